"""Analyses on small inputs with known results."""

import json
import math

import pytest
from pyspark.sql import functions as F

from lodestone.functions import geo as G
from lodestone.functions import relational as R
from lodestone.functions.register import register
from lodestone.operators import chaos, geo, graph, points, process, regression, text
from lodestone.session import cut
from lodestone.sources import geojson, tsv
from lodestone.sources.rect_space import axis, parse_spec, rect_space

#: A small graph and a short series with known results.
GRAPH = [("A", "C"), ("B", "C"), ("C", "D"), ("C", "E"), ("E", "F"), ("C", "H"), ("G", "H"), ("C", "G"), ("D", "E"), ("A", "G"), ("B", "G")]
SERIES = [("200912", 12), ("201001", 9), ("201002", 2), ("201003", 7), ("201004", 13), ("201005", 10), ("201006", 5), ("201007", 8)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(GRAPH, "v1 string, v2 string").cache()


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_grep_matches_whole_text_over_lines(spark):
    df = spark.createDataFrame([("my heart\nbeats",), ("heartless",), ("none",), (None,)], "value string")
    assert {r.value for r in text.grep(df, ".*HEART.*").collect()} == {"my heart\nbeats", "heartless"}
    assert text.grep(df, "HEART").count() == 0


def test_word_count_tokens(spark):
    df = spark.createDataFrame([('The end, the "end". (!) *a\tb*',), (None,), ("",)], "value string")
    assert {r.token: r.num for r in text.word_count(df).collect()} == {"the": 2, "end": 2, "": 2, "a\tb": 1}


def test_histogram_counts_no_null(spark):
    df = spark.createDataFrame([("joe",), ("joe",), (None,)], "user string")
    assert rows(text.histogram(df, "user").fillna("-")) == [("-", 0), ("joe", 2)]


def test_normalize(spark):
    df = spark.createDataFrame(SERIES, "month string, count int")
    got = {r.month: r.normalized for r in text.normalize_by_max(df, "count").collect()}
    assert got["201004"] == 1.0 and got["200912"] == pytest.approx(0.9230769, abs=1e-7) and got["201002"] == pytest.approx(0.15384616, abs=1e-8)
    assert text.normalize_by_max(df.limit(0), "count").count() == 0


def test_bincond_and_division(spark):
    df = spark.createDataFrame([(1, 0.0), (None, 2.0)], "a int, b double")
    got = df.select(R.bincond(F.col("a") > 0, F.lit("y"), F.lit("n")).alias("c"), R.safe_div(F.lit(1.0), "b").alias("d")).collect()
    assert [tuple(r) for r in got] == [("y", None), (None, 0.5)]


def test_group_all_of_nothing_has_no_row(spark):
    assert R.group_all(spark.range(0), F.max("id")).count() == 0
    assert R.group_all(spark.range(3), F.max("id").alias("m")).first().m == 2


def test_split_and_columns(spark):
    df = spark.createDataFrame([(1, 2, 3), (None, 5, 6)], "a int, b int, c int")
    parts = R.split_by(df, low=F.col("a") < 2, all=F.col("b") > 0)
    assert parts["low"].count() == 1 and parts["all"].count() == 2
    assert R.column_range(df, "b", "c") == ["b", "c"] and df.select(R.nth(df, 1)).columns == ["b"]


def test_zip_pads_and_cuts(spark):
    df = spark.range(1).select(F.array(F.lit("w1"), F.lit("w2"), F.lit("w3"), F.lit("w4")).alias("w"), F.array(F.lit("f1"), F.lit("f2"), F.lit("f3")).alias("f"))
    got = df.select(F.inline(R.zip_arrays(F.col("w"), F.col("f"), names=("weight", "feature")))).collect()
    assert [tuple(r) for r in got] == [("w1", "f1", 0), ("w2", "f2", 1), ("w3", "f3", 2), ("w4", None, 3)]
    short = df.select(F.size(R.zip_arrays(F.col("f"), F.col("w"))).alias("n"), R.zip_arrays(F.col("w")).alias("one")).first()
    assert short.n == 3 and short.one is None


def test_record_to_json(spark):
    df = spark.sql("""SELECT 1 AS int_field, 1L AS long_field, float(1.0) AS float_field, 1.0D AS double_field, 'Some string' AS string_field,
        array(named_struct('bag_element', "I'm in a bag!")) AS bag_field, map('a', 1) AS m, X'00' AS raw, true AS flag, CAST(null AS string) AS gone""")
    want = '{"int_field":1,"long_field":1,"float_field":1.0,"double_field":1.0,"string_field":"Some string","bag_field":[{"bag_element":"I\'m in a bag!"}]}'
    assert df.select(R.record_to_json(df)).first()[0] == want


def test_counts_by_keeps_null_key_unmatched_as_one_row(spark):
    a, b = spark.createDataFrame([("x",), (None,)], "k string"), spark.createDataFrame([("x",), ("y",)], "k string")
    got = {r.key: (r.left, r.right) for r in R.counts_by(left=(a, "k"), right=(b, "k")).collect()}
    assert got == {"x": (1, 1), "y": (0, 1), None: (0, 0)}


def test_quadkey_values(spark):
    df = spark.createDataFrame([(-97.699013, 30.265016), (0.0, 0.0), (0.0, 90.0), (0.0, -90.0), (None, 1.0)], "lng double, lat double")
    seven = [r[0] for r in df.select(G.quadkey(F.col("lng"), F.col("lat"), 7)).collect()]
    assert seven[0] == "0231301" and seven[4] is None and seven[2][0] == "1" and seven[3][0] == "3"
    assert df.select(G.quadkey(F.col("lng"), F.col("lat"), 22)).first()[0] == "0231301212200330213233"
    assert df.select(G.quadkey(F.col("lng"), F.col("lat"), 3)).collect()[1][0] == "300"
    with pytest.raises(ValueError):
        G.quadkey(F.col("lng"), F.col("lat"), 23)


def test_haversine_orders(spark):
    at = [F.lit(x) for x in (-97.74306, 30.26715, -96.64609, 28.97859)]
    got = spark.range(1).select(G.haversine(*at), G.haversine(*at, axis_order="swapped")).first()
    assert got[0] == pytest.approx(0.027977824658822228, abs=1e-14) and got[1] == pytest.approx(0.01935061352033848, abs=1e-14)


def test_registered_functions(spark):
    assert set(register(spark)) >= {"square", "quadkey", "lyapunov_henon"}
    row = spark.sql("SELECT square(3.0), tokens('a, b (c)'), clean_token('The!'), quadkey(-97.699013, 30.265016, 22), quadkey(0, 0, 3)").first()
    assert list(row) == [9.0, ["a", "b", "c"], "the", "0231301212200330213233", "300"]
    assert spark.sql("SELECT lyapunov_henon(1.0D, 0.3D)").first()[0] == pytest.approx(-0.16118836, abs=1e-4)


def test_tsv_round_trip_pads_and_keeps_quotes(spark, tmp_path):
    (tmp_path / "a.tsv").write_text('x\t1\textra\nNoreen\n"q"\tnot a number\n')
    df = tsv.read_tsv(spark, str(tmp_path / "a.tsv"), "a string, b int")
    assert rows(df.fillna(-1)) == sorted([("x", 1), ("Noreen", -1), ('"q"', -1)])
    tsv.write_tsv(df.filter("b = 1"), str(tmp_path / "out"))
    tsv.write_tsv(df.filter("b = 1"), str(tmp_path / "out"))
    assert rows(tsv.read_tsv(spark, str(tmp_path / "out"), "a string, b int")) == [("x", 1)]
    assert tsv.read_lines(spark, str(tmp_path / "a.tsv")).count() == 3 and tsv.has_rows(df)
    assert len(spark.createDataFrame([], tsv.GAZETTEER).columns) == 19


def test_rect_space(spark, tmp_path):
    assert axis(0, 1, 0) == [] and axis(2, 2, 3) == [2, 2, 2] and parse_spec("1,2,3\n\n") == [(1.0, 2.0, 3)]
    with pytest.raises(ValueError):
        parse_spec("1,2")
    long = axis(0.6, 1.6, 800)
    assert long[-1] == 1.6000000000000378 and axis(-1, 1, 800)[-1] == 0.9999999999999915
    (tmp_path / "spec").write_text("0,1,3\n5,6,2\n")
    df = rect_space(spark, path=str(tmp_path / "spec"), splits=4)
    assert [tuple(r) for r in df.collect()] == [(0, 5), (0, 6), (0.5, 5), (0.5, 6), (1, 5), (1, 6)] and df.rdd.getNumPartitions() == 4
    assert rect_space(spark, "0,1,4").count() == 4 and rect_space(spark, "0,1,2", splits=50).rdd.getNumPartitions() == 2


def test_geojson(spark):
    df = spark.createDataFrame([(1, "a", -9.5, 3.0)], "geonameid int, name string, longitude double, latitude double")
    doc = json.loads(geojson.feature_collection(df).first()[0])
    assert doc == {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [-9.5, 3.0]}, "properties": {"geonameid": 1, "name": "a"}}]}


def test_stream_through(spark):
    df = spark.createDataFrame([("b", "1"), ("a", "2")], "x string, y string")
    assert rows(process.stream_through(df, "cat", "x string, y string")) == [("a", "2"), ("b", "1")]


def test_distances_and_correlation(spark):
    df = spark.createDataFrame([(0.0, 0.0), (3.0, 4.0), (0.1, 0.0)], "x1 double, x2 double")
    d = sorted(r.dist for r in points.pairwise_distances(df).collect())
    assert len(d) == 9 and d[:3] == [0, 0, 0] and d[-1] == 5
    assert points.correlation_integral(df, 0.5).first().correlation == pytest.approx(5 / 9)
    assert points.correlation_integral(df, 0.5, sample_size=10).first().correlation == pytest.approx(0.05)
    assert points.correlation_integral(df.limit(0), 0.5).count() == 0
    sweep = {r.eps: r.correlation for r in points.correlation_sweep(df, [0.01, 0.5, 9.0]).collect()}
    assert sweep == {0.01: pytest.approx(3 / 9), 0.5: pytest.approx(5 / 9), 9.0: 1.0}
    assert points.eps_steps(3) == pytest.approx([0.001, 0.026, 0.051])


def test_distances_by_blocks(spark):
    at = [(i * 37 % 11 / 7, i * 53 % 13 / 3) for i in range(45)] + [(0.0, 0.0)] * 3 + [(None, 1.0), (2.0, None), (None, None), (float("nan"), 0.0)]
    df = spark.createDataFrame(at, "x1 double, x2 double").repartition(3)
    dist = lambda p, d: None if None in p + d else math.sqrt((p[0] - d[0]) * (p[0] - d[0]) + (p[1] - d[1]) * (p[1] - d[1]))
    expected = sorted(repr((*p, *d, dist(p, d))) for p in at for d in at)
    for block, run in ((512, 16), (7, 3), (1, 1), (4, 9)):
        assert sorted(repr(tuple(r)) for r in points.pairwise_distances(df, block=block, run=run).collect()) == expected
    assert points.pairwise_distances(df.limit(0)).count() == 0


def test_distances_take_less_than_their_doubles_on_disk(spark, tmp_path):
    df = spark.range(1500).select(F.rand(1).alias("x1"), F.rand(2).alias("x2")).coalesce(2)
    points.pairwise_distances(df).write.parquet(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1500**2
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 7 * 1500**2


def test_distances_twice_close_by_take_few_bytes_a_row(spark, tmp_path):
    df = spark.range(2500).select(F.rand(1).alias("x1"), F.rand(2).alias("x2")).coalesce(2)
    points.pairwise_distances(df).write.parquet(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2500**2
    # 5.70 bytes a row with runs of 16, 5.47 with runs of 32
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 5.6 * 2500**2


def test_tree_of_six_points():
    ids, at = ["p1", "p2", "p3", "p4", "p5", "p6"], [(7, 2), (9, 6), (8, 1), (5, 4), (4, 7), (2, 3)]
    got = {n[0]: n[1:5] for n in points.build_tree(ids, at)}
    assert got == {"p4": (1, 0, "p1", "p6"), "p1": (0, 1, "p2", "p3"), "p2": (0, 0, None, None), "p3": (0, 0, None, None), "p6": (0, 1, "p5", None), "p5": (0, 0, None, None)}
    assert points.build_tree([], []) == [] and [n[0] for n in points.build_tree(["b", "a"], [(1, 1), (1, 1)])] == ["a", "b"]


def test_forest_invariants_and_search(spark):
    df = spark.createDataFrame([(i, (i * 37 % 360) - 180.0, (i * 53 % 160) - 80.0) for i in range(400)] + [(1000, None, 1.0)], "id long, lng double, lat double")
    forest = points.kdtree_forest(df, 2).cache()
    nodes = {r.id: r for r in forest.collect()}
    tiles = {r.quadkey for r in nodes.values()}
    parts = points.kdtree_split(forest)
    assert len(nodes) == 400 and parts["roots"].count() == len(tiles) and parts["branches"].count() == 400 - len(tiles)
    for r in nodes.values():
        axis_ = ("lng", "lat")[r.axis]
        assert r.above_child is None or nodes[r.above_child][axis_] >= r[axis_]
        assert r.below_child is None or nodes[r.below_child][axis_] <= r[axis_]
    near = [(r.id, r.dist2) for r in points.forest_search(forest, 3.2, 4.1, 7).collect()]
    brute = [(str(r.id), r.dist2) for r in points.knn_bruteforce(df, 3.2, 4.1, 7).collect()]
    assert [d for _, d in near] == pytest.approx([d for _, d in brute]) and {i for i, _ in near} == {i for i, _ in brute}


def test_forest_search_ties_go_by_id(spark):
    df = spark.createDataFrame([(i, 1.0 + i % 2, 1.0) for i in range(100, 160)], "id long, lng double, lat double")
    near = [r.id for r in points.forest_search(points.kdtree_forest(df, 2), 1.0, 1.0, 7).collect()]
    assert near == [str(i) for i in range(100, 114, 2)]


def test_quadkey_knn(spark):
    df = spark.createDataFrame([(1, 0.00001, 0.00001), (2, 0.00002, 0.00001), (3, 0.00003, 0.00001), (4, 50.0, 50.0)], "id long, lng double, lat double")
    found = geo.quadkey_knn(df, 1, min_zoom=18).cache()
    got = {r.id: r.neighbor_id for r in found.collect()}
    assert got[1] == 2 and got[3] == 2 and 4 not in got
    lists = {r.id: (len(r.neighbors), r.done) for r in geo.neighbor_lists(df, found).collect()}
    assert lists[4] == (0, False) and lists[1] == (1, True)


def test_degrees_and_augment(edges, spark):
    got = {r.vertex: r.degree for r in graph.degrees(edges).collect()}
    assert got == {"A": 2, "B": 2, "C": 6, "D": 2, "E": 3, "F": 1, "G": 4, "H": 2}
    with_null = spark.createDataFrame([("x", None), ("x", "y")], "v1 string, v2 string")
    kept = {r.vertex: (r.out_degree, r.in_degree) for r in graph.degrees(with_null, keep_null_vertex=True).collect()}
    assert kept == {"x": (2, 0), "y": (0, 1), None: (0, 0)} and graph.degrees(with_null).count() == 2
    aug = rows(graph.augment_degrees(edges))
    assert len(aug) == 11 and ("A", "C", 2, 6) in aug and ("E", "F", 3, 1) in aug
    twice = edges.union(edges.filter("v2 = 'F'"))
    assert graph.augment_degrees(twice).filter("v2 = 'F'").count() == 4 and graph.augment_degrees(twice, True).filter("v2 = 'F'").count() == 1


def test_triangles(edges):
    aug = graph.augment_degrees(edges)
    assert rows(graph.oriented_edges(aug)) == sorted([("A", "C"), ("B", "C"), ("D", "C"), ("E", "C"), ("H", "C"), ("H", "G"), ("G", "C"), ("D", "E"), ("A", "G"), ("B", "G")])
    assert rows(graph.triangles(aug)) == sorted([("C", "G", "A", "C", "A", "G"), ("C", "G", "B", "C", "B", "G"), ("C", "E", "D", "C", "D", "E"), ("C", "G", "H", "C", "H", "G")])
    assert graph.open_triads(graph.oriented_edges(aug), "consecutive").count() == 4


def test_symmetric_and_neighbourhood(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("b", "c"), ("a", "c"), ("x", "x")], "v1 string, v2 string")
    assert rows(graph.symmetric_links(e)) == [("a", "b"), ("b", "c")]
    assert rows(graph.n1_edges(e, "a")) == [("b", "c"), ("b", "c")]
    assert rows(graph.undirected(e)) == [("a", "b"), ("a", "c"), ("b", "c"), ("c", "d")]


def test_jaccard(edges):
    got = {(r.v1, r.v2): r.similarity for r in graph.jaccard(edges).collect()}
    assert len(got) == 16 and graph.jaccard_pairs(edges).count() == 23
    assert got["A", "B"] == 1 and got["A", "C"] == pytest.approx(0.2) and got["C", "D"] == pytest.approx(0.25)
    assert all(got[b, a] == s for (a, b), s in got.items()) and all(got[v, v] == 1 for v in "ABCDEG")


def test_pagerank(edges, spark):
    one = {r.node: r["rank"] for r in graph.pagerank(edges, 1, dtype="float").collect()}
    assert one["A"] == one["B"] == 0 and one["C"] == pytest.approx(1.0) and one["D"] == pytest.approx(0.3625) and one["E"] == pytest.approx(1.2125) and one["F"] == pytest.approx(1.0)
    assert all(r["rank"] == 0 for r in graph.pagerank(edges, 10).collect())
    assert all(r["rank"] > 0 for r in graph.pagerank(edges, 2, base_rank="teleport").collect())
    init = {r.node: [x.node_b for x in r.out_links] for r in graph.pagerank_init(edges).collect()}
    assert init["F"] == ["dummy"] and sorted(init["C"]) == ["D", "E", "G", "H"]
    with_null = spark.createDataFrame([("x", None), ("x", "y")], "v1 string, v2 string")
    assert {r.node: r["rank"] for r in graph.pagerank(with_null, 1).collect()} == {"x": 0.0, "y": pytest.approx(0.85 * 0.5 + 0.15)}


def test_regression(spark):
    data = [(x / 10, 2 + 3 * x / 10) for x in range(-10, 11)]
    f = regression.line_features(spark.createDataFrame(data, "x double, y double"))
    step = regression.gradient_step(f, [0.0, 0.0], 0.1).first().weights
    n = len(data)
    assert step == pytest.approx([0.1 * sum(y for _, y in data) / n, 0.1 * sum(x * y for x, y in data) / n])
    w, steps = regression.fit(f, 2, 0.5, [0.0, 0.0], tol=1e-8)
    assert w == pytest.approx([2, 3], abs=1e-2) and steps > 2
    assert regression.fit(f, 2, 0.5, [0.0, 0.0], norm="l2", tol=10.0)[1] == 2
    assert regression.run_steps(f.limit(0), [0.0, 0.0], 0.1, 3) == []


def test_exponents(spark):
    df = spark.createDataFrame([(1.4, 0.3), (1.0, 0.3), (9.0, 9.0), (None, 0.3)], "x0 double, x1 double")
    got = [r.exponent for r in chaos.chaos_map(df).collect()]
    assert got[0] == pytest.approx(0.41969335, abs=1e-3) and got[1] == pytest.approx(-0.16118836, abs=1e-4) and math.isnan(got[2]) and got[3] is None
    lorenz = spark.createDataFrame([(10.0, 8 / 3, 28.0)], "s double, b double, r double")
    value = lorenz.select(chaos.lyapunov_lorenz(F.col("s"), F.col("b"), F.col("r"), transient=1000, rounds=20000)).first()[0]
    assert value == pytest.approx(0.91, abs=0.06)
    grid = chaos.exponent_grid(chaos.chaos_map(rect_space(spark, "1,1.2,2\n0.1,0.2,3"), 10, 200))
    assert grid.count() == 2 and len(grid.columns) == 4


def test_orbit(spark):
    got = chaos.henon_orbit(spark, 3).collect()
    assert (got[0].x, got[0].y) == pytest.approx((0.631354477120879, 0.1894063431)) and (got[2].x, got[2].y) == pytest.approx((0.6313544772444324, 0.189406342103157))
    assert chaos.henon_orbit(spark, 5, burn_in=2).count() == 5


def test_cut_is_a_reliable_checkpoint(spark):
    df = cut(spark.range(5))
    assert df.count() == 5 and spark.sparkContext.getCheckpointDir()
