"""The registered queries over the driver's tables, one for each operator and analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import geo as G
from lodestone.functions import relational as R
from lodestone.functions.register import register
from lodestone.operators import chaos, geo, graph, points, process, regression, text
from lodestone.plans import inputs as I
from lodestone.session import shared_path
from lodestone.sources import geojson, tsv
from lodestone.sources.rect_space import rect_space

SPACE = "0.6,1.6,41\n-1,1,21"
MAP_SPACE = "1.0,1.4,9\n0.1,0.3,5"
SWEEP = [0.05, 0.1, 0.25, 0.5, 1.0]
SEED_USER = "u1"


def _rounded(df: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _rounded_scaled(df: DataFrame, c: str, digits: int = 9) -> DataFrame:
    """c, at least 0, rounded as DuckDB does: the scaled double, not the double's decimal digits, which take longer than all else of a row."""
    scaled, whole = F.col(c) * 10.0**digits, F.floor(F.col(c) * 10.0**digits)
    # from 2^52 on doubles have no fraction; NaN is not below it
    return df.withColumn(c, F.when(scaled < 2.0**52, F.when(scaled - whole >= 0.5, whole + 1).otherwise(whole)).otherwise(scaled) / 10.0**digits)


# Text and counts


def grep(spark: SparkSession, d: str) -> DataFrame:
    return text.grep(I.read(spark, d, "documents"), ".*LICENSE.*", "text").select("doc_id", "text")


def word_count(spark: SparkSession, d: str) -> DataFrame:
    return text.word_count(I.read(spark, d, "documents"), "text")


def histogram(spark: SparkSession, d: str) -> DataFrame:
    return text.histogram(I.read(spark, d, "events"), "user_id")


def normalize(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(text.normalize_by_max(I.monthly_orders(spark, d), "count", dtype="double"), "normalized")


def square(spark: SparkSession, d: str) -> DataFrame:
    return I.read(spark, d, "customer").select("c_custkey", R.square("c_acctbal").alias("squared"))


def split(spark: SparkSession, d: str) -> DataFrame:
    parts = R.split_by(I.read(spark, d, "customer"), rich=F.col("c_acctbal") > 0, large=F.col("c_acctbal") > 5000)
    return parts["rich"].select(F.lit("rich").alias("part"), "c_custkey").union(parts["large"].select(F.lit("large").alias("part"), "c_custkey"))


def cogroup_counts(spark: SparkSession, d: str) -> DataFrame:
    return R.counts_by(customers=(I.read(spark, d, "customer"), "c_nationkey"), suppliers=(I.read(spark, d, "supplier"), "s_nationkey"))


def group_all(spark: SparkSession, d: str) -> DataFrame:
    o = I.read(spark, d, "orders")
    whole = R.group_all(o, F.count("o_orderkey").alias("n"), F.max("o_totalprice").alias("top")).select(F.lit("all").alias("part"), "n", "top")
    none = R.group_all(o.filter("o_totalprice < 0"), F.count("o_orderkey").alias("n"), F.max("o_totalprice").alias("top")).select(F.lit("none").alias("part"), "n", "top")
    return whole.union(none)


def bincond(spark: SparkSession, d: str) -> DataFrame:
    c = I.read(spark, d, "customer").withColumn("limit", F.when(F.col("c_custkey") % 3 != 0, F.lit(1000.0)))
    return c.select("c_custkey", R.bincond(F.col("c_acctbal") > F.col("limit"), F.lit("over"), F.lit("under")).alias("side"), F.round(R.safe_div(F.col("c_acctbal"), (F.col("c_custkey") % 5).cast("double")), 9).alias("share"))


def substring_names(spark: SparkSession, d: str) -> DataFrame:
    n = I.read(spark, d, "nation")
    return n.select(R.nth(n, 0).alias("n_nationkey"), R.substring0("n_name", 0, 3).alias("head"), F.upper("n_name").alias("upper"), F.lower("n_name").alias("lower"))


def zip_arrays(spark: SparkSession, d: str) -> DataFrame:
    w = F.split("n_name", "")
    n = I.read(spark, d, "nation").select("n_nationkey", F.explode(R.zip_arrays(w, F.slice(w, 1, 3), names=("letter", "first"))).alias("z"))
    return n.select("n_nationkey", "z.letter", "z.first", F.col("z.order").alias("place"))


def to_json(spark: SparkSession, d: str) -> DataFrame:
    c = I.read(spark, d, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("c_mktsegment"), F.array(F.struct(F.col("c_nationkey").alias("nation"))).alias("bag"), F.create_map(F.lit("a"), F.lit(1)).alias("skipped"))
    return c.select("c_custkey", R.record_to_json(c).alias("json"))


def ordered_values(spark: SparkSession, d: str) -> DataFrame:
    pairs = F.collect_list(F.struct("l_linenumber", "l_quantity"))
    bag = I.read(spark, d, "lineitem").groupBy("l_orderkey").agg(pairs.alias("bag"))
    return bag.select("l_orderkey", F.concat_ws(",", F.transform(R.ordered_values(F.col("bag"), "l_quantity"), lambda q: q.cast("int").cast("string"))).alias("quantities"))


def stream_through(spark: SparkSession, d: str) -> DataFrame:
    return process.stream_through(I.read(spark, d, "nation").select("n_nationkey", "n_regionkey"), "cat", "n_nationkey string, n_regionkey string").select(F.col("n_nationkey").cast("int").alias("n_nationkey"), F.col("n_regionkey").cast("int").alias("n_regionkey"))


# Points


def pairwise_dist(spark: SparkSession, d: str) -> DataFrame:
    return _rounded_scaled(points.pairwise_distances(I.points(spark, d)), "dist")


def corr_integral(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(points.correlation_integral(I.points(spark, d), 0.5), "correlation", digits=12)


def corr_sweep(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(points.correlation_sweep(I.points(spark, d), SWEEP), "correlation", digits=12)


def knn_bruteforce(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(points.knn_bruteforce(I.wide_places(spark, d), 10.05, 20.03, 10), "dist2", digits=6)


def kdtree_forest(spark: SparkSession, d: str) -> DataFrame:
    return points.kdtree_forest(I.wide_places(spark, d), 4)


def kdtree_roots(spark: SparkSession, d: str) -> DataFrame:
    return points.kdtree_forest(I.wide_places(spark, d), 4).filter("is_root = 1").select("quadkey", F.col("id").cast("long").alias("id"), "lng", "lat")


def kdtree_branches(spark: SparkSession, d: str) -> DataFrame:
    return points.kdtree_split(points.kdtree_forest(I.wide_places(spark, d), 4))["branches"].select(F.col("id").cast("long").alias("id"), "lng", "lat")


def kdtree_search(spark: SparkSession, d: str) -> DataFrame:
    found = points.forest_search(points.kdtree_forest(I.wide_places(spark, d), 4), 10.05, 20.03, 10)
    return _rounded(found.select(F.col("id").cast("long").alias("id"), "dist2"), "dist2", digits=6)


# Places


def quadkey(spark: SparkSession, d: str) -> DataFrame:
    w = I.wide_places(spark, d)
    return w.select("id", *[G.quadkey(F.col("lng"), F.col("lat"), z).alias(f"z{z}") for z in (4, 7, 20, 22)])


def haversine(spark: SparkSession, d: str) -> DataFrame:
    w = I.wide_places(spark, d)
    here = [F.col("lng"), F.col("lat"), F.lit(-97.74306), F.lit(30.26715)]
    return w.select("id", F.round(G.haversine(*here), 9).alias("angle"), F.round(G.haversine(*here, axis_order="swapped"), 9).alias("swapped"))


def knn_geo(spark: SparkSession, d: str) -> DataFrame:
    return geo.quadkey_knn(I.near_places(spark, d), 3).select("id", "neighbor_id", F.round("distance", 12).alias("distance"), "zoom", "done")


def geojson_features(spark: SparkSession, d: str) -> DataFrame:
    w = I.wide_places(spark, d).select(F.col("id").alias("geonameid"), F.floor("lng").cast("int").alias("longitude"), F.floor("lat").cast("int").alias("latitude"))
    return geojson.features(w)


def geojson_collection(spark: SparkSession, d: str) -> DataFrame:
    n = I.read(spark, d, "nation").select("n_nationkey", "n_name", (F.col("n_nationkey") * 2).alias("longitude"), (F.col("n_nationkey") - 10).alias("latitude"))
    return geojson.feature_collection(n)


def sql_functions(spark: SparkSession, d: str) -> DataFrame:
    register(spark)
    return spark.sql("SELECT id, square(lng) AS squared, quadkey(lng, lat, 7) AS z7, quadkey(lng, lat, 21) AS z21, round(haversine(lng, lat, -97.74306, 30.26715), 9) AS angle FROM {w}", w=I.wide_places(spark, d))


# Graphs


def symmetrize(spark: SparkSession, d: str) -> DataFrame:
    return graph.symmetric_links(I.raw_edges(spark, d))


def degrees(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(I.raw_edges(spark, d))


def n1_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.n1_edges(I.raw_edges(spark, d), SEED_USER)


def augment(spark: SparkSession, d: str) -> DataFrame:
    return graph.augment_degrees(I.raw_edges(spark, d))


def oriented_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.oriented_edges(graph.augment_degrees(graph.undirected(I.edges(spark, d))))


def triangles(spark: SparkSession, d: str) -> DataFrame:
    return graph.triangles(graph.augment_degrees(graph.undirected(I.edges(spark, d))))


def triads_consecutive(spark: SparkSession, d: str) -> DataFrame:
    return graph.open_triads(graph.oriented_edges(graph.augment_degrees(graph.undirected(I.edges(spark, d)))), "consecutive")


def jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    return graph.jaccard_pairs(I.edges(spark, d))


def jaccard(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(graph.jaccard(I.edges(spark, d)), "similarity")


def pagerank_init(spark: SparkSession, d: str) -> DataFrame:
    return graph.pagerank_init(I.edges(spark, d)).select("node", F.col("rank").cast("double").alias("rank"), F.size("out_links").alias("n_links"), F.array_join(F.array_sort(F.transform("out_links", lambda x: x["node_b"])), ",").alias("links"))


def pagerank_step(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(graph.pagerank_step(*graph.rank_state(I.edges(spark, d))), "rank", digits=6)


def pagerank(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(graph.pagerank(I.edges(spark, d), 3), "rank", digits=6)


def pagerank_10(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(graph.pagerank(I.edges(spark, d), 10), "rank", digits=6)


# Regression


def lm_step(spark: SparkSession, d: str) -> DataFrame:
    w = regression.gradient_step(regression.line_features(I.line_rows(spark, d)), [0.0, 0.0], 0.1)
    return w.select(F.round(F.get("weights", F.lit(0)), 9).alias("w0"), F.round(F.get("weights", F.lit(1)), 9).alias("w1"))


def lm_steps(spark: SparkSession, d: str) -> DataFrame:
    found = regression.run_steps(regression.line_features(I.line_rows(spark, d)), [0.0, 0.0], 0.1, 3)
    return spark.createDataFrame([(k + 1, round(w[0], 9), round(w[1], 9)) for k, w in enumerate(found)], "step int, w0 double, w1 double")


# Chaotic systems


def rect_space_points(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(rect_space(spark, SPACE, splits=20), "x0", "x1")


def henon_orbit(spark: SparkSession, d: str) -> DataFrame:
    return chaos.henon_orbit(spark)


def henon_orbit_60(spark: SparkSession, d: str) -> DataFrame:
    """So few steps that arithmetic in another order gives the same six digits."""
    return _rounded(chaos.henon_orbit(spark, 60, x=0.1, y=0.1), "x", "y", digits=6)


def _map(spark: SparkSession, **rounds: int) -> DataFrame:
    return chaos.chaos_map(rect_space(spark, MAP_SPACE, splits=8), **rounds)


def lyapunov_map(spark: SparkSession, d: str) -> DataFrame:
    return _map(spark)


def lyapunov_map_short(spark: SparkSession, d: str) -> DataFrame:
    """The map after few rounds, which SQL can repeat; null where a system leaves all bounds."""
    found = _map(spark, transient=20, rounds=140)
    return found.select(F.round("a", 6).alias("a"), F.round("b", 6).alias("b"), F.round(F.when(~F.isnan("exponent"), F.col("exponent")), 6).alias("exponent"))


def lyapunov_grid(spark: SparkSession, d: str) -> DataFrame:
    return chaos.exponent_grid(_map(spark))


def lyapunov_grid_short(spark: SparkSession, d: str) -> DataFrame:
    grid = chaos.exponent_grid(_map(spark, transient=20, rounds=140))
    return grid.select("a", *[F.round(F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")), 6).alias("b" + c.replace(".", "_")) for c in grid.columns[1:]])


def lyapunov_lorenz(spark: SparkSession, d: str) -> DataFrame:
    systems = spark.createDataFrame([(10.0, 8 / 3, 28.0), (10.0, 8 / 3, 14.0)], "sigma double, beta double, rho double")
    return systems.withColumn("exponent", chaos.lyapunov_lorenz(F.col("sigma"), F.col("beta"), F.col("rho")))


# Sources and sinks


def tsv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Both parts of a split, stored, and read again by a glob."""
    c = I.read(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    base = shared_path(spark, "tsv")
    tsv.store_both(R.split_by(c, rich=F.col("c_acctbal") > 5000, others=F.col("c_acctbal") <= 5000), base)
    return tsv.read_tsv(spark, f"{base}/*", "c_custkey bigint, c_name string, c_acctbal double")


def nested_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Vertices with a bag of their links as text, read again and flattened."""
    state = graph.pagerank_init(I.edges(spark, d)).select("node", F.col("rank").cast("double").alias("rank"), "out_links")
    path = shared_path(spark, "state")
    tsv.write_nested(state, path)
    back = tsv.read_nested(spark, path, state.schema)
    return back.select("node", "rank", F.inline("out_links"))


def triads_streamed(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring links of a vertex, paired by a child process over sorted partitions."""
    links = graph.oriented_edges(graph.augment_degrees(graph.undirected(I.edges(spark, d)))).select("v1", "v2").repartition("v1").sortWithinPartitions("v1", "v2")
    pair = r"""awk -F'\t' -v OFS='\t' '{ if ($1 == p) print p, q, $1, $2; p = $1; q = $2 }'"""
    return process.stream_through(links, pair, "t1_v1 string, t1_v2 string, t2_v1 string, t2_v2 string")


def descent(spark: SparkSession, d: str) -> DataFrame:
    """Descent until a step is small, by both norms."""
    features = regression.line_features(I.line_rows(spark, d))
    found = [(norm, *regression.fit(features, 2, alpha=0.5, start=[0.0, 0.0], norm=norm, tol=tol)) for norm, tol in (("sq_l2", 1e-6), ("l2", 1e-2))]
    return spark.createDataFrame([(norm, steps, round(w[0], 6), round(w[1], 6)) for norm, w, steps in found], "norm string, steps int, w0 double, w1 double")


_ALL = [
    grep, word_count, histogram, normalize, square, split, cogroup_counts, group_all, bincond, substring_names, zip_arrays, to_json, ordered_values, stream_through,
    pairwise_dist, corr_integral, corr_sweep, knn_bruteforce, kdtree_forest, kdtree_roots, kdtree_branches, kdtree_search,
    quadkey, haversine, sql_functions, knn_geo, geojson_features, geojson_collection,
    symmetrize, degrees, n1_edges, augment, oriented_edges, triangles, triads_consecutive, jaccard_pairs, jaccard, pagerank_init, pagerank_step, pagerank, pagerank_10,
    lm_step, lm_steps, descent, henon_orbit, henon_orbit_60, lyapunov_map, lyapunov_map_short, lyapunov_grid, lyapunov_grid_short, lyapunov_lorenz,
    tsv_round_trip, nested_round_trip, triads_streamed,
]


def queries() -> dict:
    return {f.__name__: f for f in _ALL} | {"rect_space": rect_space_points}
