"""DuckDB SQL with the rows that the registered queries return."""

from __future__ import annotations

RAW = "raw AS (SELECT 'u' || a.user_id AS v1, 'u' || b.user_id AS v2 FROM events a JOIN events b ON b.event_id = a.event_id + 1)"
EDGES = f"{RAW}, edges AS (SELECT DISTINCT v1, v2 FROM raw)"
UNDIRECTED = f"{EDGES}, und AS (SELECT DISTINCT least(v1, v2) AS v1, greatest(v1, v2) AS v2 FROM edges WHERE v1 <> v2)"
POINTS = "points AS (SELECT embedding[1]::DOUBLE AS x1, embedding[2]::DOUBLE AS x2 FROM embeddings)"
WIDE = "places AS (SELECT c_custkey AS id, (c_custkey * 37 % 3600)::DOUBLE / 10 - 180 AS lng, (c_custkey * 53 % 1600)::DOUBLE / 10 - 80 AS lat FROM customer)"
NEAR = "places AS (SELECT c_custkey AS id, (c_custkey * 37 % 997)::DOUBLE / 200000 - 97 AS lng, (c_custkey * 53 % 991)::DOUBLE / 200000 + 30 AS lat FROM customer)"
SPREAD = "(p.lng - 10.05e0) * (p.lng - 10.05e0) + (p.lat - 20.03e0) * (p.lat - 20.03e0)"


def degree_table(edges: str) -> str:
    """deg: vertex, out_degree, in_degree."""
    return f"""deg AS (SELECT vertex, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (
        SELECT v1 AS vertex, count(v1) AS o, 0 AS i FROM {edges} GROUP BY v1 UNION ALL SELECT v2, 0, count(v2) FROM {edges} GROUP BY v2) GROUP BY vertex)"""


def quadkey(zoom: int, lng: str = "lng", lat: str = "lat") -> str:
    size = 256 << zoom
    x = f"(least(greatest(floor((({lng} + 180) / 360e0) * {size} + 0.5e0), 0), {size - 1})::BIGINT >> 8)"
    share = f"(0.5e0 - ln((1 + sin({lat} * pi() / 180)) / (1 - sin({lat} * pi() / 180))) / (4 * pi()))"
    y = f"(least(greatest(floor({share} * {size} + 0.5e0), 0), {size - 1})::BIGINT >> 8)"
    return f"array_to_string(list_transform(range({zoom} - 1, -1, -1), lambda i: ((({x} >> i::INT) & 1) + 2 * (({y} >> i::INT) & 1))::VARCHAR), '')"


def angle(lng1: str, lat1: str, lng2: str, lat2: str) -> str:
    up, across = f"sin((radians({lat2}) - radians({lat1})) / 2)", f"sin((radians({lng2}) - radians({lng1})) / 2)"
    return f"2 * asin(least(1e0, sqrt({up} * {up} + cos(radians({lat1})) * cos(radians({lat2})) * {across} * {across})))"


def rank_rounds(n: int) -> str:
    """r0 to rn: ranks after each step."""
    out = [f"WITH {EDGES}, n AS (SELECT v1, count(*) AS n FROM edges GROUP BY v1), links AS (SELECT e.v1, e.v2, n.n FROM edges e JOIN n USING (v1))", "r0 AS MATERIALIZED (SELECT node, 1e0 AS rank FROM (SELECT v1 AS node FROM edges UNION SELECT v2 FROM edges))"]
    for k in range(1, n + 1):
        out.append(
            f"r{k} AS MATERIALIZED (SELECT r.node, CASE WHEN coalesce(s.s, 0) > 1e-12 THEN 0.85e0 * s.s + 1e0 - 0.85e0 ELSE 0e0 END AS rank FROM r0 r LEFT JOIN "
            f"(SELECT l.v2 AS node, sum(p.rank / l.n) AS s FROM r{k - 1} p JOIN links l ON l.v1 = p.node GROUP BY l.v2) s ON s.node = r.node)"
        )
    return ", ".join(out) + f" SELECT node, round(rank, 6) AS rank FROM r{n}"


def _descent(steps: int) -> str:
    out = ["WITH f AS (SELECT l_quantity / 50 AS x, l_extendedprice / 100000 AS y FROM lineitem), g0 AS (SELECT 0 AS step, 0e0 AS w0, 0e0 AS w1)"]
    for k in range(1, steps + 1):
        out.append(
            f"g{k} AS MATERIALIZED (SELECT {k} AS step, any_value(g.w0) - (0.1e0 / count(*)) * sum(g.w0 + g.w1 * f.x - f.y) AS w0, any_value(g.w1) - (0.1e0 / count(*)) * sum(f.x * (g.w0 + g.w1 * f.x - f.y)) AS w1 FROM f, g{k - 1} g)"
        )
    return ", ".join(out)


AUGMENTED = f"{UNDIRECTED}, {degree_table('und')}, aug AS (SELECT e.v1, e.v2, a.out_degree + a.in_degree AS d1, b.out_degree + b.in_degree AS d2 FROM und e JOIN deg a ON a.vertex = e.v1 JOIN deg b ON b.vertex = e.v2)"
ORIENTED = f"{AUGMENTED}, ori AS (SELECT CASE WHEN d1 < d2 OR (d1 = d2 AND v1 < v2) THEN v1 ELSE v2 END AS v1, CASE WHEN d1 < d2 OR (d1 = d2 AND v1 < v2) THEN v2 ELSE v1 END AS v2 FROM aug WHERE d1 > 1 AND d2 > 1)"
OUT = f"{EDGES}, o AS (SELECT e.v1, e.v2, n.n FROM edges e JOIN (SELECT v1, count(*) AS n FROM edges GROUP BY v1) n USING (v1))"
SWEEP = "(VALUES (0.05e0), (0.1e0), (0.25e0), (0.5e0), (1e0)) AS s(eps)"
D2 = "(p.x1 - d.x1) * (p.x1 - d.x1) + (p.x2 - d.x2) * (p.x2 - d.x2)"
TILED = f"WITH {WIDE}, t AS (SELECT id, lng, lat, {quadkey(4)} AS quadkey FROM places), n AS (SELECT *, row_number() OVER (PARTITION BY quadkey ORDER BY lng, id::VARCHAR) AS r, count(*) OVER (PARTITION BY quadkey) AS n FROM t)"


def _knn(k: int) -> str:
    finest = quadkey(22)
    return f"""WITH {NEAR}, keyed AS (SELECT id, lng, lat, {finest} AS key FROM places),
    sizes AS (SELECT z, left(key, z) AS tile, count(*) AS n FROM keyed, (VALUES (22), (21), (20)) AS v(z) GROUP BY 1, 2),
    own AS (SELECT p.*, coalesce(max(s.z) FILTER (WHERE s.n > {k}), 20) AS zoom, max(s.n) > {k} AS done FROM keyed p JOIN sizes s ON s.tile = left(p.key, s.z) GROUP BY ALL),
    found AS (SELECT a.id, b.id AS neighbor_id, {angle('a.lng', 'a.lat', 'b.lng', 'b.lat')} AS d, a.zoom, a.done FROM own a JOIN keyed b ON left(a.key, a.zoom) = left(b.key, a.zoom) AND a.id <> b.id)
    SELECT id, neighbor_id, round(d, 12) AS distance, zoom::INT AS zoom, done FROM found QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, neighbor_id) <= {k}"""


#: Each slice's lower median is a node; the others go on below and above it, along the next axis.
TREE = f"""WITH RECURSIVE {WIDE}, t(quadkey, id, lng, lat, path, depth, r, n) AS (
    SELECT *, row_number() OVER (PARTITION BY quadkey ORDER BY lng, id), count(*) OVER (PARTITION BY quadkey) FROM (SELECT {quadkey(4)} AS quadkey, id::VARCHAR AS id, lng, lat, '' AS path, 0 AS depth FROM places)
    UNION ALL SELECT *, row_number() OVER (PARTITION BY quadkey, path ORDER BY CASE WHEN depth % 2 = 0 THEN lng ELSE lat END, id), count(*) OVER (PARTITION BY quadkey, path)
    FROM (SELECT quadkey, id, lng, lat, path || CASE WHEN r < (n - 1) // 2 + 1 THEN 'b' ELSE 'a' END AS path, depth + 1 AS depth FROM t WHERE r <> (n - 1) // 2 + 1)),
    nodes AS (SELECT * FROM t WHERE r = (n - 1) // 2 + 1)
    SELECT x.quadkey, x.id, (x.depth = 0)::INT AS is_root, (x.depth % 2)::INT AS axis, a.id AS above_child, b.id AS below_child, x.lng, x.lat FROM nodes x
    LEFT JOIN nodes a ON a.quadkey = x.quadkey AND a.path = x.path || 'a' LEFT JOIN nodes b ON b.quadkey = x.quadkey AND b.path = x.path || 'b'"""


def _map(transient: int, rounds: int, skipped: int = 100) -> str:
    """m: a, b, exponent of the map of parameters after few rounds, in the same order of arithmetic."""
    step = lambda x, y: f"b * {y} + 1e0 - a * {x} * {x}"
    start = "1e-7 / sqrt(2e0)"
    return f"""WITH RECURSIVE aa(k, a) AS (SELECT 0, 1e0 UNION ALL SELECT k + 1, a + (1.4e0 - 1e0) / 8 FROM aa WHERE k < 8), bb(k, b) AS (SELECT 0, 0.1e0 UNION ALL SELECT k + 1, b + (0.3e0 - 0.1e0) / 4 FROM bb WHERE k < 4),
    o(a, b, k, x, y, ox, oy, total, lost) AS (SELECT a, b, 0, 0e0, 0e0, 0e0, 0e0, 0e0, false FROM aa, bb
    UNION ALL SELECT a, b, k + 1, nx, x, CASE WHEN k + 1 < {transient} THEN 0e0 WHEN k + 1 = {transient} THEN nx + {start} ELSE nx + ax * (1e-7 / d) END, CASE WHEN k + 1 < {transient} THEN 0e0 WHEN k + 1 = {transient} THEN x + {start} ELSE x + ay * (1e-7 / d) END,
    CASE WHEN k + 1 - {transient} > {skipped} THEN total + ln(d / 1e-7) ELSE total END, lost OR (k >= {transient} AND NOT abs(nx) + abs(x) < 1e7)
    FROM (SELECT *, CASE WHEN k < {transient} OR lost THEN 1e0 ELSE sqrt(ax * ax + ay * ay) END AS d FROM (SELECT *, px - nx AS ax, ox - x AS ay FROM (SELECT *, {step('x', 'y')} AS nx, {step('ox', 'oy')} AS px FROM o))) WHERE k < {transient + rounds} AND NOT lost),
    m AS (SELECT round(aa.a, 6) AS a, round(bb.b, 6) AS b, round(o.total / {rounds - skipped - 1}, 6) AS exponent FROM aa CROSS JOIN bb LEFT JOIN o ON o.a = aa.a AND o.b = bb.b AND o.k = {transient + rounds} AND NOT o.lost)"""


def _fit(norm: str, test: str) -> str:
    """Descent on the sums of the features."""
    return f"""SELECT '{norm}' AS norm, step AS steps, round(w0, 6) AS w0, round(w1, 6) AS w1 FROM (WITH RECURSIVE s AS (SELECT count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM (SELECT l_quantity / 50 AS x, l_extendedprice / 100000 AS y FROM lineitem)),
    g(step, w0, w1, moved) AS (SELECT 0, 0e0, 0e0, 1e9 UNION ALL SELECT step + 1, v0, v1, (v0 - w0) * (v0 - w0) + (v1 - w1) * (v1 - w1) FROM
    (SELECT step, w0, w1, moved, w0 - 0.5e0 / n * (n * w0 + sx * w1 - sy) AS v0, w1 - 0.5e0 / n * (sx * w0 + sxx * w1 - sxy) AS v1 FROM g, s) WHERE step < 2 OR NOT {test}) SELECT * FROM g ORDER BY step DESC LIMIT 1)"""


def oracle_sql() -> dict[str, str]:
    return {
        "grep": "SELECT doc_id, text FROM documents WHERE regexp_full_match(upper(text), '.*LICENSE.*', 's')",
        "word_count": """SELECT token, count(*) AS num FROM (SELECT regexp_replace(lower(t), '[.:!?]', '', 'g') AS token FROM
            (SELECT unnest(string_split_regex(text, '[ ",()*]')) AS t FROM documents) WHERE t <> '') GROUP BY token""",
        "histogram": "SELECT user_id, count(user_id) AS num_visits FROM events GROUP BY user_id",
        "normalize": "SELECT month, count::INT AS count, round(count / max(count) OVER (), 9) AS normalized FROM (SELECT strftime(o_orderdate, '%Y%m') AS month, count(o_orderkey) AS count FROM orders GROUP BY 1)",
        "square": "SELECT c_custkey, c_acctbal * c_acctbal AS squared FROM customer",
        "split": "SELECT 'rich' AS part, c_custkey FROM customer WHERE c_acctbal > 0 UNION ALL SELECT 'large', c_custkey FROM customer WHERE c_acctbal > 5000",
        "cogroup_counts": "SELECT coalesce(a.k, b.k) AS key, coalesce(a.n, 0) AS customers, coalesce(b.n, 0) AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k = b.k",
        "group_all": "SELECT 'all' AS part, count(o_orderkey) AS n, max(o_totalprice) AS top FROM orders HAVING count(*) > 0 UNION ALL SELECT 'none', count(o_orderkey), max(o_totalprice) FROM orders WHERE o_totalprice < 0 HAVING count(*) > 0",
        "bincond": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_acctbal > 1000 THEN 'over' ELSE 'under' END AS side, round(CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal / (c_custkey % 5) END, 9) AS share FROM customer",
        "substring_names": "SELECT n_nationkey, substring(n_name, 1, 3) AS head, upper(n_name) AS upper, lower(n_name) AS lower FROM nation",
        "zip_arrays": "SELECT n_nationkey, substring(n_name, i::INT + 1, 1) AS letter, CASE WHEN i < 3 THEN substring(n_name, i::INT + 1, 1) END AS first, i::INT AS place FROM (SELECT *, unnest(range(length(n_name))) AS i FROM nation)",
        "to_json": """SELECT c_custkey, '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"' || CASE WHEN c_custkey % 2 = 0 THEN ',"c_mktsegment":"' || c_mktsegment || '"' ELSE '' END || ',"bag":[{"nation":' || c_nationkey || '}]}' AS json FROM customer""",
        "ordered_values": "SELECT l_orderkey, string_agg(l_quantity::INT::VARCHAR, ',' ORDER BY l_linenumber, l_quantity) AS quantities FROM lineitem GROUP BY l_orderkey",
        "stream_through": "SELECT n_nationkey::INT AS n_nationkey, n_regionkey::INT AS n_regionkey FROM nation",
        "pairwise_dist": f"WITH {POINTS} SELECT p.x1 AS p_x1, p.x2 AS p_x2, d.x1 AS d_x1, d.x2 AS d_x2, round(sqrt({D2}), 9) AS dist FROM points p, points d",
        "corr_integral": f"WITH {POINTS} SELECT round(count(*) / ((SELECT count(*) FROM points) * (SELECT count(*) FROM points))::DOUBLE, 12) AS correlation, 0.5e0 AS eps FROM points p, points d WHERE {D2} < 0.25e0 HAVING count(*) > 0",
        "corr_sweep": f"WITH {POINTS} SELECT round(count(*) FILTER (WHERE {D2} < eps * eps) / count(*)::DOUBLE, 12) AS correlation, eps FROM points p, points d, {SWEEP} GROUP BY eps",
        "knn_bruteforce": f"WITH {WIDE} SELECT id, round({SPREAD}, 6) AS dist2 FROM places p ORDER BY {SPREAD}, id LIMIT 10",
        "kdtree_search": f"WITH {WIDE} SELECT id, round({SPREAD}, 6) AS dist2 FROM places p ORDER BY {SPREAD}, id::VARCHAR LIMIT 10",
        "kdtree_forest": TREE,
        "kdtree_roots": f"{TILED} SELECT quadkey, id, lng, lat FROM n WHERE r = (n - 1) // 2 + 1",
        "kdtree_branches": f"{TILED} SELECT id, lng, lat FROM n WHERE r <> (n - 1) // 2 + 1",
        "quadkey": f"WITH {WIDE} SELECT id, " + ", ".join(f"{quadkey(z)} AS z{z}" for z in (4, 7, 20, 22)) + " FROM places",
        "haversine": f"WITH {WIDE} SELECT id, round({angle('lng', 'lat', '-97.74306e0', '30.26715e0')}, 9) AS angle, round({angle('lat', 'lng', '30.26715e0', '-97.74306e0')}, 9) AS swapped FROM places",
        "sql_functions": f"WITH {WIDE} SELECT id, lng * lng AS squared, {quadkey(7)} AS z7, {quadkey(21)} AS z21, round({angle('lng', 'lat', '-97.74306e0', '30.26715e0')}, 9) AS angle FROM places",
        "knn_geo": _knn(3),
        "geojson_features": f"""WITH {WIDE} SELECT '{{"type":"Feature","geometry":{{"type":"Point","coordinates":[' || floor(lng)::INT || ',' || floor(lat)::INT || ']}},"properties":{{"geonameid":' || id || '}}}}' AS feature FROM places""",
        "geojson_collection": """SELECT '{"type":"FeatureCollection","features":[' || string_agg(f, ',' ORDER BY f) || ']}' AS geojson FROM (SELECT '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || n_nationkey * 2 || ',' || (n_nationkey - 10) || ']},"properties":{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}}' AS f FROM nation)""",
        "symmetrize": f"WITH {RAW} SELECT least(v1, v2) AS v1, greatest(v1, v2) AS v2 FROM raw GROUP BY 1, 2 HAVING count(*) > 1",
        "degrees": f"WITH {RAW}, {degree_table('raw')} SELECT vertex, out_degree, in_degree, out_degree + in_degree AS degree FROM deg",
        "n1_edges": f"WITH {RAW}, near AS (SELECT v1 AS node FROM raw WHERE v1 = 'u1' OR v2 = 'u1' UNION SELECT v2 FROM raw WHERE v1 = 'u1' OR v2 = 'u1'), n AS (SELECT node FROM near WHERE node <> 'u1') SELECT v1, v2 FROM raw WHERE v1 IN (SELECT node FROM n) AND v2 IN (SELECT node FROM n)",
        "augment": f"WITH {RAW}, {degree_table('raw')}, m AS (SELECT v1, v2, count(*) AS m FROM raw GROUP BY 1, 2), r AS (SELECT v1, v2, unnest(range(m * m)) AS k FROM m) SELECT r.v1, r.v2, a.out_degree + a.in_degree AS deg_v1, b.out_degree + b.in_degree AS deg_v2 FROM r JOIN deg a ON a.vertex = r.v1 JOIN deg b ON b.vertex = r.v2",
        "oriented_edges": f"WITH {ORIENTED} SELECT v1, v2 FROM ori",
        "triangles": f"WITH {ORIENTED} SELECT c.v1, c.v2, a.v1 AS t1_v1, a.v2 AS t1_v2, b.v1 AS t2_v1, b.v2 AS t2_v2 FROM ori a JOIN ori b ON a.v1 = b.v1 AND a.v2 < b.v2 JOIN und c ON c.v1 = least(a.v2, b.v2) AND c.v2 = greatest(a.v2, b.v2)",
        "triads_consecutive": f"WITH {ORIENTED}, t AS (SELECT v1 AS t1_v1, v2 AS t1_v2, v1 AS t2_v1, lead(v2) OVER (PARTITION BY v1 ORDER BY v2) AS t2_v2 FROM ori) SELECT * FROM t WHERE t2_v2 IS NOT NULL",
        "jaccard_pairs": f"WITH {OUT} SELECT a.v1, b.v1 AS v2, a.n + b.n AS added_size FROM o a JOIN o b ON a.v2 = b.v2",
        "jaccard": f"WITH {OUT} SELECT a.v1, b.v1 AS v2, round(count(*) / (any_value(a.n) + any_value(b.n) - count(*))::DOUBLE, 9) AS similarity FROM o a JOIN o b ON a.v2 = b.v2 GROUP BY a.v1, b.v1",
        "pagerank_init": f"WITH {EDGES}, nodes AS (SELECT v1 AS node FROM edges UNION SELECT v2 FROM edges) SELECT node, 1e0 AS rank, greatest(count(v2), 1)::INT AS n_links, coalesce(string_agg(v2, ',' ORDER BY v2), 'dummy') AS links FROM nodes LEFT JOIN edges ON v1 = node GROUP BY node",
        "pagerank_step": rank_rounds(1),
        "pagerank": rank_rounds(3),
        "pagerank_10": rank_rounds(10),
        "lm_step": _descent(1) + " SELECT round(w0, 9) AS w0, round(w1, 9) AS w1 FROM g1",
        "lm_steps": _descent(3) + " SELECT step, round(w0, 9) AS w0, round(w1, 9) AS w1 FROM (FROM g1 UNION ALL FROM g2 UNION ALL FROM g3)",
        "rect_space": "SELECT round(0.6e0 + a * (1e0 / 40), 9) AS x0, round(-1e0 + b * (2e0 / 20), 9) AS x1 FROM range(41) AS s(a), range(21) AS t(b)",
        "lyapunov_map_short": _map(20, 140) + " SELECT a, b, exponent FROM m",
        "lyapunov_grid_short": _map(20, 140) + " SELECT a, " + ", ".join(f"max(exponent) FILTER (WHERE b = {b}) AS b{str(b).replace('.', '_')}" for b in (0.1, 0.15, 0.2, 0.25, 0.3)) + " FROM m GROUP BY a",
        "descent": _fit("sq_l2", "moved < 1e-6") + " UNION ALL " + _fit("l2", "sqrt(moved) < 1e-2"),
        "tsv_round_trip": "SELECT c_custkey, c_name, c_acctbal FROM customer",
        "nested_round_trip": f"WITH {EDGES}, nodes AS (SELECT v1 AS node FROM edges UNION SELECT v2 FROM edges) SELECT node, 1e0 AS rank, coalesce(v2, 'dummy') AS node_b FROM nodes LEFT JOIN edges ON v1 = node",
        "triads_streamed": f"WITH {ORIENTED}, t AS (SELECT v1 AS t1_v1, v2 AS t1_v2, v1 AS t2_v1, lead(v2) OVER (PARTITION BY v1 ORDER BY v2) AS t2_v2 FROM ori) SELECT * FROM t WHERE t2_v2 IS NOT NULL",
        "henon_orbit_60": "WITH RECURSIVE o(step, x, y) AS (SELECT 1::BIGINT, 0.1e0 + 1e0 - 1.4e0 * 0.1e0 * 0.1e0, 0.3e0 * 0.1e0 UNION ALL SELECT step + 1, y + 1e0 - 1.4e0 * x * x, 0.3e0 * x FROM o WHERE step < 60) SELECT step, round(x, 6) AS x, round(y, 6) AS y FROM o",
    }
