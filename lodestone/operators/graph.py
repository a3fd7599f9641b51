"""Analyses of directed edge lists (v1, v2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.relational import bincond, counts_by, safe_div
from lodestone.session import cut

#: Fixed values of the rank step.
DAMPING = 0.85
LEAST_SUM = 1e-12


def undirected(edges: DataFrame) -> DataFrame:
    """Each pair of distinct, non-null ends once, the lesser end first."""
    return edges.filter("v1 <> v2").select(F.least("v1", "v2").alias("v1"), F.greatest("v1", "v2").alias("v2")).distinct()


def symmetric_links(edges: DataFrame) -> DataFrame:
    """Unordered pairs that occur twice or more, in whatever direction (a repeated edge counts)."""
    less = F.col("v1") < F.col("v2")
    ends = edges.select(bincond(less, F.col("v1"), F.col("v2")).alias("v1"), bincond(less, F.col("v2"), F.col("v1")).alias("v2"))
    return ends.groupBy("v1", "v2").agg(F.count("v1").alias("_n")).filter("_n > 1").select("v1", "v2")


def degrees(edges: DataFrame, keep_null_vertex: bool = False) -> DataFrame:
    """vertex, out_degree, in_degree, degree. The null vertex, where it is kept, has counts of 0."""
    out = counts_by(out_degree=(edges, "v1"), in_degree=(edges, "v2")).withColumnRenamed("key", "vertex")
    out = out.withColumn("degree", F.col("out_degree") + F.col("in_degree"))
    return out if keep_null_vertex else out.filter("vertex is not null")


def n1_edges(edges: DataFrame, seed: str) -> DataFrame:
    """Edges between neighbours of the seed, which is none of them; repeated edges stay."""
    touching = edges.filter((F.col("v1") == seed) | (F.col("v2") == seed))
    near = touching.select(F.col("v1").alias("node")).union(touching.select("v2")).filter(F.col("node") != seed).distinct()
    out = edges.join(near.withColumnRenamed("node", "v1"), "v1", "left_semi")
    return out.join(near.withColumnRenamed("node", "v2"), "v2", "left_semi").select("v1", "v2")


def augment_degrees(edges: DataFrame, distinct_edges: bool = False) -> DataFrame:
    """v1, v2, deg_v1, deg_v2: degrees in and out together; an edge that occurs m times comes m * m times unless distinct_edges."""
    deg = degrees(edges).select("vertex", "degree")
    known = edges.filter("v1 is not null and v2 is not null").groupBy("v1", "v2").agg(F.count(F.lit(1)).alias("_m"))
    out = known.join(deg.select(F.col("vertex").alias("v1"), F.col("degree").alias("deg_v1")), "v1").join(deg.select(F.col("vertex").alias("v2"), F.col("degree").alias("deg_v2")), "v2")
    if not distinct_edges:
        out = out.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_m") * F.col("_m"))))
    return out.select("v1", "v2", "deg_v1", "deg_v2")


def oriented_edges(augmented: DataFrame) -> DataFrame:
    """Edges whose ends both have company, from the end of lesser degree to the other; ties by name."""
    rows = augmented.filter((F.col("deg_v1") > 1) & (F.col("deg_v2") > 1))
    forward = (F.col("deg_v1") < F.col("deg_v2")) | ((F.col("deg_v1") == F.col("deg_v2")) & (F.col("v1") < F.col("v2")))
    return rows.select(bincond(forward, F.col("v1"), F.col("v2")).alias("v1"), bincond(forward, F.col("v2"), F.col("v1")).alias("v2"))


def open_triads(oriented: DataFrame, pairing: str = "all") -> DataFrame:
    """t1_v1, t1_v2, t2_v1, t2_v2: two edges out of one vertex, t1_v2 before t2_v2.

    Edges leave the end of lesser degree, so that a vertex has few however large
    its degree is.  pairing "consecutive" pairs each edge with the next one only.
    """
    if pairing == "consecutive":
        nxt = F.lead("v2").over(Window.partitionBy("v1").orderBy("v2"))
        out = oriented.select(F.col("v1").alias("t1_v1"), F.col("v2").alias("t1_v2"), F.col("v1").alias("t2_v1"), nxt.alias("t2_v2"))
        return out.filter("t2_v2 is not null")
    a = oriented.select(F.col("v1").alias("t1_v1"), F.col("v2").alias("t1_v2"))
    b = oriented.select(F.col("v1").alias("t2_v1"), F.col("v2").alias("t2_v2"))
    return a.join(b, (F.col("t1_v1") == F.col("t2_v1")) & (F.col("t1_v2") < F.col("t2_v2")))


def triangles(augmented: DataFrame, pairing: str = "all") -> DataFrame:
    """v1, v2 (the closing edge, sorted) and the triad it closes; edges that repeat give repeated triangles."""
    closing = augmented.select(F.least("v1", "v2").alias("v1"), F.greatest("v1", "v2").alias("v2"))
    triads = open_triads(oriented_edges(augmented), pairing)
    triads = triads.select(F.least("t1_v2", "t2_v2").alias("v1"), F.greatest("t1_v2", "t2_v2").alias("v2"), "t1_v1", "t1_v2", "t2_v1", "t2_v2")
    return closing.join(triads, ["v1", "v2"])


def _out_counts(edges: DataFrame) -> DataFrame:
    """Edges with the number of edges out of v1."""
    return edges.join(edges.groupBy("v1").agg(F.count("v1").alias("v1_out")), "v1")


def jaccard_pairs(edges: DataFrame) -> DataFrame:
    """v1, v2, added_size: for each vertex that both point to, one row with the sizes of both neighbourhoods added."""
    rows = _out_counts(edges)
    a = rows.select(F.col("v1").alias("x"), F.col("v2").alias("c"), F.col("v1_out").alias("n"))
    b = rows.select(F.col("v1").alias("y"), F.col("v2").alias("c"), F.col("v1_out").alias("m"))
    return a.join(b, "c").select(F.col("x").alias("v1"), F.col("y").alias("v2"), (F.col("n") + F.col("m")).alias("added_size"))


def jaccard(edges: DataFrame) -> DataFrame:
    """v1, v2, similarity of the vertices they point to, for pairs that share one, in both directions and with themselves. Edges must be distinct."""
    both = jaccard_pairs(edges).groupBy("v1", "v2").agg(F.count(F.lit(1)).alias("n"), F.max("added_size").alias("total"))
    return both.select("v1", "v2", safe_div(F.col("n").cast("double"), (F.col("total") - F.col("n")).cast("double")).alias("similarity"))


def pagerank_init(edges: DataFrame, keep_null_node: bool = False) -> DataFrame:
    """node, rank 1 and out_links of every vertex; out_links of a vertex without any is ['dummy']."""
    own = edges.groupBy(F.col("v1").alias("node")).agg(F.collect_list(F.struct(F.col("v2").alias("node_b"))).alias("out_links"))
    none = edges.select(F.col("v2").alias("node")).distinct().join(edges.select(F.col("v1").alias("node")).distinct(), "node", "left_anti")
    none = none.withColumn("out_links", F.array(F.struct(F.lit("dummy").alias("node_b"))))
    out = own.unionByName(none).select("node", F.lit(1.0).cast("float").alias("rank"), "out_links")
    return out if keep_null_node else out.filter("node is not null")


def rank_state(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ranks (node, rank 1) and links (node, v2, share of each link), the flat form of pagerank_init."""
    out = edges.groupBy("v1").agg(F.count(F.lit(1)).alias("n"))
    links = edges.join(out, "v1").select(F.col("v1").alias("node"), "v2", "n")
    nodes = edges.select(F.col("v1").alias("node")).union(edges.select("v2")).filter("node is not null").distinct()
    return nodes.withColumn("rank", F.lit(1.0)), links


def pagerank_step(ranks: DataFrame, links: DataFrame, damping: float = DAMPING, base_rank: str = "zero", dtype: str = "double") -> DataFrame:
    """node, rank after one step. A vertex that receives nothing gets 0, or with base_rank "teleport" the teleport share.

    Shares are added before the second shuffle, so that a vertex with many links
    in costs one row a task.
    """
    share = (F.col("rank") / F.col("n")).cast(dtype)
    sums = ranks.join(links, "node").select("v2", share.alias("s")).filter("v2 is not null").groupBy(F.col("v2").alias("node")).agg(F.sum("s").alias("s"))
    got = F.coalesce(F.col("s"), F.lit(0.0))
    moved = (F.lit(damping) * got + F.lit(1.0) - F.lit(damping)).cast(dtype)
    if base_rank == "zero":
        moved = F.when(got > LEAST_SUM, moved).otherwise(F.lit(0.0).cast(dtype))
    return ranks.select("node").join(sums, "node", "left").select("node", moved.alias("rank"))


def pagerank(edges: DataFrame, iterations: int = 10, damping: float = DAMPING, base_rank: str = "zero", dtype: str = "double", cut_every: int = 4) -> DataFrame:
    """node, rank after so many steps from rank 1; the lineage is cut every few steps."""
    ranks, links = rank_state(edges)
    links = cut(links)
    ranks = ranks.withColumn("rank", F.col("rank").cast(dtype))
    for k in range(iterations):
        ranks = pagerank_step(ranks, links, damping, base_rank, dtype)
        if (k + 1) % cut_every == 0 and k + 1 < iterations:
            ranks = cut(ranks)
    return ranks
