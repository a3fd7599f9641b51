"""Mixing sources to target weights with a low-discrepancy schedule of equal-token blocks.

Each source's documents are put in a seeded hash order and laid end to end; the
stream, repeated when the target asks for it, is cut into blocks of
`block_words` words.  A Fibonacci lattice (the golden-ratio sequence in exact
integers) goes through the cumulative weights of the sources: the i-th slot of
the mix belongs to the source whose interval holds the i-th point.  The slots of
a source are ranked, and rank r takes block r.

Defined results: a null text or one without words has size 0 and is never
taken; a null source is a source of its own, after all others; a null or
repeated id is a row like any other (each input row is mixed by itself, rows
that agree in id and size are interchangeable); an empty table gives an empty
mix.  Columns beside the three that are named are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.shared import table

BLOCK_WORDS = 1024
WEIGHTS = (3, 1, 2)
TOTAL_SHARE = 1.5
MOST_REPEATS = 2
SEED = 17
HASH_BITS = 60
#: Two neighbours of the Fibonacci sequence; their quotient is the golden ratio's fraction.
LATTICE, STEP = 1836311903, 1134903170


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; null has none."""
    bare = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.length(bare) > 0, F.size(F.split(bare, "[\\x20\\x09-\\x0D]+"))).otherwise(0).cast("long")


def targets(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Shares of `total` by weight; none above `most` times its size, the excess shared again by weight."""
    out, open_, left = [0.0] * len(sizes), list(range(len(sizes))), total
    while open_:
        whole = sum(weights[i] for i in open_)
        full = [i for i in open_ if weights[i] * left / whole > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = weights[i] * left / whole
            break
        for i in full:
            out[i] = float(most * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def _lattice(edges: np.ndarray):
    def assign(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            i = p.column(0).to_numpy()
            u = (i % LATTICE) * STEP % LATTICE / LATTICE
            yield pa.RecordBatch.from_arrays([p.column(0), pa.array(np.minimum(np.searchsorted(edges, u, "right"), len(edges) - 1).astype(np.int32))], ["slot", "src"])

    return assign


def _running(df: DataFrame, group: list[str], coarse: str, order: list, value: Column, name: str) -> DataFrame:
    """Sum of `value` over the rows before, by group, in two levels so that no task gets a whole group."""
    level = df.groupBy(*group, coarse).agg(F.sum(value).alias("_s"))
    before = Window.partitionBy(*group).orderBy(coarse).rowsBetween(Window.unboundedPreceding, -1)
    level = level.select(*group, coarse, F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_b"))
    inner = Window.partitionBy(*group, coarse).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn("_i", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return out.join(level, [*group, coarse]).withColumn(name, F.col("_b") + F.col("_i")).drop("_b", "_i")


class Mix:
    """sizes: uid, doc_id, src, size. sources: dicts of src, source, source_size, target, quota. schedule: slot, src, uid, from_word, n_words."""

    def __init__(self, sizes: DataFrame, sources: list[dict], schedule: DataFrame):
        self.sizes, self.sources, self.schedule = sizes, sources, schedule


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS,
    total_share: float = TOTAL_SHARE, most: int = MOST_REPEATS, block_words: int = BLOCK_WORDS, seed: int = SEED, bucket_rows: int = 4096,
    max_sources: int = 1_000_000, uid_col: str | None = None,
) -> Mix:
    """The mix of `docs`. Weights repeat over the sources in code point order.

    One row a source is held on the driver; more than max_sources raise ValueError.
    Blocks grow beyond block_words where the mix has more of them than half the lattice's points.
    uid_col names a column of distinct longs, where the caller has one.
    """
    spark = docs.sparkSession
    # Sixty bits of a digest that SQL knows too.
    digest = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    order = F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")
    uid = F.col(uid_col) if uid_col else F.monotonically_increasing_id()
    rows = table(docs.select(uid.alias("uid"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), order.alias("h")), "mix-sizes")
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")).orderBy(F.col("source").asc_nulls_last()).limit(max_sources + 1).collect()
    if len(per) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    sizes = [r.source_size for r in per]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(per))], total_share * sum(sizes), most)
    quota = [min(math.floor(t + 0.5), most * s) for t, s in zip(goal, sizes, strict=True)]
    sources = [{"src": k, "source": r.source, "source_size": r.source_size, "target": goal[k], "quota": quota[k]} for k, r in enumerate(per)]
    # A source's hash order is cut into buckets of about bucket_rows documents.
    bits = [max(0, math.ceil(math.log2(r.n / bucket_rows))) for r in per]
    schema = "src int, known_source string, source_size long, target double, quota long, bits int"
    known = spark.createDataFrame(list(zip(range(len(per)), [r.source for r in per], sizes, goal, quota, bits, strict=True)), schema)
    rows = rows.join(known, F.col("source").eqNullSafe(F.col("known_source"))).drop("known_source")

    # Where each document lies in its source's stream.
    rows = rows.withColumn("bucket", F.expr(f"shiftright(h, {HASH_BITS} - bits)"))
    placed = _running(rows, ["src"], "bucket", ["h", "size", "uid"], F.col("size"), "off")

    # The slots: interval lengths leave room for the lattice's discrepancy; slots past a source's last block stay empty.
    while sum(quota) // block_words > LATTICE // 2:
        # More blocks than the lattice has points for: larger ones. What is taken of a document does not depend on it.
        block_words *= 2
    blocks = [-(-q // block_words) for q in quota]
    lean = 4 + math.ceil(math.log(sum(blocks) + 2))
    room = np.array([b + lean * (b > 0) for b in blocks], float)
    n_slots = int(room.sum())
    if n_slots > LATTICE:
        raise ValueError("too many slots for the lattice: raise block_words")
    edges = np.cumsum(room) / max(room.sum(), 1)
    slots = spark.range(n_slots).mapInArrow(_lattice(edges), "slot long, src int")
    slots = slots.withColumn("chunk", F.shiftright("slot", 16))
    slots = _running(slots, ["src"], "chunk", ["slot"], F.lit(1), "rank").select("slot", "src", "rank")

    # A document's piece of each block it reaches into, in each pass over the source.
    p = placed.filter("size > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    p = p.withColumn("lo", F.col("off") + F.col("pass") * F.col("source_size")).withColumn("hi", F.least(F.col("lo") + F.col("size"), F.col("quota"))).filter("hi > lo")
    p = p.withColumn("rank", F.explode(F.sequence(F.floor(F.col("lo") / block_words), F.floor((F.col("hi") - 1) / block_words))))
    start, end = F.greatest("lo", F.col("rank") * block_words), F.least("hi", (F.col("rank") + 1) * block_words)
    p = p.select("src", "rank", "uid", "doc_id", "pass", (start - F.col("lo")).alias("from_word"), (end - start).alias("n_words"))
    schedule = p.join(slots, ["src", "rank"]).select("slot", "src", "rank", "uid", "doc_id", "pass", "from_word", "n_words")
    return Mix(rows.select("uid", "doc_id", "source", "src", "size", "source_size", "target"), sources, schedule)


def taken_words(mix: Mix) -> DataFrame:
    """For each input row: the words that the schedule takes of it, repeats counted."""
    got = mix.schedule.groupBy("uid").agg(F.sum("n_words").alias("taken"))
    return mix.sizes.join(got, "uid", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))
