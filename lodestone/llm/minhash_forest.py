"""Near-duplicate documents by an LSH forest over MinHash signatures.

A document is the set of its distinct word shingles (64-bit hashes).  Documents
with equal sets are one node from the start.  A node has `TREES` signature
orders of `DEPTH` MinHash values each.  In each order, nodes that share the
first few values are a region (so few that a pair at the threshold misses all
regions with a chance of at most `MISSED`); to sort its nodes, a region with more than `region_rows` nodes
is cut at greater depth, and by the node's hash at full depth.  Inside a region
nodes are sorted by the rest of their values, so that those with the longest
common prefix stand side by side; a node's candidates are its next
`NEIGHBOURS` nodes, and the least node of its region and of each wider region
that was cut.  Candidates grow with the nodes, not with a region's square.

Candidates whose 128 one-byte sketches agree less than the threshold less
`ERRORS` standard errors go; what remains connects nodes to groups.  In regions
with more nodes than a node has neighbours, the sketches of nodes outside the
region's largest group are then compared with those of all its other groups, in
blocks, and groups with a pair that agrees enough are joined.  For this a region
that was cut is whole again: all its blocks meet, two in a task.

So all nodes that may be linked are in one group.  A group of up to
`region_rows` nodes and `TASK_SHINGLES` shingles goes to one task, each node's
full set once, and every pair whose ends are not connected yet is compared on
its full sets.  In a larger group each node's two likeliest candidates are
compared first; then its nodes outside the largest component meet all others in
blocks, by sketches, and by full sets where those agree enough.
Sets are computed from the texts again, for nodes in a
group only: a bitmap of fixed size, which any number of nodes may fill, lets a
worker leave out the others.

Defined results: texts that are null or hold no word have the empty set, link to
nothing and are their own component; a text with fewer words than a shingle has
its whole sequence as its one shingle; rows with a null id take part, and a
component's id is its least non-null id; rows that repeat an id are rows by
themselves with one component; a text of any length is read whole, in pieces; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.components import components
from lodestone.llm.shared import drop, table
from lodestone.llm.spans import batches, chained, mix, trim, word_hashes, worker_cache

TREES, DEPTH, MIDDLE = 16, 8, 6
MISSED = 2e-5
NEIGHBOURS = 4
SHINGLE, THRESHOLD = 5, 80
REGION_ROWS = 4096
#: Shingles whose sets meet in one task.
TASK_SHINGLES = 1 << 21
#: Standard errors by which a pair at the threshold may fall short in its sketches.
ERRORS = 4.1
BITMAP_BITS = 27
#: Bytes of an Arrow batch of texts or sets.
BATCH = 8 << 20

_RNG = np.random.default_rng(77)
_MUL = (_RNG.integers(1, 2**63, TREES * DEPTH, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_ADD = _RNG.integers(1, 2**63, TREES * DEPTH, dtype=np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    hashes, bounds = word_hashes(data, offsets)
    grams = chained(hashes, size)
    out = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        n = hi - lo
        if n >= size:
            out.append(np.unique(grams[lo : hi - size + 1]))
        elif n:
            out.append(mix(chained(hashes[lo:hi], n) ^ mix(np.array([n], np.uint64))))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_nodes(sets: list[np.ndarray]) -> np.ndarray:
    """A 64-bit name of each set (0 for the empty one)."""
    sizes = np.array([len(s) for s in sets])
    out = np.zeros(len(sets), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        flat = np.concatenate(sets)
        at = (np.cumsum(sizes) - sizes)[full]
        out[full] = mix(np.add.reduceat(mix(flat), at) ^ mix(np.add.reduceat(mix(flat ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at) + sizes[full].astype(np.uint64)))
    return out.view(np.int64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """TREES * DEPTH MinHash values (unsigned 32-bit) of each set; all ones for the empty set."""
    sizes = np.array([len(s) for s in sets])
    out = np.full((len(sets), TREES * DEPTH), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(sizes)
    if len(full):
        flat = np.concatenate(sets)
        at = (np.cumsum(sizes) - sizes)[full]
        for j in range(TREES * DEPTH):
            out[full, j] = np.minimum.reduceat(((flat * _MUL[j] + _ADD[j]) >> np.uint64(32)).astype(np.uint32), at)
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    """A binary column of equally long rows."""
    raw = np.ascontiguousarray(rows)
    width = raw.shape[1] * raw.itemsize
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer((np.arange(len(raw) + 1) * width).astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])


def signed(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """_id, n_shingles, node (null for an empty set), sig of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("minhash_forest")
        for batch in parts:
            for part, data, offsets in batches(batch, "_t"):
                sets = shingle_sets(data, offsets, size)
                n = np.array([len(s) for s in sets], np.int64)
                sig = _binary(signatures(sets).astype(">u4"))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(set_nodes(sets), mask=n == 0), sig], ["_id", "n_shingles", "node", "sig"])

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).mapInArrow(run, f"_id {kind}, n_shingles long, node long, sig binary")


def least_depth(percent: int) -> int:
    """How many values a region's nodes share: as many as leave a pair at the threshold a chance of at most MISSED to share no region."""
    depth = MIDDLE
    while depth > 1 and (1 - (percent / 100) ** depth) ** TREES > MISSED:
        depth -= 1
    return depth


def regions_of(nodes: DataFrame, depth: int, region_rows: int = REGION_ROWS, neighbours: int = NEIGHBOURS) -> DataFrame:
    """node, region, n (its nodes), others (the node's candidates there), whole (the region before it was cut, else null), for each order in which the node has company."""
    rows = nodes.select("node", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"), "sig")
    rows = rows.select("node", "tree", F.expr(f"substring(sig, tree * {4 * DEPTH} + 1, {4 * DEPTH})").alias("vals"))

    def key(values: int) -> F.Column:
        return F.xxhash64("tree", F.substring("vals", 1, 4 * values))

    def dense(df: DataFrame, name: str) -> DataFrame:
        """Regions that are too large, with their size and least node."""
        return table(df.groupBy(name).agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least")).filter(F.col("n") > region_rows), "forest-dense")

    rows = rows.withColumn("k1", key(depth)).withColumn("k2", key(MIDDLE)).withColumn("k3", key(DEPTH))
    wide = dense(rows, "k1").select("k1", F.col("least").alias("hub1"))
    inside = rows.join(wide, "k1")
    middle = dense(inside, "k2").select("k2", F.col("least").alias("hub2"), F.ceil(F.col("n") / region_rows).alias("cuts"))
    rows = rows.join(wide, "k1", "left").join(middle, "k2", "left")
    region = F.when(F.col("hub1").isNull(), F.col("k1")).when(F.col("hub2").isNull(), F.col("k2")).otherwise(F.xxhash64("k3", F.pmod("node", "cuts")))
    rows = rows.select("node", "vals", "hub1", "hub2", region.alias("region"), F.when(F.col("hub1").isNotNull(), F.col("k1")).alias("whole"))
    by, whole = Window.partitionBy("region").orderBy("vals", "node"), Window.partitionBy("region")
    near = [F.lead("node", k).over(by) for k in range(1, neighbours + 1)]
    rows = rows.select("node", "region", "whole", F.count(F.lit(1)).over(whole).alias("n"), F.array(F.min("node").over(whole), "hub1", "hub2", *near).alias("others"))
    return table(rows.filter("n > 1 or others[1] is not null"), "forest-regions")


def pairs_of(regions: DataFrame) -> DataFrame:
    """The distinct candidates a < b."""
    pairs = regions.select("node", F.explode("others").alias("other")).filter("other is not null and other <> node")
    return pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def sketches(nodes: DataFrame) -> DataFrame:
    """node, sketch: the last byte of each MinHash value."""

    def short(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(len(batch), -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), _binary(sig[:, 3::4])], ["node", "sketch"])

    return nodes.mapInArrow(short, "node long, sketch binary")


def sketch_least(percent: int) -> float:
    """The share of equal sketch bytes that a pair at the threshold has at least, but for a chance of some 2e-5."""
    j = percent / 100
    return j - ERRORS * (j * (1 - j) / (TREES * DEPTH)) ** 0.5


def likely(pairs: DataFrame, sketch: DataFrame, least: float) -> DataFrame:
    """Pairs whose sketches agree enough: a, b, agree (equal bytes, of TREES * DEPTH)."""

    def agree(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(len(batch), -1) for k in (2, 3))
            n = (x == y).sum(1)
            keep = pa.array(n >= least * TREES * DEPTH)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n.astype(np.int32))], ["a", "b", "agree"]).filter(keep)

    left = sketch.select(F.col("node").alias("a"), F.col("sketch").alias("x"))
    right = sketch.select(F.col("node").alias("b"), F.col("sketch").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(agree, "a long, b long, agree int")


def _asking(comp: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Components by number, and the rows to compare with the others: those of side 1, and where no row has a side, those outside the largest component."""
    _, comp, size = np.unique(comp, return_inverse=True, return_counts=True)
    return comp, np.flatnonzero(comp != size.argmax() if side[0] < 0 else side == 1)


def _near(sketch: np.ndarray, block: np.ndarray, least: float) -> np.ndarray:
    """For some rows against all: whether their sketches agree enough."""
    return (sketch[block][:, None, :] == sketch[None, :, :]).sum(2) >= least * sketch.shape[1]


def _blocks(rows: np.ndarray) -> list[np.ndarray]:
    return np.array_split(rows, -(-len(rows) // 64)) if len(rows) else []


def _pairs(node: np.ndarray, ends: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    i, j = np.array(ends, np.int64).reshape(-1, 2).T
    return np.minimum(node[i], node[j]), np.maximum(node[i], node[j])


def _joins(node: np.ndarray, comp: np.ndarray, sketch: np.ndarray, side: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """In one task: pairs that join all components between which sketches agree enough."""
    comp, outside = _asking(comp, side)
    ends = []
    for block in _blocks(outside):
        for i, good in zip(block.tolist(), _near(sketch, block, least), strict=True):
            for j in np.flatnonzero(good & (comp != comp[i])).tolist():
                if comp[j] != comp[i]:
                    ends.append((i, j))
                    comp[comp == comp[j]] = comp[i]
    return _pairs(node, ends)


def _wanted(comp: np.ndarray, sketch: np.ndarray, side: np.ndarray, least: float) -> np.ndarray:
    """In one task: mask of the nodes whose sketch agrees enough with that of a node in another component."""
    comp, outside = _asking(comp, side)
    out = np.zeros(len(comp), bool)
    for block in _blocks(outside):
        good = _near(sketch, block, least) & (comp[block][:, None] != comp[None, :])
        out[block] |= good.any(1)
        out |= good.any(0)
    return out


def _links(node: np.ndarray, comp: np.ndarray, side: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """In one task: links that join all components between which full sets are near enough, found by an inverted index."""
    comp, outside = _asking(comp, side)
    n = np.array([len(s) for s in sets])
    ends = []
    if len(sets) == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        if len(outside) and comp[0] != comp[1] and 100 * both >= percent * (n.sum() - both):
            ends.append((0, 1))
        return _pairs(node, ends)
    at = np.cumsum(n) - n
    _, term, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    holder = np.repeat(np.arange(len(sets)), n)[np.argsort(term, kind="stable")]
    start = np.cumsum(count) - count
    main = int(np.flatnonzero(comp == np.bincount(comp).argmax())[0])
    if side[0] < 0:
        # The main node asks first, so that those near to it need not: whatever is connected with it is compared by the others.
        outside = np.concatenate([[main], outside])
    for i in outside.tolist():
        if side[0] < 0 and i != main and comp[i] == comp[main]:
            continue
        both = np.zeros(len(sets), np.int64)
        for k in range(at[i], at[i] + n[i], 4096):
            mine = term[k : min(k + 4096, at[i] + n[i])]
            c = count[mine]
            both += np.bincount(holder[np.repeat(start[mine] - (np.cumsum(c) - c), c) + np.arange(c.sum())], minlength=len(sets))
        for j in np.flatnonzero((100 * both >= percent * (n + n[i] - both)) & (comp != comp[i])).tolist():
            if comp[j] != comp[i]:
                ends.append((i, j))
                comp[comp == comp[j]] = comp[i]
    return _pairs(node, ends)


def _tasks(rows: DataFrame, region_rows: int) -> DataFrame:
    """region (here a task's name), node, comp, side, from region, whole, node, comp, n: rows without a whole stay in their region's task (side -1), others in tasks that meet all pairs of blocks.

    Of a whole, the nodes outside its largest component (side 1) are dealt into
    chunks, all its nodes (side 0) into blocks, and each chunk meets each block,
    so that any two nodes that are apart meet.  Chunks and blocks have some
    region_rows nodes and TASK_SHINGLES shingles at most.
    """
    small = rows.filter("whole is null").select("region", "node", "comp", F.lit(-1).alias("side"))
    large = rows.filter("whole is not null").select("whole", "node", "comp", "n").distinct()
    size = large.groupBy("whole", "comp").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n"))
    size = size.groupBy("whole").agg(F.sum("c").alias("c"), F.sum("n").alias("n"), F.max(F.struct("c", "n", "comp")).alias("main")).filter(F.col("c") > F.col("main.c"))

    def parts(c: Column, n: Column) -> Column:
        return F.greatest(F.ceil(c / region_rows), F.ceil(n / TASK_SHINGLES)).cast("int")

    size = size.select("whole", F.col("main.comp").alias("main"), parts(F.col("c"), F.col("n")).alias("blocks"), parts(F.col("c") - F.col("main.c"), F.col("n") - F.col("main.n")).alias("chunks"))
    # So few that they are broadcast: a whole has more than region_rows nodes or TASK_SHINGLES shingles.
    large = large.join(F.broadcast(size), "whole")

    def own(count: str) -> Column:
        return F.pmod(F.xxhash64("node", F.lit(count)), F.col(count)).cast("int")

    def every(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    members = large.withColumn("block", own("blocks")).withColumn("chunk", every("chunks")).withColumn("side", F.lit(0))
    asking = large.filter("comp <> main").withColumn("chunk", own("chunks")).withColumn("block", every("blocks")).withColumn("side", F.lit(1))
    return small.union(members.unionByName(asking).select(F.xxhash64("whole", "chunk", "block").alias("region"), "node", "comp", "side"))


def _by_region(rows: DataFrame, one: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """one() of each region's rows, streamed in sorted order so that a task holds one region; regions of one component are left out."""

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("minhash_forest")
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                t = pa.Table.from_batches(held).combine_chunks()
                held.clear()
                comp = t["comp"].to_numpy()
                if (comp != comp[0]).any():
                    yield from one(t).to_batches()

        last = None
        for batch in batches_:
            region = batch.column(0).to_numpy()
            cuts = np.flatnonzero(region[1:] != region[:-1]) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(region)], strict=True):
                if last is not None and region[i] != last:
                    yield from flush()
                held.append(batch.slice(i, j - i))
                last = region[i]
            trim()
        yield from flush()

    return rows.repartition("region").sortWithinPartitions("region").mapInArrow(run, schema)


def _sketched(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    sketch = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint8).reshape(len(t), -1)
    return t["node"].to_numpy(), t["comp"].to_numpy(), sketch, t["side"].to_numpy()


def crossing(dense: DataFrame, comp: DataFrame, sketch: DataFrame, least: float, region_rows: int = REGION_ROWS) -> DataFrame:
    """Pairs a < b that join groups inside the regions that hold more nodes than a node has neighbours.

    A task holds a region, or two blocks of a large one, and compares its
    sketches in blocks.  What goes to a task and what it gives grows with its
    nodes, not with its pairs.
    """
    rows = dense.join(comp, "node", "left").select("region", "whole", "node", F.coalesce("comp", "node").alias("comp"), F.lit(0).alias("n"))
    rows = _tasks(rows, region_rows)
    mixed = rows.groupBy("region").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("region")
    rows = rows.join(mixed, "region").join(sketch, "node").select("region", "node", "comp", "side", "sketch")

    def one(t: pa.Table) -> pa.Table:
        node, own, near, side = _sketched(t)
        a, b = _joins(node, own, near, side, least)
        return pa.table({"a": a, "b": b})

    return _by_region(rows, one, "a long, b long")


def _linker(percent: int) -> Callable[[pa.Table], pa.Table]:
    def one(t: pa.Table) -> pa.Table:
        a, b = _links(t["node"].to_numpy(), t["comp"].to_numpy(), t["side"].to_numpy(), [np.frombuffer(x.as_buffer(), np.uint64) for x in t["shingles"]], percent)
        return pa.table({"a": a, "b": b})

    return one


def group_links(sets: DataFrame, percent: int) -> DataFrame:
    """Links a < b that join all that is linked, in groups (node, grp, shingles) of which each fits in a task."""
    rows = sets.select(F.col("grp").alias("region"), "node", F.col("node").alias("comp"), F.lit(-1).alias("side"), "shingles")
    return _by_region(rows, _linker(percent), "a long, b long")


def large_group_links(sets: DataFrame, pairs: DataFrame, sketch: DataFrame, percent: int, region_rows: int = REGION_ROWS) -> DataFrame:
    """The same in groups that do not fit (node, grp, n, shingles); pairs: a, b, agree, their likely candidates."""
    least = sketch_least(percent)
    # Each node's two likeliest candidates first; they connect most of what is connected at all.
    both = pairs.select(F.col("a").alias("node"), "a", "b", "agree").union(pairs.select("b", "a", "b", "agree"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("agree"), "a", "b"))
    first = table(confirmed(both.withColumn("rank", rank).filter("rank <= 2").select("a", "b").distinct(), sets, percent), "forest-links", BATCH)
    comp = components(first)
    rows = sets.select("node", "grp", "n").join(comp, "node", "left").select(F.col("grp").alias("region"), F.col("grp").alias("whole"), "node", F.coalesce("comp", "node").alias("comp"), "n")
    rows = _tasks(rows, region_rows).join(sketch, "node").select("region", "node", "comp", "side", "sketch")

    def one(t: pa.Table) -> pa.Table:
        _, own, near, side = _sketched(t)
        return t.select(["region", "node", "comp", "side"]).filter(pa.array(_wanted(own, near, side, least)))

    wanted = table(_by_region(rows, one, "region long, node long, comp long, side int"), "forest-wanted", BATCH)
    rows = wanted.join(sets.select("node", "shingles"), "node").select("region", "node", "comp", "side", "shingles")
    return first.union(_by_region(rows, _linker(percent), "a long, b long"))


def _bitmap(ends: DataFrame, bits: int) -> np.ndarray:
    """Bits of the column `node`, in a map whose size doesn't depend on the rows."""
    place = F.shiftrightunsigned(F.col("node"), 64 - bits)
    words = ends.groupBy(F.shiftright(place, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(node, {64 - bits}) & 63 as int))")).alias("v")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words["w"].to_numpy()] = words["v"].to_numpy().view(np.uint64)
    return out


def full_sets(docs: DataFrame, text_col: str, size: int, bitmap: np.ndarray) -> DataFrame:
    """node, shingles (sorted, packed) for the nodes in the bitmap and a few more; each partition gives a node once."""
    held = docs.sparkSession.sparkContext.broadcast(bitmap)
    shift = np.uint64(64 - (int(np.log2(len(bitmap))) + 6))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in parts:
            for _, data, offsets in batches(batch, "_t"):
                sets = shingle_sets(data, offsets, size)
                names = set_nodes(sets)
                place = names.view(np.uint64) >> shift
                hit = (held.value[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1)
                mine = [i for i in np.flatnonzero(hit).tolist() if len(sets[i]) and names[i] not in seen]
                mine = list({names[i]: i for i in mine}.values())
                if mine:
                    seen.update(names[mine].tolist())
                    yield pa.RecordBatch.from_arrays([pa.array(names[mine]), pa.array([sets[i].tobytes() for i in mine], pa.binary())], ["node", "shingles"])

    return docs.select(F.col(text_col).alias("_t")).mapInArrow(run, "node long, shingles binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b with 100 * intersection >= percent * union on their full sets."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
                    keep.append(False)
                    continue
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def groups_of(regions: DataFrame, pairs: DataFrame, sketch: DataFrame, least: float, region_rows: int = REGION_ROWS) -> DataFrame:
    """node, comp: the group of each node that may be linked with another, from likely pairs and from crowded regions."""
    comp = components(pairs)
    # In crowded regions neighbours are few of all.
    dense = regions.filter((F.col("n") > NEIGHBOURS + 1) | F.col("whole").isNotNull()).select("region", "whole", "node")
    if dense.isEmpty():
        return comp
    more = table(crossing(dense, comp, sketch, least, region_rows), "forest-joins", BATCH)
    # Of the groups so far, each node needs its group's least node only.
    return comp if more.isEmpty() else components(more.union(comp.select(F.col("node").alias("a"), F.col("comp").alias("b"))))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = THRESHOLD, region_rows: int = REGION_ROWS) -> DataFrame:
    """One row a document: id, n_shingles, component_id, kept (the id is its component's)."""
    least = sketch_least(percent)
    rows = table(signed(docs, id_col, text_col, shingle), "forest-rows", BATCH)
    nodes = table(rows.filter("node is not null").groupBy("node").agg(F.first("sig").alias("sig"), F.first("n_shingles").alias("n")), "forest-nodes")
    # Written, so that no task runs this function and another one behind it.
    sketch = table(sketches(nodes.select("node", "sig")), "forest-sketches", BATCH)
    regions = regions_of(nodes, least_depth(percent), region_rows)
    pairs = table(likely(pairs_of(regions), sketch, least), "forest-pairs")
    grouped = groups_of(regions, pairs, sketch, least, region_rows).withColumnRenamed("comp", "grp")
    grouped = grouped.join(nodes.select("node", "n"), "node")
    large = grouped.groupBy("grp").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s")).filter((F.col("c") > region_rows) | (F.col("s") > TASK_SHINGLES)).select("grp", F.lit(True).alias("large"))
    # So few that they are broadcast: each holds more than region_rows nodes or TASK_SHINGLES shingles.
    grouped = table(grouped.join(F.broadcast(large), "grp", "left"), "forest-groups")
    found = full_sets(docs, text_col, shingle, _bitmap(grouped, BITMAP_BITS)).join(grouped, "node")
    sets = table(found.groupBy("node").agg(*[F.first(c).alias(c) for c in ("grp", "n", "large", "shingles")]), "forest-sets", BATCH)
    links = table(group_links(sets.filter("large is null"), percent), "forest-links", BATCH)
    big = grouped.filter("large")
    if not big.isEmpty():
        own = pairs.join(big.select(F.col("node").alias("a")), "a", "left_semi")
        links = links.union(table(large_group_links(sets.filter("large"), own, sketch, percent, region_rows), "forest-links", BATCH))
    comp = components(links)
    for done in (nodes, sketch, regions, pairs, sets):
        drop(done)
    placed = rows.select("_id", "n_shingles", "node").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least_id = placed.filter("comp is not null").groupBy("comp").agg(F.min("_id").alias("least_id"))
    out = placed.join(least_id, "comp", "left").withColumn("component_id", F.when(F.col("comp").isNull(), F.col("_id")).otherwise(F.col("least_id")))
    return out.select(F.col("_id").alias(id_col), "n_shingles", "component_id", F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"))
