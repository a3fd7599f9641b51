"""Language-model scores by a hashed maximum-entropy model with class-factored softmax.

A text is its lower-cased (A-Z) words and one end token.  A token's class is one
of `CLASSES` by its last two bytes.  In each class the `OWN` most frequent tokens
have a leaf each, and a hash deals the others to as many leaves again:

    P(token | context) = P(class | context) * P(leaf | class, context) * P(token | leaf)

The first two are softmaxes over hashed features of the context: the word
before, the two words before, the word before that (skipping one), and the
classes of the two words before.  P(token | leaf) is 1 for a token's own leaf,
else (c + 1) / (N + V + 1) over the leaf's tokens, so that every unknown token of
a leaf has the same last share.

Training: token counts and then synchronous gradient rounds, each over all
training texts.  A round moves each weight by the logarithm of what its feature
was seen with against what the model expected of it (a gradient step scaled by
the expectation, smoothed by `KAPPA`, shared among the features of a context).
In the first round all weights are zero, so that expectations follow from
counts; in the others they are sums of probabilities over all tokens.  Sums are
of integers (probabilities in units of 2 ** -`FINE`), so that the model does not
depend on how rows are dealt to partitions.  The weights have a fixed size.

Counts: rows are written in chunks of about `chunk_bytes`.  Each chunk sends its
distinct tokens once, as sorted packed arrays by ranges of their hashes; each
range sums them and sends every chunk its tokens and their counts back.

Defined results: a null text is empty and holds the end token alone; a null id
is neither held out nor learned from; without training texts every token is
unknown (score and base score stay finite); repeated rows score alike; a text of
any length is read whole, in pieces; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import table
from lodestone.llm.spans import LOWER, Words, as_bytes, mix, pieces, trim, word_span_hashes, worker_cache

CLASSES, LEAVES, OWN = 64, 64, 32
FAMILIES = 4
#: Rows of a family of features: for the classes, and for the leaves of each class.
CLASS_ROWS, LEAF_ROWS = 1 << 13, 1 << 9
KAPPA, ROUNDS, FINE = 4.0, 2, 12
END = np.uint64(0x243F6A8885A308D3)
START = np.uint64(0x13198A2E03707344)
BATCH = 2048
#: Least of what a softmax shares out, so that a logarithm stays finite.
LEAST = np.float32(1e-37)
CHUNK_BYTES = 8 << 20
#: Distinct tokens of a chunk that get a hash table; more, those of a long text, are sought in order, without its memory.
MOST_HASHED = 1 << 21
#: Bytes of training text of one task, that sends one array of sums; of as little as LEAST_BYTES where there would be fewer tasks than cores; bytes of input for each range of token hashes.
TASK_BYTES, LEAST_BYTES = 64 << 20, 16 << 20
RANGE_BYTES = 32 << 20
#: Arrays that are added in a first step, by one task for each block and salt; most salts.
FAN_IN, SALTS = 64, 64
#: Cells of the sums that are sent and added together.
BLOCK = 1 << 17
CELLS = FAMILIES * (CLASS_ROWS * CLASSES + CLASSES * LEAF_ROWS * LEAVES)
#: Bits of a cell in a double that holds two; tokens that may add to a row before it is full.
LANE = 26
FULL = 1 << LANE - FINE


class Tokens:
    """Hashes and classes of the tokens of some texts, or of a piece of one; the two tokens before each; bounds by text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, before: tuple | None = None, ended: bool = True):
        """before: the last() of the piece before this one; ended: whether the texts end here, with an end token each."""
        low = LOWER[data]
        words = Words(low, offsets)
        n = len(offsets) - 1
        self.bounds = words.bounds + np.arange(n + 1) * ended
        at = np.arange(len(words.text)) + words.text * ended
        self.hashes = np.full(len(at) + n * ended, END, np.uint64)
        self.hashes[at] = word_span_hashes(low, words.starts, words.ends)
        self.classes = np.zeros(len(self.hashes), np.int64)
        if len(at):
            last = low[words.ends - 1].astype(np.int64)
            second = np.where(words.ends - words.starts > 1, low[np.maximum(words.ends - 2, 0)], 0).astype(np.int64)
            self.classes[at] = ((last * 131 + second * 31) * 2654435761 >> 13) % CLASSES
        self.before = before or (START, START, 0, 0)
        first = self.bounds[:-1][self.bounds[:-1] < self.bounds[1:]]

        def shifted(x: np.ndarray, fill: int) -> np.ndarray:
            out = np.empty_like(x)
            out[1:] = x[:-1]
            out[first] = fill
            return out

        self.one = shifted(self.hashes, self.before[0])
        self.two = shifted(self.one, self.before[1])
        self.class_one = shifted(self.classes, self.before[2])
        self.class_two = shifted(self.class_one, self.before[3])

    def last(self) -> tuple:
        return (self.hashes[-1], self.one[-1], self.classes[-1], self.class_one[-1]) if len(self.hashes) else self.before

    def features(self) -> list[np.ndarray]:
        """A 64-bit number for each family and token."""
        both = mix(self.one * np.uint64(0x9E3779B97F4A7C15) + self.two)
        classes = mix((self.class_one * CLASSES + self.class_two).astype(np.uint64) + np.uint64(1))
        return [mix(x + np.uint64(k)) for k, x in enumerate((self.one, both, self.two, classes))]


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, Tokens]]:
    """Ranges of texts and their tokens, in groups of bounded size; a long text's come in pieces."""
    before = None
    for i, j, lo, hi in pieces(data, offsets):
        whole = lo == offsets[i] and hi == offsets[j]
        ended = hi == offsets[j]
        t = Tokens(data[lo:hi], offsets[i : j + 1] - lo if whole else np.array([0, hi - lo]), None if lo == offsets[i] else before, bool(ended))
        before = t.last()
        yield i, j, t


def rows_of(feats: list[np.ndarray], classes: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Rows of class weights and of leaf weights, by family."""
    own = classes * LEAF_ROWS
    return [(f >> np.uint64(64 - 13)).astype(np.int64) for f in feats], [own + (f & np.uint64(LEAF_ROWS - 1)).astype(np.int64) for f in feats]


class Model:
    """Tokens with their own leaf, leaf sizes, biases and weights of both softmax levels."""

    def __init__(self, own: np.ndarray, own_leaf: np.ndarray, leaf_n: np.ndarray, leaf_v: np.ndarray):
        """own: sorted hashes of the tokens with a leaf of their own, and these leaves; tokens counted and distinct in each (class, leaf)."""
        self.own, self.own_leaf, self.leaf_n, self.leaf_v = pd.Index(own, dtype=np.uint64), own_leaf, leaf_n, leaf_v
        share = np.maximum(np.where(np.arange(LEAVES) < OWN, leaf_n, leaf_n + leaf_v + 1.0), 1e-3)
        self.share, self.leaf_share = share.sum(1) / share.sum(), share / share.sum(1, keepdims=True)
        self.class_bias, self.leaf_bias = np.log(self.share).astype(np.float32), np.log(self.leaf_share).astype(np.float32)
        self.class_w = np.zeros((FAMILIES, CLASS_ROWS, CLASSES), np.float32)
        self.leaf_w = np.zeros((FAMILIES, CLASSES * LEAF_ROWS, LEAVES), np.float32)

    def leaves(self, hashes: np.ndarray) -> np.ndarray:
        out = hashed_leaf(hashes)
        if len(self.own):
            at = self.own.get_indexer(hashes)
            out = np.where(at >= 0, self.own_leaf[at], out)
        return out

    def scores(self, rows: list[np.ndarray], leaf_rows: list[np.ndarray], classes: np.ndarray, part: slice) -> tuple[np.ndarray, np.ndarray]:
        """What the softmaxes share out: of all classes, and of all leaves of each token's class. Weights are logarithms of quotients of counts, so that nothing overflows."""
        x = self.class_w[0].take(rows[0][part], axis=0)
        y, more = self.leaf_bias.take(classes[part], axis=0), np.empty_like(x)
        x += self.class_bias
        for k in range(FAMILIES):
            for z, w, row in ((x, self.class_w, rows), (y, self.leaf_w, leaf_rows)):
                if k or z is y:
                    z += w[k].take(row[k][part], axis=0, out=more, mode="clip")
        return np.exp(x, out=x), np.exp(y, out=y)

    def softmaxes(self, rows: list[np.ndarray], leaf_rows: list[np.ndarray], classes: np.ndarray, part: slice) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of all classes, and of all leaves of each token's class."""
        both = self.scores(rows, leaf_rows, classes, part)
        for z in both:
            z /= z.sum(1, keepdims=True)
        return both

    def log10(self, tokens: Tokens, counts: np.ndarray) -> np.ndarray:
        """log10 probability of each token; counts are the tokens' training counts."""
        order = by_class(tokens.classes)
        cls, leaf = tokens.classes[order], self.leaves(tokens.hashes)[order]
        part_of_leaf = np.where(leaf < OWN, 0.0, np.log((counts[order] + 1) / (self.leaf_n[cls, leaf] + self.leaf_v[cls, leaf] + 1)))
        rows, leaf_rows = rows_of([f[order] for f in tokens.features()], cls)
        for i in range(0, len(cls), BATCH):
            part = slice(i, i + BATCH)
            x, y = self.scores(rows, leaf_rows, cls, part)
            at = np.arange(len(x))
            part_of_leaf[part] += np.log(np.maximum(x[at, cls[part]], LEAST) / x.sum(1)) + np.log(np.maximum(y[at, leaf[part]], LEAST) / y.sum(1))
        out = np.empty(len(cls))
        out[order] = part_of_leaf
        return out / np.log(10)

    def seen(self, tokens: Tokens, sums: np.ndarray) -> None:
        """Adds what each feature was seen with to the flat sums."""
        cls, leaf = tokens.classes, self.leaves(tokens.hashes)
        rows, leaf_rows = rows_of(tokens.features(), cls)
        class_sums, leaf_sums = views(sums)
        for k in range(FAMILIES):
            for view, row, col, width in ((class_sums[k], rows[k], cls, CLASSES), (leaf_sums[k], leaf_rows[k], leaf, LEAVES)):
                np.add.at(view.reshape(-1), row * width + col, 1)

    def expected(self, tokens: Tokens, sums: np.ndarray, lanes: Lanes | None = None) -> None:
        """Adds what the model expects with each feature to the flat sums, in units of 2 ** -FINE; with lanes, by their next flush()."""
        held = lanes or Lanes(sums)
        order = by_class(tokens.classes)
        cls = tokens.classes[order]
        rows, leaf_rows = rows_of([f[order] for f in tokens.features()], cls)
        for i in range(0, len(cls), BATCH):
            part = slice(i, i + BATCH)
            both = self.softmaxes(rows, leaf_rows, cls, part)
            for z, half, own in zip(both, held.halves, (rows, leaf_rows), strict=True):
                z *= np.float32(1 << FINE)
                half.add(np.rint(z, out=z), [r[part] for r in own])
        if lanes is None:
            held.flush()

    def update(self, start: int, seen: np.ndarray, expected: np.ndarray | None) -> None:
        """A round's step on the weights from cell `start` on; no expectations stand for those of zero weights."""
        flat, first, size = (self.class_w, 0, self.class_w.size) if start < self.class_w.size else (self.leaf_w, self.class_w.size, self.leaf_w.size)
        cells = np.arange(start - first, min(start - first + len(seen), size))
        col = cells % CLASSES
        if flat is self.class_w:
            prior = self.share[col]
            pull = KAPPA * 8 * prior + 0.1
        else:
            prior = self.leaf_share[cells // LEAVES // LEAF_ROWS % CLASSES, col]
            pull = np.full(len(cells), KAPPA / 2)
        if expected is None:
            expected = np.repeat(seen.reshape(-1, CLASSES).sum(1), CLASSES) * prior
        else:
            expected = expected / (1 << FINE)
        flat.reshape(-1)[cells] += (np.log((seen + pull) / (expected + pull)) / FAMILIES).astype(np.float32)


def hashed_leaf(hashes: np.ndarray) -> np.ndarray:
    """The leaf that a token shares with others."""
    return OWN + (mix(hashes) >> np.uint64(40)).astype(np.int64) % (LEAVES - OWN)


def views(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flat sums as those of class rows and of leaf rows."""
    cut = FAMILIES * CLASS_ROWS * CLASSES
    return sums[:cut].reshape(FAMILIES, CLASS_ROWS, CLASSES), sums[cut:].reshape(FAMILIES, CLASSES * LEAF_ROWS, LEAVES)


def by_class(classes: np.ndarray) -> np.ndarray:
    """Places of tokens by class: the leaf rows of one class stay in cache."""
    return np.argsort(classes.astype(np.uint8), kind="stable")


class Half:
    """Sums of whole numbers up to 2 ** FINE, by family and row, for one level of the softmax.

    Columns k and k + width / 2 share a double, and two of these a complex number, which numpy adds at once. Whatever is
    added, a cell stays under 2 ** LANE, as no row takes FULL tokens before its sums move on.
    """

    def __init__(self, target: np.ndarray):
        """target: the whole sums, by family, row and column."""
        self.target = target
        _, self.n_rows, self.width = target.shape
        self.held = np.zeros((FAMILIES, target[0].size // 4), np.complex128)
        self.taken = np.zeros((FAMILIES, self.n_rows), np.int64)
        self.most = 0
        self.places = np.arange(target[0].size // 4).reshape(self.n_rows, -1)
        self.at = np.empty((BATCH, self.width // 4), np.int64)

    def add(self, values: np.ndarray, rows: list[np.ndarray]) -> None:
        """Adds each token's values to its row in each family; a call brings BATCH tokens at most."""
        if self.most + len(values) >= FULL:
            self.most = int(self.taken.max())
            if self.most + len(values) >= FULL:
                self.flush(FULL // 2)
                self.most = int(self.taken.max())
        self.most += len(values)
        half = self.width // 2
        pairs = np.multiply(values[:, half:], float(1 << LANE), dtype=np.float64)
        pairs += values[:, :half]
        pairs = pairs.view(np.complex128).ravel()
        at = self.at[: len(values)]
        for held, taken, own in zip(self.held, self.taken, rows, strict=True):
            np.add.at(taken, own, 1)
            self.places.take(own, axis=0, out=at, mode="clip")
            np.add.at(held, at.ravel(), pairs)

    def flush(self, least: int = 1) -> None:
        """Moves what is held in rows of so many tokens to the target."""
        half = self.width // 2
        for target, held, taken in zip(self.target, self.held, self.taken, strict=True):
            own, pairs = np.flatnonzero(taken >= least), held.view(np.float64).reshape(self.n_rows, half)
            both = pairs[own].astype(np.int64)
            target[own, :half] += both & ((1 << LANE) - 1)
            target[own, half:] += both >> LANE
            pairs[own], taken[own] = 0, 0


class Lanes:
    """Both halves of the flat sums."""

    def __init__(self, sums: np.ndarray):
        self.halves = [Half(x) for x in views(sums)]

    def flush(self) -> None:
        for half in self.halves:
            half.flush()


def pack(x: np.ndarray) -> bytes:
    """Integers, byte by byte and compressed; of as few bytes as the largest needs."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return bytes([width]) + zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(data[0], -1)
    full = np.zeros((planes.shape[1], 8), np.uint8)
    full[:, : data[0]] = planes.T
    return full.view("<u8").ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    return x[:1].astype("<u8").tobytes() + pack(np.diff(x))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(np.concatenate([np.frombuffer(data, "<u8", 1), unpack(data[8:])]), dtype=np.uint64)


def _chunks(docs: DataFrame, id_col: str, text_col: str, folds: int, held: int, chunk_bytes: int) -> DataFrame:
    """chunk, _id, held, learn, packed (the compressed text), size of every row, written; a chunk's rows are neighbours in one partition."""
    rest = F.crc32(F.col(id_col).cast("string").cast("binary")) % folds
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"), F.coalesce(rest == held, F.lit(False)).alias("held"), F.coalesce(rest != held, F.lit(False)).alias("learn"))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk, size = TaskContext.get().partitionId() << 24, 0
        zip_ = zstandard.ZstdCompressor(1)
        for batch in parts:
            packed, sizes, own = [], [], []
            for x in batch.column(1).cast(pa.binary()):
                raw = x.as_buffer() if x.is_valid else b""
                if size and size + len(raw) > chunk_bytes:
                    chunk, size = chunk + 1, 0
                size += len(raw) + 16
                packed.append(zip_.compress(raw))
                sizes.append(len(raw))
                own.append(chunk)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), batch.column(0), *batch.columns[2:], pa.array(packed, pa.binary()), pa.array(sizes, pa.int64())], ["chunk", "_id", "held", "learn", "packed", "size"])

    return table(rows.mapInArrow(run, f"chunk long, _id {kind}, held boolean, learn boolean, packed binary, size long"), "lm-chunks")


def _texts(packed: pa.Array | pa.ChunkedArray, limit: int = 4 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Ranges of rows whose texts have about `limit` bytes, their bytes and offsets."""
    unzip, held, first, size = zstandard.ZstdDecompressor(), [], 0, 0
    for i, x in enumerate(packed):
        raw = unzip.decompress(x.as_buffer())
        if held and size + len(raw) > limit:
            yield first, i, *as_bytes(pa.array(held, pa.large_binary()))
            held, first, size = [], i, 0
        held.append(raw)
        size += len(raw)
    if held:
        yield first, first + len(held), *as_bytes(pa.array(held, pa.large_binary()))


def _distinct(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct tokens of a chunk, their classes, and their counts in rows to learn from."""
    held: list[tuple[np.ndarray, ...]] = []
    learn = t["learn"].to_numpy()
    for a, _, data, offsets in _texts(t["packed"]):
        for i, _, k in tokens_of(data, offsets):
            if len(k.hashes):
                weight = np.repeat(learn[a + i : a + i + len(k.bounds) - 1], np.diff(k.bounds))
                held.append(_tally(k.hashes, k.classes, weight))
                if len(held) > 16:
                    held[:] = [_merged(held)]
    return _merged(held)


def _merged(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _tally(*(np.concatenate(x) for x in zip(*held, strict=True))) if len(held) > 1 else held[0]


def _tally(hashes: np.ndarray, classes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes, their classes, and their weights' sums."""
    at, u = pd.factorize(hashes)
    own = np.empty(len(u), np.int64)
    own[at] = classes
    order = np.argsort(u)
    return u[order], own[order], np.bincount(at, weights, len(u)).astype(np.int64)[order]


def _cuts(h: np.ndarray, range_bits: int) -> np.ndarray:
    """Bounds of the ranges in sorted hashes."""
    edges = np.arange(1, 1 << range_bits, dtype=np.uint64) << np.uint64(64 - range_bits) if range_bits else np.zeros(0, np.uint64)
    return np.concatenate([[0], np.searchsorted(h, edges), [len(h)]])


def token_counts(chunks: DataFrame, range_bits: int) -> DataFrame:
    """range, chunk, h, counts: packed tokens of a chunk and their training counts (a token may come twice, if the chunk was read in two parts); and for each range a row with chunk -1: total, n_distinct, its frequent tokens and leaf sizes."""

    def ask(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("maxent_lm")
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                t = pa.Table.from_batches(held)
                held.clear()
                h, cls, c = _distinct(t)
                cuts = _cuts(h, range_bits)
                full = np.flatnonzero(np.diff(cuts)).tolist()
                cols = [[f(x[cuts[k] : cuts[k + 1]]) for k in full] for f, x in ((pack_sorted, h), (pack, cls), (pack, c))]
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([t["chunk"][0].as_py()] * len(full), pa.int64()), *(pa.array(x, pa.binary()) for x in cols)], ["range", "chunk", "h", "cls", "c"])
                trim()

        for batch in parts:
            chunk = batch["chunk"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if held and held[0]["chunk"][0].as_py() != chunk[i]:
                    yield from flush()
                held.append(batch.slice(i, j - i))
        yield from flush()

    def tell(t: pa.Table) -> pa.Table:
        worker_cache("maxent_lm")
        trim()
        parts = [unpack_sorted(x.as_py()) for x in t["h"]]
        h = np.concatenate(parts)
        cls, c = (np.concatenate([unpack(x.as_py()) for x in t[name]]).astype(np.int64) for name in ("cls", "c"))
        u, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        total = np.bincount(inverse, c, len(u)).astype(np.int64)
        back = total[inverse]
        ends = np.cumsum([len(p) for p in parts])
        rows = [pack(x) for x in np.split(back, ends[:-1])]
        known = total > 0
        u, own, total = u[known], cls[first][known], total[known]
        # The most frequent tokens of each class, and the sizes of all hashed leaves.
        order = np.lexsort((u, -total, own))
        rank = np.arange(len(order)) - np.searchsorted(own[order], own[order])
        best = order[rank < OWN]
        leaf = own * LEAVES + hashed_leaf(u)
        n, v = (np.bincount(leaf, w, CLASSES * LEAVES).astype(np.int64) for w in (total, None))
        top = pack(u[best]) if len(best) else b""
        k = t["range"][0].as_py()
        return pa.table({
            "range": pa.array([k] * (len(rows) + 1), pa.int32()), "chunk": pa.array([*t["chunk"].to_pylist(), -1], pa.int64()), "h": pa.array([*t["h"].to_pylist(), None], pa.binary()), "counts": pa.array([*rows, pack(n)], pa.binary()),
            "total": pa.array([None] * len(rows) + [int(total.sum())], pa.int64()), "n_distinct": pa.array([None] * len(rows) + [len(u)], pa.int64()), "leaf_v": pa.array([None] * len(rows) + [pack(v)], pa.binary()),
            "top": pa.array([None] * len(rows) + [top], pa.binary()), "top_cls": pa.array([None] * len(rows) + [pack(own[best])], pa.binary()), "top_c": pa.array([None] * len(rows) + [pack(total[best])], pa.binary()),
        })

    asked = chunks.select("chunk", "learn", "packed").mapInArrow(ask, "range int, chunk long, h binary, cls binary, c binary")
    return table(asked.groupBy("range").applyInArrow(tell, "range int, chunk long, h binary, counts binary, total long, n_distinct long, leaf_v binary, top binary, top_cls binary, top_c binary"), "lm-counts")


def _best(summaries: DataFrame) -> pa.Table:
    """Leaf sizes summed, and the most frequent tokens of each class: by ranges in Arrow groups, then of all on the driver (one row a group of ranges)."""

    def fold(t: pa.Table) -> pa.Table:
        n, v = (sum(unpack(x.as_py()) for x in t[c]) for c in ("counts", "leaf_v"))
        h, own, c = (np.concatenate([unpack(x.as_py()) for x in t[name] if len(x.as_py())] or [np.zeros(0, np.uint64)]) for name in ("top", "top_cls", "top_c"))
        h, own, c = h, own[: len(h)].astype(np.int64), c[: len(h)].astype(np.int64)
        order = np.lexsort((h, -c, own))
        best = order[np.arange(len(order)) - np.searchsorted(own[order], own[order]) < OWN]
        return pa.table({"counts": [pack(n)], "leaf_v": [pack(v)], "top": pa.array([pack(h[best]) if len(best) else b""], pa.binary()), "top_cls": [pack(own[best])], "top_c": [pack(c[best])]})

    kept = summaries.select((F.col("range") / 256).cast("int").alias("g"), "counts", "leaf_v", "top", "top_cls", "top_c")
    return fold(kept.groupBy("g").applyInArrow(lambda t: fold(t), "counts binary, leaf_v binary, top binary, top_cls binary, top_c binary").toArrow())


def start(counts: DataFrame) -> Model:
    """The model before its first round."""
    summaries = counts.filter("chunk = -1")
    if summaries.isEmpty():
        return Model(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((CLASSES, LEAVES)), np.zeros((CLASSES, LEAVES)))
    got = _best(summaries)
    n, v = (unpack(got[c][0].as_py()).astype(np.int64).reshape(CLASSES, LEAVES) for c in ("counts", "leaf_v"))
    top = got["top"][0].as_py()
    h = unpack(top) if top else np.zeros(0, np.uint64)
    own, c = (unpack(got[x][0].as_py()).astype(np.int64)[: len(h)] for x in ("top_cls", "top_c"))
    # Those seen once only stay in the shared leaves, where unknown tokens are.
    h, own, c = h[c > 1], own[c > 1], c[c > 1]
    leaf = np.arange(len(h)) - np.searchsorted(own, own)
    np.subtract.at(n, (own, hashed_leaf(h)), c)
    np.subtract.at(v, (own, hashed_leaf(h)), 1)
    n[own, leaf], v[own, leaf] = c, 1
    order = np.argsort(h)
    return Model(h[order], leaf[order], n, v)


def tasks(size: int, cores: int) -> int:
    """Tasks of a sum over so many bytes."""
    return max(1, -(-size // TASK_BYTES), min(cores, -(-size // LEAST_BYTES)))


def _sums(chunks: DataFrame, model: Model, step: str) -> dict[int, bytes]:
    """Packed sums over all tokens of the chunks' rows, by the first cell of their block."""
    size = chunks.agg(F.sum("size")).first()[0] or 0
    n_tasks = tasks(size, chunks.sparkSession.sparkContext.defaultParallelism)
    n_salts = min(SALTS, -(-n_tasks // FAN_IN))
    held = chunks.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        worker_cache("maxent_lm")
        sums = np.zeros(CELLS, np.int64)
        lanes = [Lanes(sums)] if step == "expected" else []
        for batch in parts:
            for _, _, data, offsets in _texts(batch["packed"]):
                for _, _, t in tokens_of(data, offsets):
                    getattr(held.value, step)(t, sums, *lanes)
        for x in lanes:
            x.flush()
        del lanes
        salt = TaskContext.get().partitionId() % n_salts
        for k in range(0, CELLS, BLOCK):
            part = sums[k : k + BLOCK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([salt], pa.int32()), pa.array([pack(part)], pa.binary())], ["block", "salt", "v"])
        del sums
        trim()

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK, np.int64)
        for x in t["v"]:
            part = unpack(x.as_py())
            total[: len(part)] += part.astype(np.int64)
        return pa.table({"block": t["block"][:1], "salt": pa.array([0], pa.int32()), "v": pa.array([pack(total)], pa.binary())})

    rows = chunks.select("packed").coalesce(n_tasks).mapInArrow(run, "block int, salt int, v binary")
    schema = "block int, salt int, v binary"
    got = rows.groupBy("block", "salt").applyInArrow(add, schema).groupBy("block").applyInArrow(add, schema).toArrow()
    held.destroy()
    return dict(zip(got["block"].to_pylist(), got["v"].to_pylist(), strict=True))


def fit(chunks: DataFrame, counts: DataFrame, rounds: int = ROUNDS) -> Model:
    """The model after its rounds."""
    model, own = start(counts), chunks.filter("learn")
    # What features were seen with does not depend on the weights: it is summed once.
    seen = _sums(own, model, "seen") if rounds else {}
    for k in range(rounds):
        expected = _sums(own, model, "expected") if k else {}
        for block, packed in seen.items():
            # A round's tokens have the same features in both; cells of class rows and of leaf rows never share a block.
            model.update(block, unpack(packed).astype(np.int64), unpack(expected[block]).astype(np.int64) if k else None)
    return model


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2, chunk_bytes: int = CHUNK_BYTES, rounds: int = ROUNDS) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs."""
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    chunks = _chunks(docs, id_col, text_col, folds, held, chunk_bytes)
    size = chunks.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    range_bits = max(0, math.ceil(math.log2(max(1, size / RANGE_BYTES))))
    counts = token_counts(chunks, range_bits)
    n_train, n_distinct = counts.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("n_distinct"), F.lit(0))).first()
    model = spark.sparkContext.broadcast(fit(chunks, counts, rounds))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return empty
        worker_cache("maxent_lm")
        trim()
        m = model.value
        h, first = np.unique(np.concatenate([unpack_sorted(x.as_py()) for x in right["h"]]), return_index=True)
        c = np.concatenate([unpack(x.as_py()) for x in right["counts"]]).astype(np.int64)[first]
        places = pd.Index(h) if len(h) <= MOST_HASHED else None
        out = np.zeros((4, len(left)))
        for a, _, data, offsets in _texts(left["packed"]):
            for i, _, t in tokens_of(data, offsets):
                own = c[np.searchsorted(h, t.hashes) if places is None else places.get_indexer(t.hashes)]
                sums = (np.ones(len(own)), own > 0, np.log10((own + 1) / (n_train + n_distinct + 1)), m.log10(t, own))
                n = np.diff(t.bounds)
                full = np.flatnonzero(n)
                for k, x in enumerate(sums):
                    if len(full):
                        out[k, a + i + full] += np.add.reduceat(x.astype(float), t.bounds[:-1][full])
        return pa.table({
            id_col: left["_id"], "held_out": left["held"], "n_tokens": out[0].astype(np.int64), "n_known": out[1].astype(np.int64),
            "train_tokens": np.full(len(left), n_train, np.int64), "base_score": out[2], "score": out[3],
        })

    schema = f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    empty = pa.table({id_col: pa.array([], pa.null()), "held_out": pa.array([], pa.bool_()), **{c: pa.array([], pa.int64()) for c in ("n_tokens", "n_known", "train_tokens")}, **{c: pa.array([], pa.float64()) for c in ("base_score", "score")}})
    known = counts.filter("chunk >= 0").select("chunk", "h", "counts")
    rows = chunks.select("chunk", "_id", "held", "learn", "packed")
    return rows.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(score, schema)
