"""Quality rules and a calibrated hashed n-gram classifier.

Base rules count words, symbols, repeated lines and repeated 5-word windows of
the whole text.  The verdict on texts that pass them is a logistic regression
over hashed word 1- and 2-grams and byte 4-grams (each family as shares of its
own count), trained on a bounded, hash-chosen sample of labelled rows
(`max_rows` of up to `MAX_TEXT` bytes), with Platt scaling on a fold that is held out of training, and
scored in Arrow batches: a text is kept unless its calibrated probability of
low quality exceeds a fixed threshold.  Texts of any length are read whole, a
long one in pieces.

Defined results: a null text has no words and fails; an empty text too; equal
texts get equal results; a null or repeated id is a row like any other; labels
that are null, or whose id has no text, are not learned from (an id labelled
twice counts by its lowest label); with no labels, or one class only, every text
that passes the base rules is kept (low_quality is the share of that class).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.spans import CONT, LOWER, WS, Words, as_bytes, batches, chained, groups, mix, pieces, span_hashes

BITS = 18
MAX_ROWS = 3000
#: Bytes of a labelled text that is learned from, at most: with MAX_ROWS, they bound what the driver holds.
MAX_TEXT = 1 << 16
THRESHOLD = 0.5
MIN_WORDS = 10
REPEAT_WINDOW = 5
REPEAT_PERCENT = 20
CHAR_GRAM = 4
#: N-grams that are hashed at once.
RUN = 1 << 21
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True


def repeated(keys: np.ndarray) -> np.ndarray:
    """Mask of the keys that occur more than once."""
    order = np.argsort(keys)
    s = keys[order]
    same = np.zeros(len(s), bool)
    if len(s) > 1:
        eq = s[1:] == s[:-1]
        same[1:] |= eq
        same[:-1] |= eq
    out = np.zeros(len(s), bool)
    out[order] = same
    return out


def later_copies(keys: np.ndarray) -> np.ndarray:
    """Mask of the keys that are equal to an earlier one."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    out = np.zeros(len(s), bool)
    out[order[1:]] = s[1:] == s[:-1]
    return out


def per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    if len(offsets) == 2:
        return np.array([np.count_nonzero(mask)])
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def base_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text; the words' hashes, and the texts' bounds among them."""
    n = len(offsets) - 1
    out = {c: np.zeros(n, np.int64) for c in ("n_words", "word_chars", "n_symbols")}
    hashes = []
    for i, j, lo, hi in pieces(data, offsets):
        part, own = data[lo:hi], offsets[i : j + 1] - lo if hi - lo == offsets[j] - offsets[i] else np.array([0, hi - lo])
        words = Words(part, own)
        hashes.append(words.hashes())
        for c, x in (("n_words", words.counts), ("word_chars", per_text(words.inside & ~CONT[part], own)), ("n_symbols", per_text(_SYMBOLS[part], own))):
            out[c][i:j] += x
    hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    bounds = np.concatenate([[0], np.cumsum(out["n_words"])])
    # Lines end at a line feed or at the text's end; only those with a word count.
    feeds = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([offsets[:-1], feeds + 1]))
    starts = starts[starts < len(data)]
    ends = np.minimum(np.append(starts[1:], len(data)), len(data))
    has = np.logical_or.reduceat(~WS[data], starts) if len(starts) else np.zeros(0, bool)
    ends = ends - ((ends > starts) & (data[np.maximum(ends - 1, 0)] == 10))
    starts, ends = starts[has], ends[has]
    text = np.searchsorted(offsets, starts, "right") - 1
    dup = later_copies(span_hashes(data, starts, ends) ^ mix(text.astype(np.uint64) + np.uint64(1)))
    out["n_dup_lines"] = np.bincount(text[dup], minlength=n).astype(np.int64)
    # Windows of five words inside one text; a word counts if any window over it repeats.
    w = REPEAT_WINDOW
    keys = chained(hashes, w)
    inside = np.zeros(len(hashes) + 1, np.int32)
    if len(keys):
        own = None
        if n > 1:
            text = np.repeat(np.arange(n), out["n_words"])
            own = np.flatnonzero(text[: len(keys)] == text[w - 1 :])
            keys = keys[own] ^ mix(text[own].astype(np.uint64) + np.uint64(1))
        hit = np.flatnonzero(repeated(keys))
        del keys
        hit = hit if own is None else own[hit]
        inside[hit] += 1
        inside[hit + w] -= 1
    covered = np.cumsum(inside[:-1], dtype=np.int32) > 0
    out["n_repeat_words"] = per_text(covered, bounds)
    return out, hashes, bounds


def base_failed(n_words: np.ndarray, n_repeat_words: np.ndarray) -> np.ndarray:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > REPEAT_PERCENT * n_words)


def features(data: np.ndarray, offsets: np.ndarray, hashes: np.ndarray, bounds: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Hashed features in runs of bounded size: family, and text number and bucket of each n-gram."""
    shift = np.uint64(64 - bits)
    text = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))
    for a in range(0, len(hashes), RUN):
        part, t = hashes[a : a + RUN + 1], text[a : a + RUN + 1]
        yield 0, t[:RUN], (mix(part[:RUN] + np.uint64(11)) >> shift).astype(np.int64)
        pairs = chained(part, 2)
        own = np.flatnonzero(t[: len(pairs)] == t[1:]) if len(pairs) else np.zeros(0, np.int64)
        yield 1, t[own], (mix(pairs[own] + np.uint64(12)) >> shift).astype(np.int64)
    for a in range(0, max(0, len(data) - CHAR_GRAM + 1), RUN):
        # Four bytes are one 32-bit number.
        x = LOWER[data[a : a + RUN + 3]].astype(np.uint32)
        g = x[:-3] | (x[1:-2] << 8) | (x[2:-1] << 16) | (x[3:] << 24)
        t = np.repeat(np.arange(len(offsets) - 1), np.diff(np.clip(offsets - a, 0, len(x))))
        own = np.flatnonzero(t[: len(g)] == t[3:])
        h = (g[own].astype(np.uint64) + np.uint64(13)) * np.uint64(0x9E3779B97F4A7C15)
        yield 2, t[own], (h >> shift).astype(np.int64)


def n_features(offsets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """N-grams of each family and text, one at least."""
    words = np.diff(bounds)
    return np.maximum(np.stack([words, words - 1, np.diff(offsets) - CHAR_GRAM + 1]), 1)


class Model:
    """Weights by family and bucket, a bias, and Platt's slope and offset of P(low quality)."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, offset: float, bits: int):
        self.weights, self.bias, self.slope, self.offset, self.bits = weights.astype(np.float32), bias, slope, offset, bits

    def margin(self, feats: Iterator[tuple[int, np.ndarray, np.ndarray]], counts: np.ndarray) -> np.ndarray:
        sums = np.zeros(counts.shape)
        for k, text, bucket in feats:
            sums[k] += np.bincount(text, self.weights[k][bucket], minlength=counts.shape[1])
        return self.bias + (sums / counts).sum(0)

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -40, 40)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def train(texts: pa.Array, low: np.ndarray, bits: int = BITS, rounds: int = 60, l2: float = 1e-6) -> Model:
    """Fit on texts and their low-quality flags; every fourth text calibrates and is not trained on."""
    share = float(low.mean()) if len(low) else 0.0
    prior = np.log((share + 1e-9) / (1 - share + 1e-9))
    if len(low) < 8 or share in (0.0, 1.0):
        return Model(np.zeros((3, 1 << bits)), 0.0, 0.0, prior, bits)
    held = np.arange(len(low)) % 4 == 3
    data, offsets = as_bytes(texts)
    row, col, val = [], [], []
    for i, j in groups(offsets):
        d, o = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        _, hashes, bounds = base_counts(d, o)
        count = n_features(o, bounds)
        for k, text, bucket in features(d, o, hashes, bounds, bits):
            key, c = np.unique((text.astype(np.int64) << (bits + 2)) | (k << bits) | bucket, return_counts=True)
            t = key >> (bits + 2)
            row.append((t + i).astype(np.int32))
            col.append((key & ((1 << (bits + 2)) - 1)).astype(np.int32))
            val.append((c / count[k][t]).astype(np.float32))
    row, col, val = np.concatenate(row), np.concatenate(col), np.concatenate(val)
    used, col = np.unique(col, return_inverse=True)
    w, g2, bias, b2 = np.zeros(len(used)), np.full(len(used), 1e-12), prior, 1e-12
    weight = np.where(held, 0.0, np.where(low, 0.5 / max(low[~held].mean(), 1e-9), 0.5 / max(1 - low[~held].mean(), 1e-9)))
    for _ in range(rounds):
        m = np.bincount(row, w[col] * val, minlength=len(low)) + bias
        err = (_sigmoid(m) - low) * weight
        g = np.bincount(col, err[row] * val, minlength=len(used)) + l2 * w
        g2 += g * g
        w -= 1.0 * g / np.sqrt(g2)
        b2 += err.sum() ** 2
        bias -= 0.1 * err.sum() / np.sqrt(b2)
    m = np.bincount(row, w[col] * val, minlength=len(low)) + bias
    # Platt scaling on the held-out fold, with smoothed targets.
    x, y = m[held], low[held]
    up, down = y.sum(), (~y).sum()
    goal = np.where(y, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = _sigmoid(a * x + b)
        h = np.maximum(p * (1 - p), 1e-9)
        ga, gb = ((p - goal) * x).sum(), (p - goal).sum()
        haa, hab, hbb = (h * x * x).sum() + 1e-6, (h * x).sum(), h.sum() + 1e-6
        det = haa * hbb - hab * hab
        if det <= 0:
            break
        a -= np.clip((hbb * ga - hab * gb) / det, -1, 1)
        b -= np.clip((haa * gb - hab * ga) / det, -1, 1)
    weights = np.zeros(3 << bits)
    weights[used] = w
    return Model(weights.reshape(3, 1 << bits), bias, max(a, 0.0), b, bits)


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_rows: int) -> tuple[pa.Array, np.ndarray]:
    """At most max_rows labelled texts, half of them of low quality where there are enough, by a hash of the id."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_q")).filter("_id is not null and _q is not null").groupBy("_id").agg(F.min("_q").alias("_q"))
    known = known.withColumn("_h", F.xxhash64(F.col("_id").cast("string"), F.lit(5)))
    picked = [known.filter("_q = 0" if low else "_q <> 0").orderBy("_h").limit(max_rows // 2) for low in (True, False)]
    # The picked ids are max_rows at most, so that they are broadcast and no text is shuffled.
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).filter(F.octet_length("_t") <= MAX_TEXT).join(F.broadcast(picked[0].unionByName(picked[1])), "_id")
    sample = rows.orderBy("_h", "_t").limit(max_rows).select("_h", "_t", "_q").toArrow()
    got = [sample.filter(pc.field("_q") == 0), sample.filter(pc.field("_q") != 0)]
    texts = pa.chunked_array([c for g in got for c in g["_t"].chunks] or [pa.array([], pa.string())], pa.string()).combine_chunks()
    low = np.repeat([True, False], [len(g) for g in got])
    order = np.argsort(np.concatenate([g["_h"].to_numpy() for g in got]).astype(np.int64), kind="stable")
    return texts.take(pa.array(order)), low[order]


def base_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The base counts and base_failed of every row, without a classifier."""
    return score_quality(docs, docs.sparkSession.createDataFrame([], f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, quality int"), id_col, text_col).drop("kept", "low_quality")


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS, threshold: float = THRESHOLD, bits: int = BITS) -> DataFrame:
    """One row a document: id, base counts, base_failed, kept and low_quality, the calibrated probability."""
    texts, low = labelled_sample(docs, labels, id_col, text_col, label_col, max_rows)
    # The classes are drawn evenly; calibration goes back to their shares among the labelled rows.
    model = train(texts, low, bits)
    if low.any() and not low.all():
        known = labels.filter(F.col(label_col).isNotNull()).agg(F.avg((F.col(label_col) == 0).cast("double"))).first()[0]
        drawn, share = float(low.mean()), min(max(known, 1e-6), 1 - 1e-6)
        model.offset += np.log(share / (1 - share)) - np.log(drawn / (1 - drawn))
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def score(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in parts:
            for part, data, offsets in batches(batch, "_t"):
                out, hashes, bounds = base_counts(data, offsets)
                fail = base_failed(out["n_words"], out["n_repeat_words"])
                p = m.probability(m.margin(features(data, offsets, hashes, bounds, m.bits), n_features(offsets, bounds)))
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, out.values()), pa.array(fail), pa.array(~fail & (p <= threshold)), pa.array(p)], [id_col, *out, "base_failed", "kept", "low_quality"])

    schema = f"`{id_col}` {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, low_quality double"
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).mapInArrow(score, schema)
