"""Removal of long byte strings that an earlier document holds, by a distributed difference-cover sort.

Every byte that a string of `LENGTH` bytes covers goes, if that string also
starts in a document with a smaller id.  The suffixes of all texts are compared
by their first `LENGTH` bytes, as a difference-cover suffix sort does it:

1. Sample.  Places whose offset in the text lies in a difference cover modulo
   `CYCLE` give a tuple of `LENGTH` - `CYCLE` + 1 bytes.  For any two places some
   shift below `CYCLE` brings both into the sample, so two equal strings hold an
   equal sampled tuple.
2. Names.  The tuples' names are sorted, in buckets over all texts, and
   neighbours compared: each group of texts learns which of its names another
   group holds too.  A name is a hash: the order need not be that of the bytes,
   as only equality counts, and since names of 38 bytes decide where 50 bytes can
   agree, one level of names suffices and the recursion ends there.
3. Remaining suffixes.  Only places whose string holds a shared name go on.  The
   names of their first `LENGTH` bytes are sorted in buckets, each with a second,
   independent hash, and neighbours compared by both: each group learns which of
   its strings an earlier group holds.  Strings that repeat inside a group are
   compared by their bytes.

Texts are grouped by ranges of their least id, so that "earlier" is a comparison
of group numbers, and inside a group the texts are at hand, in the order of their
least ids and hashes: a place that one step finds is the same to the next, in
whatever order a shuffle brings the rows.  What is shuffled is
one sorted, delta-coded array of distinct names for each group and bucket, and
one bit a name on the way back; a string that a third of all documents share is
one name a group.  Exact copies are taken out before: a copy of an earlier text
goes as a whole, if it is long enough.  Rows whose text occurs once, as a bitmap
of fixed size tells, are shuffled once only, compressed.

Names of tuples are cut to the bits that tell most of them apart, as a clash
costs time only.  A string's name and its second hash have together `SPARE` bits
more than twice those that count all texts' bytes, so that two different strings
of a corpus of any size agree in both with a chance of at most 2 ** -`SPARE`.

Defined results: null is the empty text; texts under `LENGTH` bytes lose
nothing; null ids come after all others; rows that repeat an id are not earlier
than each other; a row that repeats both id and text is judged as the same
document; an empty table gives an empty result.  Ids must be integers.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.shared import drop, table
from lodestone.llm.spans import FIRST, SECOND, Rolling, trim, worker_cache

LENGTH = 50
#: A perfect difference set: every shift modulo 13 is the difference of two of its members.
CYCLE, COVER = 13, (0, 1, 3, 9)
GROUP_BYTES = 4 << 20
BUCKET_NAMES = 2 << 20
#: Texts are hashed in parts of about so many bytes.
PART_BYTES = 1 << 18
BITMAP_BITS = 24
#: Bits of a string's name and second hash beyond twice those of the corpus's size.
SPARE = 16
#: Ids that bound the groups are quantiles of so many ids a group, and of so many in all.
IDS_A_GROUP, IDS_AT_MOST = 200, 16_000_000
LAST = (1 << 63) - 1


def pack(names: np.ndarray, tails: np.ndarray | None = None, tail_bytes: int = 0) -> bytes:
    """Sorted 64-bit names: the first, and the differences of as few bytes as the largest needs, byte by byte and compressed; then their tails' low bytes."""
    d = np.diff(names)
    width = (int(d.max()).bit_length() + 7) // 8 if len(d) else 0
    planes = np.ascontiguousarray(d.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    body = zstandard.ZstdCompressor(1).compress(planes.tobytes())
    out = bytes([width]) + names[:1].astype("<u8").tobytes() + len(body).to_bytes(4, "little") + body
    return out + np.ascontiguousarray(tails.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :tail_bytes]).tobytes() if tail_bytes else out


def unpack(data: bytes, tail_bytes: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The names and the tails (zeros where there are none)."""
    width, end = data[0], 13 + int.from_bytes(data[9:13], "little")
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[13:end]), np.uint8).reshape(width, -1) if width else None
    n = (len(data) - end) // tail_bytes if tail_bytes else 1 if planes is None else planes.shape[1] + 1
    full = np.zeros((n, 8), np.uint8)
    if planes is not None:
        full[1:, :width] = planes.T
    names = full.view("<u8").ravel()
    names[0] = np.frombuffer(data, "<u8", 1, 1)[0]
    tails = np.zeros((n, 8), np.uint8)
    tails[:, :tail_bytes] = np.frombuffer(data, np.uint8, n * tail_bytes, end).reshape(n, tail_bytes)
    return np.cumsum(names, dtype=np.uint64), tails.view("<u8").ravel()


def pack_places(places: np.ndarray) -> bytes:
    """Ascending places as runs: the gap before each and its length."""
    first = np.flatnonzero(np.diff(places, prepend=-2) != 1)
    start, n = places[first], np.diff(np.append(first, len(places)))
    gap = start - np.concatenate([[0], start[:-1] + n[:-1]])
    return zstandard.ZstdCompressor(1).compress(np.stack([gap, n]).astype("<i8").tobytes())


def unpack_places(data: bytes) -> np.ndarray:
    gap, n = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<i8").reshape(2, -1)
    start = np.cumsum(gap + n) - n
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


def by_name(names: np.ndarray, tails: np.ndarray) -> np.ndarray:
    """The order by names, and among equal names by tails; ties come in any order."""
    order = np.argsort(names)
    s, t = names[order], tails[order]
    if ((s[1:] == s[:-1]) & (t[1:] != t[:-1])).any():
        order = np.lexsort((tails, names))
    return order


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; a sort is faster here than the hash table of np.unique."""
    s = np.sort(x)
    return s[np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))] if len(s) else s


def in_order(t: pa.Table) -> pa.Table:
    """A group's distinct texts in an order of their own: a shuffle's blocks come in any order, another one in each step."""
    return t.take(pc.sort_indices(t.select(["least", "h1", "h2"]), sort_keys=[(c, "ascending") for c in ("least", "h1", "h2")]))


class Group:
    """Texts of one group, end to end, as their table has them."""

    def __init__(self, t: pa.Table, string_bits: int, tail_bytes: int):
        self.string_bits, self.tail_bytes = string_bits, tail_bytes
        unzip = zstandard.ZstdDecompressor()
        parts = [unzip.decompress(x.as_buffer()) if len(x.as_buffer()) else b"" for x in t["packed"]]
        self.offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts], dtype=np.int64)]).astype(np.int64)
        self.data = np.frombuffer(b"".join(parts), np.uint8)
        self.least = t["least"].to_numpy()

    def text_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, at, "right") - 1

    def hashed(self, places: np.ndarray, width: int, *tables: np.ndarray) -> list[np.ndarray]:
        """Hashes of the spans at (ascending) places by each table of byte values, in parts of the data."""
        out = [np.empty(len(places), np.uint64) for _ in tables]
        edges = np.append(np.arange(0, len(self.data), PART_BYTES), len(self.data))
        cuts = np.searchsorted(places, edges)
        for lo, hi, a, b in zip(edges[:-1], edges[1:], cuts[:-1], cuts[1:], strict=True):
            if b > a:
                part, at = self.data[lo : hi + width], places[a:b] - lo
                for x, table in zip(out, tables, strict=True):
                    x[a:b] = Rolling(part, table).windows(at, width)
        return out

    def sampled(self, name_bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in the cover, and their tuples' names."""
        width = LENGTH - CYCLE + 1
        at = []
        for lo, hi in zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist(), strict=True):
            # Columns of a table of CYCLE places a row.
            p = (np.arange(0, hi - lo, CYCLE)[:, None] + np.array(COVER)).ravel()
            at.append(p[: np.searchsorted(p, hi - lo - width, "right")] + lo)
        at = np.concatenate(at) if at else np.zeros(0, np.int64)
        names = self.hashed(at, width, FIRST)[0]
        names >>= np.uint64(64 - name_bits)
        return at, names

    def candidates(self, at: np.ndarray, inverse: np.ndarray, elsewhere: np.ndarray) -> np.ndarray:
        """Places whose string holds a sampled name (inverse: its number, at each of the places `at`) that is `elsewhere` or in two texts here."""
        text = self.text_of(at).astype(np.int32)
        low, high = np.full(len(elsewhere), len(self.least), np.int32), np.full(len(elsewhere), -1, np.int32)
        np.minimum.at(low, inverse, text)
        np.maximum.at(high, inverse, text)
        hit = (elsewhere | (low != high))[inverse]
        del low, high
        # A tuple at p lies in the strings that start at p - CYCLE + 1 to p.
        p, text = at[hit], text[hit]
        reach = np.zeros(len(self.data) + 1, np.int16)
        np.add.at(reach, np.maximum(p - CYCLE + 1, self.offsets[text]), 1)
        np.subtract.at(reach, p + 1, 1)
        places = np.flatnonzero(np.cumsum(reach[:-1], dtype=np.int16) > 0)
        return places[places + LENGTH <= self.offsets[self.text_of(places) + 1]]

    def strings(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Names and tails of the distinct strings at these places, sorted, and each place's number among them."""
        name, tail = self.hashed(places, LENGTH, FIRST, SECOND)
        name >>= np.uint64(64 - self.string_bits)
        tail &= np.uint64((1 << 8 * self.tail_bytes) - 1)
        order = by_name(name, tail)
        n, t = name[order], tail[order]
        new = np.ones(len(n), bool)
        new[1:] = (n[1:] != n[:-1]) | (t[1:] != t[:-1])
        own = np.empty(len(n), np.int64)
        own[order] = np.cumsum(new) - 1
        return n[new], t[new], own

    def repeated(self, places: np.ndarray, own: np.ndarray, n_strings: int) -> np.ndarray:
        """Mask of the places whose string, byte by byte, also starts in a text of this group with a smaller id; own: the strings' numbers."""
        out = np.zeros(len(places), bool)
        often = np.flatnonzero(np.bincount(own, minlength=n_strings)[own] > 1)
        if not len(often):
            return out
        ids = self.least[self.text_of(places[often])]
        order = np.lexsort((ids, own[often]))
        often, ids = often[order], ids[order]
        first = np.flatnonzero(np.diff(own[often], prepend=-1))
        lead = np.repeat(first, np.diff(np.append(first, len(often))))
        windows = np.lib.stride_tricks.sliding_window_view(self.data, LENGTH)
        clash: set[int] = set()
        for i in range(0, len(often), 1 << 16):
            part = slice(i, i + (1 << 16))
            same = (windows[places[often[part]]] == windows[places[often[lead[part]]]]).all(1)
            clash.update(own[often[part]][~same].tolist())
        out[often] = ids[lead] < ids
        for k in clash:
            mine = often[own[often] == k]
            known: dict[bytes, int] = {}
            for j in mine.tolist():
                out[j] = known.setdefault(windows[places[j]].tobytes(), int(self.least[self.text_of(places[j])])) < self.least[self.text_of(places[j])]
        return out

    def covered(self, go: np.ndarray) -> np.ndarray:
        """Mask of the bytes under the strings at these places."""
        cover = np.zeros(len(self.data) + 1, np.int8)
        cover[go] += 1
        cover[go + LENGTH] -= 1
        return np.cumsum(cover[:-1], dtype=np.int8) > 0


def _split(names: np.ndarray, bits: int, bucket_bits: int) -> np.ndarray:
    """Bounds of the buckets in sorted names."""
    edges = np.arange(1, 1 << bucket_bits, dtype=np.uint64) << np.uint64(bits - bucket_bits) if bucket_bits else np.zeros(0, np.uint64)
    return np.concatenate([[0], np.searchsorted(names, edges), [len(names)]])


def _blobs(grp: int, names: np.ndarray, bits: int, bucket_bits: int, tails: np.ndarray | None = None, tail_bytes: int = 0, note: bytes | None = None) -> pa.Table:
    """One row for each bucket that has names; a note, if any, goes to a bucket of the group's own, and comes back as it is."""
    cuts = _split(names, bits, bucket_bits)
    full = np.flatnonzero(np.diff(cuts)).tolist()
    blobs = [pack(names[cuts[k] : cuts[k + 1]], None if tails is None else tails[cuts[k] : cuts[k + 1]], tail_bytes) for k in full]
    if note is not None:
        full, blobs = [*full, (1 << bucket_bits) + grp], [*blobs, note]
    return pa.table({"bucket": pa.array(full, pa.int32()), "grp": pa.array(np.full(len(full), grp, np.int32)), "blob": pa.array(blobs, pa.binary())})


def _told(right: pa.Table, names: np.ndarray, bits: int, bucket_bits: int) -> tuple[np.ndarray, bytes | None]:
    """The bits that came back, by name, and the note."""
    out, note = np.zeros(len(names), bool), None
    cuts = _split(names, bits, bucket_bits)
    for bucket, told in zip(right["bucket"].to_pylist(), right["bits"].to_pylist(), strict=True):
        if bucket >> bucket_bits:
            note = told
            continue
        a, b = cuts[bucket], cuts[bucket + 1]
        out[a:b] = np.unpackbits(np.frombuffer(told, np.uint8), count=b - a).astype(bool)
    return out, note


def _compare(blobs: DataFrame, earlier: bool, bucket_bits: int, tail_bytes: int = 0) -> DataFrame:
    """Sorts each bucket's names and compares neighbours: grp, bucket and one bit a name, set if another (or an earlier) group holds it."""

    def run(t: pa.Table) -> pa.Table:
        if t["bucket"][0].as_py() >> bucket_bits:
            return t.select(["grp", "bucket", "blob"]).rename_columns(["grp", "bucket", "bits"])
        worker_cache("suffix_dedup")
        trim()
        t = t.sort_by("grp")
        names, tails = zip(*[unpack(x.as_py(), tail_bytes) for x in t["blob"]], strict=True)
        n = np.array([len(p) for p in names])
        names, tails = np.concatenate(names), np.concatenate(tails)
        order = by_name(names, tails)
        same = (names[order[1:]] == names[order[:-1]]) & (tails[order[1:]] == tails[order[:-1]])
        hit = np.zeros(len(order), bool)
        if earlier:
            # The blobs come in the order of their groups: the least place of equal names is the first group's.
            first = np.flatnonzero(np.concatenate([[True], ~same]))
            hit = order != np.repeat(np.minimum.reduceat(order, first), np.diff(np.append(first, len(order))))
        else:
            hit[1:] = same
            hit[:-1] |= same
        told = np.empty(len(order), bool)
        told[order] = hit
        at = np.cumsum(n) - n
        bits = pa.array([np.packbits(told[a : a + k]).tobytes() for a, k in zip(at, n, strict=True)], pa.binary())
        return pa.table({"grp": t["grp"], "bucket": t["bucket"], "bits": bits})

    return blobs.groupBy("bucket").applyInArrow(run, "grp int, bucket int, bits binary")


def _keyed(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(text).alias("h1"), F.xxhash64(text, F.lit(9)).alias("h2"), text.alias("text"), *more)


def distinct_texts(rows: DataFrame, group_bytes: int) -> tuple[DataFrame, DataFrame, int, int]:
    """grp, h1, h2, least, text, and rest where rows have it: each distinct text once, dealt by ranges of its least id.

    With them the rows and their groups (-1 and a null rest for texts that may
    occur often), the number of groups and of bytes.
    """
    keys = table(rows.select("id", "h1", "h2", F.octet_length("text").alias("size")).groupBy("h1", "h2").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("size").alias("size")), "suffix-keys")
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    n_groups = max(1, -(-total // group_bytes))
    bounds = np.zeros(0, np.int64)
    if n_groups > 1:
        # As a range partitioner does: of few rows all ids, else a share of them; it moves the groups' bounds, but no result.
        share = min(n_groups * IDS_A_GROUP, IDS_AT_MOST) / max(1, keys.count())
        ids = np.sort((keys if share >= 1 else keys.sample(share, seed=1)).select("least").toArrow()["least"].to_numpy())
        bounds = np.unique(ids[np.arange(1, n_groups) * len(ids) // n_groups]) if len(ids) else bounds
    word = F.shiftrightunsigned("h1", 64 - BITMAP_BITS + 6)
    many = keys.filter("n > 1")
    words = many.groupBy(word.alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h1, {64 - BITMAP_BITS}) & 63 as int))")).alias("v")).toArrow()
    bitmap = np.zeros(1 << (BITMAP_BITS - 6), np.uint64)
    bitmap[words["w"].to_numpy()] = words["v"].to_numpy().view(np.uint64)
    held = rows.sparkSession.sparkContext.broadcast((bounds, bitmap))
    drop(keys)

    def group(ids: pa.Array) -> np.ndarray:
        return np.searchsorted(held.value[0], ids.to_numpy(zero_copy_only=False), "right").astype(np.int32)

    @F.arrow_udf("int")
    def place(ids: pa.Array, h1: pa.Array) -> pa.Array:
        """The group of a text that occurs once, and -1 for one that may occur often."""
        at = h1.to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - BITMAP_BITS)
        often = (held.value[1][(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)
        return pa.array(np.where(often, np.int32(-1), group(ids)))

    @F.arrow_udf("int")
    def place_least(ids: pa.Array) -> pa.Array:
        return pa.array(group(ids))

    @F.arrow_udf("binary")
    def packed(texts: pa.Array) -> pa.Array:
        zip_ = zstandard.ZstdCompressor(1)
        return pa.array([zip_.compress(x.as_buffer()) for x in texts.cast(pa.binary())], pa.binary())

    placed = rows.withColumn("grp", place("id", "h1"))
    carried = ["rest"] if "rest" in rows.columns else []
    once = placed.filter("grp >= 0").select("grp", "h1", "h2", F.col("id").alias("least"), packed("text").alias("packed"), *carried)
    # All rows of a text are on this side; each task sends a text once.
    copies = placed.filter("grp < 0").groupBy("h1", "h2").agg(F.min("id").alias("least"), F.first("text").alias("text"))
    none = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in carried]
    texts = once.unionByName(copies.select(place_least("least").alias("grp"), "h1", "h2", "least", packed("text").alias("packed"), *none))
    return texts.repartition(n_groups, "grp"), placed, n_groups, total


def judged_texts(rows: DataFrame, group_bytes: int = GROUP_BYTES, bucket_names: int = BUCKET_NAMES, string_bits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """h1, h2, least, n_bytes, n_removed, n_spans, kept_sha256 of each distinct text; if rows have a column rest, also that and what is kept of the text.

    The second result is the rows with their groups, as distinct_texts() has
    them.  The fewer string_bits names have (by default as many as fit beside whole
    bytes of second hashes), the longer are the second hashes.
    """
    texts, placed, _, total = distinct_texts(rows, group_bytes)
    with_text = "rest" in rows.columns
    n_names = max(1, total * len(COVER) // CYCLE)
    bucket_bits = max(0, math.ceil(math.log2(max(1, n_names / bucket_names))))
    name_bits = min(64, max(bucket_bits, math.ceil(math.log2(n_names + 1)) + 10))
    wanted = math.ceil(2 * math.log2(total + 2)) + SPARE
    string_bits = max(bucket_bits, string_bits or min(wanted, 64 - -wanted % 8))
    tail_bytes = min(8, max(0, -(-(wanted - string_bits) // 8)))

    def load(t: pa.Table) -> Group:
        worker_cache("suffix_dedup")
        trim()
        return Group(t, string_bits, tail_bytes)

    def sample(t: pa.Table) -> pa.Table:
        return _blobs(t["grp"][0].as_py(), distinct(load(t).sampled(name_bits)[1]), name_bits, bucket_bits)

    def strings(t: pa.Table, told: pa.Table) -> pa.Table:
        if not len(t):
            return _blobs(0, np.zeros(0, np.uint64), string_bits, bucket_bits)
        t = in_order(t)
        g = load(t)
        at, names = g.sampled(name_bits)
        names, inverse = np.unique(names, return_inverse=True)
        places = g.candidates(at, inverse, _told(told, names, name_bits, bucket_bits)[0])
        names, tails, _ = g.strings(places)
        return _blobs(t["grp"][0].as_py(), names, string_bits, bucket_bits, tails, tail_bytes, pack_places(places) if len(places) else None)

    def judge(t: pa.Table, told: pa.Table) -> pa.Table:
        if not len(t):
            return finish(t, None)
        # Places come from the step before.
        t = in_order(t)
        g = load(t)
        note = told.filter(pc.greater_equal(told["bucket"], 1 << bucket_bits))
        if not len(note):
            return finish(t, g, np.zeros(len(g.data), bool))
        places = unpack_places(note["bits"][0].as_py())
        names, _, own = g.strings(places)
        go = _told(told, names, string_bits, bucket_bits)[0][own] | g.repeated(places, own, len(names))
        return finish(t, g, g.covered(places[go]))

    finish = _finisher(with_text)
    blob = "bucket int, grp int, blob binary"
    first = _compare(texts.groupBy("grp").applyInArrow(sample, blob), False, bucket_bits)
    told = _compare(texts.groupBy("grp").cogroup(first.groupBy("grp")).applyInArrow(strings, blob), True, bucket_bits, tail_bytes)
    schema = T.StructType([*(T.StructField(c, T.LongType()) for c in ("h1", "h2", "least", "n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType())])
    if with_text:
        schema = schema.add("kept", T.StringType()).add("rest", rows.schema["rest"].dataType)
    return texts.groupBy("grp").cogroup(told.groupBy("grp")).applyInArrow(judge, schema), placed


def _finisher(with_text: bool) -> Callable[..., pa.Table]:
    def finish(t: pa.Table, g: Group | None, gone: np.ndarray | None = None) -> pa.Table:
        size, lost, spans, sha, kept = [], [], [], [], []
        for i in range(len(t)):
            a, b = g.offsets[i], g.offsets[i + 1]
            m = gone[a:b]
            rest = g.data[a:b][~m].tobytes()
            size.append(int(b - a))
            lost.append(int(m.sum()))
            spans.append(int(m[:1].sum() + (m[1:] & ~m[:-1]).sum()))
            sha.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest.decode("utf-8", "ignore") if with_text else None)
        out = {**{c: t[c].cast(pa.int64()) for c in ("h1", "h2", "least")}, "n_bytes": pa.array(size, pa.int64()), "n_removed": pa.array(lost, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(sha, pa.string())}
        return pa.table(out | ({"kept": pa.array(kept, pa.string()), "rest": t["rest"]} if with_text else {}))

    return finish


EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def repeat_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """One row a document: id, n_bytes, n_removed, n_spans, kept_sha256."""
    rows = _keyed(docs, id_col, text_col)
    own = rows.select("id", "h1", "h2").join(judged_texts(rows, **options)[0], ["h1", "h2"])
    copy = (F.col("id") > F.col("least")) & (F.col("n_bytes") >= LENGTH)
    kind = docs.schema[id_col].dataType
    return own.select(
        F.nullif("id", F.lit(LAST)).cast(kind).alias(id_col), "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, F.lit(1).cast("long")).otherwise(F.col("n_spans")).alias("n_spans"), F.when(copy, F.lit(EMPTY_SHA)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """The rows of docs, all columns, with what is kept of their texts.

    A text that loses nothing stays as it is (null too); of a character that
    loses some of its bytes, none are kept.
    """
    others = [c for c in docs.columns if c != text_col]
    rest = F.struct(F.col(text_col).isNull().alias("none"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(others)])
    rows = _keyed(docs, id_col, text_col, rest.alias("rest"))
    judged, placed = judged_texts(rows, **options)

    def restored(df: DataFrame, text: Column) -> DataFrame:
        text = F.when(~F.col("rest.none") | (F.col("n_removed") > 0), text)
        at = {c: F.col(f"rest.c{i}") for i, c in enumerate(others)} | {text_col: text}
        return df.select(*[at[c].alias(c) for c in docs.columns])

    # A text that occurs once brings its row's columns along; only rows of the others are joined.
    once = restored(judged.filter("rest is not null"), F.col("kept"))
    found = judged.filter("rest is null").select("h1", "h2", "least", "n_bytes", "n_removed", "kept")
    copies = placed.filter("grp < 0").select("id", "h1", "h2", "rest").join(found, ["h1", "h2"])
    gone = (F.col("id") > F.col("least")) & (F.col("n_bytes") >= LENGTH)
    return once.unionByName(restored(copies, F.when(gone, F.lit("")).otherwise(F.col("kept"))))
