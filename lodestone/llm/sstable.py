"""Token ids in sorted-string-table shards.

File format, all integers little endian, varints in base 128:

    shard  = block* index bloom meta footer
    block  = flag (0 stored, 1 zstd), crc32 of the payload (u32), payload
    payload, unpacked = entry*; entry = varint shared, varint unshared,
             varint value bytes, key suffix, value
    value  = width (2 or 4), token ids of that many bytes each
    index  = for each block: varint key bytes, first key, varint offset, varint bytes
    bloom  = number of hashes (u8), bits
    meta   = documents (u64), ids (u64)
    footer = offsets of index, bloom, meta, end of meta (u64 each), magic

Keys sort as the identifiers do: a zero byte for null; a one byte and then the
big-endian number with its sign bit turned, or the UTF-8 text.  Within a block a
key drops the bytes that it shares with the key before.  A lookup asks the
Bloom filter, finds the block by binary search in the index, and reads that
block alone; a scan reads the blocks in order.

Writing: texts are dealt by ranges of the identifier and sorted (range bounds
come from a sample of the identifiers); each task encodes and streams one shard
to a temporary name and renames it, so that a task that runs again replaces its
file.  Files go through pyarrow.fs, to the folder that all executors share.

Defined results: a null text is empty, a document of the end id alone; null ids
come first; rows with one id are kept each, in the order of their texts' hashes;
an empty table gives no shard and no rows; other columns are not read.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import json
import os
import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.shared import new_path, table
from lodestone.llm.spans import LOWER, Words, batches, worker_cache

MAGIC = b"LODESST1"
BLOCK_BYTES = 1 << 16
SHARD_BYTES = 24 << 20
BLOOM_BITS, BLOOM_HASHES = 10, 6
END_ID = 1
CACHE_WORDS = 2_000_000


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def key_of(ident: int | str | None) -> bytes:
    if ident is None:
        return b"\0"
    return b"\1" + (struct.pack(">Q", ident + (1 << 63)) if isinstance(ident, int) else ident.encode())


def ident_of(key: bytes, text: bool) -> int | str | None:
    if key == b"\0":
        return None
    return key[1:].decode() if text else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def pack_ids(ids: np.ndarray) -> bytes:
    wide = 4 if len(ids) and int(ids.max()) > 0xFFFF else 2
    return bytes([wide]) + ids.astype(f"<u{wide}").tobytes()


def unpack_ids(value: bytes) -> np.ndarray:
    return np.frombuffer(value, f"<u{value[0]}", offset=1).astype(np.uint32)


def _bloom_pair(key: bytes) -> tuple[int, int]:
    """Two independent hashes of 32 bits, the second odd."""
    a, b = struct.unpack("<II", hashlib.blake2b(key, digest_size=8).digest())
    return a, b | 1


def _bloom_places(key: bytes, bits: int, hashes: int) -> list[int]:
    a, b = _bloom_pair(key)
    return [(a + i * b) % bits for i in range(hashes)]


class Writer:
    """Streams entries in key order to one shard."""

    def __init__(self, out, block_bytes: int = BLOCK_BYTES):
        import zstandard

        self.out, self.block_bytes, self.pack = out, block_bytes, zstandard.ZstdCompressor(1)
        self.block, self.index, self.keys = bytearray(), [], []
        self.first = self.last = b""
        self.at = self.n_ids = 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        shared = 0
        if self.block:
            shared = len(os.path.commonprefix([self.last, key]))
        else:
            self.first = key
        value = pack_ids(ids)
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.last = key
        self.keys.append(_bloom_pair(key))
        self.n_ids += len(ids)
        if len(self.block) >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            body, flag = self.pack.compress(bytes(self.block)), 1
            if len(body) >= len(self.block):
                body, flag = bytes(self.block), 0
            data = bytes([flag]) + struct.pack("<I", zlib.crc32(body)) + body
            self.out.write(data)
            self.index.append((self.first, self.at, len(data)))
            self.at += len(data)
            self.block = bytearray()

    def close(self) -> None:
        self._flush()
        index = b"".join(varint(len(k)) + k + varint(o) + varint(n) for k, o, n in self.index)
        bits = max(64, BLOOM_BITS * len(self.keys))
        bloom = np.zeros(bits, bool)
        pairs = np.array(self.keys, np.int64).reshape(-1, 2)
        for i in range(BLOOM_HASHES):
            bloom[(pairs[:, 0] + i * pairs[:, 1]) % bits] = True
        tail = [index, bytes([BLOOM_HASHES]) + struct.pack("<Q", bits) + np.packbits(bloom, bitorder="little").tobytes(), struct.pack("<QQ", len(self.keys), self.n_ids)]
        marks = [self.at]
        for part in tail:
            self.out.write(part)
            marks.append(marks[-1] + len(part))
        self.out.write(struct.pack("<QQQQ", *marks) + MAGIC)


class Reader:
    """Looks up and scans one shard; `file` has read, seek and size (a pyarrow input file)."""

    def __init__(self, file, text_keys: bool = False):
        self.file, self.text_keys = file, text_keys
        size = file.size()
        foot = self._read(size - 40, 40)
        if foot[32:] != MAGIC:
            raise ValueError("not a shard")
        i, b, m, end = struct.unpack("<QQQQ", foot[:32])
        raw, self.index, at = self._read(i, b - i), [], 0
        while at < len(raw):
            n, at = read_varint(raw, at)
            key, at = raw[at : at + n], at + n
            offset, at = read_varint(raw, at)
            length, at = read_varint(raw, at)
            self.index.append((key, offset, length))
        raw = self._read(b, m - b)
        self.hashes, self.bits, self.bloom = raw[0], struct.unpack("<Q", raw[1:9])[0], raw[9:]
        self.n_docs, self.n_ids = struct.unpack("<QQ", self._read(m, end - m))

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def may_hold(self, ident: int | str | None) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _bloom_places(key_of(ident), self.bits, self.hashes))

    def _block(self, k: int) -> Iterator[tuple[bytes, bytes]]:
        import zstandard

        _, at, n = self.index[k]
        data = self._read(at, n)
        if zlib.crc32(data[5:]) != struct.unpack("<I", data[1:5])[0]:
            raise ValueError("a block's checksum is wrong")
        data = zstandard.ZstdDecompressor().decompress(data[5:]) if data[0] else data[5:]
        at, key = 0, b""
        while at < len(data):
            shared, at = read_varint(data, at)
            own, at = read_varint(data, at)
            size, at = read_varint(data, at)
            key, at = key[:shared] + data[at : at + own], at + own
            yield key, data[at : at + size]
            at += size

    def scan(self) -> Iterator[tuple[int | str | None, np.ndarray]]:
        for k in range(len(self.index)):
            for key, value in self._block(k):
                yield ident_of(key, self.text_keys), unpack_ids(value)

    def get(self, ident: int | str | None) -> list[np.ndarray]:
        """The ids of every document with this identifier."""
        if not self.may_hold(ident):
            return []
        want, out = key_of(ident), []
        k = max(0, bisect.bisect_left([x[0] for x in self.index], want) - 1)
        while k < len(self.index) and self.index[k][0] <= want:
            out += [unpack_ids(v) for key, v in self._block(k) if key == want]
            k += 1
        return out


#: The one word pattern under which letters and punctuation never share a token.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_PUNCTUATION[ord("'")] = False  # it may open a contraction
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def punctuation_cuts(data: np.ndarray) -> np.ndarray:
    """Bytes where a letter (ASCII or Latin-1) and ASCII punctuation other than an apostrophe meet."""
    letter_ends = _LETTER[data]
    letter_starts = letter_ends.copy()
    if len(data) > 1:
        latin = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        letter_ends[1:] |= latin
        letter_starts[:-1] |= latin
    mark = _PUNCTUATION[data]
    out = np.zeros(len(data), bool)
    out[1:] = (letter_ends[:-1] & mark[1:]) | (mark[:-1] & letter_starts[1:])
    return out


class WordEncoder:
    """Token ids of texts, each distinct word encoded once while it stays in a bounded cache.

    For models that lower-case and whose tokens cross neither ASCII white space
    nor the border between letters and punctuation, as `lowers` says; for others
    words are cut at white space alone.  A group of texts with the beginning of
    a special token's string is not cut or lower-cased either.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model, self.limit = Tokenizer.from_file(path), cache_words
        plan = json.loads(self.model.to_str())
        steps = [x.get("type") for x in (plan.get("normalizer") or {}).get("normalizers", [])]
        pattern = next((x["pattern"].get("Regex", "") for x in (plan.get("pre_tokenizer") or {}).get("pretokenizers", []) if x.get("type") == "Split"), "")
        self.lowers = "Lowercase" in steps and pattern == WORD_PATTERN
        self._reset()

    def _reset(self) -> None:
        # Sorted hashes of the known words, and where their ids lie.
        self.hashes, self.starts, self.lengths = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        got = [e.ids for e in self.model.encode_batch_fast(words, add_special_tokens=False)]
        n = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter(chain.from_iterable(got), np.uint32, int(n.sum()))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(flat)] = flat
        at = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.starts = np.insert(self.starts, at, self.used + np.cumsum(n) - n)
        self.lengths = np.insert(self.lengths, at, n)
        self.used += len(flat)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a group of texts, and each text's bounds among them."""
        if self.lowers and b"<|" not in data.tobytes():
            words = Words(LOWER[data], offsets, punctuation_cuts(data))
        else:
            words = Words(data, offsets)
        uniq, first, inverse = np.unique(words.hashes(), return_index=True, return_inverse=True)
        if len(self.hashes) + len(uniq) > self.limit:
            self._reset()
        at = np.searchsorted(self.hashes, uniq)
        new = np.flatnonzero((at == len(self.hashes)) | (np.append(self.hashes, np.uint64(0))[at] != uniq))
        if len(new):
            raw = words.data.tobytes()
            self._learn(uniq[new], [raw[a:b].decode() for a, b in zip(words.starts[first[new]].tolist(), words.ends[first[new]].tolist(), strict=True)])
            at = np.searchsorted(self.hashes, uniq)
        n = self.lengths[at][inverse].astype(np.int64)
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(self.starts[at][inverse] - (ends - n), n) + np.arange(total)]
        return ids, np.concatenate([[0], ends])[words.bounds]


def encoder(path: str) -> WordEncoder:
    """One encoder a Python worker."""
    kept = worker_cache("sstable")
    if path not in kept:
        kept[path] = WordEncoder(path)
    return kept[path]


def write_shards(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the shards and returns the manifest: shard, path, n_docs, n_ids, first_key, last_key, in key order of the shards."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_t"))
    size = rows.agg(F.sum(F.octet_length("_t") + 16)).first()[0] or 0
    order = [F.col("_id").asc_nulls_first(), F.xxhash64("_t")]
    rows = rows.repartitionByRange(max(1, -(-size // shard_bytes)), *order).sortWithinPartitions(*order)

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        writer = out = first = last = None
        store, base = fs.FileSystem.from_uri(folder)
        n = 0
        for batch in parts:
            for part, data, offsets in batches(batch, "_t"):
                if writer is None:
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(f"{base}/part-{shard:06d}-{attempt}.tmp")
                    writer = Writer(out)
                ids, bounds = encoder(tokenizer).encode(data, offsets)
                for k, ident in enumerate(part.column(0).to_pylist()):
                    last = key_of(ident)
                    first = last if first is None else first
                    writer.add(last, np.append(ids[bounds[k] : bounds[k + 1]], np.uint32(end_id)))
                    n += 1
        if writer is not None:
            writer.close()
            out.close()
            store.move(f"{base}/part-{shard:06d}-{attempt}.tmp", f"{base}/part-{shard:06d}.sst")
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (shard, f"{folder}/part-{shard:06d}.sst", n, writer.n_ids, first, last)], ["shard", "path", "n_docs", "n_ids", "first_key", "last_key"])

    return table(rows.mapInArrow(write, "shard long, path string, n_docs long, n_ids long, first_key binary, last_key binary"), "sst-manifest")


def open_shard(path: str, text_keys: bool) -> Reader:
    store, where = fs.FileSystem.from_uri(path)
    return Reader(store.open_input_file(where), text_keys)


def read_shards(manifest: DataFrame, id_col: str = "doc_id", kind: str = "bigint") -> DataFrame:
    """Scans the shards: id, start (ids of all documents before it), ids."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    shards = shards.select("path", "base").repartition(max(1, manifest.count()), "path")

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for path, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, held = [], 0
                for ident, ids in open_shard(path, kind == "string").scan():
                    rows.append((ident, start, ids))
                    start += len(ids)
                    held += len(ids)
                    if held > 1 << 20:
                        yield _rows(rows, id_col, kind)
                        rows, held = [], 0
                if rows:
                    yield _rows(rows, id_col, kind)

    return shards.mapInArrow(read, f"`{id_col}` {kind}, start long, ids array<bigint>")


def _rows(rows: list[tuple], id_col: str, kind: str) -> pa.RecordBatch:
    bounds = np.concatenate([[0], np.cumsum([len(r[2]) for r in rows])]).astype(np.int32)
    ids = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([r[2] for r in rows]).astype(np.int64)))
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string() if kind == "string" else pa.int64()).cast(_ARROW[kind]), pa.array([r[1] for r in rows], pa.int64()), ids], [id_col, "start", "ids"])


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "string": pa.string()}


def digests(manifest: DataFrame, id_col: str = "doc_id", kind: str = "bigint") -> DataFrame:
    """From the files: id, start, n_tokens and ids_crc32 (of the ids as little-endian unsigned 32-bit integers)."""

    def digest(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            paths, starts = (c.to_pylist() for c in batch.columns)
            for path, start in zip(paths, starts, strict=True):
                rows = []
                for ident, ids in open_shard(path, kind == "string").scan():
                    rows.append((ident, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                idents, *rest = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(idents, _ARROW[kind]), *(pa.array(r, pa.int64()) for r in rest)], [id_col, "start", "n_tokens", "ids_crc32"])

    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    return shards.select("path", "base").repartition(max(1, manifest.count()), "path").mapInArrow(digest, f"`{id_col}` {kind}, start long, n_tokens long, ids_crc32 long")


def lookup(manifest: DataFrame, idents: Iterable[int | str | None], text_keys: bool = False) -> dict[int | str | None, list[np.ndarray]]:
    """The ids of a few documents, through the manifest's key ranges, Bloom filters and block indexes, on the driver; other shards are not opened."""
    out: dict = {i: [] for i in idents}
    keys = {i: key_of(i) for i in out}
    within = [(F.col("first_key") <= F.lit(k)) & (F.col("last_key") >= F.lit(k)) for k in keys.values()]
    held = manifest.filter(functools.reduce(lambda x, y: x | y, within)) if within else manifest.limit(0)
    for r in held.orderBy("shard").toLocalIterator():
        shard = open_shard(r.path, text_keys)
        for i, k in keys.items():
            if bytes(r.first_key) <= k <= bytes(r.last_key):
                out[i] += shard.get(i)
    return out


def write_token_tables(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """write_shards() to a new folder below the shared one."""
    spark: SparkSession = docs.sparkSession
    return write_shards(docs, new_path(spark, "sst"), tokenizer, **options)
