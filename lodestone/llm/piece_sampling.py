"""Sampled SentencePiece segmentations by forward filtering and backward sampling, and lossless decoding.

Every way to write a text as pieces of the model is a path through a lattice.
A piece's weight follows its rank in the model by Zipf's law, `sharpness` times
its logarithm; forward filtering sums the weights of all paths to each place,
and backward sampling draws the last piece, the one before, and so on, each by
its share of the paths.  Draws come from a hash of the row's key, the segment's
number in the text and the step, so that a key gives the same pieces again on
any cluster.

A text is cut where no piece holds the two neighbouring characters side by
side, which no path crosses, so that the lattice of the text is the product of
its segments' lattices, exactly.  Forward filtering runs once for each distinct
segment while it stays in a bounded cache; backward sampling runs over all
segments of a group of texts at once.

Lossless: a space is the piece character U+2581; any character without a piece
of its own, U+2581 in the text included, goes into byte pieces.  Decoding joins
the pieces' bytes and gives the text back as it was, white space and all.

Defined results: null is encoded as the empty text, which has no pieces; a null
key seeds like the empty string; rows with one key and text get one result; an
empty table gives an empty result; a text of any length is read whole, a long
one in parts; columns that are not named are kept by the callers that want them,
and not read here.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.spans import CONT, as_bytes, groups, mix, span_hashes, trim, worker_cache

SHARPNESS = 1.0
CACHE_EDGES = 2_500_000
#: Bytes of texts, or of a part of a long one, that are sampled at once.
PART_BYTES = 1 << 20
SPACE = "▁"


class Pieces:
    """A model's vocabulary: bytes and weight of each id, a byte trie of the pieces, and which byte pairs they hold."""

    def __init__(self, path: str, sharpness: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.byte_ids = np.zeros(256, np.int32)
        raw: list[bytes] = []
        children: list[dict[int, int]] = [{}]
        piece_at: dict[int, int] = {}
        pairs = np.zeros((256, 256), bool)
        ranked = sorted((i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))), key=lambda i: (-model.get_score(i), i))
        # User-defined pieces (runs of spaces) carry a score of 0 and rank first, like the earliest merges.
        weight = {i: -sharpness * math.log(rank + 2) for rank, i in enumerate(ranked)}
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:-1], 16)] = i
                raw.append(bytes([int(piece[3:-1], 16)]))
            elif i in weight:
                data = piece.replace(SPACE, " ").encode()
                raw.append(data)
                node = 0
                for byte in data:
                    if byte not in children[node]:
                        children[node][byte] = len(children)
                        children.append({})
                    node = children[node][byte]
                piece_at[node] = i
                b = np.frombuffer(data, np.uint8)
                pairs[b[:-1], b[1:]] = True
            else:
                raw.append(b"")
        self.pairs = pairs
        # The trie's moves as sorted keys (node * 256 + byte), and the piece that ends at a node.
        moves = sorted((node * 256 + byte, to) for node, own in enumerate(children) for byte, to in own.items())
        self.move_keys, self.move_to = (np.array(x, np.int64) for x in zip(*moves, strict=True))
        self.node_piece = np.full(len(children), -1, np.int32)
        self.node_piece[list(piece_at)] = list(piece_at.values())
        self.weights = np.zeros(n)
        self.weights[list(weight)] = list(weight.values())
        self.fallback = -sharpness * math.log(10 * n)
        self.lengths = np.array([len(x) for x in raw], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(raw), np.uint8)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of a run of ids, and the byte offset after each id."""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return self.data[np.repeat(self.starts[ids] - (ends - n), n) + np.arange(total)], ends


class Sampler:
    """Lattices of the segments seen so far, in flat arrays, and backward sampling over them."""

    def __init__(self, pieces: Pieces, cache_edges: int = CACHE_EDGES):
        self.pieces, self.limit = pieces, cache_edges
        self._reset()

    def _reset(self) -> None:
        self.hashes, self.ends = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        # Node 0 stands for every segment's beginning; edges of a node lie side by side, cumulated.
        self.first, self.n_nodes = np.zeros(1 << 14, np.int64), 1
        self.cum, self.back = np.zeros(1 << 16, np.float32), np.zeros(1 << 16, np.int32)
        self.tok, self.tok_n = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int8)
        self.n_edges = 0
        self.spill, self.n_spill = np.zeros(1 << 10, np.int32), 0

    def _edges(self, buf: np.ndarray, seg_of: np.ndarray, seg_end: np.ndarray) -> tuple[np.ndarray, ...]:
        """All edges of the segments' lattices: start, end (byte places), token or -1 - place in `spill`, tokens, weight; and the new spill."""
        p = self.pieces
        chars = np.flatnonzero(~CONT[buf])
        begin, at, node = chars, chars.copy(), np.zeros(len(chars), np.int64)
        found = []
        while len(begin):
            key = node * 256 + buf[at]
            k = np.minimum(np.searchsorted(p.move_keys, key), len(p.move_keys) - 1)
            ok = p.move_keys[k] == key
            begin, at, node = begin[ok], at[ok] + 1, p.move_to[k[ok]]
            hit = p.node_piece[node]
            whole = hit >= 0
            found.append((begin[whole], at[whole], hit[whole]))
            more = at < seg_end[seg_of[begin]]
            begin, at, node = begin[more], at[more], node[more]
        start, end, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        # Characters that are no piece go into byte pieces.
        after = np.append(chars[1:], len(buf))
        single = np.zeros(len(buf) + 1, np.int64)
        np.maximum.at(single, start, np.where(end - start == (after - chars)[np.searchsorted(chars, start)], 1, 0))
        lone = np.flatnonzero(single[chars] == 0)
        size = (after - chars)[lone]
        place = np.cumsum(size) - size
        spill = p.byte_ids[buf[np.repeat(chars[lone] - place, size) + np.arange(int(size.sum()))]]
        return (
            np.concatenate([start, chars[lone]]), np.concatenate([end, after[lone]]), np.concatenate([piece, (-1 - self.n_spill - place).astype(np.int32)]),
            np.concatenate([np.ones(len(start), np.int8), size.astype(np.int8)]), np.concatenate([p.weights[piece], size * p.fallback]), spill,
        )

    def _learn(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> None:
        """Forward filtering over the new segments, side by side: one step for each byte place."""
        size = stops - starts
        seg_end = np.cumsum(size)
        seg_start = seg_end - size
        buf = data[np.repeat(starts - seg_start, size) + np.arange(int(seg_end[-1]))]
        seg_of = np.repeat(np.arange(len(size)), size)
        start, end, tok, tok_n, weight, spill = self._edges(buf, seg_of, seg_end)
        first_byte = seg_start[seg_of[start]]
        order = np.lexsort((start, end, end - first_byte))
        start, end, tok, tok_n, weight, first_byte = (x[order] for x in (start, end, tok, tok_n, weight, first_byte))
        opening = start == first_byte
        alpha, cum = np.zeros(len(buf) + 1), np.empty(len(start))
        local = end - first_byte
        slices = np.flatnonzero(np.concatenate([[True], local[1:] != local[:-1], [True]]))
        heads = np.concatenate([[True], end[1:] != end[:-1]])
        for a, b in zip(slices[:-1].tolist(), slices[1:].tolist(), strict=True):
            z = weight[a:b] + np.where(opening[a:b], 0.0, alpha[start[a:b]])
            group = np.flatnonzero(heads[a:b])
            n = np.diff(np.append(group, b - a))
            top = np.maximum.reduceat(z, group)
            e = np.exp(z - np.repeat(top, n))
            # Sums run inside each node alone, so that they don't depend on the company it is learned in.
            total = e[group].copy()
            sums = e.copy()
            for k in range(1, int(n.max())):
                more = np.flatnonzero(n > k)
                total[more] += e[group[more] + k]
                sums[group[more] + k] = total[more]
            alpha[end[a:b][group]] = top + np.log(total)
            cum[a:b] = sums / np.repeat(total, n)
        cum[np.append(np.flatnonzero(heads)[1:] - 1, len(cum) - 1)] = 2.0
        base = self.n_nodes
        first = np.zeros(len(buf), np.int64)
        first[end[heads] - 1] = self.n_edges + np.flatnonzero(heads)
        back = np.where(opening, 0, base + start - 1).astype(np.int32)
        for name, new, used in (("first", first, self.n_nodes), ("cum", cum, self.n_edges), ("back", back, self.n_edges), ("tok", tok, self.n_edges), ("tok_n", tok_n, self.n_edges), ("spill", spill, self.n_spill)):
            have = getattr(self, name)
            if used + len(new) > len(have):
                have = np.concatenate([have[:used], np.zeros((used + len(new)) // 4 + len(new), have.dtype)])
            have[used : used + len(new)] = new
            setattr(self, name, have)
        self.n_nodes += len(first)
        self.n_edges += len(cum)
        self.n_spill += len(spill)
        at = np.searchsorted(self.hashes, hashes)
        self.hashes, self.ends = np.insert(self.hashes, at, hashes), np.insert(self.ends, at, base + seg_end - 1)

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """Mask of the bytes (but for the first) before which no piece goes on."""
        cut = np.zeros(len(data), bool)
        cut[1:] = ~self.pieces.pairs[data[:-1], data[1:]] & ~CONT[data[1:]]
        return cut

    def parts(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """Ranges of whole texts and their bytes; a long text alone, in parts that begin where it is cut."""
        for i, j in groups(offsets, PART_BYTES):
            lo, end = int(offsets[i]), int(offsets[j])
            while end - lo > 2 * PART_BYTES and j == i + 1:
                hi = lo + PART_BYTES
                while hi < end:
                    found = np.flatnonzero(self.cuts(data[hi - 1 : hi + 4096]))
                    if len(found):
                        hi += int(found[0]) - 1
                        break
                    hi = min(hi + 4096, end)
                if hi >= end:
                    break
                yield i, j, lo, hi
                lo = hi
            yield i, j, lo, end

    def sample(self, data: np.ndarray, offsets: np.ndarray, seeds: np.ndarray, skipped: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
        """Piece ids of a group of texts, each text's bounds among them, and the number of segments; skipped: those of the text before this part."""
        cut = self.cuts(data)
        cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        starts = np.flatnonzero(cut)
        bounds = np.searchsorted(starts, offsets)
        stops = np.append(starts[1:], len(data)) if len(starts) else starts
        hashes = span_hashes(data, starts, stops)
        uniq, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if self.n_edges > self.limit:
            self._reset()
        at = np.searchsorted(self.hashes, uniq)
        new = np.flatnonzero((at == len(self.hashes)) | (np.append(self.hashes, np.uint64(0))[at] != uniq))
        if len(new):
            self._learn(uniq[new], data, starts[where[new]], stops[where[new]])
            at = np.searchsorted(self.hashes, uniq)
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
        key = mix(seeds[text] + (np.arange(len(starts)) - bounds[text] + skipped).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        live = np.arange(len(starts))
        node = self.ends[at][inverse]
        count = np.zeros(len(starts), np.int64)
        steps = []
        step = 0
        while len(live):
            u = (mix(key[live] + np.uint64(step)) >> np.uint64(40)).astype(np.float32) * np.float32(2**-24)
            edge = self.first[node]
            # Walk along each node's cumulated shares; most nodes have few edges.
            moving = np.flatnonzero(u >= self.cum[edge])
            while len(moving):
                edge[moving] += 1
                moving = moving[u[moving] >= self.cum[edge[moving]]]
            n = self.tok_n[edge]
            count[live] += n
            steps.append((live, edge, n))
            node = self.back[edge]
            go = node > 0
            live, node = live[go], node[go]
            step += 1
        ends = np.cumsum(count)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        at = ends.copy()
        for live, edge, n in steps:
            at[live] -= n
            t = self.tok[edge]
            one = n == 1
            whole = one & (t >= 0)
            out[at[live[whole]]] = t[whole]
            for k in np.flatnonzero(~whole).tolist():
                p = at[live[k]]
                s = -1 - int(t[k])
                out[p : p + n[k]] = self.spill[s : s + n[k]]
        return out, np.concatenate([[0], ends])[bounds], len(starts)


def sampler(path: str, sharpness: float) -> Sampler:
    """One sampler a Python worker."""
    kept = worker_cache("piece_sampling")
    if (path, sharpness) not in kept:
        kept[path, sharpness] = Sampler(Pieces(path, sharpness))
    return kept[path, sharpness]


def _list(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))


def _same(pieces: Pieces, ids: np.ndarray, bounds: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text's ids decode to its bytes."""
    back, ends = pieces.decode(ids)
    after = np.concatenate([[0], ends])[bounds]
    same = (np.diff(after) == np.diff(offsets)) & (after[:-1] == offsets[:-1])
    if len(back) == len(data):
        wrong = np.concatenate([[0], np.cumsum(back != data)])
        same &= wrong[offsets[1:]] == wrong[offsets[:-1]]
    return same


def encode_sampled(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", sharpness: float = SHARPNESS, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, the columns of `keep`, piece_ids, n_pieces, and lossless: the ids decode to the very text."""
    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (id_col, *keep)]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sampler(model, sharpness)
        for batch in parts:
            data, offsets = as_bytes(batch.column(0))
            done: list[tuple[np.ndarray, bool]] = []
            skipped = 0
            for i, j, lo, hi in s.parts(data, offsets):
                own = offsets[i : j + 1] - lo if hi - lo == offsets[j] - offsets[i] else np.array([0, hi - lo])
                ids, bounds, n_segments = s.sample(data[lo:hi], own, batch.column(1).slice(i, j - i).to_numpy().view(np.uint64), skipped)
                same = _same(s.pieces, ids, bounds, data[lo:hi], own)
                if hi < offsets[j] or done:
                    done.append((ids, bool(same[0])))
                    skipped += n_segments
                    if hi < offsets[j]:
                        continue
                    ids, same = np.concatenate([x for x, _ in done]), np.array([all(x for _, x in done)])
                    bounds = np.array([0, len(ids)])
                    done, skipped = [], 0
                cols = [batch.column(2 + k).slice(i, j - i) for k in range(1 + len(keep))]
                yield pa.RecordBatch.from_arrays([*cols, _list(ids, bounds), pa.array(np.diff(bounds).astype(np.int64)), pa.array(same)], [id_col, *keep, "piece_ids", "n_pieces", "lossless"])
            trim()

    seed = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(41))
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("_t"), seed.alias("_seed"), F.col(id_col).alias("_id"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)])
    return rows.mapInArrow(run, ", ".join([*kinds, "piece_ids array<int>", "n_pieces long", "lossless boolean"]))


def decode_pieces(encoded: DataFrame, model: str, ids_col: str = "piece_ids", text_col: str = "text") -> DataFrame:
    """The encoded rows with their texts, from the ids alone; null ids give null."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = sampler(model, SHARPNESS).pieces
        for batch in parts:
            ids = batch.column(batch.schema.get_field_index(ids_col))
            texts = [None if x is None else pieces.decode(np.array(x, np.int64))[0].tobytes().decode() for x in ids.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, text_col])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{fields}, `{text_col}` string")
