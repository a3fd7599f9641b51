"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of its
labelled rows: at most `max_docs`, by a hash of the id, each with at most
`WINDOWS` windows of `WINDOW` characters, spread evenly over its whole text.  A text is parsed into the longest pieces that occur in a language's
sample (Ziv and Merhav's cross parsing); phrases times log2 of the sample's
length, by the text's length, estimate the bits a byte needs under that
language.  The language that needs fewest wins; the score is the softmax of
those estimates over `evidence` bytes of text.

Texts are lower-cased (ASCII and Latin-1 letters) and runs of other ASCII
characters become one space.  A whole text is parsed in lanes of `LANE` bytes,
side by side in numpy; a phrase ends with its lane, alike for every language.
Workers build the automata themselves from the samples, which are bounded; their
moves are rows laid over each other in one array, so that a language takes some
16 bytes for each of its sample's moves, whatever its script.

Defined results: `und` with score 0 for a null text, a text without a letter,
or when nothing could be learned; ties go to the language that sorts first;
rows with a null id or null lang are not learned from; a null id is never held
out; repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.spans import as_bytes, batches, groups, trim, worker_cache

MAX_DOCS, WINDOWS, WINDOW = 40, 8, 100
LANE = 512
EVIDENCE = 24
UNKNOWN = "und"


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes with one space for each run of ASCII non-letters, and the new offsets."""
    x = data.copy()
    upper = (x >= 65) & (x <= 90)
    x[upper] += 32
    if len(x) > 1:
        latin = (x[:-1] == 0xC3) & (x[1:] >= 0x80) & (x[1:] <= 0x9E) & (x[1:] != 0x97)
        x[1:][latin] += 32
    gap = (x < 97) | ((x > 122) & (x < 128))
    x[gap] = 32
    keep = np.ones(len(x), bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    keep[first] = ~gap[first]
    total = np.concatenate([[0], np.cumsum(keep)])
    return x[keep], total[offsets]


def automaton(sample: bytes) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of `sample`; state 0 is the root."""
    move: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in sample:
        new = len(move)
        move.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in move[p]:
            move[p][c] = new
            p = link[p]
        if p >= 0:
            q = move[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(move)
                move.append(dict(move[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and move[p].get(c) == q:
                    move[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return move


class Moves:
    """Moves of automata in shared arrays: that of a state by a byte is at base[state] + byte, where owner says that it is the state's."""

    def __init__(self, moves: list[dict[int, int]]):
        n, sizes = len(moves), np.array([len(m) for m in moves], np.int64)
        state = np.repeat(np.arange(n), sizes)
        byte = np.array([c for m in moves for c in m], np.int64)
        bases = np.zeros(n, np.int64)
        # States of many moves try places at random, side by side, until all bytes of each fall on free ones; those of one move fill up the rest.
        draw, many = np.random.default_rng(5), sizes[state] > 1
        left, key, room = state[many], byte[many], 3 * int(many.sum()) + 512
        taken = np.zeros(room, bool)
        tries = 0
        while len(left):
            tries += 1
            if tries % 40 == 0:
                taken, room = np.append(taken, np.zeros(room // 2, bool)), room + room // 2
            own = np.flatnonzero(np.diff(left, prepend=-1))
            bases[left[own]] = draw.integers(0, room - 256, len(own))
            at = bases[left] + key
            claim = np.full(room, n, np.int64)
            np.minimum.at(claim, at, left)
            good = np.logical_and.reduceat((claim[at] == left) & ~taken[at], own)
            placed = np.repeat(good, np.diff(np.append(own, len(left))))
            taken[at[placed]] = True
            left, key = left[~placed], key[~placed]
        one = np.flatnonzero(~many)
        free = np.flatnonzero(~taken)
        free = np.append(free, np.arange(len(taken), len(taken) + max(0, len(one) - len(free))))[: len(one)]
        bases[state[one]] = free - byte[one]
        at = bases[state] + byte
        bases += 256
        end = int(max(at.max(initial=0), bases.max(initial=0))) + 513
        self.base = bases.astype(np.int32)
        self.owner, self.to = np.full(end, -1, np.int32), np.zeros(end, np.int32)
        self.owner[at + 256], self.to[at + 256] = state, [x for m in moves for x in m.values()]

    def next(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The states after these by these bytes, -1 where there is no such move."""
        at = self.base[state] + byte
        return np.where(self.owner[at] == state, self.to[at], np.int32(-1))


class Parser:
    """Automata of all languages, their states numbered through."""

    def __init__(self, samples: dict[str, bytes]):
        self.langs = sorted(samples)
        every: list[dict[int, int]] = []
        self.roots = []
        for lang in self.langs:
            at = len(every)
            self.roots.append(at)
            every += [{c: x + at for c, x in m.items()} for m in automaton(samples[lang])]
        self.moves = Moves(every)
        self.bits = np.log2([max(2, len(samples[x])) for x in self.langs])

    def rates(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Estimated bits a byte of each text under each language (texts by languages)."""
        n, k = len(offsets) - 1, len(self.langs)
        sizes = np.diff(offsets)
        lanes = -(-sizes // LANE)
        owner = np.repeat(np.arange(n), lanes)
        local = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        begin = offsets[owner] + local * LANE
        length = np.minimum(sizes[owner] - local * LANE, LANE)
        order = np.argsort(-length, kind="stable")
        begin, length, owner = begin[order], length[order], owner[order]
        codes = data.astype(np.int32)
        roots = np.array(self.roots, np.int32)[:, None]
        state = np.repeat(roots, len(begin), axis=1)
        phrases = np.zeros((k, len(begin)), np.int32)
        active = np.searchsorted(-length, -np.arange(LANE), "left")  # lanes longer than t
        for t in range(int(length[0]) if len(length) else 0):
            m = active[t]
            c = codes[begin[:m] + t][None, :]
            nxt = self.moves.next(state[:, :m], c)
            # A phrase starts at the root, and where the one before can't go on; a byte unknown to the sample is one.
            fail = nxt < 0
            phrases[:, :m] += fail | (state[:, :m] == roots)
            if fail.any():
                fresh = self.moves.next(np.broadcast_to(roots, nxt.shape), c)
                nxt = np.where(fail, np.where(fresh < 0, roots, fresh), nxt)
            state[:, :m] = nxt
        total = np.stack([np.bincount(owner, phrases[i], minlength=n) for i in range(k)], 1)
        return total * self.bits / np.maximum(sizes, 1)[:, None]


def parser(samples: tuple[tuple[str, bytes], ...]) -> Parser:
    """One parser a Python worker for each set of samples."""
    kept = worker_cache("langid")
    if samples not in kept:
        kept.clear()
        kept[samples] = Parser(dict(samples))
    return kept[samples]


def has_letter(data: np.ndarray, offsets: np.ndarray, texts: pa.Array) -> np.ndarray:
    ascii_letter = ((data | 32) >= 97) & ((data | 32) <= 122)
    total = np.concatenate([[0], np.cumsum(ascii_letter)])
    out = total[offsets[1:]] > total[offsets[:-1]]
    for i in np.flatnonzero(~out & (np.diff(offsets) > 1)):
        out[i] = any(ch.isalpha() for ch in texts[int(i)].as_py() or "")
    return out


def fold(ident: Column, folds: int) -> Column:
    return F.crc32(ident.cast("string").cast("binary")) % folds


def spread(text: Column) -> Column:
    """WINDOWS windows of WINDOW characters at even distances, the first at the beginning and the last at the end; a shorter text whole."""
    n = F.length(text)
    start = lambda k: (F.lit(1) + F.floor((n - WINDOW) * k / (WINDOWS - 1))).cast("int")
    return F.when(n <= WINDOWS * WINDOW, text).otherwise(F.concat_ws(" ", *[F.substring(text, start(k), F.lit(WINDOW)) for k in range(WINDOWS)]))


def learn_samples(docs: DataFrame, id_col: str, text_col: str, lang_col: str, learn: Column, max_docs: int = MAX_DOCS) -> dict[str, bytes]:
    """For each language the normalised windows of at most max_docs rows, chosen by a hash of their ids."""
    rows = docs.filter(learn & F.col(lang_col).isNotNull() & F.col(text_col).rlike("\\p{L}"))
    rows = rows.select(F.col(lang_col).alias("lang"), spread(F.col(text_col)).alias("text"), F.xxhash64(F.col(id_col).cast("string"), F.lit(3)).alias("h"))
    first = Window.partitionBy("lang").orderBy("h", "text")
    got = rows.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= max_docs).orderBy("lang", "k").select("lang", "text").toArrow()
    out: dict[str, bytes] = {}
    for lang, text in zip(got["lang"].to_pylist(), got["text"].to_pylist(), strict=True):
        data, offsets = as_bytes(pa.array([text]))
        out[lang] = out.get(lang, b"") + normalised(data, offsets)[0].tobytes() + b" "
    return out


def identify(docs: DataFrame, samples: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", evidence: int = EVIDENCE) -> DataFrame:
    """id, lang_pred and score of every row of docs."""
    frozen = tuple(sorted(samples.items()))
    kind = docs.schema[id_col].dataType.simpleString()

    def predict(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = parser(frozen)
        for batch in parts:
            for part, data, offsets in batches(batch, "_t"):
                lang, score = _predict(p, data, offsets, part.column(1), evidence)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score)], [id_col, "lang_pred", "score"])

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).mapInArrow(predict, f"`{id_col}` {kind}, lang_pred string, score double")


def language_of(samples: dict[str, bytes], evidence: int = EVIDENCE):
    """A column function of a text: a struct of lang_pred and score, as identify() gives them."""
    frozen = tuple(sorted(samples.items()))

    @F.arrow_udf("lang_pred string, score double")
    def udf(texts: pa.Array) -> pa.Array:
        data, offsets = as_bytes(texts)
        out = [_predict(parser(frozen), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], texts[i:j], evidence) for i, j in groups(offsets)]
        lang, score = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, object), np.zeros(0))
        trim()
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["lang_pred", "score"])

    return udf


def _predict(p: Parser, data: np.ndarray, offsets: np.ndarray, texts: pa.Array, evidence: int) -> tuple[np.ndarray, np.ndarray]:
    known = has_letter(data, offsets, texts)
    lang, score = np.full(len(known), UNKNOWN, object), np.zeros(len(known))
    if p.langs and known.any():
        rate = p.rates(*normalised(data, offsets))
        weight = np.exp2(-(rate - rate.min(1, keepdims=True)) * evidence)
        lang[known] = np.array(p.langs, object)[rate.argmin(1)[known]]
        score[known] = (1 / weight.sum(1))[known]
    return lang, score


def predict_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, held: int = 1) -> DataFrame:
    """id, held_out, lang_pred, score: learned from rows whose crc32 of the id leaves another remainder than `held`."""
    samples = learn_samples(docs, id_col, text_col, lang_col, fold(F.col(id_col), folds) != held)
    out = identify(docs, samples, id_col, text_col)
    return out.select(id_col, F.coalesce(fold(F.col(id_col), folds) == held, F.lit(False)).alias("held_out"), "lang_pred", "score")
