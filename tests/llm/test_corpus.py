"""Operators over whole tables, against brute force: near copies, repeats, mixing, scores, fingerprints, the pipeline."""

import functools
import hashlib
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from odd_documents import ODD, PROSE, near_copy
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import imatch, maxent_lm, minhash_forest, mixing, spans, suffix_dedup
from lodestone.llm.components import components
from lodestone.llm.spans import as_bytes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF = "/root/testdata/sf0.001"


# Near copies


def shingles(text, size):
    w = WORD.findall((text or "").translate(LOW))
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def brute_components(rows, size, percent):
    """For each row (id, text): size of its set and least id of its component, by all pairs."""
    sets = [shingles(t, size) for _, t in rows]
    label = list(range(len(rows)))

    def find(a):
        while label[a] != a:
            a = label[a]
        return a

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                label[y] = x
    least = {}
    for i, (ident, _) in enumerate(rows):
        if ident is not None:
            least[find(i)] = min(ident, least.get(find(i), ident))
    return [(ident, len(s), least.get(find(i)) if s else ident) for i, ((ident, _), s) in enumerate(zip(rows, sets, strict=True))]


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_copies_of_odd_documents(odd, none, size, percent):
    got = minhash_forest.near_duplicates(odd, shingle=size, percent=percent)
    rows = got.collect()
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in rows) == Counter(brute_components([(i, t) for i, t, *_ in ODD], size, percent))
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows) and minhash_forest.near_duplicates(none).count() == 0


def test_near_copies_of_the_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = Counter(brute_components([(r.doc_id, r.text) for r in docs.collect()], 3, 85))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in minhash_forest.near_duplicates(docs, shingle=3, percent=85).collect()) == want


def test_large_group_of_near_copies_with_small_regions(spark):
    rows = [(i, near_copy(i % 60) + f" tail{i}") for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = Counter(brute_components(rows, 3, 85))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in minhash_forest.near_duplicates(df, shingle=3, percent=85, region_rows=20).collect()) == want


def test_least_depth_bounds_the_misses():
    for percent in (50, 80, 85, 95):
        d = minhash_forest.least_depth(percent)
        assert d == 1 or (1 - (percent / 100) ** d) ** minhash_forest.TREES <= minhash_forest.MISSED


def test_components_of_a_path_and_a_star(spark):
    order = np.random.default_rng(1).permutation(40).tolist()
    links = [(order[i], order[i + 1]) for i in range(39)] + [(100, 100 + k) for k in range(1, 9)] + [(7, 7)]
    got = {r.node: r["comp"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(40)}, **{100 + k: 100 for k in range(9)}}


# Repeats


def brute_repeats(rows):
    """For each row (id, text): bytes, removed, spans and what is kept; null ids come last."""
    last = float("inf")
    key = lambda i: last if i is None else i
    first = {}
    for ident, text in rows:
        b = (text or "").encode()
        for i in range(len(b) - 49):
            first[b[i : i + 50]] = min(key(ident), first.get(b[i : i + 50], last))
    out = []
    for ident, text in rows:
        b = (text or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < key(ident):
                gone[i : i + 50] = True
        kept = bytes(c for c, g in zip(b, gone, strict=False) if not g)
        out.append((ident, len(b), int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("options", [{}, {"group_bytes": 20000, "bucket_names": 3000}])
def test_repeats_of_odd_documents(odd, none, options):
    got = suffix_dedup.repeat_digests(odd, **options)
    assert Counter(map(tuple, got.collect())) == brute_repeats([(i, t) for i, t, *_ in ODD])
    assert suffix_dedup.repeat_digests(none).count() == 0
    cut = suffix_dedup.remove_repeats(odd, **options)
    assert cut.columns == odd.columns and cut.count() == len(ODD)
    texts = {r.doc_id: r.text for r in cut.collect() if r.doc_id in (1, 2, 6, 8)}
    assert texts[1] == PROSE and texts[2] == "" and texts[6] is None and texts[8] == " \n\t "


def test_repeats_of_the_tables_in_many_groups(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = suffix_dedup.repeat_digests(docs, group_bytes=30000, bucket_names=20000)
    assert Counter(map(tuple, got.collect())) == brute_repeats([(r.doc_id, r.text) for r in docs.collect()])


def test_cover_reaches_every_shift():
    v, d = suffix_dedup.CYCLE, suffix_dedup.COVER
    assert {(a - b) % v for a in d for b in d} == set(range(v))


# Mixing


def test_targets_by_hand():
    assert mixing.targets([100, 100, 100], [3, 1, 2], 450, 2) == pytest.approx([200, 250 / 3, 500 / 3])
    assert mixing.targets([10, 1000], [3, 1], 1515, 2) == pytest.approx([20, 1495])
    assert mixing.targets([], [], 0, 2) == [] and mixing.targets([0, 0], [1, 1], 0, 2) == [0, 0]


def test_word_count_column(spark, odd):
    got = {r.text: r.n for r in odd.select("text", mixing.word_count(F.col("text")).alias("n")).collect()}
    assert got == {t: len(WORD.findall(t or "")) for _, t, *_ in ODD}


@pytest.mark.parametrize("bucket_rows", [3, 100_000])
def test_mix_of_odd_documents(odd, none, bucket_rows):
    mix = mixing.mix_sources(odd, block_words=64, bucket_rows=bucket_rows)
    rows = mixing.taken_words(mix).collect()
    again = mixing.taken_words(mixing.mix_sources(odd, block_words=64, bucket_rows=bucket_rows)).collect()
    key = lambda rs: Counter((r.doc_id, r["size"], r.source, r.taken) for r in rs)
    assert key(rows) == key(again) and len(rows) == len(ODD) and all(0 <= r.taken <= 2 * r["size"] for r in rows)
    sizes = Counter()
    for _, t, _, s in ODD:
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    want = mixing.targets([sizes[s] for s in order], [3, 1, 2, 3, 1], 1.5 * sum(sizes.values()), 2)
    taken = Counter()
    for r in rows:
        taken[r.source] += r.taken
        assert r.target == pytest.approx(want[order.index(r.source)]) and r.source_size == sizes[r.source]
    assert all(abs(taken[s] - w) <= 1 for s, w in zip(order, want, strict=True))
    slots = mix.schedule.groupBy("src").agg(F.countDistinct("rank").alias("n"), F.max("rank").alias("m")).collect()
    assert all(r.n == r.m + 1 for r in slots)  # every block of a source once, in its own slot
    assert mixing.taken_words(mixing.mix_sources(none)).count() == 0


def test_schedule_spreads_sources_evenly(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), 100).alias("text"), F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("source"))
    got = mixing.mix_sources(docs, block_words=100).schedule.select("slot", "src").distinct().toPandas().sort_values("slot")
    half = got.head(len(got) // 2).src.value_counts(normalize=True)
    whole = got.src.value_counts(normalize=True)
    assert (half - whole).abs().max() < 0.02


# Scores


def test_scores_by_brute_force(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(odd.select("doc_id", "text"))
    rows = [(r.doc_id, WORD.findall((r.text or "").translate(LOW)) + [None]) for r in docs.collect()]
    rest = lambda i: None if i is None else zlib.crc32(str(i).encode()) % 7
    c = Counter(w for i, ws in rows for w in ws if rest(i) not in (None, 2))
    n, v = sum(c.values()), len(c)
    want = Counter((i, rest(i) == 2, len(ws), sum(c[w] > 0 for w in ws), n, round(float(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in ws)), 5)) for i, ws in rows)
    got = maxent_lm.score_texts(docs, chunk_bytes=60000).toPandas()
    assert Counter((None if np.isnan(r.doc_id) else int(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got.itertuples()) == want
    assert np.isfinite(got.score).all() and (got.score < 0).all()
    assert maxent_lm.score_texts(none).count() == 0
    assert np.isfinite(maxent_lm.score_texts(odd.filter("doc_id is null")).toPandas().score).all()


def test_scores_beat_the_base_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = maxent_lm.score_texts(docs.repartition(1)).toPandas().set_index("doc_id").sort_index()
    held = got[got.held_out]
    assert held.score.sum() > 0.95 * held.base_score.sum() and (held.score > held.base_score).mean() > 0.9
    # However the rows are dealt, each has the same score, to the bit.
    again = maxent_lm.score_texts(docs.repartition(16, "text"), chunk_bytes=300_000).toPandas().set_index("doc_id").sort_index()
    assert (got.score == again.score).all() and (got.base_score == again.base_score).all()


def test_every_round_goes_over_all_training_texts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i} of many") for i in range(100)], "doc_id long, text string")
    sums, seen = maxent_lm._sums, []
    monkeypatch.setattr(maxent_lm, "_sums", lambda chunks, model, step: seen.append((step, chunks.count())) or sums(chunks, model, step))
    n = docs.filter("crc32(cast(cast(doc_id as string) as binary)) % 7 <> 2").count()
    maxent_lm.score_texts(docs, rounds=3)
    assert [k for _, k in seen] == [n] * len(seen) and [x for x, _ in seen].count("expected") == 2


def test_tokens_of_long_texts_are_sought_without_a_table(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i} of many") for i in range(40)], "doc_id long, text string")
    want = sorted(maxent_lm.score_texts(docs).collect())
    monkeypatch.setattr(maxent_lm, "MOST_HASHED", 0)
    assert sorted(maxent_lm.score_texts(docs).collect()) == want


def test_context_tells_words_of_one_class_apart(spark):
    texts = ["the big cat sat", "a small rat ran"] * 200 + ["the big rat sat"] * 2
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.text: r.score for r in maxent_lm.score_texts(docs.filter("crc32(cast(cast(doc_id as string) as binary)) % 7 <> 2").union(spark.createDataFrame([(k, t) for k, t in ((2000, "the big cat sat"), (2001, "the big rat sat"))], docs.schema))).join(docs.withColumnRenamed("doc_id", "d"), F.col("doc_id") == F.col("d")).collect()}
    cat, rat = np.array([99, 97], np.int64), np.array([114, 97], np.int64)  # one class: it is that of the last two bytes
    assert (cat[1:] == rat[1:]).all() and got["the big cat sat"] > got["the big rat sat"] + 1


def _model(own=(3, 5)):
    draw = np.random.default_rng(0)
    n, v = draw.integers(1, 90, (2, maxent_lm.CLASSES, maxent_lm.LEAVES))
    model = maxent_lm.Model(np.array(own, np.uint64), np.array([0, 1]), n, v)
    model.class_w += draw.normal(size=model.class_w.shape).astype(np.float32) * 0.3
    model.leaf_w += draw.normal(size=model.leaf_w.shape).astype(np.float32) * 0.3
    return model


def test_model_is_a_distribution_over_leaves():
    model = _model()
    rows, total = [np.array([k + 1]) for k in range(maxent_lm.FAMILIES)], 0.0
    for c in range(maxent_lm.CLASSES):
        cls = np.array([c])
        x, y = model.softmaxes(rows, [cls * maxent_lm.LEAF_ROWS + k for k in range(maxent_lm.FAMILIES)], cls, slice(0, 1))
        total += float(x[0, c] * y[0].sum())
    assert total == pytest.approx(1, abs=1e-5)


def test_sums_by_brute_force_and_in_pieces(monkeypatch):
    texts = ["the cat sat on the mat and the rat ran " * 30, "", "one", "a " * 300, "x" * 900 + " yy zz"]
    data, offsets = as_bytes(pa.array(texts, pa.string()))
    whole = [t for *_, t in maxent_lm.tokens_of(data, offsets)]
    monkeypatch.setattr(maxent_lm, "pieces", lambda d, o: spans.pieces(d, o, 64))
    parts = [t for *_, t in maxent_lm.tokens_of(data, offsets)]
    assert len(whole) == 1 and len(parts) > 20
    for name in ("hashes", "classes", "one", "two", "class_one", "class_two"):
        assert (np.concatenate([getattr(t, name) for t in parts]) == getattr(whole[0], name)).all(), name
    model = _model()
    sums, seen = (np.zeros(maxent_lm.CELLS, np.int64) for _ in range(2))
    in_parts = np.zeros(maxent_lm.CELLS, np.int64)
    model.expected(whole[0], sums)
    model.seen(whole[0], seen)
    for t in parts:
        model.expected(t, in_parts)
    assert (sums == in_parts).all() and seen.sum() == 2 * maxent_lm.FAMILIES * len(whole[0].hashes)
    t = whole[0]
    rows, leaf_rows = maxent_lm.rows_of(t.features(), t.classes)
    x, y = model.softmaxes(rows, leaf_rows, t.classes, slice(None))
    want = np.zeros((maxent_lm.CLASS_ROWS, maxent_lm.CLASSES))
    np.add.at(want, rows[1], x)
    assert np.abs(maxent_lm.views(sums)[0][1] / 2**maxent_lm.FINE - want).max() < 0.05
    want = np.zeros((maxent_lm.CLASSES * maxent_lm.LEAF_ROWS, maxent_lm.LEAVES))
    np.add.at(want, leaf_rows[3], y)
    assert np.abs(maxent_lm.views(sums)[1][3] / 2**maxent_lm.FINE - want).max() < 0.05


def test_expectations_by_brute_force_where_rows_are_hot():
    # Rows take more tokens than a lane holds, and the largest probability each.
    draw, n = np.random.default_rng(1), maxent_lm.FULL + 5000
    target = np.zeros((maxent_lm.FAMILIES, 16, 64), np.int64)
    half, want = maxent_lm.Half(target), np.zeros_like(target)
    values = draw.integers(0, 9, (n, 64)).astype(np.float32)
    values[:, [0, 31, 32, 63]] = 1 << maxent_lm.FINE
    rows = [draw.integers(0, k + 1, n) for k in range(maxent_lm.FAMILIES)]
    for i in range(0, n, maxent_lm.BATCH):
        part = slice(i, i + maxent_lm.BATCH)
        half.add(values[part], [r[part] for r in rows])
    half.flush()
    for k, own in enumerate(rows):
        np.add.at(want[k], own, values.astype(np.int64))
    assert (target == want).all()


def test_few_tasks_send_sums_of_many_texts():
    # Each task sends an array of the weights' size, so that small tasks would send more than they read.
    assert maxent_lm.tasks(0, 8) == 1 and maxent_lm.tasks(100 << 20, 6) == 6 and maxent_lm.tasks(20 << 20, 6) == 2
    assert maxent_lm.tasks(1 << 30, 6) == 16 and maxent_lm.tasks(44 << 30, 8) == 704


def test_hashes_from_prefix_sums_are_those_of_spans():
    data, offsets = as_bytes(pa.array(["a bb  ccc " * 50, "", " x", "y" * 400 + " z"], pa.string()))
    words = spans.Words(data, offsets)
    for n, limit in ((3, 1 << 20), (1000, 1 << 20), (7, 100)):
        assert (spans.word_span_hashes(data, words.starts, words.ends, n, limit) == words.hashes()).all()
    assert not len(spans.word_span_hashes(data, words.starts[:0], words.ends[:0]))


# Fingerprints


def test_edits_and_fingerprints_of_odd_documents(odd, none):
    rows = imatch.fingerprint_with_edits(odd).collect()
    assert len(rows) == len(ODD)
    distinct = {(i, t or "") for i, t, *_ in ODD}
    # Documents with one id follow each other by a hash; those are left out here.
    alone = sorted(((i, t) for i, t in distinct if i is not None and i not in (9,)), key=lambda x: x[0])
    after = {alone[k][0]: alone[k + 1][1] for k in range(len(alone) - 1) if alone[k][0] not in (8,)}
    for r in rows:
        if r.doc_id in after:
            text = dict(alone)[r.doc_id]
            n = len(text) // 4
            assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256((text[: len(text) - n] + after[r.doc_id][:n]).encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    prints = {}
    texts = {i: t or "" for i, t in distinct if i not in (9, None)}
    for r in rows:
        if r.doc_id in texts:
            assert prints.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
    assert {r.near_next for r in rows if r.doc_id == 1} == {1.0} and imatch.fingerprint_with_edits(none).count() == 0


def test_edits_stay_nearer_than_neighbours(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = imatch.fingerprint_with_edits(docs).toPandas().sort_values("doc_id")
    texts = docs.toPandas().sort_values("doc_id").text.tolist()
    for k, r in enumerate(got.itertuples()):
        n = len(texts[k]) // 4
        assert r.edited_sha256 == hashlib.sha256((texts[k][: len(texts[k]) - n] + texts[(k + 1) % len(texts)][:n]).encode()).hexdigest()
    assert got.near_edited.mean() > 0.15 > 0.02 > got.near_next.mean()


def test_edits_rarely_leave_nothing_alike(spark):
    got = imatch.fingerprint_with_edits(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).toPandas()
    assert (got.near_edited == 0).mean() < 0.05 and got.near_next.mean() < 0.02


def brute_fingerprints(rows, low=imatch.LOW, high=imatch.HIGH):
    """The fingerprint of each text, from the document frequencies of all rows."""
    h = lambda data, seed=42: xxhash.xxh64(data, seed=seed).intdigest()
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    long = lambda x, seed=42: h(struct.pack("<q", signed(x)), seed)
    chain = lambda seed, *xs: functools.reduce(lambda s, x: h(struct.pack("<i", x), s), xs, seed)
    terms = {t: {signed(h(w.encode())) for w in re.split(r"[^\w]|_", t.lower()) if w} for _, t in rows}
    df = Counter(w for _, t in rows for w in terms[t])
    band = {w for w, c in df.items() if max(2, low * len(rows)) <= c <= max(2, high * len(rows))}
    out = {}
    for t, own in terms.items():
        parts = []
        for rate in imatch.RATES:
            for seed in imatch.SEEDS:
                kept = sorted(w for w in own & band if (signed(chain(long(w), seed)) >> 40) & (rate - 1) == 0)
                parts.append(chain(functools.reduce(lambda s, w: long(w, s), kept, 42), rate) & 0xFFFFFFFF if kept else None)
        if not any(p is not None for p in parts):
            subsets = [(r, s) for r in imatch.RATES for s in imatch.SEEDS]
            whole = h(t.encode())
            parts = [min(signed(chain(long(w), s, r)) for w in own) & 0xFFFFFFFF for r, s in subsets] if own else [chain(long(whole), k) & 0xFFFFFFFF for k in range(len(subsets))]
        out[t] = "".join("--------" if p is None else f"{p:08x}" for p in parts)
    return out


def test_fingerprints_by_brute_force(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(odd.filter("doc_id <> 9").select(F.col("doc_id") + 10_000, "text"))
    rows = [(r.doc_id, r.text or "") for r in docs.distinct().collect()]
    want = brute_fingerprints([(r.doc_id, r.text or "") for r in docs.collect()])
    texts = dict(rows)
    got = imatch.fingerprint_with_edits(docs).collect()
    assert len(got) == docs.count() and all(r.fingerprint == want[texts[r.doc_id]] for r in got)


def test_lexicon_is_the_band(spark):
    df = spark.createDataFrame([(f"all w{i} " + ("half " if i % 2 else ""),) for i in range(40)], "text string")
    got = {r.term for r in imatch.lexicon(df, 0.1, 0.6).collect()}
    assert got == {r[0] for r in spark.sql("SELECT xxhash64('half')").collect()}


def test_imatch_hashes_all_terms_only_where_the_lexicon_has_none(spark):
    # Below the aggregate each text would pay for it; above, only those whose subsets are empty.
    keyed = imatch.keyed(spark.createDataFrame([(1, "one two"), (2, "two three")], "doc_id long, text string"), "doc_id", "text")
    plan = imatch.fingerprints(keyed, ["text"], imatch.lexicon(keyed))._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Aggregate", 1)
    assert "array_min" in above and "array_min" not in below


def test_imatch_seeks_a_subset_once_and_in_the_one_before(spark):
    keyed = imatch.keyed(spark.createDataFrame([(1, "one two"), (2, "two three")], "doc_id long, text string"), "doc_id", "text")
    out = imatch.fingerprints(keyed, ["text"], imatch.lexicon(keyed))
    spark.conf.set("spark.sql.debug.maxToStringFields", 1000)
    try:
        sought = re.findall(r"filter\((\w+)", out._jdf.queryExecution().optimizedPlan().toString().split("Aggregate", 1)[0])
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert len(sought) == len(imatch.RATES) * len(imatch.SEEDS) and sought.count("in0") == len(imatch.SEEDS)


def test_no_python_in_the_fingerprint_plan(spark):
    plan = imatch.fingerprint_with_edits(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# Pipeline


def test_pipeline_on_odd_documents(spark, odd, plain, none):
    docs = odd
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        kept[name] = docs.toPandas()
        if name != "encode_pieces":
            assert docs.columns == odd.columns, name
    assert [i for i in (6, 7, 8, 10) if i in set(kept["language_id"].doc_id)] == [] and {1, 5, 13, 14} <= set(kept["language_id"].doc_id)
    near = kept["near_dedup"]
    want = brute_components([(k, t) for k, t in enumerate(kept["language_id"].text)], 5, 80)
    assert len(near) == len({c for _, _, c in want}) and (near.doc_id == 1).sum() == 1 and not (near.doc_id == 2).any()
    assert len(kept["suffix_dedup"]) == len(near) and (kept["suffix_dedup"].n_chars == kept["suffix_dedup"].text.str.len()).all()
    assert set(kept["mix_sources"].doc_id.dropna()) <= set(near.doc_id.dropna()) and kept["encode_pieces"].lossless.all() and len(kept["encode_pieces"]) == len(kept["mix_sources"])
    docs = none.select(*plain.columns)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_pipeline_runs_over_the_tables(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "lang", "source", "piece_ids", "n_pieces", "lossless"] and out.filter("not lossless").count() == 0 and out.count() > 200
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5
