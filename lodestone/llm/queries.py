"""The queries op1 to op10 over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.shared import small_batches


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_extract_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.html_extract import extract_main_text

    return extract_main_text(_read(spark, sf_dir, "pages"))


def op2_sample_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lodestone.llm.piece_sampling import encode_sampled

    return encode_sampled(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.quality import score_quality

    return score_quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.suffix_dedup import repeat_digests

    return repeat_digests(_read(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.langid import predict_languages

    return predict_languages(_read(spark, sf_dir, "documents"))


def op6_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.minhash_forest import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"), shingle=3, percent=85)


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.mixing import mix_sources, taken_words

    mix = mix_sources(_read(spark, sf_dir, "documents"))
    return taken_words(mix).select("doc_id", "size", "source_size", "target", "taken")


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.maxent_lm import score_texts

    return score_texts(_read(spark, sf_dir, "documents"))


def op9_token_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lodestone.llm.sstable import digests, write_token_tables

    return digests(write_token_tables(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op10_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.imatch import fingerprint_with_edits

    return fingerprint_with_edits(_read(spark, sf_dir, "documents"))


def base_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import quality

    return quality.base_rules(_read(spark, sf_dir, "documents"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)} | {"base_rules": base_rules}


_LEADS = " + ".join(f"lead(v, {k}, 0) OVER o * {256 ** (7 - k)}::UBIGINT" for k in range(1, 8))
_WORDS = (8, 16, 24, 32, 40, 42)
_KEYS = ", ".join(f"w{k}" for k in (0, *_WORDS))

#: Removed bytes by 50-byte strings, each as seven numbers of eight bytes (the last two overlap): one row a byte, and no hashes.
_REPEATS = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS l FROM documents),
p AS (SELECT doc_id, len(l) AS n, unnest(l) AS b, unnest(range(len(l))) AS i FROM d),
v AS (SELECT *, (16 * (instr('0123456789ABCDEF', b[1]) - 1) + instr('0123456789ABCDEF', b[2]) - 1)::UBIGINT AS v FROM p),
w AS (SELECT doc_id, n, i, b, v * {256 ** 7}::UBIGINT + {_LEADS} AS w0 FROM v WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT *, {", ".join(f"lead(w0, {k}) OVER (PARTITION BY doc_id ORDER BY i) AS w{k}" for k in _WORDS)} FROM w),
f AS (SELECT {_KEYS}, min(doc_id) AS first FROM s WHERE i + 50 <= n GROUP BY ALL HAVING count(*) > 1),
m AS (SELECT s.doc_id, s.i, s.b, s.i + 50 <= s.n AND coalesce(f.first < s.doc_id, false) AS mark FROM s LEFT JOIN f USING ({_KEYS})),
c AS (SELECT doc_id, i, b, max(mark::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) = 1 AS gone FROM m),
g AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS start FROM c),
r AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE start) AS n_spans, string_agg(b, '' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM g GROUP BY doc_id)
SELECT d.doc_id, len(d.l)::BIGINT AS n_bytes, coalesce(r.n_removed, 0)::BIGINT AS n_removed, coalesce(r.n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(r.kept, ''))) AS kept_sha256
FROM d LEFT JOIN r ON r.doc_id = d.doc_id"""

#: The base rules of op3 without its classifier.
_RULES = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM d),
g AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM w WHERE len(w) >= 5),
x AS (SELECT DISTINCT doc_id, unnest(range(i, i + 5)) AS k FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
r AS (SELECT doc_id, count(*) AS n FROM x GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
len(w) < 10 OR 100 * coalesce(r.n, 0) > 20 * len(w) AS base_failed FROM w LEFT JOIN r ON r.doc_id = w.doc_id LEFT JOIN l ON l.doc_id = w.doc_id"""

#: All pairs that share a shingle, and the least document that links reach.
_NEAR = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT k.a, k.b FROM k JOIN n x ON x.doc_id = k.a JOIN n y ON y.doc_id = k.b WHERE 100 * k.k >= 85 * (x.n + y.n - k.k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, least) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.least FROM r JOIN e ON e.a = r.node),
c AS (SELECT node, min(least) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM documents d JOIN c ON c.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""

#: Targets by raising the water, and a document's overlap with the part of its source's repeated stream that is taken.
_MIX = """
WITH d AS (SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS size, ('0x' || substr(md5(doc_id || ':17'), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY source_size / w::DOUBLE, source NULLS LAST) AS r FROM s),
l AS (SELECT *, 1.5e0 * sum(source_size) OVER () - 2 * coalesce(sum(source_size) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest, sum(w) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM o),
b AS (SELECT min_by(rest, r) AS rest, min_by(ws, r) AS ws, min(r) AS r FROM l WHERE w * rest / ws <= 2 * source_size),
t AS (SELECT l.source, l.source_size, CASE WHEN l.r < b.r THEN 2e0 * l.source_size ELSE l.w * b.rest / b.ws END AS target FROM l, b),
q AS (SELECT *, least(floor(target + 0.5)::BIGINT, 2 * source_size) AS quota FROM t),
p AS (SELECT d.*, q.source_size, q.target, q.quota, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM d JOIN q ON q.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, source_size, target, greatest(0, least(size, quota - off)) + greatest(0, least(size, quota - source_size - off)) AS taken FROM p"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL where it can express an operator; the others are tested against brute force, round trips or held-out rows."""
    return {"base_rules": _RULES, "op4_suffix_dedup": _REPEATS, "op6_minhash_forest": _NEAR, "op7_mix_sources": _MIX}
