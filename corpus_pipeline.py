"""A corpus pipeline over the documents table: identify languages, drop near copies, cut repeated passages, mix sources, encode.

Each stage is (spark, docs, sf_dir) -> DataFrame over all rows that the stage
before kept; its result is written as Parquet and read again.  All but the last
return the columns of documents.  Rows are told apart by their place in the
table that is read, so null and repeated ids are rows like any other.  Every
stage takes a table without rows, and returns one; columns beside those of
documents are kept as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.langid import UNKNOWN, fold, language_of, learn_samples
from lodestone.llm.minhash_forest import near_duplicates
from lodestone.llm.mixing import mix_sources, taken_words
from lodestone.llm.piece_sampling import encode_sampled
from lodestone.llm.shared import scratch, small_batches, table
from lodestone.llm.suffix_dedup import remove_repeats

#: A document whose best language is less sure than this is rejected.
LEAST_SCORE = 0.3
PIECE_MODEL = "piece_bpe_32k.model"
#: Bytes of text that cut_repeats holds in one task: the workers still hold what other stages left.
GROUP_BYTES = 1 << 20


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter, or of which no language is likely.

    Languages are learned from rows with a language of two thirds of the ids.
    With no such rows, only documents without a letter go.  Kept rows stay as
    they are: the language in the table is not replaced.
    """
    small_batches(spark)
    samples = learn_samples(docs, "doc_id", "text", "lang", fold(F.col("doc_id"), 3) != 1)
    if not samples:
        return docs.filter(F.col("text").rlike("\\p{L}"))
    found = language_of(samples)(F.col("text"))
    return docs.filter((found["lang_pred"] != UNKNOWN) & (found["score"] >= LEAST_SCORE))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group of near copies (five-word shingles, similarity 0.8 or more).

    A null id comes after all others; of rows that repeat an id, the first read
    is kept.  Null texts and texts without a word are copies of nothing, and stay.
    """
    small_batches(spark)
    rows = docs.withColumn("__lodestone_uid", F.monotonically_increasing_id())
    with scratch(spark) as keep:
        found = near_duplicates(rows, id_col="__lodestone_uid", text_col="text")
        ids = rows.select("__lodestone_uid", F.col("doc_id").isNull().alias("__lodestone_none"), F.col("doc_id").alias("__lodestone_id"))
        best = F.min(F.struct("__lodestone_none", "__lodestone_id", "__lodestone_uid"))["__lodestone_uid"]
        first = table(found.join(ids, "__lodestone_uid").groupBy("component_id").agg(best.alias("__lodestone_uid")).select("__lodestone_uid"), "pipeline-first")
        keep(first)
    # Kept rows are no bounded number: sorted and merged at every size, instead of broadcast as long as they are few.
    return rows.join(first.hint("merge"), "__lodestone_uid", "left_semi").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the strings of 50 bytes and more that an earlier document holds; n_chars follows the text.

    All rows stay: a null text as it is, a text that goes as a whole as an empty one.
    Null ids come last; rows that repeat an id are not earlier than each other.
    """
    small_batches(spark)
    out = remove_repeats(docs, id_col="doc_id", text_col="text", group_bytes=GROUP_BYTES)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, to the nearest whole number; not at all where that is none.

    Rounding moves a source's words by less than half of the one or two documents
    at its quota's end.  Texts that are null or hold no word are not taken; a
    null source is a source of its own.
    """
    rows = docs.withColumn("__lodestone_uid", F.monotonically_increasing_id())
    with scratch(spark) as keep:
        taken = taken_words(mix_sources(rows, uid_col="__lodestone_uid"))
        times = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int").alias("__lodestone_times")
        taken = table(taken.filter("size > 0").select(F.col("uid").alias("__lodestone_uid"), times).filter("__lodestone_times > 0"), "pipeline-times")
        keep(taken)
    out = rows.join(taken, "__lodestone_uid")
    return out.withColumn("__lodestone_copy", F.explode(F.sequence(F.lit(1), F.col("__lodestone_times")))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, piece_ids, n_pieces, lossless of every row; a null text is empty, repeated rows get the same pieces."""
    import public_tokenizers

    small_batches(spark)
    return encode_sampled(docs, public_tokenizers.path(PIECE_MODEL), keep=("lang", "source"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_languages),
    ("near_dedup", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("mix_sources", mix),
    ("encode_pieces", encode),
]

#: SQL can express neither the languages, the sampled pieces nor the candidates' search.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
