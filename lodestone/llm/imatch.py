"""I-Match document fingerprints, in DataFrame functions only.

The lexicon holds the terms (lower-cased runs of letters and digits, as 64-bit
hashes) whose document frequency lies in a band of shares of the corpus: very
common terms say little, very rare ones change with every edit.  A document
keeps its distinct lexicon terms, sorted.  Each of several randomised subsets of
the lexicon (a term belongs to it by a seeded hash, at one of several rates)
hashes the kept terms that it holds; the hashes in order are the fingerprint.
A document without lexicon terms has, in place of each subset's hash, the least
of its terms' hashes under that subset's seed.  Two fingerprints are alike by the share of equal subset hashes among subsets
that hold a term of either document.

Size of the lexicon: a document holds d distinct terms on average and a lexicon
term is in a share of at least `low` of them, so there are d / low lexicon terms
at most, whatever the size of the corpus.  It is counted and is broadcast only
up to `broadcast_terms`; beyond, it is joined by a shuffle.  Of a document's
terms, only those of the lexicon are gathered again, and one row that carries
what it needs without them.

Defined results: a null text is the empty text.  A document without a term has a
fingerprint made from its whole text.  Equal texts have equal fingerprints and likeness 1.  Documents come in ascending id,
null ids first, equal ids by the hash of their texts; a repeated row (same id
and text) is one document in that order and is returned as often as it came.
An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.shared import table

#: Shares of all documents that hold a lexicon term.
LOW, HIGH = 1 / 2000, 1 / 10
#: One subset of the lexicon for each rate and seed: a term is in it with chance 1 / rate.
RATES, SEEDS = (8, 32, 128, 512), tuple(range(1, 9))
BROADCAST_TERMS = 2_000_000
KEY = ["nf", "ik", "h"]
#: Stands for no term: every text has it, and the lexicon too.
NO_TERM = 0


def terms(text: Column) -> Column:
    """Distinct term hashes of a text."""
    words = F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """nf, ik (null id, id), h (hash of the text) and text, which is never null."""
    kind = docs.schema[id_col].dataType
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).isNull().alias("nf"), F.coalesce(F.col(id_col), F.lit(0).cast(kind)).alias("ik"), F.xxhash64(text).alias("h"), text.alias("text"))


def successors(docs: DataFrame, per_part: int = 200_000) -> DataFrame:
    """One row a document: its key, n_rows, n_chars, and the next document's key (nnf, nik, nh); the first follows the last.

    Rows are sorted by ranges of the key; only the first row of each range goes
    through a window of one task.
    """
    ids = docs.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_rows"), F.first(F.length("text")).alias("n_chars"))
    ids = table(ids, "imatch-ids")
    order = [F.col("nf").desc(), F.col("ik"), F.col("h")]
    parts = max(1, -(-ids.count() // per_part))
    ranged = table(ids.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "imatch-order")
    heads = ranged.groupBy("part").agg(F.min(F.struct((~F.col("nf")).alias("kept"), "ik", "h")).alias("head"))
    all_heads = Window.orderBy("part")
    heads = heads.select("part", F.coalesce(F.lead("head").over(all_heads), F.first("head").over(all_heads)).alias("after"))
    inner = Window.partitionBy("part").orderBy(*order)
    nxt = ranged.withColumn("nxt", F.lead(F.struct((~F.col("nf")).alias("kept"), "ik", "h")).over(inner)).join(F.broadcast(heads), "part")
    nxt = nxt.withColumn("nxt", F.coalesce("nxt", "after"))
    return table(nxt.select(*KEY, "n_rows", "n_chars", (~F.col("nxt.kept")).alias("nnf"), F.col("nxt.ik").alias("nik"), F.col("nxt.h").alias("nh")), "imatch-next")


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """term: hashes of the terms whose document frequency lies in the band, counted over all rows of docs (text column `text`)."""
    n = docs.count()
    counts = docs.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").count()
    return counts.filter((F.col("count") >= max(2, low * n)) & (F.col("count") <= max(2, high * n))).select("term")


def _in_subset(rate: int, seed: int, term: Column) -> Column:
    """Whether a term is in the subset of this rate and seed. A seed's subsets are nested, as each rate divides the next."""
    return F.shiftright(F.xxhash64(term, F.lit(seed)), 40).bitwiseAND(F.lit(rate - 1)) == 0


def with_subset_hashes(rows: DataFrame, kept: str, to: str) -> DataFrame:
    """rows with column `to` in place of `kept` (terms): the hash of those in each subset, in order, null where the subset holds none.

    Each rate's terms are sought among those of the rate before, and are a column, so that no filter runs twice.
    """
    rest = [c for c in rows.columns if c != kept]
    rows = rows.withColumn(kept, F.sort_array(kept))
    name = lambda r, s: f"{kept}_{r}_{s}"
    before = dict.fromkeys(SEEDS, kept)
    for rate in RATES:
        rows = rows.select("*", *[F.filter(before[s], functools.partial(_in_subset, rate, s)).alias(name(rate, s)) for s in SEEDS])
        before = {s: name(rate, s) for s in SEEDS}
    hashes = [F.when(F.size(name(r, s)) > 0, F.xxhash64(F.col(name(r, s)), F.lit(r)).bitwiseAND(F.lit(0xFFFFFFFF))) for r in RATES for s in SEEDS]
    return rows.select(*rest, F.array(*hashes).alias(to))


def least_hashes(found: Column) -> Column:
    """The least hash of the terms under the seed of each subset, null where there are none."""

    def one(rate: int, seed: int) -> Column:
        return F.array_min(F.transform(found, lambda t: F.xxhash64(t, F.lit(seed), F.lit(rate)))).bitwiseAND(F.lit(0xFFFFFFFF))

    return F.array(*[one(r, s) for r in RATES for s in SEEDS])


def as_text(hashes: Column) -> Column:
    return F.concat_ws("", F.transform(hashes, lambda x: F.coalesce(F.lpad(F.lower(F.hex(x)), 8, "0"), F.lit("--------"))))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among subsets that hold a term of either."""
    same = F.zip_with(a, b, lambda x, y: F.when(x.isNull() & y.isNull(), F.lit(None)).otherwise(x.eqNullSafe(y)))
    held = F.filter(same, lambda x: x.isNotNull())
    return F.when(a == b, F.lit(1.0)).otherwise(F.coalesce(F.size(F.filter(held, lambda x: x)) / F.nullif(F.size(held), F.lit(0)), F.lit(0.0)))


def _bare(whole: Column) -> Column:
    """Subset hashes that stand for a whole text."""
    return F.array(*[F.xxhash64(whole, F.lit(k)).bitwiseAND(F.lit(0xFFFFFFFF)) for k in range(len(RATES) * len(SEEDS))])


def fingerprints(texts: DataFrame, names: list[str], band: DataFrame, digest: str | None = None, broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """KEY, for each text column of `names` the subset hashes <name>_sig, and the sha256 of column `digest` as <digest>_sha256.

    Terms of a document stay in its task: if texts is dealt by KEY, nothing is shuffled.
    """
    # Terms of no subset add nothing to a fingerprint.
    band = band.filter(functools.reduce(Column.__or__, [_in_subset(min(RATES), s, F.col("term")) for s in SEEDS]))
    band = table(band.union(band.sparkSession.range(1).select(F.lit(NO_TERM).cast("long"))), "imatch-lexicon")
    if band.count() <= broadcast_terms:
        band = F.broadcast(band)
    wanted = [*names, *([digest] if digest else [])]
    rows = texts.select(*KEY, F.explode(F.array(*[F.struct(F.lit(i).alias("which"), F.col(c).alias("t")) for i, c in enumerate(wanted)])).alias("w"))
    listed = F.col("w.which") < len(names)
    rows = rows.select(*KEY, "w.which", F.col("w.t").alias("t"), F.when(listed, terms(F.col("w.t"))).alias("terms"), listed.alias("listed"))
    rows = rows.select(*KEY, "which", "terms", F.when(F.col("listed"), F.xxhash64("t")).alias("whole"), F.when(~F.col("listed"), F.sha2(F.col("t").cast("binary"), 256)).alias("sha"))
    none = F.array(F.lit(NO_TERM).cast("long"))
    rows = rows.select("*", F.explode(F.concat(none, F.coalesce("terms", F.array().cast("array<bigint>")))).alias("term"))
    # One row of a text carries what it needs without the lexicon: all its terms, its hash, or the digest.
    lone = F.col("term") == NO_TERM
    rows = rows.select(*KEY, "which", "term", *[F.when(lone, F.col(c)).alias(c) for c in ("terms", "whole", "sha")]).join(band, "term")
    aggs = [F.max("sha").alias(f"{digest}_sha256")] if digest else []
    for i in range(len(names)):
        own = F.col("which") == i
        aggs += [F.collect_set(F.when(own & (F.col("term") != NO_TERM), F.col("term"))).alias(f"in{i}"), F.max(F.when(own, F.col("terms"))).alias(f"terms{i}"), F.max(F.when(own, F.col("whole"))).alias(f"whole{i}")]
    out = rows.groupBy(*KEY).agg(*aggs)
    for i, c in enumerate(names):
        out = with_subset_hashes(out, f"in{i}", f"{c}_sig")
        # Where the subsets hold none of a text's terms, they say nothing of it either; only then is each term hashed for each subset.
        alone = F.when(F.size(f"terms{i}") > 0, least_hashes(F.col(f"terms{i}"))).otherwise(_bare(F.col(f"whole{i}")))
        out = out.withColumn(f"{c}_sig", F.when(F.exists(f"{c}_sig", lambda x: x.isNotNull()), F.col(f"{c}_sig")).otherwise(alone))
    return out.select(*KEY, *[f"{c}_sig" for c in names], *([f"{digest}_sha256"] if digest else []))


def fingerprint_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of all texts and of their edited texts, and likenesses.

    The edited text has its last quarter (in code points, rounded down) replaced
    by as many first code points of the next document, or all it has.  Texts are
    shuffled once, by their key; the next document sends only its first part.
    """
    kind = docs.schema[id_col].dataType
    base = keyed(docs, id_col, text_col)
    nxt = successors(base)
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    wants = nxt.select(F.col("nnf").alias("nf"), F.col("nik").alias("ik"), F.col("nh").alias("h"), F.col("nf").alias("pnf"), F.col("ik").alias("pik"), F.col("h").alias("ph"), quarter.alias("want"))
    heads = base.join(wants, KEY).select(F.col("pnf").alias("nf"), F.col("pik").alias("ik"), F.col("ph").alias("h"), F.expr("left(text, want)").alias("head"), "want")
    edited = F.expr("concat(left(text, length(text) - want), head)")
    both = base.join(heads, KEY).select(*KEY, "text", edited.alias("edited"))
    sig = table(fingerprints(both, ["text", "edited"], lexicon(base), "edited"), "imatch-signatures")
    after = sig.select(F.col("nf").alias("nnf"), F.col("ik").alias("nik"), F.col("h").alias("nh"), F.col("text_sig").alias("next_sig"))
    out = sig.join(nxt, KEY).join(after, ["nnf", "nik", "nh"])
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_rows"))))
    return out.select(
        F.when(~F.col("nf"), F.col("ik")).cast(kind).alias(id_col), F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256",
        as_text(F.col("text_sig")).alias("fingerprint"), as_text(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("text_sig"), F.col("edited_sig")).alias("near_edited"), likeness(F.col("text_sig"), F.col("next_sig")).alias("near_next"),
    )
