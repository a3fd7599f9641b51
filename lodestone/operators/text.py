"""Line search, token counts, histograms, normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.relational import bag_count, clean_token, full_match, safe_div, tokenize


def grep(lines: DataFrame, pattern: str, column: str = "value") -> DataFrame:
    """Rows whose upper-cased text matches the pattern as a whole."""
    return lines.filter(full_match(F.upper(column), pattern))


def word_count(lines: DataFrame, column: str = "value") -> DataFrame:
    """token and num: cleaned tokens and how often they occur; a token of marks alone is the empty token."""
    tokens = lines.select(F.explode(tokenize(column)).alias("token")).select(clean_token(F.col("token")).alias("token"))
    return tokens.groupBy("token").agg(bag_count("token").alias("num"))


def histogram(rows: DataFrame, column: str, count_as: str = "num_visits") -> DataFrame:
    """How often each value occurs; the null value counts no row."""
    return rows.groupBy(column).agg(bag_count(column).alias(count_as))


def normalize_by_max(rows: DataFrame, column: str, as_: str = "normalized", dtype: str = "float") -> DataFrame:
    """Each row with its value as a share of the largest; a one-row join, so that no window gathers all rows."""
    top = rows.agg(F.max(column).alias("_max"))
    return rows.crossJoin(F.broadcast(top)).withColumn(as_, safe_div(F.col(column).cast(dtype), F.col("_max").cast(dtype)).cast(dtype)).drop("_max")
