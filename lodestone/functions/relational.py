"""Column and relation helpers with the null rules of bag-oriented dataflow languages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What separates tokens, and what a token loses.
TOKEN_BREAKS = '[ ",()*]'
TOKEN_MARKS = "[.:!?]"


def bag_count(first_field: Column | str) -> Column:
    """Number of tuples of a group whose first field is not null."""
    return F.count(first_field)


def bincond(condition: Column, yes: Column, no: Column) -> Column:
    """yes or no; null where the condition is null."""
    return F.when(condition, yes).when(~condition, no)


def safe_div(a: Column | str, b: Column | str) -> Column:
    """a / b; null where b is zero."""
    return F.try_divide(a, b)


def tokenize(text: Column | str) -> Column:
    """Non-empty tokens between spaces, quotes, commas, parentheses and stars."""
    return F.filter(F.split(text, TOKEN_BREAKS), lambda t: t != "")


def clean_token(token: Column) -> Column:
    """A token in lower case without its marks."""
    return F.regexp_replace(F.lower(token), TOKEN_MARKS, "")


def full_match(text: Column, pattern: str) -> Column:
    """True if the whole text matches; the dot matches line ends too."""
    return text.rlike(f"(?s)\\A(?:{pattern})\\z")


def substring0(text: Column | str, start: int, end: int) -> Column:
    """Characters from start (0-based) up to, not including, end."""
    return F.substring(text, start + 1, max(0, end - start))


def square(x: Column | str) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return x * x


def nth(df: DataFrame, n: int) -> Column:
    """The n-th column, from 0."""
    return df[df.columns[n]]


def column_range(df: DataFrame, first: str, last: str) -> list[str]:
    """Names of the columns from first to last, both included."""
    return df.columns[df.columns.index(first) : df.columns.index(last) + 1]


def split_by(df: DataFrame, **conditions: Column) -> dict[str, DataFrame]:
    """One relation for each condition; a row may be in several, and is in none where all are null or false."""
    return {name: df.filter(c) for name, c in conditions.items()}


def group_all(df: DataFrame, *aggs: Column) -> DataFrame:
    """One row of aggregates over all rows, and none over no rows."""
    return df.agg(F.count(F.lit(1)).alias("_rows"), *aggs).filter("_rows > 0").drop("_rows")


def counts_by(**sides: tuple[DataFrame, str]) -> DataFrame:
    """key and, for each side, how many rows hold the key in its column: a cogroup of counts in one shuffle."""
    names = list(sides)
    parts = [df.groupBy(F.col(c).alias("key")).agg(bag_count(c).alias("_n")).select("key", *[(F.col("_n") if m == name else F.lit(0)).cast("long").alias(m) for m in names]) for name, (df, c) in sides.items()]
    return reduce(DataFrame.union, parts).groupBy("key").agg(*[F.sum(m).alias(m) for m in names])


def zip_arrays(first: Column, *others: Column, names: tuple[str, ...] | None = None, order: str = "order") -> Column:
    """Structs of equal places, as long as the first array: shorter ones give null, longer ones are cut; null for one array alone."""
    if not others:
        return F.lit(None)
    names = names or tuple(f"f{i}" for i in range(1 + len(others)))
    return F.transform(first, lambda x, i: F.struct(x.alias(names[0]), *[F.get(o, i).alias(n) for n, o in zip(names[1:], others, strict=True)], i.alias(order)))


_JSON_KINDS = {"string", "int", "bigint", "float", "double", "smallint", "tinyint"}


def record_to_json(df: DataFrame, *columns: str) -> Column:
    """A JSON object of the columns: numbers, strings, structs and arrays of structs; nulls and other kinds are left out."""
    kept = [c for c in columns or df.columns if df.schema[c].dataType.simpleString() in _JSON_KINDS or df.schema[c].dataType.typeName() in ("struct", "array")]
    return F.to_json(F.struct(*[F.col(c) for c in kept]))


def ordered_values(pairs: Column, value: str) -> Column:
    """From an array of structs, sorted by their fields, the values of one field."""
    return F.transform(F.array_sort(pairs), lambda p: p[value])
