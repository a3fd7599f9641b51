"""Tab-separated tables, text lines and their writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The columns of a gazetteer dump.
GAZETTEER = (
    "geonameid int, name string, asciiname string, alternatenames string, latitude double, longitude double, feature_class string, feature_code string, country_code string, cc2 string, "
    "admin1_code string, admin2_code string, admin3_code string, admin4_code string, population bigint, elevation int, gtopo30 int, timezone string, modification_date string"
)


def read_tsv(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Rows of files, folders or globs; short lines end in nulls, long ones are cut, values of another type are null, quotes are text."""
    return spark.read.csv(path, sep="\t", schema=schema, quote="", escape="", mode="PERMISSIVE")


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One column `value`."""
    return spark.read.text(path)


def write_tsv(df: DataFrame, path: str) -> None:
    """Part files without a header, in place of what is at path."""
    df.write.mode("overwrite").csv(path, sep="\t", quote="", escape="", emptyValue="", nullValue="")


def write_state(df: DataFrame, path: str) -> DataFrame:
    """Nested state between iterations, as Parquet; returns it as read again."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def bag_text(bag: Column, fields: list[str]) -> Column:
    """An array of structs as ``{(a,b),(c,d)}``; a null field is empty."""
    record = lambda x: F.concat(F.lit("("), F.concat_ws(",", *[F.coalesce(x[f].cast("string"), F.lit("")) for f in fields]), F.lit(")"))
    return F.concat(F.lit("{"), F.concat_ws(",", F.transform(bag, record)), F.lit("}"))


def parse_bag(text: Column, kind: T.ArrayType) -> Column:
    """The array of structs of a bag's text, by the types of `kind`; text that is no bag is null, an empty field too.

    Values hold no comma or bracket, as in the text form itself.
    """
    inner = F.regexp_extract_all(text, F.lit(r"\(([^()]*)\)"), F.lit(1))

    def record(x: Column) -> Column:
        parts = F.split(x, ",", -1)
        return F.struct(*[F.try_element_at(parts, F.lit(k + 1)).try_cast(f.dataType).alias(f.name) if not isinstance(f.dataType, T.StringType) else F.nullif(F.try_element_at(parts, F.lit(k + 1)), F.lit("")).alias(f.name) for k, f in enumerate(kind.elementType.fields)])

    return F.when(text.rlike(r"^\{.*\}$"), F.transform(inner, record))


def write_nested(df: DataFrame, path: str) -> None:
    """A TSV whose arrays of structs are bags in text."""
    write_tsv(df.select(*[bag_text(F.col(f.name), f.dataType.elementType.names).alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name) for f in df.schema]), path)


def read_nested(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """Rows of a TSV with bags in text, by a schema that has arrays of structs for them."""
    flat = T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.ArrayType) else f.dataType) for f in schema])
    rows = spark.read.csv(path, sep="\t", schema=flat, quote="", escape="", mode="PERMISSIVE")
    return rows.select(*[parse_bag(F.col(f.name), f.dataType).alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name) for f in schema])


def store_both(parts: dict[str, DataFrame], base: str) -> None:
    """Each relation of a split to its own folder below base."""
    for name, df in parts.items():
        write_tsv(df, f"{base}/{name}")


def has_rows(df: DataFrame) -> bool:
    return not df.isEmpty()
