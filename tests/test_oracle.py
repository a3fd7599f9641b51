"""Every registered query against its SQL, on the smallest tables."""

import duckdb
import pytest

from lodestone.plans import oracle, workloads

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES.split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def _rows(df):
    df = df.reindex(sorted(df.columns), axis=1).astype(object)
    return list(df.columns), sorted(map(repr, df.where(df.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_equals_sql(name, spark, duck):
    assert _rows(workloads.queries()[name](spark, DIR).toPandas()) == _rows(duck.sql(oracle.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(workloads.queries()) - set(oracle.oracle_sql())))
def test_query_without_sql_has_rows(name, spark):
    assert workloads.queries()[name](spark, DIR).count() > 0




def test_distances_are_rounded_as_in_sql(spark, tmp_path):
    # the decimal digits of the first four would be rounded the other way
    at = [0.1311441235, 0.2684178275, 0.5088356995, 0.11408125449999999, 0.0, 4e-10, 0.9999999995, 4503599.6273704965, 12345678.901, 1e200, float("inf"), float("nan"), None]
    spark.createDataFrame([(i, [x, 0.0]) for i, x in enumerate(at)], "vec_id long, embedding array<double>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = _rows(workloads.queries()["pairwise_dist"](spark, str(tmp_path)).toPandas())
    assert len(got[1]) == len(at) ** 2 and got == _rows(c.sql(oracle.oracle_sql()["pairwise_dist"]).df())
