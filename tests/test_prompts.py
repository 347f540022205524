"""Memory lines and bodies against their SQL where ages are small or lie ahead and fields are missing."""

import duckdb
import pytest

from tests.test_queries import rows_of
from tidemark.plans import catalogue

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Ids over 11,111 lie ahead of the queries' now; 11,111 is minutes old."""
    path = tmp_path_factory.mktemp("odd")
    rows = [(i, f"words of {i}", "en", f"src{i % 3}", 50 * (i % 90)) for i in (1, 7, 700, 11_088, 11_090, 11_108, 11_110, 11_111, 11_112, 11_116, 11_134, 14_000, 20_001)]
    rows += [(30_001, None, "en", "src1", 10), (30_002, "no language", None, "src1", 20), (30_003, "no group", "de", None, 30), (30_009, "no group", "de", None, 30)]
    rows += [(30_012, "nothing to show", None, "bare", 40)]
    rows += [(i, "entries of 15 units, of which 52 fit", "en", "filling", 50) for i in range(1000, 1080) if i % 7]
    spark.createDataFrame(rows, DOCS).coalesce(1).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def equals_sql(name, spark, path):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet/*.parquet'")
    df = catalogue.queries()[name](spark, path)
    rel = con.sql(catalogue.oracle_sql()[name])
    assert rows_of(df.columns, df.collect()) == rows_of(rel.columns, rel.fetchall())


def test_lines_of_any_age_equal_their_sql(spark, odd):
    equals_sql("format_memory_lines", spark, odd)


def test_bodies_of_any_age_equal_their_sql(spark, odd):
    equals_sql("format_prompt", spark, odd)
