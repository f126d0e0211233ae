"""The queries that have SQL twins against them, on the test tables and on planted rows."""

import duckdb
import pytest

from tallyloom.llm import queries


def compared(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet{'/*.parquet' if folder.startswith('/tmp') else ''}')")
    df = queries.queries()[name](spark, folder)
    twin = con.sql(queries.oracle_sql()[name])
    assert sorted(df.columns) == sorted(twin.columns)
    at = [twin.columns.index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect())) == sorted(tuple(r[i] for i in at) for r in twin.fetchall())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_tables(spark, sf, name):
    compared(spark, sf, name)


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("planted"))
    a = " ".join(f"word{i % 37}x{i % 11}" for i in range(120))
    texts = [a, a.upper(), a + " more", "é" * 60 + a[:70], "日本 " * 40, "日本 " * 40 + "!", None, "", " ", "one two", "One  TWO", "x" * 49, "x" * 50, "x" * 51, a[:49], a[1:60] + "Ä" + a[60:130]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    nan, inf = float("nan"), float("inf")
    vectors = [([1.0, 0.0, 0.0], 1), ([0.99, 0.1, 0.0], 1), ([0.97, 0.3, 0.0], 1), ([2.0, 0.0, 0.0], 1), ([1.0, 0.0, 0.0], 2), ([1.0, 0.0, 0.0], None), (None, 1), ([0.0, 0.0, 0.0], 1), ([nan, 0.0, 0.0], 1), ([inf, 0.0, 0.0], 1), ([1.0, None, 0.0], 1), ([], 1), ([1.0, 0.0], 1), ([-1.0, 0.0, 0.0], 1)]
    spark.createDataFrame([(i, v, n) for i, (v, n) in enumerate(vectors)], "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return folder


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_planted_rows(spark, planted, name):
    compared(spark, planted, name)
