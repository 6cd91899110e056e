import duckdb
import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, first=0):
        rows = [(first + i if not isinstance(t, tuple) else t[0], t if not isinstance(t, tuple) else t[1], "en", "s", 0)
                for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOCS)
    return make
