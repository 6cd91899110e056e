"""Every query with a DuckDB statement gives its rows."""
import pandas as pd
import pytest

from navlens.llm import queries


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple("null" if pd.isna(v) else str(v) for v in r) for r in df[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, sf, duck, name):
    assert rows(queries.QUERIES[name](spark, sf).toPandas()) == rows(duck.execute(queries.ORACLE_SQL[name]).fetchdf())
