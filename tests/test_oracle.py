"""Every query with SQL against DuckDB on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from tideline.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def canonical(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind in "fiu":
            df[c] = df[c].astype(float).round(9) + 0.0
        elif df[c].dtype.kind == "M" or c == "day":
            df[c] = pd.to_datetime(df[c]).astype("datetime64[us]")
        else:
            df[c] = df[c].astype(str)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query(spark, name):
    db = duckdb.connect()
    for t in ("events", "lineitem"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    pd.testing.assert_frame_equal(canonical(QUERIES[name](spark, SF).toPandas()), canonical(db.execute(ORACLE_SQL[name]).df()), check_dtype=False)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    from __spark_entry__ import entry

    assert entry(spark).columns == ["day", "missing", "too_low", "normal", "too_high", "score"]
