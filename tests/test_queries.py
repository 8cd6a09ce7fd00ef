"""Every registered query runs; those with SQL equal DuckDB's result."""

import duckdb
import pandas as pd
import pytest

from sonarmill.plans.catalog import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(frame: pd.DataFrame) -> pd.DataFrame:
    def value(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "null"
        if isinstance(v, float):
            return f"{v:.6f}" if v else "0.000000"
        return str(int(v)) if isinstance(v, bool) else str(v)

    out = frame[sorted(frame.columns)].map(value)
    return out.sort_values(list(out.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, name):
    got = QUERIES[name](spark, small).toPandas()
    if name not in ORACLE_SQL:
        assert len(got)
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = plain(got.astype(object)), plain(want.astype(object))
    for c in a.columns:  # ints that pandas made floats because of nulls
        if a[c].str.endswith(".000000").any() != b[c].str.endswith(".000000").any():
            a[c], b[c] = (x[c].str.removesuffix(".000000").str.removesuffix(".0") for x in (a, b))
    a, b = (x.sort_values(list(x.columns)).reset_index(drop=True) for x in (a, b))
    pd.testing.assert_frame_equal(a, b)


def test_entry_point(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
