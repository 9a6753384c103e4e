"""Every registered query with an oracle against DuckDB, at the smallest scale."""

import duckdb
import pandas as pd
import pytest

from relscope.plans import catalog
from relscope.plans.fixtures import GIVEN

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in GIVEN:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows_of(frame):
    frame = frame[sorted(frame.columns)]

    def shown(v):
        if pd.isna(v):
            return "-"
        return f"{float(v):.6f}" if isinstance(v, float) or hasattr(v, "dtype") and v.dtype.kind == "f" else str(v)

    return sorted(tuple(map(shown, r)) for r in frame.astype(object).to_numpy().tolist())


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_matches_sql(spark, con, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), con.execute(catalog.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    ints = [c for c in got.columns if got[c].dtype.kind in "if" or want[c].dtype.kind in "if"]
    for c in ints:
        got[c], want[c] = got[c].astype(float), want[c].astype(float)
    assert rows_of(got) == rows_of(want)
    spark.catalog.clearCache()
