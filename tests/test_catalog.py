"""Every query of the catalog against its SQL on DuckDB."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest
from quillon.plans import catalog, catalog_more, catalog_surfaces  # noqa: F401

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NaT or v is pd.NA or v != v:
            return "null"
        return f"{v:.6f}" if isinstance(v, float) else str(int(v)) if "int" in type(v).__name__ else str(v)

    return sorted(tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


def test_names_agree():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
    assert catalog.FLAGSHIP in catalog.QUERIES


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, db, name):
    got, want = catalog.QUERIES[name](spark, DATA).toPandas(), db.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_queries_of_all_catalogs_call_the_library():
    """With all catalogs registered, whichever tests ran before."""
    import test_detectors_more

    test_detectors_more.test_each_catalog_query_calls_the_library()
