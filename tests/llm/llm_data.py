"""Folders of the test tables, and a DuckDB connection over one of them."""
import duckdb
import pytest

from stargraph.sources.tables import TABLES

SMALL, MID = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def sf_small():
    return SMALL


@pytest.fixture(scope="session")
def sf_mid():
    return MID


@pytest.fixture(scope="session")
def duck_mid():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{MID}/{t}.parquet')")
    return con
