"""One session for all tests, and DuckDB over the same tables."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tarnwell.session import local_session  # noqa: E402

DATA = os.environ.get("TARNWELL_TESTDATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    return local_session("4", 4, "4g")


@pytest.fixture(scope="session")
def data() -> str:
    return DATA


@pytest.fixture(scope="session")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for file in os.listdir(DATA):
        connection.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{DATA}/{file}'")
    return connection
