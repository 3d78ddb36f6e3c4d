"""Queries whose results SQL can express, against DuckDB on the small tables."""

import duckdb
import pytest

from dawnchorus.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.helpers import SF
from tests.test_oracle import _canon

TABLES = ("documents", "pages", "labels")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = con.sql(f"SELECT * FROM ({ORACLE_SQL[name]}) AS q").df()
    assert len(got) and _canon(got) == _canon(want)


def test_names():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]


def test_line_frequency_where_lines_are_frequent(spark):
    """At this size lines exceed the limits, and documents are rejected for them."""
    large = "/root/testdata/sf0.1"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{large}/documents.parquet'")
    frame = QUERIES["op3_line_frequency"](spark, large)
    want = con.sql(f"SELECT {', '.join(frame.columns)} FROM ({ORACLE_SQL['op3_line_frequency']})").fetchall()
    got = [tuple(r) for r in frame.collect()]
    assert sorted(got) == sorted(want)
    assert sum(r.removed_chars > 0 for r in frame.collect()) > 0
