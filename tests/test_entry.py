import math
import re

import __spark_entry__ as entry
import duckdb
import pandas as pd
import pytest

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Queries without SQL: what stands in their docstrings says how they are tested.
NAMES = [n for n in entry.queries() if not re.match(r"op\d+_|pipeline$", n)]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def rows(frame):
    """The rows of a frame in an order of their own, numbers to six digits."""
    plain = lambda x: None if x is None or x is pd.NA or (isinstance(x, float) and math.isnan(x)) else f"{float(x):.6g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return sorted((tuple(plain(x) for x in row) for row in frame[sorted(frame.columns)].itertuples(index=False)), key=str)


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_gives_what_its_sql_gives(spark, duck, name):
    got = entry.queries()[name](spark, SMALL).toPandas()
    if name in entry.oracle_sql():
        want = duck.sql(entry.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got.columns)
