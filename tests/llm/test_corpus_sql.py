"""Registered queries of the corpus operators against their SQL, at the smallest scale."""

from pathlib import Path

import duckdb
import pytest

from passages.llm.oracle import ORACLE_SQL
from passages.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in Path(SF).glob("*.parquet"):
        connection.execute(f"create view {file.stem} as select * from '{file}'")
    return connection


def _rows(frame):
    columns = sorted(frame.columns)
    plain = frame[columns].astype(object).where(frame[columns].notna(), None)
    return columns, sorted(map(repr, plain.itertuples(index=False, name=None)))


def test_one_query_for_each_number():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):
    assert _rows(QUERIES[name](spark, SF).toPandas()) == _rows(duck.execute(ORACLE_SQL[name]).df())
