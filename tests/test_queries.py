"""Every registered query with an oracle against DuckDB, and the others for rows."""

import math

import duckdb
import pandas as pd
import pytest

from quillon import catalogue

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = catalogue.queries(), catalogue.oracle_sql()
#: Rows that small tables may lack.
MAY_BE_EMPTY = {"near_duplicates", "metadata_filter", "missing_vectors"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def plain(value):
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, list | tuple):
        return tuple(map(plain, value))
    if value is None or value is pd.NA or value is pd.NaT or (isinstance(value, float) and math.isnan(value)):
        return None
    if hasattr(value, "isoformat"):
        return str(pd.Timestamp(value))
    return round(value, 6) if isinstance(value, float) else value


def rows(frame):
    return sorted((tuple(map(plain, r)) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, FOLDER).toPandas()
    if name in ORACLES:
        want = duck.sql(ORACLES[name]).df()
        assert sorted(found.columns) == sorted(want.columns)
        assert rows(found) == rows(want)
    assert len(found) or name in MAY_BE_EMPTY


def test_lead_summaries_by_hand(spark):
    from quillon.operators import language

    turns = {}
    for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").collect():
        turns.setdefault(r.conv_id, []).append((r.turn, r.text))
    found = {r.conv_id: r.summary for r in QUERIES["lead_summaries"](spark, FOLDER).collect()}
    for conv, parts in turns.items():
        leads = [next((s for _, _, s in language.sentences(t)), None) for _, t in sorted(parts)[:6]]
        assert found[conv] == " ".join(x for x in leads if x is not None)
