"""Every query with an oracle gives the oracle's rows on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from splitmark.plans.registry import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return connection


def plain(value):
    if isinstance(value, np.ndarray):
        return [plain(v) for v in value]
    if value is None or value is pd.NA or (isinstance(value, float | np.floating) and np.isnan(value)):
        return None
    if isinstance(value, bool | np.bool_):
        return bool(value)
    if isinstance(value, int | np.integer):
        return float(value)
    return round(float(value), 6) if isinstance(value, float | np.floating) else value


def rows(frame, columns):
    return sorted(repr([plain(v) for v in row]) for row in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_gives_the_oracles_rows(spark, duck, sf_dir, name):
    got, wanted = QUERIES[name](spark, sf_dir).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert rows(got, sorted(got.columns)) == rows(wanted, sorted(got.columns))


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE_SQL)
