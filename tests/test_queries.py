"""Every query on the smallest tables, against its SQL where it has one."""

import datetime as dt
import importlib
import math

import __spark_entry__ as entry
import duckdb
import pytest
from queries import ORACLE, QUERIES

SF = entry.SMALLEST
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def plain(v):
    if isinstance(v, dt.datetime) and v.time() == dt.time():
        return v.date()
    if isinstance(v, float) and (math.isnan(v) or v == 0):
        return None if math.isnan(v) else 0.0
    return v


def ordered(rows):
    return sorted((tuple(plain(v) for v in r) for r in rows), key=lambda r: [(v is None, str(type(v)), v if v is not None else 0) for v in r])


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    names = sorted(df.columns)
    assert len({n.lower() for n in names}) == len(names)
    got = ordered([r[c] for c in names] for r in df.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    cursor = duck.execute(sql)
    found = [c[0] for c in cursor.description]
    assert sorted(found) == names
    at = [found.index(c) for c in names]
    assert got == ordered([r[i] for i in at] for r in cursor.fetchall())


#: Queries that SQL cannot express, and the tests that check their numbers.
NUMERIC = {
    "feat_spectral": ("test_windows", "test_transforms", "test_cwt_is_a_centred_convolution", "test_pacf_and_ar", "test_complexities"),
    "pca_explained": ("test_selection", "test_pca_matches_svd"), "pca_scores": ("test_selection", "test_pca_matches_svd"),
    "run_window_features": ("test_runs", "test_window_feature_training"),
    "run_window_features_by_entity": ("test_runs", "test_window_feature_training"),
    "window_features_report": ("test_runs", "test_window_feature_training"),
}


def test_every_query_is_checked_by_sql_or_a_named_test():
    assert set(QUERIES) - set(ORACLE) == set(NUMERIC)
    for module, *names in NUMERIC.values():
        assert all(callable(getattr(importlib.import_module(module), name)) for name in names)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
