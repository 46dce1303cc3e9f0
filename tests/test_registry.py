"""Every registered query against its SQL on whole tables, and the registry itself."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, canonical

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
SLOW_FITS = {"boosted_fit", "gmm_density", "oof_predictions", "logistic_fit", "fold_pipeline"}


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    cur = con.execute(ORACLES[name])
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical([d[0] for d in cur.description], cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW_FITS))
def test_query_runs(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert len(df.columns) == len(set(df.columns))
    assert df.count() > 0


def test_gate_search_finds_gates(spark, sf_dir):
    """A floor that no gate reaches leaves the search without a result."""
    found = {(r["variant"], r["method"]) for r in QUERIES["gate_search"](spark, sf_dir).where("gate IS NOT NULL").collect()}
    assert {v for v, _ in found} >= {"first_joint"} and len(found) > 1


def test_entry(spark):
    df = entry.entry(spark)
    assert {r["method"] for r in df.collect()} == {"alpha", "beta", "gamma"}


def test_no_oracle_without_query():
    assert set(ORACLES) <= set(QUERIES)
