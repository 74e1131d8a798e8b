"""Every registered kernel query on the smallest tables; those with SQL against DuckDB."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gramlake.functions import kernels
from gramlake.operators import gram, log_training
from gramlake.plans import queries
from gramlake.plans.spec import KernelSpec

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
NAMES = sorted(queries.QUERIES)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"create view {t.removesuffix('.parquet')} as select * from '{SF}/{t}'")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", [n for n in NAMES if n in queries.ORACLES])
def test_against_sql(spark, db, name):
    df = queries.QUERIES[name](spark, SF)
    rel = db.sql(queries.ORACLES[name])
    cols = list(rel.columns)
    assert sorted(cols) == sorted(df.columns)
    at = [cols.index(c) for c in df.columns]
    key = lambda r: tuple(map(repr, r))
    ours = sorted((tuple(plain(v) for v in r) for r in df.collect()), key=key)
    theirs = sorted((tuple(plain(r[k]) for k in at) for r in rel.fetchall()), key=key)
    assert len(ours) == len(theirs)
    assert ours == theirs


@pytest.mark.parametrize("name", [n for n in NAMES if n not in queries.ORACLES])
def test_runs(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert df.count() > 0


def test_balanced_clusters_over_the_whole_table(spark):
    n = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    rows = queries.QUERIES["balanced_cluster_labels"](spark, SF).collect()
    sizes = [sum(r.label == k for r in rows) for k in range(8)]
    assert len(rows) == n > 200 and max(sizes) - min(sizes) <= 1


def test_transport_conditional_fits_all_rows(spark):
    c = gram.centres(queries._valued(spark, SF).select("id", F.slice("x", 1, 2).alias("x"), "f"), ["f"])
    k = kernels.block(KernelSpec("maternnorm"), c.x, c.x)
    want = dict(zip(c.ids.tolist(), (k @ np.linalg.solve(k + 1e-3 * len(k) * np.eye(len(k)), c.f))[:, 0]))
    got = {r.id: r.e for r in queries.QUERIES["transport_conditional"](spark, SF).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 2e-3 for i in want)


@pytest.mark.parametrize("name", [f"agent_{h}" for h in log_training.HOWS] + ["agent_greedy_actions", "state_values"])
def test_agents_answer_for_every_event(spark, name):
    n = spark.read.parquet(f"{SF}/events.parquet").count()
    df = queries.QUERIES[name](spark, SF)
    rows = df.collect()
    assert n > log_training.CENTRE_ROWS and len(rows) == len({r[0] for r in rows}) == n
    assert all(np.isfinite(r[1]) and (df.columns[1] == "v" or 0 <= r[1] < 3) for r in rows)
