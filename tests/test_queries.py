"""Registered queries against their SQL at the smallest scale."""

import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as registry
from forktrack import queries as domain
from forktrack.signal import align

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def cell(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return [cell(x) for x in v]
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        path = f"{DATA}/{f}/*.parquet" if os.path.isdir(f"{DATA}/{f}") else f"{DATA}/{f}"
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{path}'")
    return c


@pytest.mark.parametrize("name", sorted(domain.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    df = domain.queries()[name](spark, DATA)
    rel = con.sql(domain.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    got = sorted(repr([cell(r[c]) for c in columns]) for r in df.collect())
    want = sorted(repr([cell(v) for v in r]) for r in rel.project(", ".join(f'"{c}"' for c in columns)).fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(domain.queries()) - set(domain.oracle_sql())))
def test_query_runs(spark, name):
    assert domain.queries()[name](spark, DATA).count() > 0


def test_registry(spark):
    assert set(domain.queries()) <= set(registry.queries()) and set(registry.oracle_sql()) <= set(registry.queries())
    assert registry.entry(spark).count() > 0


def test_signal_queries_read_whole_signals(spark, tmp_path):
    """Against the operators on whole signals, which test_signal.py holds against brute force."""
    r = np.random.default_rng(7)
    one = r.normal(0, 0.2, 64)
    two = np.concatenate([one[:40], r.normal(0, 0.2, 24)])
    rows = [(1, one.tolist()), (2, two.tolist()), (3, one[:10].tolist())]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {name: {x.vec_id: tuple(x)[1:] for x in domain.queries()[name](spark, str(tmp_path)).collect()} for name in ("hmm_forward", "viterbi", "banded_align")}
    t = align.Transitions.of(1.5, literal=False)
    for i, x in rows:
        x = np.array(x)
        n, m = max(12, len(x) // 2), max(20, len(x) // 2)
        low, high, sd, mean = np.linspace(-0.3, 0.3, n), np.linspace(-0.2, 0.4, n), np.full(n, 0.2), np.linspace(-0.3, 0.3, m)
        assert got["hmm_forward"][i][0] == pytest.approx(align.forward(x, high, sd, t) - align.forward(x, low, sd, t), abs=1e-5)
        score, path = align.viterbi(x, low, sd, t)
        assert got["viterbi"][i] == pytest.approx((score, sum(s == "M" for _, s in path), sum(s == "D" for _, s in path)), abs=1e-5)
        band = align.banded_alignment(x, mean, np.full(m, 0.2), align.Scaling(0.0, 1.0))
        assert got["banded_align"][i] == pytest.approx((band.average_log, len(band.pairs), band.longest_gap), abs=1e-5)
    assert all(found[1] != found[2] for found in got.values())
