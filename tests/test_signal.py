import math

import numpy as np
import pytest

from forktrack.config import EventConfig, GmmConfig
from forktrack.signal import align, events, model, ratios
from forktrack.training import gmm


def all_paths(x, mean, sd, t):
    """Every state path, by recursion, with its log probability."""
    n = len(mean)

    def emit(b, j):
        return float(align.log_density(x[j], mean[b], sd[b]))

    def go(state, b, j, p, path):
        path = [*path, (b, state)]
        if b == n - 1 and j == len(x):
            yield p + {"D": 0.0, "M": np.logaddexp(t.leave, t.match_del), "I": t.ins_match}[state], path
        if j < len(x):
            if state == "M":
                yield from go("M", b, j + 1, p + t.stay + emit(b, j), path)
                yield from go("I", b, j + 1, p + t.match_ins, path)
            if state == "I":
                yield from go("I", b, j + 1, p + t.ins_ins, path)
            if b + 1 < n:
                yield from go("M", b + 1, j + 1, p + {"M": t.leave, "I": t.ins_match, "D": t.del_match}[state] + emit(b + 1, j), path)
        if b + 1 < n and state in "MD":
            yield from go("D", b + 1, j, p + (t.match_del if state == "M" else t.del_del), path)

    yield from go("D", 0, 0, t.match_del, [])
    yield from go("M", 0, 1, np.logaddexp(t.leave, t.stay) + emit(0, 0), [])
    yield from go("I", 0, 1, t.match_ins, [])


@pytest.mark.parametrize("seed", range(6))
def test_viterbi_is_the_best_of_all_paths(seed):
    r = np.random.default_rng(seed)
    x, mean, sd = r.normal(0, 1, 4), r.normal(0, 1, 3), np.full(3, 0.7)
    t = align.Transitions.of(1.6, literal=bool(seed % 2))
    best = max(p for p, _ in all_paths(x, mean, sd, t))
    score, path = align.viterbi(x, mean, sd, t)
    assert score == pytest.approx(best)
    assert any(p == pytest.approx(score) and q == path for p, q in all_paths(x, mean, sd, t))


def test_forward_sums_paths():
    r = np.random.default_rng(0)
    x, mean, sd = r.normal(0, 1, 3), r.normal(0, 1, 3), np.full(3, 0.7)
    t = align.Transitions.of(1.6, literal=False)
    e = [[float(align.log_density(x[j], mean[b], sd[b])) for j in range(3)] for b in range(3)]
    total = -np.inf
    # States: S start, F leading insertion, then (M|I|D, base); emissions one at a time, deletions silent.
    def go(state, b, j, p):
        nonlocal total
        if b == 2 and j == 3 and state in "MID":
            total = np.logaddexp(total, p + {"D": 0.0, "M": np.logaddexp(t.leave, t.match_del), "I": t.ins_match}[state])
        q = math.log(0.25)
        if state in "SF":
            if j < 3:
                go("F", -1, j + 1, p + q)
                go("M", 0, j + 1, p + math.log(0.5) + e[0][j])
            go("D", 0, j, p + q)
            return
        if j < 3:
            if state == "M":
                go("M", b, j + 1, p + t.stay + e[b][j])
            if state in "MI":
                go("I", b, j + 1, p + (t.match_ins if state == "M" else t.ins_ins))
            if b < 2:
                go("M", b + 1, j + 1, p + {"M": t.leave, "I": t.ins_match, "D": t.del_match}[state] + e[b + 1][j])
        if b < 2 and state in "MD":
            go("D", b + 1, j, p + (t.match_del if state == "M" else t.del_del))

    go("S", -1, 0, 0.0)
    assert align.forward(x, mean, sd, t) == pytest.approx(total)


def test_banded_alignment_follows_a_clean_signal():
    r = np.random.default_rng(1)
    mean = r.normal(0, 1, 120)
    stays = r.integers(1, 4, 120)
    x = np.repeat(mean, stays) + r.normal(0, 0.03, stays.sum())
    got = align.banded_alignment(x, mean, np.full(120, 0.2), align.Scaling(0.0, 1.0))
    assert got.passes() and got.spanned
    truth = np.repeat(np.arange(120), stays)
    assert np.mean([truth[e] == k for e, k in got.pairs]) > 0.98


def test_scaling_recovers_a_line():
    r = np.random.default_rng(2)
    levels = r.normal(0, 1, 3000)
    signal = 80 + 12 * levels
    rough = align.rough_scaling(signal, levels)
    assert (rough.shift, rough.scale) == pytest.approx((80, 12), abs=1e-6)
    fine = align.refined_scaling(signal, levels, align.Scaling(78.0, 11.0))
    assert (fine.shift, fine.scale) == pytest.approx((80, 12), abs=1e-6)
    assert align.refined_scaling(signal[:10], levels[:10], rough) is rough


def test_events_of_a_step_signal(spark):
    r = np.random.default_rng(3)
    x = np.concatenate([np.full(20, v) for v in (70.0, 95.0, 60.0, 88.0)]) + r.normal(0, 0.4, 80)
    found = events.events(x)
    starts = [e[0] for e in found]
    assert all(any(abs(s - b) <= 2 for s in starts) for b in (20, 40, 60))
    assert sum(e[1] for e in found) == len(x)
    assert events.events(np.full(30, 5.0)) == [(0, 30, 5.0, 0.0)]
    assert events.events(np.zeros(0)) == []
    old = events.events(x, compat=True)
    assert old[0][2] == 0.0 and len(old) == len(found) - 1
    t = events.t_statistic(x, 3)
    assert t[20] > 10 and t[0] == t[-1] == 0
    rows = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate(x)], "k string, i int, v double")
    got = [w.t for w in events.windowed_t(rows, "k", ["i"], "v", 3).orderBy("i").collect()]
    assert got == pytest.approx(t.tolist(), rel=1e-6, abs=1e-6)
    assert events.detect_events(spark.createDataFrame([("r", x.tolist()), ("s", [])], "read_id string, raw array<double>")).count() == len(found)
    assert EventConfig().peak_height == 0.2


def test_event_alignment_covers_bases():
    r = np.random.default_rng(4)
    k = 4
    mean, sd = r.normal(90, 12, 4**k), np.full(4**k, 1.0)
    sequence = "".join("ATGC"[i] for i in r.integers(0, 4, 300))
    idx = align.kmer_indexes(sequence, k)
    x = np.repeat(mean[idx], 2) + r.normal(0, 0.3, 2 * len(idx))
    pairs = [(e, e // 2) for e in range(len(x))]
    out = align.event_alignment(x, pairs, {i: i for i in range(301)}, sequence, mean, sd, align.Scaling(0.0, 1.0), align.Transitions.of(2.0, literal=False), length=30, k=k)
    right = [a.event // 2 == a.base for a in out if a.match]
    assert len(right) > 500 and np.mean(right) > 0.95


def test_mixture_and_model(spark):
    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(0, 1, 600), r.normal(5, 0.5, 400)])
    w1, m1, s1, w2, m2, s2 = gmm.fit(x, (0.0, 1.0), (4.0, 1.0))
    assert (m1, s1) == (0.0, 1.0) and m2 == pytest.approx(5, abs=0.1) and w2 == pytest.approx(0.4, abs=0.05)
    rows = spark.createDataFrame([("AAA", float(v)) for v in x] + [("TTT", 1.0)], "kmer string, level double")
    got = gmm.train(rows, spark.createDataFrame([("AAA", 0.0, 1.0), ("TTT", 0.0, 1.0)], "kmer string, mean double, sd double"), GmmConfig()).collect()
    assert [g.kmer for g in got] == ["AAA"] and got[0].imported_events == 1000
    p = model.LogisticStub().predict(np.zeros(2), np.zeros(2), np.ones((2, 20)))
    assert p.shape == (2, 3) and p.sum(1) == pytest.approx([1, 1])


def test_likelihood_ratios_tell_levels_apart(spark):
    r = np.random.default_rng(6)
    k = 3
    low, sd = r.normal(0, 1, 4**k), np.full(4**k, 0.3)
    high = low + 1.0
    sequence = "".join("ATGC"[i] for i in r.integers(0, 4, 90))
    idx = align.kmer_indexes(sequence, k)
    t = align.Transitions.of(1.2, literal=False)
    to_query, pairs = {i: i for i in range(91)}, [(i, i) for i in range(len(idx))]
    # A signal has positive means; the scaling takes the offset away again.
    run = lambda x: dict(ratios.likelihood_ratios(x + 90, pairs, to_query, sequence, (low, sd), (high, sd), align.Scaling(90.0, 1.0), t, half=6, k=k))
    plain = run(low[idx])
    assert list(plain) == [i for i in range(12, 78) if sequence[i] == "T"] and np.mean([v < 0 for v in plain.values()]) > 0.9
    right = []
    for place in plain:
        x = low[idx].copy()
        for i in range(place - 1, place + 2):
            x[i] += "T" in sequence[i:i + k]
        right.append(run(x)[place] > 0)
    assert np.mean(right) > 0.9
    x = np.concatenate([np.zeros(300), r.normal(0, 5, 700), np.zeros(250)])
    start, end = ratios.trim_by_deviation(x)
    assert (start, end) == (300, 1000)
    rows = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate([1, 2, 3, 4, 100])], "k string, i int, v double")
    assert ratios.chunk_deviations(rows, "k", "i", "v").first().deviation == pytest.approx(1.4826)
