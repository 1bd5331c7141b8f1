"""Operators against sequential restatements of what they compute."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from forktrack.config import BreakConfig, ForkConfig
from forktrack.operators import breaks, density, forks, fractions, lookup, match, segment, stall
from forktrack.plans import forksense

SMALL = ForkConfig(radius=20, min_segment=30, trim_span=150, stitch_gap=40, pair_gap=120, stall_rows=10, stall_radius=40, stall_attempts=2, fraction_span=30, fraction_calls=4)


def random_calls(seed, reads=6, n=120):
    r = random.Random(seed)
    rows = []
    for read in range(reads):
        coord, state = 0, 0
        for idx in range(n):
            coord += r.randint(1, 9)
            if r.random() < 0.05:
                state = r.randint(0, 2)
            e, b = ((0.9, 0.1), (0.1, 0.9), (0.1, 0.1))[state]
            if r.random() < 0.15:
                e, b = r.random(), r.random()
            rows.append((f"r{read}", idx, coord, e, b))
    return rows


@pytest.fixture(scope="module")
def table(spark):
    rows = [x for seed in range(3) for x in [(f"{seed}{r}", *rest) for r, *rest in random_calls(seed)]]
    return spark.createDataFrame(rows, "read_id string, idx int, coord long, p_edu double, p_brdu double").cache()


def by_read(df):
    out = {}
    for r in df.orderBy("read_id", "idx").collect():
        out.setdefault(r.read_id, []).append(r)
    return out


def naive_labels(rows, d):
    out = []
    for x in rows:
        near = [y for y in rows if abs(y.coord - x.coord) <= SMALL.radius]
        e, b = sum(y.p_edu > 0.5 for y in near), sum(y.p_brdu > 0.5 for y in near)
        need = int(len(near) * d)
        pe, pb = max(e - b, 0) >= need, max(b - e, 0) >= need
        out.append(None if pe and pb else "E" if pe else "B" if pb else "T")
    return out


def naive_segments(rows, labels):
    found = []
    for own in "EB":
        start = None
        for x, label in zip(rows, labels):
            if start is None and label == own:
                start = x
            elif start is not None and label is not None and label != own:
                found.append((own, start.coord, start.idx, x.coord, x.idx))
                start = None
        if start is not None:
            found.append((own, start.coord, start.idx, rows[-1].coord, rows[-1].idx))
    return [s for s in found if abs(s[3] - s[1]) >= SMALL.min_segment]


def naive_stitch(own, other):
    own, out, i = sorted(own, key=lambda s: s[1]), [], 0
    while i < len(own):
        cur = list(own[i])
        while i + 1 < len(own) and own[i + 1][1] - cur[3] < SMALL.stitch_gap and not any(cur[3] <= o[1] and o[3] <= own[i + 1][1] for o in other):
            cur[3:], i = own[i + 1][3:], i + 1
        out.append(tuple(cur))
        i += 1
    return out


def naive_trim(rows, s):
    label, _, li, _, ri = s
    part = rows[li:ri + 1]
    if part[-1].coord - part[0].coord < SMALL.trim_span:
        return s
    net = [((x.p_edu > 0.5) - (x.p_brdu > 0.5)) * (1 if label == "E" else -1) for x in part]
    dens, n = [], len(part)
    for i in range(int(0.33 * n), n):
        if i >= 0.66 * n:
            break
        near = [k for k in range(n) if abs(part[k].coord - part[i].coord) < SMALL.radius]
        dens.append(sum(net[k] for k in near) / len(near))
    least = sum(dens) / len(dens)
    keep = []
    for i in range(n):
        near = [k for k in range(n) if abs(part[k].coord - part[i].coord) <= SMALL.radius]
        keep.append(max(sum(net[k] for k in near), 0) >= int(len(near) * least))
    if not any(keep):
        return None
    a, b = keep.index(True), n - 1 - keep[::-1].index(True)
    return (label, part[a].coord, part[a].idx, part[b].coord, part[b].idx)


def naive_all(rows):
    found = naive_segments(rows, naive_labels(rows, 0.3))
    trimmed = [t for s in found if (t := naive_trim(rows, s))]
    e, b = [s for s in trimmed if s[0] == "E"], [s for s in trimmed if s[0] == "B"]
    return naive_stitch(e, b) + naive_stitch(b, e)


def naive_mutual(a, b, ok, dist, cap=None):
    out = []
    for i, x in enumerate(a):
        c = [(dist(x, y), j) for j, y in enumerate(b) if ok(x, y)]
        if c:
            d, j = min(c)
            if d == min(dist(z, b[j]) for z in a if ok(z, b[j])) and (cap is None or d < cap):
                out.append((i, j))
    return out


def test_labels_segments_and_stitching(table):
    labelled = density.label_calls(table, 0.3, 0.3, SMALL)
    got = by_read(labelled)
    for read, rows in got.items():
        assert [r.label for r in rows] == naive_labels(rows, 0.3), read
    want = {(read, *s) for read, rows in got.items() for s in naive_segments(rows, [r.label for r in rows])}
    assert {tuple(r[c] for c in segment.SEGMENT) for r in segment.segments(labelled, SMALL).collect()} == {(w[0], *w[1:]) for w in want}
    spans = forksense.find_segments(labelled, SMALL)
    assert {tuple(r[c] for c in segment.SEGMENT) for r in spans.collect()} == {(read, *s) for read, rows in got.items() for s in naive_all(rows)}


def test_pairs_and_fork_features(table):
    labelled = density.label_calls(table, 0.3, 0.3, SMALL)
    spans = forksense.find_segments(labelled, SMALL).cache()
    e, b = spans.where("label = 'E'"), spans.where("label = 'B'")
    right = {(r.read_id, r.a_left_coord, r.b_left_coord) for r in match.right_pairs(e, b, SMALL).collect()}
    left = {(r.read_id, r.a_left_coord, r.b_left_coord) for r in match.left_pairs(e, b, SMALL).collect()}
    want_right, want_left = set(), set()
    for read, rows in by_read(table).items():
        every = naive_all(rows)
        a, c = sorted(s for s in every if s[0] == "E"), sorted(s for s in every if s[0] == "B")
        want_right |= {(read, a[i][1], c[j][1]) for i, j in naive_mutual(a, c, lambda x, y: y[1] >= x[3], lambda x, y: y[1] - x[3], SMALL.pair_gap)}
        want_left |= {(read, a[i][1], c[j][1]) for i, j in naive_mutual(a, c, lambda x, y: x[1] >= y[3], lambda x, y: x[1] - y[3], SMALL.pair_gap)}
    assert right == want_right and left == want_left and right and left
    found = forks.signatures(forks.bounds(forks.paired(e, b, SMALL)), table, SMALL)
    scored = stall.stall_scores(found, table, "p_brdu", SMALL).collect()
    assert len(scored) == len(right) + len(left)
    rows = by_read(table)
    for f in scored:
        own = rows[f.read_id]
        assert f.length == f.right_coord - f.left_coord
        if f.tip_partners:
            assert f.score == stall.PARTNERED
            continue
        tip = f.right_idx if f.direction == "right" else f.left_idx
        if not SMALL.stall_rows < tip < len(own) - SMALL.stall_rows:
            assert f.score == stall.NEAR_END
            continue
        hit = lambda lo, hi: [own[j].p_brdu > 0.5 for j in range(lo, hi) if abs(own[j].coord - own[tip].coord) < SMALL.stall_radius]
        sides = hit(tip - SMALL.stall_rows, tip), hit(tip, tip + SMALL.stall_rows)
        behind, ahead = sides if f.direction == "right" else sides[::-1]
        if min(len(behind), len(ahead)) < SMALL.stall_attempts or np.mean(behind) < SMALL.stall_near:
            assert f.score is None
        elif np.mean(behind) <= np.mean(ahead):
            assert f.score == stall.SUSPECT
        else:
            drop = (np.mean(behind) - np.mean(ahead)) / np.mean(behind)
            want = (math.log(1 + math.exp(drop - 1)) - math.log(1 + math.exp(-1))) / math.log(2 / (1 + math.exp(-1)))
            assert f.score == pytest.approx(want)


def test_fractions_follow_the_sequential_rule(table):
    got = {}
    for r in fractions.call_fractions(table, SMALL).orderBy("read_id", "window").collect():
        got.setdefault(r.read_id, []).append((r.brdu_fraction, r.edu_fraction))
    for read, rows in by_read(table).items():
        want, start, n, b, e = [], None, 0, 0, 0
        for x in rows:
            start = x.coord if start is None else start
            n, b, e = n + 1, b + (x.p_brdu > 0.5), e + (x.p_brdu <= 0.5 < x.p_edu)
            if x.coord - start > SMALL.fraction_span and n >= SMALL.fraction_calls:
                want.append((b / n, e / n))
                start, n, b, e = None, 0, 0, 0
        assert np.allclose(got.get(read, []), want) and len(got.get(read, [])) == len(want)


def test_two_means(spark):
    r = random.Random(3)
    x = [r.gauss(0.1, 0.03) for _ in range(80)] + [r.gauss(0.6, 0.1) for _ in range(50)]
    m = fractions.two_means(spark.createDataFrame([(v,) for v in x], "v double"), "v")
    c1, c2 = 0.01, 0.5
    for _ in range(100):
        one = [v for v in x if abs(v - c1) < abs(v - c2)]
        two = [v for v in x if abs(v - c1) >= abs(v - c2)]
        n1, n2 = np.mean(one), np.mean(two)
        done = abs(n1 - c1) <= 1e-4 and abs(n2 - c2) <= 1e-4
        c1, c2 = n1, n2
        if done:
            break
    assert (m.centroid_1, m.lower_1, m.centroid_2, m.lower_2) == pytest.approx((c1, min(one), c2, min(two)))
    empty = fractions.two_means(spark.createDataFrame([(0.9,)], "v double"), "v")
    assert empty.lower_1 is None and empty.lower_2 == 0.9


def test_run_off_closed_form_agrees_with_sampling(spark):
    r = random.Random(1)
    reads = [(0, r.randint(6000, 30000)) for _ in range(40)]
    sizes = [r.randint(500, 6000) for _ in range(30)]
    config = BreakConfig(tolerances=(250,))
    got = breaks.expected_by_tolerance(spark.createDataFrame(reads, "read_start int, read_end int"), spark.createDataFrame([(s,) for s in sizes], "track_length int"), (250,), config).first().p
    hits, n = 0, 60_000
    for _ in range(n):
        a, b = r.choice(reads)
        hits += b - 250 - r.randint(a + 2000, b - 2000) < r.choice(sizes)
    assert got == pytest.approx(hits / n, abs=0.01)


def test_breaks_tables(spark):
    cols = "read_id string, start int, end int, read_start int, read_end int"
    left = spark.createDataFrame([("a", 5000, 9000, 0, 20000), ("b", 100, 900, 0, 20000)], cols)
    right = spark.createDataFrame([("b", 2500, 7000, 0, 20000), ("c", 2500, 19900, 0, 20000)], cols)
    single = breaks.single_lines(breaks.fork_lines(left, right))
    assert {r.read_id for r in single.collect()} == {"a", "c"}
    tracks = spark.createDataFrame([("a", 5000, 7000, 1), ("c", 9000, 9999, 1), ("c", 9000, 19900, 2)], "read_id string, start int, end int, line int")
    known = {r.read_id: (r.track_start, r.track_end) for r in breaks.with_track(single, tracks).collect()}
    assert known == {"a": (5000, 7000), "c": (9000, 19900)}
    seen = {r.read_id: r.run_off for r in breaks.run_off(single, 250).collect()}
    assert seen == {"a": False, "c": True}
    assert breaks.with_track(single, tracks.where("false"), compat=True).count() == 0


def test_noise_and_thinning(spark):
    r = random.Random(2)
    x = [r.gauss(0, 1) for _ in range(150)] + [9.0, 14.0]
    got = {round(v.v, 9): v.is_noise for v in lookup.noise(spark.createDataFrame([("k", v) for v in x], "k string, v double"), "k", "v", 0.5, 0.025).collect()}
    least = int(len(x) * 0.025)
    core = [v for v in x if sum(abs(v - w) <= 0.5 for w in x) >= least]
    assert got == {round(v, 9): not any(abs(v - c) <= 0.5 for c in core) for v in x}
    rows = spark.createDataFrame([("k", i) for i in range(400)], "k string, i int")
    kept = sorted(v.i for v in lookup.thinned(rows, "k", ["i"], 50, 100).collect())
    assert kept == list(range(50, 350, 3))[:100]


def test_theil_sen_of_many_keys(spark):
    """Against all pairs written out, with ties, nulls and keys without a line; 4000 keys of 300 points in seconds."""
    r = random.Random(11)
    rows = [(k, float(r.randint(0, 4)) if r.random() < 0.9 else None, r.gauss(0, 1) if r.random() < 0.9 else None) for k in range(40) for _ in range(r.randint(1, 30))]
    rows += [(90, 2.0, 1.0), (90, 2.0, 3.0), (None, 1.0, 1.0), (None, 2.0, 4.0), (91, math.inf, 1.0), (91, math.inf, 2.0), (91, 0.0, 2.0), (91, 1.0, 5.0)]

    def upper(values):
        return sorted(values, key=lambda v: (v is None, v is not None and math.isnan(v), v))[len(values) // 2] if values else None

    def line(points):
        known = [p for p in points if None not in p]
        slope = upper([(a[1] - b[1]) / (a[0] - b[0]) for i, a in enumerate(known) for b in known[i + 1:] if a[0] - b[0] != 0])
        return slope, None if slope is None else upper([None if None in p else p[1] - slope * p[0] for p in points])

    got = {v.k: tuple(v)[1:] for v in lookup.theil_sen(spark.createDataFrame(rows, "k int, x double, y double"), "k", "x", "y").collect()}
    assert set(got) == {k for k, _, _ in rows} and got[90] == (None, None)
    for k, found in got.items():
        for a, b in zip(found, line([(x, y) for key, x, y in rows if key == k])):
            assert a == b or math.isnan(a) and math.isnan(b)
    many = spark.range(4000 * 300).select((F.col("id") % 4000).alias("k"), F.hash("id").cast("double").alias("x"), F.hash("id", "id").cast("double").alias("y"))
    lookup.theil_sen(many.limit(1000), "k", "x", "y").count()
    began = time.time()
    assert lookup.theil_sen(many, "k", "x", "y").where("slope is not null and intercept is not null").count() == 4000
    assert time.time() - began < 30


def test_query_span_by_the_map_without_broadcasts(spark):
    """Against the map written out base by base; the join is a shuffle even where files are below the threshold."""
    from forktrack import queries
    from forktrack.functions import cigar

    r = random.Random(5)
    rows = [(f"r{k}", 100, "".join(f"{r.randint(1, 5)}{r.choice('MIDNSHP=X')}" for _ in range(r.randint(1, 12))), k % 2 == 1) for k in range(60)]
    reads = spark.createDataFrame(rows, "read_id string, ref_start long, cigar string, is_reverse boolean").withColumn("ops", cigar.parse(F.col("cigar"))).withColumn("ref_end", cigar.reference_end(F.col("ref_start"), F.col("ops")))
    ends = spark.createDataFrame([(x[0], n, r.randint(95, 130), r.randint(95, 130)) for x in rows for n in range(4)], "read_id string, n int, left_coord long, right_coord long")
    at = {(x.read_id, x.ref_idx): x.query_idx for x in cigar.reference_to_query(reads).collect()}
    found = forks.query_span(ends, reads).collect()
    place = {x.read_id: x for x in reads.collect()}
    assert len(found) == 240 and any(x.query_span is not None for x in found)
    for x in found:
        a = place[x.read_id]
        i, j = ((a.read_id, a.ref_end - c if a.is_reverse else c - a.ref_start) for c in (x.left_coord, x.right_coord))
        assert x.query_span == (abs(at[j] - at[i]) if i in at and j in at else None)
    plan = queries.query_spans(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Generate" not in plan


def test_empty_tables(spark):
    none = spark.createDataFrame([], "read_id string, idx int, coord long, p_edu double, p_brdu double")
    found = forksense.analyse(none, 0.1, 0.1, SMALL)
    for t in (found.segments, found.forks, found.origins, found.terminations, found.painted):
        assert t.count() == 0
    with pytest.raises(ValueError):
        fractions.incorporation(fractions.call_fractions(none, SMALL), SMALL)


def test_bed_families(spark, table):
    found = forksense.analyse(table, 0.3, 0.3, SMALL)
    reads = table.select("read_id").distinct().select("read_id", F.lit("chr1").alias("contig"), F.lit(0).alias("ref_start"), F.lit(1000).alias("ref_end"), F.lit("fwd").alias("strand"))
    families = forksense.bed_families(found, reads)
    assert len(families) == 8 and len(families["left_forks"].columns) == 9 and len(families["right_signatures"].columns) == 15
    assert families["edu_regions"].count() + families["brdu_regions"].count() == found.segments.count()


@pytest.mark.parametrize("rows", [7, 512, 10_000])
def test_streamed_fractions_do_not_depend_on_frames(spark, rows):
    from forktrack import queries

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        d = "/root/testdata/sf0.001"
        got = sorted(map(tuple, queries.stream_fractions(spark, d).drop("n").collect()))
    finally:
        spark.conf.set(key, before)
    c = queries.calls(spark, d).toPandas().sort_values(["read_id", "coord"])
    want = []
    for read, g in c.groupby("read_id"):
        coord, b, e = g["coord"].to_numpy(), (g["p_brdu"] > 0.5).to_numpy(), (g["p_edu"] > 0.5).to_numpy()
        at = 0
        while at < len(coord):
            end = at + queries.CONFIG.fraction_calls - 1
            while end < len(coord) and coord[end] - coord[at] <= queries.CONFIG.fraction_span:
                end += 1
            if end >= len(coord):
                break
            want.append((read, int(coord[at]), round(float(b[at:end + 1].mean()), 6), round(float((e & ~b)[at:end + 1].mean()), 6)))
            at = end + 1
    assert got == sorted(want)
