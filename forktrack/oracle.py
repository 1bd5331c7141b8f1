"""SQL that states what the registered queries compute, for an independent engine on the same tables."""

from __future__ import annotations

DAY = 86_400_000_000

CALLS = """calls AS (
  SELECT user_id AS read_id, epoch_us(ts) AS coord, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS idx,
         CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE 0 END AS e, CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END AS b
  FROM events)"""

LABELLED = CALLS + f""", near AS (
  SELECT *, count(*) OVER w AS n, sum(e) OVER w AS ne, sum(b) OVER w AS nb FROM calls
  WINDOW w AS (PARTITION BY read_id ORDER BY coord RANGE BETWEEN {2 * DAY} PRECEDING AND {2 * DAY} FOLLOWING)),
labelled AS (
  SELECT read_id, coord, idx, e, b, CASE WHEN pe AND pb THEN NULL WHEN pe THEN 'E' WHEN pb THEN 'B' ELSE 'T' END AS label
  FROM (SELECT *, greatest(ne - nb, 0) >= floor(n * 0.25) AS pe, greatest(nb - ne, 0) >= floor(n * 0.25) AS pb FROM near))"""

SEGMENTS = LABELLED + f""", bounded AS (
  SELECT *, max(coord) OVER (PARTITION BY read_id) AS last_coord, max(idx) OVER (PARTITION BY read_id) AS last_idx FROM labelled),
sure AS (SELECT *, lag(label) OVER (PARTITION BY read_id ORDER BY coord) AS before FROM bounded WHERE label IS NOT NULL),
islands AS (
  SELECT read_id, label, coord AS left_coord, idx AS left_idx, coalesce(lead(coord) OVER o, last_coord) AS right_coord, coalesce(lead(idx) OVER o, last_idx) AS right_idx
  FROM sure WHERE before IS NULL OR before <> label WINDOW o AS (PARTITION BY read_id ORDER BY coord)),
segs AS (SELECT * FROM islands WHERE label <> 'T' AND right_coord - left_coord >= {DAY // 2})"""

TRIMMED = SEGMENTS + f""", inside AS (
  SELECT s.*, c.idx, c.coord, CASE WHEN s.label = 'E' THEN c.e - c.b ELSE c.b - c.e END AS net
  FROM segs s JOIN calls c ON c.read_id = s.read_id AND c.idx BETWEEN s.left_idx AND s.right_idx WHERE s.right_coord - s.left_coord >= {5 * DAY}),
dense AS (
  SELECT *, CASE WHEN idx - left_idx >= floor(0.33 * (right_idx - left_idx + 1)) AND idx - left_idx < 0.66 * (right_idx - left_idx + 1) THEN (sum(net) OVER i) * 1.0 / count(*) OVER i END AS density,
         count(*) OVER o AS n_near, greatest(sum(net) OVER o, 0) AS net_near
  FROM inside
  WINDOW i AS (PARTITION BY read_id, label, left_idx ORDER BY coord RANGE BETWEEN {2 * DAY - 1} PRECEDING AND {2 * DAY - 1} FOLLOWING),
         o AS (PARTITION BY read_id, label, left_idx ORDER BY coord RANGE BETWEEN {2 * DAY} PRECEDING AND {2 * DAY} FOLLOWING)),
least AS (SELECT *, coalesce(avg(density) OVER (PARTITION BY read_id, label, left_idx), 0) AS least FROM dense),
trims AS (
  SELECT read_id, label, min(coord) AS left_coord, min(idx) AS left_idx, max(coord) AS right_coord, max(idx) AS right_idx
  FROM least WHERE net_near >= trunc(n_near * least) GROUP BY read_id, label, least.left_idx),
trimmed AS (SELECT * FROM segs WHERE right_coord - left_coord < {5 * DAY} UNION ALL SELECT * FROM trims)"""
SPANS = TRIMMED + f""", ordered AS (SELECT *, lag(right_coord) OVER (PARTITION BY read_id, label ORDER BY left_coord) AS gap_from FROM trimmed),
opened AS (
  SELECT *, CASE WHEN left_coord - gap_from < {2 * DAY + DAY // 12} AND NOT EXISTS (
    SELECT 1 FROM trimmed x WHERE x.read_id = o.read_id AND x.label <> o.label AND x.left_coord >= o.gap_from AND x.right_coord <= o.left_coord) THEN 0 ELSE 1 END AS opens
  FROM ordered o),
runs AS (SELECT *, sum(opens) OVER (PARTITION BY read_id, label ORDER BY left_coord) AS run FROM opened),
spans AS (
  SELECT read_id, label, min(left_coord) AS left_coord, min(left_idx) AS left_idx, max(right_coord) AS right_coord, max(right_idx) AS right_idx
  FROM runs GROUP BY read_id, label, run)"""


def _mutual(name: str, a: str, b: str, allowed: str, distance: str, cap: str = "") -> str:
    return f"""{name} AS (
  SELECT * FROM (
    SELECT *, min(distance) OVER (PARTITION BY read_id, b_left_coord, b_right_coord) AS best_b,
           row_number() OVER (PARTITION BY read_id, a_left_coord, a_right_coord ORDER BY distance, b_left_coord) AS place
    FROM (SELECT a.read_id, {', '.join(f'{s}.{c} AS {s}_{c}' for s in 'ab' for c in ('left_coord', 'left_idx', 'right_coord', 'right_idx'))}, {distance} AS distance
          FROM {a} a JOIN {b} b ON a.read_id = b.read_id AND {allowed}))
  WHERE place = 1 AND distance = best_b {cap})"""


_E, _B = "(SELECT * FROM spans WHERE label = 'E')", "(SELECT * FROM spans WHERE label = 'B')"
PAIRS = SPANS + ", " + _mutual("rights", _E, _B, "b.left_coord >= a.right_coord", "b.left_coord - a.right_coord", "AND distance < 300000000000") + ", " + _mutual("lefts", _E, _B, "a.left_coord >= b.right_coord", "a.left_coord - b.right_coord", "AND distance < 300000000000")

BOUNDS = PAIRS + """, paired AS (
  SELECT *, count(*) OVER (PARTITION BY read_id, a_left_coord) AS pa, count(*) OVER (PARTITION BY read_id, b_left_coord) AS pb
  FROM (SELECT *, 'right' AS direction FROM rights UNION ALL SELECT *, 'left' AS direction FROM lefts)),
bounds AS (
  SELECT *, CASE WHEN pb = 2 THEN 1 ELSE 0 END AS tip_partners,
    CASE direction WHEN 'right' THEN CASE WHEN pa = 2 THEN (a_left_coord + a_right_coord) // 2 ELSE a_left_coord END ELSE CASE WHEN pb = 2 THEN (b_left_coord + b_right_coord) // 2 ELSE b_left_coord END END AS left_coord,
    CASE direction WHEN 'right' THEN CASE WHEN pa = 2 THEN (a_left_idx + a_right_idx) // 2 ELSE a_left_idx END ELSE CASE WHEN pb = 2 THEN (b_left_idx + b_right_idx) // 2 ELSE b_left_idx END END AS left_idx,
    CASE direction WHEN 'right' THEN CASE WHEN pb = 2 THEN (b_left_coord + b_right_coord) // 2 ELSE b_right_coord END ELSE CASE WHEN pa = 2 THEN (a_left_coord + a_right_coord) // 2 ELSE a_right_coord END END AS right_coord,
    CASE direction WHEN 'right' THEN CASE WHEN pb = 2 THEN (b_left_idx + b_right_idx) // 2 ELSE b_right_idx END ELSE CASE WHEN pa = 2 THEN (a_left_idx + a_right_idx) // 2 ELSE a_right_idx END END AS right_idx
  FROM paired)"""

_PAIR = "read_id, a_left_coord, a_right_coord, b_left_coord, b_right_coord, distance"
_LF, _RF = "(SELECT * FROM bounds WHERE direction = 'left')", "(SELECT * FROM bounds WHERE direction = 'right')"

SIGNATURE = "WITH " + BOUNDS + """
SELECT read_id, direction, left_coord, left_idx, right_coord, right_idx, tip_partners, right_coord - left_coord AS length,
  CASE direction WHEN 'right' THEN a_right_coord - left_coord ELSE right_coord - a_left_coord END AS first_length,
  CASE direction WHEN 'right' THEN right_coord - b_left_coord ELSE b_right_coord - left_coord END AS second_length,
  (SELECT round(avg(b), 6) FROM calls c WHERE c.read_id = f.read_id AND c.idx >= f1 AND c.idx < f2) AS brdu_in_first,
  (SELECT round(avg(e), 6) FROM calls c WHERE c.read_id = f.read_id AND c.idx >= f1 AND c.idx < f2) AS edu_in_first,
  (SELECT round(avg(e), 6) FROM calls c WHERE c.read_id = f.read_id AND c.idx >= s1 AND c.idx < s2) AS edu_in_second,
  (SELECT round(avg(b), 6) FROM calls c WHERE c.read_id = f.read_id AND c.idx >= s1 AND c.idx < s2) AS brdu_in_second
FROM (SELECT *, CASE direction WHEN 'right' THEN left_idx ELSE a_left_idx END AS f1, CASE direction WHEN 'right' THEN a_right_idx ELSE right_idx END AS f2,
             CASE direction WHEN 'right' THEN b_left_idx ELSE left_idx END AS s1, CASE direction WHEN 'right' THEN right_idx ELSE b_right_idx END AS s2 FROM bounds) f"""

STALL = "WITH " + BOUNDS + f""", tips AS (
  SELECT f.*, t.idx AS tip_idx, t.coord AS tip_coord, (SELECT count(*) FROM calls c WHERE c.read_id = f.read_id) AS n_calls
  FROM bounds f JOIN calls t ON t.read_id = f.read_id AND t.idx = CASE direction WHEN 'right' THEN f.right_idx ELSE f.left_idx END),
sides AS (
  SELECT t.read_id, t.direction, t.left_coord, t.right_coord, t.tip_partners, t.tip_idx, t.n_calls,
    count(*) FILTER (c.idx < tip_idx) AS n0, avg(c.b) FILTER (c.idx < tip_idx) AS f0, count(*) FILTER (c.idx >= tip_idx) AS n1, avg(c.b) FILTER (c.idx >= tip_idx) AS f1
  FROM tips t LEFT JOIN calls c ON c.read_id = t.read_id AND c.idx BETWEEN tip_idx - 10 AND tip_idx + 9 AND abs(c.coord - tip_coord) < {2 * DAY}
  GROUP BY ALL),
scored AS (SELECT *, CASE direction WHEN 'right' THEN f0 ELSE f1 END AS behind, CASE direction WHEN 'right' THEN f1 ELSE f0 END AS ahead FROM sides)
SELECT read_id, direction, left_coord, right_coord, round(CASE
    WHEN tip_partners > 0 THEN -1.0 WHEN NOT (tip_idx > 10 AND tip_idx < n_calls - 10) THEN -3.0
    WHEN n0 < 3 OR n1 < 3 OR behind IS NULL OR behind < 0.2 OR ahead IS NULL THEN NULL
    WHEN behind > ahead THEN (ln(1 + exp((behind - ahead) / behind - 1)) - ln(1 + exp(-1.0))) / ln(2 / (1 + exp(-1.0)))
    ELSE -2.0 END, 6) AS score
FROM scored"""

FRACTIONS = CALLS + f""", ends AS (
  SELECT a.read_id, a.idx AS s, min(z.idx) AS t FROM calls a JOIN calls z ON z.read_id = a.read_id AND z.idx >= a.idx + 2 AND z.coord - a.coord > {DAY} GROUP BY ALL),
chain AS (
  SELECT read_id, 0 AS "window", s, t FROM ends WHERE s = 0
  UNION ALL SELECT c.read_id, c."window" + 1, ends.s, ends.t FROM chain c JOIN ends ON ends.read_id = c.read_id AND ends.s = c.t + 1),
fr AS (
  SELECT w.read_id, w."window", min(c.coord) AS start, count(*) AS n, avg(c.b) AS brdu_fraction, avg(CASE WHEN c.b = 0 THEN c.e ELSE 0 END) AS edu_fraction
  FROM chain w JOIN calls c ON c.read_id = w.read_id AND c.idx BETWEEN w.s AND w.t GROUP BY w.read_id, w."window")"""


def _two_means(rounds: int = 40) -> str:
    out = "WITH RECURSIVE " + FRACTIONS + ", m0 AS (SELECT 0.01 AS p1, 0.5 AS p2, 0.01 AS c1, 0.5 AS c2, false AS done)"
    for k in range(rounds):
        out += f""", m{k + 1} AS (
  SELECT CASE WHEN done THEN p1 ELSE c1 END AS p1, CASE WHEN done THEN p2 ELSE c2 END AS p2, CASE WHEN done THEN c1 ELSE n1 END AS c1, CASE WHEN done THEN c2 ELSE n2 END AS c2,
         done OR (abs(n1 - c1) <= 0.0001 AND abs(n2 - c2) <= 0.0001) AS done
  FROM m{k}, (SELECT coalesce(avg(edu_fraction) FILTER (abs(edu_fraction - c1) < abs(edu_fraction - c2)), 0) AS n1, coalesce(avg(edu_fraction) FILTER (abs(edu_fraction - c1) >= abs(edu_fraction - c2)), 0) AS n2 FROM fr, m{k}))"""
    return out + f"""
SELECT round(any_value(c1), 6) AS centroid_1, round(min(edu_fraction) FILTER (one), 6) AS lower_1, round(coalesce(stddev_pop(edu_fraction) FILTER (one), 0), 6) AS deviation_1,
       round(any_value(c2), 6) AS centroid_2, round(min(edu_fraction) FILTER (NOT one), 6) AS lower_2, round(coalesce(stddev_pop(edu_fraction) FILTER (NOT one), 0), 6) AS deviation_2
FROM (SELECT edu_fraction, abs(edu_fraction - p1) < abs(edu_fraction - p2) AS one, c1, c2 FROM fr, m{rounds})"""


LINES = """lines AS (
  SELECT read_id, is_right, start, start + 500 + l_partkey % 5000 AS "end", 0 AS read_start, 15000 + (read_id % 7) * 1500 AS read_end, supp
  FROM (SELECT l_orderkey AS read_id, l_returnflag = 'R' AS is_right, CAST(floor(l_extendedprice) AS BIGINT) % 8000 + 2500 AS start, l_partkey, l_suppkey AS supp FROM lineitem WHERE l_returnflag IN ('A', 'R'))),
single AS (SELECT * FROM lines WHERE read_id IN (SELECT read_id FROM lines GROUP BY read_id HAVING count(*) = 1)),
known AS (
  SELECT *, CASE WHEN is_right THEN start + 100 ELSE start END AS track_start, CASE WHEN is_right THEN "end" ELSE "end" - 100 END AS track_end FROM single WHERE supp % 5 <> 0),
interior AS (SELECT track_end - track_start AS track_length FROM known WHERE track_start - read_start > 2000 AND read_end - track_end > 2000),
tolerances AS (SELECT unnest([250, 300, 350, 400, 450, 500]) AS tolerance),
seen AS (
  SELECT tolerance, avg(CASE WHEN CASE WHEN is_right THEN read_end - "end" ELSE start - read_start END < tolerance THEN 1.0 ELSE 0.0 END) AS p, count(*) AS n
  FROM known, tolerances WHERE CASE WHEN is_right THEN start - read_start ELSE read_end - "end" END > 2000 GROUP BY tolerance),
hoped AS (
  SELECT tolerance, sum(ws * wl * (least(greatest(span - 2000 - greatest(2000, span - tolerance - track_length + 1) + 1, 0), span - 3999) * 1.0 / (span - 3999))) / sum(ws * wl) AS p
  FROM (SELECT 15000 + (o_orderkey % 7) * 1500 AS span, count(*) AS ws FROM orders GROUP BY 1) r, (SELECT track_length, count(*) AS wl FROM interior GROUP BY 1) l, tolerances GROUP BY tolerance)"""
_ORDER = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity"


def _quantiles(value: str) -> str:
    return f"""SELECT l_suppkey, part, v[CAST((part * step + (part + 1) * step) // 2 AS BIGINT) + 1] AS m
  FROM (SELECT l_suppkey, list_sort(list({value})) AS v, count(*) // 10 AS step FROM lineitem GROUP BY l_suppkey), (SELECT unnest(range(10)) AS part)"""


SEQUENCES = "sequences AS (SELECT item_id, translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ATGCATGCATGCATGCATGCATGCAT') AS seq FROM benchmark)"


def _kmers(k: int) -> str:
    return f"SELECT item_id, i - 1 AS place, substr(seq, i, {k}) AS kmer FROM (SELECT item_id, seq, unnest(range(1, length(seq) - {k} + 2)) AS i FROM sequences)"


def _index(kmer: str, places: list[int]) -> str:
    return "CAST(" + " + ".join(f"(strpos('ATGC', substr({kmer}, {p}, 1)) - 1) * {4 ** (len(places) - 1 - n)}" for n, p in enumerate(places)) + " AS INTEGER)"


MARKED = CALLS + ", marked AS (SELECT read_id, idx * 3 + coord % 3 AS query_idx, (coord % 256) / 255.0::DOUBLE AS p_brdu, (coord % 101) / 101.0::DOUBLE AS p_edu FROM calls)"

ALIGNMENTS = """parts AS (
  SELECT o_orderkey AS read_id, o_orderkey * 7 AS pos, o_orderkey % 2 = 1 AS rev, o_orderkey % 4 + 1 AS s, o_orderkey % 5 + 3 AS m1, o_orderkey % 3 + 1 AS i, o_orderkey % 4 + 2 AS m2, o_orderkey % 2 + 1 AS d, o_orderkey % 6 + 2 AS m3 FROM orders),
cells AS (
  SELECT *, unnest(range(m1 + m2 + d + m3)) AS r FROM parts),
mapped AS (
  SELECT read_id, pos, rev, m1 + m2 + d + m3 AS total, r AS ref_idx,
    CASE WHEN rev THEN CASE WHEN r < m3 THEN r WHEN r < m3 + d THEN m3 WHEN r < m3 + d + m2 THEN r - d ELSE r - d + i END
         ELSE CASE WHEN r < m1 THEN s + r WHEN r < m1 + m2 THEN s + i + r WHEN r < m1 + m2 + d THEN s + i + m1 + m2 ELSE s + i + r - d END END AS query_idx,
    CASE WHEN rev THEN r >= m3 AND r < m3 + d ELSE r >= m1 + m2 AND r < m1 + m2 + d END AS is_del
  FROM cells)"""

_PAGES = "(SELECT page_id, regexp_replace(url, '[?#].*$', '') AS u FROM pages)"


def _density(mean: float, sd: float) -> str:
    return f"exp(-0.5 * ((l_quantity - {mean}) / {sd}) * ((l_quantity - {mean}) / {sd})) / ({sd} * sqrt(2 * pi()))"


SQL = {
    "density_labels": "WITH " + LABELLED + " SELECT read_id, coord, coalesce(label, 'ambiguous') AS label FROM labelled",
    "label_segments": "WITH " + SEGMENTS + " SELECT * FROM segs",
    "trim_segments": "WITH " + TRIMMED + " SELECT * FROM trimmed",
    "stitch_segments": "WITH " + SPANS + " SELECT * FROM spans",
    "right_forks": "WITH " + PAIRS + f" SELECT {_PAIR} FROM rights",
    "left_forks": "WITH " + PAIRS + f" SELECT {_PAIR} FROM lefts",
    "fork_bounds_signature": SIGNATURE,
    "origins": "WITH " + BOUNDS + ", " + _mutual("found", _LF, _RF, "b.right_coord >= a.right_coord", "b.right_coord - a.left_coord") + ' SELECT read_id, least(a_right_coord, b_left_coord) AS start, greatest(a_right_coord, b_left_coord) AS "end" FROM found',
    "terminations": "WITH " + BOUNDS + ", " + _mutual("found", _LF, _RF, "a.right_coord >= b.right_coord", "a.right_coord - b.left_coord") + ' SELECT read_id, least(a_left_coord, b_right_coord) AS start, greatest(a_left_coord, b_right_coord) AS "end" FROM found',
    "stall_scores": STALL,
    "paint_labels": "WITH " + SPANS + """ SELECT read_id, coord,
      CASE WHEN EXISTS (SELECT 1 FROM spans s WHERE s.read_id = c.read_id AND s.label = 'E' AND c.idx BETWEEN s.left_idx AND s.right_idx) THEN 1 ELSE 0 END AS edu,
      CASE WHEN EXISTS (SELECT 1 FROM spans s WHERE s.read_id = c.read_id AND s.label = 'B' AND c.idx BETWEEN s.left_idx AND s.right_idx) THEN 1 ELSE 0 END AS brdu FROM calls c""",
    "read_gate": "SELECT user_id AS read_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) > 60",
    "call_fractions": "WITH RECURSIVE " + FRACTIONS + ' SELECT read_id, CAST("window" AS INTEGER) AS "window", round(brdu_fraction, 6) AS brdu_fraction, round(edu_fraction, 6) AS edu_fraction FROM fr',
    "two_means": _two_means(),
    "sized_segments": "WITH " + SPANS + " SELECT label, count(*) AS n, round(avg((right_coord - left_coord) / 60000000.0), 6) AS mean_minutes, round(stddev_pop((right_coord - left_coord) / 60000000.0), 6) AS sd_minutes FROM spans GROUP BY label",
    "dup_reads_anti": "WITH " + LINES + ' SELECT read_id, is_right, start, "end" FROM single',
    "track_join": "WITH " + LINES + ' SELECT read_id, is_right, start, "end", track_start, track_end FROM known',
    "track_stats": "WITH " + LINES + " SELECT round(m, 6) AS mean, round(s, 6) AS sd, CAST(trunc(trunc(m) + 3 * s) AS INTEGER) AS min_read_length FROM (SELECT coalesce(avg(track_length), 0) AS m, coalesce(stddev_pop(track_length), 0) AS s FROM interior)",
    "runoff_observed": "WITH " + LINES + " SELECT tolerance, round(p, 6) AS p, n FROM seen",
    "runoff_expected": "WITH " + LINES + " SELECT tolerance, round(p, 6) AS p FROM hoped",
    "runoff_ci": "WITH " + LINES + """, o AS (SELECT avg(p) AS p, sqrt(avg(p * (1 - p) / n) + var_pop(p)) AS sd FROM seen),
      e AS (SELECT avg(p) AS p, sqrt(avg(p * (1 - p) / (SELECT max(n) FROM seen)) + var_pop(p)) AS sd FROM hoped),
      d AS (SELECT o.p AS observed, o.sd AS observed_sd, e.p AS expected, e.sd AS expected_sd, o.p - e.p AS difference, sqrt(o.sd * o.sd + e.sd * e.sd) AS difference_sd FROM o, e)
      SELECT round(observed, 6) AS observed, round(observed_sd, 6) AS observed_sd, round(expected, 6) AS expected, round(expected_sd, 6) AS expected_sd, round(difference, 6) AS difference, round(difference_sd, 6) AS difference_sd,
             round(difference - 1.96 * difference_sd, 6) AS low, round(difference + 1.96 * difference_sd, 6) AS high FROM d""",
    "read_filter": "SELECT l_returnflag AS seq, count(*) AS n, CAST(sum(trunc(l_extendedprice / 10)) AS BIGINT) AS bases FROM lineitem WHERE trunc(l_quantity) >= 20 AND trunc(l_extendedprice / 10) >= 1000 GROUP BY 1",
    "index_join": "SELECT o_orderkey, o_custkey AS read_id, c_name AS path FROM orders JOIN customer ON c_custkey = o_custkey",
    "index_missing": "SELECT doc_id AS read_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "signal_join": "SELECT c_custkey AS read_id, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 97 END AS pi, CAST(len(embedding) AS INTEGER) AS n_samples, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM customer JOIN embeddings ON vec_id = CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 97 ELSE c_custkey END",
    "reference_substring": f"WITH {SEQUENCES}, a AS (SELECT o_orderkey AS read_id, o_orderkey % 40 AS contig, o_custkey % 60 AS ref_start, 1 + o_orderkey % 70 AS n FROM orders) SELECT read_id, contig, ref_start, substr(seq, ref_start + 1, n) AS reference FROM a JOIN sequences ON item_id = contig WHERE ref_start < length(seq)",
    "event_calls": "WITH " + CALLS + ", enough AS (SELECT read_id FROM calls GROUP BY read_id HAVING count(*) > 60) SELECT c.read_id, c.coord, c.idx, CASE WHEN n.read_id IS NOT NULL THEN c.e * 1.0::DOUBLE END AS p_edu, CASE WHEN n.read_id IS NOT NULL THEN c.b * 1.0::DOUBLE END AS p_brdu FROM calls c LEFT JOIN enough n ON n.read_id = c.read_id",
    "prefix_sums": f"SELECT l_suppkey, round(max(s), 2) AS total, round(max(q), 2) AS squares, round(sum(s), 2) AS area FROM (SELECT l_suppkey, sum(l_quantity) OVER o AS s, sum(l_quantity * l_quantity) OVER o AS q FROM lineitem WINDOW o AS (PARTITION BY l_suppkey ORDER BY {_ORDER} ROWS UNBOUNDED PRECEDING)) GROUP BY 1",
    "densities": "SELECT l_partkey, round(sum(-0.5 * ln(2 * pi()) - ln(9.0::DOUBLE) - 0.5 * ((l_quantity - 25) / 9.0) * ((l_quantity - 25) / 9.0)), 5) AS log_normal, round(sum(CASE WHEN l_quantity BETWEEN 10 AND 30 THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END), 6) AS uniform, round(sum(1 / (pi() * 4 * (1 + ((l_quantity - 20) / 4.0) * ((l_quantity - 20) / 4.0)))), 6) AS cauchy FROM lineitem GROUP BY 1",
    "model_calls": f"""WITH {SEQUENCES}, k AS (SELECT item_id, place, kmer, (place % 7) / 7.0::DOUBLE AS s1, (place % 5) / 5.0::DOUBLE AS s2 FROM ({_kmers(9)}) WHERE substr(kmer, 5, 1) = 'T'),
      m AS (SELECT *, (s1 + s2) / greatest(CASE WHEN s1 <> 0 THEN 1 ELSE 0 END + CASE WHEN s2 <> 0 THEN 1 ELSE 0 END, 1) AS mean FROM k)
      SELECT item_id, CAST(place AS INTEGER) AS place, kmer, round(exp(mean / 2) / (1 + exp(mean / 2) + exp(-mean / 2)), 6) AS p_brdu, round(exp(-mean / 2) / (1 + exp(mean / 2) + exp(-mean / 2)), 6) AS p_edu FROM m""",
    "index_latest": "SELECT o_custkey AS read_id, max(o_orderkey) AS line, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1",
    "basename_join": f"SELECT b AS filename, min(u) AS path FROM (SELECT u, regexp_extract(u, '[^/]*$') AS b FROM {_PAGES}) WHERE b <> '' GROUP BY b",
    "path_parts": f"SELECT page_id, regexp_extract(u, '[^/]*$') AS base, regexp_extract(u, '\\.([^./]*)$', 1) AS ext, regexp_replace(u, '\\.[^./]*$', '') AS stem FROM {_PAGES}",
    "semi_targets": "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
    "topn_per_key": "SELECT l_partkey, l_orderkey, l_linenumber, l_extendedprice, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_extendedprice, l_quantity) AS k FROM lineitem) WHERE k <= 5",
    "collect_signal": """SELECT user_id, round(sum(CASE WHEN k <= 20 THEN value END), 6) AS total, 20 AS depth, round(min(value) FILTER (k = 1), 6) AS first
      FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM events) GROUP BY user_id""",
    "bedgraph_intervals": "SELECT user_id AS read_id, coalesce(lag(epoch_us(ts)) OVER w, epoch_us(ts) - 1) AS interval_start, epoch_us(ts) AS interval_end, CASE WHEN event_type IN ('click', 'view') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS p_edu FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)",
    "shards": "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 300 + 1 AS shard FROM (SELECT DISTINCT doc_id FROM documents)",
    "quantile_scaling": f"SELECT l_suppkey, round(regr_slope(y, x), 4) AS slope, round(regr_intercept(y, x), 3) AS intercept FROM (SELECT a.l_suppkey, a.m AS x, z.m AS y FROM ({_quantiles('l_quantity')}) a JOIN ({_quantiles('l_extendedprice')}) z ON a.l_suppkey = z.l_suppkey AND a.part = z.part) GROUP BY 1",
    "theil_sen": f"""WITH placed AS (
        SELECT l_suppkey, l_quantity AS x, l_extendedprice AS y, row_number() OVER (PARTITION BY l_suppkey ORDER BY {_ORDER}) - 51 AS k, count(*) OVER (PARTITION BY l_suppkey) - 100 AS n FROM lineitem),
      pts AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY k) AS o FROM placed WHERE k >= 0 AND k < n AND k % greatest(n // 1000, 1) = 0 AND k / greatest(n // 1000, 1) < 1000),
      slopes AS (SELECT a.l_suppkey, list_sort(list((a.y - b.y) / (a.x - b.x))) AS v FROM pts a JOIN pts b ON a.l_suppkey = b.l_suppkey AND a.o < b.o WHERE a.x <> b.x GROUP BY 1),
      s AS (SELECT l_suppkey, v[len(v) // 2 + 1] AS slope FROM slopes),
      i AS (SELECT l_suppkey, slope, list_sort(list(y - slope * x)) AS v FROM pts JOIN s USING (l_suppkey) GROUP BY ALL)
      SELECT l_suppkey, round(slope, 4) AS slope, round(v[len(v) // 2 + 1], 3) AS intercept FROM i""",
    "prefix_tstat": f"""WITH w AS (
        SELECT l_suppkey, row_number() OVER o - 1 AS k, count(*) OVER (PARTITION BY l_suppkey) AS n,
          sum(l_quantity) OVER (o ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) / 3 AS m1, sum(l_quantity * l_quantity) OVER (o ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) / 3 AS q1,
          sum(l_quantity) OVER (o ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) / 3 AS m2, sum(l_quantity * l_quantity) OVER (o ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) / 3 AS q2
        FROM lineitem WINDOW o AS (PARTITION BY l_suppkey ORDER BY {_ORDER})),
      t AS (SELECT l_suppkey, CASE WHEN k >= 3 AND k <= n - 3 AND n >= 6 THEN abs(m2 - m1) / sqrt(greatest(q1 - m1 * m1 + q2 - m2 * m2, 1.1754943508222875e-38) / 3) ELSE 0 END AS t FROM w)
      SELECT l_suppkey, count(*) AS n, count(*) FILTER (t > 1.4) AS above, round(max(t) FILTER (t < 1000000), 4) AS most FROM t GROUP BY 1""",
    "dbscan_noise": """WITH c AS (
        SELECT l_suppkey, l_extendedprice, CASE WHEN count(*) OVER w >= floor(count(*) OVER (PARTITION BY l_suppkey) * 0.025) THEN 1 ELSE 0 END AS core
        FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_extendedprice RANGE BETWEEN 300.0 PRECEDING AND 300.0 FOLLOWING)),
      f AS (SELECT l_suppkey, max(core) OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice RANGE BETWEEN 300.0 PRECEDING AND 300.0 FOLLOWING) = 0 AS noise FROM c)
      SELECT l_suppkey, count(*) AS n, count(*) FILTER (noise) AS noise FROM f GROUP BY 1""",
    "gmm_loglik": f"SELECT l_partkey, round(sum(ln(0.5 * {_density(15.0, 8.0)} + 0.5 * {_density(35.0, 8.0)})), 5) AS log_likelihood FROM lineitem GROUP BY 1",
    "kmer_counts": f"WITH {SEQUENCES} SELECT kmer, count(*) AS n FROM ({_kmers(5)}) GROUP BY kmer",
    "kmer_index": f"WITH {SEQUENCES} SELECT kmer, {_index('kmer', list(range(1, 10)))} AS idx, {_index('kmer', [3, 4, 5, 6, 7])} + 1 AS core, {_index('kmer', [1, 2, 8, 9])} + 1 AS residual FROM (SELECT DISTINCT kmer FROM ({_kmers(9)}))",
    "all_kmers": "SELECT CAST(i AS INTEGER) AS kmer_index, " + " || ".join(f"substr('ATGC', CAST((i // {4 ** (3 - p)}) % 4 + 1 AS BIGINT), 1)" for p in range(4)) + " AS kmer FROM (SELECT unnest(range(256)) AS i)",
    "revcomp": f"WITH {SEQUENCES} SELECT item_id, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc, CAST(length(regexp_replace(seq, '[^T]', '', 'g')) AS INTEGER) AS n_t, regexp_full_match(seq, '[ATGC]+') AS defined FROM sequences",
    "positions_of_interest": f"WITH {SEQUENCES} SELECT item_id, CAST(i AS INTEGER) AS place FROM (SELECT item_id, seq, unnest(range(24, length(seq) - 24)) AS i FROM sequences) WHERE substr(seq, i + 1, 1) = 'T'",
    "kmer_model_join": f"WITH {SEQUENCES} SELECT item_id, round(avg(({_index('kmer', [1, 2, 3, 4, 5])} % 97 + 0.5 - 10) / 2), 6) AS level FROM ({_kmers(5)}) GROUP BY item_id",
    "mm_encode": "WITH " + MARKED + " SELECT read_id, query_idx, query_idx - coalesce(lag(query_idx) OVER (PARTITION BY read_id ORDER BY query_idx) + 1, 0) AS delta FROM marked",
    "mm_roundtrip": "WITH " + MARKED + " SELECT read_id, CAST(query_idx AS INTEGER) AS query_idx, CAST(floor(p_brdu * 255) AS INTEGER) AS b, CAST(floor(p_edu * 255) AS INTEGER) AS e FROM marked",
    "ml_quantise": "WITH " + MARKED + " SELECT CAST(floor(p_edu * 255) AS INTEGER) AS value, count(*) AS n FROM marked GROUP BY 1",
    "cigar_refend": "WITH " + ALIGNMENTS + " SELECT read_id, pos + m1 + m2 + d + m3 AS ref_end, i > 2 OR d > 2 AS long_indel FROM parts",
    "cigar_map": "WITH " + ALIGNMENTS + " SELECT read_id, count(*) AS n, CAST(sum(ref_idx * query_idx) AS BIGINT) AS mix, count(*) FILTER (is_del) AS deleted FROM mapped GROUP BY read_id",
    "query_spans": "WITH " + ALIGNMENTS + " SELECT read_id, max(query_idx) FILTER (ref_idx = total - 1) - max(query_idx) FILTER (ref_idx = 0) AS query_span FROM mapped GROUP BY read_id",
    "log_space": """SELECT vec_id, round(sum(x + x * x), 5) AS total, count(*) FILTER (x > x * x) AS greater
      FROM (SELECT vec_id, abs(CAST(unnest(embedding) AS DOUBLE)) AS x FROM embeddings) GROUP BY vec_id""",
    # Probabilities of match, insertion, deletion and lead, scaled at each value; the operator adds logarithms.
    "hmm_forward": """WITH RECURSIVE m AS (
        SELECT vec_id, sign, x, n, [low + k * 0.6 / (n - 1) for k in range(n)] AS mean
        FROM (SELECT vec_id, coalesce(embedding, [])::DOUBLE[] AS x, greatest(12, (len(coalesce(embedding, [])) + 1) // 2) AS n FROM embeddings),
             (VALUES (-1, -0.3::DOUBLE), (1, -0.2::DOUBLE)) v(sign, low)
      ), f AS (
        SELECT vec_id, sign, 0 AS j, [0.0::DOUBLE for k in range(n)] AS nm, [0.0::DOUBLE for k in range(n)] AS ni,
               [0.25 * pow(0.3::DOUBLE, k) for k in range(n)] AS nd, 0.0::DOUBLE AS nl, 1.0::DOUBLE AS start, 0.0::DOUBLE AS total FROM m
        UNION ALL
        SELECT vec_id, sign, j, [v / z for v in nm], [v / z for v in ni], [v / z for v in nd], nl / z, 0.0::DOUBLE, total + ln(z)
        FROM (
          SELECT vec_id, sign, j, nm, ni, nl, total, list_sum(nm) + list_sum(ni) + nl AS z,
                 [list_sum([(CASE WHEN c = 1 THEN nl * 0.25 ELSE nm[c - 1] * 0.0025 END) * pow(0.3::DOUBLE, b - c) for c in range(1, b + 1)]) for b in range(1, n + 1)] AS nd
          FROM (
            SELECT vec_id, sign, f.j + 1 AS j, n, total, (start + nl) * 0.25 AS nl, [ni[b] * 0.001 + nm[b] * 0.001 for b in range(1, n + 1)] AS ni,
                   [exp(-12.5 * pow(x[f.j + 1] - mean[b], 2)) / (0.2 * sqrt(2 * pi())) * CASE WHEN b = 1 THEN (start + nl) * 0.5 + nm[1] / 3
                     ELSE ni[b - 1] * 0.999 + nm[b - 1] * (2.0 / 3 - 0.0035) + nm[b] / 3 + nd[b - 1] * 0.7 END for b in range(1, n + 1)] AS nm
            FROM f JOIN m USING (vec_id, sign) WHERE f.j < len(x)
          )
        )
      )
      SELECT vec_id, round(sum(sign * (total + ln(nd[n] + nm[n] * (2.0 / 3 - 0.001) + ni[n] * 0.999))), 6) AS log_ratio
      FROM f JOIN m USING (vec_id, sign) WHERE j = len(x) GROUP BY vec_id""",
    "stream_tumbling": f"SELECT w AS window_start, w + {DAY} AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT epoch_us(ts) // {DAY} * {DAY} AS w, event_type, value FROM events) GROUP BY w, event_type",
    "stream_sliding": f"SELECT w AS window_start, w + {DAY} AS window_end, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT (epoch_us(ts) // {DAY // 2} - unnest([0, 1])) * {DAY // 2} AS w, value FROM events) GROUP BY w",
    "stream_session": f"""SELECT min(t) AS window_start, max(t) + {DAY // 4} AS window_end, user_id, count(*) AS n FROM (
        SELECT user_id, t, sum(opens) OVER (PARTITION BY user_id ORDER BY t) AS s FROM (
          SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < {DAY // 4} THEN 0 ELSE 1 END AS opens FROM events)) GROUP BY user_id, s""",
    "stream_fractions": "WITH RECURSIVE " + FRACTIONS + " SELECT read_id, start, n, round(brdu_fraction, 6) AS brdu_fraction, round(edu_fraction, 6) AS edu_fraction FROM fr",
}
