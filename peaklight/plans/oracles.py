"""DuckDB SQL with the results of the queries, on the same tables."""

LONG = "lib AS (SELECT vec_id AS row_id, label, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings)"
Q = "q AS (SELECT pos, v AS qv FROM lib WHERE row_id = 0)"
#: Support of a library row at a point: its ends, and a gap of three points in two of three rows.
SUPPORT = "(pos BETWEEN row_id % 8 AND 63 - row_id % 5 AND (row_id % 3 = 0 OR NOT pos BETWEEN 20 + row_id % 7 AND 22 + row_id % 7))"
MASK = "(pos BETWEEN 2 AND 61)"
SIG = "sig AS (SELECT user_id AS signal, (epoch_us(ts) - 1704067200000000) / 3.6e9 AS x, value AS y FROM events)"


def _screen(common: str) -> str:
    return f"""
  WITH {LONG}, {Q}, c AS (SELECT row_id, label, v, qv FROM lib JOIN q USING (pos) WHERE {common}),
  o AS (SELECT row_id, label, v - min(v) OVER w AS a, qv - min(qv) OVER w AS b FROM c WINDOW w AS (PARTITION BY row_id)),
  s AS (SELECT row_id, label, sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))) AS screen FROM o GROUP BY ALL HAVING count(*) >= 2 AND sum(a * a) * sum(b * b) > 0)"""


ALIGN = f"""
WITH {LONG}, {Q},
lib2 AS (SELECT row_id, pos, v, {SUPPORT} AS s,
  CASE WHEN pos = 0 THEN lead(v) OVER w - v WHEN pos = 63 THEN v - lag(v) OVER w ELSE (lead(v) OVER w - lag(v) OVER w) / 2 END AS g FROM lib WINDOW w AS (PARTITION BY row_id ORDER BY pos)),
q2 AS (SELECT pos, qv, {MASK} AS m, CASE WHEN pos = 0 THEN lead(qv) OVER w - qv WHEN pos = 63 THEN qv - lag(qv) OVER w ELSE (lead(qv) OVER w - lag(qv) OVER w) / 2 END AS qg FROM q WINDOW w AS (ORDER BY pos)),
k AS (SELECT unnest(range(-5, 6)) AS shift),
sh AS (SELECT row_id, shift, pos + shift AS pos, v, g FROM lib2, k WHERE s),
c AS (SELECT row_id, shift, pos, v, g, qv, qg FROM sh JOIN q2 USING (pos) WHERE m),
o AS (SELECT *, v - min(v) OVER w AS a, qv - min(qv) OVER w AS b,
  coalesce(lag(pos) OVER w2 = pos - 1 AND lead(pos) OVER w2 = pos + 1, false) AS inner_point
  FROM c WINDOW w AS (PARTITION BY row_id, shift), w2 AS (PARTITION BY row_id, shift ORDER BY pos)),
f AS (SELECT row_id, shift, count(*) AS common,
  CASE WHEN count(*) >= 2 AND sum(a * a) * sum(b * b) > 0 THEN sum(a * b) / sqrt(sum(a * a) * sum(b * b)) ELSE -1 END AS shape,
  CASE WHEN count(*) FILTER (inner_point) >= 2 AND sum(g * g) FILTER (inner_point) * sum(qg * qg) FILTER (inner_point) > 0
    THEN sum(g * qg) FILTER (inner_point) / sqrt(sum(g * g) FILTER (inner_point) * sum(qg * qg) FILTER (inner_point)) ELSE -1 END AS gradient
  FROM o GROUP BY ALL),
r AS (SELECT *, 0.8 * shape + 0.2 * gradient AS similarity, row_number() OVER (PARTITION BY row_id ORDER BY round(0.8 * shape + 0.2 * gradient, 11) DESC, common DESC, abs(shift), shift) AS n FROM f),
best AS (SELECT * FROM r WHERE n = 1 AND similarity >= 0)
"""

COVERAGE = f"cov AS (SELECT row_id, count(*) FILTER ({MASK})::BIGINT AS requested, count(*) FILTER ({MASK} AND {SUPPORT})::BIGINT AS covered FROM lib GROUP BY row_id)"

TRACES = (
    _screen(f"{SUPPORT} AND {MASK}")
    + f""",
{COVERAGE},
traces AS (SELECT s.row_id, 'Phase ' || label AS name, 'phase ' || label AS phase_key, (s.row_id % 7)::VARCHAR AS spec, (s.row_id % 3)::VARCHAR AS acq, 'ref' || lpad(s.row_id::VARCHAR, 8, '0') AS ref,
  round(screen, 6) AS rank_score, covered / requested AS coverage, covered AS common, s.row_id % 11 = 0 AS boundary, s.row_id % 13 = 0 AS clipped, (s.row_id % 97) / 97 AS pcs FROM s JOIN cov USING (row_id)),
a AS (SELECT phase_key, spec, acq, avg(rank_score) AS score, max(rank_score) AS best, arg_min(ref, (-rank_score, ref)) AS ref, avg(coverage) AS mean_coverage, min(coverage) AS min_coverage, min(common) AS min_common, bool_or(boundary) AS boundary, bool_or(clipped) AS clipped FROM traces GROUP BY ALL),
sp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY phase_key, spec ORDER BY score DESC, best DESC, ref DESC) AS n1 FROM a) WHERE n1 = 1),
two AS (SELECT *, row_number() OVER (PARTITION BY phase_key ORDER BY score DESC, best DESC, ref) AS n2 FROM sp),
ph AS (SELECT phase_key, max(score) AS aggregate_score, median(score) AS median_group_score, avg(mean_coverage) FILTER (n2 <= 2) AS mean_coverage_fraction, min(min_coverage) FILTER (n2 <= 2) AS minimum_group_coverage_fraction,
  min(min_common) FILTER (n2 <= 2)::BIGINT AS minimum_group_common_point_count, count(*) AS independent_reference_count, count(*) FILTER (n2 <= 2 AND boundary) AS shift_boundary_group_count, count(*) FILTER (n2 <= 2 AND clipped) AS grid_boundary_clipped_group_count FROM two GROUP BY phase_key),
tr AS (SELECT phase_key, max(rank_score) AS best_reference_score, count(*) AS reference_variant_count, arg_min(name, row_id) AS phase_name, arg_min(row_id, (-rank_score, ref)) AS best_row_id FROM traces GROUP BY phase_key),
phases AS (SELECT *, row_number() OVER (ORDER BY aggregate_score DESC, median_group_score DESC, best_reference_score DESC, phase_key) AS phase_rank FROM ph JOIN tr USING (phase_key)),
b AS (SELECT * FROM phases WHERE phase_rank = 1), r AS (SELECT * FROM phases WHERE phase_rank = 2),
verdict AS (SELECT b.*, r.phase_name AS runner_up_phase, r.aggregate_score AS runner_up_score, b.aggregate_score - r.aggregate_score AS score_margin,
  list_filter([CASE WHEN b.minimum_group_common_point_count < 50 THEN 'too_few_common_points' END, CASE WHEN b.minimum_group_coverage_fraction < 0.8 THEN 'insufficient_minimum_group_coverage' END], lambda z: z IS NOT NULL) AS weak,
  list_filter([CASE WHEN NOT coalesce(r.minimum_group_common_point_count >= 50 AND r.minimum_group_coverage_fraction >= 0.8, false) THEN 'phase_separation_not_assessed' WHEN b.aggregate_score - r.aggregate_score < 0.05 THEN 'leading_phase_margin_too_small' END,
    CASE WHEN b.independent_reference_count < 2 THEN 'too_few_independent_references' END, CASE WHEN b.shift_boundary_group_count > 0 THEN 'leading_phase_has_shift_search_boundary_evidence' END,
    CASE WHEN b.grid_boundary_clipped_group_count > 0 THEN 'leading_phase_has_grid_clipped_reference_support' END], lambda z: z IS NOT NULL) AS unclear
  FROM b LEFT JOIN r ON true),
decision AS (SELECT CASE WHEN len(weak) > 0 THEN 'insufficient_evidence' WHEN aggregate_score < 0.8 THEN 'unknown_or_out_of_library' WHEN len(unclear) > 0 THEN 'ambiguous' ELSE 'supported_candidate' END AS status,
  phase_name AS best_phase, aggregate_score AS best_score, runner_up_phase, runner_up_score, score_margin,
  CASE WHEN len(weak) > 0 THEN array_to_string(weak, ',') WHEN aggregate_score < 0.8 THEN 'phase_score_below_uncalibrated_guardrail' WHEN len(unclear) > 0 THEN array_to_string(unclear, ',') ELSE 'uncalibrated_evidence_guardrails_passed' END AS reasons FROM verdict)
"""
)

#: What a log of approvals leaves: per stage the events since the last change of the one before it, and in these the last change.
CHAIN = """
WITH e AS (SELECT conv_id AS k, turn AS t, role AS s, (length(text) % 4)::VARCHAR AS c FROM conversations),
a0 AS (SELECT k, t, coalesce(c, '') AS c, '' AS g FROM e WHERE s = 'system'),
b0 AS (SELECT k, max(t) FILTER (c IS DISTINCT FROM p) AS since, arg_max(c, t) AS now, any_value(g) AS g FROM (SELECT *, lag(c) OVER (PARTITION BY k ORDER BY t) AS p FROM a0) GROUP BY k),
c0 AS (SELECT k, since, g AS parent, sha1(concat_ws('|', g, 'system', now)) AS g FROM b0),
a1 AS (SELECT e.k, t, coalesce(c, '') AS c, g FROM e JOIN c0 ON c0.k = e.k AND t > since WHERE s = 'user'),
b1 AS (SELECT k, max(t) FILTER (c IS DISTINCT FROM p) AS since, arg_max(c, t) AS now, any_value(g) AS g FROM (SELECT *, lag(c) OVER (PARTITION BY k ORDER BY t) AS p FROM a1) GROUP BY k),
c1 AS (SELECT k, since, g AS parent, sha1(concat_ws('|', g, 'user', now)) AS g FROM b1),
a2 AS (SELECT e.k, t, coalesce(c, '') AS c, g FROM e JOIN c1 ON c1.k = e.k AND t > since WHERE s = 'assistant'),
b2 AS (SELECT k, max(t) FILTER (c IS DISTINCT FROM p) AS since, arg_max(c, t) AS now, any_value(g) AS g FROM (SELECT *, lag(c) OVER (PARTITION BY k ORDER BY t) AS p FROM a2) GROUP BY k),
c2 AS (SELECT k, since, g AS parent, sha1(concat_ws('|', g, 'assistant', now)) AS g FROM b2)
SELECT k AS conv_id, 'system' AS stage, 0::BIGINT AS place, parent, g AS signature FROM c0 UNION ALL SELECT k, 'user', 1, parent, g FROM c1 UNION ALL SELECT k, 'assistant', 2, parent, g FROM c2
"""

ELEMENTS = """
WITH f AS (SELECT p_partkey AS row_id, p_name AS name, p_size % 3 = 0 AS already_processed,
  CASE WHEN p_partkey % 9 = 0 THEN '?' ELSE upper(p_name[1]) || lower(p_name[2]) || '2' || upper(p_type[1]) || lower(p_type[2]) || 'O' || (p_size % 4) END AS formula FROM part),
e AS (SELECT *, CASE WHEN formula = '?' THEN []::VARCHAR[] ELSE list_sort(list_distinct(regexp_extract_all(formula, '([A-Z][a-z]?)', 1))) END AS elements, formula <> '?' AS has_formula FROM f)
"""

FILES = """
WITH rows AS (SELECT user_id AS path, event_id, round(value, 2) AS y, user_id % 4 AS kind FROM events)
"""

STEPS = f"""
WITH {SIG}, d AS (SELECT *, x - lag(x) OVER (PARTITION BY signal ORDER BY x) AS dx FROM sig),
m AS (SELECT signal, median(dx) FILTER (dx > 0) AS med FROM d GROUP BY signal),
g AS (SELECT d.*, med, greatest(5 * med, med + 10) AS lim FROM d JOIN m USING (signal)),
seg AS (SELECT *, sum(CASE WHEN dx > lim THEN 1 ELSE 0 END) OVER (PARTITION BY signal ORDER BY x)::BIGINT AS segment FROM g)
"""

HEADERS = """
SELECT p_partkey AS row_id, p_name AS name, 'Fe2O' || (p_size % 5) AS formula, 'R' || lpad(p_partkey::VARCHAR, 6, '0') AS reference_id, 514.5::DOUBLE AS wavelength, 'c axis' AS orientation,
  CASE WHEN p_partkey % 2 = 0 THEN 'raw' ELSE 'processed' END AS processing, CASE WHEN p_partkey % 3 = 0 THEN 'excellent' ELSE 'fair' END AS quality,
  CASE WHEN p_partkey % 3 = 0 THEN 'oriented' ELSE 'unoriented' END AS sample_orientation, p_partkey % 2 = 1 AS already_processed, 'Quartz__R' || p_partkey || '__Raman__514-5__90-000__ccw' AS acquisition FROM part
"""

#: Window 5, order 3; needs v, the list of each row's values.
SMOOTHED = """smoothed AS (SELECT row_id, unnest(range(0, 64))::BIGINT AS pos, unnest(list_concat(
  [(69 * v[1] + 4 * v[2] - 6 * v[3] + 4 * v[4] - v[5]) / 70, (2 * v[1] + 27 * v[2] + 12 * v[3] - 8 * v[4] + 2 * v[5]) / 35],
  list_transform(range(3, 63), lambda i: (-3 * v[i - 2] + 12 * v[i - 1] + 17 * v[i] + 12 * v[i + 1] - 3 * v[i + 2]) / 35),
  [(2 * v[60] - 8 * v[61] + 12 * v[62] + 27 * v[63] + 2 * v[64]) / 35, (-v[60] + 4 * v[61] - 6 * v[62] + 4 * v[63] + 69 * v[64]) / 70])) AS y FROM v)"""

ORACLE_SQL = {
    "screen_topk": _screen("true") + " SELECT row_id, 'Phase ' || label AS name, round(screen, 6) AS screen FROM s ORDER BY s.screen DESC, row_id LIMIT 50",
    "screen_topk_ranged": _screen(f"{SUPPORT} AND {MASK}") + " SELECT row_id, 'Phase ' || label AS name, round(screen, 6) AS screen FROM s ORDER BY s.screen DESC, row_id LIMIT 50",
    "index_screen": f"""
WITH {LONG}, c AS (SELECT a.row_id AS query, b.row_id, b.label, b.v, a.v AS qv FROM lib a JOIN lib b USING (pos) WHERE a.row_id % 50 = 0
  AND pos BETWEEN 2 AND 61 AND pos BETWEEN b.row_id % 8 AND 63 - b.row_id % 5 AND (b.row_id % 3 = 0 OR NOT pos BETWEEN 20 + b.row_id % 7 AND 22 + b.row_id % 7)),
o AS (SELECT query, row_id, label, v - min(v) OVER w AS a, qv - min(qv) OVER w AS b FROM c WINDOW w AS (PARTITION BY query, row_id)),
s AS (SELECT query, row_id, label, round(sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))), 9) AS screen FROM o GROUP BY ALL HAVING count(*) >= 2 AND sum(a * a) * sum(b * b) > 0)
SELECT query, row_number() OVER (PARTITION BY query ORDER BY s.screen DESC, row_id) AS rank, row_id, 'Phase ' || label AS name, round(s.screen, 6) AS screen FROM s
QUALIFY row_number() OVER (PARTITION BY query ORDER BY s.screen DESC, row_id) <= 50""",
    "coverage_filter": f"""WITH {LONG}, c AS (SELECT row_id, count(*) FILTER (pos BETWEEN 3 AND 58) AS requested, count(*) FILTER (pos BETWEEN 3 AND 58 AND {SUPPORT}) AS covered FROM lib GROUP BY row_id)
SELECT row_id, requested, covered, round(covered / requested, 6) AS coverage FROM c WHERE covered / requested >= 0.85""",
    "legacy_rank": f"""WITH {LONG}, n AS (SELECT row_id, pos, (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) AS v FROM lib WINDOW w AS (PARTITION BY row_id))
SELECT a.row_id, round(sum(a.v * b.v) / (sqrt(sum(a.v * a.v)) * sqrt(sum(b.v * b.v))), 6) AS score FROM n a JOIN n b ON a.pos = b.pos AND b.row_id = 0 GROUP BY a.row_id ORDER BY score DESC, row_id LIMIT 30""",
    "shift_align": ALIGN
    + f""", ends AS (SELECT row_id, min(pos) AS a, max(pos) AS z FROM lib2 WHERE s GROUP BY row_id)
SELECT row_id, shift::BIGINT AS shift, common, round(similarity, 6) AS similarity, round(shape, 6) AS shape, round(gradient, 6) AS gradient, abs(shift) = 5 AS shift_boundary, a + shift < 0 OR z + shift > 63 AS grid_clipped FROM best JOIN ends USING (row_id)""",
    "rank_components": ALIGN + "SELECT row_id, round(0.88 * similarity, 6) AS similarity_part, round((0.12 * (row_id % 100) / 100)::DOUBLE, 6) AS pcs_part, round(0.88 * similarity + 0.12 * (row_id % 100) / 100, 6) AS composed, round(0.88 * similarity + 0.12 * (row_id % 100) / 100, 6) AS final, true AS consistent FROM best",
    "phase_rollup": TRACES
    + """SELECT phase_rank, phase_key, phase_name, best_row_id, round(aggregate_score, 6) AS aggregate_score, round(median_group_score, 6) AS median_group_score, round(best_reference_score, 6) AS best_reference_score, round(mean_coverage_fraction, 6) AS mean_coverage_fraction,
  round(minimum_group_coverage_fraction, 6) AS minimum_group_coverage_fraction, minimum_group_common_point_count, independent_reference_count, reference_variant_count, shift_boundary_group_count, grid_boundary_clipped_group_count FROM phases""",
    "evidence_decision": TRACES + "SELECT status, best_phase, runner_up_phase, round(best_score, 6) AS best_score, round(runner_up_score, 6) AS runner_up_score, round(score_margin, 6) AS score_margin, reasons FROM decision",
    "annotate_traces": TRACES
    + "SELECT row_id, phase_key, phase_rank, round(aggregate_score, 6) AS phase_score, round(rank_score, 6) AS rank_score, independent_reference_count AS phase_specimens, status AS evidence_status FROM traces JOIN phases USING (phase_key), decision",
    "diverse_topn": TRACES
    + """, an AS (SELECT row_id, t.phase_key, round(aggregate_score, 6) AS phase_score, rank_score, pcs, 'id' || (row_id % 400) AS ident FROM traces t JOIN phases USING (phase_key)),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ident ORDER BY phase_score DESC, rank_score DESC, pcs DESC, row_id) AS i FROM an) WHERE i = 1),
n AS (SELECT *, row_number() OVER (PARTITION BY phase_key ORDER BY phase_score DESC, rank_score DESC, pcs DESC, row_id) > 5 AS late FROM u),
ch AS (SELECT *, row_number() OVER (ORDER BY late, phase_score DESC, rank_score DESC, pcs DESC, row_id) AS spot FROM n QUALIFY spot <= 40),
fr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY phase_key ORDER BY pcs DESC, rank_score DESC, phase_score DESC, row_id) AS p FROM n) WHERE p = 1 AND phase_key NOT IN (SELECT phase_key FROM ch) AND pcs >= 0.52 AND rank_score >= 0.3 ORDER BY pcs DESC, rank_score DESC, phase_score DESC, row_id LIMIT 8),
al AS (SELECT row_id, phase_key, phase_score, rank_score, pcs FROM ch WHERE spot <= 40 - (SELECT count(*) FROM fr) UNION ALL SELECT row_id, phase_key, phase_score, rank_score, pcs FROM fr)
SELECT row_number() OVER (ORDER BY phase_score DESC, rank_score DESC, pcs DESC, row_id) AS place, row_id, phase_key, round(rank_score, 6) AS rank_score, round(pcs, 6) AS pcs FROM al""",
    "residual_projection": f"""WITH {LONG}, {Q},
p AS (SELECT row_id, pos, qv AS q, v AS c, {MASK} AS m, {MASK} AND {SUPPORT} AS k FROM lib JOIN q USING (pos)),
f AS (SELECT row_id, sum(q * c) AS qc, sum(c * c) AS cc, sum(q * q) AS before, count(*) AS common_points, max(abs(q)) AS amp FROM p WHERE k GROUP BY row_id HAVING count(*) >= 20 AND sum(c * c) > 1e-12),
e AS (SELECT *, m AND lag(m) OVER w AND k <> lag(k) OVER w AS edge FROM p WINDOW w AS (PARTITION BY row_id ORDER BY pos)),
u AS (SELECT *, m AND NOT coalesce(bool_or(edge) OVER (PARTITION BY row_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 3 FOLLOWING), false) AS usable FROM e),
r AS (SELECT u.*, amp, before, common_points, greatest(0, qc / cc) AS scale, CASE WHEN NOT m THEN 0 WHEN k THEN q - greatest(0, qc / cc) * c ELSE q END AS res FROM u JOIN f USING (row_id)),
s AS (SELECT row_id, any_value(common_points) AS common_points, any_value(scale) AS scale, any_value(before) AS before, sum(res * res) FILTER (k) AS after, avg((res < -1e-6 * greatest(1e-12, amp))::INT) FILTER (k) AS np,
  coalesce(sum(res * res) FILTER (k AND res < -1e-6 * greatest(1e-12, amp)), 0) AS ne, count(*) FILTER (usable) AS usable, max(abs(res)) FILTER (usable) AS top, sum(abs(res)) FILTER (usable) AS size FROM r GROUP BY row_id)
SELECT row_id, common_points, round(scale, 6) AS scale, round(CASE WHEN before > 1e-12 THEN greatest(0, least(1, (before - after) / before)) ELSE 0 END, 6) AS improvement, round(np, 6) AS negative_points,
  round(CASE WHEN after > 1e-12 THEN ne / after ELSE 0 END, 6) AS negative_energy, CASE WHEN before > 1e-12 THEN greatest(0, least(1, (before - after) / before)) ELSE 0 END >= 0.02 AS worth, usable, round(CASE WHEN top > 1e-12 THEN size / top ELSE 0 END, 6) AS matching_size FROM s""",
    "gap_segments": STEPS + "SELECT signal, segment, count(*) AS points, round(min(x), 6) AS start, round(max(x), 6) AS \"end\" FROM seg GROUP BY ALL",
    "resample_grid": STEPS
    + """, sp AS (SELECT signal, segment, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1, row_number() OVER w AS n FROM seg WINDOW w AS (PARTITION BY signal, segment ORDER BY x)),
c AS (SELECT *, unnest(range((CASE WHEN n = 1 THEN ceil(x0 / 4 - 1e-9) ELSE floor(x0 / 4 + 1e-9) + 1 END)::BIGINT, floor(x1 / 4 + 1e-9)::BIGINT + 1)) AS grid FROM sp WHERE x1 IS NOT NULL)
SELECT signal, segment, grid, round(grid * 4.0::DOUBLE, 6) AS x, round(y0 + (y1 - y0) * (least(greatest(grid * 4.0, x0), x1) - x0) / (x1 - x0), 6) AS y FROM c""",
    "axis_quality": STEPS
    + """, t AS (SELECT *, max(y) OVER w AS ymax, min(y) OVER w AS ymin FROM g WINDOW w AS (PARTITION BY signal)),
a AS (SELECT signal, count(*) AS point_count, min(x) AS minimum, max(x) AS maximum, any_value(med) AS median_spacing, stddev_pop(dx) FILTER (dx > 0) / any_value(med) AS spacing_cv, count(*) FILTER (dx = 0) AS duplicate_count, count(*) FILTER (dx > lim) AS gap_count,
  avg((abs(y - ymax) <= greatest(1e-12, (ymax - ymin) * 1e-8))::INT) AS saturation_fraction FROM t GROUP BY signal)
SELECT signal, point_count, round(minimum, 6) AS minimum, round(maximum, 6) AS maximum, round(median_spacing, 6) AS median_spacing, round(spacing_cv, 6) AS spacing_cv, duplicate_count, gap_count, round(saturation_fraction, 6) AS saturation_fraction,
  concat_ws('; ', CASE WHEN spacing_cv > 0.25 THEN 'irregular spacing' END, CASE WHEN duplicate_count > 0 THEN 'duplicates are averaged' END, CASE WHEN gap_count > 0 THEN 'gaps are not bridged' END, CASE WHEN saturation_fraction >= 0.01 AND point_count >= 50 THEN 'saturation suspected' END, CASE WHEN point_count < 30 THEN 'too few points' END) AS warnings FROM a""",
    "duplicate_mean": f"WITH {SIG} SELECT signal, floor(x / 12)::BIGINT AS x, count(*) AS n_merged, round(avg(y), 6) AS y FROM sig GROUP BY signal, floor(x / 12)",
    "normalise": f"""WITH {LONG}, s AS (SELECT row_id, min(v) AS lo, max(v) AS hi, max(abs(v)) AS ab, sum(v) AS t, max(v) FILTER (pos = 5) AS v5 FROM lib GROUP BY row_id)
SELECT row_id, round((v5 - lo) / (hi - lo), 6) AS minmax_5, round(v5 / CASE WHEN hi > 1e-12 THEN hi ELSE ab END, 6) AS peak_5, round((v5 - lo) / (hi - lo) * 1000, 6) AS scaled_5, round((t - 64 * lo) / (hi - lo), 6) AS minmax_sum FROM s""",
    "noise_sigma": f"""WITH {SIG}, d AS (SELECT signal, y - lag(y) OVER (PARTITION BY signal ORDER BY x) AS d FROM sig), m AS (SELECT signal, median(d) AS m FROM d WHERE d IS NOT NULL GROUP BY signal)
SELECT signal, count(*) AS steps, round(1.4826 * median(abs(d - m)) / sqrt(2), 6) AS sigma FROM d JOIN m USING (signal) WHERE d IS NOT NULL GROUP BY signal""",
    "rolling_median": f"""WITH {SIG}, w AS (SELECT signal, x, median(y) OVER f AS med, count(*) OVER f AS n FROM sig WINDOW f AS (PARTITION BY signal ORDER BY x ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))
SELECT signal, round(x, 6) AS x, round(med, 6) AS median FROM w WHERE n = 7""",
    "spikes": f"""WITH {SIG}, r AS (SELECT *, y - list_sort([coalesce(lag(y, 2) OVER w, 0), coalesce(lag(y) OVER w, 0), y, coalesce(lead(y) OVER w, 0), coalesce(lead(y, 2) OVER w, 0)])[3] AS r, row_number() OVER w - 1 AS i FROM sig WINDOW w AS (PARTITION BY signal ORDER BY x)),
a AS (SELECT signal, median(r) AS m, max(y) - min(y) AS rng, count(*) AS n FROM r GROUP BY signal), b AS (SELECT signal, 1.4826 * median(abs(r - m)) AS s FROM r JOIN a USING (signal) GROUP BY signal)
SELECT signal, i AS index, round(x, 6) AS x, round(y, 6) AS y, round(r, 6) AS excess FROM r JOIN a USING (signal) JOIN b USING (signal) WHERE n >= 7 AND rng > 0 AND r > greatest(8 * greatest(s, rng * 1e-8), 0.04 * rng) QUALIFY row_number() OVER (PARTITION BY signal ORDER BY x) <= 100""",
    "zero_trim": f"WITH {SIG} SELECT signal, round(min(x) FILTER (y > 60), 6) AS first_x, round(max(x) FILTER (y > 60), 6) AS last_x, count(*) AS points, count(*) FILTER (y > 60) AS above FROM sig GROUP BY signal",
    "first_jump": f"""WITH {SIG}, d AS (SELECT *, abs(y - lag(y) OVER (PARTITION BY signal ORDER BY x)) AS d, min(x) OVER (PARTITION BY signal) AS x0 FROM sig)
SELECT signal, round(min(x) FILTER (d >= 50 AND x - x0 <= 250), 6) AS jump_x, round(arg_min(d, x) FILTER (d >= 50 AND x - x0 <= 250), 6) AS jump FROM d GROUP BY signal""",
    "peak_so_far": f"WITH {SIG} SELECT signal, round(x, 6) AS x, round(max(CASE WHEN x >= 240 THEN y END) OVER (PARTITION BY signal ORDER BY x ROWS UNBOUNDED PRECEDING), 6) AS peak_so_far FROM sig",
    "local_peaks": f"""WITH {LONG}, n AS (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b, max(v) OVER (PARTITION BY row_id) AS top FROM lib WINDOW w AS (PARTITION BY row_id ORDER BY pos))
SELECT row_id, pos, round(v, 6) AS v, round(v - greatest(a, b), 6) AS weight FROM n WHERE v > a AND v >= b AND v - greatest(a, b) >= greatest(1e-6, 0.03 * top)""",
    "spearman": f"""WITH {LONG}, p AS (SELECT l.row_id, l.pos, round(l.v, 1) AS v, round(q.v, 1) AS q FROM lib l JOIN lib q ON q.row_id = 0 AND q.pos = l.pos),
r AS (SELECT row_id, rank() OVER (PARTITION BY row_id ORDER BY v) + (count(*) OVER (PARTITION BY row_id, v) - 1) / 2 AS a, rank() OVER (PARTITION BY row_id ORDER BY q) + (count(*) OVER (PARTITION BY row_id, q) - 1) / 2 AS b FROM p)
SELECT row_id, round(corr(a, b), 6) AS rho FROM r GROUP BY row_id""",
    "support_geometry": f"""WITH {LONG}, m AS (SELECT row_id, pos, {SUPPORT} OR pos BETWEEN row_id % 40 AND row_id % 40 + 6 AS s FROM lib), n AS (SELECT *, lag(s) OVER w AS a, lead(s) OVER w AS b FROM m WINDOW w AS (PARTITION BY row_id ORDER BY pos))
SELECT row_id, count(*) FILTER (s AND NOT coalesce(a, false)) AS runs, count(*) FILTER (s) AS points, count(*) FILTER (s AND coalesce(a, false) AND coalesce(b, false)) AS gradient_points FROM n GROUP BY row_id""",
    "true_runs": f"""WITH {LONG}, i AS (SELECT row_id, pos, pos - row_number() OVER (PARTITION BY row_id ORDER BY pos) AS g FROM lib WHERE v > 0)
SELECT row_id, min(pos) AS start, max(pos) AS "end", count(*) AS points FROM i GROUP BY row_id, g""",
    "gradient": f"""WITH {LONG}, s AS (SELECT row_id, pos, coalesce(lag(v, 2) OVER w, 0) AS v FROM lib WINDOW w AS (PARTITION BY row_id ORDER BY pos)),
g AS (SELECT row_id, CASE WHEN pos = 0 THEN lead(v) OVER w - v WHEN pos = 63 THEN v - lag(v) OVER w ELSE (lead(v) OVER w - lag(v) OVER w) / 2 END AS g FROM s WINDOW w AS (PARTITION BY row_id ORDER BY pos))
SELECT row_id, round(sum(abs(g)), 6) AS variation, round(max(g), 6) AS steepest FROM g GROUP BY row_id""",
    "subtract_reference": f"""WITH {LONG}, m AS (SELECT label, pos, avg(v) AS m FROM lib GROUP BY ALL)
SELECT row_id AS signal, round(sum(v - 0.5 * m), 6) AS sum_y, 0.75::DOUBLE AS overlap, count(*) AS points FROM lib JOIN m USING (label, pos) WHERE pos % 4 <> 3 GROUP BY row_id""",
    "element_filter_all": ELEMENTS + "SELECT row_id, formula, array_to_string(elements, ',') AS elements FROM e WHERE NOT has_formula OR (NOT list_contains(elements, 'Sm') AND list_has_all(elements, ['O', 'Re']))",
    "element_filter_only": ELEMENTS + "SELECT row_id, formula, array_to_string(elements, ',') AS elements FROM e WHERE has_formula AND NOT already_processed AND list_has_all(['O', 'Re', 'Bl', 'Ec', 'Sm', 'St'], elements)",
    "element_filter_exact": ELEMENTS + "SELECT row_id, formula, array_to_string(elements, ',') AS elements FROM e WHERE has_formula AND elements = ['Ec', 'O', 'Re']",
    "element_index": ELEMENTS + ", x AS (SELECT row_id, unnest(elements) AS element FROM e) SELECT element, count(*) AS rows, min(row_id) AS first_row, max(row_id) AS last_row FROM x GROUP BY element",
    "posting_filter_all": ELEMENTS + "SELECT row_id FROM e WHERE NOT has_formula OR (NOT list_contains(elements, 'Sm') AND list_has_all(elements, ['O', 'Re']))",
    "posting_filter_only": ELEMENTS + "SELECT row_id FROM e WHERE has_formula AND NOT already_processed AND list_has_all(['O', 'Re', 'Bl', 'Ec', 'Sm', 'St'], elements)",
    "posting_filter_exact": ELEMENTS + "SELECT row_id FROM e WHERE has_formula AND elements = ['Ec', 'O', 'Re']",
    "posting_counts": ELEMENTS + ", x AS (SELECT row_id, unnest(elements) AS element FROM e) SELECT element, count(*) AS rows, count(DISTINCT CASE WHEN row_id > 0 THEN 1 + (row_id - 1) // 32768 ELSE 0 END) AS buckets FROM x GROUP BY element",
    "posting_join": ELEMENTS + "SELECT row_id, name, formula FROM e WHERE has_formula AND NOT already_processed AND NOT list_contains(elements, 'Sm')",
    "formula_display": ELEMENTS + "SELECT row_id, translate(formula, '0123456789', '₀₁₂₃₄₅₆₇₈₉') AS shown FROM e",
    "phase_keys": """WITH n AS (SELECT p_partkey, CASE WHEN p_partkey % 50 = 0 THEN '?' ELSE lower(p_name) || ' ' || lower(p_brand) END AS phase_key, regexp_replace(upper(p_name) || '   ' || lower(p_brand), '[^A-Za-z0-9._-]+', '_', 'g') AS slug FROM part)
SELECT phase_key, count(*) AS rows, min(slug) AS slug, min(p_partkey) AS first_row FROM n GROUP BY phase_key""",
    "background_neutral": ELEMENTS + "SELECT row_id, name, already_processed FROM e WHERE already_processed UNION ALL SELECT row_id, name, already_processed FROM e WHERE NOT already_processed AND row_id % 2 = 0",
    "provenance_parse": HEADERS,
    "numeric_body": "SELECT p_partkey AS row_id, 2::BIGINT AS points, 100.5::DOUBLE AS x0, p_partkey::DOUBLE AS y0, 7.0::DOUBLE AS y1 FROM part",
    "delimiter_detect": FILES + "SELECT path, CASE kind WHEN 0 THEN 'comma' WHEN 1 THEN 'tab' WHEN 2 THEN 'semicolon' ELSE 'whitespace' END AS delimiter, count(*) AS numeric_rows FROM rows GROUP BY path, kind",
    "measurement_parse": """WITH a AS (SELECT user_id AS path, count(*) AS points, sum(value) AS t, min(event_id)::DOUBLE AS x0 FROM events GROUP BY ALL)
SELECT path, points, CASE WHEN path % 7 = 0 THEN 'not numeric: line ' || (points + 3) WHEN points < 2 THEN 'fewer than two different x' ELSE '' END AS error,
  CASE WHEN path % 7 = 0 OR points < 2 THEN 0 ELSE points END AS kept, CASE WHEN path % 7 <> 0 AND points >= 2 THEN round(t, 4) END AS total, CASE WHEN path % 7 <> 0 AND points >= 2 THEN x0 END AS x0 FROM a""",
    "spectrum_text": """SELECT user_id AS path, sha256('#head' || chr(10) || string_agg(printf('%.3f', event_id::DOUBLE) || chr(9) || printf('%.3f', value), chr(10) ORDER BY event_id)) AS sha FROM events WHERE user_id % 7 <> 0 GROUP BY user_id HAVING count(*) >= 2""",
    "catalog_summary": """SELECT CASE WHEN grouping(p_brand) = 1 THEN 'all' ELSE p_brand END AS source, count(*) AS rows, count(DISTINCT lower(p_name)) AS names, count(DISTINCT (lower(p_name), p_type)) AS names_and_formulas FROM part GROUP BY ROLLUP (p_brand)""",
    "unique_names": """WITH n AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS n FROM part) SELECT lower(n) AS key, arg_min(n, p_partkey) AS name, count(*) AS rows FROM n GROUP BY lower(n)""",
    "class_pivot": """WITH c AS (SELECT p_type, CASE WHEN contains(p_name, 'ring') THEN 'round' WHEN regexp_matches(p_name, 'bolt|gear') THEN 'sharp' WHEN p_size < 10 THEN 'small' ELSE 'other' END AS class FROM part)
SELECT CASE WHEN grouping(class) = 1 THEN 'total' ELSE class END AS class, CASE WHEN grouping(p_type) = 1 THEN 'total' ELSE p_type END AS source, count(*) AS rows FROM c GROUP BY CUBE (class, p_type)""",
    "inventory_signature": """WITH d AS (SELECT sha256(coalesce(source, '') || chr(0) || doc_id || chr(0) || n_chars) AS d FROM documents), b AS (SELECT sha256(string_agg(d, '' ORDER BY d)) AS s, count(*) AS n FROM d GROUP BY d[1:2])
SELECT sha256(string_agg(s, '' ORDER BY s)) AS signature, sum(n)::BIGINT AS records FROM b""",
    "root_match": """WITH p AS (SELECT p_partkey, p_partkey % 3 AS k, (CASE WHEN p_partkey % 5 = 0 THEN p_partkey || '/../x.txt' ELSE p_partkey || '.txt' END) AS rel FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN 'OWN' WHEN 1 THEN 'DEEP' ELSE '' END AS alias, CASE WHEN k = 2 THEN '' ELSE rel END AS relative_path, k <> 2 AND p_partkey % 5 <> 0 AS safe FROM p""",
    "failure_gate": """WITH c AS (SELECT CASE WHEN event_type IN ('error', 'view') THEN event_type || ':' || (user_id % 3) END AS c, count(*) AS n FROM events GROUP BY 1), w AS (SELECT * FROM c WHERE c IS NOT NULL ORDER BY n DESC, c DESC LIMIT 1)
SELECT sum(n)::BIGINT AS rows, coalesce(sum(n) FILTER (c IS NULL), 0)::BIGINT AS valid, (SELECT c FROM w) AS leading_failure, round((SELECT n FROM w) / sum(n), 6) AS failure_share, sum(n) FILTER (c IS NULL) > 0 AND (SELECT n FROM w) / sum(n) < 0.9 AS publish FROM c""",
    "cache_budget": """WITH e AS (SELECT o_custkey AS owner, o_orderkey AS entry, round(o_totalprice * 100)::BIGINT AS bytes, o_orderdate AS mtime, o_orderstatus <> 'P' AS complete, o_orderkey % 17 = 0 AS active FROM orders),
p AS (SELECT *, active OR (complete AND row_number() OVER (PARTITION BY owner, complete ORDER BY mtime DESC, entry DESC) <= 2) AS protected, NOT complete AND NOT active AS inc FROM e),
s AS (SELECT *, sum(CASE WHEN inc THEN 0 ELSE bytes END) OVER (PARTITION BY owner) AS kept, coalesce(sum(CASE WHEN NOT protected AND NOT inc THEN bytes ELSE 0 END) OVER (PARTITION BY owner ORDER BY mtime, entry ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM p)
SELECT owner, entry, protected, CASE WHEN inc THEN 'quarantine incomplete' WHEN NOT protected AND kept - gone > 60000000 THEN 'quarantine' ELSE 'keep' END AS action FROM s""",
    "twin_check": "SELECT count(*) AS raw_rows, count(*) FILTER (p_partkey % 10 <> 3) AS corrected_rows, count(*) FILTER (p_partkey % 10 = 3) AS without_twin, count(*) FILTER (p_partkey % 20 = 1) AS different FROM part",
    "broken_rows": """WITH r AS (SELECT vec_id AS row_id, vec_id % 31 = 0 AS a, vec_id % 29 = 0 AND vec_id % 3 = 0 AS g, vec_id % 29 = 0 AND vec_id % 3 <> 0 AS s FROM embeddings)
SELECT row_id, concat_ws(',', CASE WHEN a THEN 'norm' END, CASE WHEN g THEN 'grid' END, CASE WHEN s THEN 'summary' END) AS broken FROM r WHERE a OR g OR s""",
    "name_lookup_all": """WITH n AS (SELECT lower(p_name) AS key, ['x', 's', ''][p_partkey % 3 + 1] AS flag, lpad(p_partkey::VARCHAR, 7, '0') AS filename FROM part WHERE lower(p_name) IN ('red widget', 'small ring', 'blue bolt')),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY CASE flag WHEN 's' THEN 0 WHEN '' THEN 1 ELSE 2 END, filename) AS nth FROM n)
SELECT key, nth, filename, flag FROM r UNION ALL SELECT k, 0, '', 'missing' FROM (SELECT unnest(['red widget', 'small ring', 'no such', 'blue bolt']) AS k) WHERE k NOT IN (SELECT key FROM n)""",
    "recall_at_k_all": f"""WITH {LONG}, p AS (SELECT q.row_id AS query, l.row_id, any_value(l.label = q.label) AS hit, round(sum(l.v * q.v) / (sqrt(sum(l.v * l.v)) * sqrt(sum(q.v * q.v))), 9) AS c, -round(sum(abs(l.v - q.v)), 9) AS d FROM lib l JOIN lib q ON l.pos = q.pos AND q.row_id % 50 = 0 AND l.row_id <> q.row_id GROUP BY q.row_id, l.row_id),
r AS (SELECT 'cosine' AS app, query, hit, row_number() OVER (PARTITION BY query ORDER BY c DESC, row_id) AS rank FROM p UNION ALL SELECT 'city block', query, hit, row_number() OVER (PARTITION BY query ORDER BY d DESC, row_id) FROM p),
t AS (SELECT * FROM r WHERE rank <= 10), e AS (SELECT app, query, rank, hit FROM t UNION ALL SELECT 'either', query, rank, bool_or(hit) FROM t GROUP BY query, rank),
f AS (SELECT app, query, min(rank) FILTER (hit) AS first FROM e GROUP BY ALL), k AS (SELECT unnest([1, 3, 6, 10])::BIGINT AS k),
s AS (SELECT app, k, count(*) FILTER (first <= k) AS hits, count(*) AS total FROM f, k GROUP BY ALL)
SELECT app, k, hits, total, round((100.0 * hits / total)::DOUBLE, 6) AS percent, round(100 * 1.96 / (1 + 1.96 * 1.96 / total) * sqrt((hits / total) * (1 - hits / total) / total + 1.96 * 1.96 / (4 * total * total)), 6) AS half_width FROM s""",
    "candidate_match": """WITH n AS (SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS l FROM part)
SELECT p_partkey, l AS loose, list_bool_or(list_transform(['redwidget', 'bolt', 'ri'], lambda t: t = l OR (length(t) >= 4 AND contains(l, t)) OR (length(l) >= 4 AND contains(t, l)))) AS hit FROM n""",
    "medoid": f"""WITH {LONG}, n AS (SELECT row_id, label, pos, v / sqrt(sum(v * v) OVER (PARTITION BY row_id)) AS u FROM lib), t AS (SELECT label, pos, sum(u) AS t, count(*) AS members FROM n GROUP BY ALL),
d AS (SELECT label, row_id, round(1 - sum(u * t) / any_value(members), 9) AS d, any_value(members) AS members FROM n JOIN t USING (label, pos) GROUP BY ALL)
SELECT label, row_id, round(d, 6) AS mean_distance, members FROM d QUALIFY row_number() OVER (PARTITION BY label ORDER BY d.d, row_id) = 1""",
    "workflow_stage": """WITH l AS (SELECT conv_id, count(*) AS events, max(turn) FILTER (role = 'system') AS s, max(turn) FILTER (role = 'user') AS u, max(turn) FILTER (role = 'assistant') AS a FROM conversations GROUP BY conv_id)
SELECT conv_id, events, CASE WHEN s IS NULL THEN 'system' WHEN u IS NULL THEN 'user' WHEN a IS NULL THEN 'assistant' ELSE 'done' END AS next_stage, coalesce(u < s, false) OR coalesce(a < greatest(s, u), false) AS stale FROM l""",
    "workflow_chain": """SELECT conv_id, turn, sha1(turn || '|' || role) AS signature, coalesce(lag(sha1(turn || '|' || role)) OVER w, '') AS parent, coalesce(lag(role) OVER w = role, false) AS content_repeated FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
    "savgol_edges": f"""WITH {LONG}, e AS (SELECT row_id, list(v ORDER BY pos) AS v FROM lib GROUP BY row_id),
s AS (SELECT row_id, unnest([0, 1, 62, 63]) AS pos, unnest([
  (69 * v[1] + 4 * v[2] - 6 * v[3] + 4 * v[4] - v[5]) / 70, (2 * v[1] + 27 * v[2] + 12 * v[3] - 8 * v[4] + 2 * v[5]) / 35,
  (2 * v[60] - 8 * v[61] + 12 * v[62] + 27 * v[63] + 2 * v[64]) / 35, (-v[60] + 4 * v[61] - 6 * v[62] + 4 * v[63] + 69 * v[64]) / 70]) AS y FROM e)
SELECT row_id, pos::BIGINT AS pos, round(y, 6) AS y FROM s""",
    "preprocess_plain": f"""WITH {LONG}, v AS (SELECT row_id, list(v ORDER BY pos) AS v FROM lib GROUP BY row_id), {SMOOTHED},
d AS (SELECT row_id, v - lag(v) OVER (PARTITION BY row_id ORDER BY pos) AS d FROM lib), m AS (SELECT row_id, median(d) AS m FROM d GROUP BY row_id), n AS (SELECT row_id, 1.4826 * median(abs(d - m)) / sqrt(2) AS sigma FROM d JOIN m USING (row_id) GROUP BY row_id),
r AS (SELECT row_id, max(v) - min(v) AS size, max(v) AS top, greatest(3 * any_value(sigma), 0.005 * (max(v) - min(v)), 1e-12) AS lim, any_value(sigma) AS sigma FROM lib JOIN n USING (row_id) GROUP BY row_id)
SELECT row_id, round(avg((v < 0)::INT), 6) AS negative_fraction, round(avg((v < -lim)::INT), 6) AS material_negative_fraction, round(any_value(lim), 6) AS material_negative_threshold, round(any_value(sigma), 6) AS noise_sigma,
  round(sqrt(avg((y - v) * (y - v))) / any_value(size), 6) AS change_rms_fraction, round((max(y) - any_value(top)) / any_value(size), 6) AS peak_change_fraction, round(sum(y), 6) AS processed_sum
FROM smoothed JOIN lib USING (row_id, pos) JOIN r USING (row_id) GROUP BY row_id""",
    "savgol": f"""WITH {LONG}, v AS (SELECT row_id, list(v ORDER BY pos) AS v FROM lib GROUP BY row_id), {SMOOTHED} SELECT row_id, pos, round(y, 6) AS y FROM smoothed""",
    "library_build_raw": f"""WITH {LONG}, g AS (SELECT DISTINCT row_id, unnest(range(0, 91))::BIGINT AS place FROM lib),
x AS (SELECT g.row_id, place, coalesce(v, 0) AS v FROM g LEFT JOIN lib l ON l.row_id = g.row_id AND place = pos + CASE WHEN pos >= 40 THEN 15 ELSE 0 END),
s AS (SELECT row_id, (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) AS u FROM x WINDOW w AS (PARTITION BY row_id)),
t AS (SELECT row_id, sqrt(sum(u * u)) AS l2, sum(u) AS total FROM s GROUP BY row_id)
SELECT row_id, variant, false AS db_baseline, CASE WHEN row_id % 50 = 7 THEN 0 ELSE round(l2, 6) END AS l2, CASE WHEN row_id % 50 = 7 THEN 0 ELSE 0 END::BIGINT AS start_idx, CASE WHEN row_id % 50 = 7 THEN -1 ELSE 78 END::BIGINT AS end_idx,
  CASE WHEN row_id % 50 = 7 THEN 0 ELSE 2 END::BIGINT AS runs, CASE WHEN row_id % 50 = 7 THEN 'parse: no numeric rows' ELSE '' END AS failure, CASE WHEN row_id % 50 = 7 THEN 0 ELSE round(total, 3) END AS total
FROM t, (SELECT unnest(['DB-RAW', 'DB-BC']) AS variant) WHERE variant = 'DB-RAW' OR row_id % 4 = 0""",
    "result_rows": ALIGN
    + f""", n AS (SELECT row_id, any_value(label) AS label, count(*) FILTER ({SUPPORT}) AS points FROM lib GROUP BY row_id),
mv AS (SELECT b.row_id, count(*) AS moved FROM best b JOIN lib2 l ON l.row_id = b.row_id AND l.s AND l.pos + b.shift BETWEEN 0 AND 63 GROUP BY b.row_id)
SELECT row_id, 'unresolved:phase ' || label AS independence_group, 'unresolved:phase ' || label AS acquisition_group, points::BIGINT AS support_points, moved::BIGINT AS shifted_support_points, 5::BIGINT AS maximum_shift_points,
  2.0::DOUBLE * shift AS shift_cm1, round(common / moved, 6) AS reference_overlap_fraction, round(0.88 * 0.8 * shape, 6) AS shape_contribution, round(0.88 * 0.2 * gradient, 6) AS gradient_contribution, 0.0::DOUBLE AS pcs_contribution, 0.88::DOUBLE AS spectral_similarity_weight
FROM best JOIN n USING (row_id) JOIN mv USING (row_id)""",
    "independence_groups": """SELECT p_partkey AS row_id, CASE WHEN p_partkey % 11 <> 0 AND p_partkey % 4 = 0 THEN 'G' || p_partkey % 50 WHEN p_partkey % 5 = 0 THEN 'S' || p_partkey % 50 WHEN p_partkey % 13 = 0 THEN 'R' || p_partkey % 50
  WHEN p_partkey % 7 = 0 THEN 'A' || p_partkey % 50 WHEN p_partkey % 3 = 0 THEN 'provenance-source:source ' || p_partkey % 50 ELSE 'unresolved:' || lower(p_name) END AS independent FROM part""",
    "signature_chain": """WITH l AS (SELECT conv_id, role, max(turn) AS turn, arg_max(length(text), turn)::VARCHAR AS size FROM conversations GROUP BY ALL),
p AS (SELECT conv_id, max(turn) FILTER (role = 'system') AS t0, max(turn) FILTER (role = 'user') AS t1, max(turn) FILTER (role = 'assistant') AS t2, any_value(size) FILTER (role = 'system') AS s0, any_value(size) FILTER (role = 'user') AS s1, any_value(size) FILTER (role = 'assistant') AS s2 FROM l GROUP BY conv_id),
a AS (SELECT *, sha1('|system|' || coalesce(s0, '')) AS g0 FROM p WHERE t0 IS NOT NULL), b AS (SELECT *, sha1(g0 || '|user|' || coalesce(s1, '')) AS g1 FROM a WHERE t1 >= t0), c AS (SELECT *, sha1(g1 || '|assistant|' || coalesce(s2, '')) AS g2 FROM b WHERE t2 >= t1)
SELECT conv_id, 'system' AS stage, 0::BIGINT AS place, '' AS parent, g0 AS signature FROM a UNION ALL SELECT conv_id, 'user', 1, g0, g1 FROM b UNION ALL SELECT conv_id, 'assistant', 2, g1, g2 FROM c""",
    "inventory_changes": """WITH d AS (SELECT coalesce(source, '') AS alias, doc_id AS i, n_chars FROM documents)
SELECT alias, i::VARCHAR AS relative_path, CASE WHEN i % 5 = 0 THEN 'added' WHEN i % 7 = 0 THEN 'gone' WHEN i % 4 = 0 OR i % 11 = 0 THEN 'changed' ELSE 'same' END AS change,
  CASE WHEN i % 7 <> 0 AND i % 4 = 0 THEN n_chars + 1 ELSE n_chars END AS size, CASE WHEN i % 7 <> 0 AND i % 11 = 0 THEN i % 3 + 1 ELSE i % 3 END AS modified FROM d WHERE i % 5 <> 0 OR i % 7 <> 0""",
    "result_faults": ALIGN + """, u AS (SELECT row_id, shift, abs(shift) = 5 AS edge, (start + shift < 0 OR stop + shift > 63) AS clipped FROM best JOIN (SELECT row_id, min(pos) AS start, max(pos) AS stop FROM lib2 WHERE s GROUP BY row_id) USING (row_id))
SELECT row_id, CASE row_id % 12 WHEN 1 THEN 'finite numbers' WHEN 2 THEN 'counts; shift' || CASE WHEN edge THEN '; shift boundary' ELSE '' END WHEN 3 THEN 'flags' WHEN 4 THEN 'shift in axis units'
  WHEN 5 THEN 'shape contribution; sum of contributions' WHEN 6 THEN 'coverage; common points' WHEN 7 THEN 'overlap' WHEN 8 THEN 'shifted support' || CASE WHEN clipped THEN '; grid clipped' ELSE '' END WHEN 9 THEN 'grid clipped'
  WHEN 10 THEN 'rank score; sum of contributions' ELSE '' END AS broken FROM u""",
    "spectrum_difference": f"WITH {LONG} SELECT a.row_id, a.pos::BIGINT AS pos, round(a.v - 0.5 * b.v, 6) AS d FROM lib a JOIN lib b ON a.row_id = b.row_id AND b.pos = greatest(3, least(60, a.pos))",
    "frozen_rows": """WITH r AS (SELECT vec_id AS i, label, CASE WHEN vec_id % 3 <> 0 THEN '[{"end":' || (19 + vec_id % 7) || ',"start":' || vec_id % 8 || '},{"end":' || (63 - vec_id % 5) || ',"start":' || (23 + vec_id % 7) || '}]' ELSE 'null' END AS runs FROM embeddings)
SELECT i AS place, sha256('{"label":' || label || ',"provenance":{"accession":null,"specimen":"' || i % 7 || '"},"row_id":' || i || ',"support_runs":' || runs || '}') AS digest, CASE WHEN i % 3 <> 0 THEN 23 + i % 7 ELSE -1 END AS second_run FROM r""",
    "approved_chain": CHAIN,
    "approval_stream": CHAIN,
    "truth_sets": r"""WITH n AS (SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') || CASE WHEN p_partkey % 3 = 0 THEN '_' ELSE ' ' END || CASE WHEN p_partkey % 4 <> 0 THEN (p_partkey % 9)::VARCHAR ELSE 'run' END AS s FROM part),
b AS (SELECT p_partkey, CASE WHEN regexp_extract(s, '^(.*?)(?:_\d|\s\d)', 1) <> '' THEN regexp_extract(s, '^(.*?)(?:_\d|\s\d)', 1) ELSE s END AS base FROM n),
k AS (SELECT *, regexp_replace(lower(base), '[^a-z0-9]', '', 'g') AS key FROM b)
SELECT p_partkey, base, CASE WHEN key = 'redwidget' THEN 'red widget|widget' ELSE array_to_string(list_sort(list_distinct(list_append(list_transform(list_filter(regexp_split_to_array(base, '[^a-zA-Z0-9]+'), lambda p: length(p) >= 3), lambda p: lower(p)), key))), '|') END AS truths FROM k""",
    "ranked_sheet": """WITH c AS (SELECT p_partkey, p_name, unnest(range(0, 9)) AS k FROM part)
SELECT 's' || p_partkey AS spectrum, ['Alpha Search', 'Beta', 'Alpha Search #2'][k // 3 + 1] AS app, (k % 3 + 1)::BIGINT AS rank, 'c' || k || ' ' || p_name AS candidate FROM c WHERE (p_partkey + k) % 5 <> 0""",
    "ranked_sheets": """WITH c AS (SELECT p_partkey, p_name, p_brand, unnest(range(0, 6)) AS k FROM part WHERE p_brand <> 'Brand#11')
SELECT p_brand AS path, 's' || p_partkey AS spectrum, ['Alpha Search', 'Beta'][k // 3 + 1] AS app, (k % 3 + 1)::BIGINT AS rank, 'c' || k || ' ' || p_name AS candidate FROM c WHERE (p_partkey + k) % 5 <> 0
UNION ALL SELECT DISTINCT p_brand, '', 'none', 0::BIGINT, 'no block of ranks 1 to 3 in the sheet' FROM part WHERE p_brand = 'Brand#11'""",
    "resolve_sources": """WITH p AS (SELECT p_partkey AS i, 'sub/f' || p_partkey || '.txt' AS r, p_partkey % 6 <> 5 AS there, CASE WHEN p_partkey % 2 = 0 THEN 'Own' ELSE 'ref' END AS a FROM part),
w AS (SELECT *, CASE WHEN i % 8 = 0 THEN 'stated' WHEN i % 5 = 0 THEN 'below root' WHEN i % 3 = 0 AND there AND a = 'ref' THEN 'known tail' WHEN there THEN 'unique name' ELSE 'unresolved' END AS how FROM p),
s AS (SELECT *, CASE how WHEN 'stated' THEN 'Own' WHEN 'below root' THEN 'Own' WHEN 'known tail' THEN 'ref' WHEN 'unique name' THEN a ELSE '' END AS alias FROM w)
SELECT i AS row_id, alias, CASE WHEN alias = '' THEN '' ELSE r END AS relative_path, how, CASE WHEN alias = '' THEN '' WHEN there AND a = alias THEN 'true' ELSE 'false' END AS known FROM s""",
    "cached_provenance": """WITH p AS (SELECT p_partkey AS i, p_partkey % 100 AS f, p_partkey % 3 AS m FROM part), s AS (SELECT *, CASE WHEN i % 4 = 0 THEN 'own' WHEN f % 2 = 0 AND m = 1 THEN 'cache' ELSE 'none' END AS source FROM p)
SELECT i::VARCHAR AS item, source FROM s UNION ALL (SELECT DISTINCT f || '/' || m, 'to parse' FROM s WHERE source = 'none')""",
    "plain_columns": "SELECT p_partkey AS path, 2::BIGINT AS points, p_partkey::DOUBLE AS first_x, 10.0::DOUBLE AS first_y, 3.5::DOUBLE AS last_y FROM part",
    "config_values": """WITH t AS (SELECT p_partkey, [p_name[1:2], 'o', p_type[1:2]] AS e FROM part)
SELECT p_partkey, array_to_string(list_sort(list_distinct(list_transform(e, lambda x: upper(x[1]) || lower(x[2:])))), ',') AS elements, p_partkey % 6 IN (0, 3, 4) AS on FROM t""",
    "quoted_fields": """SELECT p_partkey, p_name || ', "' || p_partkey || '"|' || p_partkey || '|' || p_partkey || '||x' AS fields FROM part""",
}
ORACLE_SQL |= {name: ORACLE_SQL[f"{name}_all"] for name in ("name_lookup", "recall_at_k")}
