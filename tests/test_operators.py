"""Rules of the operators on small tables made by hand."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from peaklight.functions import columns as C
from peaklight.functions import text as T
from peaklight.model import Baseline, Evidence, Grid, Matching, Query, Smoothing, canonical_json, signature
from peaklight.operators import catalog, evaluate, evidence, library, reduce, residual, search, signal
from peaklight.operators.workflow import Workflow
from peaklight.plans import match as plan
from peaklight.sources import headers, inventory, measurement, writers
from peaklight.streaming import intake

TRACE = "row_id long, name string, specimen string, acquisition string, reference_id string, rank_score double, coverage_fraction double, common long, shift_boundary boolean, grid_clipped boolean"


def traces(spark, *rows):
    return spark.createDataFrame([(i, n, s, a, f"r{i}", score, cov, common, b, c) for i, (n, s, a, score, cov, common, b, c) in enumerate(rows)], TRACE)


def test_duplicates_of_one_acquisition_do_not_vote(spark):
    t = traces(spark, ("Quartz", "s1", "a1", 0.9, 0.9, 90, False, False), (" quartz ", "s1", "a1", 0.7, 0.8, 70, False, False), ("Quartz", "s1", "a2", 0.75, 1.0, 100, True, False), ("Quartz", "s2", "a3", 0.6, 0.5, 60, False, True), ("Quartz", "s3", "a4", 0.1, 0.1, 5, True, True))
    r = evidence.rank_phases(t).first()
    assert r.aggregate_score == pytest.approx(0.8) and r.median_group_score == pytest.approx(0.6) and r.best_reference_score == 0.9
    assert (r.independent_reference_count, r.reference_variant_count, r.minimum_group_common_point_count) == (3, 5, 60)
    assert r.mean_coverage_fraction == pytest.approx((0.85 + 0.5) / 2) and r.minimum_group_coverage_fraction == 0.5
    assert (r.shift_boundary_group_count, r.grid_boundary_clipped_group_count) == (0, 1) and r.phase_name == "Quartz" and r.best_row_id == 0


GOOD = [("A", "s1", "a1", 0.95, 0.9, 90, False, False), ("A", "s2", "a2", 0.9, 0.9, 90, False, False), ("B", "s3", "a3", 0.8, 0.9, 90, False, False)]


@pytest.mark.parametrize(
    "rows, status, reasons",
    [
        (GOOD, "supported_candidate", "uncalibrated_evidence_guardrails_passed"),
        ([], "insufficient_evidence", "no_phase_candidates"),
        ([("A", "s1", "a1", 0.95, 0.5, 9, False, False)], "insufficient_evidence", "too_few_common_points,insufficient_minimum_group_coverage"),
        ([("A", "s1", "a1", 0.7, 0.9, 90, False, False)], "unknown_or_out_of_library", "phase_score_below_uncalibrated_guardrail"),
        ([("A", "s1", "a1", 0.9, 0.9, 90, True, True)], "ambiguous", "phase_separation_not_assessed,too_few_independent_references,leading_phase_has_shift_search_boundary_evidence,leading_phase_has_grid_clipped_reference_support"),
        ([*GOOD[:2], ("B", "s3", "a3", 0.93, 0.9, 90, False, False)], "ambiguous", "leading_phase_margin_too_small"),
        ([*GOOD[:2], ("B", "s3", "a3", 0.5, 0.2, 90, False, False)], "ambiguous", "phase_separation_not_assessed"),
    ],
)
def test_decisions(spark, rows, status, reasons):
    out = evidence.actionable(evidence.decide(evidence.rank_phases(traces(spark, *rows)), Evidence())).first()
    assert (out.status, out.reasons) == (status, reasons)
    assert out.actionable == (status in ("supported_candidate", "ambiguous"))


def test_diverse_top(spark):
    rows = [(i, f"p{0 if i < 30 else i}", f"id{i}", 1.0 - i / 100, 1.0 - i / 100, 1.0 - i / 100, 0.9 if i == 45 else 0.1) for i in range(50)] + [(99, "p0", "id0", 0.2, 0.2, 0.2, 0.1)]
    df = spark.createDataFrame(rows, "row_id long, name string, identity string, phase_score double, rank_score double, similarity double, pcs double")
    out = [r.row_id for r in search.diverse_top(df, 16, Matching()).orderBy("place").collect()]
    assert len(out) == 16 and out[:2] == [0, 1] and 2 not in out and 45 in out and 99 not in out
    assert [r.row_id for r in search.diverse_top(df.where("name = 'p0'"), 6).orderBy("place").collect()] == list(range(6))


def spectra(spark, rows, runs=None):
    return spark.createDataFrame([(i, f"P{i}", [float(x) for x in v], 0, len(v) - 1, runs) for i, v in enumerate(rows)], "row_id long, name string, vector array<float>, start_idx int, end_idx int, support_runs array<struct<start:int,end:int>>")


def test_screen_and_refine(spark):
    x = np.arange(120.0)
    q = np.exp(-0.5 * ((x - 40) / 3) ** 2) + 0.5 * np.exp(-0.5 * ((x - 80) / 3) ** 2)
    lib = spectra(spark, [np.roll(q, -2), 3 + 2 * q, np.zeros(120), np.roll(q, 30)])
    mask = [True] * 120
    found = search.shortlist(search.screen(lib, q.tolist(), mask, ["row_id"]), 10).collect()
    assert [r.row_id for r in found][0] == 1 and 2 not in {r.row_id for r in found}
    rows = {r.row_id: r for r in search.self_consistency(search.refine(lib, q.tolist(), mask, Matching(), ["row_id"])).collect()}
    assert rows[0].shift == 2 and rows[0].similarity > 0.999 and rows[0].pcs == pytest.approx(0.75) and rows[0].common == 118 and rows[0].grid_clipped
    assert rows[1].shift == 0 and not rows[1].broken and not rows[1].shift_boundary
    empty = search.coverage(spectra(spark, [q], []), mask).first()
    assert empty.covered == 0 and search.coverage(spectra(spark, [q]), mask, 10, 19).first().coverage == 1


def test_whole_match_and_residual(spark):
    rng = np.random.default_rng(3)
    x = np.arange(200.0)
    peak = lambda c: np.exp(-0.5 * ((x - c) / 2.5) ** 2)
    a, b = peak(50) + 0.8 * peak(120), peak(85) + 0.7 * peak(160)
    rows = [a, 1.01 * a, b, b + 0.001 * rng.random(200), peak(20) + peak(180)]
    names = ["Alpha", "alpha", "Beta", "Beta", "Gamma"]
    lib = spark.createDataFrame([(i, n, "DB-RAW", f"s{i}", f"a{i}", f"r{i}", v.tolist(), 0, 199, None) for i, (n, v) in enumerate(zip(names, rows, strict=True))], "row_id long, name string, variant string, specimen string, acquisition string, reference_id string, vector array<float>, start_idx int, end_idx int, support_runs array<struct<start:int,end:int>>")
    q = a + 0.5 * b
    shown, phases, decision = plan.match({"DB-RAW": lib}, Query(q.tolist(), [True] * 200), 10)
    assert phases.orderBy("phase_rank").first().phase_key == "alpha" and shown.count() >= 4
    points = spark.createDataFrame([(0, i, float(q[i]), float(a[i]), True, True) for i in range(200)], "signal long, pos int, q double, c double, mask boolean, support boolean")
    summary, vectors = residual.project(points)
    one = residual.worth_searching(summary).first()
    assert one.worth and 0.99 < one.scale < 1.05
    left = vectors.orderBy("pos").collect()
    shown, phases, _ = plan.residual_match({"DB-RAW": lib}, [r.matching for r in left], [r.usable for r in left], "alpha")
    assert phases.orderBy("phase_rank").first().phase_key == "beta" and shown.where("phase_key = 'alpha'").count() == 0


def test_residual_guards(spark):
    rows = [(0, i, 1.0 + i, 1.0 + i, True, i < 30) for i in range(40)] + [(1, i, 1.0, 1.0, True, i < 5) for i in range(40)]
    summary, vectors = residual.project(spark.createDataFrame(rows, "signal long, pos int, q double, c double, mask boolean, support boolean"))
    assert [r.signal for r in summary.collect()] == [0] and summary.first().improvement == 1
    assert [r.pos for r in vectors.where("not usable").orderBy("pos").collect()] == [27, 28, 29, 30, 31, 32]


def test_measurement_layouts(spark):
    files = [
        ("comma", "﻿shift,counts\n# c\n100,1\n102.5,3\n101,5\n", "axis runs both ways"),
        ("semi", "x;y\r\n100,5;1,25\r\n101,5;2\r\n", None),
        ("tab", "300\t1\textra\n200\t2\n100\t3\n", None),
        ("space", "1  2\n2  4\n2  6\n3 1\n", None),
        ("broken", "1,2\n2,3\noops\n3,4\nbad,line\n", "not numeric: line 3, 5"),
        ("one", "1,2\n1,3\n", "fewer than two different x"),
        ("none", "hello\n", "no numeric rows"),
        ("empty", None, "no numeric rows"),
        ("quoted", '"1","2"\n"2","5"\n', None),
    ]
    rows = {r.path: r for r in measurement.parse(spark.createDataFrame([f[:2] for f in files], "path string, value string")).collect()}
    assert {k: r.error for k, r in rows.items()} == {k: e for k, _, e in files}
    assert rows["semi"].axis == [100.5, 101.5] and rows["semi"].intensity == [1.25, 2.0]
    assert rows["tab"].axis == [100, 200, 300] and rows["space"].intensity == [2, 5, 1] and rows["quoted"].intensity == [2, 5]
    head = measurement.split_header(spark.createDataFrame([("a", "#k=v\nname\n1\t2\n3\t4")], "path string, value string")).first()
    assert head.header == "#k=v\nname" and head.x == [1, 3]


def test_headers(spark):
    tagged = "data_x\n_chemical_name_mineral 'Calcite'\n_chemical_formula_sum\n 'Ca C O3'\n_rod_database.code 1000001\n_raman_measurement_device.excitation_laser_wavelength 532\n_raman_measurement.background_subtraction yes\nloop_\n_raman_spectrum.raman_shift\n_raman_spectrum.intensity\n 100.0 5.0\n 101.0 6.0\n"
    text = "##NAMES=Quartz; SiO2\n##RRUFFID=R040031\n##IDEAL CHEMISTRY=Si_1_O_2\n100, 1\n101, 2, 9\n"
    rows = spark.createDataFrame([("a.rod", tagged), ("b.txt", text), ("c.txt", "nothing")], "path string, value string")
    m = {r.path: r.m for r in rows.select("path", headers.meta(F.col("value"), F.col("path")).alias("m")).collect()}
    assert m["a.rod"].name == "Calcite" and m["a.rod"].formula == "Ca C O3" and tuple(m["b.txt"]) == ("Quartz", "Si1O2") and tuple(m["c.txt"]) == ("Unknown", "?")
    p = rows.where("path = 'a.rod'").select(headers.tag_provenance(F.col("value")).alias("p")).first().p
    assert (p.reference_id, p.wavelength, p.processing, p.background_subtracted) == ("1000001", 532.0, "processed", True)
    b = {r.path: r for r in headers.body(rows).collect()}
    assert b["b.txt"].intensity == [1, 9] and b["a.rod"].axis == [100, 101] and b["c.txt"].error
    out = rows.select(headers.quality_flag(F.lit("xSpinel")).alias("f"), headers.sort_stem(F.lit("xSpinel")).alias("s")).first()
    assert tuple(out) == ("x", "pinel")


def test_names_and_formulas(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("v")).first().v
    assert get(T.formula_elements(F.lit("Ca2(SO4)·2H2O"))) == ["Ca", "H", "O", "S"] and get(T.formula_elements(F.lit("?x"))) == []
    assert get(T.phase_key(F.lit("  Iron   OXIDE "))) == "iron oxide" and get(T.phase_key(F.lit(None).cast("string"))) == "?"
    assert get(T.formula_display(F.lit("CaSO4·2H2O"))) == "CaSO₄·2H₂O"
    assert get(T.acquisition_group(F.lit(" "), F.lit("Q__R1__Raman_Data_RAW__ab12.txt"), F.lit("s"))) == "Q__R1" and get(T.acquisition_group(F.lit(""), F.lit("other.txt"), F.lit("s"))) == "s"
    assert get(T.claim(F.lit("'Yes'"))) is True and get(T.claim(F.lit("?"))) is None and get(T.number_or_null(F.lit("1,5"))) == 1.5


def test_library_pair(spark, tmp_path):
    folder = f"file://{tmp_path}/lib"
    x = [float(i) for i in range(60, 101)]
    y = [1 + 0.01 * i + np.exp(-0.5 * ((v - 80) / 2) ** 2) for i, v in enumerate(x)]
    rows = [(0, "A", "", "a.txt", False, x, [float(v) for v in y], None), (1, "B", "", "b.txt", True, x, [float(v) for v in y], None), (2, "SKIPPED", "", "c.txt", False, None, None, "no numeric rows"), (3, "G", "", "g.txt", False, x[:10] + x[30:], [float(v) for v in y[:10] + y[30:]], None)]
    src = spark.createDataFrame(rows, "row_id long, name string, flag string, filename string, already_processed boolean, axis array<double>, intensity array<double>, error string")
    made = library.build_pair(spark, src, Grid(60, 100, 1), folder)
    assert made["rows"] == 4 and made["valid"] == 3 and library.build_pair(spark, src, Grid(60, 100, 1), folder) == made
    raw, corrected = (x.orderBy("row_id").collect() for x in library.load_pair(spark, made))
    assert [len(r.vector) for r in raw] == [41] * 4 and raw[1].vector == corrected[1].vector and raw[0].vector != corrected[0].vector
    assert raw[2].failure.startswith("parse:") and raw[2].l2 == 0 and [(r.start, r.end) for r in raw[3].support_runs] == [(0, 9), (30, 40)]
    assert not any(raw[3].vector[11:29]) and [r.db_baseline for r in corrected] == [True, False, False, True]
    bad = src.where("row_id = 2")
    with pytest.raises(ValueError, match="nothing to publish"):
        library.build_pair(spark, bad, Grid(60, 100, 1), folder, inputs="bad")
    with pytest.raises(FileExistsError):
        writers.promote(spark, made["path"], made["path"])
    assert library.build_pair(spark, src, Grid(60, 100, 1), folder, inputs="other")["name"] != made["name"]


def test_inventory(spark, tmp_path):
    (tmp_path / "a/sub").mkdir(parents=True)
    for name in ("a/one.TXT", "a/sub/two.rod", "a/three.csv"):
        (tmp_path / name).write_text("1 2\n")
    records, issues = inventory.scan(spark, {"Own": f"{tmp_path}/a", "gone": f"{tmp_path}/none"})
    assert sorted(r.relative_path for r in records.collect()) == ["one.TXT", "sub/two.rod"] and issues.first().issue == "missing root"
    held = inventory.Inventory(spark, {"Own": f"{tmp_path}/a"})
    before = held.token()
    held.refresh()
    assert held.token().split(":")[0] == before.split(":")[0] and held.token().endswith(":2")
    with pytest.raises(ValueError):
        inventory.coerce_roots([("a", "/x"), ("A", "/y")])
    assert inventory.numbered_aliases(["db", "DB", "x"]) == ["db", "DB-2", "x"]


def test_signal_segments_do_not_bridge_gaps(spark):
    pts = [("s", float(i), float(i)) for i in range(10)] + [("s", float(i), 0.0) for i in range(40, 50)] + [("s", 3.0, 5.0), ("s", None, 1.0), ("s", 4.0, float("nan"))]
    df = spark.createDataFrame(pts, "signal string, x double, y double")
    clean = signal.clean_xy(df)
    assert clean.where("x = 3").first().y == 4.0 and clean.count() == 20
    grid = signal.resample(signal.gap_segments(clean), 0.5).collect()
    assert {r.segment for r in grid} == {0, 1} and not [r for r in grid if 9 < r.x < 40] and len(grid) == 38
    q = signal.axis_quality(df).first()
    assert (q.gap_count, q.duplicate_count, q.point_count) == (1, 1, 21) and "too few points" in q.warnings


def test_array_kernels_on_rows(spark):
    rows = spark.createDataFrame([(1, [float(i % 7) for i in range(30)]), (2, [1.0, 2.0]), (3, [])], "id long, intensity array<double>")
    out = signal.preprocess(rows, Baseline(), Smoothing()).orderBy("id").collect()
    assert [len(r.processed) for r in out] == [30, 2, 0] and not any(out[1].baseline) and out[2].noise_sigma == 0


def test_declustering(spark):
    rng = np.random.default_rng(0)
    rows = [(i, "M", "", (np.eye(8)[i % 3] + 0.01 * rng.random(8)).tolist()) for i in range(12)] + [(20, "M", "", None), (30, "N", "x", [1.0] * 8)]
    df = spark.createDataFrame(rows, "row_id long, name string, flag string, fingerprint array<double>")
    out = {r.row_id: r for r in reduce.decluster(df).collect()}
    assert out[20].keep and out[30].keep and sum(r.keep for r in out.values() if r.reason in ("medoid", "represented")) == 3
    report = {r.name: r for r in reduce.reduction_report(reduce.decluster(df)).collect()}
    assert report["M"].kept == 4 and report["N"].spectra == 1


def test_cluster_query_thins_whole_names(spark):
    from peaklight.plans.queries import cluster_reps, lib

    rows = cluster_reps(spark, "/root/testdata/sf0.001")
    assert {r.name for r in rows.select("name").distinct().collect()} == {r.name for r in lib(spark, "/root/testdata/sf0.001").select("name").distinct().collect()}
    assert all(r.kept - r.without_fingerprint <= 9 for r in reduce.reduction_report(rows).collect())


def test_recall(spark):
    wide = spark.createDataFrame([("q1", "Quartz", "Calcite", "alpha-quartz", None), ("q2", "x", "y", "z", "Calcite")], "query string, a1 string, a2 string, b1 string, b2 string")
    long = evaluate.unpivot_ranks(wide, ["query"], {"A": ["a1", "a2"], "B": ["b1", "b2"]})
    truth = F.when(F.col("query") == "q1", F.array(F.lit("Quartz"))).otherwise(F.array(F.lit("calcite")))
    ranked = long.withColumn("hit", evaluate.hit(F.col("candidate"), truth))
    out = {(r.app, r.k): r.hits for r in evaluate.recall_at_k(evaluate.combined(ranked, ["A", "B"], "both"), (1, 2)).collect()}
    assert out == {("A", 1): 1, ("A", 2): 1, ("B", 1): 1, ("B", 2): 2, ("both", 1): 1, ("both", 2): 2}


def test_recall_asks_every_fiftieth_row(spark):
    from peaklight.plans.queries import recall_at_k_all

    n = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where("vec_id % 50 = 0").count()
    assert {r.total for r in recall_at_k_all(spark, "/root/testdata/sf0.001").collect()} == {n} and n > 1


def test_nearest_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(evaluate, "ROWS", 7)
    monkeypatch.setattr(evaluate, "QUERIES", 20)
    rng = np.random.default_rng(3)
    x = rng.integers(0, 3, (60, 4)).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, vector array<double>")
    out = evaluate.nearest(df, df.where("row_id % 5 = 0"), 4).collect()
    got = {(r["query"], r.app, r["rank"]): r.row_id for r in out}
    size = np.linalg.norm(x, axis=1)
    for q in range(0, 60, 5):
        scores = {"cosine": [x[q] @ v / (size[q] * s) if size[q] * s else 0.0 for v, s in zip(x, size, strict=True)], "city block": [-np.abs(x[q] - v).sum() for v in x]}
        for app, score in scores.items():
            want = sorted((i for i in range(60) if i != q), key=lambda i: (-round(score[i], 9), i))[:4]
            assert [got[q, app, r] for r in range(1, 5)] == want
    assert len(out) == 12 * 2 * 4


def test_lookup_and_smoothing_return_every_row(spark):
    from peaklight.plans import queries

    sf = "/root/testdata/sf0.001"
    parts = spark.read.parquet(f"{sf}/part.parquet").where("lower(p_name) in ('red widget', 'small ring', 'blue bolt')").count()
    found = queries.name_lookup_all(spark, sf).where("flag <> 'missing'")
    assert found.count() == parts and parts == found.select("filename").distinct().count()
    ends = [r.pos for r in queries.savgol_edges(spark, sf).where("row_id = 0").orderBy("pos").collect()]
    assert ends == [0, 1, 62, 63]


def test_workflow():
    w = Workflow().apply("input", {"sha": 1}).apply("baseline", {"m": "arpls"}).apply("smoothing", {}).apply("matching", {})
    done = w.record([])
    assert done.next_stage is None and not done.stale and done.apply("baseline", {"m": "arpls"}) is done
    changed = done.apply("baseline", {"m": "als"})
    assert changed.stale and changed.next_stage == "smoothing" and changed.result == done.result
    with pytest.raises(ValueError):
        Workflow().apply("matching", {})
    assert done.replace_input() == Workflow()


def test_settings():
    assert Baseline.named("IASLS", p=0.5).method == "als" and Baseline(p=0.5).signature() == Baseline().signature() != Baseline(lam=2.0).signature()
    assert Smoothing("none", 9).signature() == Smoothing("none", 5).signature()
    assert canonical_json({"b": -0.0, "a": float("nan")}) == '{"a":null,"b":0.0}' and len(signature({}, 12)) == 12
    assert len(Grid()) == 3941 and len(Grid(60, 100, 1)) == 41
    with pytest.raises(ValueError):
        Grid(1, 0, 1)


def test_writers(spark, tmp_path):
    row = spark.createDataFrame([([1.0, 2.5], [3.0, 0.1234567])], "x array<double>, y array<double>")
    text = row.select(writers.spectrum_text(F.col("x"), F.col("y"), F.lit("#h"), 3, ",").alias("t"), writers.spectrum_text(F.col("x"), F.col("y"), decimals=None).alias("g")).first()
    assert text.t == "#h\n1.000,3.000\n2.500,0.123" and text.g == "1\t3\n2.5\t0.1234567"
    at = f"file://{tmp_path}/m.json"
    writers.write_json(spark, at, writers.manifest(spark, {"a": 1}, {}, {"x": float("inf")}))
    assert writers.read_json(spark, at)["outputs"] == {"x": None} and json.loads((tmp_path / "m.json").read_text())["settings"] == {"a": 1}


def test_gate_and_plan(spark):
    rows = spark.createDataFrame([("ok",), ("parse",), ("parse",), (None,)], "c string")
    out = catalog.failure_gate(rows, F.col("c").eqNullSafe("parse"), F.col("c")).first()
    assert (out.valid, out.leading_failure, out.failure_share, out.publish) == (2, "parse", 0.5, True)
    assert not catalog.failure_gate(rows.where("c = 'parse'"), F.lit(True), F.col("c")).first().publish
    entries = spark.createDataFrame([(i, 10, i, i != 2, i == 0) for i in range(6)], "entry long, bytes long, mtime long, complete boolean, active boolean")
    plan = {r.entry: r.action for r in catalog.cleanup_plan(entries, 35.0).collect()}
    assert plan == {0: "keep", 1: "quarantine", 2: "quarantine incomplete", 3: "quarantine", 4: "keep", 5: "keep"}


def test_streaming(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("1,2\n2,3\n")
    (tmp_path / "in/b.txt").write_text("bad\n")
    for _ in range(2):
        q = intake.start(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/ck", once=True)
        q.awaitTermination(120)
    rows = {r.path.rsplit("/", 1)[-1]: r for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    assert rows["a.txt"].intensity == [2, 3] and rows["b.txt"].error == "no numeric rows" and len(rows) == 2


def test_small_helpers(spark, tmp_path):
    text = "data_\nloop_\n_a\n 1 2\nloop_\n_raman_spectrum.raman_shift\n_raman_spectrum.intensity\n" + "\n".join(f" {i} {i * 2}.5" for i in range(5))
    one = spark.createDataFrame([(text, [1.0, 2.0, 3.0], [True, False, True], [(1, 2)])], "t string, v array<double>, m array<boolean>, r array<struct<start:int,end:int>>")
    got = one.select(headers.loop_pairs(F.col("t")).alias("p"), C.gap_masked(F.col("v"), F.col("m")).alias("g"), C.clipped_trace(F.col("v"), F.col("r"), 0, 1).alias("c"), C.content_hash(F.col("v"), F.col("m")).alias("h")).first()
    assert [tuple(p) for p in got.p] == [(float(i), i * 2 + 0.5) for i in range(5)] and got.g == [1.0, None, 3.0]
    assert [tuple(p) for p in got.c] == [(1, 2.0)] and len(got.h) == 64
    lock = f"file://{tmp_path}/pair.lock"
    assert writers.claim(spark, lock) and not writers.claim(spark, lock)
    writers.release(spark, lock)
    assert writers.claim(spark, lock)
    shown = spark.createDataFrame([(1, 1), (9, 2)], "row_id long, place int")
    rows = search.enrich(shown, spark.range(5).select(F.col("id").alias("row_id"), F.lit("x").alias("source"))).orderBy("place").collect()
    assert [r.source for r in rows] == ["x", None]
    a = spark.createDataFrame([("s", i) for i in range(4)], "signal string, grid long")
    assert signal.overlap(a, a.where("grid < 3")).first().overlap == 0.75
