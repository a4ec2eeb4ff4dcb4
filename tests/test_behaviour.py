"""Preprocessing, denoising, reduction, sources and settings, against dense or plain versions of the same rules."""

import hashlib
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from peaklight import model
from peaklight.functions import columns as C
from peaklight.functions import kernels as K
from peaklight.functions import text as T
from peaklight.model import Baseline, Grid, Matching, Query, Reduction, Smoothing, Trim
from peaklight.operators import evaluate, library, reduce, search, signal, workflow
from peaklight.plans.match import query_of, residual_of
from peaklight.sources import headers, inventory, writers


def noisy_peak(n=400, seed=17, noise=0.02):
    t = np.linspace(0, 1, n)
    return 0.2 + 0.6 * t + np.exp(-0.5 * ((t - 0.43) / 0.025) ** 2) + np.random.default_rng(seed).normal(0, noise, n)


def test_negative_shares_are_taken_before_smoothing(spark):
    y = noisy_peak()
    rows = spark.createDataFrame([(1, y.tolist())], "id long, intensity array<double>")
    r = signal.preprocess(rows, Baseline(), Smoothing()).first()
    z = y - K.baseline(y, Baseline())[0]
    steps = np.diff(z)
    sigma = 1.4826 * np.median(np.abs(steps - np.median(steps))) / np.sqrt(2)
    limit = max(3 * sigma, 0.005 * np.ptp(y))
    assert r.negative_fraction == pytest.approx((z < 0).mean()) and r.material_negative_threshold == pytest.approx(limit) and r.noise_sigma == pytest.approx(sigma)
    assert r.material_negative_fraction == pytest.approx((z < -limit).mean()) and r.material_negative_fraction < 0.01 < r.negative_fraction
    done = np.array(r.processed)
    assert r.change_rms_fraction == pytest.approx(np.sqrt(((done - y) ** 2).mean()) / np.ptp(y)) and r.peak_change_fraction == pytest.approx((done.max() - y.max()) / np.ptp(y))


def test_noise_guides_have_a_width_on_the_axis():
    assert [K.width_points(10, s) for s in (1, 2, 0.5, 100)] == [11, 7, 21, 3]
    y = noisy_peak()
    plain = K.savgol(y, 11, 3)[0]
    steps, rest = np.diff(y), y - plain
    both = [1.4826 * np.median(np.abs(x - np.median(x))) for x in (steps, rest)]
    assert K.noise_sigma(y) == pytest.approx(min(both[0] / np.sqrt(2), both[1]))


def test_windows_cover_the_axis_and_fade_only_in_overlaps():
    starts = K.model_windows(3940.0, 1300.0, 325.0)
    assert starts[0] == 0 and starts[-1] + 1300 == 3940 and (np.diff(starts) <= 975 + 1e-9).all() and K.model_windows(900.0, 1300.0, 325.0).tolist() == [0]
    axis, total = np.arange(3941.0), np.zeros(3941)
    for i, a in enumerate(starts):
        inside = (axis >= a) & (axis <= a + 1300)
        w = K.window_fade(axis[inside], starts, i, 1300.0)
        total[inside] += w
        alone = np.ones(inside.sum(), bool)
        for j, b in enumerate(starts):
            if j != i:
                alone &= ~((axis[inside] >= b) & (axis[inside] <= b + 1300))
        assert (w[alone] == 1).all()
    assert np.allclose(total, 1, atol=1e-9)


def test_denoising_keeps_peaks_and_backgrounds():
    x = np.arange(200, 2600.0)
    clean = np.exp(-0.5 * ((x - 900) / 6) ** 2) + 0.3 * np.exp(-0.5 * ((x - 1700) / 300) ** 2)
    y = clean + np.random.default_rng(3).normal(0, 0.01, len(x))
    for runner in (lambda v: np.zeros_like(v), lambda v: np.linspace(0, 1, len(v)), lambda v: v[::-1]):
        out = K.denoise(y, runner)
        assert np.abs(out - y).max() <= min(K.noise_sigma(y), 0.02 * np.ptp(y)) + 1e-12
    assert np.allclose(K.denoise(y, lambda v: v), y, atol=0.012) and np.array_equal(K.denoise(np.ones(50), lambda v: v), np.ones(50))


def test_plain_least_squares_equal_a_dense_solution():
    y = noisy_peak(120)
    d = np.diff(np.eye(120), 2, axis=0)
    w = np.ones(120)
    for _ in range(10):
        z = np.linalg.solve(np.diag(w) + 1e5 * d.T @ d, w * y)
        w = 0.01 * (y > z) + 0.99 * (y < z)
    assert np.allclose(K.plain_als(y)[0], z, atol=1e-7)


def test_improved_least_squares_equal_a_dense_solution():
    y = noisy_peak(90)
    d1, d2 = np.diff(np.eye(90), 1, axis=0), np.diff(np.eye(90), 2, axis=0)
    w, z = np.ones(90), y.copy()
    for _ in range(20):
        jump = np.abs(np.diff(y - z))
        jump = (jump / jump.max() if jump.max() > 0 else jump) + 1e-6
        z = np.linalg.solve(np.diag(w) + 1e4 * d2.T @ d2 + 1e2 * d1.T @ np.diag(jump) @ d1, w * y)
        w = np.where(y > z, 0.01, 0.99)
    assert np.allclose(K.iasls(y, lam=1e4)[0], z, atol=1e-7)


def test_fingerprints(spark):
    x = np.arange(40, 2100.0, 3)
    y = noisy_peak(len(x)) * 100
    order = np.random.default_rng(1).permutation(len(x))
    rows = [(1, x[order].tolist(), y[order].tolist(), None), (2, [2500.0, 2600.0], [1.0, 2.0], None), (3, None, None, "no numeric lines"), (4, [100.0, 200.0, 300.0], [1.0, float("nan"), 2.0], None), (5, [], [], None), (6, [100.0, 300.0], [1.0, 1.0], None)]
    out = {r.row_id: r for r in reduce.fingerprints(spark.createDataFrame(rows, "row_id long, axis array<double>, intensity array<double>, error string"), Reduction()).collect()}
    z = y - K.plain_als(y)[0]
    z = (z - z.min()) / (z - z.min()).max()
    grid = np.arange(50, 2001.0)
    want = np.where(grid <= x[-1], np.interp(grid, x, z), 0)
    assert np.allclose(out[1].fingerprint, want / np.linalg.norm(want), atol=1e-9) and (out[1].x_min, out[1].x_max) == (x[0], x[-1])
    assert out[2].outside and out[2].fingerprint is None and out[3].failure == "no numeric lines" and out[4].failure == "non-finite values" and out[5].failure == "empty spectrum"
    assert out[6].outside and out[6].fingerprint is None
    library_rows = spark.createDataFrame(rows, "row_id long, axis array<double>, intensity array<double>, error string").withColumn("name", F.lit("M")).withColumn("flag", F.lit(""))
    kept = reduce.decluster(reduce.fingerprints(library_rows, Reduction()))
    assert kept.where("keep").count() == 6


def test_fewer_medoids_than_three_give_way_to_a_mixture():
    x = np.vstack([np.tile([1.0, 0, 0], (10, 1)), np.tile([0, 1.0, 0], (10, 1)), np.tile([0, 0, 1.0], (2, 1))]) + np.random.default_rng(0).normal(0, 1e-3, (22, 3))
    label, tops = K.representatives(x, np.ones(22, int), 3, 9, 30, 9, 6, 42)
    assert 3 <= len(tops) <= 9 and label[0] != label[10] != label[20]


def test_legacy_search_equals_plain_version(spark):
    rng = np.random.default_rng(4)
    x = np.arange(100.5, 160.0, 0.5)
    q = np.exp(-0.5 * ((x - 130) / 3) ** 2) + 0.01 * x + rng.normal(0, 0.01, len(x))
    rows = [(i, np.arange(90.0, 150.0 + i).tolist(), rng.random(60 + i).tolist()) for i in range(5)] + [(9, [], [])]
    out = search.legacy_search(spark.createDataFrame(rows, "row_id long, axis array<double>, intensity array<double>"), x.tolist(), q.tolist(), 10).collect()
    grid = np.arange(101.0, 160.0)
    v = np.interp(grid, x, q)
    v = K.savgol(v - K.plain_als(v)[0], 11, 3)[0]
    v = (v - v.min()) / np.ptp(v)
    want = {}
    for i, a, b in rows:
        w = np.interp(grid, a, b, left=0, right=0) if a else np.zeros(len(grid))
        w = w - w.min()
        w = w / w.max() if w.max() else w
        want[i] = float(v @ w / (np.linalg.norm(v) * np.linalg.norm(w))) if np.linalg.norm(w) else 0.0
    assert {r.row_id: pytest.approx(r.score) for r in out} == want and [r.score for r in out] == pytest.approx(sorted(want.values(), reverse=True)) and "axis" not in out[0].asDict()


def test_content_hash_is_over_bytes(spark):
    v, m = [1.5, None, -0.25], [True, False, True]
    got = spark.createDataFrame([(v, m), (None, None)], "v array<double>, m array<boolean>").select(C.content_hash("v", "m").alias("h")).collect()
    assert got[0].h == hashlib.sha256((3).to_bytes(8, "little") + np.array([1.5, np.nan, -0.25], "<f4").tobytes() + bytes([1, 0, 1])).hexdigest() and got[1].h == hashlib.sha256(bytes(8)).hexdigest()


def test_json_is_replaced_in_one_step(spark, tmp_path):
    at = f"file://{tmp_path}/m.json"
    for value in ({"a": 1}, {"a": 2}):
        writers.write_json(spark, at, value)
        assert writers.read_json(spark, at) == value
    assert not [f for f in os.listdir(tmp_path) if "writing" in f]


def test_manifest_names_code_and_time(spark, tmp_path):
    (tmp_path / ".git/refs/heads").mkdir(parents=True)
    (tmp_path / ".git/HEAD").write_text("ref: refs/heads/main\n")
    (tmp_path / ".git/refs/heads/main").write_text("abc\n")
    (tmp_path / "lib").mkdir()
    (tmp_path / "lib/a.py").write_text("x = 1\n")
    out = writers.manifest(spark, {}, {}, {}, str(tmp_path / "lib"))
    assert out["code"] == {"files": {"a.py": hashlib.sha256(b"x = 1\n").hexdigest()}, "commit": "abc"} and out["created_utc"].endswith("Z") and "pyarrow" in out["versions"]
    assert json.dumps(out, sort_keys=True)


def test_reports_of_a_thinned_library(spark, tmp_path):
    rows = spark.createDataFrame([(1, "b B", 0, True, "medoid"), (2, "b B", 0, False, "represented"), (3, "A", -1, True, "small group")], "row_id long, name string, cluster int, keep boolean, reason string")
    writers.write_reports(rows, f"file://{tmp_path}/r")
    read = lambda x: spark.read.option("header", "true").csv(f"file://{tmp_path}/r/{x}")
    assert read("all_spectra").count() == 3 and {r.name: r.kept for r in read("groups").collect()} == {"A": "1", "b B": "1"}
    assert {r.group_slug for r in read("detail").collect()} == {"b_B", "A"}
    writers.write_recall(spark.createDataFrame([("x", 1, 3)], "app string, k long, hits long"), f"file://{tmp_path}/recall")
    assert spark.read.option("header", "true").csv(f"file://{tmp_path}/recall").first().hits == "3"


def test_trimmed_files_keep_their_other_lines(spark):
    n = 400
    y = 300 + 20 * np.sin(np.arange(n) / 9)
    y[:30] = 0
    text = "##NAMES=Quartz\n" + "".join(f"{i}, {v:.6f}\n" for i, v in enumerate(y)) + "##END=\n"
    rows = spark.createDataFrame([("a", text), ("b", "nothing here"), ("c", None)], "path string, value string")
    out = {r.path: r for r in signal.trim_files(rows, Trim()).collect()}
    lines = out["a"].trimmed.splitlines()
    assert lines[0] == "##NAMES=Quartz" and lines[-1] == "##END=" and out["a"].kept == len(lines) - 2 == n - 32
    values = np.array([[float(p) for p in line.split("\t")] for line in lines[1:-1]])
    assert values[0, 0] == 32 and values[:, 1].min() == 0 and values[:, 1].max() == 1000
    assert out["b"].error == out["c"].error == "no numeric lines" and out["b"].trimmed is None


def test_folder_of_a_library(spark, tmp_path):
    (tmp_path / "lib/deep").mkdir(parents=True)
    (tmp_path / "lib/sBeta.txt").write_text("##NAMES=Beta\n1, 2\n2, 3\n")
    (tmp_path / "lib/deep/Alpha.TXT").write_bytes(b"##NAMES=Alph\xe9\n1, 2\n2, 3\n")
    (tmp_path / "lib/deep/xempty.rod").write_text("_no numbers\n")
    (tmp_path / "lib/other.csv").write_text("1,2\n")
    spectra, skipped = headers.load_folder(spark, {"lib": f"file://{tmp_path}/lib"})
    rows = spectra.collect()
    assert [(r.stem, r.flag, r.name) for r in rows] == [("Alpha", "", "Alph\xe9"), ("sBeta", "s", "Beta")] and list(rows[1].axis) == [1.0, 2.0]
    assert [os.path.basename(r.path) for r in skipped.collect()] == ["xempty.rod"]


def test_an_axis_shift_moves_places_alone():
    grid, segments = Grid(0, 20, 1), [(np.arange(5.0, 11.0), np.array([1.0, 3, 2, 5, 4, 2]))]
    plain, runs = library.project(segments, grid, normalise=False)
    moved, moved_runs = library.project(segments, grid, shift=3.0, normalise=False)
    assert np.array_equal(moved[3:], plain[:-3]) and runs == [(5, 10)] and moved_runs == [(8, 13)]
    half, _ = library.project(segments, grid, shift=0.5, normalise=False)
    assert half[6] == 2.0 and library.project(segments, grid)[0].max() == 1.0


def test_vectors_of_a_batch_equal_vectors_one_by_one(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(12):
        x = np.sort(rng.choice(np.arange(0, 90.0), 40 + i % 3, replace=False))
        rows.append((i, f"n{i}", "", f"f{i}", i % 4 == 0, x.tolist(), rng.random(len(x)).tolist(), "bad" if i == 5 else None))
    df = spark.createDataFrame(rows, "row_id long, name string, flag string, filename string, already_processed boolean, axis array<double>, intensity array<double>, error string")
    how, grid = Baseline(lam=1e3), Grid(0, 90, 1)
    for r in library.build_vectors(df, grid, how).collect():
        i, x, y = r.row_id, rows[r.row_id][5], rows[r.row_id][6]
        if i == 5:
            assert r.failure == "parse: bad" and not any(r.vector) and r.l2 == 0
            continue
        want, runs = library.onto_grid(x, y, grid, how if r.variant == "DB-BC" and i % 4 else None)
        assert np.allclose(r.vector, want, atol=1e-6) and [(s.start, s.end) for s in r.support_runs] == runs and r.db_baseline == (r.variant == "DB-BC" and i % 4 != 0)


def test_residual_of_a_result_is_of_just_that_row(spark):
    rng = np.random.default_rng(2)
    v = rng.random((3, 60))
    rows = spark.createDataFrame([(i, f"Phase {i}", v[i].tolist(), 0, 59, None) for i in range(3)], "row_id long, name string, vector array<double>, start_idx int, end_idx int, support_runs array<struct<start:int,end:int>>")
    packs = {"DB-RAW": rows.withColumn("variant", F.lit("DB-RAW")), "DB-BC": rows.where("row_id < 0").withColumn("variant", F.lit("DB-BC"))}
    q = v[0].copy()
    q[2:] += 2 * v[1][:-2]
    result = spark.createDataFrame([("DB-RAW", 1, 2)], "variant string, row_id long, shift int")
    left = residual_of(packs, Query(q.tolist(), [True] * 60), result)
    c = np.concatenate([[0, 0], v[1][:-2]])
    scale = q[2:] @ c[2:] / (c[2:] @ c[2:])
    assert (left.variant, left.row_id, left.phase) == ("DB-RAW", 1, "phase 1") and left.scale == pytest.approx(scale)
    want = q - scale * np.where(np.arange(60) >= 2, c, 0)
    assert left.usable[:5] == [False] * 5 and np.allclose(np.array(left.vector)[5:], want[5:] / np.abs(want[5:]).max())


def test_rank_blocks_of_a_sheet():
    header = [None, "Tool", "One", None, "Tool", "one", None]
    assert evaluate.rank_blocks(header, ["", "1", "2", "3", "1", 2, 3.0], [(("tool", "one"), "T1")], 3) == {"T1": [1, 2, 3], "T1 #2": [4, 5, 6]}
    assert evaluate.rank_number(" 2.0 ") == 2 and evaluate.rank_number("x") is None and evaluate.rank_number(None) is None
    with pytest.raises(ValueError):
        evaluate.rank_blocks(header, ["", "1", "3", "2", "1", "2", "x"], size=3)


def test_a_change_shows_in_all_later_signatures(spark):
    rows = [("k", 1, "a", "x"), ("k", 2, "b", "y"), ("k", 3, "c", "z"), ("m", 1, "a", "w"), ("m", 2, "b", "y"), ("m", 3, "c", "z"), ("old", 5, "a", "x"), ("old", 4, "b", "y"), ("none", 1, "b", "y")]
    df = spark.createDataFrame(rows, "key string, at long, stage string, content string")
    out = {(r.key, r.stage): r for r in workflow.signature_chain(df, "key", "at", "stage", "content", ["a", "b", "c"]).collect()}
    assert out["k", "b"].signature != out["m", "b"].signature and out["k", "c"].signature != out["m", "c"].signature and out["k", "c"].parent == out["k", "b"].signature
    assert ("old", "a") in out and ("old", "b") not in out and not [k for k in out if k[0] == "none"]


def test_settings_of_uploads_and_references():
    up = model.Upload.of("a.txt", b"abc")
    assert (up.sha1, up.size_bytes) == (hashlib.sha1(b"abc").hexdigest(), 3) and "abc" not in json.dumps(up.payload())
    for bad in (("", "0" * 40, 1), ("a", "0" * 39, 1), ("a", "g" * 40, 1), ("a", "0" * 40, -1)):
        with pytest.raises(ValueError):
            model.Upload(*bad)
    white = model.WhiteReference(True, 1.23456789, "ff")
    assert white.payload()["scale"] == 1.234568 and len(white.token()) == 12 and white.label() == "on (scale=1.235)" and model.WhiteReference().label() == "off"
    assert model.first_range(Grid(60, 4000, 1)) == (60, 2000) and model.first_range(Grid(2500, 4000, 1)) == (2500, 4000) and model.first_range(Grid(60, 900, 1)) == (60, 900)


def test_inventory_signature_sees_states_and_issues_but_not_places(spark, tmp_path):
    from peaklight.operators.catalog import inventory_facts, inventory_signature

    roots = spark.createDataFrame([("own",), ("ref",)], "alias string")
    records = spark.createDataFrame([("own", f"f{i}.txt", i, "t") for i in range(50)], "alias string, relative_path string, size long, modified string")
    none = spark.createDataFrame([], "alias string, path string, issue string")
    sign = lambda r, i, b=256: inventory_signature(inventory_facts(roots, r, i), ["fact", "alias", "place", "size", "modified"], b).first().signature
    gone = [spark.createDataFrame([("ref", p, "missing root")], "alias string, path string, issue string") for p in ("/a", "/b")]
    base = sign(records, none)
    assert base == sign(records.repartition(5), none) and base != sign(records.where("size < 49"), none)
    assert base != sign(records, gone[0]) == sign(records, gone[1]) and sign(records, none, 7) != base


def test_groups_of_independent_evidence(spark):
    rows = [("q", " ", None, "  acc ", None), ("q  Z", None, None, None, "src"), (None, None, None, None, None), ("q", "own", "spec", "acc", "src")]
    df = spark.createDataFrame(rows, "name string, specimen_id string, p_spec string, accession string, source string")
    got = [r.g for r in df.select(T.independence_group({"specimen_id": F.col("specimen_id"), "accession": F.col("accession")}, {"specimen_id": F.col("p_spec"), "source": F.col("source")}, F.col("name")).alias("g")).collect()]
    assert got == ["acc", "provenance-source:src", "unresolved:?", "own"]


def test_result_rows_take_groups_from_where_they_are(spark):
    base = spark.createDataFrame([(1, "Quartz", 2, 0.9, 0.8, 0.7)], "row_id long, name string, shift int, shape double, gradient double, pcs double")
    row = search.result_rows(base.withColumn("provenance", F.struct(F.lit("R1").alias("accession"))), Matching(), 0.5).first()
    assert (row.shift_cm1, row.independence_group, row.acquisition_group) == (1.0, "R1", "R1")
    w, g = Matching().similarity_weight, Matching().gradient_weight
    assert row.shape_contribution + row.gradient_contribution + row.pcs_contribution == pytest.approx(w * ((1 - g) * 0.9 + g * 0.8) + (1 - w) * 0.7)


def test_sources_without_an_inventory(spark):
    rows = spark.createDataFrame([(1, None, None, "/elsewhere/reference/a/b.txt", None), (2, "own", "a/b.txt", None, None), (3, "own", "/abs", "x.txt", "x.txt"), (4, None, None, None, None)], "row_id long, source_alias string, source_path string, path string, filename string")
    out = {r.row_id: (r.alias, r.relative_path, r.how, r.known) for r in inventory.resolve_sources(rows, {"Own": "/data/own", "ref": "/x/reference"}).collect()}
    assert out == {1: ("ref", "a/b.txt", "known tail", None), 2: ("Own", "a/b.txt", "stated", None), 3: (None, None, "unresolved", None), 4: (None, None, "unresolved", None)}


def test_query_of_a_spectrum_is_masked_after_preprocessing():
    x = np.concatenate([np.arange(10, 30.0), np.arange(60, 80.0)])
    y = np.concatenate([np.linspace(1, 3, 20), 2 + np.sin(np.arange(20))])
    grid, how = Grid(0, 100, 1), Baseline(lam=1e3)
    q = query_of(x, y, grid, how, 15, 70, shift=2.0)
    whole, runs = library.onto_grid(x, y, grid, how, 2.0)
    assert runs == [(12, 31), (62, 81)]
    want = np.zeros(101, bool)
    want[15:32] = want[62:71] = True
    assert q.mask == want.tolist() and np.allclose(q.vector, np.where(want, whole, 0)) and query_of(x, y, grid).mask[60]


def test_a_pair_must_be_what_its_manifest_says(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"n{i}", "", f"f{i}", False, [float(k) for k in range(20)], [float((k * i) % 7) for k in range(20)], None, ["O"]) for i in range(1, 5)], "row_id long, name string, flag string, filename string, already_processed boolean, axis array<double>, intensity array<double>, error string, elements array<string>")
    made = library.build_pair(spark, rows, Grid(0, 19, 1), f"file://{tmp_path}/lib")
    raw, corrected = library.load_pair(spark, made)
    assert raw.count() == corrected.count() == 4 and raw.first().elements == ["O"]
    for wrong in ({"rows": 5}, {"grid": Grid(0, 20, 1).payload()}, {"bytes_per_variant": 1}):
        with pytest.raises(ValueError):
            library.load_pair(spark, made | wrong)
