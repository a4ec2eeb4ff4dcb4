"""Differences of spectra, files written anew below their headers, globs, copies of kept files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from peaklight.functions import kernels
from peaklight.model import Baseline, Smoothing
from peaklight.operators import signal
from peaklight.sources import headers, measurement, writers

KIND = "i int, axis array<double>, intensity array<double>, other_axis array<double>, other_intensity array<double>"


def test_differences_are_smoothed_before_and_corrected_behind(spark):
    rng = np.random.default_rng(1)
    x, y, u, v = np.arange(40.0), rng.random(40) + np.arange(40) / 9, np.arange(5.0, 30.5, 0.5), rng.random(51)
    f = lambda a: [float(k) for k in a]
    rows = [(0, f(x), f(y), f(u), f(v)), (1, f(x[::-1]), f(y[::-1]), f(u[::-1]), f(v[::-1])), (2, f(x), f(y), f(x), f(y)), (3, f(x), f(y), None, None), (4, [], [], f(u), f(v)), (5, f(x), f(y[:3]), f(u), f(v))]
    df = spark.createDataFrame(rows, KIND)
    how, smooth = Baseline(lam=1e3), Smoothing()
    out = {r.i: r for r in signal.spectrum_difference(df, 0.5, smooth, how).collect()}
    other = kernels.savgol(np.interp(x, u, v)[None], smooth.window, smooth.order)[0]
    want = y - 0.5 * other
    below = kernels.baseline(want[None], how)[0]
    assert np.allclose(out[0].difference, want) and np.allclose(out[0].difference_baseline, below) and np.allclose(out[0].difference_corrected, want - how.strength * below)
    assert np.allclose(out[1].difference, want[::-1])
    plain = {r.i: r.difference for r in signal.spectrum_difference(df, 1.0).collect()}
    assert np.allclose(plain[2], 0) and plain[3] is plain[4] is plain[5] is None and out[3].difference_corrected is None
    assert signal.spectrum_difference(df.where("false"), 1.0).count() == 0


def test_files_are_written_anew_below_their_headers(spark):
    files = spark.createDataFrame([("a", "#Laser= 532\n#x\ty\n1\t2\n2\t4.5\n"), ("b", "no numbers")], "path string, value string")
    out = {r.path: r.value for r in measurement.rewritten(files, decimals=2).collect()}
    assert out["a"] == "#Laser= 532\n#x\ty\n1.00\t2.00\n2.00\t4.50" and out["b"].strip() == "no numbers"
    halved = measurement.rewritten(files.where("path = 'a'"), lambda t: t.withColumn("intensity", F.transform("intensity", lambda v: v / 2)), None, ",").first().value
    assert halved.splitlines()[2:] == ["1,1", "2,2.25"]


def test_only_files_that_fit_the_pattern_are_read(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a Edge 1.txt", "sub/b Edge.txt", "c.txt", "d Edge.csv"):
        (tmp_path / name).write_text("# c\n2 3\n1 2 9\n")
    out = headers.load_columns(spark, f"file://{tmp_path}", "*Edge*.txt").collect()
    assert sorted(r.path.rsplit("/", 1)[-1].replace("%20", " ") for r in out) == ["a Edge 1.txt", "b Edge.txt"] and out[0].axis == [1, 2]


def test_kept_files_are_copied(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"f{i}.txt").write_bytes(b"x" * (i + 1) * 700_000)
    rows = [(f"file://{tmp_path}/in/f{i}.txt", f"n{i % 2}/f{i}.txt") for i in range(4)]
    df = spark.createDataFrame(rows, "path string, relative_path string").repartition(2)
    for _ in range(2):
        out = {r.to: (r.bytes, r.error) for r in writers.copy_files(df, f"file://{tmp_path}/out").collect()}
    assert out["n0/f2.txt"] == (2_100_000, None) and out["n1/f3.txt"][0] is None and "f3" in out["n1/f3.txt"][1]
    assert sorted(p.relative_to(tmp_path / "out").as_posix() for p in (tmp_path / "out").rglob("*.*")) == ["n0/f0.txt", "n0/f2.txt", "n1/f1.txt"]
    assert (tmp_path / "out/n1/f1.txt").read_bytes() == (tmp_path / "in/f1.txt").read_bytes()
    for bad in ([(rows[0][0], "../x")], [(rows[0][0], "a"), (rows[1][0], "a")]):
        with pytest.raises(ValueError, match="copy"):
            writers.copy_files(spark.createDataFrame(bad, "path string, relative_path string"), f"file://{tmp_path}/out")
    assert writers.copy_files(df.where("false"), f"file://{tmp_path}/none").count() == 0
