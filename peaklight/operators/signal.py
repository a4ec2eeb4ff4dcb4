"""Cleaning, segmenting, resampling and judging signals in long form: one row per point.

Every function takes the names of its columns, works per signal by window or
aggregate, and shuffles once by the signal's id; later steps on the same id
reuse that partitioning.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peaklight.functions import kernels
from peaklight.functions.text import NUMBER, NUMERIC_LINE
from peaklight.model import Baseline, Denoise, Smoothing


def clean_xy(points: DataFrame, key: str = "signal", x: str = "x", y: str = "y") -> DataFrame:
    """Finite points only; values at the same x are averaged."""
    good = points.where(f"{x} is not null and {y} is not null and not isnan({x}) and not isnan({y}) and abs({x}) < double('infinity') and abs({y}) < double('infinity')")
    return good.groupBy(key, x).agg(F.avg(y).alias(y), F.count("*").alias("n_merged"))


def gap_segments(points: DataFrame, key: str = "signal", x: str = "x", factor: float = 5.0, extra: float = 10.0) -> DataFrame:
    """Adds segment, which counts up where dx > max(factor * median, median + extra) of the signal's positive steps.

    The median is a percentile aggregate on steps, joined back on the signal; a
    signal's points pass one window.
    """
    w = Window.partitionBy(key).orderBy(x)
    stepped = points.withColumn("_dx", F.col(x) - F.lag(x).over(w))
    middle = F.expr("percentile(if(_dx > 0, _dx, null), 0.5)").over(Window.partitionBy(key))
    limit = F.greatest(factor * F.col("_median"), F.col("_median") + extra)
    marked = stepped.withColumn("_median", middle).withColumn("_break", F.coalesce((F.col("_dx") > limit).cast("int"), F.lit(0)))
    return marked.withColumn("segment", F.sum("_break").over(w).cast("int")).drop("_dx", "_median", "_break")


def segment_summary(segmented: DataFrame, key: str = "signal", x: str = "x") -> DataFrame:
    return segmented.groupBy(key, "segment").agg(F.count("*").alias("points"), F.min(x).alias("start"), F.max(x).alias("end"))


def resample(segmented: DataFrame, step: float, key: str = "signal", x: str = "x", y: str = "y") -> DataFrame:
    """Linear interpolation on integer multiples of step, inside segments only.

    A point and its successor span an interval; each makes the grid points that
    lie in it, so no join is needed.  Grid ends have a tolerance of 1e-9 steps.
    """
    w = Window.partitionBy(key, "segment").orderBy(x)
    spans = segmented.select(key, "segment", F.col(x).alias("x0"), F.col(y).alias("y0"), F.lead(x).over(w).alias("x1"), F.lead(y).over(w).alias("y1"), F.row_number().over(w).alias("_n")).where("x1 is not null")
    first = F.when(F.col("_n") == 1, F.ceil(F.col("x0") / step - 1e-9)).otherwise(F.floor(F.col("x0") / step + 1e-9) + 1)
    last = F.floor(F.col("x1") / step + 1e-9)
    cells = spans.withColumn("_a", first).withColumn("_b", last).where("_a <= _b").withColumn("grid", F.explode(F.sequence("_a", "_b")))
    at = F.least(F.greatest(F.col("grid") * step, F.col("x0")), F.col("x1"))
    value = F.col("y0") + (F.col("y1") - F.col("y0")) * (at - F.col("x0")) / (F.col("x1") - F.col("x0"))
    return cells.select(key, "segment", F.col("grid").cast("long").alias("grid"), (F.col("grid") * step).alias(x), value.alias(y))


def axis_quality(points: DataFrame, key: str = "signal", x: str = "x", y: str = "y") -> DataFrame:
    """One row per signal: counts, ends, median spacing and its spread, duplicates, gaps, saturation, warnings."""
    finite = points.where(f"{x} is not null and {y} is not null and not isnan({x}) and not isnan({y})")
    w = Window.partitionBy(key).orderBy(x)
    top = Window.partitionBy(key)
    rows = finite.withColumn("_dx", F.col(x) - F.lag(x).over(w)).withColumn("_max", F.max(y).over(top)).withColumn("_min", F.min(y).over(top))
    rows = rows.withColumn("_median", F.expr("percentile(if(_dx > 0, _dx, null), 0.5)").over(top))
    limit = F.greatest(5 * F.col("_median"), F.col("_median") + 10)
    ceiling = F.greatest(F.lit(1e-12), (F.col("_max") - F.col("_min")) * 1e-8)
    out = rows.groupBy(key).agg(
        F.count("*").alias("point_count"),
        F.min(x).alias("minimum"),
        F.max(x).alias("maximum"),
        F.first("_median").alias("median_spacing"),
        (F.expr("stddev_pop(if(_dx > 0, _dx, null))") / F.first("_median")).alias("spacing_cv"),
        F.count_if(F.col("_dx") == 0).alias("duplicate_count"),
        F.count_if((F.col("_dx") > 0) & (F.col("_dx") > limit)).alias("gap_count"),
        F.avg((F.abs(F.col(y) - F.col("_max")) <= ceiling).cast("double")).alias("saturation_fraction"),
    )
    notes = [
        F.when(F.col("spacing_cv") > 0.25, "irregular spacing"),
        F.when(F.col("duplicate_count") > 0, "duplicates are averaged"),
        F.when(F.col("gap_count") > 0, "gaps are not bridged"),
        F.when((F.col("saturation_fraction") >= 0.01) & (F.col("point_count") >= 50), "saturation suspected"),
        F.when(F.col("point_count") < 30, "too few points"),
    ]
    return out.withColumn("warnings", F.concat_ws("; ", *notes))


def noise_sigma(points: DataFrame, key: str = "signal", x: str = "x", y: str = "y") -> DataFrame:
    """Robust noise from neighbouring differences: 1.4826 * MAD / sqrt(2)."""
    w = Window.partitionBy(key).orderBy(x)
    steps = points.withColumn("_d", F.col(y) - F.lag(y).over(w)).where("_d is not null")
    steps = steps.withColumn("_m", F.expr("percentile(_d, 0.5)").over(Window.partitionBy(key)))
    return steps.groupBy(key).agg((1.4826 * F.expr("percentile(abs(_d - _m), 0.5)") / F.sqrt(F.lit(2.0))).alias("sigma"), F.count("*").alias("steps"))


def rolling_median(points: DataFrame, half: int, key: str = "signal", x: str = "x", y: str = "y") -> DataFrame:
    """Adds median, over half points on either side; only where the whole window exists."""
    w = Window.partitionBy(key).orderBy(x)
    frame = w.rowsBetween(-half, half)
    rows = points.withColumn("_w", F.collect_list(y).over(frame))
    return rows.withColumn("median", F.when(F.size("_w") == 2 * half + 1, F.get(F.array_sort("_w"), F.lit(half)))).drop("_w")


def spikes(points: DataFrame, key: str = "signal", x: str = "x", y: str = "y") -> DataFrame:
    """Points that stand more than max(8 sigma, 4 % of the range) above the median of five, zeros standing beyond the ends; the first 100."""
    w = Window.partitionBy(key).orderBy(x)
    top = Window.partitionBy(key)
    five = F.array_sort(F.array(*(F.coalesce(F.lag(y, k).over(w), F.lit(0.0)) for k in (2, 1)), F.col(y), *(F.coalesce(F.lead(y, k).over(w), F.lit(0.0)) for k in (1, 2))))
    rows = points.withColumn("_r", F.col(y) - F.get(five, F.lit(2))).withColumn("_n", F.row_number().over(w))
    rows = rows.withColumn("_range", F.max(y).over(top) - F.min(y).over(top)).withColumn("_count", F.count("*").over(top))
    rows = rows.withColumn("_m", F.expr("percentile(_r, 0.5)").over(top)).withColumn("_s", 1.4826 * F.expr("percentile(abs(_r - _m), 0.5)").over(top))
    sigma = F.greatest(F.col("_s"), F.col("_range") * 1e-8)
    found = rows.where((F.col("_count") >= 7) & (F.col("_range") > 0) & (F.col("_r") > F.greatest(8 * sigma, 0.04 * F.col("_range"))))
    return found.withColumn("nth", F.row_number().over(w)).where("nth <= 100").select(key, x, y, (F.col("_n") - 1).cast("long").alias("index"), F.col("_r").alias("excess"))


def zero_trim(points: DataFrame, low: float = 0.0, key: str = "signal", x: str = "x", y: str = "y") -> DataFrame:
    """First and last x whose value is above low, and the points outside."""
    return points.groupBy(key).agg(
        F.min(F.when(F.col(y) > low, F.col(x))).alias("first_x"),
        F.max(F.when(F.col(y) > low, F.col(x))).alias("last_x"),
        F.count("*").alias("points"),
        F.count_if(F.col(y) > low).alias("above"),
    )


def first_jump(points: DataFrame, least: float, reach: float, key: str = "signal", x: str = "x", y: str = "y") -> DataFrame:
    """The first step of size least or more within reach of the signal's start; NULL without one."""
    w = Window.partitionBy(key).orderBy(x)
    rows = points.withColumn("_d", F.abs(F.col(y) - F.lag(y).over(w))).withColumn("_x0", F.min(x).over(Window.partitionBy(key)))
    hit = (F.col("_d") >= least) & (F.col(x) - F.col("_x0") <= reach)
    return rows.groupBy(key).agg(F.min(F.when(hit, F.col(x))).alias("jump_x"), F.expr(f"min_by(if(_d >= {least} and {x} - _x0 <= {reach}, _d, null), if(_d >= {least} and {x} - _x0 <= {reach}, {x}, null))").alias("jump"))


def running_peak_after(points: DataFrame, start: str, key: str = "signal", x: str = "x", y: str = "y") -> DataFrame:
    """Adds peak_so_far, the largest value from the column ``start`` on."""
    w = Window.partitionBy(key).orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    return points.withColumn("peak_so_far", F.max(F.when(F.col(x) >= F.col(start), F.col(y))).over(w))


def subtract(signal: DataFrame, reference: DataFrame, scale: float, key: str = "signal", grid: str = "grid", y: str = "y") -> DataFrame:
    """signal - scale * reference on their common grid points, and the share of the signal's points that are common."""
    out = signal.join(reference.select(key, grid, F.col(y).alias("_ref")), [key, grid], "left")
    share = F.avg(F.col("_ref").isNotNull().cast("double")).over(Window.partitionBy(key))
    return out.withColumn("overlap", share).where("_ref is not null").withColumn(y, F.col(y) - scale * F.col("_ref")).drop("_ref")


def overlap(target: DataFrame, reference: DataFrame, key: str = "signal", grid: str = "grid") -> DataFrame:
    """Share of the target's grid points at which the reference has a value; 0 without a reference."""
    there = reference.select(key, grid).distinct().withColumn("_there", F.lit(1.0))
    return target.join(there, [key, grid], "left").groupBy(key).agg(F.avg(F.coalesce("_there", F.lit(0.0))).alias("overlap"), F.count("*").alias("points"))


def true_runs(points: DataFrame, flag: str, key: str = "signal", pos: str = "pos") -> DataFrame:
    """Runs of neighbouring positions where the flag holds: both ends and the number of points."""
    w = Window.partitionBy(key).orderBy(pos)
    rows = points.where(F.col(flag)).withColumn("_island", F.col(pos) - F.row_number().over(w))
    return rows.groupBy(key, "_island").agg(F.min(pos).alias("start"), F.max(pos).alias("end"), F.count("*").alias("points")).drop("_island")


def to_arrays(points: DataFrame, key: str = "signal", x: str = "x", y: str = "y") -> DataFrame:
    """One row per signal; arrays in order of x."""
    rows = points.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))).alias("_p"))
    return rows.select(key, F.col("_p.x").alias("axis"), F.col("_p.y").alias("intensity"))


def _kernel(df: DataFrame, run, added: str) -> DataFrame:
    """Adds columns that ``run`` computes from each Arrow batch; the others pass through uncopied."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            new = run(b)
            yield pa.RecordBatch.from_arrays([*b.columns, *new.values()], names=[*b.schema.names, *new])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(batches, f"{kinds}, {added}")


def _rows(column: pa.Array) -> list[np.ndarray]:
    return [np.array(v, float) if v is not None else np.zeros(0) for v in column.to_pylist()]


def _by_length(rows: list[np.ndarray], f) -> list[np.ndarray]:
    """Applies a kernel on all rows of one length together."""
    out: list = [None] * len(rows)
    for n in {len(r) for r in rows}:
        at = [i for i, r in enumerate(rows) if len(r) == n]
        made = f(np.stack([rows[i] for i in at])) if n else [np.zeros(0)] * len(at)
        for i, z in zip(at, made, strict=True):
            out[i] = z
    return out


def correct_baseline(df: DataFrame, how: Baseline, column: str = "intensity") -> DataFrame:
    """Adds baseline and corrected = value - strength * baseline, to arrays on an even axis."""

    def run(b: pa.RecordBatch) -> dict:
        y = _rows(b.column(column))
        z = _by_length(y, lambda m: kernels.baseline(m, how))
        kind = pa.list_(pa.float64())
        return {"baseline": pa.array(z, kind), "corrected": pa.array([a - how.strength * c for a, c in zip(y, z, strict=True)], kind)}

    return _kernel(df, run, "baseline array<double>, corrected array<double>")


def smooth(df: DataFrame, how: Smoothing, column: str = "intensity") -> DataFrame:
    def run(b: pa.RecordBatch) -> dict:
        y = _rows(b.column(column))
        z = _by_length(y, lambda m: kernels.savgol(m, how.window, how.order)) if how.method == "savgol" else y
        return {"smoothed": pa.array(z, pa.list_(pa.float64()))}

    return _kernel(df, run, "smoothed array<double>")


def spectrum_difference(df: DataFrame, scale: float = 1.0, smoothing: Smoothing | None = None, how: Baseline | None = None) -> DataFrame:
    """Adds difference (intensity - scale * other) and, with a baseline, difference_baseline and difference_corrected.

    Rows have axis, intensity, other_axis, other_intensity.  The other spectrum is taken at the places of the first (its end values beyond its ends; as it is where the axes agree),
    then smoothed if asked, then scaled; a baseline is taken off the difference.  Spectra are taken in order of their axis; where either is empty, null or
    has an axis of another length, the results are null.
    """

    def run(b: pa.RecordBatch) -> dict:
        x, y, u, v = (_rows(b.column(c)) for c in ("axis", "intensity", "other_axis", "other_intensity"))
        taken: list = [None] * len(x)
        for i in range(len(x)):
            if len(x[i]) and len(x[i]) == len(y[i]) and len(u[i]) and len(u[i]) == len(v[i]):
                own, other = np.argsort(x[i], kind="stable"), np.argsort(u[i], kind="stable")
                at, place, value = x[i][own], u[i][other], v[i][other]
                same = len(at) == len(place) and np.allclose(at, place, rtol=1e-7, atol=1e-9)
                taken[i] = (own, y[i][own], value if same else np.interp(at, place, value))
        held = [i for i, t in enumerate(taken) if t is not None]
        prepared = [taken[i][2] for i in held]
        if smoothing is not None and smoothing.method == "savgol":
            prepared = _by_length(prepared, lambda m: kernels.savgol(m, smoothing.window, smoothing.order))
        left = [taken[i][1] - scale * z for i, z in zip(held, prepared, strict=True)]
        below = _by_length(left, lambda m: kernels.baseline(m, how)) if how is not None else left

        def back(values: list) -> pa.Array:
            out: list = [None] * len(x)
            for i, z in zip(held, values, strict=True):
                out[i] = np.empty(len(z))
                out[i][taken[i][0]] = z
            return pa.array(out, pa.list_(pa.float64()))

        added = {"difference": back(left)}
        return added if how is None else added | {"difference_baseline": back(below), "difference_corrected": back([a - how.strength * z for a, z in zip(left, below, strict=True)])}

    return _kernel(df, run, "difference array<double>" + (", difference_baseline array<double>, difference_corrected array<double>" if how is not None else ""))


#: Diagnostics of preprocess().
DIAGNOSTICS = ("negative_fraction", "material_negative_fraction", "material_negative_threshold", "noise_sigma", "change_rms_fraction", "peak_change_fraction")


def preprocess(df: DataFrame, baseline: Baseline, smoothing: Smoothing | None = None, column: str = "intensity") -> DataFrame:
    """Baseline, then smoothing, with diagnostics.

    A corrected noisy signal crosses zero often, so before smoothing two shares of negative points are taken: all, and those
    below material_negative_threshold = max(3 sigma of the corrected signal's steps, 0.5 % of the raw range).  The changes of the
    whole (root mean square, and of the highest point) are shares of the raw range.  All zero for an empty signal.
    """

    def run(b: pa.RecordBatch) -> dict:
        raw = _rows(b.column(column))
        z = _by_length(raw, lambda m: kernels.baseline(m, baseline))
        plain = [a - baseline.strength * c for a, c in zip(raw, z, strict=True)]
        done = _by_length(plain, lambda m: kernels.savgol(m, smoothing.window, smoothing.order)) if smoothing and smoothing.method == "savgol" else plain
        found = []
        for y, p, d in zip(raw, plain, done, strict=True):
            if not len(y):
                found.append((0.0,) * len(DIAGNOSTICS))
                continue
            size, sigma = max(float(np.ptp(y)), kernels.TINY), kernels.difference_sigma([p])
            limit = max(3 * sigma, 0.005 * size, kernels.TINY)
            found.append((float((p < 0).mean()), float((p < -limit).mean()), limit, sigma, float(np.sqrt(((d - y) ** 2).mean())) / size, float(d.max() - y.max()) / size))
        kind = pa.list_(pa.float64())
        return {"baseline": pa.array(z, kind), "processed": pa.array(done, kind)} | {n: pa.array([f[i] for f in found], pa.float64()) for i, n in enumerate(DIAGNOSTICS)}

    return _kernel(df, run, f"baseline array<double>, processed array<double>, {', '.join(f'{n} double' for n in DIAGNOSTICS)}")


def denoise(df: DataFrame, runner, how: Denoise | None = None, step: float = 1.0, column: str = "intensity") -> DataFrame:
    """A model's proposal, blended over windows and guarded; ``runner`` takes and gives ``points`` numbers in 0..1."""
    how = how or Denoise()

    def run(b: pa.RecordBatch) -> dict:
        out = [kernels.denoise(y, runner, step, how.span, how.overlap, how.points, cap=how.sigma_cap, guide=how.guide, trend=how.trend, share=how.range_share) if len(y) else y for y in _rows(b.column(column))]
        return {"denoised": pa.array(out, pa.list_(pa.float64()))}

    return _kernel(df, run, "denoised array<double>")


#: Models that a worker has loaded, by name.
_models: dict[str, Callable[[np.ndarray], np.ndarray]] = {}


def loaded(name: str, load: Callable[[], Callable[[np.ndarray], np.ndarray]]) -> Callable[[np.ndarray], np.ndarray]:
    if name not in _models:
        _models[name] = load()
    return _models[name]


def denoise_in_batches(df: DataFrame, name: str, load: Callable[[], Callable[[np.ndarray], np.ndarray]], how: Denoise | None = None, step: float = 1.0, column: str = "intensity", windows: int = 256) -> DataFrame:
    """As denoise(), with a model that takes and gives many windows at once, a row each.

    ``load`` makes the model; a worker calls it once for each ``name`` and keeps the model for all its later tasks.  The windows of all spectra of
    a batch go to the model together, at most ``windows`` in a call, so neither the number of spectra nor their length sets the size of a call.  Null and
    flat spectra need no call.
    """
    how = how or Denoise()

    def run(b: pa.RecordBatch) -> dict:
        rows = _rows(b.column(column))
        given = [kernels.model_inputs(y, step, how.span, how.overlap, how.points) for y in rows]
        every = np.concatenate(given) if given else np.zeros((0, how.points))
        made = np.zeros_like(every)
        model = loaded(name, load) if len(every) else None
        for at in range(0, len(every), windows):
            out = np.asarray(model(every[at : at + windows]), float)
            if out.shape != every[at : at + windows].shape:
                raise ValueError(f"the model {name} gave {out.shape} for {every[at : at + windows].shape}")
            made[at : at + windows] = out
        ends = np.cumsum([0, *map(len, given)])
        out = [kernels.blended(y, made[a:c], step, how.span, how.overlap, how.points, cap=how.sigma_cap, guide=how.guide, trend=how.trend, share=how.range_share) if len(y) else y for y, a, c in zip(rows, ends[:-1], ends[1:], strict=True)]
        return {"denoised": pa.array(out, pa.list_(pa.float64()))}

    return _kernel(df, run, "denoised array<double>")


def trim_edges(df: DataFrame, how, axis: str = "axis", column: str = "intensity") -> DataFrame:
    """Adds keep_from, keep_to: the half-open range of points that stay, by the rules of edges.edge_range."""

    def run(b: pa.RecordBatch) -> dict:
        out = [kernels.edge_range(x, y, how) if len(y) else (0, 0) for x, y in zip(_rows(b.column(axis)), _rows(b.column(column)), strict=True)]
        return {"keep_from": pa.array([a for a, _ in out], pa.int32()), "keep_to": pa.array([c for _, c in out], pa.int32())}

    return _kernel(df, run, "keep_from int, keep_to int")


def trim_files(files: DataFrame, how, key: str = "path", text: str = "value") -> DataFrame:
    """Adds trimmed, kept and error: the text with the numeric lines that stay, scaled anew; all other lines as they were.

    A numeric line gives its first and last number, and is written as these with up to ten significant digits and a tab between.
    Where no line is numeric, trimmed is NULL and error tells so.  A file is one row and is trimmed where it is.
    """
    line, numbers = re.compile(NUMERIC_LINE), re.compile(NUMBER)

    def one(value: str | None) -> tuple[str | None, int, str | None]:
        lines = (value or "").splitlines(keepends=True)
        found = [(i, numbers.findall(x)) for i, x in enumerate(lines) if line.match(x.rstrip("\r\n"))]
        if not found:
            return None, 0, "no numeric lines"
        x, y = (np.array([float(n[j]) for _, n in found]) for j in (0, -1))
        a, b = kernels.edge_range(x, y, how)
        scaled = kernels.scaled(y[a:b], how.low, how.high)
        kept = {found[i][0]: f"{x[i]:.10g}\t{scaled[i - a]:.10g}\n" for i in range(a, b)}
        gone = {i for i, _ in found} - set(kept)
        return "".join(kept.get(i, x) for i, x in enumerate(lines) if i not in gone), b - a, None

    def run(b: pa.RecordBatch) -> dict:
        out = [one(x) for x in b.column(text).to_pylist()]
        return {"trimmed": pa.array([o[0] for o in out], pa.string()), "kept": pa.array([o[1] for o in out], pa.int32()), "error": pa.array([o[2] for o in out], pa.string())}

    return _kernel(files.select(key, text), run, "trimmed string, kept int, error string")
