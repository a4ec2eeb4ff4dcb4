"""Masked, shift-tolerant similarity search of a query over a library of vectors.

The library is a DataFrame with a row per reference: row_id, name, variant,
vector (array), start_idx, end_idx, support_runs.  The query is one vector, so
it travels with the task; library rows never move before the top of each
partition has been taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peaklight.functions import columns as C
from peaklight.functions import kernels
from peaklight.functions.text import acquisition_group, first_text, independence_group, phase_key
from peaklight.model import Matching


def element_policy(elements: Column, has_formula: Column, include: list[str], exclude: list[str], mode: str = "must_include_all", allow_missing: bool = True) -> Column:
    """True where a reference's elements fit: none excluded, and by mode all of / only / exactly the included ones."""
    wanted, banned = (F.array(*map(F.lit, x)).cast("array<string>") for x in (include, exclude))
    rules = {
        "must_include_all": F.size(F.array_except(wanted, elements)) == 0,
        "only_from_list": F.size(F.array_except(elements, wanted)) == 0,
        "exact_set": (F.size(F.array_except(wanted, elements)) == 0) & (F.size(F.array_except(elements, wanted)) == 0),
    }
    fits = rules[mode] if include else F.lit(True)
    return F.when(~has_formula, F.lit(allow_missing)).when(F.arrays_overlap(elements, banned), F.lit(False)).otherwise(fits)


def eligible(library: DataFrame, fits: Column, drop_processed: bool) -> DataFrame:
    """Rows that the policy admits; corrected variants leave out what was processed before."""
    rows = library.where(fits)
    return rows.where("not coalesce(already_processed, false)") if drop_processed else rows


def background_neutral(raw: DataFrame, corrected: DataFrame) -> DataFrame:
    """References that carry no background: processed ones as they are, and all that were corrected."""
    return raw.where("coalesce(already_processed, false)").unionByName(corrected.where("db_baseline"))


def coverage(library: DataFrame, mask: list[bool], low: int = 0, high: int | None = None) -> DataFrame:
    """Adds requested, covered and coverage: the share of the query's points in range that the support runs hold.

    Prefix sums of the query's mask are a constant array; each run costs two look-ups.
    """
    high = len(mask) - 1 if high is None else high
    wanted = [bool(m) and low <= i <= high for i, m in enumerate(mask)]
    sums = np.concatenate([[0], np.cumsum(wanted)]).tolist()
    n, total, prefix = len(mask), sums[-1], F.array(*map(F.lit, sums))
    runs = C.support_runs(F.col("support_runs"), F.col("start_idx"), F.col("end_idx"))
    held = F.aggregate(runs, F.lit(0), lambda s, r: s + F.when(r["end"] >= r["start"], F.get(prefix, F.least(r["end"] + 1, F.lit(n))) - F.get(prefix, F.greatest(r["start"], F.lit(0)))).otherwise(0))
    out = library.withColumn("requested", F.lit(total).cast("long")).withColumn("covered", held.cast("long"))
    return out.withColumn("coverage", F.when(F.col("requested") > 0, F.col("covered") / F.col("requested")).otherwise(F.lit(0.0)))


def covered_enough(library: DataFrame, mask: list[bool], least: float, low: int = 0, high: int | None = None) -> DataFrame:
    return coverage(library, mask, low, high).where(f"requested > 0 and coverage >= {least}")


def _matrix(batch: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and supports of a batch as matrices."""
    column = batch.column("vector")
    v = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(batch), n)
    s = np.zeros((len(batch), n), bool)
    runs, start, end = (batch.column(c).to_pylist() for c in ("support_runs", "start_idx", "end_idx"))
    for i, own in enumerate(runs):
        for a, b in [(r["start"], r["end"]) for r in own] if own is not None else [(start[i], end[i])]:
            s[i, max(0, a) : b + 1] = True
    return np.where(np.isfinite(v), v, 0.0), s


NEEDS = ("row_id", "vector", "start_idx", "end_idx", "support_runs")


def screen(library: DataFrame, vector: list[float], mask: list[bool], keep: list[str] | None = None, offset_query: bool = True) -> DataFrame:
    """Adds screen, the cosine on common support with local offsets removed; rows without any drop out.

    Only the columns in ``keep`` (all by default) come back from the kernel.
    """
    q, m, n = np.array(vector, float), np.array(mask, bool), len(vector)
    keep = keep or library.columns
    needed = list(dict.fromkeys([*keep, *NEEDS]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, s = _matrix(b, n)
            common = s & m[None]
            score = kernels.masked_cosines(q[None], v, common, offset_query, True)
            out = pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(score)], names=[*keep, "screen"])
            yield out.filter(pa.array((common.sum(1) >= 2) & (score > -1)))

    kinds = ", ".join(f"`{c}` {library.schema[c].dataType.simpleString()}" for c in keep)
    return library.select(*needed).mapInArrow(run, f"{kinds}, screen double")


def shortlist(screened: DataFrame, size: int) -> DataFrame:
    """The best rows; ties by row_id.  Each partition sends at most ``size`` rows."""
    return screened.orderBy(F.col("screen").desc(), "row_id").limit(size)


ALIGNED = "similarity double, shape double, gradient double, shift int, common int, requested int, support_points int, shifted_support_points int, coverage_fraction double, reference_overlap_fraction double, shift_boundary boolean, grid_clipped boolean, pcs double, pcs_f1 double, pcs_rho double, rank_score double"


def refine(rows: DataFrame, vector: list[float], mask: list[bool], how: Matching, keep: list[str]) -> DataFrame:
    """Aligns each row with the query, compares their peaks and composes the rank score.

    rank_score = w * similarity + (1 - w) * pcs.  Rows without support, with a
    zero norm, a negative similarity or too little agreement of peaks drop out.
    """
    q, m, n = np.array(vector, float), np.array(mask, bool), len(vector)
    needed = list(dict.fromkeys([*keep, *NEEDS]))
    w = how.similarity_weight

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, s = _matrix(b, n)
            best = kernels.align(v, s, q, m, how)
            k = best["shift"]
            peaks = np.zeros((len(b), 3))
            for i in np.flatnonzero(best["score"] >= 0):
                one = slice(i, i + 1)
                peaks[i] = kernels.peak_consistency(q, kernels.shifted(v[one], int(k[i]))[0], m & kernels.shifted(s[one], int(k[i]))[0], how)
            first = np.where(s.any(1), s.argmax(1), n)
            last = np.where(s.any(1), n - 1 - s[:, ::-1].argmax(1), -1)
            requested, points = int(m.sum()), s.sum(1)
            place = np.arange(n)[None] + k[:, None]
            moved = (s & (place >= 0) & (place < n)).sum(1)
            columns = {
                "similarity": best["score"],
                "shape": best["shape"],
                "gradient": best["gradient"],
                "shift": pa.array(k, pa.int32()),
                "common": pa.array(best["common"], pa.int32()),
                "requested": pa.array(np.full(len(b), requested), pa.int32()),
                "support_points": pa.array(points, pa.int32()),
                "shifted_support_points": pa.array(moved, pa.int32()),
                "coverage_fraction": best["common"] / max(1, requested),
                "reference_overlap_fraction": best["common"] / np.maximum(1, moved),
                "shift_boundary": (np.abs(k) == how.max_shift) & (how.max_shift > 0),
                "grid_clipped": s.any(1) & ((first + k < 0) | (last + k > n - 1)),
                "pcs": peaks[:, 0],
                "pcs_f1": peaks[:, 1],
                "pcs_rho": peaks[:, 2],
                "rank_score": w * best["score"] + (1 - w) * peaks[:, 0],
            }
            out = pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values())], names=[*keep, *columns])
            ok = s.any(1) & (np.linalg.norm(v, axis=1) > 0) & (best["score"] >= 0) & (peaks[:, 0] >= how.min_pcs)
            yield out.filter(pa.array(ok))

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.select(*needed).mapInArrow(run, f"{kinds}, {ALIGNED}")


def result_rows(refined: DataFrame, how: Matching, step: float = 1.0) -> DataFrame:
    """Adds to refined rows all that a result states about its alignment and its rank.

    The shift in axis units, the largest shift tried, the three weights, the contributions of shape, gradient and peaks to the rank
    score (they add up to it), and the acquisition and independence groups where the columns they need are there.
    """
    w, g = how.similarity_weight, how.gradient_weight
    out = refined.withColumn("shift_cm1", F.col("shift") * F.lit(float(step))).withColumn("maximum_shift_points", F.lit(how.max_shift))
    for name, value in (("gradient_weight_within_similarity", g), ("spectral_similarity_weight", w), ("peak_consistency_weight", 1 - w)):
        out = out.withColumn(name, F.lit(float(value)))
    for name, share in (("shape", w * (1 - g)), ("gradient", w * g), ("pcs", 1 - w)):
        out = out.withColumn(f"{name}_contribution", share * F.col(name))
    fields = ("independence_group", "specimen_id", "accession", "rruff_id", "rod_id", "source_accession")
    row = {c: F.col(c) for c in fields if c in refined.columns}
    stated = {f.name for f in refined.schema["provenance"].dataType.fields} if "provenance" in refined.columns else set()
    provenance = {c: F.col(f"provenance.{c}") for c in (*fields, "source") if c in stated}
    if "name" in refined.columns:
        out = out.withColumn("independence_group", independence_group(row, provenance, F.col("name")))
        explicit = F.col("acquisition_group") if "acquisition_group" in refined.columns else F.lit("")
        out = out.withColumn("acquisition_group", acquisition_group(explicit, F.col("filename") if "filename" in refined.columns else F.lit(""), F.col("independence_group")))
    return out


def rank_components(rows: DataFrame, weight: float = 0.88, similarity: str = "similarity", pcs: str = "pcs") -> DataFrame:
    """Adds the two contributions, their sum, and a check that they reproduce a given rank_score within 1e-9."""
    out = rows.withColumn("similarity_part", weight * F.col(similarity)).withColumn("pcs_part", (1 - weight) * F.col(pcs))
    out = out.withColumn("composed", F.col("similarity_part") + F.col("pcs_part"))
    return out.withColumn("consistent", F.abs(F.col("composed") - F.col("rank_score")) <= 1e-9 if "rank_score" in rows.columns else F.lit(True))


def final_score(rank_score: Column, similarity: Column, pcs: Column, weight: float = 0.88) -> Column:
    return F.coalesce(rank_score, weight * similarity + (1 - weight) * F.coalesce(pcs, F.lit(0.0)))


def presentation_identity(path: Column, reference: Column, row: Column) -> Column:
    return first_text(path, reference, F.concat(F.lit("row:"), row.cast("string")))


def diverse_top(rows: DataFrame, top_n: int, how: Matching | None = None, identity: str = "identity", name: str = "name") -> DataFrame:
    """The ``top_n`` rows to show: one per identity, few per phase first, and slots for phases that only peaks support.

    Order: phase_score, rank_score, similarity, pcs, all descending, then input
    position (row_id).  At most max(2, min(cap, ceil(n/8))) rows of a phase come before
    the others fill up; up to max(2, min(slots, n div 5)) rows of phases not yet
    shown, with enough pcs and similarity, then replace the tail.  The input is a
    shortlist, so the last windows run over few rows.
    """
    how = how or Matching()
    order = [F.col("phase_score").desc(), F.col("rank_score").desc(), F.col("similarity").desc(), F.col("pcs").desc(), F.col("row_id")]
    cap = max(2, min(how.phase_cap, -(-top_n // 8)))
    slots = max(2, min(how.peak_slots, top_n // 5))
    unique = rows.withColumn("_i", F.row_number().over(Window.partitionBy(identity).orderBy(*order))).where("_i = 1").withColumn("_phase", phase_key(F.col(name)))
    ranked = unique.withColumn("_nth", F.row_number().over(Window.partitionBy("_phase").orderBy(*order)))
    ranked = ranked.withColumn("_late", (F.col("_nth") > cap).cast("int"))
    chosen = ranked.orderBy("_late", *order).limit(top_n)
    best = ranked.withColumn("_p", F.row_number().over(Window.partitionBy("_phase").orderBy(F.col("pcs").desc(), F.col("similarity").desc(), *order))).where("_p = 1")
    fresh = best.join(chosen.select("_phase").distinct(), "_phase", "left_anti").where(f"pcs >= {how.slot_pcs} and similarity >= {how.slot_similarity}")
    fresh = fresh.orderBy(F.col("pcs").desc(), F.col("similarity").desc(), *order).limit(slots)
    added = fresh.agg(F.count("*").alias("_added"))
    place = chosen.withColumn("_at", F.row_number().over(Window.orderBy("_late", *order))).crossJoin(F.broadcast(added)).where(f"_at <= {top_n} - _added")
    out = place.select(rows.columns).unionByName(fresh.select(rows.columns))
    return out.withColumn("place", F.row_number().over(Window.orderBy(*order)))


#: Numbers of a result that must be finite, those that are counts, and flags, where a row has them.
NUMBERS = ("rank_score", "similarity", "shape", "gradient", "pcs", "pcs_f1", "pcs_rho", "shift", "coverage_fraction", "reference_overlap_fraction", "shift_cm1", "shape_contribution", "gradient_contribution", "pcs_contribution")
COUNTS = ("common", "requested", "support_points", "shifted_support_points", "maximum_shift_points")
FLAGS = ("shift_boundary", "grid_clipped")
WEIGHTS = ("gradient_weight_within_similarity", "spectral_similarity_weight", "peak_consistency_weight")


def result_rules(columns: list[str], weight: float = 0.88, step: float | None = None) -> dict[str, Column]:
    """By name, what is wrong with a result row: true where it breaks the rule.  Rules need the columns of refine() and of result_rows(); those without theirs are left out."""
    have, c = set(columns), F.col
    near = lambda a, b: F.abs(a - b) <= 1e-9 * F.greatest(F.lit(1.0), F.abs(a), F.abs(b))
    share = lambda a, b: F.when(c(b) > 0, c(a) / c(b)).otherwise(0.0)
    w = c("spectral_similarity_weight") if "spectral_similarity_weight" in have else F.lit(weight)
    g = c("gradient_weight_within_similarity")
    any_of = lambda names, f: [f(c(n)) for n in names if n in have]
    # A number that isn't finite breaks this rule alone: it compares with nothing.
    rules = [
        ("finite numbers", any_of(NUMBERS + WEIGHTS, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))),
        ("counts", any_of(COUNTS, lambda x: x.isNull() | (x < 0))),
        ("flags", any_of(FLAGS, lambda x: x.isNull())),
        ("weights", any_of(WEIGHTS, lambda x: ~x.between(0, 1))),
        ("range of similarity", any_of(("similarity",), lambda x: ~x.between(-1 - 1e-9, 1 + 1e-9))),
        ("range of pcs", any_of(("pcs",), lambda x: ~x.between(0, 1))),
        ("range of fractions", any_of(("coverage_fraction", "reference_overlap_fraction"), lambda x: ~x.between(0, 1))),
    ]
    for name, needs, broken in (
        ("rank score", ("rank_score", "similarity", "pcs"), lambda: ~near(c("rank_score"), w * c("similarity") + (1 - w) * c("pcs"))),
        ("peak weight", ("peak_consistency_weight", "spectral_similarity_weight"), lambda: ~near(c("peak_consistency_weight"), 1 - w)),
        ("similarity", ("similarity", "shape", "gradient", "gradient_weight_within_similarity"), lambda: ~near(c("similarity"), (1 - g) * c("shape") + g * c("gradient"))),
        ("shape contribution", ("shape_contribution", "shape", "gradient_weight_within_similarity"), lambda: ~near(c("shape_contribution"), w * (1 - g) * c("shape"))),
        ("gradient contribution", ("gradient_contribution", "gradient", "gradient_weight_within_similarity"), lambda: ~near(c("gradient_contribution"), w * g * c("gradient"))),
        ("pcs contribution", ("pcs_contribution", "pcs"), lambda: ~near(c("pcs_contribution"), (1 - w) * c("pcs"))),
        ("sum of contributions", ("shape_contribution", "gradient_contribution", "pcs_contribution", "rank_score"), lambda: ~near(c("shape_contribution") + c("gradient_contribution") + c("pcs_contribution"), c("rank_score"))),
        ("coverage", ("coverage_fraction", "common", "requested"), lambda: ~near(c("coverage_fraction"), share("common", "requested"))),
        ("overlap", ("reference_overlap_fraction", "common", "shifted_support_points"), lambda: ~near(c("reference_overlap_fraction"), share("common", "shifted_support_points"))),
        ("common points", ("common", "requested"), lambda: c("common") > c("requested")),
        ("common support", ("common", "shifted_support_points"), lambda: c("common") > c("shifted_support_points")),
        ("shifted support", ("shifted_support_points", "support_points"), lambda: c("shifted_support_points") > c("support_points")),
        ("shift", ("shift", "maximum_shift_points"), lambda: F.abs("shift") > c("maximum_shift_points")),
        ("shift boundary", ("shift_boundary", "shift", "maximum_shift_points"), lambda: c("shift_boundary") != ((c("maximum_shift_points") > 0) & (F.abs("shift") == c("maximum_shift_points")))),
        ("grid clipped", ("grid_clipped", "shifted_support_points", "support_points"), lambda: c("grid_clipped") != (c("shifted_support_points") < c("support_points"))),
        ("shift in axis units", ("shift_cm1", "shift"), lambda: ~near(c("shift_cm1"), c("shift") * F.lit(step)) if step is not None else None),
    ):
        if set(needs) <= have and (rule := broken()) is not None:
            rules.append((name, [rule]))
    out = {}
    for name, parts in rules:
        for part in parts:
            out[name] = out[name] | F.coalesce(part, F.lit(False)) if name in out else F.coalesce(part, F.lit(False))
    return out


def self_consistency(rows: DataFrame, weight: float = 0.88, step: float | None = None) -> DataFrame:
    """Adds broken: the names of the rules that a result row breaks, an empty array for a sound row."""
    return rows.withColumn("broken", F.array_compact(F.array(*(F.when(rule, name) for name, rule in result_rules(rows.columns, weight, step).items()))))


def legacy_search(library: DataFrame, x: list[float], y: list[float], top: int = 30, axis: str = "axis", intensity: str = "intensity") -> DataFrame:
    """The older ranking: adds score to the ``top`` rows of a library of spectra with axes of their own.

    The query is put on whole units of the axis, its baseline by plain asymmetric least squares goes, it is smoothed
    (window 11, order 3) and scaled to 0..1; a library spectrum is only interpolated on the query's axis, with zeros outside, and scaled.
    """
    place, value = np.array(x, float), np.array(y, float)
    order = np.argsort(place, kind="stable")
    place, value = place[order], value[order]
    first, last = np.ceil(place[0] - 1e-9), np.floor(place[-1] + 1e-9)
    grid = np.arange(first, last + 1)
    q = np.interp(grid, place, value)[None]
    q = kernels.minmax(kernels.savgol(q - kernels.plain_als(q), 11, 3))[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.zeros((len(b), len(grid)))
            for i, (own_x, own_y) in enumerate(zip(b.column(axis).to_pylist(), b.column(intensity).to_pylist(), strict=True)):
                if own_x:
                    at = np.argsort(own_x, kind="stable")
                    v[i] = kernels.minmax(kernels.on_axis(np.array(own_x, float)[at], np.array(own_y, float)[at], grid))[0]
            size = np.linalg.norm(v, axis=1) * np.linalg.norm(q)
            score = np.where(size > 0, v @ q / np.where(size > 0, size, 1.0), 0.0)
            keep = [i for i, n in enumerate(b.schema.names) if n not in (axis, intensity)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), pa.array(score)], names=[*(b.schema.names[i] for i in keep), "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in library.schema if f.name not in (axis, intensity))
    return library.mapInArrow(run, f"{kinds}, score double").orderBy(F.col("score").desc(), "row_id").limit(top)


def legacy_rank(library: DataFrame, vector: list[float], top: int = 30, vectors: str = "vector") -> DataFrame:
    """Plain cosine of min-max vectors, of spectra that are prepared already; 0 where a norm vanishes."""
    q = C.minmax(F.array(*map(F.lit, map(float, vector))))
    return library.withColumn("score", C.cosine(C.minmax(C.doubles(F.col(vectors))), q)).orderBy(F.col("score").desc(), "row_id").limit(top)


def enrich(shown: DataFrame, provenance: DataFrame) -> DataFrame:
    """Provenance by row_id for the rows to show (a bounded list, so it is the side that is sent); rows without any keep NULLs."""
    known = provenance.join(F.broadcast(shown.select("row_id").distinct()), "row_id", "left_semi")
    return shown.join(known, "row_id", "left")
