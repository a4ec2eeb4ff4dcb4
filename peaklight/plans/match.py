"""The whole query: eligible rows, coverage, screening, alignment, phases, decision, rows to show."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peaklight.functions import columns as C
from peaklight.model import Baseline, Evidence, Grid, Matching, Query, Residual
from peaklight.operators import evidence, library, residual, search

#: Columns that a result row carries from the library.
CARRIED = ["row_id", "name", "variant", "specimen", "acquisition", "reference_id"]


def pooled(packs: dict[str, DataFrame], query: Query, top_n: int, how: Matching) -> DataFrame:
    """Refined rows of all packs that share the query's support, without excluded phases.

    Each pack is filtered by predicates, screened with a map, cut to its
    shortlist with a top-k, and only then aligned.
    """
    out = None
    for variant, pack in packs.items():
        rows = pack.where("l2 > 0") if "l2" in pack.columns else pack
        rows = search.covered_enough(rows, query.mask, how.min_coverage).drop("requested", "covered", "coverage")
        if query.exclude:
            rows = rows.where(~search.phase_key(F.col("name")).isin(sorted(query.exclude)))
        keep = [c for c in CARRIED if c in rows.columns] + [c for c in search.NEEDS if c != "row_id"]
        short = search.shortlist(search.screen(rows, query.vector, query.mask, keep, how.offset_query), how.shortlist(variant, top_n))
        # The shortlist is one partition of bounded size; alignment is worth all cores.
        short = short.repartition(min(64, pack.sparkSession.sparkContext.defaultParallelism))
        refined = search.refine(short, query.vector, query.mask, how, [c for c in keep if c not in search.NEEDS or c == "row_id"])
        out = refined if out is None else out.unionByName(refined)
    return out


def match(packs: dict[str, DataFrame], query: Query, top_n: int = 60, how: Matching | None = None, policy: Evidence | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows to show, phases, decision).

    The pool holds the shortlists at most, whatever the size of the library; so it, its phases and its annotated rows are
    cached for their several uses in one partition, and all that follows needs no shuffle.  release() frees them.
    """
    how = how or Matching()
    pool = pooled(packs, query, top_n, how).repartition(1).persist()
    phases = evidence.rank_phases(pool).persist()
    decision = evidence.decide(phases, policy).persist()
    rows = evidence.annotate(pool, phases, decision).withColumn("identity", search.presentation_identity(F.lit(""), F.col("reference_id"), F.col("row_id"))).persist()
    shown = search.diverse_top(rows, top_n, how)
    shown.held = [pool, phases, decision, rows]
    return shown, phases, decision


def release(shown: DataFrame) -> None:
    """Free what match() has cached, once its results have been read or written."""
    for df in getattr(shown, "held", []):
        df.unpersist()


def query_of(x, y, grid: Grid, baseline: Baseline | None = None, low: float | None = None, high: float | None = None, shift: float = 0.0, **more) -> Query:
    """A query from one spectrum: preprocessed segment by segment on its own axis, moved by the calibration shift, put on the grid.

    The mask is taken after that: the points of the grid that lie in a segment and in low..high (all by default); the vector is zero elsewhere.
    """
    segments = [library.even_segments(x, y, grid.step)]
    vector, runs = library.project((library.corrected(segments, baseline) if baseline else segments)[0], grid, shift)
    place = grid.minimum + grid.step * np.arange(len(grid))
    mask = np.zeros(len(grid), bool)
    for a, b in runs:
        mask[a : b + 1] = True
    mask &= (place >= (grid.minimum if low is None else low)) & (place <= (grid.maximum if high is None else high))
    return Query(np.where(mask, vector, 0.0).tolist(), mask.tolist(), **more)


@dataclass(frozen=True)
class Left:
    """What a query keeps of itself when a result is taken off, with the exact row that was subtracted."""

    vector: list[float]
    usable: list[bool]
    variant: str
    row_id: int
    phase: str
    scale: float
    improvement: float


def residual_of(packs: dict[str, DataFrame], query: Query, result: DataFrame, how: Residual | None = None) -> Left:
    """The residual of a query after the first of ``result`` (variant, row_id, shift): that row's vector, moved by the shift, is subtracted.

    The row is looked up by (variant, row_id) in the pack it was found in; one vector comes to the driver, as the query of the next search.
    """
    chosen = result.select("variant", "row_id", "shift").first()
    rows, n, k = packs[chosen.variant].where(F.col("row_id") == chosen.row_id), len(query.vector), int(chosen.shift)
    support = C.mask_of(C.support_runs(F.col("support_runs"), F.col("start_idx"), F.col("end_idx")), n)
    q, mask = F.array(*map(F.lit, map(float, query.vector))), F.array(*map(F.lit, query.mask))
    points = rows.select(F.lit(chosen.variant).alias("variant"), "row_id", "name", q.alias("q"), C.shift(C.doubles(F.col("vector")), k).alias("c"), mask.alias("mask"), C.shift(support, k, False).alias("support"))
    left = residual.project_vectors(points, how).withColumn("phase", search.phase_key(F.col("name"))).first()
    if left is None:
        raise ValueError("the result shares too few points with the query to be subtracted")
    return Left(list(left.matching), list(left.usable), left.variant, left.row_id, left.phase, left.scale, left.improvement)


def residual_match(packs: dict[str, DataFrame], residual: list[float], usable: list[bool], primary: str, top_n: int = 60, how: Matching | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Search what is left: signed, so its offset stays; its phase is out; peaks must agree."""
    how = replace(how or Matching(), offset_query=False, min_pcs=0.15)
    return match(packs, Query(residual, usable, "BC", frozenset({primary})), top_n, how)
