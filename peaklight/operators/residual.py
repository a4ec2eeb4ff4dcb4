"""What a query keeps when its best match is taken off: from points in long form, or from whole vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peaklight.functions import kernels
from peaklight.model import Residual


def project(points: DataFrame, how: Residual | None = None, key: str = "signal") -> tuple[DataFrame, DataFrame]:
    """points: key, pos, q, c (aligned candidate), mask (query), support (shifted reference).

    Returns (summary, vectors).  summary has one row per key: scale = max(0,
    <q,c>/<c,c>) on common support, improvement, negative fractions and
    common_points; keys with too few common points or no energy drop out.  vectors has a row per point:
    residual, usable (edge_guard points on both sides of a change of support inside the mask are not)
    and matching, the residual divided by its largest usable size.
    """
    how = how or Residual()
    rows = points.withColumn("common", F.col("mask") & F.col("support"))
    fit = rows.where("common").groupBy(key).agg(F.sum(F.col("q") * F.col("c")).alias("qc"), F.sum(F.col("c") * F.col("c")).alias("cc"), F.sum(F.col("q") * F.col("q")).alias("before"), F.count("*").alias("common_points"), F.max(F.abs("q")).alias("amplitude"))
    fit = fit.where(f"common_points >= {how.min_common} and cc > 1e-12").withColumn("scale", F.greatest(F.lit(0.0), F.col("qc") / F.col("cc")))
    w = Window.partitionBy(key).orderBy("pos")
    edge = F.col("mask") & F.lag("mask").over(w) & (F.col("common") != F.lag("common").over(w))
    near = F.max(F.coalesce(F.col("_edge"), F.lit(False)).cast("int")).over(w.rowsBetween(-(how.edge_guard - 1), how.edge_guard)) if how.edge_guard else F.lit(0)
    rows = rows.withColumn("_edge", edge).withColumn("usable", F.col("mask") & (near == 0)).drop("_edge").join(fit.select(key, "scale"), key)
    rows = rows.withColumn("residual", F.when(~F.col("mask"), F.lit(0.0)).when(F.col("common"), F.col("q") - F.col("scale") * F.col("c")).otherwise(F.col("q")))
    negative = F.col("residual") < -1e-6 * F.greatest(F.lit(1e-12), F.col("amplitude"))
    energy = rows.where("common").join(fit.select(key, "amplitude"), key).groupBy(key).agg(
        F.sum(F.col("residual") * F.col("residual")).alias("after"), F.avg(negative.cast("double")).alias("negative_points"), F.sum(F.when(negative, F.col("residual") * F.col("residual")).otherwise(0.0)).alias("negative_energy")
    )
    gain = F.when(F.col("before") > 1e-12, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("before") - F.col("after")) / F.col("before")))).otherwise(F.lit(0.0))
    summary = fit.join(energy, key).select(key, "scale", "common_points", gain.alias("improvement"), "negative_points", F.when(F.col("after") > 1e-12, F.col("negative_energy") / F.col("after")).otherwise(F.lit(0.0)).alias("negative_energy"))
    top = F.max(F.when(F.col("usable"), F.abs("residual"))).over(Window.partitionBy(key))
    vectors = rows.withColumn("matching", F.when(F.col("usable") & (top > 1e-12), F.col("residual") / top).otherwise(F.lit(0.0)))
    return summary, vectors


def worth_searching(summary: DataFrame, how: Residual | None = None) -> DataFrame:
    return summary.withColumn("worth", F.col("improvement") >= (how or Residual()).min_improvement)


def project_vectors(rows: DataFrame, how: Residual | None = None) -> DataFrame:
    """project() for whole vectors: columns q, c (array<double>), mask, support (array<boolean>) give their place to
    scale, common_points, improvement, negative_points, negative_energy, residual, usable and matching.

    Rows stay where they are; nothing is exploded or shuffled.  Rows of a batch
    may differ in length.  Those with too few common points or no energy drop out.
    """
    how = how or Residual()
    keep = [c for c in rows.columns if c not in ("q", "c", "mask", "support")]

    def matrix(column: pa.ListArray, at: np.ndarray, n: int, kind) -> np.ndarray:
        return column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(at), n)

    def lists(x: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.diff(b.column("c").offsets.to_numpy())
            for n in np.unique(size).tolist():
                at = np.flatnonzero(size == n)
                out = kernels.residuals(*(matrix(b.column(c), at, n, kind) for c, kind in (("q", float), ("mask", bool), ("c", float), ("support", bool))), how.edge_guard)
                fine = (out["common_points"] >= how.min_common) & (out.pop("energy") > kernels.TINY)
                columns = [pa.array(x) if x.ndim == 1 else lists(x) for x in out.values()]
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(at)) for c in keep), *columns], names=[*keep, *out]).filter(pa.array(fine))

    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep]
    added = "scale double, common_points long, improvement double, negative_points double, negative_energy double, residual array<double>, usable array<boolean>, matching array<double>"
    return rows.mapInArrow(run, ", ".join([*kinds, added]))
