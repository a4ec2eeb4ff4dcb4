"""Thinning a library: per name, representatives of clusters of fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peaklight.functions import kernels
from peaklight.model import Reduction
from peaklight.operators import cluster

#: Order of quality flags, better first.
FLAG_RANK = {"s": 0, "": 1, "x": 2}
#: Points of spectra and of their fingerprints that a task works on at once (4 MB); a longer row is a slice of its own.
SLICE_POINTS = 1 << 19


def medoid(library: DataFrame, group: str = "label", vector: str = "vector", row: str = "row_id") -> DataFrame:
    """Of each group the row of least mean cosine distance to all of it, and that mean; ties by row.

    The sum of cosines of a row with its group is its dot product with the sum of
    the unit vectors, so no pairs are needed: each task sums the vectors of its groups,
    only these sums are shuffled point by point, and one join brings a group's sum to its rows.
    """
    kind = library.schema[group].dataType.simpleString()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for b in batches:
            for name, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                u = kernels.units(np.array(x, float)[None])[0]
                n, seen = total.get(name, (0, 0.0))
                total[name] = (n + 1, seen + u)
        if total:
            names = list(total)
            yield pa.RecordBatch.from_arrays([pa.array(names, b.column(0).type), pa.array([total[x][0] for x in names], pa.int64()), pa.array([total[x][1] for x in names], pa.list_(pa.float64()))], names=["g", "n", "u"])

    rows = library.where(F.col(vector).isNotNull()).select(F.col(group).alias("g"), F.col(vector).cast("array<double>").alias("v"), F.col(row).alias("r"))
    parts = rows.select("g", "v").mapInArrow(sums, f"g {kind}, n long, u array<double>")
    points = parts.select("g", "n", F.posexplode("u").alias("i", "x")).groupBy("g", "i").agg(F.sum("x").alias("t"), F.sum("n").alias("n"))
    whole = points.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "t"))), lambda p: p["t"]).alias("t"), F.max("n").alias("members"))
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    dot = F.aggregate(F.zip_with("v", "t", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    ranked = rows.join(whole, rows["g"].eqNullSafe(whole["g"])).select(rows["g"], "r", "members", (1 - F.when(size > 0, dot / size).otherwise(0.0) / F.col("members")).alias("d"))
    best = ranked.groupBy("g").agg(F.min(F.struct(F.round("d", 9).alias("d"), "r")).alias("m"), F.first("members").alias("members"))
    return best.select(F.col("g").alias(group), F.col("m.r").alias(row), F.col("m.d").alias("mean_distance"), "members")


def fingerprints(sources: DataFrame, how: Reduction | None = None) -> DataFrame:
    """Adds fingerprint, x_min, x_max, outside and failure to rows with axis, intensity and error.

    A spectrum in order of its axis is corrected by plain asymmetric least squares, scaled to 0..1,
    interpolated on the grid of ``how`` with zeros outside, and divided by its length.  One whose axis misses the grid, or that
    vanishes on it, is ``outside``; of one that can't be read, ``failure`` tells why.  Both have a NULL fingerprint, which decluster() keeps.
    Rows stay where they are; spectra of one length are corrected together, in slices of SLICE_POINTS, so memory follows neither the rows of a batch nor the grid.
    """
    how = how or Reduction()
    grid = np.arange(how.minimum, how.maximum + how.step / 2, how.step)

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [np.asarray(pc.fill_null(pc.list_value_length(batch.column(c)), 0)) for c in ("axis", "intensity")]
            ends = np.cumsum(len(grid) + sizes[0].astype(np.int64) + sizes[1])
            i = 0
            while i < len(batch):
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + SLICE_POINTS, "right")))
                yield batch.slice(i, j - i)
                i = j

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found: list = [None] * len(b)
            for i, (x, y, error) in enumerate(zip(*(b.column(c).to_pylist() for c in ("axis", "intensity", "error")), strict=True)):
                x, y = (np.array([] if v is None else v, float) for v in (x, y))
                if error is not None or not len(x) or len(x) != len(y):
                    found[i] = (None, None, None, False, error or "empty spectrum")
                    continue
                order = np.argsort(x, kind="stable")
                x, y = x[order], y[order]
                if x[-1] < grid[0] or x[0] > grid[-1]:
                    found[i] = (None, float(x[0]), float(x[-1]), True, None)
                elif not (np.isfinite(x).all() and np.isfinite(y).all()):
                    found[i] = (None, float(x[0]), float(x[-1]), False, "non-finite values")
                else:
                    found[i] = (x, y)
            open_rows = [i for i, f in enumerate(found) if len(f) == 2]
            for n in {len(found[i][0]) for i in open_rows}:
                at = [i for i in open_rows if len(found[i][0]) == n]
                y = np.stack([found[i][1] for i in at])
                flat = kernels.minmax(y - kernels.plain_als(y))
                for i, z in zip(at, flat, strict=True):
                    x = found[i][0]
                    vector = kernels.on_axis(x, z, grid)
                    length = float(np.linalg.norm(vector))
                    found[i] = (vector / length if length > 0 else None, float(x[0]), float(x[-1]), length == 0, None)
            kinds = [pa.list_(pa.float64()), pa.float64(), pa.float64(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([f[i] for f in found], k) for i, k in enumerate(kinds))], names=[*b.schema.names, "fingerprint", "x_min", "x_max", "outside", "failure"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sources.schema)
    return sources.mapInArrow(run, f"{kinds}, fingerprint array<double>, x_min double, x_max double, outside boolean, failure string")


#: Rows of a name that one task clusters at most; larger names are clustered in passes over all tasks.
TASK_ROWS = 20_000


def decluster(library: DataFrame, how: Reduction | None = None, group: str = "name", task_rows: int = TASK_ROWS) -> DataFrame:
    """Adds cluster, keep and reason to rows with row_id, name, flag, fingerprint (NULL: failed or out of range).

    Groups of up to keep_all rows stay whole; rows without a usable fingerprint
    always stay; of the others one medoid per cluster, at most ``representatives``.
    The fingerprints of a name of up to ``task_rows`` rows come to one task, which holds them once or twice over and makes no matrix of all
    pairs.  The rows of larger names, of which there can't be many, stay dealt over all tasks: ``cluster.thinned`` takes the same steps in passes.
    """
    how = how or Reduction()
    rank = FLAG_RANK

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row_id").reset_index(drop=True)
        usable = rows["fingerprint"].map(lambda v: v is not None and len(v) > 0 and float(np.linalg.norm(v)) > 0).to_numpy(bool)
        out = pd.DataFrame({"row_id": rows["row_id"], group: rows[group], "cluster": -1, "keep": True, "reason": np.where(usable, "small group", "no fingerprint")})
        if usable.sum() > how.keep_all:
            x = np.stack(rows["fingerprint"][usable].to_list()).astype(float)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            flags = rows["flag"][usable].map(lambda f: rank.get(f or "", 1)).to_numpy()
            label, tops = kernels.representatives(x, flags, how.least_k, how.most_k, how.components, how.representatives, how.medoid_seeds, how.seed)
            at = np.flatnonzero(usable)
            out.loc[at, "cluster"] = label
            out.loc[at, "keep"] = np.isin(np.arange(len(at)), list(tops.values()))
            out.loc[at, "reason"] = np.where(out.loc[at, "keep"], "medoid", "represented")
        return out

    rows = library.select("row_id", group, "flag", "fingerprint")
    large = [r[0] for r in rows.groupBy(group).count().where(F.col("count") > task_rows).select(group).collect()]
    if large:
        size = F.aggregate("fingerprint", F.lit(0.0), lambda s, x: s + x * x)
        usable = F.coalesce((size > 0) & ~F.isnan(size), F.lit(False))
        typed = rows.withColumn("fingerprint", F.col("fingerprint").cast("array<double>"))
        parts = [cluster.thinned(typed.where(F.col(group).eqNullSafe(F.lit(name))), how, group, usable, rank) for name in large]
        small = F.lit(True)
        for name in large:
            small = small & ~F.col(group).eqNullSafe(F.lit(name))
        out = _grouped(rows.where(small), one, group, library)
        for part in parts:
            out = out.unionByName(part)
        return out
    return _grouped(rows, one, group, library)


def _grouped(rows: DataFrame, one, group: str, library: DataFrame) -> DataFrame:
    return rows.groupBy(group).applyInPandas(one, f"row_id long, `{group}` {library.schema[group].dataType.simpleString()}, cluster int, keep boolean, reason string")


def reduction_report(declustered: DataFrame, group: str = "name") -> DataFrame:
    return declustered.groupBy(group).agg(F.count("*").alias("spectra"), F.count_if("keep").alias("kept"), F.countDistinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("clusters"), F.count_if(F.col("reason") == "no fingerprint").alias("without_fingerprint"))


def two_best(rows: DataFrame, group: str, score: str, row: str) -> DataFrame:
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(group).orderBy(F.col(score).desc(), row))).where("nth <= 2")
