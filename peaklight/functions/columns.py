"""Column functions on arrays; all but the hash of their bytes stay inside the JVM."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def doubles(c: Column) -> Column:
    return c.cast("array<double>")


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) where c is evaluated once for a row, however often f names it; a column written out several times is evaluated as often."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def minmax(c: Column) -> Column:
    """Scaled to 0..1; a constant array becomes zeros."""
    low, high = F.array_min(c), F.array_max(c)
    return F.transform(c, lambda v: F.when(high > low, (v - low) / (high - low)).otherwise(F.lit(0.0)))


def to_peak(c: Column) -> Column:
    """Divided by the largest value, or by the largest size if none is positive; zeros if that vanishes too."""
    top = F.array_max(c)
    size = F.when(top > 1e-12, top).otherwise(F.array_max(F.transform(c, F.abs)))
    return F.transform(c, lambda v: F.when(size > 1e-12, v / size).otherwise(F.lit(0.0)))


def scaled(c: Column, low: float = 0.0, high: float = 1000.0) -> Column:
    """Scaled to low..high; a constant array becomes low."""
    least, most = F.array_min(c), F.array_max(c)
    return F.transform(c, lambda v: F.when(most > least, low + (v - least) / (most - least) * (high - low)).otherwise(F.lit(float(low))))


def shift(c: Column, k: int, zero=0.0) -> Column:
    """Moved right by k places, zeros coming in."""
    n = F.size(c)
    if k == 0:
        return c
    fill = F.array_repeat(F.lit(zero), F.least(F.lit(abs(k)), n))
    return F.concat(fill, F.slice(c, 1, F.greatest(n - k, F.lit(0)))) if k > 0 else F.concat(F.slice(c, 1 - k, F.greatest(n + k, F.lit(0))), fill)


def support_runs(runs: Column, start: Column, end: Column) -> Column:
    """The stated runs; where they are NULL, the one run from start to end."""
    return F.coalesce(runs, F.array(F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))))


def mask_of(runs: Column, n: Column | int) -> Column:
    size = n if isinstance(n, Column) else F.lit(n)
    return F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.exists(runs, lambda r: i.between(r["start"], r["end"])))


def merged_runs(runs: Column) -> Column:
    """Sorted runs, united where they overlap or touch."""
    kind = "array<struct<start:int,end:int>>"

    def add(done, run):
        last = F.element_at(done, -1)
        joins = (F.size(done) > 0) & (run["start"] <= last["end"] + 1)
        grown = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], run["end"]).alias("end"))))
        return F.when(joins, grown).otherwise(F.concat(done, F.array(run))).cast(kind)

    return F.aggregate(F.array_sort(runs).cast(kind), F.array().cast(kind), add)


def run_points(runs: Column) -> Column:
    return F.aggregate(runs, F.lit(0), lambda n, r: n + r["end"] - r["start"] + 1)


def eroded(mask: Column) -> Column:
    """True where the point and both neighbours are; never at the ends."""
    n = F.size(mask)
    return F.transform(mask, lambda m, i: m & (i > 0) & (i < n - 1) & F.coalesce(F.get(mask, i - 1), F.lit(False)) & F.coalesce(F.get(mask, i + 1), F.lit(False)))


def gradient(c: Column) -> Column:
    """Central differences, one-sided at the ends."""
    n = F.size(c)
    return F.transform(c, lambda v, i: F.when(n < 2, F.lit(0.0)).when(i == 0, F.get(c, F.lit(1)) - v).when(i == n - 1, v - F.get(c, i - 1)).otherwise((F.get(c, i + 1) - F.get(c, i - 1)) / 2))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm vanishes."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def wilson_half_width(hits: Column, total: Column, z: float = 1.96) -> Column:
    """Half the width of Wilson's interval of a share; 0 without any trials."""
    p = hits / total
    return F.when(total > 0, z / (1 + z * z / total) * F.sqrt(p * (1 - p) / total + z * z / (4 * total * total))).otherwise(F.lit(0.0))


def gap_masked(values: Column, mask: Column) -> Column:
    """Values where the mask holds, NULL elsewhere: a line drawn through them breaks at gaps."""
    return F.zip_with(values, mask, lambda v, m: F.when(m, v))


def clipped_trace(values: Column, runs: Column, low: Column | int, high: Column | int) -> Column:
    """(pos, value) of the points inside the support and low..high."""
    points = F.transform(values, lambda v, i: F.struct(i.alias("pos"), v.alias("value")))
    return F.filter(points, lambda p: p["pos"].between(low, high) & F.exists(runs, lambda r: p["pos"].between(r["start"], r["end"])))


@F.pandas_udf(StringType())
def content_hash(values: pd.Series, mask: pd.Series) -> pd.Series:
    """SHA-256 over the number of values (8 bytes), the values as little-endian 32-bit floats (NULL as not a number), and the mask as one byte each."""

    def one(v, m) -> str:
        v = [] if v is None else v
        body = len(v).to_bytes(8, "little") + np.array([np.nan if x is None else x for x in v], "<f4").tobytes()
        return hashlib.sha256(body + (np.array([bool(x) for x in m], np.uint8).tobytes() if m is not None else b"")).hexdigest()

    return pd.Series([one(v, m) for v, m in zip(values, mask, strict=True)])
