"""An exact index for screening: cells of similar references, their bounds, coded vectors, whole vectors.

The index is three Parquet tables in one folder.  ``cells`` has a row per cell with what bounds the score of any of
its rows; ``codes`` has the vectors in one byte per point with a scale for each row; ``vectors`` has them whole.  The two latter
are partitioned by cell, so reading some cells is partition pruning.

A table of queries is answered in three steps that move no vector: cells whose bound is below the scores that some rows surely reach
are skipped; of the others the codes give a lower and an upper bound for every row; and only cells with a row that may be
among the first are read whole and scored.  All bounds are products of matrices, for many queries at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peaklight.functions import kernels
from peaklight.sources.writers import read_json, write_json

#: Rows that a cell should hold, rows that the centres are fitted on at most, centres at most, segments that a cell is bounded by.
CELL_ROWS, SAMPLE, CENTRES, SEGMENTS = 4096, 4096, 1024, 64
#: Bytes of query vectors and number of queries that go to the tasks at once; rows of a tile of bounds at most, and numbers that a matrix of a tile holds at most.
QUERY_BYTES, QUERIES, TILE, NUMBERS = 1 << 22, 2048, 1024, 1 << 19
#: Slack for the rounding of sums; scores are ranked after rounding to this many decimals.
SLACK, DECIMALS = 1e-7, 9
#: Cells that each query looks into first.
PROBES = 2


def edges(points: int, most: int = SEGMENTS) -> np.ndarray:
    """Bounds of at most ``most`` even segments of a grid."""
    return np.unique(np.linspace(0, points, min(points, most) + 1).round().astype(int))


@dataclass
class Rows:
    """Vectors of references with their supports; zero outside of these."""

    v: np.ndarray
    s: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch, n: int) -> Rows:
        flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(float)
        s = supports(batch, n)
        v = flat.reshape(len(batch), n)
        return cls(np.where(s & np.isfinite(v), v, 0.0), s)

    def offset(self) -> np.ndarray:
        """The vectors less their least values on their supports."""
        low = np.where(self.s, self.v, np.inf).min(1, initial=np.inf)
        return np.where(self.s, self.v - np.where(np.isfinite(low), low, 0.0)[:, None], 0.0)


def tiles(rows: int, width: int) -> Iterator[slice]:
    """Stretches of rows whose matrices of ``width`` numbers a row stay small, so that memory follows neither queries nor cells nor rows of a batch."""
    step = max(1, min(TILE, NUMBERS // max(1, width)))
    return (slice(a, min(rows, a + step)) for a in range(0, rows, step))


def supports(batch: pa.RecordBatch, n: int) -> np.ndarray:
    """Masks of the support runs; of start_idx..end_idx where there are none."""
    runs, start, end = batch.column("support_runs"), batch.column("start_idx").to_numpy(zero_copy_only=False), batch.column("end_idx").to_numpy(zero_copy_only=False)
    off = np.asarray(runs.offsets)
    stated = np.asarray(runs.is_valid())
    count = np.where(stated, np.diff(off), 0)
    own = runs.values.slice(int(off[0]), int(off[-1] - off[0])) if len(off) else runs.values
    first, last = (own.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
    row = np.concatenate([np.repeat(np.arange(len(batch)), count), np.flatnonzero(~stated)])
    a = np.clip(np.concatenate([first, start[~stated]]).astype(int), 0, n)
    b = np.clip(np.concatenate([last, end[~stated]]).astype(int) + 1, 0, n)
    ok = b > a
    steps = np.zeros((len(batch), n + 1), np.int32)
    np.add.at(steps, (row[ok], a[ok]), 1)
    np.add.at(steps, (row[ok], b[ok]), -1)
    return np.cumsum(steps, 1)[:, :n] > 0


@dataclass
class Queries:
    """A bounded block of queries: vectors that are zero outside of their masks, and for speed the distinct masks."""

    ids: np.ndarray
    q: np.ndarray
    m: np.ndarray
    offset: bool
    k: int
    masks: np.ndarray = field(init=False)
    which: np.ndarray = field(init=False)

    def __post_init__(self):
        self.q = np.where(self.m, self.q, 0.0)
        self.masks, self.which = np.unique(self.m, axis=0, return_inverse=True)
        self.which = self.which.reshape(-1)
        #: Least values of the stretches of 1, 2, 4, ... points that begin at each point.
        self.stretches: list[np.ndarray] = []

    def least_on(self, patterns: np.ndarray) -> np.ndarray:
        """For each query and each pattern of points the least value on both; 0 where they share nothing.  Two stretches cover a run."""
        if not self.stretches:
            self.stretches = [np.where(self.m, self.q, np.inf)]
            while (half := 1 << (len(self.stretches) - 1)) * 2 <= self.q.shape[1]:
                below = self.stretches[-1]
                self.stretches.append(np.minimum(below[:, :-half], below[:, half:]))
        steps = np.diff(np.pad(patterns.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        row, a = np.nonzero(steps > 0)
        b = np.nonzero(steps < 0)[1]
        run = np.empty((len(self.q), len(row)))
        level = np.frexp(b - a)[1] - 1
        for k in np.unique(level).tolist():
            at = level == k
            run[:, at] = np.minimum(self.stretches[k][:, a[at]], self.stretches[k][:, b[at] - (1 << k)])
        out = np.full((len(self.q), len(patterns)), np.inf)
        if len(row):
            held, first = np.unique(row, return_index=True)
            out[:, held] = np.minimum.reduceat(run, first, axis=1)
        return np.where(np.isfinite(out), out, 0.0)


def lows(v: np.ndarray, m: np.ndarray, s: np.ndarray) -> np.ndarray:
    """For each row of ``v`` (with supports ``s``) and each mask the least value on both; 0 where they share nothing."""
    out = np.zeros((len(m), len(v)))
    for i, mask in enumerate(m):
        low = np.where(s[:, mask], v[:, mask], np.inf).min(1, initial=np.inf)
        out[i] = np.where(np.isfinite(low), low, 0.0)
    return out


def sums(queries: Queries, rows: Rows) -> tuple[np.ndarray, ...]:
    """For each query and row, on common support and with offsets removed: points, product, length of the query, of the row, sum of the query."""
    m, s = queries.m.astype(float), rows.s.astype(float)
    patterns, of_row = np.unique(rows.s, axis=0, return_inverse=True)
    common = m @ s.T
    a = queries.least_on(patterns)[:, of_row.reshape(-1)] if queries.offset else np.zeros_like(common)
    b = lows(rows.v, queries.masks, rows.s)[queries.which]
    sum_q, sum_v = queries.q @ s.T, m @ rows.v.T
    product = queries.q @ rows.v.T - a * sum_v - b * sum_q + common * a * b
    size_q = np.sqrt(np.maximum((queries.q**2) @ s.T - 2 * a * sum_q + common * a * a, 0))
    size_v = np.sqrt(np.maximum(m @ (rows.v**2).T - 2 * b * sum_v + common * b * b, 0))
    return common, product, size_q, size_v, sum_q - common * a


def quotient(top: np.ndarray, below: np.ndarray, otherwise: float) -> np.ndarray:
    return np.where(below > 1e-12, top / np.maximum(below, 1e-12), otherwise)


def coded_bounds(queries: Queries, rows: Rows, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the scores, below and above, of rows that are known to within half a ``scale`` at each point; -1 where a row drops out."""
    common, product, size_q, size_v, sum_q = sums(queries, rows)
    # Each point is off by half a scale at most, and so is the least one: their difference by a whole one.
    off, spread = scale[None] * np.abs(sum_q) if queries.offset else scale[None] * np.sqrt(np.maximum(common, 0)) * size_q, scale[None] * np.sqrt(common)
    high = quotient(product + off, size_q * (size_v - spread), 1.0)
    high = np.where(product + off < 0, quotient(product + off, size_q * (size_v + spread), 1.0), high)
    low = np.where(product - off >= 0, quotient(product - off, size_q * (size_v + spread), -1.0), quotient(product - off, size_q * (size_v - spread), -1.0))
    # Sums of products round off in proportion to their terms; where what is left of them is small, nothing is known.
    sure = (size_q > 1e-5) & (size_v - spread > 1e-5)
    fits = common >= 2
    return np.where(fits & sure, np.clip(low, -1, 1) - SLACK, -1.0), np.where(fits, np.where(sure, np.minimum(high, 1.0), 1.0) + SLACK, -1.0)


def sketch(v: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Norms of each row on the segments."""
    return np.sqrt(np.add.reduceat(v * v, cuts[:-1], axis=1))


def centres(sample: np.ndarray, k: int, seed: int = 42, rounds: int = 8) -> np.ndarray:
    """Unit centres of sketches by spherical k-means; starts at random rows."""
    u = kernels.units(sample)
    out = u[np.random.default_rng(seed).choice(len(u), min(k, len(u)), replace=False)]
    for _ in range(rounds):
        at = (u @ out.T).argmax(1)
        total = np.zeros_like(out)
        np.add.at(total, at, u)
        held = np.bincount(at, minlength=len(out)) > 0
        out[held] = kernels.units(total[held])
    return out


CODES = "row_id long, scale double, low double, code binary"
BOUNDS = "cell int, rows long, centre array<double>, most array<double>, least array<double>, floor array<double>, always binary, ever binary"


def _bounds(n: int):
    """What bounds the scores of a cell's rows: for rows of unit length the largest and least norm and the largest least value on each segment, and the points that all and any have."""
    cuts = edges(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            rows, cell = Rows.of(b, n), b.column("cell").to_numpy()
            y = kernels.units(rows.offset())
            norms = sketch(y, cuts)
            inside = np.add.reduceat(rows.s, cuts[:-1], axis=1) == np.diff(cuts)
            floor = np.where(inside, np.minimum.reduceat(y, cuts[:-1], axis=1), np.inf)
            for c in np.unique(cell).tolist():
                own = cell == c
                new = [int(own.sum()), norms[own].sum(0), norms[own].max(0), norms[own].min(0), floor[own].max(0), rows.s[own].all(0), rows.s[own].any(0)]
                old = held.get(c)
                held[c] = new if old is None else [old[0] + new[0], old[1] + new[1], np.maximum(old[2], new[2]), np.minimum(old[3], new[3]), np.maximum(old[4], new[4]), old[5] & new[5], old[6] | new[6]]
        for c, (k, centre, most, least, floor, always, ever) in held.items():
            yield pa.RecordBatch.from_pydict({"cell": pa.array([c], pa.int32()), "rows": pa.array([k], pa.int64()), "centre": pa.array([centre]), "most": pa.array([most]), "least": pa.array([least]), "floor": pa.array([np.where(np.isfinite(floor), floor, 1e300)]), "always": pa.array([np.packbits(always).tobytes()]), "ever": pa.array([np.packbits(ever).tobytes()])})

    return run


def cell_bounds(queries: Queries, most: np.ndarray, least: np.ndarray, floor: np.ndarray, always: np.ndarray, ever: np.ndarray) -> np.ndarray:
    """An upper bound of the score of any row of each cell, for each query.

    The product is at most that of the norms on each segment.  The row's length on the mask is at least that of its segments inside the mask, less what
    the offset there can be above the offset of the whole; the query's length at least what it has on the points that all rows share.
    """
    cuts = edges(queries.q.shape[1])
    low = np.where(queries.m, queries.q, np.inf).min(1, initial=np.inf) if queries.offset else np.zeros(len(queries.q))
    x = np.where(queries.m, queries.q - np.where(np.isfinite(low), low, 0.0)[:, None], 0.0)
    top = sketch(x, cuts) @ most.T
    inner = (np.add.reduceat(queries.m, cuts[:-1], axis=1) == np.diff(cuts)).astype(float)
    offset = np.where(inner[:, None] > 0, floor[None], np.inf).min(2, initial=np.inf) if len(floor) else np.zeros((len(x), 0))
    length = np.sqrt(inner @ (least**2).T) - np.where(np.isfinite(offset), offset, 1e300) * np.sqrt(queries.m.sum(1))[:, None]
    for j in range(len(most)):
        # Where the mask holds all points of all rows, lengths are 1 and offsets those of the rows.
        length[(queries.m | ~ever[j][None]).all(1), j] = 1.0
    both = queries.m.astype(float) @ always.T.astype(float)
    at = queries.least_on(always) if queries.offset else np.zeros_like(both)
    sum_q = queries.q @ always.T.astype(float)
    size = np.sqrt(np.maximum((queries.q**2) @ always.T.astype(float) - 2 * at * sum_q + both * at * at, 0))
    return np.where((length > 1e-5) & (size > 1e-5), np.minimum(quotient(top, size * length, 1.0), 1.0), 1.0) + SLACK


@dataclass
class Index:
    """A built index: its folder and what its manifest says."""

    spark: SparkSession
    folder: str
    facts: dict

    def table(self, name: str, cells: list[int] | None = None) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.folder}/{name}")
        return rows if cells is None else rows.where(F.col("cell").isin(cells))


def build(library: DataFrame, folder: str, points: int, keep: list[str], cell_rows: int = CELL_ROWS) -> Index:
    """Write an index of every row of ``library`` (row_id, vector, start_idx, end_idx, support_runs and the columns in ``keep``) to a new folder.

    Centres are fitted on the SAMPLE rows with the least hashes of their row_id; each row goes to its nearest one, and a centre with
    more than ``cell_rows`` rows is dealt into cells by hashes of row_id, so that copies without end make many cells and no large one.
    Rows without a vector of ``points`` numbers aren't indexed: their score isn't defined.  The manifest is written last.
    """
    spark, cuts = library.sparkSession, edges(points)
    kept = list(dict.fromkeys(["row_id", "start_idx", "end_idx", "support_runs", *keep]))
    rows = library.where(F.size("vector") == points).select(*kept, F.col("vector").cast("array<float>").alias("vector"))
    picked = rows.orderBy(F.xxhash64("row_id"), "row_id").limit(SAMPLE).toArrow().combine_chunks().to_batches()
    total = rows.count()
    if not picked or not total:
        centre = np.zeros((1, len(cuts) - 1))
    else:
        centre = centres(np.concatenate([sketch(Rows.of(b, points).offset(), cuts) for b in picked]), min(CENTRES, max(1, -(-total // cell_rows))))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = sketch(Rows.of(b, points).offset(), cuts)
            at = np.concatenate([np.zeros(0, int), *((near[t] @ centre.T).argmax(1) for t in tiles(len(b), len(centre)))])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int32())], names=[*b.schema.names, "centre"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    placed = rows.mapInArrow(nearest, f"{kinds}, centre int")
    # As many cells for a centre as its rows need; at most CENTRES counts come to the driver.
    parts = {r[0]: -(-r[1] // cell_rows) for r in placed.groupBy("centre").count().collect()}
    first, n = {}, 0
    for c in sorted(parts):
        first[c], n = n, n + parts[c]
    if parts:
        begin, share = (F.create_map(*(F.lit(x) for c in sorted(parts) for x in (c, of[c])))[F.col("centre")] for of in (first, parts))
        placed = placed.withColumn("cell", (begin + F.pmod(F.xxhash64("row_id"), share)).cast("int"))
    else:
        placed = placed.withColumn("cell", F.lit(0))
    spread = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // (1 << 16) + 1)
    placed.drop("centre").repartition(spread, "cell").write.partitionBy("cell").parquet(f"{folder}/vectors")
    whole = spark.read.schema(placed.drop("centre").schema).parquet(f"{folder}/vectors")

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = Rows.of(b, points)
            low = np.where(r.s, r.v, np.inf).min(1, initial=np.inf)
            low = np.where(np.isfinite(low), low, 0.0)
            scale = np.where(r.s, r.v - low[:, None], 0.0).max(1, initial=0.0) / 255
            code = np.where(r.s, np.rint((r.v - low[:, None]) / np.where(scale > 0, scale, 1.0)[:, None]), 0).astype(np.uint8)
            out = {"row_id": b.column("row_id"), "start_idx": b.column("start_idx"), "end_idx": b.column("end_idx"), "support_runs": b.column("support_runs"), "cell": b.column("cell"), "scale": scale, "low": low, "code": pa.array([c.tobytes() for c in code], pa.binary())}
            yield pa.RecordBatch.from_pydict(out)

    runs = whole.schema["support_runs"].dataType.simpleString()
    shapes = f"row_id {whole.schema['row_id'].dataType.simpleString()}, start_idx int, end_idx int, support_runs {runs}, cell int, scale double, low double, code binary"
    lean = whole.select("row_id", F.col("start_idx").cast("int").alias("start_idx"), F.col("end_idx").cast("int").alias("end_idx"), "support_runs", "vector", "cell")
    lean.mapInArrow(coded, shapes).write.partitionBy("cell").parquet(f"{folder}/codes")
    parts = lean.mapInArrow(_bounds(points), BOUNDS)
    def over(c: str, f) -> Column:
        every = F.collect_list(c)
        return F.aggregate(F.slice(every, 2, 1 << 30), F.get(every, F.lit(0)), lambda x, y: F.zip_with(x, y, lambda a, b: f(a, b))).alias(c)

    # A cell has a row for each task that read a piece of it, few as a cell is small.
    sides = [over("centre", lambda a, b: a + b), over("most", lambda a, b: F.greatest(a, b)), over("least", lambda a, b: F.least(a, b)), over("floor", lambda a, b: F.greatest(a, b))]
    gathered = parts.groupBy("cell").agg(F.sum("rows").alias("rows"), *sides, F.collect_list("always").alias("always"), F.collect_list("ever").alias("ever"))
    gathered.write.parquet(f"{folder}/cells")
    facts = {"points": points, "rows": total, "cells": n, "keep": keep}
    write_json(spark, f"{folder}/index.json", facts)
    return Index(spark, folder, facts)


def load(spark: SparkSession, folder: str) -> Index:
    """The index in a folder; a FileNotFoundError where none was finished."""
    facts = read_json(spark, f"{folder}/index.json")
    if facts is None:
        raise FileNotFoundError(f"no finished index in {folder}")
    return Index(spark, folder, facts)


def _cell_scores(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, least = shared.value
        n = queries.q.shape[1]
        # Bounds of a cell take a number for each query and segment.
        width = len(queries.ids) * (len(edges(n)) - 1)
        for b in (batch.slice(t.start, t.stop - t.start) for batch in batches for t in tiles(len(batch), width)):
            # Floors of cells whose rows don't fill a segment are unknown, here infinite.
            centre, most, low, floor = (b.column(c).flatten().to_numpy().reshape(len(b), -1) for c in ("centre", "most", "least", "floor"))
            always, ever = (np.array([op.reduce(np.stack([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x in own])).astype(bool) for own in b.column(c).to_pylist()]) for c, op in (("always", np.bitwise_and), ("ever", np.bitwise_or)))
            high = cell_bounds(queries, most, low, floor, always, ever)
            near = sketch(np.where(queries.m, queries.q - np.where(queries.m, queries.q, np.inf).min(1, keepdims=True, initial=1e300), 0.0), edges(n)) @ kernels.units(centre).T
            i, j = np.nonzero(high >= least[:, None])
            yield pa.RecordBatch.from_pydict({"query": pa.array(i, pa.int32()), "cell": b.column("cell").take(pa.array(j)), "rows": b.column("rows").take(pa.array(j)), "high": high[i, j], "near": near[i, j]})

    return run


def _code_scores(shared):
    """Of each cell and query the best upper bound, and of each task and query the k best lower bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, least = shared.value
        n, top = queries.q.shape[1], np.full((len(queries.ids), 0), -1.0)
        bar, held = least, {}

        def bests(most: int) -> Iterator[pa.RecordBatch]:
            if len(held) <= most:
                return
            for c, best in held.items():
                i = np.flatnonzero((best >= bar) & (best > -1))
                yield pa.RecordBatch.from_pydict({"query": pa.array(i, pa.int32()), "cell": pa.array(np.full(len(i), c), pa.int32()), "high": best[i], "low": pa.nulls(len(i), pa.float64())})
            held.clear()

        for b in batches:
            code = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(len(b), n)
            scale, low, s = b.column("scale").to_numpy(), b.column("low").to_numpy(), supports(b, n)
            rows, cell = Rows(np.where(s, low[:, None] + scale[:, None] * code, 0.0), s), b.column("cell").to_numpy()
            for at in tiles(len(b), max(n, len(queries.ids))):
                below, above = coded_bounds(queries, Rows(rows.v[at], rows.s[at]), scale[at])
                top = -np.sort(-np.hstack([top, below]), axis=1)[:, : queries.k]
                bar = np.maximum(least, top[:, -1] if top.shape[1] == queries.k else -1.0)
                for c in np.unique(cell[at]).tolist():
                    held[c] = np.maximum(held.get(c, -1.0), above[:, cell[at] == c].max(1))
                yield from bests(16)
        yield from bests(0)
        i, j = np.nonzero(top > -1)
        yield pa.RecordBatch.from_pydict({"query": pa.array(i, pa.int32()), "cell": pa.nulls(len(i), pa.int32()), "high": pa.nulls(len(i), pa.float64()), "low": top[i, j]})

    return run


def _whole_scores(shared, keep: list[str]):
    """Rows that may be among the first of a query, with their scores; of each task at most the first k of a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, least = shared.value
        n, bar = queries.q.shape[1], least.copy()
        held: list[pa.Table] = []
        for b in batches:
            rows, ids = Rows.of(b, n), b.column("row_id")
            for at in tiles(len(b), max(n, len(queries.ids))):
                part = Rows(rows.v[at], rows.s[at])
                _, high = coded_bounds(queries, part, np.zeros(len(part.v)))
                i, j = np.nonzero((high >= bar[:, None]) & (high > -1))
                if not len(i):
                    continue
                score = np.concatenate([np.round(kernels.masked_cosines(queries.q[x], part.v[y], queries.m[x] & part.s[y], queries.offset, True), DECIMALS) for x, y in ((i[p : p + TILE], j[p : p + TILE]) for p in range(0, len(i), TILE))])
                ok = score > -1
                held.append(pa.table({"query": pa.array(i[ok], pa.int32()), "score": score[ok], "row_id": ids.slice(at.start).take(pa.array(j[ok])), **{c: b.column(c).slice(at.start).take(pa.array(j[ok])) for c in keep}}))
            if held:
                every = pa.concat_tables(held).sort_by([("query", "ascending"), ("score", "descending"), ("row_id", "ascending")])
                q = every["query"].to_numpy()
                nth = np.arange(len(q)) - np.searchsorted(q, q)
                last = nth == queries.k - 1
                bar[q[last]] = np.maximum(bar[q[last]], every["score"].to_numpy()[last] - 2 * SLACK)
                held = [every.filter(pa.array(nth < queries.k))]
        for t in held:
            yield from t.to_batches()

    return run


def screen_many(index: Index, queries: DataFrame, k: int = 50, offset_query: bool = True, probes: int = PROBES) -> tuple[list[DataFrame], dict]:
    """The first ``k`` rows of each query of a table (query long, vector, mask), as screen() and shortlist() give them one by one, and how much was read.

    Each DataFrame (query, rank, row_id, the index's kept columns, screen) answers a block of queries; scores
    are ranked as rounded to nine decimals, ties by row_id, and rows without a score are left out.  Only numbers of cells, and for each query k
    lower bounds, come to the driver.  The facts: queries, cells of the index, and how many (query block, cell) were skipped by
    their bounds, looked at in codes, and read whole.
    """
    spark, n, keep = index.spark, index.facts["points"], [c for c in index.facts["keep"] if c != "row_id"]
    size = min(QUERIES, max(1, QUERY_BYTES // (8 * n)))
    count = queries.count()
    numbered = queries.select(F.col("query").cast("long").alias("query"), F.col("vector").cast("array<double>").alias("vector"), F.col("mask").alias("mask"))
    blocks = -(-count // size)
    cuts = [] if blocks <= 1 else sorted(set(numbered.agg(F.percentile_approx("query", [i / blocks for i in range(1, blocks)], 100 * blocks)).first()[0]))
    out, facts = [], {"queries": count, "cells": index.facts["cells"], "skipped": 0, "coded": 0, "read": 0}
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = numbered.where((F.lit(True) if low is None else F.col("query") > low) & (F.lit(True) if high is None else F.col("query") <= high)).orderBy("query").toArrow()
        if not len(part) or not index.facts["cells"]:
            continue
        v, m = (np.stack(part[c].combine_chunks().to_numpy(zero_copy_only=False)).astype(t) for c, t in (("vector", float), ("mask", bool)))
        block = Queries(part["query"].to_numpy(), np.where(np.isfinite(v), v, 0.0), m, offset_query, k)
        least = np.full(len(block.ids), -1.0)
        seeds = _seeds(index, block, probes)
        # Looking twice pays where few cells are looked into first.
        if seeds and 4 * len(seeds) <= index.facts["cells"]:
            least, _ = _surely(spark, index.table("codes", seeds), block, least)
        sent = spark.sparkContext.broadcast((block, least))
        open_cells = sorted(r[0] for r in index.table("cells").mapInArrow(_cell_scores(sent), "query int, cell int, rows long, high double, near double").select("cell").distinct().collect())
        least, cells = _surely(spark, index.table("codes", open_cells), block, least)
        sent = spark.sparkContext.broadcast((block, least))
        kinds = ", ".join(f"`{c}` {index.table('vectors').schema[c].dataType.simpleString()}" for c in ["row_id", *keep])
        needed = list(dict.fromkeys(["row_id", "vector", "start_idx", "end_idx", "support_runs", *keep]))
        found = index.table("vectors", cells).select(*needed).mapInArrow(_whole_scores(sent, keep), f"query int, score double, {kinds}")
        ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "row_id"))).where(f"rank <= {k}")
        ids = F.array(*(F.lit(int(i)) for i in block.ids))
        out.append(ranked.select(F.get(ids, F.col("query")).cast("long").alias("query"), "rank", "row_id", *keep, F.col("score").alias("screen")))
        facts["skipped"] += index.facts["cells"] - len(open_cells)
        facts["coded"] += len(open_cells)
        facts["read"] += len(cells)
    return out, facts


def _seeds(index: Index, block: Queries, probes: int) -> list[int]:
    """The ``probes`` cells nearest to each query."""
    sent = index.spark.sparkContext.broadcast((block, np.full(len(block.ids), -1.0)))
    near = index.table("cells").mapInArrow(_cell_scores(sent), "query int, cell int, rows long, high double, near double")
    first = near.withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy(F.col("near").desc(), "cell"))).where(f"nth <= {probes}")
    return sorted(r[0] for r in first.select("cell").distinct().collect())


def _surely(spark: SparkSession, codes: DataFrame, block: Queries, least: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Scores that k rows of each query surely reach, by their codes, and the cells that may hold rows which reach them."""
    sent = spark.sparkContext.broadcast((block, least))
    scores = codes.mapInArrow(_code_scores(sent), "query int, cell int, high double, low double").persist()
    try:
        kth = scores.where("low is not null").withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy(F.col("low").desc()))).where(f"nth = {block.k}")
        reached = kth.select("query", "low").toPandas()
        least = least.copy()
        least[reached["query"]] = np.maximum(least[reached["query"]], reached["low"])
        bars = F.array(*(F.lit(float(x)) for x in least))
        cells = scores.where(F.col("cell").isNotNull() & (F.col("high") >= F.get(bars, F.col("query")) - 2 * SLACK)).select("cell").distinct().collect()
        return least, sorted(r[0] for r in cells)
    finally:
        scores.unpersist()
