"""Clusters of one name's fingerprints as passes over distributed rows, for names that are too large for one task.

The steps are those of ``kernels.representatives``, with the same random numbers for the same rows in order of row_id, so the labels are the
same: principal components, the number of clusters by the silhouettes of k-means, k-medoids by cosine, a mixture where these leave clusters empty, medoids.
Each step is a pass that adds up numbers per cluster: the products of all coordinates for the components, sums and costs for means, the sum of
unit rows for cosine distances (a row's distances to a whole cluster are its product with that sum).  All starts and all numbers of
clusters move together, so a pass serves every one of them.  The driver holds centres and totals, never rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peaklight.functions import kernels
from peaklight.model import Reduction
from peaklight.sources.writers import shared_folder

#: Rows of coordinates' products that are added up in one task.
BAND = 64


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Pass:
    """Totals over all rows of a table with a column of vectors of one length."""

    def __init__(self, rows: DataFrame, column: str):
        self.rows, self.column = rows, column

    def totals(self, adds: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
        """The sum of ``adds`` over batches; a task sends its own sum, a number for each place, and Spark adds these up."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            for b in batches:
                if len(b):
                    total += adds(matrix(b.column(0)))
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"i": pa.array(at, pa.int64()), "x": total.ravel()[at]})

        out = np.zeros(int(np.prod(shape)))
        for r in self.rows.select(self.column).mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
            out[r.i] = r.x
        return out.reshape(shape)

    def best(self, scores: Callable[[np.ndarray, np.ndarray], np.ndarray], n: int) -> dict[int, tuple[int, np.ndarray]]:
        """For each of ``n`` slots the row (mid, vector) of the least score, then the first in order; scores of inf don't count."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not len(b):
                    continue
                x, mid = matrix(b.column(0)), b.column(1).to_numpy()
                s = scores(x, b.column(2).to_numpy())
                order = np.argsort(mid, kind="stable")
                at = order[s[order].argmin(0)]
                ok = np.isfinite(s[at, np.arange(n)])
                yield pa.RecordBatch.from_pydict({"slot": pa.array(np.flatnonzero(ok), pa.int32()), "score": s[at, np.arange(n)][ok], "mid": pa.array(mid[at[ok]], pa.int64()), "x": pa.array(list(x[at[ok]]), pa.list_(pa.float64()))})

        found = self.rows.select(self.column, "mid", "rank").mapInArrow(run, "slot int, score double, mid long, x array<double>")
        return {r.slot: (r.m.mid, np.array(r.m.x)) for r in found.groupBy("slot").agg(F.min(F.struct("score", "mid", "x")).alias("m")).collect()}

    def vectors(self, mids: list[int]) -> dict[int, np.ndarray]:
        """The rows of some mids."""
        return {r.mid: np.array(r[1]) for r in self.rows.where(F.col("mid").isin(sorted(set(mids)))).select("mid", self.column).collect()}


def components(rows: DataFrame, n: int, dims: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and principal axes: products of all coordinates, added up in bands of rows, so no task holds more than a band of others' products."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((dims + 1, dims)), 0
        for b in batches:
            if len(b):
                x = matrix(b.column(0))
                total[:dims] += x.T @ x
                total[dims] += x.sum(0)
                seen += len(x)
        for a in range(0, dims + 1 if seen else 0, BAND):
            yield pa.RecordBatch.from_pydict({"band": pa.array([a], pa.int32()), "part": pa.array([total[a : a + BAND].tobytes()], pa.binary())})

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for band, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held[band] = held.get(band, 0) + np.frombuffer(part)
        for band, total in held.items():
            yield pa.RecordBatch.from_pydict({"band": pa.array([band], pa.int32()), "part": pa.array([total.tobytes()], pa.binary())})

    kind = "band int, part binary"
    bands = rows.select("u").mapInArrow(products, kind).repartition(min(64, dims // BAND + 1), "band").mapInArrow(added, kind).collect()
    total = np.concatenate([np.frombuffer(r.part) for r in sorted(bands)]).reshape(dims + 1, dims)
    mean = total[dims] / n
    size, axes = np.linalg.eigh(total[:dims] - n * np.outer(mean, mean))
    return mean, axes[:, ::-1][:, : max(1, min(most, dims, n - 1))]


def squares(z: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.maximum((z * z).sum(1)[:, None] - 2 * z @ centre.T + (centre * centre).sum(1), 0)


class Order:
    """Rows in order of row_id, told by ``mid``: the task that wrote a row and its place there."""

    def __init__(self, rows: DataFrame):
        counts = sorted(rows.groupBy(F.shiftright("mid", 33).alias("p")).count().collect())
        self.parts = np.array([r[0] for r in counts], np.int64)
        self.starts = np.cumsum([0, *(r[1] for r in counts)])
        self.n = int(self.starts[-1])

    def mid(self, i: int) -> int:
        p = int(np.searchsorted(self.starts, i, "right")) - 1
        return (int(self.parts[p]) << 33) + i - int(self.starts[p])


def k_means(rows: Pass, order: Order, ks: list[int], seed: int, starts: int = 4, rounds: int = 50) -> dict[int, np.ndarray]:
    """Centres of the best start for each number of clusters; all starts of all numbers in the same passes."""
    plans, draws = [(k, s) for k in ks for s in range(starts)], {}
    for k in ks:
        rng = np.random.default_rng(seed)
        for s in range(starts):
            draws[k, s] = (int(rng.integers(order.n)), [rng.random() for _ in range(k - 1)])
    first = rows.vectors([order.mid(draws[p][0]) for p in plans])
    centre = {p: first[order.mid(draws[p][0])][None] for p in plans}
    for step in range(1, max(ks, default=1)):
        going = [p for p in plans if p[0] > step]
        sent = [centre[p] for p in going]

        def far(z: np.ndarray, sent=sent) -> np.ndarray:
            return np.stack([squares(z, c).min(1) for c in sent], 1)

        parts = _part_sums(rows, far, len(going))
        wanted: dict[int, list[tuple[int, float]]] = {}
        chosen: dict[int, np.ndarray] = {}
        for i, p in enumerate(going):
            sums = np.array([parts.get(int(q), np.zeros(len(going)))[i] for q in order.parts])
            ends = np.cumsum(sums)
            if ends[-1] > 0:
                at = min(int(np.searchsorted(ends, draws[p][1][step - 1] * ends[-1], "right")), int(np.flatnonzero(sums)[-1]))
                wanted.setdefault(int(order.parts[at]), []).append((i, draws[p][1][step - 1] * ends[-1] - (ends[at] - sums[at])))
            else:
                chosen[i] = centre[p][0]
        chosen |= _reached(rows, far, wanted)
        for i, p in enumerate(going):
            centre[p] = np.vstack([centre[p], chosen[i]])
    final: dict[tuple[int, int], tuple[float, np.ndarray]] = {}
    for at in range(rounds):
        going = [p for p in plans if p not in final]
        if not going:
            break
        sent = [centre[p] for p in going]
        ends, m = np.cumsum([0, *(len(c) for c in sent)]), len(sent[0][0])

        def adds(z: np.ndarray, sent=sent, ends=ends, m=m) -> np.ndarray:
            out = np.zeros((ends[-1] + len(sent), m + 1))
            ones = np.column_stack([z, np.ones(len(z))])
            for i, c in enumerate(sent):
                d = squares(z, c)
                label = d.argmin(1)
                out[ends[i] : ends[i + 1]] = (label[:, None] == np.arange(len(c))).T.astype(float) @ ones
                out[ends[-1] + i, 0] = d.min(1).sum()
            return out

        total = rows.totals(adds, (ends[-1] + len(sent), m + 1))
        for i, p in enumerate(going):
            own = total[ends[i] : ends[i + 1]]
            new = np.where(own[:, m:] > 0, own[:, :m] / np.maximum(own[:, m:], 1), centre[p])
            if np.allclose(new, centre[p]) or at == rounds - 1:
                final[p] = (total[ends[-1] + i, 0], centre[p])
            else:
                centre[p] = new
    return {k: min((final[k, s] for s in range(starts)), key=lambda f: f[0])[1] for k in ks}


def _part_sums(rows: Pass, far, n: int) -> dict[int, np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            if len(b):
                d, part = far(matrix(b.column(0))), b.column(1).to_numpy() >> 33
                for p in np.unique(part).tolist():
                    held[p] = held.get(p, 0) + d[part == p].sum(0)
        for p, x in held.items():
            yield pa.RecordBatch.from_pydict({"p": pa.array([p] * n, pa.int64()), "i": pa.array(np.arange(n), pa.int32()), "x": x})

    out: dict[int, np.ndarray] = {}
    for r in rows.rows.select(rows.column, "mid").mapInArrow(run, "p long, i int, x double").groupBy("p", "i").agg(F.sum("x").alias("x")).collect():
        out.setdefault(r.p, np.zeros(n))[r.i] = r.x
    return out


def _reached(rows: Pass, far, wanted: dict[int, list[tuple[int, float]]]) -> dict[int, np.ndarray]:
    """The row at which the running sum of a part passes a number, for each plan; only the parts that hold such rows are read, one part in one task."""
    if not wanted:
        return {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The rows of a part come in order; of the last ones one is kept for sums that rounding leaves short.
        sums: dict[int, float] = {}
        open_plans: dict[int, list[tuple[int, float]]] = {p: list(w) for p, w in wanted.items()}
        last: dict[int, tuple[int, np.ndarray]] = {}
        for b in batches:
            if not len(b):
                continue
            z, part = matrix(b.column(0)), b.column(1).to_numpy() >> 33
            d = far(z)
            for p in np.unique(part).tolist():
                own = np.flatnonzero(part == p)
                left = []
                for i, target in open_plans[p]:
                    run_sum = sums.get((p, i), 0.0) + np.cumsum(d[own, i])
                    at = int(np.searchsorted(run_sum, target, "right"))
                    positive = np.flatnonzero(d[own, i])
                    if len(positive):
                        last[i] = (i, z[own[positive[-1]]])
                    if at < len(own):
                        yield pa.RecordBatch.from_pydict({"i": pa.array([i], pa.int32()), "x": pa.array([z[own[at]]], pa.list_(pa.float64())), "sure": [True]})
                        last.pop(i, None)
                    else:
                        sums[p, i] = float(run_sum[-1])
                        left.append((i, target))
                open_plans[p] = left
        for i, x in last.values():
            yield pa.RecordBatch.from_pydict({"i": pa.array([i], pa.int32()), "x": pa.array([x], pa.list_(pa.float64())), "sure": [False]})

    parts = rows.rows.where(F.shiftright("mid", 33).isin(sorted(wanted))).select(rows.column, "mid")
    dealt = parts.repartitionById(len(wanted), _rank_of(sorted(wanted))).sortWithinPartitions("mid")
    found = dealt.mapInArrow(run, "i int, x array<double>, sure boolean").orderBy("sure").collect()
    return {r.i: np.array(r.x) for r in found}


def _rank_of(parts: list[int]):
    return (F.array_position(F.array(*map(F.lit, parts)), F.shiftright("mid", 33)) - 1).cast("int")


def silhouettes(rows: Pass, n: int, centres: dict[int, np.ndarray]) -> dict[int, float]:
    """Mean cosine silhouette of the labels that centres give, for each number of clusters."""
    ks = sorted(centres)
    ends, m = np.cumsum([0, *ks]), len(centres[ks[0]][0])

    def labels(z: np.ndarray) -> list[np.ndarray]:
        return [squares(z, centres[k]).argmin(1) for k in ks]

    def adds(z: np.ndarray) -> np.ndarray:
        u = np.column_stack([kernels.units(z), np.ones(len(z))])
        return np.concatenate([(label[:, None] == np.arange(k)).T.astype(float) @ u for k, label in zip(ks, labels(z), strict=True)])

    total = rows.totals(adds, (int(ends[-1]), m + 1))

    def values(z: np.ndarray) -> np.ndarray:
        u, out = kernels.units(z), np.zeros(len(ks))
        for i, label in enumerate(labels(z)):
            sums, size = total[ends[i] : ends[i + 1], :m], total[ends[i] : ends[i + 1], m]
            far = np.clip(size - u @ sums.T, 0, None)
            row = np.arange(len(u))
            inside = far[row, label] / np.maximum(size[label] - 1, 1)
            other = np.where(size > 0, far / np.maximum(size, 1), np.inf)
            other[row, label] = np.inf
            near = other.min(1)
            near = np.where(np.isfinite(near), near, 0.0)
            out[i] = np.where(size[label] > 1, (near - inside) / np.maximum(np.maximum(near, inside), kernels.TINY), 0.0).sum()
        return out

    sums = rows.totals(values, (len(ks),))
    held = [int((total[ends[i] : ends[i + 1], m] > 0).sum()) for i in range(len(ks))]
    return {k: float(sums[i] / n) if held[i] >= 2 else -1.0 for i, k in enumerate(ks)}


def k_medoids(rows: Pass, order: Order, k: int, seeds: int, seed: int, rounds: int = 60) -> np.ndarray | None:
    """Unit medoids of the best start in which all k clusters have members, or None; all starts in the same passes."""
    picks = [[order.mid(int(i)) for i in np.random.default_rng(seed + s).choice(order.n, k, replace=False)] for s in range(seeds)]
    known = {mid: kernels.units(z[None])[0] for mid, z in rows.vectors([x for p in picks for x in p]).items()}
    at, final = [list(p) for p in picks], {}
    m = len(next(iter(known.values())))
    for turn in range(rounds):
        going = [s for s in range(seeds) if s not in final]
        if not going:
            break
        sent = [np.stack([known[x] for x in at[s]]) for s in going]

        def near(z: np.ndarray, sent=sent) -> tuple[np.ndarray, list[np.ndarray]]:
            u = kernels.units(z)
            return u, [np.clip(1 - u @ c.T, 0, 2) for c in sent]

        def adds(z: np.ndarray, near=near, sent=sent) -> np.ndarray:
            u, distances = near(z)
            ones, out = np.column_stack([u, np.ones(len(u))]), np.zeros((len(sent), k + 1, m + 1))
            for i, d in enumerate(distances):
                out[i, :k] = (d.argmin(1)[:, None] == np.arange(k)).T.astype(float) @ ones
                out[i, k, 0] = d.min(1).sum()
            return out

        total = rows.totals(adds, (len(going), k + 1, m + 1))

        def scores(z: np.ndarray, _, near=near, total=total) -> np.ndarray:
            u, distances = near(z)
            out = []
            for i, d in enumerate(distances):
                out.append(np.where(d.argmin(1)[:, None] == np.arange(k), -np.round(u @ total[i, :k, :m].T, 9), np.inf))
            return np.hstack(out)

        found = rows.best(scores, len(going) * k)
        for i, s in enumerate(going):
            new = [found[i * k + c][0] if i * k + c in found else at[s][c] for c in range(k)]
            known |= {found[i * k + c][0]: kernels.units(found[i * k + c][1][None])[0] for c in range(k) if i * k + c in found}
            if new == at[s] or turn == rounds - 1:
                final[s] = (float(total[i, k, 0]), bool((total[i, :k, m] > 0).all()), list(at[s]))
            at[s] = new
    full = [final[s] for s in range(seeds) if final[s][1]]
    return np.stack([known[x] for x in min(full, key=lambda f: f[0])[2]]) if full else None


def mixture(rows: Pass, order: Order, least: int, most: int, seed: int, m: int, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shares, means and variances of the diagonal Gaussian mixture of least BIC; all numbers of components in the same passes."""
    n, ks = order.n, list(range(min(least, order.n), min(most, order.n) + 1))
    starts = k_means(rows, order, ks, seed)
    moments = rows.totals(lambda z: np.stack([z.sum(0), (z * z).sum(0)]), (2, m)) / n
    floor = 1e-6 + 1e-3 * np.maximum(moments[1] - moments[0] ** 2, 0)

    def logs(z: np.ndarray, p) -> np.ndarray:
        size, mean, var = p
        return -0.5 * (((z[:, None] - mean) ** 2 / var).sum(2) + np.log(2 * np.pi * var).sum(1)) + np.log(size / n)

    def update(shares: Callable[[np.ndarray, int], tuple[np.ndarray, float]], going: list[int]):
        ends = np.cumsum([0, *going])

        def adds(z: np.ndarray) -> np.ndarray:
            out, wide = np.zeros((ends[-1] + len(going), 2 * m + 1)), np.column_stack([z, z * z, np.ones(len(z))])
            for i, k in enumerate(going):
                share, every = shares(z, k)
                out[ends[i] : ends[i + 1]] = share.T @ wide
                out[ends[-1] + i, 0] = every
            return out

        total = rows.totals(adds, (int(ends[-1]) + len(going), 2 * m + 1))
        for i, k in enumerate(going):
            own = total[ends[i] : ends[i + 1]]
            size = own[:, 2 * m] + kernels.TINY
            mean = own[:, :m] / size[:, None]
            yield k, (size, mean, np.maximum(own[:, m : 2 * m] / size[:, None] - mean**2, floor)), total[ends[-1] + i, 0]

    held = {k: p for k, p, _ in update(lambda z, k: (np.eye(k)[squares(z, starts[k]).argmin(1)], 0.0), ks)}
    before, final = dict.fromkeys(ks, -np.inf), {}

    def shares(z: np.ndarray, k: int) -> tuple[np.ndarray, float]:
        each = logs(z, held[k])
        top = each.max(1, keepdims=True)
        every = top[:, 0] + np.log(np.exp(each - top).sum(1))
        return np.exp(each - every[:, None]), float(every.sum())

    for turn in range(rounds):
        going = [k for k in ks if k not in final]
        if not going:
            break
        for k, p, every in list(update(shares, going)):
            if every - before[k] < 1e-6 * n or turn == rounds - 1:
                final[k] = ((2 * k * m + k - 1) * np.log(n) - 2 * every, held[k])
            else:
                held[k], before[k] = p, every
    return min((final[k] for k in ks), key=lambda f: f[0])[1]


def representatives(rows: DataFrame, dims: int, how: Reduction) -> tuple[Callable[[np.ndarray], np.ndarray], dict[int, int]]:
    """How unit fingerprints are labelled, and the mid of the medoid of each cluster, for rows (mid, u, rank) of one name."""
    order, whole = Order(rows), Pass(rows, "u")
    n = order.n
    few = [np.array(r[0]) for r in rows.select("u").distinct().limit(how.most_k + 1).collect()]
    if min(n, len(few)) < 3:
        kinds = np.unique(np.stack(few), axis=0)
        label = lambda u: (u[:, None] == kinds[None]).all(2).argmax(1)
        names = list(range(len(kinds)))
    else:
        mean, axes = components(rows, n, dims, how.components)

        def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                z = (matrix(b.column(0)) - mean) @ axes
                yield pa.RecordBatch.from_pydict({"z": pa.FixedSizeListArray.from_arrays(pa.array(z.ravel()), z.shape[1]).cast(pa.list_(pa.float64())), "mid": b.column(1), "rank": b.column(2)})

        flat = rows.select("u", "mid", "rank").mapInArrow(turned, "z array<double>, mid long, rank int").persist()
        try:
            z, least = Pass(flat, "z"), max(3, how.least_k)
            ks = list(range(max(2, min(least, n - 1, len(few) - 1)), min(how.most_k, n - 1, len(few) - 1) + 1))
            values = silhouettes(z, n, k_means(z, order, ks, how.seed)) if ks else {}
            k = max(values, key=lambda k: (values[k], -k)) if values else least
            medoid = None
            while medoid is None and k >= least:
                medoid = k_medoids(z, order, k, how.medoid_seeds, how.seed)
                k -= 1
            if medoid is not None:
                inner = lambda z: np.clip(1 - kernels.units(z) @ medoid.T, 0, 2).argmin(1)
                names = list(range(len(medoid)))
            else:
                size, centre, var = mixture(z, order, least, min(how.most_k, n - 1), how.seed, axes.shape[1])
                inner = lambda z: (-0.5 * (((z[:, None] - centre) ** 2 / var).sum(2) + np.log(2 * np.pi * var).sum(1)) + np.log(size / n)).argmax(1)
                # Components without rows have no number.
                held = z.totals(lambda x: np.bincount(inner(x), minlength=len(size)).astype(float), (len(size),)) > 0
                names = np.maximum(np.cumsum(held) - 1, 0).tolist()
        finally:
            flat.unpersist()
        label = lambda u: inner((u - mean) @ axes)
    into = np.array(names)
    while True:
        def named(u: np.ndarray, into=into) -> np.ndarray:
            return into[label(u)]

        total = whole.totals(lambda u, named=named: (named(u)[:, None] == np.arange(len(into))).T.astype(float) @ np.column_stack([u, np.ones(len(u))]), (len(into), dims + 1))

        def scores(u: np.ndarray, rank: np.ndarray, named=named, total=total) -> np.ndarray:
            own = named(u)
            mean = np.clip(1 - (u * total[own, :dims]).sum(1) / total[own, dims], 0, 2)
            # The mean to twelve decimals, then the rank of the flag, as one number.
            return np.where(own[:, None] == np.arange(len(into)), (np.round(mean, 12) + 1e-13 * rank)[:, None], np.inf)

        tops = whole.best(scores, len(into))
        if len(tops) <= how.representatives:
            return named, {c: mid for c, (mid, _) in tops.items()}
        _, a, b = min((max(0.0, 1 - float(tops[a][1] @ tops[b][1])), a, b) for a in tops for b in tops if a < b)
        into = np.where(into == b, a, into)


def thinned(rows: DataFrame, how: Reduction, group: str, usable: Column, ranks: dict[str, int]) -> DataFrame:
    """What ``reduce.decluster`` gives for the rows (row_id, group, flag, fingerprint) of one name, in passes.

    The unit fingerprints are written once, in order of row_id, to the folder that executors share; the result reads them there.
    """
    spark = rows.sparkSession
    rank = F.coalesce(F.create_map(*(F.lit(x) for pair in ranks.items() for x in pair))[F.coalesce("flag", F.lit(""))], F.lit(1))
    size = F.sqrt(F.aggregate("fingerprint", F.lit(0.0), lambda s, x: s + x * x))
    unit = rows.where(usable).select("row_id", F.col(group).alias("name"), rank.cast("int").alias("rank"), F.transform("fingerprint", lambda x: x / size).alias("u"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), unit.rdd.getNumPartitions())
    place = shared_folder(spark, "cluster")
    unit.repartitionByRange(parts, "row_id").sortWithinPartitions("row_id").withColumn("mid", F.monotonically_increasing_id()).write.parquet(place)
    held = spark.read.parquet(place)
    dims = held.agg(F.max(F.size("u")), F.count("*")).first()
    kind = rows.schema[group].dataType.simpleString()
    rest = rows.where(~usable).select("row_id", F.col(group), F.lit(-1).alias("cluster"), F.lit(True).alias("keep"), F.lit("no fingerprint").alias("reason"))
    if dims[1] <= how.keep_all:
        return held.select("row_id", F.col("name").alias(group), F.lit(-1).alias("cluster"), F.lit(True).alias("keep"), F.lit("small group").alias("reason")).unionByName(rest)
    label, tops = representatives(held.select("mid", "u", "rank"), dims[0], how)
    kept = sorted(tops.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                cluster, keep = label(matrix(b.column("u"))), np.isin(b.column("mid").to_numpy(), kept)
                yield pa.RecordBatch.from_pydict({"row_id": b.column("row_id"), group: b.column("name"), "cluster": pa.array(cluster, pa.int32()), "keep": pa.array(keep), "reason": pa.array(np.where(keep, "medoid", "represented").tolist(), pa.string())})

    out = held.mapInArrow(run, f"row_id {rows.schema['row_id'].dataType.simpleString()}, `{group}` {kind}, cluster int, keep boolean, reason string")
    return out.unionByName(rest)
