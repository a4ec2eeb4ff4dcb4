"""Hard negatives by exact search behind bounds in a rotated space.

An orthogonal rotation onto the principal axes of all rows leaves inner products as they are and moves
most of their size into the first components.  A pair is weighed by these leading
components alone: what the others can add is at most the product of the norms of the two remainders, and a slack covers all
rounding of the rotation and of the sums.  Pairs that can't reach the rows found so far go; the
survivors get their integer inner product.

Anchors are a stated set of rows; a block of them, of bounded size, goes to all tasks, which keep their rows where they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peaklight.llm._base import Stage

#: Anchors that go to the tasks at once.
ANCHORS = 16384
#: Rows that a task should hold at least where the scan has many more partitions than there are cores.
ROWS = 1 << 16
#: Sides of a tile of pairs, and pairs whose products are formed at once.
TILE_ANCHORS, TILE_ROWS, PAIRS = 2048, 4096, 1 << 15
#: Share of the sum of squares that the leading components hold.
LEAD = 0.8
#: An integer up to here is a double.
EXACT = 1 << 53


@dataclass
class Rotation:
    """The principal axes of all rows, how many of them lead, the length of a vector and whether its sums fit into doubles."""

    axes: np.ndarray
    lead: int
    exact: type


@dataclass
class Vectors:
    """Rows with their whole integer vectors, and for the bounds: leading components, norm of the remainder, slack."""

    ids: np.ndarray
    labels: np.ndarray
    whole: np.ndarray
    bound: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, labels: np.ndarray, whole: np.ndarray, how: Rotation) -> Vectors:
        turned = whole.astype(float) @ how.axes
        rest, norm = np.linalg.norm(turned[:, how.lead :], axis=1), np.linalg.norm(turned, axis=1)
        # Sums of float32 products: each rounding is at most 2**-24 of |a||b|, there are lead + 2 of them, and each factor is rounded before.
        slack = np.sqrt((how.lead + 16) * 2.0**-23) * norm
        return cls(ids, labels, whole.astype(how.exact), np.column_stack([turned[:, : how.lead], rest, slack]).astype(np.float32))

    def part(self, at: slice) -> Vectors:
        return Vectors(self.ids[at], self.labels[at], self.whole[at], self.bound[at])


def integers(column: pa.Array, dims: int | None = None) -> np.ndarray:
    """floor(256 * x) of each list of doubles, a row each; shorter lists end in zeros."""
    off = column.offsets.to_numpy()
    flat = np.floor(256 * column.flatten().to_numpy(zero_copy_only=False))
    sizes = np.diff(off)
    dims = int(sizes.max(initial=0)) if dims is None else dims
    if (sizes == dims).all():
        return flat.reshape(len(column), dims)
    out = np.zeros((len(column), dims))
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(off[:-1] - off[0], sizes)] = flat
    return out


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id, label (changed where vec_id is divisible by 7) and embedding of the rows that take part, one for each vec_id.

    Rows without vec_id, label or vector, or with a null or non-finite component, take no part.  Of rows that share a
    vec_id the one with the smallest label, then the smallest vector, counts.
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & sound)
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    # Only ids move to see whether any repeats; vectors move in that case alone.
    if rows.groupBy("vec_id").count().where("count > 1").isEmpty():
        return rows
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("r")).select("vec_id", "r.label", "r.embedding")


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, top, sums = 0, 0.0, np.zeros((0, 0))
    for b in batches:
        v = integers(b.column("embedding"))
        d = max(v.shape[1], len(sums))
        grown = np.zeros((d, d))
        grown[: len(sums), : len(sums)] = sums
        grown[: v.shape[1], : v.shape[1]] += v.T @ v
        n, top, sums = n + len(v), max(top, float(np.abs(v).max(initial=0))), grown
    i, j = np.triu_indices(len(sums))
    yield pa.RecordBatch.from_pydict({"i": pa.array(np.append(i, -1), pa.int32()), "j": pa.array(np.append(j, -1), pa.int32()), "total": np.append(sums[i, j], n), "top": np.append(np.zeros(len(i)), top)})


def rotation(rows: DataFrame, share: float = LEAD) -> tuple[Rotation, int]:
    """The principal axes from the sums of products over all rows, and the number of rows.

    A partition sends one number for each pair of components; only their totals come to the driver.
    Raises an ArithmeticError where a hundredfold score can pass 63 bits.
    """
    cells = rows.select("embedding").mapInArrow(_sums, "i int, j int, total double, top double").groupBy("i", "j").agg(F.sum("total").alias("total"), F.max("top").alias("top")).collect()
    facts = next((c for c in cells if c.i < 0), None)
    d = max((c.j for c in cells), default=-1) + 1
    if facts is None or not facts.total or not d:
        return Rotation(np.zeros((d, d)), 0, np.float64), int(facts.total) if facts else 0
    most = d * int(facts.top) ** 2
    if 100 * most >= 1 << 63:
        raise ArithmeticError(f"components up to {facts.top:g} give scores of more than 63 bits")
    gram = np.zeros((d, d))
    for c in cells:
        if c.i >= 0:
            gram[c.i, c.j] = gram[c.j, c.i] = c.total
    size, axes = np.linalg.eigh(gram)
    size, axes = np.maximum(size[::-1], 0), axes[:, ::-1]
    lead = 1 + int(np.searchsorted(np.cumsum(size), share * size.sum()))
    return Rotation(axes, min(lead, d), np.float64 if most < EXACT else np.int64), int(facts.total)


class Best:
    """The best ``k`` (score, then smaller id) of each of ``n`` slots."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.slot, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        #: What a score must reach to matter for a slot.
        self.least = np.full(n, -(1 << 62), np.int64)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        ok = score >= self.least[slot]
        if not ok.any():
            return
        slot, score, ids = (np.concatenate([a, b[ok]]) for a, b in ((self.slot, slot), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, slot))
        nth = np.arange(len(slot)) - np.searchsorted(slot[order], slot[order])
        order, nth = order[nth < self.k], nth[nth < self.k]
        self.slot, self.score, self.id = slot[order], score[order], ids[order]
        last = nth == self.k - 1
        self.least[self.slot[last]] = self.score[last]


def products(rows: Vectors, anchors: Vectors, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Integer inner products of the pairs (rows[i], anchors[j])."""
    out = np.empty(len(i), np.int64)
    for a in range(0, len(i), PAIRS):
        at = slice(a, a + PAIRS)
        out[at] = np.einsum("ij,ij->i", rows.whole[i[at]], anchors.whole[j[at]])
    return out


def survivors(rows: Vectors, anchors: Vectors, same: bool, low: np.ndarray, high: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one label (or of two) whose score can lie in low..high of the anchor, by their leading components and bounds."""
    can = (rows.labels[:, None] == anchors.labels[None]) == same
    can &= rows.bound @ anchors.bound.T >= low.astype(np.float32)[None] - np.spacing(np.abs(low).astype(np.float32))[None]
    if high is not None:
        sign = np.ones(rows.bound.shape[1], np.float32)
        sign[-2:] = -1
        can &= (rows.bound * sign) @ anchors.bound.T <= high.astype(np.float32)[None] + np.spacing(np.abs(high).astype(np.float32))[None]
    return can.nonzero()


def _pieces(batches: Iterator[pa.RecordBatch], how: Rotation) -> Iterator[Vectors]:
    """The rows of a task in pieces that double in size, so that the first ones, which find no bar to pass, are small."""
    size = 128
    for b in batches:
        v = integers(b.column("embedding"), len(how.axes))
        every = Vectors.of(b.column("vec_id").to_numpy(), b.column("label").to_numpy(), v, how)
        at = 0
        while at < len(v):
            yield every.part(slice(at, at + size))
            at, size = at + size, min(TILE_ROWS, 2 * size)


def _positives(shared, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        how, anchors = shared.value
        best = Best(len(anchors.ids), n)
        for rows in _pieces(batches, how):
            found = []
            for a in range(0, len(anchors.ids), TILE_ANCHORS):
                part = anchors.part(slice(a, a + TILE_ANCHORS))
                i, j = survivors(rows, part, True, best.least[a : a + TILE_ANCHORS])
                other = rows.ids[i] != part.ids[j]
                i, j = i[other], j[other]
                found.append((j + a, products(rows, part, i, j), rows.ids[i]))
            best.add(*map(np.concatenate, zip(*found, strict=True)))
        yield pa.RecordBatch.from_pydict({"anchor_id": anchors.ids[best.slot], "positive_id": best.id, "positive_score": best.score})

    return run


def _negatives(shared, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        how, anchors, owner, positive, score = shared.value
        # A slot is a pair of anchor and positive; slots of an anchor stand side by side.
        least, most = -(-30 * score // 100), 90 * score // 100
        best = Best(len(score), n)
        best.least = least.copy()
        first = np.searchsorted(owner, np.arange(len(anchors.ids)))
        count = np.diff(np.append(first, len(owner)))
        held = count > 0
        high = np.full(len(anchors.ids), -(1 << 62))
        high[held] = np.maximum.reduceat(most, first[held]) if held.any() else 0
        for rows in _pieces(batches, how):
            low = np.full(len(anchors.ids), 1 << 62)
            low[held] = np.minimum.reduceat(best.least, first[held]) if held.any() else 0
            found = []
            for a in range(0, len(anchors.ids), TILE_ANCHORS):
                part = anchors.part(slice(a, a + TILE_ANCHORS))
                i, j = survivors(rows, part, False, low[a : a + TILE_ANCHORS], high[a : a + TILE_ANCHORS])
                s, ids, j = products(rows, part, i, j), rows.ids[i], j + a
                for k in range(int(count[a : a + TILE_ANCHORS].max(initial=0))):
                    own = count[j] > k
                    slot = first[j[own]] + k
                    ok = (s[own] >= best.least[slot]) & (s[own] <= most[slot])
                    found.append((slot[ok], s[own][ok], ids[own][ok]))
            if found:
                best.add(*map(np.concatenate, zip(*found, strict=True)))
        yield pa.RecordBatch.from_pydict({"anchor_id": anchors.ids[owner[best.slot]], "positive_id": positive[best.slot], "positive_score": score[best.slot], "negative_id": best.id, "negative_score": best.score})

    return run


OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine_negatives(embeddings: DataFrame, every: int = 100, n_positives: int = 5, n_negatives: int = 10, block: int = ANCHORS) -> DataFrame:
    """For each anchor (vec_id divisible by ``every``) and each of its first positives, the first rows of other labels in the window of scores.

    Scores are integer inner products of floor(256 * x); higher ones come first, ties by smaller vec_id.  Positives are
    the first ``n_positives`` other rows of the anchor's label, negatives the first ``n_negatives`` rows of another label with
    30 * positive_score <= 100 * negative_score <= 90 * positive_score.  See ``usable`` for nulls and repeated ids; shorter vectors end in zeros; without anchors,
    positives or fitting rows, and for an empty table, there are no rows; other columns aren't read.

    Blocks of ``block`` anchors go to all tasks one after the other; a task keeps its rows and sends at most the
    first few of each anchor.  The work is that of the stated anchors against all rows.
    """
    spark = embeddings.sparkSession
    stage = Stage(spark, "negatives")
    rows = usable(embeddings)
    how, total = rotation(rows)
    anchors = rows.where(F.col("vec_id") % every == 0)
    n_anchors = anchors.count() if total else 0
    if not n_anchors:
        return spark.createDataFrame([], OUT)
    tasks = max(spark.sparkContext.defaultParallelism, total // ROWS + 1)
    if rows.rdd.getNumPartitions() > tasks:
        rows = rows.coalesce(tasks)
    blocks = -(-n_anchors // block)
    cuts = [] if blocks == 1 else sorted(set(anchors.agg(F.percentile_approx("vec_id", [k / blocks for k in range(1, blocks)], 100 * blocks)).first()[0]))
    done = []
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = anchors.where((F.lit(True) if low is None else F.col("vec_id") > low) & (F.lit(True) if high is None else F.col("vec_id") <= high))
        table = part.orderBy("vec_id").toArrow()
        if not len(table):
            continue
        block_of = Vectors.of(table["vec_id"].to_numpy(), table["label"].to_numpy(), integers(table["embedding"].combine_chunks(), len(how.axes)), how)
        sent = spark.sparkContext.broadcast((how, block_of))
        found = rows.mapInArrow(_positives(sent, n_positives), "anchor_id long, positive_id long, positive_score long")
        by_score = Window.partitionBy("anchor_id").orderBy(F.col("positive_score").desc(), "positive_id")
        chosen = found.withColumn("nth", F.row_number().over(by_score)).where(f"nth <= {n_positives}").orderBy("anchor_id", "nth").toArrow()
        owner = np.searchsorted(block_of.ids, chosen["anchor_id"].to_numpy())
        slots = spark.sparkContext.broadcast((how, block_of, owner, chosen["positive_id"].to_numpy(), chosen["positive_score"].to_numpy()))
        near = rows.mapInArrow(_negatives(slots, n_negatives), "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
        by_score = Window.partitionBy("anchor_id", "positive_id").orderBy(F.col("negative_score").desc(), "negative_id")
        ranked = near.withColumn("rank", F.row_number().over(by_score)).where(f"rank <= {n_negatives}")
        done.append(stage(ranked.select(*(c.split()[0] for c in OUT.split(", "))), "block").staged_path)
        sent.destroy()
        slots.destroy()
    return spark.read.schema(OUT).parquet(*done)
