"""Packing into length buckets whose bounds minimise padding, by dynamic programming."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peaklight.llm._base import Stage, id_ranges, key, n_parts, range_udf

#: Tokens of the longest sequence, number of buckets, tokens of a batch with its padding.
LONGEST, BUCKETS, BUDGET = 8192, 16, 65536


def padding(lengths: np.ndarray, counts: np.ndarray, bounds: list[int]) -> int:
    """Padding of all sequences when each is filled up to the least bound that holds it."""
    return int((counts * (np.array(bounds)[np.searchsorted(bounds, lengths)] - lengths)).sum())


def optimal_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """At most ``buckets`` ascending bounds with the least padding; the last is the largest length.

    cost[k][j], the least padding of the j shortest lengths in k buckets, is
    the least over i of cost[k-1][i] plus the padding of lengths i..j-1 filled
    up to length j-1.  The best i grows with j, so each row is filled by
    divide and conquer: M log M steps for M lengths.  No lengths give no bounds.
    """
    order = np.argsort(lengths)
    length, count = np.asarray(lengths, np.int64)[order], np.asarray(counts, np.int64)[order]
    m = len(length)
    if not m:
        return []
    number, total = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(count * length)])
    cost = np.concatenate([[0], length * number[1:] - total[1:]])
    cut = []
    for _ in range(1, min(buckets, m)):
        new, best = np.zeros(m + 1, np.int64), np.zeros(m + 1, np.int64)
        work = [(1, m, 0, m - 1)]
        while work:
            lo, hi, a, b = work.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(a, min(b, j - 1) + 1)
            x = cost[i] + length[j - 1] * (number[j] - number[i]) - (total[j] - total[i])
            at = int(np.argmin(x))
            new[j], best[j] = x[at], i[at]
            work += [(lo, j - 1, a, int(best[j])), (j + 1, hi, int(best[j]), b)]
        cost = new
        cut.append(best)
    bounds, j = [], m
    for best in reversed(cut):
        bounds.append(int(length[j - 1]))
        j = int(best[j])
        if not j:
            break
    if j:
        bounds.append(int(length[j - 1]))
    return sorted(bounds)


def byte_tokens() -> Column:
    """Tokens of a byte-level vocabulary: the UTF-8 bytes of the text and one end token."""
    return F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long") + 1


def pack(docs: DataFrame, tokens: Column | None = None, longest: int = LONGEST, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """One row per sequence: doc_id, piece, start, n_tokens, bucket_len, batch_id, slot.

    A document of more than ``longest`` tokens gives several sequences, pieces
    0, 1, ...; no token is dropped.  All sequences count in the histogram,
    which has at most ``longest`` bars, so it may come to the driver.  Inside a
    bucket sequences follow each other by doc_id and piece (rows with one doc_id by their length);
    a batch takes as many as fit its budget when padded, at least one.  batch_id is the
    bucket's bound and the number of the batch in it; slot is the place in the batch.

    A bucket may hold any share of the rows: places in it come from counts for
    each range of doc_id, so no task sees more than its range.  A null text is an empty one (one end
    token); a null doc_id comes first.  Other columns, whatever their names, aren't read.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    n = n_parts(docs)
    lengths = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (byte_tokens() if tokens is None else tokens).cast("long").alias("size")).where("size > 0")
    stage = Stage(spark, "packing")
    lengths = stage(lengths, "lengths")
    whole = lengths.select(F.expr(f"size div {longest}").alias("full"), F.expr(f"size % {longest}").alias("rest"))
    bars = whole.groupBy("rest").agg(F.count("*").alias("n"), F.sum("full").alias("full")).collect()
    count = np.zeros(longest + 1, np.int64)
    for b in bars:
        count[b.rest] += b.n
        count[longest] += b.full
    count[0] = 0
    bounds = optimal_bounds(np.flatnonzero(count), count[np.flatnonzero(count)], buckets)
    if not bounds:
        return spark.createDataFrame([], "doc_id long, piece int, start long, n_tokens long, bucket_len int, batch_id string, slot long")

    bucket = F.lit(bounds[-1])
    for b in reversed(bounds[:-1]):
        bucket = F.when(F.col("n_tokens") <= b, b).otherwise(bucket)
    pieces = lengths.withColumn("piece", F.explode(F.sequence(F.lit(0), F.expr(f"cast((size - 1) div {longest} as int)"))))
    pieces = pieces.select("doc_id", "size", "piece", (F.col("piece").cast("long") * longest).alias("start"))
    pieces = pieces.withColumn("n_tokens", F.least(F.lit(longest).cast("long"), F.col("size") - F.col("start"))).withColumn("bucket_len", bucket)

    _, highs = id_ranges(lengths, n)
    ranged = stage(pieces.withColumn("k", key()).withColumn("range", range_udf(highs)("k")), "ranged")
    stage.keep_only(ranged)
    sums = ranged.groupBy("bucket_len", "range").agg(F.count("*").alias("n"))
    before = sums.withColumn("before", F.sum("n").over(Window.partitionBy("bucket_len").orderBy("range")) - F.col("n")).select("bucket_len", "range", "before")
    inside = Window.partitionBy("bucket_len", "range").orderBy(F.col("k"), "size", "piece")
    placed = ranged.withColumn("at", F.row_number().over(inside) - 1).join(before, ["bucket_len", "range"]).withColumn("at", F.col("at") + F.col("before"))
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket_len"))).cast("long")
    return placed.select(
        "doc_id",
        "piece",
        "start",
        "n_tokens",
        "bucket_len",
        F.concat_ws("-", F.col("bucket_len"), F.floor(F.col("at") / room).cast("long")).alias("batch_id"),
        (F.col("at") % room).alias("slot"),
    )
