"""Exact deduplication with counting quotient filters.

A 64-bit fingerprint is cut into a quotient, which names a slot, and a
remainder, which the slot stores; so a filter holds fingerprints without loss.
Each partition builds filters of its own fingerprints, one for each range of
the fingerprint space; filters of one range merge by their sorted remainders.
Only fingerprints counted more than once go to the comparison of bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peaklight.llm._base import Stage, documents, id_filter, join_counted, maybe, n_parts, small

#: Deleted before texts are compared: [\x20\x09-\x0D].
BLANKS = bytes([32, *range(9, 14)])
#: Bytes of texts that a task remembers to compare equal ones at once.
SEEN = 1 << 26


class CountingQuotientFilter:
    """Fingerprints with counts, as occupied bits, run ends, remainders and counters.

    occupied: one bit for each quotient that has a run; ends: one bit for each
    slot, set at the last of its run; remainders: sorted inside a run; counters:
    a bit for each slot that counts more than one, and these counts.
    """

    def __init__(self, prints: np.ndarray, counts: np.ndarray, low: int = 0, bits: int = 64):
        """prints: sorted, distinct, all in [low, low + 2**bits)."""
        own = prints - np.uint64(low)
        self.low, self.bits = low, bits
        self.q = min(bits, max(1, int(np.ceil(np.log2(max(1, len(own)) / 0.75)))))
        self.r = bits - self.q
        quotient = (own >> np.uint64(self.r)).astype(np.int64) if self.r < 64 else np.zeros(len(own), np.int64)
        self.occupied = np.zeros(1 << self.q, bool)
        self.occupied[quotient] = True
        self.ends = np.ones(len(own), bool)
        self.ends[:-1] = quotient[1:] != quotient[:-1]
        self.remainders = own & np.uint64((1 << self.r) - 1)
        self.counts = counts.astype(np.int64)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        runs = np.cumsum(self.ends) - self.ends
        quotient = np.flatnonzero(self.occupied)[runs].astype(np.uint64)
        return (quotient << np.uint64(self.r)) + self.remainders + np.uint64(self.low), self.counts

    def to_bytes(self) -> bytes:
        many = self.counts > 1
        width = (self.r + 7) // 8
        head = np.array([len(self.ends), self.q, self.bits], np.int64).tobytes() + np.array([self.low], np.uint64).tobytes()
        slots = self.remainders.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
        return head + np.packbits(self.occupied).tobytes() + np.packbits(self.ends).tobytes() + slots + np.packbits(many).tobytes() + self.counts[many].tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> CountingQuotientFilter:
        n, q, bits = np.frombuffer(raw, np.int64, 3).tolist()
        out = cls.__new__(cls)
        out.low, out.bits, out.q, out.r = int(np.frombuffer(raw, np.uint64, 1, 24)[0]), bits, q, bits - q
        at, width = 32, (bits - q + 7) // 8

        def take(size: int) -> np.ndarray:
            nonlocal at
            at += size
            return np.frombuffer(raw, np.uint8, size, at - size)

        out.occupied = np.unpackbits(take(((1 << q) + 7) // 8), count=1 << q).astype(bool)
        out.ends = np.unpackbits(take((n + 7) // 8), count=n).astype(bool)
        slots = np.zeros((n, 8), np.uint8)
        slots[:, :width] = take(n * width).reshape(n, width)
        out.remainders = slots.view(np.uint64).reshape(n)
        many = np.unpackbits(take((n + 7) // 8), count=n).astype(bool)
        out.counts = np.ones(n, np.int64)
        out.counts[many] = np.frombuffer(take(8 * int(many.sum())).tobytes(), np.int64)
        return out

    @classmethod
    def merge(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """Lossless: remainders of a run stay sorted, counts of equal ones add up.

        The sort is a stable one, which merges the filters' ascending runs.
        """
        parts = [f.items() for f in filters]
        prints, counts = np.concatenate([p for p, _ in parts]), np.concatenate([c for _, c in parts])
        order = np.argsort(prints, kind="stable")
        prints, counts = prints[order], counts[order]
        first = np.ones(len(prints), bool)
        first[1:] = prints[1:] != prints[:-1]
        return cls(prints[first], np.add.reduceat(counts, np.flatnonzero(first)) if len(prints) else counts, filters[0].low, filters[0].bits)


def _digest(raw: bytes) -> tuple[int, bytes, bytes]:
    """The fingerprint, the SHA-256 digest and the bytes of a text without its blanks."""
    raw = raw.translate(None, BLANKS)
    sha = hashlib.sha256(raw).digest()
    return int.from_bytes(sha[:8], "little", signed=True), sha, raw


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        n, prints, shas = [], [], []
        for x in batch.column("text"):
            raw = x.as_buffer().to_pybytes()
            n.append(len(raw) if raw.isascii() else len(raw.decode("utf-8", "replace")))
            number, sha, _ = _digest(raw)
            prints.append(number)
            shas.append(sha)
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_chars": pa.array(n, pa.int64()), "print": pa.array(prints, pa.int64()), "sha": pa.array(shas, pa.binary())})


def _different(a: bytes, b: bytes) -> None:
    if a != b:
        raise ValueError("two different texts share a SHA-256 digest")


def _candidates(known):
    """Texts whose fingerprint may be repeated.  Equal ones of a task are compared here, byte by byte, and only the first goes on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = known.value
        seen, size = {}, 0
        for batch in small(batches):
            out = []
            for x in batch.column("text"):
                number, sha, raw = _digest(x.as_buffer().to_pybytes())
                if not maybe(words, np.array([number], np.int64))[0]:
                    continue
                if sha in seen:
                    _different(seen[sha], raw)
                    continue
                if size > SEEN:  # the task's memory stays bounded; what is sent twice is compared later
                    seen, size = {}, 0
                seen[sha] = raw
                size += len(raw)
                out.append((number, sha, raw))
            yield pa.RecordBatch.from_pydict({"print": pa.array([o[0] for o in out], pa.int64()), "sha": pa.array([o[1] for o in out], pa.binary()), "bytes": pa.array([o[2] for o in out], pa.binary())})

    return run


def _filters(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = np.concatenate([np.zeros(0, np.int64), *(b.column("print").to_numpy() for b in batches)]).view(np.uint64)
        prints, counts = np.unique(prints, return_counts=True)
        ranges = (prints >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(prints), np.int64)
        names, starts = np.unique(ranges, return_index=True)
        ends = [*starts[1:], len(prints)][: len(names)]
        made = [CountingQuotientFilter(prints[a:b], counts[a:b], int(name) << (64 - bits), 64 - bits).to_bytes() for name, a, b in zip(names.tolist(), starts, ends, strict=True)]
        yield pa.RecordBatch.from_pydict({"part": pa.array(names, pa.int64()), "filter": pa.array(made, pa.binary())})

    return run


def _repeated(group: pd.DataFrame) -> pd.DataFrame:
    merged = CountingQuotientFilter.merge([CountingQuotientFilter.from_bytes(x) for x in group["filter"]])
    prints, counts = merged.items()
    return pd.DataFrame({"print": prints[counts > 1].view(np.int64), "n": counts[counts > 1]})


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without [\\x20\\x09-\\x0D].  Of equal ones the
    row with most code points, then the smallest doc_id, is kept; of rows that
    agree in both, one.  A null text counts as empty; empty and blank texts are
    equal to each other.  A null doc_id comes after all others.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "dedup")
    parts = n_parts(docs)
    docs = documents(docs)
    meta = stage(docs.mapInArrow(_digests, "doc_id long, n_chars long, print long, sha binary").withColumn("rid", F.monotonically_increasing_id()), "meta")
    bits = max(1, int(np.ceil(np.log2(parts))))
    filters = meta.select("print").mapInArrow(_filters(bits), "part long, filter binary")
    repeated = stage(filters.groupBy("part").applyInPandas(_repeated, "print long, n long"), "repeated")

    # The row that stays, of each group.
    best = F.struct(F.col("n_chars"), F.coalesce(-F.col("doc_id"), F.lit(-(2**63))).alias("o"), (-F.col("rid")).alias("r"), F.col("doc_id").alias("keep_id"))
    among = join_counted(meta, repeated, "print")
    pivot = stage(among.groupBy("print", "sha").agg(F.max(best).alias("b"), F.count("*").alias("n")).select("print", "sha", F.col("b.keep_id").alias("keep_id"), (-F.col("b.r")).alias("keep_rid"), F.col("n").alias("size"), "n"), "pivots")

    # Comparison of bytes: what a task has seen is compared there, so a group sends one text for each task at most; these agree if their least and greatest do.
    known = spark.sparkContext.broadcast(id_filter(repeated.select("print")))
    texts = docs.mapInArrow(_candidates(known), "print long, sha binary, bytes binary").join(repeated.select("print"), "print")
    if not texts.groupBy("print", "sha").agg(F.min("bytes").alias("lo"), F.max("bytes").alias("hi")).where("lo <> hi").isEmpty():
        raise ValueError("two different texts share a SHA-256 digest")

    stage.keep_only(meta, pivot)
    known = join_counted(meta, pivot, ["print", "sha"], "left")
    return known.select(
        "doc_id",
        F.when(F.col("keep_rid").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("rid") == F.col("keep_rid"), F.lit(True)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows that exact_groups() keeps, with all their columns.

    Rows that share a doc_id are told apart by their texts, and of equal ones one stays.
    """
    kept = exact_groups(docs).where("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
    kept = Stage(docs.sparkSession, "dedup")(kept, "kept")
    twice = docs.groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.count("*").alias("__n")).where("__n > 1").select("__id")
    twice = Stage(docs.sparkSession, "dedup")(twice, "twice")
    once = docs
    if not twice.isEmpty():
        once = docs.join(twice, docs["doc_id"].cast("long").eqNullSafe(twice["__id"]), "left_anti")
    out = once.join(kept, once["doc_id"].cast("long").eqNullSafe(kept["__id"]), "left_semi")
    if twice.isEmpty():
        return out
    rows = docs.join(twice, docs["doc_id"].cast("long").eqNullSafe(twice["__id"]), "left_semi")
    digest = F.sha2(F.translate(F.coalesce(F.col("text"), F.lit("")), " \t\n\x0b\x0c\r", ""), 256)
    longest = F.struct(F.coalesce(F.length("text"), F.lit(0)).alias("n"), *[F.col(c) for c in docs.columns])
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("__id"), digest.alias("__sha")).agg(F.max(longest).alias("__row"))
    rows = rows.join(kept, rows["__id"].eqNullSafe(kept["__id"]) & (rows["__sha"] == kept["__sha"]), "left_semi")
    return out.unionByName(rows.select([F.col(f"__row.{c}").alias(c) for c in docs.columns]))
