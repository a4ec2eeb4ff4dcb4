"""Helpers shared by the operators: staging, ordered id ranges, Arrow blocks."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peaklight.llm._words import mix

U = np.uint64
#: Bits of a filter of ids that is broadcast: 16 MB at most.
MOST_BITS = 1 << 27
#: Partitions that its words come to the driver in; each takes a job.
FILTER_PARTS = 8
#: Bytes of text that one numpy block holds; a single longer row is a block of its own.
BLOCK_BYTES = 1 << 21


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is what the cluster names in ``spark.checkpoint.dir``.  Only in a session of one
    machine (master ``local``) that leaves it unset a temporary folder is used; elsewhere that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return root or f"file://{tempfile.gettempdir()}/peaklight-{os.getuid()}"


class Stage:
    """Writes intermediate tables to the shared folder, which cuts the lineage."""

    #: Lists that every new Stage is put on, see gathered().
    lists: list[list[Stage]] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.n = spark, f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}", 0
        self.live: set[str] = set()
        for made in self.lists:
            made.append(self)

    def __call__(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.n += 1
        path = f"{self.path}/{self.n:03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.staged_path = path
        self.live.add(path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete staged tables that nothing reads any more."""
        for df in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(df.staged_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
            self.live.discard(df.staged_path)

    def keep_only(self, *tables: DataFrame) -> None:
        """Delete all staged tables but those that a result still reads."""
        for name in self.live - {df.staged_path for df in tables}:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.live &= {df.staged_path for df in tables}


@contextlib.contextmanager
def gathered() -> Iterator[list[Stage]]:
    """The Stages made inside the block.  Once the block's result is written, ``keep_only()`` of each frees what it still read."""
    made: list[Stage] = []
    Stage.lists.append(made)
    try:
        yield made
    finally:
        Stage.lists.remove(made)


#: A key with more than this share of the rows is hot; there can't be more than 1/HOT of them.
HOT = 1 / 1000


def join_counted(big: DataFrame, small: DataFrame, on: str | list[str], how: str = "inner", total: int | None = None) -> DataFrame:
    """``big`` joined to ``small``, which has one row for each key and, as ``n``, how many rows of ``big`` have it.

    The rows of ``small`` for hot keys, at most 1/HOT by arithmetic whatever the
    input, go to all tasks.  The rest is a join by key and salt: rows of a hot key, which have found their
    partner, and rows with a null key, which have none, get a salt that spreads them evenly, so no key of the shuffle has more than
    a share HOT of the rows.  ``n`` is left out of the result.  ``total`` is the sum of ``n`` or more.
    """
    on = [on] if isinstance(on, str) else on
    if total is None:
        total = small.agg(F.sum("n")).first()[0] or 0
    limit = max(1, int(total * HOT))
    values = [c for c in small.columns if c not in (*on, "n")]
    rest = [c for c in big.columns if c not in on]
    hot = small.where(F.col("n") > limit).select(*on, *(F.col(c).alias(f"_hot_{c}") for c in values), F.lit(True).alias("_hot"))
    cold = small.where(F.col("n") <= limit).select(*on, *(F.col(c).alias(f"_cold_{c}") for c in values), F.lit(0).alias("_salt"), F.lit(True).alias("_cold"))
    away = F.col("_hot").isNotNull() | F.expr(" or ".join(f"{c} is null" for c in on))
    out = big.join(F.broadcast(hot), on, "left").withColumn("_salt", F.when(away, 1 + F.pmod(F.xxhash64(*rest), F.lit(1 << 20))).otherwise(0).cast("int"))
    out = out.join(cold, [*on, "_salt"], "left")
    if how == "inner":
        out = out.where("_hot is not null or _cold is not null")
    return out.select(*big.columns, *(F.coalesce(f"_hot_{c}", f"_cold_{c}").alias(c) for c in values))


def documents(docs: DataFrame) -> DataFrame:
    """The two columns that the operators read; a null text counts as empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def n_parts(df: DataFrame) -> int:
    """As many partitions as a shuffle of ``df`` should have: the session's number, or the scan's if that is larger."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())


def id_ranges(ids: DataFrame, n: int) -> tuple[list[int], list[int]]:
    """Split the ids into at most ``n`` even ranges; returns their smallest and largest ids, ascending.

    Only ids are shuffled, and one pair of numbers for each range comes to the driver.
    """
    ranged = ids.select(key().alias("k")).repartitionByRange(n, "k")
    rows = ranged.groupBy(F.spark_partition_id().alias("p")).agg(F.min("k").alias("lo"), F.max("k").alias("hi")).collect()
    return sorted(r.lo for r in rows), sorted(r.hi for r in rows)


def key(col: str = "doc_id"):
    """The id as it is ordered: a null id comes before all others."""
    return F.coalesce(F.col(col), F.lit(-(2**63)))


def range_of(keys: np.ndarray, highs: np.ndarray) -> np.ndarray:
    return np.minimum(np.searchsorted(highs, keys), max(0, len(highs) - 1))


def range_udf(highs: list[int]):
    """A column function: the number of the range that a key falls in."""
    bounds = np.array(highs, np.int64)

    @F.pandas_udf("int")
    def number(keys: pd.Series) -> pd.Series:
        return pd.Series(range_of(keys.to_numpy(np.int64), bounds), dtype="int32")

    return number


def small(batches: Iterator[pa.RecordBatch], limit: int = 2 * BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``limit`` bytes of text, so that a worker's memory doesn't follow the size of Spark's batches."""
    for batch in batches:
        text = batch.column(batch.schema.get_field_index("text"))
        wide = np.int64 if pa.types.is_large_string(text.type) else np.int32
        off = np.frombuffer(text.buffers()[1], wide)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, wide)
        i = 0
        while i < len(text):
            j = max(i + 1, int(np.searchsorted(off, int(off[i]) + limit, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of a string array with their UTF-8 bytes and the offsets of the rows in these."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if not len(texts):
        return
    _, off, data = texts.buffers()
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    off = np.frombuffer(off, wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def _places(ids: np.ndarray, bits: int) -> np.ndarray:
    """Two places of each id in a filter of so many bits (a power of two)."""
    h = mix(ids.view(U) + U(0x632BE59BD9B4E019))
    return np.stack([h & U(bits - 1), (h >> U(32)) & U(bits - 1)]).astype(np.int64)


def id_filter(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of whole numbers as words of 64 bits, at most MOST_BITS whatever their number.

    Each partition sends the words it sets; words are united before they come to
    the driver.  A full filter lets every number through, which costs work but no result.
    """
    bits = min(MOST_BITS, max(1 << 16, 1 << (16 * max(1, ids.count())).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(_places(b.column(0).fill_null(-(2**63)).to_numpy(), bits))
            words, first = np.unique(at >> 6, return_index=True)
            yield pa.RecordBatch.from_pydict({"word": pa.array(words), "set": pa.array(np.bitwise_or.reduceat(U(1) << (at & 63).astype(U), first).view(np.int64) if len(at) else np.zeros(0, np.int64))})

    out = np.zeros(bits // 64, np.int64)
    for r in ids.mapInArrow(run, "word long, set long").groupBy("word").agg(F.expr("bit_or(set)").alias("set")).coalesce(FILTER_PARTS).toLocalIterator():
        out[r[0]] = r[1]
    return out


def maybe(words: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which ids may be in the filter; all that are in it, and some others."""
    at = _places(ids, len(words) * 64)
    bit = U(1) << (at & 63).astype(U)
    return ((words[at >> 6].view(U) & bit) != 0).all(0)
