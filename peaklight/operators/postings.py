"""Postings: for each element the references that hold it, as bitmaps, and element policies as bit algebra.

A bitmap covers a bucket of 32,768 row numbers and takes 4 KB, so a posting list takes one bit per row.  Beside the rows
``with`` an element, the rows ``without`` it (those that state a formula) are kept: then include, exclude, only-from and exact-set are
all the intersection of some lists, which one aggregation per bucket gives.  Policies read the lists they need and no reference.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

#: Kinds of lists: rows with or without one element; with a formula or with none; not processed before.
WITH, WITHOUT, FORMULA, MISSING, NEW = "with", "without", "formula", "missing", "new"


@F.pandas_udf(BinaryType())
def _less(all_rows: pd.Series, some: pd.Series) -> pd.Series:
    """The bits of the first that the second doesn't have."""
    return pd.Series([(np.frombuffer(a, np.uint8) & ~np.frombuffer(b, np.uint8)).tobytes() for a, b in zip(all_rows, some, strict=True)], dtype=object)


def postings(library: DataFrame) -> DataFrame:
    """kind, element (empty but for with and without), bucket, bits and n (rows in it) of references (row_id, elements, has_formula, already_processed).

    Rows meet their bitmaps where they are read; bitmaps alone are shuffled.  A null row_id is in no list; null elements count as none, a
    null has_formula as false, a null or absent already_processed as not processed; a row_id that repeats with other elements is a row with all of them.
    """
    done = F.coalesce(F.col("already_processed"), F.lit(False)) if "already_processed" in library.columns else F.lit(False)
    stated = F.coalesce(F.col("has_formula"), F.lit(False))
    none = F.lit("")
    entry = lambda kind, element: F.struct(F.lit(kind).alias("kind"), element.alias("element"))
    held = F.when(stated, F.transform(F.array_compact(F.array_distinct(F.coalesce("elements", F.array().cast("array<string>")))), lambda e: entry(WITH, e))).otherwise(F.array().cast("array<struct<kind:string,element:string>>"))
    lists = F.concat(held, F.array(F.when(stated, entry(FORMULA, none)).otherwise(entry(MISSING, none))), F.when(done, F.array().cast("array<struct<kind:string,element:string>>")).otherwise(F.array(entry(NEW, none))))
    rows = library.where(F.col("row_id").isNotNull()).select(F.explode(lists).alias("l"), F.bitmap_bucket_number("row_id").alias("bucket"), F.bitmap_bit_position("row_id").alias("bit"))
    made = rows.groupBy(F.col("l.kind").alias("kind"), F.col("l.element").alias("element"), "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    every = made.where(F.col("kind") == FORMULA).select("bucket", F.col("bits").alias("every"))
    # One list of a few KB per bucket against the lists of that bucket.
    rest = made.where(F.col("kind") == WITH).join(every, "bucket").select(F.lit(WITHOUT).alias("kind"), "element", "bucket", _less("every", "bits").alias("bits"))
    return made.unionByName(rest).withColumn("n", F.bitmap_count("bits"))


def fitting(lists: DataFrame, include: list[str], exclude: list[str], mode: str = "must_include_all", allow_missing: bool = True, drop_processed: bool = False) -> DataFrame:
    """bucket and bits of the rows that a policy admits: element_policy() and eligible() said with postings alone.

    include: all of the listed, only the listed, or exactly the listed, by ``mode``; nothing is asked where the list is empty.  Excluded elements never
    count.  Rows without a formula are in as ``allow_missing`` says; with ``drop_processed`` those processed before are out.
    """
    if mode not in ("must_include_all", "only_from_list", "exact_set"):
        raise ValueError(f"no such mode: {mode}")
    kind, element = F.col("kind"), F.col("element")
    wanted = sorted(set(include)) if mode != "only_from_list" else []
    asked = (kind == FORMULA) | ((kind == WITH) & element.isin(wanted)) | ((kind == WITHOUT) & element.isin(sorted(set(exclude))))
    if include and mode != "must_include_all":
        asked = asked | ((kind == WITHOUT) & ~element.isin(sorted(set(include))))
    # A bucket where a wanted element has no list holds no row; one where another has none loses no row by it.
    met = lists.where(asked).groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count_if(kind == WITH).alias("held"), F.count_if(kind == FORMULA).alias("stated"))
    out = met.where((F.col("held") == len(wanted)) & (F.col("stated") == 1)).select("bucket", "bits")
    if allow_missing:
        out = out.unionByName(lists.where(kind == MISSING).select("bucket", "bits")).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    if drop_processed:
        both = out.unionByName(lists.where(kind == NEW).select("bucket", "bits")).groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("sides"))
        out = both.where("sides = 2").select("bucket", "bits")
    return out.where(F.bitmap_count("bits") > 0)


def _byte(bits: Column, at: Column) -> Column:
    return F.conv(F.hex(F.substring(bits, at + 1, F.lit(1))), 16, 10).cast("int")


def row_ids(bitmaps: DataFrame) -> DataFrame:
    """row_id of every bit that is set, by columns alone: bytes first, so that empty ones cost little."""
    bytes_ = bitmaps.select("bucket", "bits", F.explode(F.sequence(F.lit(0), F.lit(4095))).alias("at")).select("bucket", "at", _byte(F.col("bits"), F.col("at")).alias("byte")).where("byte > 0")
    bits = bytes_.select("bucket", "at", "byte", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k")).where("shiftright(byte, k) % 2 = 1")
    place = F.col("at") * 8 + F.col("k")
    return bits.select(F.when(F.col("bucket") > 0, (F.col("bucket") - 1) * 32768 + place + 1).otherwise(F.col("bucket") * 32768 - place).alias("row_id"))


def within(library: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The rows of a library whose bit is set; each bucket's bitmap meets its rows by a join on the bucket."""
    own = bitmaps.select(F.col("bucket").alias("_bucket"), F.col("bits").alias("_bits"))
    at = F.bitmap_bit_position("row_id")
    byte = _byte(F.col("_bits"), F.floor(at / 8).cast("int"))
    fits = F.floor(byte / F.pow(F.lit(2), at % 8)) % 2 == 1
    return library.join(own, F.bitmap_bucket_number("row_id") == F.col("_bucket")).where(fits).drop("_bucket", "_bits")


def counted(lists: DataFrame) -> DataFrame:
    """Of each element the number of rows that hold it, by counting bits."""
    return lists.where(F.col("kind") == WITH).groupBy("element").agg(F.sum("n").alias("rows"), F.count("*").alias("buckets"))
