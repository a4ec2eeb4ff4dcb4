"""Results kept as they were: rows of any nested shape as VARIANT, with a hash over their canonical form.

A snapshot is a Parquet table with a row per result row (place, content, digest) and a marker that is written last and says what it is a
result of, how many rows it has and its hash.  A result without rows is a result too.  VARIANT objects keep their keys sorted, so the text of a value doesn't
depend on the order of its fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peaklight.operators.catalog import inventory_signature
from peaklight.sources.lease import Lease
from peaklight.sources.writers import children, promote, quarantine, read_json, write_json


def frozen(value: Column) -> Column:
    """A struct, array or map as VARIANT; its types stay, its fields are sorted."""
    return F.to_variant_object(value)


def canonical(content: Column) -> Column:
    """The one text of a VARIANT: fields sorted, nulls stated, no blanks."""
    return F.to_json(content)


def freeze(rows: DataFrame, order: list[Column | str], place: str = "place") -> DataFrame:
    """place (from 0, in the given order), content and digest of the rows of a result.

    Results are bounded by the number that is shown, so one window places them; a larger table brings its own places as the column ``place``, and is placed nowhere else.
    The rows' columns, whatever their names, are the content's fields, ``place`` excepted.
    """
    fields = [F.col(f"`{c}`") for c in rows.columns if c != place]
    at = F.col(place).cast("long") if place in rows.columns else (F.row_number().over(Window.orderBy(*order)) - 1).cast("long")
    return rows.select(at.alias("place"), frozen(F.struct(*fields)).alias("content")).withColumn("digest", F.sha2(canonical(F.col("content")), 256))


def thaw(snapshot: DataFrame, schema: str) -> DataFrame:
    """The rows as they were, in order of place; ``schema`` as DDL.  A field that isn't there is null."""
    return snapshot.select("place", F.variant_get("content", "$", f"struct<{schema}>").alias("r")).select("place", "r.*")


def at(path: str, kind: str, content: str = "content") -> Column:
    """One value of a snapshot by its path ($.provenance.source, $.runs[0].start); null where there is none or it isn't of that kind."""
    return F.try_variant_get(F.col(content), path, kind)


def digest(snapshot: DataFrame) -> dict:
    """{"rows": n, "digest": hash} over places and digests; of no rows the hash of nothing."""
    row = inventory_signature(snapshot, ["place", "digest"]).first()
    return {"rows": row.records or 0, "digest": row.signature}


def write_snapshot(spark: SparkSession, snapshot: DataFrame, folder: str, identity: str, facts: dict | None = None) -> dict:
    """Publish a frozen result under its identity; returns the marker.

    The same identity is published once: if it is there with the same hash it stays as it is, with another hash that is a ValueError, as one approved request has one result.
    ``facts`` are kept in the marker.
    """
    place, marker = f"{folder.rstrip('/')}/{identity}", f"{folder.rstrip('/')}/{identity}.json"
    with Lease(spark, f"{marker}.lease") as lease:
        staged = f"{place}.staging-{lease.owner}"
        for left in (f"{folder.rstrip('/')}/{x}" for x in children(spark, folder) if x.startswith(f"{identity}.staging")):
            quarantine(spark, left, f"{folder.rstrip('/')}/quarantine")
        snapshot.write.parquet(staged)
        new = {"identity": identity, "facts": facts or {}} | digest(spark.read.schema(snapshot.schema).parquet(staged))
        known = read_json(spark, marker)
        if known is not None:
            quarantine(spark, staged, f"{folder.rstrip('/')}/quarantine")
            if known["digest"] != new["digest"]:
                raise ValueError(f"{identity} has another result: {known['digest']}, now {new['digest']}")
            return known
        quarantine(spark, place, f"{folder.rstrip('/')}/quarantine")
        lease.check()
        promote(spark, staged, place)
        write_json(spark, marker, new)
        return new


def read_snapshot(spark: SparkSession, folder: str, identity: str, check: bool = True) -> tuple[DataFrame, dict]:
    """(rows, marker) of a published result; with ``check`` its rows must have the marker's hash.  A FileNotFoundError where none was published."""
    marker = read_json(spark, f"{folder.rstrip('/')}/{identity}.json")
    if marker is None:
        raise FileNotFoundError(f"no result {identity} in {folder}")
    rows = spark.read.schema("place long, content variant, digest string").parquet(f"{folder.rstrip('/')}/{identity}")
    if check:
        # The contents are hashed again: a digest that was kept beside a changed content says nothing.
        found = digest(rows.withColumn("digest", F.sha2(canonical(F.col("content")), 256)))
        if found != {"rows": marker["rows"], "digest": marker["digest"]}:
            raise ValueError(f"the rows of {identity} aren't those of its marker")
    return rows, marker
