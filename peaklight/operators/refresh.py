"""A library that follows its files: only what was added or changed since the last time is read and made anew.

Vectors lie in buckets, by a hash of the file they come from.  A refresh compares two scans, makes vectors of the files that differ, and replaces the
buckets that hold them; all others stay as they are on disk.  The scan that the library agrees with is kept beside it and replaced last, so a refresh that
died halfway is found by the next one, which makes the same buckets again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from peaklight.model import Baseline, Grid, library_baseline, signature
from peaklight.operators.library import VECTORS, build_vectors
from peaklight.sources.lease import Lease
from peaklight.sources.writers import children, promote, quarantine, read_json, write_json

KEYS = ["alias", "relative_path"]
#: Buckets of a library; a refresh reads and writes those that hold a file that differs.
BUCKETS = 256


def change_set(before: DataFrame, after: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, change (added, changed, gone, same) and size, modified as they are now (as they were, of what is gone).

    A file is the same while its size and its time are; a file that a scan names twice counts as its latest, then largest state.  Rows with a null key are left out.
    """
    keys = keys or KEYS
    state = F.max(F.struct("modified", "size"))
    sides = [x.dropna(subset=keys).groupBy(*keys).agg(state.alias(name)) for x, name in ((before, "_old"), (after, "_new"))]
    both = sides[0].join(sides[1], keys, "full")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "gone").when(F.col("_old").eqNullSafe(F.col("_new")), "same").otherwise("changed")
    now = F.coalesce("_new", "_old")
    return both.select(*keys, change.alias("change"), now["size"].alias("size"), now["modified"].alias("modified"))


def file_id():
    """A row number that a file keeps whatever else the library holds: a hash of its alias and path."""
    return F.xxhash64(*KEYS)


def _bucket(buckets: int):
    return F.pmod(F.xxhash64(*KEYS, F.lit("bucket")), F.lit(buckets)).cast("int")


def refresh(spark: SparkSession, records: DataFrame, parse: Callable[[DataFrame], DataFrame], grid: Grid, folder: str, how: Baseline | None = None, buckets: int = BUCKETS, age: float = 60.0) -> dict:
    """Bring the library in ``folder`` up to the scan ``records`` (alias, relative_path, path, size, modified); returns what was done.

    ``parse`` gives for some records the sources of build_vectors() with alias and relative_path beside them (row_id is set here); it sees the files that were added or changed alone.
    A library of another grid, baseline or number of buckets goes to quarantine, and everything is made.  One driver refreshes a library at a time.
    Returns added, changed, gone, same, made (rows of vectors made, two for each file), buckets (replaced) and rows.
    """
    how, root = how or library_baseline(), folder.rstrip("/")
    name = signature({"grid": grid.payload(), "baseline": how.payload(), "buckets": buckets}, 12)
    vectors, scans, marker = f"{root}/vectors", f"{root}/scans", f"{root}/library.json"
    with Lease(spark, f"{root}/library.lease", age) as lease:
        known = read_json(spark, marker)
        if known is None or known["name"] != name:
            for left in (marker, vectors, scans):
                quarantine(spark, left, f"{root}/quarantine")
            known = None
        now = records.select(*KEYS, "path", "size", "modified").dropna(subset=KEYS)
        # The scan is written before anything is compared with it: what is kept is what was compared, whatever happens to the files meanwhile.
        scan = f"{scans}/{lease.owner}"
        now.write.parquet(scan)
        now = spark.read.schema(now.schema).parquet(scan)
        old = spark.read.schema(now.schema).parquet(f"{scans}/{known['scan']}") if known else now.where("false")
        changes = change_set(old, now).withColumn("bucket", _bucket(buckets)).persist()
        try:
            counts = dict.fromkeys(("added", "changed", "gone", "same"), 0) | dict(changes.groupBy("change").count().collect())
            touched = sorted(r[0] for r in changes.where("change <> 'same'").select("bucket").distinct().collect())
            out = counts | {"made": 0, "buckets": len(touched)}
            if touched:
                differ, away = (changes.where(F.col("change").isin(*kinds)).select(*KEYS) for kinds in (("added", "changed"), ("changed", "gone")))
                seen, rows = Observation(), None
                if counts["added"] + counts["changed"]:
                    sources = parse(now.join(differ, KEYS, "left_semi")).withColumn("row_id", file_id())
                    rows = build_vectors(sources, grid, how).withColumn("bucket", _bucket(buckets)).observe(seen, F.count(F.lit(1)).alias("made"))
                if known and known["rows"]:
                    kept = spark.read.parquet(vectors).where(F.col("bucket").isin(touched)).join(away, KEYS, "left_anti")
                    rows = kept if rows is None else rows.unionByName(kept.select(rows.columns))
                staged = f"{root}/staging-{lease.owner}"
                rows.repartition("variant", "bucket").write.partitionBy("variant", "bucket").parquet(staged)
                out["made"] = (seen.get["made"] or 0) if counts["added"] + counts["changed"] else 0
                lease.check()
                if known is None or not known["rows"]:
                    quarantine(spark, vectors, f"{root}/quarantine")
                    promote(spark, staged, vectors)
                else:
                    # Buckets that became empty are in no partition of the new rows, so they are emptied by name.
                    new = spark.read.schema(spark.read.parquet(vectors).schema).parquet(staged)
                    held = {(r.variant, r.bucket) for r in new.select("variant", "bucket").distinct().collect()}
                    for variant in ("DB-RAW", "DB-BC"):
                        for b in touched:
                            if (variant, b) not in held:
                                quarantine(spark, f"{vectors}/variant={variant}/bucket={b}", f"{root}/quarantine")
                    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("variant", "bucket").parquet(vectors)
                    quarantine(spark, staged, f"{root}/quarantine")
            out["rows"] = counts["added"] + counts["changed"] + counts["same"]
            lease.check()
            write_json(spark, marker, {"name": name, "scan": lease.owner, "grid": grid.payload(), "rows": out["rows"]})
            for left in children(spark, scans):
                if left != lease.owner:
                    quarantine(spark, f"{scans}/{left}", f"{root}/quarantine")
            return out
        finally:
            changes.unpersist()


def load(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(raw, corrected) of a library that was refreshed; reading one variant touches only its partitions."""
    marker = read_json(spark, f"{folder.rstrip('/')}/library.json")
    if marker is None:
        raise FileNotFoundError(f"no library in {folder}")
    rows = spark.read.parquet(f"{folder.rstrip('/')}/vectors").drop("bucket") if marker["rows"] else spark.createDataFrame([], VECTORS)
    return rows.where("variant = 'DB-RAW'"), rows.where("variant = 'DB-BC'")
