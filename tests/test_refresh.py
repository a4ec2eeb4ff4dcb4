"""A library that follows its files: what differs is made anew, the rest stays, and the whole equals a full build."""

import os

import pytest
from pyspark.sql import functions as F

from peaklight.model import Grid
from peaklight.operators import refresh
from peaklight.sources import headers, inventory, writers

GRID = Grid(0, 19, 1)


def write(folder, i, scale=1.0, text=None):
    lines = text if text is not None else "\n".join(f"{k} {scale * ((k * (i + 1)) % 11 + 0.5 * i)}" for k in range(20))
    (folder / f"f{i}.txt").write_text(f"##NAMES=n{i}\n" + lines + "\n")


def parser(spark, seen):
    def parse(records):
        seen.append(records.count())
        files = records.join(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(ROOT[0]).select("path", F.decode("content", "ISO-8859-1").alias("value")), "path")
        rows = headers.body(files.select("path", "value")).join(records, "path")
        return rows.select("alias", "relative_path", F.col("relative_path").alias("name"), F.lit("").alias("flag"), F.col("relative_path").alias("filename"), F.lit(False).alias("already_processed"), "axis", "intensity", "error")

    return parse


ROOT = [None]


def rows_of(spark, folder):
    raw, corrected = refresh.load(spark, folder)
    pick = lambda x: sorted((r.row_id, r.variant, r.name, tuple(r.vector), r.failure or "") for r in x.collect())
    return pick(raw) + pick(corrected)


def test_only_what_differs_is_made(spark, tmp_path):
    files = tmp_path / "files"
    files.mkdir()
    ROOT[0] = f"file://{files}"
    for i in range(100):
        write(files, i)
    folder, seen = f"file://{tmp_path}/lib", []
    scan = lambda: inventory.scan(spark, {"own": ROOT[0]})[0]
    first = refresh.refresh(spark, scan(), parser(spark, seen), GRID, folder, buckets=16)
    assert (first["added"], first["made"], first["rows"]) == (100, 200, 100) and seen == [100]
    assert refresh.refresh(spark, scan(), parser(spark, seen), GRID, folder, buckets=16) == {"added": 0, "changed": 0, "gone": 0, "same": 100, "made": 0, "buckets": 0, "rows": 100} and seen == [100]
    write(files, 7, 3.5)
    os.utime(files / "f7.txt", (1, 1))
    one = refresh.refresh(spark, scan(), parser(spark, seen), GRID, folder, buckets=16)
    assert (one["changed"], one["same"], one["made"], one["buckets"]) == (1, 99, 2, 1) and seen == [100, 1]
    (files / "f8.txt").unlink()
    write(files, 200)
    write(files, 9, text="no numbers")
    more = refresh.refresh(spark, scan(), parser(spark, seen), GRID, folder, buckets=16)
    assert (more["gone"], more["added"], more["changed"], more["made"]) == (1, 1, 1, 4) and seen == [100, 1, 2]
    full = f"file://{tmp_path}/full"
    refresh.refresh(spark, scan(), parser(spark, []), GRID, full, buckets=16)
    assert rows_of(spark, folder) == rows_of(spark, full)
    assert not [x for x in writers.children(spark, folder) if "staging" in x or "lease" in x]


def test_buckets_that_become_empty_and_another_grid(spark, tmp_path):
    files = tmp_path / "files"
    files.mkdir()
    ROOT[0] = f"file://{files}"
    for i in range(3):
        write(files, i)
    folder = f"file://{tmp_path}/lib"
    scan = lambda: inventory.scan(spark, {"own": ROOT[0]})[0]
    refresh.refresh(spark, scan(), parser(spark, []), GRID, folder, buckets=64)
    (files / "f1.txt").unlink()
    assert refresh.refresh(spark, scan(), parser(spark, []), GRID, folder, buckets=64)["gone"] == 1
    assert {r[2] for r in rows_of(spark, folder)} == {"f0.txt", "f2.txt"}
    # A refresh that died after it had replaced buckets, before the scan: the next one does it again.
    write(files, 0, 9.0)
    os.utime(files / "f0.txt", (5, 5))
    kept = writers.read_json(spark, f"{folder}/library.json")
    old = spark.read.parquet(f"{folder}/scans/{kept['scan']}").collect()
    refresh.refresh(spark, scan(), parser(spark, []), GRID, folder, buckets=64)
    after = rows_of(spark, folder)
    spark.createDataFrame(old, "alias string, relative_path string, path string, size long, modified timestamp").write.parquet(f"{folder}/scans/old")
    writers.write_json(spark, f"{folder}/library.json", kept | {"scan": "old"})
    assert refresh.refresh(spark, scan(), parser(spark, []), GRID, folder, buckets=64)["changed"] == 1 and rows_of(spark, folder) == after
    assert refresh.refresh(spark, scan(), parser(spark, []), Grid(0, 9, 1), folder, buckets=64)["added"] == 2
    for i in (0, 2):
        (files / f"f{i}.txt").unlink()
    assert refresh.refresh(spark, scan(), parser(spark, []), Grid(0, 9, 1), folder, buckets=64)["rows"] == 0 and rows_of(spark, folder) == []
    write(files, 5)
    assert refresh.refresh(spark, scan(), parser(spark, []), Grid(0, 9, 1), folder, buckets=64)["made"] == 2 and len(rows_of(spark, folder)) == 2
    with pytest.raises(FileNotFoundError):
        refresh.load(spark, f"file://{tmp_path}/none")


def test_changes_of_odd_scans(spark):
    kind = "alias string, relative_path string, size long, modified long"
    before = spark.createDataFrame([("a", "x", 1, 1), ("a", "y", 1, 1), ("a", "y", 2, 2), (None, "z", 1, 1), ("a", "n", None, None)], kind)
    after = spark.createDataFrame([("a", "y", 2, 2), ("b", "x", 1, 1), ("a", "n", None, None), ("a", None, 1, 1)], kind)
    got = {(r.alias, r.relative_path): (r.change, r.size) for r in refresh.change_set(before, after).collect()}
    assert got == {("a", "x"): ("gone", 1), ("a", "y"): ("same", 2), ("b", "x"): ("added", 1), ("a", "n"): ("same", None)}
    assert refresh.change_set(before.where("false"), after.where("false")).count() == 0
