"""Frozen results: inverse of thawing, one hash for equal values, an empty result as a value of its own."""

import pytest
from pyspark.sql import functions as F

from peaklight.operators import snapshots
from peaklight.sources import writers

KIND = "name string, score double, runs array<struct<start:int,end:int>>, provenance struct<source:string,wavelength:double>, tags map<string,string>, content string, digest int"
ROWS = [("Quartz", 0.5, [(1, 2), (3, None)], ("own", None), {"b": "1", "a": None}, "x", 1), (None, float("nan"), [], None, {}, None, 2), ("Ünï \"q\"", -0.0, None, (None, 514.5), None, "", None)]


def test_thawing_gives_the_rows_that_were_frozen(spark):
    df = spark.createDataFrame(ROWS, KIND)
    kept = snapshots.freeze(df, [F.col("name").desc_nulls_last()])
    assert kept.columns == ["place", "content", "digest"]
    out = snapshots.thaw(kept, KIND).orderBy("place").collect()
    want = df.orderBy(F.col("name").desc_nulls_last()).collect()
    assert [str(tuple(r)[1:]) for r in out] == [str(tuple(r)) for r in want] and [r.place for r in out] == [0, 1, 2]
    assert [r.v for r in kept.orderBy("place").select(snapshots.at("$.runs[1].start", "int").alias("v")).collect()] == [None, 3, None]
    assert kept.select(snapshots.at("$.none", "string"), snapshots.at("$.name", "array<int>")).distinct().collect() == [(None, None)]
    assert snapshots.thaw(kept, "score double, missing string").where("missing is null").count() == 3


def test_equal_results_hash_alike_in_any_order_of_fields(spark):
    df = spark.createDataFrame(ROWS, KIND)
    turned = df.select(*reversed(df.columns)).withColumn("provenance", F.struct("provenance.wavelength", "provenance.source"))
    digests = lambda x: [r.digest for r in snapshots.freeze(x, ["score"]).where("place = 0").collect()]
    assert digests(df.where("name = 'Quartz'")) == digests(turned.where("name = 'Quartz'"))
    assert digests(df.where("name = 'Quartz'")) != digests(df.where("name = 'Quartz'").withColumn("score", F.lit(0.25)))
    a = snapshots.digest(snapshots.freeze(df.where("name is not null"), ["name"]))
    assert a == snapshots.digest(snapshots.freeze(df.where("name is not null").repartition(3), ["name"])) and a["rows"] == 2
    assert a != snapshots.digest(snapshots.freeze(df.where("name is not null"), [F.col("name").desc()]))


def test_a_result_is_published_once(spark, tmp_path):
    folder = f"file://{tmp_path}/r"
    df = spark.createDataFrame(ROWS, KIND)
    kept = snapshots.freeze(df, ["score"])
    made = snapshots.write_snapshot(spark, kept, folder, "abc", {"matching": "abc"})
    assert made["rows"] == 3 and snapshots.write_snapshot(spark, kept, folder, "abc") == made
    with pytest.raises(ValueError, match="another result"):
        snapshots.write_snapshot(spark, snapshots.freeze(df.limit(1), ["score"]), folder, "abc")
    rows, marker = snapshots.read_snapshot(spark, folder, "abc")
    assert marker == made and sorted(str(tuple(r)[1:]) for r in snapshots.thaw(rows, KIND).collect()) == sorted(str(tuple(r)) for r in df.collect())
    assert not [x for x in writers.children(spark, folder) if "staging" in x or "lease" in x]
    with pytest.raises(FileNotFoundError):
        snapshots.read_snapshot(spark, folder, "none")
    writers.write_json(spark, f"{folder}/abc.json", made | {"digest": "0"})
    with pytest.raises(ValueError, match="marker"):
        snapshots.read_snapshot(spark, folder, "abc")


def test_an_empty_result_is_a_result(spark, tmp_path):
    folder = f"file://{tmp_path}/r"
    nothing = snapshots.freeze(spark.createDataFrame([], KIND), ["score"])
    made = snapshots.write_snapshot(spark, nothing, folder, "none", {"status": "ok"})
    rows, marker = snapshots.read_snapshot(spark, folder, "none")
    assert rows.count() == 0 == marker["rows"] and marker["facts"] == {"status": "ok"} and made == marker
    assert marker["digest"] == snapshots.digest(nothing)["digest"]
