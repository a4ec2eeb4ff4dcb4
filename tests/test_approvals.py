"""Approvals as a stream: any cut of a log into batches leaves what the whole log does."""

import random
import time

import pytest
from pyspark.sql import functions as F

from peaklight.operators import workflow
from peaklight.streaming import approvals

NAMES = ["input", "baseline", "smoothing", "matching"]
KIND = "key string, at long, stage string, content string"


def log(seed, n=160, keys=4):
    rnd = random.Random(seed)
    return [(f"k{rnd.randrange(keys)}", t, rnd.choice([*NAMES, *NAMES, "other"]), rnd.choice(["a", "a", "b", None])) for t in range(n)]


def plain(events):
    chains, outcomes = {}, []
    for key, at, stage, content in sorted(events, key=lambda e: e[1]):
        chain, outcome, back = approvals.advance(chains.get(key, []), NAMES, at, stage or "", content or "")
        chains[key] = chain
        outcomes.append((key, at, outcome, tuple(back)))
    left = {(k, NAMES[i], i, c[i - 1][1] if i else "", c[i][1]) for k, c in chains.items() for i in range(len(c))}
    return left, sorted(outcomes)


def test_the_rules():
    chain, outcome, back = approvals.advance([], NAMES, 1, "baseline", "x")
    assert (chain, outcome, back) == ([], "wrong order", []) and approvals.advance([], NAMES, 1, "none", "x")[1] == "unknown stage"
    for i, name in enumerate(NAMES):
        chain, outcome, _ = approvals.advance(chain, NAMES, i, name, "x")
        assert outcome == "applied"
    again, outcome, back = approvals.advance(chain, NAMES, 9, "baseline", "x")
    assert again == chain and outcome == "unchanged" and back == []
    cut, outcome, back = approvals.advance(chain, NAMES, 9, "baseline", "y")
    assert len(cut) == 2 and outcome == "applied" and back == ["smoothing", "matching"]
    assert chain[3][1] == approvals.link(chain[2][1], "matching", "x")


@pytest.mark.parametrize("seed", [1, 2])
def test_the_whole_log_at_once(spark, seed):
    events = log(seed)
    df = spark.createDataFrame(events, KIND).unionByName(spark.createDataFrame([(None, 5, "input", "a"), ("k9", None, "input", "a")], KIND)).selectExpr("*", "1 as k", "2 as t", "3 as s", "4 as c", "5 as g")
    got = {tuple(r) for r in workflow.approved_chain(df, "key", "at", "stage", "content", NAMES).collect()}
    assert got == plain(events)[0]
    assert workflow.approved_chain(df.where("false"), "key", "at", "stage", "content", NAMES).count() == 0


@pytest.mark.parametrize("cuts", [[], [40, 41, 120], [3, 90]])
def test_any_cut_into_batches_leaves_the_same(spark, tmp_path, cuts):
    events = log(7)
    left, outcomes = plain(events)
    place, bounds = f"file://{tmp_path}", [0, *cuts, len(events)]
    for a, b in zip(bounds, bounds[1:]):
        spark.createDataFrame(events[a:b], KIND).repartition(2).write.parquet(f"{place}/in/{a:05d}")
        # A new driver goes on where the last one stopped; the same files again are no new events.
        for _ in range(2 if a else 1):
            approvals.run(spark, f"{place}/in/*", KIND, f"{place}/out", f"{place}/state", "key", "at", "stage", "content", NAMES)
    out = spark.read.parquet(f"{place}/out")
    assert sorted((r.key, r.at, r.outcome, tuple(r.taken_back)) for r in out.collect()) == outcomes
    assert {tuple(r) for r in approvals.latest(out, "key", NAMES).collect()} == left


def test_late_events_change_nothing(spark, tmp_path):
    place = f"file://{tmp_path}"
    for i, events in enumerate(([("a", 5, "input", "x"), ("a", 6, "baseline", "y")], [("a", 6, "baseline", "z"), ("a", 2, "input", "w"), ("b", 1, "input", "x"), ("a", 9, "smoothing", "s")])):
        spark.createDataFrame(events, KIND).coalesce(1).write.parquet(f"{place}/in/{i}")
        approvals.run(spark, f"{place}/in/*", KIND, f"{place}/out", f"{place}/state", "key", "at", "stage", "content", NAMES)
    out = spark.read.parquet(f"{place}/out")
    assert sorted((r.key, r.at, r.outcome) for r in out.collect()) == [("a", 2, "late"), ("a", 5, "applied"), ("a", 6, "applied"), ("a", 6, "late"), ("a", 9, "applied"), ("b", 1, "applied")]
    assert {(r.key, r.stage) for r in approvals.latest(out, "key", NAMES).collect()} == {("a", "input"), ("a", "baseline"), ("a", "smoothing"), ("b", "input")}


def test_idle_keys_are_forgotten(spark, tmp_path):
    place, seen = f"file://{tmp_path}", []
    stream = spark.readStream.schema(KIND).parquet(f"{place}/in/*")
    spark.createDataFrame([("a", 5, "input", "x")], KIND).coalesce(1).write.parquet(f"{place}/in/0")
    query = approvals.approvals(stream, "key", "at", "stage", "content", NAMES, idle="500").writeStream.foreachBatch(lambda df, n: seen.extend((r.key, r.outcome) for r in df.collect())).option("checkpointLocation", f"{place}/state").trigger(processingTime="200 milliseconds").start()
    try:
        end = time.monotonic() + 60
        while ("a", "expired") not in seen and time.monotonic() < end:
            time.sleep(0.2)
        spark.createDataFrame([("a", 7, "baseline", "y")], KIND).coalesce(1).write.parquet(f"{place}/in/1")
        while ("a", "wrong order") not in seen and time.monotonic() < end:
            time.sleep(0.2)
    finally:
        query.stop()
    assert seen[:2] == [("a", "applied"), ("a", "expired")] and ("a", "wrong order") in seen
    rows = spark.createDataFrame([("a", 5, "input", "applied", "s", ""), ("a", 5, None, "expired", None, None)], "key string, at long, stage string, outcome string, signature string, parent string").withColumn("taken_back", F.array().cast("array<string>"))
    assert approvals.latest(rows, "key", NAMES).count() == 0
