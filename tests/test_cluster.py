"""Clustering in passes against clustering in one task, on the same rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from peaklight.model import Reduction
from peaklight.operators import reduce

KIND = "row_id long, name string, flag string, fingerprint array<double>"


def table(spark, x, names=None, flags=None):
    rows = [(7 * i % 1009, names[i] if names else "a", flags[i] if flags else "", None if v is None else [float(p) for p in v]) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, KIND).repartition(3)


def both(df, how):
    one = {(r.row_id, r.name): (r.cluster, r.keep, r.reason) for r in reduce.decluster(df, how).collect()}
    passes = {(r.row_id, r.name): (r.cluster, r.keep, r.reason) for r in reduce.decluster(df, how, task_rows=0).collect()}
    return one, passes


@pytest.mark.parametrize(("seed", "kinds", "noise", "quota"), [(1, 4, 0.05, 9), (2, 7, 0.6, 9), (3, 8, 0.3, 3), (4, 1, 1.0, 9)])
def test_passes_give_the_labels_of_one_task(spark, seed, kinds, noise, quota):
    rng = np.random.default_rng(seed)
    centre = rng.random((kinds, 40))
    x = [centre[i % kinds] + noise * rng.random(40) for i in range(150)]
    flags = [["s", "", "x", None, "other"][i % 5] for i in range(150)]
    one, passes = both(table(spark, x, flags=flags), Reduction(representatives=quota))
    assert one == passes and len({c for c, _, _ in one.values()}) >= 2


def test_copies_few_kinds_and_unusable_rows(spark):
    rng = np.random.default_rng(9)
    kinds = rng.random((3, 12))
    for few in (1, 2, 3):
        x = [kinds[i % few] for i in range(40)] + [None, [], [0.0] * 12, [float("nan")] * 12]
        one, passes = both(table(spark, x), Reduction())
        assert one == passes
        assert sum(reason == "no fingerprint" for _, _, reason in one.values()) == 4
    names = [None, "b"] * 20 + ["c"] * 4
    one, passes = both(table(spark, [kinds[i % 3] + 0.1 * rng.random(12) for i in range(44)], names), Reduction())
    assert one == passes and {r for (_, n), (_, _, r) in one.items() if n == "c"} == {"small group"}
    assert reduce.decluster(table(spark, [kinds[0]]).where("false"), task_rows=0).count() == 0


def test_a_mixture_where_medoids_leave_clusters_empty(spark):
    # Two directions alone, of different lengths in the space of the components.
    x = [np.array([1.0, 0.02 * (i % 4 == 0), 0, 0]) for i in range(57)] + [np.array([0.0, 0, 1, 0])] * 3
    one, passes = both(table(spark, x), Reduction())
    assert one == passes


def test_only_large_names_go_in_passes(spark):
    rng = np.random.default_rng(3)
    names = ["big"] * 90 + ["small"] * 30
    df = table(spark, list(rng.random((120, 8))), names)
    out = reduce.decluster(df, Reduction(), task_rows=50)
    want = {r.row_id: (r.cluster, r.keep) for r in reduce.decluster(df, Reduction()).collect()}
    assert {r.row_id: (r.cluster, r.keep) for r in out.collect()} == want
    # The rows of the large name are in no group: the grouping sees the others alone.
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInPandas") == 1 and "big" in plan
    assert out.where(F.col("keep")).count() == sum(k for _, k in want.values())
