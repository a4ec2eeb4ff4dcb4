"""A faulty row for each rule of a result, and sound rows that break none."""

import pytest
from pyspark.sql import functions as F

from peaklight.operators import search

SOUND = dict(
    row_id=1, similarity=0.7, shape=0.75, gradient=0.5, pcs=0.4, pcs_f1=0.5, pcs_rho=0.1, rank_score=0.88 * 0.7 + 0.12 * 0.4, shift=-5, shift_cm1=-10.0, maximum_shift_points=5, common=40, requested=50, support_points=60, shifted_support_points=55,
    coverage_fraction=0.8, reference_overlap_fraction=40 / 55, shift_boundary=True, grid_clipped=True, gradient_weight_within_similarity=0.2, spectral_similarity_weight=0.88, peak_consistency_weight=0.12,
    shape_contribution=0.88 * 0.8 * 0.75, gradient_contribution=0.88 * 0.2 * 0.5, pcs_contribution=0.12 * 0.4,
)
KIND = "row_id long, similarity double, shape double, gradient double, pcs double, pcs_f1 double, pcs_rho double, rank_score double, shift int, shift_cm1 double, maximum_shift_points int, common int, requested int, support_points int, shifted_support_points int, coverage_fraction double, reference_overlap_fraction double, shift_boundary boolean, grid_clipped boolean, gradient_weight_within_similarity double, spectral_similarity_weight double, peak_consistency_weight double, shape_contribution double, gradient_contribution double, pcs_contribution double"

FAULTS = [
    ({"shape": float("nan")}, "finite numbers"), ({"pcs_rho": None}, "finite numbers"), ({"gradient": float("inf")}, "finite numbers"),
    ({"support_points": -1}, "counts"), ({"requested": None}, "counts"), ({"shift_boundary": None}, "flags"),
    ({"peak_consistency_weight": 1.2}, "weights"), ({"similarity": 1.5}, "range of similarity"), ({"pcs": -0.1}, "range of pcs"), ({"coverage_fraction": 1.1}, "range of fractions"),
    ({"rank_score": 0.5}, "rank score"), ({"peak_consistency_weight": 0.2}, "peak weight"), ({"similarity": 0.6}, "similarity"), ({"shape_contribution": 0.1}, "shape contribution"),
    ({"gradient_contribution": 0.1}, "gradient contribution"), ({"pcs_contribution": 0.1}, "pcs contribution"), ({"pcs_contribution": 0.1}, "sum of contributions"),
    ({"coverage_fraction": 0.79}, "coverage"), ({"requested": 0}, "coverage"), ({"reference_overlap_fraction": 0.7}, "overlap"), ({"common": 51}, "common points"), ({"common": 56}, "common support"),
    ({"shifted_support_points": 61}, "shifted support"), ({"shift": 6}, "shift"), ({"shift": 4}, "shift boundary"), ({"maximum_shift_points": 0}, "shift boundary"), ({"grid_clipped": False}, "grid clipped"), ({"shift_cm1": -5.0}, "shift in axis units"),
]


@pytest.fixture(scope="module")
def broken(spark):
    rows = [SOUND] + [SOUND | fault | {"row_id": i} for i, (fault, _) in enumerate(FAULTS, 2)]
    out = search.self_consistency(spark.createDataFrame([tuple(r.values()) for r in rows], KIND), step=2.0)
    return {r.row_id: set(r.broken) for r in out.collect()}


def test_a_sound_row_breaks_no_rule(broken):
    assert broken[1] == set()


@pytest.mark.parametrize(("i", "name"), [(i, name) for i, (_, name) in enumerate(FAULTS, 2)])
def test_each_rule_has_a_row_that_breaks_it(broken, i, name):
    assert name in broken[i]


def test_every_rule_is_tried_and_rules_need_their_columns(spark):
    names = [f.split(" ")[0] for f in KIND.split(", ")]
    assert set(search.result_rules(names, step=2.0)) == {name for _, name in FAULTS} and "shift in axis units" not in search.result_rules(names)
    assert set(search.result_rules(["row_id", "pcs"])) == {"finite numbers", "range of pcs"}
    df = spark.createDataFrame([tuple(SOUND.values())], KIND)
    assert search.self_consistency(df.select("row_id")).first().broken == [] and search.self_consistency(df.where("false"), step=2.0).count() == 0
    zero = df.withColumn("common", F.lit(0)).withColumn("requested", F.lit(0)).withColumn("coverage_fraction", F.lit(0.0)).withColumn("reference_overlap_fraction", F.lit(0.0))
    assert search.self_consistency(zero, step=2.0).first().broken == []
