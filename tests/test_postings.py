"""Element policies from postings against the policy on every row."""

import random

import pytest
from pyspark.sql import functions as F

from peaklight.operators import postings, search

KIND = "row_id long, elements array<string>, has_formula boolean, already_processed boolean"
NAMES = ["C", "Ca", "Fe", "H", "O", "Si", "S"]


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(4)
    ids = [*range(-3, 60), *range(32760, 32780), *range(65530, 65545), *range(10**9, 10**9 + 9), -40000]
    return [(i, rnd.sample(NAMES, rnd.randint(0, 4)), rnd.random() < 0.8, rnd.choice([True, False, None])) for i in ids]


@pytest.fixture(scope="module")
def library(spark, rows):
    return spark.createDataFrame(rows, KIND).repartition(3)


@pytest.fixture(scope="module")
def lists(library):
    return postings.postings(library).cache()


@pytest.mark.parametrize("mode", ["must_include_all", "only_from_list", "exact_set"])
@pytest.mark.parametrize(("include", "exclude"), [([], []), (["O"], []), (["O", "Si"], ["Fe"]), (["O", "H", "C", "Ca"], []), (["O"], ["O"]), ([], ["S", "H"]), (["Zr"], []), (["O"], ["Zr"])])
@pytest.mark.parametrize(("missing", "drop"), [(True, False), (False, True), (True, True)])
def test_postings_admit_what_the_policy_admits(rows, lists, mode, include, exclude, missing, drop):
    def fits(elements, stated):
        if not stated:
            return missing
        e, i = set(elements), set(include)
        return not e & set(exclude) and (not i or {"must_include_all": i <= e, "only_from_list": e <= i, "exact_set": e == i}[mode])

    want = sorted(i for i, e, stated, done in rows if fits(e, stated) and not (drop and done))
    assert sorted(r[0] for r in postings.row_ids(postings.fitting(lists, include, exclude, mode, missing, drop)).collect()) == want


def test_the_policy_on_rows_says_the_same(library, lists):
    policy = search.element_policy(F.col("elements"), F.col("has_formula"), ["O", "Si"], ["Fe"], "only_from_list", True)
    want = sorted(r.row_id for r in search.eligible(library, policy, True).collect())
    fits = postings.fitting(lists, ["O", "Si"], ["Fe"], "only_from_list", True, True)
    assert sorted(r.row_id for r in postings.within(library, fits).collect()) == want


def test_odd_rows_no_rows_and_clashing_columns(spark):
    odd = spark.createDataFrame([(None, ["O"], True, False), (5, None, True, None), (6, ["O", None, "O"], True, False), (7, ["O"], None, False), (8, ["C"], True, False), (8, ["O"], True, True)], KIND).selectExpr("*", "1 as bucket", "2 as bits", "3 as kind", "4 as n")
    lists = postings.postings(odd)
    ids = lambda *a, **k: sorted(r[0] for r in postings.row_ids(postings.fitting(lists, *a, **k)).collect())
    assert ids(["O"], [], allow_missing=False) == [6, 8] and ids(["O", "C"], [], "exact_set", allow_missing=False) == [8]
    assert ids([], []) == [5, 6, 7, 8] and ids([], [], allow_missing=False, drop_processed=True) == [5, 6, 8]
    assert {r.element: r.rows for r in postings.counted(lists).collect()} == {"O": 2, "C": 1}
    empty = postings.postings(odd.where("false"))
    assert empty.count() == 0 and postings.row_ids(postings.fitting(empty, ["O"], [])).count() == 0
    with pytest.raises(ValueError):
        postings.fitting(lists, [], [], "some")


def test_lists_take_one_bit_for_each_row(spark):
    df = spark.range(1, 32769).selectExpr("id as row_id", "array('O') as elements", "true as has_formula")
    made = {(r.kind, r.element): (len(r.bits), r.n) for r in postings.postings(df).collect()}
    assert made == {("with", "O"): (4096, 32768), ("without", "O"): (4096, 0), ("formula", ""): (4096, 32768), ("new", ""): (4096, 32768)}
