"""The index for screening: rows as by scanning, cells skipped, bounds that never lose a row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from peaklight.functions import kernels
from peaklight.operators import index, search

KIND = "row_id long, name string, vector array<float>, start_idx int, end_idx int, support_runs array<struct<start:int,end:int>>"
N = 240


def spectra(rng, phases=24, each=50):
    """Peaks of each phase at places of their own, some noise, supports with and without gaps, copies."""
    x, rows = np.arange(N), []
    for p in range(phases):
        places = rng.integers(10, N - 10, 4)
        for j in range(each):
            i = p * each + j
            y = sum(np.exp(-(((x - c) / 2.5) ** 2)) * (0.6 + 0.4 * rng.random()) for c in places) + 0.004 * rng.random(N)
            a, b = int(rng.integers(0, 4)), N - 1 - int(rng.integers(0, 4))
            runs = [(a, 99), (104, b)] if i % 3 == 0 else [(a, b)] if i % 3 == 1 else None
            vector = rows[-1][2] if i % 17 == 1 else [float(v) for v in y]
            rows.append((i, f"phase {p}", vector, a, b, runs))
    return rows


def by_scan(rows, q, mask, k, offset=True):
    """row_ids and scores of the best rows by a plain pass over all of them."""
    found = []
    for i, _, v, a, b, runs in rows:
        s = np.zeros(N, bool)
        for c, d in runs if runs is not None else [(a, b)]:
            s[c : d + 1] = True
        m = s & mask
        if v is None or len(v) != N or m.sum() < 2:
            continue
        y, x = np.array(v, np.float32).astype(float)[m], q[m]
        y, x = y - y.min(), x - (x.min() if offset else 0)
        if (x @ x) * (y @ y) > 0:
            found.append((-round(float(x @ y / np.sqrt((x @ x) * (y @ y))), 9), i))
    return [(i, -s) for s, i in sorted(found)[:k]]


@pytest.fixture(scope="module")
def rows():
    return spectra(np.random.default_rng(5))


@pytest.fixture(scope="module")
def built(spark, rows, tmp_path_factory):
    df = spark.createDataFrame(rows, KIND).repartition(3)
    return index.build(df, f"file://{tmp_path_factory.mktemp('index')}/i", N, ["name"], cell_rows=50)


def answers(dfs):
    out = {}
    for df in dfs:
        for r in df.collect():
            out.setdefault(r.query, []).append((r.rank, r.row_id, r.screen))
    return {q: [(i, s) for _, i, s in sorted(found)] for q, found in out.items()}


@pytest.mark.parametrize(("low", "high", "offset"), [(0, N - 1, True), (30, 200, True), (0, N - 1, False)])
def test_a_table_of_queries_gives_what_scanning_gives(spark, rows, built, low, high, offset):
    asked = [(i, rows[i][2], [low <= p <= high for p in range(N)]) for i in range(7, len(rows), 61)]
    dfs, facts = index.screen_many(index.load(spark, built.folder), spark.createDataFrame(asked, "query long, vector array<float>, mask array<boolean>"), 10, offset)
    got = answers(dfs)
    assert len(got) == len(asked)
    for i, v, mask in asked:
        want = by_scan(rows, np.where(mask, np.array(v, np.float32).astype(float), 0), np.array(mask), 10, offset)
        assert [r for r, _ in got[i]] == [r for r, _ in want]
        assert np.allclose([s for _, s in got[i]], [s for _, s in want], atol=2e-9)
    assert facts["cells"] == built.facts["cells"] > 15 and facts["read"] <= facts["coded"] and facts["skipped"] + facts["coded"] == facts["cells"]


def test_one_query_reads_few_cells_and_equals_the_screen(spark, rows, built):
    mask = [True] * N
    asked = spark.createDataFrame([(1, rows[123][2], mask)], "query long, vector array<float>, mask array<boolean>")
    dfs, facts = index.screen_many(built, asked, 10)
    df = spark.createDataFrame(rows, KIND)
    want = search.shortlist(search.screen(df, rows[123][2], mask, ["row_id"]), 10).collect()
    assert [i for i, _ in answers(dfs)[1]] == [r.row_id for r in want]
    assert facts["skipped"] > 0 and facts["read"] <= 3 < facts["cells"]
    # The cells that were read are all that the plan scans.
    plan = dfs[0]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "cell" in plan


def test_many_copies_make_many_cells(spark, tmp_path):
    df = spark.range(1000).selectExpr("id as row_id", "transform(sequence(1, 8), x -> cast(x % 3 as float)) as vector", "0 as start_idx", "7 as end_idx", "cast(null as array<struct<start:int,end:int>>) as support_runs", "1 as cell_rows")
    made = index.build(df, f"file://{tmp_path}/i", 8, ["cell_rows"], cell_rows=100)
    assert made.facts["cells"] == 10 and made.table("vectors").groupBy("cell").count().agg(F.max("count")).first()[0] < 200
    asked = df.where("row_id = 3").select(F.col("row_id").alias("query"), "vector", F.expr("transform(vector, x -> true)").alias("mask"))
    dfs, _ = index.screen_many(made, asked, 5)
    assert [i for i, _ in answers(dfs)[3]] == [0, 1, 2, 3, 4]


def test_odd_rows_and_no_rows(spark, tmp_path):
    odd = [(1, "a", None, 0, 3, None), (2, "b", [1.0, 2.0], 0, 3, None), (3, "c", [0.0, 1.0, float("nan"), 2.0], 0, 3, None), (4, "d", [1.0] * 4, 0, 3, None), (5, "e", [0.0, 1.0, 0.0, 2.0], 2, 1, []), (6, "f", [0.0, 1.0, 0.0, 2.0], -5, 99, None), (7, None, [0.0, 1.0, 0.0, 2.0], 0, 3, [(0, 1), (3, 3)])]
    df = spark.createDataFrame(odd, KIND)
    made = index.build(df, f"file://{tmp_path}/i", 4, ["name"])
    asked = spark.createDataFrame([(9, [0.0, 1.0, 0.0, 2.0], [True] * 4), (8, [0.0] * 4, [True] * 4), (7, [1.0, 2.0, 3.0, 1.0], [False] * 4)], "query long, vector array<float>, mask array<boolean>")
    got = answers(index.screen_many(made, asked, 5)[0])
    want = {q: [r.row_id for r in search.shortlist(search.screen(df.where("size(vector) = 4"), v, m, ["row_id"]), 5).collect()] for q, v, m in asked.collect()}
    assert {q: [i for i, _ in got.get(q, [])] for q in want} == want
    empty = index.build(df.where("false"), f"file://{tmp_path}/e", 4, ["name"])
    assert index.screen_many(empty, asked, 5)[0] == []
    with pytest.raises(FileNotFoundError):
        index.load(spark, f"file://{tmp_path}/none")


def test_bounds_hold_for_random_rows_and_masks():
    rng = np.random.default_rng(8)
    for trial in range(40):
        n, k = int(rng.integers(2, 90)), 30
        s = rng.random((k, n)) < rng.choice([0.3, 0.9, 1.1])
        v = np.where(s, rng.normal(size=(k, n)) * rng.choice([1e-3, 1, 50]) + rng.choice([0, 5]), 0)
        m = rng.random((6, n)) < rng.choice([0.4, 0.95, 1.1])
        q = np.where(m, v[rng.integers(0, k, 6)] + 0.1 * rng.normal(size=(6, n)), 0)
        asked, offset = index.Queries(np.arange(6), q, m, bool(trial % 3), 5), bool(trial % 3)
        exact = np.stack([kernels.masked_cosines(np.repeat(x[None], k, 0), v, y[None] & s, offset, True) for x, y in zip(asked.q, m)])
        low = np.where(s, v, np.inf).min(1, initial=np.inf)
        low = np.where(np.isfinite(low), low, 0)
        scale = np.where(s, v - low[:, None], 0).max(1) / 255
        code = np.where(s, np.rint((v - low[:, None]) / np.where(scale > 0, scale, 1)[:, None]), 0)
        below, above = index.coded_bounds(asked, index.Rows(np.where(s, low[:, None] + scale[:, None] * code, 0), s), scale)
        assert (exact <= above).all() and (below <= np.where(exact > -1, exact, -1)).all()
        rows, cuts = index.Rows(v, s), index.edges(n)
        y = kernels.units(rows.offset())
        norms = index.sketch(y, cuts)
        inside = np.add.reduceat(s, cuts[:-1], axis=1) == np.diff(cuts)
        floor = np.where(inside, np.minimum.reduceat(y, cuts[:-1], axis=1), np.inf).max(0)
        high = index.cell_bounds(asked, norms.max(0)[None], norms.min(0)[None], np.where(np.isfinite(floor), floor, 1e300)[None], s.all(0)[None], s.any(0)[None])
        assert (exact.max(1) <= high[:, 0]).all()
