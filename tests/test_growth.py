"""Work and memory that must not grow faster than the input."""

import os
import tracemalloc

import numpy as np
import pyarrow as pa

from peaklight.llm import jaccard
from peaklight.model import Reduction
from peaklight.operators import index, reduce
from peaklight.plans.queries import QUERIES
from peaklight.sources import headers

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TEXT = "##NAMES=a\n##RRUFFID=R1\n\n  ##names = b; c \n##ORIENTATION=?\n##IDEAL CHEMISTRY='Fe_2_O_3'\n1, 2\n##NAMES=late"


def test_headers_are_taken_apart_once_for_a_row(spark):
    rows = spark.createDataFrame([(1, TEXT), (2, None), (3, ""), (4, "##NAME=x")], "i int, value string")
    out = rows.select("i", headers.key_values(rows.value).alias("k"), headers.text_meta(rows.value).alias("m"))
    got = {r.i: (r.k, tuple(r.m)) for r in out.collect()}
    assert got[1] == ({"NAMES": "b; c", "RRUFFID": "R1", "ORIENTATION": "?", "IDEAL CHEMISTRY": "'Fe_2_O_3'"}, ("b", "Fe2O3"))
    assert got[2] == (None, ("Unknown", "?")) and got[3] == ({}, ("Unknown", "?")) and got[4] == ({"NAME": "x"}, ("x", "?"))
    plan = rows.select(headers.text_meta(rows.value).alias("m"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(value") == 1
    assert QUERIES["provenance_parse"](spark, SF).rdd.getNumPartitions() > 1


def peak_mb(batches):
    """The most memory that numpy takes while the batches are gone through, and how many there are."""
    tracemalloc.start()
    try:
        n = sum(1 for _ in batches)
        return tracemalloc.get_traced_memory()[1] / 1e6, n
    finally:
        tracemalloc.stop()


class Plain:
    """Stands for a DataFrame, and gives the function that would run in its tasks."""

    schema = ()

    def mapInArrow(self, run, kinds):  # noqa: N802
        return run


def test_fingerprints_of_a_batch_are_made_in_slices():
    x = [float(i) for i in range(100, 164)]
    rows = pa.RecordBatch.from_pydict({"axis": pa.array([x] * 4000), "intensity": pa.array([x[::-1]] * 4000), "error": pa.nulls(4000, pa.string())})
    most, n = peak_mb(reduce.fingerprints(Plain(), Reduction())(iter([rows])))
    assert n > 1 and most < 40


class Shared:
    def __init__(self, value):
        self.value = value


def test_bounds_of_cells_take_memory_of_a_tile():
    n, cells, rng = 64, 600, np.random.default_rng(5)
    block = index.Queries(np.arange(500), rng.random((500, n)), np.ones((500, n), bool), True, 50)
    sides = {c: pa.array(list(rng.random((cells, n)))) for c in ("centre", "most", "least", "floor")}
    full = pa.array([[np.packbits(np.ones(n, bool)).tobytes()]] * cells)
    b = pa.RecordBatch.from_pydict({"cell": pa.array(np.arange(cells, dtype=np.int32)), "rows": pa.array([1] * cells), **sides, "always": full, "ever": full})
    most, _ = peak_mb(index._cell_scores(Shared((block, np.full(500, -1.0))))(iter([b])))
    assert most < 60
    assert max((t.stop - t.start) * 2048 for t in index.tiles(10_000, 2048)) <= index.NUMBERS and sum(t.stop - t.start for t in index.tiles(10_000, 2048)) == 10_000


def test_near_copies_are_not_multiplied_by_divisions(spark, monkeypatch):
    """Texts below the wanted likeness that share a passage stay together in every division; of buckets with the same members one is compared."""
    rng = np.random.default_rng(3)
    shared = [f"s{i}" for i in range(150)]
    texts = [(i, " ".join(shared + [f"r{x}" for x in rng.integers(0, 1 << 40, 60)])) for i in range(80)] + [(80 + i, " ".join(shared + [f"c{k}" for k in range(59)] + [f"e{i}"])) for i in range(10)]
    docs, rows, old = spark.createDataFrame(texts, "doc_id long, text string"), {}, jaccard.Stage.__call__

    def counted(self, df, name="t"):
        out = old(self, df, name)
        rows.setdefault(name, out.count())
        return out

    monkeypatch.setattr(jaccard.Stage, "__call__", counted)
    monkeypatch.setattr(jaccard, "LIGHT", 0.5)
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_classes(docs).collect()}
    assert got == {i: min(i, 80) for i in range(90)}
    assert 0 < rows["ready"] <= rows["left"]


def test_only_sets_that_the_sketches_leave_are_moved(spark, monkeypatch):
    """Texts that merely share a passage have keys in common, but their sets stay where they are."""
    rng = np.random.default_rng(4)
    shared = [f"s{i}" for i in range(150)]
    texts = [(i, " ".join(shared + [f"r{x}" for x in rng.integers(0, 1 << 40, 60)])) for i in range(80)] + [(80 + i, " ".join([f"c{k}" for k in range(209)] + [f"e{i}"])) for i in range(10)]
    docs, moved, old = spark.createDataFrame(texts, "doc_id long, text string"), [], jaccard.Stage.__call__

    def counted(self, df, name="t"):
        out = old(self, df, name)
        if name == "tokens":
            moved.append(out.count())
        return out

    monkeypatch.setattr(jaccard.Stage, "__call__", counted)
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_classes(docs).collect()}
    assert got == {i: min(i, 80) for i in range(90)}
    assert moved and sum(moved) <= 20
