"""Building a pair: one builder at a time, nothing by halves, files as the manifest says."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from peaklight.model import Grid
from peaklight.operators import library, postings
from peaklight.sources import writers
from peaklight.sources.lease import Lease, LeaseLost

KIND = "row_id long, name string, flag string, filename string, already_processed boolean, axis array<double>, intensity array<double>, error string, elements array<string>, has_formula boolean"
GRID = Grid(0, 19, 1)


@pytest.fixture(scope="module")
def sources(spark):
    rows = [(i, f"n{i}", "", f"f{i}", i % 3 == 0, [float(k) for k in range(20)], [float((k * i) % 11) for k in range(20)], "no numeric rows" if i == 5 else None, ["O", "Si"][: i % 3], i != 4) for i in range(1, 9)]
    return spark.createDataFrame(rows, KIND).repartition(2)


def test_facts_come_from_the_writing_job_and_postings_lie_beside(spark, sources, tmp_path):
    told = []

    def on_progress(stage, facts):
        told.append((stage, facts.get("valid")))
        raise RuntimeError("nobody looks")

    made = library.build_pair(spark, sources, GRID, f"file://{tmp_path}/lib", on_progress=on_progress)
    assert told == [("writing", None), ("written", 7), ("published", 7)]
    assert made["failures"] == {"parse": 1} and made["rows"] == 8 and sum(made["files"].values()) > 0
    lists = spark.read.parquet(made["postings"])
    assert sorted(r[0] for r in postings.row_ids(postings.fitting(lists, ["O"], [], allow_missing=False)).collect()) == [1, 2, 5, 7, 8]
    raw, corrected = library.load_pair(spark, made, "rows")
    assert raw.count() == corrected.count() == 8
    assert library.build_pair(spark, sources, GRID, f"file://{tmp_path}/lib", on_progress=lambda s, f: told.append(s)) == made and told[-1] == "reused"
    assert not [x for x in writers.children(spark, f"file://{tmp_path}/lib") if "lease" in x or "staging" in x]


def test_two_builders_make_one_pair(spark, sources, tmp_path):
    made, stages = [], []

    def build():
        made.append(library.build_pair(spark, sources, GRID, f"file://{tmp_path}/lib", on_progress=lambda s, _: stages.append(s)))

    both = [threading.Thread(target=build) for _ in range(2)]
    [t.start() for t in both]
    [t.join() for t in both]
    assert len(made) == 2 and made[0] == made[1] and stages.count("published") == 1 and stages.count("reused") == 1
    assert library.pair_available(spark, made[0])


def test_a_killed_builders_lease_is_taken_over(spark, sources, tmp_path):
    root = f"file://{tmp_path}/lib"
    made = library.build_pair(spark, sources, GRID, root)
    name = made["name"]
    # As a builder leaves it that dies while it writes: a lease without a beat, half a staging folder, no marker.
    (tmp_path / "lib" / f"{name}.json").unlink()
    writers.write_json(spark, f"{root}/{name}.lease", {"owner": "gone", "beats": 3})
    (tmp_path / "lib" / f"{name}.staging-gone").mkdir()
    start = time.monotonic()
    again = library.build_pair(spark, sources, GRID, root, age=1.5)
    assert time.monotonic() - start >= 1.5 and library.pair_available(spark, again) and again["rows"] == 8
    assert any(x.startswith(f"{name}.staging-gone") for x in writers.children(spark, f"{root}/quarantine"))


def test_a_missing_or_changed_file_leads_to_quarantine(spark, sources, tmp_path):
    root = f"file://{tmp_path}/lib"
    made = library.build_pair(spark, sources, GRID, root)
    (tmp_path / "lib" / made["name"] / next(iter(made["files"]))).unlink()
    with pytest.raises(ValueError, match="files"):
        library.load_pair(spark, made)
    assert not library.pair_available(spark, made)
    again = library.build_pair(spark, sources, GRID, root)
    assert library.load_pair(spark, again)[0].count() == 8
    assert len(writers.children(spark, f"{root}/quarantine")) == 3  # the marker, the vectors, the postings
    (tmp_path / "lib" / f"{made['name']}.json").write_text("{")
    assert library.build_pair(spark, sources, GRID, root)["rows"] == 8
    with pytest.raises(ValueError):
        library.load_pair(spark, again, "some")


def test_a_failed_build_leaves_no_pair(spark, sources, tmp_path):
    root = f"file://{tmp_path}/lib"
    for bad, message in ((sources.where("row_id = 5"), "nothing to publish: 0 valid rows, parse in 100%"), (sources.where("row_id in (1, 5)").withColumn("error", F.when(F.col("row_id") < 9, "x")), "nothing to publish"), (sources.where("false"), "nothing to publish: 0 valid rows")):
        with pytest.raises(ValueError, match=message):
            library.build_pair(spark, bad, GRID, root)
        assert writers.children(spark, root) == ["quarantine"]
    with pytest.raises(Exception, match="broken"):
        library.build_pair(spark, sources.withColumn("filename", F.raise_error(F.lit("broken"))), GRID, root)
    assert writers.children(spark, root) == ["quarantine"]


def test_an_owner_that_lost_its_lease_publishes_nothing(spark, sources, tmp_path):
    root = f"file://{tmp_path}/lib"

    def on_progress(stage, facts):
        if stage == "written":
            place = next((tmp_path / "lib").glob("*.lease"))
            writers.write_json(spark, f"file://{place}", {"owner": "other", "beats": 0})

    with pytest.raises(LeaseLost):
        library.build_pair(spark, sources, GRID, root, on_progress=on_progress)
    assert not [x for x in writers.children(spark, root) if not x.endswith(".lease") and x != "quarantine"]


def test_an_owner_that_beats_keeps_its_lease(spark, tmp_path):
    place = f"file://{tmp_path}/a.lease"
    with Lease(spark, place, age=1.0) as held:
        with pytest.raises(TimeoutError):
            Lease(spark, place, age=1.0, wait=2.5).acquire()
        held.check()
        assert held.beats >= 2
    assert writers.children(spark, f"file://{tmp_path}") == []
    with Lease(spark, place, age=1.0, wait=0.5):
        pass
