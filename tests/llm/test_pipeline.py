"""The pipeline against its stages done by brute force."""

import os
import re

import corpus_pipeline
from peaklight.llm import langid, pii
from test_groups import brute_classes, brute_groups


def test_pipeline(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = spark.createDataFrame([(9001, None, "en", "s", 0), (9002, "123 456", "en", "s", 7), (9003, "mail me at joe@site.org please, dear reader of this", "en", "s", 51)], docs.schema)
    docs.unionByName(extra).write.parquet(f"file://{tmp_path}/in/documents.parquet")
    step = spark.read.parquet(f"file://{tmp_path}/in/documents.parquet")
    rows = {r.doc_id: r.text for r in step.collect()}
    model = langid.train(step)
    judged = {r.doc_id: r for r in langid.identify(step, model).collect()}
    want = {d: t for d, t in rows.items() if t and re.search(r"[^\W\d_]", t) and judged[d].score >= langid.CHANCE / len(model.labels)}
    assert len(want) > 0.95 * len(rows)
    groups = brute_groups(want.items())
    want = {d: want[d] for d, _, _, kept, _ in groups if kept}
    classes = brute_classes(list(want.items()), 5, 80, 100)
    want = {d: pii.mask(want[d]) for d, _, c in classes if d == c}
    seen = {}
    for name, f in corpus_pipeline.STAGES:
        columns = step.columns
        path = f"file://{tmp_path}/{name}"
        f(spark, step, f"{tmp_path}/in").write.parquet(path)
        step = spark.read.parquet(path)
        assert name == "packing" or step.columns == columns
        seen[name] = step
    assert {r.doc_id: (r.text, r.n_chars) for r in seen["personal_data"].collect()} == {d: (t, len(t)) for d, t in want.items()}
    assert 9003 in want and "<EMAIL>" in want[9003] and 9001 not in want and 9002 not in want
    out = corpus_pipeline.run(spark, f"{tmp_path}/in").groupBy("doc_id").sum("n_tokens").collect()
    assert {r[0]: r[1] for r in out} == {d: len(t.encode()) + 1 for d, t in want.items()}
    assert langid.SAMPLE and corpus_pipeline.ORACLE_SQL is None


def test_a_run_leaves_its_last_stage_alone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("peaklight.llm._base.shared_root", lambda _: f"file://{tmp_path}/shared")
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    tables = {str(p.parent) for p in (tmp_path / "shared").rglob("*.parquet")}
    assert [t.rsplit("/", 1)[-1] for t in tables] == ["005-packing"] and out.count() > 0


def test_pipeline_without_languages_and_rows(spark, tmp_path):
    """Nothing to learn from: all rows with a letter stay; clashing columns pass; an empty table gives no rows."""
    rows = [(1, "some words of a text", None), (2, "12 34", None), (3, None, None), (4, "other words stand here, many of them indeed", None), (5, "some  words of a text", None)]
    docs = spark.createDataFrame([(*r, "s", len(r[1] or ""), 1, "x", 2.0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, node int, sha string, score double")
    docs.write.parquet(f"file://{tmp_path}/a/documents.parquet")
    out = corpus_pipeline.run(spark, f"file://{tmp_path}/a").collect()
    assert {r.doc_id for r in out} == {4, 5}  # of 1 and 5 the longer one
    docs.where("false").write.parquet(f"file://{tmp_path}/b/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/b").count() == 0
