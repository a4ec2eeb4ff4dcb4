"""Collocations: rare phrases stay out of the tries, and buckets that hold several phrases change no result."""

import numpy as np
import pytest
from test_new_operators import mined, plain_collocations

from peaklight.llm import collocations


def corpus():
    rng = np.random.default_rng(11)
    word = lambda: f"r{rng.integers(0, 1 << 40)}"
    rows = [(" ".join(x for _ in range(20) for x in (word(), word(), "in", "the", "end", "all", "is", word(), "well")), "en" if i % 3 else None) for i in range(60)]
    return rows + [(None, "en"), ("", "fr"), ("the end. " * 40, "de")]


def test_rare_phrases_are_in_no_trie(spark, monkeypatch):
    rows, nodes, old = corpus(), [], collocations.Stage.__call__

    def counted(self, df, name="t"):
        out = old(self, df, name)
        if name == "shards":
            nodes.append(out.agg({"nodes": "sum"}).first()[0])
        return out

    monkeypatch.setattr(collocations.Stage, "__call__", counted)
    df = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    assert mined(df, least=30, shard=500) == plain_collocations(rows, 30, 2000)
    words = sum(len((text or "").split()) for text, _ in rows)
    assert nodes and sum(nodes) < words / 10


@pytest.mark.parametrize(("bits", "width"), [(3, 1 << 23), (6, 4), (10, 7)])
def test_full_buckets_let_too_much_through_and_change_no_result(spark, monkeypatch, bits, width):
    rows = corpus()
    monkeypatch.setattr(collocations, "MOST", bits)
    monkeypatch.setattr(collocations, "WIDTH", width)
    df = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    assert mined(df, least=30, shard=500, ranges=5) == plain_collocations(rows, 30, 2000)


def test_counts_of_buckets_pack_without_loss():
    for numbers in ([], [0], [5, 5, 5], [0, (1 << 32) - 1, 7, 7, 1 << 31]):
        ids, counts = collocations.tally(np.array(numbers, np.uint32))
        got = collocations.unpack_counts(collocations.pack_counts(ids, counts))
        assert [x.tolist() for x in got] == [ids.tolist(), counts.tolist()] and sum(counts) == len(numbers)


def test_bounds_are_even_by_all_nodes():
    """A pair that many longer phrases begin with doesn't count like any other."""
    words, code = collocations.sorted_codes(collocations.pa.array([f"w{i:03}" for i in range(300)], collocations.pa.binary()))
    none, n = np.zeros(1, np.int64), 100
    deep = [(none, none, none), (none, none, none), (np.zeros(n, np.int64), code[:n], np.ones(n, np.int64)), (np.full(200, 50), code[:200], np.ones(200, np.int64))]
    seconds = [int(b[2][1:]) for b in collocations.sample(collocations.Trie(words, deep), 30)]
    assert 50 in seconds and sum(k < 50 for k in seconds) <= 6 and sum(k > 50 for k in seconds) <= 6
