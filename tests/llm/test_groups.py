"""Operators that compare documents, against brute force."""

import hashlib
import json
import random
import re
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from peaklight.llm import dedup, jaccard, packing, toolcalls
from peaklight.llm.components import connected_components
from peaklight.llm._base import Stage
from peaklight.llm.queries import ORACLE_SQL, QUERIES

BLANK = re.compile(r"[\x20\x09-\x0D]")


def shingles(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute_classes(rows, k, num, den):
    ids = sorted({d for d, _ in rows})
    parent = {d: d for d in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(d, shingles(t, k)) for d, t in rows]
    for (a, x), (b, y) in combinations(sets, 2):
        if x and y and den * len(x & y) >= num * len(x | y):
            lo, hi = sorted((find(a), find(b)))
            parent[hi] = lo
    return {(d, len(s), find(d)) for d, s in sets}


def test_rows_of_one_doc_id_join_their_classes(spark):
    first, second = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(3, first), (5, first + " x"), (5, second), (4, second + " y"), (9, "some other text of more than five words")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_classes(docs).collect()}
    assert got == brute_classes(rows, 5, 80, 100) and {c for d, _, c in got if d == 4} == {3}


def near_copies(seed, groups=12, copies=14, drift=3):
    """Chains and stars of texts near the threshold, short texts, exact copies and shared passages."""
    rng, rows = random.Random(seed), []
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = " ".join(word() for _ in range(30))
    for _ in range(groups):
        w = [word() for _ in range(rng.choice([3, 8, 12, 20, 40, 60, 120, 400]))]
        for _ in range(copies):
            rows.append((len(rows), " ".join(w)))
            if rng.random() < 0.3:
                rows.append((len(rows), " ".join(w).upper().replace(" ", "\n")))
            for _ in range(rng.randrange(drift)):
                i = rng.randrange(len(w))
                w[i : i + rng.choice([0, 1, 1])] = [word()]
    rows += [(len(rows) + i, f"{passage} {word()} {word()}") for i in range(40)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("k, num, den", [(3, 90, 100), (5, 80, 100)])
@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_equals_brute_force(spark, k, num, den, seed):
    rows = near_copies(seed)
    out = jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), k, num, den).collect()
    assert {tuple(r) for r in out} == brute_classes(rows, k, num, den)


def test_jaccard_last_pass_alone(spark, monkeypatch):
    """Pairs that no centre finds are found by the comparison of what is left."""
    monkeypatch.setattr(jaccard, "ROUNDS", 1)
    rows = near_copies(5, drift=4)
    out = jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80, 100).collect()
    assert {tuple(r) for r in out} == brute_classes(rows, 5, 80, 100)


def test_jaccard_query(spark, sf_dir, texts, odd, empty):
    out = QUERIES["op6_jaccard_join"](spark, sf_dir).collect()
    assert {tuple(r) for r in out} == brute_classes(list(texts.items()), 3, 90, 100) and len(out) == len(texts)
    rows = jaccard.jaccard_classes(odd, 5, 80, 100).collect()
    assert len(rows) == odd.count()
    assert {r.component_id for r in rows if r.doc_id in (4, 5)} == {4} and {r.component_id for r in rows if r.doc_id in (1, 2, 3)} == {1, 2, 3}
    assert jaccard.jaccard_classes(empty).count() == 0
    kept = jaccard.keep_one_of_each(odd.selectExpr("*", "1 AS node", "2 AS component_id"))
    assert kept.columns[-2:] == ["node", "component_id"] and 5 not in {r.doc_id for r in kept.collect()}


def test_pigeonhole_never_misses():
    rng = np.random.default_rng(4)
    for turn in range(3000):
        n = int(rng.integers(1, 300 if turn < 2900 else 12_000))
        a = rng.integers(0, 2**64, n, dtype=np.uint64)
        b = np.concatenate([a[int(rng.integers(0, n // 8 + 1)) :], rng.integers(0, 2**64, int(rng.integers(0, n // 8 + 1)), dtype=np.uint64)])
        a, b = np.unique(a), np.unique(b)
        both = len(np.intersect1d(a, b))
        for num in (80, 90):
            if 100 * both >= num * (len(a) + len(b) - both) and len(a) + len(b) > 2 * both:
                for level in (0, 1, 2):
                    x, y = (jaccard.signatures(t, np.array([len(t)]), num, 100, level)[0] for t in (a, b))
                    assert np.intersect1d(x, y).size
                x, y = jaccard.sketch(a, num), jaccard.sketch(b, num)
                while len(x) != len(y):
                    longer = x if len(x) > len(y) else y
                    half = longer[: len(longer) // 2] ^ longer[len(longer) // 2 :]
                    x, y = (half, y) if longer is x else (x, half)
                assert int(np.bitwise_count((x ^ y).view(np.uint64)).sum()) <= len(a) + len(b) - 2 * both


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(100, 160)] + [(1, x) for x in range(2, 40)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(70)] + [(5, 5)]
    parent = {x: x for e in links for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        lo, hi = sorted((find(a), find(b)))
        parent[hi] = lo
    out = {r.node: r.comp for r in connected_components(spark.createDataFrame(links, "a long, b long"), Stage(spark, "test")).collect()}
    assert out == {x: find(x) for e in links if e[0] != e[1] for x in e}


def brute_groups(rows):
    by = defaultdict(list)
    for d, t in rows:
        by[BLANK.sub("", t or "")].append((-len(t or ""), d))
    return {(d, sorted(g)[0][1], len(g), d == sorted(g)[0][1], hashlib.sha256(t.encode()).hexdigest()) for t, g in by.items() for _, d in g}


def test_exact_groups(spark, sf_dir, texts, odd, empty):
    out = QUERIES["op7_exact_dedup"](spark, sf_dir).collect()
    assert {tuple(r) for r in out} == brute_groups(texts.items()) and len(out) == len(texts)
    rows = dedup.exact_groups(odd).collect()
    assert len(rows) == odd.count()
    assert sorted((r.doc_id, r.kept, r.group_size) for r in rows if r.keep_id == 4) == [(4, False, 3), (4, True, 3), (6, False, 3)]
    assert {r.keep_id for r in rows if r.doc_id in (1, 2, 3)} == {3}
    assert dedup.exact_groups(empty).count() == 0


def test_drop_copies(spark, odd, empty):
    clash = odd.selectExpr("*", "'x' AS sha", "1 AS `print`", "2 AS rid")
    out = dedup.drop_copies(clash)
    assert out.columns == clash.columns
    ids = sorted((r.doc_id or -1) for r in out.collect())
    assert ids == [-1, 3, 4, 5, 7, 8, 9, 10, 11, 12, 13]
    assert dedup.drop_copies(empty).count() == 0


def test_counting_quotient_filter():
    rng = np.random.default_rng(3)
    for bits, low in ((64, 0), (60, 5 << 60), (63, 1 << 63)):
        filters, every = [], []
        for n in (0, 1, 5, 300):
            x = (rng.integers(0, 2**20, n).astype(np.uint64) << np.uint64(bits - 20)) + np.uint64(low)
            every.append(x)
            p, c = np.unique(x, return_counts=True)
            f = dedup.CountingQuotientFilter.from_bytes(dedup.CountingQuotientFilter(p, c, low, bits).to_bytes())
            assert [y.tolist() for y in f.items()] == [p.tolist(), c.tolist()]
            filters.append(f)
        merged = dedup.CountingQuotientFilter.merge([*filters, filters[-1]])
        p, c = np.unique(np.concatenate([*every, every[-1]]), return_counts=True)
        assert [y.tolist() for y in merged.items()] == [p.tolist(), c.tolist()]


def brute_bounds(lengths, counts, k):
    lengths = sorted(lengths)
    return min(packing.padding(np.array(lengths), np.array(counts), [*c, lengths[-1]]) for n in range(k) for c in combinations(lengths[:-1], n))


def test_optimal_bounds():
    rng = np.random.default_rng(6)
    for _ in range(60):
        m = int(rng.integers(1, 11))
        lengths = np.sort(rng.choice(np.arange(1, 60), m, replace=False))
        counts = rng.integers(1, 9, m)
        for k in (1, 2, 3, 4):
            bounds = packing.optimal_bounds(lengths, counts, k)
            assert len(bounds) <= k and packing.padding(lengths, counts, bounds) == brute_bounds(lengths, counts, k)
    assert packing.optimal_bounds(np.array([]), np.array([]), 3) == []


def test_packing(spark, sf_dir, texts, odd, empty):
    rows = QUERIES["op5_length_buckets"](spark, sf_dir).collect()
    sizes, batches = defaultdict(int), defaultdict(list)
    for r in rows:
        sizes[r.doc_id] += r.n_tokens
        assert r.start == r.piece * packing.LONGEST and r.n_tokens <= r.bucket_len
        batches[r.batch_id].append(r)
    assert sizes == {d: len((t or "").encode()) + 1 for d, t in texts.items()}
    lengths, counts = np.unique([r.n_tokens for r in rows], return_counts=True)
    assert sorted({r.bucket_len for r in rows}) == packing.optimal_bounds(lengths, counts)
    ends = defaultdict(list)
    for name, own in batches.items():
        bound = own[0].bucket_len
        room = max(1, packing.BUDGET // bound)
        assert sorted(r.slot for r in own) == list(range(len(own))) and len(own) <= room
        ends[bound].append((int(name.split("-")[1]), len(own) == room, min((r.doc_id, r.piece) for r in own), max((r.doc_id, r.piece) for r in own)))
    for own in ends.values():
        own.sort()
        assert [e[0] for e in own] == list(range(len(own))) and all(e[1] for e in own[:-1])
        assert all(a[3] < b[2] for a, b in zip(own, own[1:], strict=False))
    got = packing.pack(odd, longest=1000).collect()
    assert sum(r.n_tokens for r in got) == sum(len((t or "").encode()) + 1 for _, t, *_ in odd.collect())
    assert packing.pack(empty).count() == 0


def test_tool_calls(spark):
    tools = {"add": {"type": "object", "properties": {"a": {"type": ["number", "string"]}, "b": {"type": "number"}}, "required": ["a"], "additionalProperties": False}}
    calls = spark.createDataFrame(
        [
            (1, 0, "x", "add", '{"b": 2, "a": 1.5}'),
            (1, 2, "y", "add", '{"a": "$ref:x"}'),
            (1, 4, "x", "add", '{"a": 1}'),
            (1, 6, None, "add", '{"a": 1}'),
            (2, 0, "p", "add", '{"a": "$ref:q"}'),
            (2, 1, "q", "add", '{"a": "$ref:r"}'),
            (2, 2, "r", "add", '{"c": "é", "b": true}'),
            (3, 0, "m", "add", '{"a": "$ref:n"}'),
            (3, 1, "n", "add", '{"a": "$ref:m"}'),
            (4, 0, "s", "sub", "{broken"),
            (None, 0, "s", "sub", None),
            (4, 1, "t", "add", '{"a": "$ref:zz"}'),
        ],
        "conv_id long, turn long, call_id string, name string, arguments string",
    )
    results = spark.createDataFrame([(1, 1, "x", "3.5"), (1, 3, "x", "again"), (2, 9, "q", None), (9, 1, "x", "?"), (None, 1, "s", "-"), (4, 1, None, "-")], "conv_id long, turn long, call_id string, content string")
    rows = toolcalls.link_tool_calls(calls, results, tools).collect()
    assert len(rows) == 12
    by = {(r.conv_id, r.turn): r for r in rows}
    assert by[1, 0].canonical == '{"arguments":{"a":1.5,"b":2},"id":"x","name":"add"}' and (by[1, 0].content, by[1, 0].result_turn, by[1, 0].n_results) == ("3.5", 1, 2)
    assert by[1, 4].errors == ["$: identifier used before"] and by[1, 4].content is None and by[1, 6].errors == ["$: no identifier"]
    assert (by[1, 0].level, by[1, 2].level, by[4, 1].level) == (0, 1, 0)
    assert [by[2, i].level for i in range(3)] == [2, 1, 0] and by[2, 2].errors == ["$.a: missing", "$.b: not of type number", "$.c: not allowed"]
    assert [by[3, i].level for i in range(2)] == [-1, -1] and by[2, 1].n_results == 1
    assert by[4, 0].errors == ["$: not JSON"] and by[4, 1].errors == ["$: refers to no call zz"] and by[None, 0].content is None
    assert toolcalls.link_tool_calls(calls.where("false"), results.where("false"), tools).count() == 0


def brute_levels(edges):
    """The longest chain behind each call by depth-first search; -1 on or behind a cycle."""
    known, needs = {}, defaultdict(set)
    for u, r in edges:
        needs[u].add(r)

    def level(x, path):
        if x in path:
            return -1
        if x not in known:
            below = [level(r, path | {x}) for r in needs[x]]
            out = -1 if -1 in below else 1 + max(below, default=-1)
            if out < 0:
                return -1
            known[x] = out
        return known[x]

    return {x: level(x, frozenset()) for e in edges for x in e}


@pytest.mark.parametrize("most", [100_000, 5, 0])
def test_levels_of_chains_cycles_and_graphs(spark, most):
    rng, calls, want = random.Random(8), [], {}
    for conv in range(7):
        n = 60 if conv < 2 else 12
        needs = defaultdict(set)
        for i in range(n):
            if conv == 0 and i:
                needs[i] = {i - 1}  # one long chain
            elif conv == 1 and i > 1:
                needs[i] = {i - 1, i - 2}  # no chain to jump along
            elif conv > 1:
                needs[i] = {rng.randrange(n) if rng.random() < 0.15 else rng.randrange(i) for _ in range(rng.randrange(3)) if i}
        calls += [(conv, i, f"c{i}", "t", "{" + f'"x": {[f"$ref:c{r}" for r in needs[i]]}'.replace("'", '"') + "}") for i in range(n)]
        levels = brute_levels([(i, r) for i in range(n) for r in needs[i]])
        want |= {(conv, i): levels.get(i, 0) for i in range(n)}
    table = spark.createDataFrame(calls, "conv_id long, turn long, call_id string, name string, arguments string").withColumn("own", F.lit(1)).withColumn("n", F.lit(2)).repartition(4)
    results = spark.createDataFrame([], "conv_id long, turn long, call_id string, content string, level long")
    rows = toolcalls.link_tool_calls(table, results, {"t": {}}, most).collect()
    assert {(r.conv_id, r.turn): r.level for r in rows} == want and len(rows) == len(want)
    assert {-1, 59} <= set(want.values()) and all(not r.errors for r in rows)


def test_queries_equal_their_sql(spark, sf_dir):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    for name in ORACLE_SQL:
        out = QUERIES[name](spark, sf_dir)
        want = db.execute(ORACLE_SQL[name]).fetchdf()[out.columns].to_dict('records')
        got = [r.asDict() for r in out.collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, want)), name
    rows = QUERIES["op2_tool_call_linking"](spark, "/root/testdata/sf0.01").collect()
    assert {-1, 0, 1} <= {r.level for r in rows} and any("above maximum" in r.errors for r in rows) and any("not JSON" in r.errors for r in rows)


def test_tool_calls_with_long_and_odd_arguments(spark):
    """Very long texts are read whole; repeated rows, null names and clashing columns have defined results."""
    long_text = "x" * 300_000 + '"$ref:b"'
    calls = spark.createDataFrame([(1, 0, "a", "t", json.dumps({"x": [long_text, "$ref:b"]})), (1, 1, "b", "t", "{}"), (1, 1, "b", "t", "{}"), (1, 2, "d", None, "[]"), (1, None, "e", "t", "{}")], "conv_id long, turn long, call_id string, name string, arguments string")
    results = spark.createDataFrame([(1, 5, "b", "y" * 300_000)], "conv_id long, turn long, call_id string, content string")
    rows = toolcalls.link_tool_calls(calls, results, {"t": {"type": "object"}}).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.call_id].append(r)
    assert by["a"][0].level == 1 and len(by["a"][0].canonical) > 300_000
    assert sorted((r.errors, r.n_results) for r in by["b"]) == [([], 1), (["$: identifier used before"], 0)]
    assert by["d"][0].errors == ["$: unknown tool"] and by["e"][0].errors == []


def unrelated(n, seed):
    """Short sets of shingles that have nothing to do with each other."""
    rng = np.random.default_rng(seed)
    return [np.unique(rng.integers(0, 2**64, int(rng.integers(9, 16)), dtype=np.uint64)) for _ in range(n)]


def bucket_pairs(sets, num, den):
    sizes = np.array([len(s) for s in sets])
    keys, _ = jaccard.signatures(np.concatenate(sets), sizes, num, den)
    counts = np.unique(keys, return_counts=True)[1].astype(float)
    return float((counts * (counts - 1) / 2).sum())


def test_pairs_of_unrelated_short_sets_stay_few():
    """Few shingles of a segment seldom propose a link: pairs of unrelated sets grow little more than with their number."""
    few, many = (bucket_pairs(unrelated(n, n), 80, 100) for n in (5_000, 20_000))
    assert few < 50 and many < 8 * max(few, 25)


def test_large_sets_lose_no_link():
    """Sets of 500 to 20,000 shingles at the threshold: every link is proposed, at every level."""
    rng = np.random.default_rng(12)
    for num in (80, 90):
        for n in (500, 1700, 5_000, 20_000):
            for _ in range(4):
                whole = np.unique(rng.integers(0, 2**64, 2 * n, dtype=np.uint64))
                rng.shuffle(whole)
                apart = 0  # the most members that a linked pair of this size may lose and gain
                while 100 * (n - apart - 1) >= num * (n + apart + 1):
                    apart += 1
                a, b = np.sort(whole[:n]), np.sort(np.concatenate([whole[apart:n], whole[n : n + apart]]))
                for level in (0, 1):
                    x, y = (jaccard.signatures(t, np.array([len(t)]), num, 100, level)[0] for t in (a, b))
                    assert np.intersect1d(x, y).size


def test_heavy_buckets_are_split_without_loss(spark, monkeypatch):
    """With buckets that count as heavy from two nodes on, further divisions find what comparing all finds."""
    monkeypatch.setattr(jaccard, "LIGHT", 0.1)
    monkeypatch.setattr(jaccard, "ROUNDS", 1)
    rows = near_copies(9, groups=8, copies=8, drift=4)
    out = jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80, 100).collect()
    assert {tuple(r) for r in out} == brute_classes(rows, 5, 80, 100)
