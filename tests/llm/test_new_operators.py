"""Collocations, token counts and hard negatives against plain versions, on small tables and odd rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from peaklight.llm import collocations, negatives, queries, tokencount


def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# Collocations


def plain_collocations(rows, least, top, inside=80):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", folded):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for m in range(1, 5):
                f.update((lang, tuple(w[i : i + m])) for i in range(len(w) - m + 1))
    often = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    gone = set()
    for (lang, w), a in often.items():
        for m in range(2, len(w)):
            gone |= {(lang, w[i : i + m]) for i in range(len(w) - m + 1) if 100 * a >= inside * f[lang, w[i : i + m]]}
    out, by = [], {}
    for (lang, w), a in often.items():
        if (lang, w) not in gone:
            score, _, left, right = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            by.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    for lang, found in by.items():
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def mined(df, **how):
    return sorted(tuple(r) for r in collocations.mine(df, **how).collect())


@pytest.mark.parametrize(("shard", "ranges", "least", "top"), [(1 << 22, 1, 3, 2000), (300, 23, 2, 40), (1, 7, 4, 5)])
def test_collocations_equal_a_plain_version(spark, shard, ranges, least, top):
    rnd = random.Random(shard)
    words = ["the", "The", "a", "of", "in", "é", "É", "x\x00y", "漢", "zz"] + [f"w{i}" for i in range(12)]
    rows = []
    for i in range(120):
        text = "".join(rnd.choice(words[: rnd.choice([3, 8, 22])]) + rnd.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", ""]) for _ in range(rnd.randint(0, 60)))
        rows.append((text if i % 17 else None, rnd.choice(["en", "de", None, "", "und"])))
    df = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    assert mined(df, least=least, top=top, shard=shard, ranges=ranges) == plain_collocations(rows, least, top)


def test_a_hot_first_word_is_cut_by_its_second_words(spark):
    rows = [(" ".join(f"the w{(7 * i + j) % 60}" for j in range(40)), "en") for i in range(40)]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    assert mined(df, least=5, shard=100, ranges=30) == plain_collocations(rows, 5, 2000)


def test_collocations_of_odd_rows_and_clashing_columns(spark, odd, empty):
    rows = [(r.text, r.lang) for r in odd.collect()]
    more = odd.selectExpr("*", "1 as n", "2 as depth", "'x' as phrase", "'y' as suffix", "3 as range", "4 as trie", "5 as rank", "6 as f")
    assert mined(more, least=2, shard=50, ranges=9) == plain_collocations(rows, 2, 2000)
    assert mined(empty) == [] and mined(odd.where("text is null"), least=1) == []


def test_equal_scores_go_by_bytes_and_count(spark):
    rows = [("a b. c d. é f. Z y. z y", "en")] * 3 + [("q r", "en")] * 6
    assert mined(spark.createDataFrame(rows, "text string, lang string"), least=2) == plain_collocations(rows, 2, 2000)


def test_tries_merge_and_pack_without_loss():
    rnd = np.random.default_rng(3)
    shards = []
    for n in (0, 1, 50, 400):
        code = rnd.integers(0, 9, n)
        words, code = collocations.sorted_codes(pa.concat_arrays([pa.array([f"w{c}" for c in code], pa.binary()), pa.array([b"en"], pa.binary())]))
        joined = rnd.random(n) < 0.9
        if n:
            joined[-1] = False
        shards.append(collocations.grow(words, np.full(n, code[-1]), code[:n], [np.ones(n, bool), joined], {0, 1, 2}))
    whole = collocations.merge(shards)
    assert int(whole.levels[1][2].sum()) == 451 and len(collocations.Trie.unpack(whole.pack())) == len(whole)
    bounds = sorted(set(collocations.sample(whole, 9)))
    parts = [collocations.Trie.unpack(t.pack()) for _, t in collocations.cut(whole, bounds)]
    # Second words are parted, first ones on a path stand in several ranges with their whole count.
    assert sum(len(t.levels[2][1]) for t in parts) == len(whole.levels[2][1])
    assert sum(int(np.where(collocations.owned(t, bounds, r), t.levels[1][2], 0).sum()) for r, t in collocations.cut(whole, bounds)) == 451


# Token counts


def test_token_counts_equal_the_library(spark, odd, empty, texts, sf_dir):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary())
    wide = odd.selectExpr("*", "1 as n_tokens", "2 as n_bytes", "true as over_limit")
    got = tokencount.count_tokens(wide, vocabulary(), limit=40).collect()
    assert len(got) == odd.count() and tokencount.count_tokens(empty, vocabulary()).count() == 0
    want = Counter((r.doc_id, len((r.text or "").encode()), n, n > 40) for r in odd.collect() for n in [len(whole.encode(r.text or "", add_special_tokens=False).ids)])
    assert Counter(map(tuple, got)) == want
    for r in queries.op12_token_counts(spark, sf_dir).collect():
        n = len(whole.encode(texts[r.doc_id] or "", add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((texts[r.doc_id] or "").encode()), n > 2048)


def test_token_counts_of_random_strings():
    from tokenizers import Tokenizer

    whole, count, rnd = Tokenizer.from_file(vocabulary()), tokencount.TokenCounter(vocabulary()), random.Random(11)
    pool = ["a", "the", "THE", "ing", " ", "\n", "é", "ß", "ẞ", "İ", "ı", "ΑΣ", "ﬁ", "漢", "🙂", "👩‍👧", "1", "½", "'s", "'LL", "don't", "…", "\u0085", "\xa0", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|", "\x00", "́", "q̣̇", "한", "z" * 40]
    for _ in range(4000):
        s = "".join(rnd.choice(pool) for _ in range(rnd.randint(0, 12)))
        assert count(s) == len(whole.encode(s, add_special_tokens=False).ids), s


def test_merging_pops_the_leftmost_lowest_pair():
    merger = tokencount.Merger([["a", "a"], ["aa", "a</w>"], "b c"], "</w>")
    # aaa: the leftmost pair goes first, then the pair that it makes; in aaaa the last pair has no rank then.
    assert [merger.count(x) for x in (b"", b"a", b"aaa", b"aaaa", b"bcb", b"cb")] == [0, 1, 1, 3, 2, 2]


def test_other_tokenizer_files_are_refused(tmp_path):
    import json

    with open(vocabulary(), encoding="utf-8") as source:
        file = json.load(source)
    file["normalizer"] = None
    other = tmp_path / "other.json"
    other.write_text(json.dumps(file))
    with pytest.raises(ValueError):
        tokencount.TokenCounter(str(other))


# Hard negatives


def plain_negatives(rows, every=100, n_positives=5, n_negatives=10):
    kept = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        kept[i] = min(kept.get(i, (label, v)), (label, v))
    whole = {i: (label, [math.floor(256 * x) for x in v]) for i, (label, v) in kept.items()}
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, (label, v) in whole.items():
        if a % every == 0:
            every_row = sorted((-score(v, w), i, other == label) for i, (other, w) in whole.items() if i != a)
            for s, p, _ in [r for r in every_row if r[2]][:n_positives]:
                fit = [(t, i) for t, i, same in every_row if not same and 30 * -s <= 100 * -t <= 90 * -s][:n_negatives]
                out += [(a, p, rank, i, -s, -t) for rank, (t, i) in enumerate(fit, 1)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(seed, n, dims, kinds=3):
    rnd = np.random.default_rng(seed)
    middle = rnd.normal(size=(kinds, dims))
    labels = rnd.integers(0, kinds, n)
    v = (middle[labels] + rnd.normal(size=(n, dims))).astype(np.float32)
    v[: n // 3] = v[0]  # a third of the rows are copies: ties
    return [(i, [float(x) for x in v[i]], int(labels[i])) for i in range(n)]


@pytest.mark.parametrize(("seed", "dims", "block"), [(1, 3, 1 << 14), (2, 24, 2), (3, 1, 1 << 14)])
def test_negatives_equal_all_pairs(spark, seed, dims, block):
    rows = vectors(seed, 600, dims)
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    got = sorted(map(tuple, negatives.mine_negatives(df, every=40, block=block).collect()))
    assert got and got == plain_negatives(rows, every=40)


def test_negatives_of_odd_rows(spark):
    rows = vectors(4, 120, 2) + [(None, [1.0, 2.0], 1), (200, None, 1), (201, [1.0, None], 1), (202, [1.0, float("nan")], 1), (203, [1.0, float("inf")], 1), (204, [1.0, 1.0], None), (300, [0.5], 2), (301, [], 2), (302, [1.0, 1.0, 1.0], 0), (100, [3.0, 1.0], 0), (100, [3.0, 1.0], 0), (50, [1.0, 1.0], 1)]
    df = spark.createDataFrame(rows, VECTORS).repartition(2)
    got = sorted(map(tuple, negatives.mine_negatives(df.selectExpr("*", "1 as rank", "2 as positive_id", "3 as n"), every=50).collect()))
    assert got and got == plain_negatives(rows, every=50)
    assert negatives.mine_negatives(df.where("vec_id = 301"), every=7).count() == 0
    for nothing in (df.where("false"), df.where("vec_id = 200"), df.where("vec_id = 51")):
        assert negatives.mine_negatives(nothing).collect() == []
    with pytest.raises(ArithmeticError):
        negatives.mine_negatives(spark.createDataFrame([(0, [3e30], 1), (1, [1.0], 1)], VECTORS))


def test_large_components_are_multiplied_as_integers(spark):
    rows = [(i, [float(2**14 * (i % 13) + i), float(-(2**13) * (i % 5) + 3)], i % 3) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(map(tuple, negatives.mine_negatives(df).collect())) == plain_negatives(rows)


@pytest.mark.parametrize("lead", [1, 5, 16])
def test_bounds_never_lose_a_pair(lead):
    rnd = np.random.default_rng(lead)
    whole = np.floor(256 * rnd.normal(size=(200, 16)) * np.geomspace(9, 0.01, 16))
    axes = np.linalg.qr(rnd.normal(size=(16, 16)))[0]
    side = negatives.Vectors.of(np.arange(200), np.zeros(200, np.int64), whole, negatives.Rotation(axes, lead, np.float64))
    scores = (whole @ whole.T).astype(np.int64)
    for j in (0, 7):
        for least in np.sort(scores[:, j])[::29]:
            i, at = negatives.survivors(side, side.part(slice(j, j + 1)), True, np.array([least]), np.array([least]))
            assert set(np.flatnonzero(scores[:, j] == least)) <= set(i)


def test_new_queries_equal_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    for query in (queries.op11_collocations, queries.op13_hard_negatives):
        df, want = query(spark, sf_dir), con.sql(queries.ORACLE_SQL[query.__name__])
        assert sorted(map(tuple, df.select(want.columns).collect())) == sorted(want.fetchall())


# Byte-level BPE with other patterns


@pytest.mark.parametrize("pattern", [None, r"\w+ ?|[^\w]+", r"(\s+)|(\S)(\S)?", r"[a-z]+|.", r"\w+| "])
def test_other_patterns_match_whole_texts(pattern):
    import base64

    import public_tokenizers
    import tiktoken

    from peaklight.llm import bpe

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as source:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, source)}
    pattern = pattern or public_tokenizers.PATTERN
    assert bpe.SPACED == public_tokenizers.PATTERN
    theirs, own, rnd = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), bpe.TextCoder(ranks, pattern), random.Random(2)
    for _ in range(300):
        text = "".join(rnd.choice(["a", "the ", " of", " ", "12", ".", ",", "é", "漢", "\n", "  "]) for _ in range(rnd.randint(0, 12)))
        assert own(text)[1].decode() == ",".join(map(str, theirs.encode_ordinary(text))), text
