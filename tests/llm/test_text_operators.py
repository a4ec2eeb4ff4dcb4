"""Operators that judge each text alone, against plain versions of the same rules."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from peaklight.llm import bpe, langid, packing, pii, quality, tokenfile, winnowing
from peaklight.llm.queries import QUERIES

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_library(spark, sf_dir, texts, odd, tiktoken_encoding):
    rows = QUERIES["op8_byte_bpe"](spark, sf_dir).collect()
    rows_odd = bpe.encode_decode(odd, RANKS, public_tokenizers.PATTERN).collect()
    known = [(r, texts[r.doc_id] or "") for r in rows]
    by = {d: t for d, t, *_ in odd.collect()}
    known += [(r, by[r.doc_id] or "") for r in rows_odd]
    assert len(rows) == len(texts) and len(rows_odd) == odd.count()
    for r, t in known:
        ids = tiktoken_encoding.encode_ordinary(t)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(t)), t[:60]


def test_bpe_random_pieces(tiktoken_encoding):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    coder = bpe.TextCoder(ranks, public_tokenizers.PATTERN)
    rng = random.Random(3)
    for _ in range(600):
        t = "".join(rng.choice("abcdeinrst  \n\t \u0085\x1céüß'19.,!漢") for _ in range(rng.randrange(60)))
        n, ids, back = coder(t)
        assert ids.decode() == ",".join(map(str, tiktoken_encoding.encode_ordinary(t))) and back.decode() == t, repr(t)


def test_token_files_equal_library(spark, sf_dir, texts, odd, empty, tmp_path):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(WORDS)
    lib.encode_special_tokens = True
    rows = QUERIES["op10_token_files"](spark, sf_dir).orderBy("doc_id").collect()
    start = 0
    for r, (d, t) in zip(rows, sorted(texts.items()), strict=True):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    folder, files = tokenfile.write_token_files(odd, WORDS, row=64, folder=f"file://{tmp_path}/t")
    rows = sorted(tokenfile.read_token_files(folder, files).collect(), key=lambda r: r.start)
    own = sorted(((-1 if d is None else d), t or "") for d, t, *_ in odd.collect())
    want = [[*lib.encode(t, add_special_tokens=False).ids, 2] for _, t in own]
    assert [r.n_tokens for r in rows] == [len(w) for w in want] and rows[0].doc_id is None
    assert [r.ids_crc32 for r in rows] == [zlib.crc32(np.array(w, "<u4").tobytes()) for w in want]
    assert tokenfile.read_token_files(*tokenfile.write_token_files(empty, WORDS)).count() == 0


def test_fixed_list_file_round_trip(tmp_path):
    uri = f"file://{tmp_path}/a/x.arrows"
    w = tokenfile.FixedListWriter(uri, row=8, rows=4)
    parts = [np.arange(n, dtype=np.uint16) for n in (3, 100, 0, 7)]
    for p in parts:
        w.append(p)
    w.close()
    flat, r = np.concatenate(parts), tokenfile.FixedListReader(uri)
    assert len(r) == 14 and (r.ids(30, 60) == flat[30:90]).all() and (r.ids(0, 110) == flat).all()
    ids, mask = r[13]
    assert mask.tolist() == [1] * 6 + [0] * 2 and ids[:6].tolist() == flat[104:].tolist()


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(t):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, t):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return [s for *_, s in sorted(out)]


def test_personal_data(spark, sf_dir, texts, odd):
    for r in QUERIES["op4_personal_data"](spark, sf_dir).collect():
        want = base_spans(texts[r.doc_id] or "")
        assert r.base_sha256 == sha(",".join(want))
        assert set(want) <= set(r.spans.split(",")) or not want
        assert r.n_email == sum(w[:5] == "email" for w in want)
    assert pii.find_personal_data(odd).count() == odd.count()
    rng = random.Random(5)
    for _ in range(4000):
        t = "".join(rng.choice("ab1234567890 -.@+()é_00..@@++") for _ in range(rng.randrange(70)))
        assert [f"{k}:{a}:{b}" for k, a, b in pii.find(t) if k != "iban"] == base_spans(t), t


def test_personal_data_by_checksum_and_context():
    t = "Konto DE89 3704 0044 0532 0130 00 und Karte 4111 1111 1111 1111, IBAN DE88370400440532013000."
    assert [k for k, *_ in pii.find(t)] == ["iban", "card"]
    assert pii.score("my phone +49 30 1234567", ("phone", 9, 23)) > pii.score("code is  +49 30 1234567", ("phone", 9, 23))
    assert pii.mask("write to ann@example.org now") == "write to <EMAIL> now"


def test_documents_stay_where_no_language_can_be_learned(spark, odd):
    bare = odd.selectExpr("doc_id", "text", "cast(null as string) as lang", "source", "n_chars")
    model = langid.train(bare)
    kept = langid.drop_unidentified(bare, model)
    want = sorted(t for _, t, *_ in odd.collect() if t and re.search(r"[^\W\d_]", t))
    assert model is None and kept.columns == bare.columns and sorted(r.text for r in kept.collect()) == want
    assert sorted(r.text for r in langid.drop_unidentified(bare, None, 0.5).collect()) == want


def test_overlapping_spans_are_masked_whole():
    assert pii.mask("tel +49 30 1234567 99bob@x.org") == "tel <EMAIL>"
    # The context decides which kind is named where spans overlap.
    assert pii.mask("it is +378282246310005") == "it is <CARD>" and pii.mask("call +378282246310005") == "call <PHONE>"
    for t in ("192.0.2.4 111111111111111 a@b.de", "10.0.0.4 1111 1111 1111 111 +49 30 1234567 99bob@x.org and DE89 3704 0044 0532 0130 00"):
        kept, out = re.split("<[A-Z]+>", pii.mask(t)), set()
        for _, a, b in pii.find(t):
            out |= set(range(a, b))
        assert "".join(kept) == "".join(c for i, c in enumerate(t) if i not in out)


@pytest.mark.parametrize("iban", ["GR16 0110 1250 0000 0001 2300 695", "HR12 1001 0051 8630 0016 0", "TR33 0006 1005 1978 6457 8413 26", "SA03 8000 0000 6080 1016 7519", "MT84 MALT 0110 0001 2345 MTLC AST0 01S"])
def test_ibans_of_every_country(iban):
    assert pii.mask(f"pay {iban}, now") == "pay <IBAN>, now"


def test_masking_keeps_rows_and_columns(spark, odd):
    clash = odd.selectExpr("*", "1 AS score", "'k' AS kind")
    out = pii.mask_personal_data(clash)
    assert out.schema == clash.schema and out.count() == clash.count()
    assert {r.text for r in out.collect() if r.doc_id == 4} == {"one two three four five six seven eight nine ten"}


def slow_winnow(t, k, w):
    h, _ = zip(*[(0, 0)])
    grams = [t[i : i + k] for i in range(len(t) - k + 1)]
    one = {g: int(winnowing.winnow(g)[0][0]) for g in set(grams)}
    h = [one[g] for g in grams]
    chosen = []
    for i in range(max(1, len(h) - w + 1)):
        window = h[i : i + w]
        at = i + max(j for j, x in enumerate(window) if x == min(window))
        if not chosen or chosen[-1] != at:
            chosen.append(at)
    return [h[i] for i in chosen], chosen


def test_winnowing_equals_plain_version(monkeypatch):
    rng = random.Random(1)
    monkeypatch.setattr(winnowing, "BLOCK", 50)
    for n in [16, 17, 31, 32, 49, 50, 51, 200, 333, *range(60, 130, 7)]:
        for alphabet in ("a", "ab", "abcdé漢"):
            t = "".join(rng.choice(alphabet) for _ in range(n))
            h, p = winnowing.winnow(t)
            assert (h.tolist(), p.tolist()) == slow_winnow(t, 16, 16)
            assert [x.tolist() for x in winnowing.decode(winnowing.encode(h, p))] == [h.tolist(), p.tolist()]


def test_neighbours(spark, sf_dir, texts, odd, empty):
    rows = {r.doc_id: r for r in QUERIES["op1_winnowing"](spark, sf_dir).collect()}
    ids = sorted(texts, reverse=True)
    assert len(rows) == len(ids)
    for d, after in zip(ids, ids[1:] + ids[:1], strict=True):
        t, u = texts[d] or "", texts[after] or ""
        n = len(t) // 3
        new = t[: len(t) - n] + u[:n]
        assert (rows[d].n_chars, rows[d].edited_sha256) == (len(t), sha(new))
        assert rows[d].edited_fingerprint == winnowing.encode(*winnowing.winnow(new)) and rows[d].fingerprint == winnowing.encode(*winnowing.winnow(t))
        assert 0 <= rows[d].near_next <= 1
    far = np.mean([r.near_edited > r.near_next for r in rows.values()])
    assert far > 0.9
    out = winnowing.compare_neighbours(odd).collect()
    assert len(out) == odd.count() and len({r.fingerprint for r in out if r.doc_id == 4}) == 1
    one = winnowing.compare_neighbours(odd.where("doc_id = 8")).collect()
    assert len(one) == 1 and one[0].near_next == 1
    assert winnowing.compare_neighbours(empty).count() == 0


def test_language_gradient():
    rng = np.random.default_rng(0)
    net = langid.ByteCNN.start(["a", "b", "c"])
    x, y = rng.integers(0, 256, (5, langid.WINDOW + 3)), np.array([0, 1, 2, 1, 0])
    _, grads = net.step(x, y)
    for p, g in zip(net.weights(), grads, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, losses = p[at], []
        for d in (1e-3, -1e-3):
            p[at] = old + d
            losses.append(net.step(x, y)[0])
        p[at] = old
        assert abs((losses[0] - losses[1]) / 2e-3 - g[at]) < 0.05 * abs(g[at]) + 1e-3


def test_language_tables_equal_convolution(monkeypatch):
    monkeypatch.setattr(langid, "CHUNK", 1024)
    net = langid.ByteCNN.start(["a", "b"])
    raw = bytes(np.random.default_rng(1).integers(0, 256, 3000, dtype=np.uint8))
    raws = [raw, b"x", raw[:256], raw[:253], b""]
    got = net.documents(raws)
    for r, p in zip(raws, got, strict=True):
        n = max(1, -(-len(r) // langid.WINDOW))
        padded = np.frombuffer(r.ljust(n * langid.WINDOW + 3, b"\0"), np.uint8)
        total = 0
        for i in range(n):
            x = net.embed[padded[i * 256 : i * 256 + 259]]
            tops = [(np.concatenate([x[j : j + 256] for j in range(w)], 1) @ f).max(0) for w, f in zip(langid.WIDTHS, net.filters, strict=True)]
            z = np.maximum(np.concatenate(tops) + net.bias, 0) @ net.out + net.out_bias
            total = total + np.exp(z) / np.exp(z).sum() * np.clip(len(r) - i * 256, 1e-6, 256)
        assert np.allclose(p, total / total.sum(), atol=1e-4)


def test_language_accuracy(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs)
    rows = langid.identify(docs, model).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) > 100 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.95
    odd_rows = {r.doc_id: r.lang_pred for r in langid.identify(odd, model).collect()}
    assert [odd_rows[i] for i in (1, 2, 3, 10)] == ["und"] * 4 and odd_rows[8] != "und"
    assert {r.doc_id for r in langid.drop_unidentified(odd, model, 0.0).collect()} == {None, 4, 5, 6, 7, 8, 9, 11, 12, 13}
    scores = {r.doc_id: r for r in langid.identify(odd, model).collect()}
    clash = odd.selectExpr("*", "1 AS score", "'x' AS lang_pred")
    for least in (0.5, 0.9, 1.1):
        kept = langid.drop_unidentified(clash, model, least)
        assert kept.schema == clash.schema and {r.doc_id for r in kept.collect()} == {d for d, r in scores.items() if r.score >= least}
    nameless = langid.drop_unidentified(odd.withColumn("lang", F.lit(None).cast("string")), model, 0.0)
    assert all(r.lang == scores[r.doc_id].lang_pred for r in nameless.collect())
    other = langid.ByteCNN.start(model.labels, seed=1)  # another network keeps other rows
    assert {r.doc_id for r in langid.drop_unidentified(docs, other, 0.9).collect()} != {r.doc_id for r in langid.drop_unidentified(docs, model, 0.9).collect()}
    assert langid.train(empty) is None and langid.identify(odd, None).where("lang_pred <> 'und'").count() == 0


def test_quality_accuracy(spark, odd, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.score(docs, labels).where("held_out").join(labels.select("doc_id", "quality"), "doc_id").collect()
    assert len(rows) > 300 and np.mean([r.predicted == r.quality for r in rows]) > 0.93
    none = labels.where("false")
    assert {r.score for r in quality.score(odd, none).collect()} == {0.5}
    assert quality.score(odd, spark.createDataFrame([(4, 1, 0), (5, 0, 0), (8, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")).count() == odd.count()
    assert quality.score(empty, labels).count() == 0


def number(word):
    return int(quality.words(np.frombuffer(word.encode(), np.uint8), np.array([0, len(word.encode())]))[0][0])


def test_word_vectors_equal_plain_version(spark):
    docs = spark.createDataFrame([(1, "a b, c"), (2, None), (3, "c a")], "doc_id long, text string").repartition(2)
    index = {w: quality.index_vectors(np.array([number(w)], np.uint64))[0].astype(float) for w in "ab,c"}
    total, count = {w: np.zeros(quality.SIZE) for w in index}, {w: 0 for w in index}
    for words in (["a", "b", ",", "c"], ["c", "a"]):
        for i, w in enumerate(words):
            count[w] += 1
            for j in range(max(0, i - 2), min(len(words), i + 3)):
                if i != j:
                    total[w] += index[words[j]]
    for share, kept in ((quality.SHARE, "ab,c"), (0.3, "ac"), (0.4, "")):
        got = quality.word_vectors(docs, share)
        assert sorted(got.vocabulary.tolist()) == sorted(number(w) for w in kept)
        for w in kept:
            assert np.allclose(got.context[got.vocabulary.tolist().index(number(w))], total[w] / max(1e-9, np.linalg.norm(total[w])), atol=1e-6)


def test_index_vectors_belong_to_words():
    """A vector follows from the word alone: among 20,000 words few agree, as of 32 numbers 4 are set at random."""
    w = np.array([number(f"word{i}") for i in range(20_000)], np.uint64)
    assert len(set(w.tolist())) == len(w)
    x = quality.index_vectors(w)
    assert (np.abs(x).sum(1) <= quality.ONES).all() and len(np.unique(x, axis=0)) > 0.95 * len(w)


def test_temperature_minimises_the_loss_of_rows_kept_back():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 6))
    y = (x[:, 0] + rng.normal(size=400) > 0).astype(int)
    back = np.arange(400) % 4 == 0
    net = quality.fit(x, y, back)

    def loss(t):
        z = net.logits(x[back]) / t
        return float(np.mean(np.log1p(np.exp(np.where(y[back] > 0, -z, z)))))

    assert net.temperature > 1 and all(loss(net.temperature) <= loss(t) + 1e-9 for t in (0.5, 1, 0.9 * net.temperature, 1.1 * net.temperature, 8))
    assert np.allclose(net(x), 1 / (1 + np.exp(-net.logits(x) / net.temperature)))


def test_quality_network_learns_by_its_gradient():
    """On separable rows the two layers reach what no constant could."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 4))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)  # no single layer separates these
    net = quality.fit(x, y, np.arange(600) % 5 == 3)
    assert np.mean((net(x) > 0.5) == (y > 0)) > 0.9


def test_language_query_equals_plain_version(spark, sf_dir, texts):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = langid.train(docs)
    rows = QUERIES["op3_language_id"](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        text = texts[r.doc_id] or ""
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if not re.search(r"[^\W\d_]", text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        raw, total = text.encode(), 0
        for i in range(0, len(raw), 256):
            x = net.embed[np.frombuffer(raw[i : i + 259].ljust(259, b"\0"), np.uint8)]
            tops = [(np.concatenate([x[j : j + 256] for j in range(w)], 1) @ f).max(0) for w, f in zip(langid.WIDTHS, net.filters, strict=True)]
            z = np.maximum(np.concatenate(tops) + net.bias, 0) @ net.out + net.out_bias
            total = total + np.exp(z) / np.exp(z).sum() * len(raw[i : i + 256])
        p = total / len(raw)
        assert abs(r.score - p.max()) < 1e-3 and (r.lang_pred == net.labels[p.argmax()] or np.sort(p)[-1] - np.sort(p)[-2] < 1e-3)


def test_quality_query_equals_plain_version(spark, sf_dir, texts):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    vectors = quality.word_vectors(docs)
    net, prior = quality.train(docs, labels, spark.sparkContext.broadcast(vectors))
    place = {h: i for i, h in enumerate(vectors.vocabulary.tolist())}
    rows = QUERIES["op9_quality"](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3)
        raw = (texts[r.doc_id] or "").encode()
        found = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x20\x09-\x0d]+", raw)
        x = np.zeros(2 * quality.SIZE)
        for w in found:
            h = int(quality.words(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[0][0])
            context = vectors.context[place[h]] if h in place else np.zeros(quality.SIZE)
            x += np.concatenate([context, quality.index_vectors(np.array([h], np.uint64))[0] / 2]) / len(found)
        assert abs(r.score - (float(net(x[None])[0]) if net else prior)) < 1e-3


def test_likeness_equals_plain_version(spark, sf_dir, texts):
    ids = sorted(texts, reverse=True)
    sets = {d: set(winnowing.winnow(texts[d] or "")[0].tolist()) for d in ids}
    after = dict(zip(ids, ids[1:] + ids[:1], strict=True))
    for r in QUERIES["op1_winnowing"](spark, sf_dir).collect():
        t, u = texts[r.doc_id] or "", texts[after[r.doc_id]] or ""
        new = set(winnowing.winnow(t[: len(t) - len(t) // 3] + u[: len(t) // 3])[0].tolist())
        for got, other in ((r.near_edited, new), (r.near_next, sets[after[r.doc_id]])):
            own = sets[r.doc_id]
            assert abs(got - (len(own & other) / len(own | other) if own | other else 1.0)) < 1e-12


def test_clashing_columns_and_empty_tables(spark, odd, empty, tmp_path):
    """Columns with the names that operators use inside change nothing; empty tables give no rows."""
    import public_tokenizers

    clash = odd.selectExpr("*", "1 AS `range`", "true AS context", "'x' AS ids", "2 AS t", "3 AS size", "4 AS piece", "5 AS k", "'z' AS score", "6 AS node", "7 AS n")
    ranks, words = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")

    def files(docs):
        return tokenfile.read_token_files(*tokenfile.write_token_files(docs, words))

    for f in (winnowing.compare_neighbours, packing.pack, pii.find_personal_data, files, lambda d: bpe.encode_decode(d, ranks, public_tokenizers.PATTERN), lambda d: langid.identify(d, None)):
        assert sorted(map(str, f(clash).collect())) == sorted(map(str, f(odd).collect()))
        assert f(empty).count() == 0
    assert pii.mask_personal_data(empty).count() == langid.drop_unidentified(empty, None).count() == 0


def test_other_tokenizers_take_no_shortcut():
    """A file whose normalizer or pre-tokenizer isn't the known one is encoded by the library alone."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    code, library = tokenfile.WordEncoder(path), Tokenizer.from_file(path)
    library.encode_special_tokens = True
    assert not code.known and tokenfile.WordEncoder(WORDS).known
    for text in ("Two  Words", " a\tb\nC", "Größe 12 don't", ""):
        assert np.frombuffer(code(text), code.dtype).tolist() == library.encode(text, add_special_tokens=False).ids


def test_second_attempt_of_a_task_leaves_the_first_files_alone(tmp_path):
    ids = np.arange(5, dtype=np.uint16).tobytes()
    batch = tokenfile.pa.RecordBatch.from_pydict({"range": tokenfile.pa.array([0], tokenfile.pa.int32()), "doc_id": [1], "ids": [ids]})
    names = [next(tokenfile._write(f"file://{tmp_path}", 8, "uint16")(iter([batch]))).column("name")[0].as_py() for _ in range(2)]
    assert names[0] != names[1]
    for name in names:
        assert tokenfile.FixedListReader(f"file://{tmp_path}/{name}.arrows").ids(0, 5).tolist() == [0, 1, 2, 3, 4]
