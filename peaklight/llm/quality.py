"""Quality classifier on random-indexing word vectors.

Every word (a run of letters and digits, or of other marks) has a sparse random
index vector, drawn from the whole hash of its bytes.  A word that makes up
a share of SHARE or more of all words of the corpus also has a context vector, the sum of the index vectors
of its neighbours in all documents, scaled to length one; of rarer words, about which
neighbours tell little, the context vector is zero.  A document is the mean of its words' context and index
vectors; a network of two layers scores it, and a temperature fitted on rows
kept back calibrates the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peaklight.llm._base import Stage, blocks, documents
from peaklight.llm._words import BYTE, SPACE, U, mix, segment_hashes, spans
from peaklight.llm.langid import remainder

#: Numbers of a vector, how many of an index vector aren't 0, neighbours on each side.
SIZE, ONES, REACH = 32, 4, 2
#: Least share of all words of the corpus that a word with a context vector has; so there are at most 1 / SHARE of these.
SHARE = 2e-5
#: Labelled documents (about) that the network is fitted on, units of its first layer.
SAMPLE, HIDDEN, EPOCHS, RATE, SEED = 20_000, 32, 60, 0.01, 11
#: A score from here on counts as good.
GOOD = 0.3

_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a block, and the offsets of the rows in these."""
    a, b = spans(_PLAIN[data], offsets)
    c, d = spans(~_PLAIN[data] & ~SPACE[data], offsets)
    starts, ends = np.concatenate([a, c]), np.concatenate([b, d])
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], ends[order]
    return segment_hashes(data, BYTE, starts, ends), np.searchsorted(starts, offsets)


def index_vectors(hashes: np.ndarray) -> np.ndarray:
    """The index vector of each word: ONES places, fixed by its hash, hold 1 or -1 (their sum where places agree)."""
    out, own = np.zeros((len(hashes), SIZE), np.int8), np.arange(len(hashes))
    for k in range(ONES):
        x = mix(hashes + U((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        out[own, (x % U(SIZE)).astype(np.int64)] += np.where(x >> U(63), 1, -1).astype(np.int8)
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, n = np.zeros(0, U), np.zeros(0, np.int64)
    for batch in batches:
        for _, _, data, off in blocks(batch.column("text")):
            new, count = np.unique(words(data, off)[0], return_counts=True)
            every = np.concatenate([seen, new])
            seen, at = np.unique(every, return_inverse=True)
            n = np.bincount(at, np.concatenate([n, count]), len(seen)).astype(np.int64)
            if len(seen) > 1 << 20:
                yield pa.RecordBatch.from_pydict({"word": pa.array(seen.view(np.int64)), "n": pa.array(n)})
                seen, n = np.zeros(0, U), np.zeros(0, np.int64)
    yield pa.RecordBatch.from_pydict({"word": pa.array(seen.view(np.int64)), "n": pa.array(n)})


def _contexts(common):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = common.value
        total = np.zeros((len(vocabulary), SIZE), np.int64)
        for batch in batches:
            for _, _, data, off in blocks(batch.column("text")):
                w, at = words(data, off)
                row, own = np.repeat(np.arange(len(off) - 1), np.diff(at)), index_vectors(w)
                near = np.zeros_like(own)
                for step in range(1, REACH + 1):
                    same = (row[step:] == row[:-step])[:, None]
                    near[step:] += own[:-step] * same
                    near[:-step] += own[step:] * same
                place, known = find(vocabulary, w)
                place, near = place[known], near[known]
                order = np.argsort(place, kind="stable")
                starts = np.flatnonzero(np.diff(place[order], prepend=-1))
                if len(starts):
                    total[place[order][starts]] += np.add.reduceat(near[order], starts, axis=0, dtype=np.int64)
        used = np.flatnonzero(total.any(1))
        columns = [pa.array(used, pa.int32()), *(pa.array(total[used, i].astype(np.int64)) for i in range(SIZE))]
        yield pa.RecordBatch.from_arrays(columns, names=["word", *(f"v{i}" for i in range(SIZE))])

    return run


def find(vocabulary: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of words in a sorted vocabulary, and whether they are in it."""
    if not len(vocabulary):
        return np.zeros(len(w), np.int64), np.zeros(len(w), bool)
    place = np.minimum(np.searchsorted(vocabulary, w), len(vocabulary) - 1)
    return place, vocabulary[place] == w


@dataclass
class WordVectors:
    """Hashes of the common words, ascending, and their context vectors."""

    vocabulary: np.ndarray
    context: np.ndarray

    def pooled(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The mean context and index vector of each row's words, 2 * SIZE numbers; zeros for a row without any."""
        w, at = words(data, offsets)
        out = np.zeros((len(offsets) - 1, 2 * SIZE), np.float32)
        n = np.diff(at)
        full = np.flatnonzero(n)
        if len(full):
            place, known = find(self.vocabulary, w)
            context = np.append(self.context, np.zeros((1, SIZE), np.float32), 0)[np.where(known, place, len(self.vocabulary))]
            own = index_vectors(w).astype(np.float32) / ONES**0.5
            out[full] = np.add.reduceat(np.concatenate([context, own], 1), at[:-1][full], axis=0) / n[full, None]
        return out


def word_vectors(docs: DataFrame, share: float = SHARE) -> WordVectors:
    """Context vectors over all documents.

    One pass counts all words, a second one sums the neighbours of the common
    ones.  Sums are of whole numbers, so the result is the same in any order.
    At most 1 / share rows come to the driver, by arithmetic.
    """
    docs = documents(docs)
    stage = Stage(docs.sparkSession, "words")
    counts = stage(docs.mapInArrow(_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    common = np.sort(np.array([r.word for r in counts.where(F.col("n") >= max(1.0, share * total)).select("word").collect()], np.int64).view(U))
    stage.drop(counts)
    names = [f"v{i}" for i in range(SIZE)]
    sums = docs.mapInArrow(_contexts(docs.sparkSession.sparkContext.broadcast(common)), "word int, " + ", ".join(f"{n} long" for n in names))
    context = np.zeros((len(common), SIZE))
    for r in sums.groupBy("word").agg(*(F.sum(n).alias(n) for n in names)).collect():
        context[r[0]] = r[1:]
    context /= np.maximum(1e-9, np.linalg.norm(context, axis=1, keepdims=True))
    return WordVectors(common, context.astype(np.float32))


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2[0]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, kept_back: np.ndarray, seed: int = SEED) -> Network:
    """Two layers by Adam on the rows not kept back; the temperature by least loss on those kept back."""
    rng = np.random.default_rng(seed)
    size = x.shape[1]
    net = Network(x.mean(0), x.std(0) + 1e-6, rng.normal(0, size**-0.5, (size, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1))
    own, target = ((x - net.mean) / net.scale)[~kept_back], y[~kept_back].astype(float)
    params = [net.w1, net.b1, net.w2, net.b2]
    first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    batch = 256
    for _ in range(max(EPOCHS, min(600, 3000 * batch // max(1, len(own)) + 1))):
        order = rng.permutation(len(own))
        for at in range(0, len(own), batch):
            a, b = own[order[at : at + batch]], target[order[at : at + batch]]
            h = np.tanh(a @ net.w1 + net.b1)
            d = (1 / (1 + np.exp(-np.clip(h @ net.w2 + net.b2[0], -30, 30))) - b) / len(b)
            dh = d[:, None] * net.w2 * (1 - h * h)
            t += 1
            for p, g, m, v in zip(params, (a.T @ dh + 1e-4 * net.w1, dh.sum(0), h.T @ d + 1e-4 * net.w2, np.array([d.sum()])), first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        if t >= 6000:
            break
    if kept_back.any():
        z, b = net.logits(x[kept_back]), y[kept_back]

        def loss(temperature: float) -> float:
            return float(np.logaddexp(0, np.where(b > 0, -z, z) / temperature).mean())

        net.temperature = min(np.geomspace(0.1, 100, 121), key=loss)
    return net


def _pool(vectors, net: Network | None, prior: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = vectors.value
        for batch in batches:
            for i, j, data, off in blocks(batch.column("text")):
                x = table.pooled(data, off)
                out = {c: batch.column(c).slice(i, j - i) for c in batch.schema.names if c != "text"}
                if "quality" in out:
                    out["vector"] = pa.array(list(x), pa.list_(pa.float32()))
                else:
                    out["score"] = pa.array(net(x) if net else np.full(len(x), prior), pa.float64())
                yield pa.RecordBatch.from_pydict(out)

    return run


def train(docs: DataFrame, labels: DataFrame, vectors, sample: int = SAMPLE) -> tuple[Network | None, float]:
    """Network and share of good rows, from labelled rows whose crc32(doc_id) mod 5 isn't 0; vectors: a broadcast of WordVectors.

    About ``sample`` of them are used, chosen by a hash of doc_id; their list is the
    only thing broadcast.  With no labels, or one kind only, there is no network and
    every score is the share of good rows (0.5 without any).  Labels that disagree for one doc_id count as bad.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1) and doc_id is not null").where(remainder(5) != 0)
    n = known.count()
    some = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < (1 << 20) * min(1.0, sample / max(1, n))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = documents(docs).join(F.broadcast(some), "doc_id").select("doc_id", "quality", "text")
    rows = sorted((r.doc_id, r.quality, r.vector) for r in chosen.mapInArrow(_pool(vectors, None, 0), "doc_id long, quality int, vector array<float>").collect())
    y = np.array([r[1] for r in rows])
    if not len(y) or y.min() == y.max():
        return None, float(y.mean()) if len(y) else 0.5
    return fit(np.array([r[2] for r in rows], float), y, np.array([r[0] for r in rows]) % 5 == 3), float(y.mean())


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    A null or empty text is scored as a text without words.  Scores come from the text alone, so
    repeated rows and equal texts have equal scores.  A null doc_id is scored like others and learned from never; other
    columns, whatever their names, aren't read.  An empty table gives no rows.
    """
    vectors = docs.sparkSession.sparkContext.broadcast(word_vectors(docs))
    net, prior = train(docs, labels, vectors)
    out = documents(docs).mapInArrow(_pool(vectors, net, prior), "doc_id long, score double")
    return out.select("doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))
