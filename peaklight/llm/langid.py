"""Language identification by a convolutional network over bytes, in numpy.

Bytes are embedded, filters of several widths slide over windows of fixed
length, each filter's maximum in the window is kept, and a softmax layer turns
these into probabilities.  A document's are the mean over all its windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peaklight.llm._base import documents, small

#: Bytes of a window, filter widths, filters of each width, size of a byte's embedding.
WINDOW, WIDTHS, FILTERS, EMBED = 256, (2, 3, 4), 8, 8
#: Labelled documents per language that the network is fitted on (about), and windows of each, spread evenly over the whole text.
SAMPLE, SAMPLE_WINDOWS = 1500, 4
#: A language stands out if its probability is this many times 1 / (number of languages).
CHANCE = 1.2
EPOCHS, BATCH, RATE, SEED = 8, 128, 0.01, 7
#: Bytes of padded windows that are scored at once.
CHUNK = 1 << 18

_LETTER = regex.compile(r"\p{L}")


@dataclass
class ByteCNN:
    """Weights; ``first`` and ``second`` are what they amount to for pairs of bytes at offsets 0 and 2."""

    labels: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]  # (width * EMBED, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    first: np.ndarray = field(default=None, repr=False)
    second: np.ndarray = field(default=None, repr=False)

    @classmethod
    def start(cls, labels: list[str], seed: int = SEED) -> ByteCNN:
        rng = np.random.default_rng(seed)
        n = FILTERS * len(WIDTHS)
        filters = [rng.normal(0, (w * EMBED) ** -0.5, (w * EMBED, FILTERS)).astype(np.float32) for w in WIDTHS]
        return cls(labels, rng.normal(0, 1, (256, EMBED)).astype(np.float32), filters, np.zeros(n, np.float32), rng.normal(0, n**-0.5, (n, len(labels))).astype(np.float32), np.zeros(len(labels), np.float32))

    def weights(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, self.bias, self.out, self.out_bias]

    def step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Loss and gradients for windows of WINDOW + 3 bytes."""
        n = len(x)
        rows, cols = np.arange(n)[:, None], np.arange(FILTERS)[None, :]
        emb, tops, where, grams = self.embed[x], [], [], []
        for w, f in zip(WIDTHS, self.filters, strict=True):
            gram = np.concatenate([emb[:, j : j + WINDOW] for j in range(w)], axis=2)
            conv = gram @ f
            at = conv.argmax(1)
            where.append(at)
            grams.append(gram[rows, at])
            tops.append(conv[rows, at, cols])
        pre = np.concatenate(tops, 1) + self.bias
        hidden = np.maximum(pre, 0)
        p = _softmax(hidden @ self.out + self.out_bias)
        loss = float(-np.log(p[np.arange(n), y] + 1e-12).mean())
        d = p
        d[np.arange(n), y] -= 1
        d /= n
        d_hidden = (d @ self.out.T) * (pre > 0)
        d_embed, d_filters = np.zeros_like(self.embed), []
        for i, (w, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            g = d_hidden[:, i * FILTERS : (i + 1) * FILTERS]
            d_filters.append(np.einsum("nfk,nf->kf", grams[i], g).astype(np.float32))
            back = (g[:, :, None] * f.T[None]).reshape(n, FILTERS, w, EMBED)
            for j in range(w):
                np.add.at(d_embed, x[rows, where[i] + j], back[:, :, j])
        return loss, [d_embed, *d_filters, d_hidden.sum(0), hidden.T @ d, d.sum(0)]

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = SEED) -> ByteCNN:
        rng = np.random.default_rng(seed)
        params = self.weights()
        first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for at in range(0, len(x), BATCH):
                t += 1
                own = order[at : at + BATCH]
                for p, g, a, b in zip(params, self.step(x[own], y[own])[1], first, second, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    p -= (RATE * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self

    def _tables(self) -> None:
        """A convolution over embedded bytes is a sum of rows, one for each offset; rows of neighbours are added in advance."""
        by = [[self.embed @ f[j * EMBED : (j + 1) * EMBED] for j in range(w)] for w, f in zip(WIDTHS, self.filters, strict=True)]

        def pairs(at: int, parts: list[list[np.ndarray]]) -> np.ndarray:
            rows = [(p[at][:, None] + (p[at + 1][None] if len(p) > at + 1 else 0)) + np.zeros((256, 256, 1), np.float32) for p in parts]
            return np.concatenate(rows, 2).reshape(65536, -1).astype(np.float32)

        self.first, self.second = pairs(0, by), pairs(2, by[1:])

    def windows(self, padded: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Probabilities of windows; padded: whole windows of WINDOW bytes, side by side; last: the windows that end a text.

        A filter may look three bytes beyond its window, and sees zeros behind the end of a text.
        """
        if self.first is None:
            self._tables()
        out = np.empty((len(last), len(self.labels)), np.float32)
        whole = np.lib.stride_tricks.sliding_window_view(np.append(padded, np.zeros(3, np.uint8)), WINDOW + 3)[::WINDOW]
        for at in range(0, len(last), CHUNK // WINDOW):
            own = whole[at : at + CHUNK // WINDOW].astype(np.int32)
            own[last[at : at + len(own)], WINDOW:] = 0
            pair = own[:, :-1] * 256 + own[:, 1:]
            conv = self.first[pair[:, :WINDOW]]
            conv[:, :, FILTERS:] += self.second[pair[:, 2 : WINDOW + 2]]
            hidden = np.maximum(conv.max(1) + self.bias, 0)
            out[at : at + len(own)] = _softmax(hidden @ self.out + self.out_bias)
        return out

    def documents(self, raws: list[bytes]) -> np.ndarray:
        """Probabilities of each text: the mean of its windows, each counted by its bytes."""
        n = np.array([len(r) for r in raws], np.int64)
        counts = np.maximum(1, -(-n // WINDOW))
        ends = np.cumsum(counts)
        padded = np.zeros(int(ends[-1]) * WINDOW, np.uint8)
        for raw, at in zip(raws, ((ends - counts) * WINDOW).tolist(), strict=True):
            padded[at : at + len(raw)] = np.frombuffer(raw, np.uint8)
        place = np.arange(len(padded) // WINDOW) - np.repeat(ends - counts, counts)
        weight = np.clip(np.repeat(n, counts) - place * WINDOW, 1e-6, WINDOW)[:, None]
        last = np.zeros(len(place), bool)
        last[ends - 1] = True
        p = np.add.reduceat(self.windows(padded, last) * weight, ends - counts, axis=0)
        return p / p.sum(1, keepdims=True)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _cut(windows: int):
    """Windows of a sampled document, evenly spread over the whole of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"doc_id": [], "at": [], "lang": [], "window": []}
            for doc, lang, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "lang", "text")), strict=True):
                raw = text.encode("utf-8", "replace")
                spots = np.unique(np.linspace(0, max(0, len(raw) - WINDOW - 3), windows).astype(int))
                for at in spots.tolist():
                    out["doc_id"].append(doc)
                    out["at"].append(at)
                    out["lang"].append(lang)
                    out["window"].append(raw[at : at + WINDOW + 3].ljust(WINDOW + 3, b"\0"))
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(out["doc_id"], pa.int64()), "at": pa.array(out["at"], pa.int64()), "lang": pa.array(out["lang"], pa.string()), "window": pa.array(out["window"], pa.binary())})

    return run


def remainder(parts: int):
    """crc32 of doc_id written as text, modulo parts; it tells which rows are held out."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % parts


def train(docs: DataFrame, sample: int = SAMPLE, windows: int = SAMPLE_WINDOWS) -> ByteCNN | None:
    """Fit the network on rows that have text and lang and whose remainder by 4 isn't 2.

    About ``sample`` documents of each language are used, chosen by a hash of
    doc_id alone, and ``windows`` windows of each, so the sample that comes to the driver is bounded by
    sample * windows * (WINDOW + 3) bytes for each language.
    None where there is nothing to learn from.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where("text is not null and lang is not null").where(remainder(4) != 2)
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not sizes:
        return None
    share = F.lit(0.0)
    for lang, n in sorted(sizes.items()):
        share = F.when(F.col("lang") == lang, min(1.0, sample / n)).otherwise(share)
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20))
    rows = sorted(tuple(r) for r in chosen.mapInArrow(_cut(windows), "doc_id long, at long, lang string, window binary").collect())
    labels = sorted({r[2] for r in rows})
    if not labels:
        return None
    x = np.frombuffer(b"".join(bytes(r[3]) for r in rows), np.uint8).reshape(len(rows), WINDOW + 3)
    return ByteCNN.start(labels).fit(x, np.array([labels.index(r[2]) for r in rows]))


def _predict(model: ByteCNN | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            langs, scores, texts = [], [], batch.column("text")
            at = 0
            while at < len(texts):
                own, size = [], 0
                while at < len(texts) and (not own or size < 1 << 21):
                    own.append(texts[at].as_py())
                    size += len(own[-1])
                    at += 1
                lettered = [bool(model) and bool(_LETTER.search(x)) for x in own]
                raws = [x.encode("utf-8", "replace") for x, ok in zip(own, lettered, strict=True) if ok]
                p = iter(model.documents(raws) if raws else ())
                for ok in lettered:
                    best = next(p) if ok else None
                    langs.append(model.labels[int(best.argmax())] if ok else "und")
                    scores.append(float(min(1.0, best.max())) if ok else 0.0)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64())})

    return run


def identify(docs: DataFrame, model: ByteCNN | None) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score.

    ``und`` with score 0 where the text is null or has no letter, or nothing was learned.  Every
    byte of a text is in a window.  Rows are read where they are; nothing is shuffled.  Repeated rows and equal texts have
    equal predictions; a null doc_id is predicted like others; other columns, whatever their names, aren't read; an empty table gives no rows.
    """
    out = documents(docs).mapInArrow(_predict(model), "doc_id long, lang_pred string, score double")
    return out.select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score")


def drop_unidentified(docs: DataFrame, model: ByteCNN | None, least: float | None = None) -> DataFrame:
    """The rows in whose text the network sees one language with a probability of ``least`` or more.

    By default that is CHANCE times what guessing gives: a text goes in which no language stands out.  A null ``lang`` becomes the
    language that was found; all else stays as it is, other columns included.
    A row is judged by its text alone, so repeated rows stay or go together; rows without letters go.  Without a
    model nothing can be scored, and every row with a letter stays, whatever ``least`` is.  An empty table gives an empty one.
    """
    kinds = docs.schema
    if model is not None and least is None:
        least = CHANCE / len(model.labels) if len(model.labels) > 1 else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            text = batch.column(batch.schema.get_field_index("text")).fill_null("")
            if model is None:
                yield batch.filter(pa.array([bool(_LETTER.search(x.as_py())) for x in text], pa.bool_()))
                continue
            judged = next(_predict(model)(iter([pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "text": text})])))
            found, score = judged.column("lang_pred"), judged.column("score").to_numpy()
            at = batch.schema.get_field_index("lang")
            if at >= 0:
                columns = list(batch.columns)
                columns[at] = pc.coalesce(columns[at], found.cast(columns[at].type))
                batch = pa.RecordBatch.from_arrays(columns, names=batch.schema.names)
            yield batch.filter(pc.and_(pc.not_equal(found, "und"), pa.array(score >= least)))

    return docs.mapInArrow(run, kinds)
