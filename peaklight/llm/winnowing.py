"""Document fingerprints by winnowing.

All k-grams of code points are hashed; of each window of w neighbouring hashes
the least is chosen, of equal ones the rightmost, and its position is kept.  So
any passage of w + k - 1 code points that two texts share gives both a common hash.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peaklight.llm._base import documents, id_ranges, key, n_parts, range_of
from peaklight.llm._words import MULT, U, mix

#: Code points in a gram, hashes in a window (both powers of two): shared passages of 31 code points are found.
GRAM, WINDOW = 16, 16
#: Code points hashed at once; longer texts go in blocks that overlap by a window.
BLOCK = 1 << 20


def _choose(codes: np.ndarray, k: int, w: int, base: int) -> np.ndarray:
    """hash << 32 | place (relative to base) of each chosen gram of one block, in order."""
    h, power, width = mix(codes.astype(U) + U(1)), MULT, 1
    while width < k:
        h = h[: len(h) - width] * power + h[width:]
        power, width = power * power, 2 * width
    h = mix(h) & U(0xFFFFFFFF00000000)
    # Of equal hashes the larger place wins, as it gives the smaller number.
    least = h | (U(0xFFFFFFFF) - np.arange(base, base + len(h), dtype=U))
    width = min(w, len(least))
    done = 1
    while done < width:
        step = min(done, width - done)
        least = np.minimum(least[: len(least) - step], least[step:])
        done += step
    return least


def winnow(text: str, k: int = GRAM, w: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Chosen hashes (32 bits) and their positions; a text shorter than k is one gram, an empty one has none."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(codes):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    if len(codes) < k:
        x = int.from_bytes(hashlib.blake2b(codes.tobytes(), digest_size=4).digest(), "little")
        return np.array([x], np.uint32), np.zeros(1, np.int64)
    with np.errstate(over="ignore"):
        hashes, places, grams = [], [], len(codes) - k + 1
        for at in range(0, max(1, grams - w + 1), BLOCK):
            least = _choose(codes[at : at + BLOCK + w + k - 2], k, w, 0)
            place = at + (U(0xFFFFFFFF) - (least & U(0xFFFFFFFF))).astype(np.int64)
            hashes.append((least >> U(32)).astype(np.uint32))
            places.append(place)
    h, p = np.concatenate(hashes), np.concatenate(places)
    first = np.ones(len(p), bool)
    first[1:] = p[1:] != p[:-1]
    return h[first], p[first]


def encode(hashes: np.ndarray, places: np.ndarray) -> str:
    """Base64 of a record for each chosen gram: the hash in 4 bytes and the step from the last place in 1 (0 to w)."""
    out = np.empty(len(hashes), [("h", "<u4"), ("d", "u1")])
    out["h"], out["d"] = hashes, np.diff(places, prepend=0)
    return base64.b64encode(out.tobytes()).decode()


def decode(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(base64.b64decode(fingerprint), [("h", "<u4"), ("d", "u1")])
    return x["h"].copy(), np.cumsum(x["d"].astype(np.int64))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets of hashes; 1 if both are empty."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def edited(text: str, following: str) -> str:
    """The last third of the text replaced by as many code points from the start of the next text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    out, size, held = [], 0, None

    def pack():
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=names)

    for batch in batches:
        for at, context, doc, x in zip(batch.column("range").to_pylist(), batch.column("context").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            if context and held is None:
                continue
            text = x.as_py()
            h, p = winnow(text)
            own = np.unique(h)
            if held is not None:
                _, last_doc, last_text, last_print, last = held
                new = edited(last_text, text)
                eh, ep = winnow(new)
                out.append((last_doc, len(last_text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), last_print, encode(eh, ep), likeness(last, np.unique(eh)), likeness(last, own)))
                size += 2 * len(last_print)
            held = None if context else (at, doc, text, encode(h, p), own)
            if size > 1 << 24:
                yield pack()
                out, size = [], 0
    if out:
        yield pack()


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how like they are.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.  The next document is the one that follows by
    descending doc_id, after the last the first; rows with one doc_id follow each other by their
    texts, and a null doc_id stands at the end.  A null text counts as empty; an empty fingerprint is
    like an empty one only (1) and unlike others (0).  An only row is its own next.  Other columns, whatever their
    names, aren't read.  An empty table gives no rows.

    Texts move once, to even ranges of doc_id; the first rows of each range
    also go, as context, to the end of the range before it.
    """
    parts = n_parts(docs)
    docs = documents(docs)
    _, highs = id_ranges(docs, parts)
    n, bounds = max(1, len(highs)), np.array(highs, np.int64)

    @F.pandas_udf("array<int>")
    def targets(ids: pd.Series) -> pd.Series:
        ids = ids.to_numpy(np.int64)
        at = range_of(ids, bounds)
        first = bounds[at] == ids if len(bounds) else np.zeros(len(ids), bool)
        return pd.Series([[a, (a + 1) % n + n] if f else [a] for a, f in zip(at.tolist(), first.tolist(), strict=True)])

    dealt = docs.select("doc_id", "text", F.explode(targets(key())).alias("t"))
    dealt = dealt.select((F.col("t") % n).alias("range"), (F.col("t") >= n).alias("context"), "doc_id", "text")
    dealt = dealt.repartitionById(n, F.col("range")).sortWithinPartitions("range", "context", F.col("doc_id").desc_nulls_last(), "text")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInArrow(_compare, schema)
