"""Byte-level BPE, with a segment tree that finds the next merge of a piece."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from peaklight.llm._base import BLOCK_BYTES, documents

#: Entries of a worker's caches of encoded pieces; when full they start anew.
CACHE = 300_000
#: Longer pieces aren't remembered.
LONGEST = 40


class SegmentTreeBPE:
    """Encodes pieces by merging the leftmost pair of least rank, again and again.

    A leaf of the tree stands for the pair that begins at that byte; it holds
    rank * size + position, or a number above all where no pair begins.  The
    root is the leftmost pair of least rank.  A merge changes the leaves of the
    merged pair, of its live left neighbour and of the right part, which dies:
    three updates of log(n) steps, so n bytes take n log n steps in all.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {v: k for k, v in ranks.items()}

    def encode_piece(self, piece: bytes) -> list[int]:
        ranks = self.ranks
        got = ranks.get(piece)
        if got is not None:
            return [got]
        n = len(piece)
        if n < 2:
            return [ranks[piece[i : i + 1]] for i in range(n)]
        size = 1 << (n - 2).bit_length() if n > 2 else 1
        never = 1 << 62
        tree = [never] * (2 * size)
        for i in range(n - 1):
            r = ranks.get(piece[i : i + 2])
            if r is not None:
                tree[size + i] = r * size + i
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        ends = list(range(1, n + 1))  # of the part that begins at i
        back = list(range(-1, n))  # the part before the one that begins at i
        while True:
            top = tree[1]
            if top == never:
                break
            i = top & (size - 1)
            j = ends[i]
            end = ends[j]
            ends[i] = end
            if end < n:
                back[end] = i
                r = ranks.get(piece[i : ends[end]])
                value = never if r is None else r * size + i
            else:
                value = never
            changed = [(i, value)]
            if j < n - 1:
                changed.append((j, never))
            left = back[i]
            if left >= 0:
                r = ranks.get(piece[left:end])
                changed.append((left, never if r is None else r * size + left))
            for at, value in changed:
                at += size
                tree[at] = value
                at >>= 1
                while at:
                    a, b = tree[2 * at], tree[2 * at + 1]
                    low = a if a < b else b
                    if tree[at] == low:
                        break
                    tree[at] = low
                    at >>= 1
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : ends[i]]])
            i = ends[i]
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class SegmentTreeBatch:
    """The same trees for many short pieces side by side: row r of each array belongs to piece r.

    Every round merges the root's pair of all pieces that still have one.
    """

    NEVER = np.int64(1 << 62)

    def __init__(self, ranks: dict[bytes, int]):
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        pairs = [((ranks[t[:i]] << 32) + ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        keys, values = np.array([k for k, _ in pairs], np.int64), np.array([r for _, r in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the union of two tokens, which is its id; -1 if there is none."""
        key = (left << 32) + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], -1)

    def encode(self, pieces: list[bytes], size: int) -> list[list[int]]:
        """Pieces of 2 to size + 1 bytes; size, the number of leaves, is a power of two."""
        width, shift, never = size + 1, size.bit_length() - 1, self.NEVER
        n = np.array([len(p) for p in pieces])
        tok = self.byte[np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), np.uint8).reshape(len(pieces), width)]
        nxt = np.tile(np.arange(1, width + 1), (len(pieces), 1))
        prv = np.tile(np.arange(-1, width), (len(pieces), 1))
        alive = np.arange(width)[None] < n[:, None]
        first = self.rank(tok[:, :-1], tok[:, 1:])
        tree = np.full((len(pieces), 2 * size), never)
        tree[:, size:] = np.where((first >= 0) & alive[:, 1:], first * size + np.arange(size), never)
        level = size // 2
        while level:
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
            level //= 2
        rows = np.arange(len(pieces))
        while True:
            top = tree[rows, 1]
            rows, top = rows[top < never], top[top < never]
            if not len(rows):
                break
            i, new = top & (size - 1), top >> shift
            j = nxt[rows, i]
            end = nxt[rows, j]
            tok[rows, i], nxt[rows, i], prv[rows, end], alive[rows, j] = new, end, i, False
            left = prv[rows, i]
            after = self.rank(new, tok[rows, np.minimum(end, width - 1)])
            before = self.rank(tok[rows, np.maximum(left, 0)], new)
            tree[rows, size + i] = np.where((end < n[rows]) & (after >= 0), after * size + i, never)
            pair = j < size
            tree[rows[pair], size + j[pair]] = never
            known = left >= 0
            tree[rows[known], size + left[known]] = np.where(before >= 0, before * size + left, never)[known]
            for at in (size + i, size + np.minimum(j, size - 1), size + np.maximum(left, 0)):
                for _ in range(shift):
                    at = at >> 1
                    tree[rows, at] = np.minimum(tree[rows, 2 * at], tree[rows, 2 * at + 1])
        ids, ends = tok[alive].tolist(), np.cumsum(alive.sum(1)).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]


#: Fixed value: the pattern by which a single space begins a match.
SPACED = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class TextCoder:
    """Encodes and decodes whole texts, and remembers frequent pieces.

    With the pattern SPACED a single space between two characters that aren't white space begins a
    match, so a text may be cut before it; the parts are then
    matched alone.  Other texts, and all texts with another pattern, are matched as a whole.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.bpe = SegmentTreeBPE(ranks)
        self.batch = SegmentTreeBatch(ranks)
        self.pattern, self.cuts = regex.compile(pattern), pattern == SPACED
        self.odd = regex.compile(r"\s(?=[ ])| (?=\s)")
        #: (ids in decimal, each after a comma; the bytes decoded from them) by piece, and by part of a text
        self.pieces: dict[str, tuple[bytes, bytes]] = {}
        #: Parts after a space (without it), and parts that begin a text or are matched as a whole.
        self.spaced: dict[str, tuple[bytes, bytes]] = {}
        self.decimal = [b",%d" % i for i in range(max(ranks.values()) + 1)]

    def matches(self, text: str) -> list[str]:
        return self.pattern.findall(text) if self.cuts else [m[0] for m in self.pattern.finditer(text) if m[0]]

    def _learn(self, texts: set[str]) -> None:
        """Encode pieces that aren't known yet: short ones together, the others one by one."""
        groups: dict[int, list[tuple[str, bytes]]] = {}
        ranks = self.bpe.ranks
        for x in texts:
            raw = x.encode()
            n = len(raw)
            groups.setdefault(0 if n < 2 or raw in ranks or n > 65 else max(8, 1 << (n - 2).bit_length()), []).append((x, raw))
        for size, own in groups.items():
            for at in range(0, len(own), 4096):
                part = own[at : at + 4096]
                found = [self.bpe.encode_piece(raw) for _, raw in part] if not size else self.batch.encode([raw for _, raw in part], size)
                for (x, _), ids in zip(part, found, strict=True):
                    self.pieces[x] = b"".join([self.decimal[i] for i in ids]), self.bpe.decode(ids)

    def many(self, texts: list[str]) -> list[tuple[int, bytes, bytes]]:
        """For each text the number of ids, these in decimal joined by commas, and the bytes decoded from them."""
        if len(self.spaced) > CACHE:
            self.spaced.clear()
        spaced, findall, plans, alone, new = self.spaced, self.matches, [], {}, {}
        for text in texts:
            if not self.cuts or self.odd.search(text):
                first, rest, found = text, [], []
            else:
                first, *rest = text.split(" ")
                found = list(map(spaced.get, rest))
                if None in found:
                    for x, known in zip(rest, found, strict=True):
                        if known is None and x not in new:
                            new[x] = findall(f" {x}")
            if first not in alone:
                alone[first] = findall(first)
            plans.append((first, rest, found))
        pieces = self.pieces
        wanted = {p for own in (*new.values(), *alone.values()) for p in own}
        if len(pieces) + len(wanted) > CACHE:
            pieces.clear()
        self._learn(wanted.difference(pieces))

        def whole(own: list[str]) -> tuple[bytes, bytes]:
            if len(own) == 1:
                return pieces[own[0]]
            ids, back = zip(*map(pieces.__getitem__, own), strict=True) if own else ((), ())
            return b"".join(ids), b"".join(back)

        fresh = {x: whole(own) for x, own in new.items()}
        spaced.update((x, v) for x, v in fresh.items() if len(x) <= LONGEST)
        out = []
        for first, rest, found in plans:
            if None in found:
                found = [v or fresh[x] for x, v in zip(rest, found, strict=True)]
            ids, back = zip(whole(alone[first]), *found, strict=True)
            joined = b"".join(ids)
            out.append((joined.count(b","), joined[1:], b"".join(back)))
        return out

    def __call__(self, text: str) -> tuple[int, bytes, bytes]:
        return self.many([text])[0]


@lru_cache(2)
def coder(path: str, pattern: str) -> TextCoder:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return TextCoder(ranks, pattern)


def _code(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path, pattern)
        for batch in batches:
            n, ids, back, texts, size = [], [], [], [], 0
            for k, x in enumerate(batch.column("text")):
                texts.append(x.as_py())
                size += len(texts[-1])
                if size < BLOCK_BYTES and k + 1 < len(batch):
                    continue
                for count, joined, decoded in code.many(texts):
                    n.append(count)
                    ids.append(hashlib.sha256(joined).hexdigest())
                    back.append(hashlib.sha256(decoded).hexdigest())
                texts, size = [], 0
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids), "decoded_sha256": pa.array(back)})

    return run


def encode_decode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256.

    A null text counts as empty and has no ids.  Each row is coded where it is
    read; nothing is shuffled, so ties, repeated rows and hot sources don't matter.  A null doc_id stays null; other
    columns, whatever their names, aren't read; an empty table gives no rows.
    """
    return documents(docs).mapInArrow(_code(ranks, pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
