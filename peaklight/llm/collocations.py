"""Collocations: phrases whose parts occur together more often than apart, mined with count tries.

A task counts the words and phrases of a few million words in a trie of limited depth: language, first word,
second word and so on.  A trie is stored level by level, each node as its parent's number in the level above, its
word and its count, in the order of the words' bytes; so every range of prefixes (language, word, word) is a
slice of each level.  Slices go to one task per range, which merges the sorted levels of all shards; the path to the first node of
a range goes with it, so a node's ancestors are always there and the walk to the root gives the counts of its
left parts.  The node of a phrase without its first word, its suffix link, stands in another range; links are joins of nodes, one for
each depth, and following them gives the counts of the right parts.

The corpus is read three times.  Words and pairs, then phrases of three and four words whose pairs are frequent, are counted by the buckets that
their hashes fall in; a phrase in a bucket with too few can't be frequent.  Tries are made in the third reading, of the others alone.  Which
these are is told by filters of bounded size that err on the side of counting, so what a trie counts is exact.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peaklight.llm._base import Stage, blocks, id_filter, join_counted, maybe, n_parts, small
from peaklight.llm._words import BYTE, FOLDED, U, mix, segment_hashes, spans

#: Words that are counted in one trie at first, nodes of the tries that a task gathers before they are cut, nodes that a range of the merge should hold.
#: The number of parts grows with the product of tries and ranges, so larger executors should have larger ones.
SHARD, GATHER, RANGE = 1 << 18, 1 << 20, 1 << 18
#: Bytes of text that are cut into words at once.
SLICE = 1 << 20
#: Phrases that a task sorts into buckets at once, buckets that a range of them has at most, bits of a bucket's number at most.
CHUNK, WIDTH, MOST = 1 << 22, 1 << 23, 32
#: A bucket that has so many is full for any greater least count too, which errs on the side of counting.
FULL = 1 << 30
#: Prefixes that each shard names as possible bounds of ranges.
SAMPLE = 64
#: Words of a phrase at most.
DEPTH = 4

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: 0 in a word, 1 between words, 2 between pieces.
KIND = np.zeros(256, np.uint8)
KIND[[32, 9]] = 1
KIND[[*b".,;:!?", *range(10, 14)]] = 2
#: A place in the order of prefixes: language, first word, second word.
Bound = tuple[bytes, bytes, bytes]


@dataclass
class Trie:
    """Sorted words, and for each level (0: languages) the parents, words and counts of its nodes in order."""

    words: pa.BinaryArray
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    def __len__(self) -> int:
        return sum(len(w) for _, w, _ in self.levels)

    def pack(self) -> bytes:
        """The trie as compressed bytes."""
        off = np.frombuffer(self.words.buffers()[1], np.int32)[self.words.offset : self.words.offset + len(self.words) + 1] if len(self.words) else np.zeros(1, np.int32)
        text = np.frombuffer(self.words.buffers()[2], np.uint8)[off[0] : off[-1]] if off[-1] > off[0] else np.zeros(0, np.uint8)
        head = [len(self.levels), *(len(w) for _, w, _ in self.levels), len(self.words), len(text)]
        parts = [np.array(head, np.int64), np.diff(off).astype(np.int32)]
        for parent, word, count in self.levels:
            parts += [np.diff(parent, prepend=0).astype(np.int32), word.astype(np.int32), count.astype(np.int64)]
        raw = b"".join(p.tobytes() for p in (*parts, text))
        return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)

    @classmethod
    def unpack(cls, blob: bytes) -> Trie:
        raw = pa.Codec("zstd").decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True)
        at = 0

        def take(n: int, kind) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, n, at)
            at += out.nbytes
            return out

        n_levels = int(take(1, np.int64)[0])
        sizes = take(n_levels + 2, np.int64).tolist()
        lengths = take(sizes[-2], np.int32)
        levels = [(np.cumsum(take(n, np.int32), dtype=np.int32), take(n, np.int32), take(n, np.int64)) for n in sizes[:n_levels]]
        return cls(binary(lengths, take(sizes[-1], np.uint8)), levels)


def binary(lengths: np.ndarray, data: np.ndarray) -> pa.BinaryArray:
    off = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=off[1:])
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data))])


def sorted_codes(words: pa.BinaryArray) -> tuple[pa.BinaryArray, np.ndarray]:
    """The distinct words by their bytes, and the place of each word among them."""
    coded = words.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)), place[coded.indices.to_numpy()]


def parted(key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Parents and words of keys parent * n + word."""
    parent = key // max(1, n)
    return parent.astype(np.int32), (key - parent * n).astype(np.int32)


def grow(words: pa.BinaryArray, lang: np.ndarray, code: np.ndarray, runs: list[np.ndarray], counted: set[int]) -> Trie:
    """The trie of the phrases that start where ``runs`` say: runs[d] for phrases of d + 1 words, each within the one before.

    Nodes of levels that aren't in ``counted`` have a count of 0.
    """
    at = np.flatnonzero(runs[0])
    u, node, n = np.unique(lang[at], return_inverse=True, return_counts=True)
    levels = [(np.zeros(len(u), np.int64), u, n if 0 in counted else np.zeros(len(u), np.int64))]
    for d, run in enumerate(runs):
        keep = run[at]
        at, node = at[keep], node[keep]
        u, node, n = np.unique(node * len(words) + code[at + d], return_inverse=True, return_counts=True)
        levels.append((*parted(u, len(words)), n if d + 1 in counted else np.zeros(len(u), np.int64)))
    return Trie(words, levels)


def merge(tries: list[Trie]) -> Trie:
    """The union of sorted tries with summed counts, level by level; the stable sort merges their sorted runs."""
    if len(tries) == 1:
        return tries[0]
    words, code = sorted_codes(pa.concat_arrays([t.words for t in tries]))
    starts = np.cumsum([0, *(len(t.words) for t in tries)])
    above, levels = [np.zeros(1, np.int64)] * len(tries), []
    for d in range(max(len(t.levels) for t in tries)):
        own = [(k, t.levels[d]) for k, t in enumerate(tries) if d < len(t.levels)]
        key = np.concatenate([above[k][parent] * len(words) + code[starts[k] + word] for k, (parent, word, _) in own])
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(new)
        count = np.concatenate([c for _, (_, _, c) in own])[order]
        levels.append((*parted(key[first], len(words)), np.add.reduceat(count, first) if len(first) else count))
        place = np.empty(len(key), np.int64)
        place[order] = np.cumsum(new) - 1
        del key, order, count
        ends = np.cumsum([0, *(len(w) for _, (_, w, _) in own)])
        above = list(above)
        for i, (k, _) in enumerate(own):
            above[k] = place[ends[i] : ends[i + 1]]
    return Trie(words, levels)


def restrict(trie: Trie, keeps: list[np.ndarray]) -> Trie:
    """The nodes that ``keeps`` say, level by level, where their parents are kept too; words that no node has go."""
    above, levels = np.zeros(1, np.int64), []
    for (parent, word, count), keep in zip(trie.levels, keeps, strict=True):
        keep = keep & (above[parent] >= 0)
        levels.append((above[parent[keep]], word[keep], count[keep]))
        above = np.where(keep, np.cumsum(keep) - 1, -1)
    used = np.unique(np.concatenate([w for _, w, _ in levels]))
    return Trie(trie.words.take(pa.array(used)), [(p, np.searchsorted(used, w), c) for p, w, c in levels])


def frequent(trie: Trie, least: int) -> Trie:
    """The nodes with counts of ``least`` or more, and all languages."""
    return restrict(trie, [np.ones(len(w), bool) if d == 0 else c >= least for d, (_, w, c) in enumerate(trie.levels)])


def sample(trie: Trie, n: int = SAMPLE) -> list[Bound]:
    """About ``n`` prefixes of the trie, with as many nodes from one to the next."""
    (_, langs, _), (above, first, _), (parent, second, _) = trie.levels[:3]
    below = np.zeros(0)
    for d in range(len(trie.levels) - 1, 1, -1):
        size = np.ones(len(trie.levels[d][1])) + (below if d + 1 < len(trie.levels) else 0)
        below = np.bincount(trie.levels[d][0], weights=size, minlength=len(trie.levels[d - 1][1])) if d > 2 else size
    ends = np.cumsum(below).astype(np.int64)
    at = np.unique(np.searchsorted(ends, np.linspace(1, ends[-1], n).astype(int))) if len(second) else np.zeros(0, int)
    if not len(at):
        at = np.unique(np.linspace(0, len(first) - 1, n).astype(int)) if len(first) else at
        return [(trie.words[int(langs[above[i]])].as_py(), trie.words[int(first[i])].as_py(), b"") for i in at]
    word = lambda k: trie.words[int(k)].as_py()
    return [(word(langs[above[parent[i]]]), word(first[parent[i]]), word(second[i])) for i in at]


def cut(trie: Trie, bounds: list[Bound]) -> Iterator[tuple[int, Trie]]:
    """The parts of a trie that lie in the ranges between the bounds, each with the path to its first node."""
    known = trie.words.to_pylist()
    depth = min(3, len(trie.levels))
    # For each bound and level: the first node that doesn't sort before it, and whether that one is on its path.
    places = [([0] * depth, [False] * depth)]
    for bound in bounds:
        at, path, low, on = [], [], 0, True
        for d in range(depth):
            parent, word, _ = trie.levels[d]
            if on:
                a, b = (0, len(word)) if d == 0 else np.searchsorted(parent, [low, low + 1])
                code = bisect_left(known, bound[d])
                low = int(a + np.searchsorted(word[a:b], code))
                on = bool(low < b and code < len(known) and known[code] == bound[d] and word[low] == code)
            else:
                low = int(np.searchsorted(parent, low))
            at.append(low)
            path.append(on)
        places.append((at, path))
    places.append(([len(trie.levels[d][1]) for d in range(depth)], [False] * depth))
    for r, ((lo, _), (hi, on)) in enumerate(zip(places[:-1], places[1:], strict=True)):
        # The nodes on the path of the upper bound sort before it, but for the bound itself.
        end = [h + (on[d] and d + 1 < depth and (d + 1 < 2 or bounds[r][2] != b"")) for d, h in enumerate(hi)]
        if end[1] <= lo[1]:
            continue
        levels, start, stop = [], 0, 0
        for d, (parent, word, count) in enumerate(trie.levels):
            a, b = (lo[d], end[d]) if d < depth else np.searchsorted(parent, [start, stop])
            levels.append((parent[a:b] - start, word[a:b], count[a:b]))
            start, stop = a, b
        used = np.unique(np.concatenate([w for _, w, _ in levels]))
        yield r, Trie(trie.words.take(pa.array(used)), [(p, np.searchsorted(used, w), c) for p, w, c in levels])


def owned(trie: Trie, bounds: list[Bound], r: int) -> np.ndarray:
    """Which first words belong to range ``r``; the one on the path to its first node belongs to an earlier one."""
    (_, langs, _), (above, first, _) = trie.levels[:2]
    own = np.ones(len(first), bool)
    if r and len(first) and bounds[r - 1][2] != b"":
        own[0] = (trie.words[int(langs[above[0]])].as_py(), trie.words[int(first[0])].as_py()) != bounds[r - 1][:2]
    return own


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * U(0x8CB92BA72F3D8DD7) + b)


class Block:
    """The words of a block of texts: bytes, lengths, languages, whether the next one follows in the same piece, hashes."""

    def __init__(self, data: np.ndarray, off: np.ndarray, langs: list[str]):
        kind = KIND[data]
        inside = kind == 0
        starts, ends = spans(inside, off)
        piece = np.cumsum(kind == 2, dtype=np.int32)[starts]
        per_row = np.diff(np.searchsorted(starts, off))
        row = np.repeat(np.arange(len(langs), dtype=np.int32), per_row)
        self.joined = np.zeros(len(starts), bool)
        self.joined[:-1] = (piece[1:] == piece[:-1]) & (row[1:] == row[:-1])
        self.bytes, self.lengths = LOWER[data[inside]], (ends - starts).astype(np.int32)
        self.names = sorted(set(langs))
        number = {x: i for i, x in enumerate(self.names)}
        self.langs = np.array([number[x] for x in langs], np.int32)[row]
        spelled = [np.frombuffer(x.encode(), np.uint8) for x in self.names]
        hashes = np.array([segment_hashes(x, BYTE, np.zeros(1, np.int64), np.array([len(x)]))[0] for x in spelled], U)
        self.hashes = segment_hashes(data, FOLDED, starts, ends)
        self.first = pair_hash(hashes[self.langs], self.hashes)

    def phrases(self, depth: int, filters: list, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For 1 to ``depth`` words: where phrases start all whose parts may be frequent, their buckets, and which of these phrases may be frequent.

        filters[d] is the filter for phrases of d + 1 words, None where all may.
        """
        at, hashed, good = np.arange(len(self.first)), self.first, None
        for d in range(depth):
            if d:
                on = good[at] & good[at + 1] & (self.joined[at] if d == 1 else True)
                at = at[on]
                hashed = pair_hash(hashed[on], self.hashes[at + d])
            bucket = (hashed >> U(64 - bits)).astype(np.uint32)
            fits = np.ones(len(at), bool) if filters[d] is None else maybe(filters[d], bucket.astype(np.int64))
            yield at, bucket, fits
            good = np.zeros(len(self.first) + 1, bool)
            good[at[fits]] = True


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in small(batches, SLICE):
        langs = batch.column("lang").to_pylist()
        for i, j, data, off in blocks(batch.column("text")):
            yield Block(data, off, langs[i:j])


def _values(filters: list) -> list:
    return [None if f is None else f.value for f in filters]


def pack_counts(ids: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending numbers below 2**32 and their counts as compressed bytes: steps and counts, all first bytes, then all second ones and so on."""
    raw = b"".join(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for x in (np.diff(ids, prepend=ids[:0].dtype.type(0)), counts))
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def unpack_counts(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = pa.Codec("zstd").decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True)
    steps, counts = (np.ascontiguousarray(x.T).view("<u4").ravel() for x in np.frombuffer(raw, np.uint8).reshape(2, 4, -1))
    return np.cumsum(steps, dtype=np.int64), counts.astype(np.int64)


def tally(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers in order, and how often each occurs."""
    numbers = np.sort(numbers)
    new = np.ones(len(numbers), bool)
    new[1:] = numbers[1:] != numbers[:-1]
    first = np.flatnonzero(new)
    return numbers[first], np.diff(first, append=len(numbers))


BUCKETS = "range int, counts binary, langs array<string>, words array<long>"


def _bucket_pass(deeper: bool, filters: list, bits: int, width: int, n: int):
    """Counts by buckets of all words and pairs, or of phrases of three and more words, in ranges of ``width`` buckets; with the former, words of each language."""

    def rows(held: list[np.ndarray], words: dict[str, int]) -> pa.RecordBatch:
        ids, counts = tally(np.concatenate(held))
        ends = np.searchsorted(ids, np.arange(n + 1, dtype=np.int64) * width)
        full = np.flatnonzero(np.diff(ends))
        # Those of languages go with any one range.
        at = full[len(ids) % len(full)]
        blobs = [pack_counts(ids[ends[r] : ends[r + 1]] - np.uint32(r * width), counts[ends[r] : ends[r + 1]]) for r in full]
        sides = [pa.array([list(x) if r == at else [] for r in full], kind) for x, kind in ((words, pa.list_(pa.string())), (words.values(), pa.list_(pa.int64())))]
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(blobs, pa.binary()), *sides], names=["range", "counts", "langs", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, words = _values(filters), [], {}
        for block in _blocks(batches):
            found = [bucket for _, bucket, _ in block.phrases(DEPTH if deeper else 2, known, bits)]
            held += [x for x in (found[2:] if deeper else found) if len(x)]
            if not deeper:
                for x, k in zip(block.names, np.bincount(block.langs, minlength=len(block.names)).tolist(), strict=True):
                    words[x] = words.get(x, 0) + k
            if sum(map(len, held)) >= CHUNK:
                yield rows(held, words)
                held, words = [], {}
        if held:
            yield rows(held, words)

    return run


def _full_buckets(width: int, least: int):
    """The buckets of each range that have ``least`` or more, and the words of each language; rows come sorted by range."""
    least = min(least, FULL)

    def out(ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(ids), 1 << 16):
            x = pa.array(ids[i : i + (1 << 16)], pa.int64())
            yield pa.RecordBatch.from_arrays([x, pa.nulls(len(x), pa.string()), pa.nulls(len(x), pa.int64())], names=["id", "lang", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total, words = None, None, {}
        for b in batches:
            for r, blob, langs, ks in zip(b.column("range").to_pylist(), b.column("counts"), b.column("langs").to_pylist(), b.column("words").to_pylist(), strict=True):
                if r != at:
                    if at is not None:
                        yield from out(at * width + np.flatnonzero(total >= least))
                    at, total = r, np.zeros(width, np.int32)
                ids, counts = unpack_counts(blob.as_py())
                total[ids] = np.minimum(total[ids] + counts, least)
                for x, k in zip(langs, ks, strict=True):
                    words[x] = words.get(x, 0) + k
        if at is not None:
            yield from out(at * width + np.flatnonzero(total >= least))
        if words:
            yield pa.RecordBatch.from_arrays([pa.nulls(len(words), pa.int64()), pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["id", "lang", "f"])

    return run


class Shard:
    """Words that may be frequent, gathered from blocks of text until there are enough for a trie."""

    def __init__(self):
        self.bytes, self.lengths, self.depths, self.langs, self.n, self.names = [], [], [], [], 0, {}

    def add(self, block: Block, filters: list, bits: int) -> None:
        # How many words the longest phrase has that starts at each word and may be frequent; all its words are gathered then.
        depth = np.zeros(len(block.first), np.int8)
        for at, _, fits in block.phrases(DEPTH, filters, bits):
            depth[at[fits]] += 1
        keep = depth > 0
        number = np.array([self.names.setdefault(x.encode(), len(self.names)) for x in block.names], np.int32)
        self.bytes.append(block.bytes[np.repeat(keep, block.lengths)])
        self.lengths.append(block.lengths[keep])
        self.depths.append(depth[keep])
        self.langs.append(number[block.langs[keep]])
        self.n += int(keep.sum())

    def trie(self) -> Trie:
        pa.default_memory_pool().release_unused()
        data, lengths = np.concatenate(self.bytes), np.concatenate(self.lengths)
        words, code = sorted_codes(pa.concat_arrays([binary(lengths, data), pa.array(list(self.names), pa.binary())]))
        lang, code = code[self.n :][np.concatenate(self.langs)], code[: self.n]
        depth = np.concatenate(self.depths)
        self.__init__()
        return grow(words, lang, code, [depth > d for d in range(DEPTH)], set(range(1, DEPTH + 1)))


def _counted(batches: Iterator[pa.RecordBatch], filters: list, bits: int, size: int) -> Iterator[Trie]:
    shard = Shard()
    for block in _blocks(batches):
        shard.add(block, filters, bits)
        if shard.n >= size:
            yield shard.trie()
    if shard.n:
        yield shard.trie()


def _tries(batches: Iterator[pa.RecordBatch], filters: list, bits: int, size: int) -> Iterator[Trie]:
    """The tries of a task, merged as far as GATHER allows: what repeats in a task is sent once."""
    held: list[Trie] = []
    for trie in _counted(batches, filters, bits, size):
        held.append(trie)
        if sum(map(len, held)) > GATHER:
            held = [merge(held)]
            pa.default_memory_pool().release_unused()
            if 2 * len(held[0]) > GATHER:
                yield held.pop()
    if held:
        yield merge(held)


PACKED = "trie binary, nodes long, langs array<binary>, firsts array<binary>, seconds array<binary>"


def _trie_pass(filters: list, bits: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for trie in _tries(batches, _values(filters), bits, size):
            bounds = sample(trie)
            sides = [pa.array([[b[k] for b in bounds]], pa.list_(pa.binary())) for k in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array([trie.pack()], pa.binary()), pa.array([len(trie)], pa.int64()), *sides], names=["trie", "nodes", "langs", "firsts", "seconds"])

    return run


def _cut_pass(bounds: list[Bound]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column("trie"):
                for r, part in cut(Trie.unpack(blob.as_py()), bounds):
                    yield pa.RecordBatch.from_pydict({"range": pa.array([r], pa.int32()), "trie": pa.array([part.pack()], pa.binary())})

    return run


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Trie]]:
    """One merged trie for each range; rows come sorted by range."""
    at, held = None, []
    for b in batches:
        for r, blob in zip(b.column("range").to_pylist(), b.column("trie"), strict=True):
            if r != at and held:
                whole, held = merge(held), []
                yield at, whole
                pa.default_memory_pool().release_unused()
            at = r
            held.append(Trie.unpack(blob.as_py()))
            if len(held) > 1 and sum(map(len, held)) > 2 * RANGE + len(held[0]):
                held = [merge(held)]
    if held:
        yield at, merge(held)


NODES = "lang string, depth int, phrase string, suffix string, f long, l1 long, l2 long, l3 long, child long"


def _merge_pass(bounds: list[Bound], least: int):
    names = [c.split()[0] for c in NODES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, merged in _ranges(batches):
            trie = frequent(merged, least)
            text = trie.words.cast(pa.string())
            lang, phrase, suffix, left = text.take(pa.array(trie.levels[0][1])), None, None, []
            for d, (parent, word, count) in enumerate(trie.levels):
                own = text.take(pa.array(word))
                if d > 0:
                    lang = lang.take(pa.array(parent))
                    suffix = None if d == 1 else own if d == 2 else pc.binary_join_element_wise(suffix.take(pa.array(parent)), own, " ")
                    phrase = own if d == 1 else pc.binary_join_element_wise(phrase.take(pa.array(parent)), own, " ")
                    # Counts of the left parts: those of the nodes on the way to the root, the language left out.
                    left = [x[parent] for x in left] + ([trie.levels[d - 1][2][parent]] if d > 1 else [])
                child = np.zeros(len(word), np.int64)
                if d + 1 < len(trie.levels):
                    np.maximum.at(child, trie.levels[d + 1][0], trie.levels[d + 1][2])
                lefts = [pa.array(left[k]) if k < len(left) else pa.nulls(len(word), pa.int64()) for k in range(DEPTH - 1)]
                none = pa.nulls(len(word), pa.string())
                columns = [lang, pa.array(np.full(len(word), d, np.int32)), none if d == 0 else phrase, none if d < 2 else suffix, pa.array(count), *lefts, pa.array(child)]
                out = pa.RecordBatch.from_arrays(columns, names=names)
                if d > 0:
                    yield out.filter(pa.array(owned(trie, bounds, r))) if d == 1 else out

    return run


def _dealt(parts: DataFrame, n: int) -> DataFrame:
    return parts.repartitionById(n, F.col("range")).sortWithinPartitions("range")


def phrases(docs: DataFrame, least: int = 30, stage: Stage | None = None, shard: int = SHARD, ranges: int = 1) -> DataFrame:
    """Every phrase of one to DEPTH words that occurs ``least`` times or more in a language, with what a trie knows of it.

    lang, depth, phrase, suffix (the phrase without its first word), f (its count), l1 to l3 (counts of its first words), child (largest
    count of a phrase with one word more at its end, 0 if none has ``least``).  Rows of depth 0 have a number of words of the language as f; their sum is that of all.
    A trie counts about ``shard`` words at first; it doesn't change the result, nor does the least number of ``ranges``.
    """
    spark = docs.sparkSession
    stage = stage or Stage(spark, "collocations")
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # A bucket for every four to eight bytes, so that few rare phrases fall into one; their number grows with the corpus, that of counters in a task doesn't.
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MOST, max(16, (size // 8).bit_length()))
    parts = n_parts(texts)
    n = max(parts, (1 << bits) // WIDTH)
    width = -(-(1 << bits) // n)
    filters, found, sent, spare = [None] * DEPTH, [], [], 0.0
    for deeper in (False, True):
        counts = texts.mapInArrow(_bucket_pass(deeper, list(filters), bits, width, n), BUCKETS)
        full = stage(_dealt(counts, n).mapInArrow(_full_buckets(width, least), "id long, lang string, f long"), "full")
        known = id_filter(full.where("id is not null").select("id"))
        sent.append(spark.sparkContext.broadcast(known))
        filters[2 * deeper : 2 * deeper + 2] = [sent[-1]] * 2
        found.append(full)
        spare = max(spare, (float(np.bitwise_count(known.view(np.uint64)).sum()) / (64 * len(known))) ** 2)
    shards = stage(texts.mapInArrow(_trie_pass(filters, bits, shard), PACKED), "shards")
    for one in sent:
        one.destroy()
    nodes = shards.agg(F.sum("nodes")).first()[0] or 0
    # Once merged there is about a node for each full bucket, and for rare phrases that the filters let through.
    words, often = (sum(x or 0 for x in y) for y in zip(*(f.agg(F.sum("f"), F.count("id")).first() for f in found), strict=True))
    n = max(parts, ranges, min(nodes, often + int(spare * 2 * words)) // RANGE + 1)
    keys = shards.select(F.explode(F.arrays_zip("langs", "firsts", "seconds")).alias("k")).select("k.*").repartitionByRange(n, "langs", "firsts", "seconds")
    rows = keys.groupBy(F.spark_partition_id()).agg(F.min(F.struct("langs", "firsts", "seconds")).alias("k")).collect()
    # The first range has no lower bound.
    bounds = sorted({(bytes(r.k.langs), bytes(r.k.firsts), bytes(r.k.seconds)) for r in rows})[1:]
    cuts = shards.select("trie").mapInArrow(_cut_pass(bounds), "range int, trie binary")
    out = stage(_dealt(cuts, len(bounds) + 1).mapInArrow(_merge_pass(bounds, least), NODES), "nodes")
    stage.drop(shards, found[1])
    blank = [F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in NODES.split(", ")[5:]]
    return out.union(found[0].where("lang is not null").select("lang", F.lit(0), F.lit(None).cast("string"), F.lit(None).cast("string"), "f", *blank))


def mine(docs: DataFrame, least: int = 30, top: int = 2000, inside: int = 80, **how) -> DataFrame:
    """The first ``top`` collocations of each language: lang, rank, phrase, a, l, r, n, score.

    A candidate is a phrase of 2 to DEPTH words with a = f(phrase) >= ``least``.  Cut after its first k words it has l, r = f(first part), f(rest) and the
    score 2000000 * a div (l + r); its lowest score counts, ties to the smallest k.  A candidate that lies inside a longer one with at
    least ``inside`` percent of its count goes; as counts never grow with length, looking at the phrases one word longer tells that.
    n is the number of words of the language.  Order: score, then a, descending, then the phrase by its UTF-8 bytes.

    A null text counts as empty, a null language as "und"; repeated rows count each; doc_id and other columns aren't read; an empty table, or
    one without frequent phrases, gives no rows.  ``how`` goes to ``phrases``.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "collocations")
    nodes = phrases(docs, least, stage, **how)
    counts = dict(nodes.groupBy("depth").count().collect())
    n = nodes.where("depth = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    base = nodes.where("depth = 1").select("lang", "phrase", "f", *(F.lit(None).cast("long").alias(f"r{k}") for k in range(1, DEPTH)))
    levels = []
    for d in range(2, DEPTH + 1):
        here = nodes.where(f"depth = {d}")
        # Suffix links: how many phrases lead to a node, and the largest count of one with a word more at its front.
        links = here.groupBy("lang", F.col("suffix").alias("phrase")).agg(F.count("*").alias("n"), F.max("f").alias("front"))
        base = base.join(links, ["lang", "phrase"], "left")
        if d > 2:
            base = stage(base, f"linked{d - 1}")
            levels.append(base)
        target = base.where("n is not null").select("lang", F.col("phrase").alias("suffix"), F.col("f").alias("r1"), *(F.col(f"r{k}").alias(f"r{k + 1}") for k in range(1, DEPTH - 1)), "n")
        base = join_counted(here, target, ["lang", "suffix"], total=counts.get(d, 0))
    levels.append(base.withColumn("n", F.lit(None).cast("long")).withColumn("front", F.lit(None).cast("long")))
    columns = ["lang", "phrase", "f", "child", "front", *(f"{s}{k}" for s in "lr" for k in range(1, DEPTH))]
    every = levels[0].select(columns)
    for level in levels[1:]:
        every = every.union(level.select(columns))
    # Decimals, for products may pass 64 bits.
    cuts = [F.when(F.col(f"l{k}").isNotNull(), F.struct(F.expr(f"cast(f as decimal(20, 0)) * 2000000 div (l{k} + r{k})").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, DEPTH)]
    scored = every.where(f"100 * cast(greatest(child, coalesce(front, 0)) as decimal(20, 0)) < {inside} * cast(f as decimal(20, 0))").withColumn("cut", F.array_min(F.array_compact(F.array(*cuts))))
    order = Window.partitionBy("lang").orderBy(F.col("cut.score").desc(), F.col("f").desc(), "phrase")
    best = scored.withColumn("rank", F.row_number().over(order).cast("long")).where(f"rank <= {top}")
    return best.join(n, "lang").select("lang", "rank", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "n", F.col("cut.score").alias("score"))
