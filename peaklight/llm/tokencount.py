"""How many tokens a text has, by byte-pair merging with a heap and a linked list.

A piece starts as a linked list of symbols, one for each byte.  The adjacent pair of the
lowest rank (the leftmost of equals) is popped from a heap and merged until no pair has a rank; the count is
the number of initial symbols less the number of merges.  No ids are made or kept.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peaklight.llm._base import documents, small

#: Counted stretches of text that a worker remembers; when full it starts anew.
MOST = 400_000
#: Longer stretches are counted each time they occur.
LONG = 32


class Merger:
    """Counts the symbols that are left of a piece once every ranked pair is merged."""

    def __init__(self, merges: list, end: str):
        names: dict[str, int] = {}
        number = lambda s: names.setdefault(s, len(names))
        #: Rank of a pair of symbols, and the symbol that it becomes.
        self.pairs = {}
        for rank, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs.setdefault((number(a), number(b)), (rank, number(a + b)))
        # Byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = iter(range(256, 512))
        letters = [chr(b if b in shown else next(rest)) for b in range(256)]
        self.inner, self.last = [number(c) for c in letters], [number(c + end) for c in letters]

    def count(self, piece: bytes) -> int:
        n = len(piece)
        if n < 2:
            return n
        symbol = [*map(self.inner.__getitem__, piece[:-1]), self.last[piece[-1]]]
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        pairs, merges = self.pairs, 0
        # An entry is (rank, place of the left symbol, left symbol, right symbol); it is stale once either has changed.
        heap = [(pairs[a, b][0], i, a, b) for i, (a, b) in enumerate(zip(symbol, symbol[1:])) if (a, b) in pairs]
        heapify(heap)
        while heap:
            _, i, a, b = heappop(heap)
            j = after[i]
            if symbol[i] != a or j < 0 or symbol[j] != b:
                continue
            symbol[i], symbol[j] = pairs[a, b][1], -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
            merges += 1
            for left, right in ((before[i], i), (i, k)):
                if left >= 0 and right >= 0 and (pair := (symbol[left], symbol[right])) in pairs:
                    heappush(heap, (pairs[pair][0], left, *pair))
        return n - merges


class Remembered(dict):
    """Counts of short texts, made by a function when first asked for."""

    def __init__(self, made: Callable[[str], int]):
        super().__init__()
        self.made = made

    def __missing__(self, text: str) -> int:
        n = self.made(text)
        if len(text) < LONG:
            if len(self) >= MOST:
                self.clear()
            self[text] = n
        return n


#: The settings of a tokenizer file under which white space never is part of a token and letters are lowered.
LOWERED = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PIECES = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
PLAIN_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "byte_fallback": False, "ignore_merges": False}


class TokenCounter:
    """The number of tokens that the tokenizers library gives for a text, without special tokens added.

    Strings of special tokens inside a text are one token each, as is the library's default.  A tokenizer file with
    other settings than the ones stated above is refused with a ValueError, for its pieces would be cut in another way.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as source:
            file = json.load(source)
        model, added = file["model"], file["added_tokens"]
        plain = not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added)
        if not plain or file["normalizer"] != LOWERED or file["pre_tokenizer"] != PIECES or any(model.get(k) != v for k, v in PLAIN_MODEL.items()):
            raise ValueError(f"{path} isn't a file of the known kind")
        self.merger = Merger(model["merges"], model["end_of_word_suffix"] or "")
        missing = {t["content"] for t in added}
        self.special = regex.compile("|".join(map(regex.escape, sorted(missing, key=len, reverse=True)))) if missing else None
        whole = Tokenizer.from_file(path)
        self.normalizer, self.splitter = whole.normalizer, whole.pre_tokenizer
        self.simple = regex.compile(r"[!-~À-ÖØ-öø-ÿ]+")
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        #: Counts of pieces, and of the stretches between white space that consist of them.
        self.known_pieces = Remembered(lambda piece: self.merger.count(piece.encode()))
        self.known = Remembered(self.stretch)

    def stretch(self, text: str) -> int:
        """Tokens of a stretch without blanks: plain letters are lowered here, all else is normalised and cut by the library."""
        if not text:
            return 0
        if text.isascii() and text.isalpha():
            return self.known_pieces[text.lower()]
        if self.simple.fullmatch(text):
            return sum(map(self.known_pieces.__getitem__, self.pieces.findall(text.lower())))
        # The library cuts bytes by code points, so each of its pieces is bytes of the normalised text.
        normal = self.normalizer.normalize_str(text)
        return sum(self.known_pieces[normal[a:b]] for _, (a, b) in self.splitter.pre_tokenize_str(normal))

    def __call__(self, text: str) -> int:
        if self.special is not None and "<|" in text:
            parts = self.special.split(text)
            return len(parts) - 1 + sum(map(self._section, parts))
        return self._section(text)

    def _section(self, text: str) -> int:
        return sum(map(self.known.__getitem__, text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")))


@lru_cache(2)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) for each row.

    Rows stay where they are read; a null text counts as empty (no bytes, no tokens), a null doc_id stays null, repeated
    rows are counted each, other columns, whatever their names, aren't read, and an empty table gives no rows.  Whole
    texts of any length are counted; a worker keeps at most MOST counts of short stretches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for batch in small(batches):
            text = batch.column("text")
            n = pa.array([count(t.as_py()) for t in text], pa.int64())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_bytes": pc.binary_length(text).cast(pa.int64()), "n_tokens": n})

    return documents(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
