"""Token ids in Arrow stream files of fixed-size lists.

A file is an Arrow IPC stream of record batches with two columns: ``ids``, a
fixed-size list of L unsigned integers, and ``mask``, a fixed-size list of L
bytes, 1 where the id counts and 0 for padding behind the last one.  All rows
have L ids, so row i of a mapped file is a slice at a known place: nothing is
copied or decoded.  A second stream beside it, ``.index``, holds doc_id and
n_tokens of each document in file order.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peaklight.llm._base import Stage, documents, id_ranges, n_parts, range_of, small

#: Ids in a row of a file, and rows in a record batch.
ROW, ROWS = 2048, 256
#: Entries of a worker's cache of encoded pieces; when full it starts anew.
CACHE = 300_000


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if ":/" in uri else f"file://{os.path.abspath(uri)}")


class FixedListWriter:
    """Appends ids of any number to a new file; close() pads the last row."""

    def __init__(self, uri: str, row: int = ROW, rows: int = ROWS, dtype=np.uint16):
        self.fs, self.path = _open(uri)
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.row, self.size, self.dtype = row, row * rows, dtype
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), row)), ("mask", pa.list_(pa.uint8(), row))])
        self.sink = self.fs.open_output_stream(self.path)
        self.stream = pa.ipc.new_stream(self.sink, self.schema)
        self.held, self.n = [], 0

    def append(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n += len(ids)
        if self.n >= self.size:
            every = np.concatenate(self.held)
            full = len(every) // self.size * self.size
            for at in range(0, full, self.size):
                self._put(every[at : at + self.size])
            self.held, self.n = [every[full:]], len(every) - full

    def _put(self, ids: np.ndarray) -> None:
        rows = -(-len(ids) // self.row)
        flat, mask = np.zeros(rows * self.row, self.dtype), np.zeros(rows * self.row, np.uint8)
        flat[: len(ids)], mask[: len(ids)] = ids, 1
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.row) for x in (flat, mask)]
        self.stream.write_batch(pa.record_batch(columns, schema=self.schema))

    def close(self) -> None:
        if self.n:
            self._put(np.concatenate(self.held))
        self.stream.close()
        self.sink.close()


class FixedListReader:
    """Random access to the rows and to the ids of a file, without copies."""

    def __init__(self, uri: str):
        fs, path = _open(uri)
        source = pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path).read_buffer()
        self.batches = list(pa.ipc.open_stream(source))
        self.row = self.batches[0].schema.field("ids").type.list_size if self.batches else ROW
        self.starts = np.cumsum([0, *(len(b) for b in self.batches)])

    def __len__(self) -> int:
        return int(self.starts[-1])

    def _column(self, k: int, name: str) -> np.ndarray:
        return self.batches[k].column(name).flatten().to_numpy(zero_copy_only=True)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Row i: its ids and its mask."""
        k = int(np.searchsorted(self.starts, i, "right")) - 1
        at = (i - int(self.starts[k])) * self.row
        return self._column(k, "ids")[at : at + self.row], self._column(k, "mask")[at : at + self.row]

    def ids(self, start: int, n: int) -> np.ndarray:
        """n ids from the place start; a copy only where they cross batches."""
        k, parts = int(np.searchsorted(self.starts * self.row, start, "right")) - 1, []
        while n > 0:
            at = start - int(self.starts[k]) * self.row
            parts.append(self._column(k, "ids")[at : at + n])
            start, n, k = start + len(parts[-1]), n - len(parts[-1]), k + 1
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint16)


#: The normalizer and pre-tokenizer of a tokenizer file under which white space never is part of a token.
LOWERED = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PIECES = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


class WordEncoder:
    """Ids of a text as the tokenizers library gives them.

    Where the file says LOWERED and PIECES, white space never is part of a token, so what stands
    between is encoded alone and remembered: pieces of the plain letters, digits and marks
    that normalisation only lowers go straight to the library's model, all others through
    the whole tokenizer.  With any other file each whole text goes through the tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as source:
            settings = json.load(source)
        self.known = settings["normalizer"] == LOWERED and settings["pre_tokenizer"] == PIECES and settings["model"]["type"] == "BPE"
        #: Two bytes hold an id where the vocabulary allows it.
        self.dtype = np.uint16 if Tokenizer.from_file(path).get_vocab_size() <= 65536 else np.uint32
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model = self.tokenizer.model
        self.plain = regex.compile(r"[!-~À-ÖØ-öø-ÿ]+")
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        # Byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = iter(range(256, 512))
        self.letters = {b: chr(b if b in shown else next(rest)) for b in range(256)}
        self.cache: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {"": b""}

    def piece(self, text: str) -> bytes:
        got = self.cache.get(text)
        if got is None:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            word = text if text.isascii() else "".join(map(self.letters.__getitem__, text.encode()))
            got = self.cache[text] = np.array([t.id for t in self.model.tokenize(word)], self.dtype).tobytes()
        return got

    def chunk(self, text: str) -> bytes:
        if text.isascii() and text.isalpha():
            return self.piece(text.lower())
        if self.plain.fullmatch(text):
            return b"".join(map(self.piece, self.pieces.findall(text.lower())))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def __call__(self, text: str) -> bytes:
        if not self.known:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        known = self.chunks
        words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        out = list(map(known.get, words))
        if None in out:
            if len(known) >= CACHE:
                known.clear()
                known[""] = b""
            for i, got in enumerate(out):
                if got is None:
                    x = words[i]
                    got = known.get(x)
                    out[i] = got if got is not None else self.chunk(x)
                    if got is None and len(x) < 24:
                        known[x] = out[i]
        return b"".join(out)


@lru_cache(2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _encode(path: str, end: int, highs: list[int]):
    bounds = np.array(highs, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        tail = np.array([end], code.dtype).tobytes()
        for batch in small(batches):
            ids = [code(x.as_py()) + tail for x in batch.column("text")]
            keys = np.array([-(2**63) if x is None else x for x in batch.column("doc_id").to_pylist()], np.int64)
            yield pa.RecordBatch.from_pydict({"range": pa.array(range_of(keys, bounds), pa.int32()), "doc_id": batch.column("doc_id"), "ids": pa.array(ids, pa.binary())})

    return run


def _write(folder: str, row: int, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, open_at, out, index, total = None, None, None, [], 0

        def finish():
            out.close()
            fs, path = _open(f"{folder}/{name}.index")
            table = pa.table({"doc_id": pa.array([d for d, _ in index], pa.int64()), "n_tokens": pa.array([n for _, n in index], pa.int64())})
            with fs.open_output_stream(path) as sink, pa.ipc.new_stream(sink, table.schema) as stream:
                stream.write_table(table)
            return pa.RecordBatch.from_pydict({"range": pa.array([open_at], pa.int32()), "name": pa.array([name], pa.string()), "n_docs": pa.array([len(index)], pa.int64()), "n_tokens": pa.array([total], pa.int64())})

        for batch in batches:
            for at, doc, raw in zip(*(batch.column(c).to_pylist() for c in ("range", "doc_id", "ids")), strict=True):
                if at != open_at:
                    if out is not None:
                        yield finish()
                    # A name of its own for each attempt: only files of the attempt that counts are listed.
                    open_at, index, total, name = at, [], 0, f"part-{at:07d}-{os.urandom(8).hex()}"
                    out = FixedListWriter(f"{folder}/{name}.arrows", row, dtype=np.dtype(dtype).type)
                ids = np.frombuffer(raw, dtype)
                out.append(ids)
                index.append((doc, len(ids)))
                total += len(ids)
        if out is not None:
            yield finish()

    return run


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column("name").to_pylist(), batch.column("start").to_pylist(), strict=True):
                reader = FixedListReader(f"{folder}/{name}.arrows")
                fs, path = _open(f"{folder}/{name}.index")
                with fs.open_input_stream(path) as source:
                    index = pa.ipc.open_stream(source).read_all()
                counts = index.column("n_tokens").to_numpy()
                places = np.cumsum(counts) - counts
                sums = [zlib.crc32(reader.ids(p, n).astype("<u4").tobytes()) for p, n in zip(places.tolist(), counts.tolist(), strict=True)]
                out = {"doc_id": index.column("doc_id").combine_chunks(), "start": pa.array(places + start, pa.int64()), "n_tokens": pa.array(counts, pa.int64()), "ids_crc32": pa.array(sums, pa.int64())}
                table = pa.table(out)
                yield from table.to_batches(max_chunksize=10_000)

    return run


def write_token_files(docs: DataFrame, tokenizer: str, end: int = 2, row: int = ROW, folder: str | None = None) -> tuple[str, DataFrame]:
    """Encode every text, write the ids in ascending doc_id order; returns the folder and its list of files.

    Texts are encoded where they are read; only their ids move, to one range of
    doc_id per file.  The list has a row per file: range, name, n_docs, n_tokens, start (ids in all files before it); it is
    as long as there are partitions.  A task that runs again writes files of other names, and those of lost attempts are in no list.  Rows with one doc_id stand side by side, ordered by their ids; a
    null doc_id comes first.  An empty table gives no files; other columns, whatever their names, aren't read.  Ids are 16-bit where the vocabulary allows it.
    """
    spark = docs.sparkSession
    folder = folder or Stage(spark, "tokens").path
    parts = n_parts(docs)
    docs = documents(docs)
    _, highs = id_ranges(docs, parts)
    schema = "range int, name string, n_docs long, n_tokens long"
    if not highs:
        return folder, spark.createDataFrame([], schema + ", start long")
    dtype = np.dtype(encoder(tokenizer).dtype).name
    coded = docs.mapInArrow(_encode(tokenizer, end, highs), "range int, doc_id long, ids binary")
    dealt = coded.repartitionById(len(highs), F.col("range")).sortWithinPartitions("range", F.col("doc_id").asc_nulls_first(), "ids")
    files = sorted(dealt.mapInArrow(_write(folder, row, dtype), schema).collect())
    start, rows = 0, []
    for f in files:
        rows.append((f.range, f.name, f.n_docs, f.n_tokens, start))
        start += f.n_tokens
    return folder, spark.createDataFrame(rows, schema + ", start long")


def read_token_files(folder: str, files: DataFrame) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32."""
    n = max(1, files.count())
    return files.repartitionById(n, F.col("range")).mapInArrow(_read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")
