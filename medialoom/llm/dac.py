"""Token output as directly addressable codes.

An id is cut into chunks of 8 bits, lowest first.  Level k holds the k-th chunk of every id
that has one, a bitmap that says which of these ids go on in level k+1, and a rank
directory: the bitmap's set bits before every 512th bit.  The place of an id in the next
level is the rank of its bit, so any id, and any run of ids, is read from byte ranges of
each level, without decoding a block.

A file (little-endian): magic, level count, id count, document count; a table of section
offsets; doc_ids (int64), document starts (uint64, one more than documents); for each level
chunks (uint8), bitmap (uint8), ranks (uint64).

Writing: documents are range-partitioned and sorted by doc_id (ties by the text's hash, then
the text; null ids first); each task writes one file under a name of its own and returns a
manifest row.  Only manifest rows of successful tasks are committed, so files left by lost or
repeated tasks are never read.

Defined results: a null text is an empty one, so that its only id is the end id; empty table:
no file, no rows; repeated doc_ids keep one entry a row, and rows that repeat spread over files; null doc_ids come
first and back as null; very long texts are encoded whole; columns other than doc_id and text
are not looked at, whatever their names.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from medialoom.llm.bpe import LETTERS, NUMBERS, SPACES, chunks, vocabulary
from medialoom.llm.common import claim, documents_of, file_system, fresh_path, keeps, parts_for, saved, shuffle_partitions, text_bytes

MAGIC = b"MLDAC001"
BLOCK = 512
CACHE, CHUNK_CHARS = 700_000, 3_000_000
PART_BYTES = 32_000_000
_RARE = re.compile("[^\x00-ſ]")
_SPACED = re.compile(f"[{SPACES}]")
_PIECES = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")


# ---------------------------------------------------------------- the code

def encode_levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks, bitmap, ranks) of each level."""
    out, rest = [], ids.astype(np.uint32)
    while True:
        on = rest > 255
        bitmap = np.packbits(on, bitorder="little")
        ones = np.add.reduceat(on.astype(np.uint64), np.arange(0, len(on), BLOCK)) if len(on) else np.empty(0, np.uint64)
        out.append(((rest & 255).astype(np.uint8), bitmap, np.concatenate([np.zeros(1, np.uint64), np.cumsum(ones, dtype=np.uint64)])))
        rest = rest[on] >> np.uint32(8)
        if not len(rest):
            return out


def write_file(uri: str, doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
    levels = encode_levels(ids)
    sections = [doc_ids.astype("<i8").tobytes(), np.concatenate([[0], np.cumsum(counts)]).astype("<u8").tobytes()]
    for c, b, r in levels:
        sections += [c.tobytes(), b.tobytes(), r.astype("<u8").tobytes()]
    head = MAGIC + struct.pack("<QQQ", len(levels), len(ids), len(doc_ids))
    at, table = len(head) + 8 * (len(sections) + 1), []
    for s in sections:
        table.append(at)
        at += len(s)
    fs, path = file_system(uri)
    with fs.open_output_stream(path) as f:
        f.write(head + struct.pack(f"<{len(table) + 1}Q", *table, at))
        for s in sections:
            f.write(s)


class Reader:
    """Random access to a file by byte ranges."""

    def __init__(self, uri: str):
        fs, path = file_system(uri)
        self.f = fs.open_input_file(path)
        head = self.f.read_at(32, 0)
        if head[:8] != MAGIC:
            raise ValueError(f"{uri} is no such file")
        self.n_levels, self.n_ids, self.n_docs = struct.unpack("<QQQ", head[8:])
        n = 2 + 3 * self.n_levels
        self.at = struct.unpack(f"<{n + 1}Q", self.f.read_at(8 * (n + 1), 32))

    def _read(self, section: int, kind: str, a: int, b: int) -> np.ndarray:
        w = np.dtype(kind).itemsize
        return np.frombuffer(self.f.read_at(w * (b - a), self.at[section] + w * a), kind) if b > a else np.empty(0, kind)

    def documents(self) -> tuple[np.ndarray, np.ndarray]:
        """doc_ids, and the starts of the documents with the end of the last."""
        return self._read(0, "<i8", 0, self.n_docs), self._read(1, "<u8", 0, self.n_docs + 1)

    def _rank(self, level: int, i: int) -> int:
        block = i // BLOCK
        before = int(self._read(4 + 3 * level, "<u8", block, block + 1)[0])
        rest = i - block * BLOCK
        bits = self._read(3 + 3 * level, "u1", block * BLOCK // 8, block * BLOCK // 8 + (rest + 7) // 8)
        return before + int(np.unpackbits(bits, bitorder="little")[:rest].sum())

    def ids(self, a: int, b: int) -> np.ndarray:
        """Ids from a to b (exclusive) of the file."""
        out, where, shift = np.zeros(max(b - a, 0), np.uint32), np.arange(max(b - a, 0)), 0
        for level in range(self.n_levels):
            if b <= a:
                break
            out[where] |= self._read(2 + 3 * level, "u1", a, b).astype(np.uint32) << np.uint32(shift)
            bits = np.unpackbits(self._read(3 + 3 * level, "u1", a // 8, (b + 7) // 8), bitorder="little")[a % 8 : a % 8 + b - a].astype(bool)
            where, shift = where[bits], shift + 8
            if len(where):
                a = self._rank(level, a)
            b = a + len(where)
        return out

    def __getitem__(self, i: int) -> int:
        """The i-th id of the file."""
        return int(self.ids(i, i + 1)[0])

    def close(self) -> None:
        self.f.close()


# ---------------------------------------------------------------- ids of texts

class LibraryIds:
    """Ids of texts by the tokenizers library; a text whose split is known here is looked up word by word."""

    def __init__(self, path: str, ordinary: bool = False):
        """ordinary: special tokens' strings in a text are ordinary text."""
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = ordinary
        self.special = [] if ordinary else [t.content for t in self.library.get_added_tokens_decoder().values()]
        end = self.library.encode("\n", add_special_tokens=False).ids
        self.line_end = end[0] if len(end) == 1 else None
        self.known = _Known()

    def _of_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word. Words without white space, but for one space before them, go as lines of
        one text: the split takes the line ends out as words of their own, so their id parts the rest."""
        lines = [w for w in words if not _SPACED.search(w, 1 if w[0] == " " else 0) and len(w) > (w[0] == " ")]
        out = {}
        if lines and self.line_end is not None:
            ids = np.array(self.library.encode_batch_fast(["\n".join(lines)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.append(np.flatnonzero(ids == self.line_end), len(ids))
            if len(ends) == len(lines):
                raw, cuts = ids.tobytes(), (4 * ends).tolist()
                out = dict(zip(lines, (raw[a:b] for a, b in zip([0, *(c + 4 for c in cuts)], cuts))))
        rest = [w for w in words if w not in out]
        out |= zip(rest, (np.array(e.ids, "<u4").tobytes() for e in (self.library.encode_batch_fast(rest, add_special_tokens=False) if rest else [])))
        return [out[w] for w in words]

    def encode(self, texts: list[str | None], end_id: int) -> list[bytes]:
        """Each text's ids and the end id, as little-endian uint32."""
        get, known, n = self.known.__getitem__, self.known, 0
        parts: list = []
        for t in texts:
            if not t:
                parts.append([])
            elif (t.isascii() or not _RARE.search(t)) and not any(s in t for s in self.special):
                parts.append(list(map(get, _PIECES.findall(t))))
                n += len(parts[-1])
            else:
                parts.append([np.array(self.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes()])
        new, known.new = known.new, []
        found = self._of_words(new)
        for w, ids in zip(new, found):
            known[w].extend(ids)
        end = struct.pack("<I", end_id)
        out = [b"".join(p) + end for p in parts]
        if len(known) <= CACHE:
            known.update(zip(new, found))
        elif 4 * len(new) > n:  # the texts have changed
            known.clear()
        else:  # what was met first is what is frequent; the rest passes
            for w in new:
                del known[w]
        return out


class _Known(dict):
    """Ids of the words met. A new word gets a buffer that is filled when the batch's new words have been encoded."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> bytearray:
        self.new.append(word)
        self[word] = out = bytearray()
        return out


_LIBRARY: dict[tuple[str, bool], LibraryIds] = {}
keeps("library", _LIBRARY.clear)


def library_ids(path: str, ordinary: bool = False) -> LibraryIds:
    claim("library")
    if (path, ordinary) not in _LIBRARY:
        _LIBRARY.clear()
        _LIBRARY[path, ordinary] = LibraryIds(path, ordinary)
    return _LIBRARY[path, ordinary]


# ---------------------------------------------------------------- writing and reading a corpus

def write_corpus(docs: DataFrame, folder: str, name: str = "byte_bpe_50k.json", end_id: int = 2) -> DataFrame:
    """Writes the files of a corpus; the manifest has part (order), file, n_docs, n_ids, and first_id, the ids in files before."""
    docs = documents_of(docs)
    spark = docs.sparkSession
    n = parts_for(spark, text_bytes(docs), PART_BYTES)
    # the row's number spreads rows that are equal; their order does not show
    spread = docs.withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id()).repartitionByRange(n, "doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "text").drop("tie", "row")

    def run(batches):
        tok = library_ids(vocabulary(name))
        doc_ids, counts, parts = [], [], []
        for batch in batches:
            texts = batch.column(1).to_pylist()
            doc_ids.append(batch.column(0).fill_null(-(2**63)).to_numpy(zero_copy_only=False))
            for a, b in chunks(texts, CHUNK_CHARS):
                coded = tok.encode(texts[a:b], end_id)
                counts.append(np.fromiter(map(len, coded), np.int64, len(coded)) // 4)
                parts.append(np.frombuffer(b"".join(coded), "<u4").astype(np.uint16 if tok.library.get_vocab_size() < 65536 else np.uint32))
        if not doc_ids or not sum(map(len, doc_ids)):
            return
        uri, ids, counts = f"{folder}/{uuid.uuid4().hex}.dac", np.concatenate(parts), np.concatenate(counts)
        write_file(uri, np.concatenate(doc_ids), counts, ids)
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "file": [uri], "n_docs": [len(counts)], "n_ids": [len(ids)]})

    _make_folder(folder)
    manifest = saved(spread.mapInArrow(run, "part int, file string, n_docs long, n_ids long"), "dac-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    return manifest.withColumn("first_id", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _make_folder(uri: str) -> None:
    fs, path = file_system(uri)
    fs.create_dir(path, recursive=True)


def read_corpus(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """For each document, from the files: doc_id, start, n_tokens and the ids as little-endian uint32 (ids)."""
    files = manifest.select("file", "first_id").repartition(shuffle_partitions(spark), "file")

    def run(batches):
        for batch in batches:
            for uri, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                r = Reader(uri)
                doc_ids, starts = r.documents()
                starts = starts.astype(np.int64)
                lo = 0
                while lo < r.n_docs:
                    hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + 2_000_000, "right")) - 1)
                    hi = min(hi, r.n_docs)
                    run_ids = r.ids(int(starts[lo]), int(starts[hi])).astype("<u4").tobytes()
                    cuts = 4 * (starts[lo : hi + 1] - starts[lo])
                    ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(cuts.astype("<i8").tobytes()), pa.py_buffer(run_ids)]).cast(pa.binary())
                    own = doc_ids[lo:hi]
                    yield pa.RecordBatch.from_arrays([pa.array(own, mask=own == -(2**63)), pa.array(first + starts[lo:hi]), pa.array(np.diff(starts[lo : hi + 1])), ids], ["doc_id", "start", "n_tokens", "ids"])
                    lo = hi
                r.close()

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def stored(docs: DataFrame, name: str = "byte_bpe_50k.json", end_id: int = 2) -> DataFrame:
    """Writes a corpus to a new place in the shared folder and reads it back."""
    spark = docs.sparkSession
    return read_corpus(spark, write_corpus(docs, fresh_path(spark, "dac"), name, end_id))
