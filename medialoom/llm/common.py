"""What several corpus operators share: the shared folder, sizing, word splitting and hashing."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medialoom.session import remove, shared_dir, ship

#: Bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
#: They are just the bytes that bytes.split() splits at.
WORD = r"[^\x20\x09-\x0D]+"
#: Inputs of this many bytes a core have enough splits.
SPLIT_BYTES = 128 * 2**20


#: Paths written within the scratch scopes that are open, the innermost last.
_SCOPES: list[list[str]] = []


def fresh_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing else uses."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


def saved(df: DataFrame, what: str) -> DataFrame:
    """Writes a frame to the shared folder and reads it back: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Deletes what `saved` wrote, once nothing reads it any more."""
    for df in frames:
        if getattr(df, "saved_at", None):
            remove(df.sparkSession, df.saved_at)


@contextmanager
def scratch(spark: SparkSession):
    """What is written to the shared folder in this scope is deleted at its end; write the result elsewhere before."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            remove(spark, path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def documents_of(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (and `more` columns, where present) alone, so that other columns cannot clash with an operator's own."""
    ship(docs.sparkSession)
    have = set(docs.columns)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[c for c in more if c in have])


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts."""
    return docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]


def parts_for(spark: SparkSession, total_bytes: int, part_bytes: int, least: int = 1) -> int:
    """How many parts of about part_bytes the bytes make, `least` times the shuffle partitions at least."""
    return max(1, least * shuffle_partitions(spark), math.ceil(total_bytes / part_bytes))


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt round over all cores, where a small input lies in fewer files than there are cores; any other input as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(2 * cores) if size < cores * SPLIT_BYTES and 0 < len(df.inputFiles()) < cores else df


def binary_array(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


# ---------------------------------------------------------------- words and their hashes

#: What each kind of operator keeps in a Python worker between tasks: name -> how to let it go.
_KEPT: dict[str, Callable[[], None]] = {}


def keeps(name: str, forget: Callable[[], None]) -> None:
    _KEPT[name] = forget


def claim(name: str) -> None:
    """Called when an operator begins in a worker: what other kinds of operators have kept there goes, so that a job of many stages needs no more memory than its largest."""
    for other, forget in _KEPT.items():
        if other != name:
            forget()


_SEPARATES = np.zeros(256, bool)
_SEPARATES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: How much of an 8-byte load belongs to a word of 0..8 bytes.
_KEEP = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
_LONG = 64


def words_of(text: bytes, strip: bytes = b"") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word of a text begins and ends, without the bytes of `strip` at either end, and its 64-bit hash: eight bytes of all words at a time; words over _LONG bytes one by one."""
    x = np.frombuffer(text, np.uint8)
    edge = np.diff((~_SEPARATES[x]).view(np.int8), prepend=np.int8(0), append=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if strip:
        off = np.isin(np.arange(256), list(strip))
        for at, step, last in ((start, 1, 0), (end, -1, 1)):
            some = np.arange(len(start))
            for _ in range(_LONG):
                some = some[(start[some] < end[some]) & off[x[np.minimum(at[some] - last, len(x) - 1)]]]
                at[some] += step
            for i in some.tolist():  # long runs, one by one
                word = text[start[i] : end[i]]
                at[i] += step * (len(word) - len(word.rstrip(strip) if last else word.lstrip(strip)))
    length = end - start
    h = mixed(length.astype(np.uint64) + np.uint64(0x51ED270B))
    loads = np.ndarray(len(text) + 1, "<u8", text + bytes(8), strides=(1,))
    left = np.flatnonzero(length <= _LONG)
    for at in range(0, _LONG, 8):
        left = left[length[left] > at]
        if not len(left):
            break
        part = loads[start[left] + at] & _KEEP[np.minimum(length[left] - at, 8)]
        h[left] = mixed(h[left] ^ part)
    for i in np.flatnonzero(length > _LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(text[start[i] : end[i]])
    return start, end, h


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser: spreads the information of each 64-bit value over all its bits."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        x = x ^ (x >> np.uint64(29))
        x = x * np.uint64(0x9E3779B97F4A7C15)
        return x ^ (x >> np.uint64(32))


def gram_hashes(h: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """A 64-bit hash for each run of n consecutive words, from the words' hashes; empty if there are fewer than n words."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        base = np.uint64(2 * (0x5851F42D4C957F2D // (seed + 1)) + 1)
        out = h[:m].copy()
        for j in range(1, n):  # Horner: depends on every word and on the order
            out *= base
            out ^= out >> np.uint64(31)
            out += h[j : j + m]
        return mixed(out)


_LOWER_TABLE = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def ascii_lower(b: bytes) -> bytes:
    """A-Z to a-z; all other bytes stay."""
    return b.translate(_LOWER_TABLE)


# ---------------------------------------------------------------- files in any store

def file_system(uri: str):
    """pyarrow's file system of a URI and the path within it; works for local, HDFS and object stores."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)
