"""Files read by byte ranges: heads, and digests of files of any size.

A task reads the bytes it is given and no others, so a head costs its own length, and a large file is
digested by many tasks.  A file of one block has the SHA-256 of its content as its digest; of a longer one, blocks of BLOCK bytes
are digested apart, and the digest is the SHA-256 of theirs in order.  Blocks are cut by place,
so equal files get equal digests however tasks are split.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialoom.session import ship

BLOCK = 64 << 20
#: Bytes that are held at a time.
PIECE = 4 << 20


def opened(path: str):
    """A file of any store that pyarrow knows, by URI or local path; Spark's file:/x is file:///x."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path[5:].lstrip("/"))
    if "://" not in path:
        return fs.LocalFileSystem().open_input_file(path)
    at, inner = fs.FileSystem.from_uri(path)
    return at.open_input_file(inner)


def _spread(files: DataFrame, *keys) -> DataFrame:
    ship(files.sparkSession)
    return files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def heads(files: DataFrame, n: int = 131072) -> DataFrame:
    """path and head, the first n bytes, of each file (column path); a file that is gone or cannot be read has none (null)."""

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    with opened(path) as f:
                        head = f.read(n)
                except OSError:
                    head = None
                yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([head], pa.binary())], ["path", "head"])

    return _spread(files.select("path"), "path").mapInArrow(run, "path string, head binary")


def digests(files: DataFrame, block: int = BLOCK) -> DataFrame:
    """path and hash of each file (path, and bytes as a walk tells). A file that is gone, or has not these bytes any more, has none (null): it waits for the next walk."""

    def run(batches):
        for batch in batches:
            for path, number, size in zip(*(batch.column(k).to_pylist() for k in range(3))):
                digest, left = hashlib.sha256(), min(block, size - number * block)
                try:
                    with opened(path) as f:
                        fits = f.size() == size
                        f.seek(number * block)
                        while fits and left > 0:
                            piece = f.read(min(PIECE, left))
                            digest.update(piece)
                            left -= len(piece)
                            fits = bool(piece)
                except OSError:
                    fits = False
                yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([number], pa.int64()), pa.array([digest.digest() if fits else None], pa.binary())], ["path", "block", "digest"])

    last = F.floor(F.greatest(F.col("bytes") - 1, F.lit(0)) / block)
    parts = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"), F.col("bytes").cast("long").alias("bytes")).distinct()
    made = _spread(parts, "path", "block").mapInArrow(run, "path string, block long, digest binary")
    own = made.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("block", "digest"))).alias("d"), F.count_if(F.col("digest").isNull()).alias("lost"))  # 32 bytes a block
    whole = F.aggregate("d", F.lit(b""), lambda a, x: F.concat(a, x["digest"]))
    one = F.lower(F.hex(F.get("d", F.lit(0))["digest"]))
    return own.select("path", F.when(F.col("lost") > 0, F.lit(None)).when(F.size("d") == 1, one).otherwise(F.sha2(whole, 256)).alias("hash"))
