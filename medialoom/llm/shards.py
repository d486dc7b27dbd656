"""Uniform shuffling into shards of exact sizes, by a hypergeometric communication matrix.

Rows are written once, numbered within their partitions.  The driver then draws how many rows
of each partition go to each shard, so that every shard gets its exact size (counts at most one
apart); the joint law is that of a uniform permutation cut into shards, a multivariate
hypergeometric one.  It is drawn as follows, for any number of rows (direct samplers end at
10**9): independent multinomial counts, then of each shard with too many rows as many distinct
rows as are too many, all equally likely, which in random order fill the shards with too few.
Every step treats all rows alike and the sizes are fixed, so every arrangement is equally likely.
Only about the square root of the number of rows is moved that way.

Permuted locally: the task that reads a partition's rows deals them its drawn labels in random
order, and each row a random key.  Exchanged: a shard is cut into cells by ranges of the key, of
about CELL_BYTES each, and a cell is a partition of the exchange.  Permuted again: a cell's rows
are ordered by their keys; slots follow from that order and from the sizes of the cells
before, which the keys fix without reading any row.  Labels and keys come from seeds and row numbers, so a
task that is repeated gives the same.

The matrix has 8 bytes a partition and shard; inputs of more partitions than MATRIX_BYTES allow
are read with several to a task.

Law: `rows`.  Each row is placed on its own, so neither equal texts nor equal ids stay together,
and hot ones are dealt like any others.  Defined results: null ids and texts are rows like any
other; repeated rows each have a slot; with fewer rows than shards the first shards have one
each; an empty table gives an empty one; texts of any length are moved whole; other columns, whatever their
names, come back inside `doc`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from medialoom.llm.common import saved, shuffle_partitions, spread
from medialoom.session import ship

MATRIX_BYTES = 64 << 20
#: Bytes of a cell, as written.
CELL_BYTES = 16 << 20
_PLACE = 33  # the number of a partition is above this bit of a row's number


def communication_matrix(counts: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """How many rows of each partition (of so many rows each) go to each shard: a uniform draw among all arrangements with shard sizes at most one apart, the larger ones first."""
    total = int(counts.sum())
    sizes = total // shards + (np.arange(shards) < total % shards)
    if not total:
        return np.zeros((len(counts), shards), np.int64)
    m = rng.multinomial(counts, np.full(shards, 1 / shards))
    spare = m.sum(axis=0) - sizes
    leaving = [np.empty(0, np.int64)]
    for j in np.flatnonzero(spare > 0):
        ends = np.cumsum(m[:, j])
        rows = rng.choice(int(ends[-1]), int(spare[j]), replace=False, shuffle=False)
        leaving.append(np.searchsorted(ends, rows, "right"))
        m[:, j] -= np.bincount(leaving[-1], minlength=len(m))
    leaving, at = rng.permutation(np.concatenate(leaving)), 0
    for j in np.flatnonzero(spare < 0):
        m[:, j] += np.bincount(leaving[at : at - spare[j]], minlength=len(m))
        at -= spare[j]
    return m


def dealt(part: int, goes: np.ndarray, cells: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Cell and key of each row of a partition whose rows go to the shards so often."""
    rng = np.random.default_rng([seed, 1, part])
    shard = rng.permutation(np.repeat(np.arange(len(goes)), goes))
    key = rng.integers(0, 2**63 - 1, len(shard), endpoint=True)
    return shard * cells + np.minimum((key / 2.0**63 * cells).astype(np.int64), cells - 1), key


def shuffled(docs: DataFrame, shards: int = 8, seed: int = 42) -> DataFrame:
    """shard (from 0), slot (from 0 in each shard, gapless) and doc (all columns) of each row; partitions hold a shard's rows by ranges of slots, in order."""
    spark = docs.sparkSession
    ship(spark)
    rows = spread(docs).coalesce(max(1, MATRIX_BYTES // (8 * shards))).select(F.struct("*").alias("doc"))
    rows = saved(rows.withColumn("row", F.monotonically_increasing_id()), "numbered-rows")
    found = rows.groupBy(F.shiftright("row", _PLACE).alias("part")).count().collect()  # a row for each partition
    counts = np.zeros(max((p for p, _ in found), default=-1) + 1, np.int64)
    for part, n in found:
        counts[part] = n
    matrix = communication_matrix(counts, shards, np.random.default_rng([seed, 0]))
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cells = max(math.ceil(shuffle_partitions(spark) / shards), math.ceil(size / shards / CELL_BYTES))
    ahead = _ahead(spark, matrix, cells, seed)

    @F.pandas_udf("cell int, key long, ahead long")
    def place(ids: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        now, cell, key = -1, np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in ids:
            x = batch.to_numpy(np.int64)
            part, at = x >> _PLACE, x & ((1 << _PLACE) - 1)
            out = np.empty((2, len(x)), np.int64)
            cuts = [*np.flatnonzero(np.diff(part, prepend=-1)).tolist(), len(x)]
            for lo, hi in zip(cuts, cuts[1:]):
                if part[lo] != now:
                    now = int(part[lo])
                    cell, key = dealt(now, matrix[now], cells, seed)
                out[:, lo:hi] = cell[at[lo:hi]], key[at[lo:hi]]
            yield pd.DataFrame({"cell": out[0].astype(np.int32), "key": out[1], "ahead": ahead[out[0]]})

    placed = rows.withColumn("to", place("row")).select("doc", "row", "to.cell", "to.key", "to.ahead").repartitionById(shards * cells, F.col("cell"))
    slot = F.col("ahead") + F.row_number().over(Window.partitionBy("cell").orderBy("key", "row")) - 1
    return placed.select(F.floor(F.col("cell") / cells).cast("int").alias("shard"), slot.cast("long").alias("slot"), "doc")


def _ahead(spark, matrix: np.ndarray, cells: int, seed: int) -> np.ndarray:
    """For each cell how many rows its shard has in the cells before: counted from labels and keys alone."""
    shards = matrix.shape[1]

    def run(batches):
        total = np.zeros(shards * cells, np.int64)
        for batch in batches:
            for part in batch.column(0).to_pylist():
                total += np.bincount(dealt(part, matrix[part], cells, seed)[0], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["cell", "n"])

    n = np.zeros(shards * cells, np.int64)
    parts = spark.range(0, len(matrix), 1, max(1, min(len(matrix), shuffle_partitions(spark))))
    for cell, k in parts.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # a row for each cell
        n[cell] = k
    by_shard = n.reshape(shards, cells)
    return (np.cumsum(by_shard, axis=1) - by_shard).reshape(-1)


def report(docs: DataFrame, shards: int = 8, seed: int = 42) -> DataFrame:
    """doc_id, size (bytes of the text plus 1), text_crc32, law, shard, slot and grown_shard (null under this law), read off the shuffled rows."""
    text = F.coalesce(F.col("doc.text").cast("string"), F.lit("")).cast("binary")
    return shuffled(docs, shards, seed).select(
        F.col("doc.doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(docs: DataFrame, folder: str, shards: int = 8, seed: int = 42) -> None:
    """A Parquet folder shard=0, shard=1, ... with slot and doc, the rows of a file in the order of their slots."""
    shuffled(docs, shards, seed).write.partitionBy("shard").parquet(folder)
