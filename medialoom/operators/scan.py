"""Segmented prefix scans: running sums, places, runs and neighbours along an order, within groups of any size.

Rows are sorted into range partitions by group and order, so that a group of any size lies in as
many partitions as it fills.  Each partition is scanned on its own and written once; its edges (first and last
group and what they add up to) are one row, and a fold over these rows gives what each partition
has before and after it.  Only a partition's first group can begin earlier, and only its last one
can go on, so finishing is a broadcast of one row a partition.

Keys are equal if all their columns are, nulls included.  A partition's keys and long columns are held
in its task; there are spark.sql.shuffle.partitions of them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialoom.session import materialised, ship

_NOTHING = object()


def _sorted(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    ship(df.sparkSession)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*map(F.col, keys), *order]
    return df.repartitionByRange(n, *by).sortWithinPartitions(*by)


def _differs(column: pa.ChunkedArray) -> np.ndarray:
    """Whether each value but the first differs from the one before; nulls are equal."""
    a, b = column.slice(1), column.slice(0, max(len(column) - 1, 0))
    return pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy().astype(bool)


def _begins(table: pa.Table, columns: list[str]) -> np.ndarray:
    """Where a row differs from the one before in any of the columns; the first row always."""
    out = np.zeros(table.num_rows, bool)
    out[:1] = True
    for c in columns:
        out[1:] |= _differs(table.column(c))
    return out


def _schema(df: DataFrame, more: str) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [more])


def _local(scan: Callable[[pa.Table, int], pa.Table]):
    """A task's whole partition through `scan`; empty ones give nothing."""

    def run(batches):
        parts = [b for b in batches if b.num_rows]
        if parts:
            yield from scan(pa.Table.from_batches(parts), TaskContext.get().partitionId()).to_batches(max_chunksize=100_000)

    return run


def _with(table: pa.Table, **more: np.ndarray) -> pa.Table:
    for name, values in more.items():
        table = table.append_column(name, values if isinstance(values, pa.Array) else pa.array(values))
    return table


def _joined(rows: DataFrame, carries: list[tuple], columns: str) -> DataFrame:
    """What the fold gave each partition, beside its rows: a row for each partition is broadcast."""
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(carries, f"_part int, {columns}")), "_part")


def _key(keys: list[str]) -> Column:
    return F.struct(F.lit(0).alias("_zero"), *keys)


def running(df: DataFrame, keys: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """df with `name`: the sum of a long value over the rows before, within the rows of equal keys."""

    def scan(t: pa.Table, part: int) -> pa.Table:
        new = _begins(t, keys)
        v = t.column("_own").to_numpy()
        before = np.cumsum(v) - v
        seg = np.cumsum(new) - 1
        return _with(t, _part=np.full(len(v), part, np.int32), _at=np.arange(len(v)), _seg=seg, _before=before - before[np.flatnonzero(new)][seg])

    rows = _sorted(df, keys, order).withColumn("_own", value.cast("long"))
    made = materialised(rows.mapInArrow(_local(scan), _schema(rows, "_part int, _at long, _seg long, _before long")), "running")
    edges = made.groupBy("_part").agg(
        F.min_by(_key(keys), "_at").alias("first"), F.max_by(_key(keys), "_at").alias("last"), F.max("_seg").alias("segs"), F.max_by(F.col("_before") + F.col("_own"), "_at").alias("sum")
    )
    carries, key, before = [], _NOTHING, 0
    for e in sorted(edges.collect(), key=lambda e: e["_part"]):  # a row for each partition
        carry = before if e["first"] == key else 0
        carries.append((e["_part"], carry))
        key, before = e["last"], e["sum"] + (carry if e["segs"] == 0 else 0)
    out = _joined(made, carries, "_carry long")
    return out.withColumn(name, F.col("_before") + F.when(F.col("_seg") == 0, F.col("_carry")).otherwise(0)).select(*df.columns, name)


def places(df: DataFrame, keys: list[str], order: list[Column], name: str = "place") -> DataFrame:
    """df with `name`: 1, 2, ... along the order, within the rows of equal keys."""
    return running(df, keys, order, F.lit(1), name).withColumn(name, F.col(name) + 1)


def runs(df: DataFrame, keys: list[str], order: list[Column], by: str, measure: str) -> DataFrame:
    """keys, run (1, 2, ... along the order), `by`, items, least and greatest measure of each run of rows of equal keys and `by`. A run that spans partitions is one: tasks give a row for each of theirs, and rows of one run are added up."""

    def scan(t: pa.Table, part: int) -> pa.Table:
        group = _begins(t, keys)
        starts = np.flatnonzero(group | _begins(t, [by]))
        seg = (np.cumsum(group) - 1)[starts]
        opens = group[starts]
        k = np.arange(len(starts)) - np.flatnonzero(opens)[seg] + 1
        v = t.column(measure)
        some = pc.is_valid(v).to_numpy().astype(bool)
        low, high = (v.fill_null(x).to_numpy() for x in (np.iinfo(np.int64).max, np.iinfo(np.int64).min))
        empty = pa.array(np.add.reduceat(some.astype(np.int64), starts) == 0)
        least, most = (pc.if_else(empty, pa.scalar(None, pa.int64()), pa.array(f.reduceat(x, starts))) for f, x in ((np.minimum, low), (np.maximum, high)))
        out = t.select([*keys, by]).take(pa.array(starts))
        return _with(out, _part=np.full(len(starts), part, np.int32), _at=np.arange(len(starts)), _seg=seg, _k=k, items=np.diff(np.append(starts, t.num_rows)), least=least, most=most)

    rows = _sorted(df, keys, order).select(*keys, by, F.col(measure).cast("long").alias(measure))
    made = materialised(rows.mapInArrow(_local(scan), _schema(rows.drop(measure), "_part int, _at long, _seg long, _k long, items long, least long, most long")), "runs")
    ends = F.struct(_key(keys).alias("key"), F.struct(by).alias("by"), "_k")
    carries, key, last, before = [], _NOTHING, None, 0
    for e in sorted(made.groupBy("_part").agg(F.min_by(ends, "_at").alias("first"), F.max_by(ends, "_at").alias("last"), F.max("_seg").alias("segs")).collect(), key=lambda e: e["_part"]):
        goes_on = e["first"]["key"] == key
        carry = before - (e["first"]["by"] == last) if goes_on else 0
        carries.append((e["_part"], carry))
        key, last, before = e["last"]["key"], e["last"]["by"], e["last"]["_k"] + (carry if e["segs"] == 0 else 0)
    run = F.col("_k") + F.when(F.col("_seg") == 0, F.col("_carry")).otherwise(0)
    whole = _joined(made, carries, "_carry long").withColumn("run", run).groupBy(*keys, "run")
    return whole.agg(F.first(by).alias(by), F.sum("items").alias("items"), F.min("least").alias("least"), F.max("most").alias("most"))


def beside(df: DataFrame, keys: list[str], order: list[Column], col: str, reach: int) -> DataFrame:
    """keys, the long `col`, prev and next (its value in the rows before and after), and near: how many rows of the group stand within `reach` on either side."""

    def scan(t: pa.Table, part: int) -> pa.Table:
        new = _begins(t, keys)
        n, seg, starts = t.num_rows, np.cumsum(new) - 1, np.flatnonzero(new)
        ends = np.append(starts[1:], t.num_rows)
        at = np.arange(n)
        v = t.column(col).combine_chunks()
        here = lambda index, ok: pc.if_else(pa.array(ok), v.take(pa.array(np.clip(index, 0, n - 1))), pa.scalar(None, pa.int64()))
        return _with(t, _part=np.full(n, part, np.int32), _at=at, _seg=seg, _before=at - starts[seg], _after=ends[seg] - 1 - at, prev=here(at - 1, ~new), next=here(at + 1, np.append(~new[1:], False)))

    rows = _sorted(df, keys, order).select(*keys, F.col(col).cast("long").alias(col))
    made = materialised(rows.mapInArrow(_local(scan), _schema(rows, "_part int, _at long, _seg long, _before long, _after long, prev long, next long")), "beside")
    end = F.struct(_key(keys).alias("key"), F.col(col).alias("v"), "_before", "_after")
    edges = sorted(made.groupBy("_part").agg(F.min_by(end, "_at").alias("first"), F.max_by(end, "_at").alias("last"), F.max("_seg").alias("segs")).collect(), key=lambda e: e["_part"])
    back, key, v, count = [], _NOTHING, None, 0
    for e in edges:
        goes_on = e["first"]["key"] == key
        back.append((count, v) if goes_on else (0, None))
        key, v, count = e["last"]["key"], e["last"]["v"], e["last"]["_before"] + 1 + (back[-1][0] if e["segs"] == 0 else 0)
    ahead, key, v, count = [], _NOTHING, None, 0
    for e in reversed(edges):
        goes_on = e["last"]["key"] == key
        ahead.append((count, v) if goes_on else (0, None))
        key, v, count = e["first"]["key"], e["first"]["v"], e["first"]["_after"] + 1 + (ahead[-1][0] if e["segs"] == 0 else 0)
    carries = [(e["_part"], e["segs"], *b, *a) for e, b, a in zip(edges, back, reversed(ahead))]
    out = _joined(made, carries, "_segs long, _back long, _prev long, _ahead long, _next long")
    first, last = F.col("_seg") == 0, F.col("_seg") == F.col("_segs")
    before = F.col("_before") + F.when(first, F.col("_back")).otherwise(0)
    after = F.col("_after") + F.when(last, F.col("_ahead")).otherwise(0)
    edge = lambda local, ok, carried: F.when(ok, F.col(carried)).otherwise(F.col(local))
    return out.select(
        *keys, col, edge("prev", first & (F.col("_before") == 0), "_prev").alias("prev"), edge("next", last & (F.col("_after") == 0), "_next").alias("next"), (F.least(before, F.lit(reach)) + F.least(after, F.lit(reach))).alias("near")
    )
