"""Archives written in parallel: stored zips as parts that, one after another, are the file.

A member's place follows from the sizes and names before it, a segmented running sum, so tasks
write members without waiting for each other: a part is the members that begin in PART_BYTES of an
archive, in one file, streamed piece by piece.  The directory, some 100 bytes a member, is the last part.
Sizes, places and counts beyond what 32 (or 16) bits hold are in zip64 records.

A task writes under a name of its own and returns it; parts of lost or repeated tasks are in no row.
A member whose file is gone, or has not its size any more, is an error.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medialoom.operators import scan
from medialoom.session import materialised, ship
from medialoom.sources.ranges import PIECE, opened

PART_BYTES = 256 << 20
# Fixed values of the format: the first of January 1980 and the flag of names in UTF-8.
DATE, UTF8 = 0x21, 0x800
# Bytes of a member's record and of its entry in the directory, without the name, and of the end record; the extra field of a member in zip64.
MEMBER, ENTRY, END, WIDE = 30, 46, 22, 20


@dataclass(frozen=True)
class Format:
    """The records of a stored zip. Values from `limit` on (and counts from `many` on) are written in zip64 records; the 32-bit (16-bit) field then holds its greatest value."""

    limit: int = 0xFFFFFFFF
    many: int = 0xFFFF

    def _large(self, *values: int) -> tuple[list[int], bytes]:
        """Each value as a 32-bit field, and the extra field with those that do not fit."""
        over = [v for v in values if v >= self.limit]
        return [0xFFFFFFFF if v >= self.limit else v for v in values], struct.pack(f"<HH{len(over)}Q", 1, 8 * len(over), *over) if over else b""

    def member(self, name: bytes, crc: int, size: int) -> bytes:
        (a, b), extra = self._large(size, size)
        return struct.pack("<4s5H3I2H", b"PK\3\4", 45 if extra else 20, UTF8, 0, 0, DATE, crc, a, b, len(name), len(extra)) + name + extra

    def entry(self, name: bytes, crc: int, size: int, offset: int) -> bytes:
        (a, b, c), extra = self._large(size, size, offset)
        version = 45 if extra else 20
        return struct.pack("<4s6H3I5H2I", b"PK\1\2", version, version, UTF8, 0, 0, DATE, crc, a, b, len(name), len(extra), 0, 0, 0, 0, c) + name + extra

    def end(self, n: int, size: int, offset: int) -> bytes:
        out, large = b"", n >= self.many or size >= self.limit or offset >= self.limit
        if large:
            out = struct.pack("<4sQ2H2I4Q", b"PK\6\6", 44, 45, 45, 0, 0, n, n, size, offset) + struct.pack("<4sIQI", b"PK\6\7", 0, offset + size, 1)
            n, size, offset = 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF
        return out + struct.pack("<4s4H2IH", b"PK\5\6", 0, 0, n, n, size, offset, 0)


def _pieces(path: str, size: int):
    """The bytes of a file, piece by piece."""
    with opened(path) as f:
        if f.size() != size:
            raise ValueError(f"{path} has {f.size()} bytes, not {size}")
        left = size
        while left:
            piece = f.read(min(PIECE, left))
            if not piece:
                raise ValueError(f"{path} ends early")
            left -= len(piece)
            yield piece


def _members(base: str, form: Format):
    """Writes the parts of a task and returns each member's part file and CRC."""

    def run(batches):
        from pyarrow import fs

        at, top = fs.FileSystem.from_uri(base)
        now, out, file = None, None, None
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if (r["coll"], r["part"]) != now:
                    if out:
                        out.close()
                    now, file = (r["coll"], r["part"]), f"{uuid.uuid4().hex}.part"
                    out = at.open_output_stream(f"{top}/{file}")
                pieces, crc = list(_pieces(r["path"], r["bytes"])) if r["bytes"] <= PIECE else None, 0
                for piece in pieces if pieces is not None else _pieces(r["path"], r["bytes"]):
                    crc = zlib.crc32(piece, crc)
                out.write(form.member(r["entry"].encode(), crc, r["bytes"]))
                for piece in pieces if pieces is not None else _pieces(r["path"], r["bytes"]):
                    out.write(piece)
                rows.append((r["coll"], r["part"], f"{base}/{file}", r["entry"], r["position"], r["bytes"], r["offset"], r["length"], crc))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 9, _TYPES)], _NAMES)
        if out:
            out.close()

    return run


_NAMES = ["coll", "part", "file", "entry", "position", "bytes", "offset", "length", "crc"]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]


def _directories(base: str, form: Format):
    """Writes each archive's directory and returns its file."""

    def run(batches):
        from pyarrow import fs

        at, top = fs.FileSystem.from_uri(base)
        now, out, done = None, None, []

        def closed():
            last = form.end(n, size, end)
            out.write(last)
            out.close()
            done.append((now, f"{base}/{file}", size + len(last), wide + len(last) - END))

        for batch in batches:
            for r in batch.to_pylist():
                if out is None or r["coll"] != now:
                    if out:
                        closed()
                    now, file, n, size, wide = r["coll"], f"{uuid.uuid4().hex}.part", 0, 0, 0
                    out = at.open_output_stream(f"{top}/{file}")
                name = r["entry"].encode()
                entry = form.entry(name, r["crc"], r["bytes"], r["offset"])
                out.write(entry)
                n, size, end, wide = n + 1, size + len(entry), r["offset"] + r["length"], wide + len(entry) - ENTRY - len(name)
        if out:
            closed()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done) if done else [[]] * 4, (pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["coll", "file", "bytes", "zip64"])

    return run


def written(manifest: DataFrame, folder: str, part_bytes: int = PART_BYTES, form: Format = Format()) -> DataFrame:
    """manifest: coll, entry, position, path and bytes of each member. Writes the archives' parts below a folder; coll, part (the order), file, offset and bytes of each, and how many of these bytes (zip64) are records that only large archives have."""
    spark = manifest.sparkSession
    ship(spark)
    base = (folder if "://" in folder or folder.startswith("file:") else "file://" + folder).rstrip("/")
    from pyarrow import fs

    at, top = fs.FileSystem.from_uri(base)
    at.create_dir(top, recursive=True)
    m = manifest.select("coll", "entry", F.col("position").cast("long").alias("position"), "path", F.col("bytes").cast("long").alias("bytes"))
    wide = F.when(F.col("bytes") >= form.limit, WIDE).otherwise(0)
    length = MEMBER + F.octet_length("entry") + wide + F.col("bytes")
    placed = scan.running(m.withColumn("length", length.cast("long")), ["coll"], [F.col("position")], F.col("length"), "offset")
    placed = placed.withColumn("part", F.floor(F.col("offset") / part_bytes))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kinds = "coll long, part long, file string, entry string, position long, bytes long, offset long, length long, crc long"
    members = materialised(placed.repartition(n, "coll", "part").sortWithinPartitions("coll", "part", "offset").mapInArrow(_members(base, form), kinds), "members")
    entries = members.select("coll", "entry", "position", "bytes", "offset", "length", "crc").repartition(n, "coll").sortWithinPartitions("coll", "position")
    ends = materialised(entries.mapInArrow(_directories(base, form), "coll long, file string, bytes long, zip64 long"), "directories")
    parts = members.groupBy("coll", "part", "file").agg(F.min("offset").alias("offset"), F.sum("length").alias("bytes"), F.sum(wide).alias("zip64"))
    last = members.groupBy("coll").agg((F.max("part") + 1).alias("part"), F.max(F.col("offset") + F.col("length")).alias("offset"))
    columns = ["coll", "part", "file", "offset", "bytes", "zip64"]
    return parts.select(*columns).unionByName(ends.join(last, "coll").select(*columns))


def put_together(spark: SparkSession, parts: DataFrame, folder: str) -> DataFrame:
    """Each archive as one file, export-<coll>.zip, for stores where parts cannot be served one after another: streamed, an archive by a task. coll, path and bytes."""
    base = (folder if "://" in folder or folder.startswith("file:") else "file://" + folder).rstrip("/")

    def run(batches):
        from pyarrow import fs

        at, top = fs.FileSystem.from_uri(base)
        now, out, done = None, None, []
        for batch in batches:
            for r in batch.to_pylist():
                if out is None or r["coll"] != now:
                    if out:
                        out.close()
                    now = r["coll"]
                    out = at.open_output_stream(f"{top}/export-{now}.zip")
                    done.append([now, f"{base}/export-{now}.zip", 0])
                for piece in _pieces(r["file"], r["bytes"]):
                    out.write(piece)
                done[-1][2] += r["bytes"]
        if out:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done) if done else [[]] * 3, (pa.int64(), pa.string(), pa.int64()))], ["coll", "path", "bytes"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return materialised(parts.select("coll", "part", "file", "bytes").repartition(n, "coll").sortWithinPartitions("coll", "part").mapInArrow(run, "coll long, path string, bytes long"), "archives")
