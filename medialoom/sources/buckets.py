"""The media table in hash buckets of the path: a write touches the buckets of what changed, and no others.

A version is a manifest: for each bucket the folder that holds its rows.  A commit writes the touched buckets
to a folder of its own and a new manifest that names it for them, so readers keep the version
they began with, and a commit costs what its buckets hold, whatever the table does.  The largest id is in the
manifest, so new rows get ids without a look at the table.  A second table, keys, tells the bucket
of an id: its parts are ranges of SPAN ids, to which a commit adds the ids that it made; writes by id read the parts of their ids alone.

Counters by library and folder are kept along (see operators.counters) where the table has the columns for them: a commit adds
the differences between the old and new rows of its buckets, and every COMPACT commits these are added up anew.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from medialoom.operators import counters, library
from medialoom.session import dropped, materialised
from medialoom.sources.catalog import Catalog

#: Ids of one part of the key table.
SPAN = 1 << 20
#: Commits whose differences are read one by one.
COMPACT = 16


class Buckets:
    """A media table (path and id among its columns) of a catalog, in `buckets` buckets, which a table keeps for life: choose them so that a bucket is some 10 to 100 MB."""

    def __init__(self, catalog: Catalog, name: str, schema: StructType, buckets: int = 1024):
        self.catalog, self.spark, self.name, self.schema = catalog, catalog.spark, name, schema
        now = catalog.pointer(name)
        self.buckets = now[1]["buckets"] if now else buckets
        self.counted = set(counters.COLUMNS) <= set(schema.names)

    def _now(self) -> tuple[int, dict]:
        return self.catalog.pointer(self.name) or (0, {"buckets": self.buckets, "top": 0, "data": {}, "keys": {}, "counts": []})

    def bucket_of(self, path: Column) -> Column:
        return F.pmod(F.xxhash64(path), F.lit(self.buckets)).cast("int")

    def _folders(self, folders: list[str], schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _rows(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        data = manifest["data"]
        held = sorted(data) if buckets is None else [str(b) for b in buckets if str(b) in data]
        return self._folders([f"{self.catalog.root}/{self.name}/{data[b]}/bucket={b}" for b in held], self.schema)

    def read(self) -> DataFrame:
        """The current version."""
        return self._rows(self._now()[1])

    def counts(self) -> DataFrame:
        """lib, sub and the measures of counters.measures of the current version."""
        return counters.added(self._counts(self._now()[1]["counts"]))

    def _counts(self, held: list[str]) -> DataFrame:
        kinds = ", ".join(f"{c} long" for c in counters.measures())
        lib, sub = (self.schema[c].dataType.simpleString() for c in ("lib", "sub"))
        return self._folders([f"{self.catalog.root}/{self.name}/{f}" for f in held], f"lib {lib}, sub {sub}, {kinds}")

    def replace(self, rows: DataFrame) -> None:
        """A whole table in place of what there is."""
        number, manifest = self._now()
        self._commit(number, manifest, list(range(self.buckets)), rows.select(*self.schema.names))

    def _commit(self, number: int, manifest: dict, touched: list[int], rows: DataFrame) -> list[int]:
        """Writes the rows of the touched buckets, and the keys of ids over the manifest's largest, and moves the pointer."""
        if not touched:
            return touched
        data = f"v-{uuid.uuid4().hex}"
        at = f"{self.catalog.root}/{self.name}/{data}"
        rows.withColumn("bucket", self.bucket_of(F.col("path"))).repartition(len(touched), "bucket").write.partitionBy("bucket").parquet(at)
        here = self._parts(at, "bucket")  # a bucket can have lost all rows
        after = {b: f for b, f in manifest["data"].items() if int(b) not in set(touched)} | dict.fromkeys(here, data)
        fresh = self._rows({"data": dict.fromkeys(here, data)}).filter(F.col("id") > manifest["top"]).select("id", "path")
        top = fresh.agg(F.max("id")).first()[0]
        keys = {k: list(v) for k, v in manifest["keys"].items()}
        if top is not None:
            made = fresh.select("id", self.bucket_of(F.col("path")).alias("bucket"), F.floor(F.col("id") / SPAN).alias("span"))
            made.repartition("span").write.partitionBy("span").parquet(f"{at}-keys")
            for span in self._parts(f"{at}-keys", "span"):
                keys.setdefault(span, []).append(f"{data}-keys")
        counts = list(manifest["counts"])
        if self.counted:
            changed = counters.differences(self._rows(manifest, touched), self._rows({"data": dict.fromkeys(here, data)}))
            whole = len(counts) >= COMPACT
            changed = counters.added(self._counts(counts).unionByName(changed)) if whole else changed
            changed.write.parquet(f"{at}-counts")
            counts = [f"{data}-counts"] if whole else [*counts, f"{data}-counts"]
        self.catalog.point(self.name, number + 1, {"buckets": self.buckets, "top": top or manifest["top"], "data": after, "keys": keys, "counts": counts})
        return touched

    def _parts(self, folder: str, column: str) -> list[str]:
        """Values of a partition column that a folder has."""
        fs, path = self.catalog._files()
        names = [s.getPath().getName() for s in fs.listStatus(path(folder))]
        return sorted(n.partition("=")[2] for n in names if n.startswith(f"{column}="))

    def _touched(self, df: DataFrame, bucket: Column) -> list[int]:
        return sorted(r["b"] for r in df.select(bucket.alias("b")).distinct().collect())  # one number a bucket at most

    def upsert(self, seen: DataFrame, now: int) -> list[int]:
        """library.upsert of the files met by a walk; which buckets were written: those of new and changed files. Of the others that were met, the paths and what a walk tells are read, and nothing is written."""
        number, manifest = self._now()
        seen = library.newest(seen)
        told = [c for c in library.WALKED if c in seen.columns and c in self.schema.names]
        old = self._rows(manifest, self._touched(seen, self.bucket_of(F.col("path"))))
        same = F.lit(True)
        for c in told:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        known = old.select("path", *[F.col(c).alias(f"_{c}") for c in told], (F.col("missing") == 0).alias("_here"))
        changed = materialised(seen.join(known, "path", "left").filter(~F.coalesce(same & F.col("_here"), F.lit(False))).select(*seen.columns), "changed")
        touched = self._touched(changed, self.bucket_of(F.col("path")))
        self._commit(number, manifest, touched, library.upsert(self._rows(manifest, touched), changed, now, manifest["top"]))
        dropped(changed)
        return touched

    def mark_missing(self, seen: DataFrame, lib: int) -> list[int]:
        """library.mark_missing: the rows to be flagged are found by path alone, and only their buckets written."""
        number, manifest = self._now()
        rows = self._rows(manifest)
        gone = library.mark_missing(rows, seen, lib).filter("missing = 1").join(rows.filter("missing = 1").select("path"), "path", "left_anti").select("path")
        gone = materialised(gone, "gone")
        touched = self._touched(gone, self.bucket_of(F.col("path")))
        old = self._rows(manifest, touched).join(gone.withColumn("_gone", F.lit(True)), "path", "left")
        flagged = old.withColumn("missing", F.when(F.col("_gone"), F.lit(1)).otherwise(F.col("missing")).cast(self.schema["missing"].dataType))
        self._commit(number, manifest, touched, flagged.select(*self.schema.names))
        dropped(gone)
        return touched

    def change(self, ids: DataFrame, made: Callable[[DataFrame], DataFrame]) -> list[int]:
        """A mutation that changes rows of some ids alone (column id): the buckets are looked up in the key table, and `made` maps their rows, which may only lose or change rows of these ids."""
        number, manifest = self._now()
        ids = materialised(ids.select(F.col("id").cast("long").alias("id")).distinct(), "ids")
        spans = self._touched(ids, F.floor(F.col("id") / SPAN))
        folders = [f"{self.catalog.root}/{self.name}/{f}/span={s}" for s in spans for f in manifest["keys"].get(str(s), [])]
        touched = self._touched(self._folders(folders, "id long, bucket int").join(ids, "id"), F.col("bucket"))
        self._commit(number, manifest, touched, made(self._rows(manifest, touched)).select(*self.schema.names))
        dropped(ids)
        return touched
