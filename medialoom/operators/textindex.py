"""A stored index of trigrams of names, paths, cameras and tags, for searches that read some of it in place of all media.

A pattern's literal parts (what lies between % and _) have trigrams that every match has in one of
its texts, so the ids that have all of them are a superset of the hits, and the search verifies these by LIKE.
Postings (trigram, id) lie in buckets by a hash of the trigram; a search reads the buckets of the CHOSEN rarest
trigrams of its pattern.  Patterns without three literal characters in a row are searched by a scan.

An item's tags are not spelt out for it: names have the trigrams of each tag once, links (tag, id) lie in
buckets by the tag, and a search reads the links of tags that have all of its trigrams.

A commit's changed rows add their postings as a folder of its own.  What was true of a row before
may stay in the index, as it only makes candidates.
"""

from __future__ import annotations

import re
import uuid
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialoom.functions import scalar as S
from medialoom.sources.catalog import Catalog

BUCKETS, SALTS = 256, 4
#: How many of a pattern's trigrams are looked up.
CHOSEN = 4
FIELDS = ("name", "rel", "camera")


def trigrams(text: Column) -> Column:
    """The distinct trigrams of a text, ASCII case folded."""
    t = S.ascii_lower(text)
    return F.when(F.length(t) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(t) - 2), lambda i: F.substr(t, i, F.lit(3)))))


def of_pattern(text: str) -> list[str]:
    """The trigrams that whatever matches a search text has."""
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text.strip())
    return sorted({part[i : i + 3] for part in re.split("[%_]", folded) for i in range(len(part) - 2)})


def bucket_of(gram: str) -> int:
    return zlib.crc32(gram.encode()) % BUCKETS


def _placed(df: DataFrame, by: str = "gram") -> DataFrame:
    return df.withColumn("bucket", (F.crc32(F.col(by).cast("string").cast("binary")) % BUCKETS).cast("int"))


class TextIndex:
    """An index in a catalog. `told` has the trigrams and buckets that the last search read."""

    def __init__(self, catalog: Catalog, name: str):
        self.catalog, self.spark, self.name, self.told = catalog, catalog.spark, name, {}

    def add(self, rows: DataFrame, tags: DataFrame | None = None, media_tags: DataFrame | None = None) -> None:
        """Postings of new or changed rows (id, and what there is of name, rel and camera), and of their tags."""
        every = F.concat(F.array().cast("array<string>"), *[F.coalesce(trigrams(F.col(c)), F.array()) for c in FIELDS if c in rows.columns])
        own = rows.select("id", F.explode(F.array_distinct(every)).alias("gram"))
        folder = f"v-{uuid.uuid4().hex}"
        at = f"{self.catalog.root}/{self.name}/{folder}"
        salt = F.pmod(F.xxhash64("id"), F.lit(SALTS))
        _placed(own).repartition("bucket", salt).write.partitionBy("bucket").parquet(f"{at}/postings")
        held = self.spark.read.schema("gram string, id long, bucket int").parquet(f"{at}/postings").select("gram", "bucket")
        if tags is not None:
            links = media_tags.select(F.col("tag_id").cast("long").alias("tag_id"), F.col("media_id").alias("id")).join(rows.select("id"), "id", "left_semi")
            _placed(links, "tag_id").repartition("bucket", salt).write.partitionBy("bucket").parquet(f"{at}/links")
            linked = self.spark.read.schema("id long, tag_id long, bucket int").parquet(f"{at}/links").select("tag_id").distinct()
            named = tags.select(F.col("id").cast("long").alias("tag_id"), F.explode(trigrams(F.col("name"))).alias("gram")).join(linked, "tag_id", "left_semi")
            _placed(named).repartition("bucket").write.partitionBy("bucket").parquet(f"{at}/names")
            held = held.unionByName(self.spark.read.schema("gram string, tag_id long, bucket int").parquet(f"{at}/names").select("gram", "bucket"))
        held.groupBy("bucket", "gram").agg(F.count("*").alias("n")).repartition("bucket").write.partitionBy("bucket").parquet(f"{at}/counts")
        number = (self.catalog.pointer(self.name) or (0,))[0] + 1
        self.catalog.point(self.name, number, {"folders": [*self._folders(), folder], "tagged": self._folders(tagged=True) + [folder] * (tags is not None)})

    def _folders(self, tagged: bool = False) -> list[str]:
        return (self.catalog.pointer(self.name) or (0, {}))[1].get("tagged" if tagged else "folders", [])

    def _read(self, what: str, schema: str, grams: list[str]) -> DataFrame:
        out = self.spark.createDataFrame([], schema)
        buckets = sorted({bucket_of(g) for g in grams})
        for folder in self._folders(what == "names"):
            rows = self.spark.read.schema(f"{schema}, bucket int").parquet(f"{self.catalog.root}/{self.name}/{folder}/{what}")
            out = out.unionByName(rows.filter(F.col("bucket").isin(*buckets) & F.col("gram").isin(*grams)).drop("bucket"))
        return out

    def candidates(self, text: str) -> DataFrame | None:
        """id of every row that can match a search text, and maybe others, some more than once; None where the text has no trigram."""
        grams = of_pattern(text)
        if not grams:
            return None
        n = {r["gram"]: r["n"] for r in self._read("counts", "gram string, n long", grams).groupBy("gram").agg(F.sum("n").alias("n")).collect()}  # the pattern's trigrams
        rare = sorted(grams, key=lambda g: (n.get(g, 0), g))[:CHOSEN]
        self.told = {"trigrams": rare, "buckets": sorted({bucket_of(g) for g in rare}), "postings": sum(n.get(g, 0) for g in rare)}
        having = lambda df, of: df.groupBy(of).agg(F.countDistinct("gram").alias("k")).filter(F.col("k") == len(rare)).select(of)
        found = having(self._read("postings", "gram string, id long", rare), "id")
        tags = _placed(having(self._read("names", "gram string, tag_id long", rare), "tag_id"), "tag_id")
        for folder in self._folders(tagged=True):
            links = self.spark.read.schema("id long, tag_id long, bucket int").parquet(f"{self.catalog.root}/{self.name}/{folder}/links")
            found = found.unionByName(links.join(tags, ["bucket", "tag_id"], "left_semi").select("id"))
        return found
