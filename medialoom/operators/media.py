"""Serving queries over the media table: filtered and sorted listing, details, counters, people."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medialoom.functions import scalar as S
from medialoom.operators.library import numbered
from medialoom.operators.textindex import TextIndex

#: Fixed value: how many items a grid asks for.
LIST_LIMIT = 400_000


def active() -> Column:
    return F.col("deleted").isNull() & (F.col("missing") == 0)


def effective_time() -> Column:
    return F.coalesce(F.col("taken"), F.col("mtime"))


def effective_path() -> Column:
    return F.coalesce(F.col("binpath"), F.col("path"))


NAMED_FILTERS = {
    "fav": lambda: F.col("fav") == 1,
    "video": lambda: F.col("kind") == S.VIDEO,
    "photo": lambda: F.col("kind") == S.PHOTO,
    "raw": lambda: F.col("kind").isin(S.RAW, S.LAYERED),
    "unrated": lambda: F.col("rating") == 0,
    "rated": lambda: F.col("rating") >= 4,
    "error": lambda: F.col("state") == 2,
}


#: What the orders look at besides id; any other order is by time.
SORT_COLUMNS = {"name": ("name",), "name_desc": ("name",), "size": ("bytes",), "size_asc": ("bytes",), "rating": ("rating", "taken", "mtime"), "added": ("added_at",), "shuffle": ()}


def sort_keys(sort: str) -> list[Column]:
    """Every order ends with id, so it is total."""
    t, i, name = effective_time(), F.col("id"), S.ascii_lower(F.col("name"))
    return {
        "oldest": [t.asc(), i.asc()],
        "name": [name.asc(), i.asc()],
        "name_desc": [name.desc(), i.asc()],
        "size": [F.col("bytes").desc(), i.asc()],
        "size_asc": [F.col("bytes").asc(), i.asc()],
        "rating": [F.col("rating").desc(), t.desc(), i.asc()],
        "added": [F.col("added_at").desc(), i.desc()],
        "shuffle": [((i * 2654435761) % 1000003).asc(), i.asc()],
    }.get(sort, [t.desc(), i.desc()])


@dataclass
class MediaQuery:
    """The listing: all conditions are optional and conjunctive; they become filters of one plan. limit: none, or how many items there are at most (a grid asks for LIST_LIMIT)."""

    bin: bool = False
    lib: int | None = None
    coll: int | None = None
    person: int | None = None
    sub: str | None = None
    filter: str | None = None
    text: str | None = None
    sort: str = "newest"
    limit: int | None = None
    tables: dict[str, DataFrame] = field(default_factory=dict)  # collection_items, faces, tags, media_tags
    index: TextIndex | None = None  # of the rows and tags: a text search then looks at its candidates alone

    def rows(self, media: DataFrame) -> DataFrame:
        df = media.filter(F.col("missing") == 0).filter(F.col("deleted").isNotNull() if self.bin else F.col("deleted").isNull())
        if self.lib is not None:
            df = df.filter(F.col("lib") == self.lib)
        if self.sub:
            df = df.filter(S.in_subtree(F.col("sub"), self.sub))
        if self.filter in NAMED_FILTERS:
            df = df.filter(NAMED_FILTERS[self.filter]())
        if self.coll is not None:
            df = df.join(self.tables["collection_items"].filter(F.col("coll") == self.coll).select(F.col("media").alias("id")), "id", "left_semi")
        if self.person is not None:
            df = df.join(self.tables["faces"].filter(F.col("cluster") == self.person).select(F.col("media").alias("id")), "id", "left_semi")
        if self.text and self.text.strip():
            df = self._searched(df, self.text.strip())
        return df

    def _searched(self, df: DataFrame, text: str) -> DataFrame:
        near = self.index.candidates(text) if self.index is not None else None
        df = df if near is None else df.join(near, "id", "left_semi")
        hit = F.lit(False)
        for c in ("name", "rel", "camera"):
            if c in df.columns:
                hit = hit | F.coalesce(S.like_ci(F.col(c), text), F.lit(False))
        if "tags" not in self.tables:
            return df.filter(hit)
        named = self.tables["tags"].filter(S.like_ci(F.col("name"), text)).select(F.col("id").alias("tag_id"))
        tagged = self.tables["media_tags"].join(named, "tag_id", "left_semi").select(F.col("media_id").alias("id")).distinct().withColumn("by_tag", F.lit(True))
        return df.join(tagged, "id", "left").filter(hit | F.coalesce("by_tag", F.lit(False))).drop("by_tag")

    def listing(self, media: DataFrame) -> DataFrame:
        """id, ts, fl, dur, w, h: what a grid draws, in order. orderBy and limit plan as one top-k."""
        ordered = self.rows(media).orderBy(*sort_keys(self.sort))
        return drawn(ordered if self.limit is None else ordered.limit(self.limit))


def drawn(media: DataFrame) -> DataFrame:
    """What a grid draws of each item."""
    native = S.plays_natively(F.col("ext"), F.col("vcodec"), F.col("acodec"))
    fl = S.pack_flags(F.col("kind"), F.col("fav"), F.col("rating"), F.col("state"), native)
    return media.select("id", effective_time().alias("ts"), fl.alias("fl"), F.round(F.coalesce("dur", F.lit(0.0))).cast("long").alias("dur"), "w", "h")


def columnar(listing: DataFrame, order: str = "pos") -> DataFrame:
    """One row of parallel arrays from a listing with a position column, and their length (total). It is one value, so the listing must have a limit."""
    packed = F.array_sort(F.collect_list(F.struct(order, *[c for c in listing.columns if c != order])))
    one = listing.agg(packed.alias("rows"))
    return one.select(F.size("rows").alias("total"), *[F.col(f"rows.{c}").alias(c) for c in listing.columns if c != order])


# ---------------------------------------------------------------- counters

def library_counts(libraries: DataFrame, media: DataFrame) -> DataFrame:
    """Active items and bytes of every library, zeros included: aggregated before the join."""
    n = media.filter(active()).groupBy("lib").agg(F.count("*").alias("n"), F.sum("bytes").alias("b"))
    out = libraries.join(n, libraries["id"] == n["lib"], "left")
    return out.select(libraries["id"], libraries["name"], F.coalesce("n", F.lit(0)).cast("long").alias("items"), F.coalesce("b", F.lit(0)).cast("long").alias("bytes"))


def state_counters(media: DataFrame) -> DataFrame:
    """All global counters in one pass. bin, missing and errors do not ask for active items."""
    ok = active()
    count = lambda c, name: F.count_if(c).alias(name)
    return media.agg(
        count(ok, "total"), F.coalesce(F.sum(F.when(ok, F.col("bytes"))), F.lit(0)).cast("long").alias("bytes"), count(ok & (F.col("fav") == 1), "fav"),
        count(ok & (F.col("kind") == S.VIDEO), "video"), count(ok & F.col("kind").isin(S.RAW, S.LAYERED), "raw"),
        count(F.col("deleted").isNotNull(), "bin"), count(F.col("missing") == 1, "missing"), count(F.col("state") == 2, "errors"),
        count((F.col("state") == 2) & F.col("ext").isin(*S.HEIC_EXTENSIONS), "heic_failed"),
    )


def model_counters(media: DataFrame, clip: DataFrame, faces: DataFrame, people: DataFrame) -> DataFrame:
    """Tagged, pending, faces, people and pending for faces, as one row."""
    done = clip.select(F.col("media").alias("id"), F.lit(1).alias("done")).distinct()
    ready = active() & (F.col("state") == 1)
    one = media.join(done, "id", "left").agg(
        F.count_if(active() & F.col("done").isNotNull()).alias("tagged"),
        F.count_if(ready & F.col("done").isNull()).alias("pending"),
        F.count_if(ready & (F.col("kind") != S.VIDEO) & (F.col("facedone") == 0)).alias("faces_pending"),
    )
    counts = faces.agg(F.count("*").alias("faces")).withColumn("one", F.lit(1)).join(people.filter("hidden = 0").agg(F.count("*").alias("people")).withColumn("one", F.lit(1)), "one")
    return one.withColumn("one", F.lit(1)).join(counts, "one").drop("one")


# ---------------------------------------------------------------- details

def top_tags(media_tags: DataFrame, tags: DataFrame, k: int = 12) -> DataFrame:
    """media_id, name, score, rank: the k best tags of each item (ties by tag id)."""
    w = Window.partitionBy("media_id").orderBy(F.desc("score"), F.asc("tag_id"))
    ranked = media_tags.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.join(tags.select(F.col("id").alias("tag_id"), "name"), "tag_id").select("media_id", "name", "score", "rank")


def memberships(collections: DataFrame, items: DataFrame) -> DataFrame:
    return items.join(collections.select(F.col("id").alias("coll"), "name"), "coll").select("media", "coll", "name")


def detail(media: DataFrame, libraries: DataFrame, faces: DataFrame, people: DataFrame) -> DataFrame:
    """Each item with its library's name, its number of faces and the names of the people in it."""
    who = faces.join(people.select(F.col("id").alias("cluster"), "name"), "cluster", "left")
    who = who.groupBy("media").agg(F.count("*").alias("faces"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("name") != "", F.col("name")))), ", ").alias("people"))
    out = media.join(libraries.select(F.col("id").alias("lib"), F.col("name").alias("library")), "lib").join(who.withColumnRenamed("media", "id"), "id", "left")
    return out.select("id", "library", effective_time().alias("ts"), F.coalesce("faces", F.lit(0)).cast("long").alias("faces"), F.coalesce("people", F.lit("")).alias("people"))


def people_stats(people: DataFrame, faces: DataFrame) -> DataFrame:
    """Visible people with distinct items and faces; rank: unnamed last, then by items."""
    n = faces.groupBy("cluster").agg(F.countDistinct("media").alias("items"), F.count("*").alias("faces"))
    out = people.filter("hidden = 0").join(n, people["id"] == n["cluster"]).select("id", "name", "items", "faces")
    return numbered(out, [(F.col("name") == "").asc(), F.desc("items"), F.asc("id")]).withColumnRenamed("number", "rank")


def pending(media: DataFrame, clip: DataFrame, what: str, limit: int) -> DataFrame:
    """The next items of a backlog: for thumbnails the newest files first, for models the newest items."""
    return backlog(media, clip, what).orderBy(*([F.desc("mtime"), F.desc("id")] if what == "thumb" else [F.desc("id")])).limit(limit)


def backlog(media: DataFrame, clip: DataFrame, what: str) -> DataFrame:
    """Items that a pass has still to do."""
    if what == "thumb":
        return media.filter((F.col("state") == 0) & (F.col("missing") == 0))
    ready = media.filter(active() & (F.col("state") == 1))
    if what == "face":
        return ready.filter((F.col("kind") != S.VIDEO) & (F.col("facedone") == 0))
    return ready.join(clip.select(F.col("media").alias("id")), "id", "left_anti")


def work_left(media: DataFrame, clip: DataFrame) -> DataFrame:
    """One row: whether each pass (thumb, face, clip) has anything left to do. One plan; each probe stops at its first row."""
    passes = ("thumb", "face", "clip")
    probes = [backlog(media, clip, w).limit(1).select(F.lit(w).alias("what")) for w in passes]
    met = probes[0].unionByName(probes[1]).unionByName(probes[2])
    return met.agg(*[(F.count_if(F.col("what") == w) > 0).alias(w) for w in passes])
