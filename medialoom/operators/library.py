"""Mutations as pure functions: old snapshot(s) in, new snapshot(s) out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medialoom.functions import scalar as S
from medialoom.operators import scan
from medialoom.session import materialised

#: What a new walk overwrites; the other columns of a known path are kept.
WALKED = ("lib", "rel", "sub", "bytes", "mtime")


def newest(seen: DataFrame) -> DataFrame:
    """One row a path: the one with the latest mtime, ties to the largest in the order of the other columns."""
    rest = [c for c in seen.columns if c not in ("path", "mtime")]
    return seen.groupBy("path").agg(F.max(F.struct("mtime", *rest)).alias("r")).select(*[F.col("path") if c == "path" else F.col(f"r.{c}") for c in seen.columns])


def upsert(old: DataFrame, seen: DataFrame, now: int, top: int | None = None) -> DataFrame:
    """Files met by a walk into the media table, by path: known ones by a left join, new ones by an anti join over the same shuffles. A changed size or time resets state; ids of new rows follow the largest (top, where that is known), in the order of paths; a path met twice counts once, with its newest row."""
    seen = newest(seen)
    met = seen.select(F.col("path"), *[F.col(c).alias(f"n_{c}") for c in seen.columns if c != "path"], F.lit(True).alias("n_met"))
    top = old.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first()["top"] if top is None else top
    fresh = numbered(seen.join(old.select("path"), "path", "left_anti"), [F.col("path")], top)
    defaults = {"id": F.col("number"), "rating": F.lit(0), "fav": F.lit(0), "state": F.lit(0), "missing": F.lit(0), "added_at": F.lit(now), "facedone": F.lit(0), "orient": F.lit(1)}
    hit = F.col("n_met").isNotNull()
    changed = hit & ((F.col("bytes") != F.col("n_bytes")) | (F.col("mtime") != F.col("n_mtime")))

    def kept(c: str) -> Column:
        if c == "missing":
            return F.when(hit, F.lit(0)).otherwise(F.col(c))
        if c == "state":
            return F.when(changed, F.lit(0)).otherwise(F.col(c))
        return F.when(hit, F.col(f"n_{c}")).otherwise(F.col(c)) if c in WALKED and c in seen.columns else F.col(c)

    def made(c: str) -> Column:
        return F.col(c) if c in seen.columns and c != "id" else defaults.get(c, F.lit(None))

    typed = lambda value: [value(c).cast(old.schema[c].dataType).alias(c) for c in old.columns]
    return old.join(met, "path", "left").select(*typed(kept)).unionByName(fresh.select(*typed(made)))


def numbered(df: DataFrame, order: list[Column], after: int = 0) -> DataFrame:
    """number: after+1, after+2, ... in the order given. The rows are sorted in range partitions and written, so that places and sizes come from one evaluation; partitions are then ranked by their sizes, so no task sees all rows."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = materialised(placed, "numbered")  # the id has the partition above bit 33, the row in it below
    placed = placed.withColumn("part", F.shiftright("at", 33)).withColumn("k", F.col("at").bitwiseAND((1 << 33) - 1) + 1)
    sizes = placed.groupBy("part").agg(F.max("k").alias("n"))
    ahead = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))  # one row a partition
    return placed.join(F.broadcast(ahead), "part").withColumn("number", F.col("k") + F.col("ahead") + after).drop("at", "part", "k", "ahead")


def mark_missing(media: DataFrame, seen: DataFrame, lib: int) -> DataFrame:
    """Items of a library that a whole walk has not met: flagged, never dropped."""
    s = seen.select("path", F.lit(True).alias("met")).distinct()
    df = media.join(s, "path", "left")
    gone = (F.col("lib") == lib) & F.col("deleted").isNull() & F.col("met").isNull()
    return df.withColumn("missing", F.when(gone, 1).otherwise(F.col("missing")).cast(media.schema["missing"].dataType)).select(*media.columns)


def write_metadata(media: DataFrame, found: DataFrame) -> DataFrame:
    """Metadata by id: found values win where present; taken falls back to the probe's, and to the name's only if both are absent."""
    cols = [c for c in found.columns if c in media.columns and c != "id"]
    n = found.select("id", *[F.col(c).alias(f"n_{c}") for c in cols], F.lit(True).alias("n_met"))
    df = media.join(n, "id", "left")
    return df.select(*[(F.coalesce(f"n_{c}", c) if c in cols else F.when(F.col("n_met"), 1).otherwise(F.col(c)) if c == "state" else F.col(c)).cast(media.schema[c].dataType).alias(c) for c in media.columns])


def retry_failed(media: DataFrame, libs: list[int] | None = None, everything: bool = False) -> DataFrame:
    again = F.lit(True) if everything else F.col("state") == 2
    if libs is not None:
        again = again & F.col("lib").isin(*libs)
    return media.withColumns({"state": F.when(again, 0).otherwise(F.col("state")), "err": F.when(~again, F.col("err"))})


def rate(media: DataFrame, ids: DataFrame, rating: int | None = None, fav: bool | None = None) -> DataFrame:
    hit = F.col("_hit").isNotNull()
    df = media.join(ids.select("id", F.lit(True).alias("_hit")).distinct(), "id", "left")
    if rating is not None:
        df = df.withColumn("rating", F.when(hit, min(max(rating, 0), 5)).otherwise(F.col("rating")))
    if fav is not None:
        df = df.withColumn("fav", F.when(hit, int(fav)).otherwise(F.col("fav")))
    return df.select(*media.columns)


def to_bin(media: DataFrame, ids: DataFrame, now: int) -> DataFrame:
    """Soft delete of items that are not binned yet."""
    df = media.join(ids.select("id", F.lit(True).alias("_hit")).distinct(), "id", "left")
    hit = F.col("_hit").isNotNull() & F.col("deleted").isNull()
    df = df.withColumn("binpath", F.when(hit, F.concat_ws("__", F.col("id").cast("string"), "name")).otherwise(F.col("binpath")))
    return df.withColumn("deleted", F.when(hit, F.lit(now)).otherwise(F.col("deleted"))).select(*media.columns)


def restore(media: DataFrame, ids: DataFrame) -> DataFrame:
    df = media.join(ids.select("id", F.lit(True).alias("_hit")).distinct(), "id", "left")
    hit = F.col("_hit").isNotNull() & F.col("deleted").isNotNull()
    return df.withColumn("deleted", F.when(~hit, F.col("deleted"))).withColumn("binpath", F.when(~hit, F.col("binpath"))).select(*media.columns)


def purge(media: DataFrame, ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Media without the binned items (all of them, or those of ids), and one row: items and bytes freed."""
    gone = media.filter(F.col("deleted").isNotNull())
    if ids is not None:
        gone = gone.join(ids.select("id"), "id", "left_semi")
    return media.join(gone.select("id"), "id", "left_anti"), gone.agg(F.count("*").alias("items"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def purge_expired(media: DataFrame, now: int, days: int = 30) -> DataFrame:
    """Items binned more than `days` ago go; days <= 0 keeps all."""
    return media if days <= 0 else media.filter(F.col("deleted").isNull() | (F.col("deleted") >= now - days * 86400))


def prune_orphans(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Rows that point at nothing go, in the order in which one removal can orphan the next."""
    out, ids = dict(t), t["media"].select("id")
    for name, column in (("clip", "media"), ("faces", "media"), ("media_tags", "media_id"), ("collection_items", "media")):
        if name in out:
            out[name] = out[name].join(ids.withColumnRenamed("id", column), column, "left_semi").select(*t[name].columns)
    if "tags" in out:
        out["tags"] = out["tags"].join(out["media_tags"].select(F.col("tag_id").alias("id")), "id", "left_semi")
    if "people" in out:
        out["people"] = out["people"].join(out["faces"].select(F.col("cluster").alias("id")), "id", "left_semi")
    return out


# The colours that libraries take in turn.
LIBRARY_COLOURS = ["#4B79E4", "#E8A33D", "#B48CE0", "#3FA98A", "#5AA9E6", "#E86A9C"]


def add_libraries(libraries: DataFrame, new: DataFrame, now: int) -> DataFrame:
    """new: path, name (blank or NULL: the folder's). A known path takes the new name; others get ids after the largest and the next colours."""
    path = F.rtrim(F.translate("path", "\\", "/"), F.lit("/"))
    named = new.select(path.alias("path"), F.coalesce(F.when(F.trim("name") != "", F.col("name")), F.when(S.name_of(path) != "", S.name_of(path)), path).alias("n_name"))
    named = named.groupBy("path").agg(F.max("n_name").alias("n_name"))
    have = libraries.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"), F.count("*").alias("n")).first()
    fresh = numbered(named.join(libraries.select("path"), "path", "left_anti"), [F.col("path")])
    colour = F.element_at(F.array(*map(F.lit, LIBRARY_COLOURS)), ((F.col("number") - 1 + have["n"]) % len(LIBRARY_COLOURS) + 1).cast("int"))
    made = {"id": F.col("number") + have["top"], "path": F.col("path"), "name": F.col("n_name"), "color": colour, "added_at": F.lit(now)}
    rows = fresh.select(*[made.get(c, F.lit(None)).cast(libraries.schema[c].dataType).alias(c) for c in libraries.columns])
    known = libraries.join(named, "path", "left").withColumn("name", F.coalesce("n_name", "name")).select(*libraries.columns)
    return known.unionByName(rows)


def library_of(paths: DataFrame, libraries: DataFrame) -> DataFrame:
    """path and lib: the library that holds each path, the deepest if one lies in another; NULL if none does. Each path meets libraries by its own prefixes, so it is a join on equality."""
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    own = paths.select("path").distinct()
    hits = own.select("path", F.explode(prefixes).alias("root")).join(libraries.select(F.col("path").alias("root"), F.col("id").alias("lib")), "root")
    best = hits.groupBy("path").agg(F.max_by("lib", F.struct(F.length("root"), "root")).alias("lib"))
    return own.join(best, "path", "left").select("path", "lib")


def without_library(t: dict[str, DataFrame], lib: int) -> dict[str, DataFrame]:
    return prune_orphans(t | {"media": t["media"].filter(F.col("lib") != lib), "libraries": t["libraries"].filter(F.col("id") != lib)})


def with_excludes(t: dict[str, DataFrame], lib: int, excludes: list[str]) -> dict[str, DataFrame]:
    """Sets a library's excluded folders; what they hold leaves the media table."""
    hit = F.lit(False)
    for x in (e.strip().strip("/") for e in excludes):
        if x:
            hit = hit | S.in_subtree(F.col("rel"), x)
    libs = t["libraries"].withColumn("excludes", F.when(F.col("id") == lib, F.lit("\n".join(excludes))).otherwise(F.col("excludes")))
    return prune_orphans(t | {"libraries": libs, "media": t["media"].filter(~((F.col("lib") == lib) & hit))})


def upsert_keyed(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `new` replace those of `old` with the same keys (settings, thumbnails, vectors)."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def settings_read(kv: DataFrame, schema: str, defaults: dict) -> DataFrame:
    """k and the fields of its value v (JSON text) by a schema; a field that is missing, of another type, or in a text that is no JSON has its default."""
    value = F.from_json("v", schema).alias("_v")
    return kv.select(F.col("k").alias("_k"), value).select(F.col("_k").alias("k"), *[F.coalesce(F.col(f"_v.{c}"), F.lit(d)).alias(f"_{n}") for n, (c, d) in enumerate(defaults.items())]).toDF("k", *defaults)


def replace_faces(faces: DataFrame, media: DataFrame, new: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Faces of the items done are replaced, never appended; these items are marked done, also without faces."""
    out = faces.join(done.select(F.col("id").alias("media")), "media", "left_anti").select(*faces.columns).unionByName(new.select(*faces.columns))
    marked = media.join(done.select("id", F.lit(True).alias("_d")).distinct(), "id", "left").withColumn("facedone", F.when(F.col("_d"), 1).otherwise(F.col("facedone"))).select(*media.columns)
    return out, marked


def relink_tags(tags: DataFrame, media_tags: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """new: media_id, name, score. Unknown names join the dictionary; an item's links are replaced."""
    top = tags.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first()["top"]
    unknown = new.select("name").distinct().join(tags, "name", "left_anti")
    all_tags = tags.select("id", "name").unionByName(numbered(unknown, [F.col("name")], top).select(F.col("number").cast("long").alias("id"), "name"))
    links = new.join(all_tags.withColumnRenamed("id", "tag_id"), "name").select("media_id", "tag_id", "score")
    return all_tags, media_tags.join(new.select("media_id").distinct(), "media_id", "left_anti").select("media_id", "tag_id", "score").unionByName(links)


def reset_models(t: dict[str, DataFrame], what: str) -> dict[str, DataFrame]:
    """What models found, forgotten so that they run again: `faces` (faces, people and their marks), `tags` (vectors and tag links), or `people` (the groups alone)."""
    if what == "faces":
        return t | {"faces": t["faces"].filter("false"), "people": t["people"].filter("false"), "media": t["media"].withColumn("facedone", F.lit(0).cast(t["media"].schema["facedone"].dataType))}
    if what == "tags":
        return t | {"clip": t["clip"].filter("false"), "media_tags": t["media_tags"].filter("false")}
    if what == "people":
        return t | {"faces": t["faces"].withColumn("cluster", F.lit(None).cast(t["faces"].schema["cluster"].dataType)), "people": t["people"].filter("false")}
    raise ValueError(what)


def replace_originals(media: DataFrame, made: DataFrame, now: int) -> DataFrame:
    """made: id, bytes, and w, h where known: originals replaced by smaller files (which are not taken if they are not smaller). Size and time follow, hashes go, and the item waits for its metadata again."""
    cols = [c for c in ("w", "h") if c in made.columns]
    n = made.groupBy("id").agg(F.min_by(F.struct(F.col("bytes").alias("n_bytes"), *[F.col(c).alias(f"n_{c}") for c in cols]), "bytes").alias("n")).select("id", "n.*")
    df = media.join(n, "id", "left")
    hit = F.coalesce((F.col("n_bytes") < F.col("bytes")) & F.col("deleted").isNull(), F.lit(False))
    new = {"bytes": F.col("n_bytes"), "mtime": F.lit(now), "state": F.lit(0), "hash": F.lit(None), "dhash": F.lit(None)} | {c: F.coalesce(f"n_{c}", c) for c in cols}
    return df.select(*[(F.when(hit, new[c]).otherwise(F.col(c)) if c in new else F.col(c)).cast(media.schema[c].dataType).alias(c) for c in media.columns])


def free_names(new: DataFrame, taken: DataFrame, keys: list[str], order: str = "id") -> DataFrame:
    """new with `name` made free among the names of the same keys (a folder) in `taken` and in new itself: name, stem (1).ext, stem (2).ext, ... in the order given.

    The rows of one folder and name are numbered t = 0, 1, ...; the numbers in use u, in order, have
    u - (those below) free ones below them. Row t takes the number t + (in use with at most t free
    ones below): one more running count, over rows and numbers in use together. All three counts are segmented scans, so a folder of
    any number of equal names costs no more than others. `order` tells rows apart; the other columns of new stay out of the scans.
    """
    group, pattern = [*keys, "_plain"], r" \(([1-9]\d*)\)(\.[^.]*)?$"
    rows = new.select(*keys, order, F.col("name").alias("_plain"))
    plain = F.col("name").alias("_plain")
    every = taken.select(*keys, "name").unionByName(new.select(*keys, "name"))  # new ones can have a number too
    counted = every.select(*keys, F.regexp_replace("name", pattern, "$2").alias("_plain"), F.regexp_extract("name", pattern, 1).try_cast("long").alias("_n")).filter("_n is not null")
    used = taken.select(*keys, plain, F.lit(0).cast("long").alias("_n")).unionByName(counted)
    used = used.join(rows.select(*group).distinct(), group, "left_semi").distinct()
    free = scan.running(used, group, [F.col("_n")], F.lit(1), "_below").select(*group, (F.col("_n") - F.col("_below")).alias("_t"), F.lit(0).alias("_row"), F.lit(None).cast(new.schema[order].dataType).alias(order))
    turns = scan.running(rows, group, [F.col(order)], F.lit(1), "_t").select(*group, "_t", F.lit(1).alias("_row"), order)
    both = scan.running(free.unionByName(turns), group, [F.col("_t"), F.col("_row")], 1 - F.col("_row"), "_used").filter("_row = 1")
    n, old = F.col("_t") + F.col("_used"), F.col("_plain")
    name = F.when(n == 0, old).otherwise(F.concat(S.stem_of(old), F.lit(" ("), n.cast("string"), F.lit(")"), S.suffix_of(old)))
    return new.join(both.select(order, name.alias("_name")), order).withColumn("name", F.col("_name")).select(*new.columns)


def edited_copies(media: DataFrame, edits: DataFrame, now: int) -> DataFrame:
    """edits: id, bytes: each edit, a JPEG, becomes an item of its own beside the original, named stem-edited.jpg, or the next free name."""
    made = edits.join(media.drop("bytes"), "id").withColumn("name", F.concat(S.stem_of(F.col("name")), F.lit("-edited.jpg")))
    made = made.withColumns({c: v for c, v in (("ext", F.lit("jpg")), ("kind", F.lit(S.PHOTO))) if c in media.columns})
    rows = free_names(made, media, ["lib", "sub"]).withColumn("mtime", F.lit(now)).withColumn("state", F.lit(0)).drop("id")
    rows = rows.withColumns({c: F.concat(S.parent_of(F.col(c)), F.when(S.parent_of(F.col(c)) != "", "/").otherwise(""), F.col("name")) for c in ("path", "rel") if c in media.columns})
    top = media.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first()["top"]
    new = numbered(rows, [F.col("lib"), F.col("sub"), F.col("name")], top).withColumn("id", F.col("number"))
    fresh = {"hash": F.lit(None), "dhash": F.lit(None), "fav": F.lit(0), "rating": F.lit(0), "added_at": F.lit(now), "facedone": F.lit(0)}
    return media.unionByName(new.select(*[fresh.get(c, F.col(c)).cast(media.schema[c].dataType).alias(c) for c in media.columns]))


def backfill_hashes(media: DataFrame, digests: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Digests of active items that lack one: `digests` maps (path, bytes) of these alone to (path, hash), as `ranges.digests` does; where it gives null, the item goes on lacking one."""
    wanted = media.filter(F.col("hash").isNull() & F.col("deleted").isNull() & (F.col("missing") == 0)).select("path", "bytes")
    made = materialised(digests(wanted).select("path", F.col("hash").alias("_h")), "digests")
    return media.join(made, "path", "left").withColumn("hash", F.coalesce("hash", "_h")).select(*media.columns)
