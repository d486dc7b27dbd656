"""Duplicates, storage and reclaim reports, compression targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialoom.functions import scalar as S
from medialoom.operators.media import active
from medialoom.session import materialised

VIDEO_WORTH = 4_000_000


def candidates(media: DataFrame, key: str) -> DataFrame:
    """Active items that have the key."""
    return media.filter(active() & F.col(key).isNotNull() & (F.lit(True) if key == "hash" else F.col(key) != 0))


def duplicate_groups(media: DataFrame, key: str = "hash") -> DataFrame:
    """The groups of two or more active items that share a key (hash: equal files; dhash: equal looks): n, freed (bytes of all but the keeper) and keeper (the largest, then the newest, then the smallest id). What frees most comes first when ordered by (freed descending, key)."""
    best = F.max(F.struct("bytes", "mtime", (-F.col("id")).alias("minus_id")))
    groups = candidates(media, key).groupBy(key).agg(F.count("*").alias("n"), F.sum("bytes").alias("b"), best.alias("best")).filter("n > 1")
    return groups.select(key, "n", (F.col("b") - F.col("best.bytes")).alias("freed"), (-F.col("best.minus_id")).alias("keeper"))


def duplicates(media: DataFrame, key: str = "hash") -> DataFrame:
    """Items that share a key, with keep and freed of their group (see duplicate_groups).

    The groups come from one groupBy with partial aggregation, so a key that holds many rows is
    reduced before the shuffle. They are written before they are joined back: a join straight above
    an aggregate over the same key could not be split, one of two shuffles can.
    """
    groups = materialised(duplicate_groups(media, key), "duplicates")
    out = candidates(media, key).select(key, "id", "bytes").join(groups.hint("merge"), key)
    return out.select(key, "id", "bytes", (F.col("id") == F.col("keeper")).alias("keep"), "n", "freed")


def duplicate_summary(media: DataFrame, key: str = "dhash") -> DataFrame:
    return duplicate_groups(media, key).agg(F.count("*").alias("groups"), F.coalesce(F.sum("freed"), F.lit(0)).cast("long").alias("freed"))


def extra_copies(media: DataFrame, key: str = "hash") -> DataFrame:
    return duplicates(media, key).filter(~F.col("keep")).select("id")


def by_kind(media: DataFrame) -> DataFrame:
    """Count and bytes of each kind, zeros included."""
    n = media.filter(active()).groupBy("kind").agg(F.count("*").alias("n"), F.sum("bytes").alias("b"))
    names = media.sparkSession.createDataFrame([(0, "photo"), (1, "video"), (2, "raw"), (3, "layered")], "kind int, label string")
    return F.broadcast(names).join(n, "kind", "left").select("kind", "label", F.coalesce("n", F.lit(0)).cast("long").alias("items"), F.coalesce("b", F.lit(0)).cast("long").alias("bytes"))


def breakdown(media: DataFrame, cache_bytes: int = 0, model_bytes: int = 0) -> DataFrame:
    """label, items and bytes of the storage report's seven rows, in one pass: the kinds of active items, cache, models, and the bin."""
    gone = F.col("deleted").isNotNull()
    kinds = [("photo", S.PHOTO), ("video", S.VIDEO), ("raw", S.RAW), ("layered", S.LAYERED)]
    tests = [(label, active() & (F.col("kind") == k)) for label, k in kinds] + [("bin", gone)]
    one = media.agg(*[x for label, t in tests for x in (F.count_if(t).alias(f"n_{label}"), F.coalesce(F.sum(F.when(t, F.col("bytes"))), F.lit(0)).cast("long").alias(f"b_{label}"))])
    fixed = [("cache", F.lit(0).cast("long"), F.lit(cache_bytes).cast("long")), ("models", F.lit(0).cast("long"), F.lit(model_bytes).cast("long"))]
    rows = [(label, F.col(f"n_{label}"), F.col(f"b_{label}")) for label, _ in tests]
    rows = rows[:4] + fixed + rows[4:]
    packed = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(label).alias("label"), n.alias("items"), b.alias("bytes")) for i, (label, n, b) in enumerate(rows)])
    return one.select(F.inline(packed))


def reclaimable(media: DataFrame) -> DataFrame:
    """id, items and bytes of the report's four rows of what could be freed: look-alikes, oversized photos, videos to encode again, and the bin."""
    r = reclaim(media)
    bin_ = media.filter(F.col("deleted").isNotNull()).agg(F.count("*").alias("items"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"))
    rows = [
        duplicate_summary(media, "dhash").select(F.lit("duplicates").alias("id"), F.col("groups").alias("items"), F.col("freed").alias("bytes")),
        r.select(F.lit("oversized"), "n_oversized", F.col("oversized_saving").cast("long")),
        r.select(F.lit("video"), "n_video", F.col("video_saving").cast("long")),
        bin_.select(F.lit("bin"), "items", "bytes"),
    ]
    return rows[0].union(rows[1]).union(rows[2]).union(rows[3])


def reclaim(media: DataFrame) -> DataFrame:
    """Oversized photos and re-encodable videos: items, bytes to save; the average photo and whether to suggest action. One pass."""
    ok, photo = active(), F.col("kind") == S.PHOTO
    big = ok & photo & S.oversized(F.col("bytes"), F.col("w"), F.col("h"))
    saving = S.video_saving(F.col("vcodec"), F.col("bytes"))
    video = ok & (F.col("kind") == S.VIDEO) & (saving > VIDEO_WORTH)
    still = ok & (F.col("kind") != S.VIDEO)
    one = media.agg(
        F.count_if(big).alias("n_oversized"), F.coalesce(F.sum(F.when(big, S.photo_saving(F.col("bytes"), F.col("w"), F.col("h")))), F.lit(0)).alias("oversized_saving"),
        F.count_if(video).alias("n_video"), F.coalesce(F.sum(F.when(video, saving)), F.lit(0)).alias("video_saving"),
        F.count_if(still).alias("n_still"), F.sum(F.when(still, F.col("bytes"))).alias("still_bytes"),
    )
    avg = F.when(F.col("n_still") > 0, F.col("still_bytes") / F.col("n_still") / 1048576.0).otherwise(0.0)
    return one.select("n_oversized", "oversized_saving", "n_video", "video_saving", F.round(avg, 6).alias("avg_photo_mb"), ((avg > 4.5) & (F.col("n_oversized") > 20)).alias("suggest"))


def compress_targets(media: DataFrame, what: str = "oversized", skip_rated: bool = True, limit: int | None = None, ids: list[int] | None = None) -> DataFrame:
    """Largest first; filters come before the limit, so it plans as a top-k. selection: the items of `ids` that are not binned, in the order asked for."""
    if what == "selection":
        asked = F.array(*[F.lit(i).cast("long") for i in ids or []])
        df = media.filter(F.col("deleted").isNull() & F.col("id").isin(*(ids or []))).orderBy(F.array_position(asked, F.col("id").cast("long")))
        return df if limit is None else df.limit(limit)
    df = media.filter(active())
    if what == "video":
        df = df.filter((F.col("kind") == S.VIDEO) & (S.video_saving(F.col("vcodec"), F.col("bytes")) > VIDEO_WORTH))
    else:
        df = df.filter((F.col("kind") == S.PHOTO) & S.oversized(F.col("bytes"), F.col("w"), F.col("h")))
    if skip_rated:
        df = df.filter(F.col("rating") < 4)
    df = df.orderBy(F.desc("bytes"), "id")
    return df if limit is None else df.limit(limit)


def compress_estimate(media: DataFrame, what: str = "oversized", sample: int = 12, **options) -> DataFrame:
    """Targets and bytes, and what would be saved if all shrank like the `sample` largest."""
    t = compress_targets(media, what, **options)
    after = F.col("bytes") - (S.video_saving(F.col("vcodec"), F.col("bytes")) if what == "video" else S.photo_saving(F.col("bytes"), F.col("w"), F.col("h")))
    head = t.limit(sample).agg(F.sum("bytes").alias("before"), F.sum(after).alias("after"))
    total = t.agg(F.count("*").alias("items"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    ratio = F.coalesce(F.col("after") / F.col("before"), F.lit(1.0))
    both = total.withColumn("one", F.lit(1)).join(head.withColumn("one", F.lit(1)), "one")  # one row each
    return both.select("items", "bytes", F.round(ratio, 9).alias("ratio"), F.floor(F.col("bytes") * (1 - F.round(ratio, 9))).alias("saving"))
