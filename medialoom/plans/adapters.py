"""The generic test tables seen as a media library (Spark), and the same views as SQL text for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medialoom.session import table


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as media items; the folder is region/nation/segment of the customer."""
    o, c, n, r = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    i, ts = F.col("o_orderkey"), F.unix_timestamp("o_orderdate")
    kind = (i % 4).cast("int")
    places = n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"])  # 25 rows
    df = o.join(c, o["o_custkey"] == c["c_custkey"]).join(F.broadcast(places), c["c_nationkey"] == n["n_nationkey"])
    ext = F.element_at(F.array(*map(F.lit, ("jpg", "mp4", "cr2", "psd"))), kind + 1)
    codec = F.when(kind == 1, F.element_at(F.array(*map(F.lit, ("h264", "hevc", "mjpeg"))), (i % 3).cast("int") + 1))
    return df.select(
        i.alias("id"), F.col("o_custkey").alias("lib"), F.when(i % 5 != 0, ts).alias("taken"), (ts + 3600).alias("mtime"), F.round(F.col("o_totalprice") * 100).cast("long").alias("bytes"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("rating"), kind.alias("kind"), (i % 7 == 0).cast("int").alias("fav"), F.when(F.col("o_orderstatus") == "P", ts).alias("deleted"),
        F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "F", 1).otherwise(2).alias("state"), F.concat_ws("/", "r_name", "n_name", "c_mktsegment").alias("sub"),
        (i % 13 == 0).cast("int").alias("missing"), ext.alias("ext"), F.concat(F.lit("IMG_"), i.cast("string"), F.lit("."), ext).alias("name"), codec.alias("vcodec"),
        F.when((kind == 1) & (i % 2 == 1), "aac").alias("acodec"), F.when(i % 11 != 0, (i % 6000 + 400).cast("int")).alias("w"), F.when(i % 11 != 0, (i % 4000 + 300).cast("int")).alias("h"),
        F.when(kind == 1, (i % 4000) / 10.0).alias("dur"), (i % 3).cast("int").alias("facedone"), (ts + i % 100).alias("added_at"),
    )


MEDIA_SQL = """media AS (
  SELECT o_orderkey AS id, o_custkey AS lib, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(epoch(o_orderdate) AS BIGINT) END AS taken, CAST(epoch(o_orderdate) AS BIGINT) + 3600 AS mtime,
    CAST(round(o_totalprice * 100) AS BIGINT) AS bytes, CAST(left(o_orderpriority, 1) AS INTEGER) AS rating, CAST(o_orderkey % 4 AS INTEGER) AS kind, CAST(o_orderkey % 7 = 0 AS INTEGER) AS fav,
    CASE WHEN o_orderstatus = 'P' THEN CAST(epoch(o_orderdate) AS BIGINT) END AS deleted, CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 ELSE 2 END AS state,
    r_name || '/' || n_name || '/' || c_mktsegment AS sub, CAST(o_orderkey % 13 = 0 AS INTEGER) AS missing, CASE o_orderkey % 4 WHEN 0 THEN 'jpg' WHEN 1 THEN 'mp4' WHEN 2 THEN 'cr2' ELSE 'psd' END AS ext,
    'IMG_' || o_orderkey || '.' || CASE o_orderkey % 4 WHEN 0 THEN 'jpg' WHEN 1 THEN 'mp4' WHEN 2 THEN 'cr2' ELSE 'psd' END AS name,
    CASE WHEN o_orderkey % 4 = 1 THEN CASE o_orderkey % 3 WHEN 0 THEN 'h264' WHEN 1 THEN 'hevc' ELSE 'mjpeg' END END AS vcodec, CASE WHEN o_orderkey % 4 = 1 AND o_orderkey % 2 = 1 THEN 'aac' END AS acodec,
    CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 6000 + 400 END AS w, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 4000 + 300 END AS h,
    CASE WHEN o_orderkey % 4 = 1 THEN (o_orderkey % 4000) / 10.0::DOUBLE END AS dur, o_orderkey % 3 AS facedone, CAST(epoch(o_orderdate) AS BIGINT) + o_orderkey % 100 AS added_at
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""
ACTIVE_SQL = "deleted IS NULL AND missing = 0"


def documents_as_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.col("source").alias("name"), F.col("lang").alias("ext"), F.col("n_chars").alias("bytes"), F.sha2("text", 256).alias("hash"),
        (F.col("doc_id") % 1000).alias("mtime"), F.lit(None).cast("long").alias("deleted"), F.lit(0).alias("missing"))


def libraries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))


def tags(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(tags, media_tags): part names as tags of orders, scored by the largest quantity (whole numbers)."""
    p, li = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    names = p.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id"))
    linked = li.join(p, li["l_partkey"] == p["p_partkey"]).join(names, p["p_name"] == names["name"])
    return names.select("id", "name"), linked.groupBy(F.col("l_orderkey").alias("media_id"), F.col("id").alias("tag_id")).agg(F.max("l_quantity").alias("score"))


TAGS_SQL = """tags AS (SELECT min(p_partkey) AS id, p_name AS name FROM part GROUP BY p_name),
media_tags AS (SELECT l_orderkey AS media_id, t.id AS tag_id, max(l_quantity) AS score FROM lineitem JOIN part ON l_partkey = p_partkey JOIN tags t ON t.name = p_name GROUP BY 1, 2)"""


def collections(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(collections, items): suppliers, and the orders with their lines; ord follows the first ship date."""
    s, li = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "lineitem")
    heads = s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 10 == 0, F.col("s_suppkey")).alias("cover"))
    first = li.groupBy(F.col("l_suppkey").alias("coll"), F.col("l_orderkey").alias("media")).agg(F.min(F.unix_timestamp("l_shipdate")).alias("added"))
    return heads, first.select("coll", "media", (F.col("added") % 1000).alias("ord"), "added")


COLLECTIONS_SQL = """collections AS (SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_suppkey % 10 = 0 THEN s_suppkey END AS cover FROM supplier),
items AS (SELECT coll, media, added % 1000 AS ord, added FROM (SELECT l_suppkey AS coll, l_orderkey AS media, CAST(epoch(min(l_shipdate)) AS BIGINT) AS added FROM lineitem GROUP BY 1, 2))"""


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), (F.col("vec_id") % 97).alias("media"), F.col("label").cast("long").alias("cluster"), F.col("embedding").alias("vec"), ((F.col("vec_id") * 37) % 101 / 101.0).alias("score"))


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("id")).distinct()
    return e.select("id", F.when(F.col("id") % 3 == 0, "").otherwise(F.concat(F.lit("person "), F.col("id").cast("string"))).alias("name"), (F.col("id") == 7).cast("int").alias("hidden"))


PEOPLE_SQL = """faces AS (SELECT vec_id AS id, vec_id % 97 AS media, CAST(label AS BIGINT) AS cluster, embedding AS vec, (vec_id * 37) % 101 / 101.0::DOUBLE AS score FROM embeddings),
people AS (SELECT DISTINCT CAST(label AS BIGINT) AS id, CASE WHEN label % 3 = 0 THEN '' ELSE 'person ' || label END AS name, CAST(label = 7 AS INTEGER) AS hidden FROM embeddings)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a timeline of each user."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("lib"), F.unix_timestamp("ts").alias("ts"), "event_type", "value")


EVENTS_SQL = "ev AS (SELECT event_id AS id, user_id AS lib, CAST(floor(epoch(ts)) AS BIGINT) AS ts, event_type, value FROM events)"
