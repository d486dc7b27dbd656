"""The library's registered queries, each with its DuckDB oracle where SQL can express it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from medialoom.functions import images as I
from medialoom.functions import scalar as S
from medialoom.operators import folders, library, media as M, scan, sets, storage, timeline, vectors
from medialoom.plans import adapters as A
from medialoom.session import shared_dir, table

_QUERIES: dict = {}
_ORACLES: dict[str, str] = {}

NOW = 946_684_800  # 2000-01-01, a fixed present


def query(sql: str | None = None, *views: str):
    """Registers a query; sql is its oracle, after the named views."""

    def keep(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _ORACLES[f.__name__] = (f"WITH {', '.join(views)} " if views else "") + sql
        return f

    return keep


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rated media, newest first, with packed flags, each library's day runs beside them."""
    rows = M.MediaQuery(filter="rated").rows(A.media(spark, sf_dir))
    native = S.plays_natively(F.col("ext"), F.col("vcodec"), F.col("acodec"))
    fl = S.pack_flags(F.col("kind"), F.col("fav"), F.col("rating"), F.col("state"), native)
    listed = rows.select("lib", "id", M.effective_time().alias("ts"), fl.alias("fl"))
    runs = timeline.day_runs(listed, [F.desc("ts"), F.desc("id")], part="lib").select("lib", "day", F.col("items").alias("in_run"))
    return listed.withColumn("day", S.day_key(F.col("ts"))).join(runs, ["lib", "day"]).orderBy(F.desc("ts"), F.desc("id"))


_FL = "((kind & 3) | ((fav & 1) << 2) | ((rating & 7) << 3) | (CAST(state = 2 AS INTEGER) << 6) | (CAST(ext IN ('mp4','m4v','webm','mov') AND coalesce(vcodec IN ('h264','vp8','vp9','av1'), false) AND coalesce(acodec IN ('aac','mp3','opus','vorbis'), true) AS INTEGER) << 7))"


# ---------------------------------------------------------------- listing

@query(f"SELECT id, coalesce(taken, mtime) AS ts, CAST({_FL} AS INTEGER) AS fl, CAST(round(coalesce(dur, 0)) AS BIGINT) AS dur, CAST(w AS INTEGER) AS w, CAST(h AS INTEGER) AS h FROM media WHERE {A.ACTIVE_SQL}", A.MEDIA_SQL)
def media_newest_flags(spark, sf_dir):
    return M.MediaQuery().listing(A.media(spark, sf_dir))


@query(f"""SELECT f AS filter, CAST(count(*) AS BIGINT) AS items FROM media, (VALUES ('fav'), ('video'), ('photo'), ('raw'), ('unrated'), ('rated'), ('error')) v(f)
WHERE {A.ACTIVE_SQL} AND CASE f WHEN 'fav' THEN fav = 1 WHEN 'video' THEN kind = 1 WHEN 'photo' THEN kind = 0 WHEN 'raw' THEN kind IN (2, 3) WHEN 'unrated' THEN rating = 0 WHEN 'rated' THEN rating >= 4 ELSE state = 2 END GROUP BY f""", A.MEDIA_SQL)
def media_filter_each(spark, sf_dir):
    hits = F.array(*[F.when(c(), F.lit(name)) for name, c in M.NAMED_FILTERS.items()])
    return A.media(spark, sf_dir).filter(M.active()).select(F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("filter")).groupBy("filter").agg(F.count("*").alias("items"))


@query(f"""SELECT id, name FROM media WHERE {A.ACTIVE_SQL} AND (name ILIKE '%g_77%' OR id IN (SELECT media_id FROM media_tags JOIN tags ON tags.id = tag_id WHERE tags.name ILIKE '%small r%'))""", A.MEDIA_SQL, A.TAGS_SQL)
def media_search_text(spark, sf_dir):
    tags, links = A.tags(spark, sf_dir)
    m = A.media(spark, sf_dir)
    return M.MediaQuery(text="G_77", tables={"tags": tags.filter("false"), "media_tags": links}).rows(m).select("id", "name").unionByName(
        M.MediaQuery(text="Small R", tables={"tags": tags, "media_tags": links}).rows(m).select("id", "name")).distinct()


@query(f"SELECT id, sub FROM media WHERE {A.ACTIVE_SQL} AND (sub = 'ASIA' OR starts_with(sub, 'ASIA/'))", A.MEDIA_SQL)
def media_subtree(spark, sf_dir):
    return M.MediaQuery(sub="ASIA").rows(A.media(spark, sf_dir)).select("id", "sub")


@query(f"SELECT id FROM media WHERE {A.ACTIVE_SQL} AND id IN (SELECT media FROM items WHERE coll = 3)", A.MEDIA_SQL, A.COLLECTIONS_SQL)
def media_in_collection(spark, sf_dir):
    return M.MediaQuery(coll=3, tables={"collection_items": A.collections(spark, sf_dir)[1]}).rows(A.media(spark, sf_dir)).select("id")


@query(f"SELECT id FROM media WHERE {A.ACTIVE_SQL} AND id IN (SELECT media FROM faces WHERE cluster = 2)", A.MEDIA_SQL, A.PEOPLE_SQL)
def media_has_person(spark, sf_dir):
    return M.MediaQuery(person=2, tables={"faces": A.faces(spark, sf_dir)}).rows(A.media(spark, sf_dir)).select("id")


def _ranked(df: DataFrame, sort: str, by: str) -> DataFrame:
    """Place of each item within its library, by a scan over range partitions."""
    need = [c for c in ("taken", "mtime", "name", "bytes", "rating", "added_at") if c in M.SORT_COLUMNS.get(sort, ("taken", "mtime"))]
    return scan.places(df.select(by, "id", *need), [by], M.sort_keys(sort)).select(by, "id", F.col("place").cast("int").alias("place"))


_ORDERS_SQL = {
    "media_shuffle_rank": ("shuffle", "(id * 2654435761) % 1000003, id"),
    "media_name_nocase_rank": ("name", "lower(name), id"),
    "media_oldest_rank": ("oldest", "coalesce(taken, mtime), id"),
    "media_size_rank": ("size", "bytes DESC, id"),
    "media_rating_rank": ("rating", "rating DESC, coalesce(taken, mtime) DESC, id"),
    "media_added_rank": ("added", "added_at DESC, id DESC"),
}
for _name, (_sort, _sql) in _ORDERS_SQL.items():
    def _rank(spark, sf_dir, sort=_sort):
        return _ranked(A.media(spark, sf_dir).filter(M.active()), sort, "lib")

    _rank.__name__ = _name
    query(f"SELECT lib, id, CAST(row_number() OVER (PARTITION BY lib ORDER BY {_sql}) AS INTEGER) AS place FROM media WHERE {A.ACTIVE_SQL}", A.MEDIA_SQL)(_rank)


# ---------------------------------------------------------------- counters and details

@query(f"SELECT c_custkey AS id, c_name AS name, CAST(coalesce(n, 0) AS BIGINT) AS items, CAST(coalesce(b, 0) AS BIGINT) AS bytes FROM customer LEFT JOIN (SELECT lib, count(*) AS n, sum(bytes) AS b FROM media WHERE {A.ACTIVE_SQL} GROUP BY lib) ON lib = c_custkey", A.MEDIA_SQL)
def library_counts(spark, sf_dir):
    return M.library_counts(A.libraries(spark, sf_dir), A.media(spark, sf_dir))


@query("""SELECT count(*) FILTER (a) AS total, CAST(coalesce(sum(bytes) FILTER (a), 0) AS BIGINT) AS bytes, count(*) FILTER (a AND fav = 1) AS fav, count(*) FILTER (a AND kind = 1) AS video, count(*) FILTER (a AND kind IN (2, 3)) AS raw,
count(*) FILTER (deleted IS NOT NULL) AS bin, count(*) FILTER (missing = 1) AS missing, count(*) FILTER (state = 2) AS errors, count(*) FILTER (state = 2 AND ext IN ('heic', 'heif', 'hif')) AS heic_failed FROM (SELECT *, deleted IS NULL AND missing = 0 AS a FROM media)""", A.MEDIA_SQL)
def state_counters(spark, sf_dir):
    return M.state_counters(A.media(spark, sf_dir))


@query("""SELECT (SELECT count(*) FROM media WHERE deleted IS NULL AND missing = 0 AND id IN (SELECT doc_id FROM labels)) AS tagged, (SELECT count(*) FROM media WHERE deleted IS NULL AND missing = 0 AND state = 1 AND id NOT IN (SELECT doc_id FROM labels)) AS pending,
(SELECT count(*) FROM media WHERE deleted IS NULL AND missing = 0 AND state = 1 AND kind <> 1 AND facedone = 0) AS faces_pending, (SELECT count(*) FROM faces) AS faces, (SELECT count(*) FROM people WHERE hidden = 0) AS people""", A.MEDIA_SQL, A.PEOPLE_SQL)
def model_counters(spark, sf_dir):
    clip = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("media"))
    return M.model_counters(A.media(spark, sf_dir), clip, A.faces(spark, sf_dir), A.people(spark, sf_dir))


@query(f"SELECT lib, sub, count(*) AS items FROM media WHERE {A.ACTIVE_SQL} AND sub <> '' GROUP BY lib, sub", A.MEDIA_SQL)
def folder_counts(spark, sf_dir):
    return folders.folder_counts(A.media(spark, sf_dir).filter(M.active()))


@query(f"""SELECT k AS lib, array_to_string(list_slice(p, 1, d), '/') AS folder, CAST(sum(CASE WHEN d = len(p) THEN n ELSE 0 END) AS BIGINT) AS own, CAST(sum(n) AS BIGINT) AS total, CAST(d AS INTEGER) AS depth
FROM (SELECT k, p, n, unnest(range(1, len(p) + 1)) AS d FROM (SELECT kind AS k, string_split(sub, '/') AS p, count(*) AS n FROM media WHERE {A.ACTIVE_SQL} GROUP BY 1, 2)) GROUP BY 1, 2, d""", A.MEDIA_SQL)
def folder_rollup(spark, sf_dir):
    m = A.media(spark, sf_dir).filter(M.active()).withColumn("lib", F.col("kind"))
    return folders.rollup(folders.folder_counts(m)).select("lib", "folder", "own", "total", "depth")


@query("""SELECT host, array_to_string(list_slice(p, 1, d), '/') AS folder, CAST(sum(CASE WHEN d = len(p) THEN n ELSE 0 END) AS BIGINT) AS own, CAST(sum(n) AS BIGINT) AS total, CAST(d AS INTEGER) AS depth
FROM (SELECT host, p, n, unnest(range(1, len(p) + 1)) AS d FROM (SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, string_split(regexp_extract(url, '^[a-z]+://[^/?#]+/([^?#]*)', 1), '/') AS p, count(*) AS n FROM pages WHERE regexp_extract(url, '^[a-z]+://[^/?#]+/([^?#]*)', 1) <> '' GROUP BY 1, 2)) GROUP BY 1, 2, d""")
def folder_rollup_pages(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host"), F.regexp_extract("url", "^[a-z]+://[^/?#]+/([^?#]*)", 1).alias("sub"))
    return folders.rollup(p.filter("sub <> ''").groupBy("host", "sub").agg(F.count("*").alias("items")), ["host"])


@query(f"""SELECT f.lib, f.rel, CAST(count(m.id) AS BIGINT) AS items, (f.rel = 'ASIA' OR starts_with(f.rel, 'ASIA/')) AS excluded
FROM (SELECT DISTINCT kind AS lib, split_part(sub, '/', 1) || '/' || split_part(sub, '/', 2) AS rel FROM media UNION SELECT DISTINCT kind, split_part(sub, '/', 1) FROM media) f LEFT JOIN (SELECT * FROM media WHERE {A.ACTIVE_SQL}) m ON m.kind = f.lib AND (m.sub = f.rel OR starts_with(m.sub, f.rel || '/')) GROUP BY ALL""", A.MEDIA_SQL)
def library_folders(spark, sf_dir):
    m = A.media(spark, sf_dir).withColumn("lib", F.col("kind"))
    dirs = m.select("lib", F.explode(F.slice(folders.prefixes(F.col("sub")), 1, 2)).alias("rel")).distinct()
    return folders.listed_folders(dirs, m.filter(M.active()), ["ASIA"])


@query("""SELECT m.id, c_name AS library, coalesce(taken, mtime) AS ts, CAST(coalesce(n, 0) AS BIGINT) AS faces, coalesce(who, '') AS people FROM media m JOIN customer ON c_custkey = lib
LEFT JOIN (SELECT media, count(*) AS n, coalesce(string_agg(DISTINCT nullif(name, ''), ', ' ORDER BY nullif(name, '')), '') AS who FROM faces LEFT JOIN people ON people.id = cluster GROUP BY media) f ON f.media = m.id""", A.MEDIA_SQL, A.PEOPLE_SQL)
def media_detail(spark, sf_dir):
    return M.detail(A.media(spark, sf_dir), A.libraries(spark, sf_dir), A.faces(spark, sf_dir), A.people(spark, sf_dir))


@query("SELECT media_id, name, score, rank FROM (SELECT media_id, tag_id, score, CAST(row_number() OVER (PARTITION BY media_id ORDER BY score DESC, tag_id) AS INTEGER) AS rank FROM media_tags) JOIN tags ON id = tag_id WHERE rank <= 3", A.TAGS_SQL)
def top_tags_per_media(spark, sf_dir):
    tags, links = A.tags(spark, sf_dir)
    return M.top_tags(links, tags, 3)


@query("SELECT media, coll, name FROM items JOIN collections ON collections.id = coll", A.COLLECTIONS_SQL)
def media_memberships(spark, sf_dir):
    heads, items = A.collections(spark, sf_dir)
    return M.memberships(heads, items)


@query("""SELECT c.id, c.name, CAST(coalesce(n, 0) AS BIGINT) AS items, CAST(coalesce(b, 0) AS BIGINT) AS bytes, coalesce(c.cover, f) AS cover FROM collections c
LEFT JOIN (SELECT coll, count(*) AS n, sum(bytes) AS b, arg_min(i.media, (ord, added, i.media)) AS f FROM items i LEFT JOIN media m ON m.id = i.media GROUP BY coll) ON coll = c.id""", A.MEDIA_SQL, A.COLLECTIONS_SQL)
def collection_stats(spark, sf_dir):
    heads, items = A.collections(spark, sf_dir)
    return sets.collection_stats(heads, items, A.media(spark, sf_dir))


@query("""SELECT id, name, n AS items, f AS faces, row_number() OVER (ORDER BY name = '', n DESC, id) AS rank FROM people JOIN (SELECT cluster, count(DISTINCT media) AS n, count(*) AS f FROM faces GROUP BY cluster) ON cluster = id WHERE hidden = 0""", A.PEOPLE_SQL)
def people_stats(spark, sf_dir):
    return M.people_stats(A.people(spark, sf_dir), A.faces(spark, sf_dir))


# ---------------------------------------------------------------- storage and duplicates

@query(f"SELECT CAST(k AS INTEGER) AS kind, label, CAST(count(m.id) AS BIGINT) AS items, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS bytes FROM (VALUES (0, 'photo'), (1, 'video'), (2, 'raw'), (3, 'layered')) v(k, label) LEFT JOIN (SELECT * FROM media WHERE {A.ACTIVE_SQL}) m ON m.kind = k GROUP BY k, label", A.MEDIA_SQL)
def storage_breakdown(spark, sf_dir):
    return storage.by_kind(A.media(spark, sf_dir))


_OVER = "CASE WHEN w IS NULL OR h IS NULL THEN bytes > 12000000 WHEN w::DOUBLE * h / 1e6 < 0.5 THEN false ELSE bytes > greatest(w::DOUBLE * h / 1e6 * 1100000, 2500000) END"
_PHOTO_SAVING = "greatest(bytes - CAST(trunc(coalesce(w, 4000)::DOUBLE * coalesce(h, 3000)::DOUBLE / 1e6 * 420000.0) AS BIGINT), 0)"
_VIDEO_SAVING = "CAST(trunc(bytes::DOUBLE * CASE WHEN vcodec IN ('mjpeg','rawvideo','msmpeg4v3','msmpeg4v2','mpeg4','wmv3','wmv2','mpeg2video','mpeg1video') THEN 0.8 WHEN vcodec IN ('h264', 'vp8') THEN 0.42 ELSE 0.0 END::DOUBLE) AS BIGINT)"


@query(f"""SELECT count(*) FILTER (o) AS n_oversized, CAST(coalesce(sum({_PHOTO_SAVING}) FILTER (o), 0) AS BIGINT) AS oversized_saving, count(*) FILTER (v) AS n_video, CAST(coalesce(sum({_VIDEO_SAVING}) FILTER (v), 0) AS BIGINT) AS video_saving,
round(CAST(sum(bytes) FILTER (a AND kind <> 1) AS DOUBLE) / count(*) FILTER (a AND kind <> 1) / 1048576.0::DOUBLE, 6) AS avg_photo_mb, CAST(sum(bytes) FILTER (a AND kind <> 1) AS DOUBLE) / count(*) FILTER (a AND kind <> 1) / 1048576.0 > 4.5 AND count(*) FILTER (o) > 20 AS suggest
FROM (SELECT *, a AND kind = 0 AND {_OVER} AS o, a AND kind = 1 AND {_VIDEO_SAVING} > 4000000 AS v FROM (SELECT *, deleted IS NULL AND missing = 0 AS a FROM media))""", A.MEDIA_SQL)
def reclaim_report(spark, sf_dir):
    return storage.reclaim(A.media(spark, sf_dir)).withColumn("oversized_saving", F.col("oversized_saving").cast("long"))


_DOCS = "docs AS (SELECT doc_id AS id, n_chars AS bytes, doc_id % 1000 AS mtime, sha256(text) AS hash FROM documents)"


@query("SELECT count(*) AS groups, CAST(coalesce(sum(f), 0) AS BIGINT) AS freed FROM (SELECT sum(bytes) - max(bytes) AS f FROM docs GROUP BY hash HAVING count(*) > 1)", _DOCS)
def dup_summary(spark, sf_dir):
    return storage.duplicate_summary(A.documents_as_media(spark, sf_dir), "hash")


@query("""SELECT hash, id, bytes, row_number() OVER (PARTITION BY hash ORDER BY bytes DESC, mtime DESC, id) = 1 AS keep, n, CAST(b - mx AS BIGINT) AS freed
FROM (SELECT *, count(*) OVER (PARTITION BY hash) AS n, sum(bytes) OVER (PARTITION BY hash) AS b, max(bytes) OVER (PARTITION BY hash) AS mx FROM docs) WHERE n > 1""", _DOCS)
def dup_groups_keep(spark, sf_dir):
    return storage.duplicates(A.documents_as_media(spark, sf_dir), "hash")


@query(f"SELECT id, bytes FROM media WHERE {A.ACTIVE_SQL} AND kind = 0 AND {_OVER} AND rating < 4 ORDER BY bytes DESC, id LIMIT 100", A.MEDIA_SQL)
def compress_targets(spark, sf_dir):
    return storage.compress_targets(A.media(spark, sf_dir), limit=100).select("id", "bytes")


@query(f"""SELECT count(*) AS items, CAST(sum(bytes) AS BIGINT) AS bytes, round((SELECT sum(bytes - {_PHOTO_SAVING})::DOUBLE / sum(bytes)::DOUBLE FROM (SELECT * FROM t ORDER BY bytes DESC, id LIMIT 12)), 9) AS ratio,
CAST(floor(sum(bytes)::DOUBLE * (1 - round((SELECT sum(bytes - {_PHOTO_SAVING})::DOUBLE / sum(bytes)::DOUBLE FROM (SELECT * FROM t ORDER BY bytes DESC, id LIMIT 12)), 9))) AS BIGINT) AS saving FROM t""", A.MEDIA_SQL, f"t AS (SELECT * FROM media WHERE {A.ACTIVE_SQL} AND kind = 0 AND {_OVER} AND rating < 4)")
def compress_estimate(spark, sf_dir):
    return storage.compress_estimate(A.media(spark, sf_dir))


@query("SELECT doc_id AS id, sha256(text) AS hash FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("hash"))


# ---------------------------------------------------------------- timeline

_RUNS = """runs AS (SELECT lib, run, min(day) AS day, count(*) AS items, min(ts) AS first_ts, max(ts) AS last_ts FROM (SELECT *, sum(new) OVER (PARTITION BY lib ORDER BY ts DESC, id DESC) AS run FROM (SELECT *, CAST(strftime(make_timestamp(ts * 1000000), '%Y%m%d') AS INTEGER) AS day,
CAST(coalesce(lag(strftime(make_timestamp(ts * 1000000), '%Y%m%d')) OVER (PARTITION BY lib ORDER BY ts DESC, id DESC), '') <> strftime(make_timestamp(ts * 1000000), '%Y%m%d') AS INTEGER) AS new FROM ev)) GROUP BY lib, run)"""


def _newest(spark, sf_dir):
    return A.events(spark, sf_dir), [F.desc("ts"), F.desc("id")]


@query("SELECT lib, CAST(run AS BIGINT) AS run, day, items, first_ts, last_ts FROM runs", A.EVENTS_SQL, _RUNS)
def day_runs(spark, sf_dir):
    return timeline.day_runs(*_newest(spark, sf_dir), part="lib")


@query("SELECT lib, CAST(run AS BIGINT) AS run, height, CAST(coalesce(sum(height) OVER (PARTITION BY lib ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS y FROM (SELECT *, CAST(40 + ceil(items / 6.0) * 120 + 6 AS BIGINT) AS height FROM runs)", A.EVENTS_SQL, _RUNS)
def grid_layout(spark, sf_dir):
    runs = timeline.day_runs(*_newest(spark, sf_dir), part="lib")
    return timeline.grid_layout(runs, 6, 120, 40, part="lib").select("lib", "run", "height", "y")


@query("SELECT lib, id, lag(id) OVER w AS prev_id, lead(id) OVER w AS next_id, count(*) OVER (PARTITION BY lib ORDER BY ts DESC, id DESC ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) - 1 AS near FROM ev WINDOW w AS (PARTITION BY lib ORDER BY ts DESC, id DESC)", A.EVENTS_SQL)
def neighbours(spark, sf_dir):
    return timeline.neighbours(*_newest(spark, sf_dir), part="lib")


# ---------------------------------------------------------------- vectors and people

def _vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def _first(spark, sf_dir, n: int) -> list:
    return [(r["id"], list(r["vec"])) for r in _vectors(spark, sf_dir).filter(F.col("id") < n).orderBy("id").collect()]  # n rows


_DOT = "list_inner_product({}::DOUBLE[], {}::DOUBLE[])"


@query(f"""SELECT id, round(score, 9) AS score, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank FROM (SELECT e.vec_id AS id, {_DOT.format('e.embedding', 'q.embedding')} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)
QUALIFY score >= max(score) OVER () - 0.8 AND score >= 0.195 ORDER BY score DESC, id LIMIT 800""")
def knn_relative_cut(spark, sf_dir):
    found = vectors.search(_vectors(spark, sf_dir), _first(spark, sf_dir, 1)[0][1], band=0.8)
    return found.withColumn("score", F.round("score", 9))


@query(f"""SELECT id, tag, round(score, 9) AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY score DESC, pos) AS INTEGER) AS rank, max(score) OVER (PARTITION BY id) AS best FROM
(SELECT e.vec_id AS id, 'term ' || v.vec_id AS tag, v.vec_id AS pos, {_DOT.format('e.embedding', 'v.embedding')} AS score FROM embeddings e, embeddings v WHERE v.vec_id < 16)) WHERE rank <= 6 AND score > 0.1 AND score > best - 0.1""")
def zero_shot_tags(spark, sf_dir):
    vocabulary = [(f"term {i}", v) for i, v in _first(spark, sf_dir, 16)]
    return vectors.zero_shot_tags(_vectors(spark, sf_dir), vocabulary, floor=0.1, band=0.1).withColumn("score", F.round("score", 9))


_CENTROIDS = """cen AS (SELECT label, list(s ORDER BY pos) AS v FROM (SELECT label, pos, CAST(sum(CAST(x AS DECIMAL(28, 12))) AS DOUBLE) AS s FROM (SELECT label, unnest(range(1, len(embedding) + 1)) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1, 2) GROUP BY label),
unit AS (SELECT label, list_transform(v, lambda x: x / greatest(sqrt(list_inner_product(v, v)), 1e-8)) AS c FROM cen)"""


@query("SELECT CAST(label AS BIGINT) AS cluster, CAST(unnest(range(0, len(c))) AS INTEGER) AS pos, round(unnest(c), 6) AS x FROM unit", _CENTROIDS)
def centroids(spark, sf_dir):
    c = vectors.centroids(A.faces(spark, sf_dir), "cluster")
    return c.select("cluster", F.posexplode("centroid").alias("pos", "x")).withColumn("x", F.round("x", 6))


@query(f"SELECT id, centre, round(score, 6) AS score FROM (SELECT e.vec_id AS id, CAST(u.label AS BIGINT) AS centre, {_DOT.format('e.embedding', 'u.c')} AS score, row_number() OVER (PARTITION BY e.vec_id ORDER BY {_DOT.format('e.embedding', 'u.c')} DESC, u.label) AS r FROM embeddings e, unit u) WHERE r = 1", _CENTROIDS)
def nearest_person(spark, sf_dir):
    people = vectors.centroids(A.faces(spark, sf_dir), "cluster").toDF("id", "vec")
    return vectors.nearest(_vectors(spark, sf_dir), people).withColumn("score", F.round("score", 6))


_FACES = "f AS (SELECT vec_id AS id, vec_id // 3 % 8 AS block, CASE WHEN vec_id % 4 = 0 THEN CAST(label AS BIGINT) END AS cluster, embedding::DOUBLE[] AS vec FROM embeddings)"
#: One step a loose face and block: the centres so far, their sizes and the faces' places in them; `at` is the best centre, if it is over the threshold.
_GREEDY = """own AS (SELECT block, cluster, list(s ORDER BY pos) AS v, any_value(n) AS n FROM (SELECT block, cluster, pos, sum(x) AS s, count(*) AS n FROM (SELECT block, cluster, unnest(range(1, len(vec) + 1)) AS pos, unnest(vec) AS x FROM f WHERE cluster IS NOT NULL) GROUP BY 1, 2, 3) GROUP BY 1, 2),
known AS (SELECT block, list(list_transform(v, lambda x: x / greatest(sqrt(list_inner_product(v, v)), 1e-8)) ORDER BY cluster) AS cs, list(n ORDER BY cluster) AS ns, list(cluster ORDER BY cluster) AS names FROM own GROUP BY block),
loose AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY id) AS k FROM f WHERE cluster IS NULL),
step AS (SELECT b.block, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS id, CAST(0 AS BIGINT) AS slot, coalesce(cs, []) AS cs, coalesce(ns, []) AS ns FROM (SELECT DISTINCT block FROM f) b LEFT JOIN known USING (block)
UNION ALL SELECT block, k, id, slot, CASE WHEN slot > len(cs) THEN list_append(cs, vec) ELSE list_transform(cs, lambda c, i: CASE WHEN i = slot THEN m ELSE c END) END, CASE WHEN slot > len(cs) THEN list_append(ns, 1) ELSE list_transform(ns, lambda c, i: CASE WHEN i = slot THEN c + 1 ELSE c END) END
FROM (SELECT *, list_transform(mean, lambda x: x / greatest(sqrt(list_inner_product(mean, mean)), 1e-8)) AS m FROM (SELECT *, CASE WHEN slot > len(cs) THEN vec ELSE list_transform(list_zip(cs[slot], vec), lambda p: (p[1] * ns[slot] + p[2]) / (ns[slot] + 1)) END AS mean FROM (
SELECT *, CASE WHEN len(cs) > 0 AND list_max(sc) > 0.3 THEN list_position(sc, list_max(sc)) ELSE len(cs) + 1 END AS slot FROM (SELECT s.block, l.k, l.id, l.vec, cs, ns, list_transform(cs, lambda c: list_inner_product(c, l.vec)) AS sc FROM step s JOIN loose l ON l.block = s.block AND l.k = s.k + 1))))),
placed AS (SELECT s.block, id, slot, len(coalesce(names, [])) AS known, names[slot] AS name, count(*) OVER (PARTITION BY s.block, slot) AS size FROM step s LEFT JOIN known USING (block) WHERE id IS NOT NULL),
fresh AS (SELECT block, slot, row_number() OVER (ORDER BY block, slot) AS n FROM (SELECT DISTINCT block, slot FROM placed WHERE slot > known AND size > 1))"""


@query("""SELECT id, cluster FROM f WHERE cluster IS NOT NULL UNION ALL SELECT id, CASE WHEN slot <= known THEN name WHEN n IS NOT NULL THEN (SELECT max(id) FROM people) + n END AS cluster FROM placed LEFT JOIN fresh USING (block, slot)""", "RECURSIVE " + A.PEOPLE_SQL, _FACES, _GREEDY)
def greedy_cluster(spark, sf_dir):
    """Faces of eight libraries, a quarter of them assigned: each library is a block of its own."""
    f = A.faces(spark, sf_dir).withColumn("cluster", F.when(F.col("id") % 4 == 0, F.col("cluster"))).withColumn("lib", F.floor(F.col("id") / 3) % 8)
    return vectors.cluster(f, A.people(spark, sf_dir), threshold=0.3, block="lib")


@query("SELECT cluster, arg_max(id, (score, -id)) AS cover FROM faces GROUP BY cluster", A.PEOPLE_SQL)
def people_covers(spark, sf_dir):
    return vectors.covers(A.faces(spark, sf_dir))


@query("SELECT id, name, CAST((SELECT count(*) FROM faces WHERE CASE WHEN cluster IN (3, 4, 5) THEN 3 ELSE cluster END = people.id) AS BIGINT) AS faces FROM (SELECT id, CASE WHEN id = 3 THEN 'person 5' ELSE name END AS name FROM people WHERE id NOT IN (4, 5)) people", A.PEOPLE_SQL)
def merge_people(spark, sf_dir):
    f, p = vectors.merge_people(A.faces(spark, sf_dir), A.people(spark, sf_dir), [5, 3, 4], 3)
    return p.join(f.groupBy(F.col("cluster").alias("id")).agg(F.count("*").alias("faces")), "id", "left").select("id", "name", F.coalesce("faces", F.lit(0)).alias("faces"))


# ---------------------------------------------------------------- mutations

def _stored(spark, sf_dir) -> DataFrame:
    """media with paths, as a stored table; every tenth order is not known yet."""
    m = A.media(spark, sf_dir).filter(F.col("id") % 10 != 9)
    return m.withColumn("path", F.concat_ws("/", "sub", "name")).withColumn("rel", F.col("path"))


def _walked(spark, sf_dir) -> DataFrame:
    """What a walk meets: files with odd ids have grown, those with id % 6 = 0 are gone."""
    m = A.media(spark, sf_dir).filter(F.col("id") % 6 != 0)
    m = m.unionByName(m.filter(F.col("id") % 7 == 0).withColumn("mtime", F.col("mtime") - 5).withColumn("bytes", F.col("bytes") + 9))  # met twice, the older one elsewhere
    path = F.concat_ws("/", "sub", "name")
    return m.select(path.alias("path"), "lib", path.alias("rel"), "sub", "name", "ext", "kind", (F.col("bytes") + F.col("id") % 2).alias("bytes"), "mtime")


@query("""SELECT path, lib, bytes, state, rating, missing, CASE WHEN id % 10 = 9 THEN (SELECT max(id) FROM media WHERE id % 10 <> 9) + row_number() OVER (PARTITION BY id % 10 = 9 ORDER BY path) ELSE id END AS id FROM (SELECT id, sub || '/' || name AS path, lib, CASE WHEN id % 6 <> 0 THEN bytes + id % 2 ELSE bytes END AS bytes, CASE WHEN id % 10 = 9 OR id % 6 <> 0 AND id % 2 = 1 THEN 0 ELSE state END AS state,
CASE WHEN id % 10 = 9 THEN 0 ELSE rating END AS rating, CASE WHEN id % 6 <> 0 THEN 0 ELSE missing END AS missing FROM media WHERE id % 10 <> 9 OR id % 6 <> 0)""", A.MEDIA_SQL)
def upsert_changes(spark, sf_dir):
    return library.upsert(_stored(spark, sf_dir), _walked(spark, sf_dir), NOW).select("path", "lib", "bytes", "state", "rating", "missing", "id")


@query("SELECT id, CASE WHEN lib = 1 AND deleted IS NULL AND id % 6 = 0 THEN 1 ELSE missing END AS missing FROM media WHERE id % 10 <> 9", A.MEDIA_SQL)
def missing_mark(spark, sf_dir):
    return library.mark_missing(_stored(spark, sf_dir), _walked(spark, sf_dir), 1).select("id", "missing")


@query("""SELECT 'media_tags' AS name, count(*) AS n FROM media_tags WHERE media_id IN (SELECT id FROM media WHERE kind = 0) UNION ALL SELECT 'items', count(*) FROM items WHERE media IN (SELECT id FROM media WHERE kind = 0)
UNION ALL SELECT 'tags', count(*) FROM tags WHERE id IN (SELECT tag_id FROM media_tags WHERE media_id IN (SELECT id FROM media WHERE kind = 0)) UNION ALL SELECT 'people', count(*) FROM people WHERE id IN (SELECT cluster FROM faces WHERE media IN (SELECT id FROM media WHERE kind = 0))""", A.MEDIA_SQL, A.TAGS_SQL, A.COLLECTIONS_SQL, A.PEOPLE_SQL)
def orphan_prune(spark, sf_dir):
    tags, links = A.tags(spark, sf_dir)
    t = {"media": A.media(spark, sf_dir).filter("kind = 0"), "tags": tags, "media_tags": links, "collection_items": A.collections(spark, sf_dir)[1], "faces": A.faces(spark, sf_dir), "people": A.people(spark, sf_dir)}
    out = library.prune_orphans(t)
    n = lambda k, name: out[k].agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    return n("media_tags", "media_tags").unionByName(n("collection_items", "items")).unionByName(n("tags", "tags")).unionByName(n("people", "people"))


@query(f"SELECT id FROM media WHERE {A.ACTIVE_SQL} AND state = 1 AND id NOT IN (SELECT doc_id FROM labels)", A.MEDIA_SQL)
def backlog_anti(spark, sf_dir):
    return M.backlog(A.media(spark, sf_dir), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("media")), "clip").select("id")


@query(f"SELECT id FROM media WHERE deleted IS NULL OR deleted >= {NOW} - 30 * 86400", A.MEDIA_SQL)
def ttl_purge(spark, sf_dir):
    return library.purge_expired(A.media(spark, sf_dir), NOW).select("id")


@query("SELECT count(*) AS items, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS bytes FROM media WHERE deleted IS NOT NULL", A.MEDIA_SQL)
def purge_bin(spark, sf_dir):
    return library.purge(A.media(spark, sf_dir))[1]


@query(f"SELECT id, CASE WHEN id % 9 = 0 AND deleted IS NULL THEN {NOW} ELSE deleted END AS deleted, CASE WHEN id % 9 = 0 THEN 5 ELSE rating END AS rating FROM media", A.MEDIA_SQL)
def bin_and_rate(spark, sf_dir):
    m = A.media(spark, sf_dir).withColumn("binpath", F.lit(None).cast("string"))
    ids = m.filter(F.col("id") % 9 == 0).select("id")
    return library.rate(library.to_bin(m, ids, NOW), ids, rating=9).select("id", "deleted", "rating")


@query(f"""SELECT coll, media, ord FROM items UNION ALL SELECT n.coll, n.media, t.top + 1 + n.pos FROM (SELECT s_suppkey AS coll, o_orderkey AS media, o_orderkey AS pos FROM supplier, orders WHERE o_orderkey < 50) n
JOIN (SELECT coll, max(ord) AS top FROM items GROUP BY coll) t ON t.coll = n.coll WHERE NOT EXISTS (SELECT 1 FROM items i WHERE i.coll = n.coll AND i.media = n.media)""", A.COLLECTIONS_SQL)
def collection_add_items(spark, sf_dir):
    heads, items = A.collections(spark, sf_dir)
    new = heads.select(F.col("id").alias("coll"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(49).cast("long"))).alias("media")).withColumn("position", F.col("media"))
    return sets.add_items(items, new, NOW).select("coll", "media", "ord")


@query("""SELECT coll, media, CASE WHEN row_number() OVER (PARTITION BY coll, nm ORDER BY ord, added, media) > 1 THEN 'pic_' || (media % 20) || ' (' || media || ').' || ext ELSE nm END AS entry, CAST(row_number() OVER (PARTITION BY coll ORDER BY ord, added, media) AS INTEGER) AS position
FROM (SELECT i.*, ext, 'pic_' || (media % 20) || '.' || ext AS nm FROM items i JOIN media m ON m.id = i.media WHERE deleted IS NULL)""", A.MEDIA_SQL, A.COLLECTIONS_SQL)
def export_manifest(spark, sf_dir):
    m = A.media(spark, sf_dir).withColumn("name", F.concat(F.lit("pic_"), (F.col("id") % 20).cast("string"), F.lit("."), F.col("ext")))
    return sets.export_manifest(A.collections(spark, sf_dir)[1], m)


# ---------------------------------------------------------------- scalar and pixel functions

@query(f"""SELECT id, CASE WHEN b >= 1073741824 THEN printf('%.2f GB', b / 1073741824.0::DOUBLE) WHEN b >= 1048576 THEN printf('%.1f MB', b / 1048576.0::DOUBLE) ELSE CAST(round_even(b / 1024.0::DOUBLE, 0) AS BIGINT) || ' KB' END AS size,
CASE WHEN s >= 3600 THEN (s // 3600) || ':' || lpad(((s // 60) % 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') ELSE (s // 60) || ':' || lpad((s % 60)::VARCHAR, 2, '0') END AS length,
CAST(strftime(make_timestamp(ts * 1000000), '%Y%m%d') AS INTEGER) AS day, ts - ts % 60 AS named FROM (SELECT *, CAST(round(value * 30) AS BIGINT) AS s, CAST(round(value * 1000000) AS BIGINT) + 1 AS b FROM ev)""", A.EVENTS_SQL)
def scalar_suite(spark, sf_dir):
    e = A.events(spark, sf_dir)
    b = F.round(F.col("value") * 1000000).cast("long") + 1
    minute = F.timestamp_seconds(F.col("ts") - F.col("ts") % 60)
    name = F.concat(F.lit("PXL_"), F.date_format(minute, "yyyyMMdd_HHmmss"), F.lit(".jpg"))
    return e.select("id", S.human_bytes(b).alias("size"), S.display_duration(F.round(F.col("value") * 30)).alias("length"), S.day_key(F.col("ts")).alias("day"), S.date_from_name(name).alias("named"))


_BOX = "[CAST(l_partkey % 40 AS DOUBLE), CAST(l_suppkey % 40 AS DOUBLE), CAST(l_partkey % 40 + l_quantity AS DOUBLE), CAST(l_suppkey % 40 + l_linenumber * 5 AS DOUBLE)]"


@query(f"""SELECT k, round(inter / greatest((a[3] - a[1]) * (a[4] - a[2]) + (b[3] - b[1]) * (b[4] - b[2]) - inter, 1e-6), 9) AS iou FROM (SELECT *, greatest(least(a[3], b[3]) - greatest(a[1], b[1]), 0) * greatest(least(a[4], b[4]) - greatest(a[2], b[2]), 0) AS inter
FROM (SELECT l_orderkey * 100 + l_linenumber AS k, {_BOX} AS a, [10.0, 10.0, 35.0, 30.0]::DOUBLE[] AS b FROM lineitem))""")
def box_overlap(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    x, y = F.col("l_partkey") % 40, F.col("l_suppkey") % 40
    box = F.array(*[c.cast("double") for c in (x, y, x + F.col("l_quantity"), y + F.col("l_linenumber") * 5)])
    return li.select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("k"), F.round(S.iou(box, F.array(*map(F.lit, (10.0, 10.0, 35.0, 30.0)))), 9).alias("iou"))


@query(f"""SELECT l_orderkey, any_value(n) AS boxes, CAST(len(arg_max(kept, k)) AS INTEGER) AS kept FROM t GROUP BY l_orderkey""",
    f"""RECURSIVE d AS (SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice + l_partkey * 1e-4 DESC) AS BIGINT) AS k, CAST(count(*) OVER (PARTITION BY l_orderkey) AS INTEGER) AS n, {_BOX} AS b FROM lineitem)""",
    """t AS (SELECT l_orderkey, k, n, [b] AS kept FROM d WHERE k = 1 UNION ALL SELECT d.l_orderkey, d.k, d.n, CASE WHEN len(list_filter(kept, lambda a: greatest(least(a[3], b[3]) - greatest(a[1], b[1]), 0) * greatest(least(a[4], b[4]) - greatest(a[2], b[2]), 0)
/ greatest((a[3] - a[1]) * (a[4] - a[2]) + (b[3] - b[1]) * (b[4] - b[2]) - greatest(least(a[3], b[3]) - greatest(a[1], b[1]), 0) * greatest(least(a[4], b[4]) - greatest(a[2], b[2]), 0), 1e-6) > 0.4)) > 0 THEN kept ELSE list_append(kept, b) END FROM t JOIN d ON d.l_orderkey = t.l_orderkey AND d.k = t.k + 1)""")
def box_suppression(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    x, y = F.col("l_partkey") % 40, F.col("l_suppkey") % 40
    box = F.array(*[c.cast("double") for c in (x, y, x + F.col("l_quantity"), y + F.col("l_linenumber") * 5)])
    d = F.struct((F.col("l_extendedprice") + F.col("l_partkey") * 1e-4).alias("score"), box.alias("box"))
    g = li.groupBy("l_orderkey").agg(F.collect_list(d).alias("boxes"))  # the lines of one order
    return g.select("l_orderkey", F.size("boxes").alias("boxes"), F.size(S.non_maximum_suppression(F.col("boxes"))).alias("kept"))


_BITS = " + ".join(f"CASE WHEN embedding[{r * 8 + c + 1}] > embedding[{r * 8 + c + 2}] THEN {1 << (r * 7 + c)} ELSE 0 END" for r in range(8) for c in range(7))


@query(f"SELECT vec_id AS id, CAST({_BITS} AS BIGINT) AS dhash, CAST(bit_count(xor(CAST({_BITS} AS BIGINT), 81985529216486895)) AS INTEGER) AS distance FROM embeddings")
def hash_hamming(spark, sf_dir):
    h = S.difference_hash(F.col("vec"), 8, 8)
    return _vectors(spark, sf_dir).select("id", h.alias("dhash")).withColumn("distance", S.hamming(F.col("dhash"), F.lit(81985529216486895)))


_LUMA = "({0} * 0.2126 + {1} * 0.7152 + {2} * 0.0722)"


@query(f"""SELECT k, round(least(greatest(r * (1 - 0.5) + {_LUMA.format('r', 'g', 'b')} * 0.5, 0), 1), 9) AS r, round(least(greatest(g * (1 - 0.5) + {_LUMA.format('r', 'g', 'b')} * 0.5, 0), 1), 9) AS g, round(least(greatest(b * (1 - 0.5) + {_LUMA.format('r', 'g', 'b')} * 0.5, 0), 1), 9) AS b FROM (
SELECT k, {_LUMA.format('r', 'g', 'b')} * (1 - 1.22) + r * 1.22 AS r, {_LUMA.format('r', 'g', 'b')} * (1 - 1.22) + g * 1.22 AS g, {_LUMA.format('r', 'g', 'b')} * (1 - 1.22) + b * 1.22 AS b FROM (
SELECT k, (r * sqrt(2) - 0.5) * 1.16 + 0.5 + 0.0264 AS r, (g * sqrt(2) - 0.5) * 1.16 + 0.5 AS g, (b * sqrt(2) - 0.5) * 1.16 + 0.5 - 0.0264 AS b FROM (
SELECT p_partkey AS k, p_size / 50.0::DOUBLE AS r, (p_partkey % 256) / 255.0::DOUBLE AS g, (p_retailprice % 100) / 100.0::DOUBLE AS b FROM part)))""")
def colour_pipeline(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    df = p.select(F.col("p_partkey").alias("k"), (F.col("p_size") / 50.0).alias("r"), ((F.col("p_partkey") % 256) / 255.0).alias("g"), ((F.col("p_retailprice") % 100) / 100.0).alias("b"))
    for step in S.adjust_colour(None, None, None, exposure=0.5, contrast=0.16, warmth=0.22, saturation=0.22, mono=0.5):
        r, g, b = step(F.col("r"), F.col("g"), F.col("b"))
        df = df.select("k", r.alias("r"), g.alias("g"), b.alias("b"))
    return df.select("k", *[F.round(c, 9).alias(c) for c in "rgb"])


def _drawn(spark, sf_dir) -> DataFrame:
    """Generated images, one a part: as many tasks as there are cores, whatever the file's splits."""
    import numpy as np

    def draw(batches):
        import pandas as pd

        for pdf in (whole[k : k + I.HELD] for whole in batches for k in range(0, len(whole), I.HELD)):
            out = []
            for i, size in zip(pdf["p_partkey"], pdf["p_size"]):
                y, x = np.mgrid[0:24, 0 : 16 + int(size)]
                out.append(I.encode_png(np.stack([(x * int(i)) % 256, (y * 9) % 256, (x + y) % 256], axis=2).astype(np.uint8)))
            yield pd.DataFrame({"id": pdf["p_partkey"], "content": out})

    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size").repartition(2 * spark.sparkContext.defaultParallelism)
    return parts.mapInPandas(draw, "id long, content binary")


@query()
def image_thumbs(spark, sf_dir):
    """Generated images: decoded, hashed and made thumbnails of."""
    made = _drawn(spark, sf_dir).select("id", S.sniff(F.col("content")).alias("type"), I.thumbnail("content", F.lit(16)).alias("t"))
    return made.select("id", "type", "t.w", "t.h", "t.dhash", F.octet_length("t.thumb").alias("thumb_bytes"), "t.err")


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 7 > 0 THEN 'png' END AS type, CASE WHEN p_partkey % 7 > 0 THEN 16 + p_size END AS w, CASE WHEN p_partkey % 7 > 0 THEN 24 END AS h, p_partkey % 7 = 0 AS failed FROM part")
def image_sizes(spark, sf_dir):
    """Generated images, every seventh one broken: type, size, and whether it could not be read."""
    c = F.col("content")
    d = _drawn(spark, sf_dir).select("id", F.when(F.col("id") % 7 == 0, F.substring(c, 2, 100)).otherwise(c).alias("content"))
    made = d.select("id", S.sniff(c).alias("type"), I.thumbnail("content", F.lit(16)).alias("t"))
    return made.select("id", "type", "t.w", "t.h", F.col("t.err").isNotNull().alias("failed"))


@query("SELECT sub || '/' || name AS path, bytes + id % 2 AS bytes, 0 AS state, 0 AS missing FROM media WHERE id % 6 <> 0", A.MEDIA_SQL)
def ingest_stream(spark, sf_dir):
    """A walk's rows taken from an inbox by micro-batches into a versioned table, twice; the second run finds nothing new."""
    from medialoom.sources.buckets import Buckets
    from medialoom.sources.catalog import Catalog
    from medialoom.streaming.ingest import ingest

    root = f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    walked = _walked(spark, sf_dir)
    walked.write.parquet(f"{root}/inbox")
    media = Buckets(Catalog(spark, f"{root}/index"), "media", _stored(spark, sf_dir).schema, buckets=16)
    for _ in range(2):
        ingest(spark, f"{root}/inbox", walked.schema, media, f"{root}/progress", NOW)
    return media.read().select("path", "bytes", "state", "missing")


from medialoom.plans import more  # noqa: E402, F401  registers its queries
