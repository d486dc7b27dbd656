"""Mutations, snapshots, walks, streaming and clustering."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from medialoom.functions import scalar as S
from medialoom.operators import folders, library, media as M, sets, storage, vectors
from medialoom.sources import files
from medialoom.sources.buckets import Buckets
from medialoom.sources.catalog import Catalog
from medialoom.streaming.ingest import ingest, routed, take_uploads

MEDIA = "id long, lib long, path string, rel string, sub string, name string, ext string, kind int, bytes long, mtime long, taken long, rating int, fav int, deleted long, binpath string, hash string, dhash long, state int, err string, added_at long, missing int, facedone int, w int, h int, vcodec string, acodec string, dur double"
WALK = "path string, lib long, rel string, sub string, name string, ext string, kind int, bytes long, mtime long"


def item(i, **v):
    d = dict(id=i, lib=1, path=f"a/{i}.jpg", rel=f"a/{i}.jpg", sub="a", name=f"{i}.jpg", ext="jpg", kind=0, bytes=100 + i, mtime=i, taken=None, rating=0, fav=0, deleted=None, binpath=None, hash=None, dhash=None, state=1, err=None, added_at=0, missing=0, facedone=0, w=None, h=None, vcodec=None, acodec=None, dur=None)
    return tuple((d | v).values())


def frame(spark, *items):
    return spark.createDataFrame(list(items), MEDIA)


def by_id(df, *cols):
    return {r["id"]: tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect()}


def walked(spark, rows):
    return spark.createDataFrame([(p, 1, p, "a", p[2:], "jpg", 0, b, t) for p, b, t in rows], WALK)


def test_upsert_keeps_what_people_set(spark):
    old = frame(spark, item(1, rating=5, fav=1, missing=1), item(2, rating=3), item(3, state=2, deleted=9))
    seen = walked(spark, [("a/1.jpg", 101, 1), ("a/2.jpg", 999, 2), ("a/new1.jpg", 5, 5), ("a/new2.jpg", 6, 6)])
    new = library.upsert(old, seen, now=77)
    got = {r["path"]: r for r in new.collect()}
    assert len(got) == 5 and (got["a/1.jpg"]["rating"], got["a/1.jpg"]["fav"], got["a/1.jpg"]["missing"], got["a/1.jpg"]["state"]) == (5, 1, 0, 1)
    assert (got["a/2.jpg"]["state"], got["a/2.jpg"]["bytes"], got["a/2.jpg"]["rating"]) == (0, 999, 3)
    assert (got["a/3.jpg"]["state"], got["a/3.jpg"]["deleted"]) == (2, 9)
    assert [got[f"a/new{k}.jpg"]["id"] for k in (1, 2)] == [4, 5] and got["a/new1.jpg"]["added_at"] == 77
    again = library.upsert(new, seen, now=99)
    assert sorted(map(str, again.collect())) == sorted(map(str, new.collect()))


def test_missing_marks_only_its_library(spark):
    m = frame(spark, item(1), item(2), item(3, lib=2), item(4, deleted=5))
    got = by_id(library.mark_missing(m, walked(spark, [("a/1.jpg", 1, 1)]), 1), "missing")
    assert got == {1: 0, 2: 1, 3: 0, 4: 0}


def test_bin_restore_purge(spark):
    m, ids = frame(spark, item(1), item(2, deleted=5), item(3)), spark.createDataFrame([(1,), (2,)], "id long")
    binned = library.to_bin(m, ids, 50)
    assert by_id(binned, "deleted") == {1: 50, 2: 5, 3: None} and by_id(binned, "binpath")[1] == "1__1.jpg"
    assert by_id(library.restore(binned, ids), "deleted") == {1: None, 2: None, 3: None}
    left, freed = library.purge(binned, ids.filter("id = 1"))
    assert sorted(by_id(left, "id")) == [2, 3] and tuple(freed.first()) == (1, 101)
    assert sorted(by_id(library.purge_expired(binned, now=5 + 86400 + 1, days=1), "id")) == [1, 3] and library.purge_expired(binned, 10**9, 0).count() == 3


def test_rating_is_clamped_and_failures_retried(spark):
    m, ids = frame(spark, item(1), item(2, state=2, err="x")), spark.createDataFrame([(1,)], "id long")
    assert by_id(library.rate(m, ids, rating=9, fav=True), "rating", "fav") == {1: (5, 1), 2: (0, 0)}
    assert by_id(library.retry_failed(m), "state", "err") == {1: (1, None), 2: (0, None)}


def test_metadata(spark):
    m = frame(spark, item(1, taken=5), item(2))
    got = by_id(library.write_metadata(m, spark.createDataFrame([(1, None, 640), (2, 9, 480)], "id long, taken long, w int")), "taken", "w")
    assert got == {1: (5, 640), 2: (9, 480)}


def test_orphans_go_in_order(spark):
    t = {
        "media": frame(spark, item(1)), "clip": spark.createDataFrame([(1,), (9,)], "media long"), "faces": spark.createDataFrame([(1, 1, 10), (2, 9, 11)], "id long, media long, cluster long"),
        "media_tags": spark.createDataFrame([(1, 5), (9, 6)], "media_id long, tag_id long"), "collection_items": spark.createDataFrame([(1, 1), (1, 9)], "coll long, media long"),
        "tags": spark.createDataFrame([(5, "a"), (6, "b")], "id long, name string"), "people": spark.createDataFrame([(10,), (11,)], "id long"),
        "libraries": spark.createDataFrame([(1, "")], "id long, excludes string"),
    }
    assert {k: v.count() for k, v in library.prune_orphans(t).items()} == dict.fromkeys(t, 1)
    assert library.with_excludes(t, 1, ["a"])["media"].count() == 0 and library.with_excludes(t, 1, ["A"])["media"].count() == 1
    assert library.without_library(t, 1)["people"].count() == 0


def test_replaced_not_appended(spark):
    faces = spark.createDataFrame([(1, 1, 10), (2, 2, 11)], "id long, media long, cluster long")
    new, done = spark.createDataFrame([(3, 1, None)], "id long, media long, cluster long"), spark.createDataFrame([(1,), (3,)], "id long")
    out, m = library.replace_faces(faces, frame(spark, item(1), item(2), item(3)), new, done)
    assert sorted(by_id(out, "id")) == [2, 3] and by_id(m, "facedone") == {1: 1, 2: 0, 3: 1}
    tags, links = spark.createDataFrame([(4, "sea")], "id long, name string"), spark.createDataFrame([(1, 4, 0.5), (2, 4, 0.6)], "media_id long, tag_id long, score double")
    t, l = library.relink_tags(tags, links, spark.createDataFrame([(1, "sky", 0.9), (1, "sea", 0.8)], "media_id long, name string, score double"))  # noqa: E741
    assert {tuple(r) for r in t.collect()} == {(4, "sea"), (5, "sky")} and sorted(map(tuple, l.collect())) == [(1, 4, 0.8), (1, 5, 0.9), (2, 4, 0.6)]
    kv = spark.createDataFrame([("a", "1"), ("b", "2")], "k string, v string")
    assert sorted(map(tuple, library.upsert_keyed(kv, kv.filter("k = 'b'").withColumn("v", F.lit("3")), ["k"]).collect())) == [("a", "1"), ("b", "3")]


def test_settings_are_json(spark):
    kv = spark.createDataFrame([("a", '{"n": 3, "on": true}'), ("b", "no json"), ("c", '{"n": "x"}'), ("d", None), ("e", '{"n": 2147483648, "more": [1]}')], "k string, v string")
    got = {r["k"]: (r["n"], r["on"]) for r in library.settings_read(kv, "n int, on boolean", {"n": -1, "on": False}).collect()}
    assert got == {"a": (3, True), "b": (-1, False), "c": (-1, False), "d": (-1, False), "e": (-1, False)}


def test_encoder_hook(spark):
    enc = vectors.encoder(lambda texts: [[len(t), 0.0] if t else [0.0, 0.0] for t in texts])
    got = [r["v"] for r in spark.createDataFrame([("abc",), (None,), ("",)], "t string").coalesce(1).select(enc("t").alias("v")).collect()]
    assert got == [[1.0, 0.0], None, [0.0, 0.0]]


def test_collections(spark):
    c = spark.createDataFrame([(3, "old", None, 0, None)], "id long, name string, note string, created long, cover long")
    made = sets.create(c, spark.createDataFrame([(" new ",), ("old",), ("",), ("new",)], "name string"), 5)
    assert by_id(made, "name") == {3: "old", 4: "new"} and by_id(sets.rename(made, 4, " ", "n"), "name", "note")[4] == ("new", "n")
    items = spark.createDataFrame([(3, 10, 0, 1), (3, 11, 5, 1)], "coll long, media long, ord long, added long")
    new = spark.createDataFrame([(3, 11, 0), (3, 12, 1), (3, 12, 2), (4, 10, 0)], "coll long, media long, position int")
    got = sorted((r["coll"], r["media"], r["ord"]) for r in sets.add_items(items, new, 9).collect())
    assert got == [(3, 10, 0), (3, 11, 5), (3, 12, 7), (4, 10, 0)]  # a member met again uses its position up
    assert sets.remove_items(items, new).count() == 1 and [x.count() for x in sets.delete(made, items, 3)] == [1, 0]
    media = frame(spark, item(10, name="x.jpg"), item(11, name="x.jpg"), item(12, deleted=1))
    assert sorted((r["position"], r["entry"]) for r in sets.export_manifest(items, media).collect()) == [(1, "x.jpg"), (2, "x (11).jpg")]


def test_duplicates_keep_the_largest(spark):
    m = frame(spark, item(1, hash="a", bytes=5, dhash=0), item(2, hash="a", bytes=9, dhash=-7), item(3, hash="a", bytes=9, mtime=99, dhash=-7), item(4, hash="b"), item(5, hash="a", deleted=1), item(6))
    got = {r["id"]: (r["keep"], r["freed"]) for r in storage.duplicates(m).collect()}
    assert got == {1: (False, 14), 2: (False, 14), 3: (True, 14)} and sorted(by_id(storage.extra_copies(m), "id")) == [1, 2]
    assert tuple(storage.duplicate_summary(m).first()) == (1, 9)


@settings(max_examples=15, deadline=None)
@given(st.dictionaries(st.lists(st.sampled_from("abc"), min_size=1, max_size=4).map("/".join), st.integers(1, 9), min_size=1, max_size=8))
def test_rollup_sums(spark, counts):
    got = {r["folder"]: (r["own"], r["total"]) for r in folders.rollup(spark.createDataFrame([(1, k, v) for k, v in counts.items()], "lib int, sub string, items long")).collect()}
    every = {"/".join(k.split("/")[: n + 1]) for k in counts for n in range(len(k.split("/")))}
    assert got == {f: (counts.get(f, 0), sum(v for k, v in counts.items() if k == f or k.startswith(f + "/"))) for f in every}


def test_listing_order_and_columns(spark):
    m = frame(spark, item(1, taken=9), item(2, mtime=50), item(3, deleted=1), item(4, missing=1))
    q = M.MediaQuery()
    assert [r["id"] for r in q.listing(m).collect()] == [2, 1] and [r["id"] for r in M.MediaQuery(bin=True).listing(m).collect()] == [3]
    one = M.columnar(q.listing(m).withColumn("pos", -F.col("ts"))).first()
    assert one["id"] == [2, 1] and one["ts"] == [50, 9]
    assert M.work_left(m, spark.createDataFrame([(1,), (2,)], "media long")).first()["clip"] is False


# ---------------------------------------------------------------- people

def test_clustering_rules(spark):
    rows = [(i, None, [1.0, 0.01 * i]) for i in (1, 2, 3)] + [(4, None, [0.0, -1.0]), (5, 6, [-1.0, 0.0]), (6, None, [-1.0, 0.1])]
    faces = spark.createDataFrame(rows, "id long, cluster long, vec array<float>")
    people = spark.createDataFrame([(6, "x")], "id long, name string")
    got = by_id(vectors.cluster(faces, people), "cluster")
    assert got == {1: 7, 2: 7, 3: 7, 4: None, 5: 6, 6: 6}
    again = faces.drop("cluster").join(spark.createDataFrame(list(got.items()), "id long, cluster long"), "id")
    assert by_id(vectors.cluster(again, spark.createDataFrame([(6, "x"), (7, "")], "id long, name string")), "cluster") == got


def test_search_cut(spark):
    rows = [(i, [s, 0.0]) for i, s in enumerate((0.31, 0.29, 0.2811, 0.2799, 0.19))]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    assert [r["id"] for r in vectors.search(df, [1.0, 0.0]).orderBy("rank").collect()] == [0, 1, 2]
    assert vectors.search(df.filter("id = 4"), [1.0, 0.0]).count() == 0
    tags = vectors.zero_shot_tags(spark.createDataFrame([(1, [1.0])], "id long, vec array<double>"), [("a", [0.30]), ("b", [0.266]), ("c", [0.264]), ("d", [0.1])])
    assert [r["tag"] for r in tags.orderBy("rank").collect()] == ["a", "b"]


def test_merge(spark):
    faces = spark.createDataFrame([(1, 1, [1.0, 0.0], 0.5), (2, 2, [0.0, 1.0], 0.9), (3, 3, [1.0, 1.0], 0.1)], "id long, cluster long, vec array<double>, score double")
    people = spark.createDataFrame([(1, ""), (2, "Ann"), (3, "Bo")], "id long, name string")
    f, p = vectors.merge_people(faces, people, [1, 2], 1)
    got = {r["id"]: (r["name"], r["centroid"]) for r in p.collect()}
    assert got[1][0] == "Ann" and got[1][1] == pytest.approx([0.5**0.5] * 2) and set(got) == {1, 3}
    assert {r["cluster"]: r["cover"] for r in vectors.covers(f).collect()} == {1: 2, 3: 3}
    items = spark.createDataFrame([(1, "", 9), (2, "Ann", 1), (3, "", 5)], "id long, name string, items long")
    assert vectors.merge_target(items).first()["into"] == 2 and vectors.merge_target(items.filter("name = ''")).first()["into"] == 1
    with pytest.raises(ValueError):
        vectors.merge_people(faces, people, [1], 1)


# ---------------------------------------------------------------- sources

def test_walk(spark, tmp_path):
    for p in ("a/x.JPG", "a/b/y.mp4", "a/empty.png", "skip/z.png", "$RECYCLE/q.png", "a/notes.txt", "top.psd"):
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"" if "empty" in p else b"data")
    df = files.walk(spark, str(tmp_path), 7, excludes=["skip"])
    assert "content" not in df._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]
    got = sorted((r["rel"], r["sub"], r["ext"], r["kind"], r["bytes"]) for r in df.collect())
    assert got == [("a/b/y.mp4", "a/b", "mp4", 1, 4), ("a/x.JPG", "a", "jpg", 0, 4), ("top.psd", "", "psd", 3, 4)]
    assert files.folder_bytes(spark, str(tmp_path)).first()["bytes"] >= 20


def test_probe(spark):
    text = '{"streams": [{"codec_type": "audio", "codec_name": "aac"}, {"codec_type": "video", "codec_name": "hevc", "width": 4, "height": 3, "side_data_list": [{}, {"rotation": -90}]}], "format": {"duration": "1.5", "tags": {"creation_time": "2024-01-02T03:04:05Z"}}}'
    row = spark.createDataFrame([(text,), ("junk",)], "t string").select(files.probe(F.col("t")).alias("p")).select("p.*").collect()
    assert tuple(row[0]) == (4, 3, 1.5, "hevc", "aac", 1704164645, -90.0) and set(row[1]) == {None}


def test_snapshots_and_stream(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/index")
    schema = frame(spark, item(1)).schema
    assert c.version("media") is None and c.read("media", schema).count() == 0
    with pytest.raises(KeyError):
        c.read("media")
    first = frame(spark, item(1))
    assert c.commit("media", first) == 1
    held = c.read("media")
    assert c.commit("media", c.read("media").filter("id > 1")) == 2 and held.count() == 1 and c.read("media").count() == 0
    wider = spark.createDataFrame([], "id long, more string").schema
    c.commit("media", first)
    assert tuple(c.read("media", wider).first()) == (1, None)

    walked(spark, [("a/1.jpg", 101, 1), ("a/2.jpg", 5, 5)]).write.parquet(f"{tmp_path}/inbox")
    media = Buckets(c, "bucketed", schema, 8)
    for _ in range(2):
        ingest(spark, f"{tmp_path}/inbox", walked(spark, [("a/1.jpg", 1, 1)]).schema, media, f"{tmp_path}/progress", 3)
    assert by_id(media.read(), "path") == {1: "a/1.jpg", 2: "a/2.jpg"}


def test_buckets_write_what_changed(spark, tmp_path, monkeypatch):
    """Equal to the whole-table mutations after each step; only the buckets of what changed are written."""
    from medialoom.sources import buckets

    monkeypatch.setattr(buckets, "SPAN", 100)
    schema = frame(spark, item(1)).schema
    c = Catalog(spark, f"file://{tmp_path}/index")
    media = Buckets(c, "media", schema, 64)
    assert media.read().count() == 0 and media.upsert(walked(spark, []), 1) == []
    files_ = [(f"d{k % 7}/{k}.jpg", k + 1, k) for k in range(500)]
    assert len(media.upsert(walked(spark, files_), 1)) > 50
    whole = library.upsert(spark.createDataFrame([], schema), walked(spark, files_), 1)
    rows = lambda df: sorted(map(tuple, df.select(*schema.names).collect()), key=repr)
    assert rows(media.read()) == rows(whole)
    held = media.read()
    before = rows(held)
    ten = [(f"d{k % 7}/{k}.jpg", k + 1000, k) for k in range(0, 450, 50)] + [("new/1.jpg", 5, 5)]
    known = spark.createDataFrame(before, schema)
    assert 1 <= len(media.upsert(walked(spark, ten), 2)) <= 10  # ten paths: ten buckets at most
    assert rows(media.read()) == rows(library.upsert(known, walked(spark, ten), 2)) and rows(held) == before
    assert media.upsert(walked(spark, [x for x in files_ if x[0] not in dict((y[0], y) for y in ten)]), 3) == []  # a rescan that finds nothing new
    known = spark.createDataFrame(rows(media.read()), schema)
    some = walked(spark, files_[:490])
    lib = known.first()["lib"]
    touched = media.mark_missing(some, lib)
    assert 1 <= len(touched) <= 11 and rows(media.read()) == rows(library.mark_missing(known, some, lib)) and media.mark_missing(some, lib) == []
    known = spark.createDataFrame(rows(media.read()), schema)
    ids = spark.createDataFrame([(3,), (250,), (501,), (9999,)], "id long")
    stars = lambda df: df.withColumn("rating", F.when(F.col("id").isin(3, 250, 501), 5).otherwise(F.col("rating")).cast("int" if str(schema["rating"].dataType) == "IntegerType()" else "long"))
    assert 1 <= len(media.change(ids, stars)) <= 3 and rows(media.read()) == rows(stars(known))
    assert media.change(ids.filter("id = 9999"), stars) == []
    gone = media.change(ids, lambda df: df.filter(~F.col("id").isin(3, 250, 501)))
    assert len(gone) <= 3 and media.read().count() == 498
    media.upsert(walked(spark, [("z/9.jpg", 1, 1)]), 4)
    assert media.read().agg(F.max("id")).first()[0] == 502  # ids are not given twice


def test_routing(spark):
    df = spark.createDataFrame([("20240203_040506.jpg", b"x", None), ("a:b.jpg", b"2023:05:06 07:08:09", None), ("c.jpg", b"", None)], "name string, content binary, taken long")
    assert sorted((r["name"], r["sub"]) for r in routed(df, 0).collect()) == [("20240203_040506.jpg", "2024-02"), ("a_b.jpg", "2023-05"), ("c.jpg", "1970-01")]


def test_excludes(spark):
    assert spark.range(1).select(S.excludes_list(F.lit(" a/ \n\n/b/c\r\n")).alias("x")).first()["x"] == ["a", "b/c"]


def test_paths_met_twice_count_once(spark):
    old = frame(spark, item(1), item(2))
    seen = walked(spark, [("a/1.jpg", 101, 1), ("a/1.jpg", 555, 9), ("a/1.jpg", 7, 3), ("a/n.jpg", 1, 1), ("a/n.jpg", 2, 2), ("a/n.jpg", 2, 2)])
    got = {r["path"]: (r["id"], r["bytes"], r["mtime"]) for r in library.upsert(old, seen, 5).collect()}
    assert got == {"a/1.jpg": (1, 555, 9), "a/2.jpg": (2, 102, 2), "a/n.jpg": (3, 2, 2)} and library.upsert(old, seen, 5).count() == 3


def test_numbers_are_distinct_with_further_columns(spark):
    n = 50_000
    df = spark.range(n, numPartitions=7).select(F.sha2(F.col("id").cast("string"), 256).alias("path"), F.col("id").alias("other"), F.repeat(F.lit("x"), 20).alias("third"))
    got = library.numbered(df, [F.col("path")], 100).select("path", "number", "other").orderBy("path").collect()
    assert [r["number"] for r in got] == list(range(101, 101 + n)) and sorted(r["other"] for r in got) == list(range(n))
    assert library.numbered(df.limit(0), [F.col("path")]).count() == 0


def test_edits_take_free_names(spark):
    m = frame(spark, item(1, name="p.jpg", path="a/p.jpg", rel="a/p.jpg"), item(2, name="p-edited.jpg", path="a/p-edited.jpg", rel="a/p-edited.jpg"), item(3, name="p-edited (2).jpg"), item(4, name="q", path="a/q", rel="a/q", rating=4))
    edits = spark.createDataFrame([(1, 50), (4, 60)], "id long, bytes long")
    got = {r["id"]: (r["name"], r["path"], r["bytes"], r["rating"], r["state"]) for r in library.edited_copies(m, edits, 9).collect()}
    assert len(got) == 6 and got[5] == ("p-edited (1).jpg", "a/p-edited (1).jpg", 50, 0, 0) and got[6] == ("q-edited.jpg", "a/q-edited.jpg", 60, 0, 0)


def test_archives_hold_the_files(spark, tmp_path):
    import zipfile

    from medialoom.operators import zips

    items = spark.createDataFrame([(1, 2, 1, 0), (1, 1, 0, 0), (1, 3, 2, 0), (2, 1, 0, 0), (2, 9, 1, 0)], "coll long, media long, ord long, added long")
    m = frame(spark, item(1, name="x.jpg"), item(2, name="x.jpg"), item(3, name="y.jpg", deleted=1), item(9, name="z"))
    for i in (1, 2, 3, 9):
        (tmp_path / f"{i}").write_bytes(b"c%d" % i)
    manifest = sets.export_manifest(items, m).withColumn("path", F.concat(F.lit(f"{tmp_path}/"), F.col("media").cast("string"))).withColumn("bytes", F.lit(2))
    got = {r["coll"]: zipfile.ZipFile(r["path"].removeprefix("file://")) for r in zips.put_together(spark, zips.written(manifest, f"{tmp_path}/out"), f"{tmp_path}/out").collect()}
    assert {k: [(n, z.read(n)) for n in z.namelist()] for k, z in got.items()} == {1: [("x.jpg", b"c1"), ("x (2).jpg", b"c2")], 2: [("x.jpg", b"c1"), ("z", b"c9")]}
    assert sorted(map(tuple, sets.archive_bytes(items, m).collect())) == [(1, 2, 203), (2, 2, 210)]
    files_ = spark.createDataFrame([("t/export-1.zip", "export-1.zip", 10), ("t/export-2.zip", "export-2.zip", 9000), ("t/a.zip", "a.zip", 1)], "path string, name string, mtime long")
    assert [r["name"] for r in sets.stale_exports(files_, 9100).collect()] == ["export-1.zip"]


def test_libraries_join_and_hold(spark):
    libs = spark.createDataFrame([(4, "/p/one", "One", "#0", 0, None)], "id long, path string, name string, color string, added_at long, excludes string")
    new = spark.createDataFrame([("/p/one/", "Uno"), ("C:\\photos\\", None), ("C:/photos", " "), ("/", "")], "path string, name string")
    got = {r["path"]: (r["id"], r["name"], r["color"]) for r in library.add_libraries(libs, new, 3).collect()}
    assert got["/p/one"] == (4, "Uno", "#0") and got["C:/photos"][1:] == ("photos", "#B48CE0") and len(got) == 3
    inner = libs.unionByName(spark.createDataFrame([(7, "/p/one/in", "In", "#1", 0, None)], libs.schema))
    paths = spark.createDataFrame([("/p/one/a.jpg",), ("/p/one/in/b.jpg",), ("/p/one2/c.jpg",), ("/p/one",)], "path string")
    assert {r["path"]: r["lib"] for r in library.library_of(paths, inner).collect()} == {"/p/one/a.jpg": 4, "/p/one/in/b.jpg": 7, "/p/one2/c.jpg": None, "/p/one": 4}


def test_models_are_reset_and_people_found_anew(spark):
    r = np.random.default_rng(1)
    base = r.normal(size=(3, 8))
    rows = [(i, i, None if i % 2 else 50, (base[i % 3] + 0.01 * r.normal(size=8)).tolist(), i / 20) for i in range(12)] + [(99, 99, 50, r.normal(size=8).tolist(), 0.1)]
    unit = lambda v: (np.array(v) / np.linalg.norm(v)).tolist()
    f = spark.createDataFrame([(i, m, c, unit(v), s) for i, m, c, v, s in rows], "id long, media long, cluster long, vec array<float>, score double")
    p = spark.createDataFrame([(50, "Mixed", 2, 0)], "id long, name string, cover long, hidden int")
    out = vectors.recluster({"faces": f, "people": p, "media": frame(spark, item(1))}, threshold=0.9)
    got = by_id(out["faces"], "cluster")
    assert len({got[i] for i in range(12)}) == 3 and all(got[i] == got[i % 3] for i in range(12)) and got[99] is None
    assert by_id(out["people"], "name", "cover") == {got[k]: ("", 9 + k) for k in range(3)}
    reset = library.reset_models({"faces": f, "people": p, "media": frame(spark, item(1, facedone=1))}, "faces")
    assert reset["faces"].count() == reset["people"].count() == 0 and by_id(reset["media"], "facedone") == {1: 0}
    with pytest.raises(ValueError):
        library.reset_models({}, "x")


def test_clustering_of_assigned_faces_alone(spark):
    f = spark.createDataFrame([(1, 3, [1.0, 0.0]), (2, 3, [0.0, 1.0])], "id long, cluster long, vec array<float>")
    assert by_id(vectors.cluster(f, spark.createDataFrame([(3,)], "id long")), "cluster") == {1: 3, 2: 3}


def test_search_leaves_out_what_is_not_active(spark):
    m = frame(spark, item(1, taken=10), item(2, deleted=1), item(3, missing=1), item(4, taken=40, dur=2.6))
    clip = spark.createDataFrame([(i, [s, 0.0]) for i, s in ((1, 0.31), (2, 0.9), (3, 0.9), (4, 0.32), (5, 0.8))], "media long, vec array<float>")
    got = [tuple(r)[:2] + (r["ts"], r["dur"]) for r in vectors.search_library(clip, m, [1.0, 0.0]).collect()]
    assert got == [(1, 4, 40, 3), (2, 1, 10, 0)]
    assert vectors.search_library(clip, m, [0.5, 0.0]).count() == 0  # the best is under the floor


def test_nearest_of_odd_vectors(spark, monkeypatch):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 2.0, 9.0]), (4, [1.0])], "id long, vec array<float>")
    c = spark.createDataFrame([(9, [0.0, 1.0]), (5, [1.0, 0.0]), (7, [1.0, 0.0])], "id long, vec array<double>")
    for bound in (64 << 20, 20):
        monkeypatch.setattr(vectors, "MATRIX_BYTES", bound)
        assert by_id(vectors.nearest(v, c), "centre", "score") == {1: (5, 1.0), 3: (9, 2.0), 4: (5, 1.0)}
    assert vectors.nearest(v, c.limit(0)).count() == 0


def test_walk_meets_hidden_names_but_not_our_own(spark, tmp_path):
    for p in (".hidden.jpg", "_under/x.png", ".dot/y.png", ".mybin/z.png", "Data/cache.png", "deep/1/2/3/4/5/w.jpg", "ü ber%20/é #1.jpg"):
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"data")
    (tmp_path / "loop").symlink_to(tmp_path)
    got = {r["rel"] for r in files.walk(spark, str(tmp_path), 1, own=["data"]).collect()}
    assert got == {".hidden.jpg", "_under/x.png", ".dot/y.png", "deep/1/2/3/4/5/w.jpg", "ü ber%20/é #1.jpg"}
    assert [r["name"] for r in files.browse(spark, str(tmp_path)).collect()] == [".dot", "_under", "Data", "deep", "ü ber%20"]
    (tmp_path / "none").mkdir()
    assert files.walk(spark, f"{tmp_path}/none", 1).count() == 0


def test_uploads_are_written_under_free_names(spark, tmp_path):
    up = spark.createDataFrame([(1, "a.jpg", b"one", 0), (2, "a.jpg", b"two", 0), (3, "b:c.jpg", b"three", 86400 * 40), (4, "a (2).jpg", b"four", 0)], "id long, name string, content binary, taken long")
    taken = spark.createDataFrame([("1970-01", "a.jpg")], "sub string, name string")
    done = take_uploads(up, taken, str(tmp_path), now=0)
    assert sorted(r["bytes"] for r in done.collect()) == [3, 3, 4, 5]
    got = {str(p.relative_to(tmp_path)): p.read_bytes() for p in tmp_path.rglob("*.jpg")}
    assert got == {"1970-01/a (1).jpg": b"one", "1970-01/a (3).jpg": b"two", "1970-02/b_c.jpg": b"three", "1970-01/a (2).jpg": b"four"}
    met = {r["rel"] for r in files.walk(spark, str(tmp_path), 1).collect()}
    assert met == set(got)
