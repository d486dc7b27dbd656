"""Reading media folders: walks, path columns, metadata probes."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from medialoom.functions import images as I
from medialoom.functions import scalar as S
from medialoom.session import materialised
from medialoom.sources import ranges

#: Folders that are never media: the bin, system folders, and names that begin with $.
SKIPPED = r"(^|/)(\$[^/]*|System Volume Information|\.[^/]*bin|\.trash)(/|$)"


def walk(spark: SparkSession, root: str, lib: int, excludes: list[str] = [], bare: bool = False, own: list[str] = []) -> DataFrame:
    """Files below a root as rows for an upsert: path, lib, rel, sub, name, ext, kind, bytes, mtime. No content is read. Empty files, unknown extensions, skipped and excluded folders, and folders of our own (`own`, paths below the root, case ignored) are left out; `bare` keeps files of every extension."""
    df = listed(spark, root).filter(F.col("length") > 0).filter(~F.col("rel").rlike(SKIPPED))
    for x in excludes:
        df = df.filter(~S.in_subtree(F.col("rel"), x))
    for x in own:
        df = df.filter(~S.in_subtree(F.lower("rel"), x.lower()))
    df = df.withColumn("name", S.name_of(F.col("rel"))).withColumn("ext", S.extension_of(F.col("name"))).withColumn("kind", S.kind_of_extension(F.col("ext")))
    df = df if bare else df.filter(F.col("kind").isNotNull())
    return df.select("path", F.lit(lib).cast("long").alias("lib"), "rel", S.parent_of(F.col("rel")).alias("sub"), "name", "ext", "kind", F.col("length").alias("bytes"), "mtime")


def listed(spark: SparkSession, root: str) -> DataFrame:
    """path, rel, length and mtime of every file below a root, names that begin with a dot or an underscore included (Spark's own readers pass over them). Folders are listed level by level, each by a task of its own, so a tree of any width spreads over the executors; links are not followed."""
    base = (root if "://" in root or root.startswith("file:") else "file://" + root).rstrip("/")
    levels, n = [], int(spark.conf.get("spark.sql.shuffle.partitions"))
    dirs = spark.createDataFrame([("",)], "rel string")
    while True:
        found = materialised(dirs.repartition(n, "rel").mapInArrow(_entries(base), "rel string, folder boolean, length long, mtime long"), "listed")
        levels.append(found.filter("not folder"))
        dirs = found.filter("folder").select("rel")
        if dirs.isEmpty():
            break
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out.select(F.concat(F.lit(base + "/"), "rel").alias("path"), "rel", "length", "mtime")


def _entries(base: str):
    def run(batches):
        from pyarrow import fs

        at, top = fs.FileSystem.from_uri(base)
        for batch in batches:
            for rel in batch.column(0).to_pylist():
                rows = []
                for e in at.get_file_info(fs.FileSelector(f"{top}/{rel}" if rel else top)):
                    if at.type_name == "local" and os.path.islink(e.path):
                        continue
                    rows.append((f"{rel}/{e.base_name}" if rel else e.base_name, e.type == fs.FileType.Directory, e.size or 0, int(e.mtime.timestamp()) if e.mtime else 0))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, (pa.string(), pa.bool_(), pa.int64(), pa.int64()))], ["rel", "folder", "length", "mtime"])

    return run


def browse(spark: SparkSession, folder: str) -> DataFrame:
    """name and path of the folders in a folder, by name without regard to case: what a folder picker shows."""
    base = (folder if "://" in folder or folder.startswith("file:") else "file://" + folder).rstrip("/")
    rows = spark.createDataFrame([("",)], "rel string").coalesce(1).mapInArrow(_entries(base), "rel string, folder boolean, length long, mtime long")
    shown = rows.filter("folder").filter(~F.col("rel").rlike(SKIPPED))
    return shown.select(F.col("rel").alias("name"), F.concat(F.lit(base + "/"), "rel").alias("path")).orderBy(F.lower("name"), "name")


#: What the JVM decodes.
DECODED = "*.{jpg,jpeg,png,gif,bmp,JPG,JPEG,PNG,GIF,BMP}"


def decoded(spark: SparkSession, root: str) -> DataFrame:
    """path, bytes, exif and the raster (data, height, width, nChannels) of the files below a root; the raster is NULL where the JVM does not decode a file (other than JPEG, PNG, GIF, BMP, by extension and content). Of files the first 128 KB are read, for their EXIF, and whole ones only with an extension that is decoded."""
    where = {"recursiveFileLookup": "true"}
    raw = spark.read.format("binaryFile").options(**where).load(root).select("path", F.col("length").alias("bytes"))  # content is not asked for, so it is not read
    raw = raw.join(ranges.heads(raw), "path")
    seen = spark.read.format("image").options(**where, dropInvalid="true", pathGlobFilter=DECODED).load(root).select("image.*")
    same = lambda c: F.regexp_replace(c, "^([a-z0-9]+:)/+", "$1/")  # noqa: E731  one reader writes file:/, the other file:///
    joined = raw.withColumn("exif", I.exif("head")).join(seen, same("path") == same("origin"), "left")
    return joined.select("path", "bytes", "exif", "data", "height", "width", "nChannels")


def pictures(spark: SparkSession, root: str, edge: int = 320) -> DataFrame:
    """path, w, h, dhash, thumb, err and EXIF fields of the images below a root, upright; what has no decoder has err."""
    thumb = I.thumbnail_of_raster("data", "height", "width", "nChannels", "exif.orient", F.lit(edge))
    return decoded(spark, root).select("path", "exif", thumb.alias("t")).select("path", "t.*", "exif.make", "exif.model", "exif.taken", "exif.orient")


def recompressed(spark: SparkSession, root: str, quality: int = I.RECOMPRESS_QUALITY, edge: int = 4096) -> DataFrame:
    """path, bytes and jpeg of the images below a root: what a recompression makes of each, NULL where it is not smaller."""
    made = I.recompressed_raster("data", "height", "width", "nChannels", "exif.orient", "bytes", F.lit(quality), F.lit(edge))
    return decoded(spark, root).select("path", "bytes", made.alias("jpeg"))


def stored(uploads: DataFrame, root: str) -> DataFrame:
    """Uploads (sub, name, content) written below a root; path and bytes of each. Names must be free (see library.free_names); a task that runs again writes the same file again."""
    base = (root if "://" in root or root.startswith("file:") else "file://" + root).rstrip("/")

    def run(batches):
        from pyarrow import fs

        at, top = fs.FileSystem.from_uri(base)
        for batch in batches:
            paths, sizes = [], []
            for sub, name, content in zip(*(batch.column(k).to_pylist() for k in range(3))):
                folder = "/".join(x for x in (top, sub) if x)
                at.create_dir(folder, recursive=True)
                with at.open_output_stream(f"{folder}/{name}") as f:
                    f.write(content or b"")
                paths.append("/".join(x for x in (base, sub, name) if x))
                sizes.append(len(content or b""))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], ["path", "bytes"])

    return uploads.select("sub", "name", "content").mapInArrow(run, "path string, bytes long")


def folder_bytes(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


_PROBE = "streams ARRAY<STRUCT<codec_type:STRING,codec_name:STRING,width:INT,height:INT,side_data_list:ARRAY<STRUCT<rotation:DOUBLE>>>>, format STRUCT<duration:STRING,tags:MAP<STRING,STRING>>"


def probe(text: Column) -> Column:
    """w, h, dur, vcodec, acodec, taken, rotation from a prober's JSON; NULL fields where it says nothing."""
    j = F.from_json(text, _PROBE)
    video = F.get(F.filter(j["streams"], lambda s: s["codec_type"] == "video"), F.lit(0))
    audio = F.get(F.filter(j["streams"], lambda s: s["codec_type"] == "audio"), F.lit(0))
    turn = F.get(F.filter(F.transform(video["side_data_list"], lambda d: d["rotation"]), lambda r: r.isNotNull()), F.lit(0))
    return F.struct(
        video["width"].alias("w"), video["height"].alias("h"), j["format"]["duration"].try_cast("double").alias("dur"), video["codec_name"].alias("vcodec"),
        audio["codec_name"].alias("acodec"), S.parse_rfc3339(j["format"]["tags"]["creation_time"]).alias("taken"), turn.alias("rotation"),
    )


def content_hash(content: Column) -> Column:
    """A digest of the whole file: equal for equal files."""
    return F.sha2(content, 256)
