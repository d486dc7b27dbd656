"""Session factory and settings that every query of the library relies on."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once an application, so that they can import it wherever they run. A package that lies in an archive came that way already."""
    sc, here = spark.sparkContext, os.path.dirname(os.path.abspath(__file__))
    if sc.applicationId in _SHIPPED or not os.path.isdir(here):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="medialoom-"), "medialoom.zip")
    with zipfile.ZipFile(path, "w") as z:
        for top, _, names in os.walk(here):
            for n in sorted(names):
                if n.endswith(".py"):
                    z.write(os.path.join(top, n), os.path.join("medialoom", os.path.relpath(os.path.join(top, n), here)))
    sc.addPyFile(path)  # the driver serves it to all executors
    _SHIPPED.add(sc.applicationId)


_ROOTS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir, which driver and executors share; it goes when the driver ends. Where the setting is absent, a local master gets a temporary folder, and any other an error."""
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            at = "file://" + tempfile.mkdtemp(prefix="medialoom-")
        _ROOTS[app] = f"{at.rstrip('/')}/medialoom-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_deleter(spark), _ROOTS[app])
    return _ROOTS[app]


def materialised(df, what: str):
    """The frame written to the shared folder and read back: evaluated once, whatever reads it, and kept when executors are lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def dropped(*frames) -> None:
    """Deletes what `materialised` wrote for these frames, once nothing reads it any more; other frames are left alone."""
    for df in frames:
        if getattr(df, "saved_at", None):
            remove(df.sparkSession, df.saved_at)


def _deleter(spark: SparkSession):
    """Deletes a path; holds what it needs, so it works when the session has been stopped."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def delete(path: str) -> None:
        try:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
        except Exception:  # the JVM can have ended before the driver's Python
            pass

    return delete


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder in any store that Spark writes to. What is gone, or cannot be reached any more, is no error."""
    _deleter(spark)(path)


def get_spark(app: str = "medialoom", cores: int | None = None, **conf: str) -> SparkSession:
    """A session with UTC, ANSI mode and adaptive execution; on a cluster the master comes from spark-submit."""
    b = SparkSession.builder.appName(app)
    if cores is not None:
        b = b.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", str(max(2 * cores, 8)))
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in (settings | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
