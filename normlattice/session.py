"""Sessions with the settings the operators expect."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "normlattice", **more: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for k, v in (SETTINGS | more).items():
        builder = builder.config(k, v)
    out = builder.getOrCreate()
    ship(out)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a few values that are broadcast; more are joined by a shuffle.
MAX_BROADCAST = 400_000


def small(df: DataFrame, most: int = MAX_BROADCAST) -> DataFrame:
    """df, marked for a broadcast if it has at most `most` rows, which are counted."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; only a local session may go without."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not re.match(r"local($|\[)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not getattr(spark, "_own_scratch", None):
        spark._own_scratch = tempfile.mkdtemp(prefix="scratch-")
    return "file://" + spark._own_scratch


#: Spark's setting by which a query that has ended leaves no shuffle files.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, tag: str, compression: str | None = None) -> DataFrame:
    """df written as Parquet in the scratch folder and read again: lineage ends there.

    The files stay until clear_scratch(), as other results may read them. What was shuffled for them
    goes when they are written: nothing reads it again, and a job of many such tables would else have
    the shuffle files of all of them on disk until the driver's memory is next cleared. The package
    is sent to executors that lack it, as their tasks may run code of it.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


_written: dict[str, list[str]] = {}


def clear_scratch(spark: SparkSession) -> int:
    """Deletes the tables that this application has materialised; results that read them must be written before."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    return len(paths)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to executors that can't import it, once for each application.

    Local workers have the driver's PYTHONPATH and working folder; those of a cluster are asked.
    """
    app, root = spark.sparkContext.applicationId, os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if app in _shipped:
        return
    _shipped.add(app)
    seen = [os.path.abspath(p) for p in ["", *os.environ.get("PYTHONPATH", "").split(os.pathsep)]]
    if spark.sparkContext.master.startswith("local"):
        found = root in seen
    else:
        found = spark.range(1).mapInPandas(_importable, "found boolean").first().found
    if not found:
        # the driver serves the file for as long as it runs
        folder = tempfile.mkdtemp(prefix="normlattice-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(folder, "normlattice"), "zip", root, "normlattice"))


def _importable(frames):
    import importlib.util

    found = importlib.util.find_spec("normlattice") is not None
    for f in frames:
        yield f.assign(found=found)[["found"]]


_importable.__module__ = "__main__"  # sent by value, as the package may be missing
