"""Session builder, table loader and the shared folder for staged tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(cpus: int | None = None, app: str = "diffloom") -> SparkSession:
    """A local session for tests and benches; a cluster brings its own."""
    cpus = cpus or os.cpu_count() or 8
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # recording where each Column is made slows plan building
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp"))
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session, so that they need not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_diffloom_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="diffloom-"), "diffloom.zip")  # read by the driver alone, which serves it
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("diffloom", os.path.relpath(full, root)))
    context.addPyFile(archive)
    context._diffloom_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables below ``sf_dir``."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for work that is heavy per row: spread over all cores where its files make fewer partitions than that.

    A table of many files is left as it is; only one that a few tasks would read whole is moved, once, as it is read.
    """
    df = table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or one of our own where it is unset and all run here.

    On a cluster it must be set: a folder of one machine would lose what the other machines write.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts the lineage: later stages that read the table more than once do not recompute it, and a lost
    executor costs a re-read of files instead of a rerun of the job before them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


_written: dict[str, list[str]] = {}


def release(spark: SparkSession) -> int:
    """Delete the tables this application has staged so far; results that read them must have been consumed."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(conf).delete(at, True)
    return len(paths)
