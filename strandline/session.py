"""Session helpers: a tuned local session, table loading, and lineage cutting."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: str | int = "*", app: str = "strandline") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("STRANDLINE_DRIVER_MEMORY", "6g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; set a local one where none is set and all executors are on this machine."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if shared is None:
        shared = tempfile.mkdtemp(prefix="strandline-ckpt-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    sc.setCheckpointDir(shared)


def cut(df: DataFrame, *spent: DataFrame) -> DataFrame:
    """Cut lineage through a table on the shared checkpoint folder (survives lost executors).

    Not ``checkpoint()``: that hands the plan's size estimate on to the next
    round of a loop, where estimates multiply until planning takes minutes. A
    table read again has its real size. ``spent`` are tables of earlier cuts
    that nothing reads once this one is written; they are deleted then.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    for old in spent:
        drop_cut(old)
    free_shuffles(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._strandline_cut = path
    return out


def free_shuffles(spark: SparkSession) -> None:
    """Have the shuffle files deleted that nothing refers to any more.

    Executors keep them until the driver collects its garbage, which it may
    not do before the disk is full. What reads a cut reads none of them.
    """
    gc.collect()  # Python's references to plans count too
    spark.sparkContext._jvm.System.gc()


def cut_count(df: DataFrame, *spent: DataFrame, where: str = "true") -> tuple[DataFrame, int]:
    """``cut``, and how many of the rows written meet a condition, counted while they are written."""
    seen = Observation()
    out = cut(df.observe(seen, F.count_if(F.expr(where)).alias("n")), *spent)
    return out, int(seen.get.get("n") or 0)


def drop_cut(df: DataFrame) -> None:
    """Delete the table of a cut, on whatever file system it is."""
    path = getattr(df, "_strandline_cut", None)
    if path is not None:
        spark = df.sparkSession
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def small_rows(df: DataFrame, most: int) -> list[Row]:
    """The rows of a list of settings, refused if they are more than ``most``."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows where a short list belongs")
    return rows
