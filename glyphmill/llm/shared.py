"""Folders that the driver and all executors share, and tables written there to cut lineage."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import BATCH_BYTES, bounded_batches  # noqa: F401

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
COLLECT_EVERY = 8
writes = 0


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. A local master may lack one and then gets its own
    temporary folder; a cluster must name it, since a machine-local folder would lose data there."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    base = "file://" + tempfile.mkdtemp(prefix="glyphmill-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared folder; writers create it."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: the plan ends here, so a lost
    executor costs a re-read rather than a recomputation. What the plan shuffled is removed with the end of the write; by
    default it stays until the driver happens to collect its garbage, and the shuffles of many steps add up. The
    driver's heap, which otherwise grows to its bound first, is collected every COLLECT_EVERY writes."""
    global writes
    spark = df.sparkSession
    path, before = new_dir(spark, name), spark.conf.getAll.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    writes += 1
    if writes % COLLECT_EVERY == 0:
        spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def partitions_for(df: DataFrame, bytes_each: int, factor: float = 1.0) -> int:
    """Number of shuffle partitions so that ``factor`` times the optimizer's size estimate of ``df``
    falls into pieces of ``bytes_each``, and never fewer than the session's setting (which holds alone where
    the optimizer has no estimate, as for local rows)."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return least if size >= 1 << 60 else max(least, int(size * factor) // bytes_each + 1)
