"""Parquet tables by folder and name."""

from pyspark.sql import DataFrame, SparkSession

DEAL = "glyphmill.scan.partitions"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Texts vary from a word to megabytes, so an Arrow batch is bounded by its bytes, whatever its rows. A session that
    was given a bound keeps it; any other gets ``most``, smaller than Spark's default, for plans run when the caller
    acts on them."""
    if BATCH_BYTES not in spark.conf.getAll:
        spark.conf.set(BATCH_BYTES, str(most))


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table's rows, dealt as its files and ``spark.sql.files.maxPartitionBytes`` say, whatever its size. A session that
    sets DEAL gets every table dealt anew to as many partitions: for files whose few row groups would keep most cores idle."""
    bounded_batches(spark)
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    deal = spark.conf.get(DEAL, None)
    return df.repartition(int(deal)) if deal else df
