"""A registry of fetched sources: membership by URL, and what is new."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import native

#: The registry's columns.
HEADER = ["SOURCE_ID", "SOURCE_TYPE", "ORIGIN_URL", "TITLE", "FETCH_TIME", "ENCODING", "CHAR_LEN", "LICENSE", "RAW_FILE"]


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Rows as wide as the header."""
    cells = HEADER + ["MORE"]
    raw = spark.read.schema(", ".join(f"{c} string" for c in cells)).csv(path, sep="\t", quote='"', escape='"')
    return raw.where((F.col("RAW_FILE").isNotNull()) & F.col("MORE").isNull() & (F.col("SOURCE_ID") != "SOURCE_ID")).drop("MORE")


def registered(df: DataFrame, registry: DataFrame, url_col: str = "origin_url") -> DataFrame:
    return df.join(registry.select(F.col("ORIGIN_URL").alias(url_col)).distinct(), url_col, "left_semi")


def unregistered(df: DataFrame, registry: DataFrame, url_col: str = "origin_url") -> DataFrame:
    return df.join(registry.select(F.col("ORIGIN_URL").alias(url_col)).distinct(), url_col, "left_anti")


def new_entries(results: DataFrame, registry: DataFrame, overwrite: bool = False) -> DataFrame:
    """Registry rows, with the text to store in ``content``, for successful results whose URL is not known: one for each
    URL, that of the least source id. With ``overwrite`` also for known URLs, whose rows they replace in ``merged``."""
    good = results.where("success")
    fresh = good if overwrite else unregistered(good, registry)
    first = fresh.groupBy("origin_url").agg(F.min(F.struct("source_id", *[c for c in fresh.columns if c not in ("source_id", "origin_url")])).alias("m")).select("origin_url", "m.*")
    content = F.when(F.coalesce("extracted_text", F.lit("")) != "", F.col("extracted_text")).otherwise(F.coalesce("raw_content", F.lit("")))
    title = F.when(F.coalesce("title", F.lit("")) == "", "corpus").otherwise(F.col("title"))
    raw_file = F.concat(F.col("source_id"), F.lit("_"), native.file_name(title), F.lit(".txt"))
    return first.select(
        F.col("source_id").alias("SOURCE_ID"), F.col("source_type").alias("SOURCE_TYPE"), F.col("origin_url").alias("ORIGIN_URL"), F.translate(F.coalesce("title", F.lit("")), "\t\n", "  ").alias("TITLE"),
        F.col("fetch_time").alias("FETCH_TIME"), F.col("encoding").alias("ENCODING"), F.length(content).cast("string").alias("CHAR_LEN"), F.col("license").alias("LICENSE"), raw_file.alias("RAW_FILE"), content.alias("content"),
    )


def merged(registry: DataFrame, new: DataFrame) -> DataFrame:
    """The registry with new rows, which replace those of the same URL."""
    rows = new.select(*HEADER)
    return registry.join(rows.select("ORIGIN_URL"), "ORIGIN_URL", "left_anti").select(*HEADER).unionByName(rows)
