"""The per-document part of the cleaning plan on a stream of files.

Cleaning, segmentation and filters keep no state. Deduplication does: within a watermark, equal sentences
pass once, which is weaker than the plan's first of the whole source and is not numbered.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.segment import explode_sentences, label_sentences
from ..options import CleanOptions
from ..plans.corpus import clean_documents
from ..sources.files import parse_files


def sentence_stream(files: DataFrame, options: CleanOptions = CleanOptions(), watermark: str = "1 hour") -> DataFrame:
    """Accepted sentences of a stream of ``path``, ``modificationTime`` and ``content``."""
    docs = parse_files(files.select("path", "content")) if not files.isStreaming else parse_files(files)
    return accepted(docs.withColumn("seen_at", F.current_timestamp()), options, watermark)


def accepted(docs: DataFrame, options: CleanOptions = CleanOptions(), watermark: str = "1 hour") -> DataFrame:
    """Accepted sentences of documents ``doc_id``, ``text``, ``seen_at``."""
    cleaned = clean_documents(docs.select("doc_id", "text", "seen_at"), options)
    labelled = label_sentences(explode_sentences(cleaned.select("doc_id", "seen_at", "text"), options.protect_dialog_quotes), options, stripped=True)
    passed = labelled.where("reason is null").select("doc_id", "sent_ord", "sentence", "seen_at")
    return passed.withWatermark("seen_at", watermark).dropDuplicatesWithinWatermark(["sentence"]) if options.deduplicate else passed


def file_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(folder)
