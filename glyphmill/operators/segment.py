"""Sentences: explosion, length and script filters, keep-first deduplication, numbering."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import native, udfs
from ..options import CleanOptions


def explode_sentences(df: DataFrame, protect_quotes: bool = True, text_col: str = "text") -> DataFrame:
    """A row for each sentence of each text: ``sent_ord`` and ``sentence`` in place of ``text_col``."""
    others = [c for c in df.columns if c != text_col]
    return df.select(*others, F.posexplode(udfs.sentences(F.col(text_col), protect_quotes)).alias("sent_ord", "sentence"))


def drop_reason(bare: Column, options: CleanOptions = CleanOptions()) -> Column:
    """Why a stripped sentence is dropped before deduplication (short, long or non_chinese), or null."""
    reason = F.when(F.length(bare) < options.min_sentence_len, "short")
    if options.max_sentence_len > 0:
        reason = reason.when(F.length(bare) > options.max_sentence_len, "long")
    if options.require_chinese:
        reason = reason.when(~bare.rlike(r"[\x{4e00}-\x{9fff}]"), "non_chinese")
    return reason


def first_of_each(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Of the rows that agree in ``by`` the one least in ``order``. The minimum is combined before the shuffle, so a
    sentence that fills a third of the table reaches its task once from each of the others."""
    rest = [c for c in df.columns if c not in by and c not in order]
    least = df.groupBy(*by).agg(F.min(F.struct(*order, *rest)).alias("m"))
    return least.select(*(F.col(c) if c in by else F.col(f"m.{c}").alias(c) for c in df.columns))


def label_sentences(df: DataFrame, options: CleanOptions, stripped: bool = False) -> DataFrame:
    """``reason`` for each sentence (null: it passes). ``stripped``: sentences are known to be, as those of
    ``explode_sentences``. Duplicates are told later, by ``keep_first``."""
    bare = df if stripped else df.withColumn("sentence", native.strip(F.col("sentence")))
    return bare.withColumn("reason", drop_reason(F.col("sentence"), options))


def keep_first(df: DataFrame, options: CleanOptions, doc_key: str, order: list[str]) -> DataFrame:
    """The accepted sentences: those without a reason to drop, the first of equal ones in the whole source or,
    with ``dedup_scope`` "document", in each document."""
    passed = df.where("reason is null")
    if not options.deduplicate:
        return passed
    by = ["sentence"] + ([doc_key] if options.dedup_scope == "document" else [])
    return first_of_each(passed, by, [c for c in order if c not in by])


def number_sentences(df: DataFrame, doc_key: str, doc_id: str, id_col: str = "corpus_id") -> DataFrame:
    """``id_col``: the document's id and the sentence's number among those that its document kept."""
    n = F.row_number().over(Window.partitionBy(doc_key).orderBy("sent_ord"))
    return df.withColumn(id_col, F.format_string("%s_%04d", F.col(doc_id).cast("string"), n))
