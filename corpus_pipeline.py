"""A corpus pipeline of five stages: toxicity, exact copies, near copies, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all but the last return the
columns of ``documents``. For every stage: rows that repeat are treated alike, ties are broken by id, an empty table gives
no rows, very long texts are read whole, and further columns of any name pass through unread. ``run`` writes each stage's result as Parquet in the shared folder and reads it back.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm.exact_dedup import drop_copies
from glyphmill.llm.packing import pack
from glyphmill.llm.queries import table, vocabulary
from glyphmill.llm.shared import bounded_batches, written
from glyphmill.llm.shingle_join import drop_near_copies
from glyphmill.llm.surrogates import replace_entities
from glyphmill.llm.toxicity import drop_toxic, train

REJECT_FROM = 0.5


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, fitted on the labelled ones among ``docs``, scores below REJECT_FROM. Null and empty texts
    get the score of no evidence; without usable labels all documents score 0.5 and, as nothing tells against them, stay."""
    bounded_batches(spark)
    model = train(docs, table(spark, sf_dir, "labels"))
    return drop_toxic(docs, model, reject_from=REJECT_FROM) if model.words.size else docs


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null equals empty) the row with the largest id, a null id being less than any; of rows that share
    it, one."""
    bounded_batches(spark)
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of five-word shingles at 80 % connect, the rows with the least id. Rows without words and
    rows without id stay."""
    bounded_batches(spark)
    return drop_near_copies(docs, width=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for the entities in their texts; ``n_chars`` follows the new text. Null texts stay
    null and keep their ``n_chars``."""
    bounded_batches(spark)
    replaced = replace_entities(docs)
    if "n_chars" not in docs.columns:
        return replaced
    return replaced.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 tokens; a null or empty text is its end token alone."""
    bounded_batches(spark)
    return pack(docs, vocabulary())


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("personal_data", personal_data), ("packing", packing)]

#: Scores, signatures and token ids can't be expressed in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
