"""The cleaning plan: documents to numbered, profiled sentences, and its statistics.

documents -> clean -> normalise -> drop notices -> sentences -> filters -> keep first -> number -> profile.
Two shuffles: of accepted sentences, combined before, and of kept sentences to their documents.
"""

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import udfs
from ..operators import clean, profile, segment
from ..options import CleanOptions

COUNTERS = ["html_tags", "urls_and_emails", "punct_compressed", "invisible_chars", "boilerplate_lines"]


def clean_documents(docs: DataFrame, options: CleanOptions = CleanOptions()) -> DataFrame:
    """``docs`` with cleaned ``text``, the counters, and ``raw_chars``."""
    out = docs.withColumn("raw_chars", F.length("text"))
    for step in (clean.clean, clean.normalize, clean.drop_boilerplate):
        out = step(out, options)
    return out


def label(cleaned: DataFrame, options: CleanOptions, order: list[str]) -> DataFrame:
    """All sentences of cleaned documents with ``reason``, before deduplication."""
    keys = list(dict.fromkeys(["doc_key", "doc_id", *order]))
    exploded = segment.explode_sentences(cleaned.select(*keys, "text"), options.protect_dialog_quotes)
    return segment.label_sentences(exploded, options, stripped=True)


def items(labelled: DataFrame, options: CleanOptions, order: list[str], category: str = "general", adapter: profile.Adapter | None = None) -> DataFrame:
    """Kept sentences as items, profiled unless the options say otherwise."""
    kept = segment.keep_first(labelled, options, "doc_key", [*order, "sent_ord"])
    numbered = segment.number_sentences(kept, "doc_key", "doc_id")
    base = numbered.select("corpus_id", F.col("sentence").alias("clean_text"), F.lit(category).alias("category"), "doc_id", *[c for c in order if c != "doc_id"], "sent_ord")
    if not options.enable_lexicon_profiling:
        return base.withColumns({"char_len": F.length("clean_text"), "oov_rate": F.lit(0.0), "feasible": F.lit(True), "difficulty": F.lit("L1"), "note": F.lit("")})
    return profile.profile_items(base, adapter or profile.LexiconAdapter())


def run(docs: DataFrame, options: CleanOptions = CleanOptions(), *, doc_key: Column | None = None, order: list[str] = ("path_parts", "row_idx"), category: str = "general", adapter: profile.Adapter | None = None, storage: StorageLevel | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items, labelled sentences and cleaned documents of ``docs`` (``doc_id``, ``text`` and the columns ``order``). All are lazy;
    with ``storage`` cleaned documents are persisted there, so that items and ``run_stats`` clean them once."""
    key = doc_key if doc_key is not None else F.struct(*order)
    cleaned = clean_documents(docs.withColumn("doc_key", key), options)
    if storage is not None:
        cleaned = cleaned.persist(storage)
    labelled = label(cleaned, options, list(order))
    return items(labelled, options, list(order), category, adapter), labelled, cleaned


def run_stats(cleaned: DataFrame, labelled: DataFrame, made: DataFrame) -> DataFrame:
    """One row of the run's counters."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    docs = cleaned.agg(F.count("*").alias("documents"), total("raw_chars"), *(total(c) for c in COUNTERS))
    reasons = labelled.agg(*(F.count_if(F.col("reason") == r).alias(f"dropped_{r}") for r in ("short", "long", "non_chinese")), F.count_if(F.col("reason").isNull()).alias("passed"))
    kept = made.agg(F.count("*").alias("clean_sentences"), F.coalesce(F.sum("char_len"), F.lit(0)).cast("long").alias("clean_chars"))
    one = F.lit(1).alias("one")
    joined = docs.select("*", one).join(reasons.select("*", one), "one").join(kept.select("*", one), "one").drop("one")
    return joined.withColumn("dropped_duplicate", F.col("passed") - F.col("clean_sentences")).drop("passed")


def stats_alone(docs: DataFrame, options: CleanOptions = CleanOptions(), *, doc_key: Column | None = None, order: list[str] = ("path_parts", "row_idx")) -> DataFrame:
    """The row of ``run_stats`` where the items aren't wanted: in one pass, which cleans and segments each document once,
    persists nothing and shuffles accepted sentences, combined before."""
    cleaned = clean_documents(docs.withColumn("doc_key", doc_key if doc_key is not None else F.struct(*order)), options)
    of_documents = ["raw_chars", *COUNTERS]
    sentences = udfs.sentences(F.col("text"), options.protect_dialog_quotes)
    rows = segment.label_sentences(cleaned.select("doc_key", *of_documents, F.posexplode_outer(sentences).alias("sent_ord", "sentence")), options, stripped=True)
    held, first = F.col("sentence").isNotNull(), F.coalesce(F.col("sent_ord"), F.lit(0)) == 0
    passed = held & F.col("reason").isNull()
    by = (["sentence"] + ["doc_key"] * (options.dedup_scope == "document")) * options.deduplicate
    counts = {"documents": first.cast("int"), **{c: F.when(first, F.col(c)) for c in of_documents}, **{f"dropped_{r}": (F.col("reason") == r).cast("int") for r in ("short", "long", "non_chinese")}, "passed": passed.cast("int"), "chars": F.when(passed, F.length("sentence"))}
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    groups = rows.groupBy(*(F.when(passed, F.col(c)).alias(c) for c in by), passed.alias("kept")).agg(*(F.sum(x).alias(c) for c, x in counts.items()))
    kept = F.count_if("kept") if by else total("passed")
    chars = F.coalesce(F.sum(F.when(F.col("kept"), F.length("sentence"))), F.lit(0)).cast("long") if by else total("chars")
    out = groups.agg(*(total(c).alias(c) for c in counts if c != "chars"), kept.alias("clean_sentences"), chars.alias("clean_chars"))
    return out.select(*(c for c in counts if c not in ("passed", "chars")), "clean_sentences", "clean_chars", (F.col("passed") - F.col("clean_sentences")).alias("dropped_duplicate"))
