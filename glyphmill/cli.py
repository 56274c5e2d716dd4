"""Command line: clean, split, fetch, harvest and align over Spark."""

import argparse
import dataclasses
import importlib
import time

from pyspark import StorageLevel
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import align, profile, split
from .options import CleanOptions
from .plans import corpus
from .sinks import tsv
from .sources import feeds, files, registry


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="glyphmill")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("clean", help="files to a cleaned sentence table")
    p.add_argument("input")
    p.add_argument("-o", "--output", default="cleaned_corpus.tsv")
    p.add_argument("--category", default="general")
    p.add_argument("--lexicon", help="tab-separated words, the first cell of each line")
    p.add_argument("--parts", action="store_true", help="a folder of files in no order, for large tables")
    p.add_argument("--min-len", type=int, default=6)
    p.add_argument("--max-len", type=int, default=120)
    p.add_argument("--no-dedup", action="store_true")
    p.add_argument("--no-boilerplate-filter", action="store_true")
    p.add_argument("--chinese-only", action="store_true")
    p.add_argument("--vetted-only", action="store_true")
    p.add_argument("-v", "--verbose", action="store_true")
    p = sub.add_parser("split", help="a cleaned table to three")
    p.add_argument("input")
    p.add_argument("-o", "--output-dir", default="./splits")
    p.add_argument("--hash", action="store_true", help="order by hash and write folders: for tables of any size")
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--train-ratio", type=float, default=0.8)
    p.add_argument("--val-ratio", type=float, default=0.1)
    p.add_argument("--test-ratio", type=float, default=0.1, help="what the other two leave; kept for compatibility")
    p.add_argument("--prefix", default="corpus")
    for name in ("fetch", "harvest"):
        p = sub.add_parser(name, help="web pages and feeds to a raw store" if name == "fetch" else "fetch, clean and export")
        p.add_argument("target", nargs="+")
        p.add_argument("--rss", action="store_true")
        p.add_argument("--wiki", action="store_true")
        p.add_argument("--variant", default="zh-tw", help="of Chinese, for --wiki")
        p.add_argument("--extractor", help="module:function that makes a page's text of its HTML")
        p.add_argument("--max-items", type=int, default=10)
        p.add_argument("--overwrite", action="store_true")
        if name == "fetch":
            p.add_argument("-o", "--output-dir", "--output", dest="raw_dir", default="./raw_corpus")
            p.add_argument("--full", action="store_true")
            continue
        p.add_argument("-o", "--output", default="harvested_benchmark.tsv")
        p.add_argument("--raw-dir", default="./raw_corpus")
        p.add_argument("--category", default="web_harvest")
        p.add_argument("--min-len", type=int, default=6)
        p.add_argument("--max-len", type=int, default=120)
        p.add_argument("--chinese-only", action="store_true")
        p.add_argument("--lexicon")
        p.add_argument("-v", "--verbose", action="store_true")
    p = sub.add_parser("profile", help="profile of a cleaned table")
    p.add_argument("input")
    p.add_argument("--lexicon")
    p = sub.add_parser("export", help="a cleaned table as instruction lines")
    p.add_argument("input")
    p.add_argument("-o", "--output", required=True)
    p.add_argument("--instruction", default="")
    p = sub.add_parser("align", help="parallel-text cards to a table of pairs")
    p.add_argument("input")
    p.add_argument("-o", "--output", default="bilingual_parallel.tsv")
    return top


def lexicon_adapter(spark: SparkSession, path: str | None) -> profile.LexiconAdapter:
    return profile.LexiconAdapter(profile.known_chars(profile.read_lexicon(spark, path)) if path else "")


def named_function(name: str | None):
    """What ``module:function`` names."""
    module, _, function = (name or "").partition(":")
    return getattr(importlib.import_module(module), function) if name else None


def fetched(spark: SparkSession, a: argparse.Namespace):
    """Documents ``source_id`` to ``error_message`` (see FETCH_SCHEMA) for the targets of fetch and harvest."""
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
    if a.wiki:
        urls = feeds.wiki_questions(spark, a.target, a.variant)
        got = feeds.fetch(urls).withColumnRenamed("html", "json")
        docs = feeds.wiki_documents(got).join(urls.select(F.col("title").alias("asked"), "origin_url"), "asked").select("success", "origin_url", "title", "text", "license", "error_message")
        kind = "wiki"
    elif a.rss:
        urls = spark.createDataFrame([(t,) for t in a.target], "url string")
        items = feeds.read_feeds(feeds.fetch(urls).select(F.col("url").alias("feed_url"), F.col("html").alias("xml")))
        pages = feeds.fetch(items.where(F.col("item") < a.max_items).select(F.col("link").alias("url")).where("url like 'http%'").distinct()).where("success") if a.command == "harvest" or a.full else None
        docs = feeds.feed_documents(items, pages, a.max_items).select(F.lit(True).alias("success"), "origin_url", "title", "text", F.lit("Unknown").alias("license"), F.lit(None).cast("string").alias("error_message"))
        kind = "rss"
    else:
        got = feeds.fetch(spark.createDataFrame([(t,) for t in a.target], "url string"))
        page = feeds.extract_html(F.col("html"), named_function(a.extractor))
        docs = got.withColumn("p", page).select("success", F.col("url").alias("origin_url"), F.coalesce("p.title", F.lit("")).alias("title"), F.col("p.body").alias("text"), F.lit("Unknown").alias("license"), "error_message")
        kind = "web"
    source_id = F.concat(F.lit(f"{kind}_"), F.substring(F.md5("origin_url"), 1, 8))
    return docs.select("success", source_id.alias("source_id"), F.lit(kind).alias("source_type"), "origin_url", "title", now.alias("fetch_time"), F.lit("utf-8").alias("encoding"), F.length("text").alias("char_len"), "license", F.col("text").alias("raw_content"), F.col("text").alias("extracted_text"), "error_message")


def store(spark: SparkSession, results, folder: str, overwrite: bool) -> None:
    """New results as text files by name under ``folder``/raw, and the registry as a table beside them."""
    path = f"{folder}/source_registry"
    try:
        known = registry.read_registry(spark, path)
        known = spark.createDataFrame(known.collect(), known.schema) if overwrite else known
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = spark.createDataFrame([], ", ".join(f"{c} string" for c in registry.HEADER))
    new = registry.new_entries(results, known, overwrite).persist()
    new.select("RAW_FILE", "content").write.mode("append").parquet(f"{folder}/raw")
    if overwrite:
        tsv.write_tsv(registry.merged(known, new), path)
    else:
        new.select(*registry.HEADER).write.mode("append").csv(path, sep="\t", header=True, quote='"', escape='"', emptyValue="")


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    began = time.time()
    spark = SparkSession.builder.appName("glyphmill").getOrCreate()
    if a.command == "clean":
        options = dataclasses.replace(CleanOptions(), min_sentence_len=a.min_len, max_sentence_len=a.max_len, deduplicate=not a.no_dedup, filter_news_boilerplates=not a.no_boilerplate_filter, require_chinese=a.chinese_only, vetted_color_only=a.vetted_only)
        docs = files.read_corpus(spark, a.input, vetted_only=a.vetted_only)
        made, labelled, cleaned = corpus.run(docs, options, category=a.category, adapter=lexicon_adapter(spark, a.lexicon), storage=StorageLevel.DISK_ONLY)
        made = made.persist()
        order = ["path_parts", "row_idx", "sent_ord"]
        if a.parts:
            tsv.write_tsv(tsv.item_columns(made), a.output)
        else:
            tsv.write_file(tsv.item_columns(made.orderBy(*order)), a.output, [])
        corpus.run_stats(cleaned, labelled, made).withColumn("elapsed_seconds", F.lit(round(time.time() - began, 3))).show(vertical=True)
        if a.verbose:
            made.orderBy(*order).select("corpus_id", "clean_text").show(5, truncate=False)
        made.unpersist()
        cleaned.unpersist()
    elif a.command == "split":
        items = files.read_clean_tsv(spark, a.input)
        if a.hash:
            tsv.write_splits(split.hash_split(items, "corpus_id", a.train_ratio, a.val_ratio, a.seed), a.output_dir, a.prefix)
        else:
            # the seeded permutation is of the file's own order, which one partition of one file keeps
            listed = items.coalesce(1).withColumn("at", F.monotonically_increasing_id())
            tsv.write_splits(split.seeded_split(listed, ["at"], a.train_ratio, a.val_ratio, a.seed), a.output_dir, a.prefix, single=True)
    elif a.command == "profile":
        items = profile.profile_items(files.read_clean_tsv(spark, a.input).select("corpus_id", "clean_text"), lexicon_adapter(spark, a.lexicon))
        profile.summarize(items).show(vertical=True)
    elif a.command == "export":
        tsv.to_alpaca(files.read_clean_tsv(spark, a.input), F.lit(a.instruction), F.col("clean_text"), F.lit("")).write.mode("overwrite").text(a.output)
    elif a.command == "align":
        scanned = files.read_corpus(spark, a.input).where(F.col("meta.format") == ".txt").select(F.element_at("path_parts", -1).alias("file_name"), "text")
        pairs = align.align_cards(scanned).persist()
        tsv.write_tsv(tsv.pair_columns(pairs), a.output)
        print(f"{scanned.count()} files, {pairs.count()} pairs")
    else:
        results = fetched(spark, a).persist()
        store(spark, results, a.raw_dir, a.overwrite)
        results.select("success", "origin_url", "title", "char_len", "error_message").show(truncate=False)
        if a.command == "harvest":
            docs = results.where("success").select(F.col("source_id").alias("doc_id"), F.col("extracted_text").alias("text"))
            options = dataclasses.replace(CleanOptions(), dedup_scope="document", min_sentence_len=a.min_len, max_sentence_len=a.max_len, require_chinese=a.chinese_only)
            made, _, _ = corpus.run(docs, options, doc_key=F.col("doc_id"), order=["doc_id"], category=a.category, adapter=lexicon_adapter(spark, a.lexicon))
            tsv.write_file(tsv.item_columns(made.orderBy("doc_id", "sent_ord")), a.output, [])
            if a.verbose:
                made.orderBy("doc_id", "sent_ord").select("corpus_id", "clean_text").show(3, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
