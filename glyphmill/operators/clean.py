"""Noise cleaning and normalisation of whole texts, as DataFrame transformations."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import native, udfs
from ..options import CleanOptions


def clean_html(c: Column) -> Column:
    """Tags and scripts removed, then character references resolved, so an escaped tag survives as text."""
    return udfs.html_unescape(native.strip_tags(c))


def by_python(df: DataFrame, text_col: str, f: Callable[[Column], Column], wanted: Column) -> DataFrame:
    """``text_col`` by an Arrow function for the ``wanted`` texts; the others don't leave the JVM."""
    text = F.col(text_col)
    return df.withColumn(text_col, F.coalesce(f(F.when(wanted, text)), text))


def clean(df: DataFrame, options: CleanOptions = CleanOptions(), text_col: str = "text") -> DataFrame:
    """``text_col`` cleaned, and ``html_tags``, ``urls_and_emails`` and ``punct_compressed`` counted."""
    text, zero = F.col(text_col), F.lit(0)
    if options.remove_html_tags:
        df = df.withColumn("html_tags", native.tag_count(text)).withColumn(text_col, native.strip_tags(text))
        df = by_python(df, text_col, udfs.html_unescape, text.contains("&"))
    else:
        df = df.withColumn("html_tags", zero)
    df = df.withColumn(text_col, native.strip_markdown(text))
    contacts, total = native.strip_contacts(text, options.remove_urls, options.remove_urls and options.remove_emails)
    df = df.withColumn("urls_and_emails", total).withColumn(text_col, contacts)
    if options.remove_social_tags:
        df = df.withColumn(text_col, native.strip_social(text))
    if options.compress_repeated_punctuation:
        df = df.withColumn("punct_compressed", native.count(text, native.RUNS))
        df = df.withColumn(text_col, F.when(F.col("punct_compressed") > 0, native.compress_punctuation(text)).otherwise(text))
    else:
        df = df.withColumn("punct_compressed", zero)
    return df.withColumn(text_col, native.strip(native.cap_repeats(text, options.max_repeated_chars)))


def normalize(df: DataFrame, options: CleanOptions = CleanOptions(), text_col: str = "text") -> DataFrame:
    """``text_col`` normalised, and ``invisible_chars`` counted."""
    text = F.col(text_col)
    if options.remove_invisible_chars:
        df = df.withColumn("invisible_chars", native.count(text, native.INVISIBLE))
        df = df.withColumn(text_col, F.when(F.col("invisible_chars") > 0, native.strip_invisible(text)).otherwise(text))
    else:
        df = df.withColumn("invisible_chars", F.lit(0))
    if options.do_nfkc:
        df = by_python(df, text_col, udfs.nfkc, F.length(text) != F.octet_length(text))
    if options.keep_ascii_halfwidth and not options.do_nfkc:  # NFKC has done it
        df = df.withColumn(text_col, native.halfwidth(text))
    for wanted, step in ((options.normalize_quotes, native.dialog_quotes), (options.normalize_punctuation, native.context_punctuation)):
        df = df.withColumn(text_col, step(text)) if wanted else df
    return df.withColumn(text_col, native.strip(text))


def drop_boilerplate(df: DataFrame, options: CleanOptions = CleanOptions(), text_col: str = "text") -> DataFrame:
    """The text's lines that hold text, joined by newlines, and ``boilerplate_lines`` dropped."""
    df = df.withColumn("lines__", native.text_lines(F.col(text_col)))
    df = df.withColumn("kept__", native.without_notices(F.col("lines__")) if options.filter_news_boilerplates else F.col("lines__"))
    df = df.withColumn("boilerplate_lines", F.size("lines__") - F.size("kept__"))
    return df.withColumn(text_col, F.array_join("kept__", "\n")).drop("lines__", "kept__")
