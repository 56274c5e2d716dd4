"""Profiles of sentences, their summaries, and the interface for other profiles."""

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import udfs
from ..functions.native import WORD


class Adapter(Protocol):
    """A profile is a set of named columns of a text; the other two read these columns."""

    def profile(self, text: Column) -> dict[str, Column]: ...
    def feasible(self) -> Column: ...
    def difficulty(self, text: Column) -> Column: ...


def known_chars(lexicon: DataFrame, word_col: str = "word") -> str:
    """The different characters of a lexicon's words: at most as many as Unicode has, so they may be collected."""
    rows = lexicon.select(F.explode(F.split(F.col(word_col), "")).alias("c")).where("c <> ''").distinct().orderBy("c").collect()
    return "".join(r.c for r in rows)


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """``word``: the first cell of each line of a tab-separated lexicon."""
    words = spark.read.text(path).select(F.trim(F.element_at(F.split("value", "\t"), 1)).alias("word"))
    return words.where("word <> ''")


class LexiconAdapter:
    """Coverage of Han characters by a lexicon. ``inside``: the class of the characters that count. ``rounded``: how rates
    are rounded (``udfs.even_round``: as SQL does)."""

    def __init__(self, known: str = "", inside: str = r"\x{4e00}-\x{9fff}", keys: Column | None = None, rounded: Callable[[Column, int], Column] = udfs.py_round):
        self.known, self.inside, self.keys, self.rounded = known, inside, keys, rounded

    def profile(self, text: Column) -> dict[str, Column]:
        counted = F.regexp_replace(text, f"[^{self.inside}]", "")
        missing = F.translate(counted, self.known, "") if self.known else counted
        n, han, oov = F.length(text), F.length(counted), F.length(missing)
        keys = self.keys if self.keys is not None else (han * F.lit(2.2) + (n - han)).cast("int")
        return {
            "total_chars": n,
            "chinese_chars": han,
            "oov_count": oov,
            "oov_chars": missing,
            "oov_rate": self.rounded(F.when(han > 0, oov / han).otherwise(0.0), 4),
            "key_count": keys,
            "expansion_ratio": self.rounded(keys / F.greatest(n, F.lit(1)), 2),
            "feasible": n > 0,
        }

    def feasible(self) -> Column:
        return F.coalesce(F.col("feasible"), F.lit(False))

    def difficulty(self, text: Column) -> Column:
        rate, n = F.col("oov_rate"), F.length(text)
        return F.when((rate == 0) & (n <= 45), "L1").when((rate <= 0.15) & (n <= 85), "L2").otherwise("L3")


class EntropyAdapter:
    """Character entropy and repetition, as a small language model would feel them. ``rounded``: see LexiconAdapter."""

    def __init__(self, rounded: Callable[[Column, int], Column] = udfs.py_round):
        self.rounded = rounded

    def profile(self, text: Column) -> dict[str, Column]:
        n, entropy = F.length(text), udfs.char_entropy(text)
        different = F.when(n > 0, F.size(F.array_distinct(F.split(text, "")))).otherwise(0)
        return {
            "char_entropy": entropy,
            "estimated_tokens": F.greatest(F.lit(1), (n * F.lit(0.85)).cast("int")),
            "repetition_ratio": self.rounded(1 - different / F.greatest(n, F.lit(1)), 3),
            "feasible": (n > 0) & (entropy > 1.5),
        }

    def feasible(self) -> Column:
        return F.coalesce(F.col("feasible"), F.lit(True))

    def difficulty(self, text: Column) -> Column:
        h, n = F.col("char_entropy"), F.length(text)
        return F.when((h < 3.5) & (n < 40), "L1").when((h < 4.8) & (n < 80), "L2").otherwise("L3")


def word_counts(text: Column) -> tuple[Column, Column]:
    """How many words (runs of letters, digits and underscores, lower-cased) a text has, and how many different ones."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), f"[^{WORD}]+"), lambda w: w != "")
    return F.size(words), F.size(F.array_distinct(words))


def type_token_ratio(text: Column) -> Column:
    """Different words by words; 0 without words."""
    n, types = word_counts(text)
    return F.when(n > 0, types / n).otherwise(0.0)


def profile_items(df: DataFrame, adapter: Adapter, text_col: str = "clean_text") -> DataFrame:
    """``df`` with the adapter's columns, ``char_len``, ``oov_rate`` (0 where the adapter has none), ``feasible``,
    ``difficulty`` and ``note``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = df.withColumns(adapter.profile(text))
    if "oov_rate" not in df.columns:
        df = df.withColumns({"oov_rate": F.lit(0.0), "oov_chars": F.lit("")})
    note = F.when(F.col("oov_rate") > 0, F.concat(F.lit("含未登錄字("), F.substring("oov_chars", 1, 5), F.lit(")"))).otherwise("詞庫全覆蓋")
    return df.withColumns({"char_len": F.length(text), "feasible": adapter.feasible(), "difficulty": adapter.difficulty(text), "note": note})


def summarize(df: DataFrame) -> DataFrame:
    """One row over profiled items; zeros for none."""
    total = F.count("*")
    level = lambda x: F.count_if(F.col("difficulty") == x)
    out = df.agg(total.alias("total_sentences"), F.coalesce(F.sum("oov_rate"), F.lit(0.0)).alias("oov_sum"), F.count_if("feasible").alias("feasible_count"), level("L1").alias("l1_easy"), level("L2").alias("l2_medium"), level("L3").alias("l3_hard"))
    n = F.greatest(F.col("total_sentences"), F.lit(1))
    return out.select("total_sentences", udfs.py_round(F.col("oov_sum") / n, 4).alias("avg_oov_rate"), "feasible_count", udfs.py_round(F.col("feasible_count") / n * 100.0, 2).alias("feasibility_percent"), "l1_easy", "l2_medium", "l3_hard")
