"""Rewriting of legacy terms, and the registry of canonical terms."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.native import SPACE

#: Patterns and what replaces them, in order; s stands for white space.
RULES = [
    ("臣服", "誠服"),
    ("密宗", "搪碴 (Tantra)"),
    ("進步利用論", "輝透論 (PROUT)"),
    (r"帕拉尼帕塔\s*(\([^)]*Pra[^)]*\))?", "Praṇipāta"),
    (r"帕里[樸普]拉仙那\s*(\([^)]*Pariprashna[^)]*\))?", "Pariprashna"),
    (r"協瓦\s*(\([^)]*se[^)]*\))?", "協峇 (Sevá)"),
]
#: Term, legacy renderings, canonical rendering.
REGISTRY = [
    ("Tantra", ["密宗", "密教", "坦陀羅"], "搪碴"),
    ("Surrender", ["臣服", "投降", "順服"], "誠服"),
    ("Sevá", ["協瓦", "色瓦"], "協峇"),
    ("Bhakti", ["虔誠", "虔敬"], "敬慕"),
    ("PROUT", ["進步利用論", "利用論"], "輝透論"),
    ("Guru", ["邪教上師", "神棍導師"], "箍攄"),
    ("Neohumanism", ["新人道主義"], "抭郎主義"),
    ("Madhuvidyá", ["蜜糖科學", "甘露思維"], "蜜融慧光"),
    ("Praṇipāta", ["帕拉尼帕塔", "啪啦泥怕塔"], "Praṇipāta"),
    ("Pariprashna", ["帕里樸拉仙那", "帕里普拉仙那"], "Pariprashna"),
    ("Dharma", ["宗教", "佛法"], "法性"),
    ("Sādhana", ["苦行", "消極修行"], "靈性修持"),
]


def rewrite_terms(text: Column) -> tuple[Column, Column]:
    """The rewritten text, and a map of each pattern that matched to its number of matches."""
    counts = []
    for pattern, new in RULES:
        java = pattern.replace(r"\s", SPACE)
        counts += [F.lit(pattern), F.regexp_count(text, F.lit(java))]
        text = F.regexp_replace(text, java, new)
    return text, F.map_filter(F.create_map(*counts), lambda _, n: n > 0)


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REGISTRY, "term string, legacy array<string>, canonical string")


def find_legacy(df: DataFrame, text_col: str = "text") -> DataFrame:
    """A row for each registered legacy rendering that a text holds. The registry is a dozen fixed rows."""
    terms = F.array(*(F.struct(F.lit(t).alias("term"), F.lit(old).alias("legacy"), F.lit(new).alias("canonical")) for t, olds, new in REGISTRY for old in olds))
    held = F.filter(terms, lambda t: F.contains(F.col(text_col), t["legacy"]))
    return df.select("*", F.explode(held).alias("found")).select(*df.columns, "found.*")
