"""Tab-separated exports and instruction formats."""

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The columns of the cleaned table and of the table of pairs.
ITEM_HEADER = ["CORPUS_ID", "CATEGORY", "DIFFICULTY", "CHAR_LEN", "OOV_RATE", "CLEAN_TEXT", "FEASIBLE_RUHI", "NOTE"]
PAIR_HEADER = ["PAIR_ID", "SOURCE_FILE", "EN_TEXT", "ZH_TEXT", "IT_TEXT", "CITATION_EN", "CITATION_ZH", "EN_CHAR_LEN", "ZH_CHAR_LEN"]
SPLIT_FILES = {"calibration": "calibration", "validation": "validation", "benchmark": "benchmark_gold"}


def one_line(c: str) -> Column:
    return F.translate(F.coalesce(F.col(c), F.lit("")), "\t\n\r", "  ")


def item_columns(df: DataFrame) -> DataFrame:
    """Items (``corpus_id`` to ``note``) as the cells of the cleaned table."""
    cells = [
        F.col("corpus_id"), F.col("category"), F.col("difficulty"), F.col("char_len").cast("string"), F.format_string("%.4f", F.coalesce("oov_rate", F.lit(0.0))),
        one_line("clean_text"), F.when(F.col("feasible"), "YES").otherwise("NO"), F.translate(F.coalesce("note", F.lit("")), "\t", " "),
    ]
    return df.select(*(c.alias(n) for c, n in zip(cells, ITEM_HEADER)))


def pair_columns(df: DataFrame) -> DataFrame:
    names = ["pair_id", "source_file", "en_text", "zh_text", "it_text", "citation_en", "citation_zh"]
    cells = [F.translate(F.coalesce(F.col(c), F.lit("")), "\t", " ") for c in names] + [F.length(c).cast("string") for c in ("en_text", "zh_text")]
    return df.select(*(c.alias(n) for c, n in zip(cells, PAIR_HEADER)))


def write_tsv(df: DataFrame, path: str, single: bool = False, order: list | None = None) -> None:
    """``df`` as tab-separated files with a header: a folder of part files or, for small tables, one ordered file in it."""
    if single:
        df = (df.orderBy(*order) if order else df).coalesce(1)
    df.write.mode("overwrite").csv(path, sep="\t", header=True, quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_file(df: DataFrame, path: str, order: list) -> None:
    """``df``, which must fit one task, as one ordered tab-separated file ``path`` with a header. It's written beside its place
    and then renamed."""
    beside = f"{path}.{uuid.uuid4().hex}"
    write_tsv(df, beside, single=True, order=order)
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    folder, target = jvm.org.apache.hadoop.fs.Path(beside), jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(conf)
    part = next(f.getPath() for f in system.listStatus(folder) if f.getPath().getName().startswith("part-"))
    system.delete(target, True)
    system.rename(part, target)
    system.delete(jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.crc"), False)  # a local file system's
    system.delete(folder, True)


def write_splits(df: DataFrame, folder: str, prefix: str = "corpus", single: bool = False) -> None:
    """Items with ``split`` and ``pos`` as one table for each split: a folder of files or, if ``single``, for tables that fit one
    task, one file in the order of ``pos``."""
    for name, suffix in SPLIT_FILES.items():
        part, path = df.where(F.col("split") == name), f"{folder}/{prefix}_{suffix}.tsv"
        if single:
            write_file(item_columns(part.orderBy("pos")), path, [])
        else:
            write_tsv(item_columns(part), path)


def to_alpaca(df: DataFrame, instruction: Column, given: Column, output: Column) -> DataFrame:
    """JSON lines of instruction, input and output, in the column ``value``; write them with ``write.text``."""
    return df.select(F.to_json(F.struct(instruction.alias("instruction"), given.alias("input"), output.alias("output"))).alias("value"))


def to_sharegpt(turns: DataFrame) -> DataFrame:
    """Conversations (``conv_id``, ``turn``, ``role``, ``text``) as JSON lines of turns in order."""
    said = F.array_sort(F.collect_list(F.struct("turn", F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt").otherwise(F.col("role")).alias("from"), F.coalesce("text", F.lit("")).alias("value"))))
    listed = turns.groupBy("conv_id").agg(said.alias("t"))
    return listed.select("conv_id", F.to_json(F.struct(F.transform("t", lambda t: F.struct(t["from"].alias("from"), t["value"].alias("value"))).alias("conversations"))).alias("value"))


def to_dpo(df: DataFrame, prompt: Column, chosen: Column, rejected: Column) -> DataFrame:
    return df.select(F.to_json(F.struct(prompt.alias("prompt"), chosen.alias("chosen"), rejected.alias("rejected"))).alias("value"))
