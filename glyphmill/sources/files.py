"""Scans of text, JSON, CSV, DOCX and ODT files, through Spark's binary reader.

Everything that holds text becomes rows ``doc_id``, ``text`` and ``meta`` with the order keys ``path_parts`` and
``row_idx``. Damaged input costs its own rows only: bad JSON, archives and short rows are skipped.
"""

import csv
import io
import json
import xml.etree.ElementTree as ET
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.udfs import decode_bytes

WORD_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
META = "struct<encoding:string,line_idx:int,item_idx:int,row_idx:int,json_raw:string>"
ROWS = f"array<struct<idx:int,numbered:boolean,text:string,meta:{META}>>"
SUFFIXES = ("txt", "md", "text", "jsonl", "json", "csv", "tsv", "docx", "odt")
#: Where a JSON object keeps its text.
LINE_KEYS = ("text", "content", "sentence", "raw", "article")


def row(idx: int, text: str, encoding: str, numbered: bool = True, **meta) -> dict:
    return {"idx": idx, "numbered": numbered, "text": text, "meta": {"encoding": encoding, "line_idx": None, "item_idx": None, "row_idx": None, "json_raw": None} | meta}


def from_jsonl(data: bytes) -> list[dict]:
    text, encoding = decode_bytes(data)
    out = []
    for k, line in enumerate(text.splitlines()):
        try:
            value = json.loads(line) if line.strip() else None
        except ValueError:
            continue
        if isinstance(value, dict):
            found = next((value[n] for n in LINE_KEYS if isinstance(value.get(n), str)), "")
        elif isinstance(value, str):
            found = value
        else:
            continue
        out.append(row(k, found, encoding, line_idx=k, json_raw=line.strip()))
    return out


def from_json(data: bytes) -> list[dict]:
    text, encoding = decode_bytes(data)
    try:
        value = json.loads(text)
    except ValueError:
        return []
    if isinstance(value, list):
        said = [v if isinstance(v, str) else v.get("text", v.get("content", str(v))) if isinstance(v, dict) else None for v in value]
        return [row(k, s if isinstance(s, str) else str(s), encoding, item_idx=k) for k, s in enumerate(said) if s is not None]
    if isinstance(value, dict):
        said = next((value[n] for n in ("text", "content", "article") if n in value), "")
        return [row(0, said if isinstance(said, str) and said else str(said or value), encoding, numbered=False)]
    return []


def from_table(data: bytes, delimiter: str) -> list[dict]:
    text, encoding = decode_bytes(data)
    out, column = [], None
    for k, cells in enumerate(csv.reader(text.splitlines(), delimiter=delimiter)):
        if not any(cells):
            continue
        whole = "".join(cells)
        if k == 0 and ("text" in whole.lower() or "word" in whole.lower() or "語料" in whole):
            names = [c.strip().lower() for c in cells]
            column = next((names.index(n) for n in ("text", "clean_text") if n in names), None)
            continue
        at = column if column is not None else int(len(cells) > 1 and len(cells[1]) > len(cells[0]))
        if at < len(cells):
            out.append(row(k, cells[at], encoding, row_idx=k))
    return out


def is_vetted(color: str | None) -> bool:
    try:
        r, g, b = bytes.fromhex(color or "") if color and color.isalnum() else ()
    except ValueError:
        return False
    return g > 1.1 * r and g > 1.1 * b and g > 75


def from_docx(data: bytes, vetted_only: bool = False) -> list[dict]:
    def run_text(run) -> str:
        if vetted_only:
            color = run.find(f".//{WORD_NS}color")
            if color is None or not is_vetted(color.get(f"{WORD_NS}val")):
                return ""
        return "".join(t.text or "" for t in run.iter(f"{WORD_NS}t"))

    try:
        root = ET.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    except (ET.ParseError, KeyError, zipfile.BadZipFile):
        return []
    lines = ("".join(map(run_text, p.iter(f"{WORD_NS}r"))).strip() for p in root.iter(f"{WORD_NS}p"))
    return [row(0, "\n".join(filter(None, lines)), "docx_xml", numbered=False)]


def from_odt(data: bytes) -> list[dict]:
    try:
        root = ET.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("content.xml"))
    except (ET.ParseError, KeyError, zipfile.BadZipFile):
        return []
    lines = ("".join(e.itertext()).strip() for e in root.iter() if e.tag.endswith(("}p", "}h")))
    return [row(0, "\n".join(filter(None, lines)), "odt_xml", numbered=False)]


def parse_file(suffix: str, data: bytes, vetted_only: bool = False) -> list[dict]:
    if suffix in ("txt", "md", "text"):
        text, encoding = decode_bytes(data)
        return [row(0, text, encoding, numbered=False)]
    readers = {"jsonl": from_jsonl, "json": from_json, "csv": lambda d: from_table(d, ","), "tsv": lambda d: from_table(d, "\t"), "docx": lambda d: from_docx(d, vetted_only), "odt": from_odt}
    return readers[suffix](data) if suffix in readers else []


def read_corpus(spark: SparkSession, paths: str | list[str], recursive: bool = True, vetted_only: bool = False) -> DataFrame:
    """All documents of files or folders, in an order given by ``path_parts`` and ``row_idx``. Files whose own name begins
    with a dot or that have another suffix are left out; a path that doesn't exist raises an error. Spark
    also hides names that begin with an underscore; name such files one by one."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return parse_files(read.load(paths).select("path", "content"), vetted_only)


def parse_files(files: DataFrame, vetted_only: bool = False) -> DataFrame:
    """The same for rows ``path`` and ``content``, also those of a stream."""

    @pandas_udf(ROWS)
    def parsed(suffixes: pd.Series, contents: pd.Series) -> pd.Series:
        return pd.Series([parse_file(s, bytes(c), vetted_only) for s, c in zip(suffixes, contents)], dtype=object)

    name = F.element_at(F.split("path", "/"), -1)
    named = files.select("path", name.alias("name"), F.lower(F.regexp_extract(name, r".\.([^.]+)\z", 1)).alias("suffix"), "content")
    held = named.where(F.col("suffix").isin(*SUFFIXES) & ~F.col("name").startswith("."))
    each = held.select("path", "name", "suffix", F.explode(parsed("suffix", "content")).alias("r"))
    stem = F.regexp_replace("name", r"(?<=.)\.[^.]+\z", "")
    meta = F.struct(F.col("path").alias("file_path"), F.concat(F.lit("."), "suffix").alias("format"), "r.meta.*", F.when(F.col("suffix") == "docx", F.lit(vetted_only)).alias("vetted_only"))
    return each.select(F.when(F.col("r.numbered"), F.concat_ws("_", stem, (F.col("r.idx") + 1).cast("string"))).otherwise(stem).alias("doc_id"), "r.text", meta.alias("meta"), F.split("path", "/").alias("path_parts"), F.col("r.idx").alias("row_idx"))


def read_clean_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Items of a cleaned table: at least six cells; a difficulty other than L1 to L3 becomes L1, a length
    that isn't a number the text's, a rate that isn't one 0; feasible unless the cell says otherwise."""
    cells = [f"c{k}" for k in range(8)]
    raw = spark.read.schema(", ".join(f"{c} string" for c in cells)).csv(path, sep="\t", quote='"', escape='"', multiLine=True)
    kept = raw.where("c5 is not null and c0 <> 'CORPUS_ID'")
    number = lambda c, pattern, kind: F.when(F.col(c).rlike(pattern), F.col(c)).try_cast(kind)
    return kept.select(
        F.col("c0").alias("corpus_id"), F.col("c1").alias("category"), F.when(F.col("c2").isin("L1", "L2", "L3"), F.col("c2")).otherwise("L1").alias("difficulty"),
        F.coalesce(number("c3", r"\A[0-9]+\z", "int"), F.length("c5")).alias("char_len"), F.coalesce(number("c4", r"\A[0-9]*\.?[0-9]+\.?\z", "double"), F.lit(0.0)).alias("oov_rate"),
        F.col("c5").alias("clean_text"), F.coalesce(F.col("c6") == "YES", F.lit(True)).alias("feasible"), F.coalesce("c7", F.lit("")).alias("note"),
    )
