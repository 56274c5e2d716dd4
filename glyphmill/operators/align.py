"""Parallel-text cards: English, Chinese and Italian blocks with their citations."""

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..functions import native
from ..functions.udfs import mapped, texts_struct
from .clean import clean, normalize

BLANK_LINES = re.compile(r"\n\s*\n")
#: How a block's language is told, in order, and the words that mark the citation after it.
ITALIAN = (" della ", " degli ", " spirituale ", " perché ", " nel ", " quando ", " vita quotidiana ", " parte del ")
LANGUAGES = {
    "zh": (lambda b: re.search("[一-鿿]{10,}", b), ("卷", "大法會", "Shrii", "P.")),
    "it": (lambda b: any(m in f" {b.lower()} " for m in ITALIAN), ("DMC", "Subh", "Parte", "Shrii")),
    "en": (lambda b: re.match(r"[A-Za-z0-9\s,.–\-'’()\":;?!]{25,}", b), ("DMC", "Part", "Discourse", "Shrii")),
}
CITATION_MOST = 180


def read_card(text: str | None) -> dict[str, str]:
    """The first block of each language and the citation that follows it, as ``en``, ``cite_en`` and so on."""
    found = {f"{p}{k}": "" for k in LANGUAGES for p in ("", "cite_")}
    blocks = [b.strip() for b in BLANK_LINES.split((text or "").strip()) if b.strip()]
    if len(blocks) < 2:
        return found
    rest = iter(range(len(blocks)))
    for k in rest:
        block = blocks[k]
        if block.startswith(("http://", "https://")):
            continue
        language = next((name for name, (fits, _) in LANGUAGES.items() if fits(block)), None)
        if language is None or found[language]:
            continue
        found[language] = block
        following = blocks[k + 1] if k + 1 < len(blocks) else ""
        if following and len(following) < CITATION_MOST and any(w in following for w in LANGUAGES[language][1]):
            found[f"cite_{language}"] = following
            next(rest, None)
    return found


FIELDS = [f"{p}{k}" for k in LANGUAGES for p in ("", "cite_")]


@arrow_udf(texts_struct(*FIELDS))
def _cards(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    return mapped(texts, read_card, pa.struct([(f, pa.string()) for f in FIELDS]))


def align_cards(files: DataFrame) -> DataFrame:
    """A pair for each card (``file_name``, ``text``) with an English and a Chinese block: see PAIR_SCHEMA. Italian is
    empty where it lacks. English and Italian are cleaned, Chinese is normalised."""
    # generated, since a condition on a Python function's columns would call it twice
    cards = files.select("file_name", F.inline(F.array(_cards(F.col("text"))))).where("en <> '' and zh <> ''")
    for c in ("en", "it"):
        cards = clean(cards, text_col=c).drop("html_tags", "urls_and_emails", "punct_compressed")
    cards = normalize(cards, text_col="zh").drop("invisible_chars")
    flat = lambda c, by: native.strip(F.replace(F.col(c), F.lit("\n"), F.lit(by)))
    stem = F.regexp_replace("file_name", r"(?<=.)\.[^.]*\z", "")
    texts = [flat(c, " ").alias(f"{c}_text") for c in ("en", "zh", "it")]
    return cards.select(F.concat(F.lit("pair_"), stem).alias("pair_id"), F.col("file_name").alias("source_file"), *texts, flat("cite_en", " | ").alias("citation_en"), flat("cite_zh", " | ").alias("citation_zh"))
