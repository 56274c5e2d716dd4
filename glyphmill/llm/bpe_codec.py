"""BPE encoding by forced boundaries, and decoding.

A pair of neighbouring symbols that occurs inside no token of the vocabulary can never be merged across,
so a cut there is certain: the fragments between such cuts encode independently and their ids are
concatenated (``wordbpe.WordBpe.fragments``). White space and class changes, at which the vocabulary's
pre-tokeniser cuts, come first; pre-tokens are memoised, since most recur.
"""

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import slices
from .wordbpe import word_bpe


def encode(df: DataFrame, vocabulary: str, *, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` with the column ``ids_col`` of token ids (binary, little-endian unsigned 32-bit) appended.

    No shuffle. A null or empty text has no ids (empty binary). An existing column ``ids_col`` is
    replaced; all others are kept, whatever their names.
    """
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("binary")
    def ids(texts):
        bpe = word_bpe(vocabulary)
        return texts.map(bpe.encode)

    return df.withColumn(ids_col, ids(F.coalesce(F.col(text_col), F.lit(""))))


def decode(ids: Column, vocabulary: str) -> Column:
    """Texts of a column of ids as ``encode`` makes them; null and empty ids give an empty text."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def text(values):
        bpe = word_bpe(vocabulary)
        return values.map(bpe.decode)

    return text(F.coalesce(ids, F.lit(b"")))


def round_trip(df: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: its id, ``n_tokens``, and the SHA-256 digests of its ids and of the
    text that these ids decode to. Encoding and decoding run in one pass; nothing is shuffled.

    Null texts count as empty: 0 tokens and the digests of nothing. Repeated rows each give a row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(vocabulary)
        for batch in slices(batches, "text", keep="vocabulary"):
            encoded = [bpe.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(e) // 4 for e in encoded], pa.int64()),
                    pa.array([hashlib.sha256(e).hexdigest() for e in encoded], pa.string()),
                    pa.array([hashlib.sha256(bpe.decode(e).encode()).hexdigest() for e in encoded], pa.string()),
                ],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    read = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = read.schema["id"].dataType.simpleString()
    out = read.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)
