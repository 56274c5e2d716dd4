"""Token counts by a compiled finite-state tokenizer.

The vocabulary is compiled into a deterministic transducer whose transitions carry the change of the
number of emitted tokens (``wordbpe.CountTransducer``). A text is cut into chunks, at white space where there is
some and otherwise within a word, where the state at the cut decides. Each chunk yields its map of transducer states: entry state to
exit state and count. A chunk within one word is run from a guessed state and applied to any other exactly, by
running that one until both fall together. The maps compose by a prefix scan over blocks of chunks, whose last element
hands its state to the next block and, at the end, gives the count; memory follows a block, not the text.
"""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import slices
from .wordbpe import count_transducer

CHUNK_CHARS = 65_536


def count_tokens(df: DataFrame, vocabulary: str, limit: int = 2048, *, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """One row for each row of ``df``: its id, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit``.

    No shuffle: a row's chunks are scanned in the task that reads it, however long its text is, with or without white space. Null and empty texts have 0 bytes
    and 0 tokens; a null id stays null; repeated rows each give a row; other columns are not read; an
    empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = count_transducer(vocabulary)
        for batch in slices(batches, "text", keep="vocabulary"):
            counts = [counter.count(t, chunk_chars) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    read = df.select(F.col(id_col).alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    kind = read.schema["id"].dataType.simpleString()
    out = read.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
