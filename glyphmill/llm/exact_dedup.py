"""Exact deduplication through an extendible-hash index on shared files.

1. Writers: every task collapses the equal texts of each bounded batch into one *entry* (hash, text, ids of
   its rows) and writes the entries to the shared folder. A text that a third of all rows repeat becomes one
   entry per batch here.
2. Directory: entries are counted by leading hash bits. A bucket over capacity splits by one more bit, which
   doubles the directory where its depth was already the greatest; a bucket that holds one hash only can't
   split and stays, as a chain.
3. Owners: each task takes whole buckets, i.e. ranges of keys, in the order of their hashes. Entries of
   equal hash are chained: their texts are compared byte by byte with those of the chain, and a collision
   lengthens it. A chain holds the different texts of one hash, so memory does not follow the copies.
"""

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import slices
from .shared import partitions_for, written

CAPACITY = 4096
GREATEST_DEPTH = 22
HASH_BITS = 64
OWNED_BYTES = 64 << 20


def entries(df: DataFrame, *, id_col: str, text_col: str, keep: list[str], hash_bits: int) -> DataFrame:
    """Step 1: ``h``, ``sha``, ``ids`` (largest first, nulls last), ``text`` and, as the struct ``row``, the
    columns ``keep`` of the row with the largest id."""
    read = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.struct(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(keep)), F.lit(0).alias("none")).alias("row"))
    schema = T.StructType([T.StructField("h", T.LongType()), T.StructField("sha", T.BinaryType()), T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("text", T.StringType()), T.StructField("row", read.schema["row"].dataType)])
    shift = 64 - hash_bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 16 << 20):
            groups: dict[str, list[int]] = {}
            ids = batch.column(0).to_pylist()
            for k, text in enumerate(batch.column(1).to_pylist()):
                groups.setdefault(text, []).append(k)
            rank = lambda k: (ids[k] is not None, ids[k] or 0)
            members = [sorted(g, key=rank, reverse=True) if len(g) > 1 else g for g in groups.values()]
            digests = [hashlib.sha256(t.encode()).digest() for t in groups]
            best = pa.array([g[0] for g in members], pa.int64())
            hashes = [int.from_bytes(d[:8], "big", signed=True) >> shift << shift for d in digests]
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes, pa.int64()), pa.array(digests, pa.binary()), pa.array([[ids[k] for k in g] for g in members], pa.list_(pa.int64())), batch.column(1).take(best), batch.column(2).take(best)],
                ["h", "sha", "ids", "text", "row"],
            )

    return read.mapInArrow(run, schema)


def directory(hashes: DataFrame, capacity: int, greatest_depth: int = GREATEST_DEPTH) -> tuple[int, list[int]]:
    """Step 2 over the column ``h``: the directory's depth, and the bucket of each of its slots (leading
    bits of the hash, shifted so that order is that of signed hashes). At most about twice as many slots as
    buckets of half capacity would need reach the driver, and 2 ** greatest_depth."""
    total = hashes.count()
    depth = 1
    while depth < greatest_depth and total > capacity << depth:
        depth += 1
    prefix = lambda d: F.shiftright(F.col("h"), 64 - d)
    leaves, open_at = [], None
    while True:
        part = hashes if open_at is None else hashes.join(F.broadcast(hashes.sparkSession.createDataFrame(pa.table({"p": pa.array(open_at, pa.int64())}))), prefix(depth - 1) == F.col("p"), "left_semi")
        counted = part.groupBy(prefix(depth).alias("p")).agg(F.count("*").alias("n"), F.min("h").alias("low"), F.max("h").alias("high")).collect()
        full = {r.p for r in counted if r.n > capacity and r.low != r.high} if depth < greatest_depth else set()
        leaves += [(r.p, depth) for r in counted if r.p not in full]
        if not full:
            break
        open_at, depth = sorted(full), depth + 1
    slots = [-1] * (1 << depth)
    for bucket, (p, d) in enumerate(sorted(leaves, key=lambda x: x[0] << (64 - x[1]))):
        first = (p << (depth - d)) + (1 << (depth - 1))
        slots[first : first + (1 << (depth - d))] = [bucket] * (1 << (depth - d))
    return depth, slots


def owned(index: DataFrame, hashes: DataFrame, capacity: int) -> DataFrame:
    """The entries dealt to owner tasks by bucket and sorted by hash within them. ``hashes``: their hashes alone."""
    depth, slots = directory(hashes, capacity)
    spark = index.sparkSession
    table = spark.createDataFrame(pa.table({"slot": pa.array(range(len(slots)), pa.int64()), "bucket": pa.array(slots, pa.int32())}))
    slot = F.shiftright("h", 64 - depth) + F.lit(1 << (depth - 1))
    dealt = index.join(F.broadcast(table), slot == F.col("slot")).drop("slot")
    return dealt.repartition(partitions_for(index, OWNED_BYTES, 2), "bucket").sortWithinPartitions("bucket", "h").drop("bucket")


def chains(batches: Iterator[pa.RecordBatch], close) -> Iterator[tuple[int, int, int, pa.RecordBatch, int, list]]:
    """Step 3: for each entry its hash, place in the chain, number within that place, and where it is.
    ``close(hash, chain)`` is called when a hash is over; a chain is a list of dicts of one text each."""
    present, chain = None, []
    for batch in batches:
        for k, (h, ids, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist())):
            if h != present:
                if chain:
                    close(present, chain)
                present, chain = h, []
            for place, link in enumerate(chain):
                if link["text"] == text:
                    break
            else:
                place, link = len(chain), {"text": text, "size": 0, "entries": 0, "best": None}
                chain.append(link)
            mine = (ids[0] is not None, ids[0] or 0)
            if link["best"] is None or mine > link["best"]:
                link |= {"best": mine, "keep": ids[0], "at": link["entries"], "row": (batch, k)}
            number = link["entries"]
            link["size"] += len(ids)
            link["entries"] += 1
            yield h, place, number, batch, k, ids
        for link in chain:  # hold one row rather than its whole batch
            b, k = link["row"]
            link["row"] = (b.slice(k, 1).take(pa.array([0])), 0)
    if chain:
        close(present, chain)


def find_copies(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, hash_bits: int = HASH_BITS) -> DataFrame:
    """One row for each row of ``df``: its id, ``keep_id`` (the largest id among equal texts), ``group_size``,
    ``kept`` and ``text_sha256``. Texts are equal if their bytes are; nothing is normalised.

    A null text counts as empty, and equals an empty one. A null id is less than any other. Of repeated
    rows that share the largest id exactly one has ``kept``. Other columns are not read. An empty table
    gives no rows.
    """
    index = written(entries(df, id_col=id_col, text_col=text_col, keep=[], hash_bits=hash_bits).drop("row"), "exact-index")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in range(8)]

        def put(*row):
            for column, value in zip(out, row):
                column.append(value)

        def close(h, chain):
            for place, link in enumerate(chain):
                put(h, place, None, None, None, link["keep"], link["size"], link["at"])

        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64()]
        names = ["h", "place", "number", "sha", "ids", "keep", "size", "keep_at"]

        def flush():
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)
            for c in out:
                c.clear()
            return made

        for h, place, number, batch, k, ids in chains(slices(batches, "text"), close):
            put(h, place, number, batch.column(3)[k].as_py(), ids, None, None, None)
            if len(out[0]) >= 5000:
                yield flush()
        yield flush()

    dealt = owned(index, index.select("h"), capacity).select("h", "ids", "text", "sha")
    rows = written(dealt.mapInArrow(run, "h long, place int, number long, sha binary, ids array<long>, keep long, size long, keep_at long"), "exact-chains")
    groups = rows.where("number is null").select("h", "place", "keep", "size", "keep_at")
    found = rows.where("number is not null").select("h", "place", "number", "sha", "ids").join(groups, ["h", "place"])
    each = found.select("*", F.posexplode("ids").alias("at", "id"))
    return each.select(
        F.col("id").alias(id_col),
        F.col("keep").alias("keep_id"),
        F.col("size").alias("group_size"),
        ((F.col("number") == F.col("keep_at")) & (F.col("at") == 0)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, hash_bits: int = HASH_BITS) -> DataFrame:
    """The rows of ``df`` that ``find_copies`` keeps, with all their columns. The kept row travels in its
    entry, so no join back to ``df`` is needed; nulls and ties as there. Of the index only the hashes are
    written to the shared folder: the entries, made again, go to their owners by one shuffle."""
    columns = df.columns
    index = entries(df, id_col=id_col, text_col=text_col, keep=columns, hash_bits=hash_bits)
    hashes = written(index.select("h"), "exact-hashes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []

        def close(h, chain):
            for link in chain:
                b, k = link["row"]
                kept.append(b.select(["row"]).slice(k, 1))

        def flush():
            made = pa.Table.from_batches(kept).combine_chunks().to_batches()
            kept.clear()
            return made

        for _ in chains(slices(batches, "text"), close):
            if len(kept) >= 2000:
                yield from flush()
        if kept:
            yield from flush()

    dealt = owned(index, hashes, capacity).select("h", "ids", "text", "row")
    rows = dealt.mapInArrow(run, T.StructType([index.schema["row"]]))
    return rows.select(*(F.col(f"row.c{k}").alias(c) for k, c in enumerate(columns)))
