"""Packed token matrices by best-fit-decreasing, written as binary files.

Documents' ids (with an end id) are cut into pieces of at most a row's length, losslessly. The pieces of a
block are placed from the longest to the shortest, each into the fullest row that still has room. A segment
tree over capacities finds it: leaf c holds how many open rows have c places left, so the least capacity of
at least the piece's length is one descent, in the logarithm of the row length.

Each block becomes three files in the shared folder: ``.ids`` (little-endian unsigned 16- or 32-bit matrix,
padded with the end id), ``.lengths`` (cumulative segment lengths of each row: 32-bit, rows after one another,
each from 0, with row offsets before them) and ``.positions`` (the matrix cells at which positions restart at 0).
File names hold a random suffix; rows refer only to files of the attempt that succeeded.
"""

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import slices
from .media import opened
from .shared import new_dir
from .wordbpe import word_bpe

LENGTH = 4096
END_ID = 2
BLOCK_TOKENS = 1 << 21


class Capacities:
    """Open rows by remaining capacity, with a segment tree for "the least capacity of at least n"."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.tree = [0] * (2 * self.size)  # counts
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def change(self, capacity: int, by: int) -> None:
        k = self.size + capacity
        while k:
            self.tree[k] += by
            k >>= 1

    def put(self, row: int, capacity: int) -> None:
        if capacity:
            self.rows[capacity].append(row)
            self.change(capacity, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """Removes a row of the least capacity of at least ``least``: the row and its capacity."""
        k = self.size + least
        if not self.tree[k]:
            while k > 1 and (k & 1 or not self.tree[k + 1]):  # up to where a right sibling holds rows
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.size:
                k = 2 * k if self.tree[2 * k] else 2 * k + 1
        capacity = k - self.size
        self.change(capacity, -1)
        return self.rows[capacity].pop(), capacity


def best_fit_decreasing(lengths: list[int], length: int) -> tuple[list[int], list[int], int]:
    """Row and offset of each piece (1 to ``length`` tokens), and the number of rows. Ties keep their order."""
    rows, offsets, made = [0] * len(lengths), [0] * len(lengths), 0
    free = Capacities(length)
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        found = free.take(lengths[k])
        if found is None:
            found, made = (made, length), made + 1
        rows[k], capacity = found
        offsets[k] = length - capacity
        free.put(rows[k], capacity - lengths[k])
    return rows, offsets, made


def cut(lengths: list[int], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and length of each piece of documents of these lengths."""
    counts = [-(-n // length) for n in lengths]
    doc = np.repeat(np.arange(len(lengths)), counts)
    start = np.concatenate([np.arange(c, dtype=np.int64) * length for c in counts]) if counts else np.empty(0, np.int64)
    return doc, start, np.minimum(np.array(lengths, dtype=np.int64)[doc] - start, length)


def write_block(path: str, ids: np.ndarray, begins: np.ndarray, sizes: np.ndarray, rows: list[int], offsets: list[int], made: int, length: int, end_id: int, width: str) -> None:
    matrix = np.full((made, length), end_id, dtype=width)
    order = np.lexsort((offsets, rows))
    row_of, offset_of = np.array(rows)[order], np.array(offsets)[order]
    for k, r, o in zip(order.tolist(), row_of.tolist(), offset_of.tolist()):
        matrix[r, o : o + sizes[k]] = ids[begins[k] : begins[k] + sizes[k]]
    segments = np.bincount(row_of, minlength=made) + 1
    row_offsets = np.concatenate([[0], np.cumsum(segments)]).astype("<u4")
    lengths = np.zeros(int(row_offsets[-1]), dtype="<u4")
    place = np.arange(len(order)) + row_of + 1  # one leading 0 for each row so far
    lengths[place] = offset_of + sizes[order]
    system, plain = opened(path)
    system.create_dir(plain.rpartition("/")[0], recursive=True)
    for suffix, data in ((".ids", matrix.tobytes()), (".lengths", np.array([made], "<u4").tobytes() + row_offsets.tobytes() + lengths.tobytes()), (".positions", (row_of * length + offset_of).astype("<u8").tobytes())):
        with system.open_output_stream(plain + suffix) as out:
            out.write(data)


def read_block(path: str, length: int, width: str) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Matrix, cumulative segment lengths of each row, and cells where positions restart."""
    system, plain = opened(path)
    read = lambda suffix: system.open_input_file(plain + suffix).readall()
    matrix = np.frombuffer(read(".ids"), dtype=width).reshape(-1, length)
    raw = np.frombuffer(read(".lengths"), dtype="<u4")
    at, flat = raw[1 : raw[0] + 2], raw[raw[0] + 2 :]
    return matrix, [flat[a:b] for a, b in zip(at[:-1], at[1:])], np.frombuffer(read(".positions"), dtype="<u8")


def write_matrices(df: DataFrame, vocabulary: str, folder: str | None = None, *, length: int = LENGTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the matrices of ``df`` below ``folder`` (a new shared folder if none is given) and returns the index, itself
    written there. One row for each piece: the id, ``start``, ``length``, ``doc_tokens``, ``file``, ``row``, ``offset``.

    Null and empty texts are their end id alone. Null ids and repeated rows are packed as any others; other
    columns are not read; an empty table writes no matrix. Blocks are parts of partitions in the order of
    ids, so memory is bounded and nothing is shuffled.
    """
    spark = df.sparkSession
    folder = folder or new_dir(spark, "matrices")
    width = width_for(vocabulary, end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = word_bpe(vocabulary), np.array([end_id], dtype="<u4").tobytes()
        keys: list = []
        held: list[bytes] = []
        size, kind = 0, None

        def flush() -> pa.RecordBatch:
            lengths = [len(x) // 4 for x in held]
            doc, start, sizes = cut(lengths, length)
            first = np.cumsum(lengths) - lengths
            rows, offsets, made = best_fit_decreasing(sizes.tolist(), length)
            path = f"{folder}/blocks/{uuid.uuid4().hex}"
            write_block(path, np.frombuffer(b"".join(held), dtype="<u4"), first[doc] + start, sizes, rows, offsets, made, length, end_id, width)
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, kind).take(pa.array(doc)), pa.array(start), pa.array(sizes), pa.array(np.array(lengths, dtype=np.int64)[doc]), pa.array([path] * len(doc)), pa.array(rows, pa.int64()), pa.array(offsets, pa.int64())],
                ["id", "start", "length", "doc_tokens", "file", "row", "offset"],
            )

        for batch in slices(batches, "text", 2 << 20, "vocabulary"):
            kind = batch.column(0).type
            keys += batch.column(0).to_pylist()
            new = [x + end for x in bpe.encode_many(batch.column(1).to_pylist())]
            held += new
            size += sum(map(len, new)) // 4
            if size >= BLOCK_TOKENS:
                yield flush()
                keys, held, size = [], [], 0
        if held:
            yield flush()

    read = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).sortWithinPartitions("id", "text")
    made = read.mapInArrow(run, f"id {read.schema['id'].dataType.simpleString()}, start long, length long, doc_tokens long, file string, row long, offset long").withColumnRenamed("id", id_col)
    made.write.parquet(f"{folder}/index")
    return spark.read.schema(made.schema).parquet(f"{folder}/index")


def width_for(vocabulary: str, end_id: int) -> str:
    return "<u2" if max(end_id, *word_bpe(vocabulary).names) < 1 << 16 else "<u4"


def read_pieces(index: DataFrame, vocabulary: str, *, length: int = LENGTH, end_id: int = END_ID, id_col: str = "doc_id") -> DataFrame:
    """The index with ``ids_crc32`` (of little-endian 32-bit ids), ``sequence_id`` (a hash of file and row), and whether
    the files' segment ends and position resets agree (``resets_ok``), all as read back from the files."""
    width = width_for(vocabulary, end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = None
        for batch in batches:
            cells = [c.to_pylist() for c in batch.columns[4:7]]
            sizes, crc, good, sequence = batch.column(2).to_pylist(), [], [], []
            for file, row, offset, n in zip(*cells, sizes):
                if file != path:
                    path, (matrix, lengths, resets) = file, read_block(file, length, width)
                    starts = set(resets.tolist())
                crc.append(zlib.crc32(matrix[row, offset : offset + n].astype("<u4").tobytes()))
                k = int(np.searchsorted(lengths[row], offset + n))
                good.append(row * length + offset in starts and lengths[row][k] == offset + n and lengths[row][k - 1] == offset)
                sequence.append((zlib.crc32(file.rpartition("/")[2].encode()) << 31) + row)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(crc, pa.int64()), pa.array(sequence, pa.int64()), batch.column(6), pa.array(good, pa.bool_())], ["id", "start", "length", "doc_tokens", "ids_crc32", "sequence_id", "offset", "resets_ok"])

    kind = index.schema[id_col].dataType.simpleString()
    read = index.select(F.col(id_col).alias("id"), "start", "length", "doc_tokens", "file", "row", "offset")
    return read.mapInArrow(run, f"id {kind}, start long, length long, doc_tokens long, ids_crc32 long, sequence_id long, offset long, resets_ok boolean").withColumnRenamed("id", id_col)
