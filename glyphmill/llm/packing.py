"""Order-preserving packing of token streams into windows by dynamic programming.

The documents of a block, in the order of their ids, form one stream of tokens. Window cuts may fall at
document ends (free), at sentence ends (a small penalty) and, only where a sentence is longer than a
window, within it (a large penalty). With p the position of a candidate cut, the least cost up to cut j is

    f(j) = penalty(j) + length - p(j) + min over i with p(j) - p(i) <= length of (f(i) + p(i)),

the sum of padding and truncation penalties. The minimum slides along the stream, so a monotone queue
gives it in constant amortised time.

A block is one partition of the input, cut further where its stream exceeds BLOCK_TOKENS, so memory is
bounded and nothing is shuffled. The last window of a block is padded only if that is cheaper than
cutting it into powers of two, which need no padding.
"""

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import slices
from .wordbpe import word_bpe

LENGTH = 4096
END_ID = 2
SENTENCE_PENALTY = 8.0
INNER_PENALTY = 64.0
BLOCK_TOKENS = 1 << 20


def cut_windows(positions: np.ndarray, penalties: np.ndarray, length: int) -> list[int]:
    """Indexes of the chosen cuts among candidates at rising ``positions`` (the first is 0, the last is the
    end of the stream; neighbours at most ``length`` apart), by the recurrence above."""
    p, pen = positions.tolist(), penalties.tolist()
    value, came = [0.0] * len(p), [0] * len(p)
    queue: deque = deque([(0.0, 0, 0)])  # f(i) + p(i), p(i), i: rising from left to right
    for j in range(1, len(p)):
        at = p[j]
        least = at - length
        while queue[0][1] < least:
            queue.popleft()
        best, _, came[j] = queue[0]
        score = best + length + pen[j]  # f(j) + p(j)
        while queue and queue[-1][0] >= score:
            queue.pop()
        queue.append((score, at, j))
    cuts, j = [], len(p) - 1
    while j:
        cuts.append(j)
        j = came[j]
    return cuts[::-1]


def candidates(ids: np.ndarray, doc_ends: np.ndarray, sentence_end: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and penalties of the possible cuts of a stream."""
    kind = np.zeros(len(ids) + 1, dtype=np.uint8)  # of the place after each token: none, sentence end, document end, inner
    kind[1:] = sentence_end[ids]
    kind[doc_ends] = kind[0] = 2
    positions = np.flatnonzero(kind)
    gaps = np.diff(positions)
    if len(gaps) and gaps.max() > length:
        # both a whole number of windows after the last boundary and before the next one can help
        for k in np.flatnonzero(gaps > length):
            kind[np.arange(positions[k], positions[k + 1], length)[1:]] = 3
            kind[np.arange(positions[k + 1], positions[k], -length)[1:]] = 3
        positions = np.flatnonzero(kind)
    penalties = np.array([0.0, SENTENCE_PENALTY, 0.0, INNER_PENALTY])[kind[positions]]
    return positions, penalties


def tail_windows(rest: int, length: int) -> list[int]:
    """Lengths for the last ``rest`` tokens: one padded window, or powers of two without padding."""
    powers = [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]
    return powers if rest < length and INNER_PENALTY * (len(powers) - 1) < length - rest else [rest]


def pack_block(ids: np.ndarray, doc_lengths: np.ndarray, sentence_end: np.ndarray, length: int) -> np.ndarray:
    """Start positions of the windows of one block, with the end of the stream as last element."""
    doc_ends = np.cumsum(doc_lengths)
    positions, penalties = candidates(ids, doc_ends, sentence_end, length)
    cuts = [0, *positions[cut_windows(positions, penalties, length)].tolist()]
    if len(cuts) > 1:
        last = cuts[-2]
        cuts[-1:] = (last + np.cumsum(tail_windows(cuts[-1] - last, length))).tolist()
    return np.array(cuts, dtype=np.int64)


def pieces_of(starts: np.ndarray, doc_lengths: np.ndarray) -> tuple[np.ndarray, ...]:
    """Where windows and documents overlap: document index, start in it, length, window index, offset in it."""
    ends = np.cumsum(doc_lengths)
    edges = np.union1d(starts, np.concatenate([[0], ends]))
    begin, size = edges[:-1], np.diff(edges)
    doc = np.searchsorted(ends, begin, side="right")
    window = np.searchsorted(starts, begin, side="right") - 1
    return doc, begin - (ends - doc_lengths)[doc], size, window, begin - starts[window]


def sentence_ends(vocabulary: str) -> np.ndarray:
    """Marks the ids of whole pre-tokens of punctuation that hold a full stop or a mark like it."""
    bpe = word_bpe(vocabulary)
    marks = np.zeros(1 + max(bpe.names), dtype=bool)
    for i, symbols in bpe.symbols.items():
        codes = [s & 255 for s in symbols]
        if symbols[-1] >= 256 and any(c in b".!?" for c in codes) and not any(chr(c).isalnum() for c in codes):
            marks[i] = True
    return marks


def pack(df: DataFrame, vocabulary: str, *, length: int = LENGTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: the id, ``start`` (tokens of its document before it), ``length``,
    ``ids_crc32``, ``doc_tokens`` (with the end token), ``sequence_id`` and ``offset`` in it.

    Every token lies in exactly one piece; a sequence holds at most ``length`` tokens without a gap. A
    null or empty text is its end token alone. Rows are ordered by id (null first) and, among equal ids,
    by text, so repeated rows and ties pack the same way again. Other columns are not read. An empty
    table gives no rows. A sequence id is the partition's number shifted by 32 bits, plus a counter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bpe, marks = word_bpe(vocabulary), sentence_ends(vocabulary)
        end = np.array([end_id], dtype="<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 32
        keys: list = []
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal sequence
            lengths = np.array([len(x) // 4 for x in held], dtype=np.int64)
            data = b"".join(held)
            starts = pack_block(np.frombuffer(data, dtype="<u4"), lengths, marks, length)
            doc, start, count, window, offset = pieces_of(starts, lengths)
            begin = (np.cumsum(lengths) - lengths)[doc] + start
            crc = [zlib.crc32(memoryview(data)[4 * a : 4 * (a + n)]) for a, n in zip(begin.tolist(), count.tolist())]
            out = pa.RecordBatch.from_arrays(
                [pa.array(keys, key_type).take(pa.array(doc)), *(pa.array(x, pa.int64()) for x in (start, count, crc, lengths[doc], window + sequence, offset))],
                ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )
            sequence += len(starts) - 1
            return out

        key_type = None
        for batch in slices(batches, "text", 1 << 20, "vocabulary"):
            key_type = batch.column(0).type
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
    kind = read.schema["id"].dataType.simpleString()
    out = read.mapInArrow(run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
