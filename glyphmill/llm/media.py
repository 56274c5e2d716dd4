"""Media columns: content-addressed payloads in tar shards.

A payload is stored losslessly as an 8-bit greyscale PNG, 64 samples wide, under its SHA-256 digest as
member name. Tasks write shards into a shared folder; rows carry digest, shard, offset and length. Range
reads of a member's first bytes alone fill the metadata columns; range reads of whole members give the
payload back.

Tasks may be run twice: a shard's name holds the attempt's random suffix, rows name only the shards of the
attempt that succeeded, and a shard left over by a lost attempt is never referred to.
"""

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import slices
from .shared import new_dir

WIDTH = 64
SHARD_BYTES = 256 << 20
HEADER_BYTES = 33
SIGNATURE = b"\x89PNG\r\n\x1a\n"
TAR_BLOCK = 512


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_media(payload: bytes) -> bytes:
    """A PNG of the payload, whose length is a positive multiple of WIDTH: one sample for each byte."""
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH)
    filtered = np.zeros((len(rows), WIDTH + 1), dtype=np.uint8)  # each row begins with filter type 0
    filtered[:, 1:] = rows
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(filtered.tobytes(), 1)) + chunk(b"IEND", b"")


def media_header(data: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from a member's first HEADER_BYTES bytes."""
    if data[:8] != SIGNATURE or data[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    width, height, depth = struct.unpack(">IIB", data[16:25])
    return width, height, depth


def from_media(data: bytes) -> bytes:
    """The payload of a stored PNG."""
    width, height, _ = media_header(data)
    at, packed = 8, []
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + body):
            raise ValueError("damaged PNG")
        if kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), dtype=np.uint8).reshape(height, width + 1)
    return rows[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Mean and deviation of the samples in thousandths, and a 16-bin histogram, as one string."""
    x = np.frombuffer(payload, dtype=np.uint8)
    bins = np.bincount(x >> 4, minlength=16)
    total, squares, n = int(x.sum(dtype=np.int64)), int((x.astype(np.int64) ** 2).sum()), len(x)
    return f"{1000 * total // n}:{1_000_000 * (n * squares - total * total) // (n * n)}:" + ",".join(map(str, bins.tolist()))


def tar_header(name: str, size: int) -> bytes:
    """A ustar header block of a plain file."""
    fields = [name.encode().ljust(100, b"\0"), b"0000644\0", b"0000000\0", b"0000000\0", b"%011o\0" % size, b"00000000000\0", b" " * 8, b"0", b"\0" * 100, b"ustar\x0000", b"\0" * 247]
    block = b"".join(fields)
    return block[:148] + b"%06o\0 " % sum(block) + block[156:]


def opened(path: str):
    """File system and plain path of a URI or local path, for executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path)


class Shard:
    """A tar file under construction; add() gives a member's offset and length, stored once by digest."""

    def __init__(self, folder: str):
        self.path = f"{folder}/shard-{uuid.uuid4().hex}.tar"
        system, plain = opened(self.path)
        system.create_dir(plain.rpartition("/")[0], recursive=True)
        self.out, self.at, self.places = system.open_output_stream(plain), 0, {}

    def add(self, digest: str, make) -> tuple[int, int]:
        place = self.places.get(digest)
        if place is None:
            data = make()
            self.out.write(tar_header(f"{digest}.png", len(data)))
            self.out.write(data)
            pad = -len(data) % TAR_BLOCK
            self.out.write(b"\0" * pad)
            place = self.places[digest] = (self.at + TAR_BLOCK, len(data))
            self.at += TAR_BLOCK + len(data) + pad
        return place

    def close(self) -> None:
        self.out.write(b"\0" * 2 * TAR_BLOCK)
        self.out.close()


def store(df: DataFrame, folder: str | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the payloads of ``df`` into shards below ``folder`` (a new shared folder if none is given)
    and returns the index, itself written there: id, ``n_bytes``, ``digest``, ``shard``, ``offset``, ``length``.

    The payload is the text's UTF-8 bytes and zeros up to a positive multiple of 64; a null text counts as
    empty (64 zeros). Equal payloads within a shard are stored once. Null ids and repeated rows each keep
    their index row; other columns are not read; an empty table gives an empty index. Nothing is shuffled.
    """
    spark = df.sparkSession
    folder = folder or new_dir(spark, "media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in slices(batches, "text"):
            if shard is None:
                shard = Shard(f"{folder}/shards")
            sizes, digests, places = [], [], []
            for text in batch.column(1).to_pylist():
                data = text.encode()
                payload = data + b"\0" * ((-len(data)) % WIDTH or (WIDTH if not data else 0))
                digest = hashlib.sha256(payload).hexdigest()
                sizes.append(len(data))
                digests.append(digest)
                places.append(shard.add(digest, lambda p=payload: to_media(p)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests), pa.array([shard.path] * len(sizes)), pa.array([p[0] for p in places], pa.int64()), pa.array([p[1] for p in places], pa.int64())],
                ["id", "n_bytes", "digest", "shard", "offset", "length"],
            )
            if shard.at >= SHARD_BYTES:
                shard.close()
                shard = None
        if shard is not None:
            shard.close()

    read = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = read.schema["id"].dataType.simpleString()
    made = read.mapInArrow(run, f"id {kind}, n_bytes long, digest string, shard string, offset long, length long").withColumnRenamed("id", id_col)
    made.write.parquet(f"{folder}/index")
    return spark.read.schema(made.schema).parquet(f"{folder}/index")


def ranges(batches: Iterator[pa.RecordBatch], most: int | None) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """The stored bytes of each index row (its first ``most`` bytes), with one open file at a time."""
    path = source = None
    try:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part, data = batch.slice(begin, 256), []
                column = lambda name: part.column(part.schema.get_field_index(name)).to_pylist()  # noqa: B023, E731
                for shard, offset, length in zip(column("shard"), column("offset"), column("length")):
                    if shard != path:
                        if source is not None:
                            source.close()
                        system, plain = opened(shard)
                        path, source = shard, system.open_input_file(plain)
                    data.append(source.read_at(length if most is None else min(length, most), offset))
                yield part, data
    finally:
        if source is not None:
            source.close()


def with_metadata(index: DataFrame) -> DataFrame:
    """``index`` with ``width``, ``height`` and ``bit_depth``, from range reads of members' headers alone."""

    def run(batches):
        for part, data in ranges(batches, HEADER_BYTES):
            found = [media_header(x) for x in data]
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array([f[k] for f in found], pa.int64()) for k in range(3))], [*part.schema.names, "width", "height", "bit_depth"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in index.schema)
    return index.mapInArrow(run, f"{schema}, width long, height long, bit_depth long")


def features(index: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Digests and a feature string for each index row, computed from the stored bytes as read back. Rows
    are read in the order of the index, i.e. of the shards."""

    def run(batches):
        for part, data in ranges(batches, None):
            payloads = [from_media(x) for x in data]
            yield pa.RecordBatch.from_arrays(
                [
                    *part.columns[:2],
                    pa.array([len(p) for p in payloads], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in payloads]),
                    pa.array([zlib.crc32(p[-64:]) for p in payloads], pa.int64()),
                    pa.array([len(x) for x in data], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in data]),
                    pa.array([feature_of(p) for p in payloads]),
                    *part.columns[5:],
                ],
                ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height"],
            )

    read = index.select(F.col(id_col).alias("id"), "n_bytes", "shard", "offset", "length", "width", "height")
    kind = read.schema["id"].dataType.simpleString()
    out = read.mapInArrow(run, f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width long, height long")
    return out.withColumnRenamed("id", id_col)
