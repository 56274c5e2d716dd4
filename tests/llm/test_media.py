"""Media shards: exact round trips, shared members, header reads, and a plain tar reader."""

import hashlib
import tarfile
import zlib

from glyphmill.llm import media

TEXTS = ["", None, "a", "x" * 64, "y" * 65, "é日\x00" * 40, "dup", "dup", "long " * 100_000, "tail\0\0"]


def test_png_round_trip():
    for n in (64, 128, 64 * 1000):
        payload = hashlib.shake_128(b"x").digest(n)
        stored = media.to_media(payload)
        assert media.from_media(stored) == payload
        assert media.media_header(stored[: media.HEADER_BYTES]) == (64, n // 64, 8)


def test_store_and_features(spark, tmp_path):
    df = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(TEXTS)] + [(None, "dup", "z")], "doc_id long, text string, digest string").repartition(2)
    index = media.store(df, f"file://{tmp_path}/m")
    rows = {r.doc_id: r for r in media.features(media.with_metadata(index)).collect()}
    assert len(rows) == len(TEXTS) + 1
    for k, t in enumerate(TEXTS):
        data = (t or "").encode()
        payload = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        stored = media.to_media(payload)
        r = rows[k]
        assert (r.n_bytes, r.payload_bytes, r.width, r.height) == (len(data), len(payload), 64, len(payload) // 64)
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert r.feature == media.feature_of(payload)
    assert rows[6].feature == rows[7].feature == rows[None].feature
    for r in index.collect():
        with tarfile.open(r.shard.removeprefix("file://")) as tar:
            names = tar.getnames()
            assert len(names) == len(set(names))
            assert hashlib.sha256(media.from_media(tar.extractfile(f"{r.digest}.png").read())).hexdigest() == r.digest
    assert media.features(media.with_metadata(media.store(df.limit(0), f"file://{tmp_path}/e"))).count() == 0


def test_feature_values():
    assert media.feature_of(b"\x00" * 32 + b"\x10" * 32) == "8000:64000000:32,32" + ",0" * 14
