"""Exact copies against a brute-force grouping, with strong and with deliberately weak hashes."""

import hashlib
from collections import defaultdict

import pytest

from glyphmill.llm.exact_dedup import directory, drop_copies, find_copies

ROWS = [
    (1, "a", "x"), (2, "a", None), (3, "b", "x"), (4, None, "y"), (5, "", "z"), (6, "a ", "x"), (7, "A", "x"),
    (8, "long " * 20_000, "x"), (9, "long " * 20_000, "y"), (10, "b", "q"), (10, "b", "q"), (None, "b", "q"), (None, "only", "q"), (None, "only", "r"),
] + [(100 + k, "hot", "h") for k in range(500)] + [(1000 + k, f"text {k % 150}", "t") for k in range(300)]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id long, text string, kept string").repartition(5)


def brute():
    groups = defaultdict(list)
    for d, t, _ in ROWS:
        groups[t or ""].append(d)
    out = []
    for t, ids in groups.items():
        known = [d for d in ids if d is not None]
        keep = max(known) if known else None
        first = True
        for d in sorted(ids, key=lambda d: (d is not None, d or 0), reverse=True):
            out.append((str(d), str(keep), len(ids), first, hashlib.sha256(t.encode()).hexdigest()))
            first = False
    return sorted(out)


@pytest.mark.parametrize(("bits", "capacity"), [(64, 4096), (64, 8), (3, 8)])
def test_find_copies(spark, bits, capacity):
    got = find_copies(frame(spark), capacity=capacity, hash_bits=bits)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in got.collect()) == brute()


@pytest.mark.parametrize("bits", [64, 3])
def test_drop_copies(spark, bits):
    got = drop_copies(frame(spark), capacity=8, hash_bits=bits)
    assert got.columns == ["doc_id", "text", "kept"]
    rows = got.collect()
    assert sorted((str(r.doc_id), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in rows) == sorted((d, s) for d, _, _, kept, s in brute() if kept)
    assert all((r.doc_id, r.text, r.kept) in {(a, b, c) for a, b, c in ROWS} for r in rows)


def test_empty(spark):
    assert find_copies(frame(spark, []).limit(0)).count() == 0
    assert drop_copies(frame(spark, []).limit(0)).count() == 0


def test_directory_splits_until_buckets_fit(spark):
    hashes = spark.range(4000).selectExpr("xxhash64(id) as h").union(spark.range(900).selectExpr("cast(77 as long) as h"))
    depth, slots = directory(hashes, 50)
    assert len(slots) == 1 << depth and -1 not in slots
    assert slots == sorted(slots)
