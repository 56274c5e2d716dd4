"""The Jaccard join against all pairs by brute force, and signatures' completeness."""

import random
import re
import time

import numpy as np
from pyspark.sql import functions as F
import pytest

from glyphmill.llm import components
from glyphmill.llm.components import connected
from glyphmill.llm.shared import written
from glyphmill.llm.shingle_join import Shingler, Signer, drop_near_copies, key_of, link_components, mix, sets_of, short_of


def shingles(text, width):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)} or {tuple(words)}


def brute(rows, width, percent):
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    groups = {}
    for k, (d, _) in enumerate(rows):
        groups.setdefault(find(k), []).append(d)
    return sorted((d, len(sets[k]), min(groups[find(k)])) for k, (d, _) in enumerate(rows))


def corpus(seed, n=25):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows, base = [], []
    for _ in range(n):
        base.append([r.choice(vocabulary) for _ in range(r.choice([1, 2, 3, 9, 12, 20, 35, 60, 150, 400]))])
    for words in base:
        for _ in range(r.choice([1, 1, 2, 6])):
            copy = list(words)
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            rows.append(" ".join(copy) + r.choice(["", " ", "\n"]))
    chain = [r.choice(vocabulary) for _ in range(200)]  # drifts: neighbours are linked, the ends are not
    for _ in range(40):
        chain[r.randrange(200)] = r.choice(vocabulary)
        rows.append(" ".join(chain))
    rows += ["", None, "   ", "A b", "a B", "a b c", "É x y z", "é x y z", "a b c"]
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("width", "percent", "seed"), [(3, 90, 1), (5, 80, 2), (3, 90, 3)])
def test_components(spark, width, percent, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id long, text string, key string").repartition(3)
    got = link_components(df, width=width, percent=percent)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute(rows, width, percent)


def test_many_near_copies_without_a_common_link(spark, monkeypatch):
    from glyphmill.llm import shingle_join

    monkeypatch.setattr(shingle_join, "BLOCK", 16)
    r = random.Random(9)
    vocabulary = [f"w{k}" for k in range(3000)]
    base = [r.choice(vocabulary) for _ in range(150)]
    rows = []
    for _ in range(120):
        copy = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 4, 6, 8])):
            copy[r.randrange(150)] = r.choice(vocabulary)
        rows.append(" ".join(copy))
    rows = list(enumerate(rows))
    got = link_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), width=3, percent=90)
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got.collect()) == brute(rows, 3, 90)


def test_sketches_never_overstate():
    from glyphmill.llm.shingle_join import folded, sketch_of

    r = np.random.default_rng(2)
    for _ in range(200):
        x = np.unique(mix(r.integers(0, 1 << 63, int(r.integers(1, 700))).astype(np.uint64)))
        y = np.unique(np.concatenate([x[int(r.integers(0, 60)):], mix(r.integers(0, 1 << 63, int(r.integers(0, 600))).astype(np.uint64))]))
        assert int(np.bitwise_count(np.bitwise_xor(*folded([sketch_of(x), sketch_of(y)]))).sum()) <= len(np.setxor1d(x, y))


def test_edges_of_input(spark):
    df = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (4, "other words here now"), (9, "long word " * 30_000)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in link_components(df, width=3, percent=90).collect())
    assert got == [("4", 2, 4), ("4", 2, 4), ("4", 2, 4), ("9", 2, 9), ("None", 2, 4), ("None", 2, 4)]
    assert link_components(df.limit(0)).count() == 0


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_share_a_signature(percent):
    r = np.random.default_rng(1)
    signer = Signer(percent)
    for _ in range(1500):
        n = int(r.integers(2, 700))
        x = np.unique(mix(r.integers(0, 1 << 63, n).astype(np.uint64)))
        gone = int(r.integers(0, n // 4 + 1))
        y = np.unique(np.concatenate([r.permutation(x)[gone:], mix(r.integers(0, 1 << 63, int(r.integers(0, n // 4 + 1))).astype(np.uint64))]))
        both = len(np.intersect1d(x, y))
        if len(y) and 100 * both >= percent * (len(x) + len(y) - both) and both < max(len(x), len(y)):
            assert len(np.intersect1d(signer.sign(x), signer.sign(y)))


def test_shingler_counts():
    for width in (3, 5):
        for text in ("a b", "a b c a b c a b c", "x", "A  b\tC\x0bd\x1ce", "é É"):
            assert len(Shingler(width).set_of(text)) == len(shingles(text, width))


def test_connected(spark):
    r = random.Random(4)
    edges = [(k, k + 1) for k in range(50)] + [(100, k) for k in range(101, 130)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(60)] + [(7, 7)]
    got = {x.node: x.root for x in connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    label = {n: n for e in edges for n in e}
    for _ in range(60):
        for u, v in edges:
            label[u] = label[v] = min(label[u], label[v])
    assert all(got.get(n, n) == label[n] for n in label)


def test_connected_deals_hubs_to_pieces(spark, monkeypatch):
    from glyphmill.llm import components

    monkeypatch.setattr(components, "HUB_SHARE", 20)
    monkeypatch.setattr(components, "PIECE_SHARE", 40)
    edges = [(500, k) for k in range(1, 400)] + [(0, k) for k in range(600, 700)] + [(k, k + 1) for k in range(800, 820)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = components.with_least(df, len(edges)).collect()
    assert sorted((r.u, r.v, r.m) for r in got) == sorted((u, v, min(u, *(y for x, y in edges if x == u))) for u, v in edges)
    root = {x.node: x.root for x in components.connected(df).collect()}
    assert root == {**{k: 1 for k in [*range(2, 400), 500]}, **{k: 0 for k in range(600, 700)}, **{k: 800 for k in range(801, 821)}}
    assert components.connected(df.limit(0)).count() == 0


def test_dropping_keeps_columns_of_any_name(spark):
    rows = corpus(5, 12)
    names = ["word", "bits", "maybe", "maybe__", "place", "row", "gone", "gone__", "likely", "key"]
    df = spark.createDataFrame([(d, t, *range(len(names))) for d, t in rows] + [(None, rows[0][1], *range(len(names)))], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names)).repartition(3)
    kept = drop_near_copies(df, width=3, percent=90)
    assert kept.columns == df.columns
    got = kept.collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(["None", *(str(d) for d, n, c in brute(rows, 3, 90) if n == 0 or d == c)])
    assert all(tuple(r)[2:] == tuple(range(len(names))) for r in got)
    assert drop_near_copies(df.limit(0)).columns == df.columns and drop_near_copies(df.limit(0)).count() == 0


def test_bitmap_clears_only_what_is_absent(spark, monkeypatch):
    from glyphmill.llm import shingle_join

    df, ids = spark.range(3000).select(F.col("id"), F.lit("x").alias("word")), spark.range(0, 3000, 50).select(F.col("id").alias("gone"))
    for most in (shingle_join.MOST_BITS, 1):  # beyond the bitmap's bound every row may be one
        monkeypatch.setattr(shingle_join, "MOST_BITS", most)
        marked = shingle_join.maybe_in(df, "id", ids).select("row.c0", "maybe").collect()
        assert all(m for i, m in marked if i % 50 == 0) and (most == 1) == all(m for _, m in marked)


def test_session_keeps_its_own_batch_bound(spark):
    from glyphmill.llm.shared import BATCH_BYTES, bounded_batches

    spark.conf.unset(BATCH_BYTES)
    bounded_batches(spark)
    assert spark.conf.get(BATCH_BYTES) == str(8 << 20)
    spark.conf.set(BATCH_BYTES, "64m")
    bounded_batches(spark)
    assert spark.conf.get(BATCH_BYTES) == "64m"
    spark.conf.unset(BATCH_BYTES)


def test_written_leaves_no_shuffle_files(spark):
    def files():
        kept = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return {f for f in kept.split("\n") if re.search(r"/shuffle_[0-9_]+\.(data|index)$", f)}

    before = files()
    df = spark.range(1000).repartition(4, "id").groupBy((F.col("id") % 7).alias("k")).count()
    assert written(df, "test").count() == 7  # this count's own shuffle may stay
    for _ in range(50):
        if sum(f.endswith(".data") for f in files() - before) <= 1:
            break
        time.sleep(0.1)
    assert sum(f.endswith(".data") for f in files() - before) <= 1
    assert "spark.sql.classic.shuffleDependency.fileCleanup.enabled" not in spark.conf.getAll


def test_stars_take_no_round(spark, monkeypatch):
    monkeypatch.setattr(components, "with_least", None)
    found = connected(spark.createDataFrame([(5, 1), (1, 4), (9, 2), (2, 2), (5, 1)], "u long, v long"))
    assert sorted(map(tuple, found.collect())) == [(4, 1), (5, 1), (9, 2)]
    assert connected(spark.createDataFrame([], "u long, v long")).collect() == []


def test_each_set_once(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (1, "A  B c D"), (1, "x y z"), (None, "n o p"), (None, "n o p"), (2, None)], "id long, text string")
    keys = [(rep, key_of(Shingler(3).set_of(text))) for rep, text in ((1, "a b c d"), (1, "x y z"), (None, "n o p"))]
    wanted = spark.createDataFrame(keys, "rep long, key binary").withColumn("short", short_of(F.col("key")))
    found = sets_of(docs, wanted, 3)
    assert sorted((bytes(r.key), r.n) for r in found.collect()) == sorted((k, n) for (_, k), n in zip(keys, (2, 1, 1)))
