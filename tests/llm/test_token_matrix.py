"""Token matrices: best fit against brute force, and an exact round trip through the files."""

import random
from collections import defaultdict

import numpy as np

from glyphmill.llm import token_matrix as M
from glyphmill.llm.queries import vocabulary
from glyphmill.llm.wordbpe import word_bpe


def plain(lengths, length):
    free, out = [], [None] * len(lengths)
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        fit = [(c, -r) for r, c in enumerate(free) if c >= lengths[k]]
        if fit:
            r = -min(fit)[1]
        else:
            r = len(free)
            free.append(length)
        free[r] -= lengths[k]
        out[k] = r
    return out, len(free)


def test_best_fit():
    r = random.Random(6)
    for _ in range(200):
        length = r.choice([1, 7, 8, 16, 100])
        sizes = [r.randint(1, length) for _ in range(r.randint(0, 60))]
        rows, offsets, made = M.best_fit_decreasing(sizes, length)
        assert made == plain(sizes, length)[1]
        cells = set()
        for row, o, n in zip(rows, offsets, sizes):
            mine = {(row, x) for x in range(o, o + n)}
            assert not mine & cells and o + n <= length
            cells |= mine


def test_round_trip(spark, tmp_path):
    texts = ["", None, "a b c", "word " * 500, "x. y! z? " * 40, "é日本 " * 30, "a b c"]
    df = spark.createDataFrame([(k, t, "c") for k, t in enumerate(texts)] + [(None, "n", "c")], "doc_id long, text string, row string").repartition(2)
    index = M.write_matrices(df, vocabulary(), f"file://{tmp_path}/m", length=64)
    got = M.read_pieces(index, vocabulary(), length=64).collect()
    assert all(r.resets_ok for r in got)
    by = defaultdict(dict)
    for r in index.collect():
        matrix, lengths, resets = M.read_block(r.file, 64, M.width_for(vocabulary(), 2))
        by[r.doc_id][r.start] = matrix[r.row, r.offset : r.offset + r.length].tolist()
        assert r.row * 64 + r.offset in resets and lengths[r.row][0] == 0
    for k, t in [*enumerate(texts), (None, "n")]:
        want = [*np.frombuffer(word_bpe(vocabulary()).encode(t or ""), "<u4").tolist(), 2]
        assert [x for s in sorted(by[k]) for x in by[k][s]] == want
    assert M.read_pieces(M.write_matrices(df.limit(0), vocabulary(), f"file://{tmp_path}/e"), vocabulary()).count() == 0
