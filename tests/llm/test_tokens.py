"""Token counts, encoding and packing against the library and plain restatements."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from glyphmill.llm import packing, wordbpe
from glyphmill.llm.bpe_codec import decode, encode, round_trip
from glyphmill.llm.packing import cut_windows, pack, tail_windows
from glyphmill.llm.queries import vocabulary
from glyphmill.llm.token_counts import count_tokens
from glyphmill.llm.wordbpe import count_transducer, word_bpe

LETTERS = "abcdeiIA'stlmvre0129 \n\t!?.,-é İßſKÅ日本の́​\x1c\x85　<|>½²_ªº\U0001f600µ中 "


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


def texts():
    r = random.Random(3)
    made = ["".join(r.choice(LETTERS) for _ in range(r.randint(0, 80))) for _ in range(400)]
    return [*made, "", " ", "<|endoftext|>" * 3 + "a<|startoftext|>b", "a" * 3000, "日" * 500, "ab" * 2000 + " x", "don't" * 300, "''s", "A.B! c?"]


def test_encode_and_count_match_library(library):
    bpe, counter = word_bpe(vocabulary()), count_transducer(vocabulary())
    many = bpe.encode_many(texts())
    for text, again in zip(texts(), many):
        want = library.encode(text, add_special_tokens=False).ids
        got = bpe.encode(text)
        assert got == again == np.array(want, dtype="<u4").tobytes()
        assert bpe.decode(got) == library.decode(want, skip_special_tokens=False)
        for chunk in (1, 7, 64, 1 << 16):
            assert counter.count(text, chunk) == len(want)


def test_state_maps_compose_associatively():
    counter = count_transducer(vocabulary())
    start = (0, -1, 0)
    for text, size in (("the quick brown fox. " * 3, 5), ("zusammengesetztewörter" * 9, 7), ("日本語の文字列" * 40, 16), ("=" * 90 + "-" * 90, 11)):
        parts = list(counter.chunks(text, size))
        assert "".join(c for c, _, _ in parts) == text and len(parts) > 2
        maps = [counter.chunk_map(c, open_, more, start) for c, open_, more in parts]
        left = maps[0]
        for m in maps[1:]:
            left = left.then(m)
        right = maps[-1]
        for m in maps[-2::-1]:
            right = m.then(right)
        assert left.apply(start) == right.apply(start) == (start, counter.count(text, 1 << 16)) == (start, counter.scan(maps)[-1].apply(start)[1])


def test_maps_are_exact_for_any_entry():
    counter = count_transducer(vocabulary())
    start, text = (0, -1, 0), "abcdefghijklmnopqrst" * 20
    whole = counter.run(0, text.encode(), True)[1]
    for cut in (3, 50, 111, 222):
        state, n = counter.run(0, text[:cut].encode(), False)
        for guess in (start, counter.states[state], counter.states[counter.run(0, b"zz", False)[0]]):
            m = counter.chunk_map(text[cut:300], True, True, guess)
            after, k = m.apply(counter.states[state])
            assert n + k + counter.run(counter.entered(after), text[300:].encode(), True)[1] == whole


def test_prefixes_count_what_precedes(library):
    counter = count_transducer(vocabulary())
    text = "some words, 123 and 日本語の文字 more. " * 30
    *_, (chars, tokens) = counter.prefix_counts(text, 50)
    assert chars == len(text) and tokens == len(library.encode(text, add_special_tokens=False).ids)
    for chars, tokens in counter.prefix_counts("word " * 200, 50):
        assert tokens == len(library.encode(("word " * 200)[:chars], add_special_tokens=False).ids)


def test_long_unspaced_texts_are_counted_in_bounded_memory(library):
    import tracemalloc

    r, counter = random.Random(8), count_transducer(vocabulary())
    made = lambda n: "".join(chr(r.randrange(0x4E00, 0x9FFF)) for _ in range(n))
    for text in (made(20_000), "a" * 50_000, "=-" * 20_000, "1234567890" * 3000, "абв" * 9000 + "é" * 5000, "e\u0301" * 9000):
        assert counter.count(text, 4096) == len(library.encode(text, add_special_tokens=False).ids)
    peaks = []
    for n in (300_000, 900_000):
        text = made(n)
        tracemalloc.start()
        counter.count(text, 1 << 14)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.5 * peaks[0] + (8 << 20)


def rows(spark):
    data = [(k, t, "clash") for k, t in enumerate(texts())] + [(1, texts()[1], None), (None, None, "x"), (7, None, "x")]
    return spark.createDataFrame(data, "doc_id long, text string, n_tokens string").repartition(3)


def test_count_tokens_query(spark, library):
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(rows(spark), vocabulary(), 100).collect())
    want = []
    for r in rows(spark).collect():
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        want.append((r.doc_id is None, r.doc_id or 0, len((r.text or "").encode()), n, n > 100))
    assert got == sorted(want)
    assert count_tokens(rows(spark).limit(0), vocabulary()).count() == 0


def test_round_trip_query(spark, library):
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in round_trip(rows(spark), vocabulary()).collect())
    want = []
    for r in rows(spark).collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        said = library.decode(ids, skip_special_tokens=False)
        want.append((str(r.doc_id), len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(said.encode()).hexdigest()))
    assert got == sorted(want)
    kept = encode(rows(spark), vocabulary())
    assert kept.columns == ["doc_id", "text", "n_tokens", "ids"]
    assert kept.select(decode(kept.ids, vocabulary()).alias("t")).count() == rows(spark).count()


def test_cut_windows_is_optimal():
    r = random.Random(5)
    for _ in range(200):
        p = np.cumsum([0] + [r.randint(1, 9) for _ in range(r.randint(1, 14))])
        pen = np.array([0.0] + [r.choice([0.0, 2.0, 5.0]) for _ in p[1:]])
        cuts = cut_windows(p, pen, 12)
        cost = lambda c: sum(12 - (p[b] - p[a]) + pen[b] for a, b in zip([0, *c], c))
        best = [0.0] + [float("inf")] * (len(p) - 1)
        for j in range(1, len(p)):
            best[j] = min(best[i] + 12 - (p[j] - p[i]) + pen[j] for i in range(j) if p[j] - p[i] <= 12)
        assert cuts[-1] == len(p) - 1 and all(p[b] - p[a] <= 12 for a, b in zip([0, *cuts], cuts))
        assert abs(cost(cuts) - best[-1]) < 1e-9
    assert tail_windows(4000, 4096) == [4000] and tail_windows(3, 4096) == [2, 1] and tail_windows(4096, 4096) == [4096]


@pytest.mark.parametrize("length", [64, 4096])
def test_pack_keeps_every_token_once(spark, library, length):
    df = rows(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    want = {r.doc_id: [*library.encode(r.text or "", add_special_tokens=False).ids, 2] for r in df.collect()}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in pack(df, vocabulary(), length=length).collect():
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(want)
    for d, ids in want.items():
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
        padding += 0 if at & (at - 1) == 0 else length - at
    assert padding < 0.25 * sum(map(len, want.values())) + length
    assert pack(rows(spark).limit(0), vocabulary()).count() == 0
    assert pack(rows(spark), vocabulary()).count() >= rows(spark).count()


def test_candidates_without_sorting(monkeypatch):
    rng = np.random.default_rng(5)
    ids, marks = rng.integers(0, 50, 5000), np.arange(50) == 7
    ids[1000:1400] = 3
    ends = np.array([1, 900, 1500, 1501, 5000])
    cuts = {0} | set(ends.tolist()) | set((np.flatnonzero(ids == 7) + 1).tolist())
    inner = set()
    for a, b in zip(sorted(cuts), sorted(cuts)[1:]):
        if b - a > 64:
            inner |= {*range(a + 64, b, 64), *range(b - 64, a, -64)}
    for name in ("union1d", "isin", "unique"):
        monkeypatch.setattr(packing.np, name, None)
    positions, penalties = packing.candidates(ids, ends, marks, 64)
    assert inner and positions.tolist() == sorted(cuts | inner)
    assert penalties.tolist() == [64.0 if p in inner else 0.0 if p in {0, *ends.tolist()} else 8.0 for p in positions.tolist()]


def test_contractions_and_long_lists(library, monkeypatch):
    bpe = wordbpe.WordBpe(vocabulary())
    monkeypatch.setattr(wordbpe, "AT_ONCE", 5)
    texts = ["it's 'tis ''s 'x 'reed we've'll i'm'd", "'S don'T.'t 3's ²'m", "'", "", "a", "!'s", "é're ß've"]
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.encode_many(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
