"""What bounds workers and passes of the cleaning steps."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glyphmill import queries
from glyphmill.functions import native, udfs
from glyphmill.llm import batches, toxicity, wordbpe
from glyphmill.llm.queries import vocabulary
from glyphmill.operators import align
from glyphmill.options import CleanOptions
from glyphmill.plans import corpus
from glyphmill.sources.tables import BATCH_BYTES


def test_pieces_are_bounded_by_bytes():
    texts = ["a" * 300, None, "", "b" * 5000, "字" * 200, "c"] * 40
    made = list(udfs.pieces(iter([pa.array(texts), pa.array([], pa.string())]), most=1000))
    assert [t for p in made for t in p.to_pylist()] == texts
    assert all(len(p) <= 1 or sum(len((t or "").encode()) for t in p.to_pylist()) <= 1000 for p in made)


def test_cards_are_read_once(spark):
    files = spark.createDataFrame([("a.txt", "x")], "file_name string, text string")
    assert align.align_cards(files)._jdf.queryExecution().executedPlan().toString().count("_cards(") == 1


@pytest.mark.parametrize("line, notice", [("記者王小明／台北報導", True), ("版權所有 翻印必究", True), ("點我看更多", True), ("AdvertisemenT", True), ("廣告", True), ("廣告商說明", False), ("====", True), ("==", False), ("a ----", False), ("請訂閱本台", True), ("記錄", False), (" \x85", True)])
def test_notices(spark, line, notice):
    row = spark.createDataFrame([(line,)], "t string").select(native.is_boilerplate(F.col("t")).alias("b"), F.size(native.kept_lines(F.col("t"))).alias("n")).first()
    assert (row.b, row.n) == (notice, 0 if notice else 1)


def test_quotes_at_their_edges(spark):
    cases = {"“a\nb” “c”": "“a\nb” 「c」", '"" "x\'yz\'"': '"「 」x『yz』"', "“‘a’” 'bc' ‘\n’": "「『a』」 『bc』 ‘\n’", "“𝒳é”": "「𝒳é」", "“a“b”": "“a「b」", "”x“": "”x“"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.q for r in df.select("t", native.dialog_quotes(F.col("t")).alias("q")).collect()} == cases


def test_model_is_read_where_it_lies():
    n = np.array([[3.0], [1.0]], dtype=np.float32)  # one word, one pair
    model = toxicity.Model(words=np.array([7]), cont=n, total=n, kept=n, both=n[0], pairs=np.array([9]), count=n, sums=np.ones((3, 2)), discounts=np.array([0.5, 0.4]), weights=np.arange(5.0))
    data = model.dumps()
    again, raw = toxicity.Model.loads(data), np.frombuffer(data, np.uint8)
    assert all(np.array_equal(getattr(model, p), getattr(again, p)) and np.shares_memory(getattr(again, p), raw) for p in toxicity.Model.PARTS)
    for own in (None, 0, 1):
        assert np.array_equal(model.features(np.array([7, 8]), own), again.features(np.array([7, 8]), own))


def test_other_tasks_let_go_of_vocabularies():
    first = wordbpe.word_bpe(vocabulary())
    batches.trim("vocabulary")
    assert wordbpe.word_bpe(vocabulary()) is first
    batches.trim()
    assert wordbpe.word_bpe.cache_info().currsize == wordbpe.count_transducer.cache_info().currsize == 0


def test_samples_pass_no_python_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "vile"), (2, "kind")], "doc_id long, text string").localCheckpoint()
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int").localCheckpoint()
    monkeypatch.setattr(type(spark), "_createFromLocal", lambda *a: pytest.fail("rows go through Python workers"), raising=False)
    monkeypatch.setattr(type(spark), "_create_dataframe", lambda *a: pytest.fail("rows go through Python workers"))
    assert len(toxicity.train(docs, labels).words) == 3  # two words and what begins a text


@pytest.mark.parametrize("options", [CleanOptions(), CleanOptions(dedup_scope="document", require_chinese=True), CleanOptions(deduplicate=False, max_sentence_len=9)])
def test_stats_in_one_pass(spark, options):
    text = "<p>這一句話會重複出現兩次喔。短。Latin only here。</p>這一句話會重複出現兩次喔！！！a@b.org\n版權所有 翻印必究"
    docs = spark.createDataFrame([(1, text), (2, text), (3, None), (4, ""), (4, "這一句話會重複出現兩次喔。"), (None, "沒有編號的檔案也要計算。")], "doc_id long, text string")
    for some in (docs, docs.limit(0)):
        made, labelled, cleaned = corpus.run(some, options, doc_key=F.col("doc_id"), order=["doc_id"])
        before, after = corpus.run_stats(cleaned, labelled, made), corpus.stats_alone(some, options, doc_key=F.col("doc_id"), order=["doc_id"])
        assert (before.dtypes, before.collect()) == (after.dtypes, after.collect())
    plan = corpus.stats_alone(docs, options, doc_key=F.col("doc_id"), order=["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("_protected(") == 1 and "InMemoryTableScan" not in plan


def test_run_stats_cleans_once(spark, tmp_path):
    spark.createDataFrame([(1, "One sentence here. Another one there.", "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = queries.run_stats(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == plan.count("_protected(") == 1 and "InMemoryTableScan" not in plan


def test_batches_of_every_query_are_bounded(spark, tmp_path):
    spark.createDataFrame([(1, "One.", "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    for given, wanted in ((None, str(8 << 20)), ("12345", "12345")):
        spark.conf.unset(BATCH_BYTES)
        if given:
            spark.conf.set(BATCH_BYTES, given)
        queries.segment_quoted(spark, str(tmp_path))
        assert spark.conf.get(BATCH_BYTES) == wanted
    spark.conf.unset(BATCH_BYTES)


def test_known_pieces_are_kept_by_parts():
    memo = wordbpe.Memo(lambda key: key.upper(), limit=5)
    for k in range(0, 12, 3):
        memo.put_all({f"p{k + i}": "x" for i in range(3)} | {"l" * 64: "long"})
        assert len(memo) <= 5 and len(memo.old) <= 5 and "l" * 64 not in memo
    assert "p11" in memo and memo["p6"] == "x" and memo["new"] == "NEW"


def test_batches_encode_as_texts_do():
    bpe = wordbpe.WordBpe(vocabulary())
    texts = [" ".join(f"w{k}x{k * 7}é" for k in range(n, n + 3000)) + " <|endoftext|> " + "q" * 80 for n in (0, 1500, 0)] + ["", "plain words, plain words."]
    bpe.piece_ids.limit = 4000  # generations turn within a batch
    many = [x for part in (texts[:2], texts[2:]) for x in bpe.encode_many(part)]
    assert many == [wordbpe.WordBpe(vocabulary()).encode(t) for t in texts]


def test_new_words_are_encoded_without_the_library(monkeypatch):
    rng = random.Random(4)
    syllables = ["an", "ble", "tion", "é", "ß", "x", "zu", "th", "q", "keit", "a", "ñ", "7"]
    words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    text = "".join(w + rng.choice([" ", ". ", ", ", ".", ",", "... ", ".) ", "'s ", " '.", "!,", "\n", "-", "\x85"]) for w in words)
    texts = [text[:9000], text.title(), text[9000:].replace("... ", " "), "a,b.c 'tis., .,", "k" * 90 + "." + "m" * 90 + ",", ""]
    want = [wordbpe.WordBpe(vocabulary()).tokenizer().encode(t, add_special_tokens=False).ids for t in texts]
    monkeypatch.setattr(wordbpe, "KNOWN", 500)
    monkeypatch.setattr(wordbpe, "ROWS", 300)
    monkeypatch.setattr(wordbpe.WordBpe, "tokenizer", None)
    bpe = wordbpe.WordBpe(vocabulary())
    for _ in range(2):
        for part in (texts[:1], texts[1:2], texts[2:]):
            assert [memoryview(x).cast("I").tolist() for x in bpe.encode_many(part)] == want[: len(part)]
            want = want[len(part) :] + want[: len(part)]
            assert all(len(w) < wordbpe.LONG for w in bpe.known)
    bpe.encode_many(["one more, " * 3])
    assert len(bpe.known) <= 500 + 3


def test_repeated_and_colliding_merges():
    bpe = wordbpe.WordBpe(vocabulary())
    bpe.pair_keys, bpe.pair_ids = bpe.pair_keys[:3000].repeat(2), np.arange(6000, dtype=np.int32)
    keys = bpe.pair_keys[::2]
    assert bpe.ranks(keys >> np.uint64(20), keys & np.uint64((1 << 20) - 1)).tolist() == [*range(0, 6000, 2)]
    assert bpe.ranks(keys >> np.uint64(20), np.full(3000, wordbpe.NO_ID)).tolist() == [wordbpe.NO_RANK] * 3000
    assert [bpe.merges[k] for k in keys.tolist()] == [(k, k) for k in range(0, 6000, 2)]
