"""Queries over whole texts: what lies beyond the prefixes that they once read. Some are compared with their SQL."""

import json
import random
import re

import __spark_entry__ as contract
import pyarrow as pa
import pyarrow.parquet as pq


def tables(folder, documents=(), benchmark=()):
    """The folder, with documents (id, text) and benchmark passages as tables."""
    ids, texts = [k for k, _ in documents], [t for _, t in documents]
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "lang": pa.array(["en"] * len(ids))}), folder / "documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array(range(len(benchmark)), pa.int64()), "text": pa.array(benchmark, pa.string())}), folder / "benchmark.parquet")
    return str(folder)


def rows(spark, name, folder):
    return contract.queries()[name](spark, folder).collect()


def by_sql(name, folder, columns):
    """The rows of a query's SQL."""
    duckdb, sql = __import__("duckdb").connect(), contract.oracle_sql()[name]
    for t in ("documents", "benchmark"):
        duckdb.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return sorted(duckdb.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall())


def test_profiles_of_whole_texts(spark, tmp_path):
    texts = ["abc " * 5, "abc " * 23, "abc " * 20 + "xyz" * 9, "", None, "x" * 300, "abc " * 14]
    folder = tables(tmp_path, list(enumerate(texts)), ["abc"])
    got = rows(spark, "lexicon_oov", folder)
    by = {r.doc_id: r for r in got}
    assert [by[k].difficulty for k in range(7)] == ["L1", "L3", "L3", "L1", "L1", "L3", "L2"]
    assert (by[2].total_chars, by[2].oov_count, by[2].oov_sample, by[5].oov_count) == (107, 27, "xyzxy", 300)
    assert sorted(map(tuple, got)) == by_sql("lexicon_oov", folder, got[0].__fields__)
    total = rows(spark, "batch_summary", folder)
    assert list(map(tuple, total)) == [(7, 5, 3, 1, 3)] == by_sql("batch_summary", folder, total[0].__fields__)
    rates = {r.doc_id: (r.oov_rate, r.note) for r in rows(spark, "lexicon_rates", folder)}
    assert rates[2] == (round(27 / 87, 4), "含未登錄字(xyzxy)") and rates[1] == (0.0, "詞庫全覆蓋")


def test_chinese_and_length_of_whole_texts(spark, tmp_path):
    texts = ["a" * 130, "b" * 130, "c" * 101 + "中", "中文", "d" * 50, None, " " * 110 + "中" * 6, "e" * 20]
    folder = tables(tmp_path, list(enumerate(texts)))
    got = rows(spark, "require_chinese", folder)
    assert [r.reason for r in sorted(got)] == ["long", "long", "passed", "short", "non_chinese", "short", "passed", "passed"]
    assert sorted(map(tuple, got)) == by_sql("require_chinese", folder, got[0].__fields__)


def test_cards_of_whole_texts(spark, tmp_path):
    long = " ".join(f"word{chr(97 + k % 26)}" for k in range(300)) + " end"
    folder = tables(tmp_path, [(1, long), (2, "short one"), (3, None), (4, "ab" * 100)])
    got = {r.source_file: r.en_text for r in rows(spark, "align_cards", folder)}
    # short texts are padded to 200 letters, of which cleaning leaves three in a row
    assert got == {"d1.txt": long, "d2.txt": "short oneaaa", "d3.txt": "aaa", "d4.txt": "ab" * 100}


def test_social_tags_of_whole_texts(spark, tmp_path):
    r = random.Random(5)
    texts = ["".join(r.choice("##@@aé中1_.- \n,") for _ in range(r.randint(0, 200))) for _ in range(300)] + [None, "plain " * 500 + "#late @me.x end"]
    folder = tables(tmp_path, list(enumerate(texts)))
    assert len(rows(spark, "strip_social", folder)) == len(texts)
    for row in rows(spark, "strip_social", folder):
        tagged = "#tag one @me.x two #end, " + (texts[row.doc_id] or "") + " #en"
        assert row.text == re.sub(r"@[\w.-]+(?:\s|\Z)", "", re.sub(r"#[\w一-鿿]+(?:\s|\Z)", "", tagged))


def test_alpaca_lines_of_whole_texts(spark, tmp_path):
    texts = ["word " * 100 + 'a"b', None, "", "short"]
    folder = tables(tmp_path, [], texts)
    got = rows(spark, "alpaca_export", folder)
    assert sorted(json.loads(r.value)["input"] for r in got) == sorted(["word " * 100 + "a b", "", "", "short"])
    assert sorted(map(tuple, got)) == by_sql("alpaca_export", folder, ["value"])


def test_pairs_and_names_of_whole_texts(spark, tmp_path):
    texts = ["one\ttwo " * 50, None, "", "short", "*" * 30 + "n" * 60, " " * 70 + "late name", '?"' * 40 + "x"]
    folder = tables(tmp_path, list(enumerate(texts)))
    pairs = rows(spark, "pair_columns", folder)
    assert {r.PAIR_ID: (r.EN_TEXT, r.EN_CHAR_LEN) for r in pairs}["pair_0"] == ("one two " * 50, "400")
    assert sorted(map(tuple, pairs)) == by_sql("pair_columns", folder, pairs[0].__fields__)
    names = rows(spark, "file_names", folder)
    assert [r.name for r in sorted(names)][3:] == ["short", "n" * 40, "late_name", "x"]
    assert sorted(map(tuple, names)) == by_sql("file_names", folder, names[0].__fields__)
