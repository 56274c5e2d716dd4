"""Scans, sinks, feeds, registry, the whole plan and the stream, on files made here."""

import csv
import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from glyphmill.options import CleanOptions
from glyphmill.plans import corpus
from glyphmill.sinks import tsv
from glyphmill.sources import feeds, files, registry
from glyphmill.streaming import clean_stream

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx(paragraphs):
    run = lambda t, color: f'<w:r><w:rPr><w:color w:val="{color}"/></w:rPr><w:t>{t}</w:t></w:r>' if color else f"<w:r><w:t>{t}</w:t></w:r>"
    body = "".join("<w:p>" + "".join(run(*r) for r in p) + "</w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def odt(text):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("content.xml", f'<o xmlns:t="urn:t"><t:h>標題</t:h><t:p>{text}<t:span>x</t:span></t:p><t:p> </t:p></o>')
    return out.getvalue()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("corpus")
    (top / "sub").mkdir()
    put = lambda name, data: (top / name).write_bytes(data if isinstance(data, bytes) else data.encode())
    put("a.txt", "第一句。")
    put("bom.md", "﻿x".encode())
    put("big5.txt", "中文".encode("big5"))
    put("gb.txt", "简体龥㐀".encode("gb18030"))
    put("bad.text", b"\xff\xfe\xfa\x00\xff")
    put("l.jsonl", '{"content":"c","text":"t"}\n\nnot json\n{"other":1}\n5\n"plain text"\n[1]\n{"text":3,"raw":"r"}')
    put("list.json", json.dumps(["s", {"text": "t"}, {"content": "c"}, {"x": 1}, 7]))
    put("dict.json", json.dumps({"article": "art"}))
    put("odd.json", json.dumps({"k": "v"}))
    put("broken.json", "{")
    put("h.csv", 'id,Text\n1,one\n\n2,"tw,o"\n3\n')
    put("n.tsv", "a\tlonger\nlonger\tb\n")
    put("q.csv", '1,"x\ny"\n')
    put("d.docx", docx([[("green", "00A933"), ("red", "FF0000")], [("plain", None)], [("", None)]]))
    put("broken.docx", "nothing")
    put("o.odt", odt("段落"))
    put("skip.pdf", "x")
    put(".hidden.txt", "x")
    put("sub/z.txt", "最後。")
    return str(top)


def test_scan(spark, folder):
    got = {r.doc_id: r for r in files.read_corpus(spark, folder).collect()}
    text = {k: r.text for k, r in got.items()}
    assert text == {
        "a": "第一句。", "bom": "﻿x", "big5": "中文", "gb": "简体龥㐀", "bad": text["bad"], "l_1": "t", "l_4": "", "l_6": "plain text", "l_8": "r",
        "list_1": "s", "list_2": "t", "list_3": "c", "list_4": "{'x': 1}", "dict": "art", "odd": "{'k': 'v'}", "h_2": "one", "h_4": "tw,o", "n_1": "longer", "n_2": "longer", "q_1": "xy",
        "d": "greenred\nplain", "o": "標題\n段落x", "z": "最後。",
    }
    assert (got["a"].meta.encoding, got["big5"].meta.encoding, got["gb"].meta.encoding, got["d"].meta.encoding) == ("utf-8", "big5", "gb18030", "docx_xml")
    assert got["l_1"].meta.line_idx == 0 and json.loads(got["l_1"].meta.json_raw)["content"] == "c" and got["d"].meta.vetted_only is False
    vetted = files.read_corpus(spark, f"{folder}/d.docx", vetted_only=True).collect()
    assert [r.text for r in vetted] == ["green"]
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        files.read_corpus(spark, f"{folder}/absent").collect()


DIRTY = "\n".join(
    ["<div><p>記者王小明／高雄報導</p>", "<p>今天的天氣真好！！！我們去公園散步吧。</p>", "<p>老師說：“大家早安！請坐下。”同學們都坐下了。</p>", "<p>網址 https://a.example.org/x 請看。</p>", "<p>短。</p>", "<p>這一句話會重複出現兩次喔。</p>", "<p>這一句話會重複出現兩次喔。</p>", "<p>版權所有 翻印必究。</p></div>"]
)


def test_plan(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/one.txt").write_text(DIRTY)
    (tmp_path / "in/two.txt").write_text("這一句話會重複出現兩次喔。第二個檔案自己的句子。")
    made, labelled, cleaned = corpus.run(files.read_corpus(spark, f"{tmp_path}/in"))
    rows = [(r.corpus_id, r.clean_text, r.char_len, r.difficulty) for r in made.orderBy("path_parts", "row_idx", "sent_ord").collect()]
    assert [r[1] for r in rows] == ["老師說：「大家早安！請坐下。」同學們都坐下了。", "這一句話會重複出現兩次喔。", "第二個檔案自己的句子。"]
    assert [r[0] for r in rows] == ["one_0001", "one_0002", "two_0001"] and {r[3] for r in rows} == {"L3"}
    stats = corpus.run_stats(cleaned, labelled, made).first()
    assert (stats.documents, stats.clean_sentences, stats.dropped_duplicate, stats.urls_and_emails, stats.punct_compressed) == (2, 3, 2, 1, 1)
    plain, _, _ = corpus.run(files.read_corpus(spark, f"{tmp_path}/in"), CleanOptions(enable_lexicon_profiling=False, deduplicate=False))
    assert {(r.difficulty, r.oov_rate, r.note) for r in plain.collect()} == {("L1", 0.0, "")} and plain.count() == 5
    tsv.write_tsv(tsv.item_columns(made), f"{tmp_path}/out", single=True, order=["CORPUS_ID"])
    again = files.read_clean_tsv(spark, f"{tmp_path}/out").orderBy("corpus_id").collect()
    assert [(r.corpus_id, r.clean_text, r.char_len, r.difficulty, r.feasible) for r in again] == [(*r[:4], True) for r in rows]


def test_tsv_bytes(spark, tmp_path):
    r = random.Random(1)
    rows = [(f"i{k}", "".join(r.choice('a"\t\\, 中\n\r') for _ in range(r.randint(0, 12))), "n\tn") for k in range(60)]
    df = spark.createDataFrame(rows, "corpus_id string, clean_text string, note string").selectExpr("*", "'g' as category", "'L1' as difficulty", "3 as char_len", "0.5d as oov_rate", "true as feasible")
    tsv.write_tsv(tsv.item_columns(df), f"{tmp_path}/t", single=True, order=["CORPUS_ID"])
    written = next((tmp_path / "t").glob("part*")).read_text()
    out = io.StringIO()
    writer = csv.writer(out, delimiter="\t", lineterminator="\n")
    writer.writerow(tsv.ITEM_HEADER)
    for i, t, _ in sorted(rows):
        writer.writerow([i, "g", "L1", 3, "0.5000", t.replace("\t", " ").replace("\r", "").replace("\n", " "), "YES", "n n"])
    assert written == out.getvalue()


def test_clean_tsv_guards(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("CORPUS_ID\tCATEGORY\tDIFFICULTY\tCHAR_LEN\tOOV_RATE\tCLEAN_TEXT\tF\tN\nx\tg\tL9\tno\tbad\tabc\n y\tg\tL2\t7\t0.25\tabc\tNO\tnote\nshort\tg\n")
    rows = {r.corpus_id.strip(): r for r in files.read_clean_tsv(spark, f"{tmp_path}/c.tsv").collect()}
    assert set(rows) == {"x", "y"}
    assert (rows["x"].difficulty, rows["x"].char_len, rows["x"].oov_rate, rows["x"].feasible) == ("L1", 3, 0.0, True)
    assert (rows["y"].difficulty, rows["y"].char_len, rows["y"].oov_rate, rows["y"].feasible, rows["y"].note) == ("L2", 7, 0.25, False, "note")


PAGE = """<html><head><title>測試 標題</title><style>x{}</style><script>track()</script></head><body><header><nav>首頁</nav></header>
<main><h1>大標題</h1><p>第一段 <b>內文</b> 很好。</p><aside>側欄</aside><blockquote>引用的文字。</blockquote><p>短</p></main><footer><p>頁尾</p></footer></body></html>"""


def test_pages(spark):
    assert feeds.main_text(PAGE) == ("測試 標題", "#  大標題\n\n第一段 內文 很好。\n\n引用的文字。")
    assert feeds.main_text("<p>before one</p><input><p>hidden</p><form></form><p>after one</p>")[1] == "before one"
    assert feeds.main_text("<input><p>hidden</p></form><p>shown text</p>")[1] == "shown text"
    assert feeds.main_text(None) == ("", "")
    row = spark.createDataFrame([(PAGE,)], "html string").select(feeds.extract_html(F.col("html")).alias("x")).first().x
    assert row.title == "測試 標題"
    loud = lambda html: html.upper() if "內文" in html else None
    both = spark.createDataFrame([(PAGE,), ("<p>plain text</p>",), (None,)], "html string").select(feeds.extract_html(F.col("html"), loud).alias("x")).collect()
    assert [(r.x.title, r.x.body) for r in both] == [("測試 標題", PAGE.upper()), ("", "plain text"), ("", "")]


RSS = """garbage<rss version="2.0" xmlns:c="http://purl.org/rss/1.0/modules/content/"><channel><title>t</title><item><title> 一 </title><link>https://e.org/1</link><description>摘要&lt;b&gt;甲&lt;/b&gt;</description></item>
<item><title>二</title><link>https://e.org/2</link><description>d</description><c:encoded>全文</c:encoded></item></channel></rss>"""


def test_feeds(spark):
    items = feeds.feed_items(RSS)
    assert [(i["title"], i["link"], i["content"], i["type"]) for i in items] == [("一", "https://e.org/1", "摘要<b>甲</b>", "rss2.0"), ("二", "https://e.org/2", "全文", "rss2.0")]
    for ns in ("", ' xmlns="http://www.w3.org/2005/Atom"'):
        assert feeds.feed_items(f'<feed{ns}><entry><title>T</title><link href="https://e.org/a"/><summary>S</summary></entry></feed>') == [{"title": "T", "link": "https://e.org/a", "content": "S", "type": "atom"}]
    assert feeds.feed_items("nothing") == feeds.feed_items(None) == []
    df = feeds.read_feeds(spark.createDataFrame([("f", RSS), ("g", None)], "feed_url string, xml string"))
    pages = spark.createDataFrame([("https://e.org/2", "<p>long page text</p>")], "url string, html string")
    got = {r.title: r.text for r in feeds.feed_documents(df, pages).collect()}
    assert got == {"一": "# 一\n\n摘要 甲", "二": "long page text"} and feeds.feed_documents(df, None, 1).count() == 1


def test_wiki(spark):
    good = json.dumps({"query": {"pages": {"12": {"title": "貓", "extract": " 內文 "}}}})
    bad = json.dumps({"query": {"pages": {"-1": {"title": "無"}}}})
    df = spark.createDataFrame([("猫", good), ("無", bad), ("壞", "{"), ("空", None)], "title string, json string")
    got = {r.asked: (r.success, r.title, r.text) for r in feeds.wiki_documents(df).collect()}
    assert got == {"猫": (True, "貓", "# 貓\n\n內文"), "無": (False, "無", None), "壞": (False, "壞", None), "空": (False, "空", None)}


def test_wiki_questions(spark):
    row = feeds.wiki_questions(spark, ["貓 科"], "zh-hk").first()
    assert row.origin_url.endswith("/wiki/%E8%B2%93%20%E7%A7%91") and "uselang=zh-hk" in row.url and "titles=%E8%B2%93+%E7%A7%91" in row.url


def test_fetch_failure_and_charset(spark):
    row = feeds.fetch(spark.createDataFrame([("http://127.0.0.1:9/none",)], "url string"), timeout=2).first()
    assert row.success is False and row.error_message
    assert feeds.page_text("中".encode("big5"), "text/html; charset=Big5") == ("中", "big5")
    assert feeds.page_text(b"\xff\xe9", "text/html") in ((b"\xff\xe9".decode("gb18030", "replace"), "gb18030"), ("ÿé", "latin-1"))


def test_registry(spark, tmp_path):
    columns = "success boolean, source_id string, source_type string, origin_url string, title string, fetch_time string, encoding string, license string, raw_content string, extracted_text string"
    rows = [(True, "web_1", "web", "u1", "a/b\tc d", "t", "utf-8", "CC", "raw", "文字"), (True, "web_2", "web", "u1", "x", "t", "utf-8", "CC", "raw", ""), (True, "web_3", "web", "u2", None, "t", "utf-8", "CC", "raw", ""), (False, "web_4", "web", "u3", "", "t", "utf-8", "CC", "", "")]
    results = spark.createDataFrame(rows, columns)
    empty = spark.createDataFrame([], ", ".join(f"{c} string" for c in registry.HEADER))
    new = registry.new_entries(results, empty)
    got = {r.ORIGIN_URL: r for r in new.collect()}
    assert set(got) == {"u1", "u2"} and (got["u1"].SOURCE_ID, got["u1"].RAW_FILE, got["u1"].CHAR_LEN, got["u1"].TITLE, got["u2"].content, got["u2"].RAW_FILE) == ("web_1", "web_1_ab\tc_d.txt", "2", "a/b c d", "raw", "web_3_corpus.txt")
    tsv.write_tsv(registry.merged(empty, new), f"{tmp_path}/r")
    known = registry.read_registry(spark, f"{tmp_path}/r")
    assert known.count() == 2 and registry.new_entries(results, known).count() == 0 and registry.new_entries(results, known, overwrite=True).count() == 2
    assert registry.merged(known, registry.new_entries(results, known, overwrite=True)).count() == 2


def test_exports(spark):
    turns = spark.createDataFrame([(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 2, "system", None)], "conv_id long, turn long, role string, text string")
    assert json.loads(tsv.to_sharegpt(turns).first().value) == {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}, {"from": "system", "value": ""}]}
    assert json.loads(tsv.to_dpo(turns.limit(1), F.lit("p"), F.lit("c"), F.lit("r")).first().value) == {"prompt": "p", "chosen": "c", "rejected": "r"}


def test_stream(spark, folder, tmp_path):
    stream = clean_stream.sentence_stream(clean_stream.file_stream(spark, folder), CleanOptions(min_sentence_len=2))
    query = stream.writeStream.format("memory").queryName("sentences").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {"第一句。", "最後。"} <= {r.sentence for r in spark.table("sentences").collect()}


def test_command_line(spark, tmp_path, monkeypatch):
    from glyphmill import cli

    (tmp_path / "x.txt").write_text("這是第一個夠長的句子。這是第二個夠長的句子。這是第三個夠長的句子。")
    cli.main(["clean", f"{tmp_path}/x.txt", "-o", f"{tmp_path}/clean", "--min-len", "4"])
    cli.main(["split", f"{tmp_path}/clean", "-o", f"{tmp_path}/splits", "--train-ratio", "0.67", "--val-ratio", "0"])
    sizes = {p.name: files.read_clean_tsv(spark, str(p)).count() for p in (tmp_path / "splits").iterdir()}
    assert sizes == {"corpus_calibration.tsv": 2, "corpus_validation.tsv": 0, "corpus_benchmark_gold.tsv": 1}


def test_command_line_split_is_the_seeded_one(spark, tmp_path):
    from glyphmill import cli

    header = "\t".join(tsv.ITEM_HEADER)
    lines = [f"c{k}\tg\tL1\t5\t0.0000\ttext{k}\tYES\t" for k in range(1, 9)]
    (tmp_path / "t.tsv").write_text("\n".join([header, *lines]) + "\n")
    cli.main(["split", f"{tmp_path}/t.tsv", "-o", f"{tmp_path}/s"])
    ids = {p.name: [x.split("\t")[0] for x in p.read_text().splitlines()[1:]] for p in (tmp_path / "s").glob("*.tsv")}
    assert ids == {"corpus_calibration.tsv": ["c4", "c5", "c7", "c8", "c3", "c6"], "corpus_validation.tsv": [], "corpus_benchmark_gold.tsv": ["c1", "c2"]}
    (tmp_path / "lexicon.tsv").write_text("text\tx\n\n")
    cli.main(["profile", f"{tmp_path}/t.tsv", "--lexicon", f"{tmp_path}/lexicon.tsv"])
    cli.main(["export", f"{tmp_path}/t.tsv", "-o", f"{tmp_path}/lines", "--instruction", "say"])
    assert sorted(json.loads(r.value)["input"] for r in spark.read.text(f"{tmp_path}/lines").collect()) == [f"text{k}" for k in range(1, 9)]
