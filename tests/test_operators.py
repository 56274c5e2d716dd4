"""The corpus operators on literal fixtures."""

import random
import re
import unicodedata

from pyspark.sql import functions as F
import pytest

from glyphmill.functions import native, udfs
from glyphmill.operators import align, profile, segment, split, terms
from glyphmill.operators.clean import clean, drop_boilerplate, normalize
from glyphmill.options import CleanOptions


def apply(spark, values, f):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, t string")
    return [r.o for r in df.select("k", f(F.col("t")).alias("o")).orderBy("k").collect()]


CASES = [
    (native.strip_invisible, "中華​民國﻿在臺灣", "中華民國在臺灣"),
    (native.halfwidth, "ＡＩ智慧２０２６年啟動！　x", "AI智慧2026年啟動！ x"),
    (native.dialog_quotes, "他說：“子曰：‘溫故而知新’，此言得之。”", "他說：「子曰：『溫故而知新』，此言得之。」"),
    (native.dialog_quotes, "don't say it's", "don『t say it』s"),
    (native.dialog_quotes, "", ""),
    (native.context_punctuation, "我們今天開始,使用許氏鍵盤自然輸入法!非常流暢.", "我們今天開始，使用許氏鍵盤自然輸入法！非常流暢。"),
    (native.context_punctuation, "時間: 3 於3.14秒(中文)a...b--c 這 是\n測 試 1.中", "時間： 3 於3.14秒（中文）a……b——c 這是\n測試 1。中"),
    (native.strip_tags, "<p>a<script x>var <b></SCRIPT>b</p>", " ab "),
    (native.strip_markdown, "![x](y)[z](w) |---|:-:| t", "xz  t"),
    (lambda c: native.strip_contacts(c)[0], "看https://a.b/c中 d www.a-b.com/x e@f.gh 於192.168.1.1台 10.0.0.1 z", "看 d /x  於192.168.1.1台  z"),
    (native.strip_social, "#中文 a @me.x\nb #tag, c #end", "a b #tag, c "),
    (native.compress_punctuation, "好！！！嗎？？ok!!。。", "好！嗎？ok!!。"),
    (native.cap_repeats, "哈哈哈哈哈 100000 \n\n\n\n\n", "哈哈哈 1000 \n\n\n\n\n"),
    (udfs.html_unescape, "&lt;b&gt; &amp; &#20013;", "<b> & 中"),
    (udfs.nfkc, "①ﾊﾝ㍿ plain", unicodedata.normalize("NFKC", "①ﾊﾝ㍿ plain")),
    (native.strip, " 　\x1c a b  \n", "a b"),
    (native.accents, "Sa'dhana' d'x T'", "Sádhaná d́x T́"),
    (native.discourse_layout, " a' $ b  \nc\t\n $", "á b\nc"),
    (native.file_name, ' a/b*c "d" ', "abc_d"),
    (native.file_name, "", "untitled"),
    (lambda c: terms.rewrite_terms(c)[0], "臣服於密宗 帕拉尼帕塔 (Prani) 協瓦 (seva) 帕里樸拉仙那", "誠服於搪碴 (Tantra) Praṇipāta 協峇 (Sevá) Pariprashna"),
]


def test_literals(spark):
    for f, given, want in CASES:
        assert apply(spark, [given, None], f) == [want, None] or (f is native.file_name and apply(spark, [given], f) == [want]), (given, want)


def test_counts(spark):
    row = spark.createDataFrame([("<b>x</b> a@b.cd http://x.y 好！！呀？？",)], "text string").transform(clean).first()
    assert (row.html_tags, row.urls_and_emails, row.punct_compressed) == (2, 2, 2)
    assert apply(spark, ["a​b\x07"], lambda c: native.count(c, native.INVISIBLE)) == [2]
    assert apply(spark, ["臣服臣服"], lambda c: terms.rewrite_terms(c)[1]) == [{"臣服": 2}]


def test_whole_cleaning(spark):
    df = spark.createDataFrame([("真的太棒了！！！！！！哈哈哈哈哈哈哈哈",), ('<div class="main">點擊連結 <a href="https://example.com">官網</a> 或來信 service@domain.com 洽詢！</div>',)], "text string")
    out = [r.text for r in df.transform(clean).collect()]
    assert out[0] == "真的太棒了！哈哈哈"
    assert "官網" in out[1] and "<" not in out[1] and "@" not in out[1]


def test_boilerplate(spark):
    lines = ["記者陳小明／台北即時報導", "版權所有 翻印必究。未經授權禁止轉載", "點我看更多精彩專題", "今天天氣晴朗，適合外出踏青散步。", "  ", "advertisement", "advertisements", "----", "--", "請訂閱本台", "責任編輯 電"]
    assert apply(spark, lines, native.is_boilerplate) == [True, True, True, False, True, True, False, True, False, True, True]
    df = spark.createDataFrame([("a text\r\n\n廣告 ----\n b ",)], "text string").transform(drop_boilerplate)
    assert (df.first().text, df.first().boilerplate_lines) == ("a text\nb", 2)


def walk(text, protect):
    """A character-by-character restatement of the sentence rules."""
    closers, out, buf, stack, k = set(udfs.PAIRS.values()), [], "", [], 0
    while k < len(text):
        c = text[k]
        buf += c
        if protect and c in udfs.PAIRS:
            stack.append(c)
        elif protect and c in closers and stack and udfs.PAIRS[stack[-1]] == c:
            stack.pop()
        if c in udfs.TERMINATORS and not stack:
            while k + 1 < len(text) and (text[k + 1] in closers or text[k + 1] in udfs.TERMINATORS):
                k += 1
                buf += text[k]
            out.append(buf)
            buf = ""
        k += 1
    return [s.strip() for s in [*out, buf] if s.strip()]


def test_sentences(spark):
    text = "孔子曾經說道：「學而時習之，不亦說乎？有朋自遠方來，不亦樂乎！」這正是人機協同思考的最佳寫照。我們繼續向前。"
    assert len(udfs.split_sentences(text)) == 2 and apply(spark, [text, None, ""], udfs.sentences)[1:] == [[], []]
    r = random.Random(3)
    for _ in range(3000):
        t = "".join(r.choice("ab 。！？；\n「」『』“”《》（）") for _ in range(r.randint(0, 25)))
        for protect in (True, False):
            assert udfs.split_sentences(t, protect) == walk(t, protect), t


def test_filters_and_first(spark):
    rows = [(0, k, s) for k, s in enumerate(["短", "太短了", "這是一句標準長度的繁體中文測試語句。", "這是一句標準長度的繁體中文測試語句。"])] + [(1, 0, "這是一句標準長度的繁體中文測試語句。"), (1, 1, "latin only sentence"), (1, 2, "長" * 121)]
    df = spark.createDataFrame(rows, "doc_key int, sent_ord int, sentence string").repartition(3)
    options = CleanOptions(require_chinese=True)
    labelled = segment.label_sentences(df, options)
    assert sorted((r.reason or "") for r in labelled.collect()) == ["", "", "", "long", "non_chinese", "short", "short"]
    kept = segment.keep_first(labelled, options, "doc_key", ["doc_key", "sent_ord"]).collect()
    assert [(r.doc_key, r.sent_ord) for r in kept] == [(0, 2)]
    each = segment.keep_first(labelled, CleanOptions(require_chinese=True, dedup_scope="document"), "doc_key", ["doc_key", "sent_ord"])
    assert sorted((r.doc_key, r.sent_ord) for r in each.collect()) == [(0, 2), (1, 0)]
    named = segment.number_sentences(each.withColumn("doc_id", F.lit("d")), "doc_key", "doc_id")
    assert {r.corpus_id for r in named.collect()} == {"d_0001"}


def test_profiles(spark):
    lexicon = spark.createDataFrame([("中華",), ("民國",)], "word string")
    known = profile.known_chars(lexicon)
    items = spark.createDataFrame([(0, "中華民國a"), (1, "中台中台大"), (2, ""), (3, "天" * 90)], "k int, clean_text string")
    rows = {r.k: r for r in profile.profile_items(items, profile.LexiconAdapter(known)).collect()}
    assert (rows[0].oov_rate, rows[0].difficulty, rows[0].note, rows[0].key_count, rows[0].feasible) == (0.0, "L1", "詞庫全覆蓋", 9, True)
    assert (rows[1].oov_chars, rows[1].oov_rate, rows[1].note, rows[1].difficulty) == ("台台大", 0.6, "含未登錄字(台台大)", "L3")
    assert (rows[2].feasible, rows[2].oov_rate) == (False, 0.0) and rows[3].expansion_ratio == 2.2
    total = profile.summarize(profile.profile_items(items, profile.LexiconAdapter(known))).first()
    assert (total.total_sentences, total.avg_oov_rate, total.feasible_count, total.feasibility_percent, total.l1_easy, total.l3_hard) == (4, 0.4, 3, 75.0, 2, 2)
    assert profile.summarize(profile.profile_items(items.limit(0), profile.LexiconAdapter())).first().total_sentences == 0
    small = {r.k: r for r in profile.profile_items(items, profile.EntropyAdapter()).collect()}
    assert (small[0].char_entropy, small[0].estimated_tokens, small[0].repetition_ratio, small[0].feasible) == (2.322, 4, 0.0, True)
    assert (small[2].char_entropy, small[2].estimated_tokens, small[2].repetition_ratio, small[2].feasible) == (0.0, 1, 1.0, False)


def test_rounding(spark):
    values = [0.03125, 0.00625, 2.675, None, 1 / 3]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double")
    assert [r.o for r in df.select("k", udfs.py_round(F.col("v"), 4).alias("o")).orderBy("k").collect()] == [round(v, 4) if v is not None else None for v in values]


def test_splits(spark):
    items = spark.range(1, 9).select(F.col("id").alias("n"), F.format_string("c%02d", "id").alias("corpus_id")).repartition(3)
    got = split.seeded_split(items, ["n"]).orderBy("pos").collect()
    assert [r.n for r in got] == [4, 5, 7, 8, 3, 6, 1, 2]
    assert [r.split for r in got] == ["calibration"] * 6 + ["benchmark"] * 2
    hashed = split.hash_split(items, "corpus_id", 0.5, 0.25)
    assert sorted(r.pos for r in hashed.collect()) == list(range(8))
    assert {r.split: r["count"] for r in hashed.groupBy("split").count().collect()} == {"calibration": 4, "validation": 2, "benchmark": 2}
    assert [r.n for r in split.seeded_split(items, ["n"], shuffle=False).orderBy("pos").collect()] == list(range(1, 9))


CARD = """No attachment to worldly objects will be developed if we observe Yama and Niyama. Hence your mind becomes absorbed in Brahma.

Shrii Shrii Ánandamúrti
c. 1955 DMC
08 The Form of Sádhaná
Subháśita Saḿgraha Part 1

如果我們能遵循外在行為的控制和內在行為的控制，就會發展出對世俗事物沒有執著之心。心靈就會融入至上意識──靈性修持的最終目標。

Shrii Shrii Ánandamúrti
約1955年於某大法會
09 云何靈性修持
靈性科學集成 卷1，P.119

https://example.com/share/test
"""


def test_cards(spark):
    df = spark.createDataFrame([("card.v1.txt", CARD), ("one.txt", "only one block"), ("none.txt", None), ("en.txt", "a b c\n\nd e f")], "file_name string, text string")
    rows = align.align_cards(df).collect()
    assert len(rows) == 1
    r = rows[0]
    assert r.pair_id == "pair_card.v1" and r.en_text.startswith("No attachment") and r.zh_text.startswith("如果我們能遵循") and r.it_text == ""
    assert r.citation_en == "Shrii Shrii Ánandamúrti | c. 1955 DMC | 08 The Form of Sádhaná | Subháśita Saḿgraha Part 1" and "云何靈性修持" in r.citation_zh


def test_vetted_colors(spark):
    from glyphmill.sources.files import is_vetted

    colors = ["81D41A", "00A933", "auto", "FF0000", "", None, "zzzzzz", "004A00", "004C00", "81D41", "00a933"]
    want = [True, True, False, False, False, False, False, False, True, False, True]
    assert apply(spark, colors, native.is_vetted_color) == want == [is_vetted(c) for c in colors]
    found = terms.find_legacy(spark.createDataFrame([("密宗與臣服",), ("x",)], "text string"))
    assert sorted(r.term for r in found.collect()) == ["Surrender", "Tantra"] and terms.registry(spark).count() == 12


def python_context(text):
    han, s = "[一-鿿㐀-䶿]", r"\s*"
    for p, r in [(r"\.{3,}|…{2,}", "……"), ("-{2,}|—{2,}", "——"), (f"({han}){s}\\.{s}", r"\1。"), (f"{s}\\.{s}({han})", r"。\1"), (f"({han}){s},{s}", r"\1，"), (f"{s},{s}({han})", r"，\1"), (f"({han}){s}\\?{s}", r"\1？"), (f"({han}){s}!{s}", r"\1！"), (f"({han}){s};{s}", r"\1；"), (f"({han}){s}:{s}(?![0-9/])", r"\1："), (f"\\(({s}{han}[^)]*)\\)", r"（\1）"), (f"({han})\\s+({han})", r"\1\2")]:
        text = re.sub(p, r, text)
    return text


@pytest.mark.parametrize("seed", [1, 2])
def test_context_against_python(spark, seed):
    r = random.Random(seed)
    texts = ["".join(r.choice("中文ab1 .,?!;:()/-…—\n　\x1c") for _ in range(r.randint(0, 40))) for _ in range(400)]
    assert apply(spark, texts, native.context_punctuation) == [python_context(t) for t in texts]
    stripped = apply(spark, texts, native.strip)
    assert stripped == [t.strip() for t in texts]
    assert [x.t for x in spark.createDataFrame([(t,) for t in texts], "t string").transform(lambda d: normalize(d, text_col="t")).limit(0).collect()] == []
