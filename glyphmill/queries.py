"""Queries of the corpus operators over the driver's tables, with equivalent SQL where SQL has it.

The tables' text is Latin, so operators on full-width marks see it through WIDE, which turns ASCII marks into
full-width ones in both engines alike.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import native, udfs
from .operators import align, profile, segment, split, terms
from .operators.clean import clean, clean_html, normalize
from .options import CleanOptions
from .plans import corpus
from .sinks import tsv
from .sources import feeds, files, registry
from .sources.tables import read_table as table

NARROW, WIDE = ".,!?;:", "。，！？；："
TEXT = "coalesce(text, '')"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang")


def wide(c: Column) -> Column:
    return F.translate(c, NARROW, WIDE)


def strip_contacts(spark, sf_dir):
    text, n = native.strip_contacts(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", F.md5(text).alias("text_md5"), n.cast("long").alias("n_removed"))


def strip_html_tags(spark, sf_dir):
    html = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", F.md5(native.strip_tags(html)).alias("text_md5"), native.tag_count(html).cast("long").alias("n_tags"))


def unescape_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", clean_html(F.col("html")).alias("text"))


def strip_markdown(spark, sf_dir):
    linked = F.concat(F.lit("![pic](a b) ["), F.substring("text", 1, 40), F.lit("](u) |---|:-:| "), "text")
    return documents(spark, sf_dir).select("doc_id", F.md5(native.strip_markdown(linked)).alias("text_md5"))


def strip_social(spark, sf_dir):
    tagged = F.concat(F.lit("#tag one @me.x two #end, "), "text", F.lit(" #"), "lang")
    return documents(spark, sf_dir).select("doc_id", native.strip_social(tagged).alias("text"))


def compress_punct(spark, sf_dir):
    text = wide(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", F.md5(native.compress_punctuation(text)).alias("text_md5"), native.count(text, native.RUNS).cast("long").alias("n_runs"))


def cap_repeats(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", native.cap_repeats(F.col("text"), 2).alias("text"))


def strip_invisible(spark, sf_dir):
    dirty = F.replace("text", F.lit(" "), F.lit(" ​﻿"))
    return documents(spark, sf_dir).select("doc_id", F.md5(native.strip_invisible(dirty)).alias("text_md5"), native.count(dirty, native.INVISIBLE).cast("long").alias("n_stripped"))


def fullwidth(spark, sf_dir):
    widened = F.translate("text", "abcdeABC012 ", "ａｂｃｄｅＡＢＣ０１２　")
    return documents(spark, sf_dir).select("doc_id", F.md5(native.halfwidth(widened)).alias("text_md5"))


def dialog_quotes(spark, sf_dir):
    quoted = F.concat(F.lit("“"), F.regexp_replace("text", "[\"'\n\r]", " "), F.lit("” rest"))
    return documents(spark, sf_dir).select("doc_id", quoted.alias("text")).select("doc_id", F.md5(native.dialog_quotes(F.col("text"))).alias("text_md5"))


def boilerplate_lines(spark, sf_dir):
    lines = documents(spark, sf_dir).select("doc_id", F.explode(F.split(F.concat("text", F.lit("\n----\n廣告\n請訂閱")), "\n")).alias("line"))
    return lines.select("doc_id", native.strip(F.col("line")).alias("line")).groupBy("doc_id").agg(F.count_if(native.is_boilerplate(F.col("line"))).alias("n_boilerplate"), F.count_if(~native.is_boilerplate(F.col("line"))).alias("n_kept"))


def wide_sentences(spark, sf_dir) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", wide(F.col("text")).alias("text"))
    return segment.explode_sentences(docs)


def segment_sentences(spark, sf_dir):
    return wide_sentences(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.sum(F.length("sentence")).alias("n_chars"), F.max(F.length("sentence")).alias("longest"))


def segment_quoted(spark, sf_dir):
    quoted = F.regexp_replace(wide(F.col("text")), "。([^。]{1,40})。", "。「$1。」")
    return segment.explode_sentences(documents(spark, sf_dir).select("doc_id", quoted.alias("text")))


def labelled(spark, sf_dir) -> DataFrame:
    return segment.label_sentences(wide_sentences(spark, sf_dir), CleanOptions(), stripped=True)


def drop_reasons(spark, sf_dir):
    return labelled(spark, sf_dir).groupBy(F.coalesce("reason", F.lit("passed")).alias("reason")).agg(F.count("*").alias("n"))


def require_chinese(spark, sf_dir):
    some = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("中文"), "text")).otherwise(F.col("text"))
    reason = segment.drop_reason(native.strip(some), CleanOptions(require_chinese=True))
    return documents(spark, sf_dir).select("doc_id", F.coalesce(reason, F.lit("passed")).alias("reason"))


def dedup_first(spark, sf_dir):
    kept = segment.keep_first(labelled(spark, sf_dir), CleanOptions(), "doc_id", ["doc_id", "sent_ord"])
    return segment.number_sentences(kept.withColumn("key", F.col("doc_id")), "key", "doc_id").select("corpus_id", F.md5("sentence").alias("sentence_md5"))


def dedup_in_document(spark, sf_dir):
    kept = segment.keep_first(labelled(spark, sf_dir), CleanOptions(dedup_scope="document"), "doc_id", ["doc_id", "sent_ord"])
    return kept.groupBy("doc_id").agg(F.count("*").alias("n_kept"), F.sum(F.length("sentence")).alias("n_chars"))


def registry_of(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages").where("page_id % 2 = 0").select(F.col("url").alias("ORIGIN_URL"))


def registry_new(spark, sf_dir):
    return registry.unregistered(table(spark, sf_dir, "pages").select("page_id", "url"), registry_of(spark, sf_dir), "url").select("page_id", "url")


def registry_known(spark, sf_dir):
    return registry.registered(table(spark, sf_dir, "pages").select("page_id", "url"), registry_of(spark, sf_dir), "url").select("page_id", "url")


def file_names(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", native.file_name(F.col("text")).alias("name"))


def lexicon(spark, sf_dir) -> profile.LexiconAdapter:
    words = table(spark, sf_dir, "benchmark").select(F.regexp_replace(F.lower("text"), "[^a-m]", "").alias("word"))
    return profile.LexiconAdapter(profile.known_chars(words), inside="a-z", rounded=udfs.even_round)


def profiled(spark, sf_dir) -> DataFrame:
    items = documents(spark, sf_dir).select("doc_id", F.col("text").alias("clean_text"))
    return profile.profile_items(items, lexicon(spark, sf_dir))


def lexicon_oov(spark, sf_dir):
    n = lambda c: F.col(c).cast("long").alias(c)
    return profiled(spark, sf_dir).select("doc_id", n("total_chars"), n("chinese_chars"), n("oov_count"), n("key_count"), F.substring("oov_chars", 1, 5).alias("oov_sample"), "difficulty", "feasible")


def lexicon_rates(spark, sf_dir):
    return profiled(spark, sf_dir).select("doc_id", "oov_rate", "expansion_ratio", "note")


def batch_summary(spark, sf_dir):
    one = profile.summarize(profiled(spark, sf_dir))
    return one.select("total_sentences", "feasible_count", "l1_easy", "l2_medium", "l3_hard")


def slm_profile(spark, sf_dir):
    items = documents(spark, sf_dir).select("doc_id", F.col("text").alias("clean_text"))
    out = profile.profile_items(items, profile.EntropyAdapter(udfs.even_round))
    return out.select("doc_id", "char_entropy", F.col("estimated_tokens").cast("long").alias("estimated_tokens"), "repetition_ratio", "difficulty", "feasible")


def slm_counts(spark, sf_dir):
    out = profile.profile_items(documents(spark, sf_dir).select("doc_id", F.col("text").alias("clean_text")), profile.EntropyAdapter(udfs.even_round))
    return out.select("doc_id", F.col("estimated_tokens").cast("long").alias("estimated_tokens"), F.round(F.col("repetition_ratio") * 1000).cast("long").alias("repetition_permille"))


def char_entropy(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.round(udfs.char_entropy(F.col("text")) * 1000).cast("long").alias("millibits"))


def hash_split(spark, sf_dir):
    return split.hash_split(documents(spark, sf_dir).select("doc_id"), "doc_id").select("doc_id", "pos", "split")


def seeded_split(spark, sf_dir):
    return split.seeded_split(documents(spark, sf_dir).select("doc_id"), ["doc_id"]).select("doc_id", "pos", "split")


def term_rewrite(spark, sf_dir):
    legacy = F.concat(F.lit("臣服 密宗 臣服 協瓦 (seva) 帕里普拉仙那 "), "text")
    text, counts = terms.rewrite_terms(legacy)
    return documents(spark, sf_dir).select("doc_id", F.md5(text).alias("text_md5"), F.coalesce(counts["臣服"], F.lit(0)).cast("long").alias("n_first"))


def legacy_terms(spark, sf_dir):
    said = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" 密教 宗教"))).otherwise(F.col("text"))
    return terms.find_legacy(documents(spark, sf_dir).select("doc_id", said.alias("text"))).select("doc_id", "term", "legacy", "canonical")


def diacritics(spark, sf_dir):
    typed = F.regexp_replace("text", "([aeioumnsrlcdt]) ", "$1' ")
    return documents(spark, sf_dir).select("doc_id", F.md5(native.accents(typed)).alias("text_md5"))


def discourse_layout(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", native.discourse_layout(F.replace("text", F.lit("\n"), F.lit(" $ \n"))).alias("text"))


def green_runs(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", native.is_vetted_color(F.upper(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 6))).alias("is_vetted"))


def extract_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", feeds.extract_html(F.col("html")).alias("x")).select("page_id", "x.title", "x.body")


def feed_items(spark, sf_dir):
    """Each page's URL as an RSS feed of its own, in which the page is the only item."""
    entity = F.replace(F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    xml = F.concat(F.lit("<rss><channel><item><title> page "), "page_id", F.lit("</title><link>"), entity, F.lit("</link><description>about "), entity, F.lit("</description></item></channel></rss>"))
    made = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("feed_url"), xml.alias("xml"))
    return feeds.read_feeds(made).select("page_id", F.col("item").cast("long").alias("item"), "title", "link", "content", "type")


def scan_files(spark, sf_dir):
    """Each document as a file of its own, as text, JSON lines, JSON and TSV by turns."""
    k, flat = F.col("doc_id") % 4, F.regexp_replace("text", "[\"\t\r\n]", " ")
    suffix = F.element_at(F.array(*map(F.lit, ("txt", "jsonl", "json", "tsv"))), (k + 1).cast("int"))
    content = F.when(k == 0, F.col("text")).when(k == 1, F.to_json(F.struct(F.col("text").alias("content")))).when(k == 2, F.to_json(F.array(F.struct("text")))).otherwise(F.concat(F.lit("id\ttext\n"), F.col("doc_id").cast("string"), F.lit("\t"), flat))
    made = documents(spark, sf_dir).select(F.concat(F.lit("file:/in/d"), F.col("doc_id").cast("string"), F.lit("."), suffix).alias("path"), F.encode(content, "UTF-8").alias("content"))
    return files.parse_files(made).select("doc_id", F.md5("text").alias("text_md5"), F.col("meta.format").alias("format"), F.col("meta.encoding").alias("encoding"))


def align_cards(spark, sf_dir):
    block = F.concat(F.regexp_replace("text", r"[^A-Za-z ]|\n", " "), F.repeat(F.lit("a"), F.greatest(F.lit(0), 200 - F.length("text"))))
    card = F.concat(block, F.lit("\n\nDiscourse "), F.col("doc_id").cast("string"), F.lit("\n\n一二三四五六七八九十百千,好\n\n大法會 卷1"))
    cards = documents(spark, sf_dir).select(F.format_string("d%d.txt", "doc_id").alias("file_name"), card.alias("text"))
    return align.align_cards(cards)


def tsv_columns(spark, sf_dir):
    items = documents(spark, sf_dir).select(F.format_string("d_%04d", "doc_id").alias("corpus_id"), F.lit("general").alias("category"), F.lit("L1").alias("difficulty"), F.length("text").alias("char_len"), (F.length("text") / 65536).alias("oov_rate"), F.col("text").alias("clean_text"), (F.col("doc_id") % 2 == 0).alias("feasible"), F.lit("a\tb").alias("note"))
    return tsv.item_columns(items)


def pair_columns(spark, sf_dir):
    pairs = documents(spark, sf_dir).select(F.concat(F.lit("pair_"), F.col("doc_id").cast("string")).alias("pair_id"), F.lit("f.txt").alias("source_file"), F.col("text").alias("en_text"), F.lit("中\t文").alias("zh_text"), F.lit("").alias("it_text"), F.lit("c").alias("citation_en"), F.lit(None).cast("string").alias("citation_zh"))
    return tsv.pair_columns(pairs)


def alpaca_export(spark, sf_dir):
    safe = F.regexp_replace(F.coalesce("text", F.lit("")), r'[\x00-\x1f"\\/]', " ")
    return tsv.to_alpaca(table(spark, sf_dir, "benchmark"), F.lit("continue"), safe, F.lit("ok"))


def sharegpt_export(spark, sf_dir):
    safe = F.regexp_replace(F.coalesce("text", F.lit("")), r'[\x00-\x1f"\\/]', " ")
    return tsv.to_sharegpt(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", safe.alias("text")))


def type_token_ratio(spark, sf_dir):
    n, types = profile.word_counts(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", n.cast("long").alias("n_words"), types.cast("long").alias("n_types"), profile.type_token_ratio(F.col("text")).alias("ratio"))


def normalize_full(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", F.concat(F.lit("中文,"), "text", F.lit(" (中) ＡＢ")).alias("text"))
    return normalize(docs)


def cleaned_full(spark, sf_dir):
    return clean(documents(spark, sf_dir).select("doc_id", wide(F.col("text")).alias("text")))


def wide_documents(spark, sf_dir) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", wide(F.col("text")).alias("text"))


def pipeline_full(spark, sf_dir):
    made, _, _ = corpus.run(wide_documents(spark, sf_dir), doc_key=F.col("doc_id"), order=["doc_id"], adapter=profile.LexiconAdapter("", inside="a-z"))
    return made.select("corpus_id", "clean_text", "category", "difficulty", "char_len", "oov_rate", "feasible", "note")


def run_stats(spark, sf_dir):
    return corpus.stats_alone(wide_documents(spark, sf_dir), doc_key=F.col("doc_id"), order=["doc_id"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        strip_contacts, strip_html_tags, unescape_html, strip_markdown, strip_social, compress_punct, cap_repeats, strip_invisible, fullwidth, dialog_quotes,
        boilerplate_lines, segment_sentences, segment_quoted, drop_reasons, require_chinese, dedup_first, dedup_in_document, registry_new, registry_known, file_names,
        lexicon_oov, lexicon_rates, batch_summary, slm_profile, slm_counts, char_entropy, hash_split, seeded_split, term_rewrite, legacy_terms, diacritics, discourse_layout,
        green_runs, extract_pages, feed_items, scan_files, align_cards, tsv_columns, pair_columns, alpaca_export, sharegpt_export, type_token_ratio, normalize_full, cleaned_full, pipeline_full, run_stats,
    )
}

_WIDE = f"translate({TEXT}, '{NARROW}', '{WIDE}')"
_SPACES = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_STRIP = lambda x: rf"regexp_replace({x}, '^{_SPACES}+|{_SPACES}+$', '', 'g')"
_CONTACTS = [
    r"(?i)https?://[^\s]+|www\.[a-zA-Z0-9-]+\.[a-zA-Z0-9.~-]+|ftp://[^\s]+",
    r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9.-]+",
    r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b",
]
_SENTENCES = f"""
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS ord, s FROM (
        SELECT doc_id, k, {_STRIP('part')} AS s FROM (
            SELECT doc_id, unnest(parts) AS part, unnest(range(len(parts))) AS k FROM (
                SELECT doc_id, regexp_extract_all({_WIDE}, '[^。！？；\n]*[。！？；\n]+|[^。！？；\n]+$') AS parts FROM documents)))
    WHERE s <> ''
"""
_REASON = "CASE WHEN length(s) < 6 THEN 'short' WHEN length(s) > 120 THEN 'long' ELSE 'passed' END"
_LEXICON = "(SELECT string_agg(c, '') FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-m]')) AS c FROM benchmark))"
_PROFILE = f"""
    SELECT doc_id, length(t) AS total_chars, length(han) AS chinese_chars, length(oov_chars) AS oov_count, oov_chars, CASE WHEN han <> '' THEN length(oov_chars) / length(han) ELSE 0.0 END AS rate
    FROM (SELECT *, translate(han, {_LEXICON}, '') AS oov_chars
          FROM (SELECT doc_id, t, regexp_replace(t, '[^a-z]', '', 'g') AS han FROM (SELECT doc_id, {TEXT} AS t FROM documents)))
"""
_KEYS = "trunc(chinese_chars * 2.2::DOUBLE + (total_chars - chinese_chars))"
_LEVEL = "CASE WHEN round(rate, 4) = 0 AND total_chars <= 45 THEN 'L1' WHEN round(rate, 4) <= 0.15 AND total_chars <= 85 THEN 'L2' ELSE 'L3' END"
_MD5_SPLIT = "row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1"


def _replaced(x: str, pairs) -> str:
    for a, b in pairs:
        x = f"regexp_replace({x}, '{a}', '{b}', 'g')"
    return x


def _contacts_sql() -> str:
    inner, counts = TEXT, []
    for p in _CONTACTS:
        counts.append(f"len(regexp_extract_all({inner}, '{p}'))")
        inner = f"regexp_replace({inner}, '{p}', '', 'g')"
    return f"SELECT doc_id, md5({inner}) AS text_md5, {' + '.join(counts)} AS n_removed FROM documents"


_SCRIPTS = r"regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g')"
_RUNS = "！！+|？？+|。。+|，，+|、、+|；；+|：：+|～～+"
_COMPRESSED = _replaced(_WIDE, [(m + m + "+", m) for m in "！？。，、；：～"])
_TYPED = f"regexp_replace({TEXT}, '([aeioumnsrlcdt]) ', '\\1'' ', 'g')"
for _plain, _accented in zip("aeioumnsrlcAEIOUMNSRLC", "áéíóúḿńśŕĺćÁÉÍÓÚḾŃŚŔĹĆ"):
    _TYPED = f"replace({_TYPED}, '{_plain}''', '{_accented}')"
for _plain in "dtDT":
    _TYPED = f"replace({_TYPED}, '{_plain}''', '{_plain}' || chr(769))"
_TERMS = f"'臣服 密宗 臣服 協瓦 (seva) 帕里普拉仙那 ' || {TEXT}"
_LINE = _STRIP("line")
_LAID = r"regexp_replace(regexp_replace(replace(" + TEXT + r", '\n', ' $ \n'), ' +\$', '', 'g'), '(?m)[ \t]+$', '', 'g')"
for _plain, _accented in zip("aeioumnsrlcAEIOUMNSRLC", "áéíóúḿńśŕĺćÁÉÍÓÚḾŃŚŔĹĆ"):
    _LAID = f"replace({_LAID}, '{_plain}''', '{_accented}')"
for _plain in "dtDT":
    _LAID = f"replace({_LAID}, '{_plain}''', '{_plain}' || chr(769))"
_SOCIAL = rf"regexp_replace(regexp_replace('#tag one @me.x two #end, ' || {TEXT} || ' #' || lang, '#[\p{{L}}\p{{N}}_]+(?:{_SPACES}|$)', '', 'g'), '@[\p{{L}}\p{{N}}_.-]+(?:{_SPACES}|$)', '', 'g')"
_QUOTED = f"regexp_replace({_WIDE}, '。([^。]{{1,40}})。', '。「\\1。」', 'g')"
_UNIT = "(?:「[^」]*」|[^。！？；\n「])"
_ENTROPY = f"""
    SELECT d.doc_id, length(t) AS n, coalesce(h, 0.0) AS h, coalesce(k, 0) AS k FROM (SELECT doc_id, {TEXT} AS t FROM documents) d LEFT JOIN (
        SELECT doc_id, count(*) AS k, round_even(greatest(0.0, -sum(n / total * log2(n / total))), 3) AS h FROM (
            SELECT doc_id, c, n, sum(n) OVER (PARTITION BY doc_id) AS total FROM (
                SELECT doc_id, c, count(*)::DOUBLE AS n FROM (SELECT doc_id, unnest(regexp_extract_all({TEXT}, '(?s).')) AS c FROM documents) GROUP BY doc_id, c))
        GROUP BY doc_id) e USING (doc_id)
"""
_TOKENS = "greatest(1, trunc(n * 0.85::DOUBLE))::BIGINT"

ORACLE_SQL: dict[str, str] = {
    "strip_contacts": _contacts_sql(),
    "strip_html_tags": f"SELECT page_id, md5(regexp_replace({_SCRIPTS}, '<[^>]+>', ' ', 'g')) AS text_md5, len(regexp_extract_all({_SCRIPTS}, '<[^>]+>')) AS n_tags FROM pages",
    "strip_markdown": "SELECT doc_id, md5(" + _replaced(f"'![pic](a b) [' || substr({TEXT}, 1, 40) || '](u) |---|:-:| ' || {TEXT}", [(r"!*\[([^\]]*)\]\([^)]+\)", r"\1"), (r"\|(?:\s*:?-+:?\s*\|)+", "")]) + ") AS text_md5 FROM documents",
    "strip_social": f"SELECT doc_id, {_SOCIAL} AS text FROM documents",
    "compress_punct": f"SELECT doc_id, md5({_COMPRESSED}) AS text_md5, len(regexp_extract_all({_WIDE}, '{_RUNS}')) AS n_runs FROM documents",
    "strip_invisible": rf"SELECT doc_id, md5(regexp_replace(d, '[\x{{200b}}-\x{{200f}}\x{{feff}}\x{{ad}}\x{{2060}}\x{{202a}}-\x{{202e}}\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g')) AS text_md5, len(regexp_extract_all(d, '[\x{{200b}}-\x{{200f}}\x{{feff}}\x{{ad}}\x{{2060}}\x{{202a}}-\x{{202e}}\x00-\x08\x0b\x0c\x0e-\x1f\x7f]')) AS n_stripped FROM (SELECT doc_id, replace({TEXT}, ' ', ' ' || chr(8203) || chr(65279)) AS d FROM documents)",
    "fullwidth": f"SELECT doc_id, md5({TEXT}) AS text_md5 FROM documents",
    "dialog_quotes": f"""SELECT doc_id, md5(CASE WHEN d = '' THEN '“” rest' ELSE regexp_replace('「' || d || '」 rest', '[‘’]', '', 'g') END) AS text_md5 FROM (SELECT doc_id, regexp_replace({TEXT}, '["''\n\r]', ' ', 'g') AS d FROM documents)""",
    "boilerplate_lines": f"""
        SELECT doc_id, count(*) FILTER (b) AS n_boilerplate, count(*) FILTER (NOT b) AS n_kept FROM (
            SELECT doc_id, s = '' OR regexp_matches(s, '^[-=_*]{{3,}}$|^廣告$|請訂閱') AS b FROM (
                SELECT doc_id, {_LINE} AS s FROM (SELECT doc_id, unnest(string_split({TEXT} || '\n----\n廣告\n請訂閱', '\n')) AS line FROM documents)))
        GROUP BY doc_id
    """,
    "segment_sentences": f"SELECT doc_id, count(*) AS n_sentences, sum(length(s))::BIGINT AS n_chars, max(length(s)) AS longest FROM ({_SENTENCES}) GROUP BY doc_id",
    "segment_quoted": f"SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INT AS sent_ord, s AS sentence FROM (SELECT doc_id, k, {_STRIP('part')} AS s FROM (SELECT doc_id, unnest(parts) AS part, unnest(range(len(parts))) AS k FROM (SELECT doc_id, regexp_extract_all({_QUOTED}, '{_UNIT}*[。！？；\n][。！？；\n」』”》】）]*|{_UNIT}+$') AS parts FROM documents))) WHERE s <> ''",
    "discourse_layout": f"SELECT doc_id, {_STRIP(_LAID)} AS text FROM documents",
    "drop_reasons": f"SELECT {_REASON} AS reason, count(*) AS n FROM ({_SENTENCES}) GROUP BY 1",
    "require_chinese": f"""
        SELECT doc_id, CASE WHEN length(s) < 6 THEN 'short' WHEN length(s) > 120 THEN 'long' WHEN NOT regexp_matches(s, '[一-鿿]') THEN 'non_chinese' ELSE 'passed' END AS reason FROM (
            SELECT doc_id, {_STRIP(f"(CASE WHEN doc_id % 7 = 0 THEN '中文' || {TEXT} ELSE {TEXT} END)")} AS s FROM documents)
    """,
    "dedup_first": f"""
        SELECT printf('%d_%04d', doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord)) AS corpus_id, md5(s) AS sentence_md5 FROM (
            SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id, ord) AS rn FROM ({_SENTENCES}) WHERE {_REASON} = 'passed')
        WHERE rn = 1
    """,
    "dedup_in_document": f"SELECT doc_id, count(*) AS n_kept, sum(length(s))::BIGINT AS n_chars FROM (SELECT DISTINCT doc_id, s FROM ({_SENTENCES}) WHERE {_REASON} = 'passed') GROUP BY doc_id",
    "registry_new": "SELECT page_id, url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 2 = 0)",
    "registry_known": "SELECT page_id, url FROM pages WHERE url IN (SELECT url FROM pages WHERE page_id % 2 = 0)",
    "file_names": rf"""SELECT doc_id, CASE WHEN n = '' THEN 'untitled' ELSE substr(n, 1, 40) END AS name FROM (SELECT doc_id, replace({_STRIP(f"regexp_replace({TEXT}, '[\\/*?:" + '"' + "<>|]', '', 'g')")}, ' ', '_') AS n FROM documents)""",
    "lexicon_oov": f"SELECT doc_id, total_chars, chinese_chars, oov_count, trunc(chinese_chars * 2.2::DOUBLE + (total_chars - chinese_chars))::BIGINT AS key_count, substr(oov_chars, 1, 5) AS oov_sample, {_LEVEL} AS difficulty, total_chars > 0 AS feasible FROM ({_PROFILE})",
    "lexicon_rates": f"SELECT doc_id, round_even(rate, 4) AS oov_rate, round_even({_KEYS} / greatest(1, total_chars), 2) AS expansion_ratio, CASE WHEN round_even(rate, 4) > 0 THEN '含未登錄字(' || substr(oov_chars, 1, 5) || ')' ELSE '詞庫全覆蓋' END AS note FROM ({_PROFILE})",
    "batch_summary": f"SELECT count(*) AS total_sentences, count(*) FILTER (total_chars > 0) AS feasible_count, count(*) FILTER ({_LEVEL} = 'L1') AS l1_easy, count(*) FILTER ({_LEVEL} = 'L2') AS l2_medium, count(*) FILTER ({_LEVEL} = 'L3') AS l3_hard FROM ({_PROFILE})",
    "slm_counts": f"SELECT doc_id, {_TOKENS} AS estimated_tokens, round(round_even(1 - k / greatest(1, n), 3) * 1000)::BIGINT AS repetition_permille FROM ({_ENTROPY})",
    "slm_profile": f"SELECT doc_id, h AS char_entropy, {_TOKENS} AS estimated_tokens, round_even(1 - k / greatest(1, n), 3) AS repetition_ratio, CASE WHEN h < 3.5 AND n < 40 THEN 'L1' WHEN h < 4.8 AND n < 80 THEN 'L2' ELSE 'L3' END AS difficulty, n > 0 AND h > 1.5 AS feasible FROM ({_ENTROPY})",
    "char_entropy": f"SELECT doc_id, round(h * 1000)::BIGINT AS millibits FROM ({_ENTROPY})",
    "hash_split": f"SELECT doc_id, pos, CASE WHEN pos < trunc(n * 0.8::DOUBLE) THEN 'calibration' WHEN pos < trunc(n * 0.8::DOUBLE) + trunc(n * 0.1::DOUBLE) THEN 'validation' ELSE 'benchmark' END AS split FROM (SELECT doc_id, {_MD5_SPLIT} AS pos, count(*) OVER () AS n FROM documents)",
    "term_rewrite": "SELECT doc_id, md5(" + _replaced(_TERMS, [(p, n) for p, n in terms.RULES]) + ") AS text_md5, 2::BIGINT AS n_first FROM documents",
    "legacy_terms": "SELECT doc_id, unnest(['Tantra', 'Dharma']) AS term, unnest(['密教', '宗教']) AS legacy, unnest(['搪碴', '法性']) AS canonical FROM documents WHERE doc_id % 3 = 0",
    "diacritics": f"SELECT doc_id, md5({_TYPED}) AS text_md5 FROM documents",
    "green_runs": "SELECT doc_id, g > r * 1.1::DOUBLE AND g > b * 1.1::DOUBLE AND g > 75 AS is_vetted FROM (SELECT doc_id, ('0x' || h[1:2])::INT AS r, ('0x' || h[3:4])::INT AS g, ('0x' || h[5:6])::INT AS b FROM (SELECT doc_id, upper(md5(doc_id::VARCHAR)) AS h FROM documents))",
    "feed_items": "SELECT page_id, 0::BIGINT AS item, 'page ' || page_id AS title, url AS link, 'about ' || url AS content, 'rss2.0' AS type FROM pages",
    "scan_files": rf"""
        SELECT 'd' || doc_id || CASE doc_id % 4 WHEN 0 THEN '' WHEN 3 THEN '_2' ELSE '_1' END AS doc_id, md5(CASE WHEN doc_id % 4 = 3 THEN regexp_replace({TEXT}, '["\x09\x0a\x0d]', ' ', 'g') ELSE {TEXT} END) AS text_md5,
            CASE doc_id % 4 WHEN 0 THEN '.txt' WHEN 1 THEN '.jsonl' WHEN 2 THEN '.json' ELSE '.tsv' END AS format, 'utf-8' AS encoding
        FROM documents
    """,
    "tsv_columns": rf"SELECT printf('d_%04d', doc_id) AS CORPUS_ID, 'general' AS CATEGORY, 'L1' AS DIFFICULTY, length({TEXT})::VARCHAR AS CHAR_LEN, printf('%.4f', round(length({TEXT}) / 65536, 4)) AS OOV_RATE, translate({TEXT}, chr(9) || chr(10) || chr(13), '  ') AS CLEAN_TEXT, CASE WHEN doc_id % 2 = 0 THEN 'YES' ELSE 'NO' END AS FEASIBLE_RUHI, 'a b' AS NOTE FROM documents",
    "pair_columns": f"SELECT 'pair_' || doc_id AS PAIR_ID, 'f.txt' AS SOURCE_FILE, translate({TEXT}, chr(9), ' ') AS EN_TEXT, '中 文' AS ZH_TEXT, '' AS IT_TEXT, 'c' AS CITATION_EN, '' AS CITATION_ZH, length({TEXT})::VARCHAR AS EN_CHAR_LEN, '3' AS ZH_CHAR_LEN FROM documents",
    "alpaca_export": r"""SELECT '{"instruction":"continue","input":"' || regexp_replace(coalesce(text, ''), '[\x00-\x1f"\\/]', ' ', 'g') || '","output":"ok"}' AS value FROM benchmark""",
    "sharegpt_export": r"""
        SELECT conv_id, '{"conversations":[' || string_agg('{"from":"' || CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE role END || '","value":"' || regexp_replace(coalesce(text, ''), '[\x00-\x1f"\\/]', ' ', 'g') || '"}', ',' ORDER BY turn) || ']}' AS value
        FROM conversations GROUP BY conv_id
    """,
    "type_token_ratio": f"SELECT doc_id, len(w) AS n_words, len(list_distinct(w)) AS n_types, CASE WHEN len(w) > 0 THEN len(list_distinct(w)) / len(w) ELSE 0.0 END AS ratio FROM (SELECT doc_id, regexp_extract_all(lower({TEXT}), '[\\p{{L}}\\p{{N}}_]+') AS w FROM documents)",
}
