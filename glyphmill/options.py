"""Options of the cleaning plan and the schemas of its tables."""

from dataclasses import dataclass

ITEM_SCHEMA = (
    "corpus_id string, raw_text string, clean_text string, category string, difficulty string, char_len int, token_count int, "
    "oov_rate double, feasible boolean, metadata map<string,string>, "
    "tokens array<struct<text:string,is_chinese:boolean,bopomofo:string,is_oov:boolean,extra:map<string,string>>>, note string"
)
PAIR_SCHEMA = "pair_id string, source_file string, en_text string, zh_text string, it_text string, citation_en string, citation_zh string"
FETCH_SCHEMA = (
    "success boolean, source_id string, source_type string, origin_url string, title string, fetch_time string, encoding string, "
    "char_len int, license string, raw_content string, extracted_text string, error_message string"
)


@dataclass(frozen=True)
class CleanOptions:
    """What the cleaning plan does; every flag works, and the defaults give the standard plan."""

    remove_html_tags: bool = True
    remove_urls: bool = True
    remove_emails: bool = True
    remove_social_tags: bool = True
    compress_repeated_punctuation: bool = True
    max_repeated_chars: int = 3
    remove_invisible_chars: bool = True
    do_nfkc: bool = True
    keep_ascii_halfwidth: bool = True
    normalize_quotes: bool = True
    normalize_punctuation: bool = True
    filter_news_boilerplates: bool = True
    protect_dialog_quotes: bool = True
    min_sentence_len: int = 6
    max_sentence_len: int = 120
    deduplicate: bool = True
    dedup_scope: str = "source"  # or "document"
    require_chinese: bool = False
    vetted_color_only: bool = False
    enable_lexicon_profiling: bool = True
