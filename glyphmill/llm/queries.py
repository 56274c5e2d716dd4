"""The queries of this subpackage for the entry module: production parameters over whole tables."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import read_table
from .shared import bounded_batches


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return read_table(spark, sf_dir, name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), vocabulary(), limit=2048)


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe_codec import round_trip

    return round_trip(table(spark, sf_dir, "documents"), vocabulary())


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary())


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import find_copies

    return find_copies(table(spark, sf_dir, "documents"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import media

    return media.features(media.with_metadata(media.store(table(spark, sf_dir, "documents"))))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import chat

    probe = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    messages = chat.written(chat.from_turns(turns), "chat-messages")
    return chat.read_back(chat.format_trees(messages))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shingle_join import link_components

    return link_components(table(spark, sf_dir, "documents"), width=3, percent=90)


def op6_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .surrogates import replace_entities

    return replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"), count_col="n_entities")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity_report

    return toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_token_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import token_matrix

    return token_matrix.read_pieces(token_matrix.write_matrices(table(spark, sf_dir, "documents"), vocabulary()), vocabulary())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_bpe_codec": op2_bpe_codec,
    "op3_packing": op3_packing,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_surrogates": op6_surrogates,
    "op7_toxicity": op7_toxicity,
    "op8_media": op8_media,
    "op9_chat_format": op9_chat_format,
    "op10_token_matrix": op10_token_matrix,
}

ORACLE_SQL: dict[str, str] = {
    "op4_exact_dedup": """
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
        FROM (
            SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size
            FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
        )
    """,
    # code points in a turn: both control strings, the newline after the role, and one more for each escaped run
    "op9_chat_format": r"""
        WITH turns AS (
            SELECT conv_id, turn, role, text, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
            UNION ALL
            SELECT -1, n, who, '</s>[INST] ok [/INST]', who, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(n, who)
        )
        SELECT
            conv_id, count(*) AS n_turns,
            sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)) AS turns_sha256,
            CAST(coalesce(sum(length(t)) FILTER (WHERE r = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256,
            CAST(sum(
                length('<|role|>') + length(r) + len(regexp_extract_all(r, '<\\*\|')) + (length(r) - length(replace(r, chr(10), ''))) * (length('<|newline|>') - 1)
                + 1 + length(t) + len(regexp_extract_all(t, '<\\*\|')) + length('<|end|>') + 1
            ) AS BIGINT) AS formatted_chars
        FROM turns GROUP BY conv_id
    """,
}
