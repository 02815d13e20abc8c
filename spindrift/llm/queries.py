"""The registered queries of the corpus operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, chat, html_text, media, mixing, near_dedup, pii, quality, rules, toxicity
from .common import table


def op1_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op2_lexicon_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity.score_table(documents, toxicity.learn(documents, table(spark, sf_dir, "labels")))


def op3_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_prefix_target_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.read_back(chat.examples(chat.with_probe(table(spark, sf_dir, "conversations"))))


def op5_fourier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality.score_table(documents, quality.learn(documents, table(spark, sf_dir, "labels")))


def op6_line_block_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_table(table(spark, sf_dir, "pages"))


def op7_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op8_mcd_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"))


def op9_bitmap_queue_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_table(table(spark, sf_dir, "documents"))


def op10_tar_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_table(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_crf_pii, op2_lexicon_toxicity, op3_pivotal_mixing, op4_prefix_target_chat, op5_fourier_quality, op6_line_block_html, op7_lsh_forest, op8_mcd_rules, op9_bitmap_queue_bpe, op10_tar_media)}

ORACLES: dict[str, str] = {
    "op4_prefix_target_chat": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-7::BIGINT, 0::BIGINT, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
        ), control AS (
            SELECT *, regexp_replace(text, '([<\[])(\\*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|\|system\|>|\|user\|>|\|assistant\|>|\|eot_id\|>|\|start_header_id\|>|\|end_header_id\|>|s>|/s>|SYS>>|/SYS>>|INST\]|/INST\])', '\1\2\\\3', 'g') AS safe FROM t
        ), sized AS (
            SELECT *, length('<|im_start|>') + length(role) + 1 + length(safe) + length('<|im_end|>') + 1 AS chars,
                row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS n FROM control
            WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
        ), summed AS (
            SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS so_far FROM sized
        )
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(so_far) FILTER (role = 'assistant' OR place = n) AS BIGINT) AS formatted_chars
        FROM summed GROUP BY conv_id""",
    "op7_lsh_forest": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
            FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
                ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS shingle FROM w
        ), n AS (
            SELECT w.doc_id, count(s.shingle) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id
        ), both_have AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
        ), link AS (
            SELECT a, b FROM both_have JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
        ), reach AS (
            SELECT doc_id, doc_id AS other FROM n
            UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.other
        )
        SELECT n.doc_id, n.n AS n_shingles, min(other) AS component_id, n.doc_id = min(other) AS kept
        FROM n JOIN reach USING (doc_id) GROUP BY n.doc_id, n.n""",
}
