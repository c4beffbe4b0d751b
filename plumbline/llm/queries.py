"""One query for each operator, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, exact, lm, packing, quality, rules, simhash, suffix, toxicity
from .common import documents

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where a public tokenizer's file lies on this machine; every worker has it at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(documents(spark, sf_dir), tokenizer_path())


def op2_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(documents(spark, sf_dir))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_path())


def op4_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeated_passages(documents(spark, sf_dir))


def op5_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.decide(documents(spark, sf_dir)).drop("uid")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    planted = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.examples(conversations.unionByName(planted)))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe, op2_rules, op3_packing, op4_suffix, op5_exact, op6_simhash, op7_chat, op8_toxicity, op9_quality, op10_lm)}


EXACT_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS body FROM documents)"""

CHAT_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (
  SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS n,
         length('### : </turn>' || chr(10)) + length(replace(replace(replace(replace(role, '\', '\\'), '#', '\#'), '</turn>', '<\/turn>'), ':', '\:'))
         + length(replace(replace(replace(text, '\', '\\'), '#', '\#'), '</turn>', '<\/turn>')) AS size
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
summed AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY place) AS so_far FROM sized)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (sum(so_far) FILTER (role = 'assistant' OR place = n))::BIGINT AS formatted_chars
FROM summed GROUP BY conv_id"""


def oracle_sql() -> dict[str, str]:
    """Tokenizing, XXH64, packing and trained models are beyond SQL; their tests have brute-force versions."""
    return {"op2_rules": rules.oracle(), "op4_suffix": suffix.oracle(), "op5_exact": EXACT_SQL, "op7_chat": CHAT_SQL}
