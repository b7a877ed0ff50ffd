"""Registered queries of the text operators, over whole tables, and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .chat_format import chat_digest
from .common import table
from .decontamination import decontaminate
from .jaccard_join import jaccard_components
from .oracles import SQL, TOKENIZERS
from .piece_encoding import encode_pieces
from .prefix_trie import conversation_trie
from .quality_rules import quality
from .secrets_scan import scan
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .token_counts import token_counts
from .token_files import token_ids
from .toxicity import score, train
from .whitening import whiten


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), digest=True)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark, table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the two turns of conversation -7, whose texts are control-like."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql("SELECT -7L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    return chat_digest(turns.unionByName(extra))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(spark, docs, table(spark, sf_dir, "labels")))


def op5_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(spark, table(spark, sf_dir, "documents"), f"{TOKENIZERS}/piece_bpe_32k.model")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"), digest=True)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("live", "pk", "th")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(spark, table(spark, sf_dir, "documents"), f"{TOKENIZERS}/word_bpe_49k.json")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    own = [op1_substring_dedup, op2_token_counts, op3_chat_format, op4_toxicity, op5_piece_encoding, op6_suffix_dedup, op7_secret_scan, op8_jaccard_join, op9_decontamination, op10_quality_rules, op11_prefix_trie, op12_token_files, op13_whitening]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
