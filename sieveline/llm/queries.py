"""The numbered queries of this subpackage, as __spark_entry__ registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sieveline.llm import chat, divergence, exact_dedup, line_dedup, mixing, prefix_trie
from sieveline.llm.common import table
from sieveline.llm.decontaminate import leaks
from sieveline.llm.language_id import identified
from sieveline.llm.ngram_join import near_groups
from sieveline.llm.pii import personal_data
from sieveline.llm.quality import scored
from sieveline.llm.secrets import findings
from sieveline.llm.token_file import token_index

#: The tokenizer file of op5; a parameter of the operator.
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(table(spark, sf_dir, "documents"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_index(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = spark.sql("SELECT -7L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    return chat.digests(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(more))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.marked(table(spark, sf_dir, "documents"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digests(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audited(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_classifier, op2_language_id, op3_ngram_jaccard_join, op4_personal_data, op5_token_output, op6_secret_scan, op7_mixing, op8_decontamination, op9_chat_formatting, op10_exact_dedup, op11_line_dedup, op12_prefix_trie, op13_source_divergence)}


def oracle_sql() -> dict[str, str]:
    return {"op7_mixing": mixing.SQL, "op9_chat_formatting": chat.SQL, "op10_exact_dedup": exact_dedup.SQL, "op11_line_dedup": line_dedup.SQL, "op12_prefix_trie": prefix_trie.SQL, "op13_source_divergence": divergence.SQL}
