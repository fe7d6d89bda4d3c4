"""The corpus pipeline: stages that each read what the one before has kept.

Rows keep their own columns, whatever their names, up to the last stage. Texts that are null or have no letter go with the
first stage; rows that repeat a doc_id go or stay together; a row without a doc_id is never a near copy nor a leak and stays. Texts
are read whole. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sieveline.llm.common import discard, staged, table
from sieveline.llm.decontaminate import clean
from sieveline.llm.language_id import accepted
from sieveline.llm.mixing import repeated
from sieveline.llm.ngram_join import one_of_each
from sieveline.llm.queries import tokenizer_path
from sieveline.llm.token_file import token_index


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents go that have no letter or are no nearer to any learned language than chance."""
    return accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: of each group of near copies the document with the least doc_id stays."""
    return one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents go that hold an item of benchmark."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: every document as often as its source's target asks for."""
    return repeated(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: the mix as token ids in files; the index that is read back from them."""
    return token_index(docs, tokenizer_path())


STAGES = [
    ("language_id", known_language),
    ("ngram_jaccard_join", near_duplicates),
    ("decontamination", decontaminated),
    ("mixing", mix),
    ("token_output", token_output),
]

#: Language ID is learned, which SQL cannot express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next; what a written stage has read is deleted."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        kept = staged(stage(spark, docs, sf_dir), name)
        if k:
            discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
