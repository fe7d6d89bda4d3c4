"""Columns whose names the operators use themselves, and empty tables through the pipeline."""

import corpus_pipeline
from sieveline.llm import decontaminate, exact_dedup, language_id, mixing, ngram_join
from sieveline.llm.common import staged

CLASHING = ["size", "target", "source_size", "rate", "seed", "copies", "a", "b", "row", "copy", "h", "norm", "salt", "lead", "is_hot", "n", "tokens", "token", "comp", "y", "set", "hash", "slots", "id", "item_id", "part", "held_out", "score"]


def test_clashing_columns(spark):
    columns = ["doc_id long", "text string", "lang string", "source string", "n_chars long", *[f"{c} string" for c in CLASHING]]
    rows = [(i, f"some words of text number {i} here", "en", "s", 1, *["x"] * len(CLASHING)) for i in range(12)]
    df = spark.createDataFrame(rows, ", ".join(columns))
    bench = spark.createDataFrame([(1, "nothing like it at all in these few words")], "item_id long, text string")
    assert exact_dedup.marked(df).count() == 12
    assert ngram_join.near_groups(df).count() == 12
    assert ngram_join.one_of_each(df).columns == df.columns
    assert language_id.accepted(df).columns == df.columns
    assert decontaminate.clean(df, bench).columns == df.columns
    assert mixing.taken(df).columns == ["doc_id", "size", "source_size", "target", "taken"]
    assert mixing.repeated(df).columns == df.columns
    assert {r.size for r in mixing.repeated(df).collect()} == {"x"}


def test_empty_tables_go_through_all_stages(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, str(tmp_path)), name)
    assert docs.count() == 0
