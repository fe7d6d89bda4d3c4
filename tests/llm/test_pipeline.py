"""Each stage of the pipeline on what the one before kept, against plain Python."""

import os
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from sieveline.llm import mixing
from sieveline.llm.common import staged
from sieveline.llm.queries import tokenizer_path
from tests.llm.test_ngram_join import brute

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables here")
def test_stages(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    columns, kept = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(staged(stage(spark, kept[-1], DATA), name))
    assert all(k.columns == columns for k in kept[:-1])
    known, unique, clean, mix = (k.collect() for k in kept[1:5])
    # All texts of these tables have a language.
    assert len(known) == docs.count()
    groups = brute([(r.doc_id, r.text) for r in known])
    assert {r.doc_id for r in unique} == {c for _, c in groups.values()} and len(unique) == len({c for _, c in groups.values()})
    plain = lambda t: " ".join(w.strip(".,;:!?").lower() for w in t.split())
    leaked = {r.doc_id for r in unique if any(plain(i) in plain(r.text) for i in items)}
    assert leaked and {r.doc_id for r in clean} == {r.doc_id for r in unique} - leaked
    want = {r.doc_id: r.taken // r.size for r in mixing.taken(kept[3]).collect() if r.size}
    assert Counter(r.doc_id for r in mix) == Counter({i: n for i, n in want.items() if n})
    library = Tokenizer.from_file(tokenizer_path())
    at = 0
    texts = sorted(((r.doc_id, r.text) for r in mix))
    for got, (doc_id, text) in zip(sorted(kept[5].collect(), key=lambda r: r.start), texts):
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        assert (got.doc_id, got.start, got.n_tokens, got.ids_crc32) == (doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert len(texts) == kept[5].count()


def test_run_gives_the_last_stage(spark):
    if os.path.isdir(DATA):
        assert corpus_pipeline.run(spark, DATA).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
