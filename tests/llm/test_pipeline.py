"""The pipeline against what its stages decide by brute force."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers

import corpus_pipeline
from tests.llm.test_llm import D, brute_components, check_places, odd_rows


def test_stages_and_run(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{D}/documents.parquet")
    start = docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        docs = stage(spark, docs, D)
        if i < 4:
            assert docs.columns == start.columns
        after = docs.collect()
        if i == 2:
            keep = {c for _, _, c in brute_components([(r.doc_id, r.text) for r in before])}
            assert {r.doc_id for r in after} == keep
        if i == 3:
            items = [f" {' '.join(r.text.lower().split())} " for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
            held = {r.doc_id for r in before if any(t in f" {' '.join((r.text or '').lower().split())} " for t in items)}
            assert held and not held & {r.doc_id for r in after} and len(after) > 0.8 * len(before)
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in before:
        ids = t.encode(r.text or "", add_special_tokens=False).ids + [1]
        for k, a in enumerate(range(0, len(ids), 4096)):
            want[(r.doc_id, k, a, zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.ids_crc32) for r in after) == want
    check_places(after)
    run = corpus_pipeline.run(spark, D)
    assert Counter((r.doc_id, r.piece, r.start, r.ids_crc32) for r in run.collect()) == want


def test_odd_rows(spark):
    docs = spark.createDataFrame(odd_rows(), "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, D)
        assert name == "packing" or out.columns == docs.columns
        assert stage(spark, docs.where("false"), D).count() == 0
        out.count()
    kept = [r.doc_id for r in corpus_pipeline.jaccard_stage(spark, docs, D).collect()]
    assert kept.count(7) == 1 and 11 not in kept and 12 not in kept and 13 not in kept and 14 in kept


def test_stages_give_memory_back_in_the_driver(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(corpus_pipeline, "give_back", lambda: calls.append(1))
    corpus_pipeline._begin(spark)
    assert calls == [1] and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "1000"
