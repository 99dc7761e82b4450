"""The mix decides in which sequences the documents of a source come."""

from collections import Counter

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from evigraph.llm import packing, pfair_mix


def test_runs_of_sequences_hold_the_shares(spark):
    rows = [(i, f"text {i} " + "word " * (i * 7 % 90), f"s{i % 3 % 2}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights, window = {"s0": 3.0, "s1": 1.0}, 480
    packed = packing.pack_in_order(docs, pfair_mix.positions(docs, weights), public_tokenizers.path("word_bpe_49k.json"), capacity=512, window=window)
    found = sorted((r["sequence_id"], r["doc_id"]) for r in packed.collect())
    assert sorted(doc for _, doc in found) == [r[0] for r in rows]
    assert sorted({s for s, _ in found}) == list(range(found[-1][0] + 1))
    source = {r[0]: r[2] for r in rows}
    for at in range(0, 2400, window):
        seen = Counter(source[doc] for _, doc in found[at : at + window])
        assert abs(seen["s0"] - 0.75 * window) < 2 * 16
    filled = Counter()
    for r in packed.collect():
        filled[r["sequence_id"]] += r["length"]
    assert max(filled.values()) <= 512


def test_the_stage_takes_the_order(spark, docs001):
    packed = corpus_pipeline.packed_sequences(spark, docs001, "").groupBy("doc_id").agg(F.min("sequence_id").alias("s"))
    alone = packing.pack_documents(docs001, public_tokenizers.path("word_bpe_49k.json")).groupBy("doc_id").agg(F.min("sequence_id").alias("s"))
    assert {tuple(r) for r in packed.collect()} != {tuple(r) for r in alone.collect()}
