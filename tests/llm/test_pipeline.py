"""Stages of the pipeline against plain code, one after the other."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from evigraph.llm import language_id
from evigraph.llm.jaccard_join import Settings
from test_jaccard_join import slow_groups

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(docs):
    return [tuple(r) for r in docs.select(*COLUMNS).collect()]


def check_packing(before, pieces):
    """Every document's ids, cut and numbered, each in one place; sequences are gapless and not too long."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in before:
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[at : at + 4096], dtype="<u4")
            want[(r[0], piece, at, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces) == want
    filled = {}
    for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled.values()) <= 4096


@pytest.mark.parametrize("name", ["table", "odd"])
def test_stages(spark, docs001, odd_docs, name, tmp_path):
    docs, now = (docs001 if name == "table" else odd_docs), None
    for number, (stage, fn) in enumerate(corpus_pipeline.STAGES):
        before = rows_of(docs)
        out = fn(spark, docs, "/root/testdata/sf0.001")
        out.write.parquet(str(tmp_path / str(number)))
        now = spark.read.parquet(str(tmp_path / str(number)))
        if stage == "best_fit_packing":
            check_packing(before, now.collect())
            break
        assert now.columns == docs.columns
        after = rows_of(now)
        assert not Counter(after) - Counter(before)
        if stage == "language_id":
            gone = [r for r in before if r not in after]
            assert all(not any(map(str.isalpha, r[1] or "")) for r in gone if len(r[1] or "") > 40 or not r[1])
            assert len(gone) <= 0.3 * len(before)
        elif stage == "exact_dedup":
            keep = {}
            for r in before:
                keep[r[1]] = max(keep.get(r[1], r), r, key=lambda x: x[0])
            assert Counter(after) == Counter(keep.values())
        elif stage == "simhash_near_dedup":
            groups = slow_groups([(r[0], r[1]) for r in before], Settings(shingle=5, percent=80))
            stay = {doc for doc, _, component in groups if doc == component}
            assert Counter(after) == Counter(r for r in before if r[0] in stay)
        elif stage == "source_mix":
            assert Counter(after) == Counter(before)
        docs = now
    assert sum(r["length"] for r in now.collect()) > 0


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0


def test_language_held_out(docs001, odd_docs, no_docs, spark):
    wide = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(wide).join(wide.select("doc_id", "lang", "n_chars"), "doc_id").filter("held_out AND n_chars > 100")
    right = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.98
    odd = {r["doc_id"]: r for r in language_id.identify(odd_docs).collect()}
    assert len(odd) == 13 and all(odd[i]["lang_pred"] == "und" for i in (3, 4, 10, 11))
    assert all(0 <= r["score"] <= 1 for r in odd.values()) and odd[5]["lang_pred"] in ("en", "de", "fr")
    assert language_id.identify(no_docs).count() == 0
    unlabelled = odd_docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language_id.identify(unlabelled).collect()} == {"und"}
