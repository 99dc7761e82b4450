"""Ids beyond 2^53, next to rows without an id, come back as they were from every operator; columns may have any name."""

import public_tokenizers
import pytest

import corpus_pipeline
from evigraph.llm import chunk_dedup, cross_polytope, fm_dedup, jaccard_join, language_id, ngram_lm, packing, pfair_mix, simhash, token_files
from evigraph.session import work_path

BASE = 1 << 60
IDS = [None, *(BASE + k for k in (1, 3, 5, 6, 7, 9, 100, 101))]
WORDS = "the quick brown fox jumps over a lazy dog while seven wizards box and eleven more look on from afar".split()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, " ".join(WORDS[k % 7 : 8 + k]) + f" number {k}", "en" if k % 2 else "de", "s") for k, i in enumerate(IDS)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for name in ("_id", "_point", "_own", "_sha", "_judged", "_place", "digest"):
        frame = frame.selectExpr("*", f"'clash' AS `{name}`")
    return frame.repartition(2)


def token_rows(spark, docs):
    form = token_files.Format(public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_token_files(spark, token_files.write_token_files(docs, work_path(spark, "tokens"), form))


RUNS = {
    "op1": token_rows,
    "op3": lambda spark, docs: ngram_lm.score(docs),
    "op4": lambda spark, docs: pfair_mix.interleave(docs),
    "op5": lambda spark, docs: simhash.near_duplicates(docs),
    "op6": lambda spark, docs: packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")),
    "op7": lambda spark, docs: chunk_dedup.exact_groups(docs),
    "op9": lambda spark, docs: language_id.identify(docs),
    "op10": lambda spark, docs: fm_dedup.without_repeats(docs),
    "op13": lambda spark, docs: jaccard_join.similar_groups(docs),
    "language stage": lambda spark, docs: language_id.confident(docs, 0.0),
    "exact stage": lambda spark, docs: corpus_pipeline.exact_copies(spark, docs, ""),
    "near stage": lambda spark, docs: corpus_pipeline.near_copies(spark, docs, ""),
    "mix stage": lambda spark, docs: corpus_pipeline.source_mix(spark, docs, ""),
    "packing stage": lambda spark, docs: corpus_pipeline.packed_sequences(spark, docs, ""),
}


@pytest.mark.parametrize("name", RUNS)
def test_ids_come_back(spark, docs, name):
    got = [r["doc_id"] for r in RUNS[name](spark, docs).collect()]
    assert sorted(got, key=str) == sorted(IDS, key=str)


def test_vectors(spark):
    rows = [(None if k == 5 else BASE + k, [float(k % 7), float(k % 11), 1.0]) for k in range(300)]
    got = cross_polytope.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    ids = {i for i, _ in rows if i is not None}
    assert {r["query_id"] for r in got} == {i for i in ids if i % 100 == 0}
    for r in got:
        assert r["vec_id"] in ids
        a, b = ([float((x - BASE) % 7), float((x - BASE) % 11)] for x in (r["query_id"], r["vec_id"]))
        assert r["score"] == ((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) ** 0.5
