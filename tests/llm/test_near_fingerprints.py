"""The near-copy stage links fingerprints first; its result is that of the exact join."""

import random

import corpus_pipeline
from evigraph.llm import jaccard_join, simhash


def test_the_tree_links_near_copies_first(spark, monkeypatch):
    rng, rows = random.Random(6), []
    for i in range(20):
        words = [f"w{rng.randrange(3000)}" for _ in range(600)]
        rows += [(i, " ".join(words)), (100 + i, " ".join([*words[:-1], "end"])), (200 + i, " ".join(f"n{rng.random()}" if k % 50 == 25 else w for k, w in enumerate(words)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    guessed, verified, close_pairs, check = [], [], simhash.close_pairs, jaccard_join.verified
    monkeypatch.setattr(simhash, "close_pairs", lambda *a: (guessed.append(close_pairs(*a)), guessed[0])[1])
    monkeypatch.setattr(jaccard_join, "verified", lambda pairs, *a: (verified.append(pairs), check(pairs, *a))[1])
    kept = sorted(r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, "").collect())
    assert guessed[0].count() >= 15 and verified[0] is guessed[0]
    assert sorted(r["doc_id"] for r in jaccard_join.one_of_each(docs).collect()) == kept


def test_every_text_has_its_fingerprint_in_the_tree(spark, monkeypatch):
    """Texts like no other, empty and null ones, repeated ids and null ids too; not only those that the set filters leave."""
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(200)) for _ in range(30)]
    rows = [(None if i % 7 == 3 else i // 2, t) for i, t in enumerate([*texts, texts[0], texts[0] + " end", "", None])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda unique, *a: (seen.append(sorted(r["fp"] for r in unique.collect())), links(unique, *a))[1])
    kept = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in corpus_pipeline.near_copies(spark, docs, "").collect())
    want = {simhash.text_fingerprint(t, 5) for _, t in rows}
    assert [[x % 2**64 for x in fps] for fps in seen] == [sorted(want, key=lambda x: x - 2**64 if x >= 2**63 else x)]
    assert kept == sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in jaccard_join.one_of_each(docs).collect())
