"""Repeated passages against a dictionary of all windows."""

import hashlib
import random
import re

import numpy as np
import pytest

from evigraph.llm import blocks, fm_dedup
from evigraph.llm.fm_index import FMIndex

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow(rows, length=13):
    first = {}
    cut = [(doc, WORD.findall(text or "")) for doc, text in rows]
    for doc, words in cut:
        for i in range(len(words) - length + 1):
            key = tuple(words[i : i + length])
            if doc is not None:
                first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, words in cut:
        gone = set()
        for i in range(len(words) - length + 1):
            if doc is not None and first[tuple(words[i : i + length])] < doc:
                gone.update(range(i, i + length))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def check(docs, **options):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    found = fm_dedup.without_repeats(docs, fm_dedup.Settings(**options), with_text=True).collect()
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found), key=str)
    assert got == slow(rows, options.get("length", 13))
    for r in found:
        assert sum(r["spans"][1::2]) - sum(r["spans"][::2]) == r["n_removed"]
        assert hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"]
    return sum(r[2] for r in got)


def test_whole_table(docs001):
    assert check(docs001) > 0


def test_odd_rows(odd_docs, no_docs):
    assert check(odd_docs) > 0
    check(odd_docs.selectExpr("nullif(doc_id, 5) AS doc_id", "text"), length=9)
    assert fm_dedup.without_repeats(no_docs).count() == 0


def test_shared_passages_and_repeated_words(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(30)]
    passages = [" ".join(rng.choices(words, k=rng.randrange(8, 60))) for _ in range(12)] + ["a " * 40, "a b " * 20]
    rows = [(rng.randrange(200), " ".join(rng.choice(passages) if rng.random() < 0.5 else rng.choice(words) for _ in range(rng.randrange(25)))) for _ in range(250)]
    check(spark.createDataFrame(rows, "doc_id long, text string"))
    check(spark.createDataFrame(rows, "doc_id long, text string"), length=16)


@pytest.mark.parametrize("seed", range(4))
def test_intervals_count_occurrences(seed):
    rng = np.random.default_rng(seed)
    lines = [rng.integers(1, 4, rng.integers(13, 24)) for _ in range(60)]
    words = np.concatenate([np.append(x, 0) for x in lines])
    ends = np.flatnonzero(words == 0)
    index = FMIndex(words.copy(), ends, 3)
    starts = np.array([i for i in range(len(words) - 11) if (words[i : i + 11] > 0).all()])
    low, high = index.intervals(starts, 11)
    for s, a, b in zip(starts, low, high, strict=True):
        same = [t for t in starts if (words[t : t + 11] == words[s : s + 11]).all()]
        assert sorted(index.order[a:b]) == same


def test_word_hashes_follow_the_words():
    texts = ["", "ab ba\tab", " \n", "x\x1cy z", "ab"]
    hashes, counts = blocks.word_hashes(texts)
    words = [w for t in texts for w in WORD.findall(t)]
    assert counts.tolist() == [len(WORD.findall(t)) for t in texts]
    assert len({(h, w) for h, w in zip(hashes.tolist(), words, strict=True)}) == len(set(words)) == len(set(hashes.tolist()))
    assert (blocks.word_hashes(["AB", "É"], lower=True)[0] == blocks.word_hashes(["ab", "É"])[0]).all()
    for array in (np.array([3, 9, 12], dtype=np.uint32), np.zeros(0, dtype=np.int64), np.array([1, 0], dtype=np.uint8)):
        assert blocks.unsqueeze(blocks.squeeze(array, array))[1].tolist() == array.tolist()
