"""Components of similar shingle sets against comparing all pairs."""

import random
import re
from collections import Counter

import pytest

from evigraph.llm import jaccard_join
from evigraph.llm.jaccard_join import Settings


def slow_set(text, shingle):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))) if words else frozenset()


def slow_groups(rows, s=Settings()):
    sets = [slow_set(text, s.shingle) for _, text in rows]
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            common = len(x & sets[j])
            if common and 100 * common >= s.percent * (len(x) + len(sets[j]) - common):
                group[top(i)] = top(j)
    ids = {}
    for i, (doc, _) in enumerate(rows):
        ids.setdefault(top(i), []).append(doc)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in ids.items()}
    return Counter((doc, len(sets[i]), least[top(i)]) for i, (doc, _) in enumerate(rows))


def compare(docs, settings=Settings()):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = jaccard_join.similar_groups(docs, settings)
    assert Counter(tuple(r) for r in got.collect()) == slow_groups(rows, settings)


def edited(rng, words, share):
    return [f"w{rng.randrange(10**6)}" if rng.random() < share else w for w in words]


def test_odd_rows(spark, odd_docs, no_docs):
    compare(odd_docs)
    assert jaccard_join.similar_groups(no_docs).count() == 0


@pytest.mark.parametrize("settings", [Settings(), Settings(percent=60, extra=3), Settings(shingle=2, percent=75, extra=0, centres=1)])
def test_tables(docs001, settings):
    compare(docs001, settings)


@pytest.mark.parametrize("percent", [70, 85])
def test_near_copies_at_the_threshold(spark, percent):
    """Chains, stars and groups whose members lie on both sides of the threshold, below shared passages."""
    rng = random.Random(percent)
    passage = [f"p{i}" for i in range(40)]
    texts = []
    for size in (5, 12, 40, 130, 400):
        base = [f"b{rng.randrange(10**6)}" for _ in range(size)]
        chain = base
        for step in range(14):
            texts.append(edited(rng, base, step * 0.004))
            chain = edited(rng, chain, 0.02)
            texts.append(chain)
            texts.append(base[: size - step] + passage * (step % 2))
    texts += [passage + [f"u{i}x{k}" for k in range(25 * i)] for i in range(12)]
    rows = [(i, " ".join(words)) for i, words in enumerate(texts)]
    rng.shuffle(rows)
    compare(spark.createDataFrame(rows, "doc_id long, text string"), Settings(percent=percent))


def test_large_group(spark):
    rng = random.Random(3)
    base = [f"b{i}" for i in range(90)]
    rows = [(i, " ".join(edited(rng, base, rng.choice([0.005, 0.02, 0.05])))) for i in range(500)]
    compare(spark.createDataFrame(rows, "doc_id long, text string"))


def test_large_and_missing_ids(spark):
    base = 1 << 60
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(base + 3, text), (base + 1, text + " tail"), (None, text), (base + 5, "other words in here now"), (None, "quite another text of words"), (base + 5, text + " end")]
    compare(spark.createDataFrame(rows, "doc_id long, text string"))
