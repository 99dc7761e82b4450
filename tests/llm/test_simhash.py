"""SimHash groups against fingerprints and links computed one by one."""

import random
import re

import numpy as np
import xxhash

from evigraph.llm import simhash


def slow_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(rows, radius=4):
    prints = [slow_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for (doc, _), g in zip(rows, group, strict=True):
        least[g] = min(least.get(g, doc), doc)
    return sorted((doc, f"{p:016x}", least[g]) for (doc, _), p, g in zip(rows, prints, group, strict=True))


def check(docs, settings=simhash.Settings()):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in simhash.near_duplicates(docs, settings).select("doc_id", "fingerprint", "component_id").collect())
    assert got == slow_groups(rows)
    return got


def test_whole_table(docs001):
    got = check(docs001)
    assert any(doc != component for doc, _, component in got)


def test_small_shards_give_the_same(docs001):
    check(docs001, simhash.Settings(shard_points=4, leaf_points=2, sample=50))


def test_odd_rows(odd_docs, no_docs, spark):
    got = check(odd_docs)
    assert {c for d, f, c in got if f == "0" * 16} == {3}
    assert simhash.near_duplicates(no_docs).count() == 0
    assert simhash.near_duplicates(odd_docs.selectExpr("CAST(NULL AS long) AS doc_id", "text")).count() == odd_docs.count()
    kept = simhash.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns and 13 not in [r["doc_id"] for r in kept.collect()]


def test_links_span_a_dense_group(spark):
    rng = random.Random(4)
    centre = rng.getrandbits(64)
    points = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for _ in range(400)}
    points |= {rng.getrandbits(64) for _ in range(2000)}
    values = np.array(sorted(points), dtype=np.uint64)
    close = np.bitwise_count(values[:, None] ^ values[None, :]) <= 4
    label = np.arange(len(values))
    while not np.array_equal(label, new := np.where(close, label[None, :], len(values)).min(axis=1)):
        label = new
    frame = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    found = simhash.links(frame, simhash.Settings(shard_points=200, sample=300)).collect()
    place = {int(v): i for i, v in enumerate(values.view(np.int64))}
    assert len(found) < 6 * len(values)
    forest = simhash.Forest(len(values))
    pairs = [(place[r["a"]], place[r["b"]]) for r in found]
    assert all(label[a] == label[b] for a, b in pairs)
    forest.link(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    roots = forest.roots(np.arange(len(values)))
    assert len(set(zip(roots.tolist(), label.tolist(), strict=True))) == len(set(label.tolist())) == len(set(roots.tolist()))
