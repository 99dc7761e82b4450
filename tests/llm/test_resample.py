"""Weights, scores and exact ranks against plain Python; splitters and segments on hot ties."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from evigraph.llm import resample
from evigraph.llm.resample import Settings


def slow_features(text, shortest, longest):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    return len(words), [" ".join(words[i : i + n]) for n in range(shortest, longest + 1) for i in range(len(words) - n + 1)]


def slow_resample(docs, target, s=Settings()):
    bucket = lambda f: zlib.crc32(f.encode()) % s.buckets
    have = Counter(bucket(f) for _, text in docs for f in slow_features(text, s.shortest, s.longest)[1])
    want = Counter(bucket(f) for text in target for f in slow_features(text, s.shortest, s.longest)[1])
    S, T = sum(have.values()), sum(want.values())
    gain = [math.floor(1000 * math.log((want[b] + 1) * (S + s.buckets) / ((have[b] + 1) * (T + s.buckets)))) for b in range(s.buckets)]
    rows = []
    for doc, text in docs:
        words, found = slow_features(text, s.shortest, s.longest)
        weight = sum(gain[bucket(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{s.seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append((doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words))
    able = sorted((r for r in rows if r[4] >= s.least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = able[: s.percent * len(able) // 100]
    out = Counter((*r[:4], i) for i, r in enumerate(drawn, 1))
    out.update((*r[:4], None) for r in (Counter(r[:4] for r in rows) - Counter(r[:4] for r in drawn)).elements())
    return out


def compare(spark, docs, target, settings=Settings()):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    texts = [r["text"] for r in target.select("text").collect()]
    got = resample.resample(docs, target, settings).collect()
    assert Counter(tuple(r) for r in got) == slow_resample(rows, texts, settings)
    return got


def benchmark(spark):
    return spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")


@pytest.mark.parametrize("settings", [Settings(), Settings(percent=60, run_rows=16), Settings(shortest=1, longest=2, buckets=97, least_words=1, percent=100, run_rows=7)])
def test_tables(spark, docs001, settings):
    got = compare(spark, docs001, benchmark(spark), settings)
    assert any(r["rank"] for r in got)


def test_odd_rows(spark, odd_docs):
    target = spark.createDataFrame([(1, None), (2, ""), (3, "The quick brown FOX äpfel")], "item_id long, text string")
    compare(spark, odd_docs, target, Settings(least_words=0, percent=100, run_rows=4))


def test_large_ids_and_ties(spark):
    base = 1 << 60
    rows = [(base + i % 5 if i % 7 else None, "word " * (20 + i % 2)) for i in range(400)]
    got = compare(spark, spark.createDataFrame(rows, "doc_id long, text string"), benchmark(spark), Settings(percent=50, run_rows=32))
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 201))


def test_empty_sides(spark, no_docs, odd_docs):
    assert resample.resample(no_docs, benchmark(spark)).count() == 0
    compare(spark, odd_docs, benchmark(spark).limit(0), Settings(least_words=0, percent=100))


def test_target_documents_score_higher(spark):
    near = [(i, "crystal lattice phonon band " * 10) for i in range(50)]
    far = [(100 + i, "garden soup cheese window " * 10) for i in range(50)]
    docs = spark.createDataFrame(near + far, "doc_id long, text string")
    target = spark.createDataFrame([("crystal phonon band lattice",)], "text string")
    weight = {r["doc_id"]: r["weight"] for r in resample.resample(docs, target).collect()}
    assert min(weight[i] for i in range(50)) > max(weight[100 + i] for i in range(50))


def test_keys_sort_like_rows():
    rng = np.random.default_rng(5)
    rows = [(None if rng.random() < 0.2 else int(rng.integers(-3, 3)) * (1 << 61), int(rng.integers(3)), int(rng.integers(-2, 3)), i) for i in range(300)]
    batch = pa.RecordBatch.from_pylist([dict(zip(("doc_id", "n_features", "score", "row"), r)) for r in rows], pa.schema([(c, pa.int64()) for c in ("doc_id", "n_features", "score", "row")]))
    order = np.argsort(resample.sort_keys(batch), kind="stable").tolist()
    assert order == sorted(range(300), key=lambda i: (-rows[i][2], rows[i][0] is None, rows[i][0] or 0, rows[i][1], i))
