"""Nearest neighbours against all distances."""

import math

import numpy as np
import pytest

from evigraph.llm import cross_polytope as cp


def exact(rows, query_step=100, neighbours=10):
    good = {(i, tuple(v)) for i, v in rows if i is not None and v is not None and None not in v and all(map(math.isfinite, v)) and any(v)}
    out = {}
    for q, a in good:
        if q % query_step == 0:
            for i, b in good:
                if i != q:
                    score = math.dist(a, b)
                    out.setdefault(q, {})[i] = min(score, out.get(q, {}).get(i, math.inf))
    return {q: sorted((s, i) for i, s in found.items())[:neighbours] for q, found in out.items()}


def answers(frame, **options):
    got = {}
    for r in cp.nearest(frame, **options).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(got[r["query_id"]])
    return got


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall(spark, sf):
    frame = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    want = exact([(r["vec_id"], r["embedding"]) for r in frame.collect()])
    got = answers(frame)
    assert got.keys() == want.keys()
    found = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert found >= 0.95 * sum(map(len, want.values()))
    scores = {(q, i): s for q in want for s, i in want[q]}
    assert all(abs(scores.get((q, i), s) - s) < 1e-12 for q in got for s, i in got[q])


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(1, 60)]
    same = rows[5][1]
    rows += [(1000 + i, same) for i in range(40)] + [(0, same), (100, same), (200, rows[7][1]), (200, rows[7][1]), (300, rows[9][1])]
    rows += [(400, None), (500, [0.0] * 8), (600, [nan] * 8), (700, [inf] * 8), (800, [None] * 8), (900, [1.0] * 3), (None, same), (61, [])]
    frame = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<float>, point string, code string")
    want = exact([r for r in rows if r[1] is None or len(r[1]) == 8])
    got = answers(frame, settings=cp.Settings(probes=(16, 256, 512)))
    assert got.keys() == want.keys() == {0, 100, 200, 300, 1000}
    for q in want:
        assert [i for _, i in got[q]] == [i for _, i in want[q]]
    assert answers(frame.limit(0)) == {}


def test_codes_begin_with_the_nearest_axis():
    vectors = np.random.default_rng(1).normal(size=(50, 24))
    own = cp.codes(vectors, 2, 2, 1, 11)[:, 0]
    many = cp.codes(vectors, 2, 2, 40, 11)
    assert (many[:, 0] == own).all() and all(len(set(row)) == 40 for row in many.tolist())
