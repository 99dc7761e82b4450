"""Every query gets all the neighbours there are, up to ten."""

import numpy as np
import pytest

from evigraph.llm import cross_polytope as cp
from test_cross_polytope import answers, exact


@pytest.mark.parametrize("settings", [cp.Settings(), cp.Settings(tables=1, probes=(1, 1, 1), recall=0.0)])
def test_a_dozen_vectors(spark, settings):
    rng = np.random.default_rng(8)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=64)]) for i in [0, 100, 200, *range(1, 10)]]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got, want = answers(frame, settings=settings), exact(rows)
    assert {q: [i for _, i in found] for q, found in got.items()} == {q: [i for _, i in found] for q, found in want.items()}


def test_odd_vectors_with_the_settings_of_the_query(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(1, 6)]
    rows += [(0, rows[1][1]), (100, rows[1][1]), (200, rows[3][1]), (300, None), (400, [0.0] * 8)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got, want = answers(frame), exact(rows)
    assert {q: [i for _, i in found] for q, found in got.items()} == {q: [i for _, i in found] for q, found in want.items()}
