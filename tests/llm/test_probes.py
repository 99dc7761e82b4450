"""Probes follow the recall that is measured, not the settings alone."""

import numpy as np

from evigraph.llm import cross_polytope as cp
from test_cross_polytope import answers, exact


def test_recall_holds_from_too_few_probes(spark):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = exact([(r["vec_id"], r["embedding"]) for r in frame.collect()])
    got = answers(frame, settings=cp.Settings(probes=(1, 1, 1)))
    found = sum(len({i for _, i in got.get(q, [])} & {i for _, i in want[q]}) for q in want)
    assert found >= 0.92 * sum(map(len, want.values()))


def test_probes_rise_until_all_is_met():
    rng = np.random.default_rng(5)
    queries, near = rng.normal(size=(9, 16)), rng.normal(size=(90, 16))
    of = np.repeat(np.arange(9), 10)
    settings = cp.Settings(tables=2, recall=1.0)
    probes = cp.probes_for(queries, near, of, 2, 1, settings)
    met = np.zeros(90, dtype=bool)
    for table in range(2):
        probed, own = cp.codes(queries, table, 2, probes, settings.seed), cp.codes(near, table, 2, 1, settings.seed)[:, 0]
        met |= (probed[of] == own[:, None]).any(axis=1)
    assert met.all()
