"""Codes of op8 stay packed; cutting a table into parts changes no answer."""

import random

from evigraph.llm import cross_polytope


def test_parts_of_a_table(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(200)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = []
    for part_rows in (16, 1 << 20):
        settings = cross_polytope.Settings(tables=4, part_rows=part_rows)
        found.append(sorted(tuple(r) for r in cross_polytope.nearest(vectors, 5, settings, query_step=10).collect()))
    assert found[0] == found[1] and len(found[0]) == 100
