"""Ranges on dyadic nodes: exact unions, each overlapping pair once, first hits, hot nodes cut into parts."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from evigraph.functions import dyadic
from evigraph.operators import coverage


def random_ranges(rng, count, most):
    out = []
    for i in range(count):
        start = rng.randrange(-20, 400)
        out.append((rng.choice("fg"), start, start + rng.choice([0, 1, 3, 17, most, -2]), i))
    return [*out, ("f", None, 3, count), ("f", 3, None, count + 1), ("f", 5, 4, count + 2)]


def overlaps(a, b):
    if a[0] != b[0] or None in a[:3] or None in b[:3] or a[2] < a[1] or b[2] < b[1]:
        return False
    return a[1] <= b[2] and b[1] <= a[2]


def test_nodes_make_up_the_range(spark):
    rows = [(a, a + n) for a in (-9, -1, 0, 1, 7, 64, 1000) for n in (-1, 0, 1, 2, 5, 31, 32, 333)]
    frame = spark.createDataFrame(rows, "a int, b int")
    levels = dyadic.levels_of(frame, "a", "b")
    for r in frame.select("a", "b", dyadic.range_nodes(F.col("a"), F.col("b"), levels).alias("n"), dyadic.number_nodes(F.col("a"), levels).alias("up")).collect():
        numbers = [x for level, node in r["n"] for x in range(node << level, (node + 1) << level)]
        assert sorted(numbers) == list(range(r["a"], r["b"] + 1))
        assert len(r["n"]) <= 2 * (levels + 1) and [tuple(x) for x in r["up"]] == [(level, r["a"] >> level) for level in range(levels + 1)]


@pytest.mark.parametrize("hot", [4096, 3])
def test_every_pair_once(spark, hot):
    rng = random.Random(hot)
    left, right = random_ranges(rng, 150, 60), random_ranges(rng, 120, 250)
    a = spark.createDataFrame(left, "file string, s int, e int, i int")
    b = spark.createDataFrame(right, "file string, ls int, le int, j int")
    got = coverage.overlap_join(a, b, ["file"], ("s", "e"), ("ls", "le"), hot)
    assert sorted(got.columns) == sorted(["file", "s", "e", "i", "ls", "le", "j"])
    assert Counter((r["i"], r["j"]) for r in got.collect()) == Counter((x[3], y[3]) for x in left for y in right if overlaps(x, y))


def test_first_hits(spark):
    rng = random.Random(8)
    traces, locations = random_ranges(rng, 100, 30), random_ranges(rng, 60, 200)
    t = spark.createDataFrame([("s", f"c{i % 9}", i, *r[:3]) for i, r in enumerate(traces)], "scope_id string, case_id string, trace_no int, file string, line_start int, line_end int")
    ords = rng.sample(range(1000), len(locations))
    rows = [("s", f"CH{i % 11}", *r[:3], o) for i, (r, o) in enumerate(zip(locations, ords, strict=True))]
    found = coverage.first_hits(t, spark.createDataFrame(rows, "scope_id string, chain_id string, file string, line_start int, line_end int, ord int"), ["scope_id", "file"])
    want = {}
    for i, trace in enumerate(traces):
        hits = [(o, f"CH{j % 11}") for j, (r, o) in enumerate(zip(locations, ords, strict=True)) if overlaps(trace, r)]
        if hits:
            want[i] = min(hits)[1]
    assert {r["trace_no"]: r["chain_id"] for r in found.collect()} == want


def test_long_ranges_cost_few_rows(spark):
    rows = spark.createDataFrame([("f", 1, 1_000_000_000, 1)], "file string, a int, b int, ord int")
    assert rows.select(F.size(dyadic.range_nodes(F.col("a"), F.col("b"), dyadic.levels_of(rows, "a", "b")))).first()[0] <= 62
