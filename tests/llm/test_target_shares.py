"""Schedules against the given weights, not rounded ones."""

from collections import Counter
from fractions import Fraction

from hypothesis import given, settings
from hypothesis import strategies as st

from evigraph.llm import pfair_mix


def ideal(blocks, weights, slots):
    """Blocks each source should have run before each slot."""
    ran, out = [Fraction(0)] * len(blocks), []
    for _ in range(slots + 1):
        out.append(list(ran))
        room = Fraction(1)
        while room and (left := [i for i, n in enumerate(blocks) if ran[i] < n]):
            total = sum(weights[i] for i in left)
            step = min(room, *[(blocks[i] - ran[i]) * total / weights[i] for i in left])
            for i in left:
                ran[i] += step * weights[i] / total
            room -= step
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 40), st.integers(1, 99)), min_size=1, max_size=7))
def test_within_one_block_of_the_weights(sources):
    blocks, weights = [b for b, _ in sources], [Fraction(w) for _, w in sources]
    fluid, seen = pfair_mix.Fluid(blocks, [float(w) for w in weights]), Counter()
    want = ideal(blocks, weights, sum(blocks))
    for slot, i in enumerate(pfair_mix.walk(fluid, [0] * len(blocks), 0), 1):
        seen[i] += 1
        assert all(abs(seen[k] - want[slot][k]) < 1 + Fraction(1, 10**9) for k in range(len(blocks)))
    assert [seen[i] for i in range(len(blocks))] == blocks


def test_a_long_schedule_keeps_nine_to_one():
    steps, seen = pfair_mix.walk(pfair_mix.Fluid([10**6, 10**6], [0.9, 0.1]), [0, 0], 0), Counter()
    for slot in range(1, 100_001):
        seen[next(steps)] += 1
        assert abs(seen[0] - 0.9 * slot) < 1.001


def test_replay_from_a_cut_goes_on_alike():
    fluid = pfair_mix.Fluid([50, 7, 300, 1], [5.0, 0.3, 2.0, 1.0])
    whole = list(pfair_mix.walk(fluid, [0] * 4, 0))
    for number, used in enumerate(pfair_mix.states(fluid, 64)):
        assert list(pfair_mix.walk(fluid, used.tolist(), 64 * number)) == whole[64 * number :]


def test_five_hundred_sources(spark):
    frame = spark.range(6000).selectExpr("id AS doc_id", "IF(id % 2 = 0, 'big', concat('s', id % 998)) AS source")
    weights = {"big": 0.5} | {f"s{i}": 0.5 / 499 for i in range(1, 998, 2)}
    rows = pfair_mix.interleave(frame, weights, pfair_mix.Settings(block_rows=1)).collect()
    assert sorted(r["slot"] for r in rows) == list(range(6000)) and len({r["source"] for r in rows}) == 500
    assert abs(sum(r["source"] == "big" for r in rows if r["slot"] < 1000) - 500) <= 1
