"""Schedules against the definition of Pfair: less than one block from the target at every slot."""

from collections import Counter
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from evigraph.llm import pfair_mix


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=9))
def test_one_period_stays_within_one_block(parts):
    period, seen = sum(parts), Counter()
    for slot, source in enumerate(pfair_mix.one_period(parts), 1):
        seen[source] += 1
        assert all(abs(seen[i] - Fraction(slot * p, period)) < 1 for i, p in enumerate(parts))
    assert [seen[i] for i in range(len(parts))] == parts


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.floats(0.1, 9)), min_size=1, max_size=6))
def test_every_block_gets_one_slot(sources):
    blocks, weights = [b for b, _ in sources], [w for _, w in sources]
    phases = pfair_mix.schedule(blocks, weights, 40)
    slots = np.concatenate([pfair_mix.slot_of(phases, i, np.arange(n)) for i, n in enumerate(blocks)])
    assert sorted(slots.tolist()) == list(range(sum(blocks)))
    for phase in phases:
        for i, own in phase.within.items():
            ran = pfair_mix.slot_of(phases, i, np.arange(blocks[i]))
            for end in range(phase.first, phase.first + phase.length):
                n = ((ran >= phase.first) & (ran <= end)).sum()
                assert abs(n - (end + 1 - phase.first) * len(own) / phase.period) < 1


def test_rows(docs001, odd_docs, no_docs):
    for docs in (docs001, odd_docs):
        rows = pfair_mix.interleave(docs, settings=pfair_mix.Settings(block_rows=3)).collect()
        want = Counter((r["doc_id"], r["source"]) for r in docs.select("doc_id", "source").collect())
        assert Counter((r["doc_id"], r["source"]) for r in rows) == want
        assert len({r["position"] for r in rows}) == len(rows)
        by_slot = {}
        for r in rows:
            by_slot.setdefault(r["slot"], set()).add((r["source"], r["block"]))
        assert all(len(b) == 1 for b in by_slot.values()) and sorted(by_slot) == list(range(len(by_slot)))
    assert pfair_mix.interleave(no_docs).count() == 0
    ordered = pfair_mix.in_order(odd_docs)
    assert ordered.columns == odd_docs.columns and ordered.count() == odd_docs.count()


def test_target_weights(docs001):
    rows = pfair_mix.interleave(docs001, {"src0": 3.0, "src1": 1.0}, pfair_mix.Settings(block_rows=1, period=1000)).collect()
    seen = Counter(r["source"] for r in rows if r["slot"] < 20)
    assert seen["src0"] > seen["src1"]
