"""Mixing sources to target weights by Pfair scheduling.

Block j (from 1) of a source with weight w is released at slot floor((j - 1) / w) and due by slot ceil(j / w); in each
slot the released block with the earliest deadline runs. Every prefix of the schedule then holds each source to
within less than one block of its share. When a source is used up, the others share its weight from then on, so the
share of a source is piecewise linear in time and no document is dropped; releases and deadlines are exact integers.
The driver walks once over the slots and keeps the state at cuts; tasks replay the slots between two cuts.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm.common import by_number, rank_within
from evigraph.session import persist_table


@dataclass(frozen=True)
class Settings:
    """A task replays ``cut_slots`` slots, or eight for each source where that is more; ``period`` is for ``schedule`` alone."""

    block_rows: int = 16
    period: int = 1000
    cut_slots: int = 4096


def whole_parts(weights: list[float], period: int) -> list[int]:
    """Parts of ``period`` nearest to the weights (largest remainders); at least one each, which the largest parts give."""
    total = float(sum(weights))
    exact = [w / total * period for w in weights]
    parts = [int(x) for x in exact]
    for i in sorted(range(len(parts)), key=lambda i: parts[i] - exact[i])[: period - sum(parts)]:
        parts[i] += 1
    for i in [i for i, p in enumerate(parts) if not p]:
        parts[max(range(len(parts)), key=parts.__getitem__)] -= 1
        parts[i] = 1
    return parts


def one_period(parts: list[int]) -> list[int]:
    """Which source runs in each of sum(parts) slots, by earliest deadline among released blocks.

    Deadlines tie by the later next release, then by position; one slot at a time with full load is always feasible.
    """
    period = sum(parts)
    waiting = [(0, i, 1) for i in range(len(parts))]
    heapq.heapify(waiting)
    ready: list[tuple] = []
    out = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-j * period // parts[i]), -(j * period // parts[i]), i, j))
        deadline, _, i, j = heapq.heappop(ready)
        if deadline <= slot:
            raise AssertionError("deadline missed")
        out.append(i)
        if j < parts[i]:
            heapq.heappush(waiting, (j * period // parts[i], i, j + 1))
    return out


@dataclass(frozen=True)
class Phase:
    """Slots from ``first``; source i has used ``used[i]`` blocks before and runs at ``within[i]`` of each period."""

    first: int
    used: dict[int, int]
    within: dict[int, np.ndarray]
    period: int
    length: int


def schedule(blocks: list[int], weights: list[float], period: int) -> list[Phase]:
    """Phases that give a slot to each of blocks[i] blocks of source i."""
    left, done, first, out = list(blocks), [0] * len(blocks), 0, []
    while active := [i for i, n in enumerate(left) if n]:
        parts = whole_parts([weights[i] for i in active], max(period, len(active)))
        runs = np.array(one_period(parts))
        within = {i: np.flatnonzero(runs == k) for k, i in enumerate(active)}
        size = len(runs)
        ends = [(left[i] - 1) // len(within[i]) * size + int(within[i][(left[i] - 1) % len(within[i])]) + 1 for i in active]
        length = min(ends)
        out.append(Phase(first, {i: done[i] for i in active}, within, size, length))
        for i in active:
            ran = length // size * len(within[i]) + int(np.searchsorted(within[i], length % size))
            left[i] -= ran
            done[i] += ran
        first += length
    return out


def slot_of(phases: list[Phase], source: int, block: np.ndarray) -> np.ndarray:
    """Slots of block numbers (from 0) of a source."""
    out = np.zeros(len(block), dtype=np.int64)
    for phase in phases:
        if source in phase.used:
            own, since = phase.within[source], block - phase.used[source]
            at = np.flatnonzero(since >= 0)
            out[at] = phase.first + since[at] // len(own) * phase.period + own[since[at] % len(own)]
    return out


class Fluid:
    """The ideal shares: source i runs at weights[i] of the weights of the sources that are not used up, until it has run blocks[i]."""

    def __init__(self, blocks: list[int], weights: list[float], scale: int = 1 << 60):
        total = sum(map(Fraction, weights)) or 1
        self.blocks, self.weights = blocks, [max(1, round(Fraction(w) / total * scale)) for w in weights]
        order = sorted(range(len(blocks)), key=lambda i: Fraction(blocks[i], self.weights[i]))
        self.ends = [Fraction(blocks[i], self.weights[i]) for i in order]
        self.done, self.rate = [0], [sum(self.weights)]
        for i in order:
            self.done.append(self.done[-1] + blocks[i])
            self.rate.append(self.rate[-1] - self.weights[i])

    def stretch(self, i: int, ran: int) -> int:
        """How many sources are used up before source i has run ``ran`` blocks."""
        return bisect_left(self.ends, Fraction(ran, self.weights[i]))

    def window(self, i: int, block: int, stretch: int) -> tuple[int, int, int]:
        """Release and deadline of a block (from 0) of source i, and the stretch of its end; ``stretch`` is that of its start."""
        w = self.weights[i]
        release = self.done[stretch] + self.rate[stretch] * block // w
        while self.ends[stretch].numerator * w < (block + 1) * self.ends[stretch].denominator:
            stretch += 1
        return release, self.done[stretch] - (-self.rate[stretch] * (block + 1) // w), stretch


def walk(fluid: Fluid, used: list[int], slot: int) -> Iterator[int]:
    """Which source runs in each slot from ``slot`` on, the earliest deadline first among released blocks; counts up ``used``."""
    waiting: list[tuple] = []
    ready: list[tuple] = []

    def follow(i: int, stretch: int) -> None:
        if used[i] < fluid.blocks[i]:
            release, deadline, stretch = fluid.window(i, used[i], stretch)
            heapq.heappush(waiting, (release, deadline, i, stretch))

    for i, n in enumerate(used):
        follow(i, fluid.stretch(i, n))
    while waiting or ready:
        while waiting and waiting[0][0] <= slot:
            heapq.heappush(ready, heapq.heappop(waiting)[1:])
        deadline, i, stretch = heapq.heappop(ready)
        if deadline <= slot:
            raise AssertionError("deadline missed")
        used[i] += 1
        follow(i, stretch)
        yield i
        slot += 1


def states(fluid: Fluid, cut: int) -> list[np.ndarray]:
    """Blocks of each source that ran before slots 0, cut, 2 * cut, ..."""
    used = [0] * len(fluid.blocks)
    out = []
    steps = walk(fluid, used, 0)
    for slot in range(sum(fluid.blocks)):
        if slot % cut == 0:
            out.append(np.array(used, dtype=np.int64))
        next(steps)
    return out


def interleave(
    docs: DataFrame, weights: dict[str | None, float] | None = None, settings: Settings = Settings(), also: tuple[str, ...] = ()
) -> DataFrame:
    """(doc_id, source[, also], block, slot, position) for every row: blocks of ``block_rows`` rows of one source, in slots.

    ``weights`` default to the square roots of the sources' sizes; a source without a weight gets the mean of the given
    ones, and sources without rows are ignored. A null source is a source of its own. Within a source, rows are in a
    fixed shuffled order; equal rows are interchangeable. Blocks are full but the last of a source. ``position`` rises
    with the slot. An empty table gives no rows.
    """
    rows = persist_table(docs.select("doc_id", "source", *also), "sources")
    counts = rows.groupBy("source").count().orderBy(F.col("source").asc_nulls_first()).collect()
    names, sizes = [r["source"] for r in counts], [r["count"] for r in counts]
    if weights is None:
        shares = [float(n) ** 0.5 for n in sizes]
    else:
        mean = sum(weights.values()) / len(weights)
        shares = [float(weights.get(name, mean)) for name in names]
    size, cut = settings.block_rows, max(settings.cut_slots, 8 * len(names))
    fluid = Fluid([-(-n // size) for n in sizes], shares)
    found = states(fluid, cut)
    plan = docs.sparkSession.sparkContext.broadcast((fluid, found, names))

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fluid, found, names = plan.value
        for batch in batches:
            for number in batch["id"].tolist():
                used = found[number].tolist()
                steps, ran, block = walk(fluid, used, number * cut), [], []
                for _, i in zip(range(cut), steps):
                    ran.append(i)
                    block.append(used[i] - 1)
                yield pd.DataFrame({"source": pd.Series([names[i] for i in ran], dtype=object), "block": block, "slot": np.arange(len(ran)) + number * cut})

    slots = docs.sparkSession.range(0, len(found), 1, max(1, len(found))).mapInPandas(replay, "source string, block long, slot long")
    slots = persist_table(slots, "slots").alias("s")
    ranked = rank_within(rows, ["source"], ["doc_id", *also], "_rank", "source-ranks").alias("r")
    block = F.floor(F.col("r._rank") / size)
    position = (F.col("s.slot") * size + F.col("r._rank") % size).alias("position")
    return ranked.join(slots, F.col("r.source").eqNullSafe(F.col("s.source")) & (block == F.col("s.block"))).select(
        F.col("r.doc_id").cast("long").alias("doc_id"), "r.source", *[f"r.{name}" for name in also], "s.block", "s.slot", position
    )


def positions(docs: DataFrame, weights: dict[str | None, float] | None = None, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, source, _mark, position): the first position of each distinct row, with a hash of its text as ``_mark``.

    The same rows get the same positions in whatever order they are read, as long as the shuffle width stays.
    """
    rows = docs.select("doc_id", "source", F.xxhash64("text").alias("_mark"))
    return interleave(rows, weights, settings, ("_mark",)).groupBy("doc_id", "source", "_mark").agg(F.min("position").alias("position"))


def in_order(docs: DataFrame, weights: dict[str | None, float] | None = None, settings: Settings = Settings()) -> DataFrame:
    """``docs`` with all columns, in the order of the schedule; a table that is written loses the order, ``positions`` finds it again."""
    placed = positions(docs, weights, settings).alias("p")
    rows, names = by_number(docs)
    same = F.col(names["doc_id"]).eqNullSafe(F.col("p.doc_id")) & F.col(names["source"]).eqNullSafe(F.col("p.source"))
    same = same & (F.xxhash64(names["text"]) == F.col("p._mark"))
    return rows.join(placed, same, "left").sort("p.position").select(*names.values()).toDF(*names)
