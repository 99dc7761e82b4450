"""Packing pieces into sequences: exact complements first, best fit for the rest.

The plan is made on the counts per length, of which there are at most ``capacity``. Lengths are taken from the
longest down; single lengths, pairs and triples whose sum is exactly the gap are consumed as often as the counts
allow, and what finds no exact complement is filled by the largest length that fits. Documents then find their
place by (length, rank within the length), so no task sees the pieces of a sequence or of a length together.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.functions.scan import ordered_scan, running_sum
from evigraph.llm.common import rank_within
from evigraph.llm.encode import encoder
from evigraph.session import persist_table


class Stock:
    """Counts per length with an index of the sums that two lengths can make."""

    def __init__(self, counts: np.ndarray):
        self.left = counts.astype(np.int64).copy()
        self.size = len(counts)
        self.pairs = np.zeros(2 * self.size, dtype=np.int32)
        self.there = np.zeros(self.size, dtype=bool)
        for length in np.flatnonzero(self.left):
            self._show(int(length))

    def _show(self, length: int) -> None:
        self.there[length] = True
        self.pairs[length + np.flatnonzero(self.there)] += 1

    def take(self, lengths: Counter, times: int) -> None:
        for length, n in lengths.items():
            self.left[length] -= n * times
            if not self.left[length]:
                self.pairs[length + np.flatnonzero(self.there)] -= 1
                self.there[length] = False

    def holds(self, lengths: Counter) -> bool:
        return all(self.left[length] >= n for length, n in lengths.items())

    def single(self, gap: int, used: Counter) -> list[int] | None:
        return [gap] if self.there[gap] and self.holds(used + Counter([gap])) else None

    def pair(self, gap: int, used: Counter) -> list[int] | None:
        if gap < 2 or not self.pairs[gap]:
            return None
        larger = np.arange(gap - 1, (gap - 1) // 2, -1)
        for a in larger[self.there[larger] & self.there[gap - larger]].tolist():
            if self.holds(used + Counter([a, gap - a])):
                return [a, gap - a]
        return None

    def triple(self, gap: int, used: Counter) -> list[int] | None:
        if gap < 3:
            return None
        first = np.arange(gap - 2, (gap + 2) // 3 - 1, -1)
        for a in first[self.there[first] & (self.pairs[gap - first] > 0)].tolist():
            rest = self.pair(gap - a, used + Counter([a]))
            if rest and rest[0] <= a:
                return [a, *rest]
        return None

    def largest(self, most: int, used: Counter) -> int | None:
        for length in np.flatnonzero(self.there[: most + 1])[::-1].tolist():
            if self.left[length] > used[length]:
                return length
        return None


def plan_sequences(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """[(lengths of a sequence, how many such sequences)] that use up ``counts`` (by length, 1 to capacity)."""
    stock, out = Stock(counts), []
    while (longest := stock.largest(capacity, Counter())) is not None:
        chosen, gap = [longest], capacity - longest
        while gap:
            used = Counter(chosen)
            exact = stock.single(gap, used) or stock.pair(gap, used) or stock.triple(gap, used)
            if exact:
                chosen += exact
                break
            best = stock.largest(gap, used)
            if best is None:
                break
            chosen.append(best)
            gap -= best
        lengths = Counter(chosen)
        times = min(int(stock.left[length]) // n for length, n in lengths.items())
        stock.take(lengths, times)
        out.append((chosen, times))
    return out


@dataclass(frozen=True)
class Places:
    """For each length, runs of ranks and where they go; sorted by (length, first rank)."""

    key: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (length.astype(np.int64) << 44) | rank.astype(np.int64)
        at = np.searchsorted(self.key, key, side="right") - 1
        return self.sequence[at] + (key - self.key[at]), self.offset[at]


def places(plan: list[tuple[list[int], int]]) -> Places:
    used, first, rows = Counter(), 0, []
    for lengths, times in plan:
        offset = 0
        for length in lengths:
            rows.append(((length << 44) | used[length], first, offset))
            used[length] += times
            offset += length
        first += times
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 3)
    return Places(table[:, 0], table[:, 1], table[:, 2])


def token_pieces(
    docs: DataFrame, tokenizer: str, capacity: int, end_id: int, spaced: bool = False, with_ids: bool = False, keep: tuple[str, ...] = ()
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids][, keep]) of the ids of each text and ``end_id``, cut at every ``capacity`` ids.

    Null text counts as empty: one piece with the end id alone. Columns named in ``keep`` stand on every piece.
    """

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keep)
    names = ["doc_id", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            piece, start, length, crc, ids, row = [], [], [], [], [], []
            for at_row, text in enumerate(batch.column("text")):
                data = encoder(tokenizer, spaced).encode(text.as_py() or "") + end
                for number, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    row.append(at_row)
                    piece.append(number)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, dtype="<u4").astype(np.int64))
            of = pa.array(row, pa.int64())
            longs = [pa.array(x, pa.int64()) for x in (start, length, crc)]
            own = [batch.column(name).take(of) for name in names]
            more = [pa.array(ids, pa.list_(pa.int64()))] if with_ids else []
            yield pa.RecordBatch.from_arrays([own[0], pa.array(piece, pa.int32()), *longs, *more, *own[1:]], [f.split()[0].strip("`") for f in schema.split(", ")])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    schema += "".join(f", `{name}` {rows.schema[name].dataType.simpleString()}" for name in keep)
    return rows.mapInArrow(run, schema)


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to a table of pieces (doc_id, piece, start, length, ids_crc32, ...).

    Lengths lie between 1 and ``capacity``. Which of two pieces of one length goes where is decided by a hash of their ids;
    pieces that agree in everything are interchangeable. The counts of at most ``capacity`` lengths are all the driver sees,
    and the plan it sends out has at most a few rows per length.
    """
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in pieces.groupBy("length").count().collect():
        counts[row["length"]] = row["count"]
    found = pieces.sparkSession.sparkContext.broadcast(places(plan_sequences(counts, capacity)))
    ranked = rank_within(pieces, ["length"], ["doc_id", "piece", "ids_crc32"], "_rank", "length-ranks")

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = found.value.find(length.to_numpy(), rank.to_numpy())
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    return ranked.select(*pieces.columns, place("length", "_rank").alias("_place")).select(*pieces.columns, "_place.*")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their places; an empty table gives no rows. Null and repeated ids are kept as they are."""
    return pack(persist_table(token_pieces(docs, tokenizer, capacity, end_id, with_ids=with_ids), "pieces"), capacity)


def pack_window(pieces: pa.Table, capacity: int) -> pa.Table:
    """Adds ``_sequence`` and offset to the pieces of a window, sequences numbered from 0 by the first position in them."""
    pieces = pieces.sort_by([(name, "ascending") for name in ("position", "_mark", "piece", "ids_crc32")])
    length = pieces.column("length").to_numpy()
    plan = plan_sequences(np.bincount(length, minlength=capacity + 1), capacity)
    order = np.argsort(length, kind="stable")
    group = np.searchsorted(length[order], length[order], side="left")
    rank = np.empty(len(length), dtype=np.int64)
    rank[order] = np.arange(len(length)) - group
    sequence, offset = places(plan).find(length, rank)
    _, first, number = np.unique(sequence, return_index=True, return_inverse=True)
    return pieces.append_column("_sequence", pa.array(np.argsort(np.argsort(first))[number])).append_column("offset", pa.array(offset))


def pack_in_order(docs: DataFrame, positions: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, window: int = 8192) -> DataFrame:
    """Like ``pack_documents``, in the order of ``positions`` (doc_id, source, _mark, position; see ``pfair_mix.positions``).

    Positions are cut into windows of ``window``. A window is packed on its own and its sequences come before those of
    later windows, so a run of sequences holds the sources in the shares that the schedule gives to its positions. A task
    sees the lengths of the pieces of a window, never their texts.
    """
    marked = docs.select("doc_id", "text", "source", F.xxhash64("text").alias("_mark"))
    pieces = persist_table(token_pieces(marked, tokenizer, capacity, end_id, keep=("source", "_mark")), "pieces").alias("d")
    p = positions.alias("p")
    same = F.lit(True)
    for key in ("doc_id", "source", "_mark"):
        same = same & F.col(f"d.{key}").eqNullSafe(F.col(f"p.{key}"))
    dealt = pieces.join(p, same).select("d.*", "p.position", F.floor(F.col("p.position") / window).alias("_window")).drop("source")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)
    packed = persist_table(
        dealt.groupBy("_window").applyInArrow(lambda rows: pack_window(rows, capacity), f"{fields}, _sequence long, offset long"), "windows"
    )
    sizes = packed.groupBy("_window").agg((F.max("_sequence") + 1).alias("_n"))
    ends = ordered_scan(sizes, [], [F.col("_window")], {"_end": running_sum(F.col("_n"))})
    starts = persist_table(ends.select("_window", (F.col("_end") - F.col("_n")).alias("_start")), "window-starts")
    number = (F.col("_start") + F.col("_sequence")).alias("sequence_id")
    return packed.join(starts, "_window").select("doc_id", "piece", "start", "length", "ids_crc32", number, "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) from packed pieces with ids; a sequence is bounded by its capacity."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))
