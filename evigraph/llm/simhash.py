"""SimHash near-duplicates, linked exactly through a vantage-point tree.

Equal fingerprints are one point. The upper tree is fitted on a bounded sample of points and cuts the
Hamming space into shards; every point lives in one shard and also visits the shards whose boundary it is
within the radius of (triangle inequality), so each close pair meets in exactly one shard whatever the sample.
Inside a shard a second tree prunes in the same way. A shard reports a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.llm import jaccard_join
from evigraph.llm.common import whole_text
from evigraph.llm.components import components
from evigraph.session import persist_table


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds the points that the upper tree is fitted on; it moves shard borders, never results."""

    shingle: int = 4
    radius: int = 4
    seed: int = 42
    shard_points: int = 4096
    least_shards: int = 64
    sample: int = 200_000
    leaf_points: int = 64


def text_fingerprint(text: str | None, shingle: int = 4, seed: int = 42, step: int = 1 << 15) -> int:
    """64 bits, unsigned; 0 for a text without words, the whole sequence is the one shingle of a shorter text."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(shingle, len(words))
    first, last = starts[: len(words) - size + 1], ends[size - 1 :]
    set_bits = np.zeros(64, dtype=np.int64)
    for at in range(0, len(first), step):
        parts = [joined[a:b] for a, b in zip(first[at : at + step].tolist(), last[at : at + step].tolist(), strict=True)]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(seed)), dtype=np.uint64, count=len(parts))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(set_bits * 2 > len(first), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, settings: Settings = Settings(), with_text: bool = False) -> DataFrame:
    """(doc_id, fp[, text_sha256]) with the fingerprint as a signed long; null text counts as empty."""
    shingle, seed = settings.shingle, settings.seed

    @F.pandas_udf("long")
    def fingerprint(texts: pd.Series) -> pd.Series:
        found = [text_fingerprint(t if isinstance(t, str) else None, shingle, seed) for t in texts]
        return pd.Series(np.array(found, dtype=np.uint64).view(np.int64))

    more = [F.unhex(F.sha2(whole_text("text").cast("binary"), 256)).alias("text_sha256")] if with_text else []
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint("text").alias("fp"), *more)


class VantageTree:
    """Inner nodes split their points by the distance to a vantage point; leaves are numbered from 0."""

    def __init__(self, points: np.ndarray, leaf_points: int, candidates: int = 24):
        self.nodes: list[tuple] = []
        self.leaves: list[np.ndarray] = []
        order = np.random.default_rng(7)
        self._build(points, np.arange(len(points)), leaf_points, candidates, order)

    def _build(self, points, at, leaf_points, candidates, order) -> int:
        here = len(self.nodes)
        self.nodes.append(())
        split = self._split(points, at, candidates, order) if len(at) > leaf_points else None
        if split is None:
            self.nodes[here] = ("leaf", len(self.leaves))
            self.leaves.append(at)
            return here
        vantage, border, near = split
        left = self._build(points, at[near], leaf_points, candidates, order)
        right = self._build(points, at[~near], leaf_points, candidates, order)
        self.nodes[here] = ("inner", vantage, border, left, right)
        return here

    @staticmethod
    def _split(points, at, candidates, order):
        own = points[at]
        tried = order.choice(own, min(candidates, len(own)), replace=False)
        probe = own if len(own) <= 1024 else order.choice(own, 1024, replace=False)
        spread = np.bitwise_count(tried[:, None] ^ probe[None, :]).astype(np.float32).var(axis=1)
        vantage = tried[int(spread.argmax())]
        distance = np.bitwise_count(own ^ vantage)
        sizes = np.cumsum(np.bincount(distance, minlength=65))
        border = int(np.abs(sizes - len(own) / 2).argmin())
        near = distance <= border
        return None if near.all() or not near.any() else (vantage, border, near)

    def home(self, queries: np.ndarray) -> np.ndarray:
        out = np.zeros(len(queries), dtype=np.int32)
        for leaf, at in self.visits(queries, 0):
            out[at] = leaf
        return out

    def visits(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, indices of the queries that may have points within ``radius`` there)."""
        waiting = [(0, np.arange(len(queries)))]
        while waiting:
            here, at = waiting.pop()
            node = self.nodes[here]
            if not len(at):
                continue
            if node[0] == "leaf":
                yield node[1], at
                continue
            _, vantage, border, left, right = node
            distance = np.bitwise_count(queries[at] ^ vantage).astype(np.int16)
            waiting.append((left, at[distance - radius <= border]))
            waiting.append((right, at[distance + radius > border]))


class Forest:
    """Union-find over numbered points, fed with arrays of links."""

    def __init__(self, size: int):
        self.parent = np.arange(size)

    def roots(self, at: np.ndarray) -> np.ndarray:
        found = self.parent[at]
        while not np.array_equal(found, up := self.parent[found]):
            found = up
        return found

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            ra, rb = self.roots(a), self.roots(b)
            apart = ra != rb
            if not apart.any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.parent, np.maximum(ra, rb), np.minimum(ra, rb))
            self.parent = self.parent[self.parent]


def shard_links(points: np.ndarray, at_home: np.ndarray, radius: int, leaf_points: int, cells: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as (point, root) values, of the pairs within ``radius`` that have at least one side at home."""
    home = np.flatnonzero(at_home)
    forest = Forest(len(points))
    if len(home):
        tree = VantageTree(points[home], leaf_points)
        for leaf, asking in tree.visits(points, radius):
            own = home[tree.leaves[leaf]]
            rows = max(1, cells // len(own))
            for start in range(0, len(asking), rows):
                part = asking[start : start + rows]
                close = np.bitwise_count(points[part][:, None] ^ points[own][None, :]) <= radius
                q, p = np.nonzero(close)
                forest.link(part[q], own[p])
    roots = forest.roots(np.arange(len(points)))
    moved = roots != np.arange(len(points))
    return points[moved], points[roots[moved]]


def links(unique: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(a, b): links between distinct fingerprints (table with column fp) that span every group within the radius."""
    spark = unique.sparkSession
    total = unique.count()
    wanted = max(settings.least_shards, -(-total // settings.shard_points))
    size = min(settings.sample, max(20_000, 16 * wanted))
    chosen = unique.orderBy(F.xxhash64("fp"), "fp").limit(size).toPandas()["fp"].to_numpy(dtype=np.int64).view(np.uint64)
    tree = spark.sparkContext.broadcast(VantageTree(chosen, max(2, len(chosen) // wanted)) if len(chosen) else None)
    radius, leaf_points = settings.radius, settings.leaf_points

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            points = batch["fp"].to_numpy(dtype=np.int64).view(np.uint64)
            home = tree.value.home(points)
            for shard, at in tree.value.visits(points, radius):
                own = home[at] == shard
                # of two shards that a pair could meet in, the lower or the higher one, by turns
                asks = own | ((home[at] < shard) != ((home[at] + shard) % 2 == 1))
                yield pd.DataFrame({"shard": np.int32(shard), "fp": points[at[asks]].view(np.int64), "home": own[asks]})

    def match(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = shard_links(rows["fp"].to_numpy(dtype=np.int64).view(np.uint64), rows["home"].to_numpy(dtype=bool), radius, leaf_points)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    routed = unique.select("fp").mapInPandas(route, "shard int, fp long, home boolean")
    return routed.groupBy("shard").applyInPandas(match, "a long, b long")


def near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of ``docs``.

    Documents are linked when their fingerprints differ in at most ``radius`` bits; component_id is the smallest doc_id
    reachable. Null and empty texts have fingerprint zero and are linked like any other. Null ids never name a component
    unless it has no other. Repeated rows are rows of one component. An empty table gives no rows.
    """
    marked = persist_table(fingerprints(docs, settings), "fingerprints")
    points = persist_table(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "points")
    roots = components(persist_table(links(points, settings), "near"))
    linked = roots.select(F.col("node").alias("fp"), "root").union(roots.select(F.col("root").alias("fp"), "root").distinct())
    members = persist_table(points.join(linked, "fp", "left").filter("root IS NOT NULL OR n > 1").select("fp", F.coalesce("root", "fp").alias("root"), "first"), "members")
    firsts = persist_table(members.groupBy("root").agg(F.min("first").alias("component_id")), "firsts")
    named = persist_table(members.join(firsts, "root").select("fp", "component_id", F.lit(True).alias("_in")), "named")
    return marked.join(named, "fp", "left").select(
        "doc_id", hex_fingerprint(F.col("fp")).alias("fingerprint"), F.when(F.col("_in"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


#: Near copies are guessed by the fingerprints of their runs of five words.
NEAR_COPIES = Settings(shingle=5)


def close_pairs(docs: DataFrame, points: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(a, b): points that join every group whose fingerprints are linked; ``points`` (point, text_sha256) names the texts of each.

    Every row of ``docs`` gets its fingerprint and every distinct fingerprint is in the tree, also those of texts that are of no
    point. Points are joined along the links of their fingerprints and, as a link may lead to a fingerprint without a point, to the
    least point of those that are linked to the same one. Points of one fingerprint are joined to the least of them, which stands for them.
    """
    prints = persist_table(fingerprints(docs, settings, True).select("fp", "text_sha256").distinct(), "fingerprints")
    near = persist_table(links(persist_table(prints.select("fp").distinct(), "distinct-fingerprints"), settings), "fingerprint-links")
    named = persist_table(points.join(prints, "text_sha256").select("point", "fp").distinct(), "point-fingerprints")
    centres = persist_table(named.groupBy("fp").agg(F.min("point").alias("centre")), "centres")
    equal = named.join(centres, "fp").filter("point <> centre").select(F.col("centre").alias("a"), F.col("point").alias("b"))
    side = lambda fp, point: centres.select(F.col("fp").alias(fp), F.col("centre").alias(point))
    along = near.withColumnsRenamed({"a": "fa", "b": "fb"}).join(side("fa", "x"), "fa").join(side("fb", "y"), "fb").select("x", "y")
    ends = near.select(F.col("a").alias("fp"), F.col("b").alias("root")).union(near.select("b", "b")).distinct()
    grouped = persist_table(ends.join(centres, "fp").select("root", F.col("centre").alias("y")), "fingerprint-groups")
    over = grouped.groupBy("root").agg(F.min("y").alias("x")).join(grouped, "root").select("x", "y")
    found = along.union(over).filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return persist_table(equal.union(found).distinct(), "close")


def one_of_each(docs: DataFrame, settings: Settings = NEAR_COPIES) -> DataFrame:
    """``docs`` with the row of the smallest doc_id of each group of near copies.

    Fingerprints of all texts link through the tree first, and these links are verified on the whole sets of runs. At a similarity of 0.8
    fingerprints differ in some ten bits, so what they miss is looked for among the sets that they have not joined.
    """
    return jaccard_join.one_of_each(docs, close=lambda points: close_pairs(docs, points, settings))
