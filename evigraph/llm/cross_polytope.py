"""Approximate nearest neighbours by cross-polytope hashing.

Three rounds of random signs and a fast Hadamard transform turn a unit vector; its hash is the nearest signed axis.
A table joins the axes of several such rotations to one code, a query probes the codes that are nearest to its own in
every table (codes and what they meet stay packed, a row per query, table and part of a table), and the candidates are ranked by exact distance. Equal vectors are one point with the smallest ids that
any answer can need, so a vector that many rows share costs no more than one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evigraph.llm.common import tasks_for
from evigraph.session import persist_table


@dataclass(frozen=True)
class Settings:
    """How points are coded; rotations and probes follow from the data.

    For ``sample`` queries the nearest points are found by all distances. With ``tables`` tables, a half, a quarter and an eighth
    of them, and each number of rotations that fits the rows (a bucket of ``bucket_rows`` asks for one more), probes are raised from ``probes`` until the tables meet the share ``recall`` of
    them. Of these plans the cheapest is taken: a candidate, which is joined, collected and measured, costs ``candidate_cost``
    times as much as a probed code, and candidates are estimated from ``points`` points. Fewer tables are tried for the best number
    of rotations only, and as long as that is cheaper.
    """

    tables: int = 96
    bucket_rows: int = 64
    probes: tuple[int, ...] = (1, 1, 1)
    seed: int = 11
    shard_rows: int = 4096
    probe_rows: int = 200_000
    part_rows: int = 1 << 20
    sample: int = 128
    points: int = 2048
    recall: float = 0.97
    candidate_cost: float = 16.0

    def rotations(self, rows: int, dimension: int) -> list[int]:
        """The numbers of rotations to choose from."""
        axes, k, smallest = 2 * dimension, 1, self.bucket_rows
        while rows > smallest * axes and k < len(self.probes):
            k, smallest = k + 1, smallest * axes
        return list(range(k, min(k + 1, len(self.probes)) + 1))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Rows times the normalised Hadamard matrix, by butterflies; their length is a power of two."""
    n, half = x.shape[1], 1
    x = np.ascontiguousarray(x.T) / np.sqrt(n)
    while half < n:
        pairs = x.reshape(-1, 2, half, x.shape[1])
        low, high = pairs[:, 0] + pairs[:, 1], pairs[:, 0] - pairs[:, 1]
        pairs[:, 0], pairs[:, 1] = low, high
        half *= 2
    return np.ascontiguousarray(x.T)


def rotated(vectors: np.ndarray, table: int, rotation: int, seed: int) -> np.ndarray:
    """Pseudo-randomly turned unit vectors, padded with zeros to a power of two."""
    width = 1 << max(0, vectors.shape[1] - 1).bit_length()
    y = np.zeros((len(vectors), width))
    y[:, : vectors.shape[1]] = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    rng = np.random.default_rng([seed, table, rotation])
    for _ in range(3):
        y = hadamard(y * rng.choice([-1.0, 1.0], width))
    return y


def ranked_axes(y: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest ``most`` signed axes of each row (numbered below 2 * width) and how much farther than the nearest they are."""
    signed = np.concatenate([y, -y], axis=1)
    most = min(most, signed.shape[1])
    axes = np.argpartition(-signed, most - 1, axis=1)[:, :most]
    value = np.take_along_axis(signed, axes, axis=1)
    order = np.argsort(-value, axis=1, kind="stable")
    axes, value = np.take_along_axis(axes, order, axis=1), np.take_along_axis(value, order, axis=1)
    return axes, value[:, :1] - value


@lru_cache(maxsize=64)
def _pairs(rows: int, columns: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of two ascending lists whose sums can be among the ``most`` smallest: (i + 1) * (j + 1) sums are no larger."""
    wide = [min(columns, most // (i + 1)) for i in range(min(rows, most))]
    return np.repeat(np.arange(len(wide)), wide), np.concatenate([np.arange(n) for n in wide])


def nearest_codes(turned: list[np.ndarray], probes: int) -> np.ndarray:
    """The ``probes`` codes nearest to each vector, its own first, from its rotations in a table."""
    kept, cost = np.zeros((len(turned[0]), 1), dtype=np.int64), np.zeros((len(turned[0]), 1))
    for y in turned:
        axes, farther = ranked_axes(y, probes)
        i, j = _pairs(kept.shape[1], axes.shape[1], probes)
        kept = kept[:, i] * (2 * y.shape[1]) + axes[:, j]
        cost = cost[:, i] + farther[:, j] ** 2
        if kept.shape[1] > probes:
            best = np.argpartition(cost, probes - 1, axis=1)[:, :probes]
            kept, cost = np.take_along_axis(kept, best, axis=1), np.take_along_axis(cost, best, axis=1)
        order = np.argsort(cost, axis=1, kind="stable")
        kept, cost = np.take_along_axis(kept, order, axis=1), np.take_along_axis(cost, order, axis=1)
    return kept


def codes(vectors: np.ndarray, table: int, rotations: int, probes: int, seed: int) -> np.ndarray:
    """The ``probes`` codes of a table nearest to each vector, its own first."""
    return nearest_codes([rotated(vectors, table, rotation, seed) for rotation in range(rotations)], probes)


class Trial:
    """Some queries, turned once in every table, and the axes of the points that they are tried on."""

    def __init__(self, queries: np.ndarray, tried: np.ndarray, rotations: int, settings: Settings):
        self.count, self.tables = len(queries), settings.tables
        self.turned, self.axes = [], []
        both = np.concatenate([queries, tried])
        for table in range(settings.tables):
            ys = [rotated(both, table, rotation, settings.seed) for rotation in range(rotations)]
            self.turned.append([y[: self.count].astype(np.float32) for y in ys])
            self.axes.append([ranked_axes(y[self.count :], 1)[0][:, 0] for y in ys])
        self.width = 2 * ys[0].shape[1]

    def own(self, table: int, rotations: int) -> np.ndarray:
        code = np.zeros(len(self.axes[table][0]), dtype=np.int64)
        for axes in self.axes[table][:rotations]:
            code = code * self.width + axes
        return code

    def probed(self, table: int, rotations: int, probes: int) -> Iterator[tuple[slice, np.ndarray]]:
        """(some of the queries, their nearest codes), a few queries at a time."""
        step = max(1, (1 << 17) // probes)
        for at in range(0, self.count, step):
            some = slice(at, min(self.count, at + step))
            yield some, nearest_codes([y[some] for y in self.turned[table][:rotations]], probes)

    def probes_for(self, near: slice, of: np.ndarray, tables: int, rotations: int, least: int, recall: float, most_probed: float = math.inf) -> int | None:
        """Probes, at least ``least``, by which the share ``recall`` of the points ``near`` is met by the queries numbered ``of``.

        None if these would be more than ``most_probed`` in all tables.
        """
        every = self.width**rotations
        most = min(every, max(64, least))
        while True:
            rank = np.full(len(of), every)
            for table in range(tables):
                own = self.own(table, rotations)[near]
                for some, probed in self.probed(table, rotations, most):
                    pairs = np.flatnonzero((of >= some.start) & (of < some.stop))
                    hit = probed[of[pairs] - some.start] == own[pairs, None]
                    rank[pairs] = np.minimum(rank[pairs], np.where(hit.any(axis=1), hit.argmax(axis=1), every))
            needed = int(np.sort(rank)[max(0, int(np.ceil(recall * len(rank))) - 1)]) + 1
            if needed <= most or most == every:
                return min(every, max(least, needed))
            if tables * most > most_probed:
                return None
            most = min(every, 4 * most)

    def candidates_for(self, points: slice, tables: int, rotations: int, probes: int) -> float:
        """The mean over the queries of how many of the points share a probed code, a point counted once a table."""
        met = 0
        for table in range(tables):
            own = np.sort(self.own(table, rotations)[points])
            for _, probed in self.probed(table, rotations, probes):
                met += int((np.searchsorted(own, probed, "right") - np.searchsorted(own, probed, "left")).sum())
        return met / self.count


def probes_for(queries: np.ndarray, near: np.ndarray, of: np.ndarray, rotations: int, least: int, settings: Settings) -> int:
    """Probes, at least ``least``, by which the share ``recall`` of vectors ``near`` is met by the queries numbered ``of``."""
    return Trial(queries, near, rotations, settings).probes_for(slice(None), of, settings.tables, rotations, least, settings.recall)


def cheapest(queries: np.ndarray, near: np.ndarray, of: np.ndarray, points: np.ndarray, total: int, settings: Settings) -> tuple[int, int, int]:
    """Tables, rotations and probes of the cheapest plan; ``near`` are the nearest of the queries numbered ``of``, ``points`` some of all."""
    choice = settings.rotations(total, queries.shape[1])
    trial = Trial(queries, np.concatenate([near, points]), max(choice), settings)
    cost, plan = math.inf, (settings.tables, choice[0], 1)
    for tables in (max(1, settings.tables >> i) for i in range(4)):
        found = []
        for rotations in choice:
            # a plan that probes more than the best one costs in all is not followed further
            probes = trial.probes_for(slice(0, len(near)), of, tables, rotations, settings.probes[rotations - 1], settings.recall, cost)
            if probes is not None:
                met = trial.candidates_for(slice(len(near), None), tables, rotations, probes) * total / len(points)
                found.append((settings.candidate_cost * met + tables * probes, (tables, rotations, probes)))
        if not found or min(found)[0] >= cost:
            break
        cost, plan = min(found)
        choice = [plan[1]]
    return plan


def _part(code: np.ndarray, parts: int) -> np.ndarray:
    """The part of a table that a code belongs to."""
    return (code * 0x9E3779B97F4A7C1 >> 24) % parts


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def usable(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, embedding) whose vector is finite and not zero, each once."""
    limit = float("inf")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit))
    return vectors.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda x: x != 0)).distinct()


ANSWER = "query_id long, rank int, vec_id long, score double"


def nearest(vectors: DataFrame, neighbours: int = 10, settings: Settings = Settings(), query_step: int = 100) -> DataFrame:
    """(query_id, rank, vec_id, score): for ids divisible by ``query_step`` the nearest other ids by Euclidean distance.

    Queries for which the tables give fewer ids are compared with all points, so fewer rows mean that there are no more ids.
    Vectors that are null, zero, or hold null or non-finite components take no part, nor do null ids. Vectors of one length are
    searched among themselves. Repeated rows count once; an id with several vectors is as near as its nearest. Ties go to the
    smaller id. Only vec_id and embedding are read, so other columns cannot clash. An empty table gives no rows.
    """
    rows = persist_table(usable(vectors), "vectors")
    length = F.size("embedding")
    sizes = sorted(r["n"] for r in rows.select(length.alias("n")).distinct().collect())
    found = [_nearest_of_length(rows.filter(length == n), neighbours, settings, query_step) for n in sizes]
    return reduce(DataFrame.unionByName, found) if found else vectors.sparkSession.createDataFrame([], ANSWER)


def _nearest_of_length(rows: DataFrame, neighbours: int, settings: Settings, query_step: int) -> DataFrame:
    spark = rows.sparkSession
    wanted = neighbours + 1
    numbered = rows.withColumn("_n", F.row_number().over(W.partitionBy("embedding").orderBy("vec_id"))).filter(F.col("_n") <= wanted)
    points = persist_table(numbered.groupBy("embedding").agg(F.min("vec_id").alias("point"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "points")
    asked = rows.filter(F.col("vec_id") % query_step == 0).join(points.select("embedding", "point"), "embedding")
    queries = persist_table(asked.select(F.col("vec_id").alias("query_id"), "point", "embedding"), "queries")

    total = points.count()
    seed = settings.seed

    def coded(tables: int, rotations: int, parts: int):
        """The points of a batch, packed by table and part of the codes."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for at in range(0, len(batch), 512):
                    some = batch.iloc[at : at + 512]
                    matrix, names, shards = _matrix(some["embedding"]), some["point"].to_numpy(dtype=np.int64), some["shard"].to_numpy(dtype=np.int32)
                    for table in range(tables):
                        code = codes(matrix, table, rotations, 1, seed)[:, 0]
                        part = _part(code, parts)
                        own = [part == p for p in np.unique(part)]
                        yield pd.DataFrame({
                            "table": np.int32(table), "part": np.unique(part).astype(np.int32), "codes": [code[o] for o in own],
                            "points": [names[o] for o in own], "shards": [shards[o] for o in own],
                        })

        return run

    def probed(tables: int, rotations: int, probe: int, parts: int):
        """The codes that a query probes, packed by table and part."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for at in range(0, len(batch), 512):
                    some = batch.iloc[at : at + 512]
                    matrix, names = _matrix(some["embedding"]), some["query"].tolist()
                    for table in range(tables):
                        found = codes(matrix, table, rotations, probe, seed)
                        part = _part(found, parts)
                        rows = [(table, p, q, row[own == p]) for q, row, own in zip(names, found, part, strict=True) for p in np.unique(own).tolist()]
                        yield pd.DataFrame(rows, columns=["table", "part", "query", "codes"])

        return run

    def meet(index: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        """The points of a part of a table whose code a query probes, a row per query."""
        rows = []
        if len(index) and len(asked):
            code = np.concatenate(index["codes"].tolist())
            order = np.argsort(code, kind="stable")
            code, names, shards = code[order], np.concatenate(index["points"].tolist())[order], np.concatenate(index["shards"].tolist())[order]
            for query, wanted in zip(asked["query"].tolist(), asked["codes"], strict=True):
                low, high = np.searchsorted(code, wanted, "left"), np.searchsorted(code, wanted, "right")
                size = high - low
                if size.any():
                    at = np.arange(int(size.sum())) + np.repeat(low - (np.cumsum(size) - size), size)
                    rows.append((query, names[at], shards[at]))
        return pd.DataFrame(rows, columns=["query", "points", "shards"])

    def gathered(group: pd.DataFrame) -> pd.DataFrame:
        """Each query's points of all tables, once, packed by shard."""
        rows = []
        for query, own in group.groupby("query"):
            names, first = np.unique(np.concatenate(own["points"].tolist()), return_index=True)
            at = np.concatenate(own["shards"].tolist())[first]
            rows.extend((shard, query, names[at == shard]) for shard in np.unique(at).tolist())
        return pd.DataFrame(rows, columns=["shard", "query", "found"])

    distinct_queries = queries.select(F.col("point").alias("query"), "embedding").distinct()
    shards = tasks_for(spark, total, settings.shard_rows)
    shard = F.pmod(F.xxhash64("point"), F.lit(shards)).cast("int").alias("shard")
    # points and queries of a shard come as one table; an id is never null, which would make a column of ids inexact
    own = points.select(shard, F.lit(True).alias("is_point"), F.col("point").alias("id"), F.lit(None).cast("array<long>").alias("found"), "embedding")

    def rerank(group: pd.DataFrame) -> pd.DataFrame:
        is_point = group["is_point"].to_numpy(dtype=bool)
        base, queries = group[is_point], group[~is_point]
        out = [pd.DataFrame({"query": np.zeros(0, dtype=np.int64), "point": np.zeros(0, dtype=np.int64), "score": np.zeros(0)})]
        if len(queries) and len(base):
            names = base["id"].to_numpy(dtype=np.int64)
            order = np.argsort(names)
            names, matrix = names[order], _matrix(base["embedding"])[order]
            for query, found, vector in zip(queries["id"].tolist(), queries["found"], queries["embedding"], strict=True):
                at = np.arange(len(names)) if found is None else np.searchsorted(names, np.sort(np.asarray(found, dtype=np.int64)))
                score = np.sqrt(((matrix[at] - np.asarray(vector, dtype=np.float64)) ** 2).sum(axis=1))
                best = np.lexsort((names[at], score))[:wanted]
                out.append(pd.DataFrame({"query": np.full(len(best), query, dtype=np.int64), "point": names[at[best]], "score": score[best]}))
        return pd.concat(out)

    def everywhere(some: DataFrame) -> DataFrame:
        """Each query at every shard: all distances, in blocks."""
        every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
        return some.select(every, F.lit(False).alias("is_point"), F.col("query").alias("id"), F.lit(None).cast("array<long>").alias("found"), "embedding")

    def ranked(asking: DataFrame) -> DataFrame:
        return asking.unionByName(own).groupBy("shard").applyInPandas(rerank, "query long, point long, score double")

    sample = persist_table(distinct_queries.orderBy(F.xxhash64("query", F.lit(seed)), "query").limit(settings.sample), "sample")
    nearby = W.partitionBy("query").orderBy("score", "point")
    true = ranked(everywhere(sample)).filter("query <> point").withColumn("_n", F.row_number().over(nearby)).filter(F.col("_n") <= neighbours)
    pairs = true.join(points.select("point", "embedding"), "point").join(sample.select("query", F.col("embedding").alias("asked")), "query").toPandas()
    tables, rotations, probes = settings.tables, settings.rotations(total, 1)[0], 1
    if len(pairs):
        firsts = pairs.drop_duplicates("query").reset_index(drop=True)
        of = pairs["query"].map({q: i for i, q in enumerate(firsts["query"])}).to_numpy()
        some = points.select("point", "embedding").orderBy(F.xxhash64("point", F.lit(seed + 1)), "point").limit(settings.points).toPandas()
        tables, rotations, probes = cheapest(_matrix(firsts["asked"]), _matrix(pairs["embedding"]), of, _matrix(some["embedding"]), total, settings)

    asked_count = distinct_queries.count()
    # a part of a table is one task: it holds ``part_rows`` points and probed codes at most, but for chance
    parts = max(1, math.ceil(max(total, asked_count * probes) / settings.part_rows))
    index = points.select(shard, "point", "embedding").mapInPandas(
        coded(tables, rotations, parts), "table int, part int, codes array<long>, points array<long>, shards array<int>"
    )
    # as many tasks as the probed codes need: a task makes about ``probe_rows`` of them
    asked_tasks = max(1, math.ceil(asked_count * tables * probes / settings.probe_rows))
    probing = distinct_queries.repartition(asked_tasks).mapInPandas(probed(tables, rotations, probes, parts), "table int, part int, query long, codes array<long>")
    met = index.groupBy("table", "part").cogroup(probing.groupBy("table", "part")).applyInPandas(meet, "query long, points array<long>, shards array<int>")
    some = F.pmod(F.xxhash64("query"), F.lit(tasks_for(spark, asked_count, 64))).alias("_some")
    packed = persist_table(met.withColumn("_some", some).groupBy("_some").applyInPandas(gathered, "shard int, query long, found array<long>"), "candidates")
    asking = packed.join(distinct_queries, "query").select("shard", F.lit(False).alias("is_point"), F.col("query").alias("id"), "found", "embedding")
    local = ranked(asking)
    by_score = W.partitionBy("query").orderBy("score", "vec_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))

    def best_of(local: DataFrame) -> DataFrame:
        named = local.join(points.select("point", "ids"), "point").select("query", "score", F.explode("ids").alias("vec_id"))
        return persist_table(named.withColumn("_n", F.row_number().over(by_score)).filter(F.col("_n") <= wanted), "nearest")

    def answers(best: DataFrame) -> DataFrame:
        found = queries.select("query_id", "point").join(best, F.col("point") == F.col("query")).filter("vec_id <> query_id")
        closest = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        return closest.withColumn("rank", rank).filter(F.col("rank") <= neighbours).select("query_id", "rank", "vec_id", "score")

    best = best_of(local)
    full = answers(best).groupBy("query_id").count().filter(F.col("count") >= neighbours)
    short = persist_table(queries.join(full, "query_id", "left_anti").select(F.col("point").alias("query"), "embedding").distinct(), "short")
    if short.isEmpty():
        return answers(best)
    exact = best_of(ranked(everywhere(short)))
    return answers(best.join(short.select("query"), "query", "left_anti").unionByName(exact))
