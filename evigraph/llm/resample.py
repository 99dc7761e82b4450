"""Importance resampling towards a target: documents scored from arrays, then ranked by parallel sorting with regular samples.

Features are hashed runs of words. A bucket's gain is the logarithm of how much likelier the target is to use it than the
documents are; a document's weight is the mean of its gains, and Gumbel noise from its id turns the highest scores into a
weighted draw without replacement. Ranks come from sorted runs: each run gives samples at regular distances, the sorted
samples give splitters, counts between splitters give every segment its first rank, and only segments with ranks that are drawn
are exchanged and merged. A segment holds at most twice the mean, whatever the scores are, as ties are told apart by the row.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.functions.scan import ordered_scan, row_no
from evigraph.session import persist_table


@dataclass(frozen=True)
class Settings:
    """Features are runs of ``shortest`` to ``longest`` words; ``percent`` of the documents with ``least_words`` words are drawn.

    ``run_rows`` is about the size of a sorted run and of a segment.
    """

    shortest: int = 1
    longest: int = 1
    buckets: int = 10_000
    least_words: int = 20
    percent: int = 10
    seed: int = 2024
    run_rows: int = 1_000_000


#: Bytes of words as they are, A-Z lower-cased, anything else a space.
WORD_BYTES = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))

SCORED = "doc_id long, n_words long, n_features long, weight long, score long"


def features(text: str | None, settings: Settings = Settings()) -> tuple[int, np.ndarray]:
    """Number of words, and the bucket of each feature, repeats included; a null text has none."""
    words = text.encode("utf-8", "replace").translate(WORD_BYTES).split() if text else []
    runs = list(words) if settings.shortest <= 1 else []
    for size in range(max(2, settings.shortest), settings.longest + 1):
        runs += [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]
    return len(words), np.fromiter(map(zlib.crc32, runs), dtype=np.int64, count=len(runs)) % settings.buckets


def bucket_counts(texts: DataFrame, settings: Settings = Settings()) -> np.ndarray:
    """Features per bucket over all rows: an array of the fixed length ``buckets``, summed up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(settings.buckets, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0):
                found += np.bincount(features(text.as_py(), settings)[1], minlength=settings.buckets)
        used = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(found[used])], ["bucket", "n"])

    rows = texts.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(settings.buckets, dtype=np.int64)
    for row in rows:
        counts[row["bucket"]] = row["n"]
    return counts


def gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of the smoothed ratio of target to documents, floored, by bucket."""
    size, s_all, t_all = len(documents), float(documents.sum()), float(target.sum())
    ratios = ((t + 1.0) * (s_all + size) / ((s + 1.0) * (t_all + size)) for s, t in zip(documents.tolist(), target.tolist(), strict=True))
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], dtype=np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Thousandths of a Gumbel variate, floored, from 32 bits of the hash of the id; a null id counts as the empty text."""
    h = int.from_bytes(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()[:4], "big")
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score), one row per row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words, found = features(text.as_py(), settings)
                weight = int(shared.value[found].sum()) // len(found) if len(found) else 0
                out.append((words, len(found), weight, weight + noise(doc, settings.seed)))
            columns = np.array(out, dtype=np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], ["doc_id", "n_words", "n_features", "weight", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCORED)


KEY_BYTES = 33


def sort_keys(rows: pa.Table | pa.RecordBatch) -> np.ndarray:
    """Fixed-width bytes that sort as rows rank: highest score, then smallest id, null last, then n_features and the row's own number."""
    ids = rows.column("doc_id")
    parts = [
        -rows.column("score").to_numpy(zero_copy_only=False).astype(np.int64),
        ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64),
        rows.column("n_features").to_numpy(zero_copy_only=False).astype(np.int64),
        rows.column("row").to_numpy(zero_copy_only=False).astype(np.int64),
    ]
    sign = np.uint64(1 << 63)
    score, doc, size, row = ((p.view(np.uint64) ^ sign).astype(">u8").view(np.uint8).reshape(-1, 8) for p in parts)
    missing = ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)[:, None]
    return np.ascontiguousarray(np.hstack([score, missing, doc, size, row])).view(f"S{KEY_BYTES}").ravel()


def sorted_runs(batches: Iterator[pa.RecordBatch], run_rows: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The rows of a task in runs of at most ``run_rows``, each sorted, with their keys."""
    held, size = [], 0

    def run() -> tuple[pa.RecordBatch, np.ndarray]:
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        keys = sort_keys(whole)
        order = np.argsort(keys, kind="stable")
        return whole.take(pa.array(order)), keys[order]

    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, run_rows - size)
            held.append(part)
            at, size = at + part.num_rows, size + part.num_rows
            if size == run_rows:
                yield run()
                held, size = [], 0
    if size:
        yield run()


def segment_of(keys: np.ndarray, splitters: np.ndarray) -> np.ndarray:
    """Number of the segment of each key: how many splitters are smaller."""
    return np.searchsorted(splitters, keys, side="left")


def merge_segment(rows: pa.Table) -> pa.Table:
    """The sorted pieces of a segment merged, with places from 1."""
    whole = rows.combine_chunks().to_batches()[0]
    order = np.argsort(sort_keys(whole), kind="stable")
    merged = whole.take(pa.array(order))
    return pa.table({"row": merged.column("row"), "segment": merged.column("segment"), "place": pa.array(np.arange(1, len(order) + 1))})


def ranked(rows: DataFrame, draw: int, total: int, settings: Settings = Settings()) -> DataFrame:
    """(row, rank) of the ``draw`` first of ``total`` rows; ``rows`` is a table of doc_id, n_features, score and a unique ``row``.

    There are as many segments as runs of ``run_rows``, 64 at least; the driver holds one splitter and one count for each.
    """
    spark, run_rows = rows.sparkSession, settings.run_rows
    segments = max(64, math.ceil(total / run_rows))
    every = max(1, total // segments**2)

    def samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, keys in sorted_runs(batches, run_rows):
            chosen = [k.ljust(KEY_BYTES, b"\0") for k in keys[every - 1 :: every].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(chosen, pa.binary())], ["key"])

    numbered = ordered_scan(rows.mapInArrow(samples, "key binary"), [], [F.col("key")], {"n": row_no()})
    cuts = sorted(bytes(r["key"]) for r in numbered.filter(F.col("n") % max(1, total // (every * segments)) == 0).select("key").collect())
    splitters = spark.sparkContext.broadcast(np.array(cuts, dtype=f"S{KEY_BYTES}"))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, n = np.unique(segment_of(sort_keys(batch), splitters.value), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(n.astype(np.int64))], ["segment", "n"])

    sizes = rows.mapInArrow(counts, "segment long, n long").groupBy("segment").agg(F.sum("n").alias("n")).collect()
    starts, before = [], 0
    for segment, n in sorted((r["segment"], r["n"]) for r in sizes):
        if before < draw:
            starts.append((segment, before))
        before += n
    last = starts[-1][0] if starts else -1

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run, keys in sorted_runs(batches, run_rows):
            segment = segment_of(keys, splitters.value)
            upto = int(np.searchsorted(segment, last, side="right"))
            yield run.slice(0, upto).append_column("segment", pa.array(segment[:upto].astype(np.int64)))

    pieces = rows.mapInArrow(sent, "doc_id long, n_features long, score long, row long, segment long")
    merged = pieces.groupBy("segment").applyInArrow(merge_segment, "row long, segment long, place long")
    first = F.broadcast(spark.createDataFrame(starts, "segment long, start long"))
    found = merged.join(first, "segment").select("row", (F.col("start") + F.col("place")).alias("rank"))
    return found.filter(F.col("rank") <= draw)


def resample(docs: DataFrame, target: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, n_features, weight, score, rank), one row per row of ``docs``; the rank is null for rows that are not drawn.

    Null and empty texts have no feature and weight 0, on either side. A null doc_id draws its noise as the empty text and
    ranks behind equal scores. Repeated rows are rows of their own and share no rank; which of two that agree in score, id and
    features comes first is open. Texts of any length count whole. Only doc_id and text are read, so other columns cannot clash.
    An empty table gives no rows; an empty target gives the ratio of the smoothing alone.
    """
    gain = gains(bucket_counts(docs, settings), bucket_counts(target, settings))
    rows = persist_table(scored(docs, gain, settings).withColumn("row", F.monotonically_increasing_id()), "scored")
    able = rows.filter(F.col("n_words") >= settings.least_words).select("doc_id", "n_features", "score", "row")
    total = able.count()
    ranks = ranked(able, settings.percent * total // 100, total, settings)
    return rows.join(ranks, "row", "left").select("doc_id", "n_features", "weight", "score", "rank")
