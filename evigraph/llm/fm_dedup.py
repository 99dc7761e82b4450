"""Substring deduplication: passages that also start in an earlier document, found by FM-indexes.

Windows of ``length`` words whose hash occurs in several documents are searched for: they are cut into segments by the
rarest-hash trigram that they share (so equal windows of different documents come to one shard), every shard builds a
compressed FM-index over its distinct segments, and backward search gives, for each window, the interval of suffixes
that begin with it and the smallest doc_id among them. The hashes only choose what is sent; matches compare words.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm import blocks as B
from evigraph.llm.common import tasks_for
from evigraph.llm.fm_index import FMIndex

ANCHOR = 3
#: Bits of a position within a block, below the hash of an anchor.
PLACE_BITS = 26


@dataclass(frozen=True)
class Settings:
    """``length`` words (9 to 16) make a passage. Buckets grow with the text, so the share of chance candidates does not."""

    length: int = 13
    block_chars: float = 8e6
    bucket_chars: float = 6e6


class Windows:
    """All windows of a block: where each begins (word number), its document and its hash. Documents without an id have none."""

    def __init__(self, ids: list[int | None], texts: list[str], length: int):
        self.ids, self.texts, self.length = ids, texts, length
        self.hashes, self.counts = B.word_hashes(texts)
        ends = np.cumsum(self.counts)
        named = np.array([i is not None for i in ids], dtype=bool)
        room = np.where(named, np.maximum(self.counts - length + 1, 0), 0)
        self.doc = np.repeat(np.arange(len(texts)), room)
        self.start = np.arange(room.sum()) - np.repeat(np.cumsum(room) - room, room) + np.repeat(ends - self.counts, room)
        self.rolling = B.Rolling(self.hashes)
        self.hash = self.rolling.slices(self.start, self.start + length)

    def keys(self, buckets: int) -> np.ndarray:
        """Bucket number above 32 bits of hash."""
        return ((self.hash >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | self.hash & np.uint64(0xFFFFFFFF)


def send_windows(block: pd.DataFrame, length: int, buckets: int) -> pd.DataFrame:
    """Each distinct window hash of a block once, with a mark if several documents of the block have it."""
    ids, texts = B.in_fixed_order(block)
    windows = Windows(ids, texts, length)
    key = windows.keys(buckets)
    names = np.array([i or 0 for i in ids], dtype=np.int64)[windows.doc]
    order = np.argsort(key, kind="stable")
    key, names = key[order], names[order]
    first = np.flatnonzero(np.diff(key, prepend=key[:1] ^ np.uint64(1)))
    several = np.minimum.reduceat(names, first) != np.maximum.reduceat(names, first) if len(first) else np.zeros(0, dtype=bool)
    key = key[first]
    rows = [(b, int(block["block"].iloc[0]), B.squeeze(B.gaps((key[s] & np.uint64(0xFFFFFFFF)).astype(np.uint32)), several[s].astype(np.uint8))) for b, s in B.by_bucket((key >> np.uint64(32)).astype(np.int64), buckets)]
    return pd.DataFrame(rows, columns=["bucket", "block", "data"])


def repeated_windows(rows: pd.DataFrame) -> pd.DataFrame:
    """For one bucket, back to each block: those of its hashes that another document has too."""
    sent = [(b, *B.unsqueeze(d)) for b, d in zip(rows["block"], rows["data"], strict=True)]
    sent = [(b, np.cumsum(g, dtype=np.uint32), m.astype(bool)) for b, g, m in sent]
    values = np.sort(np.concatenate([v for _, v, _ in sent]))
    twice = values[1:][values[1:] == values[:-1]]
    known = np.union1d(twice, np.concatenate([v[m] for _, v, m in sent]))
    out = []
    for block, own, _ in sent:
        at = np.minimum(np.searchsorted(known, own), max(0, len(known) - 1))
        kept = own[known[at] == own] if len(known) else own[:0]
        if len(kept):
            out.append((int(rows["bucket"].iloc[0]), block, B.squeeze(B.gaps(kept))))
    return pd.DataFrame(out, columns=["bucket", "block", "data"])


class Segments:
    """The runs of repeated windows of a block that share an anchor, and the distinct ones among them."""

    def __init__(self, block: pd.DataFrame, answers: pd.DataFrame, length: int, buckets: int):
        ids, texts = B.in_fixed_order(block)
        self.windows = w = Windows(ids, texts, length)
        known = [np.cumsum(B.unsqueeze(d)[0], dtype=np.uint32).astype(np.uint64) | np.uint64(b) << np.uint64(32) for b, d in zip(answers["bucket"], answers["data"], strict=True)]
        known = np.sort(np.concatenate(known)) if known else np.zeros(0, dtype=np.uint64)
        self.window = np.flatnonzero(np.isin(w.keys(buckets), known, kind="sort")) if len(known) else np.zeros(0, dtype=np.int64)
        start = w.start[self.window]
        place = np.arange(max(0, len(w.hashes) - ANCHOR + 1))
        anchor = w.rolling.slices(place, place + ANCHOR) >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS) | place.astype(np.uint64)
        width, reach, least = length - ANCHOR + 1, 1, anchor
        while 2 * reach <= width:
            least, reach = np.minimum(least[:-reach], least[reach:]), 2 * reach
        chosen = np.minimum(least[start], least[start + width - reach]) if len(start) else anchor[:0]
        follows = (np.diff(start) == 1) & (np.diff(w.doc[self.window]) == 0) & (np.diff(chosen) == 0)
        self.run = np.cumsum(np.concatenate([[0], ~follows]))[: len(start)]
        self.head = np.flatnonzero(np.diff(self.run, prepend=-1))
        self.size = np.diff(np.concatenate([self.head, [len(start)]]))
        tail = self.head + self.size - 1
        self.first, self.last = start[self.head], start[tail] + length
        self.bucket = ((chosen[self.head] >> np.uint64(PLACE_BITS)) % np.uint64(buckets)).astype(np.int64)
        names = np.array([i or 0 for i in ids], dtype=np.int64)[w.doc[self.window[self.head]]] if len(self.head) else np.zeros(0, dtype=np.int64)
        # windows of one anchor overlap, so the first and the last fix all words between
        content = np.stack([self.bucket.astype(np.uint64), w.hash[self.window[self.head]], w.hash[self.window[tail]], self.size.astype(np.uint64)], axis=1) if len(self.head) else np.zeros((0, 4), dtype=np.uint64)
        order = np.lexsort((names, *content.T[::-1]))
        new = np.any(content[order[1:]] != content[order[:-1]], axis=1)
        number = np.concatenate([[0], np.cumsum(new)]).astype(np.int64)[: len(order)]
        self.distinct = np.empty(len(order), dtype=np.int64)
        self.distinct[order] = number
        leaders = order[np.flatnonzero(np.diff(number, prepend=-1))]
        self.leader, self.owner = leaders, names[leaders]


def send_segments(block: pd.DataFrame, answers: pd.DataFrame, length: int, buckets: int) -> pd.DataFrame:
    if not len(block):
        return pd.DataFrame({"bucket": [], "block": [], "sizes": [], "text": []})
    segments = Segments(block, answers, length, buckets)
    words = b"\n".join(t.encode("utf-8", "replace") for t in segments.windows.texts).split()
    rows = []
    for bucket, part in B.by_bucket(segments.bucket[segments.leader], buckets):
        leaders = segments.leader[part]
        text = b"\n".join(b" ".join(words[a:b]) for a, b in zip(segments.first[leaders].tolist(), segments.last[leaders].tolist(), strict=True))
        sizes = (segments.last[leaders] - segments.first[leaders]).astype(np.int32)
        rows.append((bucket, int(block["block"].iloc[0]), B.squeeze(sizes, segments.owner[part]), B.squeeze(np.frombuffer(text, dtype=np.uint8))))
    return pd.DataFrame(rows, columns=["bucket", "block", "sizes", "text"])


def search_segments(rows: pd.DataFrame, length: int) -> pd.DataFrame:
    """For one shard, back to each block: the smallest doc_id of every window of its segments."""
    known: dict[bytes, int] = {}
    owners, numbers = [], []
    for sizes, text in zip(rows["sizes"], rows["text"], strict=True):
        _, owner = B.unsqueeze(sizes)
        lines = B.unsqueeze(text)[0].tobytes().split(b"\n")
        numbers.append(np.array([known.setdefault(x, len(known)) for x in lines], dtype=np.int64))
        owners.append(owner)
    least = np.full(len(known), np.iinfo(np.int64).max)
    np.minimum.at(least, np.concatenate(numbers), np.concatenate(owners))

    ids: dict[bytes, int] = {}
    split = [x.split(b" ") for x in known]
    count = np.array([len(x) for x in split])
    words = np.zeros(int(count.sum()) + len(split), dtype=np.int64)
    ends = np.cumsum(count + 1) - 1
    inside = np.ones(len(words), dtype=bool)
    inside[ends] = False
    words[inside] = [ids.setdefault(x, len(ids) + 1) for line in split for x in line]
    index = FMIndex(words, ends, len(ids))

    room = count - length + 1
    begins = np.cumsum(room) - room
    start = np.arange(room.sum()) - np.repeat(begins, room) + np.repeat(ends - count, room)
    low, high = index.intervals(start, length)
    segment = np.repeat(np.arange(len(count)), count + 1)
    owner = np.concatenate([least[segment][index.order], [np.iinfo(np.int64).max]])
    apart, back = np.unique(low, return_inverse=True)
    until = np.zeros(len(apart), dtype=np.int64)
    until[back] = high
    smallest = np.minimum.reduceat(owner, np.stack([apart, until], axis=1).ravel())[::2][back]

    out = []
    for block, own in zip(rows["block"], numbers, strict=True):
        size = room[own]
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begins[own], size)
        out.append((int(rows["bucket"].iloc[0]), block, B.squeeze(smallest[at])))
    return pd.DataFrame(out, columns=["bucket", "block", "data"])


def remove_repeats(block: pd.DataFrame, answers: pd.DataFrame, length: int, buckets: int) -> pd.DataFrame:
    """Words, removed words, spans and the kept text of each document of a block."""
    columns = ["doc_id", "n_words", "n_removed", "kept_sha256", "spans", "kept_text"]
    if not len(block):
        return pd.DataFrame({c: [] for c in columns})
    found = answers["segment"].to_numpy(dtype=bool)
    segments = Segments(block, answers[~found], length, buckets)
    w = segments.windows
    gone = np.zeros(len(w.hashes) + 1, dtype=np.int64)
    if len(segments.head):
        by_bucket = {b: B.unsqueeze(d)[0] for b, d in zip(answers["bucket"][found], answers["data"][found], strict=True)}
        smallest = np.concatenate([by_bucket[b] for b, _ in B.by_bucket(segments.bucket[segments.leader], buckets)])
        size = segments.size[segments.leader]
        begins = np.cumsum(size) - size
        within = np.arange(len(segments.run)) - segments.head[segments.run]
        least = smallest[begins[segments.distinct[segments.run]] + within]
        own = np.array([i or 0 for i in w.ids], dtype=np.int64)[w.doc[segments.window]]
        start = w.start[segments.window][least < own]
        np.add.at(gone, start, 1)
        np.add.at(gone, start + length, -1)
    covered = np.cumsum(gone)[:-1] > 0
    rows, at = [], 0
    for text, n in zip(w.texts, w.counts.tolist(), strict=True):
        part = covered[at : at + n]
        at += n
        words = text.encode("utf-8", "replace").split()
        edges = np.flatnonzero(np.diff(part, prepend=False, append=False))
        kept = b" ".join([x for x, out in zip(words, part.tolist(), strict=True) if not out] if len(edges) else words)
        rows.append((n, int(part.sum()), hashlib.sha256(kept).hexdigest(), edges.tolist(), kept.decode("utf-8", "replace")))
    out = pd.DataFrame(rows, columns=columns[1:])
    out.insert(0, "doc_id", pd.array(w.ids, dtype="Int64"))
    return out


def without_repeats(docs: DataFrame, settings: Settings = Settings(), with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, spans[, kept_text]), one row per row of ``docs``.

    A word goes if a window of ``length`` words over it also starts in a document with a smaller doc_id; ``spans`` are
    the first and the behind-last word number of each stretch that goes. Null text has no words. Rows without an id lose
    nothing and are nobody's earlier document; rows that share an id are not earlier than each other. An empty table
    gives no rows. Words are told apart by their bytes; a chance equality of 64-bit window hashes changes no result
    unless two different windows of one block also agree in both.
    """
    if not FMIndex.SEED <= settings.length <= 16:
        raise ValueError("length must lie between 9 and 16")
    length = settings.length
    texts, chars = B.in_blocks(docs, settings.block_chars)
    buckets = tasks_for(docs.sparkSession, chars, settings.bucket_chars)
    sent = texts.groupBy("block").applyInPandas(lambda rows: send_windows(rows, length, buckets), "bucket int, block int, data binary")
    repeated = sent.groupBy("bucket").applyInPandas(repeated_windows, "bucket int, block int, data binary")
    segments = texts.groupBy("block").cogroup(repeated.groupBy("block")).applyInPandas(
        lambda rows, answers: send_segments(rows, answers, length, buckets), "bucket int, block int, sizes binary, text binary"
    )
    searched = segments.groupBy("bucket").applyInPandas(lambda rows: search_segments(rows, length), "bucket int, block int, data binary")
    answers = repeated.withColumn("segment", F.lit(False)).unionByName(searched.withColumn("segment", F.lit(True)))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<int>" + (", kept_text string" if with_text else "")
    columns = [part.split()[0] for part in schema.split(", ")]
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(
        lambda rows, found: remove_repeats(rows, found, length, buckets)[columns], schema
    )
