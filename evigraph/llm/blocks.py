"""Blocks of documents that ask and answer each other through buckets of keys.

A block is a bounded share of the texts, chosen by a hash, that one task holds. To learn something about its keys from
the whole corpus, a block sends each distinct key once, packed by bucket; a bucket sees at most one entry per key and
block, however often the key occurs, and sends its answers back to the blocks. Neither side meets a hot key.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm.common import tasks_for, whole_text

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32

_rng = np.random.default_rng(20_240_601)
BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
STEP = np.uint64(0xD1342543DE82EF95)
STEP_BACK = np.uint64(pow(int(STEP), -1, 1 << 64))
MIX = np.uint64(0xFF51AFD7ED558CCD)


def in_blocks(docs: DataFrame, block_chars: float = 8e6) -> tuple[DataFrame, float]:
    """(block, doc_id, text) with null text as empty, and the characters in all; a block has about ``block_chars``.

    Ids travel as text: a null among numbers would turn a block's ids into floating point.
    """
    chars = float(docs.agg(F.sum(F.length("text"))).first()[0] or 0)
    blocks = tasks_for(docs.sparkSession, chars, block_chars)
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")
    return docs.select(block.alias("block"), F.col("doc_id").cast("long").cast("string").alias("doc_id"), whole_text().alias("text")), chars


def in_fixed_order(block: pd.DataFrame) -> tuple[list[int | None], list[str]]:
    """Ids and texts of a block in an order that does not depend on how its rows arrived."""
    ids = [None if pd.isna(x) else int(x) for x in block["doc_id"]]
    rows = sorted(zip(ids, block["text"], strict=True), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    return [r[0] for r in rows], [r[1] for r in rows]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(29))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Hashes of slices of a sequence of 64-bit values: the same content gives the same hash anywhere."""

    def __init__(self, values: np.ndarray):
        self.back = _powers(STEP_BACK, len(values) + 1)
        self.sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(values * _powers(STEP, len(values)))])

    def slices(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return mixed((self.sums[last] - self.sums[first]) * self.back[first] + (last - first).astype(np.uint64))


def word_hashes(texts: list[str], lower: bool = False, step_bytes: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of all texts, and how many each text has."""
    hashes, counts, held, size = [], [], [], 0

    def flush():
        nonlocal held, size
        if not held:
            return
        data = np.frombuffer(b"\n".join(held) + b"\n", dtype=np.uint8)
        data = ASCII_LOWER[data] if lower else data
        inside = ~SPACE[data]
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        first, last = edge[::2], edge[1::2]
        hashes.append(Rolling(BYTE_VALUE[data]).slices(first, last))
        ends = np.cumsum([len(x) + 1 for x in held])
        counts.append(np.diff(np.searchsorted(first, ends), prepend=0))
        held, size = [], 0

    for text in texts:
        held.append(text.encode("utf-8", "replace"))
        size += len(held[-1]) + 1
        if size >= step_bytes:
            flush()
    flush()
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate(hashes or [none.astype(np.uint64)]), np.concatenate(counts or [none])


KINDS = ("uint8", "uint16", "uint32", "uint64", "int32", "int64")


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value; bytes of the same significance lie together."""
    parts = []
    for array in arrays:
        planes = np.ascontiguousarray(array).view(np.uint8).reshape(len(array), array.dtype.itemsize).T
        parts.append(np.array([len(array), KINDS.index(array.dtype.name)], dtype=np.int64).tobytes() + planes.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unsqueeze(data: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(raw):
        n, kind = np.frombuffer(raw, dtype=np.int64, count=2, offset=at)
        dtype = np.dtype(KINDS[int(kind)])
        planes = np.frombuffer(raw, dtype=np.uint8, count=int(n) * dtype.itemsize, offset=at + 16)
        out.append(np.ascontiguousarray(planes.reshape(dtype.itemsize, int(n)).T).view(dtype).reshape(-1))
        at += 16 + int(n) * dtype.itemsize
    return out


def gaps(ascending: np.ndarray) -> np.ndarray:
    return np.diff(ascending, prepend=ascending.dtype.type(0))


def by_bucket(bucket: np.ndarray, buckets: int) -> list[tuple[int, slice]]:
    """(bucket, its slice) of an ascending array of bucket numbers, empty ones left out."""
    border = np.searchsorted(bucket, np.arange(buckets + 1))
    return [(b, slice(int(border[b]), int(border[b + 1]))) for b in np.flatnonzero(np.diff(border)).tolist()]
