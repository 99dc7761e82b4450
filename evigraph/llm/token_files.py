"""Token-id files: one zstandard frame per document under a shared dictionary, with an index for direct access.

A shard file is

    header   magic, version, bytes per id, sha256 of the dictionary
    frames   one zstandard frame per document: its ids as little-endian unsigned integers
    index    doc ids (int64), null flags (uint8), token offsets (int64, n + 1), frame offsets (int64, n + 1)
    trailer  position of the index, number of documents, magic

The dictionary lies beside the shards as ``dictionary-<sha256>.zdict``. Files are written under a temporary name and
moved, so a repeated task leaves one whole file; their folder must be shared by all executors.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evigraph.llm.encode import encoder
from evigraph.session import persist_table

MAGIC, VERSION = b"EVTOKENS", 1
HEADER, TRAILER = "<8sHH32s", "<QQ8s"
#: Shards are numbered by the task that writes them and, within a task, in turn.
SHARDS_PER_TASK = 1_000_000
HEADER_SIZE, TRAILER_SIZE = struct.calcsize(HEADER), struct.calcsize(TRAILER)
MANIFEST = "shard long, file string, n_docs long, n_tokens long, n_bytes long"


@dataclass(frozen=True)
class Format:
    """The dictionary is trained on about ``dictionary_docs`` texts of at most ``dictionary_chars`` characters each.

    A shard ends with the document that takes it past ``shard_bytes``.
    """

    tokenizer: str
    spaced: bool = True
    end_id: int = 0
    level: int = 3
    dictionary_bytes: int = 112_640
    dictionary_docs: int = 1000
    dictionary_chars: int = 32_768
    shard_bytes: int = 128 << 20


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class _Target:
    """A file that appears under its name only when it is whole."""

    def __init__(self, uri: str):
        self.store, self.path = _open(uri)
        self.store.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.passing = f"{self.path}.{uuid.uuid4().hex}"
        self.out = self.store.open_output_stream(self.passing)

    def close(self) -> None:
        self.out.close()
        self.store.move(self.passing, self.path)


def _write(uri: str, data: bytes) -> None:
    target = _Target(uri)
    target.out.write(data)
    target.close()


def _serialise(ids: bytes, width: int) -> bytes:
    return np.frombuffer(ids, dtype="<u4").astype("<u2").tobytes() if width == 2 else ids


def train_dictionary(docs: DataFrame, form: Format) -> bytes:
    """Dictionary bytes from a bounded sample chosen by hash, trained in one task; empty where there is too little text."""
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) / float(1 << 40)
    rate = form.dictionary_docs / max(1, docs.count())
    sample = docs.select("doc_id", "text").filter(F.length("text").between(1, form.dictionary_chars) & (draw < rate)).select("text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(form.tokenizer, form.spaced)
        width = 2 if enc.vocabulary() <= 1 << 16 else 4
        samples = [_serialise(ids, width) for batch in batches for ids in map(enc.encode, batch["text"])]
        try:
            trained = zstandard.train_dictionary(form.dictionary_bytes, samples).as_bytes()
        except (zstandard.ZstdError, ValueError):
            trained = b""
        yield pd.DataFrame({"dictionary": [trained]})

    rows = sample.repartition(1).mapInPandas(run, "dictionary binary").collect()
    return max((bytes(r["dictionary"]) for r in rows), key=len, default=b"")


def _frames(dictionary: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def write_token_files(docs: DataFrame, folder: str, form: Format) -> DataFrame:
    """Writes (doc_id, text) in ascending doc_id order (null ids first, then by text) and returns the manifest table.

    Null text counts as empty; each document ends with ``end_id``. Rows that repeat an id are documents of their own.
    """
    dictionary = train_dictionary(docs, form)
    digest = hashlib.sha256(dictionary).digest()
    base = folder.rstrip("/")
    _write(f"{base}/dictionary-{digest.hex()}.zdict", dictionary)
    shared = docs.sparkSession.sparkContext.broadcast(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(form.tokenizer, form.spaced)
        width = 2 if max(enc.vocabulary() - 1, form.end_id) < 1 << 16 else 4
        known = _frames(shared.value)
        squeeze = zstandard.ZstdCompressor(level=form.level, dict_data=known) if known else zstandard.ZstdCompressor(level=form.level)
        end = np.array([form.end_id], dtype="<u4").tobytes()
        writer, number = None, TaskContext.get().partitionId() * SHARDS_PER_TASK
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if writer is None:
                    writer = _ShardWriter(f"{base}/shard-{number:012d}.tok", struct.pack(HEADER, MAGIC, VERSION, width, digest))
                ids = enc.encode(text.as_py() or "") + end
                writer.add(doc_id, squeeze.compress(_serialise(ids, width)), len(ids) // 4)
                if writer.size >= form.shard_bytes:
                    yield writer.close(number)
                    writer, number = None, number + 1
        if writer is not None:
            yield writer.close(number)

    order = ["doc_id", "text"]
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id", F.xxhash64("text"))
    return persist_table(ranged.select(*order).sortWithinPartitions("doc_id", F.xxhash64("text")).mapInArrow(run, MANIFEST), "token-manifest")


class _ShardWriter:
    """Frames go to the file as they come; only the index, some 25 bytes a document, waits for the end."""

    def __init__(self, uri: str, header: bytes):
        self.uri, self.target, self.size = uri, _Target(uri), len(header)
        self.ids, self.nulls, self.lengths, self.frames = [], [], [], []
        self.target.out.write(header)

    def add(self, doc_id: int | None, frame: bytes, length: int) -> None:
        self.target.out.write(frame)
        self.size += len(frame)
        self.ids.append(0 if doc_id is None else doc_id)
        self.nulls.append(doc_id is None)
        self.lengths.append(length)
        self.frames.append(len(frame))

    def close(self, number: int) -> pa.RecordBatch:
        offsets = lambda first, steps: np.concatenate([[first], first + np.cumsum(steps)]).astype("<i8")
        tokens, frames = offsets(0, self.lengths), offsets(HEADER_SIZE, self.frames)
        index = [np.array(self.ids, dtype="<i8").tobytes(), np.array(self.nulls, dtype=np.uint8).tobytes(), tokens.tobytes(), frames.tobytes()]
        for part in [*index, struct.pack(TRAILER, int(frames[-1]), len(self.ids), MAGIC)]:
            self.target.out.write(part)
        self.target.close()
        total = int(frames[-1]) + sum(map(len, index)) + TRAILER_SIZE
        return pa.RecordBatch.from_pylist([{"shard": number, "file": self.uri, "n_docs": len(self.ids), "n_tokens": int(tokens[-1]), "n_bytes": total}])


class Shard:
    """Reads one shard; a single document costs one index read and one frame read."""

    def __init__(self, uri: str):
        store, self.path = _open(uri)
        self.file = store.open_input_file(self.path)
        size = self.file.size()
        at, n, magic = struct.unpack(TRAILER, self.file.read_at(TRAILER_SIZE, size - TRAILER_SIZE))
        head, version, self.width, self.digest = struct.unpack(HEADER, self.file.read_at(HEADER_SIZE, 0))
        if magic != MAGIC or head != MAGIC or version != VERSION:
            raise ValueError(f"not a token file: {uri}")
        index = self.file.read_at(size - TRAILER_SIZE - at, at)
        self.doc_ids = np.frombuffer(index, dtype="<i8", count=n)
        self.nulls = np.frombuffer(index, dtype=np.uint8, count=n, offset=8 * n)
        self.tokens = np.frombuffer(index, dtype="<i8", count=n + 1, offset=9 * n)
        self.frames = np.frombuffer(index, dtype="<i8", count=n + 1, offset=17 * n + 8)
        with store.open_input_stream(f"{self.path.rpartition('/')[0]}/dictionary-{self.digest.hex()}.zdict") as stream:
            dictionary = stream.read()
        if hashlib.sha256(dictionary).digest() != self.digest:
            raise ValueError(f"dictionary does not match: {uri}")
        known = _frames(dictionary)
        self.unpack = zstandard.ZstdDecompressor(dict_data=known) if known else zstandard.ZstdDecompressor()

    def ids(self, i: int) -> np.ndarray:
        """Ids of the i-th document as unsigned 32-bit integers."""
        frame = self.file.read_at(int(self.frames[i + 1] - self.frames[i]), int(self.frames[i]))
        return np.frombuffer(self.unpack.decompress(frame), dtype=f"<u{self.width}").astype("<u4")

    def run_of_ids(self, first: int, stop: int) -> list[np.ndarray]:
        """Ids of the documents ``first`` to ``stop``, with one read of the file."""
        edges = (self.frames[first : stop + 1] - self.frames[first]).tolist()
        data = memoryview(self.file.read_at(int(self.frames[stop] - self.frames[first]), int(self.frames[first])))
        parts = [self.unpack.decompress(data[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        joined = np.frombuffer(b"".join(parts), dtype=f"<u{self.width}").astype("<u4")
        return np.split(joined, np.cumsum([len(p) // self.width for p in parts])[:-1])

    def find(self, doc_id: int) -> list[int]:
        """Places of a doc_id; ids ascend behind the null ids."""
        first = int(self.nulls.sum())
        low, high = (first + int(np.searchsorted(self.doc_ids[first:], doc_id, side)) for side in ("left", "right"))
        return list(range(low, high))


def read_token_files(spark: SparkSession, manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, shard[, ids]) of all documents; start counts the ids of all documents before."""
    before = F.sum("n_tokens").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1))
    shards = manifest.select("shard", "file", F.coalesce(before, F.lit(0)).alias("base"))
    files = max(1, manifest.count())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number, path, base in zip(batch["shard"], batch["file"], batch["base"], strict=True):
                shard = Shard(path)
                for first in range(0, len(shard.doc_ids), 2000):
                    at = range(first, min(first + 2000, len(shard.doc_ids)))
                    ids = shard.run_of_ids(at.start, at.stop)
                    names = pd.array(shard.doc_ids[at.start : at.stop], dtype="Int64")
                    names[shard.nulls[at.start : at.stop].astype(bool)] = pd.NA
                    rows = {
                        "doc_id": names,
                        "start": base + shard.tokens[at.start : at.stop],
                        "n_tokens": [len(x) for x in ids],
                        "ids_crc32": [zlib.crc32(x.tobytes()) for x in ids],
                        "shard": np.int64(number),
                    }
                    yield pd.DataFrame(rows | ({"ids": ids} if with_ids else {}))

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, shard long" + (", ids array<long>" if with_ids else "")
    return shards.repartition(files).mapInPandas(run, schema)
