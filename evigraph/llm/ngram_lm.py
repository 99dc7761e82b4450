"""Bigram language model in Elias-Fano tries, built and queried shard by shard.

Blocks of documents ask for the counts of their words, then for the smoothed probabilities of their bigrams. A shard
holds the trie of some contexts; a context is spread over several shards by its successor, so a hot word has no shard
of its own. Smoothing is Dirichlet interpolation with the add-0.1 unigram model:

    p(w | u) = (c(u, w) + mu * base(w)) / (c(u) + mu)

The trie keeps the first summand, c(u, w) / (c(u) + mu), as a 16-bit logarithm.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm import blocks as B
from evigraph.llm.common import tasks_for
from evigraph.llm.elias_fano import Trie
from evigraph.session import persist_table

#: The word behind every document; it is also the context of a first word.
END = np.uint64(0x9E3779B97F4A7C15)
#: Quantised values per unit of log10.
GRID = 4096.0


@dataclass(frozen=True)
class Settings:
    mu: float = 4.0
    add: float = 0.1
    block_chars: float = 8e6
    bucket_chars: float = 6e6
    spread: int = 16


def is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


class Tokens:
    """Words and ends of a block in order, its distinct ones by hash, and which come from training documents."""

    def __init__(self, block: pd.DataFrame, buckets: int):
        self.ids, texts = B.in_fixed_order(block)
        hashes, counts = B.word_hashes(texts, lower=True)
        tokens = np.insert(hashes, np.cumsum(counts), END)
        self.sizes = counts + 1
        self.held = np.array([is_held_out(i) for i in self.ids], dtype=bool)
        self.doc = np.repeat(np.arange(len(self.ids)), self.sizes)
        self.train = ~self.held[self.doc]
        self.words, self.at = np.unique(tokens, return_inverse=True)
        self.bucket = ((self.words >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)

    def bigrams(self, spread: int, ids: np.ndarray, buckets: int):
        """Distinct (context, word) places in shard order, their shards, training counts, and each token's bigram."""
        context = np.concatenate([np.searchsorted(self.words, [END]), self.at[:-1]])
        key, which = np.unique(context.astype(np.int64) << 32 | self.at, return_inverse=True)
        u, w = key >> 32, key & 0xFFFFFFFF
        mixed = B.mixed(ids[u].astype(np.uint64) * np.uint64(spread) + ids[w].astype(np.uint64) % np.uint64(spread) + np.uint64(1))
        shard = ((mixed >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
        order = np.argsort(shard, kind="stable")
        back = np.empty(len(order), dtype=np.int64)
        back[order] = np.arange(len(order))
        counts = np.bincount(which, weights=self.train, minlength=len(key)).astype(np.int64)
        return u[order], w[order], shard[order], counts[order], back[which]


def send_words(block: pd.DataFrame, buckets: int) -> pd.DataFrame:
    tokens = Tokens(block, buckets)
    counts = np.bincount(tokens.at, weights=tokens.train, minlength=len(tokens.words)).astype(np.int64)
    name = int(block["block"].iloc[0])
    rows = [(b, name, B.squeeze(B.gaps(tokens.words[s]), counts[s])) for b, s in B.by_bucket(tokens.bucket, buckets)]
    return pd.DataFrame(rows, columns=["bucket", "block", "data"])


def count_words(rows: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """For one bucket, back to each block: a number and the training count of each of its words; once, the bucket's totals."""
    bucket = int(rows["bucket"].iloc[0])
    sent = [B.unsqueeze(d) for d in rows["data"]]
    words = [np.cumsum(g, dtype=np.uint64) for g, _ in sent]
    names, where = np.unique(np.concatenate(words), return_inverse=True)
    total = np.bincount(where, weights=np.concatenate([c for _, c in sent]), minlength=len(names)).astype(np.int64)
    out, at = [(bucket, -1, b"", int(total.sum()), int((total > 0).sum()))], 0
    for block, own in zip(rows["block"], words, strict=True):
        place = where[at : at + len(own)]
        at += len(own)
        out.append((bucket, block, B.squeeze(place.astype(np.int64) * buckets + bucket, total[place]), 0, 0))
    return pd.DataFrame(out, columns=["bucket", "block", "data", "tokens", "distinct"])


def _known(answers: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and counts of a block's words, in the order of their hashes."""
    parts = [B.unsqueeze(d) for _, d in sorted(zip(answers["bucket"], answers["data"], strict=True))]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def send_bigrams(block: pd.DataFrame, answers: pd.DataFrame, buckets: int, spread: int) -> pd.DataFrame:
    columns = ["bucket", "block", "data"]
    if not len(block):
        return pd.DataFrame({c: [] for c in columns})
    tokens, (ids, counts) = Tokens(block, buckets), _known(answers)
    u, w, shard, seen, _ = tokens.bigrams(spread, ids, buckets)
    rows = []
    for b, s in B.by_bucket(shard, buckets):
        context = np.flatnonzero(np.diff(u[s], prepend=-1))
        runs = np.diff(np.append(context, s.stop - s.start))
        leaders = u[s][context]
        rows.append((b, int(block["block"].iloc[0]), B.squeeze(ids[leaders], counts[leaders], runs, ids[w[s]], seen[s])))
    return pd.DataFrame(rows, columns=columns)


def search_bigrams(rows: pd.DataFrame, mu: float) -> pd.DataFrame:
    """For one shard: the trie of its training bigrams, and back to each block what the trie has for its bigrams."""
    sent = [B.unsqueeze(d) for d in rows["data"]]
    contexts, first = np.unique(np.concatenate([s[0] for s in sent]), return_index=True)
    of_context = np.concatenate([s[1] for s in sent])[first]
    u = np.concatenate([np.repeat(np.searchsorted(contexts, s[0]), s[2]) for s in sent])
    words, w = np.unique(np.concatenate([s[3] for s in sent]), return_inverse=True)
    key, where = np.unique(u.astype(np.int64) * len(words) + w, return_inverse=True)
    seen = np.bincount(where, weights=np.concatenate([s[4] for s in sent]), minlength=len(key))
    entries = np.flatnonzero(seen)
    up, wp = key // len(words), key % len(words)
    share = seen[entries] / (of_context[up[entries]] + mu)
    codes = np.minimum(np.round(-np.log10(share) * GRID), 0xFFFE)
    trie = Trie.from_buffer(Trie.build(contexts[up[entries]], words[wp[entries]], codes).to_bytes())
    found = trie.lookup(contexts[up], words[wp])
    out, at = [], 0
    for block, s in zip(rows["block"], sent, strict=True):
        out.append((int(rows["bucket"].iloc[0]), block, B.squeeze(found[where[at : at + len(s[3])]])))
        at += len(s[3])
    return pd.DataFrame(out, columns=["bucket", "block", "data"])


def score_block(block: pd.DataFrame, answers: pd.DataFrame, buckets: int, settings: Settings, train_tokens: int, distinct: int) -> pd.DataFrame:
    columns = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    if not len(block):
        return pd.DataFrame({c: [] for c in columns})
    model = answers["model"].to_numpy(dtype=bool)
    tokens, (ids, counts) = Tokens(block, buckets), _known(answers[~model])
    u, _, _, _, which = tokens.bigrams(settings.spread, ids, buckets)
    codes = np.concatenate([B.unsqueeze(d)[0] for _, d in sorted(zip(answers["bucket"][model], answers["data"][model], strict=True))])
    base = (counts + settings.add) / (train_tokens + settings.add * (distinct + 1))
    context = counts[u][which]
    code = codes[which]
    own = np.where(code == Trie.MISSING, 0.0, 10.0 ** (-code.astype(np.float64) / GRID))
    p = own + settings.mu / (context + settings.mu) * base[tokens.at]
    n = len(tokens.ids)
    table = {
        "doc_id": pd.array(tokens.ids, dtype="Int64"),
        "held_out": tokens.held,
        "n_tokens": tokens.sizes,
        "n_known": np.bincount(tokens.doc, weights=counts[tokens.at] > 0, minlength=n).astype(np.int64),
        "train_tokens": np.full(n, train_tokens),
        "base_score": np.bincount(tokens.doc, weights=np.log10(base)[tokens.at], minlength=n),
        "score": np.bincount(tokens.doc, weights=np.log10(p), minlength=n),
    }
    return pd.DataFrame(table)


def score(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per row of ``docs``.

    Words are runs of other than ASCII white space, A-Z lower-cased; an end follows each text and counts as a token. Null
    text is empty. Documents whose crc32 of the id as text is divisible by 10 are held out of training (a null id is the
    empty text, so it is). Scores are log10 probabilities of the whole text. Repeated rows are rows of their own.
    Without training documents both scores are those of the uniform base. An empty table gives no rows.
    """
    texts, chars = B.in_blocks(docs, settings.block_chars)
    buckets = tasks_for(docs.sparkSession, chars, settings.bucket_chars)
    spread, mu = settings.spread, settings.mu
    plain = "bucket int, block int, data binary"
    words = texts.groupBy("block").applyInPandas(lambda rows: send_words(rows, buckets), plain)
    counted = words.groupBy("bucket").applyInPandas(lambda rows: count_words(rows, buckets), plain + ", tokens long, distinct long")
    vocabulary = persist_table(counted, "vocabulary")
    totals = vocabulary.filter("block = -1").agg(F.sum("tokens").alias("n"), F.sum("distinct").alias("v")).first()
    train_tokens, distinct = int(totals["n"] or 0), int(totals["v"] or 0)
    known = vocabulary.filter("block >= 0").select("bucket", "block", "data")
    asked = texts.groupBy("block").cogroup(known.groupBy("block")).applyInPandas(lambda rows, found: send_bigrams(rows, found, buckets, spread), plain)
    searched = asked.groupBy("bucket").applyInPandas(lambda rows: search_bigrams(rows, mu), plain)
    answers = known.withColumn("model", F.lit(False)).unionByName(searched.withColumn("model", F.lit(True)))
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(
        lambda rows, found: score_block(rows, found, buckets, settings, train_tokens, distinct),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
