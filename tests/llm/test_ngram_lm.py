"""Scores against counts in dictionaries, and the trie against plain look-ups."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evigraph.llm import ngram_lm
from evigraph.llm.elias_fano import EliasFano, Trie


def tokens_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lowered), None]


def slow(rows, mu):
    cut = [(doc, tokens_of(text), zlib.crc32(("" if doc is None else str(doc)).encode()) % 10 == 0) for doc, text in rows]
    one, two = Counter(), Counter()
    for _, tokens, held in cut:
        if not held:
            one.update(tokens)
            two.update(zip([None, *tokens], tokens))
    n, v = sum(one.values()), len(one)
    out = []
    for doc, tokens, held in cut:
        base = {t: (one[t] + 0.1) / (n + 0.1 * (v + 1)) for t in tokens}
        ps = [(two[u, w] + mu * base[w]) / (one[u] + mu) for u, w in zip([None, *tokens], tokens)]
        out.append((doc, held, len(tokens), sum(one[t] > 0 for t in tokens), n, sum(math.log10(base[t]) for t in tokens), sum(map(math.log10, ps))))
    return sorted(out, key=str)


def check(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in ngram_lm.score(docs).collect()), key=str)
    want = slow(rows, ngram_lm.Settings().mu)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5] == pytest.approx(w[5], rel=1e-9, abs=1e-9)
        assert abs(g[6] - w[6]) <= 1e-9 + g[2] / ngram_lm.GRID
    return got


def test_whole_table(docs001):
    got = check(docs001)
    held = [g for g in got if g[1]]
    assert sum(g[6] for g in held) > sum(g[5] for g in held)


def test_odd_rows(odd_docs, no_docs):
    check(odd_docs)
    check(odd_docs.selectExpr("nullif(doc_id, 5) AS doc_id", "text"))
    check(odd_docs.filter("false"))
    assert ngram_lm.score(no_docs).count() == 0
    only_held = odd_docs.selectExpr("CAST(NULL AS long) AS doc_id", "text")
    assert {r["train_tokens"] for r in check_rows(only_held)} == {0}


def check_rows(docs):
    check(docs)
    return ngram_lm.score(docs).collect()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1 << 40) | st.integers(0, 50), max_size=200), st.lists(st.integers(0, 60), max_size=20))
def test_sequences(values, more):
    ascending = np.array(sorted(values), dtype=np.uint64)
    level = EliasFano.of(ascending)
    if len(ascending):
        assert (level.get(np.arange(len(ascending))) == ascending).all()
    asked = np.array(values + more, dtype=np.uint64)
    zero = np.zeros(len(asked), dtype=np.int64)
    found = level.successor(asked, zero, zero + len(ascending))
    for value, at in zip(asked, found, strict=True):
        assert (at < 0 and value not in ascending) or ascending[at] == value


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.tuples(st.integers(0, 9) | st.integers(0, 1 << 33), st.integers(0, 9) | st.integers(0, 1 << 33)), st.integers(0, 65534), max_size=80))
def test_trie(entries):
    keys = sorted(entries)
    u, w = (np.array([k[i] for k in keys], dtype=np.int64) for i in (0, 1))
    built = Trie.build(u, w, np.array([entries[k] for k in keys]))
    trie = Trie.from_buffer(built.to_bytes())
    asked = keys + [(a, b) for a, _ in keys[:9] for _, b in keys[:9]] + [(3, 3)]
    got = trie.lookup(np.array([a for a, _ in asked]), np.array([b for _, b in asked]))
    assert got.tolist() == [entries.get(k, 0xFFFF) for k in asked]


def test_mapped_file(tmp_path):
    trie = Trie.build(np.array([2, 2, 7]), np.array([0, 5, 1]), np.array([10, 20, 30]))
    (tmp_path / "levels").write_bytes(trie.to_bytes())
    assert Trie.open(str(tmp_path / "levels")).lookup(np.array([2, 7, 7]), np.array([5, 1, 5])).tolist() == [20, 30, 0xFFFF]
