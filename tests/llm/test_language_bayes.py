"""Counts, weights and predictions against plain Python; parts of a text lose no n-gram."""

import math
import random
import zlib
from collections import Counter

import numpy as np

from evigraph.llm import language_id
from evigraph.llm.language_id import Settings


def slow_grams(text, features):
    """The feature of each 1-, 2- and 3-gram, one character after the other."""
    mask, shift = (1 << 64) - 1, 64 - (features.bit_length() - 1)
    one, two, three = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
    c = [ord(x) for x in text.lower()]
    out = [(x * one & mask) >> shift for x in c]
    out += [((a * two + b + 1) * one & mask) >> shift for a, b in zip(c, c[1:])]
    return out + [(((a * three + b) * two + d + 2) * one & mask) >> shift for a, b, d in zip(c, c[1:], c[2:])]


def slow_identify(rows, s):
    counts, seen = {}, set()
    for doc, text, lang in rows:
        if text is not None and lang is not None and zlib.crc32(("" if doc is None else str(doc)).encode()) % 4 != 2:
            counts.setdefault(lang, Counter()).update(slow_grams(text, s.features))
            seen.add(lang)
    names = sorted(seen)
    weights = {n: {f: math.log((counts[n][f] + s.smoothing) / (sum(counts[n].values()) + s.smoothing * s.features)) for f in range(s.features)} for n in names}
    out = {}
    for doc, text, _ in rows:
        if not any(map(str.isalpha, text or "")) or not names:
            out[doc] = ("und", 0.0)
            continue
        total = [sum(weights[n][f] for f in slow_grams(text, s.features)) for n in names]
        best = total.index(max(total))
        out[doc] = (names[best], 1 / sum(math.exp(t - total[best]) for t in total))
    return out


def test_against_plain_counts(spark):
    rng = random.Random(6)
    spoken = {"aa": "abcde ", "bb": "bcdfg ", "cc": "defÄß "}
    rows = [(i, "".join(rng.choice(spoken[k]) for _ in range(rng.randrange(60))), k) for i, k in enumerate(rng.choice(list(spoken)) for _ in range(80))]
    rows += [(100, None, "aa"), (101, "", "bb"), (102, "12 !", "cc"), (103, "abcabc", None)]
    settings = Settings(features=256, step_chars=7)
    want = slow_identify(rows, settings)
    for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), settings).collect():
        lang, score = want[r["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert r["lang_pred"] == lang and abs(r["score"] - score) < 1e-3, r


def test_parts_lose_nothing():
    weights = np.random.default_rng(1).normal(size=(512, 3))
    texts = ["", "a", "Ab", "the quick brown fox " * 9, "ΑΣ ΟΔΟΣ ß" * 5]
    whole = language_id.text_scores(texts, weights, 1 << 19)
    for part in (1, 2, 3, 10, 64):
        assert np.allclose(language_id.text_scores(texts, weights, part), whole)
    assert np.allclose(whole[3], sum(weights[f] for f in slow_grams(texts[3], 512)))


def test_the_most_frequent_languages_are_learned(spark):
    rows = [(i, "abc " * 5, "aa") for i in range(12)] + [(20 + i, "xyz " * 5, "bb") for i in range(8)] + [(40, "qqq", "cc")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["lang_pred"] for r in language_id.identify(frame, Settings(features=256, most_languages=2)).collect()}
    assert got == {"aa", "bb"}
