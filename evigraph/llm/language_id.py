"""Language identification: multinomial naive Bayes over hashed character n-grams.

The model is one matrix of log probabilities (features x languages), which is broadcast:
its size is bounded by ``features`` and ``most_languages``. Texts are scored in batches in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.llm.common import by_number, id_bucket

UNDETERMINED = "und"


@dataclass(frozen=True)
class Settings:
    """``train_rows`` bounds the labelled rows per language that the classifier is fitted on (their expected number).

    The ``most_languages`` most frequent languages are learned; the model has a column for each.
    """

    features: int = 1 << 15
    train_rows: int = 5000
    most_languages: int = 512
    smoothing: float = 0.5
    step_chars: int = 1 << 19


def ngram_features(codes: np.ndarray, features: int, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids and their positions for the 1-, 2- and 3-grams of an array of code points that end in a ``fresh`` place.

    0 ends a text and is in no n-gram.
    """
    c = codes.astype(np.uint64)
    live = codes != 0
    one, two, three = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
    shift = np.uint64(64 - (features.bit_length() - 1))
    ids, places = [], []
    pair, trio = live[:-1] & live[1:], live[:-2] & live[1:-1] & live[2:]
    for mask, mixed in (
        (live & fresh, c * one),
        (pair & fresh[1:], (c[:-1] * two + c[1:] + np.uint64(1)) * one),
        (trio & fresh[2:], ((c[:-2] * three + c[1:-1]) * two + c[2:] + np.uint64(2)) * one),
    ):
        at = np.flatnonzero(mask)
        ids.append((mixed[at] >> shift).astype(np.int32))
        places.append(at)
    return np.concatenate(ids), np.concatenate(places)


#: Characters that a part of a text repeats from the part before it, so that every n-gram lies whole in one part.
CARRIED = 2


def _steps(texts: list[str], step_chars: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the text, code points and an end, which of them are new) in parts of bounded size."""
    for i, text in enumerate(texts):
        lowered = text.lower()
        for start in range(0, len(lowered), step_chars):
            first = max(0, start - CARRIED)
            codes = np.frombuffer((lowered[first : start + step_chars] + "\0").encode("utf-32-le", "replace"), dtype=np.uint32)
            yield i, codes, np.arange(first, first + len(codes)) >= start


def text_scores(texts: list[str], weights: np.ndarray, step_chars: int) -> np.ndarray:
    """Sum of ``weights`` rows over all n-grams of each text. A text longer than ``step_chars`` is read in parts."""
    totals = np.zeros((len(texts), weights.shape[1]))
    held: list[tuple[int, np.ndarray, np.ndarray]] = []
    size = 0

    def flush():
        nonlocal held, size
        if not held:
            return
        owner = np.concatenate([np.full(len(codes), i, dtype=np.int64) for i, codes, _ in held])
        ids, places = ngram_features(np.concatenate([x for _, x, _ in held]), weights.shape[0], np.concatenate([x for _, _, x in held]))
        for language in range(weights.shape[1]):
            totals[:, language] += np.bincount(owner[places], weights=weights[ids, language], minlength=len(texts))
        held, size = [], 0

    for step in _steps(texts, step_chars):
        held.append(step)
        size += len(step[1])
        if size >= step_chars:
            flush()
    flush()
    return totals


def _count(features: int, step_chars: int, languages: list[str]):
    place = {name: i for i, name in enumerate(languages)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros((len(languages), features), dtype=np.int64)
        for batch in batches:
            for name, text in zip(batch["lang"], batch["text"], strict=True):
                for _, codes, fresh in _steps([text], step_chars):
                    ids, _ = ngram_features(codes, features, fresh)
                    counts[place[name]] += np.bincount(ids, minlength=features)
        lang, feature = np.nonzero(counts)
        yield pd.DataFrame({"lang": lang.astype(np.int32), "feature": feature.astype(np.int32), "n": counts[lang, feature]})

    return run


def train(labelled: DataFrame, settings: Settings = Settings()) -> tuple[list[str], np.ndarray]:
    """Languages and the matrix (features x languages) of log probabilities, from rows (doc_id, text, lang) without nulls.

    Rows are chosen by a hash of id and text at the rate that gives ``train_rows`` per language (all, where there are fewer).
    """
    common = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(settings.most_languages)
    sizes = {r["lang"]: r["count"] for r in common.collect()}
    languages = sorted(sizes)
    if not languages:
        return [], np.zeros((settings.features, 0))
    rate = F.create_map(*[F.lit(x) for name in languages for x in (name, min(1.0, settings.train_rows / sizes[name]))])
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    chosen = labelled.filter(draw < rate[F.col("lang")]).select("lang", "text")
    rows = chosen.mapInPandas(_count(settings.features, settings.step_chars, languages), "lang int, feature int, n long")
    counts = np.full((settings.features, len(languages)), settings.smoothing)
    for r in rows.groupBy("feature", "lang").agg(F.sum("n").alias("n")).toArrow().to_batches():
        counts[r["feature"].to_numpy(), r["lang"].to_numpy()] += r["n"].to_numpy()
    return languages, np.log(counts / counts.sum(axis=0)).astype(np.float32)


def predict(docs: DataFrame, languages: list[str], weights: np.ndarray, settings: Settings = Settings(), keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """``keep`` columns (default doc_id) with lang_pred and score, one row per row of ``docs``.

    Null text, text without a letter and an empty model give ``und`` with score 0. The score is the posterior
    probability at equal priors; ties go to the first language by name.
    """
    model = docs.sparkSession.sparkContext.broadcast((languages, weights))
    step_chars = settings.step_chars

    @F.pandas_udf("lang_pred string, score double")
    def judged(column: pd.Series) -> pd.DataFrame:
        names, matrix = model.value
        texts = [t if isinstance(t, str) else "" for t in column]
        readable = np.array([any(map(str.isalpha, t)) for t in texts], dtype=bool) & bool(names)
        lang, score = np.full(len(texts), UNDETERMINED, dtype=object), np.zeros(len(texts))
        if readable.any():
            at = np.flatnonzero(readable)
            totals = text_scores([texts[i] for i in at], matrix, step_chars)
            best = totals.argmax(axis=1)
            lang[at] = np.array(names, dtype=object)[best]
            score[at] = 1 / np.exp(totals - totals.max(axis=1, keepdims=True)).sum(axis=1)
        return pd.DataFrame({"lang_pred": lang, "score": score})

    return docs.select(*(keep or ["doc_id"]), judged(text).alias("_judged")).select(*(keep or ["doc_id"]), "_judged.*")


def held_out() -> Column:
    return id_bucket("doc_id", 4) == 2


def identify(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), learned from the rows that are not held out and have text and language.

    An id of null counts as empty text for the split. Repeated rows are rows of their own. An empty table gives no rows.
    """
    labelled = docs.select("doc_id", "text", "lang").filter("text IS NOT NULL AND lang IS NOT NULL").filter(~held_out())
    languages, weights = train(labelled, settings)
    rows = docs.select("doc_id", "text", held_out().alias("held_out"))
    return predict(rows, languages, weights, settings, ["doc_id", "held_out"])


def confident(docs: DataFrame, least: float = 0.5, settings: Settings = Settings()) -> DataFrame:
    """``docs`` without texts that have no letter or whose language is less likely than ``least``; all columns kept."""
    labelled = docs.select("doc_id", "text", "lang").filter("text IS NOT NULL AND lang IS NOT NULL").filter(~held_out())
    languages, weights = train(labelled, settings)
    rows, names = by_number(docs)
    judged = predict(rows, languages, weights, settings, list(names.values()), names["text"])
    return judged.filter((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least)).select(*names.values()).toDF(*names)
