"""Shares by potentials and steps by coalitions against walking through every order, document by document."""

import re
from collections import Counter
from itertools import permutations

from evigraph.llm import filter_audit


def slow_audit(docs, labels):
    smallest = {}
    for doc, text, _ in docs:
        if doc is not None:
            smallest[text or ""] = min(doc, smallest.get(text or "", doc))
    failed = {}
    for doc, text, lang in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": doc is not None and doc > smallest[t],
        }
        marks = [(q == 1, x == 1) for i, q, x in labels if i is not None and i == doc]
        found = ("".join(k for k, v in fails.items() if v), any(q for q, _ in marks), any(x for _, x in marks))
        failed.setdefault(lang or "", []).append(found)
    out = []
    for part, rows in failed.items():
        removed_in = Counter()
        lines = []
        for order in permutations("ABCDE"):
            left = rows
            for step, name in enumerate(order, 1):
                gone = [r for r in left if name in r[0]]
                fails = sum(name in r[0] for r in rows)
                left = [r for r in left if name not in r[0]]
                removed_in[name] += len(gone)
                unique = sum(r[0] == name for r in rows)
                lines.append((name, part, "".join(order), step, len(left), len(gone), fails - len(gone), unique, sum(r[1] for r in gone), sum(r[2] for r in gone)))
        out += [(*line[1:], removed_in[line[0]]) for line in lines]
    return Counter(out)


def compare(spark, docs, labels):
    got = filter_audit.audit(docs, labels)
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()]
    marks = [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()]
    assert Counter(tuple(r) for r in got.collect()) == slow_audit(rows, marks)


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_odd_rows(spark, odd_docs):
    labels = labels_of(spark, [(1, 1, 0), (1, 0, None), (2, None, 1), (13, 1, 1), (None, 1, 1), (999, 1, 1), (6, 1, 0)])
    compare(spark, odd_docs.selectExpr("*", "'x' AS mask", "'y' AS part", "'z' AS good"), labels)


def test_tables(spark, docs001):
    compare(spark, docs001, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))


def test_large_and_missing_ids(spark):
    base = 1 << 60
    text = "One Two # " * 150
    rows = [(base + 3, text, "en"), (base + 1, text, None), (None, text, "en"), (base + 2, text, ""), (base + 1, text, "en"), (None, None, "en"), (base + 4, "", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    compare(spark, docs, labels_of(spark, [(base + 1, 1, 1), (base + 2, 1, 0)]))


def test_no_rows(spark, no_docs):
    assert filter_audit.audit(no_docs, labels_of(spark, [(1, 1, 1)])).count() == 0


def test_no_labels(spark, odd_docs):
    compare(spark, odd_docs, labels_of(spark, []))
