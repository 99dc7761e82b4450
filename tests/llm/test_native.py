"""URL reputation and chunk recipes on odd input; whole tables are compared with SQL in tests/test_oracles.py."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from evigraph.llm import chunk_dedup, queries, url_reputation


def slow_groups(rows):
    groups = {}
    for doc, text in rows:
        groups.setdefault(text or "", []).append(doc)
    out = []
    for doc, text in rows:
        ids = [i for i in groups[text or ""] if i is not None]
        keep = max(ids) if ids else None
        out.append((doc, keep, len(groups[text or ""]), doc == keep))
    return Counter(out)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups(odd_docs, docs001, no_docs, weak):
    digest = (lambda c: F.substring(F.md5(c.cast("binary")), 1, 1).cast("binary")) if weak else chunk_dedup.sha256_bytes
    for docs in (odd_docs, docs001, odd_docs.selectExpr("nullif(nullif(doc_id, 3), 4) AS doc_id", "text"), odd_docs.selectExpr("CAST(NULL AS long) AS doc_id", "text")):
        rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        got = chunk_dedup.exact_groups(docs, digest=digest).collect()
        assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got) == slow_groups(rows)
    assert chunk_dedup.exact_groups(no_docs).count() == 0
    kept = chunk_dedup.without_copies(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == len({r["text"] or "" for r in odd_docs.collect()})


def test_chunks_make_up_the_text(odd_docs, docs001):
    for docs in (odd_docs.select("text"), docs001.select("text")):
        cut = docs.filter("text IS NOT NULL").withColumn("c", chunk_dedup.chunks(F.col("text"), 16, 64))
        for r in cut.collect():
            assert "".join(r["c"]) == r["text"] and all(0 < len(x) <= 64 for x in r["c"])


URLS = [
    None, "", "no scheme", "http://", "HTTP://User@ExAmple.NET:80/EN/x", "http://example.net/en/", "http://a.example.net/en/1?x=/q#f", "http://example.net",
    "http://badexample.net/en/", "ftp://x.org/fr/?q", "x.org/fr/", "http://a.co.uk/z://y", "a://b.org/fr", "http://127.0.0.1/net/", "http://example.com/de/#", "http://É.org/fr/é",
]


def slow_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def slow_rule(host, path):
    fits = [r for r in queries.URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)


def test_rules_and_parts(spark):
    pages = spark.createDataFrame([(i, u, "clash", 1.0) for i, u in enumerate(URLS)] + [(1, "http://z.net/", "clash", 1.0), (None, None, None, None)], "page_id long, url string, host string, lower double")
    labels = spark.createDataFrame([(1, True), (1, False), (99, True), (None, True)], "page_id long, bad boolean")
    for known in (labels, labels.limit(0)):
        rows = url_reputation.judge(pages, known, queries.URL_RULES).collect()
        assert len(rows) == len(URLS) + 2
        for r in rows:
            assert r["verdict"] in ("allow", "block") and 0 < r["bad_rate"] < 1
        for i, u in enumerate(URLS):
            got = [r for r in rows if r["page_id"] == i and (r["host"], r["path"]) == slow_parts(u)]
            rule = slow_rule(*slow_parts(u))
            assert got and got[0]["rule"] == (rule and rule.text) and (rule is None or got[0]["verdict"] == rule.verdict)
    assert url_reputation.judge(pages.limit(0), labels, []).count() == 0


def test_bad_hosts_are_blocked_and_small_ones_shrunk(spark):
    rows = [(i, "http://good.a.org/") for i in range(40)] + [(100 + i, "http://bad.b.org/") for i in range(40)] + [(200, "http://new.b.org/"), (201, "http://c.org/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = pages.filter("page_id < 200").selectExpr("page_id", "page_id >= 100 AS bad").union(spark.createDataFrame([(201, True)], "page_id long, bad boolean"))
    got = {r["host"]: r for r in url_reputation.judge(pages, labels, []).collect()}
    assert got["bad.b.org"]["verdict"] == "block" and got["good.a.org"]["verdict"] == "allow"
    assert got["c.org"]["verdict"] == "allow"  # one bad page is not enough
    assert got["new.b.org"]["bad_rate"] > got["good.a.org"]["bad_rate"]
