"""What ordered scans and numbered modules send and write."""

import pytest
from pyspark.sql import functions as F

from catalog import corpus
from evigraph.functions import scan
from evigraph.operators import extract, responses


def written(monkeypatch, *modules):
    """Labels of the tables that the modules write, in order."""
    labels = []
    for module in modules:
        kept = module.persist_table
        monkeypatch.setattr(module, "persist_table", lambda df, label, *a, kept=kept: (labels.append(label), kept(df, label, *a))[1])
    return labels


@pytest.mark.parametrize("most", [scan.KEY_ROWS, 20])
def test_small_keys_are_shuffled_once(spark, monkeypatch, most):
    monkeypatch.setattr(scan, "KEY_ROWS", most)
    labels = written(monkeypatch, scan)
    df = spark.range(600).select((F.col("id") % 7).alias("key"), F.col("id").alias("at"), F.lit("wide").alias("other"))
    out = scan.ordered_scan(df, ["key"], [F.col("at")], {"n": scan.row_no(), "s": scan.running_sum(F.col("at"))}).select("key", "at", "n", "s")
    rows = out.collect()
    assert sorted((r["key"], r["at"], r["n"], r["s"]) for r in rows) == sorted((i % 7, i, i // 7 + 1, sum(range(i % 7, i + 1, 7))) for i in range(600))
    assert labels == ([] if most > 600 else ["ordered"])


def test_module_texts_are_written_once(spark, monkeypatch):
    labels = written(monkeypatch, extract, scan)
    monkeypatch.setattr(corpus, "persist_table", lambda *a: pytest.fail("modules are written again"))
    found = corpus.modules(spark, "/root/testdata/sf0.001")
    assert labels == ["spans", "module-numbers"] and found.count() > 0


def test_matches_of_a_frequent_word_are_numbered_in_slices(spark, monkeypatch):
    monkeypatch.setattr(scan, "KEY_ROWS", 20)
    labels = written(monkeypatch, scan)
    lines = spark.range(100).select(F.col("id").alias("doc_id"), F.lit(1).alias("line_no"), F.lit(" The end ").alias("line"))
    got = responses.search_lines(lines, ["the", "zz"], F.col("doc_id")).collect()
    assert sorted((r["query"], r["doc_id"], r["match_no"], r["line"]) for r in got) == [("the", i, i + 1, "The end") for i in range(100)]
    assert labels == ["ordered"]
    few = responses.search_lines(lines, ["the"], F.col("doc_id"), max_matches=3).collect()
    assert sorted(r["match_no"] for r in few) == [1, 2, 3]
