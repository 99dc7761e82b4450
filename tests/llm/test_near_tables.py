"""Tables that the near-copy stage writes."""

import random

from evigraph.llm import jaccard_join, simhash


def test_components_of_guessed_pairs_are_not_written_twice(spark, monkeypatch):
    rng, written, real = random.Random(4), {}, jaccard_join.persist_table

    def seen(df, label, *more):
        written.setdefault(label, set()).update(df.columns)
        return real(df, label, *more)

    monkeypatch.setattr(jaccard_join, "persist_table", seen)
    words = [f"w{rng.randrange(3000)}" for _ in range(300)]
    rows = [(7, " ".join(words)), (9, " ".join([*words[:150], "new", *words[151:]])), (8, "another text of its own")]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in kept} == {7, 8}
    assert written["grouped"] == {"shingle", "point", "n", "place", "bits", "root"}
