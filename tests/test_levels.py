"""Counts at several levels: distinct runs as sums of the finest level, without a row per run and level."""

import random

from evigraph.operators import evaluate

FLAGS = ["detection_match", "evidence_quality", "wrong_localization", "insufficient_evidence", "fabricated_evidence", "unsupported_claim", "overconfidence"]


def tables(spark):
    rng = random.Random(5)
    pick = lambda *values: rng.choice(values)
    place = lambda: (pick("m1", "m2", "", None), pick("b1", "b2", ""), pick("s1", "s2", "s3", None), pick(*[f"r{i}" for i in range(9)], "", None))
    keys = "model_family string, benchmark_id string, input_scope string, run_id string"
    meta = [place() for _ in range(12)]
    cases = [(*place(), pick("visible", "hidden", None), pick("TP", "fn", "Partial")) for _ in range(80)]
    findings = [(*place(), pick("TP", "FP", "Partial"), pick("Sufficient", "Fabricated"), *[pick("yes", "") for _ in range(5)]) for _ in range(80)]
    frames = [
        spark.createDataFrame(meta, keys), spark.createDataFrame(cases, f"{keys}, case_visibility string, case_result string"),
        spark.createDataFrame(findings, f"{keys}, {', '.join(f'{c} string' for c in FLAGS)}"),
    ]
    return frames, meta, cases, findings


def test_runs_and_counts(spark):
    frames, *rows = tables(spark)
    got = {}
    for r in evaluate.multi_level_summary(*frames).collect():
        got[(r["level"], r["model_family"], r["benchmark_id"], r["input_scope"])] = (r["num_runs"], r["num_findings"], r["fn_cases"])
    want = {}
    for depth, level in enumerate(["global", "model", "model_benchmark", "model_scope"]):
        key = lambda row: (level, *[(v or "") if i < depth else "" for i, v in enumerate(row[:3])])  # noqa: B023, E731
        for row in [x for part in rows for x in part]:
            want.setdefault(key(row), [set(), 0, 0])[0].update([row[3]] if row[3] else [])
        for row in rows[1]:
            want[key(row)][2] += row[4] != "hidden" and row[5] == "fn"
        for row in rows[2]:
            want[key(row)][1] += 1
    assert got == {k: (len(v[0]), v[1], v[2]) for k, v in want.items()}


def test_runs_are_not_expanded(spark, capsys):
    """Only rows of the finest level are expanded to the four levels; before, there was one row per run and level, with all counters."""
    frames, *_ = tables(spark)
    evaluate.multi_level_summary(*frames).explain()
    expands = [line for line in capsys.readouterr().out.splitlines() if "Expand" in line]
    assert expands and not any("run_id" in line for line in expands)
