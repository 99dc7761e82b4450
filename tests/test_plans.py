"""Evaluation from files to tables, and reduction of contexts, on small inputs."""

import json

from pyspark.sql import functions as F

from evigraph.plans import evaluation, reduction


def write(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content if isinstance(content, str) else json.dumps(content, indent=1))


def finding(summary, module, evidence=(), **more):
    return {"summary": summary, "locations": [{"file": f"rtl/{module}.sv", "line_start": 3, "line_end": 5, "module": module}], "evidence": [{"file": e} for e in evidence], **more}


def test_evaluation(spark, tmp_path):
    answer = lambda scope, rep, *found: write(tmp_path / "runs" / "models" / "m" / scope / f"rep_{rep}" / "final_answer.json", {"findings": list(found)})
    answer("s1", 1, finding("debug lock is open", "lock", ["a.v"]), finding("lock open again in debug", "lock"), finding("counter wraps", "count"))
    answer("s1", 2, finding("counter may wrap around", "count"), finding("counter wraps around", "count", finding_id="X"))
    answer("s2", 1, finding("key leaks", "aes"))
    write(tmp_path / "mapping.csv", "expected_case_id,benchmark_id,input_scope,reason,case_visibility\nC1,b,s1,r,visible\nC2,b,s1,r,\"visible\"\nC3,b,s2,r,visible\nC4,b,s2,r,hidden\n")
    write(tmp_path / "tasks.csv", "case_id,vulnerable_behavior_summary,relevance_reason,official_description,notes\nC1,lock,,,\nC2,timer,,,\nC3,key,,,\n")
    write(tmp_path / "official.csv", "case_id,official_description\nC1,one\n")
    write(tmp_path / "evidence.jsonl", '{"case_id": "C1", "hit_summary": "h"}\n')
    gt = evaluation.load_ground_truth(spark, *(str(tmp_path / f) for f in ("mapping.csv", "tasks.csv", "official.csv", "evidence.jsonl")), {})
    assert [(r["case_id"], r["input_scope"], r["case_description"]) for r in gt.orderBy("ord").collect()] == [("C1", "s1", "lock"), ("C2", "s1", "timer"), ("C3", "s2", "key")]

    found = evaluation.load_findings(spark, str(tmp_path / "runs"), "method")
    rules = spark.createDataFrame(
        [("s1", 1, "C1", [("all", ["lock", "debug"])]), ("s2", 1, "C3", [("any", ["key"]), ("not", ["none"])])],
        "scope string, priority int, case_id string, clauses array<struct<mode:string,terms:array<string>>>",
    )
    reviewed = evaluation.review(found, rules)
    rows = [(r["finding_id"], r["input_scope"], r["repetition"], r["detection_match"], r["matched_case_id"], r["evidence_quality"], r["claimed_modules"]) for r in reviewed.orderBy("ord").collect()]
    assert rows == [
        ("F1", "s1", "1", "TP", "C1", "Sufficient", "lock"), ("F2", "s1", "1", "Duplicate", "C1", "Sufficient", "lock"), ("F3", "s1", "1", "FP", "", "Unsupported", "count"),
        ("F1", "s1", "2", "FP", "", "Unsupported", "count"), ("X", "s1", "2", "FP", "", "Unsupported", "count"), ("F1", "s2", "1", "TP", "C3", "Sufficient", "aes"),
    ]
    made = evaluation.report(reviewed, gt)
    metrics = {r["repetition"]: (r["precision"], r["recall"]) for r in made["run_metrics"].collect()}
    assert metrics == {"1": (0.666667, 0.666667), "2": (0.0, 0.0)}
    assert made["mean_std"].first()["recall_mean"] == 0.333333 or made["mean_std"].first()["recall_mean"] == 0.333334
    assert made["anyhit_summary"].first()["tp_cases"] == 2
    assert {r["case_result"] for r in made["anyhit_cases"].filter("case_id = 'C2'").collect()} == {"FN"}
    reasons = [r["candidate_reason"] for r in made["failures"].collect()]
    assert reasons.count("FP finding") == 3 and reasons.count("Duplicate finding") == 1
    sizes = sorted(r["fp_count"] for r in made["clusters"].collect())
    assert sizes == [1, 2]
    assert made["clustered_metrics"].filter("repetition = ''").first()["fp_findings"] == 2
    assert sum(r["fp_count"] for r in made["groups"].collect()) == 3


def test_reduction(spark):
    snippet = lambda f, a, b: {"file": f, "line_start": a, "line_end": b, "code": "x"}
    rows = [
        ("s", "CH1", 0, [snippet("f", 1, 5)]), ("s", "CH2", 1, [snippet("f", 1, 5)]), ("s", "CH3", 2, [snippet("f", 8, 9), snippet("g", 1, 2)]),
        ("s", "CH4", 3, [snippet("g", 1, 2)]), ("t", "CH5", 4, [snippet("h", 1, 2)]),
    ]
    rows = [(*r, [], [], [], "payload") for r in rows]
    schema = (
        "scope string, chain_id string, idx int, source_snippets array<struct<file:string,line_start:int,line_end:int,code:string>>, nodes array<struct<node_id:string,module:string>>, "
        "edges array<string>, seed_targets array<string>, payload string"
    )
    contexts = spark.createDataFrame(rows, schema)
    made = reduction.reduce_contexts(contexts, 3, 1)
    assert {(r["scope"], r["idx"]) for r in made["kept"].collect()} == {("s", 2), ("s", 0), ("t", 4)}
    total = {r["scope"]: (r["original_chains"], r["kept_chains"]) for r in made["summary"].collect()}
    assert total[""] == (5, 3)
    traces = spark.createDataFrame(
        [("s", "C1", 1, "f", 4, 4), ("s", "C1", 2, "g", 2, 7), ("s", "C2", 3, "f", 20, 21), ("t", "C3", 4, "h", 2, 2)],
        "scope_id string, case_id string, trace_no int, file string, line_start int, line_end int",
    )
    taken = reduction.covering_contexts(contexts, traces)
    assert {(r["scope"], r["idx"]) for r in taken["cover"].collect()} == {("s", 0), ("s", 2), ("t", 4)}
    assert taken["extras"].count() == 0
    before, after = ({r["scope_id"]: (r["weak"], r["strict"]) for r in reduction.coverage_of(c, traces).collect()} for c in (contexts, made["kept"]))
    assert before == after == {"s": (1, 1), "t": (1, 1), "": (2, 2)}


def test_parts_without_a_query(spark):
    from evigraph.operators import context, cost, search

    lines = spark.createDataFrame([("f", i, f"l{i}") for i in range(1, 9)], "file string, line_no int, line string")
    assert [r["line_no"] for r in context.line_window(lines, 3, 2).orderBy("line_no").collect()] == [3, 4]
    assert context.line_window(lines, 0).count() == 8 and context.line_window(lines, 7, 0).count() == 0
    keys = spark.range(1).select(F.lit('{"a": {"finding": 1}, "gt_cases": []}').alias("t")).select(search.json_keys(F.col("t"))).first()[0]
    assert set(keys) & set(search.FORBIDDEN_CONTEXT_KEYS) if hasattr(search, "FORBIDDEN_CONTEXT_KEYS") else keys
    assert callable(cost.chain_cost_join)
