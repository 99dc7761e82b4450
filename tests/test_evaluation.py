"""Metric values on small reviewed tables, sources and sinks."""

import json

import pytest
from pyspark.sql import functions as F

from evigraph.operators import cost, evaluate, responses, runs, search
from evigraph.session import work_path
from evigraph.sources import files, tables

FINDING = "finding_uid string, model_family string, method_name string, input_scope string, repetition string, matched_case_id string, detection_match string, evidence_quality string, ord int"


def review(spark):
    rows = [
        ("u1", "m", "p", "scope_a", "1", "C1", "TP", "Sufficient", 1),
        ("u2", "m", "p", "scope_a", "1", "", "FP", "Unsupported", 2),
        ("u3", "m", "p", "scope_a", "2", "C1", "TP", "Insufficient", 3),
        ("u4", "m", "p", "scope_a", "2", "C2", "TP", "Sufficient", 4),
    ]
    gt = spark.createDataFrame([("C1", "scope_a", "b"), ("C2", "scope_a", "b")], "case_id string, input_scope string, benchmark_id string")
    return spark.createDataFrame(rows, FINDING), gt


def test_metrics(spark):
    found, gt = review(spark)
    per_run = {r["repetition"]: r for r in evaluate.run_metrics(found, gt).collect()}
    one, two = per_run["1"], per_run["2"]
    assert (one["precision"], one["recall"], one["f1_score"]) == (0.5, 0.5, 0.5)
    assert (one["evidence_sufficiency_rate"], one["fabricated_unsupported_evidence_rate"]) == (1.0, 0.5)
    assert (two["precision"], two["recall"]) == (1.0, 1.0)
    mean = evaluate.mean_std(evaluate.run_metrics(found, gt)).first()
    assert (mean["precision_mean"], mean["recall_mean"]) == (0.75, 0.75)
    best = evaluate.anyhit_summary(evaluate.anyhit_cases(found, gt), found).first()
    assert (best["precision"], best["recall"], best["f1_score"]) == (0.666667, 1.0, 0.8)
    assert best["fabricated_unsupported_evidence_rate"] == 0.333333


def test_runs_without_findings_stay_when_the_run_list_is_given(spark):
    found, gt = review(spark)
    listed = spark.createDataFrame([("m", "p", "1"), ("m", "p", "3")], "model_family string, method_name string, repetition string")
    rows = {r["repetition"]: r for r in evaluate.run_metrics(found, gt, "all", listed).collect()}
    assert set(rows) == {"1", "3"} and rows["3"]["fn_cases"] == 2 and rows["3"]["precision"] is None and rows["3"]["recall"] == 0.0


def test_cost_and_reruns(spark):
    prices = cost.price_table(spark.createDataFrame([('{"m": {"input_per_million": 2, "output_per_million": "x"}}',)], "p string"), "p")
    runs_ = spark.createDataFrame([("d", "m", 30, 10), ("e", "other", 1, 1)], "run_dir string, model string, input_tokens long, output_tokens long")
    got = {r["run_dir"]: r["estimated_cost_usd"] for r in cost.with_price(runs_, prices).collect()}
    assert got == {"d": 0.00006, "e": None}
    nested = [("d", [("C1", "ok", "1.5", ("ok", "10", "5", "15", "api"))])]
    schema = "run_dir string, per_chain array<struct<chain_id:string,status:string,elapsed_seconds:string,llm:struct<status:string,input_tokens:string,output_tokens:string,total_tokens:string,token_usage_source:string>>>"
    chains = cost.explode_per_chain(spark.createDataFrame(nested, schema))
    meta = spark.createDataFrame([("d", "m", "p")], "run_dir string, model string, provider string")
    row = cost.chain_cost(meta, chains, prices).first()
    assert (row["input_tokens"], row["total_tokens"], row["elapsed_seconds"], row["estimated_cost_usd"]) == (10, 15, 1.5, 0.00002)
    old = spark.createDataFrame([(0, "success", None), (1, "failed", "x"), (2, "failed", "y")], "position int, status string, error string")
    new = spark.createDataFrame([(1, "success", None), (0, "failed", "no")], "position int, status string, error string")
    left = runs.remaining_failed(runs.apply_reruns(old, new)).first()
    assert (left["runs"], left["rerun_runs"], left["remaining_failed"]) == (3, 1, 1)


def test_correlation_of_constants_is_undefined(spark):
    df = spark.createDataFrame([("k", 1.0, 2.0), ("k", 1.0, 3.0), ("n", 1.0, None)], "key string, x double, y double")
    assert all(r["pearson"] is None for r in cost.pearson(df, ["key"], "x", "y").collect())
    assert [r["spearman"] for r in cost.spearman(df, ["key"], "x", "y").collect()] == [None]


def test_usage_and_json(spark):
    df = spark.createDataFrame([("```JSON\n{\"a\": 1}\n```",), ("x {\"a\": 1} y",), ("{\"a\": 1} {\"b\": 2}",), ("",)], "t string")
    got = [r["payload"] for r in responses.extract_json(df, F.col("t")).collect()]
    assert got == ['{"a": 1}', '{"a": 1}', None, None]
    keys = spark.createDataFrame([('{"a": {"b\\"c": 1, "finding" : ["prompt"]}}',)], "t string").select(search.json_keys(F.col("t"))).first()[0]
    assert keys == ["a", 'b\\"c', "finding"]


def test_sources(spark, tmp_path):
    root = tmp_path / "in put+x"
    for name, data in {"b1/s1/rtl/A.SV": b"module a;\xff\nendmodule\n", "b1/s1/n.txt": b"no", "b2/s2/c.vh": b"x"}.items():
        target = root / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(data)
    rows = files.scan_sources(spark, str(root))
    assert {r["relative_path"]: r["text"] for r in rows.collect()} == {"b1/s1/rtl/A.SV": "module a;\nendmodule\n", "b2/s2/c.vh": "x"}
    assert {(r["graph_id"], r["file"]) for r in files.scope_sources(rows).collect()} == {("b1__s1", "rtl/A.SV"), ("b2__s2", "c.vh")}
    run = root / "models" / "m1" / "sc" / "rep_2"
    run.mkdir(parents=True)
    (run / "final_answer.json").write_text('{"findings": [{"summary": "s"}]}')
    got = files.scan_run_outputs(spark, str(root / "models").replace("/models", ""), "findings array<struct<summary:string>>").first()
    assert (got["model_family"], got["input_scope"], got["repetition"]) == ("m1", "sc", "2")


def test_tables(spark, tmp_path):
    csv = tmp_path / "t.csv"
    csv.write_bytes('﻿a,b\r\n1,"x\ny ""q"""\r\n2,\r\n'.encode())
    assert [tuple(r) for r in tables.read_csv(spark, str(csv), ["a", "b"]).collect()] == [("1", 'x\ny "q"'), ("2", "")]
    doc = tmp_path / "d.json"
    doc.write_text(json.dumps({"runs": [{"k": 1}, {"k": 2}]}, indent=2))
    assert tables.read_json(spark, str(doc), "runs array<struct<k:int>>").select(F.explode("runs")).count() == 2
    log = tmp_path / "log.jsonl"
    log.write_text('{"k": 1}\n\n[3]\n{bad\n')
    assert [r["k"] for r in tables.read_jsonl_tolerant(spark, str(log), "k int").collect()] == [1]
    with pytest.raises(Exception):
        tables.read_jsonl(spark, str(log), "k int").collect()
    assert tables.read_jsonl(spark, str(tmp_path / "none.jsonl"), "k int").count() == 0
    left = spark.createDataFrame([("r", "f", "s")], "run_id string, finding_id string, input_scope string")
    with pytest.raises(ValueError):
        tables.strict_merge({"x": left, "y": left}, left.columns, ["run_id", "finding_id"])
    out = work_path(spark, "template")
    evaluate.write_analysis_template(left, out)
    with pytest.raises(Exception):
        evaluate.write_analysis_template(left, out)
