"""Contents of messages and schemas of tool documents, value by value."""

import json

import pytest
from pyspark.sql import functions as F

from evigraph.operators import responses

ACTION = {"tool": "read_around", "file": "a.v", "line_start": 3, "line_end": None, "reason": ""}
EVIDENCE = {"file": "a.v", "line_start": 1, "line_end": 2, "evidence_role": "violation", "description": "d", "supports_claim": "c"}
FINDING = {"summary": "s", "reasoning_summary": "r", "security_impact": "i", "evidence": [EVIDENCE], "confidence": "low"}


def stages(spark, schema, docs):
    rows = [(i, d if d is None or isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)]
    frame = spark.createDataFrame(rows, "i int, payload string")
    return [r["failure_stage"] for r in responses.response_problem(frame, schema=schema).orderBy("i").collect()]


def analysis(**changed):
    return {"chain_id": "C", "has_finding": True, "finding": {**FINDING, **changed}}


def evidence(**changed):
    return analysis(evidence=[EVIDENCE, {**EVIDENCE, **changed}])


def test_tool_actions(spark):
    good = [{"chain_id": "C"}, {"chain_id": "C", "actions": []}, {"chain_id": "C", "actions": [ACTION, {**ACTION, "line_end": "7"}]}, {"chain_id": "C", "actions": [{**ACTION, "line_start": 4.0}], "x": 1}]
    bad = [
        {}, {"chain_id": None}, {"chain_id": 1}, {"chain_id": "C", "actions": None}, {"chain_id": "C", "actions": {}},
        *({"chain_id": "C", "actions": [ACTION, {**ACTION, **c}]} for c in ({"tool": "run"}, {"file": None}, {"line_start": "x"}, {"line_end": 1.5}, {"line_start": [1]}, {"reason": None}, {"query": 3})),
        {"chain_id": "C", "actions": ["read_around"]},
    ]
    assert stages(spark, "tool_actions", good) == [""] * len(good)
    assert stages(spark, "tool_actions", bad) == ["schema_validate"] * len(bad)
    assert stages(spark, "tool_actions", [None, "{", ""]) == ["json_extract"] * 3


def test_tool_analysis(spark):
    good = [analysis(), evidence(), evidence(module="m", object="o"), evidence(line_start="12"), {"chain_id": "C", "has_finding": "no"}, {"chain_id": "C", "has_finding": 0, "finding": None, "no_finding_reason": "none"}]
    bad = [
        analysis(confidence="certain"), analysis(summary=None), analysis(evidence=None), analysis(evidence="x"), evidence(line_start=None), evidence(line_end=2.5), evidence(evidence_role="guess"),
        evidence(module=None), {"chain_id": "C", "has_finding": True, "finding": "text"}, {"chain_id": "C", "has_finding": "maybe"}, {"has_finding": True},
    ]
    assert stages(spark, "tool_analysis", good) == [""] * len(good)
    assert stages(spark, "tool_analysis", bad) == ["schema_validate"] * len(bad)


def test_analysis_cites_snippets(spark):
    item = {"snippet_id": "S", "evidence_role": "impact", "description": "d", "supports_claim": "c"}
    assert stages(spark, "analysis", [analysis(evidence=[item]), evidence()]) == ["", "schema_validate"]


@pytest.mark.parametrize(
    ("content", "text"),
    [
        ('"plain\\n text "', "plain\n text "),
        ('[{"type": "text", "text": "a"}, "b", 3, {"type": "REASONING", "text": "c"}, {"content": "d"}, {"text": 5, "content": " "}]', "a\nb\n3\nd"),
        ('[{"type": "thinking", "text": "a"}]', '[{"type": "thinking", "text": "a"}]'),
        ("[]", "[]"), ('{"text": "a"}', '{"text": "a"}'), ("12", "12"), ("not json", "not json"), (None, None),
    ],
)
def test_message_text(spark, content, text):
    frame = spark.createDataFrame([(content,)], "c string")
    assert frame.select(responses.message_text(F.col("c"))).first()[0] == text


def test_parsed_analysis(spark):
    frame = spark.createDataFrame([(json.dumps(analysis()),)], "p string").select(responses.parse_analysis(F.col("p")).alias("a"))
    row = frame.select("a.chain_id", "a.has_finding", "a.finding.evidence").first()
    assert (row[0], row[1], row[2][0]["evidence_role"]) == ("C", True, "violation")
