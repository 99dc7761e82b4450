"""Run outputs to reviewed findings, metrics and failures, from files to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.operators import clusters, evaluate
from evigraph.session import persist_table
from evigraph.sources import files, tables

PLACE_FIELDS = "file:string,line_start:string,line_end:string,module:string"
ANSWER_SCHEMA = (
    f"findings array<struct<finding_id:string,summary:string,security_impact:string,locations:array<struct<{PLACE_FIELDS},signal_or_register:string>>,"
    f"evidence:array<struct<{PLACE_FIELDS},object:string,evidence_type:string,description:string,supports_claim:string>>>>"
)
MAPPING = ["expected_case_id", "benchmark_id", "input_scope", "reason", "case_visibility"]
TASKS = ["case_id", "vulnerable_behavior_summary", "relevance_reason", "official_description", "notes"]
OFFICIAL = ["case_id", "official_description"]
EVIDENCE = (
    "case_id string, files array<string>, modules array<string>, hit_summary string, notes string, official_description string, "
    "trace array<struct<file:string,module:string,signal_or_register:string>>"
)


def load_ground_truth(spark: SparkSession, mapping: str, tasks: str, official: str, evidence: str, aliases: dict[str, str]) -> DataFrame:
    """Cases from their CSV and JSON-lines files; which row of a case counts follows from the order of files and lines.

    ``ord`` is the place of a case's first row in the mapping.
    """
    place = ["file_ord", "line_ord"]
    mapped = persist_table(tables.read_csv_ordered(spark, mapping, MAPPING).drop(*place), "mapping")
    cases = evaluate.gt_assembly(
        mapped,
        tables.read_csv_ordered(spark, tasks, TASKS).drop(*place),
        tables.read_csv_ordered(spark, official, OFFICIAL).drop(*place),
        tables.read_jsonl_ordered(spark, evidence, EVIDENCE).drop(*place),
        aliases,
    )
    firsts = mapped.groupBy(F.trim("expected_case_id").alias("case_id")).agg(F.min("ord").alias("ord"))
    return persist_table(cases.join(firsts, "case_id"), "cases")


def load_findings(spark: SparkSession, root: str, method: str, model: str | None = None) -> DataFrame:
    """One row per finding of the stored answers below ``root``, ordered by the answers' paths and their place in them."""
    answers = files.scan_run_outputs(spark, root, ANSWER_SCHEMA, model)
    flat = F.transform(
        "findings",
        lambda f, i: F.struct(
            f["finding_id"].alias("finding_id"), f["summary"].alias("summary"), f["security_impact"].alias("security_impact"),
            _distinct(f["locations"], "file").alias("claimed_files"), _distinct(f["locations"], "module").alias("claimed_modules"),
            _distinct(f["locations"], "signal_or_register").alias("claimed_signals_or_registers"),
            evaluate.flatten_items(f["locations"], evaluate.LOCATION_FIELDS).alias("location_items"),
            evaluate.flatten_items(f["evidence"], evaluate.EVIDENCE_FIELDS).alias("evidence_items"), i.cast("string").alias("no"),
        ),
    )
    rows = answers.withColumns({"method_name": F.lit(method), "findings": flat, "final_answer_path": F.col("path")})
    found = evaluate.explode_findings(rows)
    order = F.struct(F.col("path"), F.col("no").cast("int").alias("no"))
    return persist_table(found.withColumn("ord", order).drop("path", "no"), "findings")


def _distinct(items, field: str):
    return evaluate.unique_join_array(F.transform(F.coalesce(items, F.array()), lambda x: F.coalesce(x[field], F.lit(""))))


def review(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings with their case, label, default evidence quality and duplicates; rules as for ``evaluate.match_rules_table``."""
    words = ["summary", "security_impact", "claimed_files", "claimed_modules", "claimed_signals_or_registers", "evidence_items"]
    claims = findings.select("finding_uid", "input_scope", F.concat_ws(" ", *words).alias("text"))
    judged = evaluate.match_rules_table(claims, rules, ["finding_uid"]).drop("input_scope")
    rows = findings.join(judged, "finding_uid")
    quality = evaluate.default_evidence_quality(F.col("detection_match"), F.col("evidence_items"))
    return persist_table(evaluate.mark_duplicates(rows.withColumns({"evidence_quality": quality, "review_notes": F.lit("")})), "reviewed")


def report(reviewed: DataFrame, gt: DataFrame, runs: DataFrame | None = None, threshold: float = clusters.THRESHOLD) -> dict[str, DataFrame]:
    """The tables of an evaluation: per run, over runs, any-hit, failures, and clusters of false positives with their metrics.

    ``runs`` (model_family, method_name, repetition) keeps runs without a finding.
    """
    per_run = persist_table(evaluate.run_metrics(reviewed, gt, "seen" if runs is None else "all", runs), "run-metrics")
    any_hit = persist_table(evaluate.anyhit_cases(reviewed, gt), "anyhit-cases")
    tokens = clusters.token_set([F.col("summary"), F.col("claimed_modules")], F.col("claimed_files"))
    clustered = persist_table(clusters.cluster_false_positives(reviewed.withColumn("tokens", tokens), threshold), "clustered")
    return {
        "run_metrics": per_run,
        "mean_std": evaluate.mean_std(per_run),
        "anyhit_cases": any_hit,
        "anyhit_summary": evaluate.anyhit_summary(any_hit, reviewed),
        "failures": evaluate.failure_candidates(reviewed, gt),
        "groups": evaluate.group_review(reviewed),
        "clusters": clusters.cluster_rollup(clustered),
        "clustered_metrics": clusters.clustered_metrics(clustered, gt),
    }
