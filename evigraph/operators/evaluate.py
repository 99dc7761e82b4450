"""Evaluation of reviewed findings against ground-truth cases.

Tables: ``gt`` (case_id, input_scope, benchmark_id, case_description, ...) and
``findings`` (finding_uid, model_family, method_name, input_scope, repetition,
run_id, matched_case_id, detection_match, evidence_quality, ord, ...), where
``ord`` is the position of the row in its source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evigraph.functions.scan import ordered_scan, row_no, running_sum
from evigraph.functions.values import count_where, f1, padded, present, ratio
from evigraph.session import persist_table

RUN = ["model_family", "method_name", "repetition"]
IDENTITY = ["model_family", "method_name"]
# Names of the metrics, in the order of their columns.
METRICS = [
    "precision",
    "recall",
    "f1_score",
    "evidence_sufficiency_rate",
    "fabricated_unsupported_evidence_rate",
]

# Review vocabulary, best evidence first.
DETECTION_MATCHES = ["TP", "FP", "Duplicate", "Unscorable"]
EVIDENCE_QUALITIES = ["Sufficient", "Insufficient", "Unclear", "Unsupported", "Fabricated"]


def _is(column: str, *values: str) -> Column:
    return F.coalesce(F.col(column), F.lit("")).isin(*values)


def evidence_rank(quality: Column) -> Column:
    rank = F.lit(99)
    for position, name in enumerate(EVIDENCE_QUALITIES):
        rank = F.when(quality == name, F.lit(position)).otherwise(rank)
    return rank


# ---------------------------------------------------------------- joins of texts


def unique_join_array(values: Column) -> Column:
    """Ordered distinct non-blank items of an array as one text."""
    trimmed = F.transform(values, lambda v: F.trim(v))
    return F.array_join(F.array_distinct(F.filter(trimmed, lambda v: F.length(v) > 0)), "; ")


def unique_join(df: DataFrame, keys: list[str], value: Column, ord_: Column, out: str) -> DataFrame:
    """Ordered distinct non-blank values per key; values collapse before they are gathered."""
    firsts = (
        df.select(*keys, present(value).alias("_v"), ord_.alias("_o"))
        .filter(F.col("_v").isNotNull())
        .groupBy(*keys, "_v")
        .agg(F.min("_o").alias("_o"))
    )
    items = F.array_sort(F.collect_list(F.struct("_o", "_v")))
    return firsts.groupBy(*keys).agg(F.array_join(F.transform(items, lambda x: x["_v"]), "; ").alias(out))


def first_rows(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The first n rows per key (the limit is applied before the shuffle)."""
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).filter(F.col("_rn") <= n).drop("_rn")


def ordered_text(df: DataFrame, keys: list[str], value: str, ord_: str, separator: str, n: int, out: str) -> DataFrame:
    """The first n values per key joined in order."""
    few = first_rows(df, keys, [ord_], n)
    items = F.array_sort(F.collect_list(F.struct(F.col(ord_).alias("o"), F.col(value).alias("v"))))
    return few.groupBy(*keys).agg(F.array_join(F.transform(items, lambda x: x["v"]), separator).alias(out))


# ---------------------------------------------------------------- ground truth


def strip_vendor_prefix(file: Column, benchmark: Column, vendor: str = "third_party") -> Column:
    path = F.trim(F.replace(file, F.lit("\\"), F.lit("/")))
    prefix = F.concat(F.lit(f"{vendor}/"), benchmark, F.lit("/"))
    return F.when(F.startswith(path, prefix), F.substr(path, F.length(prefix) + 1)).otherwise(path)


def scope_alias(benchmark: Column, scope: Column, aliases: dict[str, str]) -> Column:
    """Scopes of some benchmarks are written with a prefix; add it where it is missing."""
    out = scope
    for name, prefix in aliases.items():
        missing = (benchmark == name) & (scope != "") & ~F.startswith(scope, F.lit(prefix))
        out = F.when(missing, F.concat(F.lit(prefix), scope)).otherwise(out)
    return out


def gt_assembly(
    mapping: DataFrame, task: DataFrame, official: DataFrame, evidence: DataFrame, aliases: dict[str, str]
) -> DataFrame:
    """One row per visible case: first mapping row, last task/official/evidence row, fallbacks.

    All inputs carry ``ord``. evidence: case_id, files[], modules[], hit_summary,
    notes, official_description, trace[struct(file, module, signal_or_register)].
    """

    def last(df: DataFrame, prefix: str) -> DataFrame:
        fields = [c for c in df.columns if c not in ("case_id", "ord")]
        picked = df.groupBy("case_id").agg(F.max_by(F.struct(*fields), F.col("ord")).alias(prefix))
        return picked

    visible = mapping.filter(F.lower(F.trim(F.coalesce("case_visibility", F.lit("visible")))) == "visible")
    fields = [c for c in mapping.columns if c not in ("expected_case_id", "ord")]
    first = (
        visible.withColumn("case_id", present(F.col("expected_case_id")))
        .filter(F.col("case_id").isNotNull())
        .groupBy("case_id")
        .agg(F.min_by(F.struct(*fields), F.col("ord")).alias("m"))
    )
    rows = (
        first.join(last(task, "t"), "case_id", "left")
        .join(last(official, "o"), "case_id", "left")
        .join(last(evidence, "e"), "case_id", "left")
    )
    trace = F.coalesce(F.col("e.trace"), F.array().cast("array<struct<file:string,module:string,signal_or_register:string>>"))

    def listed(name: str, part: str) -> Column:
        given = F.col(f"e.{name}")
        return F.when(F.size(given) > 0, given).otherwise(F.transform(trace, lambda x: x[part]))

    benchmark = F.coalesce("m.benchmark_id", F.lit(""))
    files = F.transform(listed("files", "file"), lambda f: strip_vendor_prefix(f, benchmark))
    filled = lambda *names: F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names], F.lit(""))
    return rows.select(
        "case_id",
        benchmark.alias("benchmark_id"),
        scope_alias(benchmark, F.coalesce("m.input_scope", F.lit("")), aliases).alias("input_scope"),
        filled("o.official_description", "t.official_description", "e.official_description").alias("official_description"),
        filled("t.vulnerable_behavior_summary", "t.relevance_reason", "m.reason").alias("case_description"),
        unique_join_array(files).alias("gt_files"),
        unique_join_array(listed("modules", "module")).alias("gt_modules"),
        unique_join_array(F.transform(trace, lambda x: x["signal_or_register"])).alias("gt_signals_or_registers"),
        unique_join_array(
            F.array(*[F.coalesce(F.col(n), F.lit("")) for n in ("e.hit_summary", "e.notes", "t.notes")])
        ).alias("gt_evidence_notes"),
        F.concat(F.lit("datasets/benchmarks/"), benchmark, F.lit("/cases/"), F.col("case_id"), F.lit(".md")).alias(
            "case_doc_path"
        ),
    )


# ---------------------------------------------------------------- findings


def explode_findings(answers: DataFrame) -> DataFrame:
    """answers(method_name, model_family, input_scope, repetition, findings[]) to one row per finding."""
    run = F.concat_ws(":", "method_name", "model_family", "input_scope", F.concat(F.lit("rep_"), "repetition"))
    rows = answers.withColumn("run_id", run).select(
        *[c for c in answers.columns if c != "findings"], "run_id", F.posexplode("findings").alias("_p", "_f")
    )
    finding_id = F.coalesce(F.nullif(F.col("_f.finding_id"), F.lit("")), F.concat(F.lit("F"), F.col("_p") + 1))
    rest = [c for c in answers.schema["findings"].dataType.elementType.names if c != "finding_id"]
    return rows.select(
        *[c for c in answers.columns if c != "findings"],
        "run_id",
        finding_id.alias("finding_id"),
        F.concat_ws(":", "run_id", finding_id).alias("finding_uid"),
        *[F.coalesce(F.col(f"_f.{c}"), F.lit("")).alias(c) for c in rest],
    )


def _place(item: Column) -> Column:
    start, end = item["line_start"].cast("string"), item["line_end"].cast("string")
    has_start, has_end = F.length(start) > 0, (F.length(end) > 0) & (end != start)
    line = F.concat(
        F.when(has_start, F.concat(F.lit(":"), start)).otherwise(F.lit("")),
        F.when(has_start & has_end, F.concat(F.lit("-"), end)).otherwise(F.lit("")),
    )
    return F.concat(F.coalesce(item["file"], F.lit("")), line)


def flatten_items(items: Column, fields: list[str]) -> Column:
    """``file:start-end | field | ...`` per item, blanks skipped, one item per line."""

    def one(item: Column) -> Column:
        parts = [F.nullif(_place(item), F.lit(""))] + [F.nullif(item[f].cast("string"), F.lit("")) for f in fields]
        return F.concat_ws(" | ", *parts)

    return F.array_join(F.transform(items, one), "\n")


LOCATION_FIELDS = ["module", "signal_or_register"]
EVIDENCE_FIELDS = ["module", "object", "evidence_type", "description", "supports_claim"]


def review_errors(findings: DataFrame, gt: DataFrame) -> DataFrame:
    """One row per violated review rule; ``row_index`` is the line in the reviewed file."""
    quoted = lambda c: F.concat(F.lit("'"), c, F.lit("'"))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = findings.select(
        "row_index",
        text("finding_uid").alias("uid"),
        text("detection_match").alias("match"),
        text("evidence_quality").alias("quality"),
        text("matched_case_id").alias("case_id"),
        text("duplicate_of_finding_uid").alias("dup"),
    )
    uids = rows.groupBy("uid").agg(F.min("row_index").alias("first_index"))
    repeated = (
        rows.filter("uid <> ''").join(uids, "uid").filter(F.col("row_index") > F.col("first_index"))
        .select("row_index", F.concat(F.lit("duplicate finding_uid "), "uid").alias("error"))
    )
    lost_case = (
        rows.filter("case_id <> ''").join(gt.select("case_id").distinct(), "case_id", "left_anti")
        .select("row_index", F.concat(F.lit("matched_case_id "), quoted(F.col("case_id")), F.lit(" not found in GT")).alias("error"))
    )
    lost_dup = (
        rows.filter("match = 'Duplicate' AND dup <> ''")
        .join(uids.select(F.col("uid").alias("dup")), "dup", "left_anti")
        .select("row_index", F.concat(F.lit("duplicate_of_finding_uid "), quoted(F.col("dup")), F.lit(" not found")).alias("error"))
    )
    match, quality = F.col("match"), F.col("quality")
    checks = F.array(
        F.when(F.col("uid") == "", F.lit("missing finding_uid")),
        F.when(match == "Partial", F.lit("Partial is not allowed")),
        F.when(~match.isin(*DETECTION_MATCHES), F.concat(F.lit("invalid detection_match "), quoted(match))),
        F.when(~quality.isin(*EVIDENCE_QUALITIES), F.concat(F.lit("invalid evidence_quality "), quoted(quality))),
        F.when((match == "TP") & (F.col("case_id") == ""), F.lit("TP requires matched_case_id")),
        F.when((match == "FP") & (F.col("case_id") != ""), F.lit("FP must not keep matched_case_id")),
        F.when((match == "Duplicate") & (F.col("dup") == ""), F.lit("Duplicate requires duplicate_of_finding_uid")),
    )
    local = rows.select("row_index", F.explode(F.array_compact(checks)).alias("error"))
    return local.unionByName(repeated).unionByName(lost_case).unionByName(lost_dup)


# ---------------------------------------------------------------- metrics


def _expected_cases(findings: DataFrame, gt: DataFrame, keys: list[str]) -> DataFrame:
    scopes = findings.select(*keys, "input_scope").filter(present(F.col("input_scope")).isNotNull()).distinct()
    cases = gt.filter(present(F.col("case_id")).isNotNull()).select("input_scope", "case_id").distinct()
    return scopes.join(cases, "input_scope").select(*keys, "case_id").distinct()


def _finding_counts(findings: DataFrame, keys: list[str]) -> DataFrame:
    tp, fp = _is("detection_match", "TP"), _is("detection_match", "FP")
    return findings.groupBy(*keys).agg(
        count_where(tp).alias("tp_findings"),
        count_where(fp).alias("fp_findings"),
        count_where(tp & _is("evidence_quality", "Sufficient")).alias("_sufficient"),
        count_where((tp | fp) & _is("evidence_quality", "Fabricated", "Unsupported")).alias("_unsupported"),
    )


def _metric_columns(df: DataFrame, tp: str) -> DataFrame:
    found, wrong = F.col(tp), F.col("fp_findings")
    return df.withColumns(
        {
            "precision": ratio(found, found + wrong),
            "recall": ratio(F.col("tp_cases"), F.col("tp_cases") + F.col("fn_cases")),
            "evidence_sufficiency_rate": ratio(F.col("_sufficient"), found),
            "fabricated_unsupported_evidence_rate": ratio(F.col("_unsupported"), found + wrong),
        }
    ).withColumn("f1_score", f1(F.col("precision"), F.col("recall")))


def run_metrics(findings: DataFrame, gt: DataFrame, gt_scope: str = "seen", runs: DataFrame | None = None) -> DataFrame:
    """Metrics per (model, method, repetition).

    ``gt_scope="seen"`` counts the cases of the scopes with findings, "all" every
    case. ``runs`` (the run list) keeps runs without any finding in the result.
    """
    counts = _finding_counts(findings, RUN)
    hits = (
        findings.filter(_is("detection_match", "TP") & present(F.col("matched_case_id")).isNotNull())
        .select(*RUN, F.col("matched_case_id").alias("case_id"))
        .distinct()
    )
    if gt_scope == "seen":
        expected = _expected_cases(findings, gt, RUN)
        totals = expected.groupBy(*RUN).agg(F.count(F.lit(1)).alias("num_gt_cases"))
        hit_counts = hits.join(expected, [*RUN, "case_id"], "left_semi")
    else:
        cases = gt.filter(present(F.col("case_id")).isNotNull()).select("case_id").distinct()
        totals = None
        hit_counts = hits.join(cases, "case_id", "left_semi")
    hit_counts = hit_counts.groupBy(*RUN).agg(F.count(F.lit(1)).alias("tp_cases"))
    base = counts if runs is None else runs.select(*RUN).distinct().join(counts, RUN, "left")
    joined = base.join(hit_counts, RUN, "left")
    if totals is None:
        joined = joined.withColumn("num_gt_cases", cases.agg(F.count(F.lit(1))).scalar())
    else:
        joined = joined.join(totals, RUN, "left")
    filled = joined.fillna(0, ["tp_findings", "fp_findings", "_sufficient", "_unsupported", "tp_cases", "num_gt_cases"])
    out = _metric_columns(filled.withColumn("fn_cases", F.col("num_gt_cases") - F.col("tp_cases")), "tp_findings")
    return out.select(*RUN, "num_gt_cases", "tp_cases", "fn_cases", "tp_findings", "fp_findings", *METRICS)


def mean_std(metrics: DataFrame) -> DataFrame:
    """Mean and sample deviation over runs; undefined values are left out."""
    return metrics.groupBy(*IDENTITY).agg(
        *[F.round(F.avg(m), 6).alias(f"{m}_mean") for m in METRICS],
        *[F.when(F.count(m) >= 2, F.round(F.stddev_samp(m), 6)).alias(f"{m}_std") for m in METRICS],
    )


def anyhit_cases(findings: DataFrame, gt: DataFrame) -> DataFrame:
    """Every expected case per (model, method): hit in any repetition, best evidenced finding."""
    scopes = findings.select(*IDENTITY, "input_scope").filter(present(F.col("input_scope")).isNotNull()).distinct()
    expected = scopes.join(gt.select("input_scope", "benchmark_id", "case_id"), "input_scope")
    best = F.struct(evidence_rank(F.col("evidence_quality")), F.col("finding_uid"))
    hits = (
        findings.filter(_is("detection_match", "TP") & present(F.col("matched_case_id")).isNotNull())
        .groupBy(*IDENTITY, F.col("matched_case_id").alias("case_id"))
        .agg(
            F.array_join(F.array_sort(F.collect_set(present(F.col("repetition")))), ";").alias("hit_repetitions"),
            F.min_by(F.struct("finding_uid", "evidence_quality"), best).alias("_rep"),
        )
    )
    return expected.join(hits, [*IDENTITY, "case_id"], "left").select(
        *IDENTITY,
        "input_scope",
        "benchmark_id",
        "case_id",
        F.when(F.col("_rep").isNotNull(), F.lit("TP")).otherwise(F.lit("FN")).alias("case_result"),
        F.coalesce("hit_repetitions", F.lit("")).alias("hit_repetitions"),
        F.coalesce("_rep.finding_uid", F.lit("")).alias("representative_finding_uid"),
        F.coalesce("_rep.evidence_quality", F.lit("")).alias("representative_evidence_quality"),
    )


def anyhit_summary(cases: DataFrame, findings: DataFrame) -> DataFrame:
    """One representative finding per hit case; every false positive counts."""
    hit = F.col("case_result") == "TP"
    quality = F.col("representative_evidence_quality")
    by_case = cases.groupBy(*IDENTITY).agg(
        F.count_distinct(F.when(F.col("case_id") != "", F.col("case_id"))).alias("num_gt_cases"),
        F.count_distinct(F.when(hit, F.col("case_id"))).alias("tp_cases"),
        count_where(hit).alias("representative_tp_findings"),
        count_where(hit & (quality == "Sufficient")).alias("_sufficient"),
        count_where(hit & quality.isin("Fabricated", "Unsupported")).alias("_rep_unsupported"),
    )
    false_hits = findings.groupBy(*IDENTITY).agg(
        count_where(_is("detection_match", "FP")).alias("fp_findings"),
        count_where(_is("detection_match", "FP") & _is("evidence_quality", "Fabricated", "Unsupported")).alias("_fp_unsupported"),
    )
    numbers = ["num_gt_cases", "tp_cases", "representative_tp_findings", "_sufficient", "_rep_unsupported"]
    joined = false_hits.join(by_case, IDENTITY, "left").fillna(0, numbers).withColumns(
        {
            "fn_cases": F.col("num_gt_cases") - F.col("tp_cases"),
            "_unsupported": F.col("_rep_unsupported") + F.col("_fp_unsupported"),
        }
    )
    out = _metric_columns(joined, "representative_tp_findings")
    return out.select(
        *IDENTITY, "num_gt_cases", "tp_cases", "fn_cases", "representative_tp_findings", "fp_findings", *METRICS
    )


# ---------------------------------------------------------------- failures

# Columns of a failure table.
FAILURE_COLUMNS = [
    "model_family",
    "method_name",
    "input_scope",
    "repetition",
    "run_id",
    "failure_object_type",
    "related_finding_uid",
    "related_case_id",
    "detection_match",
    "evidence_quality",
    "summary",
    "final_answer_path",
    "candidate_reason",
]


def failure_candidates(findings: DataFrame, gt: DataFrame, traces: DataFrame | None = None) -> DataFrame:
    """Findings that failed plus the cases no run finding hit, numbered in that order.

    gt needs ``ord``; traces(final_answer_path, tool_trace_path) is optional.
    """
    match, quality = F.col("detection_match"), F.col("evidence_quality")
    weak = match.isin("TP", "FP") & quality.isin("Insufficient", "Fabricated", "Unsupported")
    reason = (
        F.when(match == "FP", "FP finding")
        .when(match == "Duplicate", "Duplicate finding")
        .when(match == "Unscorable", "Unscorable finding")
        .when(weak, F.concat(quality, F.lit(" evidence")))
    )
    kind = (
        F.when(match == "FP", "FP_finding")
        .when(match.isin("Duplicate", "Unscorable"), match)
        .otherwise(F.lit("Evidence_failure"))
    )
    failed = findings.withColumns(
        {
            "candidate_reason": reason,
            "failure_object_type": kind,
            "related_finding_uid": F.col("finding_uid"),
            "related_case_id": F.coalesce("matched_case_id", F.lit("")),
        }
    ).filter(F.col("candidate_reason").isNotNull())
    failed = ordered_scan(failed.select(*FAILURE_COLUMNS, "ord"), [], [F.col("ord")], {"_n": row_no()})

    group = ["model_family", "method_name", "input_scope", "repetition"]
    runs = findings.groupBy(*group).agg(
        F.min_by("run_id", "ord").alias("run_id"), F.min_by("final_answer_path", "ord").alias("final_answer_path")
    )
    hits = findings.filter((match == "TP") & (F.col("matched_case_id") != "")).select(
        *group, F.col("matched_case_id").alias("related_case_id")
    )
    cases = gt.select("input_scope", F.col("case_id").alias("related_case_id"), F.col("case_description").alias("summary"), "ord")
    missed = runs.join(cases, "input_scope").join(hits, [*group, "related_case_id"], "left_anti")
    missed = ordered_scan(missed, group, [F.col("ord")], {"_k": row_no()})
    sizes = missed.groupBy(*group).agg(F.count(F.lit(1)).alias("_size"))
    starts = ordered_scan(
        sizes, [], [F.col(c) for c in group], {"_upto": running_sum(F.col("_size"))}
    ).select(*group, (F.col("_upto") - F.col("_size")).alias("_start"))
    missed = missed.join(starts, group).select(
        *group,
        "run_id",
        F.lit("FN_case").alias("failure_object_type"),
        F.lit("").alias("related_finding_uid"),
        "related_case_id",
        F.lit("").alias("detection_match"),
        F.lit("").alias("evidence_quality"),
        "summary",
        "final_answer_path",
        F.lit("GT case not hit by any TP finding in this run").alias("candidate_reason"),
        (F.col("_start") + F.col("_k") + failed.agg(F.count(F.lit(1))).scalar()).alias("_n"),
    )
    rows = failed.select(*FAILURE_COLUMNS, "_n").unionByName(missed)
    if traces is None:
        rows = rows.withColumn("tool_trace_path", F.lit(""))
    else:
        rows = rows.join(traces, "final_answer_path", "left").fillna("", ["tool_trace_path"])
    return rows.select(padded("E", F.col("_n"), 5).alias("failure_uid"), *FAILURE_COLUMNS, "tool_trace_path")


# Columns an analyst fills in.
ANALYST_COLUMNS = [
    "failure_manifestation",
    "failure_mechanism",
    "evidence_from_output",
    "tool_trace_observation",
    "likely_cause",
    "method_implication",
    "review_notes",
]


def analysis_template(candidates: DataFrame) -> DataFrame:
    return candidates.withColumns({c: F.lit("") for c in ANALYST_COLUMNS if c not in candidates.columns})


def write_analysis_template(candidates: DataFrame, path: str, overwrite: bool = False) -> None:
    """Refuses to replace an existing analysis unless asked to."""
    mode = "overwrite" if overwrite else "errorifexists"
    analysis_template(candidates).write.mode(mode).option("header", True).csv(path)


def mechanism_summary(rows: DataFrame, most_ids: int = 10) -> DataFrame:
    """Failures per mechanism with the scopes, first ``most_ids`` ids and implications they carry."""
    rows = rows.withColumn("failure_mechanism", F.coalesce(F.nullif("failure_mechanism", F.lit("")), F.lit("Unclear")))
    keys = [*IDENTITY, "failure_mechanism"]
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("failure_count"))
    ord_ = F.col("ord")
    parts = [
        unique_join(rows, keys, F.col("input_scope"), ord_, "affected_input_scopes"),
        unique_join(first_rows(rows, keys, ["ord"], most_ids), keys, F.col("failure_uid"), ord_, "representative_failure_uids"),
        unique_join(rows, keys, F.col("method_implication"), ord_, "method_implication_summary"),
    ]
    out = counts
    for part in parts:
        out = out.join(part, keys, "left")
    return out.fillna("", ["affected_input_scopes", "representative_failure_uids", "method_implication_summary"])


# ---------------------------------------------------------------- matching rules


def word_tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0)))


def term_in(text: Column, tokens: Column, term: Column) -> Column:
    """Plain words match whole tokens, anything else matches as a substring.

    ``text`` is lower-case and ``tokens`` are its words, so no pattern is compiled per row.
    """
    needle = F.lower(term)
    return F.when(needle.rlike("^[a-z0-9_]+$"), F.array_contains(tokens, needle)).otherwise(F.contains(text, needle))


def scope_rules(rules: DataFrame) -> DataFrame:
    """(scope, words, phrases, rules): per scope its rules by priority, and the distinct terms that they ask about.

    Words are looked up among the words of a text, phrases within the text itself.
    """
    terms = F.flatten(F.transform("clauses", lambda c: F.transform(c["terms"], lambda t: F.lower(t))))
    is_word = lambda t: t.rlike("^[a-z0-9_]+$")
    asked = rules.select("scope", F.explode(terms).alias("term")).distinct()
    listed = asked.groupBy("scope").agg(
        F.array_sort(F.collect_list(F.when(is_word(F.col("term")), F.col("term")))).alias("words"),
        F.array_sort(F.collect_list(F.when(~is_word(F.col("term")), F.col("term")))).alias("phrases"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("priority", "case_id", "clauses"))).alias("rules")
    return rules.groupBy("scope").agg(ordered).join(listed, "scope", "left")


def match_rules_table(claims: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """First rule (by priority) of the claim's scope whose any/all/not clauses all hold.

    claims: keys, input_scope, text. rules: scope, priority, case_id,
    clauses[struct(mode, terms[])]. Claims without a rule come back as FP.

    A claim is joined with one row, that of its scope. Its text is reduced once to the terms of the scope that it holds, and rules
    are tests on that set, so no text is copied or searched per rule.
    """
    text = F.lower(F.coalesce("text", F.lit("")))
    indexed = scope_rules(rules).withColumnRenamed("scope", "input_scope")
    joined = claims.select(*keys, "input_scope", "text").join(indexed, "input_scope", "left")
    held = F.concat(
        F.array_intersect(word_tokens(text), F.coalesce("words", F.array().cast("array<string>"))),
        F.filter(F.coalesce("phrases", F.array().cast("array<string>")), lambda t: F.contains(text, t)),
    )
    has = lambda t: F.array_contains(F.col("_held"), F.lower(t))

    def holds(clause: Column) -> Column:
        some = F.exists(clause["terms"], has)
        return F.when(clause["mode"] == "all", F.forall(clause["terms"], has)).when(clause["mode"] == "not", ~some).otherwise(some)

    fitting = F.filter("rules", lambda rule: F.forall(rule["clauses"], holds))
    case = F.try_element_at(fitting, F.lit(1))["case_id"]
    matched = joined.withColumn("_held", held).withColumn("_case", case)
    return matched.select(
        *keys,
        "input_scope",
        F.coalesce("_case", F.lit("")).alias("matched_case_id"),
        F.when(F.col("_case").isNotNull(), F.lit("TP")).otherwise(F.lit("FP")).alias("detection_match"),
    )


def default_evidence_quality(detection_match: Column, evidence_items: Column) -> Column:
    """A labelled default, not a measured quality: matched or evidenced findings are Sufficient."""
    return F.when((detection_match == "TP") | present(evidence_items).isNotNull(), "Sufficient").otherwise(F.lit("Unsupported"))


def mark_duplicates(findings: DataFrame) -> DataFrame:
    """Later true positives on a case already hit in the same run become duplicates of the first."""
    key = ["model_family", "method_name", "input_scope", "repetition", "matched_case_id"]
    firsts = (
        findings.filter(_is("detection_match", "TP"))
        .groupBy(*key)
        .agg(F.min_by("finding_uid", "ord").alias("_first"), F.min("ord").alias("_first_ord"))
    )
    later = _is("detection_match", "TP") & (F.col("ord") > F.col("_first_ord"))
    note = F.concat(
        F.lit("Duplicate of "), F.col("_first"), F.lit(": same run reports "), F.col("matched_case_id"), F.lit(" again. "),
        F.coalesce("review_notes", F.lit("")),
    )
    return (
        findings.join(firsts, key, "left")
        .withColumns(
            {
                "duplicate_of_finding_uid": F.when(later, F.col("_first")).otherwise(F.lit("")),
                "review_notes": F.when(later, note).otherwise(F.col("review_notes")),
                "detection_match": F.when(later, F.lit("Duplicate")).otherwise(F.col("detection_match")),
            }
        )
        .drop("_first", "_first_ord")
    )


def group_review(findings: DataFrame, examples_of: int = 5) -> DataFrame:
    """Per run, case and label: counts, the first finding and the first ``examples_of`` summaries."""
    keys = ["model_family", "method_name", "input_scope", "repetition", "matched_case_id", "detection_match"]
    counts = findings.groupBy(*keys).agg(
        F.min_by("finding_uid", "ord").alias("representative_finding_uid"),
        count_where(_is("detection_match", "Duplicate")).alias("duplicate_count"),
        count_where(_is("detection_match", "FP")).alias("fp_count"),
    )
    examples = ordered_text(findings, keys, "summary", "ord", "\n---\n", examples_of, "example_summaries")
    return counts.join(examples, keys)


# ---------------------------------------------------------------- status log and score tables


def latest_status(log: DataFrame, keys: list[str]) -> DataFrame:
    """Last row per run: partial aggregation first, so long logs of one run stay cheap."""
    fields = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*fields), F.col("ord")).alias("_l")).select(*keys, "_l.*")


def status_summary(log: DataFrame) -> DataFrame:
    latest = latest_status(log, ["batch_id", "run_id"])
    rows = log.groupBy("batch_id").agg(F.count(F.lit(1)).alias("status_rows"))
    return rows.join(
        latest.groupBy("batch_id").agg(
            F.count(F.lit(1)).alias("latest_unique_runs"),
            count_where(F.col("status") == "success").alias("latest_success"),
            count_where(F.col("status") == "failed").alias("latest_failed"),
        ),
        "batch_id",
    )


def repetition_of(name: Column) -> Column:
    number = F.regexp_extract(name, r"rep[_-]?([0-9]+)", 1)
    return F.when(number != "", number).otherwise(name)


def repetition_list(log: DataFrame) -> DataFrame:
    """Distinct repetitions per batch, "1" when none is known."""
    return log.groupBy("batch_id").agg(
        F.array_sort(F.collect_set(present(F.col("repetition")))).alias("_r")
    ).select("batch_id", F.when(F.size("_r") > 0, F.array_join("_r", ";")).otherwise(F.lit("1")).alias("repetitions"))


def alias_rows(gt: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """GT rows under their own scope and, where a rule applies, also under the prefixed scope."""
    alias = scope_alias(F.lower(F.trim("benchmark_id")), F.trim("input_scope"), aliases)
    names = F.array_distinct(F.array(F.col("input_scope"), alias))
    return gt.filter(F.col("input_scope") != "").withColumn("input_scope", F.explode(names))


def case_score_rows(runs: DataFrame, gt: DataFrame, aliases: dict[str, str]) -> DataFrame:
    cases = alias_rows(gt, aliases).select(
        "input_scope",
        "benchmark_id",
        F.coalesce(F.nullif("expected_case_id", F.lit("")), F.col("case_id"), F.lit("")).alias("case_id"),
        "case_visibility",
    )
    return runs.select("run_id", "input_scope").join(cases, "input_scope").select(
        "run_id", "input_scope", "benchmark_id", "case_id", "case_visibility",
        *[F.lit("").alias(c) for c in ("case_result", "matched_finding_ids", "miss_reason", "scorer_notes")],
    )


def run_metadata_rows(runs: DataFrame) -> DataFrame:
    stem = F.regexp_replace(F.regexp_extract("prompt_template_path", r"([^/\\]*)$", 1), r"(?<=.)\.[^.]+$", "")
    return runs.select(
        "run_id", "batch_id", "input_scope",
        F.col("method_name").alias("agent_mode"),
        F.col("model_id").alias("model_family"),
        F.col("model").alias("model_version"),
        "provider", "method_name",
        stem.alias("prompt_version"),
        F.lit("read_search_only").alias("tool_policy"),
        F.coalesce(F.col("repetition").cast("string"), F.lit("")).alias("run_index"),
        F.concat("run_dir", F.lit("/final_answer.json")).alias("output_path"),
    )


def finding_score_rows(findings: DataFrame) -> DataFrame:
    blanks = [
        "matched_case_id", "detection_match", "evidence_quality", "wrong_localization", "insufficient_evidence",
        "fabricated_evidence", "unsupported_claim", "overconfidence", "scorer_notes",
    ]
    return findings.select(
        "run_id", "finding_id", "input_scope",
        F.col("summary").alias("claimed_summary"),
        "claimed_files", "claimed_modules",
        F.col("claimed_signals_or_registers").alias("claimed_signals"),
        F.col("confidence").alias("confidence_label"),
        *[F.lit("").alias(c) for c in blanks],
    )


# The (empty) failure table that goes with the score tables.
FAILURE_TABLE_SCHEMA = (
    "run_id STRING, input_scope STRING, case_id_or_finding_id STRING, failure_manifestation STRING, "
    "failure_layer STRING, suspected_cause STRING, evidence_excerpt STRING, impact_on_engineer STRING, "
    "needs_followup STRING, notes STRING"
)


def _norm(name: str) -> Column:
    return F.lower(F.trim(F.coalesce(F.col(name), F.lit(""))))


def case_counters(prefix: str = "") -> list[Column]:
    visible = F.lower(F.trim(F.coalesce("case_visibility", F.lit("visible")))) == "visible"
    result = _norm("case_result")
    return [
        count_where(visible & (result == v)).alias(f"{prefix}{v}_cases") for v in ("tp", "partial", "fn")
    ]


def _finding_flags() -> dict[str, Column]:
    match, quality = _norm("detection_match"), _norm("evidence_quality")
    scored = match.isin("tp", "partial", "fp")
    yes = lambda c: _norm(c) == "yes"
    bad = {
        "insufficient_evidence_count": (quality == "insufficient") | yes("insufficient_evidence"),
        "fabricated_evidence_count": (quality == "fabricated") | yes("fabricated_evidence"),
        "unsupported_claim_count": (quality == "unsupported") | yes("unsupported_claim"),
    }
    any_bad = bad["insufficient_evidence_count"] | bad["fabricated_evidence_count"] | bad["unsupported_claim_count"]
    flags = {f"{v}_findings": match == v for v in ("tp", "partial", "fp")}
    flags["wrong_localization_count"] = scored & yes("wrong_localization")
    flags["evidence_failure_count"] = scored & any_bad
    flags.update({k: scored & v for k, v in bad.items()})
    flags["overconfidence_count"] = scored & yes("overconfidence")
    return flags


def _summary_rates(df: DataFrame) -> DataFrame:
    c = F.col
    expected = c("tp_cases") + c("partial_cases") + c("fn_cases")
    scored = c("tp_findings") + c("partial_findings") + c("fp_findings")
    return df.withColumns(
        {
            "num_expected_cases": expected,
            "precision": ratio(c("tp_findings"), c("tp_findings") + c("fp_findings")),
            "recall": ratio(c("tp_cases"), expected),
            "partial_rate": ratio(c("partial_cases"), expected),
            "fp_rate": ratio(c("fp_findings"), scored),
            "fn_rate": ratio(c("fn_cases"), expected),
            "localization_error_rate": ratio(c("wrong_localization_count"), scored),
            "evidence_failure_rate": ratio(c("evidence_failure_count"), scored),
            "overconfidence_rate": ratio(c("overconfidence_count"), scored),
        }
    )


def run_summary(metadata: DataFrame, cases: DataFrame, findings: DataFrame) -> DataFrame:
    """Full outer join of three per-run aggregates."""
    scope = present(F.col("input_scope"))
    first_scope = F.min_by(scope, F.when(scope.isNotNull(), F.col("ord")))
    by_case = cases.groupBy("run_id").agg(*case_counters(), first_scope.alias("_case_scope"))
    by_finding = findings.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("num_findings"),
        *[count_where(v).alias(k) for k, v in _finding_flags().items()],
        first_scope.alias("_finding_scope"),
    )
    joined = metadata.join(by_case, "run_id", "full").join(by_finding, "run_id", "full")
    numbers = [c for c, t in joined.dtypes if t == "bigint"]
    scope = F.coalesce("input_scope", "_case_scope", "_finding_scope", F.lit(""))
    out = _summary_rates(joined.fillna(0, numbers).withColumn("input_scope", scope))
    return out.drop("_case_scope", "_finding_scope").fillna("", [c for c in metadata.columns if c != "run_id"])


def benchmark_by_run(cases: DataFrame) -> DataFrame:
    """First non-blank benchmark per run."""
    return (
        cases.filter("run_id <> '' AND benchmark_id <> ''").groupBy("run_id").agg(F.min_by("benchmark_id", "ord").alias("_bench"))
    )


def with_model_and_benchmark(df: DataFrame, metadata: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """Model from the row, else from the run; benchmark from the row, else from the run's cases."""
    own = lambda n: F.nullif(F.col(n), F.lit("")) if n in df.columns else F.lit(None).cast("string")
    models = metadata.select("run_id", F.col("model_family").alias("_model"))
    return (
        df.join(models, "run_id", "left")
        .join(benchmarks, "run_id", "left")
        .withColumns(
            {
                "model_family": F.coalesce(own("model_family"), "_model", F.lit("")),
                "benchmark_id": F.coalesce(own("benchmark_id"), "_bench", F.lit("")),
            }
        )
        .drop("_model", "_bench")
    )


LEVELS = [[], ["model_family"], ["model_family", "benchmark_id"], ["model_family", "benchmark_id", "input_scope"]]


def _grouped(df: DataFrame, levels: list[list[str]], aggs: list[Column]) -> DataFrame:
    cols = [F.col(c) for c in LEVELS[-1]]
    sets = [[F.col(c) for c in level] for level in levels]
    out = df.groupingSets(sets, *cols).agg(*aggs, (F.grouping_id()).alias("_gid"))
    return out.fillna("", LEVELS[-1]).withColumn(
        "level",
        F.when(F.col("_gid") == 0, "model_scope").when(F.col("_gid") == 1, "model_benchmark")
        .when(F.col("_gid") == 3, "model").otherwise(F.lit("global")),
    ).drop("_gid")


def runs_by_level(rows: DataFrame) -> DataFrame:
    """(finest level, _runs_0 to _runs_3): how many runs are met there for the first time within each level; rows(level columns, run_id).

    A run is met first in one row of each of its groups at a level, so the distinct runs of a group are a sum over its finest levels.
    """
    finest = LEVELS[-1]
    runs = rows.fillna("", finest).filter("run_id <> ''").distinct()
    no = F.row_number().over(W.partitionBy("run_id").orderBy(*finest))
    before = {c: F.lag(c).over(W.partitionBy("run_id").orderBy(*finest)) for c in finest}
    marked = runs.withColumns({"_no": no, **{f"_before_{c}": v for c, v in before.items()}})
    firsts = []
    for depth, level in enumerate(LEVELS):
        first = F.col("_no") == 1
        for name in level:
            first = first | (F.col(name) != F.col(f"_before_{name}"))
        firsts.append(count_where(first).alias(f"_runs_{depth}"))
    return marked.groupBy(*finest).agg(*firsts)


def multi_level_summary(metadata: DataFrame, cases: DataFrame, findings: DataFrame) -> DataFrame:
    """The same counters at four levels, summed from the finest one; the tables are read once, to a row per run and finest level.

    metadata carries model_family, benchmark_id and input_scope (see with_model_and_benchmark).
    """
    finest = LEVELS[-1]
    keys = [*finest, "run_id"]
    flags = _finding_flags()
    c = cases.groupBy(*keys).agg(*case_counters())
    f = findings.groupBy(*keys).agg(F.count(F.lit(1)).alias("num_findings"), *[count_where(v).alias(k) for k, v in flags.items()])
    m = metadata.select(*keys).distinct()
    per_run = persist_table(m.unionByName(c, allowMissingColumns=True).unionByName(f, allowMissingColumns=True), "per-run")
    numbers = [n for n in per_run.columns if n not in keys]
    counted = per_run.groupBy(*finest).agg(*[F.sum(n).alias(n) for n in numbers])
    runs = runs_by_level(per_run.select(*keys))
    firsts = [n for n in runs.columns if n not in finest]
    rows = counted.unionByName(runs, allowMissingColumns=True).fillna(0, [*numbers, *firsts]).fillna("", finest)
    out = _grouped(rows, LEVELS, [F.sum(n).alias(n) for n in [*firsts, *numbers]])
    names = ["global", "model", "model_benchmark", "model_scope"]
    of_level = F.coalesce(*[F.when(F.col("level") == name, F.col(n)) for name, n in zip(names, firsts, strict=True)])
    return _summary_rates(out.select(*finest, of_level.alias("num_runs"), *numbers, "level"))


def anyhit_precedence(cases: DataFrame) -> DataFrame:
    """TP before Partial before FN over all repetitions of a visible case."""
    visible = F.lower(F.trim(F.coalesce("case_visibility", F.lit("visible")))) == "visible"
    keys = ["model_family", "benchmark_id", "input_scope", "case_id"]
    result = _norm("case_result")
    rank = F.when(result == "tp", 0).when(result == "partial", 1).when(result == "fn", 2)
    complete = (F.col("model_family") != "") & (F.col("input_scope") != "") & (F.col("case_id") != "")
    return (
        cases.filter(visible & complete).groupBy(*keys).agg(F.min(rank).alias("_r")).filter(F.col("_r").isNotNull())
        .select(*keys, F.element_at(F.array(F.lit("TP"), F.lit("Partial"), F.lit("FN")), F.col("_r") + 1).alias("case_result"))
    )


def anyhit_levels(anyhit: DataFrame) -> DataFrame:
    result = _norm("case_result")
    aggs = [count_where(result == v).alias(f"{v}_cases") for v in ("tp", "partial", "fn")]
    out = _grouped(anyhit, LEVELS[1:], aggs)
    n = F.col("tp_cases") + F.col("partial_cases") + F.col("fn_cases")
    return out.withColumns(
        {
            "num_cases": n,
            "recall": ratio(F.col("tp_cases"), n),
            "partial_rate": ratio(F.col("partial_cases"), n),
            "fn_rate": ratio(F.col("fn_cases"), n),
        }
    )


# ---------------------------------------------------------------- groups of ground truth


def group_ground_truth(gt: DataFrame, hits: DataFrame, group: str) -> DataFrame:
    """Per group of cases: how many there are, are hit and are missed; ``union_cases`` counts all cases of either table.

    gt(group, case_id), hits(case_id). A case that stands in several groups counts in each, repeated rows count as they stand; the
    union counts distinct cases, and a case that is hit but in no group belongs to it alone.
    """
    hit = hits.select("case_id").distinct()
    marked = gt.select(group, "case_id").join(hit.withColumn("_hit", F.lit(True)), "case_id", "left").withColumn("_hit", F.col("_hit").isNotNull())
    union = gt.select("case_id").union(hit).distinct()
    counts = marked.groupBy(group).agg(
        F.count(F.lit(1)).alias("gt_cases"), count_where(F.col("_hit")).alias("hit_cases"), count_where(~F.col("_hit")).alias("missed_cases")
    )
    return counts.withColumn("union_cases", union.agg(F.count(F.lit(1))).scalar())
