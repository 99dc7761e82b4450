"""Parsing stored model responses and checking them against the evidence they cite."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evigraph.functions.scan import numbered, ordered_scan, row_no
from evigraph.functions.values import contains_any, count_where, padded, within
from evigraph.operators.context import snippet_text

# Vocabulary of a response.
EVIDENCE_ROLES = [
    "access_entry", "permission_state", "guard_logic", "protected_resource", "lifecycle_behavior", "debug_or_test_control", "violation", "impact",
]
CONFIDENCES = ["high", "medium", "low"]
TOOLS = ["read_around", "search_in_file"]
INPUT_KEYS = ["input_tokens", "prompt_tokens", "input_token_count", "prompt_token_count"]
OUTPUT_KEYS = ["output_tokens", "completion_tokens", "output_token_count", "completion_token_count", "candidates_token_count"]
TOTAL_KEYS = ["total_tokens", "total_token_count"]
USAGE_PATHS = ["usage_metadata", "response_metadata.token_usage", "response_metadata.usage", "response_metadata.usage_metadata"]
FORBIDDEN_PATHS = ["gt_cases", "evidence_gt", "case", "cases", "scoring", "finding_review"]


def _parses(text: Column) -> Column:
    # The parser ignores what follows a value; inside brackets it cannot.
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return F.try_variant_get(listed, "$[0]", "variant").isNotNull() & F.try_variant_get(listed, "$[1]", "variant").isNull()


def extract_json(rows: DataFrame, text: Column, out: str = "payload") -> DataFrame:
    """Adds the JSON text of a response: without its code fence, else from the first { to the last }; NULL if neither parses."""
    rows = rows.withColumn("_trimmed", F.regexp_replace(text, r"^\s+|\s+\z", ""))
    bare = F.regexp_replace(F.regexp_replace("_trimmed", r"^```(?i:json)?\s*", ""), r"\s*```\z", "")
    rows = rows.withColumn("_clean", F.when(F.startswith("_trimmed", F.lit("```")), bare).otherwise(F.col("_trimmed")))
    rows = rows.withColumn("_whole", (F.col("_clean") != "") & _parses(F.col("_clean")))
    inner = F.when(~F.col("_whole"), F.nullif(F.regexp_extract("_clean", r"(?s)\{.*\}", 0), F.lit("")))
    rows = rows.withColumn("_inner", inner)
    payload = F.when(F.col("_whole"), F.col("_clean")).when(_parses(F.col("_inner")), F.col("_inner"))
    return rows.withColumn(out, payload).drop("_trimmed", "_clean", "_whole", "_inner")


def content_text(blocks: Column) -> Column:
    """Text of content blocks: reasoning skipped, ``text`` before ``content``, blanks dropped."""
    shown = F.filter(blocks, lambda b: ~F.lower(F.coalesce(b["type"], F.lit(""))).isin("thinking", "reasoning"))
    parts = F.transform(shown, lambda b: F.coalesce(b["text"], b["content"]))
    parts = F.filter(parts, lambda t: t.isNotNull() & t.rlike(r"\S"))
    return F.regexp_replace(F.array_join(parts, "\n"), r"^\s+|\s+\z", "")


def message_text(content: Column) -> Column:
    """Text of a message from the JSON of its content: a string as it is, a list block by block, anything else written out.

    Of a list, objects of type thinking or reasoning are skipped; others give their ``text`` or else their ``content`` where
    that is a string, bare items are written out. If nothing readable is left, or it is neither, the content stays as it is.
    """
    doc = F.try_parse_json(content)
    plain = F.try_variant_get(doc, "$", "string")
    blocks = F.try_variant_get(doc, "$", "array<variant>")

    def string_at(block: Column, path: str) -> Column:
        value = F.try_variant_get(block, path, "variant")
        return F.when(_kind(value) == "STRING", F.try_variant_get(block, path, "string"))

    def one(block: Column) -> Column:
        kind = F.lower(F.coalesce(F.try_variant_get(block, "$.type", "string"), F.lit("")))
        bare = ~F.startswith(_kind(block), F.lit("OBJECT"))
        found = F.coalesce(string_at(block, "$.text"), string_at(block, "$.content"))
        return F.when(bare, F.try_variant_get(block, "$", "string")).when(~kind.isin("thinking", "reasoning"), found)

    parts = F.filter(F.transform(blocks, one), lambda t: t.isNotNull() & t.rlike(r"\S"))
    joined = F.regexp_replace(F.array_join(parts, "\n"), r"^\s+|\s+\z", "")
    listed = F.startswith(_kind(doc), F.lit("ARRAY"))
    return (
        F.when(doc.isNull(), content)
        .when(_kind(doc) == "STRING", plain)
        .when(listed, F.coalesce(F.nullif(joined, F.lit("")), content))
        .otherwise(content)
    )


def estimated_tokens(text: Column) -> Column:
    return F.when(F.length(F.coalesce(text, F.lit(""))) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor((F.length(text) + 3) / 4))).cast("long")


def token_usage(usage: Column, prompt: Column, output: Column) -> Column:
    """struct(input_tokens, output_tokens, total_tokens, token_usage_source) from the first usable usage object."""

    def first_int(path: str, keys: list[str]) -> Column:
        return F.coalesce(*[F.get_json_object(usage, f"$.{path}.{k}").try_cast("long") for k in keys])

    candidates = []
    for path in USAGE_PATHS:
        i, o, t = first_int(path, INPUT_KEYS), first_int(path, OUTPUT_KEYS), first_int(path, TOTAL_KEYS)
        zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
        value = F.struct(
            zero(i).alias("input_tokens"), zero(o).alias("output_tokens"), F.coalesce(t, zero(i) + zero(o)).alias("total_tokens"), F.lit("api").alias("token_usage_source")
        )
        candidates.append(F.when(i.isNotNull() | o.isNotNull() | t.isNotNull(), value))
    a, b = estimated_tokens(prompt), estimated_tokens(output)
    guess = F.struct(a.alias("input_tokens"), b.alias("output_tokens"), (a + b).alias("total_tokens"), F.lit("estimated_char4").alias("token_usage_source"))
    return F.coalesce(*candidates, guess)


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _field(doc: Column, path: str) -> Column:
    return F.try_variant_get(doc, path, "variant")


@dataclass(frozen=True)
class Rule:
    """One value of a document: where it is, of which kind, which values it may have, whether it must be there.

    A path with ``[]`` leads into each item of a list. Objects that are not there excuse what is below them if ``optional`` names
    their path. Kinds: text, flag, whole (a whole number, or text that is one), list.
    """

    path: str
    kind: str = "text"
    values: tuple[str, ...] = ()
    required: bool = True
    nullable: bool = False


def _value_ok(doc: Column, path: str, rule: Rule) -> Column:
    value = _field(doc, path)
    kind, text = _kind(value), F.try_variant_get(doc, path, "string")
    if rule.kind == "flag":
        good = (kind == "BOOLEAN") | F.lower(text).isin("true", "false", "yes", "no", "on", "off", "t", "f", "y", "n", "1", "0")
    elif rule.kind == "whole":
        number = F.try_variant_get(doc, path, "double")
        is_number = kind.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)") & (number == F.floor(number))
        good = is_number | (kind == "BOOLEAN") | ((kind == "STRING") & F.trim(text).rlike(r"^[+-]?\d+$"))
    elif rule.kind == "list":
        good = F.startswith(kind, F.lit("ARRAY"))
    else:
        good = kind == "STRING"
        if rule.values:
            good = good & text.isin(*rule.values)
    missing = F.lit(not rule.required)
    null = F.lit(rule.nullable)
    return F.when(value.isNull(), missing).when(kind == "VOID", null).otherwise(F.coalesce(good, F.lit(False)))


def _items_ok(items: Column, path: str, rule: Rule) -> Column:
    return items.isNull() | F.forall(items, lambda item: _value_ok(item, path, rule))


def document_valid(doc: Column, rules: list[Rule], optional: tuple[str, ...] = ()) -> Column:
    """Whether a VARIANT keeps all rules; unknown fields are allowed. Objects named in ``optional`` may be absent or null."""
    checks = []
    for rule in rules:
        outer, _, inner = rule.path.partition("[].")
        if inner:
            ok = _items_ok(F.try_variant_get(doc, outer, "array<variant>"), f"$.{inner}", rule)
        else:
            ok = _value_ok(doc, rule.path, rule)
        for parent in optional:
            if rule.path.startswith(f"{parent}."):
                body = _field(doc, parent)
                ok = body.isNull() | F.coalesce(_kind(body) == "VOID", F.lit(False)) | ok
        checks.append(F.coalesce(ok, F.lit(False)))
    return reduce(lambda a, b: a & b, checks)


def _analysis_rules(evidence: list[Rule]) -> list[Rule]:
    finding = "$.finding"
    return [
        Rule("$.chain_id"),
        Rule("$.has_finding", "flag"),
        Rule("$.no_finding_reason", required=False),
        Rule(f"{finding}.summary"),
        Rule(f"{finding}.reasoning_summary"),
        Rule(f"{finding}.security_impact"),
        Rule(f"{finding}.confidence", values=tuple(CONFIDENCES), required=False),
        Rule(f"{finding}.uncertainty_or_missing_evidence", required=False),
        Rule(f"{finding}.evidence", "list", required=False),
        *[replace(rule, path=f"{finding}.evidence[].{rule.path}") for rule in evidence],
    ]


def _evidence_rules(*own: Rule) -> list[Rule]:
    return [*own, Rule("evidence_role", values=tuple(EVIDENCE_ROLES)), Rule("description"), Rule("supports_claim")]


#: An analysis that cites snippets, and one that cites files and lines itself.
ANALYSIS_RULES = _analysis_rules(_evidence_rules(Rule("snippet_id")))
TOOL_ANALYSIS_RULES = _analysis_rules(
    _evidence_rules(Rule("file"), Rule("line_start", "whole"), Rule("line_end", "whole"), Rule("module", required=False), Rule("object", required=False))
)
#: A request for tool actions.
TOOL_ACTION_RULES = [
    Rule("$.chain_id"),
    Rule("$.actions", "list", required=False),
    Rule("$.actions[].tool", values=tuple(TOOLS)),
    Rule("$.actions[].file"),
    Rule("$.actions[].line_start", "whole", required=False, nullable=True),
    Rule("$.actions[].line_end", "whole", required=False, nullable=True),
    Rule("$.actions[].query", required=False, nullable=True),
    Rule("$.actions[].reason", required=False),
]
#: Documents and the objects in them that may be absent.
SCHEMAS = {"analysis": (ANALYSIS_RULES, ("$.finding",)), "tool_analysis": (TOOL_ANALYSIS_RULES, ("$.finding",)), "tool_actions": (TOOL_ACTION_RULES, ())}


def response_problem(rows: DataFrame, payload: str = "payload", out: str = "failure_stage", schema: str = "analysis") -> DataFrame:
    """Adds '' for a valid response, else the stage it fails at: json_extract or schema_validate."""
    rows = rows.withColumn("_doc", F.try_parse_json(F.col(payload)))
    doc = F.col("_doc")
    rules, optional = SCHEMAS[schema]
    stage = F.when(F.col(payload).isNull() | doc.isNull(), "json_extract").when(~document_valid(doc, rules, optional), "schema_validate").otherwise(F.lit(""))
    return rows.withColumn(out, stage).drop("_doc")


ANALYSIS_SCHEMA = (
    "struct<chain_id:string,has_finding:boolean,no_finding_reason:string,finding:struct<summary:string,reasoning_summary:string,security_impact:string,"
    "confidence:string,uncertainty_or_missing_evidence:string,evidence:array<struct<snippet_id:string,evidence_role:string,description:string,supports_claim:string>>>>"
)


def parse_analysis(payload: Column) -> Column:
    return F.from_json(payload, ANALYSIS_SCHEMA)


# ---------------------------------------------------------------- evidence


def range_valid(start: Column, end: Column, line_count: Column) -> Column:
    return F.coalesce((start >= 1) & (end >= start) & (end <= line_count), F.lit(False))


def check_evidence(evidence: DataFrame, snippets: DataFrame, files: DataFrame, chain_keys: list[str], file_keys: list[str]) -> DataFrame:
    """Evidence rows with their snippet's range and whether it is valid.

    evidence(chain_keys, ev_no, snippet_id, evidence_role), snippets(chain_keys,
    snippet_id, file, line_start, line_end, ...), files(file_keys, line_count).
    """
    joined = evidence.join(snippets.withColumn("_known", F.lit(True)), [*chain_keys, "snippet_id"], "left").join(files, file_keys, "left")
    known = F.coalesce(F.col("_known"), F.lit(False))
    ok = known & range_valid(F.col("line_start"), F.col("line_end"), F.col("line_count"))
    return joined.withColumns({"known_snippet": known, "valid": ok}).drop("_known", "line_count")


def evidence_verdict(checked: DataFrame, chain_keys: list[str], require_violation: bool = True) -> DataFrame:
    """Per chain: valid items, status, reason and the location (first violation, else first valid item)."""
    valid = F.col("valid")
    violation = valid & (F.col("evidence_role") == "violation")
    place = F.struct("file", "line_start", "line_end")
    out = checked.groupBy(*chain_keys).agg(
        count_where(valid).alias("valid_evidence"),
        count_where(violation).alias("violations"),
        count_where(~F.col("known_snippet")).alias("invalid_snippet_ids"),
        F.min_by(place, F.when(valid, F.struct((~violation).alias("a"), F.col("ev_no").alias("b")))).alias("_loc"),
    )
    reason = F.when(F.col("valid_evidence") == 0, "no_valid_evidence")
    if require_violation:
        reason = reason.when(F.col("violations") == 0, "missing_violation_evidence")
    reason = reason.otherwise(F.lit(""))
    status = F.when(reason == "", "accepted").otherwise(F.lit("discarded"))
    kept = F.when(reason == "", F.col("_loc"))
    return out.select(
        *chain_keys, "valid_evidence", "violations", "invalid_snippet_ids", status.alias("status"), reason.alias("discard_reason"),
        kept["file"].alias("file"), kept["line_start"].alias("line_start"), kept["line_end"].alias("line_end"),
    )


def check_ranges(evidence: DataFrame, files: DataFrame, file_keys: list[str]) -> DataFrame:
    """Evidence that names file and lines itself, checked against the corpus."""
    joined = evidence.join(files, file_keys, "left")
    return joined.withColumn("valid", range_valid(F.col("line_start"), F.col("line_end"), F.col("line_count"))).drop("line_count")


def first_nonblank(members: DataFrame, nodes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """First non-empty value of each column along the ordered node ids; members(keys, pos, node_id)."""
    joined = members.join(nodes.select("node_id", *columns), "node_id", "left")
    pick = lambda c: F.coalesce(F.min_by(c, F.when(F.col(c) != "", F.col("pos"))), F.lit("")).alias(c)
    return joined.groupBy(*keys).agg(*[pick(c) for c in columns])


# ---------------------------------------------------------------- outcomes


def outcomes(rows: DataFrame) -> DataFrame:
    """Status per chain and ids of accepted findings.

    rows(scope_id, chain_id, ord, failed, answered_chain_id, has_finding,
    has_body, verdict), where verdict is that of the evidence check.
    """
    status = (
        F.when(F.col("failed"), "llm_failed")
        .when(~F.col("answered_chain_id").eqNullSafe(F.col("chain_id")), "chain_id_mismatch")
        .when(~F.coalesce("has_finding", F.lit(False)), "no_finding")
        .when(~F.coalesce("has_body", F.lit(False)), "discarded")
        .otherwise(F.coalesce("verdict", F.lit("discarded")))
    )
    rows = rows.withColumn("status", status)
    accepted = ordered_scan(rows.filter("status = 'accepted'"), ["scope_id"], [F.col("ord")], {"_n": row_no()})
    ids = accepted.select("scope_id", "chain_id", padded("F-", F.col("_n"), 3).alias("finding_id"))
    return rows.join(ids, ["scope_id", "chain_id"], "left").fillna("", ["finding_id"])


def outcome_counters(rows: DataFrame) -> DataFrame:
    status = F.col("status")
    raw = ~status.isin("llm_failed") & F.coalesce("has_finding", F.lit(False))
    return rows.groupBy("scope_id").agg(
        F.count(F.lit(1)).alias("analyzed_chain_count"),
        count_where(status == "accepted").alias("final_finding_count"),
        count_where(raw).alias("raw_llm_finding_count"),
        count_where(status.isin("llm_failed", "chain_id_mismatch", "discarded")).alias("discarded_finding_count"),
        count_where(status == "no_finding").alias("no_finding_count"),
    )


# ---------------------------------------------------------------- tools over the corpus


def allowed_files(locations: DataFrame, keys: list[str]) -> DataFrame:
    rows = locations.filter(F.coalesce("file", F.lit("")) != "").select(*keys, "file").distinct()
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list("file")).alias("allowed_files"))


def judge_actions(actions: DataFrame, allowed: DataFrame, files: DataFrame, keys: list[str], max_calls: int | None = None) -> DataFrame:
    """Actions of each chain (the first ``max_calls``, where given): denied outside the allowlist, error for a missing file, else ok.

    actions(keys, action_no, file), allowed(keys, file), files(file).
    """
    window = W.partitionBy(*keys).orderBy("action_no")
    first = within(actions.withColumn("_r", F.row_number().over(window)), "_r", max_calls).drop("_r")
    ok = allowed.select(*keys, "file").distinct().withColumn("_ok", F.lit(True))
    there = files.select("file").distinct().withColumn("_there", F.lit(True))
    joined = first.join(ok, [*keys, "file"], "left").join(there, "file", "left")
    hidden = contains_any(F.lower(F.replace("file", F.lit("\\"), F.lit("/"))), FORBIDDEN_PATHS)
    status = F.when(F.col("_ok").isNull() | hidden, "denied").when(F.col("_there").isNull(), "error").otherwise(F.lit("ok"))
    return joined.withColumn("status", status).drop("_ok", "_there")


def search_lines(lines: DataFrame, needles: list[str], file_order: Column, case_sensitive: bool = False, max_matches: int | None = None) -> DataFrame:
    """Lines that contain each needle, numbered by file and line."""
    text = F.col("line") if case_sensitive else F.lower("line")
    words = [n if case_sensitive else n.lower() for n in needles]
    found = F.array_compact(F.array(*[F.when(F.contains(text, F.lit(w)), F.lit(w)) for w in words]))
    rows = lines.withColumn("query", F.explode(found)).withColumn("_o", file_order)
    ranked = numbered(rows, ["query"], [F.col("_o"), F.col("line_no")], "match_no", max_matches).withColumn("match_no", F.col("match_no").cast("int"))
    return ranked.withColumn("line", F.regexp_replace("line", r"^\s+|\s+\z", "")).drop("_o")


def read_around(
    requests: DataFrame, lines: DataFrame, files: DataFrame, file_keys: list[str], keys: list[str], before: int = 10, after: int = 18, limit: int | None = None
) -> DataFrame:
    """Numbered lines around a requested range; ``limit`` cuts them at a number of characters."""
    first = F.coalesce(F.nullif("line_start", F.lit(0)), F.lit(1))
    last = F.coalesce(F.nullif("line_end", F.lit(0)), F.nullif("line_start", F.lit(0)), F.lit(1))
    wanted = requests.join(files, file_keys).withColumns(
        {"range_start": F.greatest(F.lit(1), first - before), "range_end": F.least("line_count", last + after)}
    )
    texts = snippet_text(wanted.drop("line_count"), lines, file_keys, keys)
    if limit is None:
        return texts.withColumnRenamed("code", "content")
    cut = F.when(F.length("code") <= limit, F.col("code")).otherwise(F.concat(F.left("code", F.lit(limit)), F.lit("\n[TRUNCATED]")))
    return texts.withColumn("content", cut).drop("code")
