"""Evaluation queries (j01 to j29)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import domain
from catalog.registry import query, table, texts
from evigraph.functions.values import count_where
from evigraph.operators import clusters, evaluate

ALIASES = {"b1": "h_"}

METRIC_SQL = """
round(CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) END, 6) AS precision,
round(CASE WHEN tp_cases + fn_cases > 0 THEN tp_cases::DOUBLE / (tp_cases + fn_cases) END, 6) AS recall,
round(CASE WHEN tp > 0 THEN suff::DOUBLE / tp END, 6) AS evidence_sufficiency_rate,
round(CASE WHEN tp + fp > 0 THEN unsup::DOUBLE / (tp + fp) END, 6) AS fabricated_unsupported_evidence_rate
"""

RUN_METRICS_SQL = f"""
runs AS (
  SELECT model_family, method_name, repetition,
         count(*) FILTER (detection_match = 'TP') AS tp, count(*) FILTER (detection_match = 'FP') AS fp,
         count(*) FILTER (detection_match = 'TP' AND evidence_quality = 'Sufficient') AS suff,
         count(*) FILTER (detection_match IN ('TP', 'FP') AND evidence_quality IN ('Fabricated', 'Unsupported')) AS unsup
  FROM findings GROUP BY ALL),
expected AS (
  SELECT DISTINCT f.model_family, f.method_name, f.repetition, g.case_id
  FROM (SELECT DISTINCT model_family, method_name, repetition, input_scope FROM findings) f JOIN gt g USING (input_scope)),
hits AS (
  SELECT DISTINCT model_family, method_name, repetition, matched_case_id AS case_id
  FROM findings WHERE detection_match = 'TP' AND matched_case_id <> ''),
counted AS (
  SELECT r.*, (SELECT count(*) FROM expected e WHERE e.model_family = r.model_family AND e.method_name = r.method_name
                 AND e.repetition = r.repetition) AS num_gt_cases,
         (SELECT count(*) FROM expected e JOIN hits h USING (model_family, method_name, repetition, case_id)
          WHERE e.model_family = r.model_family AND e.method_name = r.method_name AND e.repetition = r.repetition) AS tp_cases
  FROM runs r),
rates AS (
  SELECT *, {METRIC_SQL} FROM (SELECT *, num_gt_cases - tp_cases AS fn_cases FROM counted)),
run_metrics AS (
  SELECT model_family, method_name, repetition, num_gt_cases, tp_cases, fn_cases, tp AS tp_findings, fp AS fp_findings,
         precision, recall,
         CASE WHEN precision + recall > 0 THEN round(2 * precision * recall / (precision + recall), 6) END AS f1_score,
         evidence_sufficiency_rate, fabricated_unsupported_evidence_rate
  FROM rates)
"""

ANYHIT_SQL = """
identity_scopes AS (SELECT DISTINCT model_family, method_name, input_scope FROM findings),
tp_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY model_family, method_name, matched_case_id ORDER BY
           CASE evidence_quality WHEN 'Sufficient' THEN 0 WHEN 'Insufficient' THEN 1 WHEN 'Unclear' THEN 2
                WHEN 'Unsupported' THEN 3 WHEN 'Fabricated' THEN 4 ELSE 99 END, finding_uid) AS rn
  FROM findings WHERE detection_match = 'TP' AND matched_case_id <> ''),
hit_reps AS (
  SELECT model_family, method_name, matched_case_id, string_agg(DISTINCT repetition, ';' ORDER BY repetition) AS reps
  FROM tp_ranked GROUP BY ALL),
anyhit AS (
  SELECT s.model_family, s.method_name, s.input_scope, g.benchmark_id, g.case_id,
         CASE WHEN t.finding_uid IS NULL THEN 'FN' ELSE 'TP' END AS case_result,
         coalesce(h.reps, '') AS hit_repetitions, coalesce(t.finding_uid, '') AS representative_finding_uid,
         coalesce(t.evidence_quality, '') AS representative_evidence_quality
  FROM identity_scopes s JOIN gt g USING (input_scope)
  LEFT JOIN tp_ranked t ON t.rn = 1 AND t.model_family = s.model_family AND t.method_name = s.method_name AND t.matched_case_id = g.case_id
  LEFT JOIN hit_reps h ON h.model_family = s.model_family AND h.method_name = s.method_name AND h.matched_case_id = g.case_id)
"""


# ------------------------------------------------------------ j01 to j06


@query(
    "j01_gt_assembly",
    """
WITH m AS (
  SELECT 'C' || o_custkey AS case_id, arg_min(struct_pack(b := 'b' || (o_orderkey % 3), s := o_orderpriority, r := 'order ' || o_orderkey), o_orderkey) AS v
  FROM orders WHERE o_orderstatus <> 'P' AND o_custkey % 50 <> 0 GROUP BY o_custkey),
tr AS (
  SELECT o_custkey, 'third_party/b' || (o_orderkey % 3) || '/rtl/' || o_orderpriority AS file, 'mod' || (o_orderkey % 5) AS module,
         o_orderstatus AS sig, min(o_orderkey) AS o FROM orders GROUP BY ALL),
x AS (
  SELECT m.case_id, m.v.b AS benchmark_id, m.v.s AS sc, m.v.r AS reason, c.*
  FROM m JOIN customer c ON m.case_id = 'C' || c.c_custkey),
files AS (
  SELECT case_id, string_agg(f, '; ' ORDER BY o) AS gt_files FROM (
    SELECT x.case_id, CASE WHEN starts_with(tr.file, 'third_party/' || x.benchmark_id || '/') THEN substr(tr.file, length('third_party/' || x.benchmark_id || '/') + 1) ELSE tr.file END AS f, min(o) AS o
    FROM x JOIN tr ON tr.o_custkey = x.c_custkey GROUP BY 1, 2) GROUP BY 1),
mods AS (SELECT o_custkey, string_agg(module, '; ' ORDER BY o) AS v FROM (SELECT o_custkey, module, min(o) AS o FROM tr GROUP BY ALL) GROUP BY 1),
sigs AS (SELECT o_custkey, string_agg(sig, '; ' ORDER BY o) AS v FROM (SELECT o_custkey, sig, min(o) AS o FROM tr GROUP BY ALL) GROUP BY 1)
SELECT x.case_id, benchmark_id,
  CASE WHEN benchmark_id = 'b1' AND NOT starts_with(sc, 'h_') THEN 'h_' || sc ELSE sc END AS input_scope,
  CASE WHEN c_nationkey < 10 THEN c_name WHEN c_custkey % 2 = 1 THEN 'task ' || c_name WHEN c_nationkey % 2 = 0 THEN 'nation ' || c_nationkey ELSE '' END AS official_description,
  CASE WHEN c_custkey % 2 = 1 AND c_mktsegment <> 'BUILDING' THEN c_mktsegment WHEN c_custkey % 2 = 1 THEN 'relevant ' || c_custkey ELSE reason END AS case_description,
  CASE WHEN c_nationkey % 2 = 0 THEN files.gt_files ELSE '' END AS gt_files,
  CASE WHEN c_nationkey % 4 = 0 THEN 'given; ' || c_mktsegment WHEN c_nationkey % 2 = 0 THEN mods.v ELSE '' END AS gt_modules,
  CASE WHEN c_nationkey % 2 = 0 THEN sigs.v ELSE '' END AS gt_signals_or_registers,
  concat_ws('; ', CASE WHEN c_nationkey % 2 = 0 THEN 'hit ' || c_mktsegment END, CASE WHEN c_custkey % 2 = 1 THEN 'task note' END) AS gt_evidence_notes,
  'datasets/benchmarks/' || benchmark_id || '/cases/' || x.case_id || '.md' AS case_doc_path
FROM x LEFT JOIN files USING (case_id) LEFT JOIN mods ON mods.o_custkey = x.c_custkey LEFT JOIN sigs ON sigs.o_custkey = x.c_custkey
""",
)
def j01(spark, sf):
    orders, customer = table(spark, sf, "orders"), table(spark, sf, "customer")
    key = F.col("o_orderkey")
    mapping = orders.select(
        F.when(F.col("o_custkey") % 50 == 0, "").otherwise(F.concat(F.lit("C"), "o_custkey")).alias("expected_case_id"),
        F.concat(F.lit("b"), key % 3).alias("benchmark_id"),
        F.col("o_orderpriority").alias("input_scope"),
        F.concat(F.lit("order "), key).alias("reason"),
        F.when(F.col("o_orderstatus") == "P", "hidden").otherwise(F.lit(" Visible")).alias("case_visibility"),
        key.alias("ord"),
    )
    cust = F.col("c_custkey")
    case_id = F.concat(F.lit("C"), cust).alias("case_id")
    task = customer.filter(cust % 2 == 1).select(
        case_id,
        F.concat(F.lit("task "), "c_name").alias("official_description"),
        F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.col("c_mktsegment")).alias("vulnerable_behavior_summary"),
        F.concat(F.lit("relevant "), cust).alias("relevance_reason"),
        F.lit("task note").alias("notes"),
        cust.alias("ord"),
    )
    official = customer.filter("c_nationkey < 10").select(case_id, F.col("c_name").alias("official_description"), cust.alias("ord"))
    trace = (
        orders.groupBy(
            "o_custkey",
            F.concat(F.lit("third_party/b"), key % 3, F.lit("/rtl/"), "o_orderpriority").alias("file"),
            F.concat(F.lit("mod"), key % 5).alias("module"),
            F.col("o_orderstatus").alias("signal_or_register"),
        )
        .agg(F.min("o_orderkey").alias("o"))
        .groupBy("o_custkey")
        .agg(F.array_sort(F.collect_list(F.struct("o", "file", "module", "signal_or_register"))).alias("t"))
        .select(
            F.col("o_custkey").alias("c_custkey"),
            F.transform("t", lambda x: F.struct(x["file"].alias("file"), x["module"].alias("module"), x["signal_or_register"].alias("signal_or_register"))).alias("trace"),
        )
    )
    evidence = customer.filter("c_nationkey % 2 = 0").join(trace, "c_custkey", "left").select(
        case_id,
        F.lit(None).cast("array<string>").alias("files"),
        F.when(F.col("c_nationkey") % 4 == 0, F.array(F.lit("given"), F.lit(""), F.col("c_mktsegment"))).alias("modules"),
        F.concat(F.lit("hit "), "c_mktsegment").alias("hit_summary"),
        F.lit(" ").alias("notes"),
        F.concat(F.lit("nation "), "c_nationkey").alias("official_description"),
        "trace",
        cust.alias("ord"),
    )
    return evaluate.gt_assembly(mapping, task, official, evidence, ALIASES)


@query(
    "j02_unique_join",
    """SELECT l_orderkey, string_agg(v, '; ' ORDER BY o, v) AS ship_years FROM (
  SELECT l_orderkey, CAST(year(l_shipdate) AS VARCHAR) AS v, min(l_partkey * 10 + l_linenumber) AS o FROM lineitem GROUP BY ALL) GROUP BY 1""",
)
def j02(spark, sf):
    items = table(spark, sf, "lineitem")
    year = F.concat(F.lit(" "), F.year("l_shipdate").cast("string"))
    return evaluate.unique_join(items, ["l_orderkey"], year, F.col("l_partkey") * 10 + F.col("l_linenumber"), "ship_years")


PAGE_PATH_SQL = """
pages_path AS (
  SELECT page_id, split_part(split_part(split_part(url, '://', 2), '?', 1), '#', 1) AS p FROM pages),
parts AS (
  SELECT page_id, p, split_part(p, '/', 2) AS lang,
         CASE WHEN page_id % 3 = 0 THEN 'third_party/' || split_part(p, '/', 2) || '/' || p
              WHEN page_id % 3 = 1 THEN 'third_party\\' || p ELSE ' ' || p END AS file
  FROM pages_path)
"""


def page_paths(spark, sf):
    p = F.split_part(F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1))
    lang = F.split_part("p", F.lit("/"), F.lit(2))
    file = (
        F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("third_party/"), "lang", F.lit("/"), "p"))
        .when(F.col("page_id") % 3 == 1, F.concat(F.lit("third_party\\"), "p"))
        .otherwise(F.concat(F.lit(" "), "p"))
    )
    return table(spark, sf, "pages").select("page_id", p.alias("p")).withColumn("lang", lang).withColumn("file", file)


@query(
    "j03_prefix_alias",
    f"""WITH {PAGE_PATH_SQL}
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN p WHEN page_id % 3 = 1 THEN 'third_party/' || p ELSE p END AS file,
       CASE WHEN lang = 'en' AND NOT starts_with(p, 'm.') THEN 'm.' || p ELSE p END AS scope FROM parts""",
)
def j03(spark, sf):
    return page_paths(spark, sf).select(
        "page_id",
        evaluate.strip_vendor_prefix(F.col("file"), F.col("lang")).alias("file"),
        evaluate.scope_alias(F.col("lang"), F.col("p"), {"en": "m."}).alias("scope"),
    )


LINES_SQL = """
doc_lines AS (
  SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
  FROM documents)
"""


@query(
    "j04_finding_explode",
    f"""WITH {LINES_SQL}, f AS (
  SELECT *, 'proposed:' || lang || ':' || source || ':rep_' || (doc_id % 3) AS run_id,
         CASE WHEN pos % 3 = 0 THEN 'ID' || doc_id || '-' || pos ELSE 'F' || (pos + 1) END AS finding_id FROM doc_lines)
SELECT doc_id, run_id, finding_id, run_id || ':' || finding_id AS finding_uid, lang AS model_family, source AS input_scope,
       CAST(doc_id % 3 AS VARCHAR) AS repetition, 'proposed' AS method_name, line AS summary, CASE WHEN pos % 2 = 0 THEN 'high' ELSE '' END AS confidence
FROM f""",
)
def j04(spark, sf):
    lines = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.struct(
            F.when(i % 3 == 0, F.concat(F.lit("ID"), "doc_id", F.lit("-"), i.cast("string"))).when(i % 3 == 1, "").alias("finding_id"),
            line.alias("summary"),
            F.when(i % 2 == 0, "high").alias("confidence"),
        ),
    )
    answers = table(spark, sf, "documents").select(
        "doc_id",
        F.lit("proposed").alias("method_name"),
        F.col("lang").alias("model_family"),
        F.col("source").alias("input_scope"),
        (F.col("doc_id") % 3).cast("string").alias("repetition"),
        lines.alias("findings"),
    )
    return evaluate.explode_findings(answers)


@query(
    "j05_nested_flatten",
    f"""WITH {LINES_SQL}, i AS (
  SELECT *, length(line) AS n, split_part(line, ' ', 1) AS w FROM doc_lines)
SELECT doc_id, string_agg(
    concat_ws(' | ', NULLIF(CASE WHEN pos % 4 = 3 THEN '' ELSE source || '.sv' END
      || CASE WHEN pos % 5 = 4 THEN '' ELSE ':' || pos || CASE WHEN n % 3 = 0 THEN '' ELSE '-' || (pos + n % 3) END END, ''),
      NULLIF(w, ''), CASE WHEN pos % 2 = 0 THEN 's' || pos END), chr(10) ORDER BY pos) AS affected_locations
FROM i GROUP BY doc_id""",
)
def j05(spark, sf):
    def item(line, i):
        n = F.length(line)
        return F.struct(
            F.when(i % 4 == 3, "").otherwise(F.concat("source", F.lit(".sv"))).alias("file"),
            F.when(i % 5 != 4, i).alias("line_start"),
            (i + n % 3).alias("line_end"),
            F.split_part(line, F.lit(" "), F.lit(1)).alias("module"),
            F.when(i % 2 == 0, F.concat(F.lit("s"), i.cast("string"))).alias("signal_or_register"),
        )

    docs = table(spark, sf, "documents").select("doc_id", "source", F.transform(F.split("text", "\n"), item).alias("items"))
    return docs.select("doc_id", evaluate.flatten_items(F.col("items"), evaluate.LOCATION_FIELDS).alias("affected_locations"))


@query(
    "j06_review_validation",
    """
WITH r AS (
  SELECT o_orderkey + 2 AS row_index,
    CASE WHEN o_orderkey % 97 = 0 THEN '' WHEN o_orderkey % 89 = 0 THEN 'O' || (o_orderkey - 1) ELSE 'O' || o_orderkey END AS uid,
    CASE WHEN o_orderkey % 101 = 0 THEN 'Partial' WHEN o_orderkey % 103 = 0 THEN '' WHEN o_orderstatus = 'F' THEN 'TP' WHEN o_orderstatus = 'O' THEN 'FP' ELSE 'Duplicate' END AS match,
    CASE WHEN o_orderkey % 107 = 0 THEN 'Great' ELSE 'Sufficient' END AS quality,
    CASE WHEN o_orderstatus = 'F' AND o_orderkey % 61 <> 0 THEN 'C' || o_custkey WHEN o_orderkey % 67 = 0 THEN 'C' || o_custkey ELSE '' END AS case_id,
    CASE WHEN o_orderstatus = 'P' AND o_orderkey % 59 = 0 THEN 'missing' WHEN o_orderstatus = 'P' AND o_orderkey % 53 <> 0 THEN 'O' || o_orderkey ELSE '' END AS dup
  FROM orders),
g AS (SELECT 'C' || c_custkey AS case_id FROM customer WHERE c_custkey % 7 <> 0)
SELECT row_index, 'missing finding_uid' AS error FROM r WHERE uid = ''
UNION ALL SELECT row_index, 'duplicate finding_uid ' || uid FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY row_index) AS rn FROM r WHERE uid <> '') WHERE rn > 1
UNION ALL SELECT row_index, 'Partial is not allowed' FROM r WHERE match = 'Partial'
UNION ALL SELECT row_index, 'invalid detection_match ''' || match || '''' FROM r WHERE match NOT IN ('TP', 'FP', 'Duplicate', 'Unscorable')
UNION ALL SELECT row_index, 'invalid evidence_quality ''' || quality || '''' FROM r WHERE quality NOT IN ('Sufficient', 'Insufficient', 'Fabricated', 'Unsupported', 'Unclear')
UNION ALL SELECT row_index, 'matched_case_id ''' || case_id || ''' not found in GT' FROM r WHERE case_id <> '' AND case_id NOT IN (SELECT case_id FROM g)
UNION ALL SELECT row_index, 'TP requires matched_case_id' FROM r WHERE match = 'TP' AND case_id = ''
UNION ALL SELECT row_index, 'FP must not keep matched_case_id' FROM r WHERE match = 'FP' AND case_id <> ''
UNION ALL SELECT row_index, 'Duplicate requires duplicate_of_finding_uid' FROM r WHERE match = 'Duplicate' AND dup = ''
UNION ALL SELECT row_index, 'duplicate_of_finding_uid ''' || dup || ''' not found' FROM r WHERE match = 'Duplicate' AND dup <> '' AND dup NOT IN (SELECT uid FROM r)
""",
)
def j06(spark, sf):
    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    case_id = F.concat(F.lit("C"), "o_custkey")
    findings = table(spark, sf, "orders").select(
        (k + 2).alias("row_index"),
        F.when(k % 97 == 0, "").when(k % 89 == 0, F.concat(F.lit("O"), k - 1)).otherwise(F.concat(F.lit("O"), k)).alias("finding_uid"),
        F.when(k % 101 == 0, "Partial").when(k % 103 == 0, "").when(status == "F", "TP").when(status == "O", "FP").otherwise(F.lit("Duplicate")).alias("detection_match"),
        F.when(k % 107 == 0, "Great").otherwise(F.lit("Sufficient")).alias("evidence_quality"),
        F.when((status == "F") & (k % 61 != 0), case_id).when(k % 67 == 0, case_id).alias("matched_case_id"),
        F.when((status == "P") & (k % 59 == 0), "missing").when((status == "P") & (k % 53 != 0), F.concat(F.lit("O"), k)).alias("duplicate_of_finding_uid"),
    )
    gt = table(spark, sf, "customer").filter("c_custkey % 7 <> 0").select(F.concat(F.lit("C"), "c_custkey").alias("case_id"))
    return evaluate.review_errors(findings, gt)


# ------------------------------------------------------------ j07 to j13


@query("j07_run_metrics", f"WITH {domain.FINDINGS_SQL}, {RUN_METRICS_SQL} SELECT * FROM run_metrics")
def j07(spark, sf):
    return evaluate.run_metrics(domain.findings(spark, sf), domain.gt_cases(spark, sf))


def _mean_std_sql():
    parts = []
    for m in evaluate.METRICS:
        parts.append(f"round(avg({m}), 6) AS {m}_mean")
        parts.append(f"CASE WHEN count({m}) >= 2 THEN round(stddev_samp({m}), 6) END AS {m}_std")
    return ", ".join(parts)


@query(
    "j08_mean_std",
    f"WITH {domain.FINDINGS_SQL}, {RUN_METRICS_SQL} SELECT model_family, method_name, {_mean_std_sql()} FROM run_metrics GROUP BY ALL",
)
def j08(spark, sf):
    return evaluate.mean_std(evaluate.run_metrics(domain.findings(spark, sf), domain.gt_cases(spark, sf)))


@query("j09_anyhit_cases", f"WITH {domain.FINDINGS_SQL}, {ANYHIT_SQL} SELECT * FROM anyhit")
def j09(spark, sf):
    return evaluate.anyhit_cases(domain.findings(spark, sf), domain.gt_cases(spark, sf))


@query(
    "j10_anyhit_summary",
    f"""WITH {domain.FINDINGS_SQL}, {ANYHIT_SQL},
fps AS (SELECT model_family, method_name, count(*) FILTER (detection_match = 'FP') AS fp,
        count(*) FILTER (detection_match = 'FP' AND evidence_quality IN ('Fabricated', 'Unsupported')) AS fu FROM findings GROUP BY ALL),
c AS (SELECT model_family, method_name, count(DISTINCT case_id) AS num_gt_cases, count(*) FILTER (case_result = 'TP') AS tp,
        count(*) FILTER (representative_evidence_quality = 'Sufficient') AS suff,
        count(*) FILTER (representative_evidence_quality IN ('Fabricated', 'Unsupported')) AS ru FROM anyhit GROUP BY ALL),
j AS (SELECT model_family, method_name, fp, num_gt_cases, tp, suff, ru + fu AS unsup, tp AS tp_cases, num_gt_cases - tp AS fn_cases FROM fps JOIN c USING (model_family, method_name)),
r AS (SELECT *, {METRIC_SQL} FROM j)
SELECT model_family, method_name, num_gt_cases, tp_cases, fn_cases, tp AS representative_tp_findings, fp AS fp_findings, precision, recall,
  CASE WHEN precision + recall > 0 THEN round(2 * precision * recall / (precision + recall), 6) END AS f1_score,
  evidence_sufficiency_rate, fabricated_unsupported_evidence_rate FROM r""",
)
def j10(spark, sf):
    found, gt = domain.findings(spark, sf), domain.gt_cases(spark, sf)
    return evaluate.anyhit_summary(evaluate.anyhit_cases(found, gt), found)


FAILURES_SQL = """
bad AS (
  SELECT *, row_number() OVER (ORDER BY ord) AS n FROM (
    SELECT *, CASE WHEN detection_match = 'FP' THEN 'FP finding' WHEN detection_match IN ('Duplicate', 'Unscorable') THEN detection_match || ' finding'
      WHEN detection_match = 'TP' AND evidence_quality IN ('Insufficient', 'Fabricated', 'Unsupported') THEN evidence_quality || ' evidence' END AS reason,
      CASE WHEN detection_match = 'FP' THEN 'FP_finding' WHEN detection_match IN ('Duplicate', 'Unscorable') THEN detection_match ELSE 'Evidence_failure' END AS kind
    FROM findings) WHERE reason IS NOT NULL),
grp AS (SELECT model_family, method_name, input_scope, repetition, arg_min(run_id, ord) AS run_id, arg_min(final_answer_path, ord) AS final_answer_path FROM findings GROUP BY ALL),
missed AS (
  SELECT g.*, c.case_id, c.case_description, row_number() OVER (ORDER BY g.model_family, g.method_name, g.input_scope, g.repetition, c.ord) AS n
  FROM grp g JOIN gt c USING (input_scope)
  WHERE NOT EXISTS (SELECT 1 FROM findings f WHERE f.detection_match = 'TP' AND f.matched_case_id = c.case_id AND f.model_family = g.model_family
    AND f.method_name = g.method_name AND f.input_scope = g.input_scope AND f.repetition = g.repetition)),
failures AS (
  SELECT n, model_family, method_name, input_scope, repetition, run_id, kind AS failure_object_type, finding_uid AS related_finding_uid,
    matched_case_id AS related_case_id, detection_match, evidence_quality, summary, final_answer_path, reason AS candidate_reason FROM bad
  UNION ALL
  SELECT n + (SELECT count(*) FROM bad), model_family, method_name, input_scope, repetition, run_id, 'FN_case', '', case_id, '', '', case_description,
    final_answer_path, 'GT case not hit by any TP finding in this run' FROM missed),
candidates AS (
  SELECT CASE WHEN n < 100000 THEN 'E' || lpad(CAST(n AS VARCHAR), 5, '0') ELSE 'E' || n END AS failure_uid, * EXCLUDE (n),
    CASE WHEN repetition = '1' THEN regexp_replace(final_answer_path, '[^/]+$', 'tool_trace.jsonl') ELSE '' END AS tool_trace_path FROM failures)
"""


def _candidates(spark, sf):
    found = domain.findings(spark, sf)
    traces = found.filter("repetition = '1'").select(
        "final_answer_path", F.regexp_replace("final_answer_path", "[^/]+$", "tool_trace.jsonl").alias("tool_trace_path")
    )
    return evaluate.failure_candidates(found, domain.gt_cases(spark, sf), traces.distinct())


@query("j11_failure_candidates", f"WITH {domain.FINDINGS_SQL}, {FAILURES_SQL} SELECT * FROM candidates")
def j11(spark, sf):
    return _candidates(spark, sf)


@query(
    "j12_template_columns",
    f"WITH {domain.FINDINGS_SQL}, {FAILURES_SQL} SELECT *, "
    + ", ".join(f"'' AS {c}" for c in evaluate.ANALYST_COLUMNS)
    + " FROM candidates",
)
def j12(spark, sf):
    return evaluate.analysis_template(_candidates(spark, sf))


@query(
    "j13_mechanism_summary",
    """
WITH e AS (
  SELECT 'm' || (user_id % 2) AS model_family, 'proposed' AS method_name, CASE WHEN event_type = 'error' THEN 'Unclear' ELSE event_type END AS failure_mechanism,
    's' || (user_id % 7) AS input_scope, 'E' || event_id AS failure_uid, CASE WHEN value < 5 THEN '' ELSE 'impl ' || CAST(floor(value / 50) AS BIGINT) END AS imp, event_id AS ord FROM events),
a AS (SELECT model_family, method_name, failure_mechanism, string_agg(input_scope, '; ' ORDER BY o) AS s FROM (SELECT model_family, method_name, failure_mechanism, input_scope, min(ord) AS o FROM e GROUP BY ALL) GROUP BY ALL),
b AS (SELECT model_family, method_name, failure_mechanism, string_agg(failure_uid, '; ' ORDER BY ord) AS u FROM (SELECT *, row_number() OVER (PARTITION BY model_family, method_name, failure_mechanism ORDER BY ord) AS rn FROM e) WHERE rn <= 10 GROUP BY ALL),
c AS (SELECT model_family, method_name, failure_mechanism, string_agg(imp, '; ' ORDER BY o) AS i FROM (SELECT model_family, method_name, failure_mechanism, imp, min(ord) AS o FROM e WHERE imp <> '' GROUP BY ALL) GROUP BY ALL)
SELECT e.model_family, e.method_name, e.failure_mechanism, count(*) AS failure_count, any_value(a.s) AS affected_input_scopes, any_value(b.u) AS representative_failure_uids, any_value(c.i) AS method_implication_summary
FROM e JOIN a USING (model_family, method_name, failure_mechanism) JOIN b USING (model_family, method_name, failure_mechanism) JOIN c USING (model_family, method_name, failure_mechanism) GROUP BY 1, 2, 3
""",
)
def j13(spark, sf):
    rows = table(spark, sf, "events").select(
        F.concat(F.lit("m"), F.col("user_id") % 2).alias("model_family"),
        F.lit("proposed").alias("method_name"),
        F.when(F.col("event_type") != "error", F.col("event_type")).otherwise(F.lit("")).alias("failure_mechanism"),
        F.concat(F.lit("s"), F.col("user_id") % 7).alias("input_scope"),
        F.concat(F.lit("E"), "event_id").alias("failure_uid"),
        F.when(F.col("value") < 5, "").otherwise(F.concat(F.lit("impl "), F.floor(F.col("value") / 50))).alias("method_implication"),
        F.col("event_id").alias("ord"),
    )
    return evaluate.mechanism_summary(rows)


# ------------------------------------------------------------ j14 to j21

RULES = [
    ("*", 1, "K-01", [("all", ["the", "in"]), ("any", ["on", "th e", "at the"]), ("not", ["zz", "erat"])]),
    ("*", 2, "K-02", [("any", ["la", "die"]), ("not", ["que el"])]),
    ("*", 3, "K-03", [("any", ["en la", "der", "of", ", the"])]),
    ("src0", 0, "K-00", [("all", ["is", "on"])]),
]


def _rules_sql():
    def clause(mode, terms):
        tests = [
            f"list_contains(tokens, '{t}')" if t.replace("_", "a").isalnum() and t == t.lower() else f"contains(t, '{t}')" for t in terms
        ]
        joined = " AND ".join(tests) if mode == "all" else " OR ".join(tests)
        return f"NOT ({joined})" if mode == "not" else f"({joined})"

    ordered = sorted(RULES, key=lambda r: r[1])
    whens = []
    for scope, _, case_id, clauses in ordered:
        where = " AND ".join(clause(m, t) for m, t in clauses)
        if scope != "*":
            where += f" AND source = '{scope}'"
        whens.append(f"WHEN {where} THEN '{case_id}'")
    return "CASE " + " ".join(whens) + " ELSE '' END"


def rules_table(spark, sf):
    rows = [(s, p, c, [{"mode": m, "terms": t} for m, t in cl]) for s, p, c, cl in RULES]
    schema = "scope string, priority int, case_id string, clauses array<struct<mode:string,terms:array<string>>>"
    rules = spark.createDataFrame(rows, schema)
    shared = F.array(
        *[
            F.struct(
                F.lit(p).alias("priority"),
                F.lit(c).alias("case_id"),
                F.array(*[F.struct(F.lit(m).alias("mode"), F.array(*[F.lit(t) for t in ts]).alias("terms")) for m, ts in cl]).alias("clauses"),
            )
            for s, p, c, cl in RULES
            if s == "*"
        ]
    )
    scopes = table(spark, sf, "documents").select(F.col("source").alias("scope")).distinct()
    everywhere = scopes.select("scope", F.explode(shared).alias("r")).select("scope", "r.*")
    return rules.filter("scope <> '*'").unionByName(everywhere)


@query(
    "j14_rule_match",
    f"""WITH p AS (SELECT doc_id, source, lower(text) AS t, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS tokens FROM documents),
m AS (SELECT doc_id, source AS input_scope, {_rules_sql()} AS matched_case_id FROM p)
SELECT *, CASE WHEN matched_case_id = '' THEN 'FP' ELSE 'TP' END AS detection_match FROM m""",
)
def j14(spark, sf):
    claims = texts(spark, sf, "documents", "doc_id", "source", "text").select("doc_id", F.col("source").alias("input_scope"), "text")
    return evaluate.match_rules_table(claims, rules_table(spark, sf), ["doc_id"])


TERMS = ["the", "of the", "is", "que", ", und", "er", "___"]


@query(
    "j15_term_match",
    "WITH p AS (SELECT doc_id, lower(text) AS t, regexp_extract_all(lower(text), '[a-z0-9_]+') AS k FROM documents) SELECT doc_id, "
    + ", ".join(
        (f"list_contains(k, '{t}')" if t.replace("_", "a").isalnum() else f"contains(t, '{t}')") + f" AS hit_{i}" for i, t in enumerate(TERMS)
    )
    + " FROM p",
)
def j15(spark, sf):
    docs = texts(spark, sf, "documents", "doc_id", "text").select("doc_id", F.lower("text").alias("t"))
    docs = docs.withColumn("k", evaluate.word_tokens(F.col("t")))
    return docs.select("doc_id", *[evaluate.term_in(F.col("t"), F.col("k"), F.lit(t)).alias(f"hit_{i}") for i, t in enumerate(TERMS)])


@query(
    "j16_duplicate_mark",
    f"""WITH {domain.FINDINGS_SQL}, w AS (
  SELECT *, row_number() OVER k AS rn, first_value(finding_uid) OVER k AS fu FROM findings WHERE detection_match = 'TP'
  WINDOW k AS (PARTITION BY model_family, method_name, input_scope, repetition, matched_case_id ORDER BY ord))
SELECT f.finding_uid, f.matched_case_id, CASE WHEN w.rn > 1 THEN 'Duplicate' ELSE f.detection_match END AS detection_match,
  CASE WHEN w.rn > 1 THEN w.fu ELSE '' END AS duplicate_of_finding_uid,
  CASE WHEN w.rn > 1 THEN 'Duplicate of ' || w.fu || ': same run reports ' || f.matched_case_id || ' again. ' || f.summary ELSE f.summary END AS review_notes
FROM findings f LEFT JOIN w ON w.finding_uid = f.finding_uid""",
)
def j16(spark, sf):
    found = domain.findings(spark, sf).withColumn("review_notes", F.col("summary"))
    return evaluate.mark_duplicates(found).select(
        "finding_uid", "matched_case_id", "detection_match", "duplicate_of_finding_uid", "review_notes"
    )


@query(
    "j17_group_review",
    f"""WITH {domain.FINDINGS_SQL}, n AS (
  SELECT *, row_number() OVER (PARTITION BY model_family, method_name, input_scope, repetition, matched_case_id, detection_match ORDER BY ord) AS rn FROM findings)
SELECT model_family, method_name, input_scope, repetition, matched_case_id, detection_match, arg_min(finding_uid, ord) AS representative_finding_uid,
  count(*) FILTER (detection_match = 'Duplicate') AS duplicate_count, count(*) FILTER (detection_match = 'FP') AS fp_count,
  string_agg(summary, chr(10) || '---' || chr(10) ORDER BY ord) FILTER (rn <= 5) AS example_summaries
FROM n GROUP BY model_family, method_name, input_scope, repetition, matched_case_id, detection_match""",
)
def j17(spark, sf):
    return evaluate.group_review(domain.findings(spark, sf))


TOKENS_SQL = (
    "list_sort(list_distinct(list_concat([x for x in regexp_extract_all(lower(concat_ws(' ', text, claimed_modules)), '[a-z0-9_]+') "
    "if length(x) >= 3 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in clusters.STOPWORDS) + "], x)], [input_scope, lang_top])))"
)


@query(
    "j18_token_set",
    f"""WITH {domain.FINDINGS_SQL}, t AS (
  SELECT finding_uid, {TOKENS_SQL} AS tokens FROM (SELECT *, substr(claimed_modules, 1, 2) || '_top' AS lang_top FROM findings))
SELECT finding_uid, len(tokens) AS n_tokens, md5(array_to_string(tokens, ' ')) AS token_digest FROM t""",
)
def j18(spark, sf):
    rows = _with_tokens(domain.findings(spark, sf))
    return rows.select("finding_uid", F.size("tokens").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("token_digest"))


def _with_tokens(found):
    return found.withColumn("tokens", clusters.token_set([F.col("text"), F.col("claimed_modules")], F.col("claimed_files")))


def _clustered(spark, sf):
    found = _with_tokens(domain.findings(spark, sf)).drop("text")
    return clusters.cluster_false_positives(found.withColumn("claimed_signals_or_registers", F.col("claimed_modules")))


SAME_RUN = " AND ".join(f"a.{k} = b.{k}" for k in clusters.CLUSTER_KEYS)
RUN = ", ".join(clusters.CLUSTER_KEYS)
# One item of each run per recursion step: it follows its nearest earlier item, the earliest leader on ties.
CLUSTER_SQL = f"""{domain.FINDINGS_SQL},
fp AS MATERIALIZED (SELECT {RUN}, ord, {TOKENS_SQL} AS tokens, row_number() OVER (PARTITION BY {RUN} ORDER BY ord) AS n
  FROM (SELECT *, substr(claimed_modules, 1, 2) || '_top' AS lang_top FROM findings) WHERE detection_match = 'FP'),
near AS (SELECT {", ".join(f"a.{k}" for k in clusters.CLUSTER_KEYS)}, a.n, b.n AS other, len(list_intersect(a.tokens, b.tokens)) AS shared, shared::DOUBLE / (len(a.tokens) + len(b.tokens) - shared) AS score
  FROM fp a JOIN fp b ON {SAME_RUN} AND b.n < a.n WHERE len(a.tokens) > 0 AND len(b.tokens) > 0),
best AS MATERIALIZED (SELECT {RUN}, n, list(other) AS others FROM (SELECT *, max(score) OVER (PARTITION BY {RUN}, n) AS top FROM near WHERE score >= {clusters.THRESHOLD}) WHERE score = top GROUP BY ALL),
step AS (SELECT DISTINCT {RUN}, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS led FROM fp
  UNION ALL SELECT {", ".join(f"a.{k}" for k in clusters.CLUSTER_KEYS)}, a.n + 1, list_append(led, coalesce(list_min([led[j] FOR j IN others]), a.n + 1))
  FROM step a JOIN fp b ON {SAME_RUN} AND b.n = a.n + 1 LEFT JOIN best c ON {SAME_RUN.replace("b.", "c.")} AND c.n = a.n + 1),
led AS (SELECT {RUN}, unnest(led) AS leader, generate_subscripts(led, 1) AS n FROM (SELECT *, row_number() OVER (PARTITION BY {RUN} ORDER BY n DESC) AS last FROM step) WHERE last = 1),
heads AS (SELECT {RUN}, leader, 'FPC-' || lpad(CAST(row_number() OVER (ORDER BY {RUN}, leader) AS VARCHAR), 4, '0') AS fp_cluster_id FROM (SELECT DISTINCT {RUN}, leader FROM led)),
clustered AS MATERIALIZED (SELECT f.*, coalesce(fp_cluster_id, '') AS fp_cluster_id,
  CASE WHEN detection_match = 'FP' THEN CASE WHEN fp.n = leader THEN 'FP_CLUSTER_REP' ELSE 'FP_CLUSTER_DUP' END WHEN detection_match = 'Duplicate' THEN 'TP_DUPLICATE' ELSE detection_match END AS cluster_scoring_role
  FROM findings f LEFT JOIN fp USING ({RUN}, ord) LEFT JOIN led USING ({RUN}, n) LEFT JOIN heads USING ({RUN}, leader))"""


@query("j19_leader_cluster", f"WITH RECURSIVE {CLUSTER_SQL} SELECT finding_uid, detection_match, fp_cluster_id, cluster_scoring_role FROM clustered")
def j19(spark, sf):
    return _clustered(spark, sf).select("finding_uid", "detection_match", "fp_cluster_id", "cluster_scoring_role")


def _parts_sql(column):
    """Distinct parts of a column's texts per cluster, in order of first appearance."""
    return f"""(SELECT cluster, string_agg(part, '; ' ORDER BY first) AS {column} FROM (
  SELECT fp_cluster_id AS cluster, trim(part) AS part, min(ord * 1000 + p) AS first FROM (SELECT fp_cluster_id, ord, unnest(string_split(coalesce({column}, ''), ';')) AS part,
    generate_subscripts(string_split(coalesce({column}, ''), ';'), 1) AS p FROM rows) WHERE trim(part) <> '' GROUP BY 1, 2) GROUP BY 1)"""


@query(
    "j20_cluster_rollup",
    f"""WITH RECURSIVE {CLUSTER_SQL},
rows AS MATERIALIZED (SELECT *, claimed_modules AS claimed_signals_or_registers, row_number() OVER (PARTITION BY fp_cluster_id ORDER BY ord) AS place FROM clustered WHERE fp_cluster_id <> ''),
k AS (SELECT fp_cluster_id, {RUN}, count(*) AS fp_count, arg_min(finding_uid, ord) AS representative_finding_uid,
  string_agg(summary, chr(10) || '---' || chr(10) ORDER BY ord) FILTER (place <= 5) AS example_summaries FROM rows GROUP BY ALL)
SELECT k.*, coalesce(f.claimed_files, '') AS claimed_files, coalesce(m.claimed_modules, '') AS claimed_modules, coalesce(s.claimed_signals_or_registers, '') AS claimed_signals_or_registers
FROM k LEFT JOIN {_parts_sql("claimed_files")} f ON f.cluster = fp_cluster_id LEFT JOIN {_parts_sql("claimed_modules")} m ON m.cluster = fp_cluster_id
LEFT JOIN {_parts_sql("claimed_signals_or_registers")} s ON s.cluster = fp_cluster_id""",
)
def j20(spark, sf):
    return clusters.cluster_rollup(_clustered(spark, sf))


@query(
    "j21_clustered_metrics",
    f"""WITH RECURSIVE {CLUSTER_SQL},
c AS (SELECT model_family, method_name, coalesce(repetition, '') AS repetition, count(*) FILTER (cluster_scoring_role = 'TP') AS tp, count(*) FILTER (cluster_scoring_role = 'FP_CLUSTER_REP') AS fp,
  count(*) FILTER (cluster_scoring_role = 'TP' AND evidence_quality = 'Sufficient') AS good, count(*) FILTER (cluster_scoring_role IN ('TP', 'FP_CLUSTER_REP') AND evidence_quality IN ('Fabricated', 'Unsupported')) AS bad
  FROM clustered GROUP BY GROUPING SETS ((model_family, method_name, repetition), (model_family, method_name))),
h AS (SELECT model_family, method_name, coalesce(repetition, '') AS repetition, count(DISTINCT matched_case_id) AS tp_cases FROM clustered SEMI JOIN gt ON case_id = matched_case_id
  WHERE cluster_scoring_role = 'TP' GROUP BY GROUPING SETS ((model_family, method_name, repetition), (model_family, method_name))),
m AS (SELECT c.*, coalesce(tp_cases, 0) AS tp_cases, (SELECT count(DISTINCT case_id) FROM gt) AS num_gt_cases FROM c LEFT JOIN h USING (model_family, method_name, repetition)),
x AS (SELECT model_family, method_name, repetition, num_gt_cases, tp_cases, num_gt_cases - tp_cases AS fn_cases, tp AS representative_tp_findings, fp AS fp_findings,
  round(tp_cases::DOUBLE / nullif(tp_cases + fp, 0), 6) AS case_precision, round(tp::DOUBLE / nullif(tp + fp, 0), 6) AS precision, round(tp_cases::DOUBLE / nullif(num_gt_cases, 0), 6) AS recall,
  round(good::DOUBLE / nullif(tp, 0), 6) AS evidence_sufficiency_rate, round(bad::DOUBLE / nullif(tp + fp, 0), 6) AS fabricated_unsupported_evidence_rate FROM m)
SELECT *, CASE WHEN precision + recall <> 0 THEN round(2.0::DOUBLE * precision * recall / (precision + recall), 6) END AS f1_score FROM x""",
)
def j21(spark, sf):
    return clusters.clustered_metrics(_clustered(spark, sf), domain.gt_cases(spark, sf))


# ------------------------------------------------------------ j22 to j29


def status_log(spark, sf):
    kind = F.col("event_type")
    return table(spark, sf, "events").select(
        F.concat(F.lit("batch"), F.col("user_id") % 5).alias("batch_id"),
        F.concat(F.lit("run"), "user_id").alias("run_id"),
        F.when(kind.isin("error"), "failed").when(kind == "view", "running").otherwise(F.lit("success")).alias("status"),
        F.when(F.col("user_id") % 5 == 4, "").otherwise((F.col("event_id") % 4).cast("string")).alias("repetition"),
        F.struct("ts", "event_id").alias("ord"),
    )


STATUS_SQL = """
log AS (
  SELECT 'batch' || (user_id % 5) AS batch_id, 'run' || user_id AS run_id,
    CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'running' ELSE 'success' END AS status,
    CASE WHEN user_id % 5 = 4 THEN '' ELSE CAST(event_id % 4 AS VARCHAR) END AS repetition, ts, event_id FROM events),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY batch_id, run_id ORDER BY ts DESC, event_id DESC) AS rn FROM log) WHERE rn = 1)
"""


@query(
    "j22_latest_status",
    f"""WITH {STATUS_SQL}
SELECT batch_id, (SELECT count(*) FROM log x WHERE x.batch_id = l.batch_id) AS status_rows, count(*) AS latest_unique_runs,
  count(*) FILTER (status = 'success') AS latest_success, count(*) FILTER (status = 'failed') AS latest_failed FROM latest l GROUP BY batch_id""",
)
def j22(spark, sf):
    return evaluate.status_summary(status_log(spark, sf))


@query(
    "j23_repetition_list",
    """WITH c AS (SELECT 'conv' || conv_id AS batch_id, CASE turn % 3 WHEN 0 THEN '' WHEN 1 THEN 'rep_' || turn ELSE 'final' || turn END AS name FROM conversations),
r AS (SELECT batch_id, CASE WHEN regexp_matches(name, 'rep[_-]?[0-9]+') THEN regexp_extract(name, 'rep[_-]?([0-9]+)', 1) ELSE name END AS rep FROM c)
SELECT batch_id, coalesce(string_agg(DISTINCT rep, ';' ORDER BY rep) FILTER (rep <> ''), '1') AS repetitions FROM r GROUP BY 1""",
)
def j23(spark, sf):
    turn = F.col("turn")
    name = F.when(turn % 3 == 0, "").when(turn % 3 == 1, F.concat(F.lit("rep_"), turn)).otherwise(F.concat(F.lit("final"), turn))
    log = table(spark, sf, "conversations").select(
        F.concat(F.lit("conv"), "conv_id").alias("batch_id"), evaluate.repetition_of(name).alias("repetition")
    )
    return evaluate.repetition_list(log)


@query(
    "j24_score_tables",
    """
WITH runs AS (SELECT 'r' || c_custkey AS run_id, CASE WHEN c_custkey % 2 = 0 THEN 'h_' ELSE '' END || 'scope_' || c_nationkey AS input_scope FROM customer),
g AS (SELECT 'scope_' || n_nationkey AS input_scope, 'b' || n_regionkey AS benchmark_id, CASE WHEN n_nationkey % 3 = 0 THEN 'alt' || n_nationkey ELSE 'C' || n_nationkey END AS case_id FROM nation),
a AS (SELECT * FROM g UNION ALL SELECT 'h_' || input_scope, benchmark_id, case_id FROM g WHERE benchmark_id = 'b1')
SELECT run_id, input_scope, benchmark_id, case_id, 'visible' AS case_visibility, '' AS case_result, '' AS matched_finding_ids, '' AS miss_reason, '' AS scorer_notes
FROM runs JOIN a USING (input_scope)
""",
)
def j24(spark, sf):
    runs = table(spark, sf, "customer").select(
        F.concat(F.lit("r"), "c_custkey").alias("run_id"),
        F.concat(F.when(F.col("c_custkey") % 2 == 0, "h_").otherwise(F.lit("")), F.lit("scope_"), "c_nationkey").alias("input_scope"),
    )
    key = F.col("n_nationkey")
    gt = table(spark, sf, "nation").select(
        F.concat(F.lit("scope_"), key).alias("input_scope"),
        F.concat(F.lit("b"), "n_regionkey").alias("benchmark_id"),
        F.when(key % 3 == 0, "").otherwise(F.concat(F.lit("C"), key)).alias("expected_case_id"),
        F.concat(F.lit("alt"), key).alias("case_id"),
        F.lit("visible").alias("case_visibility"),
    )
    return evaluate.case_score_rows(runs, gt, ALIASES)


VISIBLE = "lower(trim(case_visibility)) = 'visible'"
SCORED_COUNTS_SQL = """
count(*) AS num_findings,
count(*) FILTER (m = 'tp') AS tp_findings, count(*) FILTER (m = 'partial') AS partial_findings, count(*) FILTER (m = 'fp') AS fp_findings,
count(*) FILTER (sc AND lower(wrong_localization) = 'yes') AS wrong_localization_count,
count(*) FILTER (sc AND (q IN ('insufficient', 'fabricated', 'unsupported') OR insufficient_evidence = 'yes' OR fabricated_evidence = 'yes')) AS evidence_failure_count,
count(*) FILTER (sc AND (q = 'insufficient' OR insufficient_evidence = 'yes')) AS insufficient_evidence_count,
count(*) FILTER (sc AND (q = 'fabricated' OR fabricated_evidence = 'yes')) AS fabricated_evidence_count,
count(*) FILTER (sc AND q = 'unsupported') AS unsupported_claim_count,
count(*) FILTER (sc AND lower(overconfidence) = 'yes') AS overconfidence_count
"""
CASE_COUNTS_SQL = f"""
count(*) FILTER ({VISIBLE} AND lower(case_result) = 'tp') AS tp_cases, count(*) FILTER ({VISIBLE} AND lower(case_result) = 'partial') AS partial_cases,
count(*) FILTER ({VISIBLE} AND lower(case_result) = 'fn') AS fn_cases
"""
FLAGGED_SQL = "(SELECT *, lower(trim(detection_match)) AS m, lower(trim(evidence_quality)) AS q, lower(trim(detection_match)) IN ('tp', 'partial', 'fp') AS sc FROM {src})"
NUMBERS = (
    "num_findings tp_findings partial_findings fp_findings wrong_localization_count evidence_failure_count insufficient_evidence_count "
    "fabricated_evidence_count unsupported_claim_count overconfidence_count tp_cases partial_cases fn_cases"
).split()
RATES_SQL = """
tp_cases + partial_cases + fn_cases AS num_expected_cases,
round(CASE WHEN tp_findings + fp_findings > 0 THEN tp_findings::DOUBLE / (tp_findings + fp_findings) END, 6) AS precision,
round(CASE WHEN tp_cases + partial_cases + fn_cases > 0 THEN tp_cases::DOUBLE / (tp_cases + partial_cases + fn_cases) END, 6) AS recall,
round(CASE WHEN tp_cases + partial_cases + fn_cases > 0 THEN partial_cases::DOUBLE / (tp_cases + partial_cases + fn_cases) END, 6) AS partial_rate,
round(CASE WHEN tp_cases + partial_cases + fn_cases > 0 THEN fn_cases::DOUBLE / (tp_cases + partial_cases + fn_cases) END, 6) AS fn_rate,
round(CASE WHEN tp_findings + partial_findings + fp_findings > 0 THEN fp_findings::DOUBLE / (tp_findings + partial_findings + fp_findings) END, 6) AS fp_rate,
round(CASE WHEN tp_findings + partial_findings + fp_findings > 0 THEN wrong_localization_count::DOUBLE / (tp_findings + partial_findings + fp_findings) END, 6) AS localization_error_rate,
round(CASE WHEN tp_findings + partial_findings + fp_findings > 0 THEN evidence_failure_count::DOUBLE / (tp_findings + partial_findings + fp_findings) END, 6) AS evidence_failure_rate,
round(CASE WHEN tp_findings + partial_findings + fp_findings > 0 THEN overconfidence_count::DOUBLE / (tp_findings + partial_findings + fp_findings) END, 6) AS overconfidence_rate
"""


@query(
    "j25_run_summary",
    f"""WITH {domain.SCORES_SQL},
c AS (SELECT run_id, {CASE_COUNTS_SQL}, arg_min(input_scope, ord) AS cs FROM cases GROUP BY run_id),
f AS (SELECT run_id, {SCORED_COUNTS_SQL}, arg_min(input_scope, ord) AS fs FROM {FLAGGED_SQL.format(src="scored")} GROUP BY run_id),
j AS (SELECT coalesce(m.run_id, c.run_id, f.run_id) AS run_id, coalesce(m.model_family, '') AS model_family, coalesce(m.run_index, '') AS run_index,
  coalesce(m.input_scope, cs, fs, '') AS input_scope, {", ".join(f"coalesce({n}, 0) AS {n}" for n in NUMBERS)}
  FROM metadata m FULL JOIN c ON c.run_id = m.run_id FULL JOIN f ON f.run_id = coalesce(m.run_id, c.run_id))
SELECT *, {RATES_SQL} FROM j""",
)
def j25(spark, sf):
    return evaluate.run_summary(*domain.score_tables(spark, sf))


MODEL_SQL = """
bench AS (SELECT run_id, arg_min(benchmark_id, ord) AS b FROM cases WHERE benchmark_id <> '' GROUP BY run_id),
md AS (SELECT m.run_id, m.model_family, coalesce(b, '') AS benchmark_id, m.input_scope FROM metadata m LEFT JOIN bench USING (run_id)),
cd AS (SELECT c.*, coalesce(m.model_family, '') AS model_family, coalesce(nullif(c.benchmark_id, ''), b, '') AS bid FROM cases c LEFT JOIN metadata m USING (run_id) LEFT JOIN bench USING (run_id)),
fd AS (SELECT s.*, coalesce(m.model_family, '') AS model_family, coalesce(b, '') AS bid FROM scored s LEFT JOIN metadata m USING (run_id) LEFT JOIN bench USING (run_id))
"""


def _levels_sql(key):
    zero_f = ", ".join(f"0 AS {n}" for n in NUMBERS[:10])
    zero_c = ", ".join(f"0 AS {n}" for n in NUMBERS[10:])
    return f"""
SELECT level, mf AS model_family, bi AS benchmark_id, sc AS input_scope, count(DISTINCT run_id) AS num_runs,
  {", ".join(f"CAST(sum({n}) AS BIGINT) AS {n}" for n in NUMBERS)} FROM (
  SELECT lv.level, CASE WHEN lv.d >= 1 THEN model_family ELSE '' END AS mf, CASE WHEN lv.d >= 2 THEN benchmark_id ELSE '' END AS bi,
    CASE WHEN lv.d >= 3 THEN input_scope ELSE '' END AS sc, run_id, {", ".join(NUMBERS)}
  FROM (SELECT model_family, benchmark_id, input_scope, run_id, {zero_f}, {zero_c} FROM md
    UNION ALL SELECT model_family, bid, input_scope, run_id, {zero_f}, {CASE_COUNTS_SQL} FROM cd GROUP BY 1, 2, 3, 4
    UNION ALL SELECT model_family, bid, input_scope, run_id, {SCORED_COUNTS_SQL}, {zero_c} FROM {FLAGGED_SQL.format(src="fd")} GROUP BY 1, 2, 3, 4) u
  CROSS JOIN (VALUES ('global', 0), ('model', 1), ('model_benchmark', 2), ('model_scope', 3)) lv(level, d)) GROUP BY ALL"""


@query("j26_multi_level_summary", f"WITH {domain.SCORES_SQL}, {MODEL_SQL}, s AS ({_levels_sql('x')}) SELECT *, {RATES_SQL} FROM s")
def j26(spark, sf):
    metadata, cases, scored = domain.score_tables(spark, sf)
    bench = evaluate.benchmark_by_run(cases)
    full = [evaluate.with_model_and_benchmark(df, metadata, bench) for df in (metadata, cases, scored)]
    return evaluate.multi_level_summary(*full)


ANYHIT_LEVELS_SQL = f"""
SELECT lv.level, CASE WHEN lv.d >= 1 THEN model_family ELSE '' END AS model_family, CASE WHEN lv.d >= 2 THEN benchmark_id ELSE '' END AS benchmark_id,
  CASE WHEN lv.d >= 3 THEN input_scope ELSE '' END AS input_scope, count(*) FILTER (r = 0) AS tp_cases, count(*) FILTER (r = 1) AS partial_cases, count(*) FILTER (r = 2) AS fn_cases
FROM (SELECT model_family, benchmark_id, input_scope, case_id, min(CASE lower(case_result) WHEN 'tp' THEN 0 WHEN 'partial' THEN 1 ELSE 2 END) AS r
  FROM cases JOIN (SELECT run_id, model_family FROM metadata) USING (run_id) WHERE {VISIBLE} GROUP BY 1, 2, 3, 4)
CROSS JOIN (VALUES ('model', 1), ('model_benchmark', 2), ('model_scope', 3)) lv(level, d) GROUP BY ALL
"""


@query(
    "j27_anyhit_precedence",
    f"""WITH {domain.SCORES_SQL}, a AS ({ANYHIT_LEVELS_SQL})
SELECT *, tp_cases + partial_cases + fn_cases AS num_cases, round(tp_cases::DOUBLE / (tp_cases + partial_cases + fn_cases), 6) AS recall,
  round(partial_cases::DOUBLE / (tp_cases + partial_cases + fn_cases), 6) AS partial_rate, round(fn_cases::DOUBLE / (tp_cases + partial_cases + fn_cases), 6) AS fn_rate FROM a""",
)
def j27(spark, sf):
    metadata, cases, _ = domain.score_tables(spark, sf)
    cases = cases.join(metadata.select("run_id", "model_family"), "run_id", "left").fillna("", ["model_family"])
    return evaluate.anyhit_levels(evaluate.anyhit_precedence(cases))


@query(
    "j28_benchmark_fill",
    f"WITH {domain.SCORES_SQL}, {MODEL_SQL} SELECT run_id, case_id, ord, model_family, bid AS benchmark_id FROM cd",
)
def j28(spark, sf):
    metadata, cases, _ = domain.score_tables(spark, sf)
    filled = evaluate.with_model_and_benchmark(cases, metadata, evaluate.benchmark_by_run(cases))
    return filled.select("run_id", "case_id", "ord", "model_family", "benchmark_id")


@query(
    "j29_group_gt",
    """
SELECT c_nationkey AS nation, count(*) AS gt_cases, count(*) FILTER (hit) AS hit_cases, count(*) FILTER (NOT hit) AS missed_cases,
  (SELECT count(*) FROM (SELECT c_custkey FROM customer UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')) AS union_cases
FROM (SELECT c_nationkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AS hit FROM customer) GROUP BY 1
""",
)
def j29(spark, sf):
    gt = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("case_id"))
    hit = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("case_id"))
    return evaluate.group_ground_truth(gt, hit, "nation")
