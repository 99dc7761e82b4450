"""Tagging and target queries (d01 to d12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import domain
from catalog.registry import query, texts
from evigraph.functions import rules
from evigraph.operators import tagging
from evigraph.session import persist_table


def any_sql(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def in_sql(expr: str, words: list[str]) -> str:
    return f"{expr} IN (" + ", ".join(f"'{w}'" for w in words) + ")"


def rules_sql(text: str) -> str:
    parts = ", ".join(f"CASE WHEN {any_sql(text, w)} THEN '{r}' END" for r, (w, _) in rules.RULES.items())
    return f"[x for x in [{parts}] if x IS NOT NULL]"


HIGH = "[" + ", ".join(f"'{r}'" for r in rules.HIGH_PRIORITY_ROLES) + "]"
ROLE_MAP = "CASE r " + " ".join(
    f"WHEN '{r}' THEN [" + ", ".join(f"'{x}'" for x in roles) + "]" for r, (_, roles) in rules.RULES.items()
) + " END"

SIGNAL_SQL = f"""
sig AS (
  SELECT graph_id, id AS node_id, name, regexp_replace(scope, '^module:', '') AS module, file, line_start, line_end, kind, direction, decl_raw,
    lower(regexp_replace(scope, '^module:', '') || ' ' || file) AS context, lower(name) AS low FROM nodes WHERE type = 'Signal'),
usable AS (
  SELECT * FROM sig WHERE NOT coalesce(kind = 'implicit' AND decl_raw IS NULL AND
      ({" OR ".join(f"starts_with(name, '{p}')" for p in rules.CONSTANT_PREFIXES)} OR (regexp_matches(name, '[A-Z]') AND NOT regexp_matches(name, '[a-z]') AND contains(name, '_'))), false)
    AND NOT ({in_sql("low", rules.PURE_RESET_CLOCK + rules.TEMPORARY_NAMES + rules.PLAIN_DATA + rules.ACCESS_ONLY_NAMES)}
      AND NOT ({any_sql("context", rules.CRYPTO_CONTEXT)} AND {in_sql("low", rules.PLAIN_DATA)}))),
ruled AS (
  SELECT *, list_concat({rules_sql("low")},
    CASE WHEN {any_sql("context", rules.CRYPTO_CONTEXT)} AND {any_sql("low", rules.CRYPTO_RESOURCES)} THEN ['R5'] ELSE [] END,
    CASE WHEN {any_sql("context", rules.RESET_CONTEXT)} AND ({in_sql("low", rules.RESET_CONTROLS)} OR starts_with(low, 'rst_')) THEN ['R3'] ELSE [] END) AS raw_rules
  FROM usable)
"""

EVIDENCE_SQL = f"""
inc AS (
  SELECT e.graph_id, e.node_id, e.other_id, e.type, e.read_role, e.ok, e.item_no, e.side,
    coalesce(nullif(n.kind, ''), split_part(n.name, ':', 1)) AS other_kind
  FROM (SELECT graph_id, to_id AS node_id, from_id AS other_id, type, read_role, ok, item_no, 0 AS side FROM edges
        UNION ALL SELECT graph_id, from_id, to_id, type, read_role, ok, item_no, 1 FROM edges WHERE type = 'connects') e
  JOIN nodes n ON n.graph_id = e.graph_id AND n.id = e.other_id),
seen AS (
  SELECT graph_id, node_id, bool_or(type = 'writes' AND other_kind = 'state_update') AS u, bool_or(type = 'reads' AND read_role IN ('condition', 'case_selector')) AS c,
    bool_or(type = 'connects') AS x, bool_or(type IN ('writes', 'reads')) AS rw FROM inc GROUP BY 1, 2),
evidence AS (
  SELECT s.*, CASE WHEN kind = 'register' THEN 'explicit' WHEN u THEN 'inferred' ELSE 'unavailable' END AS register,
    CASE WHEN u THEN 'explicit' ELSE 'unavailable' END AS state_update_target, CASE WHEN c THEN 'explicit' ELSE 'unavailable' END AS condition_used,
    CASE WHEN direction = 'output' THEN 'explicit' ELSE 'unavailable' END AS output_port,
    CASE WHEN kind = 'port' OR direction IN ('input', 'output', 'inout') THEN 'explicit' ELSE 'unavailable' END AS port,
    CASE WHEN x THEN 'explicit' ELSE 'unavailable' END AS cross_module_connect, CASE WHEN rw THEN 'explicit' ELSE 'unavailable' END AS read_or_write,
    CASE WHEN {any_sql("low || ' ' || context", rules.RESET_WORDS)} AND ({any_sql("low || ' ' || context", rules.RESET_STATE_WORDS)} OR {any_sql("low || ' ' || context", rules.RESET_CONTEXT)})
      THEN 'inferred' ELSE 'unavailable' END AS reset_related
  FROM sig s LEFT JOIN seen USING (graph_id, node_id))
"""

POINT_SQL = f"""
gated AS (
  SELECT e.*, list_sort(list_distinct([r for r in u.raw_rules if NOT ((r = 'R3' AND e.reset_related = 'unavailable') OR (r = 'R8' AND e.cross_module_connect = 'unavailable')
      OR (r = 'R4' AND list_contains(u.raw_rules, 'R2')) OR (r = 'R7' AND NOT {any_sql("e.low || ' ' || e.context", rules.DMA_CONTEXT)}))])) AS rules
  FROM evidence e JOIN ruled u USING (graph_id, node_id)
  WHERE len(u.raw_rules) > 0 AND NOT ({" AND ".join(f"e.{c} = 'unavailable'" for c in tagging.EVIDENCE)})
    AND NOT ({in_sql("e.low", rules.WEAK_HANDSHAKE)} AND NOT {any_sql("e.low || ' ' || e.context", rules.HANDSHAKE_CONTEXT)})),
points AS MATERIALIZED (
  SELECT *, list_sort(list_distinct(list_concat(flatten([{ROLE_MAP} for r in rules]),
    [x for x in [CASE WHEN register <> 'unavailable' THEN 'register' END, CASE WHEN state_update_target <> 'unavailable' THEN 'state_update_target' END,
      CASE WHEN output_port <> 'unavailable' THEN 'output_port' END, CASE WHEN condition_used <> 'unavailable' THEN 'control_like' END] if x IS NOT NULL]))) AS roles
  FROM gated WHERE len(rules) > 0)
"""
ALL_SQL = f"{domain.GRAPH_SQL}, {SIGNAL_SQL}, {EVIDENCE_SQL}, {POINT_SQL}"


def points(spark, sf):
    nodes, edges = domain.graph(spark, sf)
    return persist_table(tagging.candidate_points(nodes, edges), "points"), nodes, edges


@query(
    "d01_rule_tagger",
    f"SELECT doc_id, unnest({rules_sql('t')}) AS rule_id FROM (SELECT doc_id, lower(text) AS t FROM documents)",
)
def d01(spark, sf):
    lowered = texts(spark, sf, "documents", "doc_id", "text").select("doc_id", F.lower("text").alias("low"))
    return lowered.select("doc_id", F.explode(rules.rule_ids(F.col("low"))).alias("rule_id"))


@query(
    "d02_evidence_flags",
    f"WITH {domain.GRAPH_SQL}, {SIGNAL_SQL}, {EVIDENCE_SQL} SELECT graph_id, node_id, {', '.join(tagging.EVIDENCE)} FROM evidence",
)
def d02(spark, sf):
    return tagging.evidence_flags(*domain.graph(spark, sf)).select("graph_id", "node_id", *tagging.EVIDENCE)


@query("d03_exclusions", f"WITH {domain.GRAPH_SQL}, {SIGNAL_SQL} SELECT graph_id, node_id, name FROM usable")
def d03(spark, sf):
    nodes, _ = domain.graph(spark, sf)
    return tagging.name_filter(tagging.signals_of(nodes)).select("graph_id", "node_id", "name")


@query(
    "d04_context_rules",
    f"WITH {domain.GRAPH_SQL}, {SIGNAL_SQL} SELECT graph_id, node_id, array_to_string(raw_rules, ',') AS matched FROM ruled",
)
def d04(spark, sf):
    nodes, _ = domain.graph(spark, sf)
    rows = tagging.name_filter(tagging.signals_of(nodes))
    matched = tagging.context_rules(F.col("low"), F.col("context"))
    return rows.select("graph_id", "node_id", F.array_join(matched, ",").alias("matched"))


@query("d05_rule_gating", f"WITH {ALL_SQL} SELECT graph_id, node_id, array_to_string(rules, ',') AS matched_rules FROM points")
def d05(spark, sf):
    return points(spark, sf)[0].select("graph_id", "node_id", F.array_join("matched_rules", ",").alias("matched_rules"))


@query("d06_role_arrays", f"WITH {ALL_SQL} SELECT graph_id, node_id, array_to_string(roles, ',') AS point_roles FROM points")
def d06(spark, sf):
    return points(spark, sf)[0].select("graph_id", "node_id", F.array_join("point_roles", ",").alias("point_roles"))


ACCESS_SQL = """
acc AS (
  SELECT i.graph_id, i.node_id AS point_id, i.other_id AS node_id, i.other_kind AS kind,
    CASE i.type WHEN 'writes' THEN 'write' WHEN 'connects' THEN 'control' ELSE CASE WHEN read_role IN ('condition', 'case_selector') THEN 'control' ELSE 'read' END END AS type,
    CASE i.type WHEN 'writes' THEN CASE WHEN other_kind = 'state_update' THEN 'state_update,register_write' ELSE 'register_write' END WHEN 'connects' THEN 'cross_module_connect'
      ELSE CASE read_role WHEN 'case_selector' THEN 'case_use' WHEN 'condition' THEN 'condition_use' ELSE 'register_read' END END AS access_roles,
    CASE i.type WHEN 'writes' THEN 0 WHEN 'reads' THEN 1 ELSE 3 END AS branch, i.side, i.ok, i.item_no
  FROM inc i JOIN points p ON p.graph_id = i.graph_id AND p.node_id = i.node_id WHERE i.side = 0 OR i.type = 'connects'
  UNION ALL SELECT graph_id, node_id, node_id, 'output_port', 'output', 'output_drive', 2, 0, NULL, NULL FROM points WHERE direction = 'output'),
firsts AS (SELECT *, row_number() OVER (PARTITION BY graph_id, point_id, node_id, type, access_roles ORDER BY branch, side, ok, item_no) AS f FROM acc),
access AS MATERIALIZED (SELECT graph_id, point_id, node_id, type, access_roles, no FROM (
  SELECT *, row_number() OVER (PARTITION BY graph_id, point_id ORDER BY branch, side, ok, item_no) AS no FROM firsts WHERE f = 1))
"""


@query(
    "d07_access_union",
    f"WITH {ALL_SQL}, {ACCESS_SQL} SELECT graph_id, point_id, node_id, type, access_roles, branch FROM acc",
)
def d07(spark, sf):
    found = tagging.all_accesses(*points(spark, sf))
    return found.select("graph_id", "point_id", "node_id", "type", F.array_join("access_roles", ",").alias("access_roles"), F.col("ord.branch").alias("branch"))


@query("d08_distinct_cap", f"WITH {ALL_SQL}, {ACCESS_SQL} SELECT * FROM access")
def d08(spark, sf):
    found = tagging.accesses(*points(spark, sf))
    return found.select("graph_id", "point_id", "node_id", "type", F.array_join("access_roles", ",").alias("access_roles"), "no")


TARGET_SQL = """
targets AS MATERIALIZED (
  SELECT *, 'target:' || module || ':' || name || ':' || seq AS target_id FROM (
    SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY module, name, node_id) AS seq FROM points))
"""


@query(
    "d09_target_assembly",
    f"""WITH {ALL_SQL}, {ACCESS_SQL}, {TARGET_SQL},
l AS (SELECT graph_id, target_id, node_id, 'point' AS role FROM targets UNION SELECT a.graph_id, t.target_id, a.node_id, 'access' FROM access a JOIN targets t ON t.graph_id = a.graph_id AND t.node_id = a.point_id)
SELECT l.graph_id, target_id, node_id, role, file, line_start, line_end FROM l JOIN nodes n ON n.graph_id = l.graph_id AND n.id = l.node_id""",
)
def d09(spark, sf):
    found, nodes, edges = points(spark, sf)
    targets = tagging.make_targets(found)
    locations = tagging.target_locations(targets, tagging.accesses(found, nodes, edges), nodes)
    return locations.select("graph_id", "target_id", "node_id", "role", "file", "line_start", "line_end")


# Targets of a graph under one module name, so that similar ones meet.
POOLED_SQL = f"""
pooled AS (SELECT * REPLACE (graph_id AS module) FROM targets),
keyed AS (SELECT *, CASE WHEN len(list_intersect(roles, {HIGH})) > 0 THEN [r for r in roles if list_contains({HIGH}, r)] ELSE roles[1:2] END AS k FROM pooled),
deduped AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY graph_id, module, name, k ORDER BY seq) AS d FROM keyed) WHERE d = 1),
prio AS (SELECT *, -(CASE WHEN list_contains(roles, 'register') THEN 4 ELSE 0 END + CASE WHEN list_contains(roles, 'output_port') THEN 3 ELSE 0 END
  + CASE WHEN list_contains(roles, 'control_like') THEN 2 ELSE 0 END + CASE WHEN len(list_intersect(roles, {HIGH})) > 0 THEN 2 ELSE 0 END) AS score FROM deduped),
modtop AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY graph_id, module ORDER BY score, name, seq) AS m FROM prio) WHERE m <= 20),
final AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY score, module, name, seq) AS rank FROM modtop) WHERE rank <= 15)
"""


def pooled(spark, sf):
    targets = tagging.make_targets(points(spark, sf)[0])
    return targets.withColumn("module", F.col("graph_id"))


@query(
    "d10_role_key_dedupe",
    f"WITH {ALL_SQL}, {TARGET_SQL}, {POOLED_SQL} SELECT graph_id, target_id, name, seq, array_to_string(roles, ',') AS point_roles FROM deduped",
)
def d10(spark, sf):
    return tagging.dedupe_targets(pooled(spark, sf)).select(
        "graph_id", "target_id", "name", "seq", F.array_join("point_roles", ",").alias("point_roles")
    )


@query(
    "d11_priority_topk",
    f"""WITH {ALL_SQL}, {TARGET_SQL}, {POOLED_SQL}, st AS (
  SELECT graph_id, count(*) AS b FROM pooled GROUP BY 1), dd AS (SELECT graph_id, count(*) AS d FROM deduped GROUP BY 1), mm AS (SELECT graph_id, count(*) AS m FROM modtop GROUP BY 1)
SELECT f.graph_id, f.target_id, f.score, f.rank, st.b - dd.d AS deduplicated_target_count, dd.d - mm.m AS targets_trimmed_by_module_limit, mm.m - least(mm.m, 15) AS targets_trimmed_by_repo_limit
FROM final f JOIN st USING (graph_id) JOIN dd USING (graph_id) JOIN mm USING (graph_id)""",
)
def d11(spark, sf):
    before = pooled(spark, sf)
    deduped = tagging.dedupe_targets(before)
    kept = tagging.trim_targets(deduped, 20, 15)
    stats = tagging.trim_stats(before, deduped, 20, 15)
    return kept.join(stats, "graph_id").select(
        "graph_id", "target_id", "score", "rank", "deduplicated_target_count", "targets_trimmed_by_module_limit", "targets_trimmed_by_repo_limit"
    )


@query(
    "d12_histograms",
    f"""WITH {ALL_SQL}, {ACCESS_SQL}
SELECT graph_id, histogram, name, count(*) AS n FROM (
  SELECT graph_id, 'matched_rules' AS histogram, unnest(rules) AS name FROM points
  UNION ALL SELECT graph_id, 'point_roles', unnest(roles) FROM points
  UNION ALL SELECT graph_id, 'access_roles', unnest(string_split(access_roles, ',')) FROM access
  UNION ALL SELECT graph_id, 'evidence_modes', unnest([{", ".join(tagging.EVIDENCE)}]) FROM points) WHERE name <> 'unavailable' GROUP BY ALL""",
)
def d12(spark, sf):
    found, nodes, edges = points(spark, sf)
    return tagging.histograms(found, found, tagging.accesses(found, nodes, edges))
