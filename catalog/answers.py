"""Response and evidence queries (i01 to i12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import domain
from catalog.ranges import FILE, files_of
from catalog.registry import query, table
from evigraph.operators import context, responses

# ------------------------------------------------------------ i01 to i04


@query(
    "i01_json_extract",
    """WITH e AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '```json' || chr(10) || props || chr(10) || '```' WHEN 1 THEN 'Answer: ' || props || ' done' WHEN 2 THEN ' ' || props || chr(10) WHEN 3 THEN 'no json ' || event_id ELSE '``` ' || props || ' trailing' END AS raw, props FROM events)
SELECT event_id, CASE WHEN event_id % 5 = 3 THEN NULL ELSE props END AS payload FROM e""",
)
def i01(spark, sf):
    no, p = F.col("event_id") % 5, F.col("props")
    raw = (
        F.when(no == 0, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(no == 1, F.concat(F.lit("Answer: "), p, F.lit(" done")))
        .when(no == 2, F.concat(F.lit(" "), p, F.lit("\n"))).when(no == 3, F.concat(F.lit("no json "), "event_id")).otherwise(F.concat(F.lit("``` "), p, F.lit(" trailing")))
    )
    return responses.extract_json(table(spark, sf, "events").select("event_id", raw.alias("raw")), F.col("raw")).drop("raw")


@query(
    "i02_content_blocks",
    """WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM conversations),
k AS (SELECT conv_id, turn, string_agg(line, chr(10) ORDER BY i) FILTER (i % 4 <> 1 AND trim(line) <> '') AS t FROM l GROUP BY 1, 2)
SELECT conv_id, turn, md5(trim(coalesce(t, ''))) AS content FROM k""",
)
def i02(spark, sf):
    blocks = F.transform(
        F.split("text", "\n"),
        lambda x, i: F.struct(
            F.when(i % 4 == 1, "Thinking").otherwise(F.lit("text")).alias("type"), F.when(i % 4 != 2, x).alias("text"), F.when(i % 4 == 2, x).alias("content")
        ),
    )
    return table(spark, sf, "conversations").select("conv_id", "turn", F.md5(responses.content_text(blocks)).alias("content"))


@query(
    "i03_token_usage",
    """SELECT conv_id, turn, CASE turn % 4 WHEN 3 THEN (length(text) + 3) // 4 WHEN 2 THEN 0 ELSE length(text) END AS input_tokens,
  CASE turn % 4 WHEN 0 THEN 7 WHEN 1 THEN turn WHEN 2 THEN 0 ELSE (length(role) + 3) // 4 END AS output_tokens,
  CASE turn % 4 WHEN 0 THEN length(text) + 7 WHEN 1 THEN 999 WHEN 2 THEN 55 ELSE (length(text) + 3) // 4 + (length(role) + 3) // 4 END AS total_tokens,
  CASE WHEN turn % 4 = 3 THEN 'estimated_char4' ELSE 'api' END AS token_usage_source FROM conversations""",
)
def i03(spark, sf):
    no, n = F.col("turn") % 4, F.length("text").cast("string")
    usage = (
        F.when(no == 0, F.concat(F.lit('{"usage_metadata": {"input_tokens": "x", "prompt_tokens": '), n, F.lit(', "candidates_token_count": "7"}}')))
        .when(no == 1, F.concat(F.lit('{"usage_metadata": {}, "response_metadata": {"usage": {"prompt_token_count": '), n, F.lit(', "completion_tokens": '), "turn", F.lit(', "total_tokens": 999}}}')))
        .when(no == 2, F.lit('{"response_metadata": {"token_usage": {"total_token_count": 55}}}'))
        .otherwise(F.lit('{"usage_metadata": {"input_tokens": null}}'))
    )
    rows = table(spark, sf, "conversations").select("conv_id", "turn", responses.token_usage(usage, F.col("text"), F.col("role")).alias("u"))
    return rows.select("conv_id", "turn", "u.*")


@query(
    "i04_response_schema",
    """SELECT event_id, CASE event_id % 8 WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN 'schema_validate' WHEN 3 THEN 'schema_validate' WHEN 4 THEN 'json_extract' WHEN 5 THEN 'schema_validate' WHEN 6 THEN '' ELSE 'schema_validate' END AS failure_stage FROM events""",
)
def i04(spark, sf):
    no = F.col("event_id") % 8
    body = '"finding": {"summary": "s", "reasoning_summary": "r", "security_impact": "i"'
    item = '{"snippet_id": "S1", "description": "d", "supports_claim": "c", "evidence_role": '
    head = F.concat(F.lit('{"chain_id": "C'), "event_id", F.lit('", "has_finding": true, "props": '), "props", F.lit(", "))
    raw = (
        F.when(no == 0, F.concat(head, F.lit(body + ', "evidence": [' + item + '"violation"}, ' + item + '"impact"}]}}')))
        .when(no == 1, F.concat(head, F.lit('"finding": null}')))
        .when(no == 2, F.concat(head, F.lit(body + ', "evidence": [' + item + '"guess"}]}}')))
        .when(no == 3, F.concat(F.lit('{"chain_id": "C", "props": '), "props", F.lit("}")))
        .when(no == 4, F.concat(F.lit("{broken "), "props"))
        .when(no == 5, F.concat(head, F.lit(body + ', "confidence": "certain"}}')))
        .when(no == 6, F.concat(head, F.lit(body + ', "confidence": "low"}}')))
        .otherwise(F.concat(F.lit('{"chain_id": 7, "has_finding": false, "props": '), "props", F.lit("}")))
    )
    rows = responses.extract_json(table(spark, sf, "events").select("event_id", raw.alias("raw")), F.col("raw"))
    return responses.response_problem(rows).select("event_id", "failure_stage")


@query(
    "i02_message_text",
    """WITH b AS (SELECT event_id, event_type, 'k' || user_id AS k FROM events)
SELECT event_id, CASE event_id % 6 WHEN 0 THEN event_type WHEN 1 THEN event_type || chr(10) || k || chr(10) || 'seen' WHEN 2 THEN '[{"type": "reasoning", "text": "' || k || '"}]'
  WHEN 3 THEN '{"text": "' || k || '"}' WHEN 4 THEN '{open ' || k ELSE CAST(event_id AS VARCHAR) END AS content FROM b""",
)
def i02_message(spark, sf):
    """Contents of every kind: a string, a list of blocks and bare items, reasoning alone, an object, no JSON, a number."""
    no, kind, key = F.col("event_id") % 6, F.col("event_type"), F.concat(F.lit("k"), "user_id")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    listed = F.concat(
        F.lit('["'), kind, F.lit('", {"type": "Thinking", "text": "no"}, {"type": "text", "text": null, "content": '), quoted(key), F.lit('}, {"text": " "}, {"text": ["x"]}, "seen"]')
    )
    raw = (
        F.when(no == 0, quoted(kind)).when(no == 1, listed).when(no == 2, F.concat(F.lit('[{"type": "reasoning", "text": '), quoted(key), F.lit("}]")))
        .when(no == 3, F.concat(F.lit('{"text": '), quoted(key), F.lit("}"))).when(no == 4, F.concat(F.lit("{open "), key)).otherwise(F.col("event_id").cast("string"))
    )
    rows = table(spark, sf, "events").select("event_id", raw.alias("raw"))
    return rows.select("event_id", responses.message_text(F.col("raw")).alias("content"))


@query(
    "i04_tool_schemas",
    """SELECT event_id, 'tool_actions' AS schema, CASE event_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'schema_validate' WHEN 2 THEN '' WHEN 3 THEN 'schema_validate' WHEN 4 THEN 'json_extract' ELSE '' END AS failure_stage FROM events
UNION ALL SELECT event_id, 'tool_analysis', CASE event_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'schema_validate' WHEN 2 THEN 'schema_validate' WHEN 3 THEN 'schema_validate' WHEN 4 THEN '' ELSE '' END FROM events""",
)
def i04_tools(spark, sf):
    """Requests for tool actions, and analyses that name files and lines themselves; lines have to be whole numbers."""
    no, line = F.col("event_id") % 6, F.col("user_id").cast("string")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    action = '{"chain_id": "C", "actions": [{"tool": "%s", "file": "a.v", "line_start": '
    actions = (
        F.when(no == 0, text(action % "read_around", line, ', "line_end": null, "query": null}]}'))
        .when(no == 1, text(action % "delete_file", line, "}]}"))
        .when(no == 2, text('{"chain_id": "C", "more": ', line, "}"))
        .when(no == 3, text(action % "search_in_file", line, '.5, "query": "q"}]}'))
        .when(no == 4, text('{"chain_id" ', line))
        .otherwise(text(action % "search_in_file", '"', line, '", "query": "q", "reason": "r"}]}'))
    )
    head = '{"chain_id": "C", "has_finding": true, "finding": {"summary": "s", "reasoning_summary": "r", "security_impact": "i", "evidence": ['
    item = '{"file": "a.v", "description": "d", "supports_claim": "c", "evidence_role": "impact", "line_start": '
    analysis = (
        F.when(no == 0, text(head, item, line, ', "line_end": ', line, ', "module": "m"}]}}'))
        .when(no == 1, text(head, item, line, "}]}}"))
        .when(no == 2, text(head, item, line, ', "line_end": "x"}]}}'))
        .when(no == 3, text(head, item, line, '.25, "line_end": ', line, "}]}}"))
        .when(no == 4, text('{"chain_id": "C', line, '", "has_finding": "no", "finding": null}'))
        .otherwise(text(head, item, line, '.0, "line_end": "', line, '"}]}}'))
    )
    out = []
    for name, payload in (("tool_actions", actions), ("tool_analysis", analysis)):
        rows = table(spark, sf, "events").select("event_id", F.lit(name).alias("schema"), payload.alias("payload"))
        out.append(responses.response_problem(rows, schema=name).drop("payload"))
    return out[0].unionByName(out[1])


# ------------------------------------------------------------ i05 to i07

EVIDENCE_SQL = """
ev AS (SELECT 'CH' || l_orderkey AS chain_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ev_no, 'S' || (l_partkey % 14) AS snippet_id,
  CASE WHEN l_returnflag = 'A' THEN 'violation' WHEN l_returnflag = 'N' THEN 'impact' ELSE 'guard_logic' END AS evidence_role FROM lineitem),
sn AS (SELECT 'CH' || o_orderkey AS chain_id, 'S' || k AS snippet_id, 'f' || (o_custkey % 20) AS file, CAST(k * 10 - o_orderkey % 3 AS INT) AS line_start, CAST(k * 10 + o_orderkey % 9 AS INT) AS line_end FROM orders CROSS JOIN range(10) r(k)),
fl AS (SELECT 'f' || n_nationkey AS file, 40 + n_nationkey * 3 AS line_count FROM nation WHERE n_nationkey < 18),
ck AS MATERIALIZED (SELECT ev.*, sn.file, sn.line_start, sn.line_end, sn.chain_id IS NOT NULL AS known, coalesce(sn.line_start >= 1 AND sn.line_end >= sn.line_start AND sn.line_end <= fl.line_count, false) AS valid
  FROM ev LEFT JOIN sn ON sn.chain_id = ev.chain_id AND sn.snippet_id = ev.snippet_id LEFT JOIN fl ON fl.file = sn.file),
verdict AS MATERIALIZED (
  SELECT chain_id, count(*) FILTER (valid) AS valid_evidence, count(*) FILTER (valid AND evidence_role = 'violation') AS violations, count(*) FILTER (NOT known) AS invalid_snippet_ids,
    arg_min(struct_pack(f := file, s := line_start, e := line_end), CASE WHEN evidence_role = 'violation' THEN 0 ELSE 1000000 END + ev_no) FILTER (valid) AS loc FROM ck GROUP BY 1)
"""


def evidence_tables(spark, sf):
    flag = F.col("l_returnflag")
    evidence = domain.items(spark, sf).select(
        F.concat(F.lit("CH"), "l_orderkey").alias("chain_id"), F.col("item_no").alias("ev_no"), F.concat(F.lit("S"), F.col("l_partkey") % 14).alias("snippet_id"),
        F.when(flag == "A", "violation").when(flag == "N", "impact").otherwise(F.lit("guard_logic")).alias("evidence_role"),
    )
    k, o = F.col("k"), F.col("o_orderkey")
    snippets = table(spark, sf, "orders").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(9)))).select(
        F.concat(F.lit("CH"), o).alias("chain_id"), F.concat(F.lit("S"), k).alias("snippet_id"), F.concat(F.lit("f"), F.col("o_custkey") % 20).alias("file"),
        (k * 10 - o % 3).cast("int").alias("line_start"), (k * 10 + o % 9).cast("int").alias("line_end"),
    )
    files = table(spark, sf, "nation").filter("n_nationkey < 18").select(F.concat(F.lit("f"), "n_nationkey").alias("file"), (F.col("n_nationkey") * 3 + 40).alias("line_count"))
    return responses.check_evidence(evidence, snippets, files, ["chain_id"], ["file"])


@query(
    "i05_evidence_fk",
    f"""WITH {EVIDENCE_SQL} SELECT chain_id, valid_evidence, violations, invalid_snippet_ids, CASE WHEN violations > 0 THEN 'accepted' ELSE 'discarded' END AS status,
  CASE WHEN valid_evidence = 0 THEN 'no_valid_evidence' WHEN violations = 0 THEN 'missing_violation_evidence' ELSE '' END AS discard_reason,
  CASE WHEN violations > 0 THEN loc.f END AS file, CASE WHEN violations > 0 THEN loc.s END AS line_start, CASE WHEN violations > 0 THEN loc.e END AS line_end FROM verdict""",
)
def i05(spark, sf):
    return responses.evidence_verdict(evidence_tables(spark, sf), ["chain_id"])


@query(
    "i06_first_nonblank",
    """WITH m AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, (event_id * 7) % 1999 AS node FROM events),
n AS (SELECT p_partkey AS node, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand END AS module, CASE WHEN p_size % 5 < 3 THEN '' ELSE p_name END AS name FROM part)
SELECT user_id, coalesce(arg_min(module, pos) FILTER (module <> ''), '') AS module, coalesce(arg_min(name, pos) FILTER (name <> ''), '') AS name FROM m LEFT JOIN n USING (node) GROUP BY 1""",
)
def i06(spark, sf):
    members = table(spark, sf, "events").select("user_id", F.struct("ts", "event_id").alias("pos"), ((F.col("event_id") * 7) % 1999).alias("node_id"))
    size = F.col("p_size")
    nodes = table(spark, sf, "part").select(
        F.col("p_partkey").alias("node_id"), F.when(size % 3 == 0, "").otherwise(F.col("p_brand")).alias("module"), F.when(size % 5 < 3, "").otherwise(F.col("p_name")).alias("name")
    )
    return responses.first_nonblank(members, nodes, ["user_id"], ["module", "name"])


OUTCOME_SQL = """
o AS (SELECT role AS scope_id, conv_id * 100 + turn AS ord, 'CH' || conv_id || '_' || turn AS chain_id,
  CASE WHEN conv_id % 9 = 0 THEN 'llm_failed' WHEN conv_id % 7 = 0 THEN 'chain_id_mismatch' WHEN length(text) % 2 = 0 THEN 'no_finding' WHEN length(text) % 5 = 0 THEN 'discarded' WHEN turn % 3 = 0 THEN 'discarded' ELSE 'accepted' END AS status,
  length(text) % 2 = 1 AS hf FROM conversations)
"""


def _outcomes(spark, sf):
    n = F.length("text")
    rows = table(spark, sf, "conversations").select(
        F.col("role").alias("scope_id"), (F.col("conv_id") * 100 + F.col("turn")).alias("ord"), F.concat(F.lit("CH"), "conv_id", F.lit("_"), "turn").alias("chain_id"),
        (F.col("conv_id") % 9 == 0).alias("failed"),
        F.concat(F.when(F.col("conv_id") % 7 == 0, "XX").otherwise(F.lit("CH")), "conv_id", F.lit("_"), "turn").alias("answered_chain_id"),
        (n % 2 == 1).alias("has_finding"), (n % 5 != 0).alias("has_body"), F.when(F.col("turn") % 3 == 0, "discarded").otherwise(F.lit("accepted")).alias("verdict"),
    )
    return responses.outcomes(rows)


@query(
    "i07_outcome_status",
    f"""WITH {OUTCOME_SQL} SELECT 'chain' AS level, scope_id, chain_id, status, CASE WHEN status = 'accepted' THEN 'F-' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END ELSE '' END AS finding_id, 1 AS analyzed, 0 AS final, 0 AS raw_found, 0 AS discarded, 0 AS empty
FROM (SELECT *, row_number() OVER (PARTITION BY scope_id, status ORDER BY ord) AS n FROM o)
UNION ALL SELECT 'scope', scope_id, '', '', '', count(*), count(*) FILTER (status = 'accepted'), count(*) FILTER (status <> 'llm_failed' AND hf), count(*) FILTER (status IN ('llm_failed', 'chain_id_mismatch', 'discarded')), count(*) FILTER (status = 'no_finding') FROM o GROUP BY 2""",
)
def i07(spark, sf):
    rows = _outcomes(spark, sf)
    zero, blank = F.lit(0).cast("long"), F.lit("")
    chain = rows.select(
        F.lit("chain").alias("level"), "scope_id", "chain_id", "status", "finding_id", F.lit(1).cast("long").alias("analyzed"), *[zero.alias(c) for c in ("final", "raw_found", "discarded", "empty")]
    )
    scope = responses.outcome_counters(rows).select(
        F.lit("scope").alias("level"), "scope_id", blank.alias("chain_id"), blank.alias("status"), blank.alias("finding_id"),
        F.col("analyzed_chain_count").alias("analyzed"), F.col("final_finding_count").alias("final"), F.col("raw_llm_finding_count").alias("raw_found"),
        F.col("discarded_finding_count").alias("discarded"), F.col("no_finding_count").alias("empty"),
    )
    return chain.unionByName(scope)


# ------------------------------------------------------------ i08 to i12

ACTION_SQL = """
act AS (SELECT 'CH' || (user_id % 50) AS chain_id, event_id AS action_no, CASE WHEN event_id % 23 = 0 THEN 'Cases/f' || (user_id % 9) ELSE 'f' || (event_id % 30) END AS file FROM events),
alw AS (SELECT DISTINCT 'CH' || (c_custkey % 50) AS chain_id, 'f' || (c_nationkey + c_custkey % 3) AS file FROM customer)
"""


def actions(spark, sf):
    eid, user = F.col("event_id"), F.col("user_id")
    acts = table(spark, sf, "events").select(
        F.concat(F.lit("CH"), user % 50).alias("chain_id"), eid.alias("action_no"),
        F.when(eid % 23 == 0, F.concat(F.lit("Cases/f"), user % 9)).otherwise(F.concat(F.lit("f"), eid % 30)).alias("file"),
    )
    allowed = table(spark, sf, "customer").select(
        F.concat(F.lit("CH"), F.col("c_custkey") % 50).alias("chain_id"), F.concat(F.lit("f"), F.col("c_nationkey") + F.col("c_custkey") % 3).alias("file")
    )
    return acts, allowed


@query(
    "i08_allowlist",
    f"""WITH {ACTION_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY chain_id ORDER BY action_no) AS n FROM act)
SELECT r.chain_id, action_no, r.file, CASE WHEN a.file IS NULL OR contains(lower(r.file), 'case') THEN 'denied' WHEN r.file NOT IN (SELECT 'f' || n_nationkey FROM nation WHERE n_nationkey % 4 <> 1) THEN 'error' ELSE 'ok' END AS status
FROM r LEFT JOIN alw a ON a.chain_id = r.chain_id AND a.file = r.file""",
)
def i08(spark, sf):
    acts, allowed = actions(spark, sf)
    files = table(spark, sf, "nation").filter("n_nationkey % 4 <> 1").select(F.concat(F.lit("f"), "n_nationkey").alias("file"))
    return responses.judge_actions(acts, allowed, files, ["chain_id"])


NEEDLES = ["The ", "que", "und", "zz"]


@query(
    "i09_text_search",
    """WITH l AS (SELECT doc_id, unnest(string_split(regexp_replace(text, chr(10) || '$', ''), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(text, chr(10) || '$', ''), chr(10)), 1) AS line_no FROM documents WHERE text <> ''),
h AS (SELECT q.query, l.*, row_number() OVER (PARTITION BY q.query ORDER BY doc_id, line_no) AS match_no FROM l JOIN (VALUES ('the '), ('que'), ('und'), ('zz')) q(query) ON contains(lower(line), q.query))
SELECT query, doc_id, line_no, match_no, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS line FROM h""",
)
def i09(spark, sf):
    lines = context.source_lines(table(spark, sf, "documents").select("doc_id", "text"), ["doc_id"], "text")
    return responses.search_lines(lines, NEEDLES, F.col("doc_id")).select("query", "doc_id", "line_no", "match_no", "line")


@query(
    "i10_read_around",
    """WITH f AS (SELECT source AS scope_id, 'doc' || doc_id AS file, doc_id, n_chars, string_split(regexp_replace(text, chr(10) || '$', ''), chr(10)) AS l FROM documents WHERE text <> ''),
r AS (SELECT *, n_chars % 40 AS s, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE n_chars % 40 + 2 END AS e FROM f),
w AS (SELECT *, greatest(1, coalesce(nullif(s, 0), 1) - 10) AS a, least(len(l), coalesce(e, nullif(s, 0), 1) + 18) AS b FROM r),
t AS (SELECT scope_id, file, a, b, coalesce(array_to_string([i || ': ' || l[i] FOR i IN range(a, b + 1)], chr(10)), '') AS c FROM w)
SELECT scope_id, file, md5(c) AS content FROM t""",
)
def i10(spark, sf):
    sources = files_of(spark, sf)
    keyed = table(spark, sf, "documents").filter("text <> ''")
    start = (F.col("n_chars") % 40).cast("int")
    requests = keyed.select(
        F.col("source").alias("scope_id"), F.concat(F.lit("doc"), "doc_id").alias("file"), F.col("doc_id").alias("request_id"), start.alias("line_start"),
        F.when(F.col("doc_id") % 3 != 0, start + 2).alias("line_end"),
    )
    out = responses.read_around(
        requests, context.source_lines(sources, FILE, "text"), context.line_counts(sources, FILE, "text"), FILE, ["request_id"]
    )
    return out.select("scope_id", "file", F.md5("content").alias("content"))


@query(
    "i11_evidence_range",
    """WITH f AS (SELECT 'doc' || doc_id AS file, CASE WHEN text = '' THEN 0 ELSE len(string_split(regexp_replace(text, chr(10) || '$', ''), chr(10))) END AS n FROM documents WHERE doc_id % 9 <> 0)
SELECT doc_id, coalesce(n_chars % 11 >= 1 AND n_chars % 13 >= n_chars % 11 AND n_chars % 13 <= n, false) AS valid FROM documents LEFT JOIN f ON f.file = 'doc' || doc_id""",
)
def i11(spark, sf):
    docs = table(spark, sf, "documents")
    name = F.concat(F.lit("doc"), "doc_id").alias("file")
    files = context.line_counts(docs.filter("doc_id % 9 <> 0").select(name, "text"), ["file"], "text")
    evidence = docs.select("doc_id", name, (F.col("n_chars") % 11).alias("line_start"), (F.col("n_chars") % 13).alias("line_end"))
    return responses.check_ranges(evidence, files, ["file"]).select("doc_id", "valid")


@query("i12_allowed_files", f"WITH {ACTION_SQL} SELECT chain_id, string_agg(DISTINCT file, ',' ORDER BY file) AS allowed_files FROM act GROUP BY 1")
def i12(spark, sf):
    acts, _ = actions(spark, sf)
    return responses.allowed_files(acts, ["chain_id"]).select("chain_id", F.array_join("allowed_files", ",").alias("allowed_files"))
