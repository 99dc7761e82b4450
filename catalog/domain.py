"""Domain tables derived from the driver tables, in Spark and as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.registry import table, texts
from evigraph.functions.scan import ordered_scan, row_no
from evigraph.session import persist_table

# ------------------------------------------------------------ findings and ground truth

FINDINGS_SQL = """
labelled AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
shaped AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, r.rep,
         (d.n_chars + r.rep * 7 + d.doc_id) % 10 AS h
  FROM documents d LEFT JOIN labelled l ON d.doc_id = l.doc_id
  CROSS JOIN (VALUES (1), (2), (3)) r(rep)),
matched AS (
  SELECT *, CASE WHEN h IN (0, 1, 2) THEN 'FP' WHEN h = 3 THEN 'Unscorable' WHEN h = 4 THEN 'Duplicate'
                 WHEN quality = 1 OR doc_id % 11 = 0 THEN 'TP' ELSE 'FP' END AS detection_match
  FROM shaped),
findings AS (
  SELECT 'doc' || doc_id || ':rep_' || rep AS finding_uid,
         CASE WHEN doc_id % 2 = 0 THEN 'alpha' ELSE 'beta' END AS model_family,
         CASE WHEN doc_id % 5 < 2 THEN 'baseline' ELSE 'proposed' END AS method_name,
         source AS input_scope, CAST(rep AS VARCHAR) AS repetition,
         'run:' || source || ':rep_' || rep AS run_id,
         'models/m/' || source || '/rep_' || rep || '/final_answer.json' AS final_answer_path,
         'doc ' || doc_id || ' in ' || lang AS summary,
         CASE WHEN detection_match = 'Duplicate' OR (detection_match = 'TP' AND quality = 1) THEN 'C' || (doc_id - doc_id % 40 + doc_id % 20)
              WHEN detection_match = 'TP' THEN 'X' || doc_id ELSE '' END AS matched_case_id,
         detection_match,
         CASE (n_chars + rep) % 5 WHEN 0 THEN 'Sufficient' WHEN 1 THEN 'Insufficient' WHEN 2 THEN 'Unclear'
              WHEN 3 THEN 'Unsupported' ELSE 'Fabricated' END AS evidence_quality,
         source || '.sv; rtl/' || lang || '_top.v' AS claimed_files,
         lang || '_top; ' || source AS claimed_modules,
         doc_id * 3 + rep - 1 AS ord, doc_id, text
  FROM matched),
gt AS (
  SELECT DISTINCT 'C' || d.doc_id AS case_id, d.source AS input_scope, 'b' || (d.doc_id % 3) AS benchmark_id,
         'case ' || d.doc_id AS case_description, d.doc_id AS ord
  FROM documents d JOIN labelled l ON d.doc_id = l.doc_id WHERE l.quality = 1)
"""


def findings(spark: SparkSession, sf: str) -> DataFrame:
    docs = texts(spark, sf, "documents", "doc_id", "text", "lang", "source", "n_chars")
    labelled = table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = docs.join(labelled, "doc_id", "left").withColumn("rep", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    h = (F.col("n_chars") + F.col("rep") * 7 + F.col("doc_id")) % 10
    doc, known = F.col("doc_id"), F.coalesce(F.col("quality") == 1, F.lit(False))
    match = (
        F.when(h.isin(0, 1, 2), "FP").when(h == 3, "Unscorable").when(h == 4, "Duplicate")
        .when(known | (doc % 11 == 0), "TP").otherwise(F.lit("FP"))
    )
    rows = rows.withColumn("detection_match", match)
    is_tp = F.col("detection_match") == "TP"
    shared_case = F.concat(F.lit("C"), (doc - doc % 40 + doc % 20).cast("string"))
    case_id = (
        F.when((F.col("detection_match") == "Duplicate") | (is_tp & known), shared_case)
        .when(is_tp, F.concat(F.lit("X"), doc)).otherwise(F.lit(""))
    )
    quality = F.element_at(
        F.array(*[F.lit(q) for q in ("Sufficient", "Insufficient", "Unclear", "Unsupported", "Fabricated")]),
        ((F.col("n_chars") + F.col("rep")) % 5 + 1).cast("int"),
    )
    rep = F.col("rep").cast("string")
    return rows.select(
        F.concat(F.lit("doc"), doc, F.lit(":rep_"), rep).alias("finding_uid"),
        F.when(doc % 2 == 0, "alpha").otherwise(F.lit("beta")).alias("model_family"),
        F.when(doc % 5 < 2, "baseline").otherwise(F.lit("proposed")).alias("method_name"),
        F.col("source").alias("input_scope"),
        rep.alias("repetition"),
        F.concat(F.lit("run:"), "source", F.lit(":rep_"), rep).alias("run_id"),
        F.concat(F.lit("models/m/"), "source", F.lit("/rep_"), rep, F.lit("/final_answer.json")).alias("final_answer_path"),
        F.concat(F.lit("doc "), doc, F.lit(" in "), "lang").alias("summary"),
        case_id.alias("matched_case_id"),
        "detection_match",
        quality.alias("evidence_quality"),
        F.concat("source", F.lit(".sv; rtl/"), "lang", F.lit("_top.v")).alias("claimed_files"),
        F.concat("lang", F.lit("_top; "), "source").alias("claimed_modules"),
        (doc * 3 + F.col("rep") - 1).alias("ord"),
        "doc_id",
        "text",
    )


def gt_cases(spark: SparkSession, sf: str) -> DataFrame:
    good = table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("q")).filter("q = 1")
    docs = table(spark, sf, "documents").select("doc_id", "source").join(good, "doc_id", "left_semi")
    return docs.select(
        F.concat(F.lit("C"), "doc_id").alias("case_id"),
        F.col("source").alias("input_scope"),
        F.concat(F.lit("b"), F.col("doc_id") % 3).alias("benchmark_id"),
        F.concat(F.lit("case "), "doc_id").alias("case_description"),
        F.col("doc_id").alias("ord"),
    )


# ------------------------------------------------------------ reviewed score tables

SCORES_SQL = """
metadata AS (
  SELECT 'r' || c_custkey AS run_id, 'm' || (c_nationkey % 3) AS model_family, c_mktsegment AS input_scope,
         'idx' || (c_custkey % 3) AS run_index
  FROM customer WHERE c_custkey % 10 <> 9),
cases AS (
  SELECT 'r' || o_custkey AS run_id, 'C' || (o_orderkey % 200) AS case_id,
         CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'b' || (o_orderkey % 3) END AS benchmark_id,
         o_orderpriority AS input_scope,
         CASE o_orderkey % 5 WHEN 0 THEN 'hidden' WHEN 1 THEN ' Visible' ELSE 'visible' END AS case_visibility,
         CASE o_orderstatus WHEN 'F' THEN 'TP' WHEN 'O' THEN 'partial' ELSE 'FN' END AS case_result,
         o_orderkey AS ord
  FROM orders),
scored AS (
  SELECT 'r' || l_suppkey AS run_id, 'scope_' || (l_suppkey % 4) AS input_scope,
         CASE WHEN l_linenumber = 7 THEN 'Unscorable' WHEN l_returnflag = 'A' THEN 'TP' WHEN l_returnflag = 'N' THEN 'FP' ELSE 'Partial' END AS detection_match,
         CASE l_linenumber WHEN 1 THEN 'Insufficient' WHEN 2 THEN 'Fabricated' WHEN 3 THEN 'unsupported ' ELSE 'Sufficient' END AS evidence_quality,
         CASE WHEN l_discount < 0.03 THEN 'Yes' ELSE 'no' END AS wrong_localization,
         CASE WHEN l_tax > 0.06 THEN 'yes' ELSE '' END AS insufficient_evidence,
         CASE WHEN l_quantity > 45 THEN 'yes' ELSE '' END AS fabricated_evidence,
         '' AS unsupported_claim,
         CASE WHEN l_quantity < 10 THEN 'YES' ELSE '' END AS overconfidence,
         l_orderkey AS ord
  FROM lineitem)
"""


def score_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    metadata = table(spark, sf, "customer").filter("c_custkey % 10 <> 9").select(
        F.concat(F.lit("r"), "c_custkey").alias("run_id"),
        F.concat(F.lit("m"), F.col("c_nationkey") % 3).alias("model_family"),
        F.col("c_mktsegment").alias("input_scope"),
        F.concat(F.lit("idx"), F.col("c_custkey") % 3).alias("run_index"),
    )
    key = F.col("o_orderkey")
    cases = table(spark, sf, "orders").select(
        F.concat(F.lit("r"), "o_custkey").alias("run_id"),
        F.concat(F.lit("C"), key % 200).alias("case_id"),
        F.when(key % 4 == 0, "").otherwise(F.concat(F.lit("b"), key % 3)).alias("benchmark_id"),
        F.col("o_orderpriority").alias("input_scope"),
        F.when(key % 5 == 0, "hidden").when(key % 5 == 1, " Visible").otherwise(F.lit("visible")).alias("case_visibility"),
        F.when(F.col("o_orderstatus") == "F", "TP").when(F.col("o_orderstatus") == "O", "partial").otherwise(F.lit("FN")).alias("case_result"),
        key.alias("ord"),
    )
    line, flag, qty = F.col("l_linenumber"), F.col("l_returnflag"), F.col("l_quantity")
    scored = table(spark, sf, "lineitem").select(
        F.concat(F.lit("r"), "l_suppkey").alias("run_id"),
        F.concat(F.lit("scope_"), F.col("l_suppkey") % 4).alias("input_scope"),
        F.when(line == 7, "Unscorable").when(flag == "A", "TP").when(flag == "N", "FP").otherwise(F.lit("Partial")).alias("detection_match"),
        F.when(line == 1, "Insufficient").when(line == 2, "Fabricated").when(line == 3, "unsupported ").otherwise(F.lit("Sufficient")).alias("evidence_quality"),
        F.when(F.col("l_discount") < 0.03, "Yes").otherwise(F.lit("no")).alias("wrong_localization"),
        F.when(F.col("l_tax") > 0.06, "yes").otherwise(F.lit("")).alias("insufficient_evidence"),
        F.when(qty > 45, "yes").otherwise(F.lit("")).alias("fabricated_evidence"),
        F.lit("").alias("unsupported_claim"),
        F.when(qty < 10, "YES").otherwise(F.lit("")).alias("overconfidence"),
        F.col("l_orderkey").alias("ord"),
    )
    return metadata, cases, scored


# ------------------------------------------------------------ property graph

SIGNAL_NAMES = [
    "debug_en", "lock_q", "rst_ni", "cfg_data", "key_reg", "addr_hit", "dma_len", "valid", "data", "TMP_CONST",
    "csr_mask", "user_mode", "wrapper_top", "tmp", "fuse_mem",
]
MODULE_SUFFIXES = ["", "_rsa", "_rst_ctrl", "_dma", "_aes_wrapper", "_core"]


def _sql_list(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _mod(p):
    return f"'m' || (({p}) // 15) || {_sql_list(MODULE_SUFFIXES)}[(({p}) // 15) % 6 + 1]"


def _sig(p):
    return f"'signal:' || {_mod(p)} || '.' || {_sql_list(SIGNAL_NAMES)}[({p}) % 15 + 1]"


GRAPH_SQL = f"""
items AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS item_no,
    'g' || (l_partkey // 60) AS graph_id, {_mod("l_partkey")} AS module, l_orderkey % 40 * 5 + 200 AS line,
    ['state_update', 'procedural_assign', 'continuous_assign'][l_suppkey % 3 + 1] AS skind FROM lineitem),
nodes AS MATERIALIZED (
  SELECT DISTINCT 'g' || (p_partkey // 60) AS graph_id, 'module:' || {_mod("p_partkey")} AS id, 'Module' AS type, NULL AS scope, {_mod("p_partkey")} AS name,
    'rtl/' || {_mod("p_partkey")} || '.sv' AS file, 1 AS line_start, 500 AS line_end, NULL AS kind, NULL AS direction, NULL AS decl_raw FROM part
  UNION ALL
  SELECT 'g' || (p_partkey // 60), {_sig("p_partkey")}, 'Signal', 'module:' || {_mod("p_partkey")}, {_sql_list(SIGNAL_NAMES)}[p_partkey % 15 + 1],
    'rtl/' || {_mod("p_partkey")} || '.sv', p_partkey % 15 * 10 + 1, p_partkey % 15 * 10 + 1, ['register', 'port', 'internal', 'implicit'][p_size % 4 + 1],
    CASE WHEN p_size % 4 = 1 THEN CASE WHEN p_partkey % 2 = 0 THEN 'output' ELSE 'input' END END, CASE WHEN p_size % 4 <> 3 THEN 'decl' END FROM part
  UNION ALL
  SELECT DISTINCT graph_id, 'instance:' || module || '.u' || (l_suppkey % 5), 'Instance', 'module:' || module, 'u' || (l_suppkey % 5), 'rtl/' || module || '.sv',
    400 + l_suppkey % 5, 400 + l_suppkey % 5, NULL, NULL, NULL FROM items WHERE l_returnflag = 'R'
  UNION ALL
  SELECT DISTINCT graph_id, 'stmt:' || module || ':' || line || ':' || skind, 'StmtSummary', 'module:' || module, skind || ':' || line, 'rtl/' || module || '.sv',
    line, line, skind, NULL, NULL FROM items WHERE l_returnflag <> 'R'),
edges AS MATERIALIZED (
  SELECT graph_id, 'edge:' || CASE l_returnflag WHEN 'A' THEN 'writes' WHEN 'N' THEN 'reads' ELSE 'connects' END || ':' || l_orderkey || '_' || item_no AS id,
    CASE l_returnflag WHEN 'A' THEN 'writes' WHEN 'N' THEN 'reads' ELSE 'connects' END AS type,
    CASE WHEN l_returnflag = 'R' THEN {_sig("l_partkey")} ELSE 'stmt:' || module || ':' || line || ':' || skind END AS from_id,
    CASE WHEN l_returnflag = 'R' THEN {_sig("l_partkey + 15")} ELSE {_sig("l_partkey")} END AS to_id,
    CASE WHEN l_returnflag = 'R' THEN 'instance:' || module || '.u' || (l_suppkey % 5) END AS via_instance,
    CASE WHEN l_returnflag = 'N' THEN ['rhs', 'condition', 'case_selector'][l_linenumber % 3 + 1] END AS read_role, l_orderkey AS ok, item_no
  FROM items)
"""


def _pick(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def _module(p):
    j = F.floor(p / 15)
    return F.concat(F.lit("m"), j, _pick(MODULE_SUFFIXES, j))


def _signal(p):
    return F.concat(F.lit("signal:"), _module(p), F.lit("."), _pick(SIGNAL_NAMES, p))


def items(spark: SparkSession, sf: str) -> DataFrame:
    """Lineitems numbered within their order."""
    order = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")]
    return ordered_scan(table(spark, sf, "lineitem"), ["l_orderkey"], order, {"item_no": row_no()})


def graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of one property graph per 60 parts."""
    p = F.col("l_partkey")
    kind = F.when(F.col("l_returnflag") == "A", "writes").when(F.col("l_returnflag") == "N", "reads").otherwise(F.lit("connects"))
    rows = items(spark, sf).withColumns(
        {
            "graph_id": F.concat(F.lit("g"), F.floor(p / 60)),
            "module": _module(p),
            "line": (F.col("l_orderkey") % 40 * 5 + 200).cast("int"),
            "skind": _pick(["state_update", "procedural_assign", "continuous_assign"], F.col("l_suppkey")),
            "type": kind,
        }
    )
    nothing = F.lit(None).cast("string")
    part = table(spark, sf, "part")
    q = F.col("p_partkey")
    gid, mod = F.concat(F.lit("g"), F.floor(q / 60)), _module(q)
    file = lambda m: F.concat(F.lit("rtl/"), m, F.lit(".sv"))
    cols = lambda *c: [x.alias(n) for x, n in zip(c, NODE_COLUMNS)]
    modules = part.select(*cols(gid, F.concat(F.lit("module:"), mod), F.lit("Module"), nothing, mod, file(mod), F.lit(1), F.lit(500), nothing, nothing, nothing)).distinct()
    at = (q % 15 * 10 + 1).cast("int")
    size = F.col("p_size")
    signals = part.select(
        *cols(
            gid, _signal(q), F.lit("Signal"), F.concat(F.lit("module:"), mod), _pick(SIGNAL_NAMES, q), file(mod), at, at,
            _pick(["register", "port", "internal", "implicit"], size),
            F.when(size % 4 == 1, F.when(q % 2 == 0, "output").otherwise(F.lit("input"))),
            F.when(size % 4 != 3, "decl"),
        )
    )
    m, line = F.col("module"), F.col("line")
    unit = F.concat(F.lit("u"), F.col("l_suppkey") % 5)
    inst_line = (F.col("l_suppkey") % 5 + 400).cast("int")
    scope = F.concat(F.lit("module:"), m)
    inst_id = F.concat(F.lit("instance:"), m, F.lit("."), unit)
    stmt = F.concat(F.lit("stmt:"), m, F.lit(":"), line.cast("string"), F.lit(":"), "skind")
    instances = rows.filter("l_returnflag = 'R'").select(
        *cols(F.col("graph_id"), inst_id, F.lit("Instance"), scope, unit, file(m), inst_line, inst_line, nothing, nothing, nothing)
    ).distinct()
    statements = rows.filter("l_returnflag <> 'R'").select(
        *cols(F.col("graph_id"), stmt, F.lit("StmtSummary"), scope, F.concat_ws(":", "skind", line.cast("string")), file(m), line, line, F.col("skind"), nothing, nothing)
    ).distinct()
    nodes = modules.unionByName(signals).unionByName(instances).unionByName(statements)
    link = F.col("l_returnflag") == "R"
    edges = rows.select(
        "graph_id",
        F.concat(F.lit("edge:"), "type", F.lit(":"), "l_orderkey", F.lit("_"), "item_no").alias("id"),
        "type",
        F.when(link, _signal(p)).otherwise(stmt).alias("from_id"),
        F.when(link, _signal(p + 15)).otherwise(_signal(p)).alias("to_id"),
        F.when(link, inst_id).alias("via_instance"),
        F.when(F.col("l_returnflag") == "N", _pick(["rhs", "condition", "case_selector"], F.col("l_linenumber"))).alias("read_role"),
        F.struct("l_orderkey", "item_no").alias("ord"),
    )
    return persist_table(nodes, "nodes"), persist_table(edges, "edges")


NODE_COLUMNS = ["graph_id", "id", "type", "scope", "name", "file", "line_start", "line_end", "kind", "direction", "decl_raw"]
