"""Text extraction queries (b01 to b16) on documents and on a corpus rendered from orders and lineitem.

One source file per order (and per 200 of its lineitems). The oracle is the
relational query the text was rendered from, so it needs no parsing.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import domain
from catalog.registry import query, table
from evigraph.functions import brackets, text as tx
from evigraph.functions.scan import last_value, ordered_scan
from evigraph.operators import context, extract
from evigraph.session import persist_table

CHUNK = 200


def parts(spark, sf):
    """Lineitems with the names and texts of their piece of source."""
    k, p, s, q = F.col("item_no"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity").cast("int")
    cat = F.concat
    lit = F.lit
    port_a = cat(lit("  input ["), q, lit(":0] a"), k, lit("_"), p, lit(", b"), k)
    body_a = cat(
        lit("  wire ["), q, lit(":0] w"), k, lit(", x"), k, lit(" = a"), k, lit("_"), p, lit("; // note\n  assign w"), k, lit(" = a"), k, lit("_"), p,
        lit(" & ~b"), k, lit(".f"), s, lit(" | 8'hFF;\n"),
    )
    body_f = cat(
        lit("  always @(posedge clk or negedge rst"), s, lit(") begin\n    if (en"), k, lit(" && !stop) r"), k, lit(" <= a + d"), p, lit(";\n  end\n")
    )
    body_o = cat(
        lit("  always_comb begin\n    case (sel"), k, lit(")\n      default: m"), k, lit("["), q, lit("] = d"), p, lit(";\n    endcase\n  end\n")
    )
    body_r = cat(
        lit("  /* unit "), k, lit("\n  */ \n  s_"), s, lit(" #(.W("), q, lit(")) u"), k, lit(" (.a(t"), k, lit("[1]), .b({x, y(z"), k, lit(")}), .c);\n")
    )
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    port = F.when(flag == "A", port_a).when(flag == "N", cat(lit("  output reg r"), k)).otherwise(cat(lit("  inout t"), k))
    body = F.when(flag == "A", body_a).when((flag == "N") & (status == "F"), body_f).when(flag == "N", body_o).otherwise(body_r)
    return domain.items(spark, sf).select(
        "l_orderkey", F.floor((k - 1) / CHUNK).alias("chunk"), k.alias("k"), port.alias("port"), body.alias("body")
    )


def corpus(spark, sf):
    rows = parts(spark, sf).groupBy("l_orderkey", "chunk").agg(F.array_sort(F.collect_list(F.struct("k", "port", "body"))).alias("xs"))
    orders = table(spark, sf, "orders")
    rows = rows.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    name = F.concat(F.lit("o_"), "l_orderkey", F.lit("_"), "chunk")
    text = F.concat(
        F.lit("// file "), "o_orderkey", F.lit(" "), "o_orderpriority", F.lit("\n/* customer "), "o_custkey", F.lit("\n   module fake; endmodule */\nmodule "), name,
        F.lit(" (\n"), F.array_join(F.concat(F.array(F.lit("  input clk")), F.transform("xs", lambda x: x["port"])), ",\n"), F.lit("\n);\n"),
        F.array_join(F.transform("xs", lambda x: x["body"]), ""), F.lit("endmodule\n"),
        F.when(F.col("o_orderkey") % 2 == 1, "module broken (\n/* open").otherwise(F.lit("")),
    )
    return rows.select(
        F.concat(F.lit("g"), F.col("l_orderkey") % 10).alias("graph_id"), F.concat(F.lit("d"), F.col("l_orderkey") % 7, F.lit("/"), name, F.lit(".sv")).alias("file"), text.alias("text")
    )


CORPUS_SQL = f"""
items AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k, CAST(l_quantity AS INT) AS q FROM lineitem),
placed AS (
  SELECT i.*, (k - 1) // {CHUNK} AS chunk, 'o_' || l_orderkey || '_' || ((k - 1) // {CHUNK}) AS module, 'd' || (l_orderkey % 7) || '/o_' || l_orderkey || '_' || ((k - 1) // {CHUNK}) || '.sv' AS file,
    'g' || (l_orderkey % 10) AS graph_id, CASE WHEN l_returnflag = 'A' THEN 2 WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 3 WHEN l_returnflag = 'N' THEN 5 ELSE 3 END AS height,
    CASE WHEN l_returnflag = 'N' THEN k END AS bk FROM items i JOIN orders ON o_orderkey = l_orderkey),
c AS MATERIALIZED (
  SELECT *, count(*) OVER w AS n, row_number() OVER o AS i, 7 + count(*) OVER w + coalesce(sum(height) OVER (PARTITION BY l_orderkey, chunk ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line,
    sum(height) OVER w AS total, last_value(bk IGNORE NULLS) OVER (PARTITION BY l_orderkey, chunk ORDER BY k ROWS UNBOUNDED PRECEDING) AS block,
    last_value(CASE WHEN l_returnflag = 'N' THEN l_linestatus END IGNORE NULLS) OVER (PARTITION BY l_orderkey, chunk ORDER BY k ROWS UNBOUNDED PRECEDING) AS btype
  FROM placed WINDOW w AS (PARTITION BY l_orderkey, chunk), o AS (PARTITION BY l_orderkey, chunk ORDER BY k)),
stmts AS MATERIALIZED (
  SELECT graph_id, file, module, k, CAST(line + 1 AS BIGINT) AS line, 'continuous_assign' AS kind, NULL AS op, 'w' || k AS lhs, 'a' || k || '_' || l_partkey || ' & ~b' || k || '.f' || l_suppkey || ' | 8''hFF' AS rhs, NULL AS cond, NULL AS sel, 1 AS form, l_partkey, l_suppkey FROM c WHERE l_returnflag = 'A'
  UNION ALL SELECT graph_id, file, module, k, line + 1, 'state_update', '<=', 'r' || k, 'a + d' || l_partkey, 'en' || k || ' && !stop', NULL, 2, l_partkey, l_suppkey FROM c WHERE l_returnflag = 'N' AND l_linestatus = 'F'
  UNION ALL SELECT graph_id, file, module, k, line + 2, 'procedural_assign', '=', 'm' || k || '[' || q || ']', 'd' || l_partkey, NULL, 'sel' || k, 3, l_partkey, l_suppkey FROM c WHERE l_returnflag = 'N' AND l_linestatus = 'O'
  UNION ALL SELECT graph_id, file, module, k, line + f, CASE WHEN btype = 'F' THEN 'state_update' ELSE 'procedural_assign' END, '=', CASE f WHEN 0 THEN 'x' ELSE 'w' END || k,
    'a' || k || '_' || l_partkey || CASE f WHEN 1 THEN ' & ~b' || k || '.f' || l_suppkey || ' | 8''hFF' ELSE '' END, CASE WHEN btype = 'F' THEN 'en' || block || ' && !stop' END, CASE WHEN btype = 'O' THEN 'sel' || block END, 4 + f, l_partkey, l_suppkey
  FROM c CROSS JOIN (VALUES (0), (1)) v(f) WHERE l_returnflag = 'A' AND block IS NOT NULL)
"""


def modules(spark, sf):
    return extract.number_modules(extract.module_spans(corpus(spark, sf)))


# ------------------------------------------------------------ lines and offsets


@query(
    "b01_line_explode",
    """SELECT doc_id, pos AS line_no, line FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM (
  SELECT doc_id, string_split(regexp_replace(text, chr(10) || '$', ''), chr(10)) AS l FROM documents WHERE text <> ''))""",
)
def b01(spark, sf):
    return context.source_lines(table(spark, sf, "documents").select("doc_id", "text"), ["doc_id"], "text")


@query(
    "b02_offset_to_line",
    "SELECT doc_id, CAST(n_chars * 2 // 3 AS BIGINT) AS at, CAST(len(string_split(substr(text, 1, n_chars * 2 // 3), chr(10))) AS BIGINT) AS line FROM documents",
)
def b02(spark, sf):
    at = F.floor(F.col("n_chars") * 2 / 3)
    return table(spark, sf, "documents").select("doc_id", at.alias("at"), tx.line_of_offset(F.col("text"), at.cast("int")).alias("line"))


@query(
    "b03_comment_mask",
    f"""WITH {CORPUS_SQL}, m AS (SELECT file, min(l_orderkey) AS ok, min(module) AS module,
  string_agg(',' || chr(10) || CASE l_returnflag WHEN 'A' THEN '  input [' || q || ':0] a' || k || '_' || l_partkey || ', b' || k WHEN 'N' THEN '  output reg r' || k ELSE '  inout t' || k END, '' ORDER BY k) AS ports,
  string_agg(CASE WHEN l_returnflag = 'A' THEN '  wire [' || q || ':0] w' || k || ', x' || k || ' = a' || k || '_' || l_partkey || ';        ' || chr(10) || '  assign w' || k || ' = a' || k || '_' || l_partkey || ' & ~b' || k || '.f' || l_suppkey || ' | 8''hFF;' || chr(10)
    WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN '  always @(posedge clk or negedge rst' || l_suppkey || ') begin' || chr(10) || '    if (en' || k || ' && !stop) r' || k || ' <= a + d' || l_partkey || ';' || chr(10) || '  end' || chr(10)
    WHEN l_returnflag = 'N' THEN '  always_comb begin' || chr(10) || '    case (sel' || k || ')' || chr(10) || '      default: m' || k || '[' || q || '] = d' || l_partkey || ';' || chr(10) || '    endcase' || chr(10) || '  end' || chr(10)
    ELSE '  ' || repeat(' ', length('/* unit ' || k)) || chr(10) || '     ' || chr(10) || '  s_' || l_suppkey || ' #(.W(' || q || ')) u' || k || ' (.a(t' || k || '[1]), .b({{x, y(z' || k || ')}}), .c);' || chr(10) END, '' ORDER BY k) AS body FROM c GROUP BY file)
SELECT file, md5(repeat(' ', length('// file ' || o_orderkey || ' ' || o_orderpriority)) || chr(10) || repeat(' ', length('/* customer ' || o_custkey)) || chr(10) || repeat(' ', 28) || chr(10) || 'module ' || module || ' (' || chr(10)
  || '  input clk' || ports || chr(10) || ');' || chr(10) || body || 'endmodule' || chr(10) || CASE WHEN ok % 2 = 1 THEN 'module broken (' || chr(10) || '       ' ELSE '' END) AS masked FROM m JOIN orders ON o_orderkey = ok""",
)
def b03(spark, sf):
    return corpus(spark, sf).select("file", F.md5(tx.mask_comments(F.col("text"))).alias("masked"))


@query(
    "b04_module_spans",
    f"""WITH {CORPUS_SQL} SELECT DISTINCT graph_id, file, module AS name, 4 AS line_start, CAST(7 + n + total AS BIGINT) AS line_end, CAST(6 + n AS BIGINT) AS body_line FROM c""",
)
def b04(spark, sf):
    return extract.module_spans(corpus(spark, sf)).select("graph_id", "file", "name", "line_start", "line_end", "body_line")


PORT_SQL = """
port_texts AS (SELECT file, chr(10) || '  input clk' || string_agg(',' || chr(10) || CASE l_returnflag WHEN 'A' THEN '  input [' || q || ':0] a' || k || '_' || l_partkey || ', b' || k WHEN 'N' THEN '  output reg r' || k ELSE '  inout t' || k END, '' ORDER BY k) || chr(10) AS ports FROM c GROUP BY file),
port_decls AS (
  SELECT graph_id, file, module, 'clk' AS name, CAST(4 AS BIGINT) AS line, 'input clk' AS decl, 'input' AS direction, NULL AS base, 0 AS no FROM (SELECT DISTINCT graph_id, file, module FROM c)
  UNION ALL SELECT graph_id, file, module, 'a' || k || '_' || l_partkey, 4 + i, 'input [' || q || ':0] a' || k || '_' || l_partkey, 'input', NULL, k * 2 FROM c WHERE l_returnflag = 'A'
  UNION ALL SELECT graph_id, file, module, 'b' || k, 5 + i, 'input b' || k, 'input', NULL, k * 2 + 1 FROM c WHERE l_returnflag = 'A'
  UNION ALL SELECT graph_id, file, module, 'r' || k, 4 + i, 'output reg r' || k, 'output', 'reg', k * 2 FROM c WHERE l_returnflag = 'N'
  UNION ALL SELECT graph_id, file, module, 't' || k, 4 + i, 'inout t' || k, 'inout', NULL, k * 2 FROM c WHERE l_returnflag = 'R')
"""


@query("b05_balanced_capture", f"WITH {CORPUS_SQL}, {PORT_SQL} SELECT file, ports FROM port_texts")
def b05(spark, sf):
    return modules(spark, sf).select("file", tx.between_first_parens(F.col("header_text")).alias("ports"))


@query(
    "b06_top_level_split",
    f"""WITH {CORPUS_SQL} SELECT file, part, no FROM (
  SELECT file, chr(10) || '  input clk' AS part, 0 AS no FROM (SELECT DISTINCT file FROM c)
  UNION ALL SELECT file, x, CAST(row_number() OVER (PARTITION BY file ORDER BY k, s) AS BIGINT) FROM (
    SELECT file, k, 0 AS s, chr(10) || CASE l_returnflag WHEN 'A' THEN '  input [' || q || ':0,1] f(a' || k || ', ' || l_partkey || ')' WHEN 'N' THEN '  output reg r' || k ELSE '  inout t' || k END AS x FROM c
    UNION ALL SELECT file, k, 1, ' b' || k FROM c WHERE l_returnflag = 'A'))""",
)
def b06(spark, sf):
    # Ranges and calls with commas inside brackets must stay whole.
    nested = F.regexp_replace(F.regexp_replace("inside", r":0\] a(\d+)_(\d+)", r":0,1] f(a$1, $2)"), r"\n\z", "")
    rows = modules(spark, sf).select("file", tx.between_first_parens(F.col("header_text")).alias("inside"))
    return brackets.split_top_level(rows.select("file", nested.alias("nested")), ["file"], "nested").select("file", "no", "part")


@query(
    "b07_port_direction_fill",
    f"""WITH {CORPUS_SQL}, {PORT_SQL} SELECT 'port' AS what, file, decl, line, NULL AS event_id, NULL AS filled FROM port_decls
UNION ALL SELECT 'event', 'u' || user_id, NULL, NULL, event_id, last_value(CASE WHEN event_type IN ('click', 'error') THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) FROM events""",
)
def b07(spark, sf):
    ports = extract.header_ports(modules(spark, sf)).select(
        F.lit("port").alias("what"), "file", tx.strip(F.col("decl")).alias("decl"), "line", F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("string").alias("filled")
    )
    kind = F.when(F.col("event_type").isin("click", "error"), F.col("event_type"))
    events = table(spark, sf, "events").withColumn("kind", kind)
    order = [F.col("ts"), F.col("event_id")]
    filled = ordered_scan(events, ["user_id"], order, {"filled": last_value(F.col("kind"))})
    rows = filled.select(F.lit("event").alias("what"), F.concat(F.lit("u"), "user_id").alias("file"), "event_id", "filled")
    return ports.unionByName(rows, allowMissingColumns=True)


@query(
    "b08_decl_names",
    f"""WITH {CORPUS_SQL} SELECT file, k, CASE l_returnflag WHEN 'A' THEN 'w' || k || ',x' || k WHEN 'N' THEN 'r' || k ELSE 't' || k END AS names FROM c""",
)
def b08(spark, sf):
    line = F.split_part("body", F.lit("\n"), F.lit(1))
    rows = parts(spark, sf).withColumn("decl", F.when(F.startswith("body", F.lit("  wire")), line).otherwise(F.col("port")))
    file = F.concat(F.lit("d"), F.col("l_orderkey") % 7, F.lit("/o_"), "l_orderkey", F.lit("_"), "chunk", F.lit(".sv"))
    return rows.select(file.alias("file"), "k", F.array_join(tx.declared_names(F.col("decl")), ",").alias("names"))


SIGNAL_SQL = f"""
decls AS (SELECT graph_id, module, name, line, decl AS decl_raw, direction, base AS decl_type, 'port' AS kind FROM port_decls
  UNION ALL SELECT graph_id, module, v || k, CASE WHEN i = 1 THEN line - 1 ELSE line END, 'wire [' || q || ':0] w' || k || ', x' || k || ' = a' || k || '_' || l_partkey || ';', NULL, 'wire', 'internal' FROM c CROSS JOIN (VALUES ('w'), ('x')) t(v) WHERE l_returnflag = 'A')
"""


@query("b09_decl_signals", f"WITH {CORPUS_SQL}, {PORT_SQL}, {SIGNAL_SQL} SELECT graph_id, module, name, line AS line_start, decl_raw, direction, decl_type, kind FROM decls")
def b09(spark, sf):
    return extract.declared_signals(modules(spark, sf)).select("graph_id", "module", "name", "line_start", "decl_raw", "direction", "decl_type", "kind")


@query(
    "b10_instances",
    f"""WITH {CORPUS_SQL} SELECT graph_id, module AS parent, 'u' || k AS name, 's_' || l_suppkey AS module_type, CAST(CASE WHEN i = 1 THEN line - 1 ELSE line END AS BIGINT) AS line_start, '#(.W(' || q || '))' AS parameter_text FROM c WHERE l_returnflag = 'R'""",
)
def b10(spark, sf):
    return extract.instances(modules(spark, sf)).select("graph_id", "parent", "name", "module_type", "line_start", "parameter_text")


@query(
    "b11_port_bindings",
    f"""WITH {CORPUS_SQL} SELECT graph_id, module AS parent, 'u' || k AS inst, v.no AS binding_no, v.formal, CASE v.no WHEN 0 THEN 't' || k || '[1]' WHEN 1 THEN '{{x, y(z' || k || ')}}' ELSE 'c' END AS actual_expr,
  CASE v.no WHEN 0 THEN 't' || k WHEN 1 THEN 'x' ELSE 'c' END AS actual_base FROM c CROSS JOIN (VALUES (0, 'a'), (1, 'b'), (2, 'c')) v(no, formal) WHERE l_returnflag = 'R'""",
)
def b11(spark, sf):
    found = persist_table(extract.instances(modules(spark, sf)), "instances")
    names = found.select("graph_id", "parent", F.col("name").alias("inst"), F.col("ord").alias("inst_ord"))
    return extract.bindings(found).join(names, ["graph_id", "inst_ord"]).drop("inst_ord")


@query(
    "b12_assign_statements",
    f"WITH {CORPUS_SQL} SELECT graph_id, module, line, lhs AS lhs_raw, rhs AS rhs_raw FROM stmts WHERE form = 1",
)
def b12(spark, sf):
    return extract.continuous_assigns(modules(spark, sf)).select("graph_id", "module", "line", "lhs_raw", "rhs_raw")


@query(
    "b13_block_segmentation",
    f"""WITH {CORPUS_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY k) - 1 AS block_no, lead(line) OVER (PARTITION BY file ORDER BY k) AS nl FROM c WHERE l_returnflag = 'N')
SELECT graph_id, module, block_no, CAST(line AS BIGINT) AS block_line, CASE l_linestatus WHEN 'F' THEN 'always @(posedge clk or negedge rst' || l_suppkey || ')' ELSE 'always_comb ' END AS header, CAST(coalesce(nl, 7 + n + total) - line AS BIGINT) AS block_height FROM b""",
)
def b13(spark, sf):
    return extract.always_blocks(modules(spark, sf)).select(
        "graph_id", "module", "block_no", "block_line", "header", tx.line_breaks(F.col("block_text")).cast("long").alias("block_height")
    )


@query(
    "b14_block_statements",
    f"WITH {CORPUS_SQL} SELECT graph_id, module, line, kind, op AS assignment_op, lhs AS lhs_raw, rhs AS rhs_raw FROM stmts WHERE form > 1",
)
def b14(spark, sf):
    rows = extract.block_statements(extract.always_blocks(modules(spark, sf)))
    return rows.select("graph_id", "module", "line", "kind", "assignment_op", "lhs_raw", "rhs_raw")


@query(
    "b15_block_conditions",
    f"WITH {CORPUS_SQL} SELECT graph_id, module, line, lhs AS lhs_raw, coalesce(cond, '') AS conditions, coalesce(sel, '') AS case_selectors FROM stmts WHERE form > 1",
)
def b15(spark, sf):
    rows = extract.block_statements(extract.always_blocks(modules(spark, sf)))
    return rows.select(
        "graph_id", "module", "line", "lhs_raw", F.array_join("conditions", "|").alias("conditions"), F.array_join("case_selectors", "|").alias("case_selectors")
    )


@query(
    "b16_identifier_refs",
    f"""WITH {CORPUS_SQL}, r AS (
  SELECT graph_id, module, line, kind, 'lhs' AS role, split_part(lhs, '[', 1) AS base, split_part(lhs, '[', 1) AS raw, '' AS sel FROM stmts
  UNION ALL SELECT graph_id, module, line, kind, 'rhs', 'a' || k || '_' || l_partkey, 'a' || k || '_' || l_partkey, '' FROM stmts WHERE form IN (1, 4, 5)
  UNION ALL SELECT graph_id, module, line, kind, 'rhs', 'b' || k, 'b' || k || '.f' || l_suppkey, '.f' || l_suppkey FROM stmts WHERE form IN (1, 5)
  UNION ALL SELECT graph_id, module, line, kind, 'rhs', 'a', 'a', '' FROM stmts WHERE form = 2
  UNION ALL SELECT graph_id, module, line, kind, 'rhs', 'd' || l_partkey, 'd' || l_partkey, '' FROM stmts WHERE form IN (2, 3)
  UNION ALL SELECT graph_id, module, line, kind, 'condition', split_part(cond, ' ', 1), split_part(cond, ' ', 1), '' FROM stmts WHERE cond IS NOT NULL
  UNION ALL SELECT graph_id, module, line, kind, 'condition', 'stop', 'stop', '' FROM stmts WHERE cond IS NOT NULL
  UNION ALL SELECT graph_id, module, line, kind, 'case_selector', sel, sel, '' FROM stmts WHERE sel IS NOT NULL)
SELECT graph_id, module, line, kind, role, base, raw, sel AS selectors FROM r""",
)
def b16(spark, sf):
    refs = extract.statement_refs(extract.statements(modules(spark, sf)))
    return refs.select("graph_id", "module", "line", "kind", "role", "base", "raw", F.array_join("selectors", "").alias("selectors"))
