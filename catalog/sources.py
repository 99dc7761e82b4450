"""Source and sink queries (a01 to a16); files go to the shared folder."""

from __future__ import annotations

import json

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import functions as F

from catalog import domain
from catalog.registry import query, table
from evigraph.operators import cost
from evigraph.session import persist_table, work_path
from evigraph.sources import files, runs, tables



@query(
    "a01_source_scan",
    """SELECT source AS scope, CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(length(text) - length(replace(text, chr(10), '')) + 1) AS BIGINT) AS n_lines, CAST(sum(length(replace(text, chr(10), ''))) AS BIGINT) AS n_chars
FROM documents GROUP BY 1""",
)
def a01(spark, sf):
    root = work_path(spark, "tree")
    docs = table(spark, sf, "documents")
    body = F.concat(F.lit("//#"), "doc_id", F.lit("#"), "text")
    docs.select("source", body.alias("value")).write.option("maxRecordsPerFile", 200).partitionBy("source").text(root)
    rows = files.scan_sources(spark, root, "*.txt")
    docs_in = F.size(F.regexp_extract_all("text", F.lit("(?m)^//#[0-9]+#"), F.lit(0)))
    bare = F.regexp_replace("text", "(?m)^//#[0-9]+#", "")
    return rows.groupBy(F.regexp_extract("relative_path", "source=([^/]+)/", 1).alias("scope")).agg(
        F.sum(docs_in).cast("long").alias("n_docs"),
        F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).cast("long").alias("n_lines"),
        F.sum(F.length(F.replace(bare, F.lit("\n"), F.lit("")))).cast("long").alias("n_chars"),
    )


@query(
    "a02_scope_discovery",
    """SELECT DISTINCT lang AS benchmark, source AS scope, lang || '__' || source AS scope_id FROM documents WHERE doc_id % 3 <> 0 AND (source IN ('src1', 'src2') OR lang || '__' || source IN ('en__src3', 'de__src4'))""",
)
def a02(spark, sf):
    suffix = F.when(F.col("doc_id") % 3 == 0, ".txt").when(F.col("doc_id") % 3 == 1, ".SV").otherwise(F.lit(".vh"))
    paths = table(spark, sf, "documents").select(F.concat_ws("/", "lang", "source", F.concat(F.lit("rtl/d"), "doc_id", suffix)).alias("path"))
    return files.discover_scopes(paths, "path", ["src1", "src2", "en__src3", "de__src4"])


COLUMNS = ["doc_id", "lang", "note", "text"]
CSV_SQL = "SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'a \"quoted\", cell' END AS note, md5(text) AS digest FROM documents"


def _csv(spark, sf):
    path = work_path(spark, "csv")
    note = F.when(F.col("doc_id") % 2 == 1, F.lit('a "quoted", cell'))
    tables.write_csv(table(spark, sf, "documents").withColumn("note", note), path, COLUMNS)
    return path


@query("a03_csv_scan", CSV_SQL)
def a03(spark, sf):
    rows = tables.read_csv(spark, _csv(spark, sf), ["note", "doc_id", "text", "lang"])
    return rows.select("doc_id", "lang", "note", F.md5("text").alias("digest"))


@query("a04_csv_sink", "SELECT CAST(count(*) AS BIGINT) AS n_rows, 'doc_id,lang,note,text' AS header FROM documents")
def a04(spark, sf):
    path = _csv(spark, sf)
    header = spark.read.text(path).filter("value LIKE 'doc_id,lang%'").select(F.col("value").alias("header")).distinct()
    return header.withColumn("n_rows", tables.read_csv(spark, path, COLUMNS).agg(F.count(F.lit(1))).scalar()).select("n_rows", "header")


@query("a05_json_scan", "SELECT conv_id, turn, role, md5(text) AS digest FROM conversations")
def a05(spark, sf):
    path = work_path(spark, "json")
    item = F.struct("turn", "role", "text")
    table(spark, sf, "conversations").select("conv_id", F.struct(F.array(item).alias("turns")).alias("doc")).write.json(path)
    rows = tables.read_json(spark, path, "conv_id bigint, doc struct<turns:array<struct<turn:bigint,role:string,text:string>>>", False)
    return rows.select("conv_id", F.explode("doc.turns").alias("t")).select("conv_id", "t.turn", "t.role", F.md5("t.text").alias("digest"))


def _lines(spark, sf, damaged):
    path = work_path(spark, "jsonl")
    eid = F.col("event_id")
    line = F.concat(F.lit('{"event_id": '), eid, F.lit(', "props": '), "props", F.lit("}"))
    if damaged:
        line = F.when(eid % 7 == 0, F.concat(line, F.lit(" x"))).when(eid % 11 == 0, F.lit("[1, 2]")).when(eid % 13 == 0, F.lit("{bad")).otherwise(line)
    line = F.when(eid % 17 == 0, F.concat(line, F.lit("\n"))).otherwise(line)
    table(spark, sf, "events").select(line.alias("value")).write.text(path)
    return path


PROPS = "event_id bigint, props struct<k:bigint>"


@query("a06_jsonl_scan_strict", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def a06(spark, sf):
    return tables.read_jsonl(spark, _lines(spark, sf, False), PROPS).select("event_id", "props.k")


@query(
    "a07_jsonl_scan_tolerant",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 7 <> 0 AND event_id % 11 <> 0 AND event_id % 13 <> 0",
)
def a07(spark, sf):
    return tables.read_jsonl_tolerant(spark, _lines(spark, sf, True), PROPS).select("event_id", "props.k")


@query("a08_jsonl_append", "SELECT event_type, count(*) AS n, count(*) FILTER (value < 10) AS small FROM events GROUP BY 1")
def a08(spark, sf):
    path = work_path(spark, "append")
    events = table(spark, sf, "events").select("event_id", "event_type", "value")
    tables.append_jsonl(events.filter("value < 10"), path)
    tables.append_jsonl(events.filter("value >= 10"), path)
    rows = tables.read_jsonl(spark, path, "event_id bigint, event_type string, value double")
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") < 10).alias("small"))


@query(
    "a09_nested_json_sink",
    """SELECT 's' || (l_orderkey % 5) AS scope_id, l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS BIGINT) AS item_no, l_partkey, l_quantity FROM lineitem""",
)
def a09(spark, sf):
    path = work_path(spark, "nested")
    rows = domain.items(spark, sf).withColumn("scope_id", F.concat(F.lit("s"), F.col("l_orderkey") % 5))
    tables.write_nested(tables.nested_documents(rows, ["scope_id", "l_orderkey"], "item_no", ["l_partkey", "l_quantity"]), path, "scope_id")
    schema = "l_orderkey bigint, part_no bigint, items array<struct<item_no:bigint,l_partkey:bigint,l_quantity:double>>, scope_id string"
    docs = spark.read.schema(schema).json(path)
    return docs.select("scope_id", "l_orderkey", F.explode("items").alias("i")).select("scope_id", "l_orderkey", "i.*")


def _write_answers(root, batches):
    """Run folders as a pipeline leaves them: an indented answer, and other JSON files beside it."""
    for batch in batches:
        for conv_id, turn, role, text in batch.itertuples(index=False):
            store, folder = pafs.FileSystem.from_uri(f"{root}/models/{role}/c{conv_id}/rep_{turn}")
            store.create_dir(folder, recursive=True)
            answer = {"conv_id": conv_id, "findings": [{"summary": line} for line in text.split("\n")]}
            for name, content in (("final_answer.json", answer), ("run_metadata.json", {"conv_id": -1, "findings": None})):
                with store.open_output_stream(f"{folder}/{name}") as out:
                    out.write(json.dumps(content, indent=2).encode())
        yield pd.DataFrame({"n": [len(batch)]})


@query(
    "a10_run_output_scan",
    """SELECT conv_id, role AS model_family, 'c' || conv_id AS input_scope, CAST(turn AS VARCHAR) AS repetition, len(string_split(text, chr(10))) AS n_findings FROM conversations WHERE role = 'assistant'""",
)
def a10(spark, sf):
    root = work_path(spark, "runs")
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").repartition(8)
    rows.mapInPandas(lambda batches: _write_answers(root, batches), "n long").write.format("noop").mode("append").save()
    rows = files.scan_run_outputs(spark, root, "conv_id bigint, findings array<struct<summary:string>>", "assistant")
    return rows.select("conv_id", "model_family", "input_scope", "repetition", F.size("findings").alias("n_findings"))


@query(
    "a11_manifest_load",
    """WITH r AS (SELECT conv_id, turn, role, CASE WHEN conv_id % 4 = 0 THEN '' ELSE 'run' || conv_id END AS rid, 'dir/' || conv_id || '_' || turn AS run_dir, text FROM conversations WHERE turn % 3 <> 2)
SELECT CASE WHEN turn % 2 = 0 THEN 'b' || conv_id ELSE 'own' END AS batch_id, CASE WHEN rid <> '' THEN rid WHEN role = 'user' THEN 'meta' || conv_id ELSE conv_id || '_' || turn END AS run_id, run_dir,
  CASE WHEN role = 'user' THEN 'm' || turn END AS model, CASE WHEN role <> 'system' THEN length(text) END AS answer_chars, CASE WHEN turn = 0 THEN 'tool_trace.jsonl' END AS trace FROM r""",
)
def a11(spark, sf):
    conv = table(spark, sf, "conversations")
    run_dir = F.concat(F.lit("dir/"), "conv_id", F.lit("_"), "turn").alias("run_dir")
    run = F.struct(
        F.when(F.col("turn") % 2 == 1, "own").otherwise(F.lit("")).alias("batch_id"),
        F.when(F.col("conv_id") % 4 == 0, "").otherwise(F.concat(F.lit("run"), "conv_id")).alias("run_id"), run_dir, F.col("role").alias("model_id"),
        F.lit("s").alias("scope_id"), F.lit(1).alias("repetition"), F.when(F.col("turn") % 3 == 2, "failed").otherwise(F.lit("success")).alias("status"),
    )
    manifest = conv.select(F.concat(F.lit("b"), "conv_id").alias("batch_id"), F.array(run).alias("runs"))
    metadata = conv.filter("role = 'user'").select(
        run_dir, F.concat(F.lit("meta"), "conv_id").alias("run_id"), F.lit("p").alias("provider"), F.concat(F.lit("m"), "turn").alias("model")
    )
    answers = conv.filter("role <> 'system'").select(run_dir, F.length("text").alias("answer_chars"))
    traces = conv.filter("turn = 0").select(run_dir, F.lit("tool_trace.jsonl").alias("trace"))
    rows = files.load_runs(files.successful_runs(manifest), metadata, answers, traces)
    return rows.select("batch_id", "run_id", "run_dir", "model", "answer_chars", "trace")


#: Runs that one part of a manifest holds, about.
MANIFEST_RUNS = 100_000


def _write_batch(root, batches):
    """Run folders of a batch; some have no answer or no trace, and the name of the trace differs."""
    for batch in batches:
        for conv_id, turn, role, text in batch.itertuples(index=False):
            store, folder = pafs.FileSystem.from_uri(f"{root}/runs/c{conv_id}/rep_{turn}")
            store.create_dir(folder, recursive=True)
            found = {"run_metadata.json": json.dumps({"run_id": f"meta{conv_id}_{turn}", "provider": "p", "model": role}, indent=1)}
            if turn % 3:
                found["final_answer.json"] = json.dumps({"text": text})
            if turn % 2 == 0:
                found["tool_observations.jsonl" if conv_id % 2 else "tool_trace.jsonl"] = "".join(json.dumps({"step": i, "size": len(x)}) + "\n" for i, x in enumerate(text.split("\n")))
            for name, content in found.items():
                with store.open_output_stream(f"{folder}/{name}") as out:
                    out.write(content.encode())
        yield pd.DataFrame({"n": [len(batch)]})


@query(
    "a11_run_folders",
    """WITH r AS (SELECT *, 'c' || conv_id AS c, string_split(text, chr(10)) AS xs FROM conversations WHERE conv_id % 5 <> 0)
SELECT 'batch' AS batch_id, CASE WHEN conv_id % 3 = 0 THEN 'run' || conv_id || '_' || turn ELSE 'meta' || conv_id || '_' || turn END AS run_id, role AS model, c AS input_scope, CAST(turn AS INT) AS repetition,
  CASE WHEN turn % 3 <> 0 THEN length(text) END AS answer_chars, CASE WHEN turn % 2 <> 0 OR conv_id % 2 = 0 THEN 'tool_trace.jsonl' ELSE 'tool_observations.jsonl' END AS trace, turn % 2 = 0 AS trace_exists,
  CASE WHEN turn % 2 = 0 THEN len(xs) ELSE 0 END AS steps, CASE WHEN turn % 2 = 0 THEN CAST(list_sum([length(x) FOR x IN xs]) AS BIGINT) ELSE 0 END AS traced_chars FROM r""",
)
def a11_folders(spark, sf):
    root = work_path(spark, "batch")
    conv = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    conv.repartition(8).mapInPandas(lambda batches: _write_batch(root, batches), "n long").write.format("noop").mode("append").save()
    run = F.struct(
        F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("run"), "conv_id", F.lit("_"), "turn")).alias("run_id"), F.concat(F.lit(f"{root}/runs/c"), "conv_id", F.lit("/rep_"), "turn").alias("run_dir"),
        F.when(F.col("conv_id") % 5 == 0, "failed").otherwise(F.lit("success")).alias("status"), F.concat(F.lit("c"), "conv_id").alias("scope_id"), F.col("turn").alias("repetition"),
    )
    # a manifest of parts, one file each, so that no task holds all runs
    part = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(conv.count() // MANIFEST_RUNS + 1))
    manifest = conv.groupBy(part.alias("_part")).agg(F.lit("batch").alias("batch_id"), F.collect_list(run).alias("runs")).drop("_part")
    manifest.write.option("maxRecordsPerFile", 1).json(f"{root}/{runs.MANIFEST}")
    loaded = persist_table(runs.load_batch(spark, root), "loaded-runs")
    traced = runs.trace_rows(spark, root, loaded, "step int, size long").groupBy("run_id").agg(F.count(F.lit(1)).alias("steps"), F.sum("size").alias("traced_chars"))
    rows = loaded.join(traced.hint("merge"), "run_id", "left").fillna(0, ["steps", "traced_chars"])
    trace = F.regexp_extract("trace_path", "([^/]*)$", 1).alias("trace")
    answer = F.length(F.get_json_object("final_answer", "$.text")).alias("answer_chars")
    return rows.select("batch_id", "run_id", "model", "input_scope", "repetition", answer, trace, "trace_exists", "steps", "traced_chars")


@query(
    "a12_trace_resolution",
    """WITH f AS (SELECT user_id, min(CASE WHEN event_type = 'click' AND user_id % 4 = 0 THEN 1 WHEN event_type = 'view' AND user_id % 4 < 3 THEN 2 END) AS p FROM events GROUP BY 1)
SELECT 'run' || u.user_id AS run_dir, 'run' || u.user_id || CASE WHEN p = 2 THEN '/tool_observations.jsonl' ELSE '/tool_trace.jsonl' END AS trace_path, p IS NOT NULL AS trace_exists FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN f USING (user_id)""",
)
def a12(spark, sf):
    events = table(spark, sf, "events")
    run_dir = F.concat(F.lit("run"), "user_id").alias("run_dir")
    kind, user = F.col("event_type"), F.col("user_id") % 4
    name = F.when((kind == "click") & (user == 0), files.TRACE_FILES[0]).when((kind == "view") & (user < 3), files.TRACE_FILES[1]).otherwise(F.lit("final_answer.json"))
    found = events.select(run_dir, name.alias("file_name"))
    return files.resolve_traces(events.select(run_dir).distinct(), found)


@query(
    "a13_dynamic_union",
    """SELECT CAST(c_custkey AS VARCHAR) AS key, c_name AS name, c_mktsegment AS segment, '' AS nation FROM customer
UNION ALL SELECT CAST(s_suppkey AS VARCHAR), s_name, '', CAST(s_nationkey AS VARCHAR) FROM supplier""",
)
def a13(spark, sf):
    left = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    right = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    return tables.dynamic_union([left, right])


@query(
    "a14_strict_merge",
    """WITH r AS (SELECT o_orderstatus AS source, 'r' || o_custkey AS run_id, 'f' || (o_orderkey % 97) AS finding_id, CASE WHEN o_orderkey % 501 = 0 THEN '' WHEN o_orderstatus = 'F' THEN 'sF' ELSE 's' || o_orderkey % 2 END AS input_scope,
  CASE WHEN o_orderkey % 3 = 0 THEN 'FP' ELSE 'TP' END AS detection_match, CASE WHEN o_orderkey % 50 = 0 OR o_orderkey % 3 <> 0 THEN 'C1' ELSE '' END AS matched_case_id FROM orders)
SELECT 'X' AS source, 'unexpected_columns' AS problem, 'run_id,finding_id' AS detail
UNION ALL SELECT source, 'several_scopes', min(nullif(input_scope, '')) || ',' || max(input_scope) FROM r GROUP BY source HAVING count(DISTINCT nullif(input_scope, '')) > 1
UNION ALL SELECT source, 'missing_scope', run_id || '|' || finding_id FROM r WHERE input_scope = ''
UNION ALL SELECT max(source), 'duplicate_key', run_id || '|' || finding_id FROM r GROUP BY run_id, finding_id HAVING count(*) > 1
UNION ALL SELECT source, 'fp_keeps_case', run_id || '|' || finding_id FROM r WHERE detection_match = 'FP' AND matched_case_id <> ''""",
)
def a14(spark, sf):
    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    expected = ["run_id", "finding_id", "input_scope", "detection_match", "matched_case_id"]
    rows = table(spark, sf, "orders").select(
        F.concat(F.lit("r"), "o_custkey").alias("run_id"), F.concat(F.lit("f"), k % 97).alias("finding_id"),
        F.when(k % 501 == 0, "").when(status == "F", "sF").otherwise(F.concat(F.lit("s"), k % 2)).alias("input_scope"),
        F.when(k % 3 == 0, "FP").otherwise(F.lit("TP")).alias("detection_match"), F.when((k % 50 == 0) | (k % 3 != 0), "C1").otherwise(F.lit("")).alias("matched_case_id"), status.alias("s"),
    )
    scopes = {s: rows.filter(F.col("s") == s).drop("s") for s in ("F", "O", "P")}
    scopes["X"] = rows.select("run_id", "finding_id")
    return tables.merge_violations(scopes, expected, ["run_id", "finding_id"], True)


@query(
    "a15_price_table",
    """SELECT p_brand || '/' || p_type AS model, CASE WHEN p_type = 'PROMO' THEN 0.0 ELSE CAST(min(p_size) AS DOUBLE) END AS input_per_million, CAST(max(p_size) AS DOUBLE) AS output_per_million FROM part GROUP BY p_brand, p_type""",
)
def a15(spark, sf):
    prices = table(spark, sf, "part").groupBy("p_brand", "p_type").agg(F.min("p_size").alias("a"), F.max("p_size").alias("b"))
    price = F.struct(
        F.when(F.col("p_type") == "PROMO", "n/a").otherwise(F.col("a").cast("string")).alias("input_per_million"), F.col("b").alias("output_per_million")
    )
    payload = prices.select(F.to_json(F.create_map(F.concat_ws("/", "p_brand", "p_type"), price)).alias("payload"))
    return cost.price_table(payload, "payload")


@query(
    "a16_evidence_index",
    "SELECT 'case' || user_id AS case_id, arg_max(event_id, struct_pack(f := event_type, l := event_id)) AS event_id, count(*) > 0 AS known FROM events GROUP BY user_id",
)
def a16(spark, sf):
    """Evidence files in order: the names follow event_type, lines within a type event_id."""
    path = work_path(spark, "evidence")
    line = F.to_json(F.struct(F.concat(F.lit("case"), "user_id").alias("case_id"), "event_id"))
    rows = table(spark, sf, "events").repartitionByRange("event_type", "event_id").sortWithinPartitions("event_type", "event_id")
    rows.select(line.alias("value"), "event_type").write.partitionBy("event_type").text(path)
    found = tables.read_jsonl_ordered(spark, path, "case_id string, event_id bigint").withColumn("known", F.lit(True))
    return tables.last_per_case(found, F.col("case_id"), F.col("ord")).select("case_id", "event_id", "known")
