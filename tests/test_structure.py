"""Small source trees through extraction, linking, tagging, search and snippets."""

from pyspark.sql import functions as F

from evigraph.functions.text import mask_comments
from evigraph.operators import extract
from evigraph.plans import structure

CHILD = """// helper block
module lock_unit(input clk, input rst_n, input lock_req, output reg lock_q);
  always @(posedge clk) begin
    if (lock_req)
      lock_q <= lock_req;
  end
endmodule
"""
PARENT = """module top(input clk, input rst_n, input debug_req, output debug_lock);
  wire held; /* two
  lines */
  lock_unit #(.W(2)) u_lock (
    .clk(clk),
    .lock_req(debug_req),
    .lock_q(held)
  );
  mystery u_other (.a(held));
  assign debug_lock = held & cfg.ready;
  if (debug_req) begin assert property (x) ; end
endmodule
module cut(input a);
"""


def graph(spark):
    rows = [("s", "rtl/lock_unit.sv", CHILD), ("s", "rtl/top.sv", PARENT)]
    sources = spark.createDataFrame(rows, "graph_id string, file string, text string")
    return sources, structure.build_graph(sources)


def test_graph(spark):
    _, built = graph(spark)
    nodes = {r["id"]: r for r in built["nodes"].collect()}
    edges = built["edges"].collect()
    assert {"module:lock_unit", "module:top", "instance:top.u_lock", "instance:top.u_other", "signal:top.held", "signal:top.cfg"} <= set(nodes)
    assert "module:cut" not in nodes
    assert not [i for i in nodes if i.startswith("instance:") and i.split(".")[1] not in ("u_lock", "u_other")]
    assert nodes["instance:top.u_other"]["unresolved"] and nodes["instance:top.u_lock"]["resolved_module"] == "module:lock_unit"
    assert nodes["instance:top.u_lock"]["parameter_text"] == "#(.W(2))"
    assert nodes["signal:lock_unit.lock_q"]["kind"] == "register" and nodes["signal:lock_unit.lock_q"]["direction"] == "output"
    assert nodes["signal:top.cfg"]["kind"] == "implicit" and nodes["signal:top.cfg"]["decl_raw"] is None
    link = {(e["from_id"], e["to_id"]): e for e in edges if e["type"] == "connects"}
    assert link[("signal:top.debug_req", "signal:lock_unit.lock_req")]["direction"] == "parent_to_child"
    assert link[("signal:lock_unit.lock_q", "signal:top.held")]["direction"] == "child_to_parent"
    reads = {(e["to_id"], e["read_role"]) for e in edges if e["type"] == "reads"}
    assert {("signal:lock_unit.lock_req", "rhs"), ("signal:lock_unit.lock_req", "condition"), ("signal:top.cfg", "rhs")} <= reads
    assert [e["edge_no"] for e in sorted(edges, key=lambda e: e["edge_no"])] == list(range(1, len(edges) + 1))
    assert [e["type"] for e in sorted(edges, key=lambda e: e["edge_no"])][:3] == ["connects"] * 3
    assert [r["warning"] for r in built["warnings"].collect()] == ["Unresolved instance top.u_other: mystery"]


def test_targets_chains_and_snippets(spark):
    sources, built = graph(spark)
    nodes, edges = built["nodes"], built["edges"]
    made = structure.build_targets(nodes, edges)
    targets = {r["name"]: r for r in made["targets"].collect()}
    assert "lock_q" in targets and "debug_req" in targets and "clk" not in targets and "rst_n" not in targets
    assert {"register", "state_update_target", "lock_state"} <= set(targets["lock_q"]["point_roles"])
    assert "wrapper_mediation" in targets["debug_req"]["point_roles"]
    chains = structure.build_chains(nodes, edges, made["targets"], made["accesses"])
    by_id = {r["chain_id"]: r for r in chains["chains"].collect()}
    chain = next(c for c, r in by_id.items() if r["name"] == "lock_q")
    found = {r["node_id"] for r in chains["nodes"].filter(F.col("chain_id") == chain).collect()}
    assert {"signal:lock_unit.lock_q", "signal:top.held", "instance:top.u_lock"} <= found
    assert chains["diagnostics"].filter("missing_seed_nodes > 0").count() == 0
    contexts = structure.build_contexts(chains["locations"], sources)
    snippets = contexts["snippets"].filter(F.col("chain_id") == chain).orderBy("snippet_id").collect()
    assert snippets[0]["snippet_id"] == "SNIP-0001" and snippets[0]["file"] == "rtl/lock_unit.sv"
    assert snippets[0]["code"].startswith("1: // helper block\n2: module lock_unit")
    assert contexts["problems"].count() == 0


def test_open_comment_masks_to_end(spark):
    text = "a // b\nc /* d\n e */ f /* g\nh"
    df = spark.createDataFrame([(text,)], "t string").select(mask_comments(F.col("t")).alias("m"))
    assert df.first()["m"] == "a     \nc     \n      f     \n "


def test_same_line_statements_share_a_node_but_keep_edges(spark):
    text = "module m(input a);\n  assign x = a; assign y = a;\nendmodule\n"
    sources = spark.createDataFrame([("s", "m.v", text)], "graph_id string, file string, text string")
    built = structure.build_graph(sources)
    assert built["nodes"].filter("type = 'StmtSummary'").count() == 1
    assert built["edges"].filter("type = 'reads'").count() == 2


def test_module_numbers_follow_path_parts(spark):
    rows = [("s", f, "module m;\nendmodule\n") for f in ("a/b.v", "a-b.v", "a/a.v")]
    sources = spark.createDataFrame(rows, "graph_id string, file string, text string")
    got = {r["file"]: r["module_no"] for r in extract.number_modules(extract.module_spans(sources)).collect()}
    assert got == {"a/a.v": 1, "a/b.v": 2, "a-b.v": 3}
