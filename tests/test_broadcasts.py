"""Joins with tables that grow, though Spark takes them for small, broadcast nothing; their rows are those of plain code."""

from evigraph.operators import graph
from evigraph.sources import runs


def broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin")


SIGNALS = "graph_id string, module string, name string, direction string"


def test_declared_signals_are_not_broadcast(spark):
    signals = spark.createDataFrame([("g", "s1", "p0", "output"), ("g", "s1", "p1", "input")], SIGNALS)
    bound = spark.createDataFrame(
        [("g", "o1", f"u{i}", "s1", f"p{i}", f"w{i}", i) for i in range(3)],
        "graph_id string, parent string, inst string, module_type string, formal string, actual_base string, inst_ord long",
    ).selectExpr("*", "actual_base AS actual_expr", "0 AS binding_no")
    edges = graph.connect_edges(bound, signals)
    assert broadcasts(edges) == 0
    assert sorted((r["from_id"], r["to_id"], r["formal_port_direction"]) for r in edges.collect()) == [
        ("signal:o1.w1", "signal:s1.p1", "input"), ("signal:o1.w2", "signal:s1.p2", "unknown"), ("signal:s1.p0", "signal:o1.w0", "output"),
    ]


def test_first_uses_meet_declared_signals(spark):
    """Uses are reduced before declared names are left out; names that are null or repeated count as before."""
    rows = [("g", "m", "a", 3), ("g", "m", "a", 1), ("g", "m", "b", 2), ("g", None, "a", 5), ("g", None, "a", 4), ("h", "m", "b", 6)]
    uses = spark.createDataFrame(rows, "graph_id string, module string, name string, at long").selectExpr(
        "graph_id", "module", "name", "named_struct('file', concat('f', at), 'line_start', at, 'line_end', at) AS loc", "named_struct('phase', 0, 'o1', at) AS ord"
    )
    signals = spark.createDataFrame([("g", "m", "b", None), ("g", "m", "b", None), ("g", None, "a", None)], SIGNALS)
    found = graph.implicit_signals(uses, signals)
    assert broadcasts(found) == 0
    got = sorted((r["graph_id"], r["module"] or "", r["name"], r["file"], r["line_start"], r["ord"]["o1"]) for r in found.collect())
    assert got == [("g", "", "a", "f4", 4, 4), ("g", "m", "a", "f1", 1, 1), ("h", "m", "b", "f6", 6, 6)]


def test_modules_are_not_broadcast(spark):
    modules = spark.createDataFrame([("g", "s1", "s.sv", 1, 9, 1), ("g", "s1", "t.sv", 2, 8, 2)], "graph_id string, name string, file string, line_start int, line_end int, ord long")
    instances = spark.createDataFrame([("g", "o1", "u", "s1", 1), ("g", "o1", "v", "s2", 2)], "graph_id string, parent string, name string, module_type string, ord long")
    instances = instances.selectExpr("*", "'f.sv' AS file", "1 AS line_start", "1 AS line_end")
    met = instances.join(graph.last_modules(modules), ["graph_id", "module_type"])
    assert broadcasts(met) == 0 and [r["child_loc"]["file"] for r in met.collect()] == ["t.sv"]
    assert broadcasts(graph.resolve_instances(instances, modules)) == 0 == broadcasts(graph.unresolved_warnings(instances, modules))


def test_texts_of_run_folders_are_not_broadcast(spark, tmp_path):
    """A manifest of two parts, the texts of whose folders are read by tasks."""
    root = tmp_path / "batch"
    (root / runs.MANIFEST).mkdir(parents=True)
    for i in range(2):
        folder = root / f"rep_{i}"
        folder.mkdir()
        (folder / runs.METADATA).write_text('{"run_id": "m%d"}' % i)
        (root / runs.MANIFEST / f"part-{i}.json").write_text('{"batch_id": "b", "runs": [{"status": "success", "run_dir": "%s"}]}' % folder)
    loaded = runs.load_batch(spark, str(root))
    assert broadcasts(loaded) == 0
    assert sorted((r["batch_id"], r["run_id"]) for r in loaded.collect()) == [("b", "m0"), ("b", "m1")]
