"""Linking extracted definitions to node and edge tables, and lookups over them.

Everything is keyed by graph_id, so all graphs are built by the same joins.
``ord`` columns carry the order of the source and decide every "first wins".
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.functions.scan import ordered_scan, row_no
from evigraph.functions.values import count_where, present


def module_id(name: Column) -> Column:
    return F.concat(F.lit("module:"), name)


def instance_id(parent: Column, name: Column) -> Column:
    return F.concat(F.lit("instance:"), parent, F.lit("."), name)


def signal_id(module: Column, name: Column) -> Column:
    return F.concat(F.lit("signal:"), module, F.lit("."), name)


def stmt_id(module: Column, line: Column, kind: Column) -> Column:
    return F.concat(F.lit("stmt:"), module, F.lit(":"), line.cast("string"), F.lit(":"), kind)


def node_union(parts: list[DataFrame]) -> DataFrame:
    """First node per id; parts come in phase order, each with its own ``ord``."""
    phased = [p.withColumn("ord", F.struct(F.lit(i).alias("phase"), F.col("ord").alias("o"))) for i, p in enumerate(parts)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), phased)
    fields = [c for c in rows.columns if c not in ("graph_id", "id")]
    first = rows.groupBy("graph_id", "id").agg(F.min_by(F.struct(*fields), F.col("ord")).alias("_n"))
    return first.select("graph_id", "id", "_n.*")


def upsert_signals(signals: DataFrame) -> DataFrame:
    """One row per (graph, module, name): first location, attributes of the last definition that has them."""

    def latest(name: str) -> Column:
        return F.max_by(name, F.when(F.col(name).isNotNull(), F.col("ord"))).alias(name)

    rows = signals.groupBy("graph_id", "module", "name").agg(
        F.min_by(F.struct("file", "line_start", "line_end"), F.col("ord")).alias("_loc"),
        F.min("ord").alias("ord"),
        *[latest(c) for c in ("kind", "decl_raw", "direction", "decl_type")],
    )
    return rows.select("graph_id", "module", "name", "_loc.*", "kind", "decl_raw", "direction", "decl_type", "ord")


def last_modules(modules: DataFrame) -> DataFrame:
    """Child lookups see the last module of a name. The table grows with the design, so no join may send it to every task."""
    rows = modules.groupBy("graph_id", "name").agg(F.max_by(F.struct("file", "line_start", "line_end"), F.col("ord")).alias("_loc"))
    return rows.select("graph_id", F.col("name").alias("module_type"), F.col("_loc").alias("child_loc")).hint("merge")


def resolve_instances(instances: DataFrame, modules: DataFrame) -> DataFrame:
    """Instances with ``resolved_module`` and ``unresolved``."""
    known = modules.select("graph_id", F.col("name").alias("module_type")).distinct().withColumn("_known", F.lit(True)).hint("merge")
    joined = instances.join(known, ["graph_id", "module_type"], "left")
    return joined.withColumns(
        {
            "resolved_module": F.when(F.col("_known"), module_id(F.col("module_type"))),
            "unresolved": F.col("_known").isNull(),
        }
    ).drop("_known")


def unresolved_warnings(instances: DataFrame, modules: DataFrame) -> DataFrame:
    known = modules.select("graph_id", F.col("name").alias("module_type")).distinct().hint("merge")
    lost = instances.join(known, ["graph_id", "module_type"], "left_anti")
    text = F.concat(F.lit("Unresolved instance "), "parent", F.lit("."), "name", F.lit(": "), "module_type")
    return lost.select("graph_id", "ord", text.alias("warning"))


def bound_ports(instances: DataFrame, bindings: DataFrame, modules: DataFrame) -> DataFrame:
    """Bindings of resolved instances that name a signal, with the child module's location."""
    inst = instances.join(last_modules(modules), ["graph_id", "module_type"]).select(
        "graph_id", "parent", F.col("name").alias("inst"), "module_type", "child_loc",
        F.struct("file", "line_start", "line_end").alias("inst_loc"), F.col("ord").alias("inst_ord"),
    )
    return inst.join(bindings.filter(F.col("actual_base").isNotNull()), ["graph_id", "inst_ord"])


def connect_edges(bound: DataFrame, signals: DataFrame) -> DataFrame:
    """One edge per binding; an output port turns it from child to parent.

    Spark takes declared signals for as small as the table they are made of, so the joins with them are told not to broadcast.
    """
    ports = signals.select("graph_id", F.col("module").alias("module_type"), F.col("name").alias("formal"), "direction").hint("merge")
    rows = bound.join(ports, ["graph_id", "module_type", "formal"], "left")
    direction = F.coalesce("direction", F.lit("unknown"))
    up = direction == "output"
    parent, child = signal_id(F.col("parent"), F.col("actual_base")), signal_id(F.col("module_type"), F.col("formal"))
    return rows.select(
        "graph_id",
        F.lit("connects").alias("type"),
        F.when(up, child).otherwise(parent).alias("from_id"),
        F.when(up, parent).otherwise(child).alias("to_id"),
        instance_id(F.col("parent"), F.col("inst")).alias("via_instance"),
        F.col("formal").alias("formal_port"),
        direction.alias("formal_port_direction"),
        "actual_expr",
        F.col("actual_base").alias("actual_base_signal"),
        F.when(up, "child_to_parent").otherwise(F.lit("parent_to_child")).alias("direction"),
        F.struct(F.lit(0).alias("phase"), F.col("inst_ord").alias("o1"), F.col("binding_no").cast("long").alias("o2")).alias("ord"),
    )


def signal_uses(bound: DataFrame, refs: DataFrame) -> DataFrame:
    """Every use of a signal name with the location it would be declared at."""
    order = lambda p, a, b, c: F.struct(
        F.lit(p).alias("phase"), a.alias("o1"), b.cast("long").alias("o2"), F.lit(c).alias("o3")
    )
    inst, no = F.col("inst_ord"), F.col("binding_no")
    use = lambda m, n, loc, o: ["graph_id", m.alias("module"), n.alias("name"), loc.alias("loc"), o.alias("ord")]
    parents = bound.select(*use(F.col("parent"), F.col("actual_base"), F.col("inst_loc"), order(0, inst, no, 0)))
    children = bound.select(*use(F.col("module_type"), F.col("formal"), F.col("child_loc"), order(0, inst, no, 1)))
    loc = F.struct("file", F.col("line").alias("line_start"), F.col("line").alias("line_end"))
    stated = refs.select(*use(F.col("module"), F.col("base"), loc, order(1, F.col("stmt_ord"), F.col("ref_no"), 0)))
    return parents.unionByName(children).unionByName(stated)


def implicit_signals(uses: DataFrame, signals: DataFrame) -> DataFrame:
    """Undeclared names become signals at their first use; uses of a name are reduced to the first before declared names are left out."""
    keys = ["graph_id", "module", "name"]
    first = uses.groupBy(*keys).agg(F.min_by("loc", "ord").alias("_loc"), F.min("ord").alias("ord"))
    missing = first.join(signals.select(*keys).hint("merge"), keys, "left_anti")
    return missing.select(*keys, "_loc.*", F.lit("implicit").alias("kind"), "ord")


def write_edges(refs: DataFrame) -> DataFrame:
    """statement -> signal for every left-hand reference."""
    return refs.filter("role = 'lhs'").select(
        "graph_id",
        F.lit("writes").alias("type"),
        stmt_id(F.col("module"), F.col("line"), F.col("kind")).alias("from_id"),
        signal_id(F.col("module"), F.col("base")).alias("to_id"),
        F.col("raw").alias("lhs_raw"),
        F.struct(F.lit(1).alias("phase"), F.col("stmt_ord").alias("o1"), F.col("ref_no").cast("long").alias("o2")).alias("ord"),
    )


def read_edges(refs: DataFrame) -> DataFrame:
    """statement -> signal, once per (statement object, signal, role) with the first raw text."""
    keys = ["graph_id", "stmt_ord", "module", "line", "kind", "base", "role"]
    first = refs.filter("role <> 'lhs'").groupBy(*keys).agg(
        F.min_by(F.struct("raw", "selectors"), F.col("ref_no")).alias("_r"), F.min("ref_no").alias("ref_no")
    )
    return first.select(
        "graph_id",
        F.lit("reads").alias("type"),
        stmt_id(F.col("module"), F.col("line"), F.col("kind")).alias("from_id"),
        signal_id(F.col("module"), F.col("base")).alias("to_id"),
        F.col("role").alias("read_role"),
        F.col("_r.raw").alias("raw_expr"),
        F.col("_r.selectors").alias("selectors"),
        F.struct(F.lit(1).alias("phase"), F.col("stmt_ord").alias("o1"), F.col("ref_no").cast("long").alias("o2")).alias("ord"),
    )


def mark_registers(signals: DataFrame, refs: DataFrame) -> DataFrame:
    """Signals written by a state update are registers; their direction stays."""
    updated = (
        refs.filter("role = 'lhs' AND kind = 'state_update'")
        .select("graph_id", "module", F.col("base").alias("name"))
        .distinct()
        .withColumn("_reg", F.lit(True))
    )
    kind = F.when(F.col("_reg"), "register").otherwise(F.col("kind"))
    return signals.join(updated, ["graph_id", "module", "name"], "left").withColumn("kind", kind).drop("_reg")


def number_edges(edges: DataFrame, slices: int | None = None) -> DataFrame:
    """Running edge number per graph: connects first, then statements in order."""
    rows = ordered_scan(edges, ["graph_id"], [F.col("ord")], {"edge_no": row_no()}, slices)
    return rows.withColumn("id", F.concat(F.lit("edge:"), "type", F.lit(":"), "edge_no"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts by type and an approximate size: the largest line seen per file, summed."""
    kind = F.col("type")
    by_type = nodes.groupBy("graph_id").agg(
        *[count_where(kind == t).alias(n) for t, n in
          (("Module", "graph_modules"), ("Instance", "graph_instances"), ("Signal", "graph_signals"), ("StmtSummary", "graph_statements"))],
        F.count(F.lit(1)).alias("graph_nodes"),
    )
    files = nodes.filter(present(F.col("file")).isNotNull()).groupBy("graph_id", "file").agg(F.max("line_end").alias("_last"))
    by_file = files.groupBy("graph_id").agg(
        F.count(F.lit(1)).alias("rtl_files"), F.sum(F.coalesce("_last", F.lit(0))).alias("graph_loc_approx")
    )
    by_edge = edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("graph_edges"))
    out = by_type.join(by_file, "graph_id", "left").join(by_edge, "graph_id", "left")
    out = out.fillna(0, ["rtl_files", "graph_loc_approx", "graph_edges"])
    return out.withColumn("graph_scale_nodes_edges", F.col("graph_nodes") + F.col("graph_edges"))


# ---------------------------------------------------------------- lookups


def relations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, node_id, relation, other_id): written_by, read_by, connected_to, writes, reads.

    Ends that are no nodes are dropped, as a lookup would not find them.
    """
    pick = lambda kind, node, other, name: edges.filter(F.col("type") == kind).select(
        "graph_id", F.col(node).alias("node_id"), F.lit(name).alias("relation"), F.col(other).alias("other_id"), F.col("id").alias("edge_id")
    )
    rows = [
        pick("writes", "to_id", "from_id", "written_by"),
        pick("reads", "to_id", "from_id", "read_by"),
        pick("connects", "to_id", "from_id", "connected_to"),
        pick("connects", "from_id", "to_id", "connected_to"),
        pick("writes", "from_id", "to_id", "statement_writes"),
        pick("reads", "from_id", "to_id", "statement_reads"),
    ]
    both = reduce(DataFrame.unionByName, rows)
    known = nodes.select("graph_id", F.col("id").alias("other_id"))
    return both.join(known, ["graph_id", "other_id"], "left_semi")


def edge_between(edges: DataFrame) -> DataFrame:
    """First edge per (from, to, type)."""
    return edges.groupBy("graph_id", "from_id", "to_id", "type").agg(F.min_by("id", "ord").alias("edge_id"))


def owning_module(node_id: Column, node_type: Column, scope: Column, name: Column) -> Column:
    """Module of a node from its scope, else from its id, else its own name for modules."""
    dotted = lambda p: F.regexp_extract(node_id, rf"^{p}:(.*)\.[^.]*$", 1)
    return (
        F.when(F.startswith(scope, F.lit("module:")), F.substr(scope, F.lit(8)))
        .when(node_id.rlike(r"^signal:[\s\S]*\."), dotted("signal"))
        .when(F.startswith(node_id, F.lit("stmt:")), F.split_part(node_id, F.lit(":"), F.lit(2)))
        .when(node_id.rlike(r"^instance:[\s\S]*\."), dotted("instance"))
        .when(node_type == "Module", F.coalesce(name, F.lit("")))
        .otherwise(F.lit(""))
    )


def location(file: Column, line_start: Column, line_end: Column) -> Column:
    """Location struct, NULL when a line is no integer."""
    start, end = line_start.try_cast("int"), line_end.try_cast("int")
    value = F.struct(F.coalesce(file, F.lit("")).alias("file"), start.alias("line_start"), end.alias("line_end"))
    return F.when(start.isNotNull() & end.isNotNull(), value)
