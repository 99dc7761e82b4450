"""Source tree to property graph, targets, chains and contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.operators import context, extract, graph, search, tagging
from evigraph.session import persist_table

ATTRS = ["kind", "direction", "decl_raw", "decl_type", "header_raw", "module_type", "resolved_module", "unresolved",
         "parameter_text", "assignment_op", "lhs_raw", "rhs_raw", "conditions", "case_selectors"]


def build_graph(sources: DataFrame) -> dict[str, DataFrame]:
    """nodes, edges and warnings of every graph in sources(graph_id, file, text)."""
    modules = persist_table(extract.number_modules(extract.module_spans(sources)), "modules")
    defs = extract.module_defs(modules)
    signals = persist_table(graph.upsert_signals(extract.declared_signals(modules)), "signals")
    found = persist_table(extract.instances(modules), "instances")
    stated = persist_table(extract.statements(modules), "statements")
    refs = persist_table(extract.statement_refs(stated), "refs")
    bound = persist_table(graph.bound_ports(found, extract.bindings(found), defs), "bound")

    implied = graph.implicit_signals(graph.signal_uses(bound, refs), signals)
    declared = signals.unionByName(implied.drop("ord"), allowMissingColumns=True)
    marked = graph.mark_registers(declared, refs)

    place = ["file", "line_start", "line_end"]
    scope = lambda c: graph.module_id(F.col(c)).alias("scope")
    module_nodes = defs.select(
        "graph_id", graph.module_id(F.col("name")).alias("id"), F.lit("Module").alias("type"), F.lit(None).cast("string").alias("scope"), "name", *place, "header_raw", "ord"
    )
    signal_nodes = marked.select(
        "graph_id", graph.signal_id(F.col("module"), F.col("name")).alias("id"), F.lit("Signal").alias("type"), scope("module"), "name", *place,
        "kind", "direction", "decl_raw", "decl_type", extract.order_in_module(F.lit(0)).alias("ord"),
    )
    instance_nodes = graph.resolve_instances(found, defs).select(
        "graph_id", graph.instance_id(F.col("parent"), F.col("name")).alias("id"), F.lit("Instance").alias("type"), scope("parent"), "name", *place,
        "module_type", "resolved_module", "unresolved", "parameter_text", "ord",
    )
    line = F.col("line")
    statement_nodes = stated.select(
        "graph_id", graph.stmt_id(F.col("module"), line, F.col("kind")).alias("id"), F.lit("StmtSummary").alias("type"), scope("module"),
        F.concat_ws(":", "kind", line.cast("string")).alias("name"), "file", line.alias("line_start"), line.alias("line_end"),
        "kind", "assignment_op", "lhs_raw", "rhs_raw", "conditions", "case_selectors", F.col("stmt_ord").alias("ord"),
    )
    nodes = graph.node_union([module_nodes, signal_nodes, instance_nodes, statement_nodes])

    connects = graph.connect_edges(bound, declared)
    edges = connects.unionByName(graph.write_edges(refs), allowMissingColumns=True).unionByName(graph.read_edges(refs), allowMissingColumns=True)
    numbered = graph.number_edges(edges)
    return {
        "nodes": persist_table(nodes.drop("ord"), "nodes"),
        "edges": persist_table(numbered.withColumn("ord", F.col("edge_no")), "edges"),
        "warnings": graph.unresolved_warnings(found, defs),
    }


def build_targets(nodes: DataFrame, edges: DataFrame, per_module: int | None = None, per_graph: int | None = None) -> dict[str, DataFrame]:
    """Targets with their points, accesses and locations; the best of each module and graph only where limits are given."""
    points = persist_table(tagging.candidate_points(nodes, edges), "points")
    found = persist_table(tagging.accesses(points, nodes, edges), "accesses")
    before = persist_table(tagging.make_targets(points), "targets")
    deduped = persist_table(tagging.dedupe_targets(before), "deduped")
    kept = persist_table(tagging.trim_targets(deduped, per_module, per_graph), "kept-targets")
    locations = tagging.target_locations(kept, found, nodes)
    return {
        "points": points,
        "targets": kept,
        "accesses": found,
        "locations": locations,
        "stats": tagging.trim_stats(before, deduped, per_module, per_graph),
        "histograms": tagging.histograms(points, kept, found),
        "missing": tagging.missing_locations(kept, locations),
    }


def build_chains(
    nodes: DataFrame, edges: DataFrame, targets: DataFrame, accesses: DataFrame, max_depth: int = search.MAX_DEPTH,
    max_chains: int | None = None, max_fanout: int | None = None, max_nodes: int | None = None, max_edges: int | None = None,
) -> dict[str, DataFrame]:
    """Neighbourhoods of the targets; chains, edges of a node, nodes and edges of a chain are cut only where limits are given."""
    chains = persist_table(search.chain_targets(targets, max_chains), "chains")
    seeds = persist_table(search.seed_nodes(chains, accesses, nodes), "seeds")
    incidence = persist_table(search.capped_incidence(edges, max_fanout), "incidence")
    names = search.chain_names(seeds)
    visited = search.bounded_search(seeds, names, search.search_steps(incidence, nodes), max_depth)
    found = persist_table(search.formal_nodes(visited, nodes), "chain-nodes")
    touched = persist_table(search.visited_edges(visited, incidence, max_depth), "chain-edges")
    kept_nodes = persist_table(search.ranked_nodes(found, max_nodes), "kept-nodes")
    kept_edges = persist_table(search.ranked_edges(search.induced_edges(touched, kept_nodes), max_edges), "kept-edges")
    locations = persist_table(search.location_groups(kept_nodes, kept_edges, nodes), "chain-locations")
    return {
        "chains": chains,
        "nodes": search.chain_rows(kept_nodes, names),
        "edges": search.chain_rows(kept_edges, names),
        "locations": search.chain_locations(locations, names),
        "diagnostics": search.chain_diagnostics(chains, seeds, found, touched, kept_nodes, kept_edges, locations, names, max_nodes, max_edges),
    }


def build_contexts(locations: DataFrame, sources: DataFrame, max_snippets: int | None = None) -> dict[str, DataFrame]:
    """Snippets of every chain and the reasons for missing ones; locations(graph_id, chain_id, file, ...)."""
    file_keys, chain = ["graph_id", "file"], ["graph_id", "chain_id"]
    ranges = context.expand_ranges(locations, context.line_counts(sources, file_keys, "text"), file_keys)
    ranges = persist_table(ranges, "ranges")
    usable = ranges.filter("status = 'ok'").select(*chain, "file", "range_start", "range_end", "node_ids", "edge_ids")
    merged = context.merge_ranges(usable, [*chain, "file"], "range_start", "range_end", ["node_ids", "edge_ids"])
    numbered = persist_table(context.number_snippets(merged, chain, max_snippets), "snippets")
    kept = numbered.filter("NOT over_limit").drop("over_limit")
    texts = context.snippet_text(kept, context.source_lines(sources, file_keys, "text"), file_keys, [*chain, "snippet_id"])
    problems = ranges.filter("status <> 'ok'").select(*chain, "file", "status")
    return {"snippets": texts, "problems": problems.unionByName(context.snippet_limits(numbered, chain))}
