"""Check targets: rule tags, structural evidence, accesses, dedupe and top-k."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evigraph.functions import rules
from evigraph.functions.scan import numbered, ordered_scan, row_no
from evigraph.functions.values import contains_any, count_where, within
from evigraph.session import persist_table

EVIDENCE = [
    "register", "state_update_target", "condition_used", "output_port", "port", "cross_module_connect", "read_or_write", "reset_related",
]


def signals_of(nodes: DataFrame) -> DataFrame:
    """Signal nodes with their module and the text their context is judged by."""
    module = F.coalesce(F.regexp_replace("scope", "^module:", ""), F.lit(""))
    context = F.lower(F.concat_ws(" ", "module", F.coalesce("file", F.lit(""))))
    return (
        nodes.filter("type = 'Signal'")
        .select(
            "graph_id", F.col("id").alias("node_id"), "name", module.alias("module"), "file", "line_start", "line_end",
            "kind", "direction", "decl_raw",
        )
        .withColumns({"low": F.lower("name"), "context": context})
        .withColumn("about", F.concat_ws(" ", "low", "context"))
    )


def statement_kind(kind: Column, name: Column) -> Column:
    return F.coalesce(F.nullif(kind, F.lit("")), F.split_part(name, F.lit(":"), F.lit(1)))


def _incident(nodes: DataFrame, edges: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """Edges seen from the signal they touch, with the node at the other end (dangling ends dropped)."""
    ends = nodes.select(
        "graph_id", F.col("id").alias("other_id"), statement_kind(F.col("kind"), F.col("name")).alias("other_kind")
    )
    into = edges.select("graph_id", F.col("to_id").alias("node_id"), F.col("from_id").alias("other_id"), "type", "read_role", "ord", F.lit(0).alias("side"))
    out = edges.filter("type = 'connects'").select(
        "graph_id", F.col("from_id").alias("node_id"), F.col("to_id").alias("other_id"), "type", "read_role", "ord", F.lit(1).alias("side")
    )
    touching = into.unionByName(out)
    if only is not None:
        touching = touching.join(only.select("graph_id", "node_id"), ["graph_id", "node_id"], "left_semi")
    return touching.join(ends, ["graph_id", "other_id"])


def evidence_flags(nodes: DataFrame, edges: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """One mode column per predicate (explicit, inferred or unavailable) from a single aggregation.

    ``only`` is a table of some signals with all their columns (see ``signals_of``) and others; edges of signals outside it are
    dropped before they are joined or aggregated.
    """
    role = F.lower(F.coalesce("read_role", F.lit("")))
    conditional = role.isin("condition", "case_selector") | F.col("other_kind").isin("condition", "case_branch")
    seen = _incident(nodes, edges, only).groupBy("graph_id", "node_id").agg(
        F.bool_or((F.col("type") == "writes") & (F.col("other_kind") == "state_update")).alias("_update"),
        F.bool_or((F.col("type") == "reads") & conditional).alias("_cond"),
        F.bool_or(F.col("type") == "connects").alias("_conn"),
        F.bool_or(F.col("type").isin("writes", "reads")).alias("_rw"),
    )
    rows = (signals_of(nodes) if only is None else only).join(seen, ["graph_id", "node_id"], "left")
    known = lambda c: F.coalesce(F.col(c), F.lit(False))
    mode = lambda cond, name="explicit": F.when(F.coalesce(cond, F.lit(False)), name).otherwise(F.lit("unavailable"))
    register = F.when(F.col("kind") == "register", "explicit").when(known("_update"), "inferred").otherwise(F.lit("unavailable"))
    return rows.withColumns(
        {
            "register": register,
            "state_update_target": mode(known("_update")),
            "condition_used": mode(known("_cond")),
            "output_port": mode(F.col("direction") == "output"),
            "port": mode((F.col("kind") == "port") | F.col("direction").isin("input", "output", "inout")),
            "cross_module_connect": mode(known("_conn")),
            "read_or_write": mode(known("_rw")),
            "reset_related": mode(rules.reset_related(F.col("about")), "inferred"),
        }
    ).drop("_update", "_cond", "_conn", "_rw")


def name_filter(signals: DataFrame) -> DataFrame:
    """Drop constants and stop names; the filter runs before any edge is joined."""
    name = F.col("name")
    skip = rules.constant_like(name, F.col("kind"), F.col("decl_raw")) | rules.excluded_name(F.col("low"), F.col("context"))
    return signals.filter(~F.coalesce(skip, F.lit(False)))


def context_rules(low: Column, context: Column) -> Column:
    """Rules by name plus R5 / R3 from the file and module around it (repeats kept)."""
    extra = F.array_compact(
        F.array(F.when(rules.crypto_resource(low, context), "R5"), F.when(rules.reset_control(low, context), "R3"))
    )
    return F.concat(rules.rule_ids(low), extra)


def gate_rules(matched: Column, about: Column, reset: Column, connected: Column) -> Column:
    """Rules that need evidence they do not have are taken away; sorted and distinct."""
    dma = contains_any(about, rules.DMA_CONTEXT)
    locked = F.array_contains(matched, "R2")
    kept = F.filter(
        matched,
        lambda r: ~(((r == "R3") & ~reset) | ((r == "R8") & ~connected) | ((r == "R4") & locked) | ((r == "R7") & ~dma)),
    )
    return F.array_sort(F.array_distinct(kept))


def candidate_points(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Signals with at least one rule left, their roles, rules and evidence modes."""
    usable = name_filter(signals_of(nodes)).withColumn("_matched", context_rules(F.col("low"), F.col("context")))
    rows = evidence_flags(nodes, edges, persist_table(usable.filter(F.size("_matched") > 0), "usable"))
    has = {e: F.col(e) != "unavailable" for e in EVIDENCE}
    any_mode = reduce(lambda a, b: a | b, has.values())
    rows = rows.filter(any_mode & ~rules.weak_handshake(F.col("low"), F.col("about")))
    rows = rows.withColumn(
        "matched_rules",
        gate_rules(F.col("_matched"), F.col("about"), has["reset_related"], has["cross_module_connect"]),
    ).filter(F.size("matched_rules") > 0)
    structural = F.array_compact(
        F.array(
            F.when(has["register"], "register"),
            F.when(has["state_update_target"], "state_update_target"),
            F.when(has["output_port"], "output_port"),
            F.when(has["condition_used"], "control_like"),
        )
    )
    modes = F.map_from_entries(
        F.array_compact(F.array(*[F.when(has[e], F.struct(F.lit(e).alias("key"), F.col(e).alias("value"))) for e in EVIDENCE]))
    )
    return rows.select(
        "graph_id", "node_id", "name", "module", "file", "line_start", "line_end", "direction",
        F.array_sort(F.array_distinct(F.concat(structural, rules.roles_of(F.col("matched_rules"))))).alias("point_roles"),
        "matched_rules",
        modes.alias("evidence_modes"),
    )


# ---------------------------------------------------------------- accesses


def all_accesses(points: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Writes, reads, output and connections of each point, in that order."""
    keys = ["graph_id", "point_id"]
    mine = points.select("graph_id", F.col("node_id").alias("point_id"), "direction")
    seen = _incident(nodes, edges).withColumnRenamed("node_id", "point_id").join(mine.select(*keys), keys, "left_semi")
    role = F.lower(F.coalesce("read_role", F.lit("")))
    roles = lambda *names: F.array(*[F.lit(n) for n in names])
    order = lambda b, side: F.struct(F.lit(b).alias("branch"), side.alias("side"), F.col("ord").alias("o"))
    writes = seen.filter("type = 'writes'").select(
        *keys, F.col("other_id").alias("node_id"), F.col("other_kind").alias("kind"), F.lit("write").alias("type"),
        F.when(F.col("other_kind") == "state_update", roles("state_update", "register_write")).otherwise(roles("register_write")).alias("access_roles"),
        order(0, F.lit(0)).alias("ord"),
    )
    case_use = (role == "case_selector") | (F.col("other_kind") == "case_branch")
    cond_use = (role == "condition") | (F.col("other_kind") == "condition")
    reads = seen.filter("type = 'reads'").select(
        *keys, F.col("other_id").alias("node_id"), F.col("other_kind").alias("kind"),
        F.when(case_use | cond_use, "control").otherwise(F.lit("read")).alias("type"),
        F.when(case_use, roles("case_use")).when(cond_use, roles("condition_use")).otherwise(roles("register_read")).alias("access_roles"),
        order(1, F.lit(0)).alias("ord"),
    )
    empty = F.lit(None).cast(edges.schema["ord"].dataType)
    outputs = mine.filter("direction = 'output'").select(
        *keys, F.col("point_id").alias("node_id"), F.lit("output_port").alias("kind"), F.lit("output").alias("type"),
        roles("output_drive").alias("access_roles"),
        F.struct(F.lit(2).alias("branch"), F.lit(0).alias("side"), empty.alias("o")).alias("ord"),
    )
    connects = seen.filter("type = 'connects'").select(
        *keys, F.col("other_id").alias("node_id"), F.lit("connects").alias("kind"), F.lit("control").alias("type"),
        roles("cross_module_connect").alias("access_roles"), order(3, F.col("side")).alias("ord"),
    )
    return writes.unionByName(reads).unionByName(outputs).unionByName(connects)


def distinct_cap(rows: DataFrame, group: list[str], key: list[str], limit: int | None) -> DataFrame:
    """First row per key, numbered within each group; only the first ``limit`` keys where one is given."""
    rest = [c for c in rows.columns if c not in (*group, *key)]
    firsts = rows.groupBy(*group, *key).agg(F.min_by(F.struct(*rest), F.col("ord")).alias("_f"))
    window = W.partitionBy(*group).orderBy("_f.ord")
    return within(firsts.withColumn("no", F.row_number().over(window)), "no", limit).select(*group, *key, "_f.*", "no")


def accesses(points: DataFrame, nodes: DataFrame, edges: DataFrame, limit: int | None = None) -> DataFrame:
    return distinct_cap(all_accesses(points, nodes, edges), ["graph_id", "point_id"], ["node_id", "type", "access_roles"], limit)


def make_targets(points: DataFrame) -> DataFrame:
    """Target ids numbered over (module, name, node) within each graph."""
    rows = ordered_scan(
        points, ["graph_id"], [F.col("module"), F.col("name"), F.col("node_id")], {"seq": row_no()}
    )
    return rows.withColumn("target_id", F.concat_ws(":", F.lit("target"), "module", "name", F.col("seq").cast("string")))


def target_locations(targets: DataFrame, found: DataFrame, nodes: DataFrame, limit: int | None = None) -> DataFrame:
    """Locations of the point, then of its accesses; one per (node, role)."""
    loc = nodes.filter(F.col("file").isNotNull()).select("graph_id", F.col("id").alias("node_id"), "file", "line_start", "line_end")
    ids = targets.select("graph_id", F.col("node_id").alias("point_id"), "target_id")
    point = ids.select("graph_id", "target_id", F.col("point_id").alias("node_id"), F.lit("point").alias("role"), F.lit(0).alias("ord"))
    used = found.join(ids, ["graph_id", "point_id"]).select(
        "graph_id", "target_id", "node_id", F.lit("access").alias("role"), F.col("no").alias("ord")
    )
    rows = point.unionByName(used).join(loc, ["graph_id", "node_id"])
    return distinct_cap(rows, ["graph_id", "target_id"], ["node_id", "role"], limit)


# ---------------------------------------------------------------- dedupe and top-k


def _high() -> Column:
    return F.filter("point_roles", lambda r: r.isin(*rules.HIGH_PRIORITY_ROLES))


def dedupe_targets(targets: DataFrame) -> DataFrame:
    """First target per (module, name, high-priority roles, else the first two roles)."""
    key = F.when(F.size(_high()) > 0, _high()).otherwise(F.slice("point_roles", 1, 2))
    rest = [c for c in targets.columns if c not in ("graph_id", "module", "name")]
    firsts = targets.withColumn("_key", key).groupBy("graph_id", "module", "name", "_key").agg(
        F.min_by(F.struct(*rest), F.col("seq")).alias("_t")
    )
    return firsts.select("graph_id", "module", "name", "_t.*")


def priority(roles: Column) -> Column:
    has = lambda r: F.array_contains(roles, r).cast("int")
    high = F.arrays_overlap(roles, F.array(*[F.lit(r) for r in rules.HIGH_PRIORITY_ROLES])).cast("int")
    return -(has("register") * 4 + has("output_port") * 3 + has("control_like") * 2 + high * 2)


def trim_targets(targets: DataFrame, per_module: int | None = None, per_graph: int | None = None) -> DataFrame:
    """Targets ranked by priority; only the best per module, then per graph, where limits are given."""
    rows = targets.withColumn("score", priority(F.col("point_roles")))
    if per_module is not None:
        rows = numbered(rows, ["graph_id", "module"], [F.col(c) for c in ("score", "name", "seq")], "_m", per_module).drop("_m")
    return numbered(rows, ["graph_id"], [F.col(c) for c in ("score", "module", "name", "seq")], "rank", per_graph)


def trim_stats(before: DataFrame, deduped: DataFrame, per_module: int | None = None, per_graph: int | None = None) -> DataFrame:
    """How many targets each step takes away, from counts alone."""
    sizes = deduped.groupBy("graph_id", "module").agg(F.count(F.lit(1)).alias("_n"))
    kept = F.col("_n") if per_module is None else F.least("_n", F.lit(per_module))
    per = sizes.groupBy("graph_id").agg(F.sum("_n").alias("_deduped"), F.sum(kept).alias("_kept"))
    totals = before.groupBy("graph_id").agg(F.count(F.lit(1)).alias("target_count_before_dedup"))
    final = F.col("_kept") if per_graph is None else F.least("_kept", F.lit(per_graph))
    return totals.join(per, "graph_id").select(
        "graph_id",
        "target_count_before_dedup",
        F.col("_deduped").alias("target_count_after_dedup"),
        final.alias("target_count_final"),
        (F.col("target_count_before_dedup") - F.col("_deduped")).alias("deduplicated_target_count"),
        (F.col("_deduped") - F.col("_kept")).alias("targets_trimmed_by_module_limit"),
        (F.col("_kept") - final).alias("targets_trimmed_by_repo_limit"),
    )


def histograms(points: DataFrame, targets: DataFrame, found: DataFrame) -> DataFrame:
    """(graph_id, histogram, name, n) over candidate rules and modes, target roles and access roles."""

    def counted(df: DataFrame, values: Column, label: str) -> DataFrame:
        rows = df.select("graph_id", F.explode(values).alias("name"))
        return rows.groupBy("graph_id", F.lit(label).alias("histogram"), "name").agg(F.count(F.lit(1)).alias("n"))

    mine = found.join(targets.select("graph_id", F.col("node_id").alias("point_id")), ["graph_id", "point_id"], "left_semi")
    return reduce(
        DataFrame.unionByName,
        [
            counted(points, F.col("matched_rules"), "matched_rules"),
            counted(points, F.map_values("evidence_modes"), "evidence_modes"),
            counted(targets, F.col("point_roles"), "point_roles"),
            counted(mine, F.col("access_roles"), "access_roles"),
        ],
    )


def missing_locations(targets: DataFrame, locations: DataFrame) -> DataFrame:
    lost = targets.join(locations.select("graph_id", "target_id"), ["graph_id", "target_id"], "left_anti")
    return lost.groupBy("graph_id").agg(count_where(F.lit(True)).alias("missing_source_loc_count"))
