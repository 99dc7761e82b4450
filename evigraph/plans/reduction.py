"""Chain contexts to a reduced set of contexts and what is left of their coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.operators import coverage, reduce
from evigraph.session import persist_table


def reduce_contexts(contexts: DataFrame, target_total: int, min_per_scope: int, redistribute: bool = False) -> dict[str, DataFrame]:
    """Contexts deduplicated by their snippets, scored, and chosen by budget for the most new snippets.

    contexts(scope, chain_id, idx, source_snippets[file, line_start, line_end, code], nodes[], edges[], seed_targets[], payload).
    """
    scored = reduce.richness(contexts.withColumn("signature", reduce.signature(F.col("source_snippets"))))
    best = persist_table(reduce.best_of_duplicates(scored), "best-contexts")
    elements = best.select("scope", "idx", F.explode(F.array_distinct("signature")).alias("element"))
    scopes = best.groupBy("scope").agg(F.count(F.lit(1)).alias("chains"), F.min("idx").alias("ord"))
    budgets = persist_table(reduce.allocate_budgets(scopes, target_total, min_per_scope, redistribute), "budgets")
    chosen = reduce.select_diverse(best, elements, budgets)
    kept = persist_table(best.join(chosen, ["scope", "idx"]), "kept-contexts")
    return {"kept": kept, "budgets": budgets, "summary": reduce.compression_summary(contexts, kept)}


def covering_contexts(contexts: DataFrame, traces: DataFrame, extras: int | None = None) -> dict[str, DataFrame]:
    """The contexts that a greedy cover of the traces takes, and contexts that cover none.

    contexts as above with file ranges in ``source_snippets``; traces(scope_id, case_id, trace_no, file, line_start, line_end).
    """
    snippets = contexts.select(F.col("scope").alias("scope_id"), "idx", F.explode("source_snippets").alias("s"))
    ranges = snippets.select("scope_id", "idx", F.col("s.file").alias("file"), F.col("s.line_start").alias("loc_start"), F.col("s.line_end").alias("loc_end"))
    pairs = coverage.overlap_join(traces, ranges, ["scope_id", "file"], ("line_start", "line_end"), ("loc_start", "loc_end"))
    trace = F.struct("case_id", "trace_no").alias("element")
    cover = persist_table(pairs.select(F.col("scope_id").alias("scope"), "idx", trace).distinct(), "covered")
    return {"cover": reduce.set_cover(cover), "extras": reduce.uncovered_extras(contexts.select("scope", "idx"), cover, extras)}


def coverage_of(contexts: DataFrame, traces: DataFrame) -> DataFrame:
    """Cases covered weakly and strictly per scope, and in total, by the snippets of ``contexts``."""
    snippets = contexts.select(F.col("scope").alias("scope_id"), "chain_id", F.explode("source_snippets").alias("s"))
    locations = snippets.select("scope_id", "chain_id", "s.file", "s.line_start", "s.line_end")
    covered = coverage.covered_traces(traces, locations, ["scope_id", "file"])
    return coverage.coverage_by_scope(coverage.case_coverage(traces.select("scope_id", "case_id").distinct(), covered))
