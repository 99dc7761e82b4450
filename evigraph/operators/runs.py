"""Run bookkeeping: pending runs, reruns and batch counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.functions.values import count_where


def planned_runs(scopes: DataFrame, models: list[str], repetitions: int, batch_id: str) -> DataFrame:
    """Every model, scope and repetition of a batch; models and repetitions are configuration lists."""
    rows = scopes.select("scope_id", F.explode(F.array(*[F.lit(m) for m in models])).alias("model_id"))
    rows = rows.withColumn("repetition", F.explode(F.sequence(F.lit(1), F.lit(repetitions))))
    run_id = F.concat_ws("__", F.lit(batch_id), "model_id", "scope_id", F.concat(F.lit("rep_"), "repetition"))
    return rows.withColumn("run_id", run_id)


def pending_runs(planned: DataFrame, log: DataFrame, batch_id: str) -> DataFrame:
    done = log.filter((F.col("batch_id") == batch_id) & (F.col("status") == "success")).select("run_id").distinct()
    return planned.join(done, "run_id", "left_anti")


def apply_reruns(manifest: DataFrame, reruns: DataFrame) -> DataFrame:
    """Failed manifest rows take the values of their rerun, found by position."""
    fields = [c for c in reruns.columns if c != "position"]
    redo = reruns.select("position", F.struct(*fields).alias("_new"))
    failed = F.coalesce(F.col("status"), F.lit("")) != "success"
    joined = manifest.join(redo, "position", "left").withColumn("_use", failed & F.col("_new").isNotNull())
    replaced = {c: F.when(F.col("_use"), F.col(f"_new.{c}")).otherwise(F.col(c)) for c in fields}
    return joined.withColumns({**replaced, "rerun": F.col("_use")}).drop("_new", "_use")


def remaining_failed(manifest: DataFrame) -> DataFrame:
    return manifest.agg(
        F.count(F.lit(1)).alias("runs"),
        count_where(F.col("rerun")).alias("rerun_runs"),
        count_where(F.coalesce(F.col("status"), F.lit("")) != "success").alias("remaining_failed"),
    )


def batch_counts(outcomes: DataFrame) -> DataFrame:
    status = F.col("status")
    return outcomes.groupBy("batch_id").agg(
        *[count_where(status == s).alias(f"{s}_count") for s in ("success", "failed", "skipped")],
        F.count(F.lit(1)).alias("total_runs"),
    )
