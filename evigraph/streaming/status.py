"""The append-only status log as a stream: latest row per run and counts by status.

Counts are kept as changes. Each run has one row of state, its newest status; a newer row takes the run out of the old status
and puts it into the new one, and a row that is older than the state changes nothing, in whatever order files and rows arrive. The
changes of a micro-batch are written to a folder of its own, so that a batch that runs again replaces what it wrote before.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from evigraph.operators.evaluate import latest_status

STATUS_SCHEMA = "batch_id string, run_id string, status string, elapsed_seconds double, ord bigint"
CHANGE_SCHEMA = "batch_id string, status string, runs long, log_rows long"


def status_stream(spark: SparkSession, path: str, schema: str = STATUS_SCHEMA, files_per_batch: int = 1000) -> DataFrame:
    """New files of a status log folder as they are appended."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def latest_per_run(log: DataFrame) -> DataFrame:
    """One row per run; the state holds a single row per run, however long the log grows."""
    return latest_status(log, ["batch_id", "run_id"])


def write_latest(log: DataFrame, checkpoint: str, sink):
    """Start a query that hands every changed run to ``sink(frame, epoch)``."""
    writer = latest_per_run(log).writeStream.outputMode("update").foreachBatch(sink)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _changes_of_run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    old = state.get if state.exists else None
    newest, rows = old, 0
    for frame in frames:
        rows += len(frame)
        for status, ord_ in zip(frame["status"], frame["ord"], strict=True):
            if newest is None or (ord_, status) > (newest[1], newest[0]):
                newest = (status, int(ord_))
    out = [] if old is None or newest[0] == old[0] else [(key[0], old[0], -1, 0)]
    out.append((key[0], newest[0], int(old is None or newest[0] != old[0]), rows))
    state.update(newest)
    yield pd.DataFrame(out, columns=["batch_id", "status", "runs", "log_rows"])


def status_changes(log: DataFrame) -> DataFrame:
    """(batch_id, status, runs, log_rows): what the new rows of a stream add to the counts, or take from them.

    A null status counts as '', rows without an ``ord`` as the oldest; rows of one run with equal ``ord`` count by the greater status.
    """
    named = log.select("batch_id", "run_id", F.coalesce("status", F.lit("")).alias("status"), F.coalesce(F.col("ord").cast("long"), F.lit(-(1 << 63))).alias("ord"))
    return named.groupBy("batch_id", "run_id").applyInPandasWithState(
        _changes_of_run, CHANGE_SCHEMA, "status string, ord long", "update", GroupStateTimeout.NoTimeout
    )


def write_counts(log: DataFrame, checkpoint: str, folder: str):
    """Start a query that writes the changes of each micro-batch below ``folder``, added up by batch and status."""

    def keep(frame: DataFrame, epoch: int) -> None:
        sums = frame.groupBy("batch_id", "status").agg(F.sum("runs").alias("runs"), F.sum("log_rows").alias("log_rows"))
        sums.write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")

    writer = status_changes(log).writeStream.outputMode("update").foreachBatch(keep)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_status(spark: SparkSession, folder: str) -> DataFrame:
    """(batch_id, status, runs): the runs whose newest row has the status, as of the last micro-batch."""
    changes = spark.read.schema(CHANGE_SCHEMA).parquet(folder)
    return changes.groupBy("batch_id", "status").agg(F.sum("runs").alias("runs")).filter("runs <> 0")


def streamed_summary(spark: SparkSession, folder: str) -> DataFrame:
    """The batch form's summary of the log, from the changes alone."""
    changes = spark.read.schema(CHANGE_SCHEMA).parquet(folder)
    of = lambda status: F.sum(F.when(F.col("status") == status, F.col("runs")).otherwise(0))
    return changes.groupBy("batch_id").agg(
        F.sum("log_rows").alias("status_rows"), F.sum("runs").alias("latest_unique_runs"), of("success").alias("latest_success"), of("failed").alias("latest_failed")
    )
