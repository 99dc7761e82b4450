"""Queries over streams; the log is read from files, a few of them in each micro-batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query, table
from evigraph.session import work_path
from evigraph.streaming import status


@query(
    "i07_status_stream",
    """WITH l AS (SELECT user_id % 7 AS b, user_id, arg_max(event_type, event_id) AS status FROM events GROUP BY 1, 2)
SELECT 'batch' || b AS batch_id, status, count(*) AS runs FROM l GROUP BY 1, 2""",
)
def i07_stream(spark, sf):
    """Events as status rows of users, in files whose order says nothing about the order of the rows."""
    path, folder = work_path(spark, "log"), work_path(spark, "counts")
    rows = table(spark, sf, "events").select(
        F.concat(F.lit("batch"), F.col("user_id") % 7).alias("batch_id"), F.concat(F.lit("run"), "user_id").alias("run_id"),
        F.col("event_type").alias("status"), F.col("value").alias("elapsed_seconds"), F.col("event_id").alias("ord"),
    )
    rows.repartition(4, F.xxhash64("ord")).write.json(path)
    status.write_counts(status.status_stream(spark, path, files_per_batch=2), work_path(spark, "progress"), folder).awaitTermination()
    return status.counts_by_status(spark, folder)
