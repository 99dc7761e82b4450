"""The streamed latest status equals the batch form."""

import random

from pyspark.sql import functions as F

from evigraph.operators import evaluate
from evigraph.session import work_path
from evigraph.sources.tables import append_jsonl
from evigraph.streaming import status


def test_latest_status_stream(spark):
    path = work_path(spark, "log")
    rows = [("b", "r1", "failed", 1.0, 1), ("b", "r2", "success", 2.0, 2), ("b", "r1", "success", 3.0, 3), ("c", "r1", "failed", 1.0, 4)]
    for row in rows:
        append_jsonl(spark.createDataFrame([row], status.STATUS_SCHEMA).coalesce(1), path)
    seen = {}

    def sink(frame, _epoch):
        seen.update({(r["batch_id"], r["run_id"]): r["status"] for r in frame.collect()})

    query = status.write_latest(status.status_stream(spark, path), work_path(spark, "progress"), sink)
    query.awaitTermination(120)
    batch = status.latest_per_run(spark.read.schema(status.STATUS_SCHEMA).json(path)).collect()
    assert seen == {(r["batch_id"], r["run_id"]): r["status"] for r in batch} == {("b", "r1"): "success", ("b", "r2"): "success", ("c", "r1"): "failed"}


def test_counts_by_status(spark):
    """Rows of a run come in any order, over several batches, and again; the counts follow the newest row."""
    rng = random.Random(4)
    rows = [(f"b{rng.randrange(3)}", f"r{rng.randrange(12)}", rng.choice(["failed", "success", "running", None]), 1.0, i) for i in range(160)]
    rng.shuffle(rows)
    path, progress, folder = (work_path(spark, n) for n in ("log", "progress", "counts"))
    for at in range(0, len(rows), 32):
        append_jsonl(spark.createDataFrame(rows[at : at + 32], status.STATUS_SCHEMA).coalesce(1), path)
        if at >= 64:
            status.write_counts(status.status_stream(spark, path), progress, folder).awaitTermination(120)
            log = spark.read.schema(status.STATUS_SCHEMA).json(path)
            latest = status.latest_per_run(log)
            want = {(r["batch_id"], r["status"] or ""): r["n"] for r in latest.groupBy("batch_id", "status").agg(F.count("*").alias("n")).collect()}
            got = {(r["batch_id"], r["status"]): r["runs"] for r in status.counts_by_status(spark, folder).collect()}
            assert got == want
            assert sorted(map(tuple, status.streamed_summary(spark, folder).collect())) == sorted(map(tuple, evaluate.status_summary(log).collect()))
