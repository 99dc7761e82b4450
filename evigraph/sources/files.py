"""Source trees and run directories as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Suffixes of source files, in any case.
SOURCE_GLOB = "*.{[vV],[sS][vV],[vV][hH]}"
TRACE_FILES = ["tool_trace.jsonl", "tool_observations.jsonl"]


def decoded(content: Column) -> Column:
    """UTF-8 text; bytes that are no UTF-8 are left out."""
    text = content.cast("string")
    repaired = F.replace(F.make_valid_utf8(text), F.lit("�"), F.lit(""))
    return F.when(F.is_valid_utf8(text), text).otherwise(repaired)


def relative_path(path: Column, root: str) -> Column:
    """Path below the root, whatever scheme it is written with."""
    base = "/" + root.split(":", 1)[-1].strip("/") + "/"
    return F.substr(path, F.instr(path, base) + len(base))


def scan_sources(spark: SparkSession, root: str, glob: str = SOURCE_GLOB) -> DataFrame:
    """(path, relative_path, text) of every source file below a folder."""
    rows = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    )
    return rows.select("path", relative_path(F.col("path"), root).alias("relative_path"), decoded(F.col("content")).alias("text"))


def scope_sources(sources: DataFrame) -> DataFrame:
    """Sources below benchmark/scope/... as (graph_id, file, text)."""
    parts = F.split("relative_path", "/")
    rows = sources.filter(F.size(parts) >= 3)
    return rows.select(
        F.concat_ws("__", parts[0], parts[1]).alias("graph_id"), F.array_join(F.slice(parts, F.lit(3), F.size(parts) - 2), "/").alias("file"), "text"
    )


def discover_scopes(paths: DataFrame, path: str, selected: list[str] | None = None) -> DataFrame:
    """Distinct (benchmark, scope, scope_id) with a source file; filtered by either form of the name."""
    parts = F.split(path, "/")
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    rows = paths.filter(suffix.isin("v", "sv", "vh") & (F.size(parts) >= 3)).select(parts[0].alias("benchmark"), parts[1].alias("scope")).distinct()
    rows = rows.withColumn("scope_id", F.concat_ws("__", "benchmark", "scope"))
    if selected:
        rows = rows.filter(F.col("scope_id").isin(*selected) | F.col("scope").isin(*selected))
    return rows


RUN_PATH = r"models[/=]([^/]+)/(?:scope=)?([^/]+)/rep[_=-]?([^/]+)/"


ANSWER_FILE = "final_answer.json"


def scan_run_outputs(spark: SparkSession, root: str, schema: str, model: str | None = None, name: str = ANSWER_FILE) -> DataFrame:
    """One row per stored answer with model, scope and repetition taken from its path.

    An answer is one JSON document of any layout in a file called ``name``; other files beside it are not read, and
    neither are other models' folders. A file that is no JSON fails. ``path`` gives the order of the answers.
    """
    folder = f"{root.rstrip('/')}/models" + (f"/{model}" if model else "")
    options = {"recursiveFileLookup": True, "pathGlobFilter": name, "multiLine": True, "mode": "FAILFAST"}
    rows = spark.read.schema(schema).options(**options).json(folder)
    part = lambda g: F.regexp_extract("_metadata.file_path", RUN_PATH, g)
    return rows.select("*", F.col("_metadata.file_path").alias("path"), part(1).alias("model_family"), part(2).alias("input_scope"), part(3).alias("repetition"))


def successful_runs(manifest: DataFrame) -> DataFrame:
    """Rows of a manifest document (batch_id, runs[]) that succeeded."""
    rows = manifest.select(F.col("batch_id").alias("_b"), F.explode("runs").alias("r")).filter("r.status = 'success'")
    return rows.select(F.coalesce(F.nullif("r.batch_id", F.lit("")), "_b", F.lit("")).alias("batch_id"), *[F.col(f"r.{c}").alias(c) for c in ("run_id", "run_dir", "model_id", "scope_id", "repetition")])


def load_runs(runs: DataFrame, metadata: DataFrame, answers: DataFrame, traces: DataFrame) -> DataFrame:
    """Successful runs with their metadata, answer and trace where these exist."""
    meta = metadata.select("run_dir", F.col("run_id").alias("_mid"), "provider", "model")
    joined = runs.join(meta, "run_dir", "left").join(answers, "run_dir", "left").join(traces, "run_dir", "left")
    name = F.regexp_extract("run_dir", r"([^/]+)/*$", 1)
    return joined.withColumn("run_id", F.coalesce(F.nullif("run_id", F.lit("")), F.nullif("_mid", F.lit("")), name)).drop("_mid")


def resolve_traces(run_dirs: DataFrame, files: DataFrame) -> DataFrame:
    """First existing trace file per run, else the default name; files(run_dir, file_name)."""
    known = files.filter(F.col("file_name").isin(*TRACE_FILES))
    first = known.groupBy("run_dir").agg(F.min(F.array_position(F.array(*[F.lit(t) for t in TRACE_FILES]), F.col("file_name"))).alias("_p"))
    name = F.element_at(F.array(*[F.lit(t) for t in TRACE_FILES]), F.coalesce(F.col("_p").cast("int"), F.lit(1)))
    return run_dirs.join(first, "run_dir", "left").select(
        "run_dir", F.concat_ws("/", "run_dir", name).alias("trace_path"), F.col("_p").isNotNull().alias("trace_exists")
    )
