"""Batches of runs as their folders hold them: manifest, metadata, answer and trace of each run.

Which folders there are follows from the manifest, so nothing is listed: a task opens the files of the folders dealt to it, and the
driver holds none of their names. A file that is not there leaves its default. Traces are read line by line in the same way.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.session import persist_table
from evigraph.sources import lines
from evigraph.sources.files import TRACE_FILES

MANIFEST, METADATA, ANSWER = "batch_manifest.json", "run_metadata.json", "final_answer.json"
RUN_FIELDS = "batch_id:string,run_id:string,run_dir:string,status:string,model_id:string,scope_id:string,provider:string,model:string,repetition:string"
METADATA_FIELDS = "run_id string, provider string, model string, input_scope_path string"


def plain_path(path: Column) -> Column:
    """A path without its scheme and without slashes at its end, so that paths of one store compare."""
    return F.regexp_replace(F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "/"), r"(?<=.)/+$", "")


def _folder(path: Column) -> Column:
    return F.regexp_replace(plain_path(path), "/[^/]*$", "")


def _name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)/*$", 1)


def _batch_root(manifest: Column) -> Column:
    """The folder of a manifest's path; the manifest may be a folder of parts, as Spark writes it."""
    return F.regexp_replace(manifest, "/" + MANIFEST.replace(".", r"\.") + "(/[^/]*)?$", "")


# Characters of text that a task gathers before it hands rows on.
BATCH_CHARS = 8 << 20


class _Store:
    """The files below one root; a task keeps one connection per root."""

    def __init__(self, root: str):
        self.plain = re.sub(r"(?<=.)/+$", "", re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "/", root))
        if self.plain == re.sub(r"(?<=.)/+$", "", root) or root.startswith("file:"):
            self.store, self.base = pafs.LocalFileSystem(), self.plain
        else:
            uri = re.sub(r"^s3[an]:", "s3:", root)
            self.store, self.base = pafs.FileSystem.from_uri(quote(uri, safe=":/@?&=%"))

    def open(self, folder: str, name: str) -> BinaryIO | None:
        """The file of a folder (a plain path) below the root, None where it is not there."""
        inside = folder == self.plain or folder.startswith(self.plain.rstrip("/") + "/")
        below = folder[len(self.plain) :].strip("/").split("/") if inside else [".."]
        if below != [""] and any(part in ("", ".", "..") for part in below):
            return None
        try:
            return self.store.open_input_stream("/".join([self.base.rstrip("/"), *filter(None, below), name]))
        except (FileNotFoundError, NotADirectoryError):
            return None


def _read_folders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    stores: dict[str, _Store] = {}
    columns, rows, chars = ["run_dir", "metadata", "final_answer", "trace"], [], 0
    for batch in batches:
        for root, run_dir in batch.itertuples(index=False):
            store = stores.get(root) or stores.setdefault(root, _Store(root))
            texts = []
            for name in (METADATA, ANSWER):
                found = store.open(run_dir, name)
                if found is None:
                    texts.append(None)
                else:
                    with found:
                        texts.append(found.read().decode("utf-8", "replace"))
            trace = None
            for name in TRACE_FILES:
                found = store.open(run_dir, name)
                if found is not None:
                    found.close()
                    trace = name
                    break
            rows.append((run_dir, *texts, trace))
            chars += sum(len(t or "") for t in texts) + 200
            if chars > BATCH_CHARS:
                yield pd.DataFrame(rows, columns=columns, dtype=object)
                rows, chars = [], 0
    if rows:
        yield pd.DataFrame(rows, columns=columns, dtype=object)


def _read_traces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lines of traces, ended by a line feed and without it, numbered from 0; a byte order mark at the head is left out."""
    stores: dict[str, _Store] = {}
    columns, rows, chars = ["run_id", "file", "line_ord", "value"], [], 0
    for batch in batches:
        for run_id, root, file in batch.itertuples(index=False):
            store = stores.get(root) or stores.setdefault(root, _Store(root))
            found = store.open(*file.rsplit("/", 1))
            if found is None:
                raise FileNotFoundError(file)
            with io.BufferedReader(found) as file_lines:
                for no, line in enumerate(file_lines):
                    text = line.removesuffix(b"\n").decode("utf-8", "replace")
                    rows.append((run_id, file, no, text.removeprefix(lines.BYTE_ORDER_MARK) if no == 0 else text))
                    chars += len(text) + 200
                    if chars > BATCH_CHARS:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, chars = [], 0
    if rows:
        yield pd.DataFrame(rows, columns=columns)


def run_folders(folders: DataFrame) -> DataFrame:
    """folders(root, run_dir) to (run_dir, metadata, final_answer, trace_path, trace_exists), one row per folder below its root.

    Metadata and answer are JSON texts, null where there is no file. Folders are shared out over tasks, which open their files.
    """
    read = folders.select("root", "run_dir").distinct().mapInPandas(_read_folders, "run_dir string, metadata string, final_answer string, trace string")
    name = F.coalesce("trace", F.lit(TRACE_FILES[0]))
    found = read.select("run_dir", "metadata", "final_answer", F.concat_ws("/", "run_dir", name).alias("trace_path"), F.col("trace").isNotNull().alias("trace_exists"))
    # Spark takes the texts for as small as the paths that they are read from; a join must not broadcast them
    return found.hint("merge")


def _described(rows: DataFrame) -> DataFrame:
    """``rows`` with the fields of their metadata as ``m``; a text that is no JSON object fails."""
    return rows.withColumn("m", F.from_json("metadata", METADATA_FIELDS, {"mode": "FAILFAST"}))


def load_batch(spark: SparkSession, root: str) -> DataFrame:
    """One row per successful run of the batch's manifest, in its order (``ord``), with what its folder holds.

    The manifest has to be there; a run whose folder is gone has no metadata, no answer and no trace. An id, provider or model that the
    manifest does not name is taken from the metadata, an id at last from the folder's name.
    """
    document = spark.read.schema(f"batch_id string, runs array<struct<{RUN_FIELDS}>>").options(multiLine=True, mode="FAILFAST").json(f"{root.rstrip('/')}/{MANIFEST}")
    here = _batch_root(lines.file_path()).alias("root")
    listed = document.select(F.col("batch_id").alias("_batch"), here, F.posexplode("runs").alias("ord", "r")).filter("r.status = 'success'")
    runs = persist_table(listed.withColumn("run_dir", plain_path(F.col("r.run_dir"))), "listed-runs")
    rows = _described(runs.join(run_folders(runs.filter("run_dir IS NOT NULL")), "run_dir", "left"))
    named = lambda *columns: F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns], F.lit(""))
    return rows.select(
        "ord",
        named("r.batch_id", "_batch").alias("batch_id"),
        F.coalesce(F.nullif("r.run_id", F.lit("")), F.nullif("m.run_id", F.lit("")), _name(F.col("run_dir"))).alias("run_id"),
        "run_dir",
        F.coalesce("r.model_id", F.lit("")).alias("model_id"),
        F.coalesce("r.provider", "m.provider", F.lit("")).alias("provider"),
        F.coalesce("r.model", "m.model", F.lit("")).alias("model"),
        F.coalesce("r.scope_id", F.lit("")).alias("input_scope"),
        F.col("r.repetition").try_cast("int").alias("repetition"),
        "metadata",
        "final_answer",
        F.coalesce("trace_path", F.concat_ws("/", "run_dir", F.lit(TRACE_FILES[0]))).alias("trace_path"),
        F.coalesce("trace_exists", F.lit(False)).alias("trace_exists"),
    )


def load_run(spark: SparkSession, run_dir: str) -> DataFrame:
    """The one run of a folder, in the columns of ``load_batch``; its metadata has to be there."""
    folder = run_dir.rstrip("/")
    read = spark.read.text(f"{folder}/{METADATA}", wholetext=True)
    here = F.regexp_replace(lines.file_path(), "/[^/]*$", "").alias("root")
    metadata = read.select(F.col("value").alias("metadata"), here, _folder(lines.file_path()).alias("run_dir"))
    rows = _described(metadata.join(run_folders(metadata).drop("metadata"), "run_dir", "left"))
    text = lambda name: F.coalesce(name, F.lit(""))
    return rows.select(
        F.lit(0).alias("ord"),
        F.lit("").alias("batch_id"),
        F.coalesce(F.nullif("m.run_id", F.lit("")), _name(F.col("run_dir"))).alias("run_id"),
        "run_dir",
        text("m.provider").alias("model_id"),
        text("m.provider").alias("provider"),
        text("m.model").alias("model"),
        _name(text("m.input_scope_path")).alias("input_scope"),
        F.lit(None).cast("int").alias("repetition"),
        "metadata", "final_answer", "trace_path", "trace_exists",
    )


def trace_rows(spark: SparkSession, root: str, runs: DataFrame, schema: str) -> DataFrame:
    """(run_id, line_ord, fields): the lines of each run's trace; a line that holds no object fails. Blank lines are skipped."""
    manifest = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/{MANIFEST}").select(_batch_root(lines.file_path()).alias("root"))
    here = F.lit(manifest.first()["root"]).alias("root")
    wanted = runs.filter("trace_exists").select("run_id", here, F.col("trace_path").alias("file"))
    read = wanted.mapInPandas(_read_traces, "run_id string, file string, line_ord long, value string")
    zero = F.lit(0).cast("long")
    text = read.select("run_id", "file", zero.alias("file_ord"), "line_ord", zero.alias("ord"), "value")
    return lines.json_records(text, schema, keep=["run_id"]).drop("file_ord", "ord")
