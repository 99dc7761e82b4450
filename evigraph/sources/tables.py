"""CSV, JSON and JSON-lines tables: explicit schemas, strict and tolerant reading, merging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from evigraph.functions.values import present
from evigraph.sources import lines


def text_schema(columns: list[str]) -> str:
    return ", ".join(f"`{c}` string" for c in columns)


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names in the order of the file; files read together must agree."""
    return spark.read.options(header=True, quote='"', escape='"', encoding="UTF-8").csv(path).columns


def read_csv(spark: SparkSession, path: str, columns: list[str], multi_line: bool = True) -> DataFrame:
    """All-text CSV with columns bound by header name; others are not read, missing cells are ''.

    A byte order mark is dropped. Rows come in the order of the files and their lines. Quoted cells may hold line breaks; a file is
    spread over tasks all the same. Without
    ``multi_line`` every line is taken for a record, which saves the scan that finds where records begin.
    """
    if multi_line:
        return read_csv_ordered(spark, path, columns).sort("ord").drop(*lines.PLACE)
    header = csv_header(spark, path)
    absent = [c for c in columns if c not in header]
    if absent:
        raise ValueError(f"no column {', '.join(absent)} in {path}")
    rows = (
        spark.read.schema(text_schema(header))
        .options(header=True, quote='"', escape='"', emptyValue="", encoding="UTF-8", enforceSchema=False)
        .csv(path)
    )
    return rows.select(*columns).fillna("")


def read_csv_ordered(spark: SparkSession, path: str | list[str], columns: list[str], glob: str | None = None) -> DataFrame:
    """``read_csv`` with the place of each record: file_ord, line_ord (of its first line) and ord, its number among the lines of all files."""
    return lines.csv_cells(lines.csv_records(lines.numbered_lines(spark, path, glob)), columns)


def write_csv(df: DataFrame, path: str, columns: list[str], mode: str = "errorifexists") -> None:
    """Columns in the given order; others are left out, absent ones are ''."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns]
    df.select(*cells).write.mode(mode).options(header=True, quote='"', escape='"', emptyValue="").csv(path)


def read_json(spark: SparkSession, path: str, schema: str, multi_line: bool = True) -> DataFrame:
    """Whole documents: one per file (of any layout), or one per line without ``multi_line``."""
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def _path_exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.text(path)
        return True
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Strict: blank lines are skipped, a missing path is empty, a bad line fails."""
    if not _path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_ordered(spark: SparkSession, path: str | list[str], schema: str, strict: bool = True, glob: str | None = None) -> DataFrame:
    """JSON lines with file_ord, line_ord and ord; a line that holds no object fails, or is dropped where ``strict`` is off."""
    return lines.json_records(lines.numbered_lines(spark, path, glob), schema, strict)


def read_jsonl_tolerant(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines that are no JSON object are dropped, as are blank ones; a missing path is empty."""
    if not _path_exists(spark, path):
        return spark.createDataFrame([], schema)
    lines = spark.read.text(path).filter(F.trim("value") != "")
    listed = F.try_parse_json(F.concat(F.lit("["), "value", F.lit("]")))
    is_object = F.startswith(F.ltrim("value"), F.lit("{")) & listed.isNotNull()
    return lines.filter(is_object).select(F.from_json("value", schema).alias("r")).select("r.*")


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("ignoreNullFields", False).json(path)


def nested_documents(rows: DataFrame, keys: list[str], number: str, items: list[str], per_document: int | None = None) -> DataFrame:
    """Children nested below their parent, whole; ``per_document`` splits a document into numbered parts instead."""
    part = (F.lit(0).cast("long") if per_document is None else F.floor((F.col(number) - 1) / per_document)).alias("part_no")
    gathered = F.array_sort(F.collect_list(F.struct(number, *items)))
    return rows.groupBy(*keys, part).agg(gathered.alias("items"))


def write_nested(documents: DataFrame, path: str, partition: str) -> None:
    documents.write.mode("errorifexists").partitionBy(partition).json(path)


def dynamic_union(tables: list[DataFrame]) -> DataFrame:
    """Union over the first-seen union of columns; absent cells are ''."""
    texts = [t.select(*[F.col(c).cast("string").alias(c) for c in t.columns]) for t in tables]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), texts)
    return rows.fillna("")


def merge_violations(tables: dict[str, DataFrame], expected: list[str], key: list[str], check_fp: bool = False) -> DataFrame:
    """(source, problem, detail) for every broken rule of a strict merge."""
    spark = next(iter(tables.values())).sparkSession
    headers = [(n, "unexpected_columns", ",".join(t.columns)) for n, t in tables.items() if t.columns != expected]
    out = [spark.createDataFrame(headers, "source string, problem string, detail string")]
    usable = {n: t for n, t in tables.items() if set(expected) <= set(t.columns)}
    rows = reduce(DataFrame.unionByName, [t.select(*expected).withColumn("source", F.lit(n)) for n, t in usable.items()])
    scope = present(F.col("input_scope"))
    scopes = rows.groupBy("source").agg(F.count_distinct(scope).alias("_n"), F.min(scope).alias("_a"), F.max(scope).alias("_b"))
    several = F.when(F.col("_n") == 0, "no_scope").when(F.col("_n") > 1, "several_scopes")
    out.append(scopes.select("source", several.alias("problem"), F.coalesce(F.concat_ws(",", "_a", "_b"), F.lit("")).alias("detail")).filter("problem IS NOT NULL"))
    label = F.concat_ws("|", *key)
    out.append(rows.filter(scope.isNull()).select("source", F.lit("missing_scope").alias("problem"), label.alias("detail")))
    repeated = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.max("source").alias("source")).filter("_n > 1")
    out.append(repeated.select("source", F.lit("duplicate_key").alias("problem"), label.alias("detail")))
    if check_fp:
        bad = rows.filter((F.lower(F.trim("detection_match")) == "fp") & present(F.col("matched_case_id")).isNotNull())
        out.append(bad.select("source", F.lit("fp_keeps_case").alias("problem"), label.alias("detail")))
    return reduce(DataFrame.unionByName, out)


def strict_merge(tables: dict[str, DataFrame], expected: list[str], key: list[str], check_fp: bool = False) -> DataFrame:
    """Union in the expected columns; raises on the first broken rule."""
    broken = merge_violations(tables, expected, key, check_fp).first()
    if broken is not None:
        raise ValueError(f"{broken['source']}: {broken['problem']} {broken['detail']}")
    return merge_tables(tables, expected)


def merge_tables(tables: dict[str, DataFrame], expected: list[str]) -> DataFrame:
    """Lenient merge: only the projection to the expected columns."""
    return reduce(
        DataFrame.unionByName,
        [t.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in t.columns else F.lit("").alias(c) for c in expected]) for t in tables.values()],
    )


def last_per_case(rows: DataFrame, case: Column, order: Column) -> DataFrame:
    """Later files and lines replace earlier ones."""
    fields = list(rows.columns)
    return rows.groupBy(case.alias("_case")).agg(F.max_by(F.struct(*fields), order).alias("_r")).select("_r.*")
