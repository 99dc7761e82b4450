"""Lines and records of text files with their place: which file, which line of it, which line of all.

A large file is read in splits by several tasks. A split knows its file and where it begins, and its lines come in order, so
a line's number is its place within the split plus the lines of the splits before it; there is one small row per split. The
lines are written once with these places, and every later step reads that table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evigraph.functions.scan import last_value, ordered_scan, running_sum
from evigraph.session import persist_table

PLACE = ["file_ord", "line_ord", "ord"]
BYTE_ORDER_MARK = "﻿"


def file_path() -> Column:
    """The name of the file that a row was read from, as it was given and not as a URL writes it."""
    encoded = F.col("_metadata.file_path")
    return F.coalesce(F.try_url_decode(F.replace(encoded, F.lit("+"), F.lit("%2B"))), encoded)


def numbered_lines(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """(file, file_ord, line_ord, ord, value): every line, blank ones too, ended by a line feed and without it.

    All numbers begin at 0. Files are numbered in the order of their full names; ``ord`` numbers the lines of all files one after the
    other. A file without a byte has no line and no number. A byte order mark at the head of a file is left out.
    """
    options = {"lineSep": "\n", "recursiveFileLookup": True, **({"pathGlobFilter": glob} if glob else {})}
    read = spark.read.options(**options).text(path)
    rows = read.select("value", file_path().alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"))
    kept = persist_table(rows, "lines")
    splits = kept.groupBy("file", "_block").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    order = ["file", "_block"]
    before = F.coalesce(F.sum("_n").over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    in_file = F.coalesce(F.sum("_n").over(W.partitionBy("file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    number = F.dense_rank().over(W.orderBy("file")) - 1
    starts = splits.select(*order, "_first", before.alias("_before"), in_file.alias("_in_file"), number.cast("long").alias("file_ord"))
    within = F.col("_row") - F.col("_first")
    line = F.col("_in_file") + within
    head = (line == 0) & F.startswith("value", F.lit(BYTE_ORDER_MARK))
    return kept.join(persist_table(starts, "splits"), order).select(
        "file", "file_ord", line.alias("line_ord"), (F.col("_before") + within).alias("ord"), F.when(head, F.substr("value", F.lit(2))).otherwise(F.col("value")).alias("value")
    )


def csv_records(lines: DataFrame) -> DataFrame:
    """(file, file_ord, line_ord, ord, value): records of delimited text, a quoted cell may hold line breaks.

    A line begins a record if an even number of quotes stands before it in its file, however far back, so that files may be
    cut anywhere. Quotes inside a cell have to be doubled and the cell quoted. Places are those of a record's first line;
    records without a character are left out.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    counted = lines.withColumn("_quotes", quotes)
    scanned = ordered_scan(counted, ["file"], [F.col("line_ord")], {"_upto": running_sum(F.col("_quotes"))})
    begins = (F.col("_upto") - F.col("_quotes")) % 2 == 0
    open_after = F.col("_upto") % 2 == 1
    marked = persist_table(scanned.select(*lines.columns, begins.alias("_begins"), open_after.alias("_open")), "marked-lines")
    alone = marked.filter("_begins AND NOT _open").select(*lines.columns)
    parts = marked.filter("NOT _begins OR _open")
    fields = ["file_ord", "line_ord", "ord"]
    first = F.when(F.col("_begins"), F.struct(*fields))
    owned = ordered_scan(parts, ["file"], [F.col("line_ord")], {"_record": last_value(first)})
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_ord", "value"))), lambda x: x["value"]), "\n")
    several = owned.groupBy("file", "_record").agg(joined.alias("value")).select("file", *[F.col(f"_record.{c}").alias(c) for c in fields], "value")
    records = alone.unionByName(several).withColumn("value", F.regexp_replace("value", "\r$", ""))
    return records.filter(F.col("value") != "")


def csv_cells(records: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` as text, bound by the header that every file begins with, and the places of the records.

    Absent cells are ''. Fails if the files disagree on the header or a column is not in it.
    """
    options = {"quote": '"', "escape": '"', "multiLine": "true", "emptyValue": "", "mode": "PERMISSIVE"}
    found = persist_table(records, "records")
    first = found.groupBy("file").agg(F.min("line_ord").alias("line_ord"))
    heads = [r["value"] for r in found.join(first, ["file", "line_ord"], "left_semi").select("value").distinct().limit(2).collect()]
    if not heads:
        raise ValueError("no header")
    if len(heads) > 1:
        raise ValueError(f"files disagree on the header: {heads[0]!r}, {heads[1]!r}")
    header = _header(found.sparkSession, heads[0], options)
    absent = [c for c in columns if c not in header]
    if absent:
        raise ValueError(f"no column {', '.join(absent)} in {', '.join(header)}")
    schema = ", ".join(f"c{i} string" for i in range(len(header)))
    body = found.join(first.withColumnRenamed("line_ord", "_head"), "file").filter(F.col("line_ord") > F.col("_head"))
    cells = body.select(*PLACE, F.from_csv("value", schema, options).alias("r"))
    return cells.select(*[F.coalesce(F.col(f"r.c{header.index(c)}"), F.lit("")).alias(c) for c in columns], *PLACE)


def _header(spark: SparkSession, line: str, options: dict[str, str]) -> list[str]:
    width = line.count(",") + 1
    cells = spark.range(1).select(F.from_csv(F.lit(line), ", ".join(f"c{i} string" for i in range(width)), options).alias("r")).select("r.*").first()
    return [c for c in cells if c is not None]


def json_records(lines: DataFrame, schema: str, strict: bool = True, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns, the fields of ``schema`` and the places, one row per line that holds a JSON object; blank lines are skipped.

    Other lines fail, or are skipped where ``strict`` is off.
    """
    own = keep or []
    full = lines.filter(F.trim("value") != "")
    listed = F.try_parse_json(F.concat(F.lit("["), "value", F.lit("]")))
    is_object = F.startswith(F.ltrim("value"), F.lit("{")) & listed.isNotNull()
    if strict:
        why = F.concat(F.lit("no JSON object: "), "file", F.lit(" line "), F.col("line_ord") + 1)
        checked = full.withColumn("value", F.when(is_object, F.col("value")).otherwise(F.raise_error(why).cast("string")))
    else:
        checked = full.filter(is_object)
    return checked.select(*own, F.from_json("value", schema).alias("r"), *PLACE).select(*own, "r.*", *PLACE)
