"""What the operators share: columns, bucket counts and numbering within hot keys."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evigraph.session import persist_table

LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def by_number(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns c0, c1, ... so that no name can clash, and the new name of each old one."""
    names = {old: f"c{i}" for i, old in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    return F.translate(text, *LOWER)


def whole_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def id_bucket(doc_id: str = "doc_id", modulus: int = 10) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


def tasks_for(spark: SparkSession, amount: float, per_task: float, least: int = 64) -> int:
    """How many groups hold ``amount`` when each holds about ``per_task``; never under ``least`` nor the shuffle width."""
    width = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(least, width, math.ceil(amount / per_task))


def rank_within(rows: DataFrame, keys: list[str], order: list[str], name: str = "rank", label: str = "ranks") -> DataFrame:
    """Number rows from 0 within ``keys``: a gapless numbering that a hot key does not put into one task.

    Rows are dealt to slots by a hash of ``order``; a slot is numbered on its own and starts after the slots before it.
    The order is by slot, then by ``order``; rows that agree in all of ``order`` are interchangeable.
    ``rows`` is read twice, so it should be a table.
    """
    slots = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    dealt = rows.withColumn("_slot", F.pmod(F.xxhash64(*order), F.lit(slots)).cast("int"))
    sizes = dealt.groupBy(*keys, "_slot").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)
    starts = persist_table(sizes.select(*keys, "_slot", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")), label)
    within = F.row_number().over(W.partitionBy(*keys, "_slot").orderBy(*order))
    numbered = dealt.withColumn("_within", within).alias("d")
    same = F.col("d._slot") == F.col("s._slot")
    for key in keys:
        same = same & F.col(f"d.{key}").eqNullSafe(F.col(f"s.{key}"))
    return numbered.join(starts.alias("s"), same, "left").select(
        *[F.col(f"d.{c}") for c in rows.columns], (F.col("s._start") + F.col("d._within") - 1).alias(name)
    )
