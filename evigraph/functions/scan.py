"""Ordered scans (numbering, running sums) that survive a hot key.

A plain window sorts all rows of a key in one task, which is right as long as no key is
large: rows are counted by a hash of their keys first. Where a key may be large, rows are
dealt by range over the keys and the whole order, so a key of any size is cut into slices in
order; every slice is scanned on its own and starts from the totals of the slices before it.
The result does not depend on the way taken, nor on where the cuts fall.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evigraph.session import persist_table

#: Rows of a key that one task may sort, and the cells of the hash by which rows are counted.
KEY_ROWS, CELLS = 200_000, 1 << 16


@dataclass(frozen=True)
class Scan:
    kind: str
    value: Column | None = None


def row_no() -> Scan:
    return Scan("row_no")


def running_sum(value: Column) -> Scan:
    return Scan("sum", value)


def max_before(value: Column) -> Scan:
    return Scan("max_before", value)


def last_value(value: Column) -> Scan:
    return Scan("last", value)


def _local(scan: Scan, part) -> Column:
    upto = part.rowsBetween(W.unboundedPreceding, W.currentRow)
    if scan.kind == "row_no":
        return F.row_number().over(part).cast("long")
    if scan.kind == "sum":
        return F.sum(scan.value).over(upto)
    if scan.kind == "max_before":
        return F.max(scan.value).over(part.rowsBetween(W.unboundedPreceding, -1))
    return F.last(scan.value, ignorenulls=True).over(upto)


def most_rows(df: DataFrame, keys: list[str]) -> int:
    """No key has more rows than this: the largest count over the cells of a hash of the keys."""
    cell = F.pmod(F.xxhash64(*keys), F.lit(CELLS)).alias("_cell")
    return df.groupBy(cell).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0


def ordered_scan(
    df: DataFrame, keys: list[str], order: list[Column], outputs: dict[str, Scan], slices: int | None = None
) -> DataFrame:
    """Add one column per scan over ``order`` within ``keys``; ``slices`` asks for a number of slices, whatever the sizes of keys.

    Rows whose keys are all small are shuffled once, with the columns that are used later. Else the sliced rows are written once,
    as both passes over them must see the same cuts. Only a key that lies across a cut needs totals carried in, which is at most
    one key per cut: that table is broadcast.
    """
    columns = df.columns
    if keys and slices is None and most_rows(df, keys) <= KEY_ROWS:
        whole = W.partitionBy(*keys).orderBy(*order)
        return df.withColumns({name: _local(scan, whole) for name, scan in outputs.items()})
    by = [*[F.col(k) for k in keys], *order]
    dealt = df.repartitionByRange(*by) if slices is None else df.repartitionByRange(slices, *by)
    sliced = persist_table(dealt.withColumn("_slice", F.spark_partition_id()), "ordered")

    part = W.partitionBy(*keys, "_slice").orderBy(*order)
    scanned = sliced.withColumns({name: _local(scan, part) for name, scan in outputs.items()})
    totals = [_total(scan, order).alias(f"_t_{name}") for name, scan in outputs.items()]
    earlier = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    carried = {f"_c_{name}": _carried(scan, F.col(f"_t_{name}"), earlier) for name, scan in outputs.items()}
    ends = sliced.groupBy(*keys, "_slice").agg(*totals).withColumns({"_before": F.count(F.lit(1)).over(earlier), **carried})
    carry = ends.filter("_before > 0").select(*keys, "_slice", *carried)

    s, c = scanned.alias("s"), F.broadcast(carry).alias("c")
    condition = F.col("s._slice") == F.col("c._slice")
    for name in keys:
        condition = condition & F.col(f"s.{name}").eqNullSafe(F.col(f"c.{name}"))
    final = []
    for name, scan in outputs.items():
        own, carry_in = F.col(f"s.{name}"), F.col(f"c._c_{name}")
        if scan.kind in ("row_no", "sum"):
            final.append((own + F.coalesce(carry_in, F.lit(0))).alias(name))
        elif scan.kind == "max_before":
            final.append(F.greatest(own, carry_in).alias(name))
        else:
            final.append(F.coalesce(own, carry_in).alias(name))
    return s.join(c, condition, "left").select(*[F.col(f"s.{n}") for n in columns], *final)


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str, most: int | None = None) -> DataFrame:
    """Adds the place of each row within ``keys``, from 1; only the first ``most`` rows where a limit is given.

    With a limit Spark cuts each key's rows before they are shuffled; without one a key of any size is scanned in slices.
    """
    if most is None:
        return ordered_scan(df, keys, order, {name: row_no()})
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= most)


def _total(scan: Scan, order: list[Column]) -> Column:
    if scan.kind == "row_no":
        return F.count(F.lit(1))
    if scan.kind == "sum":
        return F.sum(scan.value)
    if scan.kind == "max_before":
        return F.max(scan.value)
    return F.max_by(scan.value, F.when(scan.value.isNotNull(), F.struct(*order)))


def _carried(scan: Scan, total: Column, earlier) -> Column:
    if scan.kind in ("row_no", "sum"):
        return F.sum(total).over(earlier)
    if scan.kind == "max_before":
        return F.max(total).over(earlier)
    return F.last(total, ignorenulls=True).over(earlier)
