"""Closed ranges of whole numbers as dyadic nodes: node k of level l is the numbers from k * 2^l to (k + 1) * 2^l - 1.

A range is the disjoint union of at most two nodes a level, and a number lies in one node of each level. So a range holds a
number if and only if exactly one node of the range is an ancestor of the number, and ranges meet numbers by equality of nodes,
with rows that grow with the logarithm of a range's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE = "struct<level:int,node:bigint>"


def _shift(value: Column, level: Column) -> Column:
    return F.call_function("shiftright", value, level)


def range_nodes(start: Column, end: Column, levels: int) -> Column:
    """The nodes that a closed range is made of, none for an empty or null one; it must be shorter than 2^levels."""
    a, b = start.cast("bigint"), end.cast("bigint") + 1

    def at(level: Column) -> Column:
        first = _shift(a + F.call_function("shiftleft", F.lit(1).cast("bigint"), level) - 1, level)
        last = _shift(b, level)
        some = first < last
        left = F.when(some & (first.bitwiseAND(1) == 1), F.struct(level.alias("level"), first.alias("node")))
        right = F.when(some & (last.bitwiseAND(1) == 1), F.struct(level.alias("level"), (last - 1).alias("node")))
        return F.array(left, right)

    found = F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), at)), lambda x: x.isNotNull())
    return F.when(end >= start, found).otherwise(F.array().cast(f"array<{NODE}>"))


def number_nodes(number: Column, levels: int) -> Column:
    """The nodes up to level ``levels`` that hold a number, none for null."""
    value = number.cast("bigint")
    found = F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda level: F.struct(level.alias("level"), _shift(value, level).alias("node")))
    return F.when(value.isNotNull(), found).otherwise(F.array().cast(f"array<{NODE}>"))


def levels_of(ranges: DataFrame, start: str, end: str) -> int:
    """The highest level that any of the ranges can have a node of; the one number read is the greatest length."""
    return int(ranges.agg(F.max(F.col(end).cast("bigint") - F.col(start).cast("bigint") + 1)).first()[0] or 1).bit_length()
