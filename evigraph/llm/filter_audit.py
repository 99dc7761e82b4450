"""How filters interact: what each removes at each place of each order, and its fair share of all removals.

The removal game of a part gives every coalition of filters the number of documents that fail at least one of its
members. Steps of an order are differences between two coalitions. Shares come from the potential of the game: the potential
of a coalition is its value plus the potentials of the coalitions one filter smaller, divided by its size, and the share of a
filter is the potential of all filters minus the potential without that one. Documents are counted once, by the set of
filters that they fail; everything after that works on one row per part and set.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evigraph.llm.common import whole_text

SPACES = r"[\x20\x09-\x0D]+"
#: Name of the filter that removes copies; it needs the whole table, the others only the text.
COPY = "E"


@dataclass(frozen=True)
class Limits:
    """A: fewer words than ``least_words``; B: distinct words under a share, in percent; C: capitals over a share, in percent; D: symbols."""

    least_words: int = 200
    distinct_percent: int = 50
    capital_percent: int = 3
    symbols: str = "#$%&*|"


def text_filters(text: Column, limits: Limits = Limits()) -> dict[str, Column]:
    """Failure conditions A to D of a text that is not null, by name."""
    words = F.array_remove(F.split(text, SPACES), "")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": F.size(words) < limits.least_words,
        "B": 100 * F.size(F.array_distinct(words)) < limits.distinct_percent * F.size(words),
        "C": 100 * capitals > limits.capital_percent * F.length(text),
        "D": F.translate(text, limits.symbols, "") != text,
    }


def outcomes(labels: DataFrame) -> DataFrame:
    """(doc_id, good, toxic), one row per id: good if any of its rows has quality 1, toxic if any has toxic 1."""
    marks = [F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))]
    return labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(*marks)


def failures(docs: DataFrame, labels: DataFrame, filters: dict[str, Column]) -> DataFrame:
    """(part, mask, good, toxic, n): documents by the set of filters that they fail, bit i for the i-th filter, the last for copies.

    ``filters`` are conditions on a column ``text``. All documents with one text agree on these, so a text needs a count
    per part and label and its smallest doc_id; no row is joined with the group of its copies.
    """
    mask = sum((F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(filters.values())), F.lit(0))
    read = docs.select(F.col("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), whole_text().alias("text"))
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    rows = read.select("doc_id", "part", mask.alias("mask"), digest.alias("digest")).groupBy("digest", "doc_id", "part", "mask")
    named = rows.agg(F.count(F.lit(1)).alias("n")).join(outcomes(labels), "doc_id", "left")
    marked = named.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    texts = marked.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"),
        F.min("doc_id").alias("first"),
        F.min_by("n", "doc_id").alias("at_first"),
    )
    least = F.min("first").over(W.partitionBy("digest"))
    stay = F.col("unnamed") + F.when(F.col("first") == least, F.col("at_first")).otherwise(0)
    copy = F.lit(1 << len(filters))
    split = F.array(F.struct(F.col("mask").alias("mask"), F.col("stay").alias("n")), F.struct((F.col("mask") + copy).alias("mask"), (F.col("n") - F.col("stay")).alias("n")))
    sides = texts.withColumn("stay", stay).select("part", "good", "toxic", F.inline(split))
    return sides.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def coalition_values(failed: DataFrame, filters: int) -> DataFrame:
    """(part, total, removed, good, toxic), one row per part: the last three are arrays by coalition, a bit for each member."""
    both = failed.withColumn("coalition", F.explode(F.sequence(F.lit(0), F.lit((1 << filters) - 1))))
    hit = F.col("mask").bitwiseAND(F.col("coalition")) != 0
    sums = {"removed": hit, "good": hit & F.col("good"), "toxic": hit & F.col("toxic")}
    values = both.groupBy("part", "coalition").agg(F.sum("n").alias("total"), *[F.sum(F.when(c, F.col("n")).otherwise(0)).alias(name) for name, c in sums.items()])
    games = values.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("coalition", "total", *sums))).alias("games"))
    return games.select("part", F.col("games")[0]["total"].alias("total"), *[F.col(f"games.{name}").alias(name) for name in sums])


def shares(values: DataFrame, filters: int) -> DataFrame:
    """``values`` with an array ``share``: for each filter what it removes, summed over all orders; always a whole number.

    Potentials are kept times the number of orders, so that the division by the size of the coalition leaves no rest.
    """
    orders, full = math.factorial(filters), (1 << filters) - 1
    members = F.array(*[F.lit(1 << i) for i in range(filters)])

    def potential(known: Column, coalition: Column) -> Column:
        """Of the next coalition; ``known`` has the smaller numbers, and with them all that lack one member."""
        own = F.filter(members, lambda bit: coalition.bitwiseAND(bit) != 0)
        whole = F.aggregate(own, orders * F.col("removed")[coalition], lambda total, bit: total + known[coalition - bit])
        return F.call_function("div", whole, F.size(own))

    empty = F.array(F.lit(0).cast("long"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(full)), empty, lambda known, coalition: F.concat(known, F.array(potential(known, coalition))))
    last = F.transform(members, lambda bit: F.col("potential")[full] - F.col("potential")[F.lit(full) - bit])
    return values.withColumn("potential", found).withColumn("share", last).drop("potential")


def audit(docs: DataFrame, labels: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley), see the head of the module.

    A part is a value of ``lang``, null and empty text together. Null text counts as empty. A null doc_id has no smaller one and
    is smaller than none, so it never fails as a copy; rows that repeat the smallest doc_id of a text do not fail either. Several
    labels of one id count as good or toxic if one of them does; labels without a document are not read. Texts of any length
    are read whole. Only doc_id, text and lang are read of ``docs``, so other columns cannot clash. An empty table gives no rows.
    """
    filters = text_filters(F.col("text"), limits)
    letters, n = "".join(filters) + COPY, len(filters) + 1
    games = shares(coalition_values(failures(docs, labels, filters), n), n)
    orders = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    ordered = games.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    bit = F.transform(F.split("filter_order", ""), lambda x: F.call_function("shiftleft", F.lit(1), F.instr(F.lit(letters), x) - 1))
    steps = ordered.withColumn("bits", bit).withColumns(
        {"own": F.col("bits")[F.col("step") - 1], "before": F.aggregate(F.slice("bits", F.lit(1), F.col("step") - 1), F.lit(0), lambda a, x: a + x)}
    )
    after = F.col("before") + F.col("own")

    def lost(game: str) -> Column:
        return F.col(game)[after] - F.col(game)[F.col("before")]

    full = (1 << n) - 1
    return steps.select(
        "part",
        "filter_order",
        F.col("step").cast("long").alias("step"),
        (F.col("total") - F.col("removed")[after]).alias("kept"),
        lost("removed").alias("removed"),
        (F.col("removed")[F.col("own")] - lost("removed")).alias("redundant"),
        (F.col("removed")[full] - F.col("removed")[F.lit(full) - F.col("own")]).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        F.col("share")[F.instr(F.lit(letters), F.substring("filter_order", F.col("step"), F.lit(1))) - 1].alias("shapley"),
    )
