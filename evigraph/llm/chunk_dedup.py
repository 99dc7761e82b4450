"""Exact deduplication by content-defined chunk recipes, in DataFrame operations only.

A text is cut at places that its own content decides. Each distinct chunk is moved
once, to verify that its digest names one content; documents are then compared by
their ordered lists of chunk identifiers, which are short however long the text is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evigraph.llm.common import by_number, whole_text
from evigraph.session import persist_table

#: A chunk ends at the first sentence or line end after this many characters, at the latest after MAX_CHUNK.
MIN_CHUNK, MAX_CHUNK = 1024, 8192


def sha256_bytes(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def chunks(text: Column, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> Column:
    """The text as an array of chunks whose concatenation is the text; empty for the empty text."""
    pattern = rf"(?s)(.{{{least - 1},{most - 1}}}?[.!?\n]|.{{1,{most}}})"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def exact_groups(
    docs: DataFrame,
    normalise: Callable[[Column], Column] = lambda text: text,
    digest: Callable[[Column], Column] = sha256_bytes,
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of ``docs``.

    Null text counts as empty; all empty texts are one group. The largest doc_id of a group stays; a null doc_id
    is smaller than any other, and in a group of null ids every row is kept. Rows that repeat the kept doc_id with the
    same text are all marked kept. Other columns are not read. An empty table gives no rows.
    """
    prepared = docs.select("doc_id", normalise(whole_text()).alias("_text")).withColumn("_chunks", chunks(F.col("_text")))
    text_digest = F.sha2(F.col("_text").cast("binary"), 256).alias("text_sha256")
    pieces = prepared.select(F.explode("_chunks").alias("chunk")).select(digest(F.col("chunk")).alias("digest"), "chunk")
    clashes = persist_table(pieces.distinct().groupBy("digest").count().filter("count > 1").select("digest"), "clashes")
    if clashes.isEmpty():
        recipes = prepared.select("doc_id", F.transform("_chunks", digest).alias("recipe"), text_digest)
    else:
        recipes = _told_apart(prepared, pieces, clashes, digest, text_digest)
    recipes = persist_table(recipes, "recipes")
    found = recipes.groupBy("recipe").agg(F.max("doc_id").alias("_keep"), F.count(F.lit(1)).alias("_size")).filter("_size > 1")
    groups = persist_table(found, "groups")
    alone = F.col("_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("_keep"))
    return recipes.join(groups, "recipe", "left").select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def _told_apart(prepared: DataFrame, pieces: DataFrame, clashes: DataFrame, digest, text_digest: Column) -> DataFrame:
    """Recipes where some digest names several contents: its identifiers also say which content it is."""
    number = F.row_number().over(W.partitionBy("digest").orderBy("chunk"))
    contents = pieces.distinct().join(clashes, "digest", "left_semi").withColumn("_ordinal", number)
    keyed = persist_table(prepared.select("doc_id", "_chunks", text_digest, F.expr("uuid()").alias("_row")), "chunked")
    parts = keyed.select("_row", F.posexplode("_chunks").alias("_pos", "chunk")).withColumn("digest", digest(F.col("chunk")))
    named = parts.join(contents, ["digest", "chunk"], "left").select(
        "_row", F.struct("_pos", F.concat("digest", F.coalesce("_ordinal", F.lit(0)).cast("string").cast("binary")).alias("id")).alias("_part")
    )
    lists = named.groupBy("_row").agg(F.sort_array(F.collect_list("_part")).alias("_parts"))
    recipe = F.coalesce(F.transform("_parts", lambda x: x["id"]), F.expr("CAST(array() AS array<binary>)"))
    return keyed.join(lists, "_row", "left").select("doc_id", recipe.alias("recipe"), "text_sha256")


def without_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns kept; repeats of the staying row go too."""
    stay = exact_groups(docs).filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).distinct()
    numbered, names = by_number(docs)
    rows = numbered.withColumns({"_id": F.col(names["doc_id"]), "_sha": F.sha2(whole_text(names["text"]).cast("binary"), 256)}).alias("r")
    same = F.col("r._id").eqNullSafe(F.col("s._id")) & (F.col("r._sha") == F.col("s._sha"))
    kept = rows.join(stay.alias("s"), same, "left_semi").dropDuplicates(["_id", "_sha"])
    return kept.select(*names.values()).toDF(*names)
