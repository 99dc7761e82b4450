"""N-gram Jaccard join by filters under several global orders of the shingles.

Equal shingle sets are one point. Under any order of all shingles, two similar sets agree in a certain number of the first
ones of each. The first two orders are by hash, ascending and descending: a set stays only if enough shingles of its prefix
stand in another set's prefix as well, which leaves few sets. The third order is by rarity among those: sets that share a
prefix shingle become candidates if lengths, positions and a bitmap of their shingles allow the similarity. A candidate then
has to share enough of its prefixes under the first two orders, and is verified on the whole sets.

Only links between components are looked for: three centres of each prefix shingle are compared with its other sets, and
then only sets of different components meet. No link between different components is left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.llm import blocks as B
from evigraph.llm.common import by_number, whole_text
from evigraph.llm.components import components
from evigraph.session import persist_table

MAP_BITS = 1024


@dataclass(frozen=True)
class Settings:
    """Sets of ``shingle`` words link at ``percent`` of their union; ``extra`` (percent of a set) shingles lengthen the hash prefixes."""

    shingle: int = 4
    percent: int = 85
    extra: int = 8
    centres: int = 3


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b))


def least_common(n: Column, s: Settings) -> Column:
    """The least that a set of ``n`` shares with any set similar to it; also the least size of such a set."""
    return _div(n * s.percent + 99, 100)


def asked(n: Column, s: Settings) -> Column:
    """How many shingles of their lengthened prefixes two similar sets share at least, ``n`` being the size of the smaller one."""
    return _div(n * s.extra, 100) + 1


def prefix_size(n: Column, s: Settings) -> Column:
    return n - least_common(n, s) + asked(n, s)


class Sets:
    """The distinct shingle hashes of each text, ascending."""

    def __init__(self, texts: list[str], shingle: int):
        hashes, counts = B.word_hashes(texts, lower=True)
        ends = np.cumsum(counts)
        starts = ends - counts
        room = np.where(counts > 0, np.maximum(counts - shingle + 1, 1), 0)
        doc = np.repeat(np.arange(len(texts)), room)
        first = np.arange(room.sum()) - np.repeat(np.cumsum(room) - room, room) + starts[doc]
        last = np.minimum(first + shingle, ends[doc])
        values = B.Rolling(hashes).slices(first, last)
        order = np.lexsort((values, doc))
        values, doc = values[order], doc[order]
        new = np.ones(len(values), dtype=bool)
        new[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
        self.values = values[new]
        self.sizes = np.bincount(doc[new], minlength=len(texts))
        self.starts = np.cumsum(self.sizes) - self.sizes

    def of(self, i: int) -> np.ndarray:
        return self.values[self.starts[i] : self.starts[i] + self.sizes[i]]


def _prefix_size(n: int, s: Settings) -> int:
    return n - -(-n * s.percent // 100) + n * s.extra // 100 + 1 if n else 0


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *parts])))


def _portions(batches: Iterator[pa.RecordBatch], chars: int = 1 << 22) -> Iterator[tuple[pa.Array, list[str]]]:
    """(ids, texts) of a few rows at a time; null text is empty."""
    for batch in batches:
        texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
        at, size = 0, 0
        for i, text in enumerate(texts):
            size += len(text)
            if size >= chars or i + 1 == len(texts):
                yield batch.column(0).slice(at, i + 1 - at), texts[at : i + 1]
                at, size = i + 1, 0


def marked(docs: DataFrame, settings: Settings = Settings(), with_text: bool = False) -> DataFrame:
    """(doc_id, n, digest, low[, text_sha256]): size and digest of each row's set, and its lengthened prefix by ascending hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _portions(batches):
            sets = Sets(texts, settings.shingle)
            found = [sets.of(i) for i in range(len(texts))]
            digests = pa.array([hashlib.blake2b(v.tobytes(), digest_size=16).digest() for v in found], pa.binary())
            low = _lists([v[: _prefix_size(len(v), settings)].view(np.int64) for v in found])
            more = [pa.array([hashlib.sha256(t.encode()).digest() for t in texts], pa.binary())] if with_text else []
            yield pa.RecordBatch.from_arrays([ids, pa.array(sets.sizes), digests, low, *more], names)

    schema = "doc_id long, n long, digest binary, low array<long>" + (", text_sha256 binary" if with_text else "")
    names = [part.split()[0] for part in schema.split(", ")]
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def whole_sets(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(digest, n, shingles, bits): the whole set by ascending hash, and the parity of its shingles in each of 1024 cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _portions(batches):
            sets = Sets(texts, settings.shingle)
            found = [sets.of(i) for i in range(len(texts))]
            digests = pa.array([hashlib.blake2b(v.tobytes(), digest_size=16).digest() for v in found], pa.binary())
            odd = [np.bincount((v % np.uint64(MAP_BITS)).astype(np.int64), minlength=MAP_BITS) % 2 for v in found]
            bits = _lists([np.packbits(x.astype(np.uint8)).view(np.int64) for x in odd])
            yield pa.RecordBatch.from_arrays([digests, pa.array(sets.sizes), _lists([v.view(np.int64) for v in found]), bits], ["digest", "n", "shingles", "bits"])

    return docs.select(F.lit(None).cast("long"), "text").mapInArrow(run, "digest binary, n long, shingles array<long>, bits array<long>")


def by_low_prefix(rows: DataFrame, classes: DataFrame, settings: Settings) -> DataFrame:
    """The classes whose sets share enough of their prefix by ascending hash with other sets.

    A shingle is shared if it stands in the prefixes of two different sets; copies count their prefix once each, so the sum over
    a class is compared with as many times what one needs.
    """
    name = F.xxhash64("digest")
    shingles = rows.filter("n > 0").select(name.alias("name"), F.explode("low").alias("shingle"))
    seen = shingles.groupBy("shingle").agg(F.min("name").alias("least"), F.max("name").alias("most"))
    shared = persist_table(seen.filter("least <> most").select("shingle"), "shared")
    hits = shingles.join(shared, "shingle", "left_semi").groupBy("name").agg(F.count(F.lit(1)).alias("hits"))
    enough = F.col("hits") >= F.col("copies") * asked(least_common(F.col("n"), settings), settings)
    return classes.withColumn("name", name).join(hits, "name").filter(enough).select(*classes.columns)


def by_high_prefix(sets: DataFrame, settings: Settings) -> DataFrame:
    """The points (point) that share enough of their prefix by descending hash with other points."""
    size = prefix_size(F.col("n"), settings)
    shingles = sets.select("point", "n", F.explode(F.slice("shingles", F.col("n") - size + 1, size)).alias("shingle"))
    shared = persist_table(shingles.groupBy("shingle").count().filter("count > 1").select("shingle"), "shared")
    hits = shingles.join(shared, "shingle", "left_semi").groupBy("point", "n").agg(F.count(F.lit(1)).alias("hits"))
    return hits.filter(F.col("hits") >= asked(least_common(F.col("n"), settings), settings)).select("point")


def rare_prefixes(sets: DataFrame, settings: Settings) -> DataFrame:
    """(shingle, point, n, place, bits): the prefix by rarity, with how many shingles of the set come before.

    Shingles of one set alone come first and cannot meet another set, so they only take places.
    """
    shingles = sets.select("point", "n", F.explode("shingles").alias("shingle"))
    known = persist_table(shingles.groupBy("shingle").agg(F.count(F.lit(1)).alias("sets")).filter("sets > 1"), "rarity")
    lists = shingles.join(known, "shingle").groupBy("point", "n").agg(F.sort_array(F.collect_list(F.struct("sets", "shingle"))).alias("common"))
    placed = lists.withColumn("alone", F.col("n") - F.size("common"))
    length = F.col("n") - least_common(F.col("n"), settings) + 1 - F.col("alone")
    kept = placed.filter(length > 0).select("point", "n", "alone", F.posexplode(F.slice("common", F.lit(1), length.cast("int"))).alias("i", "at"))
    rows = kept.select("point", "n", (F.col("alone") + F.col("i")).alias("place"), F.col("at.shingle").alias("shingle"))
    return rows.join(sets.select("point", "bits"), "point")


def may_link(x: str, y: str, settings: Settings) -> Column:
    """Whether sets that first meet at this shingle can be similar: by length, by place and by the bitmaps.

    ``most`` shingles in all may stand in one of the two sets only; those before the first common one do, and each cell whose
    parity differs holds at least one.
    """
    n, m, p, q = F.col(f"{x}.n"), F.col(f"{y}.n"), F.col(f"{x}.place"), F.col(f"{y}.place")
    most = _div((n + m) * (100 - settings.percent), 100 + settings.percent)
    lengths = 100 * F.least(n, m) >= settings.percent * F.greatest(n, m)
    places = (2 * p + m - n <= most) & (2 * q + n - m <= most) & (p + q <= most)
    cells = sum((F.bit_count(F.col(f"{x}.bits")[i].bitwiseXOR(F.col(f"{y}.bits")[i])) for i in range(1, MAP_BITS // 64)), F.bit_count(F.col(f"{x}.bits")[0].bitwiseXOR(F.col(f"{y}.bits")[0])))
    return lengths & places & (cells <= most)


def _pairs(joined: DataFrame) -> DataFrame:
    return joined.select(F.least("x.point", "y.point").alias("a"), F.greatest("x.point", "y.point").alias("b")).distinct()


def verified(pairs: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """The pairs (a, b) that share enough under both hash orders and whose whole sets are similar."""
    sides = [sets.select(F.col("point").alias(c), F.col("n").alias(f"{c}_n"), F.col("shingles").alias(f"{c}_s")) for c in "ab"]
    both = pairs.join(sides[0], "a").join(sides[1], "b")
    n, m = F.col("a_n"), F.col("b_n")
    p, q, needed = prefix_size(n, settings), prefix_size(m, settings), asked(F.least(n, m), settings)
    low = F.size(F.array_intersect(F.slice("a_s", F.lit(1), p.cast("int")), F.slice("b_s", F.lit(1), q.cast("int"))))
    high = F.size(F.array_intersect(F.slice("a_s", (n - p + 1).cast("int"), p.cast("int")), F.slice("b_s", (m - q + 1).cast("int"), q.cast("int"))))
    common = F.size(F.array_intersect("a_s", "b_s"))
    return both.filter((low >= needed) & (high >= needed)).filter(100 * common >= settings.percent * (n + m - common)).select("a", "b")


def links(sets: DataFrame, settings: Settings = Settings(), close: DataFrame | None = None) -> DataFrame:
    """(a, b): similar pairs of points that join every component; ``sets`` is a table of point, n, shingles and bits, all points distinct.

    ``close`` may hold pairs (a, b) that another method takes for similar. They are verified first, and only sets that these
    do not join are looked for among the prefixes.
    """
    rows, known, apart = rare_prefixes(sets, settings), None, F.lit(True)
    if close is not None:
        known = persist_table(verified(close, sets, settings), "close-links")
        joined = components(known).select(F.col("node").alias("point"), F.col("root").alias("known"))
        rows = rows.join(joined, "point", "left").withColumn("known", F.coalesce("known", "point"))
        apart = F.col("x.known") != F.col("y.known")
    rows = persist_table(rows, "prefixes", "none")
    held = F.struct(*[c for c in rows.columns if c != "shingle"])
    middle = [F.min_by(held, F.xxhash64("point", F.lit(k))).alias(f"m{k}") for k in range(settings.centres)]
    meeting = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("sets"), *middle).filter("sets > 1")
    centres = meeting.select("shingle", F.explode(F.array(*[f"m{k}" for k in range(settings.centres)])).alias("m")).select("shingle", "m.*").distinct()
    x, y = rows.alias("x"), persist_table(centres, "centres").alias("y")
    near = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.point") != F.col("y.point")) & apart & may_link("x", "y", settings))
    first = persist_table(verified(persist_table(_pairs(near), "pairs"), sets, settings), "links")
    first = first if known is None else first.union(known)

    roots = components(first).withColumnRenamed("node", "point")
    # the components of the guessed pairs are part of these
    grouped = persist_table(rows.drop("known").join(roots, "point", "left").withColumn("root", F.coalesce("root", "point")), "grouped")
    several = grouped.groupBy("shingle").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least <> most").select("shingle")
    left = persist_table(grouped.join(persist_table(several, "several"), "shingle", "left_semi"), "open")
    x, y = left.alias("x"), left.alias("y")
    apart = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.point") < F.col("y.point")) & (F.col("x.root") != F.col("y.root"))
    rest = x.join(y, apart & may_link("x", "y", settings))
    return first.union(persist_table(verified(persist_table(_pairs(rest), "pairs"), sets, settings), "links"))


#: Near copies share four fifths of their runs of five words.
NEAR_COPIES = Settings(shingle=5, percent=80)


def one_of_each(docs: DataFrame, settings: Settings = NEAR_COPIES, close: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``docs`` with the rows of the smallest doc_id of each group of similar texts, all columns kept.

    Rows without an id or without a word stay. It is decided per row: a doc_id that also stands on another text goes only where its
    own group has a smaller one.
    """
    found = similar_groups(docs, settings, True, close).filter("doc_id > component_id")
    gone = persist_table(found.select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).distinct(), "gone").alias("g")
    rows, names = by_number(docs)
    own = F.unhex(F.sha2(whole_text(names["text"]).cast("binary"), 256))
    same = (F.col(f"r.{names['doc_id']}") == F.col("g._id")) & (F.col("r._own") == F.col("g._sha"))
    return rows.withColumn("_own", own).alias("r").join(gone, same, "left_anti").select(*[F.col(f"r.{c}") for c in names.values()]).toDF(*names)


def similar_groups(
    docs: DataFrame, settings: Settings = Settings(), with_text: bool = False, close: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """(doc_id, n_shingles, component_id[, text_sha256]), one row per row of ``docs``.

    Sets of at least ``percent`` similarity are linked; component_id is the smallest doc_id reachable, the own one at most.
    Null, empty and blank texts have no shingle and are linked with nothing. A null doc_id never names a component unless it
    has no other. Repeated rows and equal sets are of one component. Texts of any length are read whole; shingles stand for
    themselves by 64 bits of hash, whole sets by 128. Only doc_id and text are read, so other columns cannot clash. An empty table
    gives no rows. ``close`` may give the pairs to verify first, see ``links``, from a table (point, text_sha256) of the texts of each point.
    """
    rows = persist_table(marked(docs, settings, with_text or close is not None), "marked", "none")
    classes = persist_table(rows.filter("n > 0").groupBy("digest", "n").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")), "classes")
    kept = persist_table(by_low_prefix(rows, classes, settings).select("digest", "first"), "low")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").alias("t")
    owners = kept.select("first").distinct().alias("k")
    chosen = texts.join(owners, F.col("t.doc_id").eqNullSafe(F.col("k.first")), "left_semi")
    found = whole_sets(chosen, settings).join(kept.select("digest"), "digest", "left_semi").dropDuplicates(["digest"])
    sets = persist_table(found.withColumn("point", F.monotonically_increasing_id()), "sets", "none")
    alive = persist_table(by_high_prefix(sets, settings), "high")
    able = persist_table(sets.join(alive, "point", "left_semi"), "able", "none")

    guessed = None if close is None else close(persist_table(able.select("point", "digest").join(rows.select("digest", "text_sha256"), "digest").select("point", "text_sha256").distinct(), "asked"))
    roots = components(persist_table(links(able, settings, guessed), "near"))
    linked = roots.select(F.col("node").alias("point"), "root").union(roots.select(F.col("root").alias("point"), "root").distinct())
    named = persist_table(linked.join(able.select("point", "digest"), "point").select("digest", "root"), "linked")
    members = classes.join(named, "digest", "left").filter("root IS NOT NULL OR copies > 1")
    key = F.when(F.col("root").isNull(), F.col("digest")).otherwise(F.col("root").cast("string").cast("binary"))
    members = persist_table(members.select("digest", "first", key.alias("key")), "members")
    firsts = persist_table(members.groupBy("key").agg(F.min("first").alias("component_id")), "firsts")
    final = persist_table(members.join(firsts, "key").select("digest", "component_id", F.lit(True).alias("_in")), "named")
    component = F.when(F.col("_in"), F.col("component_id")).otherwise(F.col("doc_id"))
    more = ["text_sha256"] if with_text else []
    return rows.select("doc_id", "n", "digest", *more).join(final, "digest", "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), *more)
