"""N-gram Jaccard join with grouped prefixes, and the components of its links.

Two texts link when their sets of 5-word shingles have a Jaccard similarity of
at least 0.8.  Shingles are 64-bit hashes.

* Texts with equal sets are one class, named by the digests of the set.
* The head of a set is its smallest hashes: all of a small set, a quarter of a
  large one.  Linked sets share at least ``least_shared`` of their heads, so a
  class stays only if so many shingles of its head are in other heads.
* Whole sets of the classes that stay are put in one global order, by the number
  of these sets that hold a shingle, then by the shingle.  Linked sets share one
  of the first ``prefix_size``, the prefix.  A shingle that no other set holds
  comes first and isn't indexed, so a set with many such has no prefix at all.
  Classes with identical prefixes and sizes are one group, indexed once.
* Groups that share a prefix shingle meet in a run.  Stars come first: each group
  of a run with the one of it that has the fewest shingles of its own, which is
  nearest to what the run's copies were made from.  What they link is joined into
  components, and only groups of a run in different components are paired.  Pairs
  are filtered by size and by their places in the prefixes, expanded to classes,
  and verified by exact intersection of whole sets.

Nothing is gathered in a task: groups, runs and classes stay rows, aggregated
before the shuffle or joined, and skewed joins are split by Spark.  Pairs of one
run grow with the square only of its *components* of similar size and place; a
shingle that many unlinked sets have is late in the order, and remains in the
prefix of those alone that consist of such ones.
Rows to be picked are broadcast while a count finds them at most
``BROADCAST_ROWS``, and joined by shuffle beyond.

Defined results: a text without words, empty or null, has no shingles and its
own id as component.  A null id takes part in nothing and has a null component.
Repeated rows are one class and get a row each.  Rows that repeat an id with
different texts are one document: each text keeps its links, and all rows of the
id get the smallest id that any of them reaches.  Very long texts are hashed in
runs of about a megabyte.  Ties need no rule: the components don't depend on
order.  Further columns aren't read; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from proofmill.llm.components import components
from proofmill.llm.textscan import LOWER, U64, WINDOW, mix, shingles, slices, word_hashes
from proofmill.session import scratch

SHINGLE = 5
WHOLE_HEAD = 32
HEAD_SHARE = 4
BROADCAST_ROWS = 2_000_000
STARS = 2
Stash = Callable[[DataFrame, str], DataFrame]


def head_size(n: int) -> int:
    """How many smallest hashes of a set of ``n`` are its head."""
    return min(n, max(WHOLE_HEAD, -(-n // HEAD_SHARE)))


def shared_heads(n: int, m: int) -> int:
    """How many shingles the heads of linked sets of these sizes share at least: of the common ones, those beyond a head are at most the larger rest."""
    return (4 * (n + m) + 8) // 9 - max(n - head_size(n), m - head_size(m))


@functools.lru_cache(1 << 16)
def least_shared(n: int) -> int:
    """The least of ``shared_heads`` over all sizes that can link with ``n``: it is near one of the ends or near equal sizes, by rounding at most."""
    low, high = (4 * n + 4) // 5, 5 * n // 4
    near = {m for end in (low, n, high) for m in range(end - 8, end + 9) if low <= m <= high}
    return max(1, min(shared_heads(n, m) for m in near))


def prefix_size(n: Column) -> Column:
    """How many first shingles of a set of ``n``, in a global order, linked sets must share one of."""
    return n - F.floor((4 * n + 4) / 5) + 1


def digest(h: np.ndarray, salt: int) -> int:
    """A hash of a set in its order-free form."""
    total = mix(h ^ WINDOW[salt]).sum(keepdims=True) + np.array([len(h)], U64) * WINDOW[salt + 1]
    return int(mix(total).view(np.int64)[0])


def sets_of(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted shingle hashes of each text."""
    for h in word_hashes(texts, LOWER):
        yield shingles(h, k)


def longs(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    values = np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def set_sizes(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(doc_id, h, n, d1, d2, least, head): size and digests of each set, its head, and how many of the head linked sets share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = list(sets_of(part.column("text"), k))
                cols = [[len(s) for s in sets], [digest(s, 10) for s in sets], [digest(s, 12) for s in sets], [least_shared(len(s)) if len(s) else 0 for s in sets]]
                cols = [part.column("doc_id"), part.column("h"), *(pa.array(c, pa.int64()) for c in cols), longs([s[: head_size(len(s))] for s in sets])]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "h", "n", "d1", "d2", "least", "head"])

    return docs.select("doc_id", "h", "text").mapInArrow(run, "doc_id long, h long, n long, d1 long, d2 long, least long, head array<long>")


def held_by_others(tokens: DataFrame) -> DataFrame:
    """The rows of ``tokens`` whose key another row has too, with ``held``, how many have it.  Counts come first, so that no key is gathered."""
    counts = tokens.groupBy("key").agg(F.count(F.lit(1)).alias("held")).filter("held > 1")
    return tokens.join(counts, "key")


def with_partners(known: DataFrame, classes: DataFrame) -> DataFrame:
    """The classes so many of whose head's shingles are in other heads that they may link with one."""
    heads = known.groupBy("n", "d1", "d2").agg(F.first("head").alias("head"))
    tokens = heads.select("d1", F.explode("head").alias("key"))
    # Two classes with one first digest would count together, and stay.
    shared = held_by_others(tokens).groupBy("d1").agg(F.count(F.lit(1)).alias("shared"))
    return classes.join(shared, "d1").filter("shared >= least").drop("shared")


def whole_sets(classes: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(cls, n, whole) of each class, made from one text of it."""
    rows = classes.select("cls", F.col("rep.doc_id").alias("doc_id"), F.col("rep.h").alias("h"))
    texts = docs.join(few(rows), ["doc_id", "h"]).groupBy("cls").agg(F.first("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = list(sets_of(part.column("text"), k))
                yield pa.RecordBatch.from_arrays([part.column("cls"), pa.array([len(s) for s in sets], pa.int64()), longs(sets)], names=["cls", "n", "whole"])

    return texts.select("cls", "text").mapInArrow(run, "cls long, n long, whole array<long>")


def prefixes(sets: DataFrame) -> DataFrame:
    """(cls, n, own, key, rank): the prefix shingles of each set that another set holds too, with their ranks; ``own`` counts those that none does, which come first."""
    of = Window.partitionBy("cls", "n")
    ranked = held_by_others(sets.select("cls", "n", F.explode("whole").alias("key")))
    ranked = ranked.withColumn("r", F.row_number().over(of.orderBy("held", "key"))).withColumn("own", F.col("n") - F.count(F.lit(1)).over(of))
    return ranked.select("cls", "n", "own", "key", (F.col("own") + F.col("r")).alias("rank")).filter(F.col("rank") <= prefix_size(F.col("n")))


def same_prefixes(kept: DataFrame, stash: Stash) -> DataFrame:
    """(cls, grp): classes with identical prefixes and sizes go by the least of them."""
    prefix = F.xxhash64("n", "own", F.array_sort(F.collect_list(F.struct("rank", "key"))))
    shapes = stash(kept.groupBy("cls", "n", "own").agg(prefix.alias("p")), "shapes")
    least = shapes.groupBy("n", "own", "p").agg(F.min("cls").alias("grp"))
    return shapes.join(least, ["n", "own", "p"]).select("cls", "grp")


def few(rows: DataFrame) -> DataFrame:
    """``rows``, for broadcast if a count finds them few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def possible(nx: Column, ny: Column, rest_x: Column, rest_y: Column) -> Column:
    """Whether sets of these sizes can link that have so many shingles after their first shared one."""
    return (5 * F.least(nx, ny) >= 4 * F.greatest(nx, ny)) & (9 * (1 + F.least(rest_x, rest_y)) >= 4 * (nx + ny))


def verify(pairs: DataFrame, sets: DataFrame, stash: Stash) -> DataFrame:
    """The pairs (a, b) of classes whose sets are similar enough."""
    pairs = stash(pairs.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    both = pairs.join(sets.select(F.col("cls").alias("a"), F.col("whole").alias("wa")), "a").join(sets.select(F.col("cls").alias("b"), F.col("whole").alias("wb")), "b")
    return stash(both.filter(9 * F.size(F.array_intersect("wa", "wb")) >= 4 * (F.size("wa") + F.size("wb"))).select("a", "b"), "links")


def tint(grp: Column, low: Column, high: Column) -> Column:
    """What a group's pairs are skipped by: the component of a pure group, or a mixed group itself, whatever the signs of the ids."""
    return F.struct((low == high).alias("pure"), F.when(low == high, low).otherwise(grp).alias("id"))


def tinted(rows: DataFrame, labelled: DataFrame) -> DataFrame:
    """The rows of runs that hold more than one tint, each with its own."""
    of = labelled.groupBy("grp").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).select("grp", tint(F.col("grp"), F.col("low"), F.col("high")).alias("tint"))
    out = rows.join(of, "grp")
    least = out.groupBy("key").agg(F.min("tint").alias("least"), F.max("tint").alias("most")).filter("least <> most").select("key")
    return out.join(least, "key")


def stars(rows: DataFrame, turn: int) -> DataFrame:
    """(a, b): each group of a run with one group of it, if they differ in tint and can link.  In the first turn that is the one with the smallest share of shingles of its own."""
    by = F.struct(F.col("own") / F.col("n") if turn == 0 else F.lit(0.0), F.xxhash64("grp", F.lit(turn)))
    centers = rows.groupBy("key").agg(F.min_by(F.struct("grp", "n", "rest", "tint"), by).alias("c")).select("key", "c.*")
    fits = possible(F.col("x.n"), F.col("y.n"), F.col("x.rest"), F.col("y.rest"))
    met = rows.alias("x").join(centers.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.tint") != F.col("y.tint")) & fits)
    return met.select(F.col("x.grp").alias("a"), F.col("y.grp").alias("b")).distinct()


def crossings(rows: DataFrame) -> DataFrame:
    """(ga, gb): all groups of a run that differ in tint and can link.  Tints meet first, by what is best for a link among their groups, then the groups of those that can."""
    best = rows.groupBy("key", "tint").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("rest").alias("rest"))
    s, t = best.alias("s"), best.alias("t")
    near = (5 * F.col("s.high") >= 4 * F.col("t.low")) & (5 * F.col("t.high") >= 4 * F.col("s.low"))
    enough = 9 * (1 + F.least("s.rest", "t.rest")) >= 4 * (F.col("s.low") + F.col("t.low"))
    of = s.join(t, (F.col("s.key") == F.col("t.key")) & (F.col("s.tint") < F.col("t.tint")) & near & enough)
    of = of.select("s.key", F.col("s.tint").alias("ta"), F.col("t.tint").alias("tb")).alias("of")
    met = of.join(rows.alias("x"), (F.col("of.key") == F.col("x.key")) & (F.col("of.ta") == F.col("x.tint")))
    fits = possible(F.col("x.n"), F.col("y.n"), F.col("x.rest"), F.col("y.rest"))
    met = met.join(rows.alias("y"), (F.col("of.key") == F.col("y.key")) & (F.col("of.tb") == F.col("y.tint")) & fits)
    return met.select(F.col("x.grp").alias("ga"), F.col("y.grp").alias("gb")).distinct()


def link(docs: DataFrame, k: int, stash: Stash) -> DataFrame:
    """(doc_id, h, n, cls, comp) per row of ``docs`` (doc_id, h, text): classes and their components; null without shingles or id."""
    sized = stash(set_sizes(docs, k), "sized")
    known = sized.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = known.groupBy("n", "d1", "d2", "least").agg(F.min(F.struct("doc_id", "h")).alias("rep"))
    classes = stash(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    sets = stash(whole_sets(stash(with_partners(known, classes), "partners"), docs, k), "sets")
    kept = stash(prefixes(sets), "kept")
    grouped = stash(same_prefixes(kept, stash), "grouped")
    reps = grouped.filter("cls = grp").select("cls")
    rows = kept.join(reps, "cls").select("key", F.col("cls").alias("grp"), "n", "own", (F.col("n") - F.col("rank")).alias("rest"))
    rows = stash(rows, "prefixes")

    # Links within groups: with the group's first class; the rest is met below.
    inner = grouped.filter("cls <> grp").select(F.col("cls").alias("a"), F.col("grp").alias("b"))
    labels, links = None, None

    def labelled(df: DataFrame) -> DataFrame:
        if labels is None:
            return df.withColumn("comp", F.col("cls"))
        at = labels.select(F.col("node").alias("cls"), "component")
        return df.join(at, "cls", "left").withColumn("comp", F.coalesce("component", "cls")).drop("component")

    for turn in range(STARS + 1):
        members = stash(labelled(grouped), "labelled")
        open_rows = stash(tinted(rows, members), "open")
        if 0 < turn < STARS and open_rows.isEmpty():
            continue
        if turn < STARS:
            pairs = stars(open_rows, turn)
            pairs = pairs if turn else pairs.unionByName(inner)
        else:
            met = stash(crossings(open_rows), "crossings")
            x, y = (members.select(F.col("cls").alias(c), F.col("grp").alias(g), F.col("comp").alias(m)) for c, g, m in (("a", "ga", "ka"), ("b", "gb", "kb")))
            across = met.join(x, "ga").join(y, "gb").filter("ka <> kb").select("a", "b")
            mixed = members.groupBy("grp").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("grp")
            mixed = members.join(mixed, "grp")
            within = mixed.alias("u").join(mixed.alias("v"), (F.col("u.grp") == F.col("v.grp")) & (F.col("u.cls") < F.col("v.cls")) & (F.col("u.comp") != F.col("v.comp")))
            pairs = across.unionByName(within.select(F.col("u.cls").alias("a"), F.col("v.cls").alias("b")))
        found = verify(pairs, sets, stash)
        links = found if links is None else links.unionByName(found)
        if not found.isEmpty():
            labels = components(links, stash)
    at = labelled(classes).select("n", "d1", "d2", "cls", "comp")
    slim = sized.select("doc_id", "h", "n", "d1", "d2")
    of = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    none = F.lit(None).cast("long")
    rest = slim.filter((F.col("n") == 0) | F.col("doc_id").isNull()).select("doc_id", "h", "n", none.alias("cls"), none.alias("comp"))
    return slim.filter(of).join(at, ["n", "d1", "d2"]).select("doc_id", "h", "n", "cls", "comp").unionByName(rest)


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(docs[doc_id].cast("long").alias("doc_id"), F.xxhash64(docs[text]).alias("h"), docs[text].alias("text"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, class_id (the smallest id with an equal set) and component_id."""
    with scratch(docs.sparkSession) as (stash, keep):
        found = stash(link(_texts(docs, doc_id, text), k, stash), "found")
        known = found.filter(F.col("cls").isNotNull())
        # Documents are joined to components by id; an id in several components joins these.
        ids = known.groupBy("doc_id").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("doc_id")
        bridges = known.join(ids, "doc_id").select(F.col("comp").alias("b"), F.col("doc_id"))
        ends = bridges.groupBy("doc_id").agg(F.min("b").alias("a"))
        bridges = stash(bridges.join(ends, "doc_id").filter("a <> b").select("a", "b").distinct(), "bridges")
        joined = known.select(F.col("comp"), "doc_id")
        if not bridges.isEmpty():
            at = components(bridges, stash).select(F.col("node").alias("comp"), F.col("component").alias("whole"))
            found = found.join(at, "comp", "left").withColumn("comp", F.coalesce("whole", "comp")).drop("whole")
            joined = found.filter(F.col("cls").isNotNull()).select("comp", "doc_id")
        first = joined.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
        same = known.groupBy("cls").agg(F.min("doc_id").alias("class_id"))
        out = found.filter(F.col("cls").isNotNull()).join(first, "comp").join(same, "cls").select("doc_id", F.col("n").alias("n_shingles"), "class_id", "component_id")
        alone = found.filter(F.col("cls").isNull()).select("doc_id", "n", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"))
        return keep(out.unionByName(alone.withColumnRenamed("n", "n_shingles")), "near-duplicates")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` less those that another row of their component stands for.

    Components are those of texts: of each, the row with the smallest id stays
    (of rows that are repeated whole, one).  Rows with a null id or without words
    stay, and so do the other texts of a repeated id.
    """
    with scratch(docs.sparkSession) as (stash, keep):
        found = stash(link(_texts(docs, doc_id, text), SHINGLE, stash).filter(F.col("cls").isNotNull()), "found")
        best = found.groupBy("comp").agg(F.min(F.struct("doc_id", "h")).alias("best"))
        gone = found.join(best, "comp").filter((F.col("doc_id") != F.col("best.doc_id")) | (F.col("h") != F.col("best.h")))
        gone = keep(gone.select(F.col("doc_id").alias("__pm_id"), F.col("h").alias("__pm_h")).distinct(), "gone")
        again = found.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
        again = keep(again.select(F.col("doc_id").alias("__pm_id"), F.col("h").alias("__pm_h")), "again")
    at = lambda other: (docs[doc_id].cast("long") == other["__pm_id"]) & (F.xxhash64(docs[text]) == other["__pm_h"])
    left = docs.join(few(gone), at(gone), "left_anti")
    if again.isEmpty():
        return left
    once = left.join(few(again), at(again), "left_semi").dropDuplicates([doc_id, text])
    return left.join(few(again), at(again), "left_anti").unionByName(once)
