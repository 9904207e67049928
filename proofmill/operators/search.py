"""Search of a registry by spelling and by title, by indexes that an equi-join meets.

Near spellings meet in their deletion neighbourhoods: a word's keys are hashes of
itself and of all its forms with one character left out, and two words one slip apart
(a character changed, gone, added, or swapped with the next) share a key.  Titles
meet in prefixes: a title's words are ordered by how few titles have them, and of two
titles that share enough words one of the first few words is common.  Both verify
every candidate, and both work on distinct strings, so that copies meet once.

Defined results: null and empty words and titles are in no pair.  A title without
words likewise.  Rows that share an id are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from proofmill.functions import scalars as S
from proofmill.operators import registry as R


def _distinct(rows: DataFrame, word: str, name: str) -> DataFrame:
    return rows.select(F.col(word).alias(name)).filter(F.coalesce(F.col(name), F.lit("")) != "").distinct()


def slip_keys(word: Column) -> Column:
    """Hashes of the word and of its forms without one of its characters."""
    without = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.xxhash64(F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word)))))
    return F.array_distinct(F.concat(F.array(F.xxhash64(word)), without))


def near_spellings(left: DataFrame, right: DataFrame, word: str = "word") -> DataFrame:
    """(left, right): the pairs of distinct words of both sides that are one slip apart."""
    a = _distinct(left, word, "left").withColumn("key", F.explode(slip_keys(F.col("left"))))
    b = _distinct(right, word, "right").withColumn("key", F.explode(slip_keys(F.col("right"))))
    # Words have many keys, which the planner's sizes don't count: neither side may be broadcast.
    met = a.join(b.hint("merge"), "key").filter(F.abs(F.length("left") - F.length("right")) <= 1).filter(F.col("left") != F.col("right")).select("left", "right").distinct()
    return met.filter(S.one_slip(F.col("left"), F.col("right")))


def near_records(refs: DataFrame, works: DataFrame, doi: str = "doi") -> DataFrame:
    """(ref, doi, found): for each reference whose DOI no record has, the records whose DOI is one slip away."""
    lost = refs.join(works.select(F.col(doi)).hint("merge"), doi, "left_anti")
    pairs = near_spellings(lost, works, doi)
    return lost.select("ref", F.col(doi).alias("left")).join(pairs.hint("merge"), "left").select("ref", F.col("left").alias("doi"), F.col("right").alias("found"))


def _least_shared(n: Column, least: float) -> Column:
    """How many words a set of ``n`` shares with any set that is ``least`` alike by Jaccard."""
    return F.ceil(n * least - 1e-9).cast("int")


def similar_titles(left: DataFrame, right: DataFrame, least: float = 0.5, title: str = "title") -> DataFrame:
    """(left, right, likeness): the pairs of distinct titles of both sides whose words are ``least`` alike by Jaccard, or more."""
    sides = []
    for rows, name in ((left, "left"), (right, "right")):
        words = F.array_distinct(R.tokens(F.col(name)))
        sides.append(_distinct(rows, title, name).withColumn("words", words).filter(F.size("words") > 0))
    each = sides[0].select(F.explode("words").alias("word")).unionByName(sides[1].select(F.explode("words").alias("word")))
    rarity = each.groupBy("word").agg(F.count(F.lit(1)).alias("titles"))
    found = []
    for side, name in zip(sides, ("left", "right"), strict=True):
        ordered = side.select(name, F.explode("words").alias("word")).join(rarity, "word").groupBy(name).agg(F.array_sort(F.collect_list(F.struct("titles", "word"))).alias("by"))
        words = F.transform("by", lambda x: x["word"])
        n = F.size("by")
        first = F.slice(words, F.lit(1), n - _least_shared(n, least) + 1)
        found.append(ordered.select(name, words.alias(f"{name}_words"), F.explode(first).alias("word")))
    a, b = found
    n, m = F.size("left_words"), F.size("right_words")
    met = a.join(b, "word").filter((n >= least * m - 1e-9) & (m >= least * n - 1e-9))
    likeness = F.size(F.array_intersect("left_words", "right_words")) / F.size(F.array_union("left_words", "right_words"))
    # A pair that shares several first words is verified at the first of them.
    lead = F.get(F.array_intersect(F.slice("left_words", F.lit(1), n - _least_shared(n, least) + 1), F.slice("right_words", F.lit(1), m - _least_shared(m, least) + 1)), F.lit(0))
    return met.filter(F.col("word") == lead).withColumn("likeness", likeness).filter(F.col("likeness") >= least - 1e-9).select("left", "right", "likeness")


def candidates(refs: DataFrame, works: DataFrame, least: float = 0.5) -> DataFrame:
    """(ref, doi, likeness) of each reference and each record whose titles are alike: the blocks that ``registry.compared`` decides on."""
    pairs = similar_titles(refs, works, least)
    return pairs.join(refs.select("ref", F.col("title").alias("left")), "left").join(works.select("doi", F.col("title").alias("right")), "right").select("ref", "doi", "likeness")


def papers_by_title(refs: DataFrame, works: DataFrame, with_label: float = 0.85, without: float = 0.93) -> DataFrame:
    """(ref, doi, likeness): each reference's best record by title, of equal ones the smallest DOI.

    ``refs``: ref, title, label, doi; ``works``: doi, title, label.  An equal DOI
    wins over titles.  Labels that are both given must be equal; with one a title needs
    to be ``with_label`` alike, else ``without``.
    """
    named = refs.filter(F.coalesce("doi", F.lit("")) != "").join(works.select("doi"), "doi").select("ref", "doi", F.lit(1.0).alias("likeness"))
    rest = refs.join(named.select("ref"), "ref", "left_anti")
    # Records and references of one title and label are alike, so titles meet and not rows.
    pairs = similar_titles(rest, works, min(with_label, without))
    asked = rest.select(F.col("title").alias("left"), F.coalesce("label", F.lit("")).alias("label")).distinct()
    had = works.groupBy(F.col("title").alias("right"), F.coalesce("label", F.lit("")).alias("own")).agg(F.min("doi").alias("doi"))
    both = pairs.join(asked, "left").join(had, "right")
    given = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    same = given("label") & given("own") & (F.col("label") == F.col("own"))
    other = given("label") & given("own") & (F.col("label") != F.col("own"))
    fits = ~other & (F.col("likeness") >= F.when(same, with_label).otherwise(without))
    best = both.filter(fits).groupBy("left", "label").agg(F.min(F.struct((-F.col("likeness")).alias("order"), "doi")).alias("best"))
    found = rest.select("ref", F.col("title").alias("left"), F.coalesce("label", F.lit("")).alias("label")).join(best, ["left", "label"])
    return named.unionByName(found.select("ref", "best.doi", (-F.col("best.order")).alias("likeness")))
