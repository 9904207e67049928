"""References against records of a registry: which record is meant, which might be, and where the two disagree.

References: ref, title, surname, year, volume, page, container, kind, and publisher, if there
is one.  Records: doi, title, surname, year, volume, page, type, and, if they are there,
surnames (all authors), container and publisher.  Empty or null fields say nothing.
Candidates come from an equi-join on a blocking key; scores stay columns.  Rows that
differ in their id alone are compared once.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import DoubleType, StringType

from proofmill.operators.align import likeness


@F.pandas_udf(StringType())
def folded(texts: pd.Series) -> pd.Series:
    """Without accents, in lower case; Spark has no decomposition of its own."""
    apart = texts.str.normalize("NFKD").str.lower()
    return apart.str.replace("[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]", "", regex=True)


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """How alike two titles are as sequences of letters, by their longest common subsequence."""
    return pd.Series([likeness(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype=float)


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]*>?", " ")), F.lit("[a-z0-9]+"), F.lit(0))


def overlap(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(a), F.array_distinct(b)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).otherwise(0.0)


def similarity(a: Column, b: Column) -> Column:
    """The better of token overlap and letters in common order of two titles, markup and accents aside; 0 without tokens."""
    x, y = tokens(folded(a)), tokens(folded(b))
    return F.greatest(overlap(x, y), ratio(F.array_join(x, " "), F.array_join(y, " ")))


def said(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("")) != ""


def digits(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), "[^0-9]", "")


def _sides(name: str) -> tuple[Column, Column]:
    return F.col(f"f.{name}"), F.col(f"w.{name}")


# Words of containers, and what records call their types.
MEETINGS = ["proc", "proceedings", "conference", "conf", "workshop", "symposium", "meeting"]
PERIODICALS = ["Rev", "J", "Lett", "Phys", "Sci", "Instrum", "Instr", "Nucl", "Commun", "Trans", "Journal", "Letters", "Review"]
PAPER_TYPES = ["proceedings-article", "ConferencePaper"]
BOOK_TYPES = ["book", "monograph", "edited-book", "reference-book", "Book", ""]
CHAPTER_TYPES = ["book-chapter", "BookChapter"]
LOOSE_TYPES = ["report", "posted-content", "dataset", "Report", "Preprint", "Dataset", "Software"]


def _holds(c: Column, words: list[str], flags: str = "") -> Column:
    return c.rlike(rf"{flags}\b({'|'.join(words)})\b")


def ref_forms(refs: DataFrame, keys: list[str], extra: set[str]) -> DataFrame:
    """``refs`` as a comparison reads them: ``ref``, ``keys`` and forms, made once a row; what isn't said is null."""
    kind, kept = F.coalesce("kind", F.lit("")), F.coalesce("container", F.lit(""))
    met = _holds(kept, MEETINGS, "(?i)")
    article = kind.isin("journal", "accepted") | ((kept != "") & ~met & (said(F.col("volume")) | _holds(kept, PERIODICALS)))
    out = {
        "title": F.coalesce("title", F.lit("")), "surname": F.when(said(F.col("surname")), F.lower("surname")), "year": F.col("year"), "volume": F.when(said(F.col("volume")), digits(F.col("volume"))), "page": F.when(said(F.col("page")), digits(F.col("page"))),
        "contained": said(F.col("container")), "article": article, "paper": kind.startswith("conference") | met, "book": kind == "book", "chapter": kind == "book_chapter",
    }
    if "w.surnames" in extra:
        out["folded"] = folded(F.coalesce("surname", F.lit("")))
    if {"f.publisher", "w.publisher"} <= extra:
        out["publisher"] = F.when(said(F.col("publisher")), F.lower(F.get(F.split(F.trim("publisher"), r"\s+"), F.lit(0))))
    return refs.select("ref", *keys, *[form.alias(name) for name, form in out.items()])


def work_forms(works: DataFrame, keys: list[str], extra: set[str]) -> DataFrame:
    """``works`` as a comparison reads them: ``doi``, ``keys`` and forms, made once a row."""
    made = F.coalesce("type", F.lit(""))
    held = _holds(F.coalesce("container", F.lit("")), MEETINGS, "(?i)") if "w.container" in extra else F.lit(False)
    out = {
        "title": F.coalesce("title", F.lit("")), "surname": F.when(said(F.col("surname")), F.lower("surname")), "year": F.col("year"), "volume": digits(F.col("volume")), "page": digits(F.element_at(F.split("page", "[-–]"), 1)), "numbered": said(F.col("volume")), "paged": said(F.col("page")),
        "paper": made.isin(PAPER_TYPES) | held, "article": ((made == "journal-article") & ~held) | made.isin(LOOSE_TYPES), "book": made.isin(BOOK_TYPES), "chapter": made.isin(BOOK_TYPES + CHAPTER_TYPES),
    }
    if "w.surnames" in extra:
        out["folded"] = F.filter(F.split(folded(F.array_join(F.coalesce("surnames", F.array().cast("array<string>")), "\n")), "\n"), lambda s: s != "")
    if {"f.publisher", "w.publisher"} <= extra:
        out["publisher"] = F.when(said(F.col("publisher")), F.lower("publisher"))
    return works.select("doi", *keys, *[form.alias(name) for name, form in out.items()])


def _formed(refs: DataFrame, works: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, set[str]]:
    extra = {f"{side}.{c}" for side, df in (("f", refs), ("w", works)) for c in df.columns}
    return ref_forms(refs, keys, extra), work_forms(works, keys, extra), extra


def other_author(extra: set[str]) -> Column:
    """Whether no author of the record has the reference's surname; one of several words has each of them."""
    if "w.surnames" not in extra:
        return F.col("f.surname") != F.col("w.surname")
    mine = F.col("f.folded")
    return F.col("f.surname").isNotNull() & (F.size("w.folded") > 0) & ~F.exists("w.folded", lambda s: (s == mine) | F.array_contains(F.split(s, " "), mine))


def other_kind(extra: set[str]) -> Column:
    """Whether the record is another kind of work: an article and a paper of one title are two, a book is no article."""
    out = (F.col("f.article") & F.col("w.paper")) | (F.col("f.paper") & F.col("w.article")) | (F.col("f.book") & ~F.col("w.book")) | (F.col("f.chapter") & ~F.col("w.chapter"))
    if {"f.publisher", "w.publisher"} <= extra:
        ours, theirs = _sides("publisher")
        out = out | ~F.contains(theirs, ours)
    return out


def objections(likeness: Column, strict: bool = True, extra: set[str] = frozenset()) -> list[tuple[Column, str]]:
    """What may speak against a record, in order; a condition that is null doesn't.

    Strict: for taking a DOI that the author didn't give.  Else: for doubting one that they gave.
    """
    (fy, wy), (fv, wv), (fp, wp) = map(_sides, ("year", "volume", "page"))
    need = F.when(F.col("short"), 0.95).otherwise(0.85) if strict else F.lit(0.5)
    named, titled = F.col("f.title") != "", (F.col("f.title") != "") & (F.col("w.title") != "")
    out = [(titled & (likeness < need), "title")]
    if strict:
        thin = ~(F.col("f.dated") | F.col("f.contained") | fv.isNotNull())
        sure = fv.isNotNull() & fp.isNotNull() & F.col("f.surname").isNotNull() & F.col("f.dated")
        out = [(thin, "too little to check"), (~named & ~(F.col("w.numbered") & F.col("w.paged")), "record without pages"), *out, (~titled & ~sure, "too little to be sure")]
    out += [
        (other_author(extra) if strict else other_author(extra) & ~named, "author"),
        (F.col("f.dated") & F.col("w.dated") & (F.abs(fy - wy) > 1), "year"),
        (F.col("w.numbered") & (fv != wv), "volume"),
        (F.col("w.paged") & (fp != wp), "page"),
    ]
    return out + [(other_kind(extra), "kind")] if strict else out


def disagreement(likeness: Column, strict: bool = True, extra: set[str] = frozenset()) -> Column:
    """Why a record isn't the one, by the first thing that speaks against it; empty if nothing does."""
    out = F
    for against, name in objections(likeness, strict, extra):
        out = out.when(against, name)
    return out.otherwise("")


def agreement(likeness: Column) -> Column:
    """Points of agreement: two for the title, one each for author, year, volume and page."""
    point = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return 2 * point(likeness >= 0.85) + sum((point(a == b) for a, b in map(_sides, ("surname", "year", "volume", "page"))), F.lit(0))


CLASS_IDS = 100


def classes(rows: DataFrame, name: str, most: int | None = None) -> DataFrame:
    """``rows`` that differ in their id ``name`` alone as one row, with ``<name>s``: their ids, in order.

    A row holds ``CLASS_IDS`` ids at most, and a larger class is several rows; with
    ``most``, only so many of the first ids are kept.
    """
    same = ["mark", *[c for c in rows.columns if c != name]]
    each = rows.withColumn("mark", _mark(rows, name)).withColumn("n", F.row_number().over(W.partitionBy(*same).orderBy(name)))
    each = each.filter(F.col("n") <= most) if most else each
    return each.groupBy(*same, F.floor((F.col("n") - 1) / CLASS_IDS).alias("part")).agg(F.array_sort(F.collect_list(F.struct(name))).alias("ids")).select(*same, F.col(f"ids.{name}").alias(f"{name}s"))


def _mark(rows: DataFrame, name: str) -> Column:
    """A digest of all columns but the id: sorts compare it first, and columns only where it is equal."""
    return F.xxhash64(*[c for c in rows.columns if c != name])


def _worded(df: DataFrame) -> DataFrame:
    """``df`` with its titles as words, made once a row."""
    return df.withColumn("words", tokens(F.col("title"))).withColumn("set", F.array_distinct("words")).withColumn("size", F.size("set"))


def _alike(both: DataFrame) -> DataFrame:
    """Pairs of worded rows with the likeness of their titles, and whether the first is short."""
    n, m, shared = F.col("f.size"), F.col("w.size"), F.size(F.array_intersect("f.set", "w.set"))
    both = both.withColumn("short", F.size("f.words") < 4).withColumn("shared", shared)
    return both.withColumn("likeness", F.when((n > 0) & (m > 0), F.col("shared") / (n + m - F.col("shared"))).otherwise(0.0))


def _dated(df: DataFrame) -> DataFrame:
    return df.withColumn("dated", said(F.col("year")))


def _same(a: str, b: str, names: list[str]) -> list[Column]:
    return [F.col(f"{a}.{k}") == F.col(f"{b}.{k}") for k in names]


def _tasks(df: DataFrame) -> int:
    return 4 * df.sparkSession.sparkContext.defaultParallelism


def _alike_titles(f: DataFrame, w: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, title, other, short, likeness: the titles of both sides that meet by a blocking key, each pair once."""
    titles = lambda df: _worded(df.select(*keys, "title").distinct())
    both = _alike(titles(f).alias("f").join(titles(w).alias("w"), _same("f", "w", keys)))
    return both.select(*[f"f.{k}" for k in keys], F.col("f.title").alias("title"), F.col("w.title").alias("other"), "short", "likeness")


def _met(f: DataFrame, titles: DataFrame, w: DataFrame, keys: list[str]) -> DataFrame:
    """The pairs of classes whose ``titles`` meet.  Dealt by both a number of times the cores: their work isn't told by their bytes."""
    f = f.join(titles.alias("t"), [*keys, "title"]).repartition(_tasks(f), *keys, "other")
    f, w = _dated(f).alias("f"), _dated(w.repartition(_tasks(w), *keys, "title")).alias("w")
    return f.join(w, [*_same("f", "w", keys), F.col("f.other") == F.col("w.title")])


def _judged(both: DataFrame, ids: list[str], extra: set[str]) -> DataFrame:
    """``ids``, likeness, reason, doubt and points of pairs of forms with their likeness."""
    likeness = F.col("likeness")
    return both.select(*ids, "likeness", disagreement(likeness, extra=extra).alias("reason"), disagreement(likeness, False, extra).alias("doubt"), agreement(likeness).alias("points"))


def compared_classes(refs: DataFrame, works: DataFrame, keys: list[str]) -> DataFrame:
    """(refs, dois, likeness, reason, doubt, points) of each pair of a class of references and one of records with one blocking key.

    References whose forms agree are one class, records likewise: copies are compared
    once, and ``refs`` and ``dois`` have the ids of a class, ``CLASS_IDS`` a row at most.
    """
    f, w, extra = _formed(refs, works, keys)
    return _judged(_met(classes(f, "ref"), _alike_titles(f, w, keys), classes(w, "doi"), keys), ["f.refs", "w.dois"], extra)


def compared(refs: DataFrame, works: DataFrame, keys: list[str]) -> DataFrame:
    """(ref, doi, likeness, reason, doubt, points) of each pair of a reference and a record with one blocking key.

    Classes are compared, then their pairs are written out where they are.  Between
    the two a pair of classes is made a row, as generated code would else work out
    its verdict again for each pair of ids; ``coalesce`` to as many partitions as
    there are does only that.  Ids of references go innermost: they are copied less
    than DOIs.
    """
    said = ["likeness", "reason", "doubt", "points"]
    pairs = compared_classes(refs, works, keys).coalesce(_tasks(refs))
    each = pairs.select(F.explode("dois").alias("doi"), "refs", *said).select("doi", F.explode("refs").alias("ref"), *said)
    return each.select("ref", "doi", *said)


def compared_given(given: DataFrame, refs: DataFrame, works: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``compared`` for the pairs in ``given`` (ref, doi) alone, by their ids: no others are made."""
    asked = given.select("ref", "doi").distinct().alias("g")
    f, w, extra = _formed(refs, works, keys)
    f, w = _dated(_worded(f)).alias("f"), _dated(_worded(w)).alias("w")
    both = asked.join(f, F.col("g.ref") == F.col("f.ref")).join(w, [F.col("g.doi") == F.col("w.doi"), *_same("f", "w", keys)])
    return _judged(_alike(both), ["f.ref", "w.doi"], extra)


def leading(pairs: DataFrame, most: int, *order: Column) -> DataFrame:
    """Of pairs of classes, as pairs (ref, doi, likeness, points), the first ``most`` records of each reference by ``order``, then by DOI.

    What is kept of a class is kept of each of its references, so pairs are written
    out only for these.
    """
    each = pairs.select("refs", F.explode(F.slice("dois", 1, most)).alias("doi"), "likeness", "points")
    n = F.row_number().over(W.partitionBy("refs").orderBy(*order, "doi"))
    return each.withColumn("n", n).filter(F.col("n") <= most).select(F.explode("refs").alias("ref"), "doi", "likeness", "points")


def found_in_classes(pairs: DataFrame) -> DataFrame:
    """``found`` of pairs of classes: the first two records of a reference decide."""
    return found(leading(pairs.filter("reason = ''"), 2, F.desc("likeness")).withColumn("reason", F.lit("")))


def possible_in_classes(pairs: DataFrame, taken: DataFrame, most: int = 3) -> DataFrame:
    """``possible`` of pairs of classes."""
    near = pairs.filter("likeness >= 0.75 and points >= 3")
    return possible(leading(near, most, F.desc("points"), F.desc("likeness")), taken, most)


def best_similarity(refs: DataFrame, works: DataFrame, keys: list[str]) -> DataFrame:
    """(ref, likeness): the best similarity of a reference's title with one of the records of its blocking key; titles meet and not rows."""
    asked, had = (rows.select(*keys, "title").distinct() for rows in (refs, works))
    both = asked.alias("f").join(had.alias("w"), [F.col(f"f.{k}") == F.col(f"w.{k}") for k in keys])
    best = both.select(*[f"f.{k}" for k in keys], "f.title", similarity(F.col("f.title"), F.col("w.title")).alias("likeness")).groupBy(*keys, "title").agg(F.max("likeness").alias("likeness"))
    f, b = refs.alias("f"), best.alias("b")
    met = f.join(b, [F.col(f"f.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "title"]])
    return met.groupBy("f.ref").agg(F.max("b.likeness").alias("likeness"))


def found(pairs: DataFrame) -> DataFrame:
    """(ref, doi): the one record that passes, or the best if it leads the next by more than a tenth of similarity."""
    of = W.partitionBy("ref").orderBy(F.desc("likeness"), "doi")
    ranked = pairs.filter("reason = ''").withColumn("n", F.row_number().over(of)).withColumn("next", F.lead("likeness").over(of))
    return ranked.filter((F.col("n") == 1) & (F.col("next").isNull() | (F.col("likeness") - F.col("next") > 0.1))).select("ref", "doi")


def possible(pairs: DataFrame, taken: DataFrame, most: int = 3) -> DataFrame:
    """(ref, place, doi, points): the best few records with a similar title and one disagreement at most, for references in no pair of ``taken``."""
    open_ = pairs.filter("likeness >= 0.75 and points >= 3").join(taken.select("ref"), "ref", "left_anti")
    place = F.row_number().over(W.partitionBy("ref").orderBy(F.desc("points"), F.desc("likeness"), "doi"))
    return open_.withColumn("place", place).filter(F.col("place") <= most).select("ref", "place", "doi", "points")


def verdicts(given: DataFrame, works: DataFrame, pairs: DataFrame, known: DataFrame) -> DataFrame:
    """(ref, status): given DOIs that fit, that are of another work, that no registry knows, or that it couldn't be asked about.

    ``given``: ref, doi; ``known``: doi, reachable.  Unreachable isn't unknown.
    """
    both = given.join(known, "doi", "left").join(works.select("doi", F.lit(True).alias("there")), "doi", "left").join(pairs.select("ref", "doi", "doubt"), ["ref", "doi"], "left")
    status = F.when(~F.coalesce("reachable", F.lit(True)), "not checked").when(F.col("there").isNull(), "unresolved").when(F.col("doubt").isNull(), "wrong").when(F.col("doubt") == "", "right").otherwise("wrong")
    return both.select("ref", "doi", status.alias("status"))
