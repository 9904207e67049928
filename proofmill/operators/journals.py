"""Names of journals as their list abbreviates them: by key, by likeness, by words, and by a dictionary of words.

A list has full names and their short forms.  A name is looked up in steps, and a
step sees only what no step before it has settled:

1. ``listed``: its key is that of a full name, a short form or a given variant;
2. ``head``: so is the key of what stands before a colon;
3. ``typo``: one listed key is at least nine tenths like it (twice the longest common
   subsequence over both lengths), of nearly the same length;
4. ``words``: its words abbreviate those of one full name, one by one;
5. ``made``: a full name that isn't in the list takes the short form of each of its words
   from a dictionary that is learned from the list;
6. ``as written``.

Where a step finds several short forms and none is better, the name has no short form; its
``how`` is ``tie`` and ``choices`` has them all.

Like keys meet in segments: a key is cut in one more piece than there can be
differences, so one piece is whole in the other key, about where it was.  Abbreviated
words meet in initials and the head of the longest written word.  Both are equi-joins of
distinct names, verified pair by pair.

Defined results: null and blank names have no row; other names have one each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from proofmill.functions import scalars as S, texts as X
from proofmill.operators import registry as R
from proofmill.session import stash

# Words that short forms leave out.
MINOR = ["of", "and", "on", "in", "the", "for", "to", "a", "an", "at", "with", "de", "la"]
# Words before a section's letter, which short forms leave out as well.
SECTIONS = ["section", "sect", "sect.", "sec.", "series", "ser."]
#: Least likeness of a typo, most difference of lengths, and least length of what may hold one.
LIKE, APART, LEAST = 0.9, 3, 9
#: Least letters of a stem that stands for words the list doesn't have.
STEM = 4


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is spelt out once, however often ``f`` reads it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def words(name: Column) -> Column:
    """The words of a name, in lower case, that a short form has.

    A last letter alone names a section and stays, and so does a word with a full stop, which stands for another.
    """
    spelled = F.replace(F.replace(F.regexp_replace(F.lower(X.text(name)), "<[^>]+>", ""), F.lit("&"), F.lit(" and ")), F.lit("."), F.lit(". "))

    def of(every: Column) -> Column:
        kept = F.filter(every, lambda w, i: ~w.isin(*MINOR, *SECTIONS) | ((w == "a") & (i == F.size(every) - 1)))
        bare = lambda ws: F.filter(F.transform(ws, lambda w: F.replace(w, F.lit("."), F.lit(""))), lambda w: w != "")
        return bound(bare(kept), lambda k: F.when(F.size(k) > 0, k).otherwise(bare(every)))

    return bound(F.regexp_extract_all(spelled, F.lit(r"[^\s,:;()\"“”'–-]+"), F.lit(0)), of)


def fulls(journals: DataFrame) -> DataFrame:
    """(full, short): words of each full name, and of what stands before its colon."""
    rows = journals.filter("full IS NOT NULL AND short IS NOT NULL").select(F.explode(F.array_distinct(F.array("full", head(F.col("full"))))).alias("full"), "short")
    return rows.select(words(F.col("full")).alias("full"), "short").distinct()


def head(name: Column) -> Column:
    return F.get(F.split(name, r":\s"), F.lit(0))


def keyed(journals: DataFrame, variants: DataFrame | None = None) -> DataFrame:
    """(key, shorts): the short forms that a key may stand for, of full names first, then short forms, heads and variants.

    ``journals``: full, short.  ``variants``: name, short.
    """
    ways = F.array(*(F.struct(F.lit(i).alias("level"), S.journal_key(c).alias("key")) for i, c in enumerate((F.col("full"), F.col("short"), head(F.col("full"))))))
    rows = journals.filter("full IS NOT NULL AND short IS NOT NULL").select(F.explode(ways).alias("w"), "short").select("w.key", "w.level", "short")
    if variants is not None:
        rows = rows.unionByName(variants.filter("name IS NOT NULL AND short IS NOT NULL").select(S.journal_key(F.col("name")).alias("key"), F.lit(3).alias("level"), "short"))
    by = rows.filter("key <> ''").groupBy("key", "level").agg(F.collect_set("short").alias("shorts"))
    return by.groupBy("key").agg(F.min_by("shorts", "level").alias("shorts")).select("key", F.array_sort("shorts").alias("shorts"))


def _pieces(n: Column) -> Column:
    """How many segments a key of ``n`` letters is cut into: one more than a like key can differ by."""
    return F.floor((2 * n + APART) * (1 - LIKE) + 1e-9).cast("int") + 1


def _cut(i: Column, n: Column) -> Column:
    return F.floor(i * n / _pieces(n)).cast("int")


def like_keys(asked: DataFrame, had: DataFrame) -> DataFrame:
    """(asked, key, likeness) of all pairs of ``asked`` (asked) and ``had`` (key) that are alike by the terms of a typo."""
    n, m = F.length("key"), F.length("asked")
    own = F.transform(F.sequence(F.lit(0), _pieces(n) - 1), lambda i: F.xxhash64(n, i, F.substring(F.col("key"), _cut(i, n) + 1, _cut(i + 1, n) - _cut(i, n))))

    def of_length(size: Column) -> Column:
        shift = F.floor((_pieces(size) - 1 + APART) / 2).cast("int")

        def of_piece(i: Column) -> Column:
            at = _cut(i, size)
            low = F.greatest(at - shift, F.lit(0))
            return F.transform(F.sequence(low, F.greatest(low, at + shift)), lambda q: F.xxhash64(size, i, F.substring(F.col("asked"), q + 1, _cut(i + 1, size) - at)))

        return F.flatten(F.transform(F.sequence(F.lit(0), _pieces(size) - 1), of_piece))

    met = F.array_distinct(F.flatten(F.transform(F.sequence(F.greatest(m - APART, F.lit(1)), m + APART), of_length)))
    a = asked.select("asked").distinct().filter(m >= LEAST).withColumn("piece", F.explode(met))
    b = had.select("key").distinct().filter(n > 0).withColumn("piece", F.explode(F.array_distinct(own)))
    pairs = a.join(b, "piece").filter(F.abs(n - m) <= APART).select("asked", "key").distinct()
    return pairs.withColumn("likeness", R.ratio(F.col("asked"), F.col("key"))).filter(F.col("likeness") >= LIKE - 1e-9)


def grade(short: Column, full: Column) -> Column:
    """How well a word abbreviates another: 0 the same, 1 its head, 2 its letters in order from the same two on; null not at all."""
    rest = F.aggregate(F.split(short, ""), full, lambda left, c: bound(F.instr(left, c), lambda at: F.when(at > 0, F.substring(left, at + 1, F.length(left)))))
    return F.when(short == full, 0).when(F.startswith(full, short), 1).when((F.left(short, F.lit(2)) == F.left(full, F.lit(2))) & (F.length(short) > 2) & rest.isNotNull(), 2)


def _initials(w: Column) -> Column:
    return F.array_join(F.transform(w, lambda x: F.left(x, F.lit(1))), "")


def by_words(asked: DataFrame, journals: DataFrame) -> DataFrame:
    """(asked, shorts): the short forms of the full names that a name's words fit best."""
    a = asked.select("asked").distinct().withColumn("own", words(F.col("asked"))).filter(F.size("own") > 0)
    longest = F.array_max(F.transform("own", lambda w, i: F.struct(F.length(w).alias("n"), (-i).alias("i"))))
    a = a.withColumn("place", -longest["i"]).select("asked", "own", _initials(F.col("own")).alias("initials"), "place", F.left(F.get("own", F.col("place")), F.lit(2)).alias("start"))
    b = fulls(journals).select("full", "short", _initials(F.col("full")).alias("initials"), F.posexplode("full").alias("place", "start")).withColumn("start", F.left("start", F.lit(2)))
    # A word of one letter meets every word with its initial, so its block is that of the letter.
    single = F.length("start") == 1
    b = b.unionByName(b.filter(~single).withColumn("start", F.left("start", F.lit(1))))
    grades = F.zip_with("own", "full", grade)
    met = a.join(b, ["initials", "place", "start"]).withColumn("grades", grades).filter(~F.exists("grades", lambda g: g.isNull()))
    cost = F.aggregate("grades", F.lit(0), lambda s, g: s + g)
    by = met.groupBy("asked", cost.alias("cost")).agg(F.collect_set("short").alias("shorts"))
    return by.groupBy("asked").agg(F.min_by("shorts", "cost").alias("shorts")).select("asked", F.array_sort("shorts").alias("shorts"))


def dictionary(journals: DataFrame) -> DataFrame:
    """(word, form, stem): what short forms write for a word, learned where words of both names align one by one.

    A word has the form that most names give it; one that two forms share alike has none.  A
    form that cuts a word is also a stem, for words that the list doesn't have.
    """
    short = F.filter(F.split(F.trim(F.col("short")), r"\s+"), lambda w: ~F.lower(w).isin(*MINOR) | F.lower(w).isin("a"))
    rows = fulls(journals).withColumn("short", short).filter(F.size("full") == F.size("short"))
    each = rows.select(F.explode(F.arrays_zip("full", "short")).alias("w")).select(F.col("w.full").alias("word"), F.col("w.short").alias("form"))
    bare = F.lower(F.regexp_replace("form", r"[.,:;()]", ""))
    fits = each.filter(grade(bare, F.col("word")).isNotNull()).groupBy("word", "form").agg(F.count(F.lit(1)).alias("n"))
    best = fits.groupBy("word", "n").agg(F.min("form").alias("form"), F.count(F.lit(1)).alias("forms")).groupBy("word").agg(F.max_by(F.struct("form", "forms"), "n").alias("b")).filter("b.forms = 1")
    bare = F.lower(F.regexp_replace("form", r"[.,:;()]", ""))
    return best.select("word", "b.form").withColumn("stem", F.when(F.col("form").endswith(".") & F.startswith("word", bare) & (F.length(bare) >= STEM), bare))


def made(asked: DataFrame, forms: DataFrame) -> DataFrame:
    """(asked, short, known): each name from the short forms of its words; ``known`` of them were found."""
    tokens = F.filter(F.split(F.regexp_replace(X.norm(F.col("asked")), "[,:;()]", ""), " "), lambda w: ~F.lower(w).isin(*MINOR, "&", ""))
    rows = asked.select("asked").distinct().select("asked", F.size(tokens).alias("n"), F.posexplode(tokens).alias("i", "token")).withColumn("word", F.lower("token"))
    whole = rows.select("word").distinct().join(forms.select("word", "form"), "word", "left")
    heads = whole.filter("form IS NULL").select("word", F.explode(F.transform(F.sequence(F.lit(STEM), F.greatest(F.length("word"), F.lit(STEM))), lambda n: F.left(F.col("word"), n))).alias("stem"))
    # A stem is one only where all its words agree on the form.
    stems = forms.filter("stem IS NOT NULL").groupBy("stem").agg(F.min("form").alias("form"), F.max("form").alias("other")).filter("form = other").drop("other")
    longest = heads.join(stems, "stem").groupBy("word").agg(F.max_by("form", F.length("stem")).alias("by_stem"))
    found = whole.join(longest, "word", "left").select("word", F.coalesce("form", "by_stem").alias("form"))
    spelled = F.when(F.col("n") == 1, F.col("token")).otherwise(F.coalesce("form", "token"))
    out = rows.join(found, "word").groupBy("asked").agg(F.array_sort(F.collect_list(F.struct("i", spelled.alias("w")))).alias("by"), F.count("form").alias("known"))
    return out.select("asked", F.array_join(F.transform("by", lambda x: x["w"]), " ").alias("short"), "known")


def resolved(names: DataFrame, journals: DataFrame, variants: DataFrame | None = None) -> DataFrame:
    """(name, short, how, choices) of the distinct names of ``names`` (name)."""
    written = F.regexp_replace(F.trim(X.norm(F.col("name")), F.lit(" ,;")), "^[iI]n ", "")
    # Both lists are read by several steps: distinct rows are made and written once.
    journals = stash(journals.select("full", "short").distinct(), "journals")
    had = stash(keyed(journals, variants), "journal-keys")
    whole = names.select("name").distinct().withColumn("written", written).filter("written <> ''")
    whole = whole.withColumn("key", S.journal_key(F.col("written"))).withColumn("front", S.journal_key(head(F.col("written"))))
    for column, name in (("key", "listed"), ("front", "head")):
        whole = whole.join(had.select(F.col("key").alias(column), F.col("shorts").alias(name)), column, "left")
    whole = stash(whole, "journal-names")
    open_ = whole.filter("listed IS NULL AND head IS NULL")
    near = like_keys(open_.select(F.col("key").alias("asked")), had).join(had, "key").groupBy("asked", "likeness").agg(F.array_distinct(F.flatten(F.collect_list("shorts"))).alias("shorts"), F.count(F.lit(1)).alias("n"))
    # The two best keys decide: all those of the best likeness, and of the next if the best is one key.
    best = near.groupBy("asked").agg(F.array_sort(F.collect_list(F.struct((-F.col("likeness")).alias("l"), "n", "shorts"))).alias("o"))
    first, second = F.get("o", F.lit(0)), F.get("o", F.lit(1))
    two = F.when((first["n"] > 1) | (F.size("o") == 1), first["shorts"]).otherwise(F.array_union(first["shorts"], second["shorts"]))
    typo = best.select(F.col("asked").alias("key"), F.array_sort(two).alias("typo"))
    fitting = by_words(open_.select(F.col("written").alias("asked")), journals).select(F.col("asked").alias("written"), F.col("shorts").alias("words"))
    spelled = open_.filter(~S.looks_abbreviated(F.col("written"))).select(F.col("written").alias("asked"))
    new = made(spelled, dictionary(journals)).filter("known > 0").select(F.col("asked").alias("written"), F.array("short").alias("made"))
    whole = whole.join(typo, "key", "left").join(fitting, "written", "left").join(new, "written", "left")
    steps = ("listed", "head", "typo", "words", "made")
    step = F.coalesce(*(F.when(F.col(c).isNotNull(), F.lit(c)) for c in steps), F.lit("as written"))
    choices = F.coalesce(*steps, F.array("written"))
    one = F.size("choices") == 1
    return whole.select("name", step.alias("step"), choices.alias("choices")).select("name", F.when(one, F.get("choices", F.lit(0))).alias("short"), F.when(one, F.col("step")).otherwise("tie").alias("how"), "choices")


def issues(fields: DataFrame, journals: DataFrame, variants: DataFrame | None = None) -> DataFrame:
    """(ref, start, end, before, put, how): journals of references that aren't written as the list has them.

    ``fields``: as ``parsing.parsed`` gives them, with the span of each value in its
    reference.  ``put`` is null where nothing or more than one form is known, and the issue is a report.
    """
    own = fields.filter((F.col("field") == "journal") & F.col("start").isNotNull()).select("ref", "start", "end", F.col("value").alias("name"))
    known = resolved(own.select("name"), journals, variants)
    met = own.join(known, "name").withColumn("put", F.when(~F.col("how").isin("tie", "as written"), F.col("short")))
    return met.filter("put IS NULL OR put <> name").select("ref", "start", "end", F.col("name").alias("before"), "put", "how")
