"""Names of people: family and given names, initials, and whether two spellings can be one person."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Words that belong to the family name after them.
PARTICLES = "von van de der den du la le di da del dos ten ter zu dei des bin al".split()


def _words(c: Column) -> Column:
    return F.filter(F.split(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s~]+", " ")), " "), lambda w: w != "")


def split_name(c: Column) -> Column:
    """(given, family): the family name stands before a comma, or is the last word with the particles before it."""
    parts = F.split(F.coalesce(c, F.lit("")), ",")
    words = _words(c)
    n = F.size(words)
    particle = lambda i: F.lower(F.element_at(words, i)).isin(*PARTICLES)
    # The family name begins at the first of the particles that run up to the last word.
    at = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), n, lambda acc, k: F.when((acc == n - k + 1) & (n - k >= 2) & particle(F.greatest(n - k, F.lit(1))), n - k).otherwise(acc))
    plain = F.struct(F.array_join(F.slice(words, 1, F.greatest(at - 1, F.lit(0))), " ").alias("given"), F.array_join(F.slice(words, F.greatest(at, F.lit(1)), n), " ").alias("family"))
    turned = F.struct(F.array_join(_words(F.get(parts, 1)), " ").alias("given"), F.array_join(_words(F.get(parts, 0)), " ").alias("family"))
    return F.when(F.size(parts) == 2, turned).otherwise(plain)


def initials(given: Column) -> Column:
    """The letters that begin given names, parts of hyphenated ones too, in capitals."""
    return F.array_join(F.transform(F.filter(F.split(F.coalesce(given, F.lit("")), r"[\s.\-]+"), lambda w: w != ""), lambda w: F.upper(F.substring(w, 1, 1))), "")


def listed(names: Column) -> Column:
    """A list of authors as it is printed: two joined by and, three to six with commas, more as the first et al."""
    n = F.size(names)
    return (
        F.when(n == 0, "")
        .when(n > 6, F.concat(names[0], F.lit(" et al.")))
        .when(n <= 2, F.array_join(names, " and "))
        .otherwise(F.concat(F.array_join(F.slice(names, 1, F.greatest(n - 1, F.lit(0))), ", "), F.lit(", and "), F.element_at(names, -1)))
    )
