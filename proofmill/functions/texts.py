"""Normal forms, zones and classes of texts, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from proofmill.functions import vocabulary as V

_ANY_SPACE = r"[\s\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
SPACE = _ANY_SPACE + "+"
#: White space but a plain space; printing ASCII, most of a text, fails at the first look.
_OTHER_SPACE = rf"[\x00-\x1F\x7F-\x{{10FFFF}}&&{_ANY_SPACE}]"


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def norm(c: Column) -> Column:
    """White space of any kind collapsed and trimmed; null is empty."""
    return _single(F.regexp_replace(text(c), _OTHER_SPACE, " "))


def _single(c: Column) -> Column:
    """Plain spaces collapsed and trimmed, where there is no other white space."""
    return F.trim(F.regexp_replace(c, "  +", " "))


def loose(c: Column) -> Column:
    """``norm`` with the source's own unbreakable spaces as spaces too."""
    spaced = reduce(lambda x, mark: F.replace(x, F.lit(mark), F.lit(" ")), ("~", "\\,", "\\ "), norm(c))
    return _single(spaced)


def plain_marks(c: Column) -> Column:
    """Curly quotes, en dash and no-break space as their ASCII forms."""
    return reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), zip("“”’–\u00a0", "\"\"'- ", strict=True), text(c))


def dataset_form(c: Column) -> Column:
    return F.lower(norm(plain_marks(c)))


def answer_form(c: Column) -> Column:
    """What two answers are compared by when full stops at the end don't count."""
    return F.rtrim(norm(plain_marks(c)), F.lit("."))


def shape(c: Column) -> Column:
    """Digits as #, spaces collapsed, 60 characters at most: what 60 runs of digits, of spaces or other characters become."""
    front = F.regexp_extract(F.trim(text(c)), r"^(?:[0-9]++|\s++|[^0-9\s]){0,60}", 0)
    return F.regexp_replace(F.regexp_replace(front, r"[0-9]+", "#"), r"\s+", " ")


def signature(before: Column, after: Column) -> Column:
    return F.concat(shape(before), F.lit(" -> "), shape(after))


def n_words(c: Column) -> Column:
    return F.size(F.array_remove(F.split(norm(c), " "), ""))


def hunk_words(before: Column, after: Column) -> Column:
    return F.greatest(n_words(before), n_words(after))


def is_large(before: Column, after: Column, limit: int = 25) -> Column:
    return hunk_words(before, after) > limit


def tokens(c: Column) -> Column:
    """Words, runs of white space, and single other characters."""
    return F.regexp_extract_all(text(c), F.lit(r"(?U)\w+|\s+|[^\w\s]"), F.lit(0))


def only_space_differs(before: Column, after: Column) -> Column:
    """Equal but for plain spaces; a tie or a no-break space is a real difference."""
    bare = lambda c: F.regexp_replace(text(c), r"[ \t\n]+", "")
    return (bare(before) == bare(after)) & (text(before) != text(after)) & ~F.concat(text(before), text(after)).rlike("[~\u00a0]")


def paragraphs_of(c: Column) -> Column:
    """Blocks between blank lines, each on one line; how lines are wrapped doesn't matter."""
    return F.filter(F.transform(F.split(text(c), r"\n[ \t]*\n+"), norm), lambda p: p != "")


def zone_of_text(c: Column) -> Column:
    out = None
    for zone, mark in V.ZONE_MARKS:
        out = F.when(text(c).rlike(mark), zone) if out is None else out.when(text(c).rlike(mark), zone)
    return out.otherwise(V.BODY)


def lookup(c: Column, rows: list[tuple[str, str]], other: str | None = None) -> Column:
    """The value of ``c`` in a small map."""
    found = F.create_map(*[F.lit(x) for row in rows for x in row])[c]
    return found if other is None else F.coalesce(found, F.lit(other))


def zone_of_check(c: Column) -> Column:
    return lookup(c, V.pairs(V.ZONE_OF_CHECK), V.BODY)


def rate(part: Column, whole: Column, empty: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(empty))


def reading(zone: Column, share: Column, n: Column) -> Column:
    """What a rate of confirmations says, given its zone and denominator."""
    return (
        F.when(n < 5, "too few to say")
        .when(zone.isin(V.BODY, V.FLOATS), "editors vary here")
        .when(share >= 0.9, "strong")
        .when(share >= 0.5, "mixed")
        .otherwise("low in a strict zone")
    )


def verdict(zone: Column, share: Column, n: Column, contradicted: Column) -> Column:
    """Contradictions come before any reading of the rate."""
    return F.when(contradicted > 0, F.concat(contradicted.cast("string"), F.lit(" contradicted"))).otherwise(reading(zone, share, n))
