"""Two lists of authors of a paper against each other, as an assignment.

Names meet within a paper and a folded family name: accents, case, apostrophes, hyphens and
generational suffixes don't count.  There each pair has a grade: equal given names, equal
initials, initials that begin the others', or no given names on one side; two
different full first names are two people.  The assignment has the greatest sum of
grades, so that one missing initial doesn't shift the others, and of equal sums the
one that prefers the earlier of our names, then the earlier of theirs.  Names that
are left meet once more with their fields swapped.

Defined results: a null or empty name is left out.  Names without a partner are
returned with a null on the other side.  People of the same name are as many as they
are listed.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from proofmill.functions import names as N
from proofmill.operators.registry import folded

EQUAL, INITIALS, BEGINS, BARE, SWAPPED = 8, 4, 2, 1, 1
# Suffixes of generations.
SUFFIXES = r"[\s,]+(?:Jr|Sr|II|III|IV)\.?\s*$"


def _key(c: Column) -> Column:
    return F.regexp_replace(c, r"[\s'’.\-]", "")


def named(people: DataFrame) -> DataFrame:
    """(paper, pos, name, family, given, initials) of ``people`` (paper, pos, name), folded; ``given`` is the first full given name."""
    rows = people.select("paper", "pos", "name").filter(F.coalesce(F.trim("name"), F.lit("")) != "")
    bare = F.regexp_replace("name", SUFFIXES, "")
    rows = rows.withColumn("plain", folded(bare)).withColumn("p", N.split_name(F.col("plain")))
    first = F.regexp_extract("p.given", r"^(\p{L}{2,}[\p{L}'’-]*)(?:\s|$)", 1)
    return rows.select("paper", "pos", "name", _key(F.col("p.family")).alias("family"), _key(first).alias("given"), N.initials(F.col("p.given")).alias("initials"), _key(F.col("p.given")).alias("all_given"))


def grade(given: str, initials: str, all_given: str, given2: str, initials2: str, all_given2: str) -> int:
    """How well given names agree; 0 if they are of two people."""
    if given and given2 and given != given2:
        return 0
    if not initials or not initials2:
        return EQUAL if initials == initials2 else BARE
    if all_given == all_given2:
        return EQUAL
    if initials == initials2:
        return INITIALS
    return BEGINS if initials.startswith(initials2) or initials2.startswith(initials) else 0


def assign(grades: list[list[int]]) -> list[int]:
    """For each row its column, or -1: the greatest sum of grades, by shortest augmenting paths over a square of costs."""
    n = max(len(grades), len(grades[0]) if grades else 0)
    # A rank of places below a unit of grade settles equal sums.
    unit = n * n * n + 1
    cost = [[0] * n for _ in range(n)]
    for i, row in enumerate(grades):
        for j, g in enumerate(row):
            cost[i][j] = -g * unit + (i + j if g else 0)
    u, v, match = [0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, back, used = [float("inf")] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        while True:
            used[j0] = True
            i0, step, j1 = match[j0], float("inf"), 0
            for j in range(1, n + 1):
                if not used[j]:
                    now = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if now < least[j]:
                        least[j], back[j] = now, j0
                    if least[j] < step:
                        step, j1 = least[j], j
            for j in range(n + 1):
                if used[j]:
                    u[match[j]] += step
                    v[j] -= step
                else:
                    least[j] -= step
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[back[j0]]
            j0 = back[j0]
    out = [-1] * len(grades)
    for j in range(1, n + 1):
        i = match[j] - 1
        if i < len(grades) and j - 1 < len(grades[0]) and grades[i][j - 1] > 0:
            out[i] = j - 1
    return out


def swapped(ours: list[tuple], theirs: list[tuple]) -> Iterator[tuple]:
    """(ours, theirs, grade) of names (pos, name, family, all_given) without a partner: those whose fields are turned, the nth with the nth, and those alone."""
    order = lambda x: (x[0] is not None, x[0] or 0, x[1])
    waiting: dict[tuple[str, str], deque[str]] = {}
    for _, name, family, given in sorted(theirs, key=order):
        if given == "":
            yield None, name, 0
        else:
            waiting.setdefault((given, family), deque()).append(name)
    for _, name, family, given in sorted(ours, key=order):
        other = waiting.get((family, given))
        yield (name, other.popleft(), SWAPPED) if other else (name, None, 0)
    yield from ((None, name, 0) for names in waiting.values() for name in names)


def match(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(paper, ours, theirs, grade) of both lists (paper, pos, name): who is who, and who is in one list alone.

    Names are folded once and dealt once, by paper.  They stream in order of families;
    a task holds a family, and of one paper the names that no family settled.
    """
    side = lambda df, n: named(df).select("paper", "family", F.lit(n).alias("side"), F.col("pos").cast("long").alias("pos"), "name", "given", "initials", "all_given")
    both = side(ours, 0).unionByName(side(theirs, 1)).repartition("paper").sortWithinPartitions("paper", "family", "side", "pos", "name")
    schema = T.StructType([both.schema["paper"], *T.StructType.fromDDL("ours string, theirs string, grade int").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sides, alone, kind, out = None, ([], []), ([], []), None, []

        def settle() -> None:
            (paper, family), (a, b) = now, sides
            taken = assign([[grade(*x[2:], *y[2:]) for y in b] for x in a]) if a and b else [-1] * len(a)
            for x, j in zip(a, taken, strict=True):
                if j < 0:
                    alone[0].append((x[0], x[1], family, x[4]))
                else:
                    out.append((paper, x[1], b[j][1], grade(*x[2:], *b[j][2:])))
            held = set(taken)
            alone[1].extend((y[0], y[1], family, y[4]) for j, y in enumerate(b) if j not in held)

        def close() -> None:
            # No paper is no paper in common.
            for part in [alone] if now[0] is not None else [(alone[0], []), ([], alone[1])]:
                out.extend((now[0], *row) for row in swapped(*part))

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate([kind, pa.string(), pa.string(), pa.int32()])], names=schema.names)
            out.clear()
            return made

        for b in batches:
            kind = b.column(0).type
            for paper, family, which, *rest in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now is None or (paper, family) != now:
                    if now is not None:
                        settle()
                        if paper != now[0]:
                            close()
                            alone = ([], [])
                    now, sides = (paper, family), ([], [])
                sides[which].append(rest)
            yield batch()
        if now is not None:
            settle()
            close()
            yield batch()

    return both.mapInArrow(run, schema)
