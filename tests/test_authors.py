"""The assignment against all assignments, and literal lists."""

import itertools
import random

from proofmill.operators import authors


def best(grades):
    n, m = len(grades), len(grades[0])
    columns = [*range(m), *[-1] * n]
    return max(sum(grades[i][j] for i, j in enumerate(p) if j >= 0) for p in set(itertools.permutations(columns, n)))


def test_assignments_have_the_greatest_sum():
    rng = random.Random(1)
    for _ in range(200):
        n, m = rng.randint(1, 4), rng.randint(1, 4)
        grades = [[rng.choice([0, 0, 1, 2, 4, 8]) for _ in range(m)] for _ in range(n)]
        got = authors.assign(grades)
        taken = [j for j in got if j >= 0]
        assert len(set(taken)) == len(taken) and all(grades[i][j] > 0 for i, j in enumerate(got) if j >= 0)
        assert sum(grades[i][j] for i, j in enumerate(got) if j >= 0) == best(grades)


def test_lists(spark):
    ours = [(1, 1, "A. B. Smith"), (1, 2, "A. C. Smith"), (1, 3, "José García"), (1, 4, "Wei Zhang"), (1, 5, "J. van der Berg Jr."), (1, 6, "Anna Miller"), (1, 7, None), (1, 8, ""), (2, 1, "X. Yew"), (2, 2, "X. Yew"), (3, 1, "Lone")]
    theirs = [(1, 1, "A. C. Smith"), (1, 2, "J. GARCIA"), (1, 3, "Zhang Wei"), (1, 4, "Van der Berg, John"), (1, 5, "Alice Miller"), (2, 9, "Yew, X."), (4, 1, "Other")]
    a, b = (spark.createDataFrame(x, "paper int, pos int, name string").repartition(3) for x in (ours, theirs))
    got = sorted(((r.paper, r.ours, r.theirs, r.grade) for r in authors.match(a, b).collect()), key=repr)
    assert got == sorted([
        (1, "A. B. Smith", None, 0), (1, "A. C. Smith", "A. C. Smith", 8), (1, "José García", "J. GARCIA", 4), (1, "Wei Zhang", "Zhang Wei", 1), (1, "J. van der Berg Jr.", "Van der Berg, John", 4),
        (1, "Anna Miller", None, 0), (1, None, "Alice Miller", 0), (2, "X. Yew", "Yew, X.", 8), (2, "X. Yew", None, 0), (3, "Lone", None, 0), (4, None, "Other", 0),
    ], key=repr)


def test_turned_names_meet_within_their_paper_the_nth_with_the_nth(spark):
    people = "paper int, pos int, name string"
    ours = spark.createDataFrame([(1, 2, "Wei Chen"), (1, 1, "Wei Chen"), (2, 1, "Wei Chen"), (3, 1, "Solo"), (None, 1, "Wei Chen"), (1, 3, "Ann Lee")], people)
    theirs = spark.createDataFrame([(1, 1, "Chen Wei"), (3, 1, "Wei Chen"), (None, 1, "Chen Wei"), (1, 2, "Ann Lee"), (4, 1, "Only")], people)
    got = sorted(((r.paper or 0, r.ours or "", r.theirs or "", r.grade) for r in authors.match(ours, theirs).collect()))
    assert got == [(0, "", "Chen Wei", 0), (0, "Wei Chen", "", 0), (1, "Ann Lee", "Ann Lee", 8), (1, "Wei Chen", "", 0), (1, "Wei Chen", "Chen Wei", 1), (2, "Wei Chen", "", 0), (3, "", "Wei Chen", 0), (3, "Solo", "", 0), (4, "", "Only", 0)]
    plan = authors.match(ours, theirs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2 and "Join" not in plan
