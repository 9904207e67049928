"""Survivor-coalescence repair against exhaustive search and a plain dynamic programme over whole strings."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from proofmill.llm import conversation_repair as cr

LEGAL = re.compile(r"(s?(ua)+)?\Z")


def exhaustive(rows):
    """Every mix of at most two insertions before each row and after the last: (cost, audit, roles)."""
    found = []
    for edits in itertools.product("DKR", repeat=len(rows)):
        if any(e != "D" and r[2] for e, r in zip(edits, rows, strict=True)):
            continue
        for gaps in itertools.product((0, 1, 2), repeat=len(rows) + 1):
            audit, out, cost = "I" * gaps[0], [None] * gaps[0], 2 * sum(gaps)
            for e, r, g in zip(edits, rows, gaps[1:], strict=True):
                audit += e + "I" * g
                cost += {"D": 3, "K": r[3], "R": 2 + r[3]}[e]
                out += [(r[0], r[1]) if e == "K" else (None, r[1])] * (e != "D") + [None] * g
            first = bool(out) and out[0] is not None and (out[0][0] or "").startswith("s")
            want = "s" * first + "ua" * len(out)
            roles = [o[0] if o is not None and o[0] is not None else {"u": "user", "a": "assistant"}.get(want[i], "?") for i, o in enumerate(out)]
            if LEGAL.match("".join(x[:1] or "-" for x in roles)):
                found.append((cost, audit, "\n".join(f"{x}:{o[1] if o else ''}" for x, o in zip(roles, out, strict=True))))
    return min(found)


def plain(rows):
    """The same by a dynamic programme that keeps whole audits."""
    best = {"": (0, "", ())}
    step = lambda s, c: {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}[s].get(c)
    fits = {"": "user", "s": "user", "u": "assistant", "a": "user"}

    def put(to, s, x):
        if s is not None and (s not in to or x[:2] < to[s][:2]):
            to[s] = x

    def inserted(best):
        to = dict(best)
        for _ in range(2):
            for s, (c, a, o) in list(to.items()):
                put(to, fits[s][0], (c + 2, a + "I", (*o, (fits[s], ""))))
        return to

    for role, text, must_go, cut in rows:
        to = {}
        for s, (c, a, o) in inserted(best).items():
            put(to, s, (c + 3, a + "D", o))
            if not must_go:
                put(to, step(s, role[:1]), (c + cut, a + "K", (*o, (role, text))))
                put(to, fits[s][0], (c + 2 + cut, a + "R", (*o, (fits[s], text))))
        best = to
    cost, audit, out = min(x for s, x in inserted(best).items() if s in ("", "a"))
    return cost, audit, "\n".join(f"{r}:{t}" for r, t in out)


def searched(rows):
    search = cr.Survivors()
    for r in rows:
        search.row(*r)
    return search.end()


def random_rows(rng, n):
    return [(rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", " "]), f"t{i}", rng.random() < 0.2, rng.random() < 0.3) for i in range(n)]


def test_search_equals_exhaustive_search():
    rng = random.Random(7)
    for _ in range(120):
        rows = random_rows(rng, rng.randint(0, 4))
        cost, audit, text = exhaustive(rows)
        assert searched(rows) == (cost, audit, hashlib.sha256(text.encode()).hexdigest()), rows


def test_search_equals_a_plain_programme_on_long_rows():
    rng = random.Random(11)
    for roles in (["system"], ["user"], ["assistant"], ["user", "assistant"], ["system", "user"], ["user", "user", "assistant"], ["tool", "user"], ["user", "assistant", "system", "tool"]):
        for gone in (0, 0.3, 1):
            rows = [(rng.choice(roles), f"t{i}", rng.random() < gone, rng.random() < 0.3) for i in range(150)]
            cost, audit, text = plain(rows)
            assert searched(rows) == (cost, audit, hashlib.sha256(text.encode()).hexdigest()), (roles, gone)


def test_settled_edits_leave_the_tree():
    search, most = cr.Survivors(), 0
    for i in range(5000):
        search.row("user" if i % 2 else "assistant" if i % 7 else "user", "x", i % 11 == 0, i % 5 == 0)
        nodes = {}
        for _, leaf, _, _ in search.alive.values():
            while leaf is not None:
                nodes[id(leaf)] = leaf
                leaf = leaf.parent
        assert len(nodes) <= 7
        most = max(most, sum(len(n.letters) for n in nodes.values()))
    assert most < 60 and len(search.settled) > 4900


LETTERS = {"s": "system", "u": "user", "a": "assistant"}


def conversations():
    rng = random.Random(5)
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (1, None, "user", "b."), (1, None, "user", "b."), (1, 9, "assistant", " \t"), (-2, 5, "tool", "x")]
    for c in range(2, 150):
        for t in range(rng.randint(1, 9)):
            rows.append((c, t + (t > 3) * 2, LETTERS[rng.choice("suauaua")], rng.choice(["One. ", "Two!", "Three", "", "Où ?\n", f"{t}."])))
    rows += [(c, 3, "user", "Alone.") for c in range(600, 680)]
    rows += [(500, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(3000)]
    return rows


def expected(rows):
    by = {}
    for c, t, r, x in rows:
        own = by.setdefault(c, [])
        r, x = " " if r is None else r, " " if x is None else x
        d = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if d:
            x = "" if d == 1 else re.sub("[.!?]", "", x) if d == 2 else x
            own += [(t is not None, t or 0, "user" if d == 4 else r, x, k) for k in range(2 if d == 3 else 1)]
    out = {}
    for c, own in by.items():
        own.sort()
        seen, count, search = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, []
        for _, _, r, x, _ in own:
            rest = x.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not rest else "duplicate" if (r, x) in seen else "truncated" if rest[-1] not in ".!?" else None
            seen.add((r, x))
            if fault:
                count[fault] += 1
            search.append((r, x, fault in ("blank", "duplicate"), fault == "truncated"))
        turns = {t for known, t, *_ in own if known}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit, text = plain(search)
        out[c] = (gaps, *count.values(), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest(), text)
    return out


@pytest.fixture(scope="module")
def turns(spark):
    return spark.createDataFrame([(*r, 1) for r in conversations()], "conv_id long, turn long, role string, text string, audit int").repartition(5)


def test_query_rows_equal_a_plain_version(turns):
    want = expected(conversations())
    got = {r.conv_id: tuple(r)[1:] for r in cr.repair(cr.damaged(turns)).collect()}
    assert got == {c: x[:-1] for c, x in want.items()}
    assert any(x[6] == "" for x in want.values()) and {"D", "I", "K", "R"} <= set("".join(x[6] for x in want.values()))


def test_applied_repairs_are_the_digested_texts(turns):
    want = expected(conversations())
    rows = cr.damaged(turns)
    out = cr.apply(rows, cr.repair(rows)).orderBy("conv_id", "place").collect()
    texts = {}
    for r in out:
        texts.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert {c: "\n".join(t) for c, t in texts.items()} == {c: x[-1] for c, x in want.items() if x[-1]}


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    assert cr.repair(cr.damaged(none)).count() == 0
    texts = spark.createDataFrame([("a", 1, "user", "x.")], none.schema)
    assert cr.repair(cr.damaged(texts)).select(F.col("conv_id")).first()[0] == "a"
