"""Literal cases of the rules, and plain versions of what SQL can't say."""

import random

import pytest
from pyspark.sql import functions as F

from proofmill.functions import scalars, texts
from proofmill.operators import dataset, edits, hunks, ordered, scoring
from proofmill.plans import dataset as dataset_plans
from proofmill.streaming import claims

EDIT = "file string, start int, end int, before string, after string, check_id string, priority int"


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_edits_at_boundaries_all_stay(spark):
    rows = [("f", 2, 4, "cd", "X", "a", 10), ("f", 2, 2, "", "!", "b", 20), ("f", 6, 6, "", "?", "c", 30), ("f", 6, 6, "", ";", "d", 30)]
    found = edits.claimed(spark.createDataFrame(rows, EDIT))
    assert {r.check_id: r.kept for r in found.collect()} == dict.fromkeys("abcd", True)


def test_edits_inside_and_repeated(spark):
    rows = [("f", 0, 5, "abcde", "X", "low", 80), ("f", 2, 2, "", "!", "point", 60), ("f", 6, 8, "gh", "Y", "one", 40), ("f", 6, 8, "gh", "Y", "two", 50), ("f", 7, 9, "hi", "Z", "over", 41), ("f", 9, 9, "", "+", "edge", 90)]
    found = {r.check_id: r.kept for r in edits.claimed(spark.createDataFrame(rows, EDIT)).collect()}
    assert found == {"low": False, "point": True, "one": True, "over": False, "edge": True}


def test_resolve_equals_a_walk_over_all_claims(spark):
    rng = random.Random(6)
    rows = []
    for f in range(40):
        for i in range(30):
            start = rng.randrange(60)
            rows.append((f"f{f}", start, start + rng.choice([0, 0, 1, 3, 8]), "", str(i), "c", rng.choice([10, 40, 80])))
    got = {(r.file, r.after): r.kept for r in edits.claimed(spark.createDataFrame(rows, EDIT)).collect()}
    for f in {r[0] for r in rows}:
        kept = []
        for r in sorted((r for r in rows if r[0] == f), key=lambda r: (r[6], r[1], r[2], r[4])):
            clash = any((a < r[2] and r[1] < b) if a < b and r[1] < r[2] else (a < r[1] < b) if a < b else (r[1] <= a < r[2]) if r[1] < r[2] else False for a, b in kept)
            assert got[f, r[4]] != clash
            if not clash:
                kept.append((r[1], r[2]))


@pytest.mark.parametrize("before, after, want", [
    ("At 10 MeV\nit\nran.", "At 10 MeV it ran.", []),
    ("At 10 MeV.", "At 10~MeV.", [("replace", "10 MeV.", "10~MeV.")]),
    ("a  b", "a b", []),
    ("a b", "a b", []),
    ("the beem is on", "the beam is on", [("replace", "beem", "beam")]),
    ("one.\n\ntwo is here.", "one.", [("delete", "two is here.", "")]),
    ("one.", "one.\n\ntwo is here.", [("insert", "", "two is here.")]),
    ("completely other words", "12345 67890", [("replace", "completely other words", "12345 67890")]),
])
def test_hunks(spark, before, after, want):
    pairs = spark.createDataFrame([(1, before, after), (2, None, None)], "paper int, before string, after string")
    assert [(r.kind, r.before, r.after) for r in hunks.hunks(pairs).orderBy("idx").collect()] == want


def test_hunks_rebuild_the_words(spark):
    """Of random edits of words: every hunk's texts stand in their paragraph, and equal texts have none."""
    rng = random.Random(1)
    rows = []
    for i in range(60):
        a = [rng.choice(["beam", "of", "10", "MeV", "and", "(x)", "a,b"]) for _ in range(30)]
        b = [w if rng.random() > 0.1 else rng.choice(["beams", "", "12"]) for w in a]
        rows.append((i, " ".join(a), " ".join(w for w in b if w)))
    found = hunks.hunks(spark.createDataFrame(rows, "paper int, before string, after string")).collect()
    by = {r[0]: r for r in rows}
    assert found and all(h.before in by[h.paper][1] and h.after in by[h.paper][2] and h.before != h.after for h in found)
    assert {h.paper for h in found} == {i for i, a, b in rows if a != b}


def test_matches_go_by_strength(spark):
    proposals = spark.createDataFrame([(1, i, b, a) for i, (b, a) in enumerate([("10 MeV", "10~MeV"), ("X. Du", "X.~Du"), ("doi:1", "doi:2"), ("beam line", "beamline"), ("x", "y"), ("the cat", "the dog"), ("never", "there")])], "paper int, pid int, before string, after string")
    theirs = spark.createDataFrame([(1, 0, "see 10 MeV now", "see 10~MeV now"), (1, 1, "10 MeV", "10~MeV"), (1, 2, "X. Du", "X.\\,Du"), (1, 3, "the cat", "the bird"), (1, 4, "a doi:1 " + "word " * 30, "a doi:3 " + "word " * 30), (1, 5, "line", "beamline")], "paper int, idx int, before string, after string")
    got = {r.pid: (r.how, r.hunk, r.editors_did) for r in scoring.judge(proposals, theirs).collect()}
    assert got == {0: ("exact", 1, ""), 1: ("near exact", 2, ""), 2: ("", None, ""), 3: ("covers-hunk", 5, ""), 4: ("", None, ""), 5: ("contradicted", 3, "the bird"), 6: ("", None, "")}


def test_readings(spark):
    read = lambda zone, rate, n, bad=0: one(spark, texts.verdict(F.lit(zone), F.lit(rate), F.lit(n), F.lit(bad)))
    assert read("references", 0.95, 10) == "strong" and read("references", 0.6, 10) == "mixed" and read("references", 0.1, 10) == "low in a strict zone"
    assert read("running text", 0.1, 10) == "editors vary here" and read("references", 1.0, 4) == "too few to say" and read("references", 1.0, 40, 2) == "2 contradicted"


def test_splits_by_hash(spark):
    import hashlib

    rows = spark.range(500).select("id", dataset.split_of(F.col("id"), 0.1).alias("s")).collect()
    assert all(r.s == ("eval" if int(hashlib.sha256(str(r.id).encode()).hexdigest(), 16) % 1000 < 100 else "train") for r in rows)


def test_pairs_of_references_equal_a_walk(spark):
    old, new = dataset_plans._references(spark, "/root/testdata/sf0.001")
    got = {(r.paper, r.label): r.new_label for r in dataset.pair(old, new).collect()}
    papers = {}
    for side, df in enumerate((old, new)):
        for r in df.collect():
            papers.setdefault(r.paper, ({}, {}))[side][r.label] = r.text
    words = lambda t: {w for w in "".join(c if c.isalnum() else " " for c in t.lower()).split() if len(w) >= 3}
    name = lambda t: "" if t.startswith("u") else t.split()[-5 if "edited" not in t else -7].lower() if not t.startswith("u") else ""
    like = lambda a, b: len(words(a) & words(b)) / len(words(a) | words(b))
    want = {}
    for p, (a, b) in papers.items():
        known = lambda x, y: name(x) and name(y)
        free, left = set(b), []
        for k in a:
            if k in b and not (known(a[k], b[k]) and name(a[k]) != name(b[k])) and like(a[k], b[k]) >= (0.25 if known(a[k], b[k]) else 0.45):
                want[p, k] = k
                free.discard(k)
            else:
                left.append(k)
        for k in sorted(left):
            best = max(((like(a[k], b[n]), n) for n in free if not (known(a[k], b[n]) and name(a[k]) != name(b[n])) and like(a[k], b[n]) >= 0.45), default=None)
            if best:
                want[p, k] = best[1]
                free.discard(best[1])
    assert got == want


def test_order_and_numbers(spark):
    cited = spark.createDataFrame([(1, n, i) for i, n in enumerate([1, 3, 2, 1, 4])], "paper int, n int, pos int")
    assert [(r.n, r.highest) for r in ordered.out_of_order(cited, "paper", "n", "pos").collect()] == [(2, 3)]
    assert [(r.n, r.expected) for r in ordered.misnumbered(cited, "paper", "n", "pos").orderBy("expected").collect()] == [(3, 2), (2, 3), (1, 4), (4, 5)]


def test_small_functions(spark):
    assert one(spark, scalars.clean_doi(F.lit("https://doi.org/10.1/a(b)c).,"))) == "10.1/a(b)c"
    assert one(spark, scalars.citation_range(F.lit("1, 3-5; x, 9 – 8"))) == [1, 3, 4, 5]
    assert one(spark, texts.only_space_differs(F.lit("a  b"), F.lit("a b"))) and not one(spark, texts.only_space_differs(F.lit("a b"), F.lit("a~b")))
    assert one(spark, texts.signature(F.lit("pp. 12"), F.lit("pp. 12-15"))) == "pp. # -> pp. #-#"
    assert one(spark, scalars.safe_filename(F.lit("../MOPA001*.pdf"))) == "MOPA001_.pdf"


def test_claims_stream_gives_the_batch_rows(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"p{rng.randrange(4)}", i, rng.choice(["take", "take", "release", "take_over", "free"]), f"e{rng.randrange(3)}") for i in range(200)]
    schema = "paper string, seq long, action string, who string"
    actions = spark.createDataFrame(rows, schema)
    want = sorted(claims.history(actions).collect(), key=lambda r: r.seq)
    holder = {}
    for r in want:
        before = holder.get(r.paper)
        ok, after = {"take": (before in (None, r.who), before or r.who), "release": (before == r.who, None if before == r.who else before), "take_over": (True, r.who), "free": (before is not None, None)}[r.action]
        assert (r.accepted, r.holder) == (ok, after)
        holder[r.paper] = after
    for n, part in enumerate((rows[:90], rows[90:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        query = claims.follow(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    assert sorted(spark.read.parquet(str(tmp_path / "out")).collect(), key=lambda r: r.seq) == want


def test_windows_and_bursts_of_a_stream(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:02"), (1, "2024-01-01 00:00:09"), (2, "2024-01-01 00:00:01"), (9, "2024-01-01 03:00:00")]
    events = spark.createDataFrame(rows, "k int, t string").select("k", F.col("t").cast("timestamp").alias("ts"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = claims.debounced(stream, "k", "ts").writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    got = {(r.k, r.n) for r in spark.table("bursts").collect()}
    assert got <= {(1, 2), (1, 1), (2, 1), (9, 1)} and {(1, 2), (1, 1), (2, 1)} <= got


def test_title_similarity_is_the_better_of_two(spark):
    from difflib import SequenceMatcher

    from proofmill.operators import registry

    pairs = [("Beam dynamics in rings", "Beam dynamics of the ring"), ("Étude of <i>beams</i>", "etude of beams"), ("", "x"), ("a b c", "c b a"), (None, "x")]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", registry.similarity(F.col("a"), F.col("b")).alias("s")).collect()

    def plain(a, b):
        import re
        import unicodedata

        x, y = (re.findall("[a-z0-9]+", "".join(c for c in unicodedata.normalize("NFKD", re.sub("<[^>]*>?", " ", t or "")) if not unicodedata.combining(c)).lower()) for t in (a, b))
        return max(SequenceMatcher(None, " ".join(x), " ".join(y)).ratio(), len(set(x) & set(y)) / len(set(x) | set(y))) if x and y else 0.0

    for r in rows:
        assert abs(r.s - plain(r.a, r.b)) < 1e-9
