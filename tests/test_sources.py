"""Readers of the desk's files, with what is missing, wrapped or broken."""

import hashlib
import json

from pyspark.sql import functions as F

from proofmill.operators import papers
from proofmill.sources import files


def test_corpus_index_and_sides_give_usable_pairs(spark, tmp_path):
    index = {"event_id": 7, "papers": [{"code": "A1", "title": "x", "tags": [{"code": "TC12"}], "extra": 1}, {"code": "", "friendly_id": 5, "editor": ""}]}
    (tmp_path / "index.json").write_text(json.dumps(index))
    for role, text in (("original", "old"), ("current", "newer")):
        folder = tmp_path / "A1" / role / "Source_Files"
        folder.mkdir(parents=True)
        (folder / "main.tex").write_text(text)
        (folder / "plot.PNG").write_bytes(b"0" * 99)
    rows = files.corpus_index(spark, str(tmp_path / "index.json"))
    assert {(r.code, r.editor, tuple(r.tags or ())) for r in rows.collect()} == {("A1", None, ("TC12",)), ("c5", None, ())}
    found = files.side_files(spark, str(tmp_path)).collect()
    assert {(r.paper, r.role, r.ext, r.sha) for r in found if r.ext == ".tex"} == {("A1", "original", ".tex", hashlib.sha256(b"old").hexdigest()), ("A1", "current", ".tex", hashlib.sha256(b"newer").hexdigest())}
    numbered = files.side_files(spark, str(tmp_path)).withColumn("name", F.lit(1))
    judged = papers.usability(rows.select(F.col("code").alias("paper")), numbered)
    assert {(r.paper, r.kind, r.usable, r.reason) for r in judged.collect()} == {("A1", "latex", True, ""), ("c5", "missing", False, "nothing submitted")}


def test_states_and_decisions(spark, tmp_path):
    (tmp_path / "good.json").write_text('{"paper_id": "A1", "status": "done", "decisions": {"E001": "accepted"}, "unknown": 1}')
    (tmp_path / "bad.json").write_text('{"paper_id": "A2", ')
    rows = {r.paper_id: (r.status, r.broken) for r in files.review_states(spark, str(tmp_path)).collect()}
    assert rows["A1"] == ("done", False) and ("new", True) in rows.values()
    raw = spark.createDataFrame([('{"decisions": {"E1": "accepted"}}',), ('{"E2": "reverted"}',), (None,)], "raw string")
    assert [r[0] for r in raw.select(files.decisions(F.col("raw"))).collect()] == [{"E1": "accepted"}, {"E2": "reverted"}, None]


def test_rule_packs(spark, tmp_path):
    for version in ("1.0.0", "1.1.0"):
        pack = {"pack": "p", "version": version, "rules": [{"id": f"R-{version}", "category": "units", "applies_to": ["latex"], "title": "Space before units", "text": "5 MeV"}, {"id": "S", "category": "title", "applies_to": ["word"], "title": "Capitals"}]}
        (tmp_path / f"{version}.json").write_text(json.dumps(pack))
    rules = files.latest_pack(spark, str(tmp_path))
    assert {r.id for r in rules.collect()} == {"R-1.1.0", "S"}
    assert [r.id for r in files.search(rules, "space mev", "units", "latex").collect()] == ["R-1.1.0"] and files.search(rules, "space capitals").isEmpty() and files.search(rules, "").count() == 2


def test_pasted_lists_and_splits(spark, tmp_path):
    text = "[1] A. Alpha,\n  One.\n[2] B. Beta, Two.\n\nThree."
    rows = files.pasted(spark.createDataFrame([(1, text), (2, None), (3, "x\n\n" * 205)], "k int, t string"), "k", "t").collect()
    assert [r.reference for r in rows if r.k == 1] == ["[1] A. Alpha, One.", "[2] B. Beta, Two.", "Three."]
    assert sum(r.k == 3 for r in rows) == 200 and all(r.truncated == (r.k == 3) for r in rows)
    files.write_splits(spark.createDataFrame([("train", 1), ("eval", 2)], "split string, v int"), str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir()) == ["split=eval", "split=train"]
