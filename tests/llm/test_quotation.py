"""What is quoted: paired marks around any number of words, in four languages; and that quoting lowers a score."""

import pytest
from pyspark.sql import functions as F

from proofmill.llm import toxicity

TERMS = [(t, False, 5.0) for t in ("idiot", "imbécile", "idiota")]
SAID = [
    ('He read out the line "you are a worthless idiot" to the court', "you are a worthless idiot"),
    ("“Du bist ein Idiot”, so steht es im Brief", "Du bist ein Idiot, so steht es im Brief"),
    ("Der Brief sagt: „du bist ein Idiot“", "du bist ein Idiot"),
    ("Elle a lu « tu es un imbécile » à voix haute", "Elle a dit tu es un imbécile à voix haute"),
    ("Leyó 'eres un idiota, don't' en voz alta", "eres un idiota, don't"),
]


@pytest.mark.parametrize("quoted, plain", SAID)
def test_quoted_phrases_are_told_from_said_ones(quoted, plain):
    lexicon = toxicity.Lexicon(TERMS)
    names = toxicity.FEATURES
    a, b = (dict(zip(names, toxicity.features(t, lexicon), strict=True)) for t in (quoted, plain))
    assert a["hits"] == a["addressed"] == 0 and a["quoted"] > 0
    assert b["hits"] > 0 and b["quoted"] == 0


def test_marks_that_pair_with_nothing_quote_nothing():
    assert toxicity.quotations("don't be rude, it's bad") == []
    assert toxicity.quotations('an inch " and then\na "b" c') == [(21, 24)]
    assert toxicity.quotations("“" + "x" * 500 + "”") == []
    assert toxicity.quotations("„a“ «b» »c« ‘d’ 'e'") == [(0, 3), (4, 7), (8, 11), (12, 15), (16, 19)]


def test_quotation_lowers_the_score_on_held_out_rows(spark):
    rows = []
    for i in range(1500):
        # A fifth is abuse, some texts quote it, the others are clean.
        kind = 0 if i % 5 == 0 else 1 if i % 75 == 1 else 2
        text = [f"listen {i} you idiot go away", f'the clerk {i} noted: "listen you idiot go away" and sat down', f"a calm text {i} on roses"][kind]
        rows.append((i, text, int(kind == 0), kind))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int, kind int")
    out = toxicity.classify(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    by = {r.kind: r.score for r in out.filter("held_out").join(docs.select("doc_id", "kind"), "doc_id").groupBy("kind").agg(F.avg("score").alias("score")).collect()}
    assert by[0] > 0.7 > 0.5 > by[1] and by[2] < 0.2
