"""Normal forms against plain versions on odd texts, and as one generated expression."""

import random
import re

from proofmill.functions import texts as X
from proofmill.plans import scalars
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_forms_of_odd_texts(spark):
    rng = random.Random(3)
    marks = [" ", "  ", "\n", "\t", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", " ", "　", "​", "~", "\\,", "\\ ", "\\", "“", "’", "–", ".", "é", "😀", "7", "42", "a", "Word"]
    texts = ["", None, " ", "\\\n,", *("".join(rng.choice(marks) for _ in range(rng.randint(1, 150))) for _ in range(400))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(4)
    c = F.col("text")
    got = {r.i: r for r in df.select("i", X.norm(c).alias("norm"), X.loose(c).alias("loose"), X.dataset_form(c).alias("form"), X.answer_form(c).alias("answer"), X.shape(c).alias("shape"), X.n_words(c).alias("n")).collect()}
    for i, t in enumerate(texts):
        norm = " ".join((t or "").split())
        plain = " ".join((t or "").translate(str.maketrans("“”’–\xa0", "\"\"'- ")).split())
        loose = " ".join(norm.replace("~", " ").replace("\\,", " ").replace("\\ ", " ").split())
        shape = re.sub(r"[ \t\n\x0b\f\r]+", " ", re.sub("[0-9]+", "#", (t or "").strip(" ")))[:60]
        assert (got[i].norm, got[i].loose, got[i].form, got[i].answer, got[i].shape, got[i].n) == (norm, loose, plain.lower(), plain.rstrip("."), shape, len(norm.split())), (t, got[i])


def test_forms_are_generated_code(spark):
    plan = scalars.text_forms(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and "*(1) Project" in plan
