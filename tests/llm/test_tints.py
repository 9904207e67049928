from pyspark.sql import functions as F

from proofmill.llm import near_duplicates
from test_operators import jaccard_components


def test_tints_of_pure_and_mixed_groups_differ(spark):
    groups = spark.createDataFrame([(-5, -5, -5), (4, 4, 9), (-7, -5, -5), (-5, -5, 3)], "grp long, low long, high long")
    tints = [r[0] for r in groups.select(near_duplicates.tint(*(F.col(c) for c in groups.columns))).collect()]
    assert tints[0] == tints[2] and len(set(tints)) == 3


def test_negative_ids(spark):
    rows = []
    for c in range(4):
        base = [f"t{c}x{i}" for i in range(60)]
        rows += [(5 * c + k - 9, " ".join([*base[: 60 - k], *(f"e{c}{k}{j}" for j in range(k))])) for k in range(5)]
    out = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()} == jaccard_components(rows)
