"""Mixing sources to target weights along a time-varying curriculum.

A source's share of the budget is its weight's share, up to ``MAX_EPOCHS`` times
its own words; what is above is shared anew by weight.  A source's demand over
training time t in [0, 1] is its target times the integral of its weight curve.
Documents of a source follow each other in the order of the MD5 of their ids,
once per epoch; a document takes the word interval that follows its
predecessor's, and its training position is the time at which cumulative demand
reaches the middle of that interval.  Documents are range-sorted by position.

Running sums come in two levels: windows over (source, cell of the hash), and
the sums of whole cells before; so a source with a third of all rows is spread
over 4096 windows, and one without ids over as many as it has sizes, times 16.
Rows that tie follow by a hash of all their columns, so reruns agree.  An id that
many rows repeat with other texts isn't split.  Only the list of sources, with a
number each, is handled in one task: it must be bounded, as for names of corpora.

Defined results: a null text or one without words has size 0 and takes nothing.
A null source is a source of its own, the last one.  Repeated rows follow each
other and count each.  Empty table: empty result.  Further columns pass through
``mix``; what it adds is in one
struct column, under a name that starts with __pm_, which is reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from proofmill.llm.textscan import quoted
from proofmill.session import stash

WEIGHTS = (3.0, 1.0, 2.0)
BUDGET = 1.5
MAX_EPOCHS = 2
HEX_DIGITS = 3
#: Weight over training time, as (time, relative weight) knots with straight lines between, by place in WEIGHTS: fading, rising, steady.
CURVES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.75)), ((0.0, 1.0), (1.0, 1.0)))
STRUCT = "__pm_mix"
NO_ID = "d41d8cd98f00b204e9800998ecf8427e"  # the MD5 of nothing
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def invert(share: Column, curve) -> Column:
    """The time at which the integral of ``curve`` reaches ``share`` of its whole."""
    areas = [(t1 - t0) * (a + b) / 2 for (t0, a), (t1, b) in zip(curve, curve[1:], strict=False)]
    whole, done, out = sum(areas), 0.0, None
    for ((t0, a), (t1, b)), area in zip(zip(curve, curve[1:], strict=False), areas, strict=True):
        u = (share * whole - done) / area
        time = t0 + (t1 - t0) * u * (a + b) / (a + F.sqrt(F.greatest(F.lit(0.0), F.lit(a * a) + (b * b - a * a) * u)))
        done += area
        out = F.when(share * whole <= done, time) if out is None else out.when(share * whole <= done, time)
    return out.otherwise(F.lit(float(curve[-1][0])))


def targets(sums: DataFrame, weights=WEIGHTS, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Per source (src, no_src, source_size): its class of weight and its target, by filling to a common level."""
    one = W.orderBy("no_src", "src")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("place") + 1).cast("int"))
    s = sums.withColumn("place", (F.row_number().over(one) - 1) % len(weights)).withColumn("w", w)
    s = s.withColumn("cap", (max_epochs * F.col("source_size")).cast("double")).withColumn("ratio", F.col("cap") / F.col("w"))
    by_ratio = W.orderBy("ratio", "no_src", "src")
    full = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    everything = W.orderBy("ratio", "no_src", "src").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    capped, w_capped = F.coalesce(F.sum("cap").over(full), F.lit(0.0)), F.coalesce(F.sum("w").over(full), F.lit(0.0))
    s = s.withColumn("level", (budget * F.sum("source_size").over(everything).cast("double") - capped) / (F.sum("w").over(everything) - w_capped))
    s = s.withColumn("common", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "no_src", "src", "level"))).over(everything)["level"])
    return s.withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("common") * F.col("w"), F.col("cap"))))


def mix(docs: DataFrame, size: str, doc_id: str = "doc_id", source: str = "source", weights=WEIGHTS, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS, curves=CURVES) -> DataFrame:
    """``docs`` with a struct: size, source_size, target, epochs taken, and the training position of each."""
    h = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))
    tie = F.xxhash64(*[c for c, f in zip(quoted(docs), docs.schema, strict=True) if "map<" not in f.dataType.simpleString()])
    # Null ids share one hash: their cells are by size and tie too, in the order of the rows.
    no_id = F.concat(F.lit("1"), F.lpad(F.col(size).cast("string"), 19, "0"), F.hex(F.shiftrightunsigned(tie.bitwiseXOR(F.lit(-(2**63))), 60)))
    fine = F.when(F.col(doc_id).isNull(), no_id).otherwise(F.when(h < NO_ID, "0").otherwise("2"))
    keyed = docs.select("*", F.struct(F.coalesce(F.col(source), F.lit("")).alias("src"), F.col(source).isNull().alias("no_src"), h.alias("h"), F.concat(F.substring(h, 1, HEX_DIGITS), fine).alias("cell"), F.col(size).alias("size"), tie.alias("tie")).alias(STRUCT))
    key = [F.col(f"{STRUCT}.{k}").alias(k) for k in ("src", "no_src", "cell")]
    cells = stash(keyed.groupBy(*key).agg(F.sum(f"{STRUCT}.size").alias("cell_size")), "mix-cells")
    goals = targets(cells.groupBy("src", "no_src").agg(F.sum("cell_size").alias("source_size")), weights, budget, max_epochs)
    earlier = W.partitionBy("src", "no_src").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.withColumn("offset", F.coalesce(F.sum("cell_size").over(earlier), F.lit(0))).join(goals, ["src", "no_src"])
    cells = cells.select(F.struct("src", "no_src", "cell").alias("__pm_at"), F.struct("offset", "source_size", "target", "place").alias("__pm_goal"))
    at = F.struct(*key)
    before = W.partitionBy("__pm_at").orderBy(f"{STRUCT}.h", doc_id, f"{STRUCT}.size", f"{STRUCT}.tie").rowsBetween(W.unboundedPreceding, W.currentRow)
    run = keyed.withColumn("__pm_at", at).withColumn("__pm_end", F.sum(f"{STRUCT}.size").over(before)).join(cells, "__pm_at")
    n, goal, total = F.col(f"{STRUCT}.size"), F.col("__pm_goal.target"), F.col("__pm_goal.source_size")
    start = F.col("__pm_goal.offset") + F.col("__pm_end") - n
    middle = [(start + e * total).cast("double") + n / 2 for e in range(max_epochs)]
    epochs = sum((F.when(m <= goal, 1).otherwise(0) for m in middle[1:]), F.when(middle[0] <= goal, 1).otherwise(0))
    epochs = F.when(n > 0, epochs).otherwise(0)
    curve = F.col("__pm_goal.place") % len(curves)

    def position(m: Column) -> Column:
        share = m / goal
        out = F.when(curve == 0, invert(share, curves[0]))
        for i, c in enumerate(curves[1:], 1):
            out = out.when(curve == i, invert(share, c))
        return out

    places = F.array(*[F.when((n > 0) & (m <= goal), position(m)) for m in middle])
    mixed = F.struct(n.alias("size"), total.alias("source_size"), goal.alias("target"), epochs.alias("epochs"), F.array_compact(places).alias("positions"))
    return run.select(*quoted(docs), mixed.alias(STRUCT))


def training_order(mixed: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """What the mix takes, a row per epoch of a document, range-sorted by training position."""
    return mixed.withColumn("__pm_position", F.explode(f"{STRUCT}.positions")).orderBy("__pm_position", doc_id)


#: The targets and the words taken, in SQL over ``documents``.
SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS src, source IS NULL AS no_src, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
    CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size FROM documents),
s AS (SELECT src, no_src, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY src, no_src),
p AS (SELECT *, [{', '.join(f'{x}::DOUBLE' for x in WEIGHTS)}][(row_number() OVER (ORDER BY no_src, src) - 1) % {len(WEIGHTS)} + 1] AS w, CAST({MAX_EPOCHS} * source_size AS DOUBLE) AS cap FROM s),
l AS (SELECT *, cap / w AS ratio, ({BUDGET}::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level
  FROM p WINDOW o AS (ORDER BY cap / w, no_src, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT src, no_src, source_size, least(cap, coalesce((SELECT level FROM l AS k WHERE k.level <= k.ratio ORDER BY ratio, no_src, src LIMIT 1) * w, cap)) AS target FROM l),
r AS (SELECT d.*, t.source_size, t.target, sum(size) OVER (PARTITION BY src, no_src ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS c FROM d JOIN t USING (src, no_src))
SELECT doc_id, size, source_size, target, CAST(size * (CAST(CAST(c AS DOUBLE) + size / 2.0::DOUBLE <= target AS INT) + CAST(CAST(c + source_size AS DOUBLE) + size / 2.0::DOUBLE <= target AS INT)) AS BIGINT) AS taken
FROM r
"""
