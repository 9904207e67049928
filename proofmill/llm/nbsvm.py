"""Quality classifier: naive Bayes support vectors.

A text's features are indicators of n-grams: runs of 1 to 3 bytes, and runs of 1
to 3 words by their class (case, letters, digits, symbols, length, equal to the
word before), hashed into ``SPACE`` places.  Each indicator is scaled by its
class log-count ratio, counted over a labelled sample; on the scaled, normalised
vectors a linear hinge-loss model is fitted by dual coordinate descent.  A
sigmoid fitted to the margins gives a probability.

The sample has at most ``PER_CLASS`` rows of each class, a documented bound, and
its rows are weighted in the descent and the sigmoid so that the class balance is
that of all labels.  Log-count ratios compare shares within each class, which the
sampling leaves alone, so they are counted without weights.  With the bound,
the counts (at most ``SPACE``) and the descent, in one task, have a bound too.
Scoring is one pass over all texts without a shuffle.

Defined results: null and empty texts have the bias as their only feature and
get its score.  Without a sample of both classes every score is 0.5.  Repeated
rows get equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from proofmill.llm.labelled import held_out, sample
from proofmill.llm.textscan import WINDOW, Words, add_columns, mix, slices
from proofmill.session import stash

U64 = np.uint64
BITS = 16
SPACE = 1 << (BITS + 1)
PER_CLASS = 4000
EPOCHS = 10
COST = 1.0

_UPPER, _LOWER, _DIGIT = (np.zeros(256, bool) for _ in range(3))
_UPPER[65:91] = _LOWER[97:123] = _DIGIT[48:58] = True
_HIGH = np.arange(256) >= 128
_SYMBOL = ~(_UPPER | _LOWER | _DIGIT | _HIGH)
_SOFT = np.zeros(256, bool)
_SOFT[list(b".,;:'\"()-?")] = True


def _word_classes(w: Words) -> np.ndarray:
    """A small class for each word of ``w``."""

    def some(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags[w.data])))
        return total[w.end] - total[w.start]

    n, upper, lower, hard = w.end - w.start, some(_UPPER), some(_LOWER), some(_SYMBOL & ~_SOFT)
    h = w.hashes()
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1])
    parts = ((np.minimum(hard, 3), 4), (np.minimum(upper, 2), 3), (lower > 0, 2), (some(_DIGIT) > 0, 2), (some(_HIGH) > 0, 2), (some(_SOFT) > 0, 2), (np.minimum(n // 6, 4), 5), (same, 2))
    out = np.zeros(len(n), np.int64)
    for value, base in parts:
        out = out * base + value
    return out


def place(x: np.ndarray, offset: int) -> np.ndarray:
    return (mix(x) >> U64(64 - BITS)).astype(np.int64) + offset


def indicators(texts: pa.Array) -> Iterator[np.ndarray]:
    """The places of each text's n-grams, ascending and distinct."""
    w = Words(texts)
    b = w.data.astype(U64) + U64(1)
    grams = [place(sum(b[i : len(b) - k + 1 + i] << U64(9 * i) for i in range(k)), 0) if len(b) >= k else np.zeros(0, np.int64) for k in (1, 2, 3)]
    c = _word_classes(w).astype(U64) + U64(1)
    runs = [place(sum(c[i : len(c) - k + 1 + i] * WINDOW[i + 8] for i in range(k)), 1 << BITS) if len(c) >= k else np.zeros(0, np.int64) for k in (1, 2, 3)]
    seen = np.zeros(SPACE, bool)
    for i in range(w.n_docs):
        for k in (1, 2, 3):
            seen[grams[k - 1][w.at[i] : max(w.at[i], w.at[i + 1] - k + 1)]] = True
            seen[runs[k - 1][w.bounds[i] : max(w.bounds[i], w.bounds[i + 1] - k + 1)]] = True
        found = np.flatnonzero(seen)
        seen[found] = False
        yield found


def sample_features(rows: DataFrame) -> DataFrame:
    """(label, weight, places) of the labelled texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                places = pa.array([f.astype(np.int32) for f in indicators(part.column("text"))], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("label"), part.column("weight"), places], names=["label", "weight", "places"])

    return rows.select("label", "weight", "text").mapInArrow(run, "label int, weight double, places array<int>")


def log_count_ratios(features: DataFrame) -> np.ndarray:
    """The class log-count ratio of every place."""
    counts = features.select("label", F.explode("places").alias("place")).groupBy("place").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("q"))
    p, q = np.ones(SPACE), np.ones(SPACE)
    for r in counts.collect():  # at most SPACE rows
        p[r.place] += r.p
        q[r.place] += r.q
    return np.log(p / p.sum()) - np.log(q / q.sum())


def descend(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, cost: float = COST, epochs: int = EPOCHS, weight: np.ndarray | None = None) -> tuple[np.ndarray, float, float]:
    """Dual coordinate descent for the hinge loss on scaled, normalised indicators; then the slope of the sigmoid.  Gives weights, bias and slope.

    Rows cost in proportion to ``weight``, on average ``cost``.
    """
    part = np.ones(len(rows)) if weight is None else weight / weight.mean()
    w, bias, alpha = np.zeros(SPACE), 0.0, np.zeros(len(rows))
    norms = np.array([np.sqrt(r[f] @ r[f]) for f in rows])
    scale = np.where(norms > 0, 1 / np.maximum(norms, 1e-300), 1.0)
    diagonal = np.where(norms > 0, 2.0, 1.0)
    rng = np.random.Generator(np.random.PCG64(11))
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            x = r[rows[i]] * scale[i]  # made anew: only places of the sample are held
            grad = y[i] * (w[rows[i]] @ x + bias) - 1
            new = min(max(alpha[i] - grad / diagonal[i], 0.0), cost * part[i])
            if step := (new - alpha[i]) * y[i]:
                w[rows[i]] += step * x
                bias += step
                alpha[i] = new
    margin = np.array([w[f] @ r[f] for f in rows]) * scale + bias
    slope, t = 1.0, (y > 0).astype(float)
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(slope * margin, -30, 30)))
        grad, curve = margin @ (part * (q - t)) + 0.1 * slope, (part * margin**2 * q * (1 - q)).sum() + 0.1
        slope = min(20.0, max(0.1, slope - grad / curve))
    return w, bias, slope


def fit(rows: DataFrame) -> dict[str, np.ndarray | float] | None:
    """The model for labelled texts (text, label), or None without both classes."""
    features = stash(sample_features(rows), "nbsvm")
    sizes = {r.label: r.n for r in features.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return None
    r = log_count_ratios(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xs, ys, weights = [], [], []
        for batch in batches:
            xs += [np.array(x, np.int32) for x in batch.column("places").to_numpy(zero_copy_only=False)]
            ys += batch.column("label").to_pylist()
            weights += batch.column("weight").to_pylist()
        order = sorted(range(len(xs)), key=lambda i: (ys[i], len(xs[i]), xs[i].tobytes()))
        w, bias, slope = descend([xs[i] for i in order], 2.0 * np.array([ys[i] for i in order]) - 1, r, weight=np.array([weights[i] for i in order]))
        yield pa.RecordBatch.from_pydict({"w": [w.tolist()], "bias": [bias], "slope": [slope]})

    # The bounded sample goes to one task.
    m = features.repartition(1).mapInArrow(run, "w array<double>, bias double, slope double").first()
    return {"w": np.array(m.w), "bias": m.bias, "slope": m.slope, "r": r}


def score(docs: DataFrame, model: dict | None, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability that a text has label 1."""
    if model is None:
        return docs.withColumn(name, F.lit(0.5))
    weights, squares = model["w"] * model["r"], model["r"] ** 2
    shared = docs.sparkSession.sparkContext.broadcast((weights, squares, model["bias"], model["slope"]))  # SPACE numbers each

    def make(texts: pa.Array) -> list[pa.Array]:
        w, s, bias, slope = shared.value
        margin = np.array([w[f].sum() / (np.sqrt(s[f].sum()) or 1.0) for f in indicators(texts)]) + bias
        return [pa.array(1 / (1 + np.exp(-np.clip(slope * margin, -30, 30))), pa.float64())]

    return add_columns(docs, text, [T.StructField(name, T.DoubleType())], make)


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> DataFrame:
    """Per document: doc_id, held_out, score and predicted."""
    picked = docs.select("doc_id", "text")
    scored = score(picked, fit(sample(picked, labels, label, per_class)))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
