"""Quality rules with host verdicts.

Every text is measured and held against the rules.  Failures are summed by
host; each host's failure rate of each rule is shrunk toward the rate of all
hosts with a beta prior fitted to the hosts, so that a host with few documents
isn't condemned by two of them.  The posterior goes back to the host's documents
in two ways.  A host whose shrunk rate of any rule is above the limit is rejected
with all it has.  Else it says what a document's own failure of a soft rule means:
the document's rate is read as if ``PSEUDO`` more of its words or lines failed at
its host's posterior rate, and only if it is still above the rule's bound the
document is rejected.  So a host that often fails makes a thin failure count, and one
that seldom does clears a repeated line in a text of three.

Defined results: a null or empty text has zeros for all measures and fails the
rule on few words.  A null host is a group like any other in counts and rates, but is
never rejected as a host.  Repeated rows count as often as they occur.  An empty
table gives an empty result.  Further columns pass through; the measures come in
one struct column, under a name that starts with __pm_, which is reserved.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from proofmill.llm.textscan import AS_IS, Words, add_columns, windows
from proofmill.session import stash

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
#: A host is rejected if its shrunk failure rate of a rule is above this.
HOST_LIMIT = 0.5
#: The prior counts as so many documents at least and at most.
PRIOR_DOCS = (1.0, 10_000.0)
#: What a document's own rate of a soft rule is mixed with: so many words or lines at its host's rate.
PSEUDO = {"symbols": 10, "dup_lines": 4}
#: Soft rules: the measures whose rate is bounded, and the bound in tenths.
SOFT = {"symbols": ("n_symbols", "n_words", 1), "dup_lines": ("n_dup_lines", "n_lines", 3)}
#: Hosts are broadcast while their names have at most so many bytes; beyond, they meet documents by shuffle.
BROADCAST_BYTES = 64 << 20
STRUCT = "__pm_quality"


def measure_texts(texts: pa.Array) -> list[pa.Array]:
    words = Words(texts)
    lead = (words.data & 0xC0) != 0x80
    chars, symbols = words.per_doc(words.inside & lead), words.per_doc(SYMBOLS[words.data])
    h = words.hashes(AS_IS)
    lines, dup, repeated = (np.zeros(words.n_docs, np.int64) for _ in range(3))
    data = words.data.tobytes()
    for i in range(words.n_docs):
        seen: set[bytes] = set()
        for line in data[words.at[i] : words.at[i + 1]].split(b"\n"):
            if line.strip(b" \t\n\v\f\r"):
                lines[i] += 1
                dup[i] += line in seen
                seen.add(line)
        own = windows(h[words.bounds[i] : words.bounds[i + 1]], 3)
        if len(own) > 1:
            _, where, times = np.unique(own, return_inverse=True, return_counts=True)
            again = times[where] > 1
            covered = np.zeros(len(own) + 2, bool)
            for j in range(3):
                covered[j : j + len(own)] |= again
            repeated[i] = covered.sum()
    arrays = [pa.array(x.astype(np.int64)) for x in (words.count, chars, symbols, lines, dup, repeated)]
    return [pa.StructArray.from_arrays(arrays, names=list(MEASURES))]


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with a struct column of the measures of each whole text."""
    kind = T.StructType([T.StructField(m, T.LongType()) for m in MEASURES])
    return add_columns(df, text, [T.StructField(STRUCT, kind)], measure_texts)


def rules(m: str = STRUCT) -> dict[str, Column]:
    """True where a document fails the rule."""
    c = {k: F.col(f"{m}.{k}") for k in MEASURES}
    return {
        "few_words": c["n_words"] < 50,
        "repeats": 100 * c["n_repeat_words"] > 50 * c["n_words"],
        **{k: 10 * c[part] > tenths * c[whole] for k, (part, whole, tenths) in SOFT.items()},
    }


def base_failed(m: str = STRUCT) -> Column:
    return rules(m)["few_words"] | rules(m)["repeats"]


def host_verdicts(measured: DataFrame, host: str, limit: float = HOST_LIMIT) -> DataFrame:
    """One row per host: documents, and failures and shrunk rate by rule, and whether the host is rejected."""
    names = list(rules())
    hosts = measured.groupBy(F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c.cast("long")).alias(f"f_{k}") for k, c in rules().items()]
    )
    prior = hosts.agg(
        F.avg(1 / F.col("n")).alias("per_doc"),
        *[(F.sum(f"f_{k}") / F.sum("n")).alias(f"m_{k}") for k in names],
        *[F.var_pop(F.col(f"f_{k}") / F.col("n")).alias(f"v_{k}") for k in names],
    )
    # One row of moments, so this join multiplies nothing.
    both = hosts.join(F.broadcast(prior))
    low, high = PRIOR_DOCS
    rejected = F.lit(False)
    for k in names:
        mean, spread = F.col(f"m_{k}"), F.col(f"m_{k}") * (1 - F.col(f"m_{k}"))
        between = F.col(f"v_{k}") - spread * F.col("per_doc")
        docs = F.when(between <= spread / (high + 1), F.lit(high)).otherwise(F.greatest(F.lit(low), F.try_divide(spread, between) - 1))
        both = both.withColumn(f"r_{k}", (F.col(f"f_{k}") + mean * docs) / (F.col("n") + docs))
        rejected = rejected | (F.col(f"r_{k}") > limit)
    return both.select("host", "n", *[f"f_{k}" for k in names], *[f"r_{k}" for k in names], (rejected & F.col("host").isNotNull()).alias("host_rejected"))


def posteriors(measured: DataFrame, host: str, limit: float = HOST_LIMIT) -> DataFrame:
    """(p_host, host_rejected, p_ of each soft rule) of each host, for broadcast if a sum of their bytes finds them few."""
    hosts = stash(host_verdicts(measured, host, limit).select(F.col("host").alias("p_host"), "host_rejected", *[F.col(f"r_{k}").alias(f"p_{k}") for k in SOFT]), "hosts")
    size = hosts.agg(F.sum(F.coalesce(F.octet_length("p_host"), F.lit(0)) + 64)).first()[0] or 0
    return F.broadcast(hosts) if size <= BROADCAST_BYTES else hosts


def own_failed(m: str = STRUCT) -> Column:
    """True where a document fails a soft rule and its host's posterior doesn't clear it."""
    failed = F.lit(False)
    for k, (part, whole, tenths) in SOFT.items():
        shrunk = (F.col(f"{m}.{part}") + PSEUDO[k] * F.col(f"p_{k}")) / (F.col(f"{m}.{whole}") + PSEUDO[k])
        failed = failed | (rules(m)[k] & (10 * shrunk > tenths))
    return failed


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """One row per document: id, host, measures, ``base_failed``, ``host_rejected``, ``own_failed`` and ``kept``."""
    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(host).alias("host"))
    measured = stash(measure(picked).select("doc_id", "host", STRUCT), "quality")
    both = measured.join(posteriors(measured, "host", limit), F.col("host").eqNullSafe(F.col("p_host")))
    return both.select(
        "doc_id", "host", f"{STRUCT}.*", base_failed().alias("base_failed"), "host_rejected", own_failed().alias("own_failed"),
        (~base_failed() & ~F.col("host_rejected") & ~own_failed()).alias("kept"),
    )


def keep_good(docs: DataFrame, text: str = "text", host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """The rows of ``docs`` that the rules and the hosts' posteriors keep, with their own columns."""
    slim = measure(docs.select(F.col(text).alias("text"), F.col(host).alias("host"))).select("host", STRUCT)
    hosts = posteriors(slim, "host", limit)
    good = measure(docs, text).filter(~base_failed())
    kept = good.join(hosts, good[host].eqNullSafe(hosts["p_host"])).filter(~F.col("host_rejected") & ~own_failed())
    return kept.select(*[good[q] for q in (f"`{c.replace('`', '``')}`" for c in docs.columns)])


WORD = r"[^\x20\x09-\x0D]+"
#: The measures of ``documents`` in SQL, for other oracles too.
MEASURES_SQL = rf"""
w AS (SELECT row_number() OVER () AS rid, doc_id, source, text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
win AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
again AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, k) > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, i + unnest([0, 1, 2]) AS p FROM again) GROUP BY rid),
lin AS (SELECT rid, line FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '{WORD}')),
dup AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n FROM lin GROUP BY rid),
m AS (SELECT w.doc_id, w.source AS host, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(dup.n_lines, 0) AS n_lines,
  coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words FROM w LEFT JOIN rep USING (rid) LEFT JOIN dup USING (rid))
"""


def verdicts_sql(limit: float = HOST_LIMIT) -> str:
    tests = {"few_words": "n_words < 50", "repeats": "100 * n_repeat_words > 50 * n_words", "symbols": "10 * n_symbols > n_words", "dup_lines": "10 * n_dup_lines > 3 * n_lines"}
    low, high = (f"{x}::DOUBLE" for x in PRIOR_DOCS)
    docs = {k: f"CASE WHEN v_{k} - m_{k} * (1 - m_{k}) * per_doc <= m_{k} * (1 - m_{k}) / ({high} + 1) THEN {high} ELSE greatest({low}, m_{k} * (1 - m_{k}) / (v_{k} - m_{k} * (1 - m_{k}) * per_doc) - 1) END" for k in tests}
    return f"""
hosts AS (SELECT host, count(*) AS n, {', '.join(f'sum(CAST({t} AS INT)) AS f_{k}' for k, t in tests.items())} FROM m GROUP BY host),
prior AS (SELECT avg(1.0::DOUBLE / n) AS per_doc, {', '.join(f'sum(f_{k})::DOUBLE / sum(n) AS m_{k}, var_pop(f_{k}::DOUBLE / n) AS v_{k}' for k in tests)} FROM hosts),
posterior AS (SELECT host, {', '.join(f'(f_{k} + m_{k} * {d}) / (n + {d}) AS r_{k}' for k, d in docs.items())} FROM hosts, prior),
verdict AS (SELECT host AS p_host, host IS NOT NULL AND ({' OR '.join(f'r_{k} > {limit}' for k in tests)}) AS rejected, r_symbols, r_dup_lines FROM posterior)
"""


SQL = f"""
WITH {MEASURES_SQL}, {verdicts_sql()},
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 10 * n_symbols > n_words AND 10 * (n_symbols + {PSEUDO['symbols']} * r_symbols) / (n_words + {PSEUDO['symbols']}) > 1
  OR 10 * n_dup_lines > 3 * n_lines AND 10 * (n_dup_lines + {PSEUDO['dup_lines']} * r_dup_lines) / (n_lines + {PSEUDO['dup_lines']}) > 3 AS own_failed FROM m JOIN verdict ON host IS NOT DISTINCT FROM p_host)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AND NOT own_failed AS kept FROM b
"""
