"""Audit of how the sources of a language differ in their terms, with strings joined in late.

Terms are runs of ASCII letters and of what is beyond ASCII, lower-cased in A-Z.
What is shuffled to count them are fixed-width digests, added up within a task
first.  A second scan gives the least and the greatest string of each digest that
stays (a filter of fixed size leaves most others out before that shuffle): where
the two differ, several terms share the digest, and a third scan counts just
those digests' terms by their text.  So results are exact for any digest.  Texts
are joined back to the few terms that are reported.

A group is a source of a language, with p = 1 + floor(10^9 (count + 1) / (N + V))
of each of the language's V kept terms (those in ``MIN_DOCS`` of its documents or
more), N the group's count over them.  The difference of p from q is
floor((p - q)^2 / q).  A sum over all terms for each pair of groups goes through
the terms that both have (from one row per term with its groups), through each
group's own counts against the other's p of an absent term, and through the
number of terms that neither has; no pair of groups is made for a term that they
don't share.  All arithmetic is on integers; shares are divided in three steps of
1000, exact for up to 9 * 10^15 counted terms.

Defined results: a null text, language or source is an empty string.  Groups
without terms have pairs with p from counts of 0, and no terms; a language without kept
terms has pairs of value 0.  Repeated rows count as often as they occur.  Ties
go by the item's UTF-8 bytes.  A text beyond a slice is read in runs, with no word
cut, and is one document.  An empty table gives no rows.  Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from proofmill.llm.textscan import CHUNK_BYTES, LOWER, U64, buffers, over_batches, slices, span_hashes
from proofmill.session import stash

MIN_DOCS = 3
TOP = 200
SHARE = 1000  # cubed: shares are parts of 10^9
#: Bits of the filter of digests: 8 MB, broadcast.
FILTER_BITS = 26
#: Rows that a task adds up before it passes them on.
HELD = 1 << 20
#: Pairs of groups that a task works on at once.
PAIRS = 1 << 21
IS_TERM = np.zeros(256, bool)
IS_TERM[97:123] = True
IS_TERM[128:] = True


def found_terms(at: np.ndarray, data: np.ndarray, bits: int, spell: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array | None]:
    """Of each term of some texts its text and its place in the distinct ones; their digests, and their strings if they are to be spelled."""
    folded = LOWER[data]
    inside = IS_TERM[folded]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    start = np.flatnonzero(first)
    doc = np.searchsorted(at, start, "right") - 1
    kept, letters = np.concatenate(([0], np.cumsum(inside))), folded[inside]
    offsets = np.append(kept[start], kept[-1])
    if not spell:
        distinct, code = np.unique(digests(letters, offsets, bits), return_inverse=True)
        return doc, code, distinct, None
    words = pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(letters)]).dictionary_encode()
    _, ends, body = words.dictionary.buffers()
    ends = np.frombuffer(ends, np.int32)[: len(words.dictionary) + 1].astype(np.int64)
    body = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    return doc, words.indices.to_numpy(), digests(body, ends, bits), words.dictionary


def runs(data: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[np.ndarray]:
    """A text in runs of about ``most`` bytes that end between words."""
    first = 0
    while first < len(data):
        last = min(first + most, len(data))
        if last < len(data):
            gaps = np.flatnonzero(~IS_TERM[LOWER[data[first:last]]])
            if len(gaps):
                last = first + gaps[-1] + 1
            else:
                while last < len(data) and IS_TERM[LOWER[data[last]]]:
                    last += 1
        yield data[first:last]
        first = last


def summed(t: pa.Table, keys: list[str], values: list[str]) -> pa.Table:
    out = t.group_by(keys, use_threads=False).aggregate([(v, "sum") for v in values])
    return out.rename_columns([c.removesuffix("_sum") if c.endswith("_sum") else c for c in out.column_names]).select([*keys, *values])


def counted(texts: pa.Array, group: np.ndarray, bits: int, spell: bool) -> pa.Table:
    """(g, digest, term if spelled, n, docs): occurrences and documents of each term, by the documents' groups."""
    at, data = buffers(texts)
    keys = ["digest", "term"] if spell else ["digest"]
    if len(at) == 2 and len(data) > CHUNK_BYTES:
        parts = []
        for run in runs(data):
            _, code, distinct, terms = found_terms(np.array([0, len(run)]), run, bits, spell)
            parts.append(pa.table({"digest": distinct, **({"term": terms} if spell else {}), "n": np.bincount(code, minlength=len(distinct))}))
        whole = summed(pa.concat_tables(parts), keys, ["n"])
        return pa.table({"g": np.full(len(whole), group[0]), **{k: whole[k] for k in keys}, "n": whole["n"], "docs": np.ones(len(whole), np.int64)})
    doc, code, distinct, terms = found_terms(at, data, bits, spell)
    width = max(len(distinct), 1)
    pair, n = np.unique(doc.astype(np.int64) * width + code, return_counts=True)
    key, where = np.unique(group[pair // width] * width + pair % width, return_inverse=True)
    term = key % width
    return pa.table({
        "g": key // width, "digest": distinct[term], **({"term": terms.take(pa.array(term))} if spell else {}),
        "n": np.bincount(where, n, len(key)).astype(np.int64), "docs": np.bincount(where, minlength=len(key)),
    })


def digests(letters: np.ndarray, offsets: np.ndarray, bits: int) -> np.ndarray:
    """The first ``bits`` bits of the hash of each run of letters, as signed 64-bit numbers."""
    return (span_hashes(letters, offsets) >> U64(64 - bits)).view(np.int64)


class Groups:
    """Numbers for (lang, source) of a task."""

    def __init__(self) -> None:
        self.known: dict[tuple[str, str], int] = {}

    def of(self, batch: pa.RecordBatch) -> np.ndarray:
        pairs = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)
        return np.fromiter((self.known.setdefault(p, len(self.known)) for p in pairs), np.int64, batch.num_rows)

    def columns(self, g: pa.ChunkedArray) -> list[pa.Array]:
        at = g.combine_chunks()
        return [pa.array([p[i] for p in self.known], pa.string()).take(at) for i in (0, 1)]


def _tables(batches: Iterator[pa.RecordBatch], groups: Groups, keys: list[str], make: Callable[[pa.Array, np.ndarray], pa.Table]) -> Iterator[pa.Table]:
    """Counts of all batches, added up by ``keys`` while they are fewer than ``HELD``."""
    held: list[pa.Table] = []
    rows = 0
    for batch in batches:
        for part in slices(batch, "text"):
            t = make(part.column("text"), groups.of(part))
            held.append(t)
            rows += len(t)
            if rows > HELD:
                held = [summed(pa.concat_tables(held), keys, ["n", "docs"])]
                rows = len(held[0])
                if rows > HELD // 2:
                    yield held[0]
                    held, rows = [], 0
    if rows:
        yield summed(pa.concat_tables(held), keys, ["n", "docs"])


def tally(docs: DataFrame, bits: int) -> DataFrame:
    """(lang, source, digest, n, docs), a row or more for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = Groups()
        make = lambda texts, g: counted(texts, g, bits, spell=False)
        for t in _tables(batches, groups, ["g", "digest"], make):
            yield from pa.table([*groups.columns(t["g"]), t["digest"], t["n"], t["docs"]], names=["lang", "source", "digest", "n", "docs"]).to_batches(1 << 16)

    return over_batches(docs, run, "lang string, source string, digest long, n long, docs long")


def digest_filter(df: DataFrame) -> bytes:
    """A bit for the lowest bits of every digest of ``df``: at most 2^FILTER_BITS bits, whatever its rows."""
    low = F.col("digest").bitwiseAND((1 << FILTER_BITS) - 1)
    rows = df.select((low / 32768).cast("long").alias("page"), (low % 32768).alias("bit")).groupBy("page").agg(F.expr("bitmap_construct_agg(bit)").alias("bits")).collect()
    out = bytearray(1 << (FILTER_BITS - 3))
    for r in rows:
        out[r.page * 4096 : r.page * 4096 + len(r.bits)] = r.bits
    return bytes(out)


def spelled(docs: DataFrame, wanted: bytes, bits: int, by_source: bool) -> DataFrame:
    """(lang, source, digest, term, n, docs) of terms whose digest passes the filter; without sources their column is empty."""
    sent = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, bitmap = Groups(), np.frombuffer(sent.value, np.uint8)

        def make(texts: pa.Array, g: np.ndarray) -> pa.Table:
            t = counted(texts, g, bits, spell=True)
            low = np.asarray(t["digest"]).view(np.uint64) & U64((1 << FILTER_BITS) - 1)
            passes = (bitmap[(low >> U64(3)).astype(np.int64)] >> (low & U64(7)).astype(np.uint8)) & 1
            return t.filter(pa.array(passes.astype(bool)))

        if not by_source:
            batches = (b.set_column(b.schema.get_field_index("source"), "source", pa.array([""] * b.num_rows)) for b in batches)
        for t in _tables(batches, groups, ["g", "digest", "term"], make):
            yield from pa.table([*groups.columns(t["g"]), *(t[c] for c in ("digest", "term", "n", "docs"))], names=["lang", "source", "digest", "term", "n", "docs"]).to_batches(1 << 16)

    return over_batches(docs, run, "lang string, source string, digest long, term string, n long, docs long")


def _kept(counts: DataFrame, key: list[str]) -> DataFrame:
    """Counts by source of the keys that are in enough documents of their language, with the language's count; ``lead`` marks one row of each key."""
    dealt = counts.repartition(*key).groupBy(*key, "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    whole = W.partitionBy(*key)
    dealt = dealt.select(*key, "source", "n", F.sum("n").over(whole).alias("n_lang"), F.sum("docs").over(whole).alias("in_docs"), F.row_number().over(whole.orderBy("source")).alias("k"))
    return dealt.filter(F.col("in_docs") >= MIN_DOCS).select("lang", "source", "digest", *[c for c in key if c == "term"], "n", "n_lang", (F.col("k") == 1).alias("lead"))


def kept_terms(docs: DataFrame, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """Counts of the kept terms by source (lang, source, digest, term, n, n_lang, lead), where term is null but for shared digests; and (lang, digest, lo), the text of the others."""
    kept = stash(_kept(tally(docs, bits), ["lang", "digest"]), "kept")
    again = spelled(docs, digest_filter(kept), bits, by_source=False)
    texts = stash(again.repartition("lang", "digest").groupBy("lang", "digest").agg(F.min("term").alias("lo"), F.max("term").alias("hi")), "texts")
    shared = texts.filter("lo <> hi").select("lang", "digest")
    none = F.lit(None).cast("string")
    apart = kept.withColumn("term", none)
    if not shared.isEmpty():
        split = spelled(docs, digest_filter(shared), bits, by_source=True).join(shared, ["lang", "digest"], "left_semi")
        split = stash(_kept(split, ["lang", "digest", "term"]), "split")
        apart = apart.join(shared, ["lang", "digest"], "left_anti").unionByName(split)
    return apart.select("lang", "source", "digest", "term", "n", "n_lang", "lead"), texts.select("lang", "digest", "lo")


def _div(a: str, b: str) -> str:
    return f"(({a}) div ({b}))"


def share(count: str, total: str, vocabulary: str) -> Column:
    """1 + floor(10^9 (count + 1) / (total + vocabulary)), in long arithmetic."""
    whole, over = f"({total} + {vocabulary})", f"({count} + 1)"
    digits = []
    for _ in range(3):
        digits.append(_div(f"{SHARE} * {over}", whole))
        over = f"(({SHARE} * {over}) % {whole})"
    return F.expr(f"1 + ({digits[0]} * {SHARE} + {digits[1]}) * {SHARE} + {digits[2]}")


def difference(p: str, q: str) -> Column:
    return F.expr(_div(f"({p} - {q}) * ({p} - {q})", q))


def statistics(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(gid, lang, source, n, own, v, n_lang, p0) of every group that occurs: counts, kept terms it has, those of its language, and p of an absent term (null without kept terms)."""
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("own"))
    langs = kept.groupBy("lang").agg(F.count_if("lead").alias("v"), F.sum("n").alias("n_lang"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    both = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", *[zero(c) for c in ("n", "own", "v", "n_lang")])
    return stash(both.withColumn("gid", F.monotonically_increasing_id()).withColumn("p0", F.when(F.col("v") > 0, share("0", "n", "v"))), "groups")


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def shared_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From each term's groups (gid, p, p0): by pair, what their common terms add to sums that hold each as absent in the other."""
    held: list[pa.Table] = []
    for batch in batches:
        lists = batch.column(0)
        at = np.asarray(lists.offsets)
        gid, p, p0 = (np.asarray(c) for c in lists.values.flatten())
        size = np.diff(at)
        for s in np.unique(size[size > 1]):
            rows = np.flatnonzero(size == s)
            # Blocks of terms, and of first groups where a term has very many.
            block = max(1, PAIRS // (s * s))
            width = s if s * s <= PAIRS else max(1, PAIRS // s)
            for r in range(0, len(rows), block):
                own = at[rows[r : r + block], None] + np.arange(s)
                for i in range(0, s, width):
                    left, right = own[:, i : i + width, None], own[:, None, :]
                    value = _f(p[left], p[right]) - _f(p[left], p0[right]) - _f(p0[left], p[right]) + _f(p0[left], p0[right])
                    shape = value.shape
                    pair = pa.table({"g": np.broadcast_to(gid[left], shape).ravel(), "h": np.broadcast_to(gid[right], shape).ravel(), "value": value.ravel()})
                    held.append(summed(pair, ["g", "h"], ["value"]))
        if sum(map(len, held)) > HELD:
            held = [summed(pa.concat_tables(held), ["g", "h"], ["value"])]
            if len(held[0]) > HELD // 2:
                yield from held.pop().to_batches(1 << 16)
    if held:
        yield from summed(pa.concat_tables(held), ["g", "h"], ["value"]).to_batches(1 << 16)


def pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(g, h, value) of all ordered pairs of groups of a language: the sum of differences over all kept terms."""
    own = kept.join(groups.select("gid", "lang", "source", F.col("n").alias("total"), "v", "p0"), ["lang", "source"]).withColumn("p", share("n", "total", "v"))
    of_term = own.groupBy("lang", "digest", "term").agg(F.collect_list(F.struct("gid", "p", "p0")).alias("has")).filter(F.size("has") > 1).select("has")
    common = of_term.mapInArrow(shared_terms, "g long, h long, value long").filter("g <> h")
    other = groups.select(F.col("gid").alias("other"), F.col("lang"), F.col("p0").alias("q0"), F.col("own").alias("q_own"))
    # Each distinct p of a group, with its number of terms, against each other group's p of an absent term.
    levels = own.groupBy("lang", "gid", "p").agg(F.count(F.lit(1)).alias("m")).join(other, "lang").filter("gid <> other")
    levels = levels.groupBy("gid", "other").agg(F.sum(F.col("m") * difference("p", "q0")).alias("here"), F.sum(F.col("m") * difference("q0", "p")).alias("there"))
    absent = groups.join(other, "lang").filter("gid <> other")
    absent = absent.select(F.col("gid").alias("g"), F.col("other").alias("h"), F.coalesce((F.col("v") - F.col("own") - F.col("q_own")) * difference("p0", "q0"), F.lit(0)).alias("value"))
    sides = levels.select(F.explode(F.array(F.struct(F.col("gid").alias("g"), F.col("other").alias("h"), F.col("here").alias("value")), F.struct(F.col("other").alias("g"), F.col("gid").alias("h"), F.col("there").alias("value")))).alias("x")).select("x.*")
    return common.unionByName(sides).unionByName(absent).groupBy("g", "h").agg(F.sum("value").alias("value"))


def leading_terms(kept: DataFrame, texts: DataFrame, groups: DataFrame, top: int = TOP) -> DataFrame:
    """(gid, item, value, rank) of the ``top`` terms that a group has more often than its language.

    Values are ranked first, ties at the end included, so that only these terms get their text.
    """
    own = kept.join(groups.select("gid", "lang", "source", F.col("n").alias("total"), "v", F.col("n_lang").alias("total_lang")), ["lang", "source"])
    own = own.withColumn("p", share("n", "total", "v")).withColumn("q", share("n_lang", "total_lang", "v")).filter("p > q").withColumn("value", difference("p", "q"))
    by_value = own.withColumn("r", F.rank().over(W.partitionBy("gid").orderBy(F.desc("value")))).filter(F.col("r") <= top).select("gid", "lang", "digest", "term", "value")
    named = by_value.join(texts, ["lang", "digest"], "left").select("gid", F.coalesce("term", "lo").alias("item"), "value")
    return named.withColumn("rank", F.row_number().over(W.partitionBy("gid").orderBy(F.desc("value"), "item"))).filter(F.col("rank") <= top)


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", bits: int = 64) -> DataFrame:
    """(lang, source, part, item, value, rank): every other source of the language with its difference, and the terms that stand out."""
    blank = lambda c, n: F.coalesce(F.col(c), F.lit("")).alias(n)
    docs = docs.select(blank(text, "text"), blank(lang, "lang"), blank(source, "source"))
    kept, texts = kept_terms(docs, bits)
    groups = statistics(docs, kept)
    names = groups.select("gid", "lang", "source")
    other = pairs(kept, groups).join(groups.select(F.col("gid").alias("h"), F.col("source").alias("item")), "h")
    other = other.withColumn("rank", F.row_number().over(W.partitionBy("g").orderBy(F.desc("value"), "item"))).select(F.col("g").alias("gid"), F.lit("pair").alias("part"), "item", "value", "rank")
    terms = leading_terms(kept, texts, groups).select("gid", F.lit("term").alias("part"), "item", "value", "rank")
    return other.unionByName(terms).join(names, "gid").select("lang", "source", "part", "item", "value", "rank")


_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_P = "1 + (1000000000::HUGEINT * ({} + 1)) // ({} + {})"
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_FOLD} AS text FROM documents),
w AS (SELECT rid, lang, source, unnest(regexp_extract_all(text, '[a-z\x{{80}}-\x{{10FFFF}}]+')) AS t FROM d),
k AS (SELECT lang, t, count(*) AS nl FROM w GROUP BY ALL HAVING count(DISTINCT rid) >= {MIN_DOCS}),
c AS (SELECT lang, source, t, count(*) AS n FROM w JOIN k USING (lang, t) GROUP BY ALL),
l AS (SELECT lang, count(*) AS v, sum(nl) AS nl FROM k GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT s.lang, s.source, k.t, coalesce(c.n, 0) AS has, {_P.format('coalesce(c.n, 0)', 's.n', 'l.v')} AS p, {_P.format('k.nl', 'l.nl', 'l.v')} AS q
  FROM s JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.t = k.t),
pr AS (SELECT a.lang, a.source, b.source AS item, coalesce(f, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS f FROM p x JOIN p y ON x.lang = y.lang AND x.t = y.t AND x.source <> y.source GROUP BY ALL) z ON z.lang = a.lang AND z.source = a.source AND z.item = b.source),
tr AS (SELECT lang, source, t AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM p WHERE has > 0 AND p > q),
o AS (SELECT lang, source, 'pair' AS part, item, value FROM pr UNION ALL SELECT lang, source, 'term', item, value FROM tr)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM o QUALIFY part = 'pair' OR rank <= {TOP}
"""
