"""Benchmark decontamination by one Aho-Corasick automaton over word windows.

Texts and benchmark items are lower-cased in A-Z and read as words of ASCII
letters, digits and everything beyond ASCII.  Each ``WINDOW`` consecutive words
of an item are a pattern; an item of fewer words is one pattern.  The automaton
runs over the numbers of words, so its size is that of the items and a text is
scanned once, whole, in runs of ``CHUNK_BYTES`` between which the automaton keeps
its state.  Where patterns were found, words are mapped back to code points of
the original text.

An automaton holds at most about ``AUTOMATON_BYTES`` of items; a larger benchmark
is dealt by hash into as many automata as it needs, and texts go through one after
the other, so that no item is left out and what is broadcast stays bounded.

Defined results: a null or empty text, or one of separators alone, has no words
and is clean.  An item without words matches nothing.  Items are told apart by
their id, so rows that repeat an id are one item; a null id is one item, written
as an empty string.  Repeated documents are judged alike, each in a row of its
own.  An empty benchmark leaves all documents clean; an empty table stays empty.
Further columns pass through, whatever their names; the findings come in one
struct column under a name that starts with __pm_, which is reserved.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, Row, functions as F, types as T

from proofmill.llm.textscan import CHUNK_BYTES, buffers, over_batches, slices
from proofmill.session import stash

WINDOW = 10
#: Texts of items in one automaton: some 400 000 words, whose windows have ten nodes each.
AUTOMATON_BYTES = 2 << 20
STRUCT = "__pm_leaks"
SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
KIND = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("runs", T.ArrayType(SPAN)),
    T.StructField("spans", T.ArrayType(SPAN)), T.StructField("items", T.ArrayType(T.StringType())),
])
ARROW = pa.struct([
    ("n_words", pa.int64()), ("n_hit", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string())),
])
#: Bytes of words, folded; all others are separators.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def pieces(text: bytes, most: int = CHUNK_BYTES) -> Iterator[list[bytes]]:
    """The words of a text, in runs of about ``most`` bytes; no word is cut."""
    folded, first = text.translate(FOLD), 0
    while first < len(folded):
        last = first + most
        if last < len(folded):
            cut = folded.rfind(b" ", first, last)
            last = cut if cut > first else folded.find(b" ", last)
            last = len(folded) if last < 0 else last
        yield folded[first:last].split()
        first = last


class Automaton:
    """The windows of all items; ``items`` are (id as text, text)."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.numbers: dict[bytes, int] = {}
        self.owners: list[set[str]] = []
        self.matcher = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        known: dict[tuple[int, ...], int] = {}
        for name, text in items:
            ids = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(text.encode())]
            n = min(window, len(ids))
            for i in range(len(ids) - n + 1 if n else 0):
                key = tuple(ids[i : i + n])
                if key not in known:
                    known[key] = len(self.owners)
                    self.owners.append(set())
                    self.matcher.add_word(key, (n, known[key]))
                self.owners[known[key]].add(name)
        self.matcher.make_automaton()

    def find(self, text: bytes) -> tuple[int, list[list[int]], set[str]]:
        """The number of words; runs of hit words, half-open and apart from each other; and the items found."""
        total, runs, found, search = 0, [], set(), None
        for words in pieces(text):
            total += len(words)
            if not self.owners:
                continue
            ids = tuple(map(self.numbers.get, words, repeat(0)))
            if search is None:
                search = self.matcher.iter(ids)
            else:
                search.set(ids)
            for last, (n, at) in search:
                start, end = last - n + 1, last + 1
                while runs and start <= runs[-1][1]:
                    start = min(start, runs.pop()[0])
                runs.append([start, end])
                found.add(at)
        return total, runs, set().union(*(self.owners[i] for i in found))


def joined(a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
    """Two lists of runs as one."""
    out: list[list[int]] = []
    for start, end in sorted([*a, *b]):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def places(text: str, runs: list[list[int]]) -> list[tuple[int, int]]:
    """Runs of words as code points of the text."""
    out, waiting, begin = [], iter(runs), 0
    run = next(waiting, None)
    for i, m in enumerate(WORD.finditer(text)):
        if run is None:
            break
        if i == run[0]:
            begin = m.start()
        if i == run[1] - 1:
            out.append((begin, m.end()))
            run = next(waiting, None)
    return out


_built: dict[str, Automaton] = {}


def _pass(docs: DataFrame, text: str, items: list[Row], window: int) -> DataFrame:
    """``docs`` with the findings of one automaton, joined to those of earlier ones."""
    again = STRUCT in docs.columns
    own = [c for c in docs.columns if c != STRUCT]
    docs = docs.select(*[F.col("`" + c.replace("`", "``") + "`") for c in own], *[STRUCT] * again)
    schema = T.StructType([*(docs.schema.fields[: len(own)]), T.StructField(STRUCT, KIND)])
    sent = docs.sparkSession.sparkContext.broadcast([(r.name, r.text) for r in items])
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _built:
            _built.clear()
            _built[key] = Automaton(sent.value, window)
        automaton = _built[key]
        for batch in batches:
            for part in slices(batch, text):
                at, data = buffers(part.column(text))
                whole, made = memoryview(data), []
                before = part.column(STRUCT).to_pylist() if again else repeat(None)
                for first, last, earlier in zip(at[:-1].tolist(), at[1:].tolist(), before, strict=False):
                    body = bytes(whole[first:last])
                    n, runs, found = automaton.find(body)
                    if earlier and earlier["runs"]:
                        runs, found = joined(runs, [[r["start"], r["end"]] for r in earlier["runs"]]), found | set(earlier["items"])
                    spans = places(body.decode(), runs) if runs else []
                    pair = lambda rows: [{"start": a, "end": b} for a, b in rows]
                    made.append({"n_words": n, "n_hit": sum(b - a for a, b in runs), "runs": pair(runs), "spans": pair(spans), "items": sorted(found)})
                yield pa.RecordBatch.from_arrays([*part.columns[: len(own)], pa.array(made, ARROW)], names=schema.names)

    return over_batches(docs, run, schema)


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """``docs`` with a struct of findings: words, hit words, runs of words, their spans in code points, and the ids of the items found."""
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("name"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + F.octet_length("name"))).first()[0] or 0
    parts = -(-size // automaton_bytes) or 1
    if parts > 1:
        items = stash(items, "items")
    for k in range(parts):
        own = items.filter(F.pmod(F.xxhash64("name", "text"), F.lit(parts)) == k).collect()
        docs = _pass(stash(docs, "scanned") if k else docs, text, own, window)
    return docs


def report(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """Counts, a digest of the items found, and spans of each document."""
    found = scan(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), benchmark, **kw)
    s = lambda f: F.col(f"{STRUCT}.{f}")
    return found.select(
        "doc_id", s("n_words"), s("n_hit"), F.size(s("items")).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", s("items")).cast("binary"), 256).alias("items_sha256"),
        (s("n_hit") > 0).alias("contaminated"), s("spans"), s("items"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", **kw) -> DataFrame:
    """The documents in which no window of the benchmark occurs."""
    return scan(docs, benchmark, text, **kw).filter(F.col(f"{STRUCT}.n_hit") == 0).drop(STRUCT)


_LEADS = ", ".join(" || ' ' || ".join(["w", *[f"lead(w, {i}) OVER o" for i in range(1, n)]]) + f" AS k{n}" for n in range(1, WINDOW + 1))
_KEYS = ", ".join(f"k{n}" for n in range(1, WINDOW + 1))
_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_FOLD}, '[0-9a-z\x{{{{80}}}}-\x{{{{10FFFF}}}}]+')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, row_number() OVER () AS rid, {_WORDS.format("coalesce(text, '')")} AS ws FROM benchmark),
dw AS (SELECT rid, i, {_LEADS} FROM (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d) WINDOW o AS (PARTITION BY rid ORDER BY i)),
bw AS (SELECT rid, i, {_LEADS} FROM (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM b) WINDOW o AS (PARTITION BY rid ORDER BY i)),
win AS (SELECT DISTINCT item, n, k FROM (SELECT rid, unnest([{_KEYS}]) AS k, unnest(range(1, {WINDOW} + 1)) AS n FROM bw) JOIN b USING (rid) WHERE k IS NOT NULL AND n = least(len(ws), {WINDOW})),
occ AS (SELECT rid, i, n, item FROM (SELECT rid, i, unnest([{_KEYS}]) AS k FROM dw) JOIN win USING (k)),
hit AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM occ) GROUP BY rid),
its AS (SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT rid, item FROM occ) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(its.n, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, hit.n IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN its USING (rid)
"""
