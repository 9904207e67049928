"""Personal data by weak supervision.

Base spans come from fixed patterns and always stay.  Around them a wide net
finds candidates: written-out addresses, number groups like telephone and card
numbers, long keys.  Three labelers vote +1, 0 or -1 on every candidate and
every base span: a format labeler (regular expressions, checksums), a gazetteer
labeler (domains, dialling codes, card and key prefixes) and a context labeler
(words before the span).  Expectation-maximisation over the counts of vote
patterns estimates, for each kind, how reliable each labeler is, with base spans
held as true; the posteriors train a logistic span classifier, which decides on
the candidates.  Spans are half-open intervals of code points.

Only counts of patterns leave the tasks: kinds x votes x shapes is at most
``5 * 27 * 12`` patterns at any size of the input.  The fitted model goes to the
tasks with the second pass.  Texts without a digit, an at sign or a written-out
one are passed over after a byte scan.

Defined results: a null or empty text has no spans.  Repeated rows get equal
spans.  An empty table gives an empty result; a kind without candidates adds
nothing.  Very long texts are searched whole, in linear time.  ``redact`` passes
further columns through.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from proofmill.llm.textscan import add_columns, buffers, over_batches, slices

KINDS = ("email", "ip", "card", "phone", "secret")
Span = tuple[int, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits is only tried at its first digit and never given back: no other start or split of it can match.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

_WIDE_EMAIL = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]{1,63}(?: ?(?:\[dot\]|\(dot\)|\.) ?[A-Za-z0-9-]{1,63}){1,8}", re.I)
_WIDE_PHONE = re.compile(r"(?<![0-9A-Za-z.+-])\(?[0-9]{2,4}\)?(?:[ ./-][0-9]{2,5}){2,4}(?![0-9A-Za-z])")
_KEY = re.compile(r"[A-Za-z0-9_/+=-]{20,}")

#: Lists of the gazetteer and context labelers: fixed values.
TLDS = frozenset("com org net edu gov io de fr es it uk eu info".split())
DIAL_CODES = ("1", "33", "34", "39", "44", "49", "61", "81", "86", "91")
CARD_PREFIXES = ("34", "35", "37", "4", "51", "52", "53", "54", "55", "60", "65")
KEY_PREFIXES = ("AKIA", "ghp_", "sk-", "sk_", "xox")
CUES = {
    "email": ("contact", "correo", "e-mail", "email", "mail", "write"),
    "ip": ("address", "host", "ip", "server"),
    "card": ("card", "credit", "karte", "tarjeta", "visa"),
    "phone": ("call", "fax", "mobile", "phone", "tel", "telefon"),
    "secret": ("api", "apikey", "key", "password", "pwd", "secret", "token"),
}
AGAINST = frozenset("chapter doi figure isbn page price section version volume".split())
_WORDS = re.compile(r"[^\W\d_]+")
BEFORE = 40


def emails(text: str) -> list[Span]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        first = at
        while first > end and text[first - 1] in _LOCAL:
            first -= 1
        if first < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((first, end, 0))
        at = text.find("@", max(at + 1, end))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) << (i & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The spans of the fixed patterns, by start and kind."""
    out = emails(text)
    out += [(*m.span(), 1) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _NOT_DIGIT.sub("", m.group())) <= 19 and luhn(d):
            out.append((*m.span(), 2))
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            out.append((*m.span(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


def candidates(text: str, base: list[Span]) -> list[Span]:
    """What the wide net finds clear of the base spans, and clear of each other."""
    wide = [(*m.span(), 0) for m in _WIDE_EMAIL.finditer(text)] if "at" in text else []
    for m in _KEY.finditer(text):
        s = m.group()
        if any(c.isdigit() for c in s) and any(c.isalpha() for c in s):
            wide.append((*m.span(), 4))
    wide += [(*m.span(), 2) for m in _CARD.finditer(text) if 13 <= len(_NOT_DIGIT.sub("", m.group())) <= 19]
    wide += [(*m.span(), 3) for m in _WIDE_PHONE.finditer(text)]
    out: list[Span] = []
    starts = [s for s, _, _ in base]
    reach = list(accumulate((e for _, e, _ in base), max))
    for s, e, k in sorted(wide, key=lambda x: (x[0], -x[1], x[2])):
        before = bisect_left(starts, e)
        if (out and s < out[-1][1]) or (before and reach[before - 1] > s):
            continue
        out.append((s, e, k))
    return out


def votes(text: str, span: Span, is_base: bool) -> tuple[int, int, int]:
    """Format, gazetteer and context labelers."""
    s, e, k = span
    body = text[s:e]
    digits = _NOT_DIGIT.sub("", body)
    kind = KINDS[k]
    if kind == "email":
        shape = 1
        tld = re.split(r"[^A-Za-z]+", body)[-1].lower()
        known = 1 if tld in TLDS else -1
    elif kind == "ip":
        shape, known = 1, -1 if body.startswith(("0.", "127.")) else 1
    elif kind == "card":
        shape = 1 if luhn(digits) else -1
        known = 1 if digits.startswith(CARD_PREFIXES) else -1
    elif kind == "phone":
        shape = 1 if 9 <= len(digits) <= 15 else -1
        known = (1 if digits.startswith(DIAL_CODES) else -1) if body.startswith("+") else 0
    else:
        hexed = re.fullmatch(r"[0-9a-fA-F]{32,}", body)
        shape = 1 if hexed or len({*body}) >= 14 else -1
        known = 1 if body.startswith(KEY_PREFIXES) else 0
    near = {w.lower() for w in _WORDS.findall(text[max(0, s - BEFORE) : s])}
    context = 1 if near & set(CUES[kind]) else -1 if near & AGAINST else 0
    return (1 if is_base else shape), known, context


def pattern(text: str, span: Span, is_base: bool) -> tuple[int, ...]:
    """Kind, the three votes, and the shape of the span: its length class and its letters."""
    s, e, k = span
    body = text[s:e]
    letters = (1 if any(c.isalpha() for c in body) else 0) + (1 if any(c in " ()" for c in body) else 0)
    return (k, *votes(text, span, is_base), min(3, (e - s) // 12), letters, int(is_base))


def flagged(texts: pa.Array) -> np.ndarray:
    """Which texts can hold a base span or a candidate at all."""
    at, data = buffers(texts)
    mark = ((data >= 48) & (data <= 57)) | (data == 64) | (data == 91) | (data == 40)
    total = np.concatenate(([0], np.cumsum(mark)))
    return total[at[1:]] > total[at[:-1]]


def pattern_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """How often each pattern occurs in all texts."""
    names = ["kind", "v0", "v1", "v2", "size", "letters", "base"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for part in slices(batch, text):
                texts = part.column(text)
                for i in np.flatnonzero(flagged(texts)).tolist():
                    t = texts[i].as_py()
                    base = base_spans(t)
                    found.update(pattern(t, s, True) for s in base)
                    found.update(pattern(t, s, False) for s in candidates(t, base))
        cols = list(zip(*found, strict=True)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in cols), pa.array(list(found.values()), pa.int64())], names=[*names, "n"])

    schema = ", ".join(f"{n} int" for n in names) + ", n long"
    return df.select(text).mapInArrow(run, schema).groupBy(*names).agg(F.sum("n").alias("n"))


def em(counts: dict[tuple, int], rounds: int = 60) -> dict[tuple, float]:
    """The posterior of each pattern that its span is personal data; the reliabilities of the labelers, by kind, are estimated on the way."""
    out: dict[tuple, float] = {}
    for k in range(len(KINDS)):
        rows = sorted(p for p in counts if p[0] == k)
        if not rows:
            continue
        v, n, base = np.array([p[1:4] for p in rows]) + 1, np.array([counts[p] for p in rows], float), np.array([p[6] for p in rows], bool)
        post = np.where(base, 1.0, 1 / (1 + np.exp(-2.0 * (v.sum(1) - 3) + 1.0)))
        for _ in range(rounds):
            says = np.ones((2, 3, 3))
            for c, weight in enumerate((1 - post, post)):
                for j in range(3):
                    says[c, j] += np.bincount(v[:, j], weights=weight * n, minlength=3)
            says /= says.sum(2, keepdims=True)
            share = ((post * n).sum() + 1) / (n.sum() + 2)
            score = np.log(share / (1 - share)) + sum(np.log(says[1, j, v[:, j]] / says[0, j, v[:, j]]) for j in range(3))
            post = np.where(base, 1.0, 1 / (1 + np.exp(-np.clip(score, -30, 30))))
        out |= dict(zip(rows, post.tolist(), strict=True))
    return out


def features(p: tuple) -> np.ndarray:
    x = np.zeros(1 + len(KINDS) * 10 + 7)
    x[0] = 1
    x[1 + p[0] * 10] = 1
    for j in range(3):
        x[1 + p[0] * 10 + 1 + 3 * j + p[1 + j] + 1] = 1
    x[1 + len(KINDS) * 10 + p[4]] = 1
    x[1 + len(KINDS) * 10 + 4 + p[5]] = 1
    return x


def fit(counts: dict[tuple, int], rounds: int = 25, ridge: float = 1e-2) -> np.ndarray:
    """Weights of the span classifier: logistic regression on the posteriors, by Newton's method over patterns."""
    post = em(counts)
    rows = sorted(post)
    if not rows:
        return np.zeros(len(features((0, 0, 0, 0, 0, 0, 0))))
    x, y = np.array([features(p) for p in rows]), np.array([post[p] for p in rows])
    n = np.array([counts[p] for p in rows], float)
    n /= n.sum()
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (q - y)) + ridge * 0.01 * w
        h = (x * (n * np.maximum(q * (1 - q), 1e-6))[:, None]).T @ x + ridge * 0.01 * np.eye(len(w))
        w -= np.linalg.solve(h, grad)
    return w


def train(df: DataFrame, text: str = "text") -> np.ndarray:
    """The span classifier, fitted to the pattern counts of all texts."""
    rows = pattern_counts(df, text).collect()
    return fit({tuple(r)[:-1]: r.n for r in rows})


def find(text: str, weights: np.ndarray) -> list[tuple[int, int, int, bool]]:
    """All spans of a text by start and kind: (start, end, kind, base)."""
    base = base_spans(text)
    more = [s for s in candidates(text, base) if features(pattern(text, s, False)) @ weights >= 0]
    return sorted([(*s, True) for s in base] + [(*s, False) for s in more], key=lambda s: (s[0], s[2], s[1]))


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType())])


def spans_of(texts: pa.Array, weights: np.ndarray) -> list[list[tuple[int, int, int, bool]]]:
    flags = flagged(texts)
    return [find(texts[i].as_py(), weights) if flags[i] else [] for i in range(len(texts))]


def spans(df: DataFrame, weights: np.ndarray, text: str = "text", name: str = "spans") -> DataFrame:
    """``df`` with the array of all spans of each whole text."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def make(texts: pa.Array) -> list[pa.Array]:
        return [pa.array([[{"kind": KINDS[k], "start": s, "end": e, "base": b} for s, e, k, b in own] for own in spans_of(texts, weights)], kind)]

    return add_columns(df.drop(name), text, [T.StructField(name, T.ArrayType(SPAN))], make)


def redact(df: DataFrame, weights: np.ndarray, text: str = "text") -> DataFrame:
    """``df`` with every span of its texts replaced by the name of its kind in angle brackets; overlapping spans as one."""
    schema, at = df.schema, df.columns.index(text)

    def clean(t: str, own: list[tuple[int, int, int, bool]]) -> str:
        out, done = [], 0
        for s, e, k, _ in own:
            if s >= done:
                out += [t[done:s], f"<{KINDS[k].upper()}>"]
            done = max(done, e)
        return "".join([*out, t[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                texts = part.column(text)
                found = spans_of(texts, weights)
                if any(found):
                    new = [clean(t, own) if own else t for t, own in zip(texts.to_pylist(), found, strict=True)]
                    part = part.set_column(at, text, pa.array(new, texts.type))
                yield part

    return over_batches(df, run, schema)


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: counts of base spans by kind, SHA-256 of the base spans, and all spans as a string."""
    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = spans(picked, train(picked)).select("doc_id", "spans")
    said = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:4]], F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
