"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context windows.

The lexicon is learned from a labelled sample: words, and stems that
``STEM_WORDS`` words at least begin with, whose documents are toxic far more
often than not, or for frequent stems significantly more often.  Its terms form a
trie.  The Levenshtein automata of all terms, intersected with that trie,
are run as one lazily determinised automaton: a state is a set of (trie node,
edits so far), so a word that no term is near dies after a few letters.  Whole
terms allow one edit from 5 letters and two from 9, and fewer where their hits
with edits occur in clean documents of the sample; stems must match exactly.

Around every hit a window of ``WINDOW_WORDS`` words either side and the marks
around it are read: a hit between paired quotation marks, however many words they
hold up to ``QUOTED_CHARS`` characters, and one among reporting words is quoted;
address words outside of quotations speak for abuse.  The sums of term weights, less for each edit, by kind
of hit are the features of a logistic regression, fitted to the same sample; no
hit but a quoted one can lower a score.

The sample has at most ``PER_CLASS`` rows of each class, weighted in the fit so
that its class balance is that of all labels (odds of terms compare shares within
each class, which the sampling leaves alone), a documented bound at any size of
the input; the lexicon has every term that the sample bears out.  Scoring is one
pass over all texts without a shuffle.

Defined results: null and empty texts have no hits and get the score of the
intercept.  Without a sample of both classes every score is 0.  Repeated rows
get equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from proofmill.llm.labelled import held_out, sample
from proofmill.llm.textscan import add_columns
from proofmill.session import stash

PER_CLASS = 6000
LEAST_ODDS = 3.5
LEAST_DOCS = 4
STEMS = (4, 5, 6, 7)
STEM_WORDS = 4
#: Frequent stems of lower odds are terms too, if these are so many standard errors above 0.
LEAST_STEM_ODDS = 2.0
STEM_ERRORS = 5.0
WINDOW_WORDS = 6
#: The part of a term's weight that is left with each edit.
EDIT_SHARE = 0.8
CACHE = 400_000
STATES = 200_000
WORD = re.compile(r"[^\W_]+(?:[@$*!][^\W_]+)*")

#: Letters behind look-alike signs, reporting and address words, quotation marks: fixed values.
LOOKALIKE = str.maketrans("013457@$!*", "oieastasii")
REPORTING = frozenset("called calling quote quoted said says slur term word words wrote".split())
ADDRESS = frozenset("are du eres es tu u ur you your youre".split())
QUOTES = "\"'“”‘’«»„"
#: A quotation: paired marks around words, on one line, of at most QUOTED_CHARS characters; apostrophes inside words are no marks.
QUOTED_CHARS = 400
CLOSED_BY = {"“": "”", "„": "“”", "«": "»", "»": "«", '"': '"', "‘": "’", "'": "'"}
MARK = re.compile("[" + QUOTES + "\n]")
DEAD = -1


def most_edits(term: str, stem: bool) -> int:
    return 0 if stem or len(term) < 5 else 1 if len(term) < 9 else 2


class Lexicon:
    """Terms with weights as the product of a trie with Levenshtein automata; ``stem`` terms match words that begin with them.

    A term is (term, stem, weight), or has the most edits as a fourth.
    """

    def __init__(self, terms: list[tuple]):
        self.children: list[dict[str, int]] = [{}]
        self.whole: dict[int, tuple[float, int]] = {}
        self.stem: dict[int, float] = {}
        self.reach = [0]
        self.names: dict[int, str] = {}
        for term, stem, weight, *most in terms:
            edits, node = most[0] if most else most_edits(term, stem), 0
            self.reach[0] = max(self.reach[0], edits)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.reach.append(0)
                node = self.children[node][c]
                self.reach[node] = max(self.reach[node], edits)
            if stem:
                self.stem[node] = weight
            else:
                self.whole[node] = (weight, edits)
                self.names[node] = term
        self.cache: dict[str, tuple[float, int] | None] = {}
        self._forget()

    def _forget(self) -> None:
        """Begin the product anew: states are made as words ask for them, and go when they are too many."""
        self.ids: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.next: list[dict[str, int]] = []
        self.accept: list[tuple[float, int] | None] = []
        self.begin: list[float | None] = []
        self.start = self._state({(0, 0)})

    def _state(self, pairs: set[tuple[int, int]]) -> int:
        todo = list(pairs)
        while todo:  # letters of the term that the word leaves out
            node, e = todo.pop()
            for child in self.children[node].values():
                if e < self.reach[child] and (child, e + 1) not in pairs:
                    pairs.add((child, e + 1))
                    todo.append((child, e + 1))
        least: dict[int, int] = {}
        for node, e in pairs:
            least[node] = min(e, least.get(node, e))
        key = frozenset(least.items())
        if not key:
            return DEAD
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
            self.next.append({})
            found = [(self.whole[n][0], e) for n, e in key if n in self.whole and e <= self.whole[n][1]]
            self.accept.append(min(found, key=lambda x: (x[1], -x[0])) if found else None)
            self.begin.append(max((self.stem[n] for n, e in key if e == 0 and n in self.stem), default=None))
        return self.ids[key]

    def _step(self, state: int, c: str) -> int:
        pairs: set[tuple[int, int]] = set()
        for node, e in self.states[state]:
            for letter, child in self.children[node].items():
                if letter == c:
                    pairs.add((child, e))
                elif e < self.reach[child]:
                    pairs.add((child, e + 1))
            if e < self.reach[node]:
                pairs.add((node, e + 1))
        found = self.next[state][c] = self._state(pairs)
        return found

    def _run(self, word: str) -> tuple[float, int] | None:
        state, stem = self.start, None
        for c in word:
            step = self.next[state].get(c)
            state = self._step(state, c) if step is None else step
            if state == DEAD:
                break
            if self.begin[state] is not None:
                stem = (self.begin[state], 0)
        whole = self.accept[state] if state != DEAD else None
        return whole if whole and (not stem or whole[1] == 0) else stem

    def near(self, word: str) -> set[tuple[str, int]]:
        """Every whole term near the word with its edits, if the word's hit has edits, also behind look-alike signs."""
        out: set[tuple[str, int]] = set()
        if not (found := self.match(word)) or not found[1]:
            return out
        for w in {word, word.translate(LOOKALIKE)}:
            state = self.start
            for c in w:
                step = self.next[state].get(c)
                state = self._step(state, c) if step is None else step
                if state == DEAD:
                    break
            else:
                out.update((self.names[n], e) for n, e in self.states[state] if n in self.whole and 0 < e <= self.whole[n][1])
        return out

    def match(self, word: str) -> tuple[float, int] | None:
        """Weight and edits of the nearest term, also behind look-alike signs."""
        found = self._run(word)
        if (found is None or found[1]) and not word.isalpha():
            plain = self._run(word.translate(LOOKALIKE))
            found = min((x for x in (found, plain) if x), key=lambda x: x[1], default=None)
        return found

    def hits(self, words: set[str]) -> dict[str, tuple[float, int]]:
        out, cache = {}, self.cache
        if len(self.states) >= STATES:
            self._forget()
        for w in words:
            try:
                found = cache[w]
            except KeyError:
                found = self.match(w)
                if len(cache) >= CACHE:
                    cache.clear()
                cache[w] = found
            if found:
                out[w] = found
        return out


def quotations(text: str) -> list[tuple[int, int]]:
    """The spans between paired quotation marks, in one walk over the marks; a line's end closes nothing and ends all."""
    opened: dict[str, int] = {}
    out = []
    for m in MARK.finditer(text):
        at, c = m.start(), m.group()
        if c == "\n":
            opened.clear()
            continue
        after_word, before_word = at > 0 and text[at - 1].isalnum(), text[at + 1 : at + 2].isalnum()
        if c in "'’‘" and after_word and before_word:
            continue  # an apostrophe
        own = next((o for o in opened if c in CLOSED_BY[o] and not (c in "'’" and before_word)), None)
        if own is not None:
            start = opened.pop(own)
            if at - start <= QUOTED_CHARS:
                out.append((start, at + 1))
                opened.clear()
                continue
        if c in CLOSED_BY and not (c == "'" and after_word):
            opened[c] = at
    return out


FEATURES = ("hits", "addressed", "quoted", "kinds", "weak")
#: Those that can only speak for abuse.
FOR_ABUSE = tuple(name != "quoted" for name in FEATURES)


def features(text: str, lexicon: Lexicon) -> tuple[float, ...]:
    """Of one text: the weights of hits, less for each edit, the hits among address words, the weights of quoted hits, the number of terms hit, and the weights of stems with odds under LEAST_ODDS, which count nowhere else."""
    low = text.lower()
    hits = lexicon.hits(set(WORD.findall(low)))
    if not hits:
        return (0.0,) * len(FEATURES)
    found = list(WORD.finditer(low))
    words = [m.group() for m in found]
    sums = dict.fromkeys(FEATURES, 0.0)
    spans = quotations(low)
    starts = [s for s, _ in spans]
    for i, m in enumerate(found):
        if (hit := hits.get(words[i])) is None:
            continue
        weight, edits = hit
        near = words[max(0, i - WINDOW_WORDS) : i] + words[i + 1 : i + 1 + WINDOW_WORDS]
        marks = low[max(0, m.start() - 1) : m.start()] + low[m.end() : m.end() + 1]
        at = bisect.bisect_right(starts, m.start()) - 1
        inside = at >= 0 and m.end() <= spans[at][1]
        quoted = inside or sum(c in QUOTES for c in marks) == 2 or len(REPORTING.intersection(near)) > 1
        if weight < LEAST_ODDS:
            sums["weak"] += weight * (not quoted)
            continue
        sums["quoted" if quoted else "hits"] += weight * EDIT_SHARE**edits
        sums["addressed"] += bool(ADDRESS.intersection(near)) and not quoted
    sums["kinds"] = float(sum(weight >= LEAST_ODDS for weight, _ in hits.values()))
    return tuple(float(np.log1p(max(0.0, sums[k]))) for k in FEATURES)


def term_counts(rows: DataFrame) -> DataFrame:
    """(term, stem, p, q, n_words) over the sample: toxic and other documents with the term, and for stems the distinct words of toxic ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for text, y in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                words = {w for w in WORD.findall((text or "").lower()) if len(w) >= 3}
                stems = {w[:k] for w in words for k in STEMS if len(w) > k}
                for i, (terms, stem) in enumerate(((words, False), (stems, True))):
                    out[0].extend(terms)
                    out[1].extend([stem] * len(terms))
                    out[2].extend([y] * len(terms))
                    out[3].extend([1 - y] * len(terms))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.bool_()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64())], names=["term", "stem", "p", "q"])

    counted = stash(rows.select("text", "label").mapInArrow(run, "term string, stem boolean, p long, q long").groupBy("term", "stem").agg(F.sum("p").alias("p"), F.sum("q").alias("q")).filter("p > 0"), "terms")
    begins = F.explode(F.array(*[F.when(F.char_length("term") > k, F.substring("term", 1, k)) for k in STEMS]))
    words = counted.filter(~F.col("stem")).select(begins.alias("term")).filter(F.col("term").isNotNull()).groupBy("term").agg(F.count(F.lit(1)).alias("n_words"))
    stems = counted.filter("stem").join(words, "term")
    return stems.unionByName(counted.filter(~F.col("stem")).withColumn("n_words", F.lit(1).cast("long")))


def near_counts(rows: DataFrame, terms: list[tuple]) -> DataFrame:
    """(term, edits, p, q) over the sample: toxic and other documents with a word so many edits from the term."""
    made: list[Lexicon] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Lexicon(terms))
        for batch in batches:
            out: list[tuple[str, int, int, int]] = []
            for text, y in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                words = set(WORD.findall((text or "").lower()))
                out += [(term, edits, y, 1 - y) for term, edits in set().union(*(made[0].near(w) for w in words))]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["term", "edits", "p", "q"])

    return rows.select("text", "label").mapInArrow(run, "term string, edits long, p long, q long").groupBy("term", "edits").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))


def bound_edits(terms: list[tuple[str, bool, float]], near: dict[tuple[str, int], tuple[int, int]], sizes: dict[int, int]) -> list[tuple[str, bool, float, int]]:
    """The terms with the edits up to which their near hits are evidence: none in clean documents, or the odds asked of terms."""
    out = []
    for term, stem, weight in terms:
        edits = 0
        while edits < most_edits(term, stem):
            p, q = near.get((term, edits + 1), (0, 0))
            if q and np.log((p + 0.5) / (sizes[1] + 1.0)) - np.log((q + 0.5) / (sizes[0] + 1.0)) < LEAST_ODDS:
                break
            edits += 1
        out.append((term, stem, weight, edits))
    return out


def errors(p: int, q: int) -> float:
    """The standard error of log odds."""
    return float(np.sqrt(1 / (p + 0.5) + 1 / (q + 0.5)))


def choose(strong: list) -> list[tuple[str, bool, float]]:
    """Terms of the rows (term, stem, p, q, odds): stems that no single word makes up nor another stem covers, and all words.

    Words that a stem covers stay, for the hits with edits that a stem hasn't.  Of
    nested stems with odds under LEAST_ODDS the most significant is taken; where a
    word begins with several stems, the longest is its hit.
    """
    kept = sorted(strong, key=lambda r: (-r.odds, r.term, r.stem))
    most: dict[str, int] = {}
    for r in kept:
        for k in STEMS:
            if not r.stem and len(r.term) > k:
                most[r.term[:k]] = max(r.p, most.get(r.term[:k], 0))
    stems: dict[str, float] = {}
    for r in sorted((r for r in kept if r.stem and r.odds >= LEAST_ODDS), key=lambda r: (len(r.term), r.term)):
        # A stem stands for several words; if one word makes up nearly all of it, that word is the term.
        if most.get(r.term, 0) < 0.6 * r.p and not any(r.term[:k] in stems for k in STEMS if k < len(r.term)):
            stems[r.term] = r.odds
    weak: dict[str, float] = {}
    for r in sorted((r for r in kept if r.stem and r.odds < LEAST_ODDS), key=lambda r: (-r.odds / errors(r.p, r.q), r.term)):
        if most.get(r.term, 0) < 0.6 * r.p and not any(r.term.startswith(s) or s.startswith(r.term) for s in weak):
            weak[r.term] = r.odds
    return [(s, True, w) for s, w in (stems | weak).items()] + [(r.term, False, r.odds) for r in kept if not r.stem]


def learn(rows: DataFrame) -> list[tuple[str, bool, float, int]]:
    """The terms of the labelled texts with their edits; the sample alone bounds how many there are."""
    sizes = {r.label: r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return []
    odds = F.log((F.col("p") + 0.5) / (sizes[1] + 1.0)) - F.log((F.col("q") + 0.5) / (sizes[0] + 1.0))
    counted = term_counts(rows).filter(F.col("p") >= LEAST_DOCS).withColumn("odds", odds)
    error = F.sqrt(1 / (F.col("p") + 0.5) + 1 / (F.col("q") + 0.5))
    frequent = F.col("stem") & (F.col("odds") >= LEAST_STEM_ODDS) & (F.col("odds") >= STEM_ERRORS * error)
    terms = choose(counted.filter(((F.col("odds") >= LEAST_ODDS) | frequent) & (~F.col("stem") | (F.col("n_words") >= STEM_WORDS))).collect())
    # At most two rows a term.
    near = {(r.term, r.edits): (r.p, r.q) for r in near_counts(rows, terms).collect()} if terms else {}
    return bound_edits(terms, near, sizes)


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 40, ridge: float = 0.05, weight: np.ndarray | None = None) -> np.ndarray:
    total = len(y) if weight is None else weight.sum()
    share = (np.ones(len(y)) if weight is None else weight) / total
    x = np.hstack([np.ones((len(x), 1)), x])
    w, keep = np.zeros(x.shape[1]), np.diag([0.0, *[ridge] * (x.shape[1] - 1)])
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (share * (q - y)) + keep @ w / total * 10
        h = (x * np.maximum(q * (1 - q), 1e-5)[:, None] * share[:, None]).T @ x + keep / total * 10 + 1e-9 * np.eye(len(w))
        w -= np.clip(np.linalg.solve(h, grad), -2, 2)
    return w


def supporting(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """``logistic`` with no weight below 0 for the features that can only speak for abuse."""
    used = np.ones(x.shape[1], bool)
    while True:
        w = np.zeros(x.shape[1] + 1)
        w[np.append(True, used)] = logistic(x[:, used], y, weight=weight)
        wrong = np.where(FOR_ABUSE, w[1:], 0.0)
        if wrong.min() >= 0:
            return w
        used[wrong.argmin()] = False


def add_features(docs: DataFrame, terms: list[tuple], text: str = "text", name: str = "hits") -> DataFrame:
    made: list[Lexicon] = []

    def make(texts: pa.Array) -> list[pa.Array]:
        if not made:
            made.append(Lexicon(terms))
        return [pa.array([features(t or "", made[0]) for t in texts.to_pylist()], pa.list_(pa.float64()))]

    return add_columns(docs, text, [T.StructField(name, T.ArrayType(T.DoubleType()))], make)


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS, threshold: float = 0.7) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted and the features of its hits."""
    picked = docs.select("doc_id", "text")
    rows = stash(sample(picked, labels, label, per_class), "toxic-sample")
    terms = learn(rows)
    known = add_features(rows, terms).select("label", "weight", "hits").collect() if terms else []  # at most 2 * per_class rows of a few numbers
    w = supporting(np.array([r.hits for r in known]), np.array([r.label for r in known], float), np.array([r.weight for r in known])) if known else np.array([-30.0, *[0.0] * len(FEATURES)])
    scored = add_features(picked, terms)
    z = sum((F.get("hits", F.lit(i)) * float(x) for i, x in enumerate(w[1:])), F.lit(float(w[0])))
    scored = scored.withColumn("score", 1 / (1 + F.exp(-z)))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
