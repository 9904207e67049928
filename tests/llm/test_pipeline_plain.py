"""Rows of the whole pipeline against a plain version of its five stages, on documents with a host that is rejected."""

import hashlib
import math
import random
import re
import statistics
from collections import Counter

import public_tokenizers
import pytest
from test_operators import WORD, jaccard_components
from tokenizers import Tokenizer

import corpus_pipeline

FAIL = {"few": lambda m: m["n"] < 50, "repeats": lambda m: m["again"] > 0.5 * m["n"], "symbols": lambda m: 10 * m["symbols"] > m["n"], "lines": lambda m: 10 * m["dup"] > 3 * m["lines"]}
RATES = {"symbols": ("symbols", "n", 0.1, 10), "lines": ("dup", "lines", 0.3, 4)}
MAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")


def measured(text):
    words = WORD.findall(text or "")
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(triples)
    again = {i + j for i, t in enumerate(triples) if often[t] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return {"n": len(words), "again": len(again), "symbols": sum(c in "#*$%&|<>" for c in text or ""), "lines": len(lines), "dup": len(lines) - len(set(lines))}


def good(docs):
    own = [measured(d["text"]) for d in docs]
    by = {}
    for d, m in zip(docs, own):
        by.setdefault(d["source"], []).append(m)
    shrunk, bad = {}, set()
    for rule, fails in FAIL.items():
        failed = {h: sum(map(fails, ms)) for h, ms in by.items()}
        mean = sum(failed.values()) / len(docs)
        spread = mean * (1 - mean)
        between = statistics.pvariance([failed[h] / len(ms) for h, ms in by.items()]) - spread * statistics.mean(1 / len(ms) for ms in by.values())
        prior = 10_000 if between <= spread / 10_001 else max(1, spread / between - 1)
        for h, ms in by.items():
            shrunk[rule, h] = (failed[h] + mean * prior) / (len(ms) + prior)
            if shrunk[rule, h] > 0.5 and h is not None:
                bad.add(h)
    out = []
    for d, m in zip(docs, own):
        soft = any(FAIL[r](m) and (m[a] + pseudo * shrunk[r, d["source"]]) / (m[b] + pseudo) > most for r, (a, b, most, pseudo) in RATES.items())
        if not FAIL["few"](m) and not FAIL["repeats"](m) and d["source"] not in bad and not soft:
            out.append(d)
    return out, bad


def mixed(docs):
    sizes = {}
    for d in docs:
        d["size"] = len(WORD.findall(d["text"] or ""))
        sizes[d["source"]] = sizes.get(d["source"], 0) + d["size"]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    goal, left, open_ = {}, 1.5 * sum(sizes.values()), set(order)
    while open_:
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        for s in over or open_:
            goal[s] = 2 * sizes[s] if over else share[s]
        left -= sum(goal[s] for s in over)
        open_ = open_ - over if over else set()
    out = []
    for s in order:
        at = 0
        for d in sorted((d for d in docs if d["source"] == s), key=lambda d: (hashlib.md5(str(d["doc_id"]).encode()).hexdigest(), d["doc_id"])):
            out += [d] * sum(d["size"] > 0 and at + e * sizes[s] + d["size"] / 2 <= goal[s] for e in range(2))
            at += d["size"]
    return out


def plain(docs):
    docs, bad = good(docs)
    kept = {c for _, c in jaccard_components([(d["doc_id"], d["text"]) for d in docs]).values()}
    docs = [{**d, "text": MAIL.sub("<EMAIL>", d["text"])} for d in docs if d["doc_id"] in kept]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    out = []
    for d in mixed(docs):
        ids = tokenizer.encode(d["text"], add_special_tokens=False).ids
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        out.append((d["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False))))
    return sorted(out), bad


@pytest.fixture
def folder(spark, tmp_path):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    prose = lambda n: "\n".join(" ".join(word() for _ in range(10)) for _ in range(math.ceil(n / 10)))
    texts = []
    for i in range(160):
        text = prose(rng.randint(60, 140))
        texts.append((text, rng.choice(["web", "books", "wiki", None]) if i % 4 else "junk"))
    rows = [(i, t + (" #" * 30 if s == "junk" else ""), s) for i, (t, s) in enumerate(texts)]
    rows += [(200 + i, texts[4 * i + 1][0] + ("" if i % 2 else " more"), "web") for i in range(12)]  # copies, exact and near
    rows += [(300 + i, prose(80) + f" write to name{i}@host{i}.org today", "books") for i in range(10)]
    rows += [(400 + i, t, "wiki") for i, t in enumerate([None, "", "too few words", "a b c " * 40, prose(70) + " $" * 60, prose(60) + "\nsame line here" * 9])]
    rows += [(500, prose(70), "junk"), (501, " ".join(word() for _ in range(20_000)), "web")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    return tmp_path, [{"doc_id": i, "text": t, "source": s} for i, t, s in rows]


def test_run_equals_a_plain_version(spark, folder):
    path, rows = folder
    want, bad = plain(rows)
    assert bad == {"junk"}
    got = corpus_pipeline.run(spark, str(path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == want
    ids = Counter(r.doc_id for r in got)
    assert max(ids.values()) == 2 and not {*range(0, 160, 4), 400, 401, 402, 403, 404, 500} & set(ids) and len(ids) < len(rows) - 40
