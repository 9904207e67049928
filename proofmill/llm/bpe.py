"""Byte-level BPE with forced-boundary splitting.

A pair of neighbouring bytes that occurs inside no token of the vocabulary can't
be inside any token of an encoding, so every such pair is a certain cut.  Texts
are split at added tokens, then into the pre-tokens of the tokenizer's pattern,
then at all certain cuts; the fragments are encoded on their own, all distinct
ones of about a MB of texts at once, and concatenated; a worker keeps the results
in a bounded cache.
Decoding concatenates the bytes of the tokens.

Defined results: a null text counts as empty, and an empty text has no tokens
and decodes to the empty text.  Repeated rows get equal results, an empty table
an empty one.  Very long texts are taken piece by piece, without prefixes or
caps.  Further columns pass through; a column of ``df`` that has the name of an
added one is replaced.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from proofmill.llm.textscan import add_columns

#: The pre-token pattern of byte-level BPE: a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: The same for texts without the characters of ODD, in the faster standard module, whose letters hold other numbers too and whose white space holds 1C to 1F.
PLAIN_PATTERN = r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
ODD = r"[\p{Nl}\p{No}\x1c-\x1f]"
#: Entries of a worker's cache, bytes of texts and pre-tokens that are taken at once: workers stay, with the most they ever held.
CACHE = 200_000
CHUNK = 1 << 20
PIECES = 200_000
LONG = PIECES
NO_MERGE = 1 << 30


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in vocabulary files: printable ones stand for themselves, the rest follow from 256."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: bytes(letters[c] for c in s) for s, i in vocab.items() if s not in self.added}
        self.bytes_of |= {i: s.encode() for s, i in self.added.items()}
        self.byte_id = {letters[c]: vocab[c] for c in letters}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        self.rank = {(a, b): rank for rank, (a, b, _) in enumerate(merges)}
        self.made = np.array([new for *_, new in merges])
        keys = np.array([a << 20 | b for a, b, _ in merges])
        self.by_key = np.argsort(keys)
        self.keys = keys[self.by_key]
        self.ids_of_bytes = np.array([self.byte_id[b] for b in range(256)])
        inside = np.zeros(1 << 16, bool)
        for token in self.bytes_of.values():
            if len(token) > 1:
                b = np.frombuffer(token, np.uint8).astype(np.int64)
                inside[b[:-1] << 8 | b[1:]] = True
        self.joins = inside.tolist()
        self.pattern, self.plain, self.odd = regex.compile(PATTERN), re.compile(PLAIN_PATTERN), regex.compile(ODD)
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        #: Ids as bytes of 32-bit integers, so that they are joined without an object for each.
        self.pretokens: dict[str, bytes] = {}
        table = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]
        self.token_size = np.array([len(x) for x in table])
        self.token_at = np.cumsum(self.token_size) - self.token_size
        self.token_bytes = np.frombuffer(b"".join(table), np.uint8)

    def cuts(self, data: bytes) -> list[bytes]:
        """``data`` cut at every pair of bytes that is inside no token."""
        joins = self.joins
        at = [i for i, (a, b) in enumerate(zip(data, data[1:]), 1) if not joins[a << 8 | b]]
        return [data[i:j] for i, j in zip([0, *at], [*at, len(data)], strict=True)] if at else [data]

    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.by_key[at], NO_MERGE)

    def merge(self, fragments: list[bytes]) -> list[bytes]:
        """The tokens of each fragment: always the merge of lowest rank, leftmost first, in all fragments at once."""
        out: list[bytes] = [b""] * len(fragments)
        short = [i for i, f in enumerate(fragments) if len(f) <= 48]
        for i in set(range(len(fragments))) - set(short):
            out[i] = array("i", self._merge_long([self.byte_id[x] for x in fragments[i]])).tobytes()
        if not short:
            return out
        which, size = np.array(short), np.array([len(fragments[i]) for i in short])
        ids = self.ids_of_bytes[np.frombuffer(b"".join([fragments[i] for i in short]), np.uint8)]
        rank = np.append(self.ranks_of(ids[:-1], ids[1:]), NO_MERGE)
        rank[np.cumsum(size) - 1] = NO_MERGE
        while len(which):
            first = np.cumsum(size) - size
            best = np.minimum.reduceat(rank, first)
            live = best < NO_MERGE
            if not live.all():
                flat, done = ids.astype(np.int32).tobytes(), ~live
                for i, at, n in zip(which[done].tolist(), (4 * first[done]).tolist(), (4 * size[done]).tolist(), strict=True):
                    out[i] = flat[at : at + n]
                kept = np.repeat(live, size)
                ids, rank, which, size, best = ids[kept], rank[kept], which[live], size[live], best[live]
                if not len(which):
                    break
            owner = np.repeat(np.arange(len(which)), size)
            at = np.flatnonzero(rank == best[owner])
            at = at[np.append(True, owner[at[1:]] != owner[at[:-1]])]
            ids[at] = self.made[best]
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            last = np.zeros(len(ids), bool)
            last[np.cumsum(size) - 1] = True
            ends = last[at + 1]
            ids, rank, at, size = ids[stay], rank[stay], at - np.arange(len(at)), size - 1
            inner = at[~ends]
            rank[inner] = self.ranks_of(ids[inner], ids[inner + 1])
            rank[at[ends]] = NO_MERGE
            before = at[at > np.cumsum(size) - size] - 1
            rank[before] = self.ranks_of(ids[before], ids[before + 1])
        return out

    def _merge_long(self, ids: list[int]) -> list[int]:
        n = len(ids)
        left, right, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
        heap = [(m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := self.rank.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = right[i] if alive[i] else -1
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], right[i] = int(self.made[rank]), False, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for p, q in ((left[i], i), (i, right[i])):
                if p >= 0 and q >= 0 and (m := self.rank.get((ids[p], ids[q]))) is not None:
                    heapq.heappush(heap, (m, p, ids[p], ids[q]))
        return [x for x, live in zip(ids, alive, strict=True) if live]

    def learn(self, pretokens: list[str]) -> dict[str, bytes]:
        """The ids of some distinct pre-tokens, by encoding their distinct fragments."""
        parts = [self.cuts(p.encode()) for p in pretokens]
        fragments = list(set(chain.from_iterable(parts)))
        ids = dict(zip(fragments, self.merge(fragments), strict=True))
        found = {p: b"".join(map(ids.__getitem__, fs)) for p, fs in zip(pretokens, parts, strict=True)}
        return found | {p: array("i", [i]).tobytes() for p, i in self.added.items() if p in found}

    def _pieces(self, text: str) -> Iterator[list[str]]:
        pattern = self.pattern if self.odd.search(text) else self.plain
        if len(text) <= LONG:
            yield pattern.findall(text)
            return
        found = (m.group() for m in pattern.finditer(text))
        while piece := list(islice(found, PIECES)):
            yield piece

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as bytes of 32-bit integers; unknown pre-tokens of many texts are encoded together."""
        out: list[list[bytes]] = [[] for _ in texts]
        waiting: list[tuple[list[bytes], list[str]]] = []
        n = 0
        for own, text in zip(out, texts, strict=True):
            for part in self.split.split(text) if self.split and self.split.search(text) else [text]:
                if part in self.added:
                    waiting.append((own, [part]))
                    continue
                for piece in self._pieces(part):
                    waiting.append((own, piece))
                    n += len(piece)
                    if n >= PIECES:
                        self._flush(waiting)
                        n = 0
        self._flush(waiting)
        return [b"".join(own) for own in out]

    def _flush(self, waiting: list[tuple[list[bytes], list[str]]]) -> None:
        here = set(chain.from_iterable(piece for _, piece in waiting))
        if len(self.pretokens) + len(new := here.difference(self.pretokens)) > CACHE:
            self.pretokens, new = {}, here
        known = self.pretokens
        known |= self.learn(list(new))
        for own, piece in waiting:
            own.append(b"".join(map(known.__getitem__, piece)))
        waiting.clear()

    def decode(self, ids: np.ndarray) -> str:
        size = self.token_size[ids]
        shift = self.token_at[ids] - (np.cumsum(size) - size)
        return self.token_bytes[np.repeat(shift, size) + np.arange(size.sum())].tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=4)
def tokenizer(path: str) -> ByteBpe:
    """One per worker process."""
    return ByteBpe(path)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``df`` with the token ids of each whole text and, if ``decoded`` names it, the text decoded from them."""
    fields = [T.StructField(ids, T.ArrayType(T.IntegerType()))] + [T.StructField(decoded, T.StringType())] * bool(decoded)

    def make(texts: pa.Array) -> list[pa.Array]:
        bpe = tokenizer(path)
        found = bpe.encode([t or "" for t in texts.to_pylist()])
        at = np.cumsum([0, *(len(x) // 4 for x in found)], dtype=np.int32)
        flat = np.frombuffer(b"".join(found), np.int32)
        out = [pa.ListArray.from_arrays(pa.array(at), pa.array(flat))]
        return out + [pa.array([bpe.decode(flat[i:j]) for i, j in zip(at, at[1:], strict=False)], pa.string())] * bool(decoded)

    return add_columns(df.drop(*[c for c in df.columns if c in {ids, decoded} and c != text]), text, fields, make, CHUNK)


def digests(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: the number of tokens, and SHA-256 of the ids and of the decoded text."""
    coded = encode(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), path, decoded="decoded")
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
