"""Words, lines and hashes of whole Arrow text columns, computed on UTF-8 bytes.

A word is ``[^\\x20\\x09-\\x0D]+``.  The separators are ASCII, so words of the
bytes are words of the text.  Hashes have 64 bits and are the same in every
process and on every machine.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

U64 = np.uint64
CHUNK_BYTES = 1 << 20
IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
AS_IS = np.arange(256, dtype=np.uint8)
LOWER = AS_IS.copy()
LOWER[65:91] += 32
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
WINDOW = _rng.integers(1, 2**63, 64, dtype=np.uint64) * U64(2) + U64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(CHUNK_BYTES, n)
    found = _powers.get(size)
    if found is None:
        found = tuple(np.concatenate(([U64(1)], np.cumprod(np.full(size, b, U64)))) for b in (_BASE, _BASE_INVERSE))
        if size == CHUNK_BYTES:
            _powers[size] = found
    return found


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and UTF-8 bytes of a string column; nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return at - at[0], whole[at[0] : at[-1]]


def slices(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts have about ``most`` bytes; a longer text comes alone."""
    if not batch.num_rows:
        return
    at, _ = buffers(batch.column(column))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        yield batch.slice(first, last - first)
        first = last


class Words:
    """The words of some texts: ``doc`` and byte positions of each, ``count`` per text."""

    def __init__(self, column: pa.Array):
        self.at, self.data = buffers(column)
        self.n_docs = len(self.at) - 1
        inside = IS_WORD[self.data]
        edge = np.zeros(len(self.data) + 1, bool)
        edge[self.at] = True
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:-1]
        last[:-1] &= ~inside[1:] | edge[1:-1]
        self.inside = inside
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.doc = np.searchsorted(self.at, self.start, "right") - 1
        self.count = np.bincount(self.doc, minlength=self.n_docs)
        self.bounds = np.concatenate(([0], np.cumsum(self.count)))

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each text are flagged."""
        total = np.concatenate(([0], np.cumsum(flags)))
        return total[self.at[1:]] - total[self.at[:-1]]

    def hashes(self, fold: np.ndarray = AS_IS) -> np.ndarray:
        """A 64-bit hash of each word; ``fold`` maps bytes first."""
        up, down = _power(len(self.data))
        total = np.concatenate(([U64(0)], np.cumsum(_BYTE[fold[self.data]] * up[: len(self.data)])))
        return mix((total[self.end] - total[self.start]) * down[self.start])


def span_hashes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes between neighbouring offsets."""
    up, down = _power(len(data))
    total = np.concatenate(([U64(0)], np.cumsum(_BYTE[data] * up[: len(data)])))[offsets]
    return mix((total[1:] - total[:-1]) * down[offsets[:-1]])


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` word hashes."""
    if len(h) < k:
        return np.zeros(0, U64)
    total = np.zeros(len(h) - k + 1, U64)
    for i in range(k):
        total += h[i : len(h) - k + 1 + i] * WINDOW[i]
    return mix(total)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """The distinct shingle hashes of one text's words, ascending; a shorter text is one shingle."""
    if 0 < len(h) < k:
        return mix((h * WINDOW[k : k + len(h)]).sum(keepdims=True) ^ WINDOW[40 + len(h)])
    return np.unique(windows(h, k))


def word_hashes(column: pa.Array, fold: np.ndarray = AS_IS) -> Iterator[np.ndarray]:
    """The hashes of each text's words.  A text beyond a slice is hashed in runs of its words, so that its memory is that of the hashes; a word isn't cut."""
    at, data = buffers(column)
    if at[-1] <= CHUNK_BYTES:
        words = Words(column)
        h = words.hashes(fold)
        yield from (h[words.bounds[i] : words.bounds[i + 1]] for i in range(words.n_docs))
        return
    for first, last in zip(at[:-1], at[1:], strict=True):
        runs = [np.zeros(0, U64)]
        while first < last:
            end = min(first + CHUNK_BYTES, last)
            if end < last:
                gaps = np.flatnonzero(~IS_WORD[data[first:end]])
                if len(gaps):
                    end = first + gaps[-1] + 1
                else:
                    more = (~IS_WORD[data[end:last]]).argmax()
                    end = end + more + 1 if not IS_WORD[data[end + more]] else last
            run = data[first:end]
            runs.append(Words(pa.LargeStringArray.from_buffers(1, pa.py_buffer(np.array([0, len(run)], np.int64)), pa.py_buffer(run))).hashes(fold))
            first = end
        yield np.concatenate(runs)


def over_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``df.mapInArrow`` whatever the names of the columns: dots in them too."""
    names = df.columns

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run(b.rename_columns(names) for b in batches)

    return df.toDF(*[f"__pm_{i}" for i in range(len(names))]).mapInArrow(named, schema)


def quoted(df: DataFrame) -> list[Column]:
    """The columns of ``df``, whatever their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def add_columns(df: DataFrame, text: str, fields: list[T.StructField], make: Callable[[pa.Array], list[pa.Array]], most: int = CHUNK_BYTES) -> DataFrame:
    """``df`` with the columns that ``make`` computes from runs of its text column."""
    schema = T.StructType([*df.schema.fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, most):
                added = make(part.column(text))
                yield pa.RecordBatch.from_arrays([*part.columns, *added], names=schema.names)

    return over_batches(df, run, schema)
