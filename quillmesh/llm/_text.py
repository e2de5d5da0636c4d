"""Words, hashes and shingles of Arrow batches, as flat numpy arrays."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: A word is a maximal run of letters and digits, lower-cased.
WORD = re.compile(r"[^\W_]+")
#: Entries a worker keeps of word -> hash before it starts again.
CACHE = 1_000_000
#: Bytes of text that are turned into words at once.
SLICE = 4_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hash_of = _WordHashes()


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def word_hashes(texts: Iterable[str | None], min_chars: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, one after the other, and the number of words of each text."""
    flat: list[int] = []
    counts = []
    for text in texts:
        found = words(text)
        if min_chars > 1:
            found = [w for w in found if len(w) >= min_chars]
        flat.extend(map(_hash_of.__getitem__, found))
        counts.append(len(found))
    return np.array(flat, np.uint64), np.array(counts, np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def owners(counts: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(counts)), counts)


def shingles(flat: np.ndarray, owner: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of k consecutive words at every position that has one, and the text of each."""
    n = len(flat) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = h * _ODD + flat[i : i + n]
    whole = owner[:n] == owner[k - 1 : k - 1 + n]
    return mix(h[whole]), owner[:n][whole]


def distinct(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each text, sorted by (text, value)."""
    if not len(values):
        return values, owner
    at = np.lexsort((values, owner))
    v, o = values[at], owner[at]
    first = np.r_[True, (v[1:] != v[:-1]) | (o[1:] != o[:-1])]
    return v[first], o[first]


def by_chars(batch: pa.RecordBatch, column: int = 1, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about `most` bytes of text; a single longer text is a slice."""
    size = np.diff(_offsets(batch.column(column)))
    at = 0
    total = np.cumsum(size)
    while at < batch.num_rows:
        base = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, base + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


def _offsets(strings: pa.Array) -> np.ndarray:
    width = np.int64 if pa.types.is_large_string(strings.type) else np.int32
    return np.frombuffer(strings.buffers()[1], width)[strings.offset : strings.offset + len(strings) + 1]
