"""Problem 8: token ids of every text by a public byte-level BPE.

Texts are cut into pre-tokens; each distinct pre-token of a worker is encoded once. Pre-tokens are sorted
into length buckets and stand as rows of a padded matrix of symbols. In every round each row merges its
leftmost pair of least rank (pairs are looked up in a hash table), rows without such a pair leave the matrix.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the pre-token pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct pre-tokens a worker remembers; pre-tokens of more bytes than LONG find their least pair by a heap.
REMEMBERED, LONG = 400_000, 1024
_NONE = np.int32(2**31 - 1)
_EMPTY = np.uint64(2**64 - 1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Open-addressing hash table (left, right) -> rank of the merged symbol."""

    def __init__(self, pairs: np.ndarray, ranks: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(2, len(pairs)) * 4))))
        self.keys = np.full(1 << self.bits, _EMPTY, np.uint64)
        self.ranks = np.full(1 << self.bits, _NONE, np.int32)
        todo = np.arange(len(pairs))
        slot = self._slot(pairs)
        while len(todo):
            free = self.keys[slot] == _EMPTY
            _, first = np.unique(slot[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.keys[slot[won]], self.ranks[slot[won]] = pairs[todo[won]], ranks[todo[won]]
            rest = np.ones(len(todo), bool)
            rest[won] = False
            todo, slot = todo[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * _ODD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        shape = left.shape
        key = (left.astype(np.uint64).ravel() << np.uint64(32)) | right.astype(np.uint64).ravel()
        slot = self._slot(key)
        out = np.full(len(key), _NONE, np.int32)
        at = np.arange(len(key))
        while len(at):
            there = self.keys[slot]
            hit = there == key[at]
            out[at[hit]] = self.ranks[slot[hit]]
            go = ~hit & (there != _EMPTY)
            at, slot = at[go], (slot[go] + 1) & ((1 << self.bits) - 1)
        return out.reshape(shape)


def load_ranks(path: str) -> tuple[np.ndarray, PairTable]:
    """Ids of the 256 bytes and the pair table of a file of ranks; every split of a token into two tokens is a pair."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pairs, to = [], []
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            left, right = ranks.get(token[:i]), ranks.get(token[i:])
            if left is not None and right is not None:
                pairs.append((left << 32) | right)
                to.append(rank)
    return np.array([ranks[bytes([b])] for b in range(256)], np.int32), PairTable(np.array(pairs, np.uint64), np.array(to, np.int32))


def _merge_rows(sym: np.ndarray, n: np.ndarray, table: PairTable) -> list[np.ndarray]:
    """sym: rows of symbols padded on the right; n: symbols in each row. One merge a row and round."""
    done: list[np.ndarray | None] = [None] * len(sym)
    row = np.arange(len(sym))
    width = sym.shape[1]
    rank = np.full((len(sym), width), _NONE, np.int32)
    if width > 1:
        rank[:, :-1] = table.look(sym[:, :-1], sym[:, 1:])
        rank[np.arange(width)[None, :] >= n[:, None] - 1] = _NONE
    while len(row):
        at = rank.argmin(axis=1)
        best = rank[np.arange(len(row)), at]
        over = best == _NONE
        if over.any():
            for i in np.flatnonzero(over):
                done[row[i]] = sym[i, : n[i]].copy()
            keep = ~over
            row, n, at, best = row[keep], n[keep], at[keep], best[keep]
            top = int(n.max()) if len(n) else 0
            sym, rank = sym[keep, :top], rank[keep, :top]
            if not len(row):
                break
        width = sym.shape[1]
        i = np.arange(len(row))
        col = np.arange(width)[None, :]
        take = np.minimum(col + (col > at[:, None]), width - 1)
        sym, rank = np.take_along_axis(sym, take, 1), np.take_along_axis(rank, take, 1)
        n = n - 1
        sym[i, at] = best
        rank[:, -1] = _NONE
        right = np.minimum(at + 1, width - 1)
        rank[i, at] = np.where(at + 1 < n, table.look(sym[i, at], sym[i, right]), _NONE)
        left = np.maximum(at - 1, 0)
        fresh = table.look(sym[i, left], sym[i, at])
        rank[i, left] = np.where(at > 0, fresh, rank[i, left])
    return done


def _merge_long(sym: np.ndarray, table: PairTable) -> np.ndarray:
    """One long row, the leftmost pair of least rank in each round as in the matrices, found by a heap of (rank, place).

    A merge can make a pair of lower rank than its own (" the" comes before "the"), so rounds can't be taken together.
    """
    symbols = sym.tolist()
    n, none = len(symbols), int(_NONE)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    rank = table.look(sym[:-1], sym[1:]).tolist() + [none]  # of the pair that begins at a place; a place that is gone has none
    heap = [(r, i) for i, r in enumerate(rank) if r != none]
    heapq.heapify(heap)

    known: dict[tuple[int, int], int] = {}

    def look(i: int) -> None:
        j = after[i]
        if j < n:
            pair = symbols[i], symbols[j]
            if (r := known.get(pair)) is None:
                r = known[pair] = int(table.look(*np.array(pair, np.int32)[:, None])[0])
            rank[i] = r
        else:
            rank[i] = none
        if rank[i] != none:
            heapq.heappush(heap, (rank[i], i))

    while heap:
        r, i = heapq.heappop(heap)
        if rank[i] != r:
            continue
        j = after[i]
        symbols[i], after[i], rank[j] = r, after[j], none
        if after[j] < n:
            before[after[j]] = i
        look(i)
        if before[i] >= 0:
            look(before[i])
    out, i = [], 0
    while i < n:
        out.append(symbols[i])
        i = after[i]
    return np.array(out, np.int32)


def encode_pretokens(tokens: list[str], first: np.ndarray, table: PairTable) -> list[np.ndarray]:
    raw = [t.encode("utf-8", "surrogatepass") for t in tokens]
    size = np.array([len(b) for b in raw])
    out: list[np.ndarray] = [np.empty(0, np.int32)] * len(raw)
    lo = 0
    for hi in (1, 2, 4, 6, 8, 12, 16, 24, 32, 64, 128, 256, 512, LONG):
        at = np.flatnonzero((size > lo) & (size <= hi))
        lo = hi
        for part in np.array_split(at, max(1, len(at) * hi // 4_000_000 + 1)) if len(at) else ():
            n = size[part]
            flat = first[np.frombuffer(b"".join(raw[i] for i in part), np.uint8)]
            sym = np.zeros((len(part), hi), np.int32)
            sym[np.arange(hi)[None, :] < n[:, None]] = flat
            for i, ids in zip(part, _merge_rows(sym, n, table), strict=True):
                out[i] = ids
    for i in np.flatnonzero(size > LONG):
        out[i] = _merge_long(first[np.frombuffer(raw[i], np.uint8)], table)
    return out


class Encoder:
    """Encodes batches; remembers the ids of distinct pre-tokens in a bounded table."""

    def __init__(self, first: np.ndarray, table: PairTable):
        self.first, self.table, self.pattern = first, table, regex.compile(PATTERN)
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.starts, self.sizes, self.flat = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)

    def learn(self, tokens: list[str]) -> None:
        ids = encode_pretokens(tokens, self.first, self.table)
        sizes = np.array([len(i) for i in ids], np.int64)
        starts = len(self.flat) + np.cumsum(sizes) - sizes
        self.index.update(zip(tokens, range(len(self.index), len(self.index) + len(tokens)), strict=True))
        self.starts, self.sizes = np.r_[self.starts, starts], np.r_[self.sizes, sizes]
        self.flat = np.concatenate([self.flat, *ids]).astype(np.int32)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the number of each text's ids."""
        found = self.pattern.findall
        tokens: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text:
                before = len(tokens)
                tokens += found(text)
                counts[i] = len(tokens) - before
        distinct = set(tokens)
        if len(self.index) + len(distinct) > REMEMBERED:
            self.forget()
        if new := [t for t in distinct if t not in self.index]:
            self.learn(new)
        at = np.fromiter(map(self.index.__getitem__, tokens), np.int64, len(tokens))
        size, start = self.sizes[at], self.starts[at]
        end = np.cumsum(size)
        ids = self.flat[np.arange(end[-1] if len(end) else 0) + np.repeat(start - (end - size), size)]
        bounds = np.r_[0, np.cumsum(counts)]
        total = np.r_[0, end]
        return ids, total[bounds[1:]] - total[bounds[:-1]]


def encode_documents(docs: DataFrame, text: str = "text", tokenizers: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """(doc_id, ids) of every row; no special tokens, their strings in a text are ordinary text.

    An empty and a null text give an empty list. Texts are encoded whole. The vocabulary (a fixed file of
    less than 2 MB) is read once on the driver and sent to the workers as it is.
    """
    first, table = load_ranks(f"{tokenizers}/{name}.tiktoken")
    sent = docs.sparkSession.sparkContext.broadcast((first, table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids, counts = encoder.encode(part.column(1).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("t")).mapInArrow(run, "doc_id long, ids array<int>")
