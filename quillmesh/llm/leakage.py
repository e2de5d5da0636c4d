"""Problem 9: evaluation items inside corpus documents, by size-partitioned MinHash containment search.

A leak is a run of RUN words that a document shares with an item. Items and documents differ in size by
orders of magnitude, so a MinHash of the whole text would miss short items. Both sides are therefore
partitioned into parts of one size, the windows of RUN words: for sets of the same size, containment of
one in the other is equality, so equal windows always have equal MinHashes (the least hash among the
shingles of the window) and no leak is lost. Windows that collide are verified word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm._text import WORD, by_chars, owners, shingles, word_hashes, words

RUN, SHINGLE = 13, 5
#: Windows of items sent to the workers at once; more items are searched in further blocks.
WINDOWS = 500_000


def window_minima(flat: np.ndarray, owner: np.ndarray, run: int = RUN, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """MinHash of the k-word shingles of each window of `run` words, and the window's first word."""
    n = len(flat) - run + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h, _ = shingles(flat, np.zeros(len(flat), np.int64), k)
    width, least, span = run - k + 1, h, 1
    while span * 2 <= width:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    least = np.minimum(least[:n], least[width - span : width - span + n])
    at = np.flatnonzero(owner[:n] == owner[run - 1 : run - 1 + n])
    return least[at], at


class ItemIndex:
    """MinHash -> windows of items; the windows' words decide."""

    def __init__(self, items: list[tuple[int, str]], run: int = RUN):
        self.run, self.windows, self.of, minima = run, {}, {}, []
        for item, text in items:
            w = words(text)
            flat, counts = word_hashes([text])
            least, at = window_minima(flat, owners(counts), run)
            minima.append(least)
            for m, i in zip(least.tolist(), at.tolist(), strict=True):
                self.windows.setdefault(m, {}).setdefault(tuple(w[i : i + run]), set()).add(item)
            self.of[item] = max(0, len({tuple(w[i : i + run]) for i in range(len(w) - run + 1)}))
        self.minima = np.unique(np.concatenate(minima)) if minima else np.empty(0, np.uint64)
        self.gate = np.zeros(1 << 22, bool)
        self.gate[(self.minima >> np.uint64(42)).astype(np.int64)] = True

    def search(self, texts: list[str]) -> list[dict[int, set]]:
        """For each text the items it leaks and the windows it shares with them."""
        found: list[dict[int, set]] = [{} for _ in texts]
        flat, counts = word_hashes(texts)
        owner = owners(counts)
        least, at = window_minima(flat, owner, self.run)
        hit = np.flatnonzero(self.gate[(least >> np.uint64(42)).astype(np.int64)])
        if not len(hit):
            return found
        slot = np.minimum(np.searchsorted(self.minima, least[hit]), len(self.minima) - 1)
        hit = hit[self.minima[slot] == least[hit]]
        first = np.cumsum(counts) - counts
        cached, w = -1, []
        for m, p in zip(least[hit].tolist(), at[hit].tolist(), strict=True):
            t = int(owner[p])
            if t != cached:
                cached, w = t, words(texts[t])
            i = p - int(first[t])
            window = tuple(w[i : i + self.run])
            for item in self.windows[m].get(window, ()):
                found[t].setdefault(item, set()).add(window)
        return found


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    block, size = [], 0
    for item, text in items.toLocalIterator():
        block.append((item, text))
        size += len(WORD.findall(text))
        if size >= WINDOWS:
            yield block
            block, size = [], 0
    if block:
        yield block


def leaked_items(docs: DataFrame, items: DataFrame, text: str = "text", run: int = RUN) -> DataFrame:
    """(doc_id, item_id, n_windows, containment) of every document that shares a run of `run` words with an item.

    containment is the share of the item's distinct windows that occur in the document. The items are the
    stated query set: they are sent to the workers in blocks of bounded size, each block against all
    documents. Null and empty texts and items of fewer than `run` words match nothing.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    schema = "doc_id long, item_id long, n_windows int, containment double"
    result = None
    for block in _blocks(items.select(F.col("item_id").cast("long"), "text").where(F.col("text").isNotNull() & F.col("item_id").isNotNull())):
        sent = spark.sparkContext.broadcast((block, run))

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(*sent.value)
            for batch in batches:
                out: list[tuple] = []
                for part in by_chars(batch):
                    ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                    for doc, hits in zip(ids, index.search(texts), strict=True):
                        out += [(doc, item, len(w), len(w) / index.of[item]) for item, w in hits.items()]
                if out:
                    columns = zip(*out, strict=True)
                    types = (pa.int64(), pa.int64(), pa.int32(), pa.float64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "item_id", "n_windows", "containment"]
                    )

        found = rows.mapInArrow(scan, schema)
        result = found if result is None else result.unionByName(found)
    if result is None:
        return spark.createDataFrame([], schema)
    return result.groupBy("doc_id", "item_id").agg(F.max("n_windows").alias("n_windows"), F.max("containment").alias("containment"))
