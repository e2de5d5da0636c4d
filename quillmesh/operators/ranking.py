"""Whole ranked lists of a stated query set, fused by reciprocal ranks, without a row of a pair before the result.

A task takes a block of queries and reads what all documents have of them (`signal_rows`), a stored row at a time; it ranks and fuses its
queries one after the other. So pairs are neither shuffled nor stored; what is read again for each block are the documents' terms and vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions.encode import _slot, encode
from quillmesh.functions.text import words
from quillmesh.operators.retrieval import BONUS, K1, ROWS, RRF, B, Keyword, _units
from quillmesh.session import cut

#: Pairs of a query and a document that a task may have to hold; the least queries of a task where it has room for them; rows it adds at once.
HELD, LEAST, ADDED = 60_000_000, 32, 20_000
#: Kinds of signal rows.
NOTE, NEAR, NAME, CHUNK, TAG = range(5)
SCHEMA = "kind int, doc_id long, n long, a array<int>, b array<int>, c array<int>, x array<double>"


def signal_rows(kind: int, rows: DataFrame, **columns: str) -> DataFrame:
    """Rows of one signal in the form that a task reads: NOTE (n: length; a, b, c: terms, frequencies, phrases), NEAR (n: query, x: score),
    NAME and TAG (a: number), CHUNK (x: vector)."""
    shape = [f.rsplit(" ", 1) for f in SCHEMA.split(", ")[1:]]
    return rows.select(F.lit(kind).alias("kind"), *(F.col(columns.get(name, name)).cast(t).alias(name) if name == "doc_id" or name in columns else F.lit(None).cast(t).alias(name) for name, t in shape))


def packed(rows: DataFrame) -> DataFrame:
    """The rows, stored; each row of the result has up to a thousand as one compressed Arrow stream, which the JVM hands on as it is."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="lz4")
        for batch in (b.slice(lo, ROWS) for b in batches for lo in range(0, b.num_rows, ROWS)):
            with pa.ipc.new_stream(sink := pa.BufferOutputStream(), batch.schema, options=options) as out:
                out.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["rows"])

    return cut(rows.mapInArrow(pack, "rows binary"))


def packed_vectors(rows: DataFrame, text: Column, encoder: Callable[[list[list[str]]], np.ndarray] = encode) -> DataFrame:
    """`packed` CHUNK rows (doc_id, the vector of the text): one worker makes and packs a thousand vectors at a time and keeps nothing."""
    kinds = (pa.int32(), pa.int64(), pa.int64(), *[pa.list_(pa.int32())] * 3)
    names = [f.split(" ")[0] for f in SCHEMA.split(", ")]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="lz4")
        for part in (b.slice(lo, ROWS) for b in batches for lo in range(0, b.num_rows, ROWS)):
            x, n = encoder(part.column(1).to_pylist()), part.num_rows
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
            batch = pa.RecordBatch.from_arrays([pa.array(np.full(n, CHUNK), kinds[0]), part.column(0), *(pa.nulls(n, k) for k in kinds[2:]), lists], names=names)
            with pa.ipc.new_stream(sink := pa.BufferOutputStream(), batch.schema, options=options) as out:
                out.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["rows"])
        _slot.cache_clear()  # the worker is used again

    return cut(rows.select(F.col("doc_id").cast("long").alias("doc_id"), words(F.coalesce(text, F.lit(""))).alias("words")).mapInArrow(pack, "rows binary"))


def _by_score(score: np.ndarray, at: np.ndarray) -> np.ndarray:
    """at by falling scores rounded to six digits, ties by place; at is changed nowhere."""
    v = np.rint(score * 1e6)
    bits = int(at.max(initial=0)).bit_length()
    if v.max(initial=0) >= 2 ** (62 - bits):
        return at[np.lexsort((at, -v))]
    v = v.astype(np.int64)
    return np.sort((v.max(initial=0) - v) << bits | at) & ((1 << bits) - 1)


def _points(total: np.ndarray) -> np.ndarray:
    """Sums of reciprocal ranks in units of the ninth digit; of at most 16 lists they have less than 29 bits."""
    # What is added beside the half keeps decimal halves, which are rounded up, above it.
    return np.floor(total * 1e9 + (0.5 + 1e-8)).astype(np.int64)


def fused_order(lists: list[np.ndarray], n: int) -> np.ndarray:
    """Of the places below n those that stand in ranked lists, by their sums of 1 / (60 + rank) rounded to nine digits; ties in the order
    in which they are first seen: list, then rank."""
    total, first = np.zeros(n), np.full(n, -1, np.int64)
    for i, at in enumerate(lists):
        r = np.arange(1, len(at) + 1)
        total[at] += 1 / (RRF + r)
        first[at] = np.where(first[at] < 0, i << 30 | r, first[at])
    seen = np.flatnonzero(first >= 0)
    key = np.sort((1 << 28) - _points(total[seen]) << 34 | first[seen])
    of, r = key >> 30 & 15, (key & (1 << 30) - 1) - 1
    out = np.empty(len(key), np.int64)
    for i, at in enumerate(lists):
        mine = of == i
        out[mine] = at[r[mine]]
    return out


class Task:
    """The rows of all signals, as far as some queries need them; places of documents are those of their sorted ids.

    queries: their ids, and for each its place in the keyword block or -1; names, tags: the numbers of each query.
    """

    def __init__(self, ids: np.ndarray, places: np.ndarray, keyword: tuple, names: list[list[int]] | None = None, vectors: np.ndarray | None = None, least: float = 0.0, tags: list[int] = ()):
        self.ids, (_, at, query, weight, self.mean) = ids, keyword
        self.local = {int(p): i for i, p in enumerate(places) if p >= 0}
        term = np.repeat(np.arange(len(at) - 1), np.diff(at))
        order = np.argsort(query, kind="stable")
        lo, hi = np.searchsorted(query[order], [places, places + 1])
        self.used = np.unique(term)
        self.terms = [list(zip(np.searchsorted(self.used, term[order[a:b]]).tolist(), weight[order[a:b]].tolist(), strict=True)) if p >= 0 else [] for p, a, b in zip(places.tolist(), lo, hi, strict=True)]
        self.number = np.full(len(at), -1)
        self.number[self.used] = np.arange(len(self.used))
        self.names, self.vectors, self.least = names or [[] for _ in ids], vectors, least
        self.wanted = {NAME: np.unique(np.array([x for ns in self.names for x in ns], np.int64)), TAG: np.unique(np.array(tags, np.int64))}
        self.docs: dict[int, list[np.ndarray]] = {NOTE: [], NEAR: [], NAME: [], CHUNK: [], TAG: []}
        self.postings, self.phrases, self.near, self.found, self.labels = [], [], [], [], {NAME: [], TAG: []}
        self.read = 0

    def add(self, batch: pa.RecordBatch) -> None:
        kinds = batch.column(0).to_numpy()
        for kind in np.unique(kinds).tolist():
            part = batch if (kinds == kind).all() else batch.filter(pa.array(kinds == kind))
            doc = part.column(1).to_numpy()
            (self._note, self._near, self._label, self._chunk, self._label)[kind](part, doc, kind)

    def _note(self, part, doc, kind) -> None:
        owner = np.repeat(np.arange(len(doc), dtype=np.int32), pc.list_value_length(part.column(3)).to_numpy())
        term, tf = (part.column(i).flatten().to_numpy() for i in (3, 4))
        number = self.number[term]
        use = np.flatnonzero(number >= 0)
        use = use[np.argsort(number[use], kind="stable")]
        dl = np.maximum(part.column(2).to_numpy(), 1)
        owner, tf = owner[use], tf[use]
        self.postings.append((owner + np.int32(self.read), tf / (tf + K1 * (1 - B + B * dl[owner] / self.mean)), np.searchsorted(number[use], np.arange(len(self.used) + 1))))
        asked = np.repeat(np.arange(len(doc)), pc.list_value_length(part.column(5)).to_numpy())
        self.phrases += [(i, int(a) + self.read) for p, a in zip(part.column(5).flatten().to_pylist(), asked, strict=True) if (i := self.local.get(p)) is not None]
        self.docs[NOTE].append(doc)
        self.read += len(doc)

    def _near(self, part, doc, kind) -> None:
        q, x = part.column(2).to_numpy(), part.column(6).flatten().to_numpy()
        use = np.isin(q, self.ids)
        self.docs[NEAR].append(doc[use])
        self.near.append((q[use], x[use]))

    def _label(self, part, doc, kind) -> None:
        number = part.column(3).flatten().to_numpy()
        use = np.isin(number, self.wanted[kind])
        self.docs[kind].append(np.repeat(doc, pc.list_value_length(part.column(3)).to_numpy())[use])
        self.labels[kind].append(number[use])

    def _chunk(self, part, doc, kind) -> None:
        if self.vectors is None:
            return
        s = _units(part.column(6).flatten().to_numpy().reshape(len(doc), -1)) @ self.vectors.T
        # Of a document's chunks that follow one another the best is kept.
        start = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        size, best = np.diff(np.r_[start, len(doc)]), s[start]
        for j in range(1, size.max()):
            more = np.flatnonzero(size > j)
            best[more] = np.maximum(best[more], s[start[more] + j])
        best = np.ascontiguousarray(best.T)
        row, col = np.nonzero(best >= self.least - 1e-6)
        v = np.round(best[row, col], 6)
        near = v >= self.least
        row, col, v = row[near], col[near], v[near]
        at = sum(map(len, self.docs[CHUNK]))
        self.docs[CHUNK].append(doc[start])
        self.found.append(((col + at).astype(np.int32), v.astype(np.float32), np.searchsorted(row, np.arange(len(self.ids) + 1))))

    def close(self) -> None:
        """After the last row: the documents have their places."""
        docs = {k: np.concatenate([np.empty(0, np.int64), *v]) for k, v in self.docs.items()}
        self.universe = np.unique(np.concatenate([docs[k] for k in (NOTE, NEAR, NAME, CHUNK)]))
        self.place = {k: np.searchsorted(self.universe, docs[k]) for k in (NOTE, NEAR, NAME, CHUNK)}
        self.bonus: dict[int, list[int]] = {}
        for i, row in self.phrases:
            self.bonus.setdefault(i, []).append(row)
        self.near_query, self.near_score = (np.concatenate([np.empty(0, kind), *(x[i] for x in self.near)]) for i, kind in ((0, np.int64), (1, float)))
        self.name = np.concatenate([np.empty(0, np.int64), *self.labels[NAME]])
        # Chunks of a document that did not follow one another have entries of their own.
        self.again = np.ones(len(self.place[CHUNK]), bool)
        self.again[np.unique(self.place[CHUNK], return_index=True)[1]] = False
        tag, self.tagged = np.concatenate([np.empty(0, np.int64), *self.labels[TAG]]), {}
        at = np.searchsorted(self.universe, docs[TAG])
        known = (at < len(self.universe)) & (self.universe[np.minimum(at, max(0, len(self.universe) - 1))] == docs[TAG]) if len(self.universe) else np.zeros(len(at), bool)
        for t in self.wanted[TAG].tolist():
            self.tagged[t] = np.unique(at[known & (tag == t)])

    def keyword(self, i: int) -> np.ndarray:
        s = np.zeros(self.read)
        for t, w in self.terms[i]:
            for row, x, at in self.postings:
                lo, hi = at[t], at[t + 1]
                s[row[lo:hi]] += w * x[lo:hi]
        s[self.bonus.get(i, [])] *= BONUS
        row = np.flatnonzero(s)
        return _by_score(s[row], self.place[NOTE][row])

    def dense(self, i: int) -> np.ndarray:
        mine = np.flatnonzero(self.near_query == self.ids[i])
        return _by_score(self.near_score[mine], self.place[NEAR][mine])

    def entity(self, i: int) -> np.ndarray:
        return np.unique(self.place[NAME][np.isin(self.name, self.names[i])]) if self.names[i] else np.empty(0, np.int64)

    def chunk(self, i: int) -> np.ndarray:
        row, s = (np.concatenate([np.empty(0, np.int64), *(x[j][x[2][i] : x[2][i + 1]] for x in self.found)]) for j in (0, 1))
        row, v = row.astype(np.int64), np.round(s.astype(float), 6)
        best, later = np.zeros(len(self.universe)), self.again[row]
        best[self.place[CHUNK][row[~later]]] = v[~later]
        np.maximum.at(best, self.place[CHUNK][row[later]], v[later])
        at = np.flatnonzero(best)
        return _by_score(best[at], at)


def ranked_in_tasks(blocks: list[Keyword], queries: list[int], more: DataFrame | None, run: Callable[[Task, list], Iterator[pa.RecordBatch]], schema: str, spark: SparkSession, each: dict[int, dict] | None = None, least: float = 0.0, documents: int = 1, lists: int = 1, stored: DataFrame | None = None) -> DataFrame:
    """run's rows for all queries: a task has read all rows of `more` and of its keyword block. each: of a query, what run gets of it
    (names: numbers; vector; tag: a number). lists: how many kinds of rows may have all documents for a query. stored:
    further rows, packed."""
    each = each or {}
    # No rows, but two partitions: a union of frames that all have a single one would be a single task.
    result = spark.range(0, 2, 1, 2).mapInArrow(lambda batches: iter(()), schema)
    place = {int(q): (k, i) for k, block in enumerate(blocks) for i, q in enumerate(block.ids)}
    by: dict[int, list[int]] = {}
    for q in queries:
        by.setdefault(place[q][0] if q in place else 0, []).append(q)
    for k, asked in sorted(by.items()):
        block = blocks[k] if blocks else None
        rows = signal_rows(NOTE, block.notes, n="dl", a="terms", b="tfs", c="phrases") if block else None
        if more is not None:
            rows = more if rows is None else rows.unionByName(more)
        rows = packed(rows) if stored is None else packed(rows).unionByName(stored)
        n = block.n if block else documents
        size = max(1, min(HELD // max(1, n * lists), max(LEAST, -(-len(asked) // (4 * spark.sparkContext.defaultParallelism)))))
        for lo in range(0, len(asked), size):
            part = asked[lo : lo + size]
            places = np.array([place[q][1] if q in place else -1 for q in part], np.int64)
            model = block.only(places).model if block else (None, np.zeros(1, np.int64), np.empty(0, np.int64), np.empty(0), 1.0)
            vectors = [each.get(q, {}).get("vector") for q in part]
            some = next((len(v) for v in vectors if v is not None), 0)
            # A query without a vector has one that no chunk is similar to.
            matrix = _units(np.array([v if v is not None else np.full(some, np.nan) for v in vectors], float)) if some else None
            sent = spark.sparkContext.broadcast((np.array(part, np.int64), places, (None, *model[1:]), [each.get(q, {}).get("names", []) for q in part], matrix, least, [each[q]["tag"] for q in part if "tag" in each.get(q, {})], [each.get(q, {}) for q in part]))

            def task(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                *given, own = sent.value
                held = Task(*given)
                waiting, n = [], 0
                for blob in (x for batch in batches for x in batch.column(0)):
                    for batch in pa.ipc.open_stream(blob.as_buffer()):
                        if waiting and batch.schema != waiting[0].schema:
                            held.add(pa.concat_batches(waiting))
                            waiting, n = [], 0
                        waiting.append(batch)
                        n += batch.num_rows
                        if n >= ADDED:
                            held.add(pa.concat_batches(waiting))
                            waiting, n = [], 0
                if waiting:
                    held.add(pa.concat_batches(waiting))
                held.close()
                yield from run(held, own)

            result = result.unionByName(rows.coalesce(1).mapInArrow(task, schema))
    return result


def fused_lists(blocks: list[Keyword], near: DataFrame, after: int = 0, until: int | None = None) -> DataFrame:
    """(query_id, doc_id, rank): the ranks after `after` and until `until` of `fuse` of near (query_id, doc_id, score; stored) and the keyword lists."""

    def run(held: Task, own: list) -> Iterator[pa.RecordBatch]:
        for i, q in enumerate(held.ids.tolist()):
            doc = held.universe[fused_order([held.dense(i), held.keyword(i)], len(held.universe))[after:until]]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), q)), pa.array(doc), pa.array(np.arange(after + 1, after + len(doc) + 1, dtype=np.int32))], names=["query_id", "doc_id", "rank"])

    queries = sorted({r[0] for r in near.select("query_id").distinct().collect()} | {int(q) for b in blocks for q in b.ids})
    rows = signal_rows(NEAR, near.withColumn("x", F.array("score")), n="query_id", x="x")
    return ranked_in_tasks(blocks, queries, rows, run, "query_id long, doc_id long, rank int", near.sparkSession)


def first_places(lists: list[np.ndarray], n: int, wanted: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, ranks) for the first list alone, then with each further one: of `fused_order` the first k, and the first one of `wanted` if
    none of those is; places of an order are found without sorting it."""
    total, first = np.zeros(n), np.zeros(n, np.int64)
    sought = np.zeros(n, bool)
    sought[wanted] = True
    for i, at in enumerate(lists):
        r = np.arange(1, len(at) + 1)
        total[at] += 1 / (RRF + r)
        first[at] = np.where(first[at] > 0, first[at], i << 30 | r)
        seen = np.flatnonzero(first)
        key = (1 << 28) - _points(total[seen]) << 34 | first[seen]
        head = np.argpartition(key, k - 1)[:k] if len(key) > k else np.arange(len(key))
        head = head[np.argsort(key[head])]
        rank = np.arange(1, len(head) + 1)
        if not sought[seen[head]].any() and sought[seen].any():
            least = key[sought[seen]].min()
            head, rank = np.r_[head, np.flatnonzero(key == least)], np.r_[rank, 1 + np.count_nonzero(key < least)]
        yield seen[head], rank


def ladder(blocks: list[Keyword], near: DataFrame, named: DataFrame, chunks: DataFrame, tagged: DataFrame, each: dict[int, dict], least: float, documents: int, k: int) -> DataFrame:
    """(query_id, rung, doc_id, rank, rel) of the queries of `each`: what `first_places` gives of the vectors' list (near: query_id, doc_id,
    score), then with the keyword lists, the notes of the same names and the best chunks. rel: the note has the query's tag and is not the query.

    named, tagged: (doc_id, numbers); chunks: packed.
    """

    def run(held: Task, own: list) -> Iterator[pa.RecordBatch]:
        for i, q in enumerate(held.ids.tolist()):
            good = held.tagged[own[i]["tag"]]
            good = good[held.universe[good] != q]
            lists = [held.dense(i), held.keyword(i), held.entity(i), held.chunk(i)]
            for rung, (at, rank) in enumerate(first_places(lists, len(held.universe), good, k), 1):
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.bool_())
                cells = np.full(len(at), q), np.full(len(at), rung), held.universe[at], rank, np.isin(at, good)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, kinds, strict=True)], names=["query_id", "rung", "doc_id", "rank", "rel"])

    rows = signal_rows(NEAR, near.withColumn("x", F.array("score")), n="query_id", x="x")
    for part in (signal_rows(NAME, named, a="numbers"), signal_rows(TAG, tagged, a="numbers")):
        rows = rows.unionByName(part)
    return ranked_in_tasks(blocks, sorted(each), rows, run, "query_id long, rung int, doc_id long, rank int, rel boolean", near.sparkSession, each, least, documents, 4, chunks)
