"""Problem 4: near-duplicate records, by a segment-popcount embedding and a grid range-join.

The fingerprint of a record is the bitmap of its hashed word shingles; its bit counts by segment are a point
(see _pairs). A grid over all coordinates has far too many cells next to each other for text, so the grid is anchored:
two records of a similarity of p/q must share one of the first n - ceil(p n / q) + 1 set bits of each in any
common order of bits. Each of these bits is a cell; the order is by how rare a bit is in the whole corpus, so cells
stay small. Inside a cell records are sorted by size and range-joined under the Manhattan distance of their points,
a lower bound, and what is within it is verified exactly. No pair above the threshold is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm._pairs import Once, class_key, flat_lists, pairs_within, points, similar_classes, sketch
from quillmesh.llm._text import by_chars, distinct, owners, shingles, word_hashes
from quillmesh.operators.graph import components
from quillmesh.session import cut

#: Copies of one text are expanded into all pairs up to this number; more are paired with their representative.
COPIES = 256
#: Records whose cells are made at once.
ROWS = 1000
#: Coordinates of the points of texts; runs of words are rare, so that few of them serve.
SEGMENTS = 64


def fingerprints(docs: DataFrame, text: str, k: int, least_words: int, least_size: int = 1, min_chars: int = 1, segments: int = SEGMENTS) -> DataFrame:
    """(doc_id, key, n, point, hashes) of every record with enough words: the sorted hashes of its k-word shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_chars(batch):
                flat, counts = word_hashes(part.column(1).to_pylist(), min_chars)
                flat, owner = (flat, owners(counts)) if k == 1 else shingles(flat, owners(counts), k)
                values, of = distinct(flat, owner)
                size = np.bincount(of, minlength=len(counts))
                end = np.cumsum(size)
                rows = np.flatnonzero((counts >= least_words) & (size >= least_size))
                if not len(rows):
                    continue
                sets = [values[end[i] - size[i] : end[i]] for i in rows]
                signed = np.concatenate(sets).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size[rows])].astype(np.int32)), pa.array(signed))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows)), pa.array([class_key(s) for s in sets], pa.int64()), pa.array(size[rows].astype(np.int32)), pa.array([p.tobytes() for p in points(values, of, len(counts), segments)[rows]], pa.binary()), lists],
                    names=["doc_id", "key", "n", "point", "hashes"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("t")).where(F.col("t").isNotNull() & F.col("doc_id").isNotNull())
    return rows.mapInArrow(run, "doc_id long, key long, n int, point binary, hashes array<long>")


def cells(sets: DataFrame, least: tuple[int, int]) -> DataFrame:
    """(cell, n, rest, key, point): the rarest set bits of each class, as many as a similar one cannot all lack.

    rest is the number of bits that a class has from the cell's bit on. Copies leave a task once.
    """
    p, q = least
    sent = sets.sparkSession.sparkContext.broadcast(sketch(sets.select("hashes")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, counts = sent.value
        new = Once()
        for batch in (b.slice(lo, ROWS) for b in batches for lo in range(0, b.num_rows, ROWS)):
            batch = batch.filter(pa.array(new(batch.column(0).to_numpy())))
            flat, at = flat_lists(batch.column(3))
            n = batch.column(1).to_numpy()
            owner = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((flat, counts[(flat >> np.uint64(64 - bits)).astype(np.int64)], owner))
            place = np.arange(len(flat)) - np.repeat(at[:-1], n)
            first = place < np.repeat(n + 1 - -(-n * p // q), n)
            of = owner[order[first]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(flat[order[first]].view(np.int64)), pa.array(n[of]), pa.array((n[of] - place[first]).astype(np.int32)), batch.column(0).take(pa.array(of)), batch.column(2).take(pa.array(of))],
                names=["cell", "n", "rest", "key", "point"],
            )

    return sets.select("key", "n", "point", "hashes").mapInArrow(run, "cell long, n int, rest int, key long, point binary")


def similar_records(docs: DataFrame, text: str, k: int, least: tuple[int, int], least_words: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b, similarity) between classes of equal shingle sets, and the membership (key, doc_id) of every record."""
    sets = cut(fingerprints(docs, text, k, least_words))
    return similar_classes(sets, cells(sets, least), least), sets.select("key", "doc_id")


def similar_pairs(docs: DataFrame, text: str = "body", k: int = 3, least: tuple[int, int] = (3, 5), least_words: int = 40) -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: records of at least `least_words` words whose sets of k-word runs are similar.

    Null texts and shorter ones have no pairs. Records with equal sets are copies: up to COPIES of them are
    expanded into all pairs; of more, every copy is paired with the least id only, and links to other texts
    go from the least id.
    """
    links, members = similar_records(docs, text, k, least, least_words)
    sizes = members.groupBy("key").agg(F.count("*").alias("c"), F.min("doc_id").alias("rep"))
    few = members.join(sizes.where(F.col("c") <= COPIES).select("key"), "key", "left_semi")
    many = sizes.where(F.col("c") > COPIES)
    shown = few.unionByName(many.select("key", F.col("rep").alias("doc_id")))
    across = (
        links.join(shown.select(F.col("key").alias("a"), F.col("doc_id").alias("x")), "a")
        .join(shown.select(F.col("key").alias("b"), F.col("doc_id").alias("y")), "b")
        .select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))
    )
    inside = pairs_within(few, "key").select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))
    star = members.join(many, "key").where(F.col("doc_id") > F.col("rep")).select(F.col("rep").alias("doc_id_a"), F.col("doc_id").alias("doc_id_b"))
    return across.unionByName(inside).unionByName(star).where(F.col("doc_id_a") < F.col("doc_id_b")).distinct()


def near_duplicate_groups(docs: DataFrame, text: str = "body", k: int = 5, least: tuple[int, int] = (4, 5), least_words: int = 5) -> DataFrame:
    """(doc_id, group_id, copies): one row for every record that has enough words; group_id is the least doc_id of
    the records linked to it directly or through others, copies the number of records with the same shingle set."""
    links, members = similar_records(docs, text, k, least, least_words)
    roots = components(links).withColumnRenamed("node", "key")
    sized = members.join(members.groupBy("key").agg(F.count("*").alias("copies")), "key")
    placed = sized.join(roots, "key", "left").select("doc_id", F.coalesce("root", "key").alias("root"), "copies")
    return placed.join(placed.groupBy("root").agg(F.min("doc_id").alias("group_id")), "root").select("doc_id", "group_id", "copies")


def class_members(docs: DataFrame, text: str = "body", k: int = 3, least: tuple[int, int] = (3, 5), least_words: int = 40) -> DataFrame:
    """(doc_id, class_id, copies, links): one row for every document, with the parameters of similar_pairs.

    class_id is the least doc_id with the same shingle set, copies their number, links the number of other classes that are
    similar; with the pairs of class representatives this gives all pairs back. Documents with too few words, also null and empty
    ones, are classes of their own without links.
    """
    links, members = similar_records(docs, text, k, least, least_words)
    sizes = members.groupBy("key").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"))
    ends = links.select(F.col("a").alias("key")).unionByName(links.select(F.col("b").alias("key"))).groupBy("key").agg(F.count("*").alias("links"))
    placed = members.join(sizes.join(ends, "key", "left"), "key").select("doc_id", "class_id", "copies", "links")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where(F.col("doc_id").isNotNull()).distinct()
    alone = ids.join(placed, "doc_id", "left")
    return alone.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("copies", F.lit(1)).cast("long").alias("copies"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
