"""Candidate pairs by a range join inside cells, and their exact verification; shared by the operators on similar records.

Records are sets of 64-bit hashes. Records with equal sets form a class; a class has a key (a hash of the
set), and all pair work is done on classes. Membership (key, doc_id) turns classes into records again.

A class is a point of some hundred coordinates, the numbers of set bits in each segment of its fingerprint (the
set as a bitmap of 2^64 bits), kept modulo 2. The Manhattan distance of two such points never exceeds the size of
the sets' symmetric difference, which for a similarity of p/q is at most (q-p)/(q+p) of the sizes' sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.session import cut, keep

#: Classes of a cell that one task compares with each other; larger cells are cut in blocks whose pairs are separate work.
BLOCK = 8192
#: Members of a group whose pairs pairs_within makes in one task.
GROUP = 512
#: Counters of a sketch at most.
SKETCH_BITS = 25
_CHUNK = 1 << 16
#: A counter holds this many steps for each doubling of its number.
STEPS = 8
#: Groups of up to so many classes are compared all at once, larger ones a strip of rows at a time.
SMALL = 48
#: Keys that a task remembers to pass each class on once.
SEEN = 1_000_000


def _member(segments: int) -> np.dtype:
    return np.dtype([("n", np.int32), ("rest", np.int32), ("key", np.int64), ("point", np.uint64, (segments // 64,))])


def class_key(sorted_hashes: np.ndarray) -> int:
    h = xxhash.xxh3_64_intdigest(sorted_hashes.tobytes())
    return h - (1 << 64) if h >= 1 << 63 else h


def points(hashes: np.ndarray, owner: np.ndarray, n: int, segments: int) -> np.ndarray:
    """The popcounts modulo 2 of n records' fingerprints, packed: a row of segments / 8 bytes for each."""
    at = owner * segments + (hashes >> np.uint64(65 - segments.bit_length())).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=n * segments) & 1).astype(np.uint8).reshape(n, segments), axis=1)


def flat_lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy()[offsets[0] : offsets[-1]].view(np.uint64), offsets - offsets[0]


def _coded(counts: np.ndarray) -> np.ndarray:
    return np.minimum(255, np.rint(STEPS * np.log2(1.0 + counts))).astype(np.uint8)


def sketch(lists: DataFrame, slots: int = 1) -> tuple[int, np.ndarray]:
    """(bits, counters): about how often a hash of the lists (one column) occurs, by its first `bits` bits, in a sketch of
    `slots` logarithmic counters for each hash and 2^SKETCH_BITS in all. A hash that occurs has a counter above 0.

    Tasks' sketches are added in two levels, so no task holds more than the square root of their number at once.
    """
    column = lists.columns[0]
    total = lists.agg(F.sum(F.size(column))).first()[0] or 0
    bits = int(np.clip(np.ceil(np.log2(max(1, total * slots))), 12, SKETCH_BITS))
    width = min(_CHUNK, 1 << bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << bits, np.int32)
        for batch in batches:
            slot, n = np.unique(flat_lists(batch.column(0))[0] >> np.uint64(64 - bits), return_counts=True)
            sketch[slot.astype(np.int64)] += n.astype(np.int32)
        parts = sketch.reshape(-1, width)
        used = np.flatnonzero(parts.any(axis=1))
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([_coded(parts[i]).tobytes() for i in used], pa.binary())], names=["chunk", "counts"])

    def add(key, table):  # without hints: Spark would read them
        total = np.zeros(width)
        for c in table.column("counts").to_pylist():
            total += np.exp2(np.frombuffer(c, np.uint8) / STEPS) - 1
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([_coded(total).tobytes()], pa.binary())})

    schema = "chunk int, counts binary"
    levels = int(np.ceil(np.sqrt(lists.rdd.getNumPartitions())))
    parts = lists.mapInArrow(count, schema).withColumn("part", F.spark_partition_id() % levels)
    once_added = parts.groupBy("chunk", "part").applyInArrow(add, schema)
    out = np.zeros(1 << bits, np.uint8)
    for r in once_added.groupBy("chunk").applyInArrow(add, schema).collect():
        out[r["chunk"] * width : (r["chunk"] + 1) * width] = np.frombuffer(r["counts"], np.uint8)
    return bits, out


class Once:
    """Tells which keys a task has not met yet: copies of a record leave a task once. Bounded; forgetting only repeats rows."""

    def __init__(self):
        self.seen: set[int] = set()

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        if len(self.seen) > SEEN:
            self.seen.clear()
        out = np.zeros(len(keys), bool)
        for i, k in enumerate(keys.tolist()):
            if k not in self.seen:
                self.seen.add(k)
                out[i] = True
        return out


def once(sets: DataFrame, wanted: tuple[int, np.ndarray]) -> DataFrame:
    """Rows of sets (key first) whose key may be in the sketch `wanted`, each once a task: no hot group of copies is shuffled."""
    sent = sets.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, there = sent.value
        new = Once()
        for batch in batches:
            keys = batch.column(0).to_numpy()
            batch = batch.filter(pa.array(there[(keys.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)] > 0))
            yield batch.filter(pa.array(new(batch.column(0).to_numpy())))

    return sets.mapInArrow(run, sets.schema)


def _strips(x: np.ndarray, y: np.ndarray, same: bool, least: tuple[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys of the pairs of x with y (of x with itself, each once) within the Manhattan bound. Both are sorted by n."""
    p, q = least
    cols = np.ascontiguousarray(y["point"].T)
    for lo in range(0, len(x), 64):
        rows = x[lo : lo + 64]
        first = lo if same else int(np.searchsorted(y["n"], -(-int(rows["n"][0]) * p // q)))
        end = int(np.searchsorted(y["n"], int(rows["n"][-1]) * q // p, "right"))
        if end <= first:
            continue
        z = y[first:end]
        both = rows["n"][:, None] + z["n"][None, :]
        ok = np.minimum(rows["rest"][:, None], z["rest"][None, :]) * (p + q) >= p * both
        if same:
            ok &= np.arange(first, end)[None, :] > np.arange(lo, lo + len(rows))[:, None]
        apart = np.zeros(both.shape, np.int32)
        for w in range(len(cols)):
            apart += np.bitwise_count(rows["point"][:, w][:, None] ^ cols[w, first:end][None, :])
        i, j = np.nonzero(ok & (apart * (p + q) <= (q - p) * both) & (rows["key"][:, None] != z["key"][None, :]))
        yield rows["key"][i], z["key"][j]


def _joined(cell: np.ndarray, m: np.ndarray, least: tuple[int, int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs within the bound of whole cells; rows are sorted by cell and n."""
    p, q = least
    start = np.r_[0, 1 + np.flatnonzero(cell[1:] != cell[:-1])]
    size = np.diff(np.r_[start, len(cell)])
    out = []
    for g in np.flatnonzero(size > SMALL):
        out += _strips(m[start[g] : start[g] + size[g]], m[start[g] : start[g] + size[g]], True, least)
    left = np.repeat(np.where(size > SMALL, 0, size), size) - (np.arange(len(cell)) - np.repeat(start, size))  # rows from here to the cell's end
    n, rest, point = m["n"], m["rest"], m["point"]
    i = np.flatnonzero(left > 1)
    d = 1
    while len(i):
        j = i + d
        both = n[i] + n[j]
        fit = np.minimum(rest[i], rest[j]) * (p + q) >= p * both
        a, b = i[fit], j[fit]
        apart = np.bitwise_count(point[a] ^ point[b]).sum(axis=1, dtype=np.int32)
        near = apart * (p + q) <= (q - p) * both[fit]
        out.append((m["key"][a[near]], m["key"][b[near]]))
        d += 1
        i = i[left[i] > d]
    return out


_FOUND = "a long, b long, cell long, block int, segments int, members binary"


def _pairs_batch(pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch | None:
    if not pairs:
        return None
    x, y = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
    if not len(x):
        return None
    ab = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0)
    none = pa.nulls(len(ab))
    return pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1]), none.cast(pa.int64()), none.cast(pa.int32()), none.cast(pa.int32()), none.cast(pa.binary())], names=["a", "b", "cell", "block", "segments", "members"])


def _range_join(least: tuple[int, int], most: int):
    """Rows (cell, n, rest, key, point) sorted by cell, n, key -> pairs (a, b) within the bound; of cells of more than `most` classes blocks of members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_cell, blocks = (), None, 0  # of the last cell met: its classes not yet given out and its blocks that were

        def block(rows: np.ndarray) -> pa.RecordBatch:
            nonlocal blocks
            blocks += 1
            return pa.RecordBatch.from_arrays(
                [pa.nulls(1).cast(pa.int64()), pa.nulls(1).cast(pa.int64()), pa.array([held_cell], pa.int64()), pa.array([blocks - 1], pa.int32()), pa.array([64 * rows["point"].shape[1]], pa.int32()), pa.array([rows.tobytes()], pa.binary())], names=["a", "b", "cell", "block", "segments", "members"]
            )

        def close() -> Iterator[pa.RecordBatch]:
            """The rest of the cell that has ended."""
            nonlocal blocks
            for at in range(0, len(held), most) if blocks or len(held) > most else ():
                yield block(held[at : at + most])
            if not blocks and len(held) > 1:
                out = _pairs_batch(_joined(np.full(len(held), held_cell), held, least))
                if out is not None:
                    yield out
            blocks = 0

        for batch in batches:
            if not batch.num_rows:
                continue
            cell = batch.column(0).to_numpy()
            coded = b"".join(batch.column(4).to_pylist())
            m = np.empty(len(cell), _member(8 * len(coded) // len(cell)))
            m["n"], m["rest"], m["key"] = (batch.column(i).to_numpy() for i in (1, 2, 3))
            m["point"] = np.frombuffer(coded, np.uint64).reshape(len(cell), -1)
            if len(held):
                cell, m = np.r_[np.full(len(held), held_cell), cell], np.concatenate([held, m])
            if len(cell) > 1:  # copies stand next to each other
                new = np.r_[True, (cell[1:] != cell[:-1]) | (m["key"][1:] != m["key"][:-1])]
                cell, m = cell[new], m[new]
            if cell[0] != cell[-1]:
                first_end, last = int(np.argmax(cell != cell[0])), int(np.flatnonzero(cell != cell[-1])[-1]) + 1
                lo = 0
                if blocks or first_end > most:  # the end of a large cell
                    held, held_cell = m[:first_end], cell[0]
                    yield from close()
                    lo = first_end
                if last > lo:
                    out = _pairs_batch(_joined(cell[lo:last], m[lo:last], least))
                    if out is not None:
                        yield out
                cell, m, blocks = cell[last:], m[last:], 0
            held, held_cell = m, int(cell[-1])
            while len(held) > 2 * most:
                yield block(held[:most])
                held = held[most:]
        if held_cell is not None:
            yield from close()

    return run


def _block_pairs(least: tuple[int, int]):
    """(members of a block, members of another, same, segments) of large cells -> pairs within the bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bx, by, same, segments in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                x, y = np.frombuffer(bx, _member(segments)), np.frombuffer(by, _member(segments))
                out = _pairs_batch(list(_strips(x, y, same, least)))
                if out is not None:
                    yield out.select(["a", "b"])

    return run


def candidates(rows: DataFrame, least: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """(a, b) distinct, a < b: classes that share a cell and are within the bound for a similarity of p/q; and the cached table to drop after use.

    rows: (cell, n, rest, key, point); rest is what a class has from this cell's bit on in the common order of bits.
    If it is the first bit that two classes share, they have at most the smaller rest in common.
    """
    found = keep(rows.repartition("cell").sortWithinPartitions("cell", "n", "key").mapInArrow(_range_join(least, BLOCK), _FOUND))
    hot = found.where(F.col("block").isNotNull()).select("cell", "block", "segments", "members")
    of = hot.groupBy("cell").agg((F.max("block") + 1).alias("blocks"))
    x = hot.join(of, "cell").select("cell", F.col("block").alias("lo"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("hi"), F.col("members").alias("mx"))
    y = hot.select("cell", "segments", F.explode(F.sequence(F.lit(0), F.col("block"))).alias("lo"), F.col("block").alias("hi"), F.col("members").alias("my"))
    crossed = x.join(y, ["cell", "lo", "hi"]).select("mx", "my", (F.col("lo") == F.col("hi")).alias("same"), "segments").mapInArrow(_block_pairs(least), "a long, b long")
    return found.where(F.col("block").isNull()).select("a", "b").unionByName(crossed).distinct(), found


def _exact(least: tuple[int, int]):
    p, q = least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            keep_, sim = [], []
            offsets = [(c.offsets.to_numpy(), c.values.to_numpy()) for c in (batch.column(2), batch.column(3))]
            (oa, fa), (ob, fb) = offsets
            for i in range(len(a)):
                x, y = fa[oa[i] : oa[i + 1]], fb[ob[i] : ob[i + 1]]
                both = len(np.intersect1d(x, y, assume_unique=True))
                union = len(x) + len(y) - both
                if union and both * q >= p * union:
                    keep_.append(i), sim.append(both / union)
            if keep_:
                at = np.array(keep_)
                yield pa.RecordBatch.from_arrays([pa.array(a[at]), pa.array(b[at]), pa.array(sim)], names=["a", "b", "similarity"])

    return run


def similar_classes(sets: DataFrame, rows: DataFrame, least: tuple[int, int]) -> DataFrame:
    """(a, b, similarity) of classes with a Jaccard similarity of at least p/q among the candidates of `rows`.

    sets: (key, hashes, …) of every record. What passes the range join is verified on the sets themselves;
    the result is written to the shared checkpoint folder.
    """
    near, cached = candidates(rows, least)
    near = keep(near)
    wanted = sketch(near.select(F.array("a", "b")), 8)
    full = once(sets.select("key", "hashes"), wanted).dropDuplicates(["key"])
    ha = full.select(F.col("key").alias("a"), F.col("hashes").alias("ha"))
    hb = full.select(F.col("key").alias("b"), F.col("hashes").alias("hb"))
    links = cut(near.join(ha, "a").join(hb, "b").select("a", "b", "ha", "hb").mapInArrow(_exact(least), "a long, b long, similarity double"))
    near.unpersist(), cached.unpersist()
    return links


def pairs_within(members: DataFrame, group: str = "g", item: str = "doc_id") -> DataFrame:
    """(a, b) with a < b of every two items of a group; large groups are cut in blocks whose pairs are made apart."""
    m = members.select(F.col(group).alias("g"), F.col(item).alias("i")).distinct()
    sizes = m.groupBy("g").count().where(F.col("count") > 1).select("g", F.ceil(F.col("count") / GROUP).cast("int").alias("nb"))
    blocked = m.join(sizes, "g").select("g", "i", "nb", F.pmod(F.xxhash64("i"), F.col("nb")).cast("int").alias("b"))
    spread = blocked.select("g", "i", "b", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("j")).select("g", "i", "b", F.least("b", "j").alias("lo"), F.greatest("b", "j").alias("hi"))
    x = spread.select("g", "lo", "hi", F.col("i").alias("a"), F.col("b").alias("ba"))
    y = spread.select("g", "lo", "hi", F.col("i").alias("b"), F.col("b").alias("bb"))
    apart = (F.col("lo") == F.col("hi")) | (F.col("ba") != F.col("bb"))
    return x.join(y, ["g", "lo", "hi"]).where((F.col("a") < F.col("b")) & apart).select("a", "b")
