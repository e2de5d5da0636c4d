"""Problem 3: how often two items occur in the same record, by an external sort of packed pair codes.

Every task turns its records into 64-bit codes (smaller item in the upper half), sorts and run-length
counts them in runs of bounded size, and hands on (code, count). A range exchange and Spark's external
sorter (spilled sorted runs, multiway merge) bring equal codes together; a streaming pass sums them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.session import cut

#: Codes sorted at once in a task, and items of a record handled in one block.
RUN, BLOCK = 4_000_000, 1024


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bi, bj, items, blocks) -> counted codes. Items of a large record come in pairs of blocks."""
    held: list[np.ndarray] = []
    size = 0

    def flush() -> pa.RecordBatch:
        codes, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n)], names=["code", "n"])

    for batch in batches:
        bi, bj = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        at = batch.column(2).offsets.to_numpy()
        flat = batch.column(2).values
        block, item = flat.field(0).to_numpy(), flat.field(1).to_numpy()
        for r in range(len(bi)):
            x, b = item[at[r] : at[r + 1]], block[at[r] : at[r + 1]]
            if bi[r] == bj[r]:
                x = np.sort(x)
                i, j = np.triu_indices(len(x), 1)
                lo, hi = x[i], x[j]
            else:
                p, q = x[b == bi[r]], x[b == bj[r]]
                lo, hi = np.repeat(p, len(q)), np.tile(q, len(p))
                lo, hi = np.minimum(lo, hi), np.maximum(lo, hi)
            if len(lo):
                held.append((lo << 32) | hi)
                size += len(lo)
            if size >= RUN:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def _sum_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the counts of equal neighbouring codes; the last code of a batch waits for the next one."""
    code0, n0 = None, 0
    for batch in batches:
        code, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(code):
            continue
        start = np.r_[0, 1 + np.flatnonzero(code[1:] != code[:-1])]
        code, n = code[start], np.add.reduceat(n, start)
        if code0 is not None:
            if code[0] == code0:
                n[0] += n0
            else:
                code, n = np.r_[code0, code], np.r_[n0, n]
        code0, n0 = code[-1], n[-1]
        yield pa.RecordBatch.from_arrays([pa.array(code[:-1]), pa.array(n[:-1])], names=["code", "n"])
    if code0 is not None:
        yield pa.RecordBatch.from_arrays([pa.array([code0], pa.int64()), pa.array([n0], pa.int64())], names=["code", "n"])


def _numbered(items: DataFrame) -> DataFrame:
    """(i, c): distinct items numbered from 0 in their order. The sorted table is written to the shared checkpoint folder, so
    that a number is the same whenever it is read; only the parts' sizes go to the driver."""
    i = cut(items.repartitionByRange("i").sortWithinPartitions("i")).withColumn("at", F.monotonically_increasing_id())
    part, row = F.shiftright("at", 33), F.col("at").bitwiseAND(2**33 - 1)
    sizes = sorted((r["p"], r["count"]) for r in i.groupBy(part.alias("p")).count().collect())
    before, offsets = 0, []
    for p, n in sizes:
        offsets.append((p, before))
        before += n
    if before > 2**31:
        raise ValueError("more than 2^31 items")
    table = F.broadcast(items.sparkSession.createDataFrame(offsets, "p long, before long"))
    return i.join(table, part == F.col("p")).select("i", (F.col("before") + row).alias("c"))


def item_pairs(rows: DataFrame, record: str = "doc_id", item: str = "tag_id", least: int = 1) -> DataFrame:
    """(a, b, n_ab, n_a, n_b, n, lift, odds_ratio) for every pair a < b that at least `least` records have.

    All counts are of distinct records; rows with a null item or record are left out, repeated rows count once.
    lift is n_ab * n / (n_a * n_b); the odds ratio adds 0.5 to each of the four cells (continuity correction).
    Records of more than BLOCK rows are cut in blocks whose pairs are handled apart, so no record is held whole.
    """
    r = rows.select(F.col(record).alias("r"), F.col(item).alias("i")).where(F.col("r").isNotNull() & F.col("i").isNotNull())
    items = r.groupBy("i").agg(F.countDistinct("r").alias("n_i"))
    n = r.select(F.countDistinct("r")).first()[0]
    low, high = items.select(F.min("i"), F.max("i")).first()
    if low is not None and (low < 0 or high >= 2**31):  # ids too large for half a code: number the items
        dense = _numbered(items.select("i"))
    else:
        dense = None
    coded = r.join(dense, "i").select("r", F.col("c")) if dense is not None else r.select("r", F.col("i").alias("c"))
    big = r.groupBy("r").count().where(F.col("count") > BLOCK).select("r", F.ceil(F.col("count") / BLOCK).cast("int").alias("nb"))
    blocks = (
        coded.join(big, "r", "left")
        .select("r", "c", F.coalesce("nb", F.lit(1)).alias("nb"))
        .select("r", "c", "nb", F.pmod(F.xxhash64("c"), F.col("nb")).cast("int").alias("b"))
        .select("r", "c", "b", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("j"))
        .groupBy("r", F.least("b", "j").alias("bi"), F.greatest("b", "j").alias("bj"))
        .agg(F.collect_set(F.struct("b", F.col("c").cast("long").alias("c"))).alias("x"))
        .where(F.size("x") > 1)
        .select("bi", "bj", "x")
    )
    counted = (
        blocks.mapInArrow(_runs, "code long, n long")
        .repartitionByRange("code")
        .sortWithinPartitions("code")
        .mapInArrow(_sum_runs, "code long, n long")
        .where(F.col("n") >= least)
        .select(F.shiftright("code", 32).alias("a"), F.col("code").bitwiseAND(2**32 - 1).alias("b"), F.col("n").alias("n_ab"))
    )
    if dense is not None:
        items = items.join(dense, "i")
    key = "c" if dense is not None else "i"
    left = items.select(F.col(key).alias("a"), F.col("i").alias("item_a"), F.col("n_i").alias("n_a"))
    right = items.select(F.col(key).alias("b"), F.col("i").alias("item_b"), F.col("n_i").alias("n_b"))
    ab, na, nb = (F.col(c).cast("double") for c in ("n_ab", "n_a", "n_b"))
    return (
        counted.join(left, "a")
        .join(right, "b")
        .select(
            F.least("item_a", "item_b").alias(f"{item}_a"),
            F.greatest("item_a", "item_b").alias(f"{item}_b"),
            "n_ab",
            F.when(F.col("item_a") < F.col("item_b"), F.col("n_a")).otherwise(F.col("n_b")).alias("n_a"),
            F.when(F.col("item_a") < F.col("item_b"), F.col("n_b")).otherwise(F.col("n_a")).alias("n_b"),
            F.lit(n).alias("n"),
            (ab * n / (na * nb)).alias("lift"),
            ((ab + 0.5) * (n - na - nb + ab + 0.5) / ((na - ab + 0.5) * (nb - ab + 0.5))).alias("odds_ratio"),
        )
    )
