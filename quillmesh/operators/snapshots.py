"""What changed between full snapshots.

Each snapshot is range-partitioned and sorted by key; within every range one streaming pass walks the
sorted rows with two pointers (the earlier and the later snapshot of the same key stand next to each
other) and emits typed changes. Nothing but a batch and the row before it is held, so a range of any length runs in
constant memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges are cut by key, so a source that holds most rows is spread over many of them.
KEY = ["source_key", "external_id", "ord"]


def import_order(imports: DataFrame) -> DataFrame:
    """Finished imports of each source in order of started_at (ties: id), numbered from 1, each with the import after it."""
    done = imports.where(F.col("finished_at").isNotNull() & F.col("id").isNotNull()).select(
        F.col("id").alias("import_id"), F.col("source_key").alias("src"), "started_at"
    )
    w = Window.partitionBy("src").orderBy(F.col("started_at").asc_nulls_first(), "import_id")
    return done.select("import_id", "src", F.row_number().over(w).alias("ord"), F.lead("import_id").over(w).alias("next_id"))


def snapshot_rows(snapshots: DataFrame, order: DataFrame) -> DataFrame:
    """One row per (import, trimmed external_id): the row with the highest seq; rows without a key are left out.

    A row belongs to its import_id however late it came; its source is that of the import.
    """
    rows = snapshots.select(
        "import_id",
        F.regexp_replace("external_id", r"(?U)^\s+|\s+$", "").alias("external_id"),
        F.struct(F.coalesce(F.col("seq"), F.lit(-(2**63))).alias("seq"), F.lower(F.trim("content_hash")).alias("hash")).alias("v"),
    ).where(F.col("external_id").isNotNull() & F.col("import_id").isNotNull())
    last = rows.groupBy("import_id", "external_id").agg(F.max("v").alias("v"))
    return last.join(order, "import_id").select(
        F.coalesce("src", F.lit("")).alias("source_key"), "external_id", "ord", F.col("v.hash").alias("hash"), "import_id", "next_id"
    )


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by (source_key, external_id, ord). Every row is compared with the one before it, a batch at once;
    the last row of a batch leads the next one."""
    last: pa.RecordBatch | None = None

    def pack(*parts: tuple[pa.Array, pa.Array, np.ndarray, str]) -> pa.RecordBatch | None:
        ids = [imports.filter(pa.array(rows)) for imports, _, rows, _ in parts]
        keys = [k.filter(pa.array(rows)) for _, k, rows, _ in parts]
        kinds = [pa.array([kind] * len(i), pa.string()) for i, (*_, kind) in zip(ids, parts, strict=True)]
        columns = [pa.concat_arrays(c) for c in (ids, keys, kinds)]
        return pa.RecordBatch.from_arrays(columns, names=["import_id", "external_id", "change_type"]) if len(columns[0]) else None

    def true(mask) -> np.ndarray:
        return pc.fill_null(mask, False).to_numpy(zero_copy_only=False)

    for batch in batches:
        if not batch.num_rows:
            continue
        first = last is None
        if not first:
            batch = pa.RecordBatch.from_arrays([pa.concat_arrays([a, b]) for a, b in zip(last.columns, batch.columns, strict=True)], names=batch.schema.names)
        source, key, order, hashes, here, later = batch.columns
        n = batch.num_rows
        place = order.to_numpy(zero_copy_only=False)
        head = pack((here, key, np.r_[place[:1] > 1, np.zeros(n - 1, bool)], "added")) if first else None
        if head is not None:
            yield head
        if n > 1:
            up, down = (lambda c: c.slice(0, n - 1)), (lambda c: c.slice(1))
            same = true(pc.equal(up(source), down(source))) & true(pc.equal(up(key), down(key)))
            gap = same & (place[1:] > place[:-1] + 1)
            follows = same & ~gap
            filled = true(pc.not_equal(hashes, ""))
            changed = follows & filled[1:] & filled[:-1] & true(pc.not_equal(up(hashes), down(hashes)))
            out = pack(
                (up(later), up(key), (~same | gap) & true(up(later).is_valid()), "removed"),
                (down(here), down(key), (~same & (place[1:] > 1)) | gap, "added"),
                (down(here), down(key), changed, "updated"),
            )
            if out is not None:
                yield out
        last = batch.slice(n - 1)
    if last is not None:
        out = pack((last.column(5), last.column(1), true(last.column(5).is_valid()), "removed"))
        if out is not None:
            yield out


def snapshot_changes(snapshots: DataFrame, imports: DataFrame) -> DataFrame:
    """(import_id, external_id, change_type) for every change between consecutive finished imports of a source.

    Defined cases: imports without finished_at are no snapshots; the first import of a source yields nothing;
    external_id is trimmed, a null or (after trimming) repeated one is dropped or resolved to the highest seq;
    a missing or blank content_hash is never a change; hashes are compared without regard to letter case.
    An import that delivered no row at all removes every row of the one before. Empty inputs give no rows.
    """
    rows = snapshot_rows(snapshots, import_order(imports))
    in_ranges = rows.repartitionByRange("source_key", "external_id").sortWithinPartitions(*KEY)
    return in_ranges.mapInArrow(_merge, "import_id long, external_id string, change_type string")
