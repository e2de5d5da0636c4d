"""Change sets, upserts and deletes over content-addressed documents; inputs share a schema with id, source_key and content_hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.text import content_hash, stable_id


def to_documents(source_docs: DataFrame, source_key: str) -> DataFrame:
    """Importer rows with the stable id and the content hash of a document."""
    return source_docs.select(
        "*",
        stable_id(F.lit(source_key), F.col("external_id")).alias("id"),
        F.lit(source_key).alias("source_key"),
        content_hash(F.coalesce("title", F.lit("")), F.coalesce("body", F.lit(""))).alias("content_hash"),
        F.lit(None).cast("timestamp").alias("deleted_at"),
    )


def change_set(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """(id, change_type, restored): added, updated, unchanged or removed; `existing` is one source with its deleted rows.

    A deleted row whose hash differs is updated, one with the same hash is added again (restored). Live rows that
    the snapshot lacks are removed; deleted rows that it lacks give no row.
    """
    new = incoming.select("id", F.col("content_hash").alias("new_hash"), F.lit(True).alias("in_new"))
    old = existing.select("id", F.col("content_hash").alias("old_hash"), F.col("deleted_at").isNotNull().alias("gone"), F.lit(True).alias("in_old"))
    same = F.col("new_hash").eqNullSafe(F.col("old_hash"))
    kind = (
        F.when(F.col("in_old").isNull(), "added")
        .when(F.col("in_new").isNull(), F.when(~F.col("gone"), "removed"))
        .when(~same, "updated")
        .when(F.col("gone"), "added")
        .otherwise("unchanged")
    )
    joined = new.join(old, "id", "full_outer").select("id", kind.alias("change_type"), F.coalesce(same & F.col("gone") & F.col("in_new"), F.lit(False)).alias("restored"))
    return joined.where(F.col("change_type").isNotNull())


def change_counts(changes: DataFrame) -> DataFrame:
    kinds = ("added", "updated", "removed", "unchanged")
    return changes.agg(*(F.count_if(F.col("change_type") == k).alias(k) for k in kinds), F.count_if("restored").alias("restored"))


def apply_snapshot(incoming: DataFrame, existing: DataFrame, at) -> DataFrame:
    """The next version of the table: incoming rows are live, live rows that are missing are deleted softly."""
    kept = existing.join(incoming.select("id"), "id", "left_anti")
    return incoming.withColumn("deleted_at", F.lit(None).cast("timestamp")).unionByName(soft_delete(kept, F.lit(True), at), allowMissingColumns=True)


def soft_delete(docs: DataFrame, which, at) -> DataFrame:
    """Only live rows get the time of deletion."""
    return docs.withColumn("deleted_at", F.when(which & F.col("deleted_at").isNull(), F.lit(at)).otherwise(F.col("deleted_at")))


def restore(docs: DataFrame, which) -> DataFrame:
    return docs.withColumn("deleted_at", F.when(which, F.lit(None)).otherwise(F.col("deleted_at")))


def missing_hashes(docs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Distinct hashes of live documents without a vector: what an import has to embed."""
    live = docs.where(F.col("deleted_at").isNull() & F.col("content_hash").isNotNull())
    return live.select("content_hash").distinct().join(vectors.select("content_hash"), "content_hash", "left_anti")


def fingerprint(docs: DataFrame, name: str) -> DataFrame:
    """(name, rows, fingerprint) of the live documents, the same in any order: an index that stored another one is stale.

    The fingerprint adds up 64-bit halves of the hashes' digests, so no list of hashes is gathered.
    """
    digest = F.md5("content_hash")
    half = lambda i: F.sum(F.conv(F.substring(digest, i, 8), 16, 10).cast("decimal(20,0)"))
    live = docs.where(F.col("deleted_at").isNull())
    return live.agg(F.count("*").alias("rows"), F.concat_ws("-", *(half(i).cast("string") for i in (1, 9, 17, 25))).alias("fingerprint")).select(F.lit(name).alias("name"), "rows", "fingerprint")
