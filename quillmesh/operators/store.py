"""The store as tables: ordered reads, filters, vectors by hash, the ledger of indexes, and indexes that follow a change set."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.operators.ingest import change_counts, change_set


def multi_get(docs: DataFrame, asked: DataFrame, key: str = "id") -> DataFrame:
    """Rows of docs for the asked keys (key, place), with their place; keys that docs lack give no row. Sort by place to read."""
    return asked.select(key, "place").join(docs, key)


def list_ids(docs: DataFrame, source_key: str | None = None, deleted: bool = False) -> DataFrame:
    rows = docs if source_key is None else docs.where(F.col("source_key") == source_key)
    return (rows if deleted else rows.where(F.col("deleted_at").isNull())).select("id").orderBy("id")


def flag(column: Column, *keys: str) -> Column:
    """A boolean of a JSON text under any of the keys; false without one or for broken JSON."""
    e = F.try_parse_json(column)
    return F.coalesce(*(F.try_variant_get(e, f"$.{k}", "boolean") for k in keys), F.lit(False))


def find(docs: DataFrame, rows: DataFrame, archived: bool | None = None, edited_from: datetime | None = None, edited_to: datetime | None = None,
         any_tags: list[str] | None = None, all_tags: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Live notes by id: archived ones, others or both (None), edited in a span (both ends included), with any of some tags and
    with all of others. A note without a time of editing is outside of any span. limit is the page's size."""
    out = docs.where(F.col("deleted_at").isNull())
    if archived is not None:
        out = out.where(flag(F.col("extra"), "archived", "isArchived") == archived)
    if edited_from is not None:
        out = out.where(F.col("edited_at") >= F.lit(edited_from))
    if edited_to is not None:
        out = out.where(F.col("edited_at") <= F.lit(edited_to))
    if any_tags:
        out = out.join(rows.where(F.col("tag").isin(any_tags)).select("doc_id"), "doc_id", "left_semi")
    if all_tags:
        full = rows.where(F.col("tag").isin(all_tags)).groupBy("doc_id").agg(F.countDistinct("tag").alias("k")).where(F.col("k") == len(set(all_tags)))
        out = out.join(full.select("doc_id"), "doc_id", "left_semi")
    return out if limit is None else out.orderBy("id").limit(limit)


def load_notes(docs: DataFrame, source_key: str) -> DataFrame:
    """The live notes of the source that is served."""
    return docs.where((F.col("source_key") == source_key) & F.col("deleted_at").isNull())


def upsert_vectors(vectors: DataFrame, new: DataFrame, dim: int) -> DataFrame:
    """(content_hash, embedding): stored vectors with new ones in place of those of the same hash. A new vector of another size than
    dim fails the query; of several new ones of a hash the least is taken."""
    checked = new.select("content_hash", F.when(F.size("embedding") == dim, F.col("embedding")).otherwise(F.raise_error(F.lit(f"a vector that has not {dim} dimensions"))).alias("embedding"))
    one = checked.groupBy("content_hash").agg(F.min("embedding").alias("embedding"))
    return drop_vectors(vectors, one).unionByName(one)


def drop_vectors(vectors: DataFrame, hashes: DataFrame) -> DataFrame:
    return vectors.join(hashes.select("content_hash"), "content_hash", "left_anti")


def with_vectors(rows: DataFrame, docs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Result rows with their stored vectors (null without one); drop `embedding` before they are shown."""
    return rows.join(docs.select("doc_id", "content_hash"), "doc_id", "left").join(vectors, "content_hash", "left").drop("content_hash")


def ledger(entries: DataFrame, before: DataFrame) -> DataFrame:
    """(name, schema_version, content_hash, row_count, updated_at): entries in place of earlier ones of the same index."""
    return before.join(entries.select("name"), "name", "left_anti").unionByName(entries)


def apply_index(index: DataFrame, changes: DataFrame, fresh: DataFrame, key: str = "doc_id") -> DataFrame:
    """An index after a change set (key, change_type): what belongs to changed documents goes, fresh rows come; the rest isn't read again."""
    touched = changes.where(F.col("change_type") != "unchanged").select(key)
    return index.join(touched, key, "left_anti").unionByName(fresh)


def to_encode(docs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(content_hash, doc_id) of live documents with text whose hash has no vector, each hash once: all that a build or an apply encodes."""
    live = docs.where(F.col("deleted_at").isNull() & F.col("content_hash").isNotNull() & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    return live.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id")).join(vectors.select("content_hash"), "content_hash", "left_anti")


def ingest(incoming: DataFrame, existing: DataFrame, write=None) -> DataFrame:
    """Counts of an import's changes. Without write it is a dry run; else write(change set) is called before."""
    changes = change_set(incoming, existing)
    if write is not None:
        write(changes)
    return change_counts(changes)


def import_frames(counts: DataFrame, scanned: DataFrame) -> DataFrame:
    """(seq, frame): the phases of an import as JSON lines: scan with the number of rows, diff with the change counts, done."""
    one = scanned.agg(F.count("*").alias("found")).join(F.broadcast(counts))
    frames = F.array(
        F.to_json(F.struct(F.lit("scan").alias("phase"), "found")),
        F.to_json(F.struct(F.lit("diff").alias("phase"), "added", "updated", "removed", "unchanged")),
        F.to_json(F.struct(F.lit("done").alias("phase"), (F.col("added") + F.col("updated")).alias("written"), "removed", "restored")),
    )
    return one.select(F.posexplode(frames).alias("seq", "frame"))


def to_rows(docs: DataFrame) -> DataFrame:
    """Documents as stored rows: lists as JSON texts (an empty list for null), times as ISO texts."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return docs.select("doc_id", "id", "title", "body", F.to_json(F.coalesce("labels", F.array().cast("array<string>"))).alias("labels"), iso("created_at").alias("created_at"), iso("edited_at").alias("edited_at"))


def from_rows(rows: DataFrame) -> DataFrame:
    """Stored rows as documents: JSON that is broken is an empty list, a bad time null."""
    lists = F.coalesce(F.from_json("labels", "array<string>"), F.array().cast("array<string>"))
    return rows.select("doc_id", "id", "title", "body", lists.alias("labels"), F.try_to_timestamp("created_at").alias("created_at"), F.try_to_timestamp("edited_at").alias("edited_at"))


def text_keys(names: DataFrame, text: str = "name") -> DataFrame:
    """(key, text): the cache's key of each distinct text, its SHA-256."""
    return names.select(F.col(text).alias("text")).where(F.col("text").isNotNull()).distinct().select(F.sha2("text", 256).alias("key"), "text")


def corpus_fingerprint(docs: DataFrame) -> DataFrame:
    """(rows, fingerprint) of the live notes' ids and first 200 characters, in any order: the entity index that stored another one is rebuilt."""
    digest = F.md5(F.concat(F.col("id"), F.substring(F.coalesce("text", F.lit("")), 1, 200)))
    half = lambda i: F.sum(F.conv(F.substring(digest, i, 8), 16, 10).cast("decimal(20,0)"))
    live = docs.where(F.col("deleted_at").isNull())
    return live.agg(F.count("*").alias("rows"), F.concat_ws("-", *(half(i).cast("string") for i in (1, 9))).alias("fingerprint"))


def resolve_ids(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(asked, id): the document that an id or an external id names; an id goes before an external id of the same text, of several
    documents with one external id the first by doc_id is meant, unknown ids are left out."""
    own = docs.select(F.col("id").alias("asked"), "id", F.lit(0).alias("rank"), "doc_id")
    other = docs.where(F.coalesce("external_id", F.lit("")) != "").select(F.col("external_id").alias("asked"), "id", F.lit(1).alias("rank"), "doc_id")
    names = own.unionByName(other).join(asked.select("asked").distinct(), "asked", "left_semi")
    return names.groupBy("asked").agg(F.min_by("id", F.struct("rank", "doc_id")).alias("id"))


def inflate(docs: DataFrame, copies: int, drop: int = 5, text: str = "body") -> DataFrame:
    """(doc_id, copy, text): each text as it is (copy 0) and `copies` variants: odd ones lack about `drop` per cent of the words, even
    ones have two neighbours of every twenty words swapped. What happens to a word depends on the ids and its place alone."""
    w = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    rows = docs.where(F.col(text).isNotNull()).select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(copies))).alias("copy"), w.alias("w"))
    seed = lambda i: F.conv(F.substring(F.md5(F.concat_ws(":", "doc_id", "copy", i.cast("string"))), 1, 6), 16, 10).cast("long")
    fewer = F.filter("w", lambda x, i: F.pmod(seed(i), F.lit(100)) >= drop)
    at = lambda i: F.when(F.pmod(i, F.lit(20)) == 0, i + 1).when((F.pmod(i, F.lit(20)) == 1), i - 1).otherwise(i)
    swapped = F.transform("w", lambda x, i: F.coalesce(F.get("w", at(i)), x))
    changed = F.when(F.col("copy") == 0, F.col("w")).when(F.col("copy") % 2 == 1, fewer).otherwise(swapped)
    return rows.select("doc_id", "copy", F.array_join(changed, " ").alias("text"))
