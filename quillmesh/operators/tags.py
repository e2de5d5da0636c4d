"""Tag algebra on the long form (doc_id, tag, pos); a document's tags are ordered and distinct."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tag_rows(doc_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """(doc_id, tag, pos) distinct: names in place of ids, the first position of a repeated tag."""
    return doc_tags.where(F.col("tag_id").isNotNull()).join(tags, F.col("tag_id") == F.col("id")).groupBy("doc_id", F.col("name").alias("tag")).agg(F.min("pos").alias("pos"))


def tag_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("tag").agg(F.countDistinct("doc_id").alias("n"))


def coverage(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: live notes, tagged and untagged ones, distinct tags of all rows, assignments on live notes, mean and per cent."""
    live = docs.where(F.col("deleted_at").isNull()).select("doc_id")
    per = live.join(rows.groupBy("doc_id").agg(F.countDistinct("tag").alias("k")), "doc_id", "left")
    total, tagged, assigned = F.count("*"), F.count("k"), F.coalesce(F.sum("k"), F.lit(0))
    one = per.agg(total.alias("total"), tagged.alias("tagged"), (total - tagged).alias("untagged"), assigned.alias("assignments"),
                  F.when(total > 0, F.round(assigned / total, 2)).otherwise(0.0).alias("mean_tags"), F.when(total > 0, F.round(100 * tagged / total, 1)).otherwise(0.0).alias("tagged_pct"))
    return one.join(F.broadcast(rows.agg(F.countDistinct("tag").alias("distinct_tags"))))


def add_tag(rows: DataFrame, ids: DataFrame, tag: str) -> DataFrame:
    """Adds the tag at the end of each document that lacks it."""
    have = rows.where(F.col("tag") == tag).select("doc_id")
    last = rows.groupBy("doc_id").agg(F.max("pos").alias("p"))
    new = ids.select("doc_id").distinct().join(have, "doc_id", "left_anti").join(last, "doc_id", "left")
    return rows.select("doc_id", "tag", "pos").unionByName(new.select("doc_id", F.lit(tag).alias("tag"), (F.coalesce("p", F.lit(-1)) + 1).cast("int").alias("pos")))


def remove_tag(rows: DataFrame, tag: str, ids: DataFrame | None = None) -> DataFrame:
    if ids is None:
        return rows.where(F.col("tag") != tag)
    return rows.join(ids.select("doc_id", F.lit(tag).alias("tag")), ["doc_id", "tag"], "left_anti")


def rename_tag(rows: DataFrame, old: str, new: str) -> DataFrame:
    """The new name stands where the old one stood; where a document has both they become one, at the place of the new one."""
    named = rows.select("doc_id", F.when(F.col("tag") == old, new).otherwise(F.col("tag")).alias("tag"), "pos", (F.col("tag") == old).alias("moved"))
    return named.groupBy("doc_id", "tag").agg(F.min_by("pos", F.struct("moved", "pos")).alias("pos"))


def set_tags(rows: DataFrame, doc_id, tags: list[str]) -> DataFrame:
    spark = rows.sparkSession
    names = list(dict.fromkeys(tags))
    new = spark.createDataFrame([(doc_id, t, i) for i, t in enumerate(names)], "doc_id long, tag string, pos int")
    return rows.where(F.col("doc_id") != doc_id).select("doc_id", "tag", "pos").unionByName(new)


def seed_from_labels(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Tags joined by the documents' own labels (trimmed, not blank); doing it again changes nothing."""
    labels = docs.select("doc_id", F.posexplode("labels").alias("p", "l")).select("doc_id", F.trim("l").alias("tag"), "p").where(F.col("tag") != "")
    new = labels.groupBy("doc_id", "tag").agg(F.min("p").alias("p")).join(rows.select("doc_id", "tag"), ["doc_id", "tag"], "left_anti")
    last = rows.groupBy("doc_id").agg(F.max("pos").alias("last"))
    w = Window.partitionBy("doc_id").orderBy("p", "tag")
    placed = new.join(last, "doc_id", "left").select("doc_id", "tag", (F.coalesce("last", F.lit(-1)) + F.row_number().over(w)).cast("int").alias("pos"))
    return rows.select("doc_id", "tag", "pos").unionByName(placed)


def with_tags(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Documents with the array of their tags in order; an empty one without tags."""
    lists = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "tag"))).alias("t")).select("doc_id", F.col("t.tag").alias("tags"))
    return docs.join(lists, "doc_id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def without_excluded(docs: DataFrame, rows: DataFrame, excluded: DataFrame) -> DataFrame:
    """Documents without any excluded tag."""
    hidden = rows.join(excluded.select("tag"), "tag", "left_semi").select("doc_id").distinct()
    return docs.join(hidden, "doc_id", "left_anti")


def having_any(docs: DataFrame, rows: DataFrame, tags: list[str]) -> DataFrame:
    return docs.join(rows.where(F.col("tag").isin(tags)).select("doc_id"), "doc_id", "left_semi")


def having_all(docs: DataFrame, rows: DataFrame, tags: list[str]) -> DataFrame:
    full = rows.where(F.col("tag").isin(tags)).groupBy("doc_id").agg(F.countDistinct("tag").alias("k")).where(F.col("k") == len(set(tags)))
    return docs.join(full.select("doc_id"), "doc_id", "left_semi")


def created_between(docs: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Inclusive days; a missing date is out of scope as soon as a bound is given."""
    day = F.to_date("created_at")
    cond = F.lit(True)
    if start:
        cond = cond & (day >= F.lit(start).cast("date"))
    if end:
        cond = cond & (day <= F.lit(end).cast("date"))
    return docs.where(cond)


def samples(docs: DataFrame, rows: DataFrame, per_tag: int = 5) -> DataFrame:
    """(tag, doc_id, r): the first notes of each tag by id."""
    w = Window.partitionBy("tag").orderBy("doc_id")
    live = docs.where(F.col("deleted_at").isNull()).select("doc_id")
    return rows.join(live, "doc_id", "left_semi").select("tag", "doc_id", F.row_number().over(w).alias("r")).where(F.col("r") <= per_tag)


def colour_slots(rows: DataFrame, slots: int = 8) -> DataFrame:
    """(doc_id, tag, slot): each note takes its best-ranked tag among the most frequent ones (ties by name)."""
    top = tag_counts(rows).orderBy(F.desc("n"), "tag").limit(slots)
    ranked = top.select("tag", F.row_number().over(Window.orderBy(F.desc("n"), "tag")).alias("slot"))
    return rows.join(F.broadcast(ranked), "tag").groupBy("doc_id").agg(F.min(F.struct("slot", "tag")).alias("m")).select("doc_id", "m.tag", "m.slot")


def tag_notes(rows: DataFrame, docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Tags of many notes at once, wanted: (doc_id, tag, seq); notes that docs lack are skipped."""
    from quillmesh.operators.proposals import append_tags

    return append_tags(rows, wanted.join(docs.select("doc_id"), "doc_id", "left_semi"))


def excluded_count(rows: DataFrame, excluded: DataFrame) -> DataFrame:
    return rows.join(excluded.select("tag"), "tag", "left_semi").agg(F.countDistinct("doc_id").alias("n"))


def renamed_exclusions(excluded: DataFrame, old: str, new: str) -> DataFrame:
    """The excluded set follows the renaming of a tag."""
    return excluded.select(F.when(F.col("tag") == old, new).otherwise(F.col("tag")).alias("tag")).distinct()
