"""Proposals of tags: cards, staged decisions, what applying them does, and tags carried over by a stored manifest."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.operators.tagging import BORDER, LABELS, MAX_TAGS, MERGE, RESCUE, SECONDARY, bounded, by_label, number_names

#: Names, merges and decisions are a user's vocabulary; more of them than this fail the query instead of filling the driver.
VOCABULARY = 100_000
ACTIONS = "seq int, action string, tag_name string, new_name string, note_ids array<long>, source_tag string, target_tag string, note_id long, tag string"


def append_tags(rows: DataFrame, adds: DataFrame) -> DataFrame:
    """rows (doc_id, tag, pos) with the tags of adds (doc_id, tag, seq) behind those of their documents, in the order of seq; tags that a document has stay."""
    new = adds.groupBy("doc_id", "tag").agg(F.min("seq").alias("seq")).join(rows.select("doc_id", "tag"), ["doc_id", "tag"], "left_anti")
    last = rows.groupBy("doc_id").agg(F.max("pos").alias("last"))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("seq", "tag"))
    placed = new.withColumn("n", n).join(last, "doc_id", "left").select("doc_id", "tag", (F.coalesce("last", F.lit(-1)) + F.col("n")).cast("int").alias("pos"))
    return rows.select("doc_id", "tag", "pos").unionByName(placed)


def rename_all(rows: DataFrame, merges: DataFrame) -> DataFrame:
    """Tags renamed by merges (seq, source_tag, target_tag) one after the other; a source that no document has by then is skipped.

    Where a document has the target already, its place stays; else the first source's place is taken. The merges and the
    names they meet are a vocabulary; their effect on all names is found first and applied in one join.
    """
    pairs = sorted(bounded(merges.where((F.coalesce("source_tag", F.lit("")) != "") & (F.coalesce("target_tag", F.lit("")) != "")).select("seq", "source_tag", "target_tag"), VOCABULARY))
    met = rows.join(F.broadcast(rows.sparkSession.createDataFrame([(x,) for p in pairs for x in p[1:]], "tag string").distinct()), "tag", "left_semi")
    there = {r["tag"] for r in bounded(met.select("tag").distinct(), VOCABULARY)}
    final, moved = {t: t for t in there}, {t: 0 for t in there}
    for n, (_, source, target) in enumerate(pairs, 1):
        if source == target or source not in final.values():
            continue
        for name, now in final.items():
            if now == source:
                final[name], moved[name] = target, n
    table = rows.sparkSession.createDataFrame([(k, v, moved[k]) for k, v in final.items()], "tag string, final string, moved int")
    named = rows.join(F.broadcast(table), "tag", "left").select("doc_id", F.coalesce("final", "tag").alias("tag"), "pos", F.coalesce("moved", F.lit(0)).alias("moved"))
    return named.groupBy("doc_id", "tag").agg(F.min_by("pos", F.struct("moved", "pos")).alias("pos"))


def apply_actions(rows: DataFrame, docs: DataFrame, actions: DataFrame) -> DataFrame:
    """The tags (doc_id, tag, pos) after a user's actions (ACTIONS), whatever their number of notes.

    First approve, rename and merge cards tag their notes (rename with the new name, else the card's), then merge_tags
    renames a tag, then assign_tag tags one note. Cards without a name or notes, other actions and unknown notes are skipped.
    """
    known = docs.select("doc_id")
    name = F.when(F.col("action") == "rename", F.coalesce(F.nullif("new_name", F.lit("")), "tag_name")).otherwise(F.col("tag_name"))
    cards = actions.where(F.col("action").isin("approve", "rename", "merge")).select(F.explode("note_ids").alias("doc_id"), name.alias("tag"), "seq").where(F.coalesce("tag", F.lit("")) != "")
    assigned = actions.where((F.col("action") == "assign_tag") & (F.coalesce("tag", F.lit("")) != "")).select(F.col("note_id").alias("doc_id"), "tag", "seq")
    tagged = append_tags(rows, cards.join(known, "doc_id", "left_semi"))
    merged = rename_all(tagged, actions.where(F.col("action") == "merge_tags"))
    return append_tags(merged, assigned.join(known, "doc_id", "left_semi"))


def decided(proposals: DataFrame, said: DataFrame) -> DataFrame:
    """Fresh proposals (position, proposal_id, tag_name, …) with their `action`: what was said (proposal_id, tag_name, action) of the same
    id, else of the same name, else pending. Rows without an id get restored-<position>."""
    by_id = said.where(F.col("proposal_id").isNotNull()).groupBy("proposal_id").agg(F.min("action").alias("a"))
    by_name = said.groupBy("tag_name").agg(F.min_by("action", F.coalesce("proposal_id", F.lit(""))).alias("b"))
    p = proposals.join(by_id, "proposal_id", "left").join(by_name, "tag_name", "left")
    ids = F.coalesce("proposal_id", F.concat(F.lit("restored-"), F.col("position").cast("string")))
    return p.withColumns({"action": F.coalesce("a", "b", F.lit("pending")), "proposal_id": ids}).drop("a", "b")


def approve_all(proposals: DataFrame) -> DataFrame:
    """Pending cards that are no mere information become approved."""
    open_ = (F.col("action") == "pending") & (F.coalesce("type", F.lit("")) != "info")
    return proposals.withColumn("action", F.when(open_, "approve").otherwise(F.col("action")))


def decision_counts(proposals: DataFrame) -> DataFrame:
    kinds = ("pending", "approve", "rename", "merge", "reject")
    return proposals.agg(*(F.count_if(F.col("action") == k).alias(k) for k in kinds), F.count("*").alias("total"))


def find_cards(cards: DataFrame, asked: DataFrame) -> DataFrame:
    """(asked, position): the card that a text means: by id, else the first of that name, else the card at that place."""
    at_id = cards.select(F.col("proposal_id").alias("asked"), "position", F.lit(0).alias("rank"))
    at_name = cards.groupBy(F.col("tag_name").alias("asked")).agg(F.min("position").alias("position")).withColumn("rank", F.lit(1))
    at_place = cards.select(F.col("position").cast("string").alias("asked"), "position", F.lit(2).alias("rank"))
    found = at_id.unionByName(at_name).unionByName(at_place).join(asked.select("asked").distinct(), "asked", "left_semi")
    return found.groupBy("asked").agg(F.min(F.struct("rank", "position")).alias("m")).select("asked", F.col("m.position").alias("position"))


def merge_targets(cards: DataFrame) -> DataFrame:
    """(proposal_id, target): for each card of a tag all others that it may be merged into; a vocabulary of cards, whose pairs are its square."""
    classic = F.broadcast(cards.sparkSession.createDataFrame(bounded(cards.where(F.col("type") == "proposal").select("proposal_id"), LABELS), "proposal_id string"))
    return classic.join(classic.withColumnRenamed("proposal_id", "target")).where(F.col("proposal_id") != F.col("target"))


def merge_infos(merges: DataFrame) -> DataFrame:
    """(source_tag, target_tag, message) of merges (seq, source_tag, target_tag) that were applied, each once, no tag into itself."""
    some = merges.where((F.coalesce("source_tag", F.lit("")) != "") & (F.coalesce("target_tag", F.lit("")) != "") & (F.col("source_tag") != F.col("target_tag")))
    return some.select("source_tag", "target_tag", F.format_string("Auto-merged '%s' into '%s'", "source_tag", "target_tag").alias("message")).distinct()


def merge_cards(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Cards (source_tag, target_tag, note_count, confidence, message) of pairs (a, b, sim): the smaller tag goes into the larger, of equals a into b."""
    x, y = sizes.select(F.col("label").alias("a"), F.col("size").alias("na")), sizes.select(F.col("label").alias("b"), F.col("size").alias("nb"))
    j = pairs.join(x, "a").join(y, "b")
    into_b = F.col("nb") >= F.col("na")
    cards = j.select(F.when(into_b, F.col("a")).otherwise(F.col("b")).cast("string").alias("source_tag"), F.when(into_b, F.col("b")).otherwise(F.col("a")).cast("string").alias("target_tag"), (F.col("na") + F.col("nb")).alias("note_count"), F.round("sim", 2).alias("confidence"))
    return cards.withColumn("message", F.format_string("Merge '%s' into '%s' (%d notes)", "source_tag", "target_tag", "note_count"))


def review_cards(items: DataFrame) -> DataFrame:
    """Cards (note_id, tag, note_title, confidence, message) of items (note_id, tag, confidence, title); those without note or tag are left out."""
    some = items.where(F.col("note_id").isNotNull() & (F.coalesce("tag", F.lit("")) != ""))
    c = F.round(F.coalesce("confidence", F.lit(0.0)), 2)
    shown = F.coalesce(F.nullif("title", F.lit("")), F.col("note_id").cast("string"))
    return some.select("note_id", "tag", F.coalesce("title", F.lit("")).alias("note_title"), c.alias("confidence"), F.format_string("Assign tag '%s' to note '%s' (confidence: %s)", F.col("tag"), shown, F.format_number(c, 2)).alias("message"))


def incremental(vectors: DataFrame, manifest: DataFrame) -> DataFrame:
    """(vec_id, label, sim, r, review): new notes tagged by a stored manifest (label, centroid) without clustering again: the nearest tag from
    0.50 on, others from 0.60 on, three in all; a first tag below 0.70 is reviewed. Notes near no tag have no row."""

    def pick(ids, own, names, s):
        order = np.argsort(-s, axis=1, kind="stable")[:, :MAX_TAGS]
        top = np.take_along_axis(s, order, 1)
        row, r = np.nonzero((top[:, :1] >= RESCUE) & ((np.arange(order.shape[1]) == 0) | (top >= SECONDARY)))
        return ids[row], names[order[row, r]], top[row, r], r + 1, top[row, 0] < BORDER

    return by_label(vectors, manifest, pick, "vec_id long, label int, sim double, r int, review boolean")


def consolidation(pairs: DataFrame) -> DataFrame:
    """(a, b, sim, tier): label pairs that are merged at once (above 0.85) or that a model has to judge (above 0.70)."""
    return pairs.where(F.col("sim") > BORDER).withColumn("tier", F.when(F.col("sim") > MERGE, "auto").otherwise("judge"))


def reuse_names(proposed: DataFrame, vault: DataFrame) -> DataFrame:
    """(name, tag): each proposed name in the spelling of an existing tag that differs by letter case alone (the first in order), else as it is."""
    first = vault.groupBy(F.lower("tag").alias("k")).agg(F.min("tag").alias("known"))
    return proposed.join(first, F.lower("name") == F.col("k"), "left").select("name", F.coalesce("known", "name").alias("tag"))


#: Names that say nothing; a label with one is dropped.
GENERIC = ("misc", "miscellaneous", "various", "general", "other", "notes", "undefined", "unknown", "uncategorized")


def label_names(answers: DataFrame, keywords: DataFrame) -> DataFrame:
    """(label, name): a model's name of a label (label, name); without one its two best keywords (label, term, r) in title case, or Misc
    without any. Labels with a generic name are dropped, and the second label of a name becomes `name 2`."""
    two = keywords.where(F.col("r") <= 2).groupBy("label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda x: F.initcap(x["term"])), " ").alias("fallback"))
    named = answers.where(~F.coalesce(F.lower("name").isin(*GENERIC), F.lit(False))).join(two, "label", "left")
    chosen = named.select("label", F.coalesce(F.nullif("name", F.lit("")), "fallback", F.lit("Misc")).alias("name"))
    return number_names(chosen).select("label", F.col("unique_name").alias("name"))


def merge_groups(pairs: DataFrame) -> DataFrame:
    """(label, root): labels that merge pairs (a, b) connect, named by the least."""
    from quillmesh.operators.graph import components

    return components(pairs).select(F.col("node").alias("label"), "root")
