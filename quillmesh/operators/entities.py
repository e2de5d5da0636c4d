"""Entities: mentions by a pluggable extractor, aliases merged by blocked fuzzy matching, the documents of each."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.text import JaroTable
from quillmesh.operators.graph import PER_GROUP, components

PREFIX, READ = 3, 5000
#: Jaro-Winkler similarity from which two surfaces are one entity.
SIMILAR = 0.75
#: Surfaces of a part of a block.
PART = 1024
_CAPITAL = re.compile(r"(?<![.!?\n]\s)(?<!^)\b[^\W\d_][\w’'-]{3,}(?:[ ][^\W\d_][\w’'-]{3,})?")


def capitalised(text: str) -> list[tuple[str, str]]:
    """The default extractor: capitalised words inside of sentences."""
    return [(m.group(), "NAME") for m in _CAPITAL.finditer(text) if all(p[:1].isupper() for p in m.group().split())]


def mentions(docs: DataFrame, text: str = "body", extract: Callable[[str], list[tuple[str, str]]] = capitalised) -> DataFrame:
    """(doc_id, surface, label, n): mentions of each document; a window of the text is a property of the extractor."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, s, l) for d, t in zip(pdf["doc_id"], pdf["t"]) if t for s, l in extract(t)]
            yield pd.DataFrame(rows, columns=["doc_id", "surface", "label"])

    found = docs.select("doc_id", F.col(text).alias("t")).where(F.col("t").isNotNull()).mapInPandas(run, "doc_id long, surface string, label string")
    return found.groupBy("doc_id", "surface", "label").agg(F.count("*").alias("n"))


def listed_mentions(docs: DataFrame, names: DataFrame, text: Column) -> DataFrame:
    """(doc_id, surface, label, n): words of the first READ characters that a list (name, label) holds, in its spelling.

    The list is matched by a join on the word, so it may be of any size; null and empty texts have no mention.
    """
    w = docs.select("doc_id", F.explode(F.regexp_extract_all(F.substring(text, 1, READ), F.lit(r"(\p{L}+)"), 1)).alias("surface"))
    listed = names.where(F.col("name").isNotNull()).select(F.col("name").alias("surface"), "label").distinct()
    return w.groupBy("doc_id", "surface").agg(F.count("*").alias("n")).join(listed, "surface").select("doc_id", "surface", "label", "n")


def listed_surfaces(docs: DataFrame, names: DataFrame, text: Column) -> DataFrame:
    """(doc_id, surface) of `listed_mentions`, distinct: only listed words are shuffled."""
    w = docs.select("doc_id", F.explode(F.regexp_extract_all(F.substring(text, 1, READ), F.lit(r"(\p{L}+)"), 1)).alias("surface"))
    return w.join(F.broadcast(names.where(F.col("name").isNotNull()).select(F.col("name").alias("surface")).distinct()), "surface").select("doc_id", "surface").distinct()


def aliases(m: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(surface, label, canonical): surfaces of a label with the same first three letters and a Jaro-Winkler similarity
    of at least 0.75 are one entity, named by the surface with most documents (ties: the first in order).

    Every two surfaces of a block (label, prefix) meet; a frequent prefix is cut in parts of about PART surfaces, and
    two parts are work of their own, which gives only the links that connect its surfaces.
    """
    s = m.groupBy("surface", "label").agg(F.countDistinct("doc_id").alias("docs")).withColumn("id", F.xxhash64("label", "surface"))
    base = s.withColumn("p", F.lower(F.substring("surface", 1, PREFIX)))
    sizes = base.groupBy("label", "p").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    placed = base.join(sizes, ["label", "p"]).withColumn("part", F.pmod(F.col("id"), F.col("parts")).cast("int"))
    both = placed.select("label", "p", "id", "surface", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    spread = both.select("label", "p", "id", "surface", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"))

    def forest(pdf: pd.DataFrame) -> pd.DataFrame:
        """Links that connect what the parts' pairs connect; surfaces already reached need no further comparison."""
        ids, table = pdf["id"].to_numpy(), JaroTable(pdf["surface"].str.lower().tolist())
        left, out = np.arange(len(ids)), []
        while len(left) > 1:
            reached, left = [left[-1]], left[:-1]
            while reached and len(left):
                i = reached.pop()
                near = table.winkler(i, left) >= similar
                out += [(ids[i], ids[j]) for j in left[near]]
                reached += list(left[near])
                left = left[~near]
        return pd.DataFrame(out, columns=["a", "b"])

    linked = components(spread.groupBy("label", "p", "lo", "hi").applyInPandas(lambda pdf: forest(pdf), "a long, b long"))
    grouped = s.join(linked, s.id == linked.node, "left").withColumn("root", F.coalesce("root", "id"))
    best = grouped.groupBy("root").agg(F.min_by("surface", F.struct((-F.col("docs")).alias("d"), "surface")).alias("canonical"))
    return grouped.join(best, "root").select("surface", "label", "canonical")


def first_alike(new: DataFrame, known: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(surface, label, found): for each new surface (surface, label) the first known one (surface, label, place) of its label
    that is alike; null if none is. No prefix is asked for, so all of a label meet: known surfaces go to the workers in
    blocks of a label's surfaces, new ones stay where they are."""
    blocks = known.select("label", F.lower("surface").alias("k"), "surface", "place", F.pmod(F.xxhash64("surface"), F.lit(64)).alias("block")).groupBy("label", "block").agg(F.collect_list(F.struct("place", "surface", "k")).alias("ks"))
    rows = new.select("surface", "label").distinct().join(blocks, "label")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for surface, label, ks in zip(pdf["surface"], pdf["label"], pdf["ks"]):
                table = JaroTable([k["k"] for k in ks] + [surface.lower()])
                near = np.flatnonzero(table.winkler(len(ks), np.arange(len(ks))) >= similar)
                if len(near):
                    first = min((ks[i]["place"], ks[i]["surface"]) for i in near)
                    out.append((surface, label, *first))
            yield pd.DataFrame(out, columns=["surface", "label", "place", "found"])

    hits = rows.select("surface", "label", "ks").mapInPandas(run, "surface string, label string, place long, found string")
    best = hits.groupBy("surface", "label").agg(F.min_by("found", "place").alias("found"))
    return new.select("surface", "label").distinct().join(best, ["surface", "label"], "left")


def entity_documents(m: DataFrame, a: DataFrame) -> DataFrame:
    """(canonical, doc_id) distinct."""
    return m.join(a, ["surface", "label"]).select("canonical", "doc_id").distinct()


def entity_signal(index: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, score 1.0): documents of the canonical entities of each query (query_id, canonical)."""
    return index.join(queries, "canonical").select("query_id", "doc_id").distinct().withColumn("score", F.lit(1.0))


def shared_entity_neighbours(index: DataFrame, queries: DataFrame, per_group: int = PER_GROUP) -> DataFrame:
    """(doc_id, canonical, other): for each queried note and entity of it the first other notes with that entity, by id.

    The first per_group + 1 notes of an entity suffice, so a frequent entity isn't joined whole.
    """
    first = F.row_number().over(Window.partitionBy("canonical").orderBy("other"))
    pool = index.select("canonical", F.col("doc_id").alias("other")).withColumn("r", first).where(F.col("r") <= per_group + 1)
    mine = index.join(queries.select("doc_id").distinct(), "doc_id", "left_semi")
    n = F.row_number().over(Window.partitionBy("doc_id", "canonical").orderBy("other"))
    return mine.join(pool, "canonical").where(F.col("other") != F.col("doc_id")).withColumn("n", n).where(F.col("n") <= per_group).select("doc_id", "canonical", "other")


def purge(index: DataFrame, doc_ids: DataFrame, fresh: DataFrame) -> DataFrame:
    """An index (…, doc_id) without the rows of doc_ids and with fresh ones in their place."""
    return index.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(fresh)
