"""Importers: every file gives a document or a skip with its reason. Registered by key."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmesh.functions.text import stripped

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
KEEP_SCHEMA = """title string, textContent string, listContent array<struct<text:string,isChecked:boolean>>, createdTimestampUsec long, userEditedTimestampUsec long,
isArchived boolean, isPinned boolean, isTrashed boolean, color string, labels array<struct<name:string>>, attachments array<struct<filePath:string,mimetype:string>>, annotations array<struct<url:string,title:string>>"""
COLUMNS = ["external_id", "title", "body", "created_at", "edited_at", "labels", "attachments", "extra", "reason"]


def register(key: str):
    def put(f):
        REGISTRY[key] = f
        return f

    return put


def importer(key: str) -> Callable[[SparkSession, str], DataFrame]:
    """Unknown keys raise KeyError."""
    return REGISTRY[key]


def split_scan(scan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, skips): together all files of the scan."""
    return scan.where(F.col("reason").isNull()).drop("reason"), scan.where(F.col("reason").isNotNull()).select(F.col("external_id").alias("path"), "reason")


def _micros(c: str):
    return F.when(F.col(c) != 0, F.timestamp_micros(F.col(c)))


@register("keep")
def keep_export(spark: SparkSession, path: str) -> DataFrame:
    """A folder of JSON notes, one file each. Unparsable files are `malformed`, JSON that is no object `not-a-note`, notes in the bin `trashed`."""
    files = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True)
    j = files.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("external_id"), F.trim("value").alias("v"))
    j = j.select("external_id", "v", F.from_json("v", KEEP_SCHEMA).alias("n"), F.try_parse_json("v").alias("any"))
    reason = F.when(F.col("any").isNull(), "malformed").when(~F.col("v").startswith("{"), "not-a-note").when(F.col("n.isTrashed"), "trashed")
    item = lambda x: F.concat(F.when(x["isChecked"], "- [x] ").otherwise("- [ ] "), F.coalesce(x["text"], F.lit("")))
    listed = F.array_join(F.transform("n.listContent", item), "\n")
    text = F.coalesce(F.col("n.textContent"), F.lit(""))
    body = F.when((F.trim(text) != "") & (F.size("n.listContent") > 0), F.concat(text, F.lit("\n"), listed)).when(F.trim(text) != "", text).otherwise(F.coalesce(listed, F.lit("")))
    extra = F.to_json(F.struct("n.color", "n.isArchived", "n.isPinned", "n.annotations"))
    return j.select(
        "external_id",
        F.coalesce("n.title", F.lit("")).alias("title"),
        body.alias("body"),
        _micros("n.createdTimestampUsec").alias("created_at"),
        _micros("n.userEditedTimestampUsec").alias("edited_at"),
        F.filter(F.transform("n.labels", lambda x: F.trim(x["name"])), lambda x: x != "").alias("labels"),
        F.transform("n.attachments", lambda a: F.struct(a["filePath"].alias("path"), F.coalesce(a["mimetype"], F.lit("")).alias("mime"))).alias("attachments"),
        extra.alias("extra"),
        reason.alias("reason"),
    )


_FRONT = r"(?s)\A---\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)"


def front_matter_tags(front: str) -> list[str]:
    """Values of all `tags:` and `tag:` entries: a bracketed or bare list with commas or semicolons, one word, or the indented
    dashed lines below, up to a blank or other line. Quotes around a value go; this is no YAML parser."""
    out, inside = [], False
    for line in front.splitlines():
        if inside and line[:1] in (" ", "\t") and line.strip().startswith("-"):
            out.append(line.strip().lstrip("-"))
            continue
        entry = re.match(r"[ \t]*tags?[ \t]*:(.*)", line)
        inside = bool(entry) and not entry.group(1).strip()
        if entry and not inside:
            value = entry.group(1).strip()
            out += re.split("[,;]", value[1:-1] if value[0] == "[" and value[-1] == "]" else value)
    return [v for t in out if (v := t.strip().strip("\"'"))]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _front_tags(front: pd.Series) -> pd.Series:
    return front.map(lambda s: front_matter_tags(s) if s else [])


@register("markdown")
def markdown_tree(spark: SparkSession, path: str) -> DataFrame:
    """A folder of .md and .markdown files with all folders below. Blank files are `empty`, files that are no UTF-8 `unreadable`."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{md,markdown}").load(path)
    raw = F.col("content").cast("string")
    base = re.sub(r"^file:/*", "/", path.rstrip("/"))
    rel = F.regexp_replace(F.regexp_replace("path", r"^file:/*", "/"), "^" + re.escape(base) + "/", "")
    f = files.select(rel.alias("external_id"), F.col("modificationTime").alias("edited_at"), F.regexp_replace(raw, "^﻿", "").alias("raw"), F.is_valid_utf8(raw).alias("ok"))
    f = f.withColumns({"front": F.regexp_extract("raw", _FRONT, 1), "body": F.regexp_replace("raw", _FRONT, "")})
    inline = F.regexp_extract_all("body", F.lit(r"(?m)(?:^|\s)#([\p{L}\p{N}_/.&-]+)"), 1)  # fixed value
    both = F.filter(F.transform(F.concat(_front_tags("front"), inline), lambda x: F.regexp_replace(x, "^#+", "")), lambda x: x != "")
    distinct = F.aggregate(both, F.array().cast("array<string>"), lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x))))
    stem = F.regexp_replace(F.element_at(F.split("external_id", "/"), -1), r"\.(md|markdown)$", "")
    heading = F.regexp_extract("body", r"(?m)^#\s+(.+?)\s*$", 1)
    return f.select(
        "external_id",
        F.when(heading != "", heading).otherwise(stem).alias("title"),
        stripped(F.col("body")).alias("body"),
        F.lit(None).cast("timestamp").alias("created_at"),
        "edited_at",
        distinct.alias("labels"),
        F.array().cast("array<struct<path:string,mime:string>>").alias("attachments"),
        F.lit(None).cast("string").alias("extra"),
        F.when(~F.col("ok"), "unreadable").when(F.trim(F.regexp_replace("raw", r"\s", "")) == "", "empty").alias("reason"),
    )


def detect(path: str) -> str | None:
    """The importer whose files a folder holds: `keep` if any JSON file has a marker key, else Markdown; null without either."""
    import glob
    import json
    import os

    markers = {"createdTimestampUsec", "userEditedTimestampUsec", "isTrashed", "listContent"}  # fixed values
    for name in glob.iglob(os.path.join(glob.escape(path), "*.json")):
        try:
            with open(name, encoding="utf-8") as f:
                note = json.load(f)
        except (OSError, ValueError):
            continue
        if isinstance(note, dict) and markers & note.keys():
            return "keep"
    found = glob.iglob(os.path.join(glob.escape(path), "**", "*.m*d*"), recursive=True)
    return "markdown" if any(p.endswith((".md", ".markdown")) for p in found) else None


def export_text(docs: DataFrame) -> DataFrame:
    """(value): each note as title, blank line, content and a rule; written by `.write.text`, one part for each task."""
    return docs.select(F.concat_ws("\n\n", F.when(F.coalesce("title", F.lit("")) != "", F.col("title")), F.coalesce("body", F.lit("")), F.lit("---")).alias("value"))


def judged_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, queries, relevance) of a benchmark folder: corpus.jsonl, queries.jsonl and a tab-separated qrels/test.tsv of three or four columns."""
    docs = spark.read.schema("_id string, title string, text string").json(f"{path}/corpus.jsonl").select(F.col("_id").alias("doc_id"), "title", "text")
    queries = spark.read.schema("_id string, text string").json(f"{path}/queries.jsonl").select(F.col("_id").alias("query_id"), "text")
    lines = spark.read.text(f"{path}/qrels/test.tsv").select(F.split("value", "\t").alias("c")).where(F.element_at("c", -1).rlike(r"^-?\d+$"))
    qrels = lines.where(F.element_at("c", -1).cast("double") > 0).select(F.col("c")[0].alias("query_id"), F.element_at("c", -2).alias("doc_id"))
    return docs, queries, qrels
