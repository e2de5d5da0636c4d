"""Small artifacts beside the tables, as JSON files and Parquet caches: tag map, manifest, pending proposals, sessions, vectors.

JSON artifacts are a user's state: they are read and written by the driver, whole, into a temporary file that then takes the
place of the old one. What grows with the corpus is a Parquet table keyed by content hash.
"""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Version of the stored layout; a table of another one isn't read.
SCHEMA_VERSION = 1
TITLE = 80


def read_json(path: str) -> dict:
    """The object that a file holds; an empty one for no file, broken JSON or something else."""
    try:
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
    except (OSError, ValueError):
        return {}
    return found if isinstance(found, dict) else {}


def write_json(path: str, value: object, backup: bool = False) -> None:
    """Replaces a file at once: a reader sees the old or the new one. The old one stays as .bak if asked for."""
    folder = os.path.dirname(path) or "."
    os.makedirs(folder, exist_ok=True)
    if backup and os.path.exists(path):
        shutil.copy2(path, f"{path}.bak")
    handle, temporary = tempfile.mkstemp(dir=folder, suffix=".json")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            json.dump(value, f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise


def load_tag_map(path: str) -> dict[str, list[str]]:
    """Tags by note. Files of the former form, one tag for each note, are rewritten as lists."""
    found = read_json(path)
    if any(isinstance(v, str) for v in found.values()):
        found = {k: [v] if isinstance(v, str) else v for k, v in found.items()}
        write_json(path, found, backup=True)
    return found


def tag_map_rows(spark: SparkSession, tag_map: dict[str, list[str]]) -> DataFrame:
    """(id, tag, pos) of a tag map, each tag of a note once."""
    rows = [(k, t, i) for k, tags in tag_map.items() for i, t in enumerate(dict.fromkeys(tags))]
    return spark.createDataFrame(rows, "id string, tag string, pos int")


def save_manifest(path: str, labels: DataFrame) -> None:
    """The tags' centroids (label, tag, size, centroid) of a run for the next one; a vocabulary."""
    write_json(path, {"clusters": {str(r["label"]): {"tag": r["tag"], "size": r["size"], "centroid": list(r["centroid"])} for r in labels.toLocalIterator()}})


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(position, tag, centroid) of a stored manifest; entries without a tag or with a centroid that is no list of numbers are left out."""
    clusters = read_json(path).get("clusters")
    rows = []
    for entry in clusters.values() if isinstance(clusters, dict) else ():
        if isinstance(entry, dict) and entry.get("tag") and isinstance(entry.get("centroid"), list) and all(isinstance(x, (int, float)) for x in entry["centroid"]):
            rows.append((len(rows), str(entry["tag"]), [float(x) for x in entry["centroid"]]))
    return spark.createDataFrame(rows, "position int, tag string, centroid array<double>")


def clear(path: str) -> None:
    """Puts a file aside as .bak, so that the next run starts without it."""
    if os.path.exists(path):
        os.replace(path, f"{path}.bak")


class PendingProposals:
    """The proposals of a run until they are applied, with the decisions staged on them."""

    def __init__(self, path: str):
        self.path = path

    def save(self, proposals: list[dict], granularity: str | None = None) -> None:
        """A new set in place of the old one; the staged actions stay. Nothing is written for an empty set."""
        if proposals:
            actions = read_json(self.path).get("actions")
            write_json(self.path, {"generated_at": time.time(), "granularity": granularity, "proposals": proposals, "actions": actions if isinstance(actions, dict) else {}}, backup=True)

    def load(self) -> dict | None:
        found = read_json(self.path)
        return found if found.get("proposals") else None

    def stage(self, actions: dict[str, str]) -> None:
        """The whole map of decisions by tag name, also before there are proposals."""
        write_json(self.path, {**read_json(self.path), "actions": {str(k): str(v) for k, v in actions.items() if k is not None}}, backup=True)

    def actions(self) -> dict[str, str]:
        found = read_json(self.path).get("actions")
        return found if isinstance(found, dict) else {}

    def clear(self) -> None:
        clear(self.path)


def auto_title(messages: list[dict]) -> str:
    text = next((m["content"].strip() for m in messages if m.get("role") == "user" and (m.get("content") or "").strip()), "New Chat")
    return text[:TITLE] + "..." if len(text) > TITLE else text


class Sessions:
    """Chat sessions, a JSON file each; lists of them are read by Spark, which decodes only the columns it needs."""

    SCHEMA = "id string, title string, created_at double, updated_at double, messages array<struct<role:string,content:string>>"

    def __init__(self, folder: str):
        self.folder = folder

    def _path(self, session_id: str) -> str:
        if not session_id or os.path.basename(session_id) != session_id or session_id.startswith("."):
            raise ValueError("no name of a session")
        return os.path.join(self.folder, f"{session_id}.json")

    def create(self, title: str = "New Chat") -> dict:
        now = time.time()
        session = {"id": uuid.uuid4().hex, "title": title, "messages": [], "created_at": now, "updated_at": now}
        write_json(self._path(session["id"]), session)
        return session

    def load(self, session_id: str) -> dict | None:
        return read_json(self._path(session_id)) or None

    def save_messages(self, session_id: str, messages: list[dict]) -> dict:
        """Replaces the messages; a session without a title of its own is named by its first question."""
        session = self.load(session_id)
        if session is None:
            raise KeyError(session_id)
        title = auto_title(messages) if session["title"] == "New Chat" else session["title"]
        session |= {"messages": messages, "title": title, "updated_at": time.time()}
        write_json(self._path(session_id), session)
        return session

    def rename(self, session_id: str, title: str) -> None:
        session = self.load(session_id)
        if session is None:
            raise KeyError(session_id)
        write_json(self._path(session_id), {**session, "title": title})

    def delete(self, session_id: str) -> bool:
        try:
            os.unlink(self._path(session_id))
        except FileNotFoundError:
            return False
        return True

    def summaries(self, spark: SparkSession) -> DataFrame:
        """(id, title, n_messages, updated_at), the last changed first."""
        if not os.path.isdir(self.folder) or not any(n.endswith(".json") for n in os.listdir(self.folder)):
            return spark.createDataFrame([], "id string, title string, n_messages int, updated_at double")
        files = spark.read.schema(self.SCHEMA).json(self.folder, multiLine=True, pathGlobFilter="*.json")
        return files.where(F.col("id").isNotNull()).select("id", "title", F.size("messages").alias("n_messages"), "updated_at").orderBy(F.desc("updated_at"), "id")


def write_table(df: DataFrame, path: str) -> None:
    """Writes a table with the layout's version beside its place, then swaps it in; the old one is deleted last."""
    fs, at, fresh, old = _paths(df.sparkSession, path, path + ".new", path + ".old")
    for leftover in (fresh, old):
        fs.delete(leftover, True)
    df.withColumn("schema_version", F.lit(SCHEMA_VERSION)).write.parquet(path + ".new")
    if fs.exists(at):
        fs.rename(at, old)
    fs.rename(fresh, at)
    fs.delete(old, True)


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """A table that write_table wrote, without its version; None where there is none. Another version is an error."""
    fs, at = _paths(spark, path)
    if not fs.exists(at):
        return None
    df = spark.read.parquet(path)
    if df.where(F.col("schema_version") != SCHEMA_VERSION).limit(1).count():
        raise ValueError(f"{path} was written with another layout")
    return df.drop("schema_version")


def _paths(spark: SparkSession, *paths: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    places = [hadoop.Path(p) for p in paths]
    return (places[0].getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), *places)


class VectorCache:
    """Vectors by content hash in a Parquet table: texts are encoded once, whatever index asks for them."""

    def __init__(self, path: str):
        self.path = path

    def read(self, spark: SparkSession) -> DataFrame:
        found = read_table(spark, self.path)
        return spark.createDataFrame([], "key string, embedding array<double>") if found is None else found

    def fill(self, texts: DataFrame, encode: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Vectors of texts (key, text), null keys left out: encode gets those whose key is unknown, each once, and its (key, embedding)
        rows join the table before they are returned with the rest."""
        spark = texts.sparkSession
        known = self.read(spark)
        new = texts.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("text").alias("text")).join(known.select("key"), "key", "left_anti")
        write_table(known.unionByName(encode(new).select("key", "embedding")), self.path)
        return self.read(spark).join(texts.select("key").distinct(), "key", "left_semi")

    def compact(self, spark: SparkSession, live: DataFrame) -> None:
        """Rewrites the table with the vectors of live keys alone."""
        write_table(self.read(spark).join(live.select("key").distinct(), "key", "left_semi"), self.path)


def image_files(spark: SparkSession, folder: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, content) of the wanted images (path) below a folder, and the paths that are missing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    base = F.lit(os.path.abspath(folder).rstrip("/") + "/")
    found = files.select(F.expr("substring(regexp_replace(path, '^file:/*', '/'), 1)").alias("full"), "content").select(F.replace("full", base, F.lit("")).alias("path"), "content")
    asked = wanted.select("path").distinct()
    return found.join(asked, "path", "left_semi"), asked.join(found.select("path"), "path", "left_anti")


def newsgroups(spark: SparkSession, folder: str) -> tuple[DataFrame | None, str | None]:
    """(documents, None) of a folder of newsgroup posts, one folder a group: (path, label, text) without headers, quoted lines and signature;
    (None, why) where the folder holds none."""
    if not os.path.isdir(folder) or not any(os.path.isdir(os.path.join(folder, n)) for n in os.listdir(folder)):
        return None, f"no newsgroups in {folder}"
    files = spark.read.option("recursiveFileLookup", True).text(folder, wholetext=True)
    body = F.regexp_replace(F.regexp_replace("value", r"(?s)\A.*?\r?\n\r?\n", ""), r"(?m)^[>|].*$\n?", "")
    return files.select(F.col("_metadata.file_path").alias("path"), F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("label"), F.trim(F.regexp_replace(body, r"(?s)\n-- ?\n.*\z", "")).alias("text")), None


def skipped(name: str, why: str) -> Callable[[SparkSession, str], tuple[None, str]]:
    """A corpus that can't be had: its loader only says so."""
    return lambda spark, folder: (None, f"{name}: {why}")


#: Loaders by name: (documents or None, why not).
CORPORA: dict[str, Callable[[SparkSession, str], tuple[DataFrame | None, str | None]]] = {
    "newsgroups": newsgroups,
    "markdown_vault": skipped("markdown_vault", "no vault under a free licence"),
    "bg_wikipedia": skipped("bg_wikipedia", "no judged corpus in Bulgarian"),
}
