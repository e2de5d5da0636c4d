"""Chat sessions in long form: (session_id, turn, role, content)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.text import cited_numbers

RECENT, TITLE = 6, 80


def messages(chat: DataFrame) -> DataFrame:
    """Exact duplicates once, roles in lower case; by message id, so no content is shuffled twice."""
    return chat.select("message_id", "session_id", "turn", F.lower(F.trim("role")).alias("role"), "content", "created_at").dropDuplicates(["message_id"])


def sessions(m: DataFrame) -> DataFrame:
    """(session_id, n_messages, updated_at): newest first when ordered by updated_at."""
    return m.groupBy("session_id").agg(F.count("*").alias("n_messages"), F.max("created_at").alias("updated_at"))


def auto_titles(m: DataFrame) -> DataFrame:
    """(session_id, title): the first user message that isn't blank, cut to 80 characters with dots; 'New Chat' without one."""
    t = F.trim(F.col("content"))
    first = m.groupBy("session_id").agg(F.min_by(F.when(F.length(t) > TITLE, F.concat(F.substring(t, 1, TITLE), F.lit("..."))).otherwise(t), F.when((F.col("role") == "user") & (t != ""), F.struct("turn", "message_id"))).alias("t"))
    return first.select("session_id", F.coalesce("t", F.lit("New Chat")).alias("title"))


def recent(m: DataFrame, n: int = RECENT) -> DataFrame:
    """The last n messages of each session; `older` counts the ones before them, to summarise when there are more than two."""
    w = Window.partitionBy("session_id")
    r = m.withColumns({"back": F.row_number().over(w.orderBy(F.desc("turn"), F.desc("message_id"))), "all": F.count("*").over(w)})
    return r.where(F.col("back") <= n).select("session_id", "turn", "role", "message_id", F.greatest(F.col("all") - n, F.lit(0)).alias("older"), (F.col("all") > n + 2).alias("summarise"))


def user_context(m: DataFrame) -> DataFrame:
    """(session_id, turn, context): each user message with the two before it, joined by blanks."""
    u = m.where((F.col("role") == "user") & F.col("content").isNotNull())
    w = Window.partitionBy("session_id").orderBy("turn", "message_id").rowsBetween(-2, 0)
    return u.select("session_id", "turn", "message_id", F.array_join(F.collect_list("content").over(w), " ").alias("context"))


def citations(m: DataFrame) -> DataFrame:
    """(message_id, number, place): cited note numbers of every message in order of first mention."""
    return m.where(F.col("content").isNotNull()).select("message_id", F.posexplode(cited_numbers(F.col("content"))).alias("place", "number")).select("message_id", "number", "place")


def resolve_citations(cited: DataFrame, context: DataFrame) -> DataFrame:
    """Citations joined with the context (message_id, position from 1, doc_id); numbers out of range are dropped."""
    return cited.join(context, (cited.message_id == context.message_id) & (cited.number == context.position)).select(cited.message_id, "number", "place", "doc_id")


def token_budget(m: DataFrame, base: int = 200, limit: int = 8192) -> DataFrame:
    """(session_id, tokens, pct): a quarter of the characters of the recent messages, rounded up each, and a base."""
    last = recent(m).select("message_id").join(m.select("message_id", "session_id", F.ceil(F.length(F.coalesce("content", F.lit(""))) / 4).alias("t")), "message_id")
    s = last.groupBy("session_id").agg((F.sum("t") + base).alias("tokens"))
    return s.select("session_id", "tokens", F.round(100 * F.col("tokens") / limit, 1).alias("pct"))


def sequence_gaps(m: DataFrame, seq: str = "turn") -> DataFrame:
    """(session_id, seq, before): places where the sequence doesn't go on by one."""
    w = Window.partitionBy("session_id").orderBy(seq, "message_id")
    g = m.select("session_id", F.col(seq).alias("seq"), F.lag(seq).over(w).alias("before"))
    return g.where(F.col("seq") - F.col("before") != 1)


def frames(m: DataFrame) -> DataFrame:
    """(session_id, seq, frame): messages as numbered JSON frames."""
    w = Window.partitionBy("session_id").orderBy("turn", "message_id")
    n = F.row_number().over(w)
    return m.select("session_id", n.alias("seq"), F.to_json(F.struct(F.lit("delta").alias("type"), F.col("content"), n.alias("seq"))).alias("frame"))
