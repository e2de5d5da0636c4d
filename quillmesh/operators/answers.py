"""Answers checked against their notes: claims, cited contexts, verdicts of a pluggable inference model, conflicts, context blocks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.text import _MARK, claim_context, claims, words
from quillmesh.functions.vectors import cosine

#: Limits of the verdicts, of conflicts (similarity, notes looked at, pairs kept) and of near-equal queries.
ENTAILS, CONTRADICTS, NEUTRAL = 0.3, 0.5, 0.15
CONFLICT, CONFLICT_NOTES, CONFLICT_PAIRS = 0.85, 25, 20
SAME_QUERY = 0.95
#: Words that deny something, for the default model.
DENIALS = ("not", "no", "never", "nicht", "kein", "keine", "nie", "non", "ne", "pas", "jamais", "nunca", "не", "няма", "mai")


def overlap_logits(note: Column, claim: Column) -> Column:
    """The default inference model: (contradiction, entailment, neutral) from the share of the claim's words that the note has, turned to
    contradiction where one of them denies and the other does not."""
    a, b = F.array_distinct(words(claim)), F.array_distinct(words(F.coalesce(note, F.lit(""))))
    share = F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(0.0)
    denied = F.array(*map(F.lit, DENIALS))
    against = F.arrays_overlap(a, denied) != F.arrays_overlap(b, denied)
    return F.array(F.when(against, 4 * share).otherwise(0.0), F.when(against, 0.0).otherwise(4 * share), F.lit(1.5))


def softmax(logits: Column) -> Column:
    e = F.transform(logits, F.exp)
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def answer_claims(answers: DataFrame, content: str = "content") -> DataFrame:
    """(message_id, claim_no, text, cited): the claims of each answer; null and short answers have none."""
    c = answers.where(F.col(content).isNotNull()).select("message_id", F.posexplode(claims(F.col(content))).alias("claim_no", "c"))
    return c.select("message_id", "claim_no", "c.text", "c.cited")


def cited_contexts(answers: DataFrame, cited: DataFrame, content: str = "content") -> DataFrame:
    """(message_id, number, claim): what the answer says where it cites a note; cited: (message_id, number)."""
    return cited.join(answers.select("message_id", content), "message_id").select("message_id", "number", claim_context(F.col(content), F.col("number")).alias("claim")).where(F.col("claim").isNotNull())


def _probabilities(df: DataFrame, model: Callable[[Column, Column], Column], note: Column, claim: Column) -> DataFrame:
    p = softmax(model(note, claim))
    return df.withColumn("p_", p).withColumns({"contra": F.round(F.col("p_")[0], 6), "entail": F.round(F.col("p_")[1], 6), "neutral": F.round(F.col("p_")[2], 6)}).drop("p_")


def verify_citations(contexts: DataFrame, notes: DataFrame, model: Callable[[Column, Column], Column] = overlap_logits) -> DataFrame:
    """(message_id, number, support, contradiction, verdict): each cited claim against its note (message_id, position, note); citations of
    notes outside of the context have no row. The largest of the three probabilities is the verdict, neutral in a tie."""
    j = contexts.join(notes, (contexts.message_id == notes.message_id) & (contexts.number == notes.position)).select(contexts.message_id, "number", "claim", "note")
    s = _probabilities(j, model, F.substring("note", 1, 500), F.col("claim"))
    verdict = F.when((F.col("entail") > F.col("contra")) & (F.col("entail") > F.col("neutral")), "supported").when((F.col("contra") > F.col("entail")) & (F.col("contra") > F.col("neutral")), "contradicted").otherwise("neutral")
    return s.select("message_id", "number", F.round("entail", 2).alias("support"), F.round("contra", 2).alias("contradiction"), verdict.alias("verdict"))


def ground(said: DataFrame, notes: DataFrame, model: Callable[[Column, Column], Column] = overlap_logits) -> DataFrame:
    """(message_id, claim_no, score, verdict): claims (message_id, claim_no, text, cited) against the notes of their context.

    A claim that cites a note of the context is judged by it alone; others take the note that supports them most, from which it
    is supported above 0.3, neutral above 0.15, else unsupported.
    """
    pairs = said.join(notes, "message_id", "left")
    size = F.max(F.coalesce("position", F.lit(0))).over(Window.partitionBy("message_id", "claim_no"))
    j = pairs.withColumn("alone", (F.coalesce("cited", F.lit(0)) >= 1) & (F.col("cited") <= size))
    s = _probabilities(j.where(F.coalesce(~F.col("alone") | (F.col("position") == F.col("cited")), F.lit(True))), model, F.substring("note", 1, 500), F.col("text"))
    none = F.col("position").isNull()
    best = s.groupBy("message_id", "claim_no").agg(F.bool_or("alone").alias("alone"), F.max(F.when(none, 0.0).otherwise(F.col("entail"))).alias("entail"), F.max("contra").alias("contra"))
    e, c = F.col("entail"), F.col("contra")
    one = F.when((e > c) & (e > ENTAILS), "supported").when((c > e) & (c > CONTRADICTS), "contradicted").otherwise("neutral")
    many = F.when(e > ENTAILS, "supported").when(e > NEUTRAL, "neutral").otherwise("unsupported")
    return best.select("message_id", "claim_no", F.round("entail", 2).alias("score"), F.when(F.col("alone"), one).otherwise(many).alias("verdict"))


def grounding_scores(answers: DataFrame, grounded: DataFrame) -> DataFrame:
    """(message_id, claims, grounded, score): the share of supported claims, to two places; 1 without any claim."""
    per = grounded.groupBy("message_id").agg(F.count("*").alias("claims"), F.count_if(F.col("verdict") == "supported").alias("grounded"))
    j = answers.select("message_id").distinct().join(per, "message_id", "left").fillna(0, ["claims", "grounded"])
    return j.select("message_id", "claims", "grounded", F.when(F.col("claims") > 0, F.round(F.col("grounded") / F.col("claims"), 2)).otherwise(1.0).alias("score"))


def conflict_pairs(notes: DataFrame, above: float = CONFLICT, most_notes: int = CONFLICT_NOTES, most_pairs: int = CONFLICT_PAIRS) -> DataFrame:
    """(group_id, a, b, sim): the most similar pairs of notes (group_id, doc_id, embedding) of a result that a model has to compare, above
    a similarity; results of more than most_notes notes are left out whole, so that a group is small."""
    small = notes.groupBy("group_id").count().where(F.col("count") <= most_notes).select("group_id")
    n = notes.join(small, "group_id", "left_semi")
    a, b = n.select("group_id", F.col("doc_id").alias("a"), F.col("embedding").alias("va")), n.select("group_id", F.col("doc_id").alias("b"), F.col("embedding").alias("vb"))
    pairs = a.join(b, "group_id").where(F.col("a") < F.col("b")).select("group_id", "a", "b", F.round(cosine(F.col("va"), F.col("vb")), 6).alias("sim")).where(F.col("sim") > above)
    w = Window.partitionBy("group_id").orderBy(F.desc("sim"), F.desc("a"), F.desc("b"))
    return pairs.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most_pairs).drop("r")


def saturation(ranked: DataFrame, vectors: DataFrame, above: float = 0.9, cap: int = 5, head: int = 10) -> DataFrame:
    """(query_id, n, mean_sim, kept): the mean similarity of the first ten results among each other; above 0.9 only five of them are kept.

    ranked: (query_id, doc_id, rank). Results of at most five are kept whole.
    """
    h = ranked.where(F.col("rank") <= head).join(vectors, "doc_id")
    a, b = h.select("query_id", F.col("rank").alias("i"), F.col("embedding").alias("va")), h.select("query_id", F.col("rank").alias("j"), F.col("embedding").alias("vb"))
    m = a.join(b, "query_id").where(F.col("i") < F.col("j")).groupBy("query_id").agg(F.round(F.avg(cosine(F.col("va"), F.col("vb"))), 6).alias("mean_sim"))
    n = ranked.groupBy("query_id").agg(F.count("*").alias("n")).join(m, "query_id", "left")
    return n.select("query_id", "n", "mean_sim", F.when((F.col("n") > cap) & (F.coalesce("mean_sim", F.lit(0.0)) > above), cap).otherwise(F.col("n")).alias("kept"))


def repeated_queries(queries: DataFrame, group: str, order: str, same: float = SAME_QUERY) -> DataFrame:
    """(group, order, repeated): whether a query's vector is nearer than 0.95 to that of an earlier one of its group. Only groups with a
    chance of it, those of several queries, are compared; a session's queries are what one person types."""
    q = queries.select(F.col(group).alias("g"), F.col(order).alias("o"), "embedding")
    earlier = q.select("g", F.col("o").alias("p"), F.col("embedding").alias("v"))
    near = q.join(earlier, "g").where((F.col("p") < F.col("o")) & (F.round(cosine(F.col("embedding"), F.col("v")), 6) > same)).select("g", "o").distinct().withColumn("hit", F.lit(True))
    return q.join(near, ["g", "o"], "left").select(F.col("g").alias(group), F.col("o").alias(order), F.coalesce("hit", F.lit(False)).alias("repeated"))


def coverage(steps: DataFrame, least: int = 3, similar: float = 0.45, novel: float = 0.34, most: int = 250, max_steps: int = 5) -> DataFrame:
    """(query_id, step, stop, reason): when a search that goes on has enough. steps: (query_id, step, found, fresh, collected, top) with the
    mean similarity of the three nearest notes collected so far."""
    reason = (  # fixed values: what the interface shows
        F.when(F.col("step") >= max_steps, "max steps reached")
        .when(F.col("collected") >= most, "note limit reached")
        .when(F.col("collected") < least, "too few notes collected")
        .when((F.col("found") > 0) & (F.col("fresh") / F.col("found") < novel), "searches returning mostly duplicates")
        .when(F.col("top") >= similar, "collected notes match query well")
        .otherwise("coverage below threshold")
    )
    return steps.select("query_id", "step", ~reason.isin("too few notes collected", "coverage below threshold"), reason).toDF("query_id", "step", "stop", "reason")


def note_blocks(notes: DataFrame) -> DataFrame:
    """(message_id, position, block): notes (position, title, created, edited, tags, content) as a prompt shows them."""
    number = F.col("position").cast("string")
    # The marks of a block, by which answers cite it.
    tags = F.when(F.size("tags") > 0, F.concat(F.lit("\nTags: "), F.array_join("tags", ", "))).otherwise("")
    head = F.concat(F.lit("--- Note #"), number, F.lit(" ---\nTitle: "), F.coalesce("title", F.lit("Untitled Note")), F.lit("\nCreated: "), F.coalesce("created", F.lit("Unknown")), F.lit(" | Last edited: "), F.coalesce("edited", F.lit("Unknown")))
    return notes.select("message_id", "position", F.concat(head, tags, F.lit("\n\n"), F.coalesce("content", F.lit("")), F.lit("\n--- End Note #"), number, F.lit(" ---")).alias("block"))


def context_budget(recent: DataFrame, notes: DataFrame, base: int = 200, limit: int = 8192) -> DataFrame:
    """(message_id, tokens, pct): a quarter of the characters of messages (message_id, content) and notes (message_id, note), rounded up each, and a base."""
    t = lambda c: F.ceil(F.length(F.coalesce(c, F.lit(""))) / 4)
    parts = recent.select("message_id", t("content").alias("t")).unionByName(notes.select("message_id", t("note").alias("t")))
    s = parts.groupBy("message_id").agg((F.sum("t") + base).alias("tokens"))
    return s.select("message_id", "tokens", F.round(100 * F.col("tokens") / limit, 1).alias("pct"))


def without_marks(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, _MARK, ""))
