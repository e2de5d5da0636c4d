"""Auto-tagging on given vectors and labels: centroids, assignment, thresholds, merging, keywords, samples."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.text import words
from quillmesh.functions.vectors import cosine, dot, unit
from quillmesh.session import cut

#: Parameters of assignment and merging.
MARGIN, FLOOR, MAX_TAGS = 0.85, 0.45, 3
SECONDARY, RESCUE, REVIEW = 0.60, 0.50, 0.70
MERGE, GRAY, BORDER, REUSE = 0.85, 0.60, 0.70, 0.90


def cluster_sizing(granularity: str, n: int) -> tuple[int, int]:
    """(least cluster size, least samples) from the number of notes."""
    digits = math.log10(max(n, 1))
    return (max(8, int(3 * digits)), 2) if granularity == "specific" else (max(15, int(6 * digits)), 3)


def centroids(vectors: DataFrame, label: str = "label") -> DataFrame:
    """(label, size, centroid): mean of each label's vectors, of unit length; noise (negative labels) has none."""
    parts = vectors.where(F.col(label) >= 0).select(F.col(label).alias("label"), F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count("*").alias("size"))
    lists = means.groupBy("label").agg(F.max("size").alias("size"), F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    return lists.select("label", "size", unit(F.col("v.x")).alias("centroid"))


def prototypes(text_vectors: DataFrame, seed_means: DataFrame) -> DataFrame:
    """(label, prototype): unit vector of half the text vector and half the seed mean; the text vector alone without seeds."""
    joined = text_vectors.join(seed_means, "label", "left")
    both = F.zip_with("text_vector", "centroid", lambda a, b: 0.5 * a + 0.5 * b)
    return joined.select("label", unit(F.coalesce(both, F.col("text_vector"))).alias("prototype"))


#: Labels are a vocabulary; more of them fail the query instead of filling the workers.
LABELS = 5000


def bounded(df: DataFrame, most: int) -> list:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows where a vocabulary was expected")
    return rows


def by_label(vectors: DataFrame, labels: DataFrame, pick, schema: str, vector: str = "centroid") -> DataFrame:
    """Rows that pick(ids, own labels, label names, similarities) makes of each batch of vectors (vec_id, label, embedding).

    Similarities with all labels (label, vector) are one matrix product a batch and never leave it; names are in order.
    """
    known = sorted((r[0], r[1]) for r in bounded(labels.select("label", vector), LABELS))
    sent = vectors.sparkSession.sparkContext.broadcast((np.array([k for k, _ in known], np.int64), np.array([c for _, c in known], float)))
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        names, m = sent.value
        for pdf in batches:
            if len(pdf) and len(names):
                x = np.array(pdf["embedding"].tolist(), float)
                n = np.linalg.norm(x, axis=1, keepdims=True)
                s = np.round(np.divide(x, n, out=np.zeros_like(x), where=n > 0) @ m.T, 6)
                yield pd.DataFrame(dict(zip(columns, pick(pdf["vec_id"].to_numpy(), pdf["label"].to_numpy(), names, s), strict=True)))

    return vectors.select("vec_id", "label", "embedding").mapInPandas(run, schema)


def own_similarities(vectors: DataFrame, labels: DataFrame, vector: str = "centroid") -> DataFrame:
    """(vec_id, label, sim): every vector against its own label."""

    def pick(ids, own, names, s):
        row, col = np.nonzero(own[:, None] == names[None, :])
        return ids[row], names[col], s[row, col]

    return by_label(vectors, labels, pick, "vec_id long, label int, sim double", vector)


def nearest_labels(vectors: DataFrame, labels: DataFrame, vector: str = "centroid") -> DataFrame:
    """(vec_id, label, sim): the most similar label of every vector, of equals the least."""

    def pick(ids, own, names, s):
        best = s.argmax(axis=1)
        return ids, names[best], s[np.arange(len(ids)), best]

    return by_label(vectors, labels, pick, "vec_id long, label int, sim double", vector)


def thresholds(own: DataFrame, labels: DataFrame, dial: float = 0.75, default: float = 0.5) -> DataFrame:
    """(label, threshold): the 10th percentile (linear) of each label's own similarities times the dial; the default without any."""
    got = own.groupBy("label").agg(F.round(F.percentile("sim", 0.1) * dial, 6).alias("threshold"))
    return labels.select("label").join(got, "label", "left").select("label", F.coalesce("threshold", F.lit(default)).alias("threshold"))


def assign(vectors: DataFrame, labels: DataFrame, limits: DataFrame, margin: float = MARGIN, floor: float = FLOOR, most: int = MAX_TAGS, vector: str = "centroid") -> DataFrame:
    """(vec_id, label, sim, r): labels at or above their threshold and the margin of the best such one, at most three;
    a note without any takes its best label if that reaches the floor."""
    least = {r["label"]: r["threshold"] for r in bounded(limits, LABELS)}

    def pick(ids, own, names, s):
        ok = s >= np.array([least[k] for k in names.tolist()])
        best_ok = np.where(ok, s, -np.inf).max(axis=1, keepdims=True)
        any_ok = np.isfinite(best_ok)
        keep = np.where(any_ok, ok & (s >= margin * best_ok), (s == s.max(axis=1, keepdims=True)) & (s >= floor))
        order = np.argsort(np.where(keep, -s, np.inf), axis=1, kind="stable")[:, :most]
        row, r = np.nonzero(np.take_along_axis(keep, order, 1) & (any_ok | (np.arange(order.shape[1]) == 0)))
        col = order[row, r]
        return ids[row], names[col], s[row, col], r + 1

    return by_label(vectors, labels, pick, "vec_id long, label int, sim double, r int", vector)


def assign_by_centroid(vectors: DataFrame, labels: DataFrame) -> DataFrame:
    """(vec_id, label, r, review): the own cluster first, then others from 0.60 on, three in all; noise (a negative label) takes its
    nearest from 0.50 on and is reviewed, as is a primary below 0.70."""

    def pick(ids, own, names, s):
        primary = own[:, None] == names[None, :]
        noise = own < 0
        best = s.argmax(axis=1)
        rescued = noise & (s.max(axis=1) >= RESCUE)
        primary[rescued, best[rescued]] = True
        keep = primary | (~noise[:, None] & (s >= SECONDARY))
        order = np.argsort(np.where(keep, np.where(primary, -9, -s), np.inf), axis=1, kind="stable")[:, :MAX_TAGS]
        row, r = np.nonzero(np.take_along_axis(keep, order, 1))
        sure = np.where(primary, s, -1).max(axis=1)
        return ids[row], names[order[row, r]], r + 1, (noise | (sure < REVIEW))[row]

    return by_label(vectors, labels, pick, "vec_id long, label int, r int, review boolean")


def label_samples(own: DataFrame, k: int = 5) -> DataFrame:
    """(label, mean_sim, samples): the mean similarity of a label's members, to two places, and the ids of its nearest, of equals the least id."""
    w = Window.partitionBy("label").orderBy(F.desc("sim"), "vec_id")
    near = own.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "vec_id"))), lambda x: x["vec_id"]).alias("samples"))
    return own.groupBy("label").agg(F.round(F.avg("sim"), 2).alias("mean_sim")).join(near, "label")


def assignment_stats(vectors: DataFrame, assigned: DataFrame) -> DataFrame:
    """One row of per cents: tagged, with several tags, untagged; 0 for no notes."""
    per = vectors.select("vec_id").distinct().join(assigned.groupBy("vec_id").count(), "vec_id", "left")
    pct = lambda c: F.when(F.count("*") > 0, F.round(100 * F.count_if(c) / F.count("*"), 2)).otherwise(0.0)
    k = F.coalesce(F.col("count"), F.lit(0))
    return per.agg(F.count("*").alias("n"), pct(k > 0).alias("tagged_pct"), pct(k > 1).alias("multi_pct"), pct(k == 0).alias("untagged_pct"))


def cluster_sizes(vectors: DataFrame) -> DataFrame:
    """(label, size, share): members of each cluster, and of noise, with their per cent of all."""
    total = F.sum("size").over(Window.partitionBy(F.lit(0)))
    return vectors.groupBy("label").agg(F.count("*").alias("size")).withColumn("share", F.round(100.0 * F.col("size") / total, 2))


def label_pairs(labels: DataFrame, low: float, high: float | None = None, strict: bool = False) -> DataFrame:
    """(a, b, sim), a < b: labels whose centroids have a similarity in [low, high), or above low if strict.

    Labels are a vocabulary of at most LABELS, checked; each batch of them is compared with all in one matrix product.
    """

    def pick(ids, own, names, s):
        ok = (ids[:, None] < names[None, :]) & ((s > low) if strict else (s >= low))
        if high is not None:
            ok &= s < high
        row, col = np.nonzero(ok)
        return ids[row], names[col], s[row, col]

    return by_label(_as_vectors(labels), labels, pick, "a int, b int, sim double")


def _as_vectors(labels: DataFrame) -> DataFrame:
    return labels.select(F.col("label").alias("vec_id"), "label", F.col("centroid").alias("embedding"))


def nearest_label(labels: DataFrame) -> DataFrame:
    """(label, other, sim): the most similar other label, of equals the least; a single label has none."""

    def pick(ids, own, names, s):
        other = np.where(ids[:, None] == names[None, :], -np.inf, s)
        best = other.argmax(axis=1)
        some = np.isfinite(other[np.arange(len(ids)), best])
        return ids[some], names[best[some]], other[np.arange(len(ids)), best][some]

    return by_label(_as_vectors(labels), labels, pick, "label int, other int, sim double")


def reuse_manifest(labels: DataFrame, manifest: DataFrame) -> DataFrame:
    """(label, tag): the first manifest tag (by position) with a centroid at 0.90 or nearer. manifest: (position, tag, centroid), a vocabulary."""

    def pick(ids, own, names, s):
        near = s >= REUSE
        some = near.any(axis=1)
        return ids[some], names[near.argmax(axis=1)[some]]

    first = by_label(_as_vectors(labels), manifest.select(F.col("position").alias("label"), "centroid"), pick, "label int, position int")
    return first.join(manifest.select("position", "tag"), "position").select("label", "tag")


def disjoint_pairs(pairs: DataFrame) -> DataFrame:
    """(a, b, sim): pairs by similarity, each label in one of them. A pair is taken if it is the best left for both its ends, round by
    round, which gives what taking them one by one gives; every round is two partial aggregations over the pairs left."""
    order = F.struct((-F.col("sim")).alias("s"), "a", "b")
    left, chosen = cut(pairs.select("a", "b", "sim")), None
    while not left.isEmpty():
        ends = left.select(F.col("a").alias("x"), order.alias("o")).unionByName(left.select(F.col("b").alias("x"), order.alias("o")))
        best = ends.groupBy("x").agg(F.min("o").alias("o"))
        both = best.groupBy("o").count().where(F.col("count") == 2).select(F.col("o.a").alias("a"), F.col("o.b").alias("b"), (-F.col("o.s")).alias("sim"))
        taken = cut(both)
        chosen = taken if chosen is None else chosen.unionByName(taken)
        used = taken.select(F.col("a").alias("x")).unionByName(taken.select(F.col("b").alias("x")))
        left = cut(left.join(used, left.a == used.x, "left_anti").join(used, left.b == used.x, "left_anti"))
    return pairs.select("a", "b", "sim").where(F.lit(False)) if chosen is None else chosen


def representatives(vectors: DataFrame, labels: DataFrame, central: int = 4, diverse: int = 4, trade: float = 0.5) -> DataFrame:
    """(label, vec_id, r): the most central members, then members chosen by maximal marginal relevance among all.

    MMR weighs nearness to the centroid against nearness to what is chosen. Each step scores every member against
    the chosen ones of its label (at most central + diverse vectors a label) and takes the best of each label, so
    no label is gathered whole.
    """
    known = F.broadcast(vectors.sparkSession.createDataFrame(bounded(labels.select("label", "centroid"), LABELS), labels.select("label", "centroid").schema))
    near = vectors.join(known, "label").withColumn("sim", F.round(cosine(F.col("embedding"), F.col("centroid")), 6))
    near = cut(near.select("label", "vec_id", F.transform(unit(F.col("embedding")), lambda x: x.cast("double")).alias("v"), "sim"))
    w = Window.partitionBy("label").orderBy(F.desc("sim"), "vec_id")
    chosen = cut(near.withColumn("r", F.row_number().over(w)).where(F.col("r") <= central).select("label", "vec_id", "v", "r"))
    for r in range(central + 1, central + diverse + 1):
        sent = F.broadcast(chosen.groupBy("label").agg(F.collect_list("v").alias("vs"), F.collect_list("vec_id").alias("ids")))
        nearest = F.coalesce(F.array_max(F.transform("vs", lambda c: dot(c, F.col("v")))), F.lit(0.0))
        rest = near.join(sent, "label", "left").where(~F.coalesce(F.array_contains("ids", F.col("vec_id")), F.lit(False)))
        scored = rest.select("label", "vec_id", "v", F.struct((-F.round(trade * F.col("sim") - (1 - trade) * nearest, 9)).alias("s"), (-F.col("sim")).alias("c"), "vec_id").alias("order"))
        best = scored.groupBy("label").agg(F.min_by(F.struct("vec_id", "v"), "order").alias("m"))
        chosen = cut(chosen.unionByName(best.select("label", "m.vec_id", "m.v", F.lit(r).alias("r"))))
    return chosen.select("label", "vec_id", F.col("r").cast("int").alias("r"))


def keywords(docs: DataFrame, group: str, text: str = "body", k: int = 5) -> DataFrame:
    """(group, term, score, r): class-based TF-IDF; each group is one pseudo-document with L2-normalised weights."""
    tokens = docs.where(F.col(group).isNotNull()).select(F.col(group).alias("g"), F.explode(words(F.coalesce(text, F.lit("")))).alias("term")).groupBy("g", "term").agg(F.count("*").alias("tf"))
    n = docs.where(F.col(group).isNotNull()).select(F.countDistinct(group)).first()[0]
    df = tokens.groupBy("term").agg(F.count("*").alias("df"))
    raw = tokens.join(df, "term").select("g", "term", (F.col("tf") * (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1)).alias("w"))
    length = raw.groupBy("g").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("l"))
    w = Window.partitionBy("g").orderBy(F.desc("score"), "term")
    scored = raw.join(length, "g").select("g", "term", F.round(F.col("w") / F.col("l"), 6).alias("score"))
    return scored.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select(F.col("g").alias(group), "term", "score", "r")


#: Fixed value: one to three words of 2 to 30 characters before a colon or a dash that something follows.
TITLE_PREFIX = r"(?U)^\s*(\S{2,30}(?:\s+\S{2,30}){0,2})\s*[:\-—]\s+\S"


def title_prefixes(docs: DataFrame, least: int = 5) -> DataFrame:
    """(prefix, n): what leads at least `least` titles, lower-cased."""
    p = F.lower(F.regexp_extract("title", TITLE_PREFIX, 1))
    return docs.select(p.alias("prefix")).where(F.col("prefix") != "").groupBy("prefix").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def number_names(labels: DataFrame, name: str = "name", order: str = "label") -> DataFrame:
    """The second label of a name becomes `name 2`, and so on."""
    r = F.row_number().over(Window.partitionBy(name).orderBy(order))
    return labels.withColumn("r_", r).withColumn("unique_name", F.when(F.col("r_") == 1, F.col(name)).otherwise(F.concat(name, F.lit(" "), F.col("r_").cast("string")))).drop("r_")


def merge_labels(labels: DataFrame, groups: DataFrame) -> DataFrame:
    """Labels (label, ids, confidence, is_anchor, name) merged by (label, root): ids united, confidence weighted by size."""
    n = F.size("ids")
    j = labels.join(groups, "label", "left").withColumn("root", F.coalesce("root", "label"))
    agg = j.groupBy("root").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"),
        F.when(F.sum(n) > 0, F.sum(F.col("confidence") * n) / F.sum(n)).otherwise(0.0).alias("confidence"),
        F.bool_or("is_anchor").alias("is_anchor"),
        F.max_by("name", F.struct(n.alias("n"), (-F.col("label")).alias("l"))).alias("name"),
    )
    return agg.withColumnRenamed("root", "label")


def force_merge(labels: DataFrame, most: int = 40) -> list[tuple[int, int]]:
    """Merges (from, into) of the closest labels until at most `most` are left; driver-side over a vocabulary of at most 5000."""
    rows = sorted(bounded(labels, LABELS), key=lambda r: r["label"])
    names, size = [r["label"] for r in rows], np.array([r["size"] for r in rows], float)
    v = np.array([r["centroid"] for r in rows], float)
    live, out = list(range(len(rows))), []
    while len(live) > most:
        s = v[live] @ v[live].T
        np.fill_diagonal(s, -2)
        i, j = divmod(int(np.argmax(np.round(s, 9))), len(live))
        a, b = sorted((live[i], live[j]), key=lambda x: (-size[x], x))
        m = v[a] * size[a] + v[b] * size[b]
        v[a], size[a] = m / max(np.linalg.norm(m), 1e-12), size[a] + size[b]
        out.append((names[b], names[a]))
        live.remove(b)
    return out


#: Clusters are made again, of half the size, if more than this share is noise or fewer than so many clusters are left.
NOISY, FEWEST = 0.4, 5


def reduce_and_cluster(vectors: DataFrame, k: int, components: int = 10, far: float = 0.5, seed: int = 42) -> DataFrame:
    """(vec_id, label): PCA and k-means in place of manifold reduction and density clustering; members far from their centre are noise (-1).

    With too much noise or too few clusters twice as many centres are tried once, and the better of both is kept.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    n = vectors.count()
    if not n:
        return vectors.select("vec_id", F.lit(-1).alias("label"))
    width = len(vectors.select("embedding").first()[0])
    v = vectors.select("vec_id", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("v"))
    reduced = cut(PCA(k=min(components, width), inputCol="v", outputCol="p").fit(v).transform(v).select("vec_id", "p"))

    def clustered(number: int) -> tuple[float, int, DataFrame]:
        model = KMeans(k=max(2, min(number, n)), seed=seed, featuresCol="p", predictionCol="label").fit(reduced)
        centres = F.array(*(F.array(*(F.lit(float(x)) for x in c)) for c in model.clusterCenters()))
        near = cosine(vector_to_array("p"), F.element_at(centres, F.col("label") + 1)) >= far
        out = cut(model.transform(reduced).select("vec_id", F.when(near, F.col("label")).otherwise(-1).alias("label")))
        noise, some = out.agg(F.count_if(F.col("label") < 0) / n, F.countDistinct(F.when(F.col("label") >= 0, F.col("label")))).first()
        return noise, some, out

    first = clustered(k)
    if first[0] > NOISY or first[1] < FEWEST:
        first = min(first, clustered(2 * k), key=lambda x: (x[1] < FEWEST, x[0]))
    return first[2]
