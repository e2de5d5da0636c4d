"""Retrieval and clustering metrics, and the comparison of a run with a baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 10


def retrieval_metrics(runs: DataFrame, qrels: DataFrame, k: int = K) -> DataFrame:
    """One row: mean recall@k, MRR and nDCG@k over the queries that have a relevant document.

    runs: (query_id, doc_id, rank from 1); qrels: (query_id, doc_id), binary.
    """
    return judged(runs.join(qrels.withColumn("rel", F.lit(1)), ["query_id", "doc_id"]), qrels.groupBy("query_id").agg(F.count("*").alias("n")), k)


def judged(hit: DataFrame, sizes: DataFrame, k: int = K) -> DataFrame:
    """The row of `retrieval_metrics` of hit (query_id, rank), the relevant documents among each query's first k and the first one behind if there is
    none, and sizes (query_id, n), how many it has."""
    per = hit.groupBy("query_id").agg(F.count_if(F.col("rank") <= k).alias("hits"), F.min("rank").alias("first"), F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"))
    ideal = sizes.withColumn("idcg", F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0)))
    q = ideal.join(per, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return q.agg(
        F.count("*").alias("queries"),
        F.round(F.avg(zero(F.col("hits") / F.col("n"))), 6).alias("recall"),
        F.round(F.avg(zero(1 / F.col("first"))), 6).alias("mrr"),
        F.round(F.avg(zero(F.col("dcg") / F.col("idcg"))), 6).alias("ndcg"),
    )


def cluster_metrics(rows: DataFrame, true: str = "true_label", pred: str = "pred_label") -> DataFrame:
    """One row: adjusted Rand index, normalised mutual information (arithmetic mean) and V-measure, from the contingency table."""
    c = rows.groupBy(F.col(true).alias("t"), F.col(pred).alias("p")).agg(F.count("*").cast("double").alias("n"))
    a, b = c.groupBy("t").agg(F.sum("n").alias("a")), c.groupBy("p").agg(F.sum("n").alias("b"))
    two = lambda x: x * (x - 1) / 2
    ent = lambda x, n: -F.sum(x / n * F.log(x / n))
    total = c.agg(F.sum("n").alias("n"), F.sum(two(F.col("n"))).alias("sij"))
    n = F.col("n_all")
    one = total.withColumnRenamed("n", "n_all")
    sa = a.join(F.broadcast(one), F.lit(True)).agg(F.sum(two(F.col("a"))).alias("si"), ent(F.col("a"), n).alias("ht"))
    sb = b.join(F.broadcast(one), F.lit(True)).agg(F.sum(two(F.col("b"))).alias("sj"), ent(F.col("b"), n).alias("hp"))
    mi = c.join(a, "t").join(b, "p").join(F.broadcast(one), F.lit(True)).agg(F.sum(F.col("n") / n * F.log(F.col("n") * n / (F.col("a") * F.col("b")))).alias("mi"))
    r = one.join(sa, F.lit(True)).join(sb, F.lit(True)).join(mi, F.lit(True))
    expected = F.col("si") * F.col("sj") / two(n)
    top = (F.col("si") + F.col("sj")) / 2
    mean_h = (F.col("ht") + F.col("hp")) / 2
    v = F.when(mean_h > 0, F.col("mi") / mean_h).otherwise(1.0)
    return r.select(F.round(F.when(top == expected, 1.0).otherwise((F.col("sij") - expected) / (top - expected)), 6).alias("ari"), F.round(v, 6).alias("nmi"), F.round(v, 6).alias("v_measure"))


def compare(baseline: DataFrame, current: DataFrame, relative: float = 0.03, absolute: dict[str, float] | None = None) -> DataFrame:
    """(metric, base, now, regressed): a metric regresses if it falls by more than the relative tolerance; those of
    `absolute` if they rise by more than so many points. A metric that is gone has regressed."""
    j = baseline.select("metric", F.col("value").alias("base")).join(current.select("metric", F.col("value").alias("now")), "metric", "left")
    worse = F.col("now") < F.col("base") * (1 - relative)
    for metric, points in (absolute or {}).items():
        worse = F.when(F.col("metric") == metric, F.col("now") > F.col("base") + points).otherwise(worse)
    return j.select("metric", "base", "now", F.coalesce(worse, F.lit(True)).alias("regressed"))


def stratified(rows: DataFrame, stratum: str, budget: int, key: str = "doc_id") -> DataFrame:
    """An exact deterministic sample: in every stratum the rows with the least hashes, in proportion to its size, at least one.

    Sizes are counted map-side; the least rows of 256 parts of a stratum come before those of the stratum, so none is gathered whole.
    """
    sizes = rows.groupBy(F.col(stratum).alias("s_")).agg(F.count("*").alias("k_"))
    total = F.broadcast(sizes.agg(F.sum("k_").alias("n_")))
    share = F.greatest(F.lit(1), F.floor(F.col("k_") * budget / F.col("n_")))
    hashed = rows.withColumn("h_", F.md5(F.col(key).cast("string"))).join(sizes, F.col(stratum).eqNullSafe(F.col("s_"))).join(total).withColumn("share_", share)
    order = [F.col("h_"), F.col(key)]
    part = Window.partitionBy(stratum, F.substring("h_", 1, 2)).orderBy(*order)
    few = hashed.withColumn("r_", F.row_number().over(part)).where(F.col("r_") <= F.col("share_"))
    ranked = few.withColumn("r_", F.row_number().over(Window.partitionBy(stratum).orderBy(*order)))
    return ranked.where(F.col("r_") <= F.col("share_")).select(*rows.columns)
