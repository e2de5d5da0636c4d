"""A stored keyword index: append-only segments of postings, so that a query reads its terms alone and a change set writes its notes alone."""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions.text import normalized, search_terms
from quillmesh.operators.retrieval import PHRASE, bm25
from quillmesh.operators.tagging import bounded
from quillmesh.session import keep

#: Folders that the postings are spread over by term.
BUCKETS = 16
#: Queries of one search, and their terms; a larger set is searched by a scan of the notes.
QUERIES, TERMS = 10_000, 100_000


class KeywordIndex:
    """Tables below a folder: postings (bucket, term, doc_id, tf, dl, segment) sorted by term, and notes (doc_id, segment, dl, plain), in
    which the row of the last segment of a note holds and a null dl means that it is gone. Scores equal those of a scan."""

    def __init__(self, path: str):
        self.postings, self.notes = os.path.join(path, "postings"), os.path.join(path, "notes")

    def _rows(self, docs: DataFrame, text: Column, segment: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                counts = [Counter(search_terms(t)) for t in batch.column(1).to_pylist()]
                terms = [list(c) for c in counts]
                tf = [[c[t] for t in ts] for c, ts in zip(counts, terms, strict=True)]
                plain = [normalized(t or "") for t in batch.column(1).to_pylist()]
                columns = [batch.column(0), pa.array(terms, pa.list_(pa.string())), pa.array(tf, pa.list_(pa.int64())), pa.array([c.total() for c in counts], pa.int64()), pa.array(plain, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "terms", "tf", "dl", "plain"])

        # Kept, since both tables are written from it; what an executor loses is cut up again.
        rows = keep(docs.select("doc_id", text.alias("t")).mapInArrow(cut_up, "doc_id long, terms array<string>, tf array<long>, dl long, plain string"))
        flat = rows.select("doc_id", F.greatest("dl", F.lit(1)).alias("dl"), F.explode(F.arrays_zip("terms", "tf")).alias("p"))
        postings = flat.select(F.col("p.terms").alias("term"), "doc_id", F.col("p.tf").alias("tf"), "dl", F.lit(segment).alias("segment"))
        return postings, rows.select("doc_id", F.lit(segment).alias("segment"), "dl", "plain"), rows

    def _append(self, postings: DataFrame, notes: DataFrame, mode: str = "append") -> None:
        bucket = F.pmod(F.crc32("term"), F.lit(BUCKETS)).cast("int")
        # Sorted by term inside of a file, so that a query skips the row groups without its terms.
        postings.withColumn("bucket", bucket).repartition(BUCKETS, "bucket").sortWithinPartitions("bucket", "term", "doc_id").write.mode(mode).partitionBy("bucket").parquet(self.postings)
        notes.write.mode(mode).parquet(self.notes)

    def build(self, docs: DataFrame, text: Column) -> None:
        postings, notes, kept = self._rows(docs, text, 0)
        self._append(postings, notes, mode="overwrite")
        kept.unpersist()

    def apply(self, spark: SparkSession, gone: DataFrame, changed: DataFrame, text: Column) -> None:
        """Adds a segment: gone (doc_id) notes are marked, changed and new ones are written; nothing else is read or written."""
        segment = spark.read.parquet(self.notes).agg(F.max("segment")).first()[0] + 1
        postings, notes, kept = self._rows(changed, text, segment)
        left = gone.select("doc_id").join(changed.select("doc_id"), "doc_id", "left_anti")
        marks = left.select("doc_id", F.lit(segment).alias("segment"), F.lit(None).cast("long").alias("dl"), F.lit(None).cast("string").alias("plain"))
        self._append(postings, notes.unionByName(marks))
        kept.unpersist()

    def _live(self, spark: SparkSession) -> DataFrame:
        """(doc_id, segment, dl) of each note's last segment, without those that are gone; no text is read for it."""
        last = spark.read.parquet(self.notes).groupBy("doc_id").agg(F.max(F.struct("segment", "dl")).alias("m"))
        return last.select("doc_id", "m.segment", "m.dl").where(F.col("dl").isNotNull())

    def compact(self, spark: SparkSession) -> None:
        """One segment in place of all: the tables are written beside the old ones, then swapped."""
        live = self._live(spark)
        notes = spark.read.parquet(self.notes).join(live.select("doc_id", "segment"), ["doc_id", "segment"], "left_semi").select("doc_id", "segment", "dl", "plain")
        kept = spark.read.parquet(self.postings).join(live.select("doc_id", "segment"), ["doc_id", "segment"], "left_semi").withColumn("segment", F.lit(0))
        fresh = KeywordIndex(os.path.dirname(self.postings) + ".new")
        fresh._append(kept.select("term", "doc_id", "tf", "dl", "segment"), notes.withColumn("segment", F.lit(0)), mode="overwrite")
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        at = hadoop.Path(os.path.dirname(self.postings))
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        old = hadoop.Path(str(at.toString()) + ".old")
        fs.delete(old, True)
        fs.rename(at, old)
        fs.rename(hadoop.Path(os.path.dirname(fresh.postings)), at)
        fs.delete(old, True)
        spark.catalog.clearCache()

    def search(self, queries: DataFrame, query_text: str = "q") -> DataFrame:
        """(query_id, doc_id, score) by BM25 with the phrase bonus. Only the folders and row groups of the queries' terms are read."""
        spark = queries.sparkSession
        asked = [(r[0], r[1]) for r in bounded(queries.select("query_id", query_text).where(F.col(query_text).isNotNull()), QUERIES)]
        terms = sorted({t for _, q in asked for t in search_terms(q)})
        if len(terms) > TERMS:
            raise ValueError("too many terms for one search; scan the notes instead")
        live = self._live(spark)
        wanted = F.broadcast(spark.createDataFrame([(t,) for t in terms], "term string").select("term", F.pmod(F.crc32("term"), F.lit(BUCKETS)).cast("int").alias("bucket")))
        found = spark.read.parquet(self.postings).join(wanted, ["bucket", "term"], "left_semi").join(live.select("doc_id", "segment"), ["doc_id", "segment"], "left_semi")
        # A note with the whole phrase has all of its terms, but for those at the ends, which may be parts of words there.
        of = [(i, t, p, len(ts)) for i, q in asked if len(p := normalized(q)) > PHRASE for ts in [set(search_terms(q))] for t in ts]
        parts = F.broadcast(spark.createDataFrame(of, "query_id long, term string, phrase string, n int"))
        near = found.join(parts, "term").groupBy("query_id", "doc_id").agg(F.count("*").alias("c"), F.first("n").alias("n"), F.first("phrase").alias("phrase")).where(F.col("c") >= F.col("n") - 2)
        held = near.join(live.select("doc_id", "segment"), "doc_id").join(spark.read.parquet(self.notes).select("doc_id", "segment", "plain"), ["doc_id", "segment"]).where(F.contains("plain", "phrase"))
        hits = held.select(F.lit(2).alias("kind"), "doc_id", F.lit(None).cast("string").alias("term"), F.col("query_id").alias("tf"), F.lit(0).cast("long").alias("dl"))
        stats = live.agg(F.count("*").alias("tf"), F.sum("dl").alias("dl")).select(F.lit(1).alias("kind"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("term"), "tf", "dl")
        scan = found.select(F.lit(0).alias("kind"), "doc_id", "term", "tf", "dl").unionByName(stats).unionByName(hits)
        return bm25(scan, queries, query_text)
