"""Whole ranked lists made in tasks are those of the joined and sorted pairs."""

import pyarrow as pa
from quillmesh.functions.encode import encoded
from quillmesh.operators import ranking as K
from quillmesh.operators import retrieval as R
from quillmesh.plans import dialogue as D
from quillmesh.plans import search as S
from pyspark.sql import functions as F

WORDS = "plum harbor kettle morning violin garden ticket marble".split()


def inputs(spark):
    docs = [(i, " ".join(WORDS[(i * k) % 8] for k in range(1, 3 + i % 7)), None) for i in range(1, 90)]
    docs = spark.createDataFrame(docs, "doc_id long, title string, body string")
    queries = spark.createDataFrame([(10, "plum harbor"), (20, "kettle morning violin"), (30, "nothing here"), (40, "marble marble ticket")], "query_id long, q string")
    near = spark.createDataFrame([(10, 500, 0.4), (10, 3, 0.9), (10, 4, 0.9), (20, 88, 0.5), (70, 5, 0.35), (70, 2, 0.6)], "query_id long, doc_id long, score double")
    return docs, queries, near


def test_fused_lists_are_the_shuffled_ones(spark, monkeypatch):
    docs, queries, near = inputs(spark)
    want = {tuple(r) for r in R.fuse({"dense": near, "keyword": R.bm25(R.keyword_scan(docs, F.col("title"), queries), queries)}).select("query_id", "doc_id", "rank").collect()}
    assert len(want) > 50
    for held, least in ((60_000_000, 32), (1, 1)):
        monkeypatch.setattr(K, "HELD", held), monkeypatch.setattr(K, "LEAST", least)
        blocks = list(R.keyword_blocks(docs, F.col("title"), queries))
        assert {tuple(r) for r in K.fused_lists(blocks, near).collect()} == want
        parts = K.fused_lists(blocks, near, until=7), K.fused_lists(blocks, near, after=7)
        assert {tuple(r) for x in parts for r in x.collect()} == want
        assert all(r[2] <= 7 for r in parts[0].collect()) and all(r[2] > 7 for r in parts[1].collect())


def test_blocks_are_tasks_of_their_own(spark, monkeypatch):
    docs, queries, near = inputs(spark)
    monkeypatch.setattr(K, "HELD", 1)
    blocks = list(R.keyword_blocks(docs, F.col("title"), queries))
    assert K.fused_lists(blocks, near).rdd.getNumPartitions() >= 5


def test_reranked_search_shuffles_no_ranked_pair(spark, tmp_path, capsys):
    docs, _, _ = inputs(spark)
    (docs.union(docs.select(F.col("doc_id") + 99, "title", "body"))).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, [1.0, 0.0]), (100, [1.0, 0.1])], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    out = S.reranked_search(spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 1  # the first 50 alone
    rows = out.collect()
    assert sorted(r["place"] for r in rows) == list(range(1, len(rows) + 1)) and len({r["doc_id"] for r in rows}) == len(rows) > 50


def test_ladder_is_that_of_the_shuffled_pairs(spark, monkeypatch):
    docs, queries, near = inputs(spark)
    tags = {i: {i % 4, i % 7} for i in range(1, 95)}
    names = {i: [i % 3] for i in range(1, 95, 2)}
    vectors = {i: [[(i * k) % 5 - 2.0, (i + k) % 3 - 1.0, i % 2 + 0.5] for k in range(1, 2 + i % 3)] for i in range(1, 90)}
    asked = {10: [1.0, 0.2, 0.1], 20: [-1.0, 1.0, 0.0], 30: None, 40: [0.3, 0.3, 2.0], 70: None}
    each = {q: {"tag": min(tags[q]), "names": names.get(q - 1, []), "vector": v} for q, v in asked.items()}
    # The chunks of a note need not follow one another.
    rows = sorted(((i, k, v) for i, vs in vectors.items() for k, v in enumerate(vs)), key=lambda x: (x[0] % 5 and x[1], x))
    chunks = spark.createDataFrame(rows, "doc_id long, chunk_index int, embedding array<double>").coalesce(1)
    by_list = lambda d: spark.createDataFrame([(i, sorted(xs)) for i, xs in d.items()], "doc_id long, numbers array<int>")
    named = spark.createDataFrame([(q, i, 1.0) for q, e in each.items() for i, xs in names.items() if set(xs) & set(e["names"])], "query_id long, doc_id long, score double")
    vector = spark.createDataFrame([(q, v) for q, v in asked.items() if v], "query_id long, embedding array<double>")
    lists = {"a": near, "b": R.bm25(R.keyword_scan(docs, F.col("title"), queries), queries), "c": named, "d": R.search_chunks(chunks, vector, 0.2)}
    for held in (60_000_000, 1):
        monkeypatch.setattr(K, "HELD", held), monkeypatch.setattr(K, "ADDED", 60 if held == 1 else 20_000)
        found = K.ladder(list(R.keyword_blocks(docs, F.col("title"), queries)), near, by_list(names), K.packed(K.signal_rows(K.CHUNK, chunks, x="embedding")), by_list(tags), each, 0.2, 89, 5).collect()
        for rung in range(1, 5):
            want = set()
            for q in asked:
                run = {r["rank"]: r["doc_id"] for r in R.fuse({k: lists[k] for k in "abcd"[:rung]}).where(F.col("query_id") == q).collect()}
                rel = {r for r, doc in run.items() if doc != q and each[q]["tag"] in tags.get(doc, ())}
                shown = {r for r in run if r <= 5} | ({min(rel)} if rel else set()) if not any(r <= 5 for r in rel) else {r for r in run if r <= 5}
                want |= {(q, rung, run[r], r, r in rel) for r in shown}
            assert {tuple(r) for r in found if r["rung"] == rung} == want and want


def test_signal_ladder_shuffles_no_ranked_pair(spark):
    plan = D.QUERIES["signal_ladder"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") <= 1  # the first 20 alone


def test_packed_vectors_are_the_encoded_ones(spark):
    texts = spark.createDataFrame([(i, WORDS[i % 8] + " " + WORDS[i % 3] if i % 9 else None) for i in range(1, 30)], "doc_id long, t string")
    rows = [x for r in K.packed_vectors(texts, F.col("t")).collect() for b in pa.ipc.open_stream(bytes(r["rows"])) for x in b.to_pylist()]
    assert {(r["kind"], r["doc_id"], tuple(r["x"])) for r in rows} == {(K.CHUNK, r["doc_id"], tuple(r["embedding"])) for r in encoded(texts, F.col("t")).collect()}
