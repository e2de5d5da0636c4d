import json
import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillmesh.functions import text as T
from quillmesh.functions import vectors as X
from quillmesh.operators import chat, entities, evaluation, graph, ingest, proposals, retrieval, tagging, tags
from quillmesh.sources import notes
from quillmesh.streaming import limiter


def one(spark, expr, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(expr).first()[0]


@pytest.mark.parametrize(
    ("raw", "clean"),
    [("---\ntags: x\n---\nbody", "body"), ("a\n---\nb\n---\n", "a --- b ---"), ("x ```code``` y", "x y"), ("see [t](http://u.v) at https://a.b/c now", "see t at now"), ("**b** _i_\xa0\n# h", "b i h"), ("", "")],
)
def test_clean_note(spark, raw, clean):
    assert one(spark, T.clean_note(F.col("t")), t=raw) == clean


@pytest.mark.parametrize(("word", "stem"), [("wars", "war"), ("mixing", "mix"), ("glass", "glass"), ("ring", "ring"), ("naïves", "naïves"), ("boxes", "box"), ("used", "used"), ("things", "thing")])
def test_stem(spark, word, stem):
    assert one(spark, T.stem(F.col("w")), w=word) == stem


def test_multilingual_terms_and_normalisation(spark):
    assert one(spark, T.normalize(F.col("t")), t="Naïve Й ﬁ Ａ") == "naive и fi a"
    assert one(spark, T.multilingual_terms(F.col("t")), t="漢字仮 x yz 語 Naïve abc漢") == ["漢字", "字仮", "yz", "語", "naive", "abc", "漢"]
    assert T.search_terms("ไทย") == ["ไท", "ทย"] and T.search_terms(None) == [] and T.normalized("Ελλάς") == "ελλας"


def test_citations_claims_and_titles(spark):
    assert one(spark, T.cited_numbers(F.col("t")), t="a [Note #2] b [Note #1, #4] c [Note #2]") == [2, 1, 4]
    assert one(spark, T.strip_invalid_citations(F.col("t"), F.lit(2)), t="x [Note #0] y [Note #2] z [Note #9]") == "x  y [Note #2] z "
    said = "# Header line that is long\nShort. A claim of more than fifteen characters.\n- **The second one** stands here. [Note #3, #1] A third claim [Note #2] follows it."
    assert [tuple(c) for c in one(spark, T.claims(F.col("t")), t=said)] == [("A claim of more than fifteen characters.", None), ("The second one** stands here.", None), ("A third claim  follows it.", 3)]
    assert one(spark, T.claim_context(F.col("t"), F.lit(3)), t=said) == "A third claim  follows it." and one(spark, T.claim_context(F.col("t"), F.lit(9)), t=said) is None
    assert one(spark, T.strip_type_prefix(F.col("t")), t=" P: plan") == "plan"
    assert one(spark, T.highlight(F.col("t"), F.lit("b.c")), t="<a> B.C bxc") == "&lt;a&gt; <mark>B.C</mark> bxc"
    assert one(spark, T.tag_name(F.col("t")), t='```json\n{"tag": "home and garden tools"}\n``` and more') == "Home And Garden"
    assert [one(spark, T.tag_name(F.col("t")), t=x) for x in ("home_improvement", "a+b", "", "Дом, сад!")] == ["Home_Improvement", None, None, "Дом Сад"]


def test_vectors(spark):
    row = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], [4.0, 3.0])], "a array<float>, z array<float>, b array<float>")
    got = row.select(X.norm(F.col("a")), X.cosine(F.col("a"), F.col("z")), X.cosine(F.col("a"), F.col("b")), X.unit(F.col("z"))).first()
    assert got[0] == 5 and got[1] == 0 and math.isclose(got[2], 0.96) and list(got[3]) == [0, 0]


def test_change_set_rules(spark):
    s = "id string, content_hash string, deleted_at timestamp"
    old = spark.createDataFrame([("same", "1", None), ("edit", "1", None), ("gone", "1", None), ("back", "1", datetime(2024, 1, 1)), ("edited_back", "1", datetime(2024, 1, 1)), ("stays_gone", "1", datetime(2024, 1, 1))], s)
    new = spark.createDataFrame([("same", "1", None), ("edit", "2", None), ("back", "1", None), ("edited_back", "2", None), ("new", "1", None)], s)
    got = {r.id: (r.change_type, r.restored) for r in ingest.change_set(new, old).collect()}
    assert got == {"same": ("unchanged", False), "edit": ("updated", False), "gone": ("removed", False), "back": ("added", True), "edited_back": ("updated", False), "new": ("added", False)}
    after = ingest.apply_snapshot(new, old, datetime(2024, 6, 1))
    again = ingest.change_counts(ingest.change_set(new, after)).first()
    assert (again.added, again.updated, again.removed, again.unchanged) == (0, 0, 0, 5)
    assert {r.id for r in after.collect() if r.deleted_at} == {"gone", "stays_gone"}
    prints = [ingest.fingerprint(x, "i").first().fingerprint for x in (new, new.repartition(3), old)]
    assert prints[0] == prints[1] != prints[2]


def test_tag_algebra(spark):
    rows = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (2, "a", 0), (3, "c", 0)], "doc_id long, tag string, pos int")
    as_set = lambda df: {(r.doc_id, r.tag, r.pos) for r in df.collect()}
    assert as_set(tags.rename_tag(rows, "a", "b")) == {(1, "b", 1), (2, "b", 0), (3, "c", 0)}
    assert as_set(tags.rename_tag(rows, "c", "c")) == as_set(rows)
    ids = spark.createDataFrame([(1,), (4,), (4,)], "doc_id long")
    assert as_set(tags.add_tag(rows, ids, "z")) - as_set(rows) == {(1, "z", 2), (4, "z", 0)}
    assert as_set(tags.remove_tag(rows, "a", ids)) == as_set(rows) - {(1, "a", 0)}
    assert as_set(tags.set_tags(rows, 1, ["q", "q", "r"])) == {(1, "q", 0), (1, "r", 1), (2, "a", 0), (3, "c", 0)}
    docs = spark.createDataFrame([(1, ["a", " n ", ""], None), (5, None, None)], "doc_id long, labels array<string>, deleted_at timestamp")
    seeded = tags.seed_from_labels(docs, rows)
    assert as_set(seeded) - as_set(rows) == {(1, "n", 2)} and as_set(tags.seed_from_labels(docs, seeded)) == as_set(seeded)
    known = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    none = dict.fromkeys(("tag_name", "new_name", "note_ids", "source_tag", "target_tag", "note_id", "tag"))
    acts = [{"action": "merge", "tag_name": "a", "note_ids": [3, 9]}, {"action": "rename", "tag_name": "x", "new_name": "c", "note_ids": [2]}, {"action": "merge_tags", "source_tag": "c", "target_tag": "d"}, {"action": "merge_tags", "source_tag": "none", "target_tag": "e"}, {"action": "merge_tags", "source_tag": "d", "target_tag": "a"}, {"action": "assign_tag", "note_id": 1, "tag": "z"}]
    table = spark.createDataFrame([(i, *({**none, **a}[c] for c in ("action", *none))) for i, a in enumerate(acts)], proposals.ACTIONS)
    assert as_set(proposals.apply_actions(rows, known, table)) == {(1, "a", 0), (1, "b", 1), (1, "z", 2), (2, "a", 0), (3, "a", 1)}
    assert as_set(proposals.apply_actions(rows, known, table.limit(0))) == as_set(rows)
    assert tags.coverage(docs.limit(0), rows).first().total == 0


def brute_bm25(corpus, query):
    tf = {d: (w := t.split(), {x: w.count(x) for x in w}) for d, t in corpus.items()}
    n, avg = len(tf), sum(len(w) for w, _ in tf.values()) / len(tf)
    df = {x: sum(x in c for _, c in tf.values()) for x in query}
    use = [x for x in query if df[x] <= n / 2] or query
    score = {d: sum(math.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * c.get(x, 0) * 2.5 / (c.get(x, 0) + 1.5 * (0.25 + 0.75 * max(1, len(w)) / avg)) for x in use) for d, (w, c) in tf.items()}
    return {d: s for d, s in score.items() if s > 0}


def test_bm25_against_brute_force(spark):
    rng = random.Random(1)
    vocabulary = [f"zq{i}" for i in range(30)]
    corpus = {i: " ".join(rng.choice(vocabulary[: rng.randrange(2, 30)]) for _ in range(rng.randrange(0, 40))) for i in range(80)}
    docs = spark.createDataFrame(list(corpus.items()), "doc_id long, text string")
    queries = [[rng.choice(vocabulary) for _ in range(rng.randrange(1, 5))] for _ in range(12)] + [["zq0"], ["nothing", "zq0"], ["zq3", "zq3"]]
    q = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(queries)], "query_id long, q string")
    got = retrieval.bm25(retrieval.keyword_scan(docs, F.col("text"), q), q).collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, {})[r.doc_id] = r.score
    for i, x in enumerate(queries):
        want = brute_bm25(corpus, x)
        assert found.get(i, {}).keys() == want.keys()
        bonus = {d: 1.6 if len(" ".join(x)) > 6 and " ".join(x) in corpus[d] else 1 for d in want}
        assert all(math.isclose(found[i][d], s * bonus[d], rel_tol=1e-9) for d, s in want.items())
    assert retrieval.bm25(retrieval.keyword_scan(docs.limit(0), F.col("text"), q), q).count() == 0


def test_phrases_and_accents_in_search(spark):
    docs = spark.createDataFrame([(1, "A naïve garden plan for all"), (2, "the plan of a garden, naive"), (3, None), (4, "ungarden planner")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "Naive Gardén  "), (2, "garden plan"), (3, "x"), (4, None)], "query_id long, q string")
    got = {(r.query_id, r.doc_id): r.score for r in retrieval.bm25(retrieval.keyword_scan(docs, F.col("text"), q.withColumn("q", F.trim("q"))), q).collect()}
    assert got.keys() == {(1, 1), (1, 2), (2, 1), (2, 2)} and got[2, 1] > 1.5 * got[2, 2] and got[1, 1] > 1.5 * got[1, 2]


def test_fusion_order_rerank_and_scope(spark):
    s = "query_id long, doc_id long, score double"
    a = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.8)], s)
    b = spark.createDataFrame([(1, 12, 5.0), (1, 11, 4.0)], s)
    fused = retrieval.fuse({"dense": a, "keyword": b})
    assert [r.doc_id for r in fused.orderBy("rank").collect()] == [11, 10, 12]
    new = spark.createDataFrame([(1, 12, 0.7), (1, 10, 0.1)], "query_id long, doc_id long, new_score double")
    assert [r.doc_id for r in retrieval.rerank(fused, new, window=2).orderBy("place").collect()] == [10, 11, 12]
    assert retrieval.rerank(fused, new, window=2, tail=False).count() == 2
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0])], "doc_id long, embedding array<float>")
    q = v.where("doc_id = 1").select(F.col("doc_id").alias("query_id"), "embedding")
    assert [(r.doc_id, r.score) for r in retrieval.dense(v, q, 2, keep_self=False).collect()] == [(3, 0.707107), (2, 0.0)]
    assert retrieval.dense(v, q, 5, threshold=0.3).count() == 2 and retrieval.dense(v, q.limit(0), 5).count() == 0


def test_chunks(spark):
    long = "\n\n".join(["p" * 90] * 5 + ["x" * 1450] + ["tail"])
    docs = spark.createDataFrame([(1, "T", long), (2, "T", "short"), (3, None, None), (4, "", "")], "doc_id long, title string, body string")
    got = {}
    for r in retrieval.chunks(docs).orderBy("chunk_index").collect():
        got.setdefault(r.doc_id, []).append(r.chunk)
    assert got[2] == ["T short"] and 3 not in got and 4 not in got
    assert len(got[1]) == 2 and got[1][0].startswith("T ppp") and got[1][1].endswith("tail")


def test_assignment_rules(spark):
    labels = spark.createDataFrame([(0, 1, [1.0, 0.0, 0.0]), (1, 1, [0.0, 1.0, 0.0]), (2, 1, [0.0, 0.0, 1.0])], "label int, size int, centroid array<double>")
    v = spark.createDataFrame([(1, 0, [0.9, 0.77, 0.7]), (2, 0, [0.46, 0.4, 0.79]), (3, -1, [0.6, 0.55, 0.5]), (4, -1, [0.0, 0.0, 0.0])], "vec_id long, label int, embedding array<double>")
    limits = spark.createDataFrame([(0, 0.5), (1, 0.5), (2, 0.9)], "label int, threshold double")
    assert {(r.vec_id, r.label, r.r) for r in tagging.assign(v, labels, limits).collect()} == {(1, 0, 1), (1, 1, 2), (2, 2, 1), (3, 0, 1), (3, 1, 2)}
    assert {(r.vec_id, r.label, r.r, r.review) for r in tagging.assign_by_centroid(v, labels).collect()} == {(1, 0, 1, True), (2, 0, 1, True), (2, 2, 2, True), (3, 0, 1, True)}
    assert {(r.vec_id, r.label) for r in tagging.nearest_labels(v, labels).collect()} == {(1, 0), (2, 2), (3, 0), (4, 0)}
    assert tagging.own_similarities(v, labels).count() == 2 and tagging.assign(v, labels.limit(0), limits).count() == 0
    assert tagging.cluster_sizing("broad", 1000) == (18, 3) and tagging.cluster_sizing("specific", 10) == (8, 2)
    pairs = spark.createDataFrame([(1, 2, 0.8), (2, 3, 0.9), (4, 1, 0.7)], "a int, b int, sim double")
    assert {(r.a, r.b) for r in tagging.disjoint_pairs(pairs).collect()} == {(2, 3), (4, 1)}
    labels = spark.createDataFrame([(i, 1, [1.0, 0.01 * i]) for i in range(5)], "label int, size int, centroid array<double>")
    assert len(tagging.force_merge(labels, most=2)) == 3
    named = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "label int, name string")
    assert [r.unique_name for r in tagging.number_names(named).orderBy("label").collect()] == ["a", "a 2", "b"]


def test_diverse_representatives_are_chosen_among_all_members(spark):
    angles = [0.2 + i / 5000 if i < 250 else -0.3 - i / 2000 for i in range(300)]
    rows = [(i, 1, [math.cos(x), math.sin(x)]) for i, x in enumerate(angles)]
    vectors = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    centre = [1.0, 0.0]
    labels = spark.createDataFrame([(1, centre)], "label int, centroid array<double>")
    v = {i: x for i, _, x in rows}
    sim = {i: round(sum(a * b for a, b in zip(x, centre)), 6) for i, x in v.items()}
    central = sorted(v, key=lambda i: (-sim[i], i))
    want = central[:4]
    while len(want) < 8:
        far = {i: round(0.5 * sim[i] - 0.5 * max(sum(a * b for a, b in zip(v[i], v[c])) for c in want), 9) for i in v if i not in want}
        want.append(min(far, key=lambda i: (-far[i], central.index(i))))
    assert any(central.index(i) >= 200 for i in want)
    got = tagging.representatives(vectors, labels).orderBy("r").collect()
    assert [r.vec_id for r in got] == want and [r.r for r in got] == list(range(1, 9))


def test_graph_and_entities(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 51)], "a long, b long")
    assert {(r.node, r.root) for r in graph.components(e).collect()} == {(i, 0) for i in range(21)} | {(50, 50), (51, 50)}
    edges = spark.createDataFrame([(1, 2, "tag"), (2, 1, "tag"), (3, 3, "tag"), (2, 1, "similar")], "src long, dst long, kind string")
    assert graph.undirected(edges).count() == 2
    assert math.isclose(T.jaro_winkler("MARTHA", "MARHTA"), 0.961111, abs_tol=1e-6) and T.jaro_winkler("", "a") == 0
    m = spark.createDataFrame([(1, "Martha", "NAME", 1), (2, "Martha", "NAME", 1), (3, "Marhta", "NAME", 1), (4, "Zed", "NAME", 1)], "doc_id long, surface string, label string, n long")
    assert {r.surface: r.canonical for r in entities.aliases(m).collect()} == {"Martha": "Martha", "Marhta": "Martha", "Zed": "Zed"}


@pytest.mark.parametrize("part", [2, 512])
def test_aliases_against_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(entities, "PART", part)
    names = ["Anna", "Annabella Rossi", "Annabel", "Anton", "Anneliese von Hohenburg", "Berta", "Bertram Quillmoor Senior", "Ber"]
    m = spark.createDataFrame([(i, x, "NAME", 1) for i, x in enumerate(names)], "doc_id long, surface string, label string, n long")
    root = {x: x for x in names}
    for a in names:
        for b in names:
            if a[:3] == b[:3] and T.jaro_winkler(a.lower(), b.lower()) >= 0.75:
                root = {x: root[a] if r == root[b] else r for x, r in root.items()}
    want = {x: min(y for y in names if root[y] == root[x]) for x in names}
    assert want["Annabella Rossi"] == "Anna"
    assert {r.surface: r.canonical for r in entities.aliases(m).collect()} == want


def test_metrics(spark):
    runs = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3)], "query_id string, doc_id string, rank int")
    qrels = spark.createDataFrame([("q", "b"), ("q", "x"), ("r", "y")], "query_id string, doc_id string")
    got = evaluation.retrieval_metrics(runs, qrels).first()
    assert (got.queries, got.recall, got.mrr) == (2, 0.25, 0.25) and math.isclose(got.ndcg, (1 / math.log2(3)) / (1 + 1 / math.log2(3)) / 2, abs_tol=1e-6)
    same = spark.createDataFrame([(i % 3, i % 3) for i in range(9)], "true_label int, pred_label int")
    assert tuple(evaluation.cluster_metrics(same).first()) == (1.0, 1.0, 1.0)
    s = "metric string, value double"
    base, now = spark.createDataFrame([("r", 1.0), ("u", 10.0), ("gone", 1.0)], s), spark.createDataFrame([("r", 0.96), ("u", 14.0)], s)
    assert {r.metric: r.regressed for r in evaluation.compare(base, now, absolute={"u": 5.0}).collect()} == {"r": True, "u": False, "gone": True}


def test_chat(spark):
    rows = [(i, "s", i, " User " if i % 2 == 0 else "assistant", t, datetime(2024, 1, 1)) for i, t in enumerate(["  ", "a", "x" * 90, "b", None, "c", "d", "e", "f"])]
    m = chat.messages(spark.createDataFrame(rows + rows[:2], "message_id long, session_id string, turn int, role string, content string, created_at timestamp"))
    assert m.count() == 9 and chat.auto_titles(m).first().title == "x" * 80 + "..."
    recent = chat.recent(m).collect()
    assert len(recent) == 6 and recent[0].older == 3 and recent[0].summarise
    assert chat.sequence_gaps(m.where("turn <> 4")).count() == 1


def test_limiter_boundaries(spark):
    assert limiter.accept([0, 1, 2, 60, 61], 2, 60) == ([True, True, False, True, True], [60, 61])
    t0 = datetime(2024, 1, 1)
    rows = [(i, 7, t0 + timedelta(seconds=s)) for i, s in enumerate([0, 1, 2, 60, 61])]
    got = limiter.limit_batch(spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp"), limit=2, window=60.0)
    assert {r.event_id: r.accepted for r in got.collect()} == {0: True, 1: True, 2: False, 3: True, 4: True}


def test_streams(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [(i, i % 2, "e", 1.0, t0 + timedelta(minutes=i)) for i in range(10)]
    schema = "event_id long, user_id long, event_type string, value double, ts timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    got = {}

    def run():
        q = limiter.limit_stream(stream, limit=3, window=3600.0).writeStream.foreachBatch(lambda df, _: got.update({r.event_id: r.accepted for r in df.collect()}))
        assert q.option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination(60)

    run()
    assert sum(got.values()) == 6 and len(got) == 10
    later = [(10 + i, i % 2, "e", 1.0, t0 + timedelta(minutes=50 + 3 * i)) for i in range(10)]
    spark.createDataFrame(later, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()  # goes on from the first run's state
    whole = {r.event_id: r.accepted for r in limiter.limit_batch(spark.createDataFrame(rows + later, schema), limit=3, window=3600.0).collect()}
    assert got == whole and len(got) == 20
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
    seen = []
    q = limiter.import_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")).selectExpr("cast(event_id as string) id", "event_type content_hash"),
                              lambda: spark.createDataFrame([], "id string, content_hash string, deleted_at timestamp"),
                              lambda nxt, changes: seen.append(changes.count()), t0).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert seen == [10]


def test_importers(spark, tmp_path):
    keep = tmp_path / "keep"
    keep.mkdir()
    note = {"title": "T", "textContent": "text", "listContent": [{"text": "a", "isChecked": True}, {"text": "b", "isChecked": False}], "createdTimestampUsec": 1_700_000_000_000_000, "userEditedTimestampUsec": 0, "labels": [{"name": " x "}], "attachments": [{"filePath": "p.png", "mimetype": "image/png"}]}
    for name, value in {"1.json": json.dumps(note, indent=1), "2.json": "{broken", "3.json": "[1]", "4.json": json.dumps({**note, "isTrashed": True}), "5.json": json.dumps({"other": 1})}.items():
        (keep / name).write_text(value)
    docs, skips = notes.split_scan(notes.importer("keep")(spark, str(keep)))
    assert {r.path: r.reason for r in skips.collect()} == {"2.json": "malformed", "3.json": "not-a-note", "4.json": "trashed"}
    d = docs.orderBy("external_id").first()
    assert docs.count() == 2 and notes.front_matter_tags("tag: a; b,'c'\ntags:\n  - x y\n\t-z\n\n  - lost\nTags: no") == ["a", "b", "c", "x y", "z"]
    assert (d.body, d.labels, d.attachments[0].path, d.edited_at) == ("text\n- [x] a\n- [ ] b", ["x"], "p.png", None) and d.created_at is not None
    vault = tmp_path / "vault" / "sub"
    vault.mkdir(parents=True)
    (vault / "a.md").write_text("---\ntags:\n  - one\n  - Two\n---\n# Head line\ntext #two #three. end")
    (vault / "b.markdown").write_text("no heading")
    (vault / "c.md").write_text(" \n")
    (vault / "d.md").write_bytes(b"\xff\xfe\xfa")
    docs, skips = notes.split_scan(notes.importer("markdown")(spark, str(tmp_path / "vault")))
    got = {r.external_id: (r.title, r.labels) for r in docs.collect()}
    assert got == {"sub/a.md": ("Head line", ["one", "Two", "three."]), "sub/b.markdown": ("b", [])}
    assert {r.path: r.reason for r in skips.collect()} == {"sub/c.md": "empty", "sub/d.md": "unreadable"}
    assert notes.detect(str(keep)) == "keep" and notes.detect(str(tmp_path / "vault")) == "markdown"
    with pytest.raises(KeyError):
        notes.importer("none")


def test_registry_matches_sql():
    from quillmesh.plans import catalog

    assert catalog.oracle_sql().keys() <= catalog.queries().keys() and catalog.FLAGSHIP in catalog.queries()


def test_keyword_scores_and_ranks_where_the_documents_are(spark):
    rng = random.Random(4)
    vocabulary = [f"wörd{i}" for i in range(25)]
    corpus = [(i, " ".join(rng.choice(vocabulary[: rng.randrange(2, 25)]) for _ in range(rng.randrange(0, 30)))) for i in range(90)] + [(90, None), (91, "un" + vocabulary[3] + " " + vocabulary[4] + "s")]
    docs = spark.createDataFrame(corpus, "doc_id long, text string")
    q = spark.createDataFrame([(100 + i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 4)))) for i in range(14)] + [(114, "wörd3 wörd4"), (115, "none"), (116, None), (117, "")], "query_id long, q string")
    want = {(r.query_id, r.doc_id): r.score for r in retrieval.bm25(retrieval.keyword_scan(docs, F.col("text"), q), q).collect()}
    before = retrieval.CELLS, retrieval.ASKED
    also = spark.createDataFrame([(q, d) for q in range(98, 118) for d in range(q % 3, 92, 13)], "query_id long, doc_id long")
    dense = spark.createDataFrame([(r.query_id, r.doc_id, 1 / (1 + r.doc_id)) for r in also.collect()], "query_id long, doc_id long, score double")
    ranks = {}
    for query in {k for k, _ in want}:
        for r, (_, d) in enumerate(sorted((-round(s, 6), d) for (k, d), s in want.items() if k == query), 1):
            ranks[query, d] = r
    named = {tuple(r) for r in also.collect()}
    try:
        for retrieval.CELLS, retrieval.ASKED in ((50, 5), before):
            blocks = list(retrieval.keyword_blocks(docs, F.col("text"), q))
            scores = retrieval.keyword_scores(blocks, spark)
            got = {(r.query_id, r.doc_id): r.score for r in scores.collect()}
            assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want) and len(want) > 200
            first = retrieval.keyword_ranks(blocks, also, 3)
            assert {(r.query_id, r.doc_id): r.r for r in first.collect()} == {k: r for k, r in ranks.items() if r <= 3 or k in named}
            whole, head = retrieval.fuse({"dense": dense, "keyword": scores}), retrieval.fuse_ranks({"dense": retrieval.ranked(dense), "keyword": first})
            assert {tuple(r) for r in whole.where("rank <= 3").collect()} == {tuple(r) for r in head.where("rank <= 3").collect()}
            assert "Exchange" not in scores._jdf.queryExecution().executedPlan().toString()
    finally:
        retrieval.CELLS, retrieval.ASKED = before
    assert retrieval.keyword_scores(retrieval.keyword_blocks(docs.limit(0), F.col("text"), q), spark).count() == 0
