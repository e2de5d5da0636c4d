import json
import math
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmesh.functions import encode
from quillmesh.functions import text as T
from quillmesh.operators import answers, dialogue, entities, evaluation, proposals, retrieval, store, tagging, views
from quillmesh.sources import artifacts, index
from quillmesh.streaming import frames


def test_json_artifacts(spark, tmp_path):
    path = str(tmp_path / "tags.json")
    assert artifacts.load_tag_map(path) == {}
    artifacts.write_json(path, {"a": "x", "b": ["y", "y", "z"]})
    assert artifacts.load_tag_map(path) == {"a": ["x"], "b": ["y", "y", "z"]} and artifacts.read_json(path)["a"] == ["x"] and artifacts.read_json(path + ".bak")["a"] == "x"
    assert {tuple(r) for r in artifacts.tag_map_rows(spark, artifacts.load_tag_map(path)).collect()} == {("a", "x", 0), ("b", "y", 0), ("b", "z", 1)}
    (tmp_path / "broken.json").write_text("{")
    assert artifacts.read_json(str(tmp_path / "broken.json")) == {} and artifacts.load_manifest(spark, str(tmp_path / "broken.json")).count() == 0
    with pytest.raises(TypeError):
        artifacts.write_json(path, {"a": object()})
    assert artifacts.read_json(path)["a"] == ["x"] and len(list(tmp_path.iterdir())) == 3
    labels = spark.createDataFrame([(1, "one", 5, [1.0, 0.0])], "label int, tag string, size long, centroid array<double>")
    manifest = str(tmp_path / "manifest.json")
    artifacts.save_manifest(manifest, labels)
    artifacts.write_json(manifest, {"clusters": {**artifacts.read_json(manifest)["clusters"], "2": {"tag": "", "centroid": [1]}, "3": {"tag": "t", "centroid": ["a"]}, "4": 7}})
    assert [tuple(r) for r in artifacts.load_manifest(spark, manifest).collect()] == [(0, "one", [1.0, 0.0])]
    artifacts.clear(manifest), artifacts.clear(manifest)
    assert artifacts.load_manifest(spark, manifest).count() == 0


def test_pending_proposals_keep_their_actions(tmp_path):
    p = artifacts.PendingProposals(str(tmp_path / "p.json"))
    p.save([])
    assert p.load() is None
    p.stage({"a": "approve", None: "x"})
    assert p.load() is None and p.actions() == {"a": "approve"}
    p.save([{"tag": "a"}], "broad")
    p.save([{"tag": "a"}, {"tag": "b"}])
    assert p.actions() == {"a": "approve"} and len(p.load()["proposals"]) == 2
    p.clear()
    assert p.load() is None and p.actions() == {}


def test_sessions(spark, tmp_path):
    s = artifacts.Sessions(str(tmp_path / "chats"))
    assert s.summaries(spark).count() == 0
    one = s.create()
    s.save_messages(one["id"], [{"role": "user", "content": " "}, {"role": "user", "content": "x" * 90}])
    assert s.load(one["id"])["title"] == "x" * 80 + "..." and s.load("none") is None
    two = s.create("Named")
    s.rename(two["id"], "Other")
    got = s.summaries(spark).collect()
    assert [(r.title, r.n_messages) for r in got if r.id == one["id"]] == [("x" * 80 + "...", 2)] and {r.title for r in got} == {"x" * 80 + "...", "Other"}
    assert s.delete(two["id"]) and not s.delete(two["id"])
    for bad in ("", "../x", ".hidden"):
        with pytest.raises(ValueError):
            s.load(bad)
    with pytest.raises(KeyError):
        s.rename("none", "x")


def test_vector_cache_encodes_once(spark, tmp_path):
    cache = artifacts.VectorCache(str(tmp_path / "vectors"))
    calls = []

    def by_length(new):
        calls.append({r["key"] for r in new.collect()})
        return new.select("key", F.array(F.length("text").cast("double")).alias("embedding"))

    texts = lambda *rows: spark.createDataFrame(list(rows), "key string, text string")
    assert cache.fill(texts(("a", "x"), ("a", "x"), ("b", "yy"), (None, "z")), by_length).count() == 2
    got = cache.fill(texts(("b", "other"), ("c", "zzz")), by_length)
    assert calls == [{"a", "b"}, {"c"}] and {(r.key, r.embedding[0]) for r in got.collect()} == {("b", 2.0), ("c", 3.0)}
    cache.compact(spark, texts(("c", None)))
    assert [r.key for r in cache.read(spark).collect()] == ["c"]
    spark.createDataFrame([(1, 99)], "x int, schema_version int").write.parquet(str(tmp_path / "later"))
    with pytest.raises(ValueError):
        artifacts.read_table(spark, str(tmp_path / "later"))


def test_images_and_corpora(spark, tmp_path):
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "a.jpg").write_bytes(b"pixels")
    found, missing = artifacts.image_files(spark, str(tmp_path), spark.createDataFrame([("img/a.jpg",), ("img/b.jpg",)], "path string"))
    assert [(r.path, bytes(r.content)) for r in found.collect()] == [("img/a.jpg", b"pixels")] and [r.path for r in missing.collect()] == ["img/b.jpg"]
    assert artifacts.CORPORA["newsgroups"](spark, str(tmp_path / "none"))[0] is None and "markdown_vault" in artifacts.CORPORA["markdown_vault"](spark, "x")[1]
    group = tmp_path / "news" / "sci.space"
    group.mkdir(parents=True)
    (group / "1").write_text("From: a\nSubject: b\n\n> quoted\nThe text.\n-- \nsignature\n")
    docs, why = artifacts.CORPORA["newsgroups"](spark, str(tmp_path / "news"))
    assert why is None and [(r.label, r.text) for r in docs.collect()] == [("sci.space", "The text.")]


def test_frames_and_their_gaps():
    lines = list(frames.numbered([("phase", {"phase": "search", "detail": ""}), ("delta", {"content": "é"}), ("done", {"citations": [], "full_response": "x"}), ("error", {"message": "m"})]))
    assert json.loads(lines[0]) == {"type": "phase", "phase": "search", "seq": 1} and "é".encode() in lines[1] and frames.gaps(lines) == []
    assert frames.gaps([lines[0], b'{"type": "x"}', lines[2]]) == [(2, 3)]
    for kind, values in (("delta", {}), ("delta", {"content": "x", "more": 1})):
        with pytest.raises(ValueError):
            frames.frame(kind, **values)


def test_proposals_are_kept_as_they_pass():
    closed, saved = [], []

    def source():
        try:
            yield b"no frame\n"
            for i in range(12):
                yield json.dumps({"type": "proposal", "proposal": {"i": i}}).encode()
            yield json.dumps({"type": "label_updates", "proposals": [{"i": 99}]}).encode()
        finally:
            closed.append(True)

    assert len(list(frames.persisting(source(), saved.append))) == 14
    assert [len(x) for x in saved] == [5, 10, 1] and saved[-1] == [{"i": 99}] and closed
    stream = frames.persisting(source(), saved.append)
    next(stream), stream.close()
    assert len(closed) == 2


def test_logs_hold_no_text():
    class Refused(Exception):
        status_code = "429"

    assert frames.described(Refused("secret note")) == "Refused(status=429)" and frames.described(KeyError("secret")) == "KeyError"
    assert frames.log_line(n=3, t=0.12345, s="x" * 50) == f"n=3 t=0.123 s='{'x' * 40}'+10"


def test_model_loops():
    assert dialogue.decompose("short one", lambda q: "never") == ["short one"]
    assert dialogue.decompose("what changed", lambda q: "1. a\n- b\n\n* c\nd") == ["a", "b", "c"]
    assert dialogue.decompose("what changed", lambda q: 1 / 0) == ["what changed"] and dialogue.decompose("what changed", lambda q: " ") == ["what changed"]
    notes = [{"id": 1}]
    said = iter(["MISSING: dates", "missing: more", "SUFFICIENT"])
    got = dialogue.fill_gaps("q", notes, lambda q, n: next(said), lambda what, k: [{"id": 1}, {"id": what}])
    assert [n["id"] for n in got[0]] == [1, "dates", "more"] and got[1] == "best_effort"
    assert dialogue.fill_gaps("q", [], None, None) == ([], "sufficient") and dialogue.fill_gaps("q", notes, lambda q, n: "SUFFICIENT", None)[1] == "sufficient"
    assert dialogue.fill_gaps("q", notes, lambda q, n: "MISSING: x", lambda w, k: notes) == (notes, "best_effort")
    assert dialogue.checked_queries([" A ", "a", "", "b"]) == ["A", "b"]
    for bad in ([], ["  "], ["x" * 501], list("abcdef")):
        with pytest.raises(ValueError):
            dialogue.checked_queries(bad)
    assert dialogue.merge_pairs({"merges": [{"into": "```\nA\n```", "from": ["b", "A", ""]}, {"into": "", "from": ["c"]}, 5]}) == [("b", "A")] and dialogue.merge_pairs(None) == []
    assert dialogue.commit_merges([("a", "b")], lambda p: 1 / 0, approval=True) == ([], [("a", "b")])
    assert dialogue.summary([], None) is None and dialogue.summary([{"role": "user", "content": "x"}], lambda t: f" {t} ") == "user: x"


def test_search_led_by_a_model():
    v = np.array([1.0, 0.0])
    pool = [{"id": i, "vector": np.array([0.6, 0.8])} for i in range(10)]
    tools = {"search_notes": lambda qs: pool[: 2 * len(qs)]}
    asked = iter([{"tool": "search_notes", "queries": ["a"]}, {"tool": "search_notes", "queries": ["a", "b", "B"]}])
    *steps, end = dialogue.gather(v, lambda notes: next(asked), tools)
    assert [(s["found"], s["fresh"], s["stop"]) for s in steps] == [(2, 2, False), (4, 2, True)] and len(end["notes"]) == 4 and end["reason"] == "collected notes match query well"
    assert list(dialogue.gather(v, lambda n: None, tools)) == [{"notes": [], "reason": "done"}]
    assert next(dialogue.gather(v, lambda n: {"tool": "rm", "queries": ["x"]}, tools))["reason"] == "no such tool"
    assert dialogue.enough(v, [v] * 3, 9, 1, 1) == (True, "searches returning mostly duplicates") and dialogue.enough(-v, [v] * 3, 3, 3, 1)[0] is False


def test_cancelled_streams_interrupt_their_jobs(spark):
    def stream():
        with dialogue.cancellable(spark, "t-1"):
            yield spark.range(3).count()
            yield spark.range(4).count()

    s = stream()
    assert next(s) == 3
    s.close()
    assert "t-1" not in spark.getTags() and list(stream()) == [3, 4]


def test_store_rules(spark):
    v = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.0])], "content_hash string, embedding array<double>")
    new = spark.createDataFrame([("b", [5.0, 6.0]), ("c", [7.0, 8.0])], "content_hash string, embedding array<double>")
    assert {(r.content_hash, r.embedding[0]) for r in store.upsert_vectors(v, new, 2).collect()} == {("a", 1.0), ("b", 5.0), ("c", 7.0)}
    with pytest.raises(Exception, match="has not 3 dimensions"):
        store.upsert_vectors(v, new, 3).collect()
    docs = spark.createDataFrame([("k:1", "1", 1, None), ("k:2", "k:1", 2, None), ("k:3", None, 3, None), ("k:4", "1", 4, None)], "id string, external_id string, doc_id long, deleted_at timestamp")
    asked = spark.createDataFrame([("k:1",), ("1",), ("x",), (None,)], "asked string")
    assert {tuple(r) for r in store.resolve_ids(docs, asked).collect()} == {("k:1", "k:1"), ("1", "k:1")}
    rows = spark.createDataFrame([(1, "i", "t", "b", "[broken", "2020-01-01T00:00:00.000000", "no time")], "doc_id long, id string, title string, body string, labels string, created_at string, edited_at string")
    back = store.from_rows(rows).first()
    assert back.labels == [] and back.created_at == datetime(2020, 1, 1) and back.edited_at is None
    wrote = []
    s = "id string, content_hash string, deleted_at timestamp"
    old, now = spark.createDataFrame([("a", "1", None)], s), spark.createDataFrame([("a", "2", None), ("b", "1", None)], s)
    assert tuple(store.ingest(now, old).first())[:2] == (1, 1) and tuple(store.ingest(now, old, wrote.append).first())[:2] == (1, 1) and len(wrote) == 1


def test_views(spark):
    d = spark.createDataFrame([(["a", "b"], ["c"])], "i array<string>, e array<string>")
    for tag, side, want in (("a", "include", (["b"], ["c"])), ("c", "include", (["a", "b", "c"], [])), ("a", "exclude", (["b"], ["c", "a"]))):
        assert tuple(map(list, d.select(*views.toggled(F.col("i"), F.col("e"), F.lit(tag), side)).first())) == want
    assert views.scaled(spark.createDataFrame([], "embedding array<float>")).first().n == 0
    counts = spark.createDataFrame([("б", 1), ("B", 2), ("a", 2)], "tag string, n long")
    assert [r.tag for r in views.tag_orders(counts).orderBy("count_desc").collect()] == ["a", "B", "б"]
    assert views.stability(spark.createDataFrame([(1, "a")], "doc_id long, tag string"), spark.createDataFrame([(1, None)], "doc_id long, tag string")).first().uncategorized_pct == 100


def test_answers_of_other_models(spark):
    claims = spark.createDataFrame([(1, 0, "cites the first", 1), (1, 1, "cites none", None), (1, 2, "cites too far", 9), (2, 0, "without context", 1)], "message_id long, claim_no int, text string, cited int")
    notes = spark.createDataFrame([(1, 1, "no"), (1, 2, "yes")], "message_id long, position int, note string")
    model = lambda note, claim: F.when(note == "yes", F.array(F.lit(0.0), F.lit(5.0), F.lit(0.0))).otherwise(F.array(F.lit(5.0), F.lit(0.0), F.lit(0.0)))
    got = {(r.message_id, r.claim_no): r.verdict for r in answers.ground(claims, notes, model).collect()}
    assert got == {(1, 0): "contradicted", (1, 1): "supported", (1, 2): "supported", (2, 0): "unsupported"}
    said = spark.createDataFrame([(1,), (3,)], "message_id long")
    scores = {r.message_id: (r.claims, r.score) for r in answers.grounding_scores(said, answers.ground(claims, notes, model)).collect()}
    assert scores == {1: (3, 0.67), 3: (0, 1.0)}
    many = spark.createDataFrame([("g", i, [1.0, 0.0]) for i in range(26)] + [("h", i, [1.0, 0.0]) for i in range(9)], "group_id string, doc_id long, embedding array<double>")
    assert {r.group_id for r in answers.conflict_pairs(many).collect()} == {"h"} and answers.conflict_pairs(many).count() == 20


def test_encoder_and_first_alike(spark):
    x = encode.encode([["a1", "b2"], [], ["a1", "b2"]])
    assert math.isclose(np.linalg.norm(x[0]), 1) and not x[1].any() and (x[0] == x[2]).all() and encode.dimension() == encode.DIM
    df = encode.encoded(spark.createDataFrame([(1, None), (2, "A1 b2")], "i long, t string"), F.col("t"))
    assert {r.i: len(r.embedding) for r in df.collect()} == {1: 64, 2: 64}
    known = spark.createDataFrame([("Martha", "P", 2), ("Marta", "P", 1), ("Martha", "Q", 0)], "surface string, label string, place long")
    new = spark.createDataFrame([("Marthe", "P"), ("Zed", "P")], "surface string, label string")
    assert {r.surface: r.found for r in entities.first_alike(new, known).collect()} == {"Marthe": "Marta", "Zed": None}


def test_greedy_pairs_against_one_by_one(spark):
    rng = random.Random(6)
    rows = [(a, b, round(rng.random(), 1)) for a in range(12) for b in range(a + 1, 12) if rng.random() < 0.5]
    used, want = set(), set()
    for a, b, s in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if a not in used and b not in used:
            used |= {a, b}
            want.add((a, b))
    pairs = spark.createDataFrame(rows, "a int, b int, sim double")
    assert {(r.a, r.b) for r in tagging.disjoint_pairs(pairs).collect()} == want
    assert tagging.disjoint_pairs(pairs.limit(0)).count() == 0


def test_a_vocabulary_has_a_bound(spark, monkeypatch):
    monkeypatch.setattr(tagging, "LABELS", 2)
    labels = spark.createDataFrame([(i, 1, [1.0]) for i in range(3)], "label int, size int, centroid array<double>")
    with pytest.raises(ValueError):
        tagging.label_pairs(labels, 0.5)


def test_stratified_sample_is_exact(spark):
    rows = spark.createDataFrame([(i, "big" if i % 10 else "small") for i in range(1000)] + [(5000, None)], "doc_id long, source string")
    got = [r.source for r in evaluation.stratified(rows, "source", 100).collect()]
    assert (got.count("big"), got.count("small"), got.count(None)) == (89, 9, 1)


def test_stored_keyword_index(spark, tmp_path):
    rng = random.Random(2)
    vocabulary = ["garden", "gärten", "plan", "naïve", "walls", "walking", "Бележка", "漢字仮名", "x1"]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 12)))) for i in range(60)] + [(99, None)], "doc_id long, text string")
    q = spark.createDataFrame([(1, "garden plan"), (2, "Naive wall"), (3, "бележка 漢字仮"), (4, "nothing"), (5, None)], "query_id long, q string")

    def scores(df):
        return {(r.query_id, r.doc_id): round(r.score, 9) for r in df.collect()}

    ix = index.KeywordIndex(str(tmp_path / "ix"))
    ix.build(docs, F.col("text"))
    assert scores(ix.search(q)) == scores(retrieval.bm25(retrieval.keyword_scan(docs, F.col("text"), q), q)) != {}
    after = docs.where("doc_id % 7 <> 0").withColumn("text", F.when(F.col("doc_id") % 5 == 0, "garden plan of walls").otherwise(F.col("text")))
    changed = after.where("doc_id % 5 = 0").unionByName(spark.createDataFrame([(200, "a naive new note")], "doc_id long, text string"))
    ix.apply(spark, docs.where("doc_id % 7 = 0").select("doc_id"), changed, F.col("text"))
    now = after.where("doc_id % 5 <> 0").unionByName(changed)
    want = scores(retrieval.bm25(retrieval.keyword_scan(now, F.col("text"), q), q))
    assert scores(ix.search(q)) == want
    ix.compact(spark)
    assert scores(ix.search(q)) == want


def test_proposal_rules(spark):
    cards = spark.createDataFrame([(0, "p0", "a", "proposal"), (1, None, "b", "info"), (2, "p2", "c", "proposal")], "position int, proposal_id string, tag_name string, type string")
    said = spark.createDataFrame([("p0", "x", "reject"), (None, "c", "approve")], "proposal_id string, tag_name string, action string")
    got = {r.position: (r.proposal_id, r.action) for r in proposals.decided(cards, said).collect()}
    assert got == {0: ("p0", "reject"), 1: ("restored-1", "pending"), 2: ("p2", "approve")}
    assert proposals.approve_all(proposals.decided(cards, said)).where("action = 'pending'").count() == 1
    assert T.normalized("ÀÉ") == "ae"


def test_an_import_from_files_to_the_next_version(spark, tmp_path):
    """Two folders of notes, imported one after the other: ids and hashes, change set, next version, the exclusion that follows a tag."""
    from quillmesh.operators import ingest, tags
    from quillmesh.sources import notes

    def load(name, files):
        folder = tmp_path / name
        folder.mkdir()
        for f, text in files.items():
            (folder / f).write_text(text)
        docs, _ = notes.split_scan(notes.importer("markdown")(spark, str(folder)))
        return ingest.to_documents(docs, "vault")

    first, second = load("one", {"a.md": "# A\nx", "b.md": "b", "c.md": "c"}), load("two", {"a.md": "# A\nx", "b.md": "b2", "d.md": "d"})
    assert {r.id.split(":")[0] for r in first.collect()} == {"vault"} and first.select("id").distinct().count() == 3
    assert tuple(ingest.change_counts(ingest.change_set(second, first)).first()) == (1, 1, 1, 1, 0)
    after = ingest.apply_snapshot(second, first, datetime(2024, 6, 1))
    assert after.where("deleted_at is null").count() == 3 and ingest.restore(after, F.lit(True)).where("deleted_at is null").count() == 4
    assert store.list_ids(after, "vault").count() == 3 and store.list_ids(after, "other").count() == 0 and store.list_ids(after, deleted=True).count() == 4
    gone = tags.renamed_exclusions(spark.createDataFrame([("a",), ("b",)], "tag string"), "a", "b")
    assert [r.tag for r in gone.collect()] == ["b"]


def test_judged_corpus(spark, tmp_path):
    from quillmesh.sources import notes

    (tmp_path / "qrels").mkdir()
    (tmp_path / "corpus.jsonl").write_text('{"_id": "d1", "title": "T", "text": "x"}\n{"_id": "d2", "title": "", "text": "y"}\n')
    (tmp_path / "queries.jsonl").write_text('{"_id": "q1", "text": "x?"}\n')
    for lines in ("query-id\tcorpus-id\tscore\nq1\td1\t1\nq1\td2\t0\n", "q1\t0\td1\t2\nq1\t0\td2\t0\n"):
        (tmp_path / "qrels" / "test.tsv").write_text(lines)
        docs, queries, qrels = notes.judged_corpus(spark, str(tmp_path))
        assert (docs.count(), queries.count()) == (2, 1) and [tuple(r) for r in qrels.collect()] == [("q1", "d1")]


def test_image_search_matches_all_pairs_without_shuffling_them(spark):
    docs = spark.createDataFrame([(i, [(f"img/p{i}.{'png' if i % 3 else 'jpg'}", "image/x"), ("img/a/b.png", "image/x" if i % 2 else "text/x"), ("img/a/c.png", "image/x")][: 1 + i % 3]) for i in range(1, 13)] + [(50, None), (51, [(None, "image/x")])], "doc_id long, attachments array<struct<path string, mime string>>")
    images = views.images(docs)
    text = lambda path: F.translate(path, "/.", "  ")
    queries = encode.encoded(images.where(F.col("doc_id") % 5 == 0).select(F.explode("paths").alias("query_id")).distinct(), text(F.col("query_id")))
    vector = {r.p: np.array(r.embedding) for r in encode.encoded(images.select(F.explode("paths").alias("p")).distinct(), text(F.col("p"))).collect()}
    want = {}
    for q in (r.query_id for r in queries.collect()):
        for doc, paths in images.collect():
            score, path = min((-round(float(vector[q] @ vector[p]), 6), p) for p in paths)
            if -score > 0.2:
                want[q, doc] = (-score, path)
    before = views.CELLS
    for cells in (7, before):
        views.CELLS = cells
        try:
            got = views.image_matches(images, queries.select("query_id", "embedding"), text)
            assert {(r.query_id, r.doc_id): (round(r.score, 6), r.path) for r in got.collect()} == want and got.count() == len(want) > 30
        finally:
            views.CELLS = before
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan
