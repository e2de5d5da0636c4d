"""Queries of the store and of what the interface shows, with their SQL equivalents."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions import text as X
from quillmesh.functions.encode import encoded
from quillmesh.operators import entities as E
from quillmesh.operators import graph as H
from quillmesh.operators import ingest as I
from quillmesh.operators import proposals as P
from quillmesh.operators import retrieval as R
from quillmesh.operators import store as S
from quillmesh.operators import tagging as G
from quillmesh.operators import tags as T
from quillmesh.operators import views as W
from quillmesh.plans.notes import _CHANGES, _TAGS, _rows, _versions, CHUNKS
from quillmesh.plans.registry import Registry
from quillmesh.plans.search import enc
from quillmesh.session import read_table as table

query = Registry()
QUERIES, SQL = query.queries, query.sql


def _tagged(s: SparkSession, d: str) -> DataFrame:
    return T.with_tags(table(s, d, "documents"), _rows(s, d))


_WITH_TAGS = _TAGS + ", g AS (SELECT doc_id, list(tag ORDER BY pos, tag) AS tags FROM r GROUP BY 1), t AS (SELECT d.*, coalesce(tags, []) AS tags FROM documents d LEFT JOIN g USING (doc_id))\n"


# Store


@query("SELECT id, doc_id * 7919 % 10007 AS place, doc_id FROM documents WHERE doc_id % 10 = 0")
def multi_get(s, d):
    """Notes by id in the caller's order; ids that are not there have no row."""
    docs = table(s, d, "documents").select("id", "doc_id")
    asked = docs.where(F.col("doc_id") % 10 == 0).select("id", (F.col("doc_id") * 7919 % 10007).alias("place"))
    gone = asked.select(F.concat(F.lit("no-"), "id").alias("id"), "place")
    return S.multi_get(docs, asked.unionByName(gone))


@query("SELECT id FROM documents WHERE source_key = 'keep-000001' AND deleted_at IS NULL")
def list_ids(s, d):
    return S.list_ids(table(s, d, "documents"), "keep-000001")


_ARCHIVED = "coalesce(CASE WHEN json_valid(extra) THEN coalesce(extra->>'archived', extra->>'isArchived') END = 'true', false)"


@query(_TAGS + f"""SELECT doc_id FROM documents WHERE deleted_at IS NULL AND NOT {_ARCHIVED} AND edited_at BETWEEN TIMESTAMP '2020-01-01' AND TIMESTAMP '2023-06-30'
 AND doc_id IN (SELECT doc_id FROM r WHERE tag IN ('daily', 'Yaror', 'dorlan', 'urgent'))""")
def store_query(s, d):
    """Live notes that aren't archived, edited in a span, with any of some tags."""
    return S.find(table(s, d, "documents"), _rows(s, d), False, datetime(2020, 1, 1), datetime(2023, 6, 30), ["daily", "Yaror", "dorlan", "urgent"]).select("doc_id")


@query(_TAGS + f"""SELECT doc_id FROM documents WHERE deleted_at IS NULL AND {_ARCHIVED} ORDER BY id LIMIT 20""")
def store_query_archived(s, d):
    """The first page of archived notes by id."""
    return S.find(table(s, d, "documents"), _rows(s, d), True, limit=20).select("doc_id")


@query("SELECT doc_id FROM documents WHERE source_key = 'export-000000' AND deleted_at IS NULL")
def served_notes(s, d):
    return S.load_notes(table(s, d, "documents"), "export-000000").select("doc_id")


@query("""SELECT 'h' || vec_id AS content_hash, round(CASE WHEN vec_id % 2 = 0 THEN -embedding[1]::double ELSE embedding[1]::double END, 6) AS x FROM embeddings WHERE (vec_id % 3 <> 0 OR vec_id % 2 = 0) AND vec_id % 5 <> 0""")
def vector_upsert(s, d):
    """Vectors of two thirds of the ids, overwritten by those of even ids, then dropped for every fifth."""
    v = table(s, d, "embeddings").select("vec_id", F.concat(F.lit("h"), F.col("vec_id").cast("string")).alias("content_hash"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    old = v.where(F.col("vec_id") % 3 != 0).select("content_hash", "embedding")
    new = v.where(F.col("vec_id") % 2 == 0).select("content_hash", F.transform("embedding", lambda x: -x).alias("embedding"))
    kept = S.drop_vectors(S.upsert_vectors(old, new, 64), v.where(F.col("vec_id") % 5 == 0))
    return kept.select("content_hash", F.round(F.col("embedding")[0], 6).alias("x"))


_PRINT = " || '-' || ".join(f"sum(('0x' || substr(md5(content_hash), {i}, 8))::bigint)::varchar" for i in (1, 9, 17, 25))


@query(f"""SELECT 'dense' AS name, 2 AS schema_version, {_PRINT} AS content_hash, count(*) AS row_count FROM documents WHERE deleted_at IS NULL UNION ALL SELECT 'chunks', 1, 'old', 5""")
def index_ledger(s, d):
    """The ledger after the dense index was rebuilt; the chunk index's entry stays."""
    before = s.createDataFrame([("dense", 1, "old", 3), ("chunks", 1, "old", 5)], "name string, schema_version int, content_hash string, row_count long")
    now = I.fingerprint(table(s, d, "documents"), "dense").select("name", F.lit(2).alias("schema_version"), F.col("fingerprint").alias("content_hash"), F.col("rows").alias("row_count"))
    return S.ledger(now, before)


# A next snapshot in which every 7th note is gone and every 11th has another text.
_NEXT = "(SELECT doc_id, title, CASE WHEN doc_id % 11 = 0 THEN 'Rewritten note ' || doc_id || '. ' || coalesce(title, '') ELSE body END AS body, deleted_at FROM documents WHERE doc_id % 7 <> 0)"


def _next(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The next snapshot and the change set from this one to it."""
    new = F.concat(F.lit("Rewritten note "), F.col("doc_id").cast("string"), F.lit(". "), F.coalesce("title", F.lit("")))
    after = docs.where(F.col("doc_id") % 7 != 0).withColumn("body", F.when(F.col("doc_id") % 11 == 0, new).otherwise(F.col("body")))
    kind = F.when(F.col("doc_id") % 7 == 0, "removed").when(F.col("doc_id") % 11 == 0, "updated").otherwise("unchanged")
    return after, docs.select("doc_id", kind.alias("change_type"))


@query(CHUNKS.replace("FROM documents)", f"FROM {_NEXT})") + "SELECT doc_id, chunk_index::int AS chunk_index, md5(chunk) AS key FROM k")
def index_apply_chunks(s, d):
    """The chunk index after a change set: only changed notes are cut again, and it equals a new build."""
    docs = table(s, d, "documents").select("doc_id", "title", "body")
    after, changes = _next(docs)
    changed = after.join(changes.where(F.col("change_type") == "updated").select("doc_id"), "doc_id", "left_semi")
    return S.apply_index(R.chunks(docs), changes, R.chunks(changed)).select("doc_id", "chunk_index", F.md5("chunk").alias("key"))


_LISTED = "SELECT doc_id, surface, label, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(left(body, 5000), '\\p{L}+')) AS surface FROM {docs}) JOIN (SELECT DISTINCT name AS surface, kind AS label FROM known_names) USING (surface) GROUP BY 1, 2, 3"


def _names(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "known_names").select("name", F.col("kind").alias("label"))


def _listed(s: SparkSession, d: str, docs: DataFrame | None = None) -> DataFrame:
    return E.listed_mentions(table(s, d, "documents") if docs is None else docs, _names(s, d), F.col("body"))


@query(_LISTED.replace("{docs}", "documents"))
def listed_entities(s, d):
    """Names of the list in each note."""
    return _listed(s, d)


@query(_LISTED.replace("{docs}", _NEXT))
def index_apply_entities(s, d):
    """The entity index after a change set: changed notes are purged and read again."""
    docs = table(s, d, "documents")
    after, changes = _next(docs.select("doc_id", "title", "body"))
    touched = changes.where(F.col("change_type") != "unchanged")
    return E.purge(_listed(s, d), touched, _listed(s, d, after.join(touched, "doc_id", "left_semi")))


@query("""WITH m AS (SELECT DISTINCT content_hash FROM documents WHERE doc_id % 3 <> 0 AND content_hash IS NOT NULL) SELECT content_hash, min(doc_id) AS doc_id FROM documents
 WHERE deleted_at IS NULL AND content_hash IS NOT NULL AND trim(coalesce(text, ''), ' ') <> '' AND content_hash NOT IN (SELECT content_hash FROM m) GROUP BY 1""")
def index_apply_dense(s, d):
    """What the vector index has to encode when the hashes of two thirds of the notes have vectors."""
    docs = table(s, d, "documents")
    return S.to_encode(docs, docs.where((F.col("doc_id") % 3 != 0) & F.col("content_hash").isNotNull()).select("content_hash").distinct())


@query(_CHANGES + """, k AS (SELECT count(*) FILTER (change_type = 'added') AS added, count(*) FILTER (change_type = 'updated') AS updated, count(*) FILTER (change_type = 'removed') AS removed, count(*) FILTER (change_type = 'unchanged') AS unchanged, count(*) FILTER (restored) AS restored FROM c WHERE change_type IS NOT NULL)
SELECT 0 AS seq, '{"phase":"scan","found":' || (SELECT count(*) FROM n) || '}' AS frame UNION ALL SELECT 1, '{"phase":"diff","added":' || added || ',"updated":' || updated || ',"removed":' || removed || ',"unchanged":' || unchanged || '}' FROM k
UNION ALL SELECT 2, '{"phase":"done","written":' || added + updated || ',"removed":' || removed || ',"restored":' || restored || '}' FROM k""")
def import_frames(s, d):
    new, old = _versions(s, d)
    return S.import_frames(S.ingest(new, old), new)


@query("""SELECT doc_id, to_json(coalesce(labels, [])) AS labels, strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f') AS created_at FROM documents""")
def stored_rows(s, d):
    return S.to_rows(table(s, d, "documents")).select("doc_id", "labels", "created_at")


@query("SELECT doc_id, coalesce(len(labels), 0)::int AS n_labels, created_at FROM documents")
def row_round_trip(s, d):
    back = S.from_rows(S.to_rows(table(s, d, "documents")))
    return back.select("doc_id", F.size("labels").alias("n_labels"), F.col("created_at").cast("timestamp_ntz").alias("created_at"))


@query("SELECT DISTINCT sha256(name) AS key, name AS text FROM tags WHERE name IS NOT NULL AND name NOT IN (SELECT name FROM tags WHERE id % 2 = 0)")
def tag_cache_misses(s, d):
    """Tag names whose vectors a cache of every second one lacks."""
    tags = table(s, d, "tags")
    return S.text_keys(tags).join(S.text_keys(tags.where(F.col("id") % 2 == 0)).select("key"), "key", "left_anti")


@query("SELECT count(*) AS rows, sum(('0x' || substr(md5(id || left(coalesce(text, ''), 200)), 1, 8))::bigint)::varchar || '-' || sum(('0x' || substr(md5(id || left(coalesce(text, ''), 200)), 9, 8))::bigint)::varchar AS fingerprint FROM documents WHERE deleted_at IS NULL")
def corpus_fingerprint(s, d):
    return S.corpus_fingerprint(table(s, d, "documents"))


_ASKED = "CASE doc_id % 3 WHEN 0 THEN id WHEN 1 THEN external_id ELSE 'no-' || id END"


@query(f"""WITH a AS (SELECT DISTINCT {_ASKED} AS asked FROM documents), m AS (SELECT id AS asked, id, 0 AS r, doc_id FROM documents UNION ALL SELECT external_id, id, 1, doc_id FROM documents WHERE external_id <> '')
SELECT asked, arg_min(m.id, (r, doc_id)) AS id FROM m JOIN a USING (asked) GROUP BY 1""")
def resolve_ids(s, d):
    docs = table(s, d, "documents")
    k = F.col("doc_id") % 3
    return S.resolve_ids(docs, docs.select(F.when(k == 0, F.col("id")).when(k == 1, F.col("external_id")).otherwise(F.concat(F.lit("no-"), "id")).alias("asked")))


_SEED = "('0x' || left(md5(doc_id || ':' || copy || ':' || (i - 1)), 6))::bigint % 100"


@query(f"""WITH b AS (SELECT doc_id, c.copy, list_filter(regexp_split_to_array(body, '\\s+'), lambda x: x <> '') AS w FROM documents, range(3) c(copy) WHERE body IS NOT NULL),
x AS (SELECT doc_id, copy, w, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM b),
y AS (SELECT doc_id, copy, i, CASE WHEN copy = 2 THEN coalesce(CASE WHEN (i - 1) % 20 = 0 THEN w[i + 1] WHEN (i - 1) % 20 = 1 THEN w[i - 1] ELSE t END, t) ELSE t END AS t FROM x WHERE copy <> 1 OR {_SEED} >= 5),
z AS (SELECT doc_id, copy, string_agg(t, ' ' ORDER BY i) AS text FROM y GROUP BY 1, 2)
SELECT b.doc_id, b.copy::int AS copy, md5(coalesce(text, '')) AS key FROM b LEFT JOIN z USING (doc_id, copy)""")
def inflated_corpus(s, d):
    """Every note twice more, once without some words, once with some neighbours swapped."""
    return S.inflate(table(s, d, "documents"), 2).select("doc_id", "copy", F.md5("text").alias("key"))


# Views


@query(_TAGS + "SELECT count(DISTINCT doc_id) AS n FROM r WHERE tag IN ('daily', 'Yaror')")
def excluded_count(s, d):
    return T.excluded_count(_rows(s, d), s.createDataFrame([("daily",), ("Yaror",)], "tag string"))


@query(_WITH_TAGS + "SELECT doc_id FROM t WHERE list_contains(list_transform(tags, lambda x: lower(x)), 'yaror') AND created_at::date >= DATE '2021-01-01'")
def agent_tag_filter(s, d):
    """A tag in any letter case within a scope of days."""
    return W.by_tag(T.created_between(_tagged(s, d), "2021-01-01", None), "YAROR").select("doc_id")


@query(_WITH_TAGS + "SELECT doc_id FROM t WHERE list_has_any(tags, ['daily', 'dorlan']) AND NOT list_contains(tags, 'Yaror')")
def shown_notes(s, d):
    return W.filtered(_tagged(s, d), ["daily", "dorlan"], ["Yaror"]).select("doc_id")


@query(_WITH_TAGS + """SELECT doc_id, CASE WHEN list_contains(tags, 'daily') THEN list_filter(tags, lambda x: x <> 'daily') ELSE list_append(tags, 'daily') END AS included, list_filter(['Yaror', 'daily'], lambda x: x <> 'daily') AS excluded,
 list_sort(list_distinct(list_transform(tags, lambda x: CASE WHEN x = 'daily' THEN 'Yaror' ELSE x END))) AS renamed FROM t""")
def filter_states(s, d):
    """Each note's tags as a filter state, after a click on a tag and after its renaming."""
    t = _tagged(s, d)
    inc, exc = W.toggled(F.col("tags"), F.array(F.lit("Yaror"), F.lit("daily")), F.lit("daily"), "include")
    return t.select("doc_id", inc.alias("included"), exc.alias("excluded"), F.array_sort(W.renamed(F.col("tags"), F.lit("daily"), F.lit("Yaror"))).alias("renamed"))


@query(f"""SELECT doc_id, {_ARCHIVED} AS archived, coalesce(CASE WHEN json_valid(extra) THEN coalesce(extra->>'pinned', extra->>'isPinned') END = 'true', false) AS pinned FROM documents""")
def note_flags(s, d):
    return table(s, d, "documents").select("doc_id", S.flag(F.col("extra"), "archived", "isArchived").alias("archived"), S.flag(F.col("extra"), "pinned", "isPinned").alias("pinned"))


@query(_WITH_TAGS + "SELECT doc_id, list_has_any(tags, ['daily', 'dorlan']) AS visible, list_has_any(tags, ['daily', 'dorlan']) AND list_contains(tags, 'daily') AS focused FROM t")
def map_points(s, d):
    """Visible notes and ghosts, with the focus on a tag."""
    t = _tagged(s, d)
    return W.points(t, W.filtered(t, ["daily", "dorlan"], []), "daily")


@query("SELECT doc_id FROM documents WHERE trim(regexp_replace(coalesce(text, ''), '[\\s\\p{Z}\\x0b\\x85]+', ' ', 'g'), ' ') = ''")
def notes_without_text(s, d):
    return W.without_text(table(s, d, "documents")).select("doc_id")


@query(_TAGS + """, c AS (SELECT tag, count(*) AS n FROM r GROUP BY 1) SELECT tag, row_number() OVER (ORDER BY n DESC, tag COLLATE en, tag) AS count_desc FROM c""")
def tag_order(s, d):
    """Tags by number of notes, ties by the collation of names."""
    return W.tag_orders(T.tag_counts(_rows(s, d))).select("tag", "count_desc")


@query(_TAGS + """, c AS (SELECT tag, count(*) AS n FROM r GROUP BY 1) SELECT tag, row_number() OVER (ORDER BY tag COLLATE en, n DESC, tag) AS name_asc, row_number() OVER (ORDER BY tag COLLATE en DESC, n DESC, tag) AS name_desc, row_number() OVER (ORDER BY n, tag COLLATE en, tag) AS count_asc FROM c""")
def tag_name_orders(s, d):
    return W.tag_orders(T.tag_counts(_rows(s, d))).select("tag", "name_asc", "name_desc", "count_asc")


@query("SELECT doc_id, edited_at FROM documents WHERE deleted_at IS NULL ORDER BY edited_at DESC NULLS LAST, doc_id LIMIT 50 OFFSET 50")
def second_page(s, d):
    """The second page of 50 live notes, the last edited first."""
    docs = table(s, d, "documents").where(F.col("deleted_at").isNull()).select("doc_id", F.col("edited_at").cast("timestamp_ntz").alias("edited_at"))
    return W.page(docs, [F.desc_nulls_last("edited_at"), F.col("doc_id")], 50, 1)


@query(_TAGS + """, c AS (SELECT tag, count(*) AS n FROM r GROUP BY 1), h AS (SELECT tag FROM c ORDER BY n DESC, tag LIMIT 12) SELECT tag FROM h UNION SELECT tag FROM c WHERE tag IN ('daily', 'Yaror', 'dorlan')""")
def scope_tags(s, d):
    return W.scope_choices(T.tag_counts(_rows(s, d)), 12, ["daily", "Yaror", "dorlan"])


@query("SELECT count(*) AS n, round(10 / max(list_max(list_transform(embedding, lambda x: abs(x::double)))), 6) AS scale, round(least(greatest(2 / sqrt(count(*)), 0.05), 0.6), 6) AS radius FROM embeddings")
def map_scale(s, d):
    return W.scaled(table(s, d, "embeddings"))


@query(_TAGS + """, c AS (SELECT tag, count(*) AS n FROM r GROUP BY 1) SELECT tag, lower(printf('#%02x%02x%02x', round(20 + 200 * n / (SELECT max(n) FROM c))::int, round(120 - 100 * n / (SELECT max(n) FROM c))::int, 200)) AS colour FROM c""")
def tag_heat(s, d):
    """Tags coloured by their share of the most frequent one's notes."""
    c = T.tag_counts(_rows(s, d))
    most = F.broadcast(c.agg(F.max("n").alias("most")))
    return c.join(most).select("tag", W.mixed_colour((20, 120, 200), (220, 20, 200), F.col("n") / F.col("most")).alias("colour"))


@query(_TAGS + """, c AS (SELECT tag, count(*) AS n FROM r GROUP BY 1) SELECT to_json(list({'name': tag, 'note_count': n} ORDER BY n DESC, tag))::varchar AS value FROM c""")
def exported_tags(s, d):
    return W.exported_tags(T.tag_counts(_rows(s, d)))


_IMG = "SELECT DISTINCT doc_id, a.path AS path FROM (SELECT doc_id, unnest(attachments) AS a FROM documents) WHERE a.mime LIKE 'image/%'"


@query("WITH im AS (" + _IMG + "), ip AS (SELECT DISTINCT path, replace(replace(path, '/', ' '), '.', ' ') AS words FROM im), " + enc("iv", "ip", "path", "words") + ", iq AS (SELECT path AS query_id, embedding FROM iv WHERE path IN (SELECT path FROM im WHERE doc_id % 50 = 0)),"
       " sc AS (SELECT query_id, path, round(list_dot_product(iq.embedding, iv.embedding), 6) AS score FROM iq CROSS JOIN iv), h AS (SELECT query_id, doc_id, path, score FROM sc JOIN im USING (path) WHERE score > 0.2)"
       " SELECT query_id, doc_id, max(score) AS score, arg_min(path, (-score, path)) AS path FROM h GROUP BY 1, 2")  # fmt: skip
def image_search(s, d):
    """Notes by the best of their images, with vectors of the paths' words in place of pictures; the images of every 50th note ask."""
    images = W.images(table(s, d, "documents"))
    asked = images.where(F.col("doc_id") % 50 == 0).select(F.explode("paths").alias("path")).distinct()
    queries = encoded(asked, F.translate("path", "/.", "  ")).select(F.col("path").alias("query_id"), "embedding")
    return W.image_matches(images, queries, lambda path: F.translate(path, "/.", "  "))


@query(_TAGS + """, b AS (SELECT doc_id, arg_min(tag, (pos, tag)) AS tag FROM r GROUP BY 1), a AS (SELECT doc_id, arg_max(tag, (pos, tag)) AS tag FROM r GROUP BY 1),
j AS (SELECT b.tag AS bt, CASE WHEN doc_id % 10 <> 0 THEN a.tag END AS l FROM b JOIN a USING (doc_id))
SELECT count(*) AS notes, round(100 * count(*) FILTER (bt IS NOT DISTINCT FROM l) / count(*), 1) AS stable_pct, count(DISTINCT l) AS clusters, round(count(l) / count(DISTINCT l), 2) AS mean_size, round(100 * count(*) FILTER (l IS NULL) / count(*), 1) AS uncategorized_pct FROM j""")
def run_stability(s, d):
    """Notes' first tags against their last ones, of which every tenth note has none."""
    r = _rows(s, d)
    first = r.groupBy("doc_id").agg(F.min_by("tag", F.struct("pos", "tag")).alias("tag"))
    last = r.groupBy("doc_id").agg(F.max_by("tag", F.struct("pos", "tag")).alias("tag"))
    return W.stability(first, last.withColumn("tag", F.when(F.col("doc_id") % 10 != 0, F.col("tag"))))


@query("WITH l AS (" + _LISTED.replace("{docs}", "documents") + """), pool AS (SELECT surface, doc_id AS other, row_number() OVER (PARTITION BY surface ORDER BY doc_id) AS k FROM (SELECT DISTINCT surface, doc_id FROM l) QUALIFY k <= 11)
SELECT doc_id, surface AS canonical, other FROM (SELECT x.doc_id, surface, other, row_number() OVER (PARTITION BY x.doc_id, surface ORDER BY other) AS n FROM (SELECT DISTINCT surface, doc_id FROM l WHERE doc_id % 10 = 0) x JOIN pool USING (surface) WHERE other <> x.doc_id) WHERE n <= 10""")
def shared_entity_neighbours(s, d):
    """For every tenth note the first notes that name the same person."""
    index = _listed(s, d).select(F.col("surface").alias("canonical"), "doc_id").distinct()
    return E.shared_entity_neighbours(index, index.where(F.col("doc_id") % 10 == 0))


_ALIKE = """, sf AS (SELECT surface, label, count(DISTINCT doc_id) AS docs FROM l GROUP BY 1, 2),
e AS (SELECT x.surface AS a, y.surface AS b, x.label FROM sf x JOIN sf y ON x.label = y.label AND lower(left(x.surface, 3)) = lower(left(y.surface, 3)) AND x.surface <> y.surface AND jaro_winkler_similarity(lower(x.surface), lower(y.surface)) >= 0.75),
reach(a, b, label) AS (SELECT surface, surface, label FROM sf UNION SELECT reach.a, e.b, e.label FROM reach JOIN e ON reach.b = e.a AND reach.label = e.label)
"""


@query("WITH RECURSIVE l AS (" + _LISTED.replace("{docs}", "documents") + ")" + _ALIKE + "SELECT a AS surface, reach.label, arg_min(b, (-docs, b)) AS canonical FROM reach JOIN sf ON sf.surface = b AND sf.label = reach.label GROUP BY 1, 2")
def listed_aliases(s, d):
    """Spellings of listed names that are one entity."""
    return E.aliases(_listed(s, d))


@query("WITH l AS (" + _LISTED.replace("{docs}", "documents") + """), sf AS (SELECT DISTINCT surface, label FROM l), k AS (SELECT name, kind, row_number() OVER (ORDER BY name, kind) AS place FROM (SELECT DISTINCT name, kind FROM known_names WHERE ascii(name) % 2 = 0)),
h AS (SELECT surface, label, arg_min(name, place) AS found FROM sf JOIN k ON label = kind AND jaro_winkler_similarity(lower(surface), lower(name)) >= 0.75 GROUP BY 1, 2) SELECT surface, label, found FROM sf LEFT JOIN h USING (surface, label)""")
def alike_entities(s, d):
    """New surfaces against the names that a stored index holds."""
    from pyspark.sql import Window

    half = _names(s, d).where(F.ascii("name") % 2 == 0).distinct()
    known = half.select(F.col("name").alias("surface"), "label", F.row_number().over(Window.orderBy("name", "label")).cast("long").alias("place"))
    return E.first_alike(_listed(s, d), known)


# Proposals


def _actions(s: SparkSession, d: str) -> DataFrame:
    """A user's actions on cards of notes by the remainder of their ids."""
    docs = table(s, d, "documents")
    cards = [(0, "approve", "garden", None), (1, "rename", "old", "Home"), (2, "merge", "daily", None), (3, "reject", "never", None), (4, "approve", "", None), (5, "rename", "kept", "")]
    groups = s.createDataFrame(cards, "seq int, action string, tag_name string, new_name string")
    notes = docs.groupBy((F.col("doc_id") % 20).cast("int").alias("seq")).agg(F.collect_list("doc_id").alias("note_ids"))
    a = groups.join(notes, "seq", "left").select("seq", "action", "tag_name", "new_name", "note_ids", *(F.lit(None).cast(t).alias(c) for c, t in (("source_tag", "string"), ("target_tag", "string"), ("note_id", "long"), ("tag", "string"))))
    more = [(10, "merge_tags", "dorlan", "daily", None, None), (11, "merge_tags", "nosuch", "x", None, None), (12, "merge_tags", "daily", "Yaror", None, None), (13, "assign_tag", None, None, 5, "checked"), (14, "assign_tag", None, None, -5, "checked")]
    extra = s.createDataFrame(more, "seq int, action string, source_tag string, target_tag string, note_id long, tag string").select("seq", "action", *(F.lit(None).cast(t).alias(c) for c, t in (("tag_name", "string"), ("new_name", "string"), ("note_ids", "array<long>"))), "source_tag", "target_tag", "note_id", "tag")
    return a.unionByName(extra)


@query(_TAGS + """, ad AS (SELECT doc_id, CASE doc_id % 20 WHEN 0 THEN 'garden' WHEN 1 THEN 'Home' WHEN 2 THEN 'daily' ELSE 'kept' END AS tag, doc_id % 20 AS seq FROM documents WHERE doc_id % 20 IN (0, 1, 2, 5)),
n AS (SELECT doc_id, tag, row_number() OVER (PARTITION BY doc_id ORDER BY seq, tag) AS k FROM ad WHERE (doc_id, tag) NOT IN (SELECT (doc_id, tag) FROM r)),
t AS (SELECT * FROM r UNION ALL SELECT n.doc_id, tag, coalesce((SELECT max(pos) FROM r WHERE r.doc_id = n.doc_id), -1) + k FROM n),
m AS (SELECT doc_id, CASE WHEN tag IN ('dorlan', 'daily') THEN 'Yaror' ELSE tag END AS tag, pos, CASE WHEN tag = 'dorlan' OR tag = 'daily' THEN 3 ELSE 0 END AS o FROM t),
u AS (SELECT doc_id, tag, arg_min(pos, (o, pos)) AS pos FROM m GROUP BY 1, 2)
SELECT doc_id, tag, pos FROM u UNION ALL SELECT doc_id, 'checked', coalesce((SELECT max(pos) FROM u WHERE doc_id = 5), -1) + 1 FROM documents WHERE doc_id = 5""")
def apply_proposals(s, d):
    """Tags after approved, renamed and merged cards, merges of tags one after the other, and single assignments."""
    return P.apply_actions(_rows(s, d), table(s, d, "documents"), _actions(s, d))


def _cards(s: SparkSession, d: str) -> DataFrame:
    """A card for each tag; every fourth has lost its id, every fifth only informs."""
    t = table(s, d, "tags")
    return t.select(F.col("id").cast("int").alias("position"), F.when(F.col("id") % 4 != 0, F.concat(F.lit("p"), F.col("id").cast("string"))).alias("proposal_id"), F.col("name").alias("tag_name"), F.when(F.col("id") % 5 == 0, "info").otherwise("proposal").alias("type"))


def _said(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "tags").where(F.col("id") % 3 != 0)
    kinds = F.element_at(F.array(*map(F.lit, ("approve", "rename", "merge", "reject"))), (F.col("id") % 4 + 1).cast("int"))
    return t.select(F.when(F.col("id") % 2 == 0, F.concat(F.lit("p"), F.col("id").cast("string"))).alias("proposal_id"), F.col("name").alias("tag_name"), kinds.alias("action"))


_STAGED = """WITH c AS (SELECT id::int AS position, CASE WHEN id % 4 <> 0 THEN 'p' || id END AS proposal_id, name AS tag_name, CASE WHEN id % 5 = 0 THEN 'info' ELSE 'proposal' END AS type FROM tags),
sd AS (SELECT CASE WHEN id % 2 = 0 THEN 'p' || id END AS proposal_id, name AS tag_name, ['approve', 'rename', 'merge', 'reject'][id % 4 + 1] AS action FROM tags WHERE id % 3 <> 0),
bi AS (SELECT proposal_id, min(action) AS a FROM sd WHERE proposal_id IS NOT NULL GROUP BY 1), bn AS (SELECT tag_name, arg_min(action, coalesce(proposal_id, '')) AS b FROM sd GROUP BY 1),
f AS (SELECT position, coalesce(c.proposal_id, 'restored-' || position) AS proposal_id, tag_name, type, coalesce(a, b, 'pending') AS action FROM c LEFT JOIN bi USING (proposal_id) LEFT JOIN bn USING (tag_name))
"""


def _staged(s, d):
    return P.decided(_cards(s, d), _said(s, d))


@query(_STAGED + "SELECT position, proposal_id, tag_name, type, action FROM f")
def staged_decisions(s, d):
    return _staged(s, d)


@query(_STAGED + "SELECT position, CASE WHEN action = 'pending' AND type <> 'info' THEN 'approve' ELSE action END AS action FROM f")
def approve_all(s, d):
    return P.approve_all(_staged(s, d)).select("position", "action")


@query(_STAGED + "SELECT " + ", ".join(f"count(*) FILTER (action = '{k}') AS {k}" for k in ("pending", "approve", "rename", "merge", "reject")) + ", count(*) AS total FROM f")
def decision_counts(s, d):
    return P.decision_counts(_staged(s, d))


@query(_STAGED + """, q AS (SELECT DISTINCT unnest(['p' || id, name, id::varchar, 'no card']) AS asked FROM tags WHERE id % 7 = 0), m AS (SELECT proposal_id AS asked, position, 0 AS k FROM f UNION ALL SELECT tag_name, min(position), 1 FROM f GROUP BY 1 UNION ALL SELECT position::varchar, position, 2 FROM f)
SELECT asked, arg_min(position, (k, position)) AS position FROM m JOIN q USING (asked) GROUP BY 1""")
def find_cards(s, d):
    t = table(s, d, "tags").where(F.col("id") % 7 == 0)
    i = F.col("id").cast("string")
    return P.find_cards(_staged(s, d), t.select(F.explode(F.array(F.concat(F.lit("p"), i), "name", i, F.lit("no card"))).alias("asked")))


@query(_STAGED + "SELECT x.proposal_id, count(*) AS targets FROM f x JOIN f y ON x.proposal_id <> y.proposal_id WHERE x.type = 'proposal' AND y.type = 'proposal' GROUP BY 1")
def merge_targets(s, d):
    return P.merge_targets(_staged(s, d)).groupBy("proposal_id").agg(F.count("*").alias("targets"))


_OF = "WITH mm AS (SELECT name AS source_tag, (SELECT min(name) FROM tags u WHERE left(u.name, 1) = left(t.name, 1)) AS target_tag FROM tags t)"


@query(_OF + " SELECT DISTINCT source_tag, target_tag, 'Auto-merged ''' || source_tag || ''' into ''' || target_tag || '''' AS message FROM mm WHERE source_tag <> target_tag AND source_tag <> ''")
def merge_infos(s, d):
    """Cards that tell of merges: every tag into the first of its initial letter."""
    t = table(s, d, "tags")
    first = t.groupBy(F.substring("name", 1, 1).alias("c")).agg(F.min("name").alias("target_tag"))
    return P.merge_infos(t.join(first, F.substring("name", 1, 1) == F.col("c")).select(F.col("id").alias("seq"), F.col("name").alias("source_tag"), "target_tag"))


@query("WITH v AS (SELECT unnest(['DAILY', 'yaror', 'Brand New', 'Dorlan']) AS name) SELECT v.name, coalesce((SELECT min(t.name) FROM tags t WHERE lower(t.name) = lower(v.name)), v.name) AS tag FROM v")
def reused_names(s, d):
    return P.reuse_names(s.createDataFrame([(x,) for x in ("DAILY", "yaror", "Brand New", "Dorlan")], "name string"), table(s, d, "tags").select(F.col("name").alias("tag")))


@query("SELECT id AS label, CASE WHEN row_number() OVER (PARTITION BY id % 7 ORDER BY id) = 1 THEN 'T' || id % 7 ELSE 'T' || id % 7 || ' ' || row_number() OVER (PARTITION BY id % 7 ORDER BY id) END AS name FROM tags")
def numbered_names(s, d):
    """Names of which seven stand for all tags, told apart by numbers."""
    t = table(s, d, "tags").select(F.col("id").alias("label"), F.concat(F.lit("T"), (F.col("id") % 7).cast("string")).alias("name"))
    return G.number_names(t).select("label", F.col("unique_name").alias("name"))


@query("""WITH a AS (SELECT id AS label, CASE WHEN id % 3 = 0 THEN NULL WHEN id % 5 = 0 THEN 'Various' WHEN id % 7 = 0 THEN 'Same' ELSE name END AS name, id FROM tags),
n AS (SELECT label, coalesce(nullif(name, ''), CASE WHEN id % 2 = 0 THEN 'Word' || id || ' Of' || id ELSE 'Misc' END) AS name FROM a WHERE coalesce(lower(name), '') <> 'various')
SELECT label, CASE WHEN row_number() OVER (PARTITION BY name ORDER BY label) = 1 THEN name ELSE name || ' ' || row_number() OVER (PARTITION BY name ORDER BY label) END AS name FROM n""")
def label_names(s, d):
    """A model's names of labels, with keywords where it gave none, without generic ones and repetitions."""
    t = table(s, d, "tags")
    i = F.col("id")
    answers = t.select(i.alias("label"), F.when(i % 3 == 0, F.lit(None)).when(i % 5 == 0, "Various").when(i % 7 == 0, "Same").otherwise(F.col("name")).alias("name"))
    words = t.where(i % 2 == 0).select(i.alias("label"), F.posexplode(F.array(F.concat(F.lit("word"), i.cast("string")), F.concat(F.lit("of"), i.cast("string")), F.lit("rest"))).alias("r", "term"))
    return P.label_names(answers, words.withColumn("r", F.col("r") + 1))


@query("""SELECT doc_id AS note_id, 'T' || doc_id % 3 AS tag, coalesce(title, '') AS note_title, round((doc_id % 101) / 101, 2) AS confidence,
 'Assign tag ''T' || doc_id % 3 || ''' to note ''' || coalesce(nullif(title, ''), doc_id::varchar) || ''' (confidence: ' || printf('%.2f', round((doc_id % 101) / 101, 2)) || ')' AS message FROM documents WHERE doc_id % 4 <> 0""")
def review_cards(s, d):
    """Cards for doubtful assignments; those without a tag have none."""
    i = F.col("doc_id")
    items = table(s, d, "documents").select(i.alias("note_id"), F.when(i % 4 != 0, F.concat(F.lit("T"), (i % 3).cast("string"))).alias("tag"), (i % 101 / 101).alias("confidence"), "title")
    return P.review_cards(items)


@query(_TAGS + """, pool AS (SELECT tag, doc_id AS other, row_number() OVER (PARTITION BY tag ORDER BY doc_id) AS rn FROM r QUALIFY rn <= 11),
nb AS (SELECT doc_id, tag, other FROM (SELECT r.doc_id, r.tag, other, row_number() OVER (PARTITION BY r.doc_id, r.tag ORDER BY other) AS n FROM r JOIN pool USING (tag) WHERE r.doc_id % 10 = 0 AND other <> r.doc_id) WHERE n <= 10)
SELECT DISTINCT least(doc_id, other) AS src, greatest(doc_id, other) AS dst, 'tag' AS kind FROM nb WHERE doc_id IN (SELECT doc_id FROM documents WHERE deleted_at IS NULL) AND other IN (SELECT doc_id FROM documents WHERE deleted_at IS NULL)""")
def graph_edges(s, d):
    """Edges of shared tags between live notes, each pair once."""
    rows = _rows(s, d)
    near = H.shared_tag_neighbours(rows, rows.where(F.col("doc_id") % 10 == 0).select("doc_id").distinct())
    edges = H.undirected(near.select(F.col("doc_id").alias("src"), F.col("other").alias("dst"), F.lit("tag").alias("kind")))
    return H.visible(edges, table(s, d, "documents").where(F.col("deleted_at").isNull()).select(F.col("doc_id").alias("id")))


_SAFE = "replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"


@query(f"SELECT doc_id, regexp_replace({_SAFE}, '(an)', '<mark>\\1</mark>', 'gi') AS html, round(100.0 * (doc_id % 37) / 37)::int || '%' AS percent FROM documents WHERE title IS NOT NULL")
def highlighted_titles(s, d):
    """Titles as safe HTML with a word marked, and a score in per cent."""
    docs = table(s, d, "documents").where(F.col("title").isNotNull())
    return docs.select("doc_id", X.highlight(F.col("title"), F.lit("an")).alias("html"), X.percent(F.col("doc_id") % 37 / 37).alias("percent"))


@query("""SELECT message_id, trim(regexp_replace(split_part(content, chr(10), 1), '^[\\s\\d.)*-]+', ''), ' ') AS line FROM (SELECT DISTINCT message_id, content FROM chat_messages) WHERE content IS NOT NULL""")
def list_lines(s, d):
    """First lines of messages without what leads a line of a list."""
    m = table(s, d, "chat_messages").where(F.col("content").isNotNull()).select("message_id", "content").distinct()
    return m.select("message_id", X.list_line(F.split("content", "\n")[0]).alias("line"))


@query("""SELECT message_id, 'role ' || lower(trim(role)) AS thought, trim(content, ' ') AS answer FROM (SELECT DISTINCT message_id, role, content FROM chat_messages) WHERE content IS NOT NULL""")
def split_thoughts(s, d):
    """A model's thoughts apart from its answer."""
    m = table(s, d, "chat_messages").where(F.col("content").isNotNull()).select("message_id", "role", "content").distinct()
    said = F.concat(F.lit("<think> role "), F.lower(F.trim("role")), F.lit("\n</think>"), F.col("content"))
    thought, answer = X.split_thinking(said)
    return m.select("message_id", X.stripped(thought).alias("thought"), answer.alias("answer"))


@query("SELECT doc_id, arg_min(signal, s) AS signal FROM (SELECT doc_id, 'labels' AS signal, 0 AS s FROM documents WHERE len(labels) > 2 UNION ALL SELECT doc_id, 'long', 1 FROM documents WHERE n_chars > 1000 UNION ALL SELECT doc_id, 'inbox', 2 FROM documents WHERE source = 'inbox') GROUP BY 1")
def first_signal(s, d):
    """Each note once, as the first of several result lists has it."""
    docs = table(s, d, "documents")
    lists = {"labels": F.size("labels") > 2, "long": F.col("n_chars") > 1000, "inbox": F.col("source") == "inbox"}
    return R.first_rows([docs.where(c).select("doc_id", F.lit(k).alias("signal")) for k, c in lists.items()])


@query("WITH f AS (SELECT content_hash, min(doc_id) AS vec_id FROM documents WHERE content_hash IS NOT NULL GROUP BY 1) SELECT doc_id, round(embedding[1]::double, 6) AS x FROM documents LEFT JOIN f USING (content_hash) LEFT JOIN embeddings USING (vec_id)")
def rows_with_vectors(s, d):
    """Notes with the vector that is stored for their content."""
    docs = table(s, d, "documents")
    first = docs.where(F.col("content_hash").isNotNull()).groupBy("content_hash").agg(F.min("doc_id").alias("vec_id"))
    vectors = table(s, d, "embeddings").join(first, "vec_id").select("content_hash", "embedding")
    return S.with_vectors(docs.select("doc_id"), docs, vectors).select("doc_id", F.round(F.col("embedding")[0].cast("double"), 6).alias("x"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN NULL ELSE deleted_at END AS deleted_at FROM documents WHERE doc_id % 2 = 1 OR deleted_at IS NOT NULL")
def restored_notes(s, d):
    """Deleted notes of even ids are live again."""
    docs = table(s, d, "documents").where((F.col("doc_id") % 2 == 1) | F.col("deleted_at").isNotNull())
    return I.restore(docs, F.col("doc_id") % 2 == 0).select("doc_id", F.col("deleted_at").cast("timestamp_ntz").alias("deleted_at"))


@query(_TAGS + """, w AS (SELECT doc_id, 'daily' AS tag, 0 AS seq FROM documents WHERE doc_id % 5 = 0 UNION ALL SELECT doc_id, 'bulk', 1 FROM documents WHERE doc_id % 5 < 2),
n AS (SELECT doc_id, tag, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS k FROM w WHERE (doc_id, tag) NOT IN (SELECT (doc_id, tag) FROM r))
SELECT doc_id, tag, pos FROM r UNION ALL SELECT n.doc_id, tag, coalesce((SELECT max(pos) FROM r WHERE r.doc_id = n.doc_id), -1) + k FROM n""")
def bulk_tags(s, d):
    """Several tags for many notes at once; notes that don't exist are skipped."""
    docs = table(s, d, "documents").select("doc_id")
    tag = lambda c, name, seq: docs.where(c).select("doc_id", F.lit(name).alias("tag"), F.lit(seq).alias("seq"))
    gone = s.createDataFrame([(-7, "bulk", 1)], "doc_id long, tag string, seq int")
    return T.tag_notes(_rows(s, d), docs, tag(F.col("doc_id") % 5 == 0, "daily", 0).unionByName(tag(F.col("doc_id") % 5 < 2, "bulk", 1)).unionByName(gone))


@query("WITH RECURSIVE l AS (" + _LISTED.replace("{docs}", "documents") + ")" + _ALIKE + ", cn AS (SELECT a AS surface, reach.label, arg_min(b, (-docs, b)) AS canonical FROM reach JOIN sf ON sf.surface = b AND sf.label = reach.label GROUP BY 1, 2) SELECT DISTINCT canonical, doc_id FROM l JOIN cn USING (surface, label)")
def entity_notes(s, d):
    """The notes of each entity, whatever the spelling."""
    m = _listed(s, d)
    return E.entity_documents(m, E.aliases(m))
