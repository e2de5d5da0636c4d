"""Queries over notes, tags, imports and chats, with their SQL equivalents."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions import text as T
from quillmesh.operators import chat as C
from quillmesh.operators import entities as E
from quillmesh.operators import graph as G
from quillmesh.operators import ingest as I
from quillmesh.operators import retrieval as R
from quillmesh.operators import tags as G_
from quillmesh.plans.search import _WS, clean_sql
from quillmesh.session import read_table as table
from quillmesh.sources.notes import export_text
from quillmesh.streaming import limiter as L

SQL: dict[str, str] = {}
QUERIES: dict = {}
AT = datetime(2024, 6, 1)


def query(sql: str | None = None):
    """Registers a query under its function's name; sql is what DuckDB runs beside it."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _rows(s: SparkSession, d: str) -> DataFrame:
    return G_.tag_rows(table(s, d, "doc_tags"), table(s, d, "tags"))


_TAGS = "WITH r AS (SELECT doc_id, name AS tag, min(pos) AS pos FROM doc_tags JOIN tags ON tag_id = id GROUP BY 1, 2)\n"
_WORDS = "regexp_extract_all(lower(coalesce(body, '')), '[\\p{L}\\p{N}]+')"
_CLEAN = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(body, '(?s)\A---\n.*?\n---\n?', ''), '(?s)```.*?```', ' ', 'g'),
 '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), 'https?://\S+', ' ', 'g'), '[#*_>`~]+', ' ', 'g')"""


# Chunks in SQL: marks stand for the lookaheads, and the last part of the growing list is behind the last mark.
_PARTS = f"list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(body, '\\n{_WS}*\\n', chr(1), 'g'), '\\n(#{{{{1,3}}}}{_WS})', chr(1) || '\\1', 'g'), '\\n([-*]{_WS})', chr(1) || '\\1', 'g'), chr(1)), lambda x: regexp_replace(x, '^{_WS}+|{_WS}+$', '', 'g')), lambda x: x <> '')".replace("{{", "{").replace("}}", "}")
_LAST = "list_last(string_split(acc, chr(2)))"
CHUNKS = f"""WITH n AS (SELECT doc_id, coalesce(title, '') AS title, coalesce(body, '') AS body, {clean_sql("coalesce(title, '') || ' ' || coalesce(body, '')")} AS whole FROM documents),
g AS (SELECT doc_id, title, whole, CASE WHEN length(whole) > 500 THEN list_reduce({_PARTS}, lambda acc, x: CASE WHEN length({_LAST}) + 2 + length(x) <= 1500 OR length({_LAST}) < 100 THEN acc || chr(10) || chr(10) || x ELSE acc || chr(2) || x END) END AS grown FROM n WHERE whole <> '' AND (length(whole) <= 500 OR len({_PARTS}) > 0)),
l AS (SELECT doc_id, title, whole, CASE WHEN contains(grown, chr(2)) AND length(list_last(string_split(grown, chr(2)))) < 100 THEN regexp_replace(grown, '\\x02([^\\x02]*)$', chr(10) || chr(10) || '\\1') ELSE grown END AS grown FROM g),
k AS (SELECT doc_id, i - 1 AS chunk_index, CASE WHEN grown IS NULL THEN whole WHEN i = 1 THEN title || ' ' || p ELSE p END AS chunk
  FROM (SELECT doc_id, title, whole, grown, unnest(string_split(coalesce(grown, whole), chr(2))) AS p, generate_subscripts(string_split(coalesce(grown, whole), chr(2)), 1) AS i FROM l))
"""


# Text


@query(rf"SELECT doc_id, length(trim(regexp_replace({_CLEAN}, '[\s\p{{Z}}\x0b\x85]+', ' ', 'g'))) AS n FROM documents WHERE body IS NOT NULL")
def clean_note_lengths(s, d):
    docs = table(s, d, "documents").where(F.col("body").isNotNull())
    return docs.select("doc_id", F.length(T.clean_note(F.col("body"))).cast("long").alias("n"))


@query(f"SELECT w AS term, count(*) AS df FROM (SELECT unnest(list_distinct(list_filter({_WORDS}, lambda x: length(x) > 1))) AS w FROM documents) GROUP BY 1")
def token_document_frequency(s, d):
    docs = table(s, d, "documents").select(F.explode(F.array_distinct(T.words(F.coalesce("body", F.lit(""))))).alias("term"))
    return docs.groupBy("term").agg(F.count("*").alias("df"))


_STEM = """CASE WHEN NOT regexp_matches(w, '^[\\x00-\\x7f]*$') THEN w ELSE (CASE WHEN c LIKE '%s' AND c NOT LIKE '%ss' AND length(c) > 3 THEN left(c, -1) ELSE c END) END"""
_CUT = "CASE WHEN w LIKE '%ing' AND length(w) > 5 THEN left(w, -3) WHEN w LIKE '%ed' AND length(w) > 4 THEN left(w, -2) WHEN w LIKE '%es' AND length(w) > 4 THEN left(w, -2) ELSE w END"


@query(f"SELECT w AS term, {_STEM} AS stem FROM (SELECT w, {_CUT} AS c FROM (SELECT DISTINCT unnest(list_filter({_WORDS}, lambda x: length(x) > 1)) AS w FROM documents))")
def stems(s, d):
    words = table(s, d, "documents").select(F.explode(T.words(F.coalesce("body", F.lit("")))).alias("term")).distinct()
    return words.select("term", T.stem(F.col("term")).alias("stem"))


@query("""SELECT message_id, len(list_filter(regexp_split_to_array(lower(content), '\\s+'), lambda x: x <> '')) > 10 OR contains(l, 'compared to') OR contains(l, 'versus') OR contains(l, 'vs') OR contains(l, 'before') OR contains(l, 'after')
 OR contains(l, 'between') OR contains(l, 'and also') OR contains(l, 'as well as') OR contains(l, 'last week') OR contains(l, 'last month') OR contains(l, 'yesterday') OR contains(l, 'recently') OR contains(l, 'both')
 OR contains(l, 'difference') OR contains(l, 'similar') OR contains(l, 'changed') AS is_complex FROM (SELECT DISTINCT message_id, content, lower(content) AS l, lower(trim(role)) AS role FROM chat_messages) WHERE role = 'user' AND content IS NOT NULL""")
def complex_queries(s, d):
    m = C.messages(table(s, d, "chat_messages")).where((F.col("role") == "user") & F.col("content").isNotNull())
    return m.select("message_id", T.is_complex(F.col("content")).alias("is_complex"))


@query("SELECT doc_id, title FROM documents WHERE contains(lower(coalesce(title, '') || ' ' || coalesce(body, '')), 'need') AND contains(lower(coalesce(title, '') || ' ' || coalesce(body, '')), 'friday')")
def refine_keywords(s, d):
    docs = table(s, d, "documents")
    whole = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("body", F.lit("")))
    return docs.where(T.matches_all(whole, F.lit("Need , friday,"))).select("doc_id", "title")


@query("""SELECT doc_id, regexp_replace(title, '^\\s*p\\s*[:\\-—]\\s+', '', 'i') AS title, left(body, 200) AS snippet,
  coalesce(list_transform(attachments, lambda a: a.path), []) AS file_paths FROM documents WHERE deleted_at IS NULL""")
def note_view(s, d):
    """Serving rows: type prefix off the title, a snippet, attachment paths."""
    docs = table(s, d, "documents").where(F.col("deleted_at").isNull())
    paths = F.coalesce(F.transform("attachments", lambda a: a["path"]), F.array().cast("array<string>"))
    return docs.select("doc_id", T.strip_type_prefix(F.col("title")).alias("title"), F.substring("body", 1, 200).alias("snippet"), paths.alias("file_paths"))


@query("""WITH j AS (SELECT CASE WHEN json_valid(extra) THEN extra END AS e, attachments FROM documents WHERE deleted_at IS NULL)
SELECT count(*) AS total, count(*) FILTER (coalesce(e->>'isArchived', e->>'archived') = 'true') AS archived, count(*) FILTER (coalesce(e->>'isPinned', e->>'pinned') = 'true') AS pinned,
  count(*) FILTER (len(list_filter(attachments, lambda a: a.mime LIKE 'image/%')) > 0) AS with_images FROM j""")
def note_stats(s, d):
    """Both spellings of the archived and pinned keys are read; broken JSON counts as none."""
    e = F.try_parse_json("extra")
    flag = lambda *keys: F.coalesce(*(F.try_variant_get(e, f"$.{k}", "boolean") for k in keys), F.lit(False))
    docs = table(s, d, "documents").where(F.col("deleted_at").isNull())
    images = F.coalesce(F.exists("attachments", lambda a: a["mime"].startswith("image/")), F.lit(False))
    return docs.agg(F.count("*").alias("total"), F.count_if(flag("isArchived", "archived")).alias("archived"), F.count_if(flag("isPinned", "pinned")).alias("pinned"), F.count_if(images).alias("with_images"))


@query("SELECT concat_ws(chr(10) || chr(10), CASE WHEN coalesce(title, '') <> '' THEN title END, coalesce(body, ''), '---') AS value FROM documents WHERE deleted_at IS NULL")
def export_notes(s, d):
    return export_text(table(s, d, "documents").where(F.col("deleted_at").isNull()))


# Tags and scope


@query(_TAGS + "SELECT tag, count(*) AS n FROM r GROUP BY 1")
def tag_counts(s, d):
    return G_.tag_counts(_rows(s, d))


@query(_TAGS + """, l AS (SELECT doc_id FROM documents WHERE deleted_at IS NULL), p AS (SELECT l.doc_id, count(tag) AS k FROM l LEFT JOIN r USING (doc_id) GROUP BY 1)
SELECT count(*) AS total, count(*) FILTER (k > 0) AS tagged, count(*) FILTER (k = 0) AS untagged, sum(k)::bigint AS assignments, round(sum(k) / count(*), 2) AS mean_tags,
  round(100 * count(*) FILTER (k > 0) / count(*), 1) AS tagged_pct, (SELECT count(DISTINCT tag) FROM r) AS distinct_tags FROM p""")
def tag_coverage(s, d):
    return G_.coverage(table(s, d, "documents"), _rows(s, d))


@query(_TAGS + """SELECT doc_id, tag, arg_min(pos, (moved, pos)) AS pos FROM (SELECT doc_id, CASE WHEN tag = 'daily' THEN 'Yaror' ELSE tag END AS tag, pos, tag = 'daily' AS moved FROM r) GROUP BY 1, 2""")
def tag_rename_merge(s, d):
    return G_.rename_tag(_rows(s, d), "daily", "Yaror")


@query(_TAGS + """, n AS (SELECT DISTINCT doc_id FROM documents WHERE source = 'inbox' AND doc_id NOT IN (SELECT doc_id FROM r WHERE tag = 'daily'))
SELECT doc_id, tag, pos FROM r UNION ALL SELECT n.doc_id, 'daily', coalesce((SELECT max(pos) FROM r WHERE r.doc_id = n.doc_id), -1) + 1 FROM n""")
def tag_add(s, d):
    return G_.add_tag(_rows(s, d), table(s, d, "documents").where(F.col("source") == "inbox"), "daily")


@query(_TAGS + "SELECT doc_id, tag, pos FROM r WHERE NOT (tag = 'daily' AND doc_id IN (SELECT doc_id FROM documents WHERE source = 'inbox'))")
def tag_remove(s, d):
    return G_.remove_tag(_rows(s, d), "daily", table(s, d, "documents").where(F.col("source") == "inbox")).select("doc_id", "tag", "pos")


@query(_TAGS + """, l AS (SELECT doc_id, trim(lab) AS tag FROM (SELECT doc_id, unnest(labels) AS lab FROM documents) WHERE trim(lab) <> '')
SELECT DISTINCT doc_id, tag FROM (SELECT doc_id, tag FROM r UNION ALL SELECT doc_id, tag FROM l)""")
def tag_seed_from_labels(s, d):
    return G_.seed_from_labels(table(s, d, "documents"), _rows(s, d)).select("doc_id", "tag")


@query(_TAGS + "SELECT tag, doc_id, rn AS r FROM (SELECT tag, doc_id, row_number() OVER (PARTITION BY tag ORDER BY doc_id) AS rn FROM r WHERE doc_id IN (SELECT doc_id FROM documents WHERE deleted_at IS NULL)) WHERE rn <= 5")
def tag_samples(s, d):
    return G_.samples(table(s, d, "documents"), _rows(s, d))


@query(_TAGS + """, t AS (SELECT tag, row_number() OVER (ORDER BY count(*) DESC, tag) AS slot FROM r GROUP BY tag QUALIFY slot <= 8)
SELECT doc_id, arg_min(tag, slot) AS tag, min(slot) AS slot FROM r JOIN t USING (tag) GROUP BY 1""")
def tag_colours(s, d):
    return G_.colour_slots(_rows(s, d))


@query(_TAGS + "SELECT d.doc_id, coalesce((SELECT list(tag ORDER BY pos, tag) FROM r WHERE r.doc_id = d.doc_id), []) AS tags FROM documents d")
def notes_with_tags(s, d):
    return G_.with_tags(table(s, d, "documents").select("doc_id"), _rows(s, d))


@query(_TAGS + "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM r WHERE tag IN ('daily', 'Yaror', 'dorlan'))")
def scope_any_tag(s, d):
    return G_.having_any(table(s, d, "documents"), _rows(s, d), ["daily", "Yaror", "dorlan"]).select("doc_id")


@query(_TAGS + "SELECT doc_id FROM r WHERE tag IN ('daily', 'Yaror') AND doc_id IN (SELECT doc_id FROM documents) GROUP BY doc_id HAVING count(*) = 2")
def scope_all_tags(s, d):
    return G_.having_all(table(s, d, "documents"), _rows(s, d), ["daily", "Yaror"]).select("doc_id")


@query("SELECT doc_id FROM documents WHERE created_at::date BETWEEN DATE '2022-01-01' AND DATE '2022-12-31'")
def scope_dates(s, d):
    return G_.created_between(table(s, d, "documents"), "2022-01-01", "2022-12-31").select("doc_id")


@query(_TAGS + "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM r WHERE tag IN ('daily', 'Yaror') AND doc_id IS NOT NULL)")
def scope_excluded(s, d):
    return G_.without_excluded(table(s, d, "documents"), _rows(s, d), table(s, d, "tags").where(F.col("name").isin("daily", "Yaror")).select(F.col("name").alias("tag"))).select("doc_id")


@query(_TAGS + """, pool AS (SELECT tag, doc_id AS other, row_number() OVER (PARTITION BY tag ORDER BY doc_id) AS rn FROM r QUALIFY rn <= 11)
SELECT doc_id, tag, other FROM (SELECT r.doc_id, r.tag, other, row_number() OVER (PARTITION BY r.doc_id, r.tag ORDER BY other) AS n FROM r JOIN pool USING (tag)
  WHERE r.doc_id % 100 = 0 AND other <> r.doc_id) WHERE n <= 10""")
def shared_tag_neighbours(s, d):
    rows = _rows(s, d)
    return G.shared_tag_neighbours(rows, rows.where(F.col("doc_id") % 100 == 0).select("doc_id").distinct())


# Ingest


def _versions(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A next snapshot made of the table: every 7th note is gone, every 11th edited."""
    docs = table(s, d, "documents").select("id", "source_key", "content_hash", "deleted_at", "doc_id")
    new = docs.where(F.col("doc_id") % 7 != 0).withColumn("content_hash", F.when(F.col("doc_id") % 11 == 0, F.sha2("id", 256)).otherwise(F.col("content_hash")))
    return new, docs


_CHANGES = """WITH o AS (SELECT id, content_hash AS h, deleted_at IS NOT NULL AS gone, doc_id FROM documents),
n AS (SELECT id, CASE WHEN doc_id % 11 = 0 THEN sha256(id) ELSE h END AS h FROM o WHERE doc_id % 7 <> 0),
c AS (SELECT o.id, CASE WHEN n.id IS NULL THEN (CASE WHEN NOT gone THEN 'removed' END) WHEN n.h IS DISTINCT FROM o.h THEN 'updated' WHEN gone THEN 'added' ELSE 'unchanged' END AS change_type,
  n.id IS NOT NULL AND n.h IS NOT DISTINCT FROM o.h AND gone AS restored FROM o LEFT JOIN n USING (id))
"""


@query(_CHANGES + "SELECT * FROM c WHERE change_type IS NOT NULL")
def cdc_change_set(s, d):
    return I.change_set(*_versions(s, d))


@query(_CHANGES + "SELECT " + ", ".join(f"count(*) FILTER (change_type = '{k}') AS {k}" for k in ("added", "updated", "removed", "unchanged")) + ", count(*) FILTER (restored AND change_type IS NOT NULL) AS restored FROM c")
def cdc_counts(s, d):
    return I.change_counts(I.change_set(*_versions(s, d)))


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN coalesce(deleted_at, TIMESTAMP '2024-06-01') END AS deleted_at FROM documents")
def cdc_apply(s, d):
    return I.apply_snapshot(*_versions(s, d), AT).select("doc_id", F.col("deleted_at").cast("timestamp_ntz").alias("deleted_at"))


@query("SELECT DISTINCT content_hash FROM documents WHERE deleted_at IS NULL AND content_hash IS NOT NULL AND content_hash NOT IN (SELECT content_hash FROM documents JOIN embeddings ON doc_id = vec_id WHERE content_hash IS NOT NULL)")
def missing_vectors(s, d):
    docs = table(s, d, "documents")
    vectors = docs.join(table(s, d, "embeddings"), F.col("doc_id") == F.col("vec_id")).select("content_hash").distinct()
    return I.missing_hashes(docs, vectors)


@query("SELECT 'dense' AS name, count(*) AS rows, " + " || '-' || ".join(f"sum(('0x' || substr(md5(content_hash), {i}, 8))::bigint)::varchar" for i in (1, 9, 17, 25)) + " AS fingerprint FROM documents WHERE deleted_at IS NULL")
def index_fingerprint(s, d):
    return I.fingerprint(table(s, d, "documents"), "dense")


@query("SELECT doc_id, id, content_hash FROM documents WHERE content_hash IS NOT NULL AND external_id IS NOT NULL AND source_key IS NOT NULL")
def document_identity(s, d):
    """Stable ids and content hashes made anew from the rows."""
    docs = table(s, d, "documents").where(F.col("content_hash").isNotNull() & F.col("external_id").isNotNull() & F.col("source_key").isNotNull())
    made = T.content_hash(F.coalesce("title", F.lit("")), F.coalesce("body", F.lit("")))
    return docs.select("doc_id", T.stable_id(F.col("source_key"), F.col("external_id")).alias("id"), made.alias("content_hash"))


@query("""SELECT source_key, count(*) AS loads, count(*) FILTER (finished_at IS NULL) AS broken, sum(added)::bigint AS added, sum(removed)::bigint AS removed, arg_max(id, started_at) AS last_id FROM imports GROUP BY 1""")
def import_history(s, d):
    i = table(s, d, "imports")
    return i.groupBy("source_key").agg(F.count("*").alias("loads"), F.count_if(F.col("finished_at").isNull()).alias("broken"), F.sum("added").alias("added"), F.sum("removed").alias("removed"), F.max_by("id", "started_at").alias("last_id"))


@query(CHUNKS + "SELECT doc_id, chunk_index::int AS chunk_index, length(chunk) AS n, md5(chunk) AS key FROM k")
def chunk_documents(s, d):
    return R.chunks(table(s, d, "documents")).select("doc_id", "chunk_index", F.length("chunk").alias("n"), F.md5("chunk").alias("key"))


# Chats


def _chat(s: SparkSession, d: str) -> DataFrame:
    return C.messages(table(s, d, "chat_messages"))


_CHAT = "WITH m AS (SELECT DISTINCT message_id, session_id, turn, lower(trim(role)) AS role, content, created_at FROM chat_messages)\n"


@query(_CHAT + "SELECT session_id, count(*) AS n_messages, max(created_at) AS updated_at FROM m GROUP BY 1")
def session_list(s, d):
    return C.sessions(_chat(s, d))


@query(_CHAT + """, t AS (SELECT session_id, arg_min(CASE WHEN length(trim(content)) > 80 THEN left(trim(content), 80) || '...' ELSE trim(content) END, (turn, message_id)) AS t FROM m WHERE role = 'user' AND trim(content) <> '' GROUP BY 1)
SELECT session_id, coalesce(t, 'New Chat') AS title FROM (SELECT DISTINCT session_id FROM m) LEFT JOIN t USING (session_id)""")
def session_titles(s, d):
    return C.auto_titles(_chat(s, d))


@query(_CHAT + """SELECT session_id, turn, role, message_id, greatest(n - 6, 0) AS older, n > 8 AS summarise FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC, message_id DESC) AS back, count(*) OVER (PARTITION BY session_id) AS n FROM m) WHERE back <= 6""")
def recent_window(s, d):
    return C.recent(_chat(s, d))


@query(_CHAT + "SELECT session_id, turn, message_id, array_to_string(list(content) OVER (PARTITION BY session_id ORDER BY turn, message_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), ' ') AS context FROM m WHERE role = 'user' AND content IS NOT NULL")
def user_context(s, d):
    return C.user_context(_chat(s, d))


@query(_CHAT + r""", n AS (SELECT message_id, unnest(regexp_extract_all(array_to_string(regexp_extract_all(content, '\[Note #\d+(?:, ?#\d+)*\]'), ' '), '#(\d+)', 1)) AS x, generate_subscripts(regexp_extract_all(array_to_string(regexp_extract_all(content, '\[Note #\d+(?:, ?#\d+)*\]'), ' '), '#(\d+)', 1), 1) AS p FROM m WHERE content IS NOT NULL),
f AS (SELECT message_id, x::int AS number, min(p) AS p FROM n GROUP BY 1, 2)
SELECT message_id, number, row_number() OVER (PARTITION BY message_id ORDER BY p) - 1 AS place FROM f""")
def citations(s, d):
    return C.citations(_chat(s, d))


@query(_CHAT + """, l AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY turn DESC, message_id DESC) <= 6)
SELECT session_id, sum(ceil(length(coalesce(content, '')) / 4))::bigint + 200 AS tokens, round(100 * (sum(ceil(length(coalesce(content, '')) / 4)) + 200) / 8192, 1) AS pct FROM l GROUP BY 1""")
def token_budget(s, d):
    return C.token_budget(_chat(s, d))


@query(_CHAT + "SELECT session_id, turn AS seq, b AS before FROM (SELECT session_id, turn, lag(turn) OVER (PARTITION BY session_id ORDER BY turn, message_id) AS b FROM m WHERE message_id % 5 <> 0) WHERE turn - b <> 1")
def sequence_gaps(s, d):
    """Gaps in the sessions' turns when every fifth message is lost on its way."""
    return C.sequence_gaps(_chat(s, d).where(F.col("message_id") % 5 != 0))


@query(_CHAT + """, n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn, message_id) AS seq FROM m)
SELECT session_id, seq::int AS seq, '{"type":"delta",' || CASE WHEN content IS NULL THEN '' ELSE '"content":' || to_json(content)::varchar || ',' END || '"seq":' || seq || '}' AS frame FROM n""")
def message_frames(s, d):
    return C.frames(_chat(s, d))


# Events and entities


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
w AS (SELECT event_id, user_id, i, true AS accepted, [us] AS kept FROM e WHERE i = 1 UNION ALL
 SELECT e.event_id, e.user_id, e.i, len(list_filter(kept, lambda x: x > e.us - 86400000000)) < 3, CASE WHEN len(list_filter(kept, lambda x: x > e.us - 86400000000)) < 3 THEN list_append(list_filter(kept, lambda x: x > e.us - 86400000000), e.us) ELSE kept END FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1)
SELECT event_id, user_id, accepted FROM w""")
def rate_limit(s, d):
    """At most three accepted events of a user in a day."""
    return L.limit_batch(table(s, d, "events"), limit=3, window=86400.0).drop("ts")


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_hourly(s, d):
    h = L.hourly(table(s, d, "events"))
    return h.select(F.col("hour").cast("timestamp_ntz").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


@query()
def entity_mentions(s, d):
    return E.mentions(table(s, d, "documents"))


@query()
def entity_aliases(s, d):
    return E.aliases(E.mentions(table(s, d, "documents")))
