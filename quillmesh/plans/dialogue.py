"""Queries of answers, chats and the signals of search beside words and vectors, with their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmesh.functions import text as T
from quillmesh.functions.encode import encoded
from quillmesh.operators import answers as A
from quillmesh.operators import chat as C
from quillmesh.operators import entities as E
from quillmesh.operators import evaluation as V
from quillmesh.operators import ranking as K
from quillmesh.operators import retrieval as R
from quillmesh.operators import tags as G
from quillmesh.plans.library import _LISTED, _listed, _names
from quillmesh.plans.notes import _CHAT, CHUNKS, _chat, _rows
from quillmesh.plans.registry import Registry
from quillmesh.plans.search import _BM25, _DENSE, _dense, _fused_head, _FUSED, _keyword_blocks, _queries, enc
from quillmesh.session import cut
from quillmesh.session import read_table as table

query = Registry()
QUERIES, SQL = query.queries, query.sql

#: Notes of a message's context: those of the five ids from the message's number on.
CONTEXT = 5


def _answers(s: SparkSession, d: str) -> DataFrame:
    return _chat(s, d).where((F.col("role") == "assistant") & F.col("content").isNotNull()).select("message_id", "content")


def _context(s: SparkSession, d: str) -> DataFrame:
    """(message_id, position, doc_id, note): every answer's context."""
    docs = table(s, d, "documents").select("doc_id", F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("body", F.lit(""))).alias("note"))
    places = _answers(s, d).select("message_id", F.explode(F.sequence(F.lit(1), F.lit(CONTEXT))).alias("position"))
    return places.withColumn("doc_id", F.pmod(F.col("message_id") + F.col("position"), F.lit(997))).join(docs, "doc_id")


_WORDS = "list_distinct(list_filter(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}]+'), lambda x: length(x) > 1))"
_DENY = "['not', 'no', 'never', 'nicht', 'kein', 'keine', 'nie', 'non', 'ne', 'pas', 'jamais', 'nunca', 'не', 'няма', 'mai']"
_MARKS = "'\\[Note\\s*#\\s*\\d+(?:\\s*,\\s*#\\s*\\d+)*\\]'"
_BARE = "trim(regexp_replace(trim(regexp_replace({x}, " + _MARKS + ", '', 'g'), ' '), '^[\\s*#>-]+', ''), ' ')"
# Sentences: a mark behind each end of one that blanks follow.
_SENT = "string_split(regexp_replace(l, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"
_LINES = """an AS (SELECT message_id, content FROM m WHERE role = 'assistant' AND content IS NOT NULL),
ln AS (SELECT message_id, trim(l, ' ') AS l, j FROM (SELECT message_id, unnest(string_split(content, chr(10))) AS l, generate_subscripts(string_split(content, chr(10)), 1) AS j FROM an)),
"""
_CLAIMS = _CHAT.rstrip() + ", " + _LINES + f"""se AS (SELECT message_id, j, unnest({_SENT}) AS p, generate_subscripts({_SENT}, 1) AS i FROM ln WHERE length(l) >= 15 AND l NOT LIKE '#%'),
cl AS (SELECT message_id, row_number() OVER (PARTITION BY message_id ORDER BY j, i) - 1 AS claim_no, {_BARE.format(x='p')} AS text, nullif(regexp_extract(p, '\\[Note\\s*#(\\d+)', 1), '')::int AS cited FROM se WHERE length(trim(p, ' ')) >= 15 AND length({_BARE.format(x='p')}) >= 15)
"""
_CITED = f""", nu AS (SELECT DISTINCT message_id, unnest(regexp_extract_all(array_to_string(regexp_extract_all(content, '\\[Note #\\d+(?:, ?#\\d+)*\\]'), ' '), '#(\\d+)', 1))::int AS number FROM an),
sa AS (SELECT message_id, j, unnest({_SENT}) AS p, generate_subscripts({_SENT}, 1) AS i FROM ln WHERE l <> ''),
cc AS (SELECT message_id, number, {_BARE.format(x="string_agg(p, ' ' ORDER BY j, i)")} AS claim FROM nu JOIN sa USING (message_id) WHERE regexp_matches(p, '\\[Note\\s*#\\s*' || number || '(?:\\s*,\\s*#\\s*\\d+)*\\]') GROUP BY 1, 2)
"""
_CTX = """, cx AS (SELECT message_id, position, doc_id, coalesce(title, '') || ' ' || coalesce(body, '') AS note FROM an, range(1, 6) g(position), documents WHERE doc_id = (message_id + position) % 997)
"""
_LOGITS = f"""wo AS (SELECT *, {_WORDS.format(x='claim')} AS a, {_WORDS.format(x='left(note, 500)')} AS b FROM pr),
sh AS (SELECT *, CASE WHEN len(a) > 0 THEN len(list_intersect(a, b)) / len(a) ELSE 0 END AS share, list_has_any(a, {_DENY}) <> list_has_any(b, {_DENY}) AS against FROM wo),
ex AS (SELECT *, exp(CASE WHEN against THEN 4 * share ELSE 0 END) AS c, exp(CASE WHEN against THEN 0 ELSE 4 * share END) AS e, exp(1.5) AS n FROM sh),
pb AS (SELECT *, round(c / (c + e + n), 6) AS contra, round(e / (c + e + n), 6) AS entail, round(n / (c + e + n), 6) AS neutral FROM ex)
"""


@query(_CLAIMS + "SELECT message_id, claim_no::int AS claim_no, text, coalesce(cited, 0) AS cited FROM cl")
def answer_claims(s, d):
    """Claims of the answers; 0 for those that cite no note."""
    return A.answer_claims(_answers(s, d)).fillna(0, ["cited"])


@query(_CLAIMS + _CITED + "SELECT message_id, number, claim FROM cc WHERE claim <> ''")
def cited_contexts(s, d):
    m = _answers(s, d)
    return A.cited_contexts(m, C.citations(m).select("message_id", "number"))


@query(_CLAIMS + _CITED + _CTX + ", pr AS (SELECT cc.message_id, number, claim, note FROM cc JOIN cx ON cc.message_id = cx.message_id AND number = position WHERE claim <> ''), " + _LOGITS + """SELECT message_id, number, round(entail, 2) AS support, round(contra, 2) AS contradiction,
 CASE WHEN entail > contra AND entail > neutral THEN 'supported' WHEN contra > entail AND contra > neutral THEN 'contradicted' ELSE 'neutral' END AS verdict FROM pb""")  # fmt: skip
def verified_citations(s, d):
    """Every citation of an answer against its note, by the default model."""
    return A.verify_citations(cited_contexts(s, d), _context(s, d))


_GROUND = _CLAIMS + _CTX + """, sz AS (SELECT message_id, claim_no, max(coalesce(position, 0)) AS size FROM cl LEFT JOIN cx USING (message_id) GROUP BY 1, 2),
pr AS (SELECT cl.message_id, claim_no, text AS claim, coalesce(note, '') AS note, cited, position, coalesce(cited, 0) >= 1 AND cited <= size AS alone FROM cl LEFT JOIN cx USING (message_id) JOIN sz USING (message_id, claim_no)), """ + _LOGITS + """,
be AS (SELECT message_id, claim_no, bool_or(coalesce(alone, false)) AS alone, max(CASE WHEN position IS NULL THEN 0 ELSE entail END) AS e, max(contra) AS c FROM pb WHERE coalesce(NOT alone OR position = cited, true) GROUP BY 1, 2),
gr AS (SELECT message_id, claim_no, round(e, 2) AS score, CASE WHEN alone THEN (CASE WHEN e > c AND e > 0.3 THEN 'supported' WHEN c > e AND c > 0.5 THEN 'contradicted' ELSE 'neutral' END) WHEN e > 0.3 THEN 'supported' WHEN e > 0.15 THEN 'neutral' ELSE 'unsupported' END AS verdict FROM be)
"""  # fmt: skip


@query(_GROUND + "SELECT message_id, claim_no::int AS claim_no, score, verdict FROM gr")
def grounded_claims(s, d):
    return A.ground(answer_claims(s, d), _context(s, d))


@query(_GROUND + ", pe AS (SELECT message_id, count(*) AS claims, count(*) FILTER (verdict = 'supported') AS grounded FROM gr GROUP BY 1) SELECT message_id, coalesce(claims, 0) AS claims, coalesce(grounded, 0) AS grounded, CASE WHEN claims > 0 THEN round(grounded / claims, 2) ELSE 1 END AS score FROM an LEFT JOIN pe USING (message_id)")
def grounding_scores(s, d):
    return A.grounding_scores(_answers(s, d), grounded_claims(s, d))


@query(_CLAIMS + "SELECT message_id, trim(regexp_replace(content, " + _MARKS + ", '', 'g'), ' ') AS plain FROM an")
def answers_without_marks(s, d):
    return _answers(s, d).select("message_id", A.without_marks(F.col("content")).alias("plain"))


@query(_CLAIMS + """, bad AS (SELECT message_id, content, list_filter(list_transform(regexp_extract_all(content, '\\[Note #(\\d+)\\]', 1), lambda x: x::int), lambda x: x < 1 OR x > 3) AS b FROM an)
SELECT message_id, CASE WHEN len(b) = 0 THEN content ELSE regexp_replace(content, '\\[Note #(0|' || array_to_string(list_distinct(b), '|') || ')\\]', '', 'g') END AS checked FROM bad""")
def checked_citations(s, d):
    """Answers without single citations beyond a context of three notes."""
    return _answers(s, d).select("message_id", T.strip_invalid_citations(F.col("content"), F.lit(3)).alias("checked"))


@query(_CLAIMS + _CTX + """, rg AS (SELECT doc_id, list(tag ORDER BY pos, tag) AS tags FROM (SELECT doc_id, name AS tag, min(pos) AS pos FROM doc_tags JOIN tags ON tag_id = id GROUP BY 1, 2) GROUP BY 1)
SELECT message_id, position::int AS position, md5('--- Note #' || position || ' ---' || chr(10) || 'Title: ' || coalesce(title, 'Untitled Note') || chr(10) || 'Created: ' || coalesce(strftime(created_at, '%Y-%m-%d'), 'Unknown') || ' | Last edited: ' || coalesce(strftime(edited_at, '%Y-%m-%d'), 'Unknown')
 || CASE WHEN len(tags) > 0 THEN chr(10) || 'Tags: ' || array_to_string(tags, ', ') ELSE '' END || chr(10) || chr(10) || coalesce(body, '') || chr(10) || '--- End Note #' || position || ' ---') AS key FROM cx JOIN documents USING (doc_id) LEFT JOIN rg USING (doc_id)""")
def context_blocks(s, d):
    """The notes of each answer's context as a prompt shows them."""
    docs = G.with_tags(table(s, d, "documents"), _rows(s, d))
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c[:-3])
    shown = docs.select("doc_id", "title", day("created_at"), day("edited_at"), "tags", F.col("body").alias("content"))
    return A.note_blocks(_context(s, d).drop("note").join(shown, "doc_id")).select("message_id", "position", F.md5("block").alias("key"))


@query(_CLAIMS + _CTX + ", al AS (SELECT message_id, ceil(length(content) / 4) AS t FROM an UNION ALL SELECT message_id, ceil(length(note) / 4) FROM cx) SELECT message_id, sum(t)::bigint + 200 AS tokens, round(100 * (sum(t) + 200) / 8192, 1) AS pct FROM al GROUP BY 1")
def context_budget(s, d):
    return A.context_budget(_answers(s, d), _context(s, d))


_CV = "WITH " + enc("dv", "documents", "doc_id", "text")


@query(_CV + """, gr AS (SELECT source_key || ':' || (doc_id // 20) AS group_id, doc_id FROM documents), sm AS (SELECT group_id FROM gr GROUP BY 1 HAVING count(*) <= 25),
pr AS (SELECT x.group_id, x.doc_id AS a, y.doc_id AS b, round(list_dot_product(u.embedding, v.embedding), 6) AS sim FROM gr x JOIN gr y ON x.group_id = y.group_id AND x.doc_id < y.doc_id JOIN sm ON sm.group_id = x.group_id JOIN dv u ON u.doc_id = x.doc_id JOIN dv v ON v.doc_id = y.doc_id)
SELECT group_id, a, b, sim FROM pr WHERE sim > 0.85 QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY sim DESC, a DESC, b DESC) <= 20""")
def conflict_pairs(s, d):
    """Pairs of similar notes within results of up to 25: the notes of a source with neighbouring ids."""
    docs = table(s, d, "documents").select("doc_id", F.concat("source_key", F.lit(":"), F.floor(F.col("doc_id") / 20).cast("string")).alias("group_id"), "text").where(F.col("group_id").isNotNull())
    return A.conflict_pairs(encoded(docs, F.col("text")).drop("text"))


@query("WITH " + _DENSE + """, h AS (SELECT query_id, d.doc_id, r, embedding FROM d JOIN embeddings ON vec_id = d.doc_id WHERE r <= 10),
m AS (SELECT x.query_id, round(avg(list_cosine_similarity(x.embedding::double[], y.embedding::double[])), 6) AS mean_sim FROM h x JOIN h y ON x.query_id = y.query_id AND x.r < y.r GROUP BY 1)
SELECT query_id, count(*) AS n, any_value(mean_sim) AS mean_sim, CASE WHEN count(*) > 5 AND any_value(mean_sim) > 0.05 THEN 5 ELSE count(*) END AS kept FROM d LEFT JOIN m USING (query_id) GROUP BY 1""")
def saturated_results(s, d):
    """Results whose first ten are much alike are cut to five; the limit is low, since the vectors of the table lie far apart."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    ranked = _dense(s, d).select("query_id", "doc_id", F.row_number().over(w).alias("rank"))
    return A.saturation(ranked, table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), 0.05)


@query(_CHAT.rstrip() + ", us AS (SELECT message_id, session_id, content FROM m WHERE role = 'user' AND content IS NOT NULL), " + enc("uv", "us", "message_id", "content") + """, hit AS (SELECT DISTINCT y.message_id FROM us x JOIN us y ON x.session_id = y.session_id AND x.message_id < y.message_id JOIN uv a ON a.message_id = x.message_id JOIN uv b ON b.message_id = y.message_id WHERE round(list_dot_product(a.embedding, b.embedding), 6) > 0.95)
SELECT session_id, message_id, message_id IN (SELECT message_id FROM hit) AS repeated FROM us""")
def repeated_questions(s, d):
    """Questions that nearly repeat an earlier one of their session."""
    m = _chat(s, d).where((F.col("role") == "user") & F.col("content").isNotNull()).select("session_id", "message_id", "content")
    return A.repeated_queries(encoded(m, F.col("content")).drop("content"), "session_id", "message_id")


@query("WITH " + _DENSE + """, st AS (SELECT query_id, ((r - 1) // 10 + 1)::int AS step, count(*) AS found, count(*) FILTER (doc_id % 3 > 0) AS fresh FROM d WHERE r <= 40 GROUP BY 1, 2),
x AS (SELECT *, sum(fresh) OVER (PARTITION BY query_id ORDER BY step) AS collected, (SELECT avg(score) FROM d WHERE d.query_id = st.query_id AND r <= 3) AS top FROM st),
y AS (SELECT query_id, step, CASE WHEN step >= 4 THEN 'max steps reached' WHEN collected >= 250 THEN 'note limit reached' WHEN collected < 3 THEN 'too few notes collected' WHEN fresh / found < 0.6 THEN 'searches returning mostly duplicates' WHEN top >= 0.36 THEN 'collected notes match query well' ELSE 'coverage below threshold' END AS reason FROM x)
SELECT query_id, step, reason NOT IN ('too few notes collected', 'coverage below threshold') AS stop, reason FROM y""")
def search_coverage(s, d):
    """When a search by steps of ten results would stop; every third note counts as seen before."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    ranked = _dense(s, d).withColumn("r", F.row_number().over(w))
    top = ranked.where(F.col("r") <= 3).groupBy("query_id").agg(F.avg("score").alias("top"))
    steps = ranked.where(F.col("r") <= 40).groupBy("query_id", (F.floor((F.col("r") - 1) / 10) + 1).cast("int").alias("step")).agg(F.count("*").alias("found"), F.count_if(F.col("doc_id") % 3 > 0).alias("fresh"))
    steps = steps.withColumn("collected", F.sum("fresh").over(Window.partitionBy("query_id").orderBy("step"))).join(top, "query_id")
    return A.coverage(steps, similar=0.36, novel=0.6, max_steps=4)

@query(_CLAIMS + _CITED + _CTX + ", nf AS (SELECT message_id, x::int AS number, min(i) AS p FROM (SELECT message_id, unnest(z) AS x, generate_subscripts(z, 1) AS i FROM (SELECT message_id, regexp_extract_all(array_to_string(regexp_extract_all(content, '\\[Note #\\d+(?:, ?#\\d+)*\\]'), ' '), '#(\\d+)', 1) AS z FROM an)) GROUP BY 1, 2) SELECT nf.message_id, number, doc_id FROM nf JOIN cx ON cx.message_id = nf.message_id AND position = number")
def resolved_citations(s, d):
    """The notes that answers cite; numbers beyond the context name none."""
    m = _answers(s, d)
    return C.resolve_citations(C.citations(m), _context(s, d).drop("note")).select("message_id", "number", "doc_id")



# Signals


_CHUNKED = CHUNKS.rstrip() + ", ck AS (SELECT doc_id * 100000 + chunk_index AS cid, doc_id, chunk_index, chunk FROM k), " + enc("cv", "ck", "cid", "chunk") + ", tq AS (SELECT doc_id AS query_id, title FROM documents WHERE doc_id % 100 = 0 AND title IS NOT NULL), " + enc("qv", "tq", "query_id", "title") + """, cs AS (SELECT query_id, doc_id, chunk_index, round(list_dot_product(qv.embedding, cv.embedding), 6) AS score FROM qv CROSS JOIN cv JOIN ck USING (cid)),
cb AS (SELECT query_id, doc_id, arg_min(chunk_index, (-score, chunk_index))::int AS chunk_index, max(score) AS score FROM cs WHERE score >= 0.2 GROUP BY 1, 2)
"""


def _chunk_search(s: SparkSession, d: str, threshold: float = 0.2) -> DataFrame:
    chunks = encoded(R.chunks(table(s, d, "documents")), F.col("chunk")).select("doc_id", "chunk_index", "embedding")
    q = encoded(_queries(s, d), F.col("q")).select("query_id", "embedding")
    return R.search_chunks(chunks, q, threshold)


@query(_CHUNKED + "SELECT query_id, doc_id, chunk_index, score FROM cb QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 10")
def chunk_search(s, d):
    """The ten notes with the best chunks for each query."""
    return R.top(_chunk_search(s, d), 10)


_ENT = "SELECT DISTINCT x.doc_id AS query_id, y.doc_id FROM l x JOIN l y USING (surface) WHERE x.doc_id % 100 = 0"


def _entity_signal(s: SparkSession, d: str) -> DataFrame:
    index = _listed(s, d).select(F.col("surface").alias("canonical"), "doc_id").distinct()
    return E.entity_signal(index, index.where(F.col("doc_id") % 100 == 0).select(F.col("doc_id").alias("query_id"), "canonical"))


@query("WITH l AS (" + _LISTED.replace("{docs}", "documents") + ") SELECT query_id, doc_id, 1.0::double AS score FROM (" + _ENT + ")")
def entity_search(s, d):
    """Notes that name a person whom the queried note names."""
    return _entity_signal(s, d)


def _rung(number: int, lists: str) -> str:
    return f"""u{number} AS ({lists}), f{number} AS (SELECT query_id, doc_id, round(sum(1 / (60 + r)), 9) AS fused, min((s, r)) AS first FROM u{number} GROUP BY 1, 2),
k{number} AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, first[1], first[2], doc_id) AS rank FROM f{number}), h{number} AS (SELECT query_id, count(*) FILTER (rank <= 10) AS hits, min(rank) AS first, sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM k{number} JOIN qr USING (query_id, doc_id) GROUP BY 1),
m{number} AS (SELECT '{number}' AS rung, count(*) AS queries, round(avg(coalesce(hits / n, 0)), 6) AS recall, round(avg(coalesce(1 / first, 0)), 6) AS mrr, round(avg(coalesce(dcg / idcg, 0)), 6) AS ndcg FROM ii LEFT JOIN h{number} USING (query_id))"""


_LISTS = ["SELECT query_id, doc_id, 0 AS s, r FROM d", "SELECT query_id, doc_id, 1 AS s, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS r FROM b",
          "SELECT query_id, doc_id, 2 AS s, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS r FROM (" + _ENT + ")", "SELECT query_id, doc_id, 3 AS s, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM cb"]
_OVER = "list_distinct(list_filter(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}]+'), lambda x: length(x) > 1))"
_LADDER = _BM25 + ", " + _DENSE + ", " + _CHUNKED.split("WITH ", 1)[1].replace("n AS (SELECT doc_id, coalesce(title", "cn AS (SELECT doc_id, coalesce(title").replace("FROM n WHERE whole", "FROM cn WHERE whole").replace("g AS (SELECT doc_id, title, whole, CASE", "cg AS (SELECT doc_id, title, whole, CASE").replace("ELSE grown END AS grown FROM g)", "ELSE grown END AS grown FROM cg)").replace("l AS (SELECT doc_id, title, whole, CASE", "cl AS (SELECT doc_id, title, whole, CASE").replace("AS i FROM l))", "AS i FROM cl))") + ", l AS (" + _LISTED.replace("{docs}", "documents") + """),
rw AS (SELECT doc_id, name AS tag, min(pos) AS pos FROM doc_tags JOIN tags ON tag_id = id GROUP BY 1, 2), ft AS (SELECT doc_id AS query_id, arg_min(tag, (pos, tag)) AS tag FROM rw WHERE doc_id % 100 = 0 GROUP BY 1),
qr AS (SELECT DISTINCT query_id, doc_id FROM ft JOIN rw USING (tag) WHERE doc_id <> query_id), iq AS (SELECT query_id, count(*) AS n FROM qr GROUP BY 1), ii AS (SELECT *, (SELECT sum(1 / log2(g + 1)) FROM range(1, least(iq.n, 10) + 1) t(g)) AS idcg FROM iq), """ + ", ".join(_rung(n, " UNION ALL ".join(_LISTS[:n])) for n in range(1, 5)) + f""",
hw AS (SELECT k4.query_id, k4.doc_id, {_OVER.format(x='q.title')} AS a, {_OVER.format(x="left(concat_ws(' ', x.title, x.body), 400)")} AS b FROM k4 JOIN documents q ON q.doc_id = query_id AND q.title IS NOT NULL JOIN documents x ON x.doc_id = k4.doc_id WHERE rank <= 20),
sc AS (SELECT query_id, doc_id, CASE WHEN greatest(len(a), len(b)) > 0 THEN round(len(list_intersect(a, b)) / greatest(len(a), len(b)), 6) ELSE 0 END AS s FROM hw),
k5 AS (SELECT k4.query_id, k4.doc_id, CASE WHEN rank <= 20 THEN row_number() OVER (PARTITION BY k4.query_id ORDER BY rank > 20, coalesce(s, 0) DESC, rank) ELSE rank END AS rank FROM k4 LEFT JOIN sc USING (query_id, doc_id)), """ + _rung(5, "SELECT 1").split("k5 AS (", 1)[1].split("), ", 1)[1] + " " + " UNION ALL ".join(f"SELECT * FROM m{n}" for n in range(1, 6))  # fmt: skip


@query(_LADDER)
def signal_ladder(s, d):
    """What each signal adds to the metrics: vectors, then words, people, chunks, at last reranking the first 20; relevant are the notes with the queried note's first tag."""
    tags = cut(_rows(s, d).where(F.col("doc_id").isNotNull()))
    first = tags.where(F.col("doc_id") % 100 == 0).groupBy("doc_id").agg(F.min_by("tag", F.struct("pos", "tag")).alias("tag"))
    sizes = cut(first.join(tags.groupBy("tag").agg((F.count("*") - 1).alias("n")), "tag").where(F.col("n") > 0).select(F.col("doc_id").alias("query_id"), "tag", "n"))
    names = cut(E.listed_surfaces(table(s, d, "documents"), _names(s, d), F.col("body")))
    each: dict[int, dict] = {r["query_id"]: {"tag": r["tag"]} for r in sizes.collect()}
    for r in names.where(F.col("doc_id") % 100 == 0).collect():
        if r["doc_id"] in each:
            each[r["doc_id"]].setdefault("names", []).append(r["surface"])
    for r in encoded(_queries(s, d), F.col("q")).select("query_id", "embedding").collect():
        if r["query_id"] in each:
            each[r["query_id"]]["vector"] = r["embedding"]
    numbered = [{x: i for i, x in enumerate(sorted(xs))} for xs in ({x for e in each.values() for x in e.get("names", [])}, {e["tag"] for e in each.values()})]
    for e in each.values():
        e["names"], e["tag"] = [numbered[0][x] for x in e.get("names", [])], numbered[1][e["tag"]]
    lists = []
    for rows, label, number in ((names, "surface", numbered[0]), (tags, "tag", numbered[1])):
        known = F.broadcast(s.createDataFrame(list(number.items()), f"{label} string, number int"))
        lists.append(rows.join(known, label).groupBy("doc_id").agg(F.collect_list("number").alias("numbers")))
    chunks = K.packed_vectors(R.chunks(table(s, d, "documents")), F.col("chunk"))
    near = cut(_dense(s, d))
    found = cut(K.ladder(list(_keyword_blocks(s, d)), near, lists[0], chunks, lists[1], each, 0.2, table(s, d, "documents").count(), 20))
    parts = [V.judged(found.where(F.col("rel") & (F.col("rung") == n)), sizes).withColumn("rung", F.lit(str(n))) for n in range(1, 5)]
    fused = found.where(F.col("rung") == 4)
    docs = table(s, d, "documents").select("doc_id", F.substring(F.concat_ws(" ", "title", "body"), 1, 400).alias("t"))
    scored = fused.where(F.col("rank") <= 20).join(docs, "doc_id").join(_queries(s, d), "query_id").select("query_id", "doc_id", F.round(R.overlap_score(F.col("q"), F.col("t")), 6).alias("new_score"))
    best = R.rerank(fused, scored, 20).withColumnRenamed("place", "rank").join(fused.where("rel").select("query_id", "doc_id"), ["query_id", "doc_id"])
    parts.append(V.judged(best, sizes).withColumn("rung", F.lit("5")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).unionByName(parts[4])


@query(_FUSED + f""", hw AS (SELECT k.query_id, k.doc_id, rank, {_OVER.format(x='q.title')} AS a, {_OVER.format(x="left(concat_ws(' ', x.title, x.body), 400)")} AS b FROM k JOIN documents q ON q.doc_id = query_id AND q.title IS NOT NULL JOIN documents x ON x.doc_id = k.doc_id WHERE rank <= 20),
sc AS (SELECT query_id, doc_id, rank, CASE WHEN greatest(len(a), len(b)) > 0 THEN round(len(list_intersect(a, b)) / greatest(len(a), len(b)), 6) ELSE 0 END AS s FROM hw),
al AS (SELECT k.query_id, k.doc_id, row_number() OVER (PARTITION BY k.query_id ORDER BY coalesce(s, 0) DESC, k.rank) AS place FROM k LEFT JOIN sc USING (query_id, doc_id) WHERE k.rank <= 20)
SELECT query_id, doc_id, place FROM al WHERE place <= 5""")
def agent_context(s, d):
    """The 20 best notes of each query reranked and cut to five: the tail is dropped."""
    fused = _fused_head(s, d, 20)
    docs = table(s, d, "documents").select("doc_id", F.substring(F.concat_ws(" ", "title", "body"), 1, 400).alias("t"))
    scored = fused.join(docs, "doc_id").join(_queries(s, d), "query_id").select("query_id", "doc_id", F.round(R.overlap_score(F.col("q"), F.col("t")), 6).alias("new_score"))
    return R.rerank(fused, scored, 20, tail=False).where(F.col("place") <= 5)


@query("WITH " + _DENSE + " SELECT query_id, doc_id, round(CASE WHEN doc_id IN (3, 30, 33, 333) THEN score * 1.15 ELSE score END, 6) AS score FROM d WHERE r <= 10")
def continued_search(s, d):
    """Results in which notes of the turn before count 1.15 times."""
    return R.boost_previous(R.top(_dense(s, d), 10), [3, 30, 33, 333]).withColumn("score", F.round("score", 6))
