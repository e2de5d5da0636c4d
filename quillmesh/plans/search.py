"""Queries for retrieval, tagging on vectors and evaluation, with their SQL equivalents.

The query set of the searches is stated: every note or vector whose id is divisible by 100, against all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmesh.functions import text as T
from quillmesh.functions.encode import encoded
from quillmesh.operators import evaluation as V
from quillmesh.operators import proposals as P
from quillmesh.operators import ranking as K
from quillmesh.operators import retrieval as R
from quillmesh.operators import tagging as G
from quillmesh.session import cut
from quillmesh.session import read_table as table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _vectors(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings")


def _text():
    return F.concat_ws(" ", "title", "body")


def _queries(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").where((F.col("doc_id") % 100 == 0) & F.col("title").isNotNull())
    return docs.select(F.col("doc_id").alias("query_id"), F.col("title").alias("q"))


def _keyword_blocks(s: SparkSession, d: str):
    return R.keyword_blocks(table(s, d, "documents"), T.cleaned_text(F.col("title"), F.col("body")), _queries(s, d))


def _bm25(s: SparkSession, d: str) -> DataFrame:
    return R.keyword_scores(_keyword_blocks(s, d), s)


def _dense(s: SparkSession, d: str, k: int = 50, threshold: float | None = None) -> DataFrame:
    v = _vectors(s, d).select(F.col("vec_id").alias("doc_id"), "embedding")
    q = v.where(F.col("doc_id") % 100 == 0).select(F.col("doc_id").alias("query_id"), "embedding")
    return R.dense(v, q, k, threshold, keep_self=False)


_WS = "[\\s\\p{Z}\\x0b\\x85]"
# Compatibility forms of characters that strip_accents leaves as they are.
_WIDE = "".join(chr(0xFF01 + i) for i in range(94)) + "\xa0³º"
_PLAIN = "".join(chr(0x21 + i) for i in range(94)) + " 3o"
_NORM = "replace(replace(strip_accents(lower(replace(replace(replace(replace(translate({x}, '" + _WIDE.replace("'", "''") + "', '" + _PLAIN.replace("'", "''") + "'), '…', '...'), 'ﬁ', 'fi'), '№', 'No'), '½', '1⁄2'))), '감', chr(4352) || chr(4449) || chr(4535)), '사', chr(4361) || chr(4449))"
CLEAN = f"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({{x}}, '^{_WS}+|{_WS}+$', '', 'g'), '(?s)\\A---\n.*?\n---\n?', ''), '(?s)```.*?```', ' ', 'g'),
 '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), 'https?://\\S+', ' ', 'g'), '[#*_>`~]+', ' ', 'g'), '{_WS}+', ' ', 'g'))"""


def clean_sql(x: str) -> str:
    return CLEAN.replace("{x}", x)


def norm_sql(x: str) -> str:
    return _NORM.replace("{x}", x)


_SEEN = clean_sql("regexp_replace(coalesce(title, ''), '^\\s*p\\s*[:\\-—]\\s+', '', 'i') || ' ' || coalesce(body, '')")
_TOK = "list_filter(regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}]+'), lambda x: length(x) > 1)"
_STEMMED = """list_transform({t}, lambda w: CASE WHEN NOT regexp_matches(w, '^[\\x00-\\x7f]*$') THEN w ELSE regexp_replace(
 CASE WHEN w LIKE '%ing' AND length(w) > 5 THEN left(w, -3) WHEN w LIKE '%ed' AND length(w) > 4 THEN left(w, -2) WHEN w LIKE '%es' AND length(w) > 4 THEN left(w, -2) ELSE w END, '^(...*[^s])s$', '\\1') END)"""
_T = _STEMMED.format(t=_TOK.format(x="p"))
_BM25 = f"""WITH t AS (SELECT doc_id, p, {_T} AS w FROM (SELECT doc_id, {norm_sql('c')} AS p FROM (SELECT doc_id, {_SEEN} AS c FROM documents))), st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM t),
p AS (SELECT term, doc_id, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, greatest(len(w), 1) AS dl, unnest(w) AS term FROM t) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
qp AS (SELECT doc_id AS query_id, {norm_sql('title')} AS p FROM documents WHERE doc_id % 100 = 0 AND title IS NOT NULL),
q0 AS (SELECT query_id, term, count(*) AS qf FROM (SELECT query_id, unnest({_T}) AS term FROM qp) GROUP BY 1, 2),
q1 AS (SELECT q0.*, df.df, coalesce(df.df, 0) <= 0.5 * (SELECT n FROM st) AS rare FROM q0 LEFT JOIN df USING (term)),
q AS (SELECT * FROM (SELECT *, bool_or(rare) OVER (PARTITION BY query_id) AS any_rare FROM q1) WHERE (rare OR NOT any_rare) AND df IS NOT NULL),
b0 AS (SELECT query_id, doc_id, sum(qf * ln(1 + (n - q.df + 0.5) / (q.df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM q JOIN p USING (term) CROSS JOIN st GROUP BY 1, 2),
b AS (SELECT query_id, doc_id, score * CASE WHEN length(qp.p) > 6 AND contains(t.p, qp.p) THEN 1.6 ELSE 1 END AS score FROM b0 JOIN qp USING (query_id) JOIN t USING (doc_id))
"""
_DENSE = """d AS (SELECT query_id, doc_id, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, doc_id) AS r FROM (
 SELECT a.vec_id AS query_id, b.vec_id AS doc_id, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) AS s FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id) WHERE round(s, 6) > {least} QUALIFY r <= 50)
"""
_NEAR = _DENSE.format(least=0.3)
_DENSE = _DENSE.format(least=-2)
_FUSED = _BM25 + ", " + _NEAR + """, u AS (SELECT query_id, doc_id, 0 AS s, r FROM d UNION ALL SELECT query_id, doc_id, 1 AS s, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS r FROM b),
f AS (SELECT query_id, doc_id, round(sum(1 / (60 + r)), 9) AS fused, min((s, r)) AS first FROM u GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, first[1], first[2], doc_id) AS rank FROM f)
"""


@query(_BM25 + "SELECT query_id, doc_id, round(round(score, 6), 4) AS score FROM b QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) <= 10")
def bm25_topk(s, d):
    ranked = _bm25(s, d).withColumn("score", F.round("score", 6))
    return R.top(ranked, 10).select("query_id", "doc_id", F.round("score", 4).alias("score"))


@query("WITH " + _DENSE + "SELECT query_id, doc_id, score FROM d WHERE r <= 10")
def dense_topk(s, d):
    """Neighbours of a vector by cosine, itself removed."""
    return _dense(s, d, 10)


def _fused(s, d):
    return R.fuse({"dense": _dense(s, d, threshold=R.NEAR), "keyword": _bm25(s, d)})


def _fused_head(s, d, k: int):
    """The first k of `_fused`, from the first k of keyword search and the ranks that it gives to the nearest vectors."""
    near = cut(_dense(s, d, threshold=R.NEAR))
    fused = R.fuse_ranks({"dense": R.ranked(near), "keyword": R.keyword_ranks(_keyword_blocks(s, d), near, k)})
    return cut(fused.where(F.col("rank") <= k))


@query(_FUSED + "SELECT query_id, doc_id, fused, rank FROM k WHERE doc_id IN (SELECT doc_id FROM documents WHERE deleted_at IS NULL) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 10")
def hybrid_search(s, d):
    """Keyword and vector search fused by reciprocal ranks; deleted notes go after ranking, as every scope."""
    live = table(s, d, "documents").where(F.col("deleted_at").isNull()).select("doc_id")
    scoped = _fused(s, d).join(live, "doc_id", "left_semi")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return scoped.withColumn("place", place).where(F.col("place") <= 10).select("query_id", "doc_id", "fused", "rank")


_DISTINCT = "list_distinct(list_filter(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}]+'), lambda x: length(x) > 1))"


@query(_FUSED + f""", hw AS (SELECT k.query_id, k.doc_id, {_DISTINCT.format(x='q.title')} AS a, {_DISTINCT.format(x="left(concat_ws(' ', x.title, x.body), 400)")} AS b FROM k JOIN documents q ON q.doc_id = query_id AND q.title IS NOT NULL JOIN documents x ON x.doc_id = k.doc_id WHERE rank <= 50),
sc AS (SELECT query_id, doc_id, CASE WHEN greatest(len(a), len(b)) > 0 THEN round(len(list_intersect(a, b)) / greatest(len(a), len(b)), 6) ELSE 0 END AS s FROM hw)
SELECT k.query_id, k.doc_id, CASE WHEN rank <= 50 THEN row_number() OVER (PARTITION BY k.query_id ORDER BY rank > 50, coalesce(s, 0) DESC, rank) ELSE rank END AS place FROM k LEFT JOIN sc USING (query_id, doc_id)""")
def reranked_search(s, d):
    """The first 50 of each query by word overlap, the rest behind."""
    blocks, near = list(_keyword_blocks(s, d)), cut(_dense(s, d, threshold=R.NEAR))
    head = cut(K.fused_lists(blocks, near, until=50))
    docs = table(s, d, "documents").select("doc_id", F.substring(_text(), 1, 400).alias("t"))
    scored = head.join(docs, "doc_id").join(_queries(s, d), "query_id").select("query_id", "doc_id", F.round(R.overlap_score(F.col("q"), F.col("t")), 6).alias("new_score"))
    return R.rerank(head, scored, tail=False).unionByName(K.fused_lists(blocks, near, after=50).withColumnRenamed("rank", "place"))


_CENT = """WITH m AS (SELECT label, i, avg(x::double) AS x FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE label >= 0) GROUP BY 1, 2),
n AS (SELECT label, sqrt(sum(x * x)) AS n FROM m GROUP BY 1),
c AS (SELECT label, list(x / n ORDER BY i) AS centroid FROM m JOIN n USING (label) GROUP BY 1),
z AS (SELECT label, count(*) AS size FROM embeddings GROUP BY 1),
s AS (SELECT vec_id, e.label AS own, c.label, round(list_cosine_similarity(e.embedding::double[], c.centroid), 6) AS sim FROM embeddings e CROSS JOIN c),
t AS (SELECT label, round(quantile_cont(sim, 0.1) * 0.75, 6) AS threshold FROM s WHERE own = label GROUP BY 1),
a0 AS (SELECT s.*, sim >= threshold AS ok, max(CASE WHEN sim >= threshold THEN sim END) OVER (PARTITION BY vec_id) AS best_ok, max(sim) OVER (PARTITION BY vec_id) AS best FROM s JOIN t USING (label)),
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, label) AS r FROM a0
  WHERE CASE WHEN best_ok IS NOT NULL THEN ok AND sim >= 0.85 * best_ok ELSE sim = best AND sim >= 0.45 END) WHERE r <= CASE WHEN best_ok IS NULL THEN 1 ELSE 3 END)
"""


def enc(name: str, source: str, key: str, text: str) -> str:
    """CTEs that end in name(key, embedding): the default encoder's vectors of a source's texts."""
    return f"""{name}_w AS (SELECT {key}, unnest(list_filter(regexp_extract_all(lower(coalesce({text}, '')), '[\\p{{L}}\\p{{N}}]+'), lambda x: length(x) > 1)) AS w FROM {source}),
{name}_v AS (SELECT {key}, ('0x' || left(md5(w), 8))::bigint % 64 AS b, sum(CASE WHEN ('0x' || substr(md5(w), 9, 1))::bigint % 2 = 1 THEN 1 ELSE -1 END) AS x FROM {name}_w GROUP BY 1, 2),
{name}_n AS (SELECT {key}, sqrt(sum(x * x)) AS n FROM {name}_v GROUP BY 1),
{name} AS (SELECT {key}, list(coalesce(x, 0) / coalesce(nullif(n, 0), 1) ORDER BY b) AS embedding FROM (SELECT DISTINCT {key}, g.b FROM {source}, range(64) g(b)) LEFT JOIN {name}_v USING ({key}, b) LEFT JOIN {name}_n USING ({key}) GROUP BY 1)
"""


_LANG = "list_position(['bg', 'de', 'en', 'es', 'fr', 'it'], lower(left(trim(lang), 2)))"
_WORDY = "(SELECT * FROM documents WHERE regexp_matches(text, '[\\p{L}\\p{N}]{2}'))"
# The notes' own vectors under the view's name, labelled by language and a fifteenth of the ids; others are noise.
_NOTES = "WITH " + enc("nv", _WORDY, "doc_id", "text") + f", embeddings AS (SELECT doc_id AS vec_id, embedding, CASE WHEN {_LANG} > 0 THEN ({_LANG} - 1) * 15 + doc_id % 15 ELSE -1 END::int AS label FROM nv JOIN documents USING (doc_id)), "


def _note_vectors(s: SparkSession, d: str) -> DataFrame:
    """Vectors of the notes' texts, labelled by language and a fifteenth of the ids; notes in no named language are noise (-1)."""
    docs = table(s, d, "documents").where(F.regexp_like("text", F.lit(r"[\p{L}\p{N}]{2}")))
    at = F.array_position(F.array(*map(F.lit, ("bg", "de", "en", "es", "fr", "it"))), F.lower(F.substring(F.trim("lang"), 1, 2)))
    label = F.when(at > 0, (at - 1) * 15 + F.col("doc_id") % 15).otherwise(-1).cast("int")
    return encoded(docs.select(F.col("doc_id").alias("vec_id"), label.alias("label"), "text"), F.col("text")).drop("text")


def _note_labels(s, d):
    return G.centroids(_note_vectors(s, d))


def _labels(s, d):
    return G.centroids(_vectors(s, d))


@query(_CENT + "SELECT label, size, list_transform(centroid, lambda x: round(x, 5)) AS centroid FROM c JOIN z USING (label)")
def centroids(s, d):
    return _labels(s, d).select("label", "size", F.transform("centroid", lambda x: F.round(x, 5)).alias("centroid"))


@query(_CENT + "SELECT label, threshold FROM t")
def label_thresholds(s, d):
    return G.thresholds(G.own_similarities(_vectors(s, d), _labels(s, d)), _labels(s, d))


def _assigned(s, d):
    labels = _labels(s, d)
    return G.assign(_vectors(s, d), labels, G.thresholds(G.own_similarities(_vectors(s, d), labels), labels))


@query(_CENT + "SELECT vec_id, label, sim, r FROM a")
def assign_labels(s, d):
    return _assigned(s, d)


@query(_CENT + """, p AS (SELECT vec_id, count(label) AS k FROM (SELECT DISTINCT vec_id FROM embeddings) LEFT JOIN a USING (vec_id) GROUP BY 1)
SELECT count(*) AS n, round(100 * count(*) FILTER (k > 0) / count(*), 2) AS tagged_pct, round(100 * count(*) FILTER (k > 1) / count(*), 2) AS multi_pct, round(100 * count(*) FILTER (k = 0) / count(*), 2) AS untagged_pct FROM p""")
def assignment_stats(s, d):
    return G.assignment_stats(_vectors(s, d), _assigned(s, d))


_NOTE_CENT = _NOTES + _CENT[5:]


@query(_NOTE_CENT + """, b AS (SELECT *, CASE WHEN own < 0 THEN sim >= 0.50 AND row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, label) = 1 ELSE own = label END AS prim FROM s),
w AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY prim DESC, sim DESC, label) AS r FROM b WHERE prim OR (own >= 0 AND sim >= 0.60) QUALIFY r <= 3)
SELECT vec_id, label, r, own < 0 OR coalesce(max(CASE WHEN prim THEN sim END) OVER (PARTITION BY vec_id), 0) < 0.70 AS review FROM w""")
def assign_by_centroid(s, d):
    """Notes by their texts' vectors; those in no named language are noise."""
    return G.assign_by_centroid(_note_vectors(s, d), _note_labels(s, d))


_PAIR = "round(list_dot_product(x.centroid, y.centroid), 6)"


@query(_NOTE_CENT + f"SELECT x.label AS a, y.label AS b, {_PAIR} AS sim FROM c x JOIN c y ON x.label < y.label WHERE {_PAIR} >= 0.60 AND {_PAIR} < 0.85")
def gray_zone_pairs(s, d):
    """Labels alike enough to ask whether they are one."""
    return G.label_pairs(_note_labels(s, d), G.GRAY, G.MERGE)


_GREEDY = _NOTE_CENT.replace("WITH ", "WITH RECURSIVE ", 1) + f""", gp AS (SELECT *, row_number() OVER (ORDER BY sim DESC, a, b) AS i FROM (SELECT x.label AS a, y.label AS b, {_PAIR} AS sim FROM c x JOIN c y ON x.label < y.label WHERE {_PAIR} >= 0.60 AND {_PAIR} < 0.85)),
pick AS (SELECT 0::bigint AS i, []::int[] AS used, NULL::int AS a, NULL::int AS b, NULL::double AS sim UNION ALL
  SELECT gp.i, CASE WHEN list_contains(used, gp.a) OR list_contains(used, gp.b) THEN used ELSE list_concat(used, [gp.a, gp.b]) END, CASE WHEN NOT (list_contains(used, gp.a) OR list_contains(used, gp.b)) THEN gp.a END, gp.b, gp.sim FROM pick JOIN gp ON gp.i = pick.i + 1)
"""


@query(_GREEDY + "SELECT a, b, sim FROM pick WHERE a IS NOT NULL")
def greedy_pairs(s, d):
    return G.disjoint_pairs(gray_zone_pairs(s, d))


@query(_GREEDY + """, w AS (SELECT a, b, round(sim, 2) AS confidence, x.size AS na, y.size AS nb FROM pick JOIN z x ON x.label = a JOIN z y ON y.label = b WHERE a IS NOT NULL),
v AS (SELECT CASE WHEN nb >= na THEN a ELSE b END::varchar AS source_tag, CASE WHEN nb >= na THEN b ELSE a END::varchar AS target_tag, na + nb AS note_count, confidence FROM w)
SELECT *, 'Merge ''' || source_tag || ''' into ''' || target_tag || ''' (' || note_count || ' notes)' AS message FROM v""")
def merge_cards(s, d):
    """Cards for labels alike enough to ask whether they are one."""
    return P.merge_cards(greedy_pairs(s, d), _note_labels(s, d))


_REACH = _NOTE_CENT.replace("WITH ", "WITH RECURSIVE ", 1) + f""", au AS (SELECT x.label AS a, y.label AS b FROM c x JOIN c y ON x.label <> y.label WHERE {_PAIR} > 0.85),
reach(a, b) AS (SELECT DISTINCT a, a FROM au UNION SELECT reach.a, au.b FROM reach JOIN au ON reach.b = au.a), gp AS (SELECT a AS label, min(b) AS root FROM reach GROUP BY 1)
"""


def _auto(s, d):
    return P.merge_groups(P.consolidation(G.label_pairs(_note_labels(s, d), -1.0)).where(F.col("tier") == "auto"))


@query(_REACH + "SELECT label, root FROM gp")
def merge_groups(s, d):
    """Labels that are merged at once, alike directly or through others."""
    return _auto(s, d)


@query(_REACH + """, ls AS (SELECT label, list_sort(list(vec_id)) AS ids, round(label / 100.0, 4)::double AS confidence, label % 5 = 0 AS is_anchor, 'L' || label AS name FROM embeddings WHERE label >= 0 GROUP BY label),
j AS (SELECT ls.*, coalesce(root, ls.label) AS r, len(ids) AS n FROM ls LEFT JOIN gp USING (label))
SELECT r AS label, list_sort(list_distinct(flatten(list(ids)))) AS ids, round(sum(confidence * n) / sum(n), 9) AS confidence, bool_or(is_anchor) AS is_anchor, arg_max(name, (n, -label)) AS name FROM j GROUP BY 1""")
def merged_labels(s, d):
    """Labels of one group as one: all their notes, the confidence weighted by size, the largest one's name."""
    v = _note_vectors(s, d).where(F.col("label") >= 0)
    labels = v.groupBy("label").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumns({"confidence": F.round(F.col("label") / 100.0, 4), "is_anchor": F.col("label") % 5 == 0, "name": F.concat(F.lit("L"), F.col("label").cast("string"))})
    return G.merge_labels(labels, _auto(s, d)).withColumn("confidence", F.round("confidence", 9))


@query()
def forced_merges(s, d):
    """Which labels are merged into which until twenty are left."""
    return s.createDataFrame(G.force_merge(_note_labels(s, d), 20), "source int, target int")


@query(_NOTE_CENT + f"SELECT a, b, sim, CASE WHEN sim > 0.85 THEN 'auto' ELSE 'judge' END AS tier FROM (SELECT x.label AS a, y.label AS b, {_PAIR} AS sim FROM c x JOIN c y ON x.label < y.label) WHERE sim > 0.70")
def consolidation_tiers(s, d):
    return P.consolidation(G.label_pairs(_note_labels(s, d), -1.0))


@query(_CENT + f"SELECT x.label, arg_max(y.label, ({_PAIR}, -y.label)) AS other, max({_PAIR}) AS sim FROM c x JOIN c y ON x.label <> y.label GROUP BY 1")
def nearest_label(s, d):
    return G.nearest_label(_labels(s, d))


def _old_and_new(s, d):
    """A manifest from the notes with odd ids, by negative label so that its order differs, and the labels of the others."""
    v = _note_vectors(s, d)
    old = G.centroids(v.where(F.col("vec_id") % 2 == 1))
    manifest = old.select(F.concat(F.lit("tag "), F.col("label").cast("string")).alias("tag"), (100 - F.col("label")).cast("int").alias("position"), "label", "centroid")
    return manifest, G.centroids(v.where(F.col("vec_id") % 2 == 0)), v.where(F.col("vec_id") % 2 == 0)


_HALVES = _NOTES + "everything AS (SELECT * FROM embeddings), " + ", ".join(_CENT.split("WITH ", 1)[1].split("z AS")[0].replace("FROM embeddings", f"FROM (SELECT * FROM everything WHERE vec_id % 2 = {h})").replace("m AS", f"m{h} AS").replace("FROM m)", f"FROM m{h})").replace("FROM m ", f"FROM m{h} ").replace("n AS (SELECT label, sqrt", f"n{h} AS (SELECT label, sqrt").replace("JOIN n USING", f"JOIN n{h} USING").replace("c AS (SELECT label, list", f"c{h} AS (SELECT label, list").rstrip().rstrip(",") for h in (0, 1))


@query(_HALVES + " SELECT c0.label, arg_min('tag ' || c1.label, 100 - c1.label) AS tag FROM c0 JOIN c1 ON round(list_dot_product(c0.centroid, c1.centroid), 6) >= 0.90 GROUP BY 1")
def manifest_reuse(s, d):
    """Labels of one half of the notes that keep the tag of a centroid of the other half."""
    manifest, labels, _ = _old_and_new(s, d)
    return G.reuse_manifest(labels, manifest)


@query(_HALVES + """, q AS (SELECT vec_id, c1.label, round(list_dot_product(embedding, c1.centroid), 6) AS sim FROM (SELECT * FROM everything WHERE vec_id % 2 = 0) CROSS JOIN c1),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, label) AS r, max(sim) OVER (PARTITION BY vec_id) AS best FROM q)
SELECT vec_id, label, sim, r, best < 0.70 AS review FROM r WHERE r <= 3 AND best >= 0.50 AND (r = 1 OR sim >= 0.60)""")
def incremental_tags(s, d):
    """New notes tagged by the centroids that a former run stored."""
    manifest, _, new = _old_and_new(s, d)
    return P.incremental(new, manifest)


@query(_CENT + """, o AS (SELECT vec_id, label, sim FROM s WHERE own = label)
SELECT label, round(avg(sim), 2) AS mean_sim, list(vec_id ORDER BY r) FILTER (r <= 5) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sim DESC, vec_id) AS r FROM o) GROUP BY 1""")
def label_samples(s, d):
    return G.label_samples(G.own_similarities(_vectors(s, d), _labels(s, d)))


@query(_NOTE_CENT + """, tv AS (SELECT label, list(CASE WHEN i = 1 + label % 64 THEN 1.0::double ELSE 0 END ORDER BY i) AS t FROM c, range(1, 65) g(i) GROUP BY 1),
h AS (SELECT label, list_transform(range(1, 65), lambda i: 0.5 * t[i] + 0.5 * centroid[i]) AS p FROM tv JOIN c USING (label))
SELECT label, list_transform(p, lambda x: round(x / sqrt(list_dot_product(p, p)), 5)) AS prototype FROM h""")
def label_prototypes(s, d):
    """Half a label's text vector, here a unit axis, and half its members' mean."""
    labels = _note_labels(s, d)
    axis = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(i == F.col("label") % 64, 1.0).otherwise(0.0))
    return G.prototypes(labels.select("label", axis.alias("text_vector")), labels).select("label", F.transform("prototype", lambda x: F.round(x, 5)).alias("prototype"))


@query(_NOTES.rstrip().rstrip(",") + " SELECT label, count(*) AS size, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS share FROM embeddings GROUP BY 1")
def cluster_sizes(s, d):
    """Sizes of the clusters and of noise (-1), with their shares."""
    v = _note_vectors(s, d)
    return G.cluster_sizes(v)


@query(_CENT.replace("WITH ", "WITH RECURSIVE ", 1) + """, v AS (SELECT e.vec_id, e.label, embedding::double[] AS v, sim FROM embeddings e JOIN s ON s.vec_id = e.vec_id AND s.own = s.label),
ce AS (SELECT label, list(vec_id ORDER BY sim DESC, vec_id)[1:4] AS ids FROM v GROUP BY 1),
st AS (SELECT label, ids, 4 AS n FROM ce UNION ALL SELECT st.label, list_append(ids, nx.vec_id), n + 1 FROM st, LATERAL (SELECT x.vec_id FROM v x WHERE x.label = st.label AND NOT list_contains(ids, x.vec_id)
  ORDER BY -round(0.5 * x.sim - 0.5 * (SELECT max(list_cosine_similarity(x.v, y.v)) FROM v y WHERE list_contains(ids, y.vec_id)), 9), -x.sim, x.vec_id LIMIT 1) nx WHERE n < 8)
SELECT label, unnest(ids) AS vec_id, generate_subscripts(ids, 1)::int AS r FROM st WHERE n = 8""")
def representatives(s, d):
    return G.representatives(_vectors(s, d), _labels(s, d))


@query()
def reduced_clusters(s, d):
    return G.reduce_and_cluster(_vectors(s, d), 10)


@query("""WITH t AS (SELECT g, term, count(*) AS tf FROM (SELECT source AS g, unnest(list_filter(regexp_extract_all(lower(coalesce(body, '')), '[\\p{L}\\p{N}]+'), lambda x: length(x) > 1)) AS term FROM documents WHERE source IS NOT NULL) GROUP BY 1, 2),
f AS (SELECT term, count(*) AS df FROM t GROUP BY 1), n AS (SELECT count(DISTINCT source) AS n FROM documents), w AS (SELECT g, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM t JOIN f USING (term) CROSS JOIN n),
l AS (SELECT g, sqrt(sum(w * w)) AS l FROM w GROUP BY 1), s AS (SELECT g, term, round(w / l, 6) AS score FROM w JOIN l USING (g))
SELECT g AS source, term, score, row_number() OVER (PARTITION BY g ORDER BY score DESC, term) AS r FROM s QUALIFY r <= 5""")
def source_keywords(s, d):
    return G.keywords(table(s, d, "documents"), "source")


_PRE = f"regexp_extract(title, '^{_WS}*([^\\s\\p{{Z}}\\x0b\\x85]{{2,30}}(?:{_WS}+[^\\s\\p{{Z}}\\x0b\\x85]{{2,30}}){{0,2}}){_WS}*[:—-]{_WS}+[^\\s\\p{{Z}}\\x0b\\x85]', 1)"


@query(f"SELECT lower({_PRE}) AS prefix, count(*) AS n FROM documents WHERE {_PRE} <> '' GROUP BY 1 HAVING count(*) >= 5")
def title_prefixes(s, d):
    return G.title_prefixes(table(s, d, "documents"))


@query("WITH " + _DENSE + """, q AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
i AS (SELECT query_id, count(*) AS n FROM q GROUP BY 1), ii AS (SELECT *, (SELECT sum(1 / log2(g + 1)) FROM range(1, least(i.n, 10) + 1) t(g)) AS idcg FROM i),
h AS (SELECT query_id, count(*) FILTER (r <= 10) AS hits, min(r) AS first, sum(CASE WHEN r <= 10 THEN 1 / log2(r + 1) ELSE 0 END) AS dcg FROM d JOIN q USING (query_id, doc_id) GROUP BY 1)
SELECT count(*) AS queries, round(avg(coalesce(hits / n, 0)), 6) AS recall, round(avg(coalesce(1 / first, 0)), 6) AS mrr, round(avg(coalesce(dcg / idcg, 0)), 6) AS ndcg FROM ii LEFT JOIN h USING (query_id)""")
def retrieval_metrics(s, d):
    """Dense search judged by the vectors' labels."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    runs = _dense(s, d).select("query_id", "doc_id", F.row_number().over(w).alias("rank"))
    v = _vectors(s, d).select("vec_id", "label")
    mine = v.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), "label")
    qrels = mine.join(v, "label").where(F.col("vec_id") != F.col("query_id")).select("query_id", F.col("vec_id").alias("doc_id"))
    return V.retrieval_metrics(runs, qrels)


@query(_CENT + """, x AS (SELECT own AS t, arg_max(label, (sim, -label)) AS p FROM s GROUP BY vec_id, own), k AS (SELECT t, p, count(*)::double AS n FROM x GROUP BY 1, 2), ka AS (SELECT t, sum(n) AS a FROM k GROUP BY 1), kb AS (SELECT p, sum(n) AS b FROM k GROUP BY 1),
o AS (SELECT sum(n) AS n, sum(n * (n - 1) / 2) AS sij FROM k), sa AS (SELECT sum(a * (a - 1) / 2) AS si, -sum(a / o.n * ln(a / o.n)) AS ht FROM ka, o), sb AS (SELECT sum(b * (b - 1) / 2) AS sj, -sum(b / o.n * ln(b / o.n)) AS hp FROM kb, o),
mi AS (SELECT sum(k.n / o.n * ln(k.n * o.n / (a * b))) AS mi FROM k JOIN ka USING (t) JOIN kb USING (p), o)
SELECT round((sij - si * sj / (n * (n - 1) / 2)) / ((si + sj) / 2 - si * sj / (n * (n - 1) / 2)), 6) AS ari, round(mi / ((ht + hp) / 2), 6) AS nmi, round(mi / ((ht + hp) / 2), 6) AS v_measure FROM o, sa, sb, mi""")
def cluster_metrics(s, d):
    """The nearest centroid of each vector against its label."""
    near = G.nearest_labels(_vectors(s, d), _labels(s, d)).select("vec_id", F.col("label").alias("pred_label"))
    return V.cluster_metrics(near.join(_vectors(s, d).select("vec_id", F.col("label").alias("true_label")), "vec_id"))


@query("""WITH n AS (SELECT count(*) AS n FROM documents), x AS (SELECT doc_id, source, count(*) OVER (PARTITION BY source) AS k, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::varchar), doc_id) AS r FROM documents)
SELECT doc_id, source FROM x, n WHERE r <= greatest(1, floor(k * 200 / n))""")
def stratified_sample(s, d):
    return V.stratified(table(s, d, "documents").select("doc_id", "source"), "source", 200)
