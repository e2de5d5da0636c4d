"""Queries of the corpus-preparation problems and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.clusters import cluster_pairs, cluster_summaries
from quillmesh.llm.cooccurrence import item_pairs
from quillmesh.llm.encoding import encode_documents
from quillmesh.llm.languages import document_languages, document_passages, unlabelled_languages
from quillmesh.llm.leakage import leaked_items
from quillmesh.llm.neardup import class_members, near_duplicate_groups, similar_pairs
from quillmesh.llm.personal import mask_personal
from quillmesh.llm.residue import residue_documents
from quillmesh.llm.splitting import LIMIT, split_documents
from quillmesh.session import read_table as table


def p1_found(s: SparkSession, d: str) -> DataFrame:
    """Documents that the splitter had to cut: those with a second piece."""
    pieces = split_documents(table(s, d, "documents"), with_text=False)
    return pieces.where(F.col("piece_no") == 1).select("doc_id")


def p1_pieces(s: SparkSession, d: str) -> DataFrame:
    return split_documents(table(s, d, "documents"))


def p2_found(s: SparkSession, d: str) -> DataFrame:
    return unlabelled_languages(table(s, d, "documents"))


def p2_documents(s: SparkSession, d: str) -> DataFrame:
    return document_languages(table(s, d, "documents"))


def p2_passages(s: SparkSession, d: str) -> DataFrame:
    return document_passages(table(s, d, "documents"))


def p3_found(s: SparkSession, d: str) -> DataFrame:
    wide = [F.col(c).cast("decimal(19,0)") for c in ("n_ab", "n", "n_a", "n_b")]
    pairs = item_pairs(table(s, d, "doc_tags"), least=5)
    return pairs.where(wide[0] * wide[1] >= 5 * wide[2] * wide[3]).select("tag_id_a", "tag_id_b")


def p3_pairs(s: SparkSession, d: str) -> DataFrame:
    return item_pairs(table(s, d, "doc_tags")).drop("n")


def p4_found(s: SparkSession, d: str) -> DataFrame:
    return similar_pairs(table(s, d, "documents"))


def p4_members(s: SparkSession, d: str) -> DataFrame:
    """The class of each document for p4_found's parameters: its pairs of many copies are given by their least id alone."""
    return class_members(table(s, d, "documents"))


def p4_groups(s: SparkSession, d: str) -> DataFrame:
    """Groups of near-copies: five-word shingles, a similarity of 0.8 or more."""
    return near_duplicate_groups(table(s, d, "documents"))


def _personal(s: SparkSession, d: str, chat: DataFrame, with_text: bool) -> DataFrame:
    docs = table(s, d, "documents").select(F.lit("documents").alias("src"), F.col("doc_id").alias("row_id"), "body")
    chat = chat.select(F.lit("chat_messages").alias("src"), F.col("message_id").alias("row_id"), F.col("content").alias("body"))
    return mask_personal(docs.unionByName(chat), table(s, d, "known_names"), "body", ("src", "row_id"), with_text)


def p5_masked(s: SparkSession, d: str) -> DataFrame:
    """Every note body and every distinct chat message with placeholders in place of personal data."""
    return _personal(s, d, table(s, d, "chat_messages").dropDuplicates(), True)


def p5_found(s: SparkSession, d: str) -> DataFrame:
    return _personal(s, d, table(s, d, "chat_messages"), False).select("src", "row_id", F.explode("kinds").alias("kind")).distinct()


def p6_found(s: SparkSession, d: str) -> DataFrame:
    return cluster_pairs(table(s, d, "documents"))


def p6_clusters(s: SparkSession, d: str) -> DataFrame:
    """Size, most typical notes and most frequent label of each cluster."""
    return cluster_summaries(table(s, d, "documents"))


def p8_ids(s: SparkSession, d: str) -> DataFrame:
    return encode_documents(table(s, d, "documents"))


def p9_found(s: SparkSession, d: str) -> DataFrame:
    return leaked_items(table(s, d, "documents"), table(s, d, "eval_items")).select("doc_id", "item_id")


def p9_containment(s: SparkSession, d: str) -> DataFrame:
    """How much of each leaked item stands in the document."""
    return leaked_items(table(s, d, "documents"), table(s, d, "eval_items"))


def p10_found(s: SparkSession, d: str) -> DataFrame:
    return residue_documents(table(s, d, "documents")).select("doc_id")


def p10_kinds(s: SparkSession, d: str) -> DataFrame:
    """What was found in each record to exclude."""
    return residue_documents(table(s, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_pieces, p2_found, p2_documents, p2_passages, p3_found, p3_pairs, p4_found, p4_members, p4_groups, p5_found, p5_masked, p6_found, p6_clusters, p8_ids, p9_found, p9_containment, p10_found, p10_kinds)
}

_PAIRS = """
WITH r AS (SELECT DISTINCT doc_id, tag_id FROM doc_tags WHERE tag_id IS NOT NULL AND doc_id IS NOT NULL),
i AS (SELECT tag_id, count(*) AS n_i FROM r GROUP BY tag_id),
t AS (SELECT count(DISTINCT doc_id) AS n FROM r),
p AS (SELECT a.tag_id AS tag_id_a, b.tag_id AS tag_id_b, count(*) AS n_ab FROM r a JOIN r b ON a.doc_id = b.doc_id AND a.tag_id < b.tag_id GROUP BY 1, 2),
q AS (SELECT p.*, x.n_i AS n_a, y.n_i AS n_b, t.n FROM p JOIN i x ON x.tag_id = tag_id_a JOIN i y ON y.tag_id = tag_id_b CROSS JOIN t)
"""
_WINDOWS = """
WITH iw AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM eval_items),
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
ig AS (SELECT DISTINCT item_id, array_to_string(w[g : g + 12], ' ') AS run FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS g FROM iw)),
dg AS (SELECT doc_id, array_to_string(w[g : g + 12], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS g FROM dw))
"""
_SETS = """
WITH w AS (SELECT doc_id, regexp_extract_all(lower(body), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE body IS NOT NULL),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 40)),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(x, '|' ORDER BY x)) AS k FROM g GROUP BY 1),
f AS (SELECT x, count(*) AS c FROM g GROUP BY 1 HAVING count(*) > 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN f USING (x) JOIN g b USING (x) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
s AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 5 * c >= 3 * (x.n + y.n - c))
"""
_CLUSTERS = """
WITH RECURSIVE w AS (SELECT DISTINCT doc_id, unnest(list_filter(regexp_extract_all(lower(body), '[\\p{L}\\p{N}]+'), lambda x: length(x) >= 5)) AS x FROM documents),
n AS (SELECT doc_id, count(*) AS n FROM w GROUP BY 1 HAVING count(*) >= 25), g AS (SELECT w.* FROM w JOIN n USING (doc_id)),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b USING (x) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 2 * c >= x.n + y.n - c),
reach(a, b) AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a)
"""
SQL = {
    "p4_found": _SETS + "SELECT a AS doc_id_a, b AS doc_id_b FROM s",
    "p4_members": _SETS + """, k AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS class_id, count(*) OVER (PARTITION BY k) AS copies FROM n),
l AS (SELECT d.class_id, count(DISTINCT o.class_id) AS links FROM (SELECT a, b FROM s UNION ALL SELECT b, a FROM s) p JOIN k d ON d.doc_id = p.a JOIN k o ON o.doc_id = p.b WHERE d.class_id <> o.class_id GROUP BY 1)
SELECT doc_id, coalesce(k.class_id, doc_id) AS class_id, coalesce(copies, 1) AS copies, coalesce(links, 0) AS links FROM documents LEFT JOIN k USING (doc_id) LEFT JOIN l ON l.class_id = k.class_id""",
    "p4_groups": _SETS.replace("WITH w AS", "WITH RECURSIVE w AS").replace("i + 2]", "i + 4]").replace("len(w) - 1)", "len(w) - 3)").replace("len(w) >= 40", "len(w) >= 5").replace("5 * c >= 3 *", "5 * c >= 4 *").rstrip() + """,
reach(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT reach.a, e.b FROM reach JOIN (SELECT a, b FROM s UNION ALL SELECT b, a FROM s) e ON reach.b = e.a)
SELECT doc_id, (SELECT min(b) FROM reach WHERE reach.a = doc_id) AS group_id, count(*) OVER (PARTITION BY k) AS copies FROM n""",
    "p6_found": _CLUSTERS + "SELECT DISTINCT a AS doc_id_a, b AS doc_id_b FROM reach WHERE a < b AND a IN (SELECT a FROM reach GROUP BY a HAVING count(DISTINCT b) FILTER (b <> a) >= 2)",
    "p9_containment": _WINDOWS + """, c AS (SELECT item_id, count(*) AS n FROM ig GROUP BY 1), h AS (SELECT doc_id, item_id, count(DISTINCT run) AS k FROM dg JOIN ig USING (run) GROUP BY 1, 2)
SELECT doc_id, item_id, k::int AS n_windows, k / n AS containment FROM h JOIN c USING (item_id)""",
    "p1_found": f"SELECT doc_id FROM documents WHERE length(body) > {LIMIT}",
    "p3_found": _PAIRS + "SELECT tag_id_a, tag_id_b FROM q WHERE n_ab >= 5 AND n_ab * n >= 5 * n_a * n_b",
    "p3_pairs": _PAIRS
    + """SELECT tag_id_a, tag_id_b, n_ab, n_a, n_b, n_ab::double * n / (n_a::double * n_b) AS lift,
  (n_ab + 0.5::double) * (n - n_a::double - n_b + n_ab + 0.5::double) / ((n_a - n_ab + 0.5::double) * (n_b - n_ab + 0.5::double)) AS odds_ratio FROM q""",
    "p9_found": _WINDOWS + "SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (run)",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
