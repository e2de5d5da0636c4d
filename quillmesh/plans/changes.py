"""Problem 7: queries over note_snapshots and imports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.operators.snapshots import snapshot_changes
from quillmesh.session import read_table


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_changes(read_table(spark, d, "note_snapshots"), read_table(spark, d, "imports"))


def p7_counts(spark: SparkSession, d: str) -> DataFrame:
    """Changes found per import beside the counters the import reported."""
    imports = read_table(spark, d, "imports")
    found = (
        snapshot_changes(read_table(spark, d, "note_snapshots"), imports)
        .groupBy("import_id")
        .agg(*(F.count_if(F.col("change_type") == t).alias(f"n_{t}") for t in ("added", "removed", "updated")))
    )
    return imports.join(found, imports.id == found.import_id).select(
        "import_id", "n_added", "n_removed", "n_updated", F.col("added").alias("said_added"), F.col("removed").alias("said_removed")
    )


_ROWS = """
WITH ord AS (
  SELECT id AS import_id, source_key, row_number() OVER (PARTITION BY source_key ORDER BY started_at NULLS FIRST, id) AS n
  FROM imports WHERE finished_at IS NOT NULL),
snap AS (
  SELECT o.source_key, o.n, s.external_id, s.hash FROM (
    SELECT import_id, trim(external_id) AS external_id, lower(trim(content_hash)) AS hash,
           row_number() OVER (PARTITION BY import_id, trim(external_id) ORDER BY seq DESC) AS rn
    FROM note_snapshots WHERE external_id IS NOT NULL) s
  JOIN ord o USING (import_id) WHERE s.rn = 1),
changes AS (
  SELECT o.import_id, coalesce(b.external_id, a.external_id) AS external_id,
         CASE WHEN a.external_id IS NULL THEN 'added' WHEN b.external_id IS NULL THEN 'removed'
              WHEN a.hash <> b.hash AND a.hash <> '' AND b.hash <> '' THEN 'updated' END AS change_type
  FROM (SELECT source_key, n + 1 AS n, external_id, hash FROM snap) a
  FULL JOIN (SELECT * FROM snap WHERE n > 1) b ON a.source_key = b.source_key AND a.n = b.n AND a.external_id = b.external_id
  JOIN ord o ON o.source_key = coalesce(b.source_key, a.source_key) AND o.n = coalesce(b.n, a.n))
"""

QUERIES = {"p7_found": p7_found, "p7_counts": p7_counts}
SQL = {
    "p7_found": _ROWS + "SELECT import_id, external_id, change_type FROM changes WHERE change_type IS NOT NULL",
    "p7_counts": _ROWS
    + """SELECT c.import_id, count(*) FILTER (change_type = 'added') AS n_added, count(*) FILTER (change_type = 'removed') AS n_removed,
  count(*) FILTER (change_type = 'updated') AS n_updated, any_value(i.added) AS said_added, any_value(i.removed) AS said_removed
FROM changes c JOIN imports i ON i.id = c.import_id WHERE change_type IS NOT NULL GROUP BY c.import_id""",
}
