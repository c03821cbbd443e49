"""The p1 and p2 queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.operators import compaction, heavy_keys
from webloom.session import frozen
from webloom.sources.tables import table

HEAVY_SHARE = 0.02


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Surplus copies of records: those that were read and are not in the consolidated files."""
    return compaction.consolidate(table(spark, root, "store_file")).surplus


def p1_plan(spark: SparkSession, root: str) -> DataFrame:
    """The manifest with each file's place in the summed bytes and its output file, for outputs of 1 MiB."""
    return compaction.plan(table(spark, root, "store_file").select("file_id", "table_name", "n_bytes"), 1 << 20)


def p1_counts(spark: SparkSession, root: str) -> DataFrame:
    """Reconciliation of a consolidation into outputs of 1 MiB: what was listed, read, left out and written, per table."""
    return compaction.consolidate(table(spark, root, "store_file"), 1 << 20).counts


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """Hosts and page contents that hold at least 2 percent of their column's rows."""
    states = frozen(heavy_keys.crawl_keys(table(spark, root, "crawl")), "states")  # read twice, for the totals too
    return heavy_keys.heavy(states, HEAVY_SHARE).select("field_name", "key_value")


def p2_per_key(spark: SparkSession, root: str) -> DataFrame:
    """Rows, page bytes and newest fetch of each host and each page content."""
    return heavy_keys.crawl_keys(table(spark, root, "crawl")).where(F.col("key_value").isNotNull())


QUERIES = {"p1_found": p1_found, "p1_plan": p1_plan, "p1_counts": p1_counts, "p2_found": p2_found, "p2_per_key": p2_per_key}

_KEYS = r"""
WITH k AS (
  SELECT 'url' AS field_name, nullif(lower(regexp_extract(url, '^[ \t\r\n]*[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@\\]*@)?(\[[^\]/?#]*\]|[^:/?#\\ \t\r\n]*)', 1)), '') AS key_value,
         coalesce(octet_length(encode(page)), 0) AS b, fetched_at FROM crawl WHERE url IS NOT NULL
  UNION ALL
  SELECT 'page', md5(page), octet_length(encode(page)), fetched_at FROM crawl WHERE page IS NOT NULL
), s AS (
  SELECT field_name, key_value, count(*)::BIGINT AS n_rows, sum(b)::BIGINT AS n_bytes, max(fetched_at) AS newest FROM k GROUP BY ALL
)
"""

SQL = {
    "p1_plan": """
SELECT file_id, table_name, n_bytes, (c - n_bytes)::BIGINT AS start_byte, ((c - n_bytes) // 1048576)::BIGINT AS group_id
FROM (SELECT file_id, table_name, n_bytes, sum(n_bytes) OVER (PARTITION BY table_name ORDER BY file_id) AS c FROM store_file)
""",
    "p2_found": _KEYS + """
SELECT field_name, key_value FROM (SELECT *, sum(n_rows) OVER (PARTITION BY field_name) AS total FROM s)
WHERE key_value IS NOT NULL AND n_rows >= 0.02 * total
""",
    "p2_per_key": _KEYS + "SELECT * FROM s WHERE key_value IS NOT NULL",
}
