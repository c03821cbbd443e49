"""The queries of the training-data operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import boilerplate, mixing, near_dup, seen_keys, shared_spans, tokenizer
from webloom.sources.tables import table


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of rows with similar pages, and with similar addresses."""
    crawl, out = table(spark, root, "crawl"), []
    for column in ("page", "url"):
        found = near_dup.row_pairs(*near_dup.crawl_similar(crawl, column))
        out.append(found.select(F.lit(column).alias("field_name"), "crawl_id_a", "crawl_id_b"))
    return out[0].unionByName(out[1])


def p3_groups(spark: SparkSession, root: str) -> DataFrame:
    """Groups of rows whose pages, and whose addresses, are linked by similarity."""
    crawl, out = table(spark, root, "crawl"), []
    for column in ("page", "url"):
        out.append(near_dup.row_groups(*near_dup.crawl_similar(crawl, column)).withColumn("field_name", F.lit(column)))
    return out[0].unionByName(out[1])


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """Rows of the queue whose address was known before, as the keyed state answered them."""
    return seen_keys.repeats(table(spark, root, "queue"), [table(spark, root, name) for name in ("seed_url", "crawl")])


def p4_wrong(spark: SparkSession, root: str) -> DataFrame:
    """The rate of wrong answers of p4_found against an exact batch run."""
    return seen_keys.wrong_answers(table(spark, root, "queue"), p4_found(spark, root), [table(spark, root, name) for name in ("seed_url", "crawl")])


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """Lines of the pages' own articles."""
    return boilerplate.main_lines(table(spark, root, "crawl"))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    """Rows whose page is spam of keywords, links or tags."""
    return boilerplate.spam_rows(table(spark, root, "crawl")).select("crawl_id")


def p7_ids(spark: SparkSession, root: str) -> DataFrame:
    """Token ids of every document."""
    return tokenizer.encode(table(spark, root, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    """Lines of recipes whose target can't be reached: the mix drew all that is allowed of their source and falls short."""
    return p8_shares(spark, root).where("target_share > 0 AND NOT reachable").select("recipe", "source")


def p8_mix(spark: SparkSession, root: str) -> DataFrame:
    """The mix of every recipe, by output shard and position."""
    return mixing.mix(table(spark, root, "documents"), table(spark, root, "mix_target"))[0]


def p8_shares(spark: SparkSession, root: str) -> DataFrame:
    """The share that each source reached in each recipe."""
    return mixing.shares(*mixing.mix(table(spark, root, "documents"), table(spark, root, "mix_target")))


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    """Maximal runs of shared characters."""
    return shared_spans.shared_spans(table(spark, root, "documents")).select("doc_id", "start_pos", "end_pos")


def p9_parts(spark: SparkSession, root: str) -> DataFrame:
    """How much of each document is shared with others."""
    documents = table(spark, root, "documents")
    return shared_spans.shared_parts(documents, shared_spans.shared_spans(documents))


QUERIES = {
    "p3_found": p3_found,
    "p3_groups": p3_groups,
    "p4_found": p4_found,
    "p4_wrong": p4_wrong,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p7_ids": p7_ids,
    "p8_found": p8_found,
    "p8_mix": p8_mix,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
    "p9_parts": p9_parts,
}

_ADDRESSES = r"""
WITH every AS (
  SELECT queue_id AS place, url FROM queue UNION ALL SELECT -1, url FROM seed_url UNION ALL SELECT -1, url FROM crawl
), parts AS (
  SELECT place, regexp_extract(regexp_replace(trim(url, ' 	'), '#.*$', '', 's'), '^([Hh][Tt][Tt][Pp][Ss]?)://([^/?]*)(.*)$', ['scheme', 'authority', 'rest'], 's') AS p
  FROM (SELECT place, replace(url, chr(9), ' ') AS url FROM every WHERE url IS NOT NULL)
), keyed AS (
  SELECT place, lower(p.scheme) || '://' || regexp_extract(regexp_replace(p.authority, ':[0-9]*$', ''), '^((?:.*@)?)', 1) || lower(regexp_extract(regexp_replace(p.authority, ':[0-9]*$', ''), '([^@]*)$', 1)) || ':'
         || coalesce(nullif(regexp_extract(p.authority, ':([0-9]+)$', 1), ''), CASE lower(p.scheme) WHEN 'https' THEN '443' ELSE '80' END)
         || CASE WHEN starts_with(p.rest, '/') THEN p.rest ELSE '/' || p.rest END AS k
  FROM parts WHERE p.scheme <> ''
), firsts AS (SELECT k, min(place) AS first_place FROM keyed GROUP BY k)
"""

_STRETCHES = """
WITH w AS (
  SELECT doc_id, s, md5(substr(text, s + 1, 160)) AS h
  FROM (SELECT doc_id, text, unnest(range(0, length(text) - 159)) AS s FROM documents WHERE length(text) >= 160)
), many AS (SELECT h FROM w GROUP BY h HAVING count(DISTINCT doc_id) > 1),
g AS (SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS before FROM w JOIN many USING (h)),
r AS (SELECT doc_id, s, count(*) FILTER (before IS NULL OR s > before + 160) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM g),
runs AS (SELECT doc_id, min(s)::INT AS start_pos, max(s)::INT + 160 AS end_pos FROM r GROUP BY doc_id, run)
"""

SQL: dict[str, str] = {
    "p4_found": _ADDRESSES + "SELECT DISTINCT place AS queue_id FROM keyed JOIN firsts USING (k) WHERE place > first_place",
    "p4_wrong": _ADDRESSES + """
SELECT (SELECT count(*) FROM queue)::BIGINT AS n_rows, count(*)::BIGINT AS n_keyed, count(*) FILTER (place > first_place)::BIGINT AS n_repeats,
       0::BIGINT AS n_wrong, 0.0::DOUBLE AS wrong_rate, pow(count(*)::DOUBLE, 2) / pow(2.0::DOUBLE, 129) AS expected_bound
FROM keyed JOIN firsts USING (k) WHERE place >= 0
""",
    "p9_found": _STRETCHES + "SELECT doc_id, start_pos, end_pos FROM runs",
    "p9_parts": _STRETCHES + """
SELECT doc_id, coalesce(length(text), 0)::BIGINT AS n_chars, coalesce(n, 0)::BIGINT AS n_shared, CASE WHEN length(text) > 0 THEN coalesce(n, 0)::DOUBLE / length(text) ELSE 0.0::DOUBLE END AS shared_part
FROM documents LEFT JOIN (SELECT doc_id, sum(end_pos - start_pos) AS n FROM runs GROUP BY doc_id) USING (doc_id)
""",
}
