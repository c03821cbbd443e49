"""Per-key results when a few keys hold most rows.

Each map task folds its rows into one small state per key (count, bytes, newest), and only these states are
shuffled; a key with a third of all rows then costs one state per map task. Spark's hash aggregate is that bounded
table: it spills sorted states when full, and states merge associatively.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def host_of(url: Column) -> Column:
    """Host of an address in lower case, without user and port; null where there is none."""
    host = F.regexp_extract(url, r"^[ \t\r\n]*[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@\\]*@)?(\[[^\]/?#]*\]|[^:/?#\\ \t\r\n]*)", 1)
    return F.lower(F.nullif(host, F.lit("")))


def per_key(rows: DataFrame, keys: dict[str, tuple[Column, Column, Column]], newest: Column) -> DataFrame:
    """(field_name, key_value, n_rows, n_bytes, newest) per key of each field, from one pass over ``rows``.

    keys: per field a condition for a row to count, its key, and its bytes. Where the condition holds but the key is
    null, the rows are kept under a null key, so that they count in the field's total. Null bytes count as 0; null
    times are ignored. No rows give no keys.
    """
    entries = [F.when(on, F.struct(F.lit(field).alias("field_name"), key.alias("key_value"), F.coalesce(size, F.lit(0)).cast("long").alias("n_bytes"))) for field, (on, key, size) in keys.items()]
    return (
        rows.select(F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())).alias("e"), newest.alias("at"))
        .groupBy(F.col("e.field_name").alias("field_name"), F.col("e.key_value").alias("key_value"))
        .agg(F.count("*").alias("n_rows"), F.sum("e.n_bytes").alias("n_bytes"), F.max("at").alias("newest"))
    )


def crawl_keys(crawl: DataFrame) -> DataFrame:
    """Per host of ``url`` and per content of ``page`` (md5 of its UTF-8 bytes): rows, page bytes, newest fetch."""
    size = F.octet_length("page")
    return per_key(
        crawl.select("url", "page", "fetched_at"),
        {"url": (F.col("url").isNotNull(), host_of(F.col("url")), size), "page": (F.col("page").isNotNull(), F.md5("page"), size)},
        F.col("fetched_at"),
    )


def heavy(states: DataFrame, share: float) -> DataFrame:
    """Keys of ``states`` that hold at least ``share`` of their field's rows. The broadcast side is one row per field."""
    total = states.groupBy("field_name").agg(F.sum("n_rows").alias("total"))
    return states.join(F.broadcast(total), "field_name").where(F.col("key_value").isNotNull() & (F.col("n_rows") >= F.lit(share) * F.col("total")))
