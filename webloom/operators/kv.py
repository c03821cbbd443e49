"""A versioned key-value store over long tables (row_key, column, value, version)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(table: DataFrame, key: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows with start <= key < end; null bounds are open. The bounds reach the file scan."""
    if start is not None:
        table = table.where(F.col(key) >= start)
    if end is not None:
        table = table.where(F.col(key) < end)
    return table


def get_row(table: DataFrame, key: str, value: str) -> DataFrame:
    return table.where(F.col(key) == value)


def get_cell(table: DataFrame, key: str, value: str, column: str) -> DataFrame:
    return get_row(table, key, value).select(column)


def exists(keys: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``keys`` with whether ``table`` has a row of that key."""
    there = table.select(F.col(key).alias("_k")).distinct().withColumn("_e", F.lit(True))
    return keys.join(there, F.col(key) == F.col("_k"), "left").withColumn("found", F.coalesce("_e", F.lit(False))).drop("_k", "_e")


def upsert_latest(base: DataFrame, delta: DataFrame | None = None) -> DataFrame:
    """(row_key, column, value, version): the value of the highest version of each cell, of the base and the puts after it."""
    every = base if delta is None else base.unionByName(delta)
    latest = F.max(F.struct("version", "value"))
    return every.groupBy("row_key", "column").agg(latest.alias("m")).select("row_key", "column", F.col("m.value").alias("value"), F.col("m.version").alias("version"))


def put_row(base: DataFrame, delta: DataFrame) -> DataFrame:
    """Whole rows replaced: of each row_key only the cells of its latest put (highest version, all cells of a put share it)."""
    every = base.unionByName(delta)
    newest = every.groupBy("row_key").agg(F.max("version").alias("_v"))
    return every.join(newest, "row_key").where("version = _v").drop("_v")


def conditional_put(current: DataFrame, puts: DataFrame) -> DataFrame:
    """Compare and set: ``puts`` (row_key, column, version, expected, new) against ``current``; (row_key, column, version, value, status).

    A put succeeds where the cell's value equals the expected one, and later puts meet what it left; those of one cell
    apply in order of version. value: the cell's after the put. A missing cell or another value gives FAIL.
    """
    own = F.array_sort(F.collect_list(F.struct("version", "expected", "new"))).alias("puts")
    joined = puts.groupBy("row_key", "column").agg(own).join(current.select("row_key", "column", "value"), ["row_key", "column"], "left")
    none = F.array().cast("array<struct<version:bigint,value:string,status:string>>")

    def step(acc: Column, put: Column) -> Column:
        ok = F.coalesce(acc["value"] == put["expected"], F.lit(False))
        value = F.when(ok, put["new"]).otherwise(acc["value"])
        done = F.struct(put["version"].cast("long").alias("version"), value.alias("value"), F.when(ok, "OK").otherwise("FAIL").alias("status"))
        return F.struct(value.alias("value"), F.concat(acc["done"], F.array(done)).alias("done"))

    walked = F.aggregate("puts", F.struct(F.col("value").cast("string").alias("value"), none.alias("done")), step)["done"]
    return joined.select("row_key", "column", F.explode(walked).alias("p")).select("row_key", "column", "p.version", "p.value", "p.status")


def row_versions(log: DataFrame, order: str) -> DataFrame:
    """The log's puts numbered 1, 2, ... per row_key in ``order``."""
    from pyspark.sql import Window

    return log.withColumn("row_version", F.row_number().over(Window.partitionBy("row_key").orderBy(order)))


def view_page(table: DataFrame, key: str, start: str | None = None, rows: int = 10) -> DataFrame:
    """A page of rows in key order, from the first key at or after ``start``."""
    return scan(table, key, start).orderBy(key).limit(rows)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows) of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


def rename(spark: SparkSession, old: str, new: str) -> None:
    """Rename a table; a missing source and an existing target are errors."""
    if not spark.catalog.tableExists(old):
        raise LookupError(f"no table {old}")
    if spark.catalog.tableExists(new):
        raise FileExistsError(f"table {new} exists")
    spark.sql(f"ALTER TABLE {old} RENAME TO {new}")


def delete(spark: SparkSession, name: str) -> None:
    if not spark.catalog.tableExists(name):
        raise LookupError(f"no table {name}")
    spark.sql(f"DROP TABLE {name}")


def list_tables(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables())


def key_range(key: Column, bounds: list[str]) -> Column:
    """Index of the worker of a key: the last bound at or below it; keys below all bounds wrap round to the last worker."""
    ordered = sorted(bounds)
    n = sum((F.when(key >= b, 1).otherwise(0) for b in ordered), F.lit(0))
    return F.when(n == 0, len(ordered) - 1).otherwise(n - 1)
