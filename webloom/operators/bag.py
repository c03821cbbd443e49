"""Bags of strings and bags of pairs over DataFrames.

Functions given to these operators are Column expressions (``Column -> Column``), which stay in generated code. Where a
plain Python function is needed, the ``_python`` variants run it over Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions.hashing import hash_key


class Destroyed(RuntimeError):
    """The bag was destroyed."""


@dataclass
class _Handle:
    _df: DataFrame | None
    table: str | None = None

    @property
    def df(self) -> DataFrame:
        if self._df is None:
            raise Destroyed("this bag was destroyed")
        return self._df

    def count(self) -> int:
        """All elements, repeats included."""
        return self.df.count()

    def cache(self):
        self._df = self.df.cache()
        return self

    def save_as_table(self, name: str, mode: str = "errorifexists", path: str | None = None):
        """Write the bag as a table, at ``path`` if given; the bag reads from it then. An existing table is an error unless mode says overwrite."""
        writer = self.df.write.mode(mode)
        (writer.option("path", path) if path else writer).saveAsTable(name)
        self._df, self.table = self.df.sparkSession.table(name), name
        return self

    def destroy(self) -> None:
        """Drop the bag and its table; any later use raises ``Destroyed``."""
        df = self.df
        df.unpersist()
        if self.table:
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {self.table}")
        self._df = None


class Bag(_Handle):
    """A bag of strings: a DataFrame with the column ``value``."""

    def collect(self) -> list[str]:
        return [r["value"] for r in self.df.collect()]

    def take(self, n: int) -> list[str]:
        """Any n elements, all if there are fewer."""
        return [r["value"] for r in self.df.limit(n).collect()]

    def filter(self, keep: Callable[[Column], Column]) -> Bag:
        return Bag(self.df.where(keep(F.col("value"))))

    def flat_map(self, f: Callable[[Column], Column]) -> Bag:
        """f gives an array; null and empty ones give nothing, null elements are dropped."""
        return Bag(self.df.select(F.explode(f(F.col("value"))).alias("value")).where("value IS NOT NULL"))

    def flat_map_python(self, f: Callable[[str], Iterable[str] | None]) -> Bag:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({"value": [x for v in b["value"] for x in f(v) or () if x is not None]}, dtype="object")

        return Bag(self.df.mapInPandas(run, "value string"))

    def map_to_pair(self, key: Callable[[Column], Column], value: Callable[[Column], Column]) -> PairBag:
        """One pair per element; a null key gives none."""
        pairs = self.df.select(key(F.col("value")).alias("key"), value(F.col("value")).alias("value"))
        return PairBag(pairs.where("key IS NOT NULL"))

    def flat_map_to_pair(self, f: Callable[[Column], Column]) -> PairBag:
        """f gives an array of struct(key, value)."""
        return PairBag(self.df.select(F.inline(f(F.col("value")))).toDF("key", "value").where("key IS NOT NULL"))

    def map_partitions(self, f: Callable[[Iterator[str]], Iterator[str]]) -> Bag:
        """f runs once per partition, over an iterator."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: list[str] = []
            for x in f(v for b in batches for v in b["value"]):
                held.append(x)
                if len(held) == 10_000:
                    yield pd.DataFrame({"value": held}, dtype="object")
                    held = []
            if held:
                yield pd.DataFrame({"value": held}, dtype="object")

        return Bag(self.df.mapInPandas(run, "value string"))

    def sample(self, fraction: float, seed: int | None = None) -> Bag:
        """Each element with probability ``fraction``."""
        return Bag(self.df.sample(False, fraction, seed))

    def sample_by_hash(self, fraction: float) -> Bag:
        """The elements whose SHA-1 falls into the first part of its range: the same ones on every run, repeats together."""
        first = F.conv(F.substring(hash_key(F.col("value")), 1, 8), 16, 10).cast("long")
        return Bag(self.df.where(first < int(fraction * (1 << 32))))

    def distinct(self) -> Bag:
        return Bag(self.df.distinct())

    def intersection(self, other: Bag) -> Bag:
        """Elements of both, each once."""
        return Bag(self.df.intersect(other.df))

    def group_by(self, key: Callable[[Column], Column]) -> PairBag:
        """(key, members joined by commas in order)."""
        return PairBag(self.df.groupBy(key(F.col("value")).alias("key")).agg(F.array_join(F.array_sort(F.collect_list("value")), ",").alias("value")))

    def folded(self, zero: str, how: str) -> DataFrame:
        """One row, (value): a named fold over all elements, starting from ``zero``; see ``_named``. zero for an empty bag."""
        return self.df.agg(_folded(how, F.col("value"), zero).alias("value"))

    def fold(self, zero: str, how: str) -> str:
        """The same as a string; a whole number has no decimals."""
        got = self.folded(zero, how).first()["value"]
        return str(int(got)) if got == got.__class__(int(got)) else str(got)

    def fold_ordered(self, zero: str, f: Callable[[Column, Column], Column], order: Callable[[Column], Column]) -> str:
        """A fold by any expression needs an order to be defined; all elements meet in one task, so this is for small bags."""
        pairs = self.df.agg(F.array_sort(F.collect_list(F.struct(order(F.col("value")).alias("o"), F.col("value").alias("v")))).alias("vs"))
        return pairs.select(F.aggregate("vs", F.lit(zero), lambda acc, x: f(acc, x["v"])).alias("x")).first()["x"]


def _named(how: str, value: Column) -> Column:
    """sum, max, min or count of numbers; integer_sum, integer_max, integer_min of whole ones, exact up to 38 digits. What is no such number is left out."""
    if how == "count":
        return F.count(value)
    number = value.try_cast("decimal(38,0)") if how.startswith("integer_") else value.try_cast("double")
    return {"sum": F.sum, "max": F.max, "min": F.min}[how.removeprefix("integer_")](number)


def _folded(how: str, value: Column, zero: str) -> Column:
    """A named fold that starts from ``zero`` (empty: 0)."""
    got, start = _named(how, value), F.lit(zero or "0").cast("decimal(38,0)" if how.startswith("integer_") else "double")
    kind = how.removeprefix("integer_")
    if kind in ("sum", "count"):
        return start + F.coalesce(got, F.lit(0))
    return F.greatest(start, got) if kind == "max" else F.least(start, got)


class PairBag(_Handle):
    """A bag of pairs: a DataFrame with the columns ``key`` and ``value``."""

    def collect(self) -> list[tuple[str, str]]:
        return [(r["key"], r["value"]) for r in self.df.collect()]

    def flat_map(self, f: Callable[[Column, Column], Column]) -> Bag:
        return Bag(self.df.select(F.explode(f(F.col("key"), F.col("value"))).alias("value")).where("value IS NOT NULL"))

    def flat_map_to_pair(self, f: Callable[[Column, Column], Column]) -> PairBag:
        return PairBag(self.df.select(F.inline(f(F.col("key"), F.col("value")))).toDF("key", "value").where("key IS NOT NULL"))

    def join(self, other: PairBag) -> PairBag:
        """Per key every pair of values, joined by a comma; repeats count."""
        right = other.df.select("key", F.col("value").alias("_other"))
        return PairBag(self.df.join(right, "key").select("key", F.concat_ws(",", "value", "_other").alias("value")))

    def cogroup(self, other: PairBag) -> PairBag:
        """Per key of either ``[values],[values]``, in order."""
        listed = lambda df, name: df.groupBy("key").agg(F.array_sort(F.collect_list("value")).alias(name))
        none = F.array().cast("array<string>")
        both = listed(self.df, "x").join(listed(other.df, "y"), "key", "full_outer")
        text = F.concat(F.lit("["), F.array_join(F.coalesce("x", none), ","), F.lit("],["), F.array_join(F.coalesce("y", none), ","), F.lit("]"))
        return PairBag(both.select("key", text.alias("value")))

    def fold_by_key(self, how: str, separator: str = ", ", zero: str | None = None) -> DataFrame:
        """(key, value) by a named fold: as for bags, from ``zero`` if given, or concat (in order) or distinct_concat.

        The numeric ones are combined before the shuffle; strings that aren't numbers are left out of them.
        """
        value = F.col("value")
        if how == "concat":
            folded = F.array_join(F.array_sort(F.collect_list(value)), separator)
        elif how == "distinct_concat":
            folded = F.array_join(F.array_sort(F.collect_set(value)), separator)
        else:
            folded = _named(how, value) if zero is None else _folded(how, value, zero)
        return self.df.groupBy("key").agg(folded.alias("value"))

    def fold_by_key_ordered(self, zero: str, f: Callable[[Column, Column], Column], order: Callable[[Column], Column]) -> DataFrame:
        """(key, value) by a fold of any expression, in ``order``; a key's values meet in one row, so this is for keys of few values."""
        listed = self.df.groupBy("key").agg(F.array_sort(F.collect_list(F.struct(order(F.col("value")).alias("o"), F.col("value").alias("v")))).alias("vs"))
        return listed.select("key", F.aggregate("vs", F.lit(zero), lambda acc, x: f(acc, x["v"])).alias("value"))

    def grouped(self) -> DataFrame:
        """A row per key with all its values."""
        return self.df.groupBy("key").agg(F.array_sort(F.collect_list("value")).alias("values"))


class Context:
    """A job's handle: makes bags, and collects its output."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self._output, self._partitions = spark, [], None

    def output(self, text: str) -> None:
        self._output.append(text)

    def result(self) -> str:
        return "".join(self._output) or "no output"

    def set_concurrency_level(self, k: int) -> None:
        if k < 1:
            raise ValueError("the concurrency level must be positive")
        self._partitions = k

    def parallelize(self, values: list[str]) -> Bag:
        df = self.spark.createDataFrame([(v,) for v in values], "value string")
        return Bag(df.repartition(self._partitions) if self._partitions else df)

    def from_table(self, table: str | DataFrame, f: Callable[[DataFrame], Column]) -> Bag:
        """Scan a table and map each row to a string; nulls are dropped."""
        df = self.spark.table(table) if isinstance(table, str) else table
        out = df.select(f(df).alias("value")).where("value IS NOT NULL")
        return Bag(out.repartition(self._partitions) if self._partitions else out)
