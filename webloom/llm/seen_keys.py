"""First or repeat: whether each key of a stream occurred before, from keyed state on disk.

A streaming query keeps one flag per key, the place at which it was first seen. The state lives in RocksDB on the
executors' disks, partitioned by key, with its changes checkpointed to the shared folder; there is no watermark, so no
key ever expires and the answers are exact. Keys known beforehand are fed first, then arrivals in ranges of their
order; each feed is one micro-batch, after which the query stops. The next one, in this session or a later one, goes on
from the checkpoint. As the state has seen everything before a range when it meets the range, its flags decide the
range for good, and the answers of every record are written with the micro-batch.

Rows of one micro-batch are combined per key before the shuffle, so a key with a third of all rows reaches the state as
one row per task and batch. Answers are matched by place, which no two records share, so no key is hot there either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.session import frozen, work_dir

_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}
#: Place of the keys that were known before the stream began.
KNOWN = -1
#: Records in a micro-batch, about.
BATCH_ROWS = 1 << 26
_ARRIVALS, _ANSWERS = "digest binary, place long", "place long, repeat boolean"


def with_key(rows: DataFrame, *keep: str) -> DataFrame:
    """(keep, key) of the ``rows`` whose ``url`` has a key: trimmed of spaces and tabs, scheme and host in lower case, port
    written out, no fragment, an empty path as ``/``. What is null or neither http nor https has none.

    Step by step, so that no part is computed again for each place that it is used in.
    """
    c = F.col
    out = rows.select(*keep, F.substring_index(F.btrim("url", F.lit(" \t")), "#", 1).alias("_given"))
    out = out.select(*keep, "_given", F.lower(F.substring("_given", 1, 8)).alias("_start"))
    out = out.where((c("_start") == "https://") | c("_start").startswith("http://")).select(*keep, "_given", (c("_start") == "https://").alias("_secure"))
    out = out.select(*keep, "_secure", F.substr("_given", F.when(c("_secure"), 9).otherwise(8)).alias("_after"))
    out = out.select(*keep, "_secure", "_after", F.substring_index(F.substring_index("_after", "/", 1), "?", 1).alias("_authority"))
    out = out.select(*keep, "_secure", "_authority", F.substr("_after", F.length("_authority") + 1).alias("_rest"), F.substring_index("_authority", ":", -1).alias("_last"))
    ported = (F.length("_last") < F.length("_authority")) & (F.translate("_last", "0123456789", "") == "")
    out = out.select(*keep, "_secure", "_authority", "_rest", "_last", ported.alias("_ported"))
    name = F.when(c("_ported"), F.substr("_authority", F.lit(1), F.length("_authority") - F.length("_last") - 1)).otherwise(c("_authority"))
    port = F.when(c("_ported") & (c("_last") != ""), c("_last")).when(c("_secure"), "443").otherwise("80")
    out = out.select(*keep, "_secure", "_rest", name.alias("_name"), port.alias("_port"))
    out = out.select(*keep, "_secure", "_rest", "_name", "_port", F.substring_index("_name", "@", -1).alias("_host"))
    user = F.substr("_name", F.lit(1), F.length("_name") - F.length("_host"))
    path = F.when(c("_rest").startswith("/"), c("_rest")).otherwise(F.concat(F.lit("/"), c("_rest")))
    return out.select(*keep, F.concat(F.when(c("_secure"), "https://").otherwise("http://"), user, F.lower("_host"), F.lit(":"), c("_port"), path).alias("key"))


def key_digest(key: Column) -> Column:
    """16 bytes that stand for the key in the state; two of n keys agree by chance with a probability below n^2 / 2^129."""
    return F.unhex(F.md5(key))


class SeenKeys:
    """Keyed state in a folder, fed one micro-batch at a time; opening the folder again goes on from its last one."""

    def __init__(self, spark: SparkSession, folder: str | None = None) -> None:
        self.spark, self.folder = spark, folder or work_dir(spark, "seen-keys")
        self.fed = self._whole("feed")
        if self.fed:
            self._run()  # a feed whose micro-batch didn't end

    def _whole(self, name: str) -> int:
        """How many feeds are wholly written."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        n = 0
        while fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/n{n:09d}/_SUCCESS")):
            n += 1
        return n

    def feed(self, rows: DataFrame) -> None:
        """Take in ``rows`` (digest, place) as one micro-batch; places above KNOWN must not be below those fed before. Null digests are skipped."""
        path = f"{self.folder}/feed/n{self.fed:09d}"
        rows.select("digest", F.col("place").cast("long").alias("place")).where("digest IS NOT NULL").write.mode("overwrite").parquet(path)
        self.fed += 1
        self._run()

    def _answer(self, flags: DataFrame, batch: int) -> None:
        """Write the answers of a micro-batch. flags: (digest, first_place) of the keys in it, as the state has them."""
        at = f"{self.folder}/flags/batch={batch}"
        # Written by itself: in one plan with the join, adaptive execution may cancel the state's part when the other is empty.
        flags.where(F.col("first_place") > KNOWN).select(F.col("digest").alias("d"), "first_place").write.mode("overwrite").parquet(at)
        firsts = self.spark.read.schema("d binary, first_place long").parquet(at)
        rows = self.spark.read.schema(_ARRIVALS).parquet(f"{self.folder}/feed/n{batch:09d}").where(F.col("place") > KNOWN)
        joined = rows.join(firsts, (F.col("place") == F.col("first_place")) & (F.col("digest") == F.col("d")), "left")
        joined.select("place", F.col("first_place").isNull().alias("repeat")).write.mode("overwrite").parquet(f"{self.folder}/answers/batch={batch}")

    def _run(self) -> None:
        spark = self.spark
        before = {k: spark.conf.get(k, None) for k in _STATE}
        for k, v in _STATE.items():
            spark.conf.set(k, v)
        try:
            arrivals = spark.readStream.schema(_ARRIVALS).parquet(f"{self.folder}/feed/*")
            flags = arrivals.groupBy("digest").agg(F.min("place").alias("first_place"))
            query = flags.writeStream.outputMode("update").foreachBatch(self._answer).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start()
            query.awaitTermination()
        finally:
            for k, v in before.items():
                spark.conf.set(k, v) if v is not None else spark.conf.unset(k)

    def answers(self) -> DataFrame:
        """(place, repeat) of every record fed after the known keys."""
        if not self.fed:
            return self.spark.createDataFrame([], _ANSWERS)
        return self.spark.read.schema(_ANSWERS).parquet(f"{self.folder}/answers").select("place", "repeat")


def ranges(rows: DataFrame, batch_rows: int) -> list[DataFrame]:
    """``rows`` (digest, place) cut into ranges of place of about ``batch_rows``, in order."""
    n = -(-rows.count() // batch_rows)
    if n <= 1:
        return [rows]
    staged = frozen(rows, "arrivals")
    cuts = sorted(set(staged.agg(F.percentile_approx("place", [i / n for i in range(1, n)], 100 * n)).first()[0]))
    return [staged.where(F.lit(True) if lo is None else F.col("place") > lo).where(F.lit(True) if hi is None else F.col("place") <= hi) for lo, hi in zip([None, *cuts], [*cuts, None])]


def arrivals(queue: DataFrame) -> DataFrame:
    """(digest, place) of the rows of ``queue`` (queue_id, url) that have a key."""
    return with_key(queue.where("queue_id IS NOT NULL"), "queue_id").select(key_digest(F.col("key")).alias("digest"), F.col("queue_id").cast("long").alias("place"))


def repeats(queue: DataFrame, known: list[DataFrame], batch_rows: int = BATCH_ROWS) -> DataFrame:
    """(queue_id) of the rows of ``queue`` whose key was seen before: as known, or at a smaller queue_id.

    ``known`` are tables with a ``url``. Rows may stand in any order. Rows without a key (null, empty, relative or not
    http) and without a queue_id are never repeats. A queue_id that is repeated comes out once; with one key it is one
    arrival, with several it is a repeat if one of them is. Empty tables know nothing. Other columns are not read.
    """
    seen = SeenKeys(queue.sparkSession)
    before = None
    for k in known:
        rows = with_key(k).select(key_digest(F.col("key")).alias("digest"), F.lit(KNOWN).cast("long").alias("place"))
        before = rows if before is None else before.unionByName(rows)
    if before is not None:
        seen.feed(before)
    for part in ranges(arrivals(queue), batch_rows):
        seen.feed(part)
    return seen.answers().where("repeat").select(F.col("place").alias("queue_id")).distinct()


def exact_repeats(queue: DataFrame, known: list[DataFrame]) -> DataFrame:
    """The same from whole keys in one batch, to measure the rate of wrong answers: (queue_id, repeat) of rows with a key."""
    rows = with_key(queue, "queue_id").select("key", F.col("queue_id").cast("long").alias("place"))
    every = rows
    for k in known:
        every = every.unionByName(with_key(k).select("key", F.lit(KNOWN).cast("long").alias("place")))
    firsts = every.groupBy("key").agg(F.min("place").alias("first_place"))
    return rows.join(firsts, "key").select(F.col("place").alias("queue_id"), (F.col("place") > F.col("first_place")).alias("repeat"))


def wrong_answers(queue: DataFrame, found: DataFrame, known: list[DataFrame]) -> DataFrame:
    """One row: rows, rows with a key, repeats, wrong answers, their rate, and the bound of its expectation by the digests' size."""
    truth = exact_repeats(queue, known)
    joined = truth.join(found.select(F.col("queue_id").alias("f")), F.col("queue_id") == F.col("f"), "left")
    said = F.col("f").isNotNull()
    n_rows = queue.count()
    return joined.agg(F.lit(n_rows).alias("n_rows"), F.count("*").alias("n_keyed"), F.count_if(said).alias("n_repeats"), F.count_if(said != F.col("repeat")).alias("n_wrong"), F.coalesce(F.avg((said != F.col("repeat")).cast("double")), F.lit(0.0)).alias("wrong_rate"), (F.pow(F.count("*").cast("double"), F.lit(2.0)) / F.pow(F.lit(2.0), F.lit(129.0))).alias("expected_bound"))
