"""Consolidating a store of very many small files.

The plan reads only the manifest (ids and sizes, never a body): files are put in order, their bytes summed
along that order, and each interval of ``target_bytes`` along the sum is one output file. As ids rise along the sum, a
group is known by its first id, so bodies are parsed where they are read and move once, as records, to their group.
The rewrite keeps one copy of each distinct record, writes each group as one file and reconciles what was listed,
read, written and left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.session import frozen, work_dir
from webloom.sources.store_format import identity, records

#: Bytes of input that make one output file.
TARGET_BYTES = 128 << 20
#: Files whose ids share one value of ``file_id div BLOCK`` are summed in one window partition.
BLOCK = 1 << 16
#: Most groups whose first ids are sent to the executors; with more, bodies are joined with the plan. Most tasks of the rewrite.
MOST_BOUNDS, MOST_TASKS = 1 << 20, 1 << 16
_NULL_ID = -(1 << 63)

_RECORDS = "table_name string, group_id long, file_id long, rec_no int, row_key string, n_bytes long, digest binary, record binary"


def plan(manifest: DataFrame, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """``manifest`` (file_id, table_name, n_bytes) with ``start_byte`` and ``group_id``; in SQL only.

    The order is file_id within table_name. The sum runs in two levels, so that no task sees more than one block of
    ids or one row per block. Nulls: sizes count as 0, a null file_id stands first, null table names form a table of
    their own. Repeated manifest rows have the same place in the order and share a group. An empty manifest gives no rows.
    """
    return manifest.sparkSession.sql(
        """
        WITH m AS (
          SELECT file_id, table_name, coalesce(n_bytes, 0L) AS n_bytes, floor(file_id / {block}) AS block FROM {manifest}
        ), blocks AS (
          SELECT table_name, block, sum(block_bytes) OVER (PARTITION BY table_name ORDER BY block) - block_bytes AS before
          FROM (SELECT table_name, block, sum(n_bytes) AS block_bytes FROM m GROUP BY table_name, block)
        ), within AS (
          SELECT *, sum(n_bytes) OVER (PARTITION BY table_name, block ORDER BY file_id) - n_bytes AS inner_before FROM m
        )
        SELECT w.file_id, w.table_name, w.n_bytes, b.before + w.inner_before AS start_byte,
               cast(floor((b.before + w.inner_before) / {target}) AS long) AS group_id
        FROM within w JOIN blocks b ON w.table_name <=> b.table_name AND w.block <=> b.block
        """,
        manifest=manifest,
        block=BLOCK,
        target=target_bytes,
    )


def _bounds(planned: DataFrame) -> dict[str | None, tuple[np.ndarray, np.ndarray]]:
    """Per table the first ids of its groups, in order, and the groups; a null id counts as the smallest."""
    first = F.min(F.coalesce("file_id", F.lit(_NULL_ID))).alias("first")
    held: dict[str | None, list[tuple[int, int]]] = {}
    for r in planned.groupBy("table_name", "group_id").agg(first).toLocalIterator():
        held.setdefault(r["table_name"], []).append((r["first"], r["group_id"]))
    return {k: tuple(np.array(c, np.int64) for c in zip(*sorted(v))) for k, v in held.items()}


def _parse(bounds: Broadcast | None):
    """Records of files, and for each file a row with rec_no -1 and the length of its body. Without bounds, files come with their group."""
    schema = pa.schema([("table_name", pa.string()), ("group_id", pa.int64()), ("file_id", pa.int64()), ("rec_no", pa.int32()), ("row_key", pa.string()), ("n_bytes", pa.int64()), ("digest", pa.binary()), ("record", pa.binary())])

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            names, ids, bodies = (batch.column(c).to_pylist() for c in ("table_name", "file_id", "body"))
            groups = batch.column("group_id").to_pylist() if bounds is None else [None] * len(ids)
            for name, group, file_id, body in zip(names, groups, ids, bodies):
                if bounds is not None:
                    firsts, numbers = bounds.value[name]
                    group = int(numbers[np.searchsorted(firsts, _NULL_ID if file_id is None else file_id, "right") - 1])
                rows.append((name, group, file_id, -1, None, len(body or b""), b"", None))
                for no, (key, cells, raw) in enumerate(records(body or b"")):
                    text = None if key is None else key.decode("utf-8", "replace")
                    rows.append((name, group, file_id, no, text, len(raw), identity(name, key, cells), raw))
                    held += len(raw)
                    if held > 16 << 20:
                        yield packed(rows)
                        rows, held = [], 0
            if rows:
                yield packed(rows)

    return run


@dataclass
class Consolidated:
    """What a consolidation gives.

    path: the folder of the output; one parquet file per (table_name, group_id).
    surplus: (file_id, rec_no) of each record left out because an equal one stands at a smaller place.
    counts: per table: files listed and read, those whose listed size is not their body's; bytes of bodies and of
    records; records read, distinct, written and left out; bytes and files written.
    """

    path: str
    surplus: DataFrame
    counts: DataFrame

    def output(self, spark: SparkSession) -> DataFrame:
        """The kept records, each with the bytes it had in its file."""
        return spark.read.schema("table_name string, group_id long, file_id long, rec_no int, row_key string, n_bytes long, digest binary, record binary").parquet(self.path)


def consolidate(files: DataFrame, target_bytes: int = TARGET_BYTES) -> Consolidated:
    """Rewrite ``files`` (file_id, table_name, n_bytes, body) into few files that hold every distinct record once.

    Records are equal when table name, row key and the set of cells are equal; the one at the smallest
    (file_id, rec_no) is kept. Null and empty bodies hold no records; bytes that don't follow the format are kept
    as a record without a key; a null file_id stands before all others; further columns are ignored. Copies of a
    record are combined before the shuffle, so a record that makes up a third of the input isn't a hot key. A file that
    is listed twice has each record once in the output and none in the surplus. Sizes are only planned with: a null
    or wrong one is counted, not raised.
    Raises if a listed file wasn't read, if the bytes of its records aren't those of its body, if a distinct record
    wasn't written, or if records read aren't records written plus records left out.
    """
    spark = files.sparkSession
    manifest = frozen(files.select("file_id", "table_name", "n_bytes"), "manifest")
    planned = frozen(plan(manifest, target_bytes).select("file_id", "table_name", "group_id").distinct(), "plan")
    n_groups = planned.select("table_name", "group_id").distinct().count()
    bodies = files.select("file_id", "table_name", "body")
    if n_groups <= MOST_BOUNDS:
        parsed = bodies.mapInArrow(_parse(spark.sparkContext.broadcast(_bounds(planned))), _RECORDS)
    else:
        b, g = bodies.alias("b"), planned.alias("g")
        placed = b.join(g, F.col("b.file_id").eqNullSafe(F.col("g.file_id")) & F.col("b.table_name").eqNullSafe(F.col("g.table_name")))
        parsed = placed.select("b.table_name", "g.group_id", "b.file_id", "b.body").mapInArrow(_parse(None), _RECORDS)
    stored = F.concat(F.lit("t-"), F.coalesce("table_name", F.lit("/"))).alias("store")
    read = frozen(parsed.withColumn("rid", F.monotonically_increasing_id()).select("*", stored), "records")
    parsed = read.where("rec_no >= 0")

    # One state per distinct record, combined before the shuffle. rid tells apart the rows of a file that is listed twice.
    firsts = parsed.groupBy("digest").agg(F.min(F.struct("file_id", "rec_no", "rid", "store", "group_id")).alias("first"), F.count("*").alias("copies"))
    firsts = frozen(firsts.select("first.store", "first.group_id", "first.rid", "copies"), "firsts")

    # The one shuffle of whole records places them by output file; the kept ones are picked out there.
    n, at = max(1, min(n_groups, MOST_TASKS)), ["store", "group_id"]
    path = work_dir(spark, "consolidated")
    kept = parsed.repartition(n, *at).join(firsts.drop("copies").repartition(n, *at), [*at, "rid"])
    kept.select("store", F.col("group_id").alias("part"), "table_name", "group_id", "file_id", "rec_no", "row_key", "n_bytes", "digest", "record").write.partitionBy("store", "part").parquet(path)

    columns = "table_name string, group_id long, file_id long, rec_no int, row_key string, n_bytes long, digest binary, record binary, store string, part long"
    written = spark.read.schema(columns).parquet(path)
    kept_at = written.select(F.col("file_id").alias("f"), F.col("rec_no").alias("r"), F.col("digest").alias("d"))
    surplus = parsed.select("file_id", "rec_no", "digest").join(kept_at, F.col("file_id").eqNullSafe(F.col("f")) & (F.col("rec_no") == F.col("r")) & (F.col("digest") == F.col("d")), "left_anti").select("file_id", "rec_no")

    total = lambda c, on: F.coalesce(F.sum(F.when(on, F.col(c))), F.lit(0)).cast("long")
    a_file, a_record = F.col("rec_no") < 0, F.col("rec_no") >= 0
    listed = manifest.select("*", stored).groupBy("store").agg(F.first("table_name").alias("table_name"), F.count("*").alias("files_listed"))
    sizes = read.where(a_file).select("store", "file_id", F.col("n_bytes").alias("is")).join(manifest.select("file_id", stored, F.col("n_bytes").alias("said")).distinct().withColumnsRenamed({"file_id": "f", "store": "s"}), F.col("file_id").eqNullSafe(F.col("f")) & (F.col("store") == F.col("s")))
    sizes = sizes.groupBy("store").agg(F.count_if(~F.col("is").eqNullSafe(F.col("said"))).alias("files_misstated"))
    got = read.groupBy("store").agg(F.count_if(a_file).alias("files_read"), total("n_bytes", a_file).alias("bytes_read"), total("n_bytes", a_record).alias("record_bytes"), F.count_if(a_record).alias("records_read"))
    distinct = firsts.groupBy("store").agg(F.count("*").alias("records_distinct"), F.sum(F.col("copies") - 1).alias("records_left_out"))
    out = written.groupBy("store").agg(F.count("*").alias("records_written"), F.sum("n_bytes").alias("bytes_written"), F.countDistinct("group_id").alias("files_written"))
    numbers = ["files_listed", "files_read", "files_misstated", "bytes_read", "record_bytes", "records_read", "records_distinct", "records_left_out", "records_written", "bytes_written", "files_written"]
    counts = listed.join(got, "store", "left").join(sizes, "store", "left").join(distinct, "store", "left").join(out, "store", "left")
    counts = frozen(counts.select("table_name", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers)), "counts")
    bad = counts.where("files_read <> files_listed OR record_bytes <> bytes_read OR records_written <> records_distinct OR records_read <> records_written + records_left_out").head(1)
    if bad:
        raise RuntimeError(f"records were lost or doubled: {bad[0]}")
    return Consolidated(path, surplus, counts)
