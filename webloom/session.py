"""Session defaults and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

LOCAL_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster the caller brings its own."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("webloom").config("spark.driver.memory", memory)
    for k, v in {**LOCAL_DEFAULTS, "spark.sql.shuffle.partitions": str(partitions), **conf}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which all executors share.

    Only where that setting is absent (a local session) is a folder of this machine used, and then set for the session.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), f"webloom-{os.getuid()}")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def frozen(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage is cut and a lost executor costs nothing."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str, n: int) -> DataFrame:
    """As ``frozen``, in ``n`` buckets of ``key``, so that joins and groups by it need no shuffle in sessions of as many partitions.

    The table's name is dropped again at once; its files stay in the shared folder.
    """
    spark = df.sparkSession
    path = work_dir(spark, name)
    own = f"{name}_{path[-32:]}"
    df.write.bucketBy(n, key).option("path", path).saveAsTable(own)
    out = spark.table(own)
    spark.sql(f"DROP TABLE {own}")
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ship_package(spark: SparkSession) -> None:
    """Make this package importable by the executors' Python, once per context; the driver serves the archive."""
    sc = spark.sparkContext
    if getattr(sc, "_webloom_shipped", False):
        return
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="webloom-")
    with zipfile.ZipFile(archive := os.path.join(folder, "webloom.zip"), "w") as z:
        for at, _, names in os.walk(os.path.join(here, "webloom")):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(at, name)
                    z.write(path, os.path.relpath(path, here))
    sc.addPyFile(archive)
    sc._webloom_shipped = True
