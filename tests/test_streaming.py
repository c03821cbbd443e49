from webloom.session import work_dir
from webloom.streaming.politeness import delay_gate


def test_delay_gate(spark, tmp_path):
    schema = "host string, url string, at_ms long, delay_ms double"
    rounds = [[("h", "a", 0, None), ("h", "b", 500, None), ("g", "c", 10, 5.0), (None, "x", 1, None)], [("h", "d", 1000, None), ("h", "e", 1001, None), ("g", "f", 15, 5.0), ("g", "i", 16, 5.0)]]
    for rows in rounds:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    q = delay_gate(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", work_dir(spark, "delay")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.url: r.due for r in spark.read.parquet(out).collect()}
    assert got == {"a": True, "b": False, "c": True, "d": False, "e": True, "f": False, "i": True}
