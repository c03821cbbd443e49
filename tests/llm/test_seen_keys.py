import random

import pytest
from pyspark.sql import functions as F

from webloom.llm import seen_keys


@pytest.mark.parametrize(
    "given, key",
    [
        ("  HTTP://WWW.A.test\t", "http://www.a.test:80/"),
        ("https://a.test/B?x=1#f", "https://a.test:443/B?x=1"),
        ("http://a.test:8080?q", "http://a.test:8080/?q"),
        ("http://User@A.test/", "http://User@a.test:80/"),
        ("http://U:p@A.test:/a@B:1", "http://U:p@a.test:80/a@B:1"),
        ("http://[::1]/", "http://[::1]:80/"),
        ("http:///x", "http://:80/x"),
        ("ftp://a.test/", None),
        ("/relative", None),
        ("", None),
        (None, None),
    ],
)
def test_keys(spark, given, key):
    got = seen_keys.with_key(spark.createDataFrame([(1, given)], "id long, url string"), "id").collect()
    assert [tuple(r) for r in got] == ([(1, key)] if key else [])


def rows_and_truth(spark):
    rng = random.Random(4)
    urls = [None, "", "x", *(f"http://h{i}.test/{i}" for i in range(30)), "HTTP://H1.test:80/1#z"]
    rows = [(i, rng.choice(urls) if i % 3 else "http://hot.test/", "clash") for i in range(400)]
    key = {u: k for u, k in spark.createDataFrame([(u,) for u in urls if u is not None] + [("http://hot.test/",)], "u string").withColumn("url", F.col("u")).transform(lambda df: seen_keys.with_key(df, "u")).collect()}
    seen, expected = {"http://h5.test:80/5"}, set()
    for i, u, _ in rows:
        if k := key.get(u):
            if k in seen:
                expected.add(i)
            seen.add(k)
    rng.shuffle(rows)
    frame = lambda r: spark.createDataFrame(r, "queue_id long, url string, first_place string")
    return frame(rows), [frame([]).select("url"), frame([(0, "http://h5.test:80/5", "")])], expected


def test_repeats_over_many_batches(spark):
    queue, known, expected = rows_and_truth(spark)
    for batch_rows in (90, 1 << 26):
        got = [r.queue_id for r in seen_keys.repeats(queue, known, batch_rows).collect()]
        assert sorted(got) == sorted(expected)
    report = seen_keys.wrong_answers(queue, spark.createDataFrame([(i,) for i in got], "queue_id long"), known).first()
    assert (report.n_rows, report.n_repeats, report.n_wrong, report.wrong_rate) == (400, len(expected), 0, 0.0)


def test_state_outlives_its_session(spark, tmp_path):
    """Stop between micro-batches, and within one: what was fed but not answered is answered when the folder is opened again."""
    queue, known, expected = rows_and_truth(spark)
    folder = f"file://{tmp_path}/seen"
    parts = seen_keys.ranges(seen_keys.arrivals(queue), 150)
    assert len(parts) == 3
    first = seen_keys.SeenKeys(spark, folder)
    first.feed(seen_keys.with_key(known[1]).select(seen_keys.key_digest(F.col("key")).alias("digest"), F.lit(seen_keys.KNOWN).alias("place")))
    first.feed(parts[0])
    first._run = lambda: None  # the session ends before the micro-batch
    first.feed(parts[1])
    second = seen_keys.SeenKeys(spark, folder)
    assert second.fed == 3
    second.feed(parts[2])
    answers = {r.place: r.repeat for r in second.answers().collect()}
    assert {p for p, repeat in answers.items() if repeat} == expected and len(answers) == seen_keys.arrivals(queue).count()


def test_clashing_ids_and_empty_tables(spark):
    frame = lambda r: spark.createDataFrame(r, "queue_id long, url string")
    queue = frame([(1, "http://a.test"), (2, "http://a.test"), (2, "http://b.test"), (3, "http://c.test"), (3, "http://c.test"), (None, "http://c.test")])
    assert [r.queue_id for r in seen_keys.repeats(queue, []).collect()] == [2]
    assert seen_keys.repeats(frame([]), [frame([])]).count() == 0
