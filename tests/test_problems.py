"""Consolidation of small files and heavy keys, with the edge cases their docstrings define."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from webloom.operators import compaction
from webloom.operators.compaction import consolidate, plan
from webloom.operators.heavy_keys import crawl_keys, heavy
from webloom.sources.store_format import encode, records

FILES = "file_id long, table_name string, n_bytes long, body binary, digest string, group_id int"


def files(spark, rows):
    return spark.createDataFrame([(i, t, None if b is None else len(b), b, "clash", 1) for i, t, b in rows], FILES)


def rec(key, **cells):
    return encode(key.encode(), [(k.encode(), v.encode()) for k, v in cells.items()])


def test_format_round_trip():
    body = encode(b"k", [(b"url", b"a b\nc "), (b"x", b"")]) + encode(b"", [])
    got = list(records(body))
    assert [(k, c) for k, c, _ in got] == [(b"k", [(b"url", b"a b\nc "), (b"x", b"")]), (b"", [])]
    assert b"".join(r for _, _, r in got) == body
    broken = list(records(encode(b"k", [(b"a", b"b")]) + b"tail without form"))
    assert broken[1][0] is None and broken[1][2] == b"tail without form"


def test_consolidation(spark):
    a, b = rec("k", url="u", code="1"), rec("k", code="1", url="u")
    rows = [(1, "t", a + rec("k", url="other")), (2, "t", b), (3, "t", None), (4, "t", b""), (5, None, a), (6, None, a), (7, "s", a), (8, "t", b"bad"), (9, "t", a * 500)]
    out = consolidate(files(spark, rows), 64)
    assert sorted(map(tuple, out.surplus.collect())) == sorted([(2, 0), (6, 0)] + [(9, i) for i in range(500)])
    kept = out.output(spark).collect()
    assert len(kept) == 5 and {(r.table_name, r.file_id, r.rec_no) for r in kept} == {("t", 1, 0), ("t", 1, 1), ("t", 8, 0), (None, 5, 0), ("s", 7, 0)}
    assert sum(r.records_read for r in out.counts.collect()) == 507 and sum(r.records_written for r in out.counts.collect()) == 5


def test_consolidation_of_repeated_and_no_rows(spark):
    twice = files(spark, [(1, "t", rec("k", url="u"))] * 2)
    out = consolidate(twice)
    assert out.surplus.count() == 0 and out.output(spark).count() == 1
    empty = consolidate(files(spark, []))
    assert empty.surplus.count() == 0 and empty.counts.count() == 0


def test_consolidation_beside_a_large_plan(spark, monkeypatch):
    rows = [(i if i else None, "st"[i % 2], rec(f"k{i % 40}", url="u" * i)) for i in range(60)] + [(70, None, rec("k", url="u"))]
    few = consolidate(files(spark, rows), 200)
    monkeypatch.setattr(compaction, "MOST_BOUNDS", -1)
    many = consolidate(files(spark, rows), 200)
    kept = lambda c: sorted(map(str, c.output(spark).drop("digest", "record").collect()))
    assert kept(few) == kept(many) and few.counts.agg(F.sum("files_written")).first()[0] > 10
    assert sorted(map(str, few.counts.collect())) == sorted(map(str, many.counts.collect()))
    planned = {(r.file_id, r.table_name): r.group_id for r in plan(files(spark, rows).select("file_id", "table_name", "n_bytes"), 200).collect()}
    assert all(planned[r.file_id, r.table_name] == r.group_id for r in few.output(spark).collect())


def test_losses_are_raised(spark, monkeypatch):
    rows = [(i, "t", rec(f"k{i}", url="u")) for i in range(10)]
    parse = compaction._parse

    def withheld(bounds):
        return lambda batches: parse(bounds)(b.slice(1) for b in batches)

    monkeypatch.setattr(compaction, "_parse", withheld)
    with pytest.raises(RuntimeError):
        consolidate(files(spark, rows))
    monkeypatch.setattr(compaction, "_parse", parse)
    wrong = files(spark, rows).withColumn("n_bytes", F.when(F.col("file_id") > 7, F.col("n_bytes") + 1))
    assert consolidate(wrong).counts.first().files_misstated == 10


def test_plan_sums_across_blocks(spark):
    rows = [(i * 40_000, "t", 10) for i in range(20)] + [(None, "t", None), (3, "s", 7)]
    got = {(r.table_name, r.file_id): (r.start_byte, r.group_id) for r in plan(spark.createDataFrame(rows, "file_id long, table_name string, n_bytes long"), 25).collect()}
    assert [got["t", i * 40_000] for i in range(20)] == [(10 * i, 10 * i // 25) for i in range(20)]
    assert got["s", 3] == (0, 0) and got["t", None] == (0, 0)


def test_heavy_keys(spark):
    t = dt.datetime(2025, 1, 1)
    rows = [("http://A.test:80/x", "p", t)] * 60 + [(" https://user@a.TEST/y", "", None)] * 3 + [("relative", None, t)] * 30 + [(None, "q", t)] * 2 + [(f"http://h{i}.test/", f"page {i}", t) for i in range(60)]
    crawl = spark.createDataFrame([(*r, "clash", 5) for r in rows], "url string, page string, fetched_at timestamp, host string, n_rows int")
    states = {(r.field_name, r.key_value): (r.n_rows, r.n_bytes, r.newest) for r in crawl_keys(crawl).collect()}
    assert states["url", "a.test"] == (63, 60, t) and states["url", None][0] == 30 and states["page", "d41d8cd98f00b204e9800998ecf8427e"][:2] == (3, 0)
    assert {(r.field_name, r.key_value) for r in heavy(crawl_keys(crawl), 0.1).collect()} == {("url", "a.test"), ("page", "83878c91171338902e0fe0fb97a8c47a")}
    assert heavy(crawl_keys(crawl.limit(0)), 0.1).count() == 0


@pytest.mark.parametrize("value, host", [("HTTP://WWW.X.test./a", "www.x.test."), ("http://[::1]:80/", "[::1]"), ("mailto:x", None), ("", None), ("http:///x", None)])
def test_hosts(spark, value, host):
    from pyspark.sql import functions as F

    from webloom.operators.heavy_keys import host_of

    assert spark.range(1).select(host_of(F.lit(value)).alias("h")).first().h == host
