"""The crawl loop against a plain one, over a small invented web."""

import datetime as dt

from pyspark.sql import functions as F

from webloom.functions.robots import parse
from webloom.plans import crawl as crawling

T = dt.datetime(2025, 1, 1)
CRAWL = "url string, response_code string, content_type string, length string, page string, fetched_at timestamp, crawl_id long"
HOSTS = "host_url string, response_code string, robots_text string, time_stamp timestamp"


def page(*links):
    return "".join(f'<a href="{x}">to</a>' for x in links)


A, B, C = "http://a.test:80", "http://b.test:80", "http://c.test:80"
WEB = {
    f"{A}/": page("/1", "/2", "/3", f"{B}/", "/secret/x", "ftp://a.test/"),
    f"{A}/1": page("2", f"{B}/far", f"{C}/"),
    f"{A}/2": page("/"),
    f"{A}/3": page(f"{B}/deep"),
    f"{B}/": page("/far"),
    f"{B}/far": page(f"{A}/3"),
    f"{C}/": page("/never"),
}


def tables(spark):
    rows = [(u, "200", "text/html", "5", p, T, i) for i, (u, p) in enumerate(WEB.items())]
    rows += [(f"{B}/deep", "200", "image/png", "5", page("/no"), T, 90), (f"{A}/", "500", "text/html", "5", None, T - dt.timedelta(1), 91)]
    hosts = [("a.test", "200", "User-agent: *\nDisallow: /secret", T), ("B.test.", "200", "", T), ("c.test", "404", "", T)]
    return spark.createDataFrame(rows, CRAWL), spark.createDataFrame(hosts, HOSTS)


def expected(rounds):
    """A plain crawl: of each host the smallest address a round, the others wait."""
    queue, store = {f"{A}/"}, {}
    for _ in range(rounds):
        hosts, later = {}, set()
        for u in sorted(queue - set(store)):
            host, path = u.split("/", 3)[2], "/" + u.split("/", 3)[3]
            if host == "c.test:80" or host == "a.test:80" and any(path.startswith(p) for p in parse("User-agent: *\nDisallow: /secret")[1]):
                continue
            if host in hosts:
                later.add(u)
            else:
                hosts[host] = u
        for u in hosts.values():
            store[u] = "200" if u in WEB or u == f"{B}/deep" else "404"
            for link in _links(WEB.get(u, "")):
                later.add(link if link.startswith("http") else u.split("/", 3)[0] + "//" + u.split("/", 3)[2] + "/" + link.lstrip("/"))
        queue = later
    return store


def _links(text):
    return [x.split('"')[0] for x in text.split('href="')[1:] if not x.startswith("ftp")]


def test_rounds_and_resume(spark, tmp_path):
    crawl, hosts = tables(spark)
    head, get = crawling.offline(crawl)
    seeds = spark.createDataFrame([("http://a.test/#top",), (None,)], "url string")
    got = crawling.crawl_loop(seeds, hosts, head, get, 7)
    assert {r.url: r.response_code for r in got.collect()} == expected(7)
    assert {r.url for r in got.where("page IS NOT NULL").collect()} == set(expected(7)) & set(WEB)

    asked = []

    def counting(todo):
        asked.extend(r.url for r in todo.collect())
        return head(todo)

    folder = f"file://{tmp_path}/crawl"
    assert {r.url for r in crawling.crawl_loop(seeds, hosts, counting, get, 2, folder).collect()} == set(expected(2))
    crawling.crawl_loop(seeds, hosts, counting, get, 7, folder)
    assert sorted(asked) == sorted(expected(7))  # nothing is asked again after the start at round 2


def test_redirects_and_the_gates(spark):
    _, hosts = tables(spark)
    web = spark.createDataFrame([(f"{A}/", "301", "text/html", None, "/e"), (f"{A}/e", "200", "text/html", "9", None)], "u string, response_code string, content_type string, length string, location string")
    head = lambda todo: todo.join(web, F.col("url") == F.col("u")).drop("u")
    get = lambda todo: todo.select("url", F.lit("500").alias("response_code"), F.lit("lost").alias("page"))
    got = crawling.crawl_loop(spark.createDataFrame([(f"{A}/",)], "url string"), hosts, head, get, 5)
    assert sorted((r.url, r.response_code, r.page) for r in got.collect()) == [(f"{A}/", "301", None), (f"{A}/e", "500", None)]


def test_delay_keeps_the_others(spark):
    frontier = spark.createDataFrame([(f"http://h{i % 3}.test/{i}", f"h{i % 3}.test") for i in range(30)], "url string, host string")
    gated = crawling.delay_gate(frontier, "url")
    assert gated.where("due").count() == 3 and gated.count() == 30
