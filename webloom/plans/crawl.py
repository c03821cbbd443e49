"""The crawl as dataflow: what of a frontier to fetch, and what comes of a fetch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom.functions.robots import robots_check, robots_parse
from webloom.functions.url import extract_links_crawl, link_cap, normalize_link_crawl, normalize_seed_url, parse_url_parts
from webloom.operators.heavy_keys import host_of
from webloom.session import frozen, work_dir

#: Asks the web: from (url) to what it says of each.
Fetch = Callable[[DataFrame], DataFrame]
#: Rows of a queue that are kept for recovery, bytes of a page, and codes of redirects.
FRONTIER_CAP, MAX_PAGE_BYTES = 20_000, 5_000_000
REDIRECTS = ("301", "302", "303", "307", "308")


def unseen(frontier: DataFrame, crawl: DataFrame) -> DataFrame:
    """Distinct addresses of the frontier that the store doesn't hold."""
    return frontier.where("url IS NOT NULL").select("url").distinct().join(crawl.select("url"), "url", "left_anti")


def capped(frontier: DataFrame, order: str, cap: int = FRONTIER_CAP) -> DataFrame:
    """The first ``cap`` rows of a frontier, in order."""
    return frontier.orderBy(order).limit(cap)


def fetch_gate(content_type: Column, code: Column, length: Column) -> Column:
    """Whether a page is fetched and stored: html, status 200, not too long; an unknown length passes."""
    n = length.try_cast("long")
    return F.coalesce(content_type.contains("text/html") & (code == "200") & (F.coalesce(n, F.lit(0)) < MAX_PAGE_BYTES), F.lit(False))


def redirected(code: Column) -> Column:
    return F.coalesce(code.isin(*REDIRECTS), F.lit(False))


def page_links(pages: DataFrame) -> DataFrame:
    """(url, link): what a page adds to the frontier, capped per page."""
    links = link_cap(extract_links_crawl(F.col("page")))
    return pages.select("url", F.explode(links).alias("raw")).select("url", normalize_link_crawl(F.col("url"), F.col("raw")).alias("link")).where("link IS NOT NULL")


def allowed(frontier: DataFrame, hosts: DataFrame) -> DataFrame:
    """Addresses of the frontier that their host's robots file allows; hosts without a found file allow none."""
    plain = F.regexp_replace(F.lower("host_url"), r"\.$", "")
    latest = hosts.where("host_url IS NOT NULL").groupBy(plain.alias("h")).agg(F.max(F.struct("time_stamp", "response_code", "robots_text")).alias("m"))
    rules = latest.select("h", F.col("m.response_code").alias("code"), robots_parse(F.col("m.robots_text")).alias("rules"))
    joined = frontier.withColumn("host", host_of(F.col("url"))).join(rules, F.col("host") == F.col("h"))
    return joined.where(robots_check(F.col("code"), F.col("rules"), parse_url_parts(F.col("url"))["path"])).select("url", "host")


def delay_gate(frontier: DataFrame, order: str) -> DataFrame:
    """One address per host and round: the first in ``order``; the others stay for later rounds (``due`` false)."""
    first = F.row_number().over(Window.partitionBy("host").orderBy(order)) == 1
    return frontier.withColumn("due", first)


def offline(crawl: DataFrame) -> tuple[Fetch, Fetch]:
    """(head, get) of a stored crawl: what its latest fetch of an address says; addresses it doesn't hold give 404."""
    latest = F.max(F.struct("fetched_at", "crawl_id", "response_code", "content_type", "length", "page")).alias("m")
    web = crawl.where("url IS NOT NULL").groupBy(F.col("url").alias("u")).agg(latest).select("u", "m.response_code", "m.content_type", "m.length", "m.page")

    def head(todo: DataFrame) -> DataFrame:
        got = todo.join(web.drop("page"), F.col("url") == F.col("u"), "left")
        return got.select("url", F.coalesce("response_code", F.lit("404")).alias("response_code"), "content_type", "length", F.lit(None).cast("string").alias("location"))

    def get(todo: DataFrame) -> DataFrame:
        return todo.join(web.select("u", "response_code", "page"), F.col("url") == F.col("u")).select("url", "response_code", "page")

    return head, get


def _ended(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


_STORE = "url string, response_code string, content_type string, length string, page string"


def crawl_loop(seeds: DataFrame, hosts: DataFrame, head: Fetch, get: Fetch, rounds: int, folder: str | None = None) -> DataFrame:
    """Crawl from ``seeds`` (url); the store (url, response_code, content_type, length, page) after so many rounds.

    Each round takes the addresses of the queue that the store doesn't hold and robots files allow. Of each host the
    first is due; the others are queued again. ``head`` maps what is due (url) to (url, response_code, content_type,
    length, location); what passes the gate is asked of ``get``, which gives (url, response_code, page). Links of pages
    and places that redirects point to come into the next queue. Nothing is dropped: a queue is as long as it is.

    The queue and store of each round are written to ``folder``. A crawl that finds a folder with rounds in it goes on
    after the last one whose queue was wholly written.
    """
    spark = seeds.sparkSession
    folder = folder or work_dir(spark, "crawl")
    at = 0
    while _ended(spark, f"{folder}/queue-{at}"):
        at += 1
    if not at:
        seeds.select(normalize_seed_url(F.col("url")).alias("url")).where("url IS NOT NULL").distinct().write.mode("overwrite").parquet(f"{folder}/queue-0")
        at = 1

    def stored(n: int) -> DataFrame:
        return spark.read.schema(_STORE).parquet(*[f"{folder}/store-{i}" for i in range(n)]) if n else spark.createDataFrame([], _STORE)

    for n in range(at - 1, rounds):
        queue = spark.read.schema("url string").parquet(f"{folder}/queue-{n}")
        if queue.isEmpty():
            return stored(n)
        todo = frozen(delay_gate(allowed(unseen(queue, stored(n)), hosts), "url"), "todo")
        asked = frozen(head(todo.where("due").select("url")), "asked")
        wanted = asked.where(fetch_gate(F.col("content_type"), F.col("response_code"), F.col("length"))).select("url")
        got = get(wanted).select(F.col("url").alias("u"), F.col("response_code").alias("code"), "page")
        joined = asked.join(got, F.col("url") == F.col("u"), "left")
        page = F.when(F.col("code") == "200", F.col("page")).alias("page")
        joined.select("url", F.coalesce("code", "response_code").alias("response_code"), "content_type", "length", page).write.mode("overwrite").parquet(f"{folder}/store-{n}")
        links = page_links(spark.read.schema(_STORE).parquet(f"{folder}/store-{n}").where("page IS NOT NULL").select("url", "page")).select(F.col("link").alias("url"))
        moved = asked.where(redirected(F.col("response_code")) & F.col("location").isNotNull()).select(normalize_link_crawl(F.col("url"), F.col("location")).alias("url"))
        later = todo.where("NOT due").select("url")
        links.unionByName(moved).unionByName(later).where("url IS NOT NULL").distinct().write.mode("overwrite").parquet(f"{folder}/queue-{n + 1}")
    return stored(rounds)
