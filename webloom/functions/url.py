"""Addresses and links as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LINKS_FULL, LINKS_KEPT = 11, 10
#: The paths that the ranking leaves out, and how it finds links.
_REJECTED = r"\.(jpg|jpeg|gif|png|txt)$"
_RANK_LINK = r'(?i)<a\s+(?:[^>]*?\s+)?href="([^"]*)"'


def _null_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def parse_url_parts(url: Column) -> Column:
    """struct(protocol, host, port, path). Without ``://`` all of it is path; the path keeps query and fragment and is ``/`` if absent."""
    shape = r"(?s)^([^:/?#]+)://([^:/]*)(?::([0-9]*))?(.*)$"
    part = lambda i: _null_if_empty(F.regexp_extract(url, shape, i))
    absolute = F.regexp_extract(url, shape, 1) != ""
    return F.struct(
        part(1).alias("protocol"),
        part(2).alias("host"),
        part(3).alias("port"),
        F.when(absolute, F.coalesce(part(4), F.lit("/"))).otherwise(url).alias("path"),
    )


def _default_port(protocol: Column) -> Column:
    return F.when(protocol == "http", "80").when(protocol == "https", "443")


def with_port(url: Column) -> Column:
    """An http or https address with its port written out; null for all else."""
    p = parse_url_parts(url)
    port = F.coalesce(p["port"], _default_port(p["protocol"]))
    path = F.when(p["path"].startswith("/"), p["path"]).otherwise(F.concat(F.lit("/"), p["path"]))
    return F.when(p["protocol"].isin("http", "https") & p["host"].isNotNull(), F.concat(p["protocol"], F.lit("://"), p["host"], F.lit(":"), port, path))


def normalize_seed_url(url: Column) -> Column:
    """A seed with its port written out and without fragment."""
    return with_port(F.regexp_replace(url, r"(?s)#.*$", ""))


def extract_links_crawl(page: Column) -> Column:
    """Distinct quoted targets of ``<a ... href=``, as the crawler takes them: of each tag the first that holds no blanks; none with braces."""
    found = F.regexp_extract_all(page, F.lit("<a\\s+[^>]*?href\\s*=(\"[^\">\\s]*\"|'[^'>\\s]*')[^>]*>"), F.lit(1))
    targets = F.array_distinct(F.transform(found, lambda q: F.substring(q, F.lit(2), F.length(q) - 2)))
    return F.filter(targets, lambda x: ~x.rlike("[{}]"))


def extract_links_rank(page: Column) -> Column:
    """Targets in double quotes, in any case, with repeats; without blank ones and bare fragments."""
    found = F.regexp_extract_all(page, F.lit(_RANK_LINK), F.lit(1))
    return F.filter(found, lambda x: ~x.startswith("#") & (F.trim(x) != ""))


def link_cap(links: Column, full: int = LINKS_FULL, kept: int = LINKS_KEPT) -> Column:
    """More than ``full`` links are cut to ``kept``."""
    return F.when(F.size(links) > full, F.slice(links, 1, kept)).otherwise(links)


def _climb(path: Column) -> Column:
    """The path with ``.`` and ``..`` resolved; null if it climbs above the root."""
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(True).alias("ok"))

    def step(acc: Column, s: Column) -> Column:
        size = F.size(acc["kept"])
        up = F.struct(F.slice(acc["kept"], 1, F.greatest(size - 1, F.lit(0))).alias("kept"), (acc["ok"] & (size > 0)).alias("ok"))
        down = F.struct(F.concat(acc["kept"], F.array(s)).alias("kept"), acc["ok"].alias("ok"))
        return F.when(s == "..", up).when(s == ".", acc).otherwise(down)

    walked = F.aggregate(F.split(F.substring(path, 2, 1 << 30), "/", -1), start, step)
    return F.when(walked["ok"], F.concat(F.lit("/"), F.array_join(walked["kept"], "/")))


def _resolve(base: Column, link: Column) -> tuple[Column, Column]:
    """Scheme, host and port of the base, and the link's path below it (not yet climbed)."""
    b = parse_url_parts(base)
    site = F.concat(b["protocol"], F.lit("://"), b["host"], F.lit(":"), F.coalesce(b["port"], _default_port(b["protocol"])))
    folder = F.regexp_extract(F.regexp_replace(b["path"], r"(?s)[?#].*$", ""), r"(?s)^(.*/)", 1)
    return site, F.when(link.startswith("/"), link).otherwise(F.concat(folder, link))


def _absolute(link: Column) -> Column:
    return link.rlike(r"(?i)^https?://")


def _foreign(link: Column) -> Column:
    return link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:") & ~_absolute(link)


def normalize_link_crawl(base: Column, link: Column) -> Column:
    """A link as the crawler queues it: fragments are cut from relative links only, queries stay, ports are written out.

    A bare fragment and a path that climbs above the root give the base; other schemes give null.
    """
    bare = F.regexp_replace(link, r"(?s)#.*$", "")
    site, joined = _resolve(base, bare)
    path, query = F.regexp_extract(joined, r"(?s)^([^?]*)", 1), F.regexp_extract(joined, r"(?s)^[^?]*(\?.*)$", 1)
    climbed = F.when(path.contains("./"), _climb(path)).otherwise(path)
    return (
        F.when(_absolute(link), with_port(link))
        .when(_foreign(link), F.lit(None).cast("string"))
        .when(bare == "", with_port(base))
        .otherwise(F.coalesce(F.concat(site, climbed, query), with_port(base)))
    )


def normalize_link_rank(base: Column, link: Column) -> Column:
    """A link as the ranking takes it: http and https only, without query and fragment, dots resolved, port written out; no images and plain texts, else null."""
    bare = F.regexp_replace(link, r"(?s)[?#].*$", "")
    own = parse_url_parts(bare)
    scheme = F.lower(own["protocol"])
    own_site = F.when(own["host"].isNotNull(), F.concat(scheme, F.lit("://"), own["host"], F.lit(":"), F.coalesce(own["port"], _default_port(scheme))))
    site, joined = _resolve(base, bare)
    path = F.when(_absolute(link), own["path"]).otherwise(joined)
    climbed = F.when(path.contains("/."), _climb(path)).otherwise(path)
    target = F.when(_absolute(link), F.concat(own_site, climbed)).when(~_foreign(link) & (bare != ""), F.concat(site, climbed))
    return F.when(~climbed.rlike(_REJECTED), target)


def crawl_page_filter(url: Column, code: Column, content_type: Column) -> Column:
    """The pages that jobs read: no ``..``, at most 100 characters, status 200, html in UTF-8."""
    return ~url.contains("..") & (F.length(url) <= 100) & (code == "200") & content_type.contains("text/html") & F.lower(content_type).contains("utf-8")
