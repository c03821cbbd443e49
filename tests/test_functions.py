import math

import pytest
from pyspark.sql import functions as F

from webloom.functions import hashing, robots, text, url
from webloom.functions.stem import stem, stemmed


def one(spark, *columns):
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return tuple(row) if len(columns) > 1 else row[0]


STEMS = (
    "caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster motoring motor sing sing conflated conflat troubled troubl sized size hopping hop "
    "falling fall hissing hiss filing file happy happi sky sky relational relat conditional condit valenci valenc digitizer digit operator oper feudalism feudal hopefulness hope "
    "formaliti formal triplicate triplic electrical electr goodness good revival reviv allowance allow inference infer adjustable adjust effective effect rate rate cease ceas "
    "controll control roll roll"
).split()


def test_stems():
    for word, expected in zip(STEMS[::2], STEMS[1::2]):
        assert stem(word) == expected, word


def test_stemmed_joins_back(spark):
    df = spark.createDataFrame([("u", "cats"), ("u", "cats"), ("v", "running")], "url string, word string")
    assert sorted(map(tuple, stemmed(df).collect())) == [("u", "cat"), ("u", "cat"), ("v", "run")]


def test_hashes(spark):
    assert one(spark, hashing.hash_key(F.lit("a"))) == "86f7e437faa5a7fce15d1ddcb9eaeaea377667b8"
    assert one(spark, hashing.hash_key_compat(F.lit("a"))) == "dkmstqdepsimkmrsqqpgdclqcozqzqzqdeoizgbo"
    assert one(spark, hashing.hash_key_compat(F.lit("http://example.com:80/"))) == "zoqslobmpausikaqjmmeiqnihgckrqscjqwgyoae"


def test_key_encoding_round_trip(spark):
    for value in ("a_b c", "héllo/ü", "", "plain-1", "汉"):
        encoded = hashing.encode_key(F.lit(value))
        assert one(spark, hashing.decode_key(encoded)) == value


@pytest.mark.parametrize(
    "given, expected",
    [("http://h.com:8080/a/b?q=1#f", ("http", "h.com", "8080", "/a/b?q=1#f")), ("https://h.com", ("https", "h.com", None, "/")), ("/foo", (None, None, None, "/foo")), ("//cdn/x", (None, None, None, "//cdn/x"))],
)
def test_url_parts(spark, given, expected):
    assert tuple(one(spark, url.parse_url_parts(F.lit(given)))) == expected


def test_seeds(spark):
    assert one(spark, url.normalize_seed_url(F.lit("https://h.org/w#x"))) == "https://h.org:443/w"
    assert one(spark, url.normalize_seed_url(F.lit("http://h.com"))) == "http://h.com:80/"
    assert one(spark, url.normalize_seed_url(F.lit(None).cast("string"))) is None


BASE = "http://h.com:80/a/b/c.html"


@pytest.mark.parametrize(
    "link, crawl, rank",
    [
        ("d.html", "http://h.com:80/a/b/d.html", "http://h.com:80/a/b/d.html"),
        ("../x", "http://h.com:80/a/x", "http://h.com:80/a/x"),
        ("../../../x", BASE, None),
        ("#top", BASE, None),
        ("/z?q=1#f", "http://h.com:80/z?q=1", "http://h.com:80/z"),
        ("https://o.org/p#f", "https://o.org:443/p#f", "https://o.org:443/p"),
        ("HTTP://o.org:81/a/./b/../c?q#f", None, "http://o.org:81/a/c"),
        ("https://o.org/i.png?x=1", "https://o.org:443/i.png?x=1", None),
        ("x?file=i.png", "http://h.com:80/a/b/x?file=i.png", "http://h.com:80/a/b/x"),
        ("https://o.org/I.PNG", "https://o.org:443/I.PNG", "https://o.org:443/I.PNG"),
        ("https://o.org", "https://o.org:443/", "https://o.org:443/"),
        ("ftp://o.org/p", None, None),
        ("/i.png", "http://h.com:80/i.png", None),
        ("javascript:void(0)", None, None),
    ],
)
def test_links(spark, link, crawl, rank):
    assert one(spark, url.normalize_link_crawl(F.lit(BASE), F.lit(link))) == crawl
    if link != "../../../x":
        assert one(spark, url.normalize_link_rank(F.lit(BASE), F.lit(link))) == rank


def test_crawl_links_of_a_tag(spark):
    page = """<a href="a b" href='one'>x</a><a class=x href="two" href="three">x</a><a href="{no}">x</a><a href=""><a id=1 href="two">"""
    assert one(spark, url.extract_links_crawl(F.lit(page))) == ["one", "two", ""]


@pytest.mark.parametrize("n, kept", [(9, 9), (10, 10), (11, 11), (12, 10)])
def test_link_cap(spark, n, kept):
    assert one(spark, F.size(url.link_cap(F.array(*[F.lit(i) for i in range(n)])))) == kept


def test_html(spark):
    page = F.lit('<title>A &amp; B</title><script>var t="<p>no</p>";</script><p>x <b>y</b></p><p class="q">z</p>')
    assert one(spark, text.visible_text(page)) == "A &amp; B x <b>y</b> "
    assert one(spark, text.page_tokens(page)) == ["a", "amp", "b", "x", "y"]
    assert one(spark, text.page_title(F.lit("<p>x</p>"))) == "No title"
    assert one(spark, text.page_title(F.lit("<title></title>"))) == ""
    assert one(spark, text.tokenize(F.lit(None).cast("string"))) == []
    assert "<script>" not in one(spark, text.render_result(F.lit("u"), F.lit("<script>"), F.lit("s")))


def test_robots(spark):
    rules = robots.parse("User-agent: *\nDisallow: /private\nAllow: /private/open\nCrawl-delay: 2\n")
    assert rules == (["/private/open"], ["/private"], 2000.0)
    assert robots.parse("User-agent: *\nDisallow: /private\nUser-agent: search-crawler\nDisallow: /x\n") == ([], ["/x"], 1000.0)
    assert robots.parse(None) == ([], [], 1000.0)
    assert robots.parse("user-agent: *\ndisallow: /x\nallow: /y\nallow:\nallow: /z\ncrawl-delay: x\n") == (["/y"], [], 1000.0)
    assert robots.parse("user-agent: *\r\ndisallow: /x # no\r\ndisallow:\r\ndisallow: /y\r\nuser-agent: *\r\ndisallow: /z") == ([], ["/x"], 1000.0)
    parsed = robots.robots_parse(F.lit("User-agent: *\nDisallow: /private\nAllow: /private/open\n"))
    check = lambda code, path: one(spark, robots.robots_check(F.lit(code), parsed, F.lit(path)))
    assert (check("200", "/private/open"), check("200", "/x"), check("404", "/x")) == (False, True, False)


def test_tfidf_golden(spark):
    from webloom.plans import index

    pages = spark.createDataFrame([("u1", "<p>cat cat dog</p>"), ("u2", "<p>dog bird</p>"), ("u3", "<p>cat</p>")], "url string, page string")
    got = {(r.url, r.word): (r.tf, r.tfidf) for r in index.tfidf(pages).collect()}
    assert math.isclose(got["u1", "cat"][1], 0.405465, abs_tol=1e-6)
    assert math.isclose(got["u1", "dog"][0], 0.7) and math.isclose(got["u1", "dog"][1], 0.283826, abs_tol=1e-6)
    assert math.isclose(got["u2", "bird"][1], 1.098612, abs_tol=1e-6)
    urls = {r.word: r.urls for r in index.inverted_index(index.page_words(pages)).collect()}
    assert urls == {"cat": ["u1", "u3"], "dog": ["u1", "u2"], "bird": ["u2"]}


def test_search_golden(spark):
    from webloom.plans import index, search

    pages = spark.createDataFrame([("u1", "<p>cat cat dog</p>"), ("u2", "<p>dog bird</p>"), ("u3", "<p>cat</p>")], "url string, page string")
    ranks = spark.createDataFrame([("u1", 1.0), ("u3", 0.0)], "url string, rank double")
    found = search.ranked("cat", index.tfidf(pages), ranks)
    rows = [(r.url, round(r.score, 6)) for r in search.page_of(found).collect()]
    assert rows == [("u1", 0.881093), ("u3", 0.626093)]
    assert search.page_of(found, 2).count() == 0
    assert search.ranked("nothing", index.tfidf(pages), ranks).count() == 0
    with pytest.raises(search.EmptyQuery):
        search.query_words("  ")


@pytest.mark.parametrize("hub_links", [100_000, 1, 0])
def test_pagerank_golden(spark, monkeypatch, hub_links):
    from webloom.plans import rank

    monkeypatch.setattr(rank, "HUB_LINKS", hub_links)
    nodes = spark.createDataFrame([(x,) for x in "ABCD"], "url string")
    edges = spark.createDataFrame([("A", "B"), ("A", "C"), ("B", "C"), ("C", "A")], "src string, dst string")
    got = {r.url: r["rank"] for r in rank.pagerank(nodes, edges, 3).collect()}
    assert got == pytest.approx({"A": 1.0541875, "B": 0.72853125, "C": 1.21728125, "D": 0.15})
    got = {r.url: r["rank"] for r in rank.pagerank(nodes, edges, 100, 1e-4).collect()}
    assert got == pytest.approx({"A": 1.163337, "B": 0.644456, "C": 1.192206, "D": 0.15}, abs=1e-6)


def test_rank_that_does_not_settle(spark):
    from webloom.plans import rank

    nodes, edges = spark.createDataFrame([("A",), ("B",)], "url string"), spark.createDataFrame([("A", "B")], "src string, dst string")
    with pytest.raises(rank.NotConverged):
        rank.pagerank(nodes, edges, 1, 1e-9)


def test_index_blocks_and_search_results(spark):
    from webloom.plans import index, search

    pages = spark.createDataFrame([(f"u{i}", "<title>T</title><p>cat</p>") for i in range(30)], "url string, page string")
    blocks = index.index_blocks(index.page_words(pages), 7).where("word = 'cat'").collect()
    assert len(blocks) > 1 and sorted(u for b in blocks for u in b.urls) == sorted(f"u{i}" for i in range(30))
    scores = spark.createDataFrame([("gone", 9.0), ("u1", 2.0), ("u2", 3.0), ("u3", 1.0)], "url string, score double")
    found = search.results(scores, pages, 1, 2)
    assert sorted((r.url, r.title, r.snippet) for r in found.collect()) == [("u1", "T", "cat"), ("u3", "T", "cat")]
    assert search.answer(found).index("u1") < search.answer(found).index("u3") and search.answer(found.limit(0)) == search.NO_MATCH
