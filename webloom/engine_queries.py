"""The queries of the engine's own operators, with their SQL."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha1

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import hashing, robots, text, url
from webloom.functions.stem import stemmed
from webloom.operators import kv
from webloom.operators.bag import Bag, Context, PairBag
from webloom.operators.heavy_keys import host_of
from webloom.plans import crawl as crawling
from webloom.plans import index, rank, search
from webloom.session import work_dir
from webloom.sources.tables import table

QUERIES, SQL = {}, {}
_HOST_KEY = sha1(b"holmiston.example").hexdigest()


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- fixtures -------------------------------------------------------------------------------------------------------


def _texts(spark: SparkSession, root: str) -> Bag:
    return Bag(table(spark, root, "documents").where("text IS NOT NULL").select(F.col("text").alias("value")))


def _pages(spark: SparkSession, root: str) -> DataFrame:
    return index.crawl_pages(table(spark, root, "crawl"))


def _tokens(spark: SparkSession, root: str) -> PairBag:
    """(token, doc_id) of the documents."""
    documents = table(spark, root, "documents").select(F.explode(text.tokenize(text.clean_text(F.col("text")))).alias("key"), F.col("doc_id").cast("string").alias("value"))
    return PairBag(documents)


def _log(spark: SparkSession, root: str) -> DataFrame:
    """Events as puts: a row per user, a column per event type, the event id as version."""
    return table(spark, root, "events").select(F.col("user_id").cast("string").alias("row_key"), F.col("event_type").alias("column"), F.round("value", 4).cast("string").alias("value"), F.col("event_id").alias("version"))


def _edges(spark: SparkSession, root: str) -> DataFrame:
    """Parts and suppliers that occur in one line item, in both directions."""
    pairs = table(spark, root, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst")).distinct()
    return pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


_S_PAGES = r"""pages AS (
  SELECT url, coalesce(page, '') AS page FROM (
    SELECT url, page, row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC NULLS LAST, crawl_id DESC) AS rn FROM crawl
    WHERE NOT contains(url, '..') AND length(url) <= 100 AND response_code = '200' AND contains(content_type, 'text/html') AND contains(lower(content_type), 'utf-8')
  ) WHERE rn = 1
)"""


def _s_strip(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '(?s)<script.*?</script>', '', 'g'), '(?s)<style.*?</style>', '', 'g')"


def _s_bodies(x: str, tag: str) -> str:
    return f"regexp_extract_all({x}, '(?s)<{tag}>(.*?)</{tag}>', 1)"


def _s_visible(x: str) -> str:
    s = _s_strip(x)
    return f"coalesce(array_to_string(list_transform(list_concat({_s_bodies(s, 'title')}, {_s_bodies(s, 'p')}), lambda b: b || ' '), ''), '')"


def _s_clean(x: str) -> str:
    return rf"lower(regexp_replace(regexp_replace({x}, '<[^>]*>', ' ', 'g'), '[^a-zA-Z0-9\s]', ' ', 'g'))"


def _s_tokens(x: str) -> str:
    return rf"list_filter(regexp_split_to_array(coalesce({x}, ''), '\s+'), lambda t: t <> '')"


_S_WORDS = f"""{_S_PAGES}, words AS (
  SELECT url, unnest(list_filter({_s_tokens(_s_clean(_s_visible('page')))}, lambda t: length(t) <= 100)) AS word FROM pages
)"""
_S_TF = f"""{_S_WORDS}, counts AS (SELECT url, word, count(*) AS n FROM words GROUP BY ALL),
tf AS (SELECT url, word, n, max(n) OVER (PARTITION BY url) AS max_n, 0.4::DOUBLE + 0.6::DOUBLE * n / max(n) OVER (PARTITION BY url) AS tf FROM counts)"""
_S_TFIDF = f"""{_S_TF}, dfs AS (SELECT word, count(*) AS df FROM tf GROUP BY word),
idfs AS (SELECT word, df, ln((SELECT count(*) FROM pages)::DOUBLE / df) AS idf FROM dfs),
scored AS (SELECT word, url, tf, idf, tf * idf AS tfidf FROM tf JOIN idfs USING (word))"""
_S_DOC_TOKENS = f"toks AS (SELECT unnest({_s_tokens(_s_clean('text'))}) AS key, doc_id::VARCHAR AS value FROM documents)"
_S_LOG = "log AS (SELECT user_id::VARCHAR AS row_key, event_type AS \"column\", value AS v, event_id AS version FROM events)"


# --- sources, actions and bags --------------------------------------------------------------------------------------


@query("SELECT unnest(['crawl', 'host', 'queue', 'queue', 'seed']) AS value")
def parallelize_list(spark, root):
    return Context(spark).parallelize(["crawl", "host", "queue", "queue", "seed"]).df


@query("SELECT url || ' ' || response_code AS value FROM crawl WHERE url IS NOT NULL AND response_code IS NOT NULL")
def from_table_map(spark, root):
    return Context(spark).from_table(table(spark, root, "crawl"), lambda df: F.concat(df.url, F.lit(" "), df.response_code)).df


@query("SELECT crawl_id, url FROM crawl WHERE NOT contains(url, '..') AND length(url) <= 100 AND response_code = '200' AND contains(content_type, 'text/html') AND contains(lower(content_type), 'utf-8')")
def crawl_page_filter(spark, root):
    return table(spark, root, "crawl").where(url.crawl_page_filter(F.col("url"), F.col("response_code"), F.col("content_type"))).select("crawl_id", "url")


@query("SELECT text AS value FROM documents WHERE text IS NOT NULL")
def rdd_collect(spark, root):
    return _texts(spark, root).df


@query("SELECT count(text)::BIGINT AS n FROM documents")
def rdd_count(spark, root):
    return _texts(spark, root).df.agg(F.count("*").alias("n"))


@query("SELECT n_name AS value FROM nation")
def rdd_take(spark, root):
    """More elements asked for than there are: all of them come."""
    taken = Bag(table(spark, root, "nation").select(F.col("n_name").alias("value"))).take(30)
    return Context(spark).parallelize(taken).df


@query("SELECT DISTINCT text AS value FROM documents WHERE text IS NOT NULL")
def rdd_distinct(spark, root):
    return _texts(spark, root).distinct().df


@query("SELECT text AS value FROM documents WHERE length(text) > 500 AND contains(text, 'the')")
def rdd_filter(spark, root):
    return _texts(spark, root).filter(lambda v: (F.length(v) > 500) & v.contains("the")).df


@query("SELECT text AS value FROM documents WHERE ('0x' || substr(sha1(text), 1, 8))::BIGINT < 1073741824")
def sample_hash(spark, root):
    return _texts(spark, root).sample_by_hash(0.25).df


@query()
def sample_random(spark, root):
    return _texts(spark, root).sample(0.25, seed=7).df


@query("SELECT length(text)::VARCHAR AS value FROM documents WHERE text IS NOT NULL")
def map_partitions(spark, root):
    def lengths(values: Iterator[str]) -> Iterator[str]:
        for v in values:
            yield str(len(v))

    return _texts(spark, root).map_partitions(lengths).df


@query("SELECT n_regionkey::VARCHAR AS key, array_to_string(list_sort(list(n_name || '/' || n_regionkey)), ',') AS value FROM nation GROUP BY 1")
def group_by_csv(spark, root):
    nations = Bag(table(spark, root, "nation").select(F.concat("n_name", F.lit("/"), "n_regionkey").alias("value")))
    return nations.group_by(lambda v: F.substring_index(v, "/", -1)).df


@query("SELECT n_name AS value FROM nation JOIN customer ON n_nationkey = c_nationkey INTERSECT SELECT n_name FROM nation JOIN supplier ON n_nationkey = s_nationkey")
def rdd_intersection(spark, root):
    nation = table(spark, root, "nation")
    named = lambda name, key: Bag(table(spark, root, name).join(nation, F.col(key) == F.col("n_nationkey")).select(F.col("n_name").alias("value")))
    return named("customer", "c_nationkey").intersection(named("supplier", "s_nationkey")).df


@query(f"SELECT unnest({_s_tokens('text')}) AS value FROM documents")
def flat_map(spark, root):
    return _texts(spark, root).flat_map(text.tokenize).df


@query("SELECT sha1(text) AS key, length(text)::VARCHAR AS value FROM documents WHERE text IS NOT NULL")
def map_to_pair(spark, root):
    return _texts(spark, root).map_to_pair(hashing.hash_key, lambda v: F.length(v).cast("string")).df


@query(f"SELECT unnest({_s_tokens('text')}) AS key, sha1(text) AS value FROM documents")
def flat_map_to_pair(spark, root):
    return _texts(spark, root).flat_map_to_pair(lambda v: F.transform(text.tokenize(v), lambda t: F.struct(t.alias("key"), hashing.hash_key(v).alias("value")))).df


@query(f"WITH {_S_DOC_TOKENS} SELECT key || '@' || value AS value FROM toks")
def pair_flat_map(spark, root):
    return _tokens(spark, root).flat_map(lambda k, v: F.array(F.concat(k, F.lit("@"), v))).df


@query(f"WITH {_S_DOC_TOKENS} SELECT value AS key, key AS value FROM toks UNION ALL SELECT 'n', length(key)::VARCHAR FROM toks")
def pair_flat_map_to_pair(spark, root):
    return _tokens(spark, root).flat_map_to_pair(lambda k, v: F.array(F.struct(v.alias("key"), k.alias("value")), F.struct(F.lit("n").alias("key"), F.length(k).cast("string").alias("value")))).df


@query(f"WITH {_S_DOC_TOKENS} SELECT key, value FROM toks")
def pair_collect(spark, root):
    return _tokens(spark, root).df


@query("SELECT o_orderkey::VARCHAR AS key, o_orderpriority || ',' || l_returnflag AS value FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def pair_join(spark, root):
    a = table(spark, root, "orders").select(F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderpriority").alias("value"))
    b = table(spark, root, "lineitem").select(F.col("l_orderkey").cast("string").alias("key"), F.col("l_returnflag").alias("value"))
    return PairBag(a).join(PairBag(b)).df


@query("SELECT o_orderkey, o_orderpriority, l_linenumber, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def join_typed(spark, root):
    lines = table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return table(spark, root, "orders").select("o_orderkey", "o_orderpriority").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey")


@query("""
WITH c AS (SELECT c_nationkey::VARCHAR AS key, array_to_string(list_sort(list(c_name)), ',') AS x FROM customer GROUP BY 1),
s AS (SELECT s_nationkey::VARCHAR AS key, array_to_string(list_sort(list(s_name)), ',') AS y FROM supplier GROUP BY 1)
SELECT key, '[' || coalesce(x, '') || '],[' || coalesce(y, '') || ']' AS value FROM c FULL JOIN s USING (key)""")
def pair_cogroup(spark, root):
    bag = lambda name, key, value: PairBag(table(spark, root, name).select(F.col(key).cast("string").alias("key"), F.col(value).alias("value")))
    return bag("customer", "c_nationkey", "c_name").cogroup(bag("supplier", "s_nationkey", "s_name")).df


def _column(spark: SparkSession, root: str, name: str, column: str) -> Bag:
    return Bag(table(spark, root, name).select(F.col(column).cast("string").alias("value")))


def _pair_columns(spark: SparkSession, root: str, name: str, key: str, value: str) -> PairBag:
    return PairBag(table(spark, root, name).select(F.col(key).cast("string").alias("key"), F.col(value).cast("string").alias("value")))


@query("SELECT 7 + sum(l_linenumber)::BIGINT AS total FROM lineitem")
def fold_sum(spark, root):
    return _column(spark, root, "lineitem", "l_linenumber").folded("7", "integer_sum").select(F.col("value").cast("long").alias("total"))


@query("SELECT greatest(0.0::DOUBLE, max(l_extendedprice)) AS most FROM lineitem")
def fold_max(spark, root):
    return _column(spark, root, "lineitem", "l_extendedprice").folded("0", "max").select(F.col("value").alias("most"))


@query("SELECT coalesce(max(abs(value)), 0.0::DOUBLE) AS most FROM events")
def global_max(spark, root):
    state = table(spark, root, "events").select(F.col("value").alias("rank"), F.lit(0.0).alias("prev"))
    return spark.createDataFrame([(rank.max_change(state),)], "most double")


@query("SELECT l_returnflag AS key, sum(l_linenumber)::BIGINT AS value FROM lineitem GROUP BY 1")
def fold_by_key_sum(spark, root):
    return _pair_columns(spark, root, "lineitem", "l_returnflag", "l_linenumber").fold_by_key("integer_sum").withColumn("value", F.col("value").cast("long"))


@query("SELECT l_suppkey::VARCHAR AS key, round(sum(l_quantity), 4) AS value FROM lineitem GROUP BY 1")
def fold_by_key_sum_double(spark, root):
    pairs = table(spark, root, "lineitem").select(F.col("l_suppkey").cast("string").alias("key"), F.col("l_quantity").cast("string").alias("value"))
    return PairBag(pairs).fold_by_key("sum").withColumn("value", F.round("value", 4))


@query("SELECT event_type AS key, greatest(0.0::DOUBLE, max(value)) AS value FROM events GROUP BY 1")
def fold_by_key_max(spark, root):
    return _pair_columns(spark, root, "events", "event_type", "value").fold_by_key("max", zero="0")


@query("SELECT n_regionkey::VARCHAR AS key, '>' || array_to_string(list_sort(list(n_name)), '') AS value FROM nation GROUP BY 1")
def fold_by_key_ordered(spark, root):
    return _pair_columns(spark, root, "nation", "n_regionkey", "n_name").fold_by_key_ordered(">", lambda acc, v: F.concat(acc, v), lambda v: v)


@query("SELECT o_custkey::VARCHAR AS key, array_to_string(list_sort(list(o_orderstatus)), ', ') AS value FROM orders GROUP BY 1")
def fold_by_key_concat(spark, root):
    return PairBag(table(spark, root, "orders").select(F.col("o_custkey").cast("string").alias("key"), F.col("o_orderstatus").alias("value"))).fold_by_key("concat")


@query("SELECT o_custkey::VARCHAR AS key, array_to_string(list_sort(list_distinct(list(o_orderpriority))), ', ') AS value FROM orders GROUP BY 1")
def fold_by_key_distinct_concat(spark, root):
    return PairBag(table(spark, root, "orders").select(F.col("o_custkey").cast("string").alias("key"), F.col("o_orderpriority").alias("value"))).fold_by_key("distinct_concat")


@query("SELECT o_custkey::VARCHAR AS key, array_to_string(list_sort(list(o_orderkey::VARCHAR)), ',') AS vals FROM orders GROUP BY 1")
def pair_save_grouped(spark, root):
    bag = PairBag(table(spark, root, "orders").select(F.col("o_custkey").cast("string").alias("key"), F.col("o_orderkey").cast("string").alias("value")))
    return bag.grouped().select("key", F.array_join("values", ",").alias("vals"))


@query("SELECT text AS value FROM documents WHERE text IS NOT NULL")
def save_as_table(spark, root):
    path = work_dir(spark, "saved-bag")
    return _texts(spark, root).save_as_table("bag_" + path[-32:], path=path).df


# --- key-value store ------------------------------------------------------------------------------------------------


@query("SELECT url_hash, url, response_code FROM crawl")
def kv_scan(spark, root):
    return kv.scan(table(spark, root, "crawl").select("url_hash", "url", "response_code"), "url_hash")


@query("SELECT url_hash, url FROM crawl WHERE url_hash >= '4' AND url_hash < '9'")
def kv_range_scan(spark, root):
    return kv.scan(table(spark, root, "crawl"), "url_hash", "4", "9").select("url_hash", "url")


@query("SELECT host_hash, host_url, response_code FROM host WHERE host_hash = sha1('holmiston.example')")
def kv_get_row(spark, root):
    return kv.get_row(table(spark, root, "host"), "host_hash", _HOST_KEY).select("host_hash", "host_url", "response_code")


@query("SELECT robots_text FROM host WHERE host_hash = sha1('holmiston.example')")
def kv_get_cell(spark, root):
    return kv.get_cell(table(spark, root, "host"), "host_hash", _HOST_KEY, "robots_text")


@query("SELECT seed_id, url, url IN (SELECT url FROM crawl WHERE url IS NOT NULL) AS found FROM seed_url")
def kv_exists(spark, root):
    return kv.exists(table(spark, root, "seed_url"), table(spark, root, "crawl"), "url").select("seed_id", "url", "found")


def _base_and_delta(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Every third put of the log is a later delta to the others."""
    log = _log(spark, root)
    later = F.col("version") % 3 == 0
    return log.where(~later), log.where(later)


@query(f"WITH {_S_LOG} SELECT row_key, \"column\", round(arg_max(v, version), 4) AS value, max(version) AS version FROM log GROUP BY ALL")
def kv_upsert_latest(spark, root):
    base, delta = _base_and_delta(spark, root)
    return kv.upsert_latest(kv.upsert_latest(base), delta).withColumn("value", F.col("value").cast("double"))


@query(f"WITH {_S_LOG} SELECT row_key, \"column\", round(v, 4) AS value, version FROM log QUALIFY version = max(version) OVER (PARTITION BY row_key)")
def kv_put_row(spark, root):
    return kv.put_row(*_base_and_delta(spark, root)).select("row_key", "column", F.col("value").cast("double").alias("value"), "version")


@query(f"""WITH {_S_LOG}, cells AS (SELECT row_key, "column", round(arg_max(v, version), 4) = round(max(v), 4) AS ok FROM log GROUP BY ALL)
SELECT row_key, "column", version::BIGINT AS version, CASE WHEN NOT ok THEN 'kept' WHEN version = 1 THEN 'top' ELSE 'done' END AS value, CASE WHEN ok THEN 'OK' ELSE 'FAIL' END AS status FROM cells, (SELECT unnest([1, 2]) AS version)""")
def kv_conditional_put(spark, root):
    """Two puts on each cell: the second expects what the first leaves."""
    log = _log(spark, root)
    most = F.max(F.col("value").cast("double")).cast("string")
    first = log.groupBy("row_key", "column").agg(F.lit(1).alias("version"), most.alias("expected"), F.lit("top").alias("new"))
    second = first.select("row_key", "column", F.lit(2).alias("version"), F.lit("top").alias("expected"), F.lit("done").alias("new"))
    current = kv.upsert_latest(log).withColumn("value", F.col("value").cast("double").cast("string"))
    return kv.conditional_put(current, second.unionByName(first)).withColumn("value", F.when(F.col("status") == "OK", F.col("value")).otherwise("kept"))


@query("SELECT unnest(['kept', 'renamed']) AS table_name")
def kv_list_tables(spark, root):
    """Three tables, of which one is renamed and one deleted."""
    path = work_dir(spark, "tables")
    tag = "t" + path[-32:] + "_"
    nation = table(spark, root, "nation")
    for name in ("kept", "old", "gone"):
        nation.write.option("path", f"{path}/{name}").saveAsTable(tag + name)
    kv.rename(spark, tag + "old", tag + "renamed")
    kv.delete(spark, tag + "gone")
    return spark.createDataFrame([(t.removeprefix(tag),) for t in kv.list_tables(spark) if t.startswith(tag)], "table_name string")


@query(f"WITH {_S_LOG} SELECT row_key, version, row_number() OVER (PARTITION BY row_key ORDER BY version) AS row_version FROM log")
def kv_row_versions(spark, root):
    return kv.row_versions(_log(spark, root), "version").select("row_key", "version", F.col("row_version").cast("long").alias("row_version"))


@query("SELECT DISTINCT host_hash FROM host WHERE host_hash >= '8' ORDER BY host_hash LIMIT 10")
def kv_view_page(spark, root):
    return kv.view_page(table(spark, root, "host").select("host_hash").distinct(), "host_hash", "8")


@query("SELECT 'crawl' AS table_name, count(*)::BIGINT AS n_rows FROM crawl UNION ALL SELECT 'host', count(*) FROM host UNION ALL SELECT 'queue', count(*) FROM queue")
def kv_table_counts(spark, root):
    return kv.table_counts({name: table(spark, root, name) for name in ("crawl", "host", "queue")})


@query("SELECT url_hash, CASE WHEN url_hash >= 'd' THEN 3 WHEN url_hash >= '9' THEN 2 WHEN url_hash >= '5' THEN 1 WHEN url_hash >= '1' THEN 0 ELSE 3 END AS worker FROM crawl")
def key_range_partition(spark, root):
    return table(spark, root, "crawl").select("url_hash", kv.key_range(F.col("url_hash"), ["1", "5", "9", "d"]).alias("worker"))


# --- text -----------------------------------------------------------------------------------------------------------


def _of_pages(expression):
    return lambda spark, root: _pages(spark, root).select("url", expression(F.col("page")).alias("out"))


for _name, _function, _sql in (
    ("strip_script_style", text.strip_script_style, _s_strip("page")),
    ("title_text", text.title_text, f"coalesce(array_to_string(list_transform({_s_bodies(_s_strip('page'), 'title')}, lambda b: b || ' '), ''), '')"),
    ("visible_text", text.visible_text, _s_visible("page")),
    ("clean_text", text.clean_text, _s_clean("page")),
    ("tokenize", lambda p: F.array_join(text.tokenize(text.clean_text(p)), " "), f"coalesce(array_to_string({_s_tokens(_s_clean('page'))}, ' '), '')"),
    ("token_length_filter", lambda p: F.array_join(text.short_tokens(text.tokenize(p), 12), " "), f"coalesce(array_to_string(list_filter({_s_tokens('page')}, lambda t: length(t) <= 12), ' '), '')"),
    ("page_title", text.page_title, r"coalesce(regexp_replace(list_extract(regexp_extract_all(page, '(?s)<title>(.*?)</title>', 1), 1), '^\s+|\s+$', '', 'g'), 'No title')"),
    ("page_snippet", text.page_snippet, rf"coalesce(array_to_string(list_slice(flatten(list_transform({_s_bodies('page', 'p')}, lambda b: list_filter(regexp_split_to_array(regexp_replace(b, '(?s)<.*?>', '', 'g'), '\s+'), lambda t: t <> ''))), 1, 50), ' '), '')"),
    ("page_line_filter", text.page_line_filter, "coalesce(array_to_string(list_filter(string_split(page, chr(10)), lambda x: contains(x, '<title>') OR contains(x, '<p>')), chr(10)), '')"),
):
    QUERIES[_name] = _of_pages(_function)
    SQL[_name] = f"WITH {_S_PAGES} SELECT url, {_sql} AS out FROM pages"


@query()
def stem_tokens(spark, root):
    """Stems of the distinct words of the pages."""
    words = index.page_words(_pages(spark, root)).select("word").distinct()
    return stemmed(words.select("word", F.col("word").alias("stem")), "stem")


# --- addresses and links --------------------------------------------------------------------------------------------

_S_SHAPE = r"'^([^:/?#]+)://([^:/]*)(?::([0-9]*))?(.*)$'"
_S_PARTS = f"""parts AS (
  SELECT *, nullif(regexp_extract(url, {_S_SHAPE}, 1, 's'), '') AS protocol, nullif(regexp_extract(url, {_S_SHAPE}, 2, 's'), '') AS host, nullif(regexp_extract(url, {_S_SHAPE}, 3, 's'), '') AS port,
         CASE WHEN regexp_extract(url, {_S_SHAPE}, 1, 's') <> '' THEN coalesce(nullif(regexp_extract(url, {_S_SHAPE}, 4, 's'), ''), '/') ELSE url END AS path
  FROM given
)"""
_S_WITH_PORT = "CASE WHEN protocol IN ('http', 'https') AND host IS NOT NULL THEN protocol || '://' || host || ':' || coalesce(port, CASE protocol WHEN 'http' THEN '80' ELSE '443' END) || CASE WHEN starts_with(path, '/') THEN path ELSE '/' || path END END"


@query(f"WITH given AS (SELECT queue_id, url FROM queue), {_S_PARTS} SELECT queue_id, protocol, host, port, path FROM parts")
def parse_url_parts(spark, root):
    return table(spark, root, "queue").select("queue_id", url.parse_url_parts(F.col("url")).alias("p")).select("queue_id", "p.*")


@query(f"WITH given AS (SELECT queue_id, regexp_replace(url, '#.*$', '', 's') AS url FROM queue), {_S_PARTS} SELECT queue_id, {_S_WITH_PORT} AS seed FROM parts")
def normalize_seed_url(spark, root):
    return table(spark, root, "queue").select("queue_id", url.normalize_seed_url(F.col("url")).alias("seed"))


_S_RANK_LINKS = r"""list_filter(regexp_extract_all(page, '(?i)<a\s+(?:[^>]*?\s+)?href="([^"]*)"', 1), lambda x: NOT starts_with(x, '#') AND trim(x) <> '')"""
_S_CRAWL_LINKS = r"""list_filter(regexp_extract_all(page, '<a\s+[^>]*?href\s*=("[^">\s]*"|''[^''>\s]*'')[^>]*>', 1), lambda q: NOT contains(q, '{') AND NOT contains(q, '}'))"""


@query(f"WITH {_S_PAGES} SELECT url, unnest({_S_RANK_LINKS}) AS link FROM pages")
def extract_links_rank(spark, root):
    return _pages(spark, root).select("url", F.explode(url.extract_links_rank(F.col("page"))).alias("link"))


@query(f"WITH {_S_PAGES}, l AS (SELECT url, unnest({_S_CRAWL_LINKS}) AS q FROM pages) SELECT DISTINCT url, q[2:-2] AS link FROM l")
def extract_links_crawl(spark, root):
    return _pages(spark, root).select("url", F.explode(url.extract_links_crawl(F.col("page"))).alias("link"))


@query(f"WITH {_S_PAGES}, l AS (SELECT url, len({_S_RANK_LINKS}) AS n FROM pages) SELECT url, (CASE WHEN n > 11 THEN 10 ELSE n END)::INT AS n_links FROM l")
def link_cap(spark, root):
    return _pages(spark, root).select("url", F.size(url.link_cap(url.extract_links_rank(F.col("page")))).alias("n_links"))


# The pages' links are absolute or start at the root, so SQL needs no climbing here; the rest is tested by examples.
_S_LINKED = r"""base AS (SELECT src, link, regexp_extract(src, '^([a-z]+://[^/]*)', 1) AS site,
  regexp_extract(link, '^(?:[Hh][Tt][Tt][Pp][Ss]?)://') <> '' AS absolute FROM linked WHERE src IS NOT NULL)"""


def _s_absolute(x: str) -> str:
    return rf"regexp_extract({x}, '^([a-z]+)://', 1) || '://' || regexp_extract({x}, '^[a-z]+://([^:/]*)', 1) || ':' || coalesce(nullif(regexp_extract({x}, '^[a-z]+://[^:/]*:([0-9]+)', 1), ''), CASE WHEN starts_with({x}, 'https') THEN '443' ELSE '80' END) || coalesce(nullif(regexp_extract({x}, '^[a-z]+://[^/]*(/.*)$', 1, 's'), ''), '/')"


def _s_links(links: str) -> str:
    return f"""{_S_PAGES}, given AS (SELECT url, page FROM pages), {_S_PARTS}, linked AS (SELECT {_S_WITH_PORT} AS src, unnest({links}) AS link FROM parts), {_S_LINKED}"""


@query(f"WITH {_s_links(_S_RANK_LINKS)} SELECT src, link, CASE WHEN absolute THEN {_s_absolute('link')} ELSE site || regexp_replace(link, '#.*$', '', 's') END AS target FROM base")
def normalize_link_crawl(spark, root):
    links = _pages(spark, root).select(url.with_port(F.col("url")).alias("src"), F.explode(url.extract_links_rank(F.col("page"))).alias("link")).where("src IS NOT NULL")
    return links.withColumn("target", url.normalize_link_crawl(F.col("src"), F.col("link")))


# What the ranking makes of a link, step by step: the parts of what stands before ? and #, and the path with dots resolved
# by taking out one pair of a folder and .. after the other. Paths of more than eight levels don't occur in the tables.
def _s_undotted(x: str) -> str:
    x = f"replace({x}, '/./', '/')"
    for _ in range(8):
        x = rf"regexp_replace({x}, '/[^/]+/\.\.(/|$)', '/')"
    return x


_S_RANK_STEPS = rf"""bared AS (SELECT src, link, regexp_replace(link, '[?#].*$', '', 's') AS bare, regexp_matches(link, '^[Hh][Tt][Tt][Pp][Ss]?://') AS absolute, regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') AS schemed FROM linked WHERE src IS NOT NULL),
split AS (SELECT src, link, schemed AND NOT absolute OR bare = '' AS dropped,
  CASE WHEN absolute THEN lower(split_part(bare, '://', 1)) ELSE split_part(src, '://', 1) END AS scheme,
  CASE WHEN absolute THEN split_part(split_part(bare, '://', 2), '/', 1) ELSE split_part(split_part(src, '://', 2), '/', 1) END AS server,
  CASE WHEN absolute THEN coalesce(nullif(regexp_replace(bare, '^[A-Za-z]+://[^/]*', ''), ''), '/') WHEN starts_with(bare, '/') THEN bare
       ELSE regexp_extract(regexp_replace(regexp_replace(src, '^[a-z]+://[^/]*', ''), '[?#].*$', '', 's'), '^(.*/)', 1, 's') || bare END AS path FROM bared),
ranked_links AS (SELECT src, link, CASE WHEN NOT dropped AND split_part(server, ':', 1) <> '' AND NOT regexp_matches(resolved, '\.(jpg|jpeg|gif|png|txt)$') AND NOT starts_with(resolved, '/../') AND resolved <> '/..' THEN
  scheme || '://' || split_part(server, ':', 1) || ':' || coalesce(nullif(split_part(server, ':', 2), ''), CASE scheme WHEN 'https' THEN '443' ELSE '80' END) || resolved END AS target
  FROM (SELECT *, {_s_undotted('path')} AS resolved FROM split))"""
_S_QUEUE_LINKED = "linked AS (SELECT 'http://holmiston.example:80/a/b/c.html' AS src, trim(url, ' ' || chr(9)) AS link FROM queue WHERE url IS NOT NULL)"


def _queue_links(spark: SparkSession, root: str) -> DataFrame:
    """The queue's addresses as links on one page: relative ones, dots, queries and fragments are among them."""
    return table(spark, root, "queue").where("url IS NOT NULL").select(F.lit("http://holmiston.example:80/a/b/c.html").alias("src"), F.btrim("url", F.lit(" \t")).alias("link"))


@query(f"WITH {_S_PAGES}, given AS (SELECT url, page FROM pages), {_S_PARTS}, linked AS (SELECT {_S_WITH_PORT} AS src, unnest({_S_RANK_LINKS}) AS link FROM parts), {_S_RANK_STEPS} SELECT * FROM ranked_links")
def normalize_link_rank(spark, root):
    links = _pages(spark, root).select(url.with_port(F.col("url")).alias("src"), F.explode(url.extract_links_rank(F.col("page"))).alias("link")).where("src IS NOT NULL")
    return links.withColumn("target", url.normalize_link_rank(F.col("src"), F.col("link")))


@query(f"WITH {_S_QUEUE_LINKED}, {_S_RANK_STEPS} SELECT * FROM ranked_links")
def normalize_queue_rank(spark, root):
    return _queue_links(spark, root).withColumn("target", url.normalize_link_rank(F.col("src"), F.col("link")))


@query(f"WITH {_S_PAGES}, given AS (SELECT url, page FROM pages), {_S_PARTS}, linked AS (SELECT {_S_WITH_PORT} AS src, unnest({_S_RANK_LINKS}) AS link FROM parts), {_S_RANK_STEPS} SELECT src, target AS dst, count(*)::BIGINT AS n FROM ranked_links WHERE target IS NOT NULL GROUP BY ALL")
def link_graph(spark, root):
    return rank.link_graph(_pages(spark, root)).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query("SELECT crawl_id, sha1(url) AS key FROM crawl")
def hash_key(spark, root):
    return table(spark, root, "crawl").select("crawl_id", hashing.hash_key(F.col("url")).alias("key"))


@query("""
WITH b AS (SELECT crawl_id, list_transform(range(20), lambda i: ('0x' || substr(sha1(url), 2 * i + 1, 2))::INT) AS bytes FROM crawl),
x AS (SELECT crawl_id, list_transform(bytes, lambda b: CASE WHEN b = 0 THEN 255 WHEN b > 127 THEN b - 1 ELSE b END) AS ix FROM b)
SELECT crawl_id, array_to_string(list_transform(ix, lambda i: chr((97 + i % 26)::INT) || substr('acegikmoqs', (i // 26 + 1)::INT, 1)), '') AS key FROM x""")
def hash_key_compat(spark, root):
    return table(spark, root, "crawl").select("crawl_id", F.when(F.col("url").isNotNull(), hashing.hash_key_compat(F.col("url"))).alias("key"))


# --- crawl ----------------------------------------------------------------------------------------------------------


@query("SELECT DISTINCT url FROM queue WHERE url IS NOT NULL AND url NOT IN (SELECT url FROM crawl WHERE url IS NOT NULL)")
def frontier_anti_join(spark, root):
    return crawling.unseen(table(spark, root, "queue"), table(spark, root, "crawl"))


@query("SELECT queue_id, url FROM queue ORDER BY queue_id LIMIT 20000")
def frontier_cap(spark, root):
    return crawling.capped(table(spark, root, "queue").select("queue_id", "url"), "queue_id")


@query("SELECT crawl_id, coalesce(contains(content_type, 'text/html') AND response_code = '200' AND coalesce(try_cast(trim(length) AS BIGINT), 0) < 5000000, false) AS fetched FROM crawl")
def crawl_fetch_gate(spark, root):
    return table(spark, root, "crawl").select("crawl_id", crawling.fetch_gate(F.col("content_type"), F.col("response_code"), F.col("length")).alias("fetched"))


@query("SELECT crawl_id, coalesce(response_code IN ('301', '302', '303', '307', '308'), false) AS moved FROM crawl")
def crawl_redirect(spark, root):
    return table(spark, root, "crawl").select("crawl_id", crawling.redirected(F.col("response_code")).alias("moved"))


_S_HOST = r"nullif(lower(regexp_extract(url, '^[ \t\r\n]*[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@\\]*@)?(\[[^\]/?#]*\]|[^:/?#\\ \t\r\n]*)', 1)), '')"


@query(f"SELECT queue_id, host, row_number() OVER (PARTITION BY host ORDER BY queue_id) = 1 AS due FROM (SELECT queue_id, {_S_HOST} AS host FROM queue) WHERE host IS NOT NULL")
def crawl_delay_gate(spark, root):
    frontier = table(spark, root, "queue").select("queue_id", host_of(F.col("url")).alias("host")).where("host IS NOT NULL")
    return crawling.delay_gate(frontier, "queue_id")


_S_RULES = r"""hosts AS (SELECT row_number() OVER () AS rid, * FROM host),
robot_lines AS (SELECT rid, generate_subscripts(string_split(lower(robots_text), chr(10)), 1) AS n, unnest(string_split(lower(robots_text), chr(10))) AS line FROM hosts WHERE robots_text IS NOT NULL),
robot_kv AS (SELECT rid, n, trim(split_part(line, ':', 1), ' ' || chr(9) || chr(13)) AS name, trim(split_part(substr(line, strpos(line, ':') + 1), '#', 1), ' ' || chr(9) || chr(13)) AS val FROM robot_lines WHERE contains(line, ':')),
robot_blocks AS (SELECT *, count(*) FILTER (name = 'user-agent') OVER (PARTITION BY rid ORDER BY n) AS block FROM robot_kv),
robot_heads AS (SELECT rid, val AS agent, min(block) AS block FROM robot_blocks WHERE name = 'user-agent' GROUP BY ALL),
robot_chosen AS (SELECT rid, coalesce(max(block) FILTER (agent = 'search-crawler'), max(block) FILTER (agent = '*')) AS block FROM robot_heads GROUP BY rid),
robot_rules AS (SELECT b.rid, n, name, val, min(n) FILTER (val = '' AND name = 'allow') OVER (PARTITION BY b.rid) AS no_allow, min(n) FILTER (val = '' AND name = 'disallow') OVER (PARTITION BY b.rid) AS no_disallow FROM robot_blocks b JOIN robot_chosen c ON b.rid = c.rid AND b.block = c.block WHERE name <> 'user-agent'),
robots AS (SELECT h.rid, h.host_hash, h.host_url, h.response_code, h.time_stamp, h.robots_text,
  coalesce(list(val ORDER BY n) FILTER (name = 'allow' AND (no_allow IS NULL OR n < no_allow)), []) AS allow,
  coalesce(list(val ORDER BY n) FILTER (name = 'disallow' AND no_allow IS NULL AND (no_disallow IS NULL OR n < no_disallow)), []) AS disallow,
  coalesce(arg_max(try_cast(val AS DOUBLE) * 1000, n) FILTER (name = 'crawl-delay' AND regexp_full_match(val, '[0-9]+\.?[0-9]*|\.[0-9]+')), 1000.0::DOUBLE) AS delay
  FROM hosts h LEFT JOIN robot_rules r ON h.rid = r.rid GROUP BY ALL)"""
_S_ALLOWED = rf"""{_S_RULES}, newest AS (SELECT * FROM (SELECT *, regexp_replace(lower(host_url), '\.$', '') AS h, row_number() OVER (PARTITION BY regexp_replace(lower(host_url), '\.$', '') ORDER BY time_stamp DESC NULLS LAST, response_code DESC NULLS LAST, robots_text DESC NULLS LAST) AS rn FROM robots WHERE host_url IS NOT NULL) WHERE rn = 1),
checked AS (SELECT f.url, {_S_HOST} AS host, CASE WHEN contains(f.url, '://') AND regexp_matches(f.url, '^[^:/?#]+://') THEN coalesce(nullif(regexp_extract(f.url, {_S_SHAPE}, 4, 's'), ''), '/') ELSE f.url END AS path FROM frontier f),
allowed AS (SELECT c.url, c.host FROM checked c JOIN newest r ON c.host = r.h WHERE r.response_code = '200' AND len(list_filter(r.disallow, lambda p: starts_with(lower(c.path), p))) = 0)"""


@query(f"WITH {_S_RULES} SELECT host_hash, coalesce(array_to_string(allow, ','), '') AS allow, coalesce(array_to_string(disallow, ','), '') AS disallow, delay AS crawl_delay_ms FROM robots")
def robots_parse(spark, root):
    parsed = table(spark, root, "host").select("host_hash", robots.robots_parse(F.col("robots_text")).alias("r"))
    return parsed.select("host_hash", F.array_join("r.allow", ",").alias("allow"), F.array_join("r.disallow", ",").alias("disallow"), F.col("r.crawl_delay_ms").alias("crawl_delay_ms"))


@query(f"WITH frontier AS (SELECT url FROM queue), {_S_ALLOWED} SELECT url, host FROM allowed")
def robots_check(spark, root):
    return crawling.allowed(table(spark, root, "queue").select("queue_id", "url"), table(spark, root, "host"))


@query(f"WITH frontier AS (SELECT DISTINCT url FROM queue WHERE url IS NOT NULL AND url NOT IN (SELECT url FROM crawl WHERE url IS NOT NULL)), {_S_ALLOWED} SELECT host, min(url) AS url FROM allowed GROUP BY host")
def crawl_frontier_round(spark, root):
    """One round over the queue: unseen, allowed by robots, the first of each host."""
    crawl, queue = table(spark, root, "crawl"), table(spark, root, "queue")
    due = crawling.delay_gate(crawling.allowed(crawling.unseen(queue, crawl), table(spark, root, "host")), "url")
    return due.where("due").select("host", "url")


@query()
def crawl_loop(spark, root):
    """Three rounds from the seeds and the queue's addresses over the stored crawl as an offline web."""
    crawl = table(spark, root, "crawl")
    seeds = table(spark, root, "seed_url").select("url").unionByName(table(spark, root, "queue").select("url"))
    head, get = crawling.offline(crawl)
    return crawling.crawl_loop(seeds, table(spark, root, "host"), head, get, 3).select("url", "response_code", "content_type", F.length("page").alias("page_chars"))


# --- index, ranks and search ----------------------------------------------------------------------------------------


@query(f"WITH {_S_WORDS} SELECT word, array_to_string(list_sort(list(DISTINCT url)), ',') AS urls FROM words GROUP BY word")
def inverted_index(spark, root):
    return index.inverted_index(index.page_words(_pages(spark, root))).select("word", F.array_join("urls", ",").alias("urls"))


@query(f"""WITH {_S_WORDS}, d AS (SELECT DISTINCT word, url FROM words), s AS (SELECT word, url, (count(*) OVER (PARTITION BY word) + 63) // 64 AS blocks FROM d)
SELECT word, (('0x' || substr(md5(url), 1, 8))::BIGINT % blocks)::BIGINT AS block, array_to_string(list_sort(list(url)), ',') AS urls FROM s GROUP BY ALL""")
def index_blocks(spark, root):
    """The index with a word's addresses in blocks of about 64."""
    blocks = index.index_blocks(index.page_words(_pages(spark, root)), 64)
    return blocks.select("word", "block", F.array_join("urls", ",").alias("urls"))


@query(f"WITH {_S_WORDS} SELECT word, count(DISTINCT url)::BIGINT AS n_urls FROM words GROUP BY word ORDER BY n_urls DESC, word LIMIT 15")
def top_words(spark, root):
    return index.postings(index.page_words(_pages(spark, root))).orderBy(F.desc("n_urls"), "word").limit(15)


@query(f"WITH {_S_TF} SELECT url, word, n::BIGINT AS n, max_n::BIGINT AS max_n FROM tf")
def term_counts(spark, root):
    return index.term_counts(index.page_words(_pages(spark, root)))


@query(f"WITH {_S_TF} SELECT url, word, round(tf, 6) AS tf FROM tf")
def tf_augmented(spark, root):
    return index.term_frequency(index.term_counts(index.page_words(_pages(spark, root)))).withColumn("tf", F.round("tf", 6))


@query(f"WITH {_S_TFIDF} SELECT word, df::BIGINT AS df FROM dfs")
def doc_freq(spark, root):
    return index.doc_freq(index.page_words(_pages(spark, root)).distinct())


@query(f"WITH {_S_TFIDF} SELECT word, df::BIGINT AS df, round(idf, 6) AS idf FROM idfs")
def idf(spark, root):
    pages = _pages(spark, root)
    return index.idf(index.doc_freq(index.page_words(pages).distinct()), pages.count()).withColumn("idf", F.round("idf", 6))


@query(f"WITH {_S_TFIDF} SELECT word, url, round(tf, 6) AS tf, round(idf, 6) AS idf, round(tfidf, 6) AS tfidf FROM scored")
def tfidf(spark, root):
    return index.tfidf(_pages(spark, root)).select("word", "url", *(F.round(c, 6).alias(c) for c in ("tf", "idf", "tfidf")))


@query(f"WITH {_S_TFIDF} SELECT word, count(*)::BIGINT AS n_postings, min(url) AS first_url, round(max(tfidf), 6) AS best FROM scored GROUP BY word")
def tfidf_index(spark, root):
    postings = index.tfidf_index(index.tfidf(_pages(spark, root)))
    return postings.select("word", F.size("postings").cast("long").alias("n_postings"), F.get("postings", F.lit(0))["url"].alias("first_url"), F.round(F.array_max(F.transform("postings", lambda p: p["tfidf"])), 6).alias("best"))


_S_GRAPH = """e0 AS (SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem), edges AS (SELECT src, dst FROM e0 UNION ALL SELECT dst, src FROM e0),
deg AS (SELECT src, count(*) AS d FROM edges GROUP BY src), nodes AS (SELECT DISTINCT src AS url FROM edges), r0 AS (SELECT url, 1.0::DOUBLE AS rank FROM nodes)"""


def _s_rounds(k: int) -> str:
    out = _S_GRAPH
    for i in range(1, k + 1):
        out += f", f{i} AS (SELECT dst, sum(0.85::DOUBLE * rank / d) AS inflow FROM edges JOIN deg USING (src) JOIN r{i - 1} ON r{i - 1}.url = edges.src GROUP BY dst), r{i} AS (SELECT url, 0.15::DOUBLE + coalesce(inflow, 0) AS rank FROM nodes LEFT JOIN f{i} ON url = dst)"
    return out


def _ranked(spark: SparkSession, root: str, rounds: int, threshold: float | None = None) -> DataFrame:
    edges = _edges(spark, root)
    return rank.pagerank(edges.select(F.col("src").alias("url")).distinct(), edges, rounds, threshold)


@query(f"WITH {_s_rounds(1)} SELECT url, round(rank, 6) AS rank FROM r1")
def pagerank_step(spark, root):
    return _ranked(spark, root, 1).select("url", F.round("rank", 6).alias("rank"))


@query(f"WITH {_s_rounds(3)} SELECT url, round(rank, 6) AS rank FROM r3")
def pagerank_k(spark, root):
    return _ranked(spark, root, 3).select("url", F.round("rank", 6).alias("rank"))


@query(f"WITH {_s_rounds(2)} SELECT url, round(abs(r2.rank - r1.rank), 6) AS delta FROM r2 JOIN r1 USING (url)")
def rank_delta(spark, root):
    return _ranked(spark, root, 2).select("url", F.round(F.abs(F.col("rank") - F.col("prev")), 6).alias("delta"))


@query()
def pagerank_converged(spark, root):
    return _ranked(spark, root, 100, 1e-4).select("url", F.round("rank", 6).alias("rank"))


SEARCH = "council lantern council glacier"
_S_SEARCH = f"""{_S_TFIDF}, ranks AS (SELECT url, 0.15::DOUBLE + 0.85::DOUBLE * count(*) AS rank FROM queue WHERE url IS NOT NULL GROUP BY url),
q AS (SELECT * FROM (VALUES ('council', 2), ('lantern', 1), ('glacier', 1)) AS v(word, times)),
hits AS (SELECT word, url, tfidf, times, count(*) OVER (PARTITION BY word) AS n_postings, coalesce(rank, 0) AS rank FROM scored JOIN q USING (word) LEFT JOIN ranks USING (url)),
used AS (SELECT *, times * (0.3::DOUBLE * CASE WHEN rank = 0 THEN 0.15::DOUBLE ELSE rank END + 0.5::DOUBLE) AS base FROM hits WHERE rank <> 0 OR n_postings < 10)"""
_S_RANKED = f"""{_S_SEARCH}, extra AS (SELECT sum(t) AS x FROM (SELECT max(times) * 0.2::DOUBLE * arg_min(tfidf, url) AS t FROM hits GROUP BY word)),
result AS (SELECT url, sum(base) + (SELECT coalesce(x, 0) FROM extra) AS score FROM used GROUP BY url)"""


def _searched(spark: SparkSession, root: str, per_url: bool) -> DataFrame:
    ranks = table(spark, root, "queue").where("url IS NOT NULL").groupBy("url").agg((0.15 + 0.85 * F.count("*")).alias("rank"))
    return search.ranked(SEARCH, index.tfidf(_pages(spark, root)), ranks, per_url)


@query(f"WITH {_S_RANKED} SELECT url, round(score, 6) AS score FROM result")
def search_ranked(spark, root):
    return _searched(spark, root, False).withColumn("score", F.round("score", 6))


@query(f"WITH {_S_SEARCH} SELECT url, round(sum(base + times * 0.2::DOUBLE * tfidf), 6) AS score FROM used GROUP BY url")
def search_ranked_per_url(spark, root):
    return _searched(spark, root, True).withColumn("score", F.round("score", 6))


_S_TITLE = r"coalesce(regexp_replace(list_extract(regexp_extract_all(page, '(?s)<title>(.*?)</title>', 1), 1), '^\s+|\s+$', '', 'g'), 'No title')"
_S_SNIPPET = rf"coalesce(array_to_string(list_slice(flatten(list_transform({_s_bodies('page', 'p')}, lambda b: list_filter(regexp_split_to_array(regexp_replace(b, '(?s)<.*?>', '', 'g'), '\s+'), lambda t: t <> ''))), 1, 50), ' '), '')"


@query(f"WITH {_S_RANKED} SELECT url, round(score, 6) AS score, {_S_TITLE} AS title, {_S_SNIPPET} AS snippet FROM result JOIN pages USING (url) WHERE starts_with(url, 'https') ORDER BY round(score, 6) DESC, url LIMIT 15 OFFSET 3")
def search_results(spark, root):
    """A page of results with titles and snippets, where only the https pages are stored."""
    scores = _searched(spark, root, False).withColumn("score", F.round("score", 6))
    return search.results(scores, _pages(spark, root).where(F.col("url").startswith("https")), 3)


@query(f"WITH {_S_RANKED} SELECT url, round(score, 6) AS score FROM result ORDER BY round(score, 6) DESC, url LIMIT 15 OFFSET 5")
def search_page(spark, root):
    return search.page_of(_searched(spark, root, False).withColumn("score", F.round("score", 6)), 5)
