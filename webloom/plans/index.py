"""Inverted index and TF-IDF."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions import text
from webloom.functions.stem import stemmed
from webloom.functions.url import crawl_page_filter
from webloom.session import frozen

#: TF of the rarest and of the most frequent word of a page.
TF_BASE, TF_SPAN = 0.4, 0.6


def crawl_pages(crawl: DataFrame) -> DataFrame:
    """(url, page): of each address that the jobs read, the page of its latest fetch (the highest crawl_id of equal times)."""
    rows = crawl.where(crawl_page_filter(F.col("url"), F.col("response_code"), F.col("content_type")))
    return rows.groupBy("url").agg(F.max(F.struct("fetched_at", "crawl_id", "page")).alias("m")).select("url", F.coalesce("m.page", F.lit("")).alias("page"))


def page_words(pages: DataFrame, stem: bool = False) -> DataFrame:
    """(url, word), one row per occurrence."""
    words = pages.select("url", F.explode(text.page_tokens(F.col("page"))).alias("word"))
    return stemmed(words) if stem else words


def inverted_index(words: DataFrame) -> DataFrame:
    """(word, urls): the addresses of each word, each once, in order."""
    return words.groupBy("word").agg(F.array_sort(F.collect_set("url")).alias("urls"))


def index_blocks(words: DataFrame, most: int = 100_000) -> DataFrame:
    """(word, block, urls): the same with the addresses of a word in blocks of about ``most``, by their hash, so that no row grows with the corpus."""
    each = frozen(words.distinct(), "words")
    often = each.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") > most).select(F.col("word").alias("w"), F.ceil(F.col("n") / most).alias("blocks"))
    number = F.conv(F.substring(F.md5("url"), 1, 8), 16, 10).cast("long")
    placed = each.join(often, F.col("word") == F.col("w"), "left").select("word", "url", (number % F.coalesce("blocks", F.lit(1))).alias("block"))
    return placed.groupBy("word", "block").agg(F.array_sort(F.collect_list("url")).alias("urls"))


def postings(words: DataFrame) -> DataFrame:
    """(word, n_urls) without the lists, whose length has no bound."""
    return words.distinct().groupBy("word").agg(F.count("*").alias("n_urls"))


def term_counts(words: DataFrame) -> DataFrame:
    """(url, word, n, max_n): occurrences of a word on a page, and of the page's most frequent word."""
    counts = words.groupBy("url", "word").agg(F.count("*").alias("n"))
    return counts.withColumn("max_n", F.max("n").over(Window.partitionBy("url")))


def term_frequency(counts: DataFrame) -> DataFrame:
    """(url, word, tf) with tf = 0.4 + 0.6 n / max_n."""
    return counts.select("url", "word", (F.lit(TF_BASE) + F.lit(TF_SPAN) * F.col("n") / F.col("max_n")).alias("tf"))


def doc_freq(tf: DataFrame) -> DataFrame:
    return tf.groupBy("word").agg(F.count("*").alias("df"))


def idf(df: DataFrame, n_pages: int) -> DataFrame:
    """(word, df, idf) with idf = ln(pages / df)."""
    return df.withColumn("idf", F.log(F.lit(float(n_pages)) / F.col("df")))


def tfidf(pages: DataFrame, stem: bool = False) -> DataFrame:
    """(word, url, tf, idf, tfidf) of pages (url, page); pages without words count among all pages."""
    tf = frozen(term_frequency(term_counts(page_words(pages, stem))), "tf")  # read twice, for the frequencies too
    weights = idf(doc_freq(tf), pages.count())
    return tf.join(weights, "word").select("word", "url", "tf", "idf", (F.col("tf") * F.col("idf")).alias("tfidf"))


def tfidf_index(scored: DataFrame) -> DataFrame:
    """(word, postings) with postings (url, tfidf) in order of url."""
    return scored.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("url", "tfidf"))).alias("postings"))
