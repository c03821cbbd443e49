"""Ranked search over an index, ranks and pages."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions.stem import stem
from webloom.functions.text import page_snippet, page_title, render_result
from webloom.session import frozen

RANK_WEIGHT, MATCH_WEIGHT, TFIDF_WEIGHT = 0.3, 0.5, 0.2
#: Rank of an unranked page, and how many postings a word may have for it to be used.
UNRANKED, FEW_POSTINGS = 0.15, 10
PAGE_SIZE = 15
NO_MATCH = "No page matches the query."


class EmptyQuery(ValueError):
    """The query has no word."""


def query_words(query: str | None, stemming: bool = False) -> Counter:
    """Words of a query with how often each stands in it."""
    words = re.split(r"\s+", (query or "").lower().strip())
    if words == [""]:
        raise EmptyQuery("a query needs a word")
    return Counter(stem(w) if stemming else w for w in words)


def ranked(query: str, scored: DataFrame, ranks: DataFrame, per_url: bool = False, stemming: bool = False) -> DataFrame:
    """(url, score) of every page with a word of the query.

    scored: (word, url, tfidf); ranks: (url, rank). A word counts as often as it stands in the query. Each hit gives
    0.3 rank + 0.5; a page without rank is left out of words with ten or more postings, else has 0.15. The TF-IDF of a
    word's first posting, times 0.2, goes to every candidate; with ``per_url`` each hit has its own instead.
    Over a stored index the query's few words are a literal filter that reaches the scan; over one that is computed
    here it can't. Hits are written once, as they are read twice.
    """
    times = query_words(query, stemming)
    hits = frozen(scored.where(F.col("word").isin(*times)).select("word", "url", "tfidf"), "hits")
    count = F.create_map(*[F.lit(x) for kv in times.items() for x in kv])[F.col("word")]
    per_word = hits.groupBy("word").agg(F.count("*").alias("n_postings"), F.min(F.struct("url", "tfidf")).alias("first"))
    joined = hits.join(F.broadcast(per_word), "word").join(ranks, "url", "left")  # one row per word of the query
    rank = F.coalesce("rank", F.lit(0.0))
    used = (rank != 0) | (F.col("n_postings") < FEW_POSTINGS)
    value = RANK_WEIGHT * F.when(rank == 0, UNRANKED).otherwise(rank) + MATCH_WEIGHT
    if per_url:
        value = value + TFIDF_WEIGHT * F.col("tfidf")
    scores = joined.where(used).groupBy("url").agg(F.sum(count * value).alias("score"))
    if per_url:
        return scores
    extra = per_word.agg(F.sum(count * TFIDF_WEIGHT * F.col("first.tfidf"))).first()[0] or 0.0
    return scores.withColumn("score", F.col("score") + F.lit(extra))


def page_of(results: DataFrame, offset: int = 0, limit: int = PAGE_SIZE) -> DataFrame:
    """A page of results: by score from the top, equal ones by url; nothing beyond the end."""
    return results.orderBy(F.desc("score"), "url").offset(offset).limit(limit)


def results(scores: DataFrame, pages: DataFrame, offset: int = 0, limit: int = PAGE_SIZE) -> DataFrame:
    """A page of results, (url, score, title, snippet), of those whose page is stored in ``pages`` (url, page); others take no place in it."""
    stored = scores.join(pages.select("url"), "url", "left_semi")
    return with_snippets(page_of(stored, offset, limit), pages)


def answer(found: DataFrame) -> str:
    """A page of results as HTML, from the top; a sentence where nothing matches."""
    shown = found.orderBy(F.desc("score"), "url").select(render_result(F.col("url"), F.col("title"), F.col("snippet")).alias("html")).collect()
    return "".join(r["html"] for r in shown) or NO_MATCH


def with_snippets(results: DataFrame, pages: DataFrame) -> DataFrame:
    """(url, score, title, snippet) of results whose page is stored."""
    return results.join(pages, "url").select("url", "score", page_title(F.col("page")).alias("title"), page_snippet(F.col("page")).alias("snippet"))
