"""PageRank over an edge list (src, dst), repeats included."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions.url import extract_links_rank, normalize_link_rank, with_port
from webloom.session import bucketed, frozen, shuffle_partitions

DAMPING, BASE = 0.85, 0.15
#: The fewest links of a hub; and hubs have more than a part in so many times the partitions of all links, hence are at most so many.
HUB_LINKS, HUB_PART = 100_000, 4


def link_graph(pages: DataFrame) -> DataFrame:
    """(src, dst) of the links on pages (url, page), with repeats; links that come to nothing are dropped."""
    base = with_port(F.col("url"))
    links = pages.select(base.alias("src"), F.explode(extract_links_rank(F.col("page"))).alias("link")).where("src IS NOT NULL")
    return links.select("src", normalize_link_rank(F.col("src"), F.col("link")).alias("dst")).where("dst IS NOT NULL")


def initial(nodes: DataFrame) -> DataFrame:
    """(url, rank, prev) with both at 1."""
    return nodes.select("url", F.lit(1.0).alias("rank"), F.lit(1.0).alias("prev"))


def degrees(edges: DataFrame) -> DataFrame:
    """(s, d): the links of each source, repeats included."""
    return edges.groupBy(F.col("src").alias("s")).agg(F.count("*").alias("d"))


def out_degrees(edges: DataFrame, degree: DataFrame) -> DataFrame:
    """(src, dst, w): links from src to dst over all links of src; parallel links are one row. Sources without a degree are left out."""
    per_link = edges.groupBy("src", "dst").agg(F.count("*").alias("k"))
    return per_link.join(degree, F.col("src") == F.col("s")).select("src", "dst", (F.col("k") / F.col("d")).alias("w"))


def step(state: DataFrame, weights: DataFrame, of_hubs: DataFrame | None = None) -> DataFrame:
    """One round: rank = 0.15 + 0.85 times what flows in; prev is the rank before. Pages without links keep theirs to themselves, targets outside the pages get nothing.

    of_hubs: weights of sources with very many links, few sources; their ranks are sent to the weights.
    """
    ranks, flowing = state.select(F.col("url").alias("src"), "rank"), ["dst", (DAMPING * F.col("rank") * F.col("w")).alias("c")]
    sent = weights.join(ranks, "src").select(*flowing)
    if of_hubs is not None:
        hubs = ranks.join(F.broadcast(of_hubs.select("src").distinct()), "src", "left_semi")
        sent = sent.unionByName(of_hubs.join(F.broadcast(hubs), "src").select(*flowing))
    flow = sent.groupBy("dst").agg(F.sum("c").alias("inflow"))
    joined = state.join(flow, F.col("url") == F.col("dst"), "left")
    return joined.select("url", (F.lit(BASE) + F.coalesce("inflow", F.lit(0.0))).alias("rank"), F.col("rank").alias("prev"))


class NotConverged(RuntimeError):
    """Ranks still change by more than the threshold."""


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 100, threshold: float | None = None) -> DataFrame:
    """(url, rank, prev) after ``rounds``, or as soon as no rank changes by more than ``threshold``; with one, raises if that doesn't happen.

    Weights lie in buckets of their source and ranks in buckets of their page, so a round shuffles what flows and nothing
    else. Hubs would make one bucket large, so their links lie apart and their ranks, a few per partition, are broadcast.
    """
    n = shuffle_partitions(edges.sparkSession)
    degree = frozen(degrees(edges), "degrees")
    links = degree.agg(F.coalesce(F.sum("d"), F.lit(0))).first()[0]
    least = max(HUB_LINKS, links // (HUB_PART * n))
    hubs = degree.where(F.col("d") > least)
    of_hubs = None if hubs.isEmpty() else frozen(out_degrees(edges, F.broadcast(hubs)), "hubs")
    weights = bucketed(out_degrees(edges, degree.where(F.col("d") <= least)).repartition(n, "src"), "weights", "src", n)
    state = bucketed(initial(nodes).repartition(n, "url"), "ranks", "url", n)
    for _ in range(rounds):
        state = bucketed(step(state, weights, of_hubs), "ranks", "url", n)
        if threshold is not None and max_change(state) <= threshold:
            break
    else:
        if threshold is not None:
            raise NotConverged(f"after {rounds} rounds")
    return state


def max_change(state: DataFrame) -> float:
    """The largest change of the last round; 0 without pages."""
    return state.agg(F.coalesce(F.max(F.abs(F.col("rank") - F.col("prev"))), F.lit(0.0))).first()[0]
