"""Mixing sources to target weights.

Each source's documents are spread over blocks. A recipe's quota of a source is a number of block draws: whole
repeats of the source first, then a part of it, each in a permuted order of the blocks. A tree over the output shards
splits the quotas of all sources at once: at each node the draws that go to the left half of its shards are
multivariate hypergeometric, so every shard gets a random composition and the quotas come out exactly. Each leaf takes
the next draws of every source's permuted order, hence the shards are disjoint, and shuffles its documents locally.

Every node of the tree draws from its own random numbers, so any part of it can be computed by itself: the driver holds
one row per recipe line, and tasks walk down to the ranges of shards they are given. Blocks and shards keep their size,
whatever the input.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm import tokenizer
from webloom.session import frozen

SEED = 20240517
#: Tokens in a block, about, and the fewest blocks of a source.
BLOCK_TOKENS, FEWEST_BLOCKS = 1 << 20, 16
#: Tokens in an output shard.
SHARD_TOKENS = 1 << 22
#: Blocks that are summed in one window, and shards that one row of the walk gives.
WINDOW, WALK = 1 << 12, 1 << 10


def source_key(source: Column) -> Column:
    """Sources are compared without white space around them and in lower case."""
    return F.lower(F.regexp_replace(source, r"^\s+|\s+$", ""))


def sizes(documents: DataFrame, path: str = tokenizer.TOKENIZER) -> DataFrame:
    """(doc_id, source, n_tokens), the source as its key; null and empty texts have 0 tokens."""
    counted = tokenizer.encode(documents, "doc_id", "text", path, keep=("source",), counts_only=True)
    return counted.select("doc_id", source_key(F.col("source")).alias("source"), "n_tokens")


def targets(sized: DataFrame, recipes: DataFrame) -> DataFrame:
    """Per line of ``recipes``: the target, what the source can give, and what it will give, in tokens.

    target = tokens of all documents x budget_ratio x target_share / sum of the recipe's target_shares. Null shares,
    repeats and ratios count as 0; negative ones too. Documents without a source count among all documents only.
    A recipe whose shares sum to 0 has targets of 0. A source absent from the documents can give 0.
    """
    totals = sized.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"), F.count_if(F.col("n_tokens") > 0).alias("source_docs"))
    everything = totals.agg(F.coalesce(F.sum("source_tokens"), F.lit(0)).cast("long")).first()[0]
    zero = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0))
    share_sums = recipes.groupBy("recipe").agg(F.sum(zero("target_share")).alias("shares"))
    lines = recipes.select("recipe", "source", zero("target_share").alias("target_share"), zero("max_repeats").cast("long").alias("max_repeats"), zero("budget_ratio").alias("budget_ratio"))
    lines = lines.join(share_sums, lines.recipe.eqNullSafe(share_sums.recipe)).drop(share_sums.recipe).withColumn("all_tokens", F.lit(everything).cast("long"))
    joined = lines.join(totals.withColumnRenamed("source", "key"), source_key(F.col("source")) == F.col("key"), "left")
    tokens = F.coalesce("source_tokens", F.lit(0))
    target = F.coalesce(F.col("all_tokens") * F.col("budget_ratio") * F.col("target_share") / F.nullif(F.col("shares"), F.lit(0.0)), F.lit(0.0))
    out = joined.select("recipe", "source", "key", "target_share", "max_repeats", "all_tokens", tokens.alias("source_tokens"), F.coalesce("source_docs", F.lit(0)).alias("source_docs"), target.alias("target_tokens"), (tokens * F.col("max_repeats")).alias("available_tokens"))
    return out.withColumn("planned_tokens", F.floor(F.least("target_tokens", F.col("available_tokens").cast("double"))).cast("long"))


def _rounds(key: Column, value: Column, width: int) -> Column:
    """A permutation of the numbers below 2^(2 width), another for each key: four rounds over their halves."""
    mask = F.lit((1 << width) - 1)
    left, right = F.shiftright(value, width).bitwiseAND(mask), value.bitwiseAND(mask)
    for i in range(4):
        left, right = right, left.bitwiseXOR(F.xxhash64(key, right, F.lit(i)).bitwiseAND(mask))
    return F.shiftleft(left, width).bitwiseOR(right)


def permuted(key: Column, n: int) -> tuple[int, Column]:
    """(m, f): f maps the column ``no``, 0 to m - 1, to distinct numbers; those below ``n`` are a permutation of 0 to n - 1."""
    width = max(1, math.ceil(math.log2(max(2, n)) / 2))
    return 1 << (2 * width), _rounds(key, F.col("no"), width)


def taken_left(counts: np.ndarray, shards: int, seed: tuple[int, ...], node: int) -> np.ndarray:
    """Of each source's draws at a tree node, those that go to the left half of its shards."""
    total, left = int(counts.sum()), shards // 2
    if not total:
        return counts
    return np.random.default_rng([*seed, node]).multivariate_hypergeometric(counts, round(total * left / shards), method="marginals")


def leaves(counts: np.ndarray, shards: int, seed: tuple[int, ...], first: int = 0, last: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, start, end) of the shards ``first`` to ``last`` - 1: of each source the draws from start to end, in its permuted order. All shards' counts sum to ``counts``."""
    last = shards if last is None else last
    stack = [(1, 0, shards, np.zeros_like(counts), counts)]
    while stack:
        node, at, n, start, own = stack.pop()
        if at >= last or at + n <= first:
            continue
        if n == 1:
            yield at, start, start + own
            continue
        left = taken_left(own, n, seed, node)
        stack.append((2 * node + 1, at + n // 2, n - n // 2, start + left, own - left))
        stack.append((2 * node, at, n // 2, start, left))


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(recipe_no, line, shard, rank) of each draw, from rows (recipe_no, counts, shards, seed, first)."""
    for b in batches:
        for recipe, counts, shards, seed, first in zip(b["recipe_no"], b["counts"], b["shards"], b["seed"], b["first"]):
            for shard, start, end in leaves(np.asarray(counts, np.int64), int(shards), (int(seed), int(recipe)), int(first), min(int(first) + WALK, int(shards))):
                n = end - start
                line = np.repeat(np.arange(len(n)), n)
                rank = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)
                yield pd.DataFrame({"recipe_no": np.int32(recipe), "line": line.astype(np.int32), "shard": np.int64(shard), "rank": rank})


def draws(sized: DataFrame, plan: list, seed: int) -> tuple[DataFrame, DataFrame]:
    """The documents by block, (doc_id, key, n_tokens, block), and the draws: (recipe_no, line, key, copy_no, block, keep, shard).

    plan: rows with recipe_no, line, key, planned_tokens and source_tokens, one per line that gives something. keep: how many tokens a
    draw may give, null for all.
    """
    spark = sized.sparkSession
    n_blocks = {r.key: max(FEWEST_BLOCKS, r.source_tokens // BLOCK_TOKENS) for r in plan}
    # One row per source that a recipe names.
    named = spark.createDataFrame([*n_blocks.items()], "b_source string, n_blocks long")
    placed = sized.where("n_tokens > 0").join(F.broadcast(named), F.col("source") == F.col("b_source"))
    placed = frozen(placed.select("doc_id", F.col("source").alias("key"), "n_tokens", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("n_blocks")).alias("block")), "placed")
    held = frozen(placed.groupBy("key", "block").agg(F.sum("n_tokens").alias("held")), "blocks")

    queues = None
    for r in plan:
        n, whole, left = n_blocks[r.key], *divmod(r.planned_tokens, r.source_tokens)
        salt = F.xxhash64(F.lit(seed), F.lit(r.recipe_no), F.lit(r.line), F.col("copy_no"))
        m, number = permuted(salt, n)
        per_copy = -(-m // WINDOW)
        chunks = (whole + (left > 0)) * per_copy
        every = spark.range(0, chunks, 1, max(1, min(chunks >> 4, 1 << 12))).select(F.floor(F.col("id") / per_copy).alias("copy_no"), (F.col("id") % per_copy * WINDOW).alias("first"))
        order = every.select("copy_no", F.explode(F.sequence("first", F.least(F.col("first") + WINDOW, F.lit(m)) - 1)).alias("no"))
        order = order.select("copy_no", "no", number.alias("block")).where(F.col("block") < n)
        line = order.select(F.lit(r.recipe_no).alias("recipe_no"), F.lit(r.line).alias("line"), F.lit(r.key).alias("key"), "copy_no", "no", "block", F.when(F.col("copy_no") < whole, F.lit(None).cast("long")).otherwise(F.lit(left)).alias("left"))
        queues = line if queues is None else queues.unionByName(line)
    # Empty blocks are never drawn. Sums along the permuted order run in two levels: within chunks of it, then over chunks.
    filled = queues.join(held, ["key", "block"]).withColumn("chunk", F.floor(F.col("no") / WINDOW))
    per_chunk = filled.groupBy("recipe_no", "line", "copy_no", "chunk").agg(F.sum("held").alias("h"), F.count("*").alias("c"))
    chunks = per_chunk.selectExpr("*", "sum(h) OVER (PARTITION BY recipe_no, line, copy_no ORDER BY chunk) - h AS held_before", "sum(c) OVER (PARTITION BY recipe_no, line ORDER BY copy_no, chunk) - c AS rank_before").drop("h", "c")
    summed = filled.join(chunks, ["recipe_no", "line", "copy_no", "chunk"]).selectExpr(
        "recipe_no", "line", "key", "copy_no", "block", "left", "held",
        "held_before + sum(held) OVER (PARTITION BY recipe_no, line, copy_no, chunk ORDER BY no) - held AS before",
        "rank_before + row_number() OVER (PARTITION BY recipe_no, line, copy_no, chunk ORDER BY no) - 1 AS rank",
    )
    room = F.col("left") - F.col("before")
    queued = frozen(summed.where("left IS NULL OR before < left").withColumn("keep", F.when(F.col("held") > room, room)).drop("left", "before", "held"), "queues")

    # One row per line: how many draws it has. Then the tree over each recipe's shards.
    counts = {(r.recipe_no, r.line): r["count"] for r in queued.groupBy("recipe_no", "line").count().collect()}
    trees = []
    for recipe in dict.fromkeys(r.recipe_no for r in plan):
        own = [r for r in plan if r.recipe_no == recipe]
        row = [counts.get((recipe, line), 0) for line in range(1 + max(r.line for r in own))]
        shards = min(max(1, -(-sum(r.planned_tokens for r in own) // SHARD_TOKENS)), max(1, sum(row)))
        trees.append((recipe, row, shards, seed))
    tree = spark.createDataFrame(trees, "recipe_no int, counts array<long>, shards long, seed long")
    walks = tree.select("*", F.explode(F.expr(f"sequence(0L, shards - 1, {WALK}L)")).alias("first"))
    ranks = walks.repartition("recipe_no", "first").mapInPandas(_walk, "recipe_no int, line int, shard long, rank long")
    return placed, frozen(queued.join(ranks, ["recipe_no", "line", "rank"]).drop("rank"), "draws")


_MIX = "recipe string, line int, shard long, position long, source string, doc_id {}, copy_no long, n_tokens long"


def mix(documents: DataFrame, recipes: DataFrame, path: str = tokenizer.TOKENIZER, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The mix, (recipe, line, shard, position, source, doc_id, copy_no, n_tokens), and its lines: ``targets`` with their line number.

    A document is used at most max_repeats times per line. Each line gets whole repeats and, of a last one, blocks in a
    permuted order until the planned tokens are reached; the block at the border is cut between documents, so a line
    misses its planned tokens by less than one document. Texts without tokens are never drawn. A source that is
    listed twice in a recipe gives both lines their quota; line tells them apart. Empty tables give an empty mix.
    """
    spark = documents.sparkSession
    sized = frozen(sizes(documents, path), "sizes")
    given = targets(sized, recipes).orderBy("recipe", "key", "source", "target_share", "max_repeats").collect()
    numbers: dict[str | None, int] = {}
    lines, plan, at = [], [], {}
    for r in given:
        no = numbers.setdefault(r.recipe, len(numbers))
        at[no] = at.get(no, -1) + 1
        lines.append((*r, no, at[no]))
    schema = "recipe string, source string, key string, target_share double, max_repeats long, all_tokens long, source_tokens long, source_docs long, target_tokens double, available_tokens long, planned_tokens long, recipe_no int, line int"
    listed = frozen(spark.createDataFrame(lines, schema), "lines")
    plan = listed.where("planned_tokens > 0").orderBy("recipe_no", "line").collect()
    if not plan:
        return spark.createDataFrame([], _MIX.format(documents.schema["doc_id"].dataType.simpleString())), listed
    placed, drawn = draws(sized, plan, seed)
    chosen = placed.join(drawn, ["key", "block"])
    # A block has about BLOCK_TOKENS, and one block per line is cut.
    w = f"sum(n_tokens) OVER (PARTITION BY recipe_no, line, copy_no, block ORDER BY xxhash64(doc_id, copy_no, {seed}), doc_id)"
    cut = chosen.where("keep IS NOT NULL").withColumn("upto", F.expr(w)).where("upto <= keep").drop("upto")
    mixed = chosen.where("keep IS NULL").unionByName(cut).withColumn("o", F.xxhash64("doc_id", "copy_no", "line", F.lit(seed)))
    position = F.expr("cast(row_number() OVER (PARTITION BY recipe_no, shard ORDER BY o, doc_id, copy_no, line) - 1 AS long)")
    names = F.broadcast(listed.select(F.col("recipe_no").alias("r"), F.col("line").alias("l"), "recipe", "source"))  # one row per recipe line
    out = mixed.withColumn("position", position).join(names, (F.col("recipe_no") == F.col("r")) & (F.col("line") == F.col("l")))
    return out.select("recipe", "line", "shard", "position", "source", "doc_id", "copy_no", "n_tokens"), listed


def shares(mixed: DataFrame, lines: DataFrame) -> DataFrame:
    """Per line: the tokens wanted and reached in ``mixed``, the share of its recipe's mix, and whether its target was in reach.

    A target is out of reach if every document was drawn as often as allowed and the line still falls short of it.
    """
    got = mixed.groupBy("recipe", "line").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("drawn"), F.countDistinct("doc_id").alias("n_docs"), F.max("copy_no").alias("c"))
    got = got.select(F.col("recipe").alias("r"), F.col("line").alias("l"), "tokens", "drawn", "n_docs", "c")
    reached, drawn = F.coalesce("tokens", F.lit(0)), F.coalesce("drawn", F.lit(0))
    joined = lines.join(got, F.col("recipe").eqNullSafe(F.col("r")) & (F.col("line") == F.col("l")), "left")
    whole = F.expr("sum(tokens) OVER (PARTITION BY recipe)")  # one row per line of the recipe
    shares = F.expr("sum(target_share) OVER (PARTITION BY recipe)")
    spent = drawn >= F.col("source_docs") * F.col("max_repeats")
    return joined.select(
        "recipe", "line", "source", "target_share", (F.col("target_share") / F.nullif(shares, F.lit(0.0))).alias("wanted_share"), F.coalesce(reached / whole, F.lit(0.0)).alias("actual_share"),
        "target_tokens", reached.alias("actual_tokens"), F.coalesce(F.col("c") + 1, F.lit(0)).alias("repeats"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"), (~spent | (reached >= F.col("target_tokens"))).alias("reachable"),
    )
