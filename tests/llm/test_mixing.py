from pathlib import Path

import numpy as np
import pytest

from webloom.llm import mixing
from webloom.llm.mixing import leaves, mix, permuted, shares
from webloom.llm.tokenizer import TOKENIZER

pytestmark = pytest.mark.skipif(not Path(TOKENIZER).exists(), reason="no tokenizer")
RECIPES = "recipe string, source string, target_share double, max_repeats int, budget_ratio double, note string"


def documents(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, source string, block string, n_tokens int")


def test_tree_keeps_quotas_and_order():
    counts = np.array([7, 0, 100, 3])
    got = list(leaves(counts, 9, (1, 0)))
    assert [x[0] for x in got] == list(range(9)) and (got[-1][2] == counts).all() and (got[0][1] == 0).all()
    assert all((a[2] == b[1]).all() for a, b in zip(got, got[1:]))
    sums = [int((end - start).sum()) for _, start, end in got]
    assert max(sums) - min(sums) <= 4
    part = list(leaves(counts, 9, (1, 0), 3, 6))
    assert [[y.tolist() for y in x[1:]] for x in part] == [[y.tolist() for y in x[1:]] for x in got[3:6]]


@pytest.mark.parametrize("n", [1, 2, 16, 100])
def test_permutation(spark, n):
    from pyspark.sql import functions as F

    m, f = permuted(F.lit(5).cast("long"), n)
    got = [r.b for r in spark.range(m).select(F.col("id").alias("no")).select("no", f.alias("b")).orderBy("no").collect()]
    assert sorted(got) == list(range(m)) and m <= 8 * max(2, n)


def test_mix(spark, monkeypatch):
    rows = [(i, f"word number {i} of the first source", " A ") for i in range(300)] + [(1000 + i, f"small {i}", "b") for i in range(20)] + [(2000, None, "b"), (2001, "", "a"), (2002, "no source", None)]
    recipes = spark.createDataFrame([("r", "a", 3.0, 1, 0.5, ""), ("r", "B", 1.0, 2, 0.5, ""), ("r", "absent", 1.0, 5, 0.5, ""), ("r", "a", 0.5, 1, 0.5, ""), ("none", "a", None, None, None, None), (None, "a", 1.0, 3, 2.0, "")], RECIPES)
    for shard_tokens, window, walk in ((1 << 22, 1 << 12, 1 << 10), (300, 4, 2)):
        monkeypatch.setattr(mixing, "SHARD_TOKENS", shard_tokens)
        monkeypatch.setattr(mixing, "WINDOW", window)
        mixed, lines = mix(documents(spark, rows), recipes)
        got = mixed.collect()
        table = shares(mixed, lines).collect()
        assert {(r.recipe, r.source) for r in table if r.target_share > 0 and not r.reachable} == {("r", "B"), ("r", "absent")}
        used = {}
        for r in got:
            used.setdefault((r.recipe, r.line, r.doc_id), []).append(r.copy_no)
        assert all(len(v) == len(set(v)) for v in used.values()) and max(map(len, used.values())) == 3
        assert sorted({r.doc_id for r in got if r.source == "B"}) == list(range(1000, 1020)) and sum(r.source == "B" for r in got) == 40
        for r in table:
            if r.reachable:
                assert 0 <= r.target_tokens - r.actual_tokens <= 12, r
        # A source that is listed twice: each line has its own quota.
        assert {r.target_share: r.actual_tokens > 0 for r in table if (r.recipe, r.source) == ("r", "a")} == {3.0: True, 0.5: True}
        assert all(abs(sum(r.actual_share for r in table if r.recipe == x) - 1) < 1e-9 for x in ("r", None))
        shards = {(r.recipe, r.shard) for r in got}
        for shard in shards:
            assert sorted(r.position for r in got if (r.recipe, r.shard) == shard) == list(range(sum((r.recipe, r.shard) == shard for r in got)))
    assert len(shards) > 4
    assert sorted(map(str, mix(documents(spark, rows), recipes)[0].collect())) == sorted(map(str, got))


def test_empty(spark):
    recipes = spark.createDataFrame([("r", "a", 1.0, 1, 1.0, "")], RECIPES)
    mixed, lines = mix(documents(spark, []), recipes)
    assert mixed.count() == 0 and shares(mixed, lines).first().reachable
    assert mix(documents(spark, [(1, "x", "a")]), recipes.limit(0))[0].count() == 0
