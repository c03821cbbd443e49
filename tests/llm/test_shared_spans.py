import random

import pytest
from pyspark.sql import functions as F

from webloom.llm import shared_spans as module
from webloom.llm.shared_spans import COVER, PERIOD, cover_positions, shared_parts, shared_spans, window_hashes


def brute(rows, length):
    owners = {}
    for i, t in rows:
        for s in range(len(t or "") - length + 1):
            owners.setdefault(t[s : s + length], set()).add(i)
    out = set()
    for i, t in rows:
        marks = [False] * len(t or "")
        for s in range(len(t or "") - length + 1):
            if len(owners[t[s : s + length]]) > 1:
                marks[s : s + length] = [True] * length
        for s in range(len(marks)):
            if marks[s] and (s == 0 or not marks[s - 1]):
                e = s
                while e < len(marks) and marks[e]:
                    e += 1
                out.add((i, s, e))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, digest string, lo int")


def test_cover_meets_every_alignment():
    assert len(COVER) == 9 and {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))
    assert list(cover_positions(0)) == [] and all(p % PERIOD in COVER for p in cover_positions(500))


def test_packed_numbers_and_second_hash():
    import numpy as np

    for numbers in ([], [5], [3, 3, 900, -7, 1 << 40]):
        assert module.unsqueeze(module.squeeze(np.array(numbers, np.int64))).tolist() == numbers
    text, width = "héllo🙂wörld" * 400, 11
    slow = lambda t: sum((ord(c) + 1) * pow(module._POINT, i, module._PRIME) for i, c in enumerate(t)) % module._PRIME
    starts = np.array([0, 1, 2500, 4389])
    assert module.second_hashes(text, starts, width).tolist() == [slow(text[s : s + width]) for s in starts]


def test_hash_ignores_place():
    import numpy as np

    a, b = window_hashes("xx" + "héllo🙂wörld", np.array([2]), 11), window_hashes("héllo🙂wörld" + "y" * 40, np.array([0]), 11)
    assert a == b and a != window_hashes("héllo🙂wörle", np.array([0]), 11)


@pytest.mark.parametrize("seed, flush, bucket", [(1, 1 << 21, 500_000), (2, 60, 40)])
def test_against_brute_force(spark, monkeypatch, seed, flush, bucket):
    monkeypatch.setattr(module, "FLUSH", flush)
    monkeypatch.setattr(module, "BUCKET", bucket)
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("ab🙂é \n") for _ in range(n))
    shared = [word(n) for n in (100, 101, 102, 130, 250)]
    rows = [(i, word(rng.randint(0, 90)) + rng.choice(shared) + word(rng.randint(0, 60)) + rng.choice(shared)[: rng.randint(50, 250)]) for i in range(40)]
    rows += [(100, rows[0][1]), (101, rows[0][1]), (102, None), (103, ""), (104, "z" * 3000), (105, "z" * 101), (106, "q" * 300), (106, "q" * 300), (107, "r" * 150), (107, "r" * 160)]
    got = {(r.doc_id, r.start_pos, r.end_pos) for r in shared_spans(frame(spark, rows), 101).collect()}
    assert got == brute(list(dict.fromkeys(rows)), 101)


def test_parts_and_empty(spark):
    rows = [(1, "k" * 200), (2, "k" * 400), (3, None), (4, "short")]
    df = frame(spark, rows)
    got = {r.doc_id: (r.n_shared, r.shared_part) for r in shared_parts(df, shared_spans(df)).collect()}
    assert got == {1: (200, 1.0), 2: (400, 1.0), 3: (0, 0.0), 4: (0, 0.0)}
    assert shared_spans(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        shared_spans(df, 10)
    assert shared_spans(df.withColumn("doc_id", F.lit(None).cast("long"))).count() == 0
