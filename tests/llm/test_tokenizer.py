import base64
import random
from pathlib import Path

import pytest

from webloom.llm.tokenizer import PATTERN, TOKENIZER, Encoder, encode

pytestmark = pytest.mark.skipif(not Path(TOKENIZER).exists(), reason="no tokenizer")
TEXTS = ["", "Hello world", "  spaces   and\ttabs\n\n", "<|endoftext|>", "naïve 汉字 🙂 ퟿\U0010ffff", "a" * 5000, " " * 700, "-=" * 999, "it's 2024, they'll \x1c\x85　go"]


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    lines = Path(TOKENIZER).with_suffix(".tiktoken").read_bytes().split(b"\n")
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_against_merging(reference):
    rng, encoder = random.Random(3), Encoder(TOKENIZER)
    alphabets = ["abc", "aeinrst ", "-=_ ", "  \n\t", "0123456789", "".join(map(chr, range(0, 900))), "".join(map(chr, range(0x4E00, 0x4E80)))]
    texts = TEXTS + ["".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randint(1, 150))) for _ in range(800)]
    for text, words in zip(texts, encoder.batch(texts)):
        assert [i for w in words for i in w] == reference.encode_ordinary(text), text[:50]


def test_frame(spark, reference):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(100, None, "x"), (100, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((r.doc_id, r.ids) for r in encode(df, "doc_id", "text").collect())
    assert got == sorted([(i, reference.encode_ordinary(t)) for i, t in enumerate(TEXTS)] + [(100, [])] * 2)
    counts = {r.doc_id: r.n_tokens for r in encode(df, "doc_id", "text", counts_only=True).collect()}
    assert counts[1] == len(reference.encode_ordinary(TEXTS[1])) and counts[100] == 0
    assert encode(df.limit(0), "doc_id", "text").count() == 0
