"""Encoding texts with a public byte-level BPE tokenizer, by a depth-first walk over a trie of distinct words.

For every prefix of a word, BPE's encoding ends in one determined token, and the encoding of the prefix is that of
what stands before the token plus the token. So the last token is all the state a trie node needs: a node's state
follows from the states of the nodes above it, and prefixes that words share are encoded once. The words of a batch
are visited in sorted order, which is the depth-first order of their trie; the states on the path from the root are
kept on a stack, cut back to the common prefix at each next word.

Texts stay where they are read: each task encodes its own batches and nothing is shuffled.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vocabulary file (byte-level BPE, with its merges) on every executor.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: How this tokenizer splits a text into words. Fixed value of the public tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of words that a task remembers before it starts anew, and the longest word it remembers.
REMEMBERED_BYTES, LONG_WORD = 64 << 20, 256


def _bytes_of_printables() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file: itself, or the next one from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Tokens by their bytes, and how each was merged."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte = _bytes_of_printables()
        raw = {k: bytes(byte[c] for c in k) for k in model["vocab"] if all(c in byte for c in k)}
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        vocab = model["vocab"]
        self.ids = {raw[k]: vocab[k] for k in raw if len(k) == 1}
        for pair in model["merges"]:
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            whole, halves = vocab[left + right], (vocab[left], vocab[right])
            self.merged[halves] = whole
            self.parts[whole] = halves
            self.ids[raw[left + right]] = whole
        lengths: dict[bytes, set[int]] = {}
        for token in self.ids:
            lengths.setdefault(token[-2:], set()).add(len(token))
        #: Lengths of the tokens that end in given two bytes, longest first; single bytes are in all of them.
        self.lengths = {k: tuple(sorted(v | {1}, reverse=True)) for k, v in lengths.items() if len(k) == 2}
        self.size = {v: len(k) for k, v in self.ids.items()}
        self.known: dict[tuple[int, int], bool] = {}

    def stands(self, a: int, b: int) -> bool:
        """Whether BPE leaves the tokens ``a`` and ``b`` side by side, that is, makes no merge across their border.

        Merges are undone from the latest back, on whichever side was merged later; the pieces at the border are then
        neighbours over a span of merge times, and BPE crosses the border if their own merge falls into that span.
        """
        pair = (a, b)
        if (got := self.known.get(pair)) is not None:
            return got
        merged, parts = self.merged, self.parts
        until = 1 << 30  # the pieces at the border are gone from this merge on
        while True:
            crossing = merged.get((a, b))
            if crossing is not None and crossing < until:
                got = False
                break
            left, right = parts.get(a), parts.get(b)
            if left is None and right is None:
                got = True
                break
            # Of equal merges, BPE makes the left one first.
            if right is None or (left is not None and a > b):
                until, a = a, left[1]
            else:
                until, b = b + 1, right[0]
        if len(self.known) > 4_000_000:
            self.known.clear()
        self.known[pair] = got
        return got

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, list[int]]:
        """Ids of each of the distinct ``words``, by the walk over their trie."""
        ids, lengths, size, stands, one = self.ids, self.lengths, self.size, self.stands, (1,)
        out: dict[bytes, list[int]] = {}
        path, last = b"", [-1]  # last[i]: the last token of the encoding of path[:i]
        for word in sorted(words):
            common, most = 0, min(len(path), len(word))
            while common < most and path[common] == word[common]:
                common += 1
            del last[common + 1 :]
            for end in range(common + 1, len(word) + 1):
                for length in lengths.get(word[end - 2 : end], one) if end > 1 else one:
                    if length > end:
                        continue
                    token = ids.get(word[end - length : end])
                    if token is not None and (length == end or stands(last[end - length], token)):
                        last.append(token)
                        break
                else:
                    raise ValueError(f"no token ends {word[:end]!r}")
            path = word
            back, end = [], len(word)
            while end:
                back.append(last[end])
                end -= size[last[end]]
            back.reverse()
            out[word] = back
        return out


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Encodes texts batch by batch and remembers the words it has met, up to a bound."""

    def __init__(self, path: str, pattern: str = PATTERN) -> None:
        self.vocabulary, self.pattern = vocabulary(path), regex.compile(pattern, regex.V1)
        self.words: dict[str, list[int]] = {}
        self.held = 0

    def batch(self, texts: list[str | None]) -> list[list[list[int]]]:
        """For each text the ids of its words; none for null and for empty texts."""
        split = [self.pattern.findall(t) if t else [] for t in texts]
        words = self.words
        if self.held > REMEMBERED_BYTES:
            words.clear()
            self.held = 0
        new = {w for ws in split for w in ws if w not in words}
        long_ones: dict[str, list[int]] = {}
        if new:
            as_bytes = {w.encode("utf-8"): w for w in new}
            for b, ids in self.vocabulary.encode_words(as_bytes).items():
                if len(b) > LONG_WORD:
                    long_ones[as_bytes[b]] = ids
                else:
                    words[as_bytes[b]] = ids
                    self.held += 100 + 3 * len(b)
        if long_ones:
            return [[long_ones[w] if w in long_ones else words[w] for w in ws] for ws in split]
        return [[words[w] for w in ws] for ws in split]


def _slices(batch: pa.RecordBatch, text: str, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``most`` characters of text, or one row."""
    at, held = 0, 0
    for i, n in enumerate(pa.compute.binary_length(batch.column(text)).to_pylist()):
        if held and held + (n or 0) > most:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n or 0
    if at < batch.num_rows:
        yield batch.slice(at)


def encode(df: DataFrame, id_column: str, text_column: str, tokenizer: str = TOKENIZER, keep: tuple[str, ...] = (), counts_only: bool = False) -> DataFrame:
    """``id_column``, the columns ``keep``, and ``ids`` (array of int) or with ``counts_only`` ``n_tokens`` of each text.

    Null and empty texts have no ids: an empty list, or 0. Strings that look like special tokens are ordinary text.
    Rows are independent: repeated rows come out as often as they stand, an empty table gives none, other columns
    are not read.
    """
    import pyarrow.compute  # noqa: F401

    chosen = df.select(id_column, *keep, F.col(text_column).alias("_text"))
    result = ("n_tokens", "long") if counts_only else ("ids", "array<int>")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]), " ".join(result)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        encoder = Encoder(tokenizer)
        for whole in batches:
            for batch in _slices(whole, "_text", 4 << 20):
                coded = encoder.batch(batch.column("_text").to_pylist())
                lengths = [sum(map(len, ws)) for ws in coded]
                if counts_only:
                    out = pa.array(lengths, pa.int64())
                else:
                    flat = np.fromiter((i for ws in coded for w in ws for i in w), np.int32, sum(lengths))
                    out = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *lengths], dtype=np.int32)), pa.array(flat))
                names = [n for n in batch.schema.names if n != "_text"]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), out], names=[*names, result[0]])

    return chosen.mapInArrow(run, schema)
