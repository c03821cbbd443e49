"""Long exact spans that texts share.

A difference cover D modulo a period v holds, for every pair of positions (i, j), a shift below v that brings both
into D. So of any two equal stretches of at least ``window + v - 1`` characters, one pair of equal windows starts at
cover positions in both texts, whatever their alignment. Only windows at cover positions are hashed and sought over
the corpus. Those that stand in more than one text are anchors; around the anchors of a text alone are the stretches
of the required length then compared, in the same way but by 95 bits of two unlike hashes, and their union is the
shared part.

What is sought is packed by buckets of the hash: the hash itself and, as compressed gaps, text and place. What a task
finds twice in its own texts is decided there, and two of its texts stand for the others in the bucket; so a passage
that a third of all texts hold is a few entries per task. No step lists the pairs of a group. Exact copies of a text
are one text until the end, where they are shared from end to end.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.session import frozen, shuffle_partitions

MIN_LENGTH = 160
#: A perfect difference set: the powers of 2 modulo 73.
PERIOD = 73
COVER = tuple(sorted({pow(2, k, PERIOD) for k in range(9)}))
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX = np.uint64(0xD6E8FEB86659FD93)
#: The second hash is a polynomial over the field of this prime.
_PRIME, _POINT = (1 << 31) - 1, 1_103_515_245
#: Entries that a task packs together, and about how many come into a bucket.
FLUSH, BUCKET = 1 << 21, 500_000


def cover_positions(n: int) -> np.ndarray:
    """The first ``n``-limited positions of the cover, ascending: all p < n with p mod PERIOD in COVER."""
    if n <= 0:
        return np.zeros(0, np.int64)
    rounds = -(-n // PERIOD)
    every = (np.arange(rounds, dtype=np.int64)[:, None] * PERIOD + np.array(COVER, np.int64)).ravel()
    return every[every < n]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


_tables: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n + 1 powers of the base and of its inverse modulo 2^64."""
    if not _tables or len(_tables[0]) <= n:
        size = 1 << max(12, n.bit_length())
        _tables[:] = [np.multiply.accumulate(np.array([1, *[x] * size], np.uint64)) for x in (int(_BASE), pow(int(_BASE), -1, 1 << 64))]
    return _tables[0], _tables[1]


def window_hashes(text: str, starts: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of text[s : s + width] for each s, as signed integers: from prefix sums of c[k] * base^k, shifted back by base^s."""
    c = code_points(text).astype(np.uint64)
    up, down = _powers(len(c))
    c = (c + np.uint64(1)) * _MIX
    c ^= c >> np.uint64(29)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(c * up[: len(c)], dtype=np.uint64)])
    h = (sums[starts + width] - sums[starts]) * down[starts]
    h ^= h >> np.uint64(32)
    h = h * _MIX
    return (h ^ (h >> np.uint64(29))).view(np.int64)


_field: list[np.ndarray] = []


def _powers_in_field(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n + 1 powers of the point and of its inverse modulo the prime."""
    if not _field or len(_field[0]) <= n:
        tables = []
        for x in (_POINT, pow(_POINT, -1, _PRIME)):
            powers = np.ones(1, np.uint64)
            while len(powers) <= max(n, 4096):
                powers = np.concatenate([powers, powers * np.uint64(pow(x, len(powers), _PRIME)) % np.uint64(_PRIME)])
            tables.append(powers)
        _field[:] = tables
    return _field[0], _field[1]


def second_hashes(text: str, starts: np.ndarray, width: int) -> np.ndarray:
    """31-bit hashes of text[s : s + width] for each s."""
    prime, c = np.uint64(_PRIME), code_points(text).astype(np.uint64)
    up, down = _powers_in_field(len(c))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((c + np.uint64(1)) * up[: len(c)] % prime, dtype=np.uint64)])
    return ((sums[starts + width] - sums[starts]) % prime * down[starts] % prime).astype(np.uint32)


def squeeze(a: np.ndarray) -> bytes:
    """Whole numbers as compressed gaps."""
    gaps = np.diff(a.astype(np.int64), prepend=0)
    most = int(np.abs(gaps).max()) if len(gaps) else 0
    kind = next(k for k in (np.int8, np.int16, np.int32, np.int64) if most <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + zlib.compress(gaps.astype(kind).tobytes(), 1)


def unsqueeze(data: bytes) -> np.ndarray:
    kind = {1: np.int8, 2: np.int16, 4: np.int32, 8: np.int64}[data[0]]
    return np.cumsum(np.frombuffer(zlib.decompress(data[1:]), kind), dtype=np.int64)


def _shared(hashes: tuple[np.ndarray, ...], rid: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries have a hash that texts of more than one document hold, and which two of each such hash can stand for all."""
    shared, stand = np.zeros(len(rid), bool), np.zeros(len(rid), bool)
    if not len(rid):
        return shared, stand
    order = np.lexsort(hashes)
    new = np.concatenate([[True], np.any([h[order][1:] != h[order][:-1] for h in hashes], axis=0)])
    starts, group = np.flatnonzero(new), np.cumsum(new) - 1
    r, low, high = rid[order], lo[order], hi[order]
    many = (np.minimum.reduceat(r, starts) < np.maximum.reduceat(r, starts)) & (np.minimum.reduceat(low, starts) < np.maximum.reduceat(high, starts))
    at = np.flatnonzero(many[group])
    if not len(at):
        return shared, stand
    shared[order[at]] = True
    # Of each the one of the smallest and the one of the largest document.
    for by, last in ((low, False), (high, True)):
        sub = at[np.lexsort((by[at], group[at]))]
        edge = group[sub][1:] != group[sub][:-1]
        stand[order[sub[np.concatenate([edge, [True]] if last else [[True], edge])]]] = True
    return shared, stand


_PACKED = "bucket int, decided boolean, rids binary, lows binary, copies binary, at binary, places binary, hashes binary"


def _pack_decided(rid: np.ndarray, place: np.ndarray, buckets: int) -> Iterator[tuple]:
    """Rows of places by bucket of rid."""
    dest = rid % buckets
    order = np.lexsort((place, rid, dest))
    for at in np.split(order, np.flatnonzero(np.diff(dest[order])) + 1):
        if len(at):
            yield int(dest[at[0]]), True, squeeze(rid[at]), b"", b"", b"", squeeze(place[at]), b""


def _sought(find: Callable[[pd.DataFrame], Iterator[tuple[np.ndarray, tuple[np.ndarray, ...]]]], buckets: int):
    """Packed entries of texts. find: of each text of a batch the places and the hashes that are sought."""

    def rows(texts: list[tuple], places: list[np.ndarray], hashes: list[tuple[np.ndarray, ...]]) -> pd.DataFrame:
        rid, lo, hi = (np.array(c, np.int64) for c in zip(*texts))
        doc = np.repeat(np.arange(len(rid)), [len(p) for p in places])
        place, h = np.concatenate(places).astype(np.int64), tuple(map(np.concatenate, zip(*hashes)))
        shared, stand = _shared(h, rid[doc], lo[doc], hi[doc])
        out = list(_pack_decided(rid[doc[shared]], place[shared], buckets))
        sent = np.flatnonzero(~shared | stand)
        bucket = (h[0][sent] % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        for at in np.split(sent[by], np.flatnonzero(np.diff(bucket[by])) + 1):
            if len(at):
                own, index = np.unique(doc[at], return_inverse=True)
                data = zlib.compress(np.packbits(lo[own] < hi[own]).tobytes(), 1) if (lo[own] < hi[own]).any() else b""
                highs = squeeze(hi[own][lo[own] < hi[own]]) if data else b""
                copies = len(data).to_bytes(4, "little") + data + highs
                out.append((int(h[0][at[0]] % np.uint64(buckets)), False, squeeze(rid[own]), squeeze(lo[own]), copies, squeeze(index), squeeze(place[at]), b"".join(x[at].tobytes() for x in _narrow(h))))
        return pd.DataFrame(out, columns=[c.split()[0] for c in _PACKED.split(", ")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts, places, hashes, held = [], [], [], 0
        for b in batches:
            for text, (place, h) in zip(zip(b["rid"], b["lo"], b["hi"]), find(b)):
                if len(place):
                    texts.append(text)
                    places.append(place)
                    hashes.append(h)
                    held += len(place)
                if held > FLUSH:
                    yield rows(texts, places, hashes)
                    texts, places, hashes, held = [], [], [], 0
        if held:
            yield rows(texts, places, hashes)

    return run


def _narrow(h: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """What is sent of hashes: of a single one, which only picks candidates, the upper 48 bits, else all."""
    return h if len(h) > 1 else ((h[0] >> np.uint64(32)).astype(np.uint32), (h[0] >> np.uint64(16)).astype(np.uint16))


def _met(kinds: tuple, buckets: int):
    """Of a bucket the entries whose hash texts of several documents hold, as decided rows. kinds: of the parts of a hash as it is sent."""

    def run(key: tuple, groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _PACKED.split(", ")]
        cols: list[list[np.ndarray]] = [[] for _ in range(4 + len(kinds))]
        for g in groups:
            yield g[g["decided"]]
            for rids, lows, copies, at, places, hashes in g.loc[~g["decided"], ["rids", "lows", "copies", "at", "places", "hashes"]].itertuples(index=False):
                rid, lo, at = unsqueeze(rids), unsqueeze(lows), unsqueeze(at)
                hi, n = lo.copy(), int.from_bytes(copies[:4], "little")
                if n:
                    hi[np.unpackbits(np.frombuffer(zlib.decompress(copies[4 : 4 + n]), np.uint8), count=len(lo)).astype(bool)] = unsqueeze(copies[4 + n :])
                for c, x in zip(cols, (rid[at], lo[at], hi[at], unsqueeze(places))):
                    c.append(x)
                start = 0
                for c, k in zip(cols[4:], kinds):
                    end = start + len(at) * np.dtype(k).itemsize
                    c.append(np.frombuffer(hashes[start:end], k))
                    start = end
        if cols[0]:
            rid, lo, hi, place, *h = map(np.concatenate, cols)
            shared, _ = _shared(tuple(h), rid, lo, hi)
            yield pd.DataFrame(list(_pack_decided(rid[shared], place[shared], buckets)), columns=names)

    return run


def _gathered(finish: Callable[[np.ndarray], tuple], columns: list[str]):
    """Per text what ``finish`` makes of its decided places, in order and each once."""

    def run(key: tuple, groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rids, places = [], []
        for g in groups:
            rids += map(unsqueeze, g["rids"])
            places += map(unsqueeze, g["places"])
        both = np.unique(np.stack([np.concatenate(rids), np.concatenate(places)], axis=1), axis=0)
        cuts = np.flatnonzero(np.diff(both[:, 0])) + 1
        out = [(int(x[0, 0]), *finish(x[:, 1])) for x in np.split(both, cuts)]
        yield pd.DataFrame(out, columns=["rid", *columns])

    return run


def _places(entries: DataFrame, kinds: tuple, buckets: int, finish: Callable, columns: dict[str, str]) -> DataFrame:
    """(rid, columns) of the texts of packed ``entries`` that have shared ones."""
    met = entries.groupBy("bucket").applyInPandas(_met(kinds, buckets), _PACKED).select("bucket", "rids", "places")
    return met.groupBy("bucket").applyInPandas(_gathered(finish, [*columns]), ", ".join(["rid long", *(f"{k} {v}" for k, v in columns.items())]))


def _anchors(min_length: int):
    width = min_length - PERIOD + 1

    def find(b: pd.DataFrame) -> Iterator[tuple[np.ndarray, tuple[np.ndarray, ...]]]:
        for text in b["text"]:
            at = cover_positions(len(text) - width + 1)
            yield np.arange(len(at)), (window_hashes(text, at, width).view(np.uint64),)

    return find


def _stretches(min_length: int):
    width = min_length - PERIOD + 1

    def find(b: pd.DataFrame) -> Iterator[tuple[np.ndarray, tuple[np.ndarray, ...]]]:
        for text, nos in zip(b["text"], b["nos"]):
            n = len(text)
            at = cover_positions(n - width + 1)[np.asarray(nos)]
            # Stretches that hold an anchor at one of their first PERIOD positions.
            marks = np.zeros(n + 2, np.int64)
            np.add.at(marks, np.maximum(0, at - PERIOD + 1), 1)
            np.add.at(marks, at + 1, -1)
            s = np.flatnonzero(np.cumsum(marks)[: max(0, n - min_length + 1)] > 0)
            yield s, (window_hashes(text, s, min_length).view(np.uint64), second_hashes(text, s, min_length))

    return find


def _runs(min_length: int):
    """Begins and ends of the runs that stretches from the given starts, in order, make up."""

    def finish(s: np.ndarray) -> tuple[list[int], list[int]]:
        new = np.flatnonzero(np.concatenate([[True], s[1:] > s[:-1] + min_length]))
        return s[new].tolist(), (s[np.concatenate([new[1:] - 1, [len(s) - 1]])] + min_length).tolist()

    return finish


def shared_spans(documents: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """(doc_id, start_pos, end_pos, n_chars): the maximal runs of shared characters of each text.

    A character is shared if it lies in a stretch of at least ``min_length`` characters (code points) that occurs
    verbatim in a text of another doc_id; runs that touch are one. Null, empty and shorter texts have none; a row that
    is repeated under its doc_id isn't shared by that and comes out once; copies under different ids are shared from
    end to end. A null doc_id counts as no document. Of other columns none is read.
    """
    if min_length < PERIOD:
        raise ValueError(f"min_length must be at least {PERIOD}")
    usable = documents.select("doc_id", "text").where(F.col("doc_id").isNotNull() & (F.length("text") >= min_length))
    digest = F.unhex(F.sha2("text", 256)).alias("digest")
    # One row per distinct text, with the range of its owners; copies are combined before the shuffle.
    texts = usable.groupBy(digest).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.first("text").alias("text"))
    texts = frozen(texts.withColumns({"rid": F.monotonically_increasing_id(), "n_chars": F.length("text")}), "texts")
    parts = shuffle_partitions(documents.sparkSession)
    total = texts.agg(F.coalesce(F.sum("n_chars"), F.lit(0))).first()[0]
    buckets = max(parts, total * len(COVER) // PERIOD // BUCKET)

    columns = texts.select("rid", "lo", "hi", "text")
    anchors = _places(columns.mapInPandas(_sought(_anchors(min_length), buckets), _PACKED), (np.uint32, np.uint16), buckets, lambda places: (places.tolist(),), {"nos": "array<int>"})
    sought = columns.join(anchors, "rid").mapInPandas(_sought(_stretches(min_length), buckets), _PACKED)
    runs = _places(sought, (np.uint64, np.uint32), buckets, _runs(min_length), {"begins": "array<int>", "ends": "array<int>"})

    # Texts of one document have their runs; those of several are shared from end to end, by each of their owners.
    span = F.explode(F.arrays_zip("begins", "ends")).alias("e")
    own = texts.where("lo = hi").select("rid", F.col("lo").alias("doc_id"), "n_chars").join(runs, "rid").select("doc_id", span, "n_chars")
    own = own.select("doc_id", F.col("e.begins").alias("start_pos"), F.col("e.ends").alias("end_pos"), "n_chars")
    copied = texts.where("lo < hi").select(F.col("digest").alias("d"))
    whole = usable.select("doc_id", digest, F.length("text").alias("n_chars")).distinct().join(copied, F.col("digest") == F.col("d"))
    return own.unionByName(whole.select("doc_id", F.lit(0).alias("start_pos"), F.col("n_chars").alias("end_pos"), "n_chars"))


def shared_parts(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, n_chars, n_shared, shared_part) of every document; texts that are null or empty share nothing, part 0."""
    got = spans.groupBy("doc_id").agg(F.sum(F.col("end_pos") - F.col("start_pos")).alias("n"))
    n_chars = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    shared = F.coalesce("n", F.lit(0)).cast("long")
    part = F.when(n_chars > 0, shared / n_chars).otherwise(0.0)
    return documents.select("doc_id", "text").join(got, "doc_id", "left").select("doc_id", n_chars.alias("n_chars"), shared.alias("n_shared"), part.alias("shared_part"))
