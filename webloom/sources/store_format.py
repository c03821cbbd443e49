"""The store's record format, ``key SP (name SP length SP value SP)* LF``, as bytes."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

Cells = list[tuple[bytes, bytes]]


def records(body: bytes) -> Iterator[tuple[bytes | None, Cells, bytes]]:
    """(row key, cells, the record's own bytes) of each record in ``body``.

    From the first byte that doesn't follow the format to the end, the rest is one record without a key
    whose only cell holds these bytes, so nothing is lost.
    """
    at, end = 0, len(body)
    while at < end:
        try:
            stop = body.index(b" ", at)
            key, pos, cells = body[at:stop], stop + 1, []
            while body[pos] != 10:
                stop = body.index(b" ", pos)
                name, pos = body[pos:stop], stop + 1
                stop = body.index(b" ", pos)
                length, pos = int(body[pos:stop]), stop + 1
                if length < 0 or pos + length >= end or body[pos + length] != 32:
                    raise ValueError("value out of bounds")
                cells.append((name, body[pos : pos + length]))
                pos += length + 1
            pos += 1
        except (ValueError, IndexError):
            yield None, [(b"", body[at:])], body[at:]
            return
        yield key, cells, body[at:pos]
        at = pos


def encode(key: bytes, cells: Cells) -> bytes:
    """One record's bytes, cells in the order given."""
    return key + b" " + b"".join(b"%s %d %s " % (n, len(v), v) for n, v in cells) + b"\n"


def identity(table: str | None, key: bytes | None, cells: Cells) -> bytes:
    """A 16-byte digest of table, key and the set of cells, whatever their order."""
    h = blake2b(digest_size=16)
    for part in (None if table is None else table.encode(), key, *(x for cell in sorted(set(cells)) for x in cell)):
        h.update(b"-" if part is None else b"%d:%s" % (len(part), part))
    return h.digest()
