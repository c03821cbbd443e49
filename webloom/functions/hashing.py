"""Keys of rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_key(value: Column) -> Column:
    """SHA-1 of the value's UTF-8 bytes, in hex."""
    return F.sha1(F.encode(value, "UTF-8"))


#: Fixed value: the letters of the second place.
_SECOND = "acegikmoqs"


def hash_key_compat(value: Column) -> Column:
    """The same 20 bytes as 40 letters: each byte's index in 255 pairs of a letter a-z and a second letter.

    Bytes 1 to 127 have their own index, 128 to 255 the one below, and 0 has 255.
    """
    digest = hash_key(value)

    def letters(i: Column) -> Column:
        byte = F.conv(F.substring(digest, 2 * i + 1, F.lit(2)), 16, 10).cast("int")
        index = F.when(byte == 0, 255).when(byte > 127, byte - 1).otherwise(byte)
        return F.concat(F.char(97 + index % 26), F.substring(F.lit(_SECOND), (index / 26).cast("int") + 1, F.lit(1)))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(19)), letters), "")


def encode_key(value: Column) -> Column:
    """The value with all but ASCII letters, digits and ``-`` as ``_`` and two hex digits per UTF-8 byte; reversible."""
    one = lambda c: F.when(c.rlike("^[A-Za-z0-9-]$"), c).otherwise(F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-8"))), "(..)", "_$1"))
    return F.array_join(F.transform(F.filter(F.split(value, ""), lambda c: c != ""), one), "")


def decode_key(value: Column) -> Column:
    """The inverse of ``encode_key``."""
    pieces = F.regexp_extract_all(value, F.lit("((?:_[0-9a-f]{2})+|[^_]+)"), F.lit(1))
    one = lambda p: F.when(p.startswith("_"), F.decode(F.unhex(F.regexp_replace(p, "_", "")), "UTF-8")).otherwise(p)
    return F.array_join(F.transform(pieces, one), "")
