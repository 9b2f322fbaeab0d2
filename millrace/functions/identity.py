"""Content-addressed ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_id(*parts: Column) -> Column:
    """SHA-256 over each part's UTF-8 length (8 bytes, big-endian) and bytes, so that no two lists of
    parts run into each other."""
    each = []
    for p in parts:
        each += [F.unhex(F.lpad(F.hex(F.octet_length(p).cast("long")), 16, "0")), F.encode(p, "UTF-8")]
    return F.sha2(F.concat(*each), 256)


def chunk_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(content_id(*parts), 1, 32))


def unit_separated(*parts: Column, length: int, prefix: str = "") -> Column:
    """SHA-256 of the parts with U+001F between them, cut to length."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, length))
