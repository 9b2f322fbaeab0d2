"""Scope filters. An empty list leaves a field free; an empty intersection matches nothing."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SearchFilter:
    """What a search may see. The server sets user and generation; a request can only narrow."""

    user_id: str
    generation: str | None = None
    search_types: tuple[str, ...] = ()
    document_ids: tuple = ()
    content_types: tuple[str, ...] = ()
    dates: tuple | None = None
    match_none: bool = field(default=False)

    def narrowed(self, document_ids: Iterable | None) -> SearchFilter:
        """Both restrictions at once. None restricts nothing; ids that meet none of ours match nothing."""
        if document_ids is None:
            return self
        wanted = tuple(dict.fromkeys(document_ids))
        if not self.document_ids:
            return replace(self, document_ids=wanted, match_none=self.match_none or not wanted)
        both = tuple(x for x in self.document_ids if x in set(wanted))
        return replace(self, document_ids=both, match_none=self.match_none or not both)

    def column(self, user="user_id", active="is_active", generation="index_generation", search_type="search_type", document="document_id", content="content_type", date="date") -> Column:
        if self.match_none:
            return F.lit(False)
        parts = [F.col(user) == self.user_id, F.col(active)]
        if self.generation is not None:
            parts.append(F.col(generation) == self.generation)
        for name, values in ((search_type, self.search_types), (document, self.document_ids), (content, self.content_types)):
            if values:
                parts.append(F.col(name).isin(list(values)))
        if self.dates:
            parts.append(F.col(date).between(*self.dates))
        return reduce(and_, parts)


def covers(authorized: SearchFilter, business: SearchFilter) -> bool:
    """The business filter sees nothing beyond the authorized one."""
    if business.match_none:
        return True
    if authorized.match_none or (authorized.user_id, authorized.generation) != (business.user_id, business.generation):
        return False
    pairs = ((authorized.search_types, business.search_types), (authorized.document_ids, business.document_ids), (authorized.content_types, business.content_types))
    return all(not a or (b and set(b) <= set(a)) for a, b in pairs)


def page_before(df: DataFrame, order: str, key: str, cursor: tuple | None, size: int) -> DataFrame:
    """One keyset page, newest first: rows before the cursor (order value, key), one more than size."""
    if cursor is not None:
        df = df.where((F.col(order) < F.lit(cursor[0])) | ((F.col(order) == F.lit(cursor[0])) & (F.col(key) < F.lit(cursor[1]))))
    return df.orderBy(F.desc(order), F.desc(key)).limit(size + 1)


def tail_after(df: DataFrame, key: str, after, limit: int) -> DataFrame:
    return df.where(F.col(key) > F.lit(after)).orderBy(key).limit(limit)


def due(df: DataFrame, status: str, wanted: Iterable[str], not_before: str, now, key: str, limit: int) -> DataFrame:
    """Work that is due, first in, first out."""
    return df.where(F.col(status).isin(list(wanted)) & (F.col(not_before) <= F.lit(now))).orderBy(not_before, key).limit(limit)
