"""Parts of a table that a task's memory holds, however large the table is."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows of a part, about.
ROWS = 1 << 17


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by key in parts of ROWS rows or so: as many as the table asks for, where the number of shuffle partitions is
    fixed. Rows are counted for it, so this is for tables as they are read. One key's rows stay together."""
    n = -(-df.count() // ROWS)
    return df.repartition(n, *keys) if n > 1 else df
