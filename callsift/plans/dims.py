"""Size-checked broadcasting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What a broadcast side may hold, by an estimate from its schema.
MAX_BROADCAST_BYTES = 64 << 20
_STRING_BYTES = 64


def row_bytes(schema: T.StructType) -> int:
    """A rough size of a row: 16 bytes a fixed-width value, more for text."""
    return 16 + sum(_STRING_BYTES if isinstance(f.dataType, (T.StringType, T.BinaryType)) else 16 for f in schema.fields)


def read_configuration(df: DataFrame, what: str) -> list[Row]:
    """All rows of a table that every task receives (rules, hierarchy). Raises
    ValueError if they are over MAX_BROADCAST_BYTES; no more rows than could
    fit are read."""
    most = MAX_BROADCAST_BYTES // row_bytes(df.schema)
    rows = df.limit(most + 1).collect()
    if len(rows) > most or sum(len(str(v)) for r in rows for v in r) > MAX_BROADCAST_BYTES:
        raise ValueError(f"{what}: over {most} rows or {MAX_BROADCAST_BYTES} bytes; every task receives this table")
    return rows


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if its rows, counted up to the bound, fit
    into MAX_BROADCAST_BYTES; otherwise as it is, and the planner shuffles
    (adaptive execution may still switch). The result of a join is the same."""
    most = MAX_BROADCAST_BYTES // row_bytes(df.schema)
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
