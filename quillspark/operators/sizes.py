"""Proven sizes: what may be broadcast, by bytes that were counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a side up to which it is broadcast.
BROADCAST_BYTES = 64 << 20


def row_bytes(df: DataFrame):
    """Bytes of a row, about: its texts and arrays as they are, 8 for anything else."""
    size = lambda c, t: F.octet_length(c) if isinstance(t, (T.StringType, T.BinaryType)) else F.size(c) * 8 if isinstance(t, T.ArrayType) else F.lit(8)
    return sum((F.coalesce(size(f.name, f.dataType), F.lit(0)) for f in df.schema.fields), F.lit(16))


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether all rows together stay under limit bytes. df is computed for it: hand over what was written or is cheap."""
    return (df.agg(F.sum(row_bytes(df))).first()[0] or 0) <= limit


def checked_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its bytes allow it; else as it is, for a shuffled join."""
    return F.broadcast(df) if small(df, limit) else df
