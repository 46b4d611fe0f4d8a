"""Newest row per key, without a window over the copies of one key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def latest_version(df: DataFrame, keys: Sequence[str], version: str | Sequence[str]) -> DataFrame:
    """One row per key: the highest version, remaining ties by the other columns, maps last.

    The largest row is combined before the shuffle, so a key redelivered any number
    of times sends one row per task. It is held and sent once: the columns are read from
    what is compared, maps as their sorted entries.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    maps = [f.name for f in df.schema.fields if f.name in rest and isinstance(f.dataType, T.MapType)]
    first = [c for c in ([version] if isinstance(version, str) else version) if c in rest]
    order = [*first, *[c for c in rest if c not in first and c not in maps]]
    entries = [F.array_sort(F.map_entries(m)).alias(m) for m in maps]
    newest = F.max(F.struct(*order, *entries)).alias("_row")
    back = [
        F.map_from_entries(f"_row.{c}").alias(c) if c in maps else F.col(c if c in keys else f"_row.{c}").alias(c) for c in df.columns
    ]
    return df.groupBy(*keys).agg(newest).select(*back)
