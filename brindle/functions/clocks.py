"""Vector clocks: maps from device to counter; a missing device counts as 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def merge(a: Column, b: Column) -> Column:
    return F.map_zip_with(a, b, lambda k, x, y: F.greatest(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))))


def order(a: Column, b: Column) -> Column:
    """less, greater, equal, or null if neither knows all of the other."""
    diffs = F.map_values(F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0))))
    less, more = F.exists(diffs, lambda d: d < 0), F.exists(diffs, lambda d: d > 0)
    return F.when(less & more, F.lit(None)).when(less, "less").when(more, "greater").otherwise("equal")


def increment(clock: Column, device: str) -> Column:
    one = F.create_map(F.lit(device), F.lit(1).cast("long"))
    return F.map_zip_with(clock, one, lambda k, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))
