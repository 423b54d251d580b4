"""Jaro-Winkler similarity, for which Spark has no function: an Arrow-batched one."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0 if a else 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken = [False] * len(b)
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                left.append(c)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [b[j] for j in range(len(b)) if taken[j]]
    moved = sum(x != y for x, y in zip(left, right, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    same = 0
    while same < min(4, len(a), len(b)) and a[same] == b[same]:
        same += 1
    return jaro + 0.1 * same * (1 - jaro) if jaro > 0.7 else jaro


def jaro_winkler_column(a: Column | str, b: Column | str) -> Column:
    def similar(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in batches:
            yield pd.Series([None if p is None or q is None else jaro_winkler(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    return F.pandas_udf(similar, "double", F.PandasUDFType.SCALAR_ITER)(a, b)
