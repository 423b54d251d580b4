"""Squarified treemaps: sequential within a parent, parallel across parents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame


def squarify(weights: list[float], x: float, y: float, w: float, h: float) -> list[tuple[float, float, float, float]]:
    """Rectangles of areas in proportion to descending positive weights. Rows run along the shorter side; a row takes
    the next weight as long as its worst aspect ratio doesn't grow."""
    total = sum(weights)
    areas = [v * w * h / total for v in weights]
    out, i = [], 0
    while i < len(areas):
        side, rest = min(w, h), w >= h
        row, worst = areas[i], None
        end = i
        while end < len(areas):
            trial = row if end == i else row + areas[end]
            ratio = max(side * side * areas[i] / trial**2, trial**2 / (side * side * areas[end]))
            if worst is not None and ratio > worst:
                break
            row, worst, end = trial, ratio, end + 1
        thick, at = row / side, 0.0
        for a in areas[i:end]:
            length = a / thick
            out.append((x, y + at, thick, length) if rest else (x + at, y, length, thick))
            at += length
        x, y, w, h = (x + thick, y, w - thick, h) if rest else (x, y + thick, w, h - thick)
        i = end
    return out


def treemap(items: DataFrame, width: float = 100.0, height: float = 100.0) -> DataFrame:
    """items: parent, id, weight. One rectangle an item of positive weight, in its parent's width x height."""

    def lay(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[rows.weight > 0].sort_values(["weight", "id"], ascending=[False, True])
        boxes = squarify(rows.weight.tolist(), 0.0, 0.0, width, height) if len(rows) else []
        return pd.DataFrame({"parent": rows.parent, "id": rows.id}).assign(**{c: [b[i] for b in boxes] for i, c in enumerate("xywh")})

    return items.select("parent", "id", "weight").groupBy("parent").applyInPandas(lay, "parent string, id string, x double, y double, w double, h double")
