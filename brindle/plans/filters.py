"""The filter language: a tree of conditions, JSON at rest, compiled to one column expression."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import paths


@dataclass(frozen=True)
class Filter:
    """kind and its arguments; parts for and, or, not."""

    kind: str
    args: dict = field(default_factory=dict)
    parts: tuple[Filter, ...] = ()

    def to_json(self) -> str:
        return json.dumps(self.plain())

    def plain(self) -> dict:
        return {"kind": self.kind, **({"args": self.args} if self.args else {}), **({"parts": [p.plain() for p in self.parts]} if self.parts else {})}

    @staticmethod
    def from_json(text: str) -> Filter:
        def build(x: dict) -> Filter:
            return Filter(x["kind"], x.get("args", {}), tuple(build(p) for p in x.get("parts", [])))

        return build(json.loads(text))

    def __and__(self, other: Filter) -> Filter:
        return Filter("and", parts=(self, other))

    def __or__(self, other: Filter) -> Filter:
        return Filter("or", parts=(self, other))

    def __invert__(self) -> Filter:
        return Filter("not", parts=(self,))


def where(kind: str, **args) -> Filter:
    return Filter(kind, args)


def kinds(f: Filter) -> list[Filter]:
    return [f, *[x for p in f.parts for x in kinds(p)]]


def compile_filter(f: Filter) -> Column:
    """Over a location's columns; tag and duplicate conditions read the flags that apply_filter joins."""
    a = f.args
    if f.kind == "and":
        return reduce(lambda x, y: x & y, map(compile_filter, f.parts), F.lit(True))
    if f.kind == "or":
        return reduce(lambda x, y: x | y, map(compile_filter, f.parts), F.lit(False))
    if f.kind == "not":
        return ~compile_filter(f.parts[0])
    if f.kind == "file_type":
        return F.lower(paths.category(F.col("extension"))) == a["category"].lower()
    if f.kind == "extension":
        return F.lower("extension") == a["extension"].lower()
    if f.kind in ("size", "allocated"):
        most = min(a["max"], 2**63 - 1)
        return F.col("size_bytes" if f.kind == "size" else "allocated_bytes").between(a["min"], most)
    if f.kind == "modified":
        return F.col("modified_at").between(F.to_timestamp(F.lit(a["start"])), F.to_timestamp(F.lit(a["end"])))
    if f.kind == "stale_for":
        return F.col("accessed_at") < F.to_timestamp(F.lit(a["as_of"])) - F.make_dt_interval(F.lit(a["days"]))
    if f.kind == "wasteful":
        return F.col("allocated_bytes").cast("double") / F.greatest("size_bytes", F.lit(1)) > a["ratio"]
    if f.kind == "build_artifact":
        return paths.in_build_artifact(F.col("path"))
    if f.kind == "tag":
        return F.col(f"has_tag_{a['tag']}")
    if f.kind == "duplicate":
        return F.col("is_duplicate")
    raise ValueError(f"unknown condition {f.kind}")


def apply_filter(locations: DataFrame, f: Filter, tag_links: DataFrame | None = None) -> DataFrame:
    """Locations that match. A flag for each tag and for duplicates comes by a left join, so they may stand under or and not."""
    out = locations
    for tag in sorted({x.args["tag"] for x in kinds(f) if x.kind == "tag"}):
        own = tag_links.where(F.col("tag_id") == tag).select("object_id", F.lit(True).alias("t")).distinct()
        out = out.join(own, "object_id", "left").withColumn(f"has_tag_{tag}", F.coalesce("t", F.lit(False))).drop("t")
    if any(x.kind == "duplicate" for x in kinds(f)):
        twice = locations.groupBy("object_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("object_id", F.lit(True).alias("d"))
        out = out.join(twice, "object_id", "left").withColumn("is_duplicate", F.coalesce("d", F.lit(False))).drop("d")
    return out.where(compile_filter(f)).select(*locations.columns)


def sort_key(name: str, descending: bool = False) -> Column:
    """Nulls first ascending, last descending."""
    columns = {"name": F.col("name"), "size": F.col("size_bytes"), "modified": F.col("modified_at"), "extension": F.col("extension"), "category": paths.category(F.col("extension"))}
    return columns[name].desc_nulls_last() if descending else columns[name].asc_nulls_first()


def parse_query(text: str) -> Filter:
    """type:image extension:txt size:>5MB tag:good duplicate: joined by blanks (and)."""
    parts = []
    for word in text.split():
        key, _, value = word.partition(":")
        if key == "type":
            parts.append(where("file_type", category=value))
        elif key == "extension":
            parts.append(where("extension", extension=value))
        elif key == "size":
            units = {"KB": 1 << 10, "MB": 1 << 20, "GB": 1 << 30, "B": 1}
            number = value.lstrip("<>")
            unit = next((u for u in units if number.upper().endswith(u)), "")
            n = int(float(number[: len(number) - len(unit)]) * units.get(unit, 1))
            parts.append(where("size", min=n + 1, max=2**63 - 1) if value[0] == ">" else where("size", min=0, max=n - 1) if value[0] == "<" else where("size", min=n, max=n))
        elif key == "tag":
            parts.append(where("tag", tag=value))
        elif key == "duplicate":
            parts.append(where("duplicate"))
        else:
            raise ValueError(f"unknown key {key}")
    return Filter("and", parts=tuple(parts))
