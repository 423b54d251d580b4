"""Directory trees: exact roll-ups, ancestor chains, path reconstruction, closures, deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions import hashing, paths


def dir_sizes(locations: DataFrame, volume: str | None = None) -> DataFrame:
    """location_id, file_count and total_bytes and allocated_bytes of direct files, cumulative_allocated of all below.

    One aggregation over exploded ancestors, at any depth; files of one directory are summed before they fan out.
    """
    own = locations if volume is None else locations.where(F.col("volume_id") == volume)
    size, alloc = (F.when(~F.col("is_directory"), F.col(c)).otherwise(0) for c in ("size_bytes", "allocated_bytes"))
    direct = own.where("parent_path IS NOT NULL").groupBy("volume_id", "parent_path").agg(
        F.count(F.when(~F.col("is_directory"), 1)).alias("n"), F.sum(size).alias("b"), F.sum(alloc).alias("a")
    )
    up = F.concat(paths.ancestors(F.col("parent_path")), F.array("parent_path"))
    fanned = direct.select("volume_id", F.explode(up).alias("path"), "parent_path", "n", "b", "a")
    self = F.col("path") == F.col("parent_path")
    out = fanned.groupBy("volume_id", "path").agg(
        F.sum(F.when(self, F.col("n")).otherwise(0)).alias("file_count"), F.sum(F.when(self, F.col("b")).otherwise(0)).alias("total_bytes"),
        F.sum(F.when(self, F.col("a")).otherwise(0)).alias("allocated_bytes"), F.sum("a").alias("cumulative_allocated"),
    )
    return out.select(hashing.location_id(F.col("volume_id"), F.col("path")).alias("location_id"), "volume_id", "path", "file_count", "total_bytes", "allocated_bytes", "cumulative_allocated")


def ancestor_chain(locations: DataFrame, volume: str, path: str) -> DataFrame:
    """level (1: the parent), id and path of each directory above."""
    return locations.sparkSession.sql(
        """WITH RECURSIVE chain(level, id, parent_id, path) AS (
             SELECT 0, id, parent_id, path FROM {l} WHERE volume_id = {v} AND path = {p}
             UNION ALL SELECT c.level + 1, l.id, l.parent_id, l.path FROM chain c JOIN {l} l ON l.id = c.parent_id)
           SELECT level, id, path FROM chain WHERE level > 0""",
        l=locations.select("id", "parent_id", "path", "volume_id"), v=volume, p=path,
    )


def full_paths(topology: DataFrame) -> DataFrame:
    """fid and path of every entry that a root reaches. topology: fid, parent_fid, name; a root is its own parent."""
    return topology.sparkSession.sql(
        """WITH RECURSIVE tree(fid, path, depth) AS (
             SELECT fid, name, 0 FROM {t} WHERE fid = parent_fid
             UNION ALL SELECT t.fid, concat(p.path, '/', t.name), p.depth + 1 FROM tree p JOIN {t} t ON t.parent_fid = p.fid AND t.fid <> t.parent_fid)
           SELECT fid, path, depth FROM tree""",
        t=topology,
    )


def closure(tree: DataFrame) -> DataFrame:
    """ancestor, descendant, depth of a tree of id, parent_id; each node is its own ancestor at depth 0."""
    return tree.sparkSession.sql(
        """WITH RECURSIVE c(ancestor, descendant, depth) AS (
             SELECT id, id, 0 FROM {t} UNION ALL SELECT c.ancestor, t.id, c.depth + 1 FROM c JOIN {t} t ON t.parent_id = c.descendant)
           SELECT ancestor, descendant, depth FROM c""",
        t=tree,
    )


def bubble_up(deltas: DataFrame) -> DataFrame:
    """Sums of deltas for every directory above. deltas: volume_id, path, files, bytes, allocated."""
    fanned = deltas.select("volume_id", F.explode(paths.ancestors(F.col("path"))).alias("path"), "files", "bytes", "allocated")
    return fanned.groupBy("volume_id", "path").agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes"), F.sum("allocated").alias("allocated"))


def floored_totals(deltas: DataFrame, key: str, seq: str, value: str) -> DataFrame:
    """key and total after its deltas in order, never below zero after any of them.

    The total is a maximum over suffix sums (Lindley's recursion), so it needs a window instead of a list for each key.
    """
    from pyspark.sql import Window as W

    after = W.partitionBy(key).orderBy(F.desc(seq))
    sums = deltas.select(key, F.sum(value).over(after).alias("s"))
    return sums.groupBy(key).agg(F.greatest(F.max("s"), F.lit(0)).cast("long").alias("total"))
