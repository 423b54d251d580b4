"""Actions on a catalog as DataFrames of their effects: nothing here touches user files."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import hashing, paths

UNDO_DEPTH = 50


class UndoStack:
    """Inverse actions, the latest first; the oldest goes when there are too many."""

    def __init__(self, depth: int = UNDO_DEPTH) -> None:
        self._entries: deque[dict] = deque(maxlen=depth)

    def push(self, inverse: dict) -> None:
        self._entries.append(inverse)

    def pop(self) -> dict | None:
        return self._entries.pop() if self._entries else None

    def __len__(self) -> int:
        return len(self._entries)


def copies(locations: DataFrame, plan: DataFrame) -> DataFrame:
    """New rows for plan's (volume_id, path, new_path): the same object at another place; allocated as many bytes as it has."""
    name = paths.name(F.col("new_path"))
    return locations.join(plan, ["volume_id", "path"]).select(
        hashing.location_id(F.col("volume_id"), F.col("new_path")).alias("id"), "object_id", "volume_id", F.col("new_path").alias("path"), name.alias("name"),
        paths.extension(name).alias("extension"), "size_bytes", F.col("size_bytes").alias("allocated_bytes"),
    )


def new_directories(plan: DataFrame) -> DataFrame:
    """Rows for plan's (volume_id, path), without a parent."""
    return plan.select(
        hashing.location_id(F.col("volume_id"), F.col("path")).alias("id"), hashing.directory_id(F.col("path")).alias("object_id"), "volume_id", "path", paths.name(F.col("path")).alias("name"),
        F.lit(True).alias("is_directory"), F.lit(0).cast("long").alias("size_bytes"), F.lit(None).cast("string").alias("parent_id"),
    )


def share_plan(referenced: DataFrame) -> DataFrame:
    """Which duplicates could share the blocks of their group's reference: source, destination, bytes."""
    source = referenced.where("is_reference").select("group", F.col("path").alias("source"), F.col("size_bytes").alias("s"))
    return referenced.where("NOT is_reference").join(source, "group").where("size_bytes = s").select("source", F.col("path").alias("destination"), F.col("size_bytes").alias("bytes"))


def bulk_tag(operation: str, tag: str, ids: DataFrame, links: DataFrame) -> DataFrame:
    from brindle.operators import merge

    if operation not in ("add", "remove") or not tag:
        raise ValueError("an operation (add or remove) and a tag are needed")
    return merge.add_tags(links, tag, ids)[0] if operation == "add" else merge.remove_tags(links, tag, ids)


def content_ids(volume: Column, path: Column, fid: Column, mtime: Column, size: Column, is_directory: Column, cached: Column, content: Column, defer: Column) -> Column:
    """The rules in order: directories by path, known ones by the cache, empty ones, deferred ones, then contents."""
    return (
        F.when(is_directory, hashing.directory_id(path)).when(cached.isNotNull(), cached).when(size == 0, F.sha2(F.lit(""), 256))
        .when(defer, hashing.deferred_id(volume, fid, mtime, size)).otherwise(hashing.content_id(content))
    )


def save_cursors(old: DataFrame, new: DataFrame) -> DataFrame:
    """volume_key, cursor: the new one where there is one."""
    n = new.select("volume_key", F.col("cursor").alias("n"))
    return old.join(n, "volume_key", "full").select("volume_key", F.coalesce("n", "cursor").alias("cursor"))


def may(expires_at: Column, permissions: Column, permission: str, revoked: Column, as_of: Column) -> Column:
    """Whether a capability holds: not expired, not revoked, and it has the permission."""
    return (expires_at > as_of) & ~revoked & F.array_contains(permissions, permission)
