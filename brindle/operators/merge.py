"""Catalog maintenance as DataFrame in, DataFrame out: upserts, deletes, moves, tags, actions, the inode cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import hashing, paths


def last_of_key(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Of the rows of a key the one with the greatest seq. An aggregate, so that a hot key is summed before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("r")).select(*keys, "r.*")


def upsert_objects(old: DataFrame, batch: DataFrame) -> DataFrame:
    """old: id, kind, mime_type, size_bytes, created_at, updated_at, hash_state; batch has seq too, and its last row of
    an id counts. kind and created_at keep the old value, a null mime_type too; hash_state only rises to content."""
    new = last_of_key(batch, ["id"], "seq").drop("seq").select("id", *[F.col(c).alias(f"n_{c}") for c in ("kind", "mime_type", "size_bytes", "created_at", "updated_at", "hash_state")])
    content = (F.col("hash_state") == "content") | (F.col("n_hash_state") == "content")
    return old.join(new, "id", "full").select(
        "id", F.coalesce("kind", "n_kind").alias("kind"), F.coalesce("n_mime_type", "mime_type").alias("mime_type"),
        F.coalesce("n_size_bytes", "size_bytes").alias("size_bytes"), F.coalesce("created_at", "n_created_at").alias("created_at"),
        F.coalesce("n_updated_at", "updated_at").alias("updated_at"), F.when(content, "content").otherwise(F.coalesce("hash_state", "n_hash_state")).alias("hash_state"),
    )


KEPT_OF_LOCATION = ("id", "parent_id", "created_at")


def upsert_locations(old: DataFrame, batch: DataFrame) -> DataFrame:
    """Key: volume_id and path. A known key keeps its id, parent_id and created_at and takes all else from the batch."""
    keys = ["volume_id", "path"]
    rest = [c for c in old.columns if c not in keys]
    new = last_of_key(batch, keys, "seq").select(*keys, F.struct(*rest).alias("n"))
    both = old.select(*keys, F.struct(*rest).alias("o")).join(new, keys, "full")

    def value(c: str) -> Column:
        pick = F.when(F.col("o").isNotNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")) if c in KEPT_OF_LOCATION else F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
        return pick.alias(c)

    return both.select(*keys, *[value(c) for c in rest])


def delete_locations(locations: DataFrame, gone: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """What stays, where children of deleted rows have no parent, and the deleted rows' object ids."""
    ids = locations.join(gone, on, "left_semi").select(F.col("id").alias("parent_id"), "object_id")
    stay = locations.join(gone, on, "left_anti").join(ids.select("parent_id", F.lit(True).alias("orphan")).distinct(), "parent_id", "left")
    stay = stay.withColumn("parent_id", F.when(F.col("orphan"), None).otherwise(F.col("parent_id"))).drop("orphan")
    return stay.select(*locations.columns), ids.select("object_id").distinct()


def delete_orphan_objects(objects: DataFrame, locations: DataFrame, ids: DataFrame) -> DataFrame:
    """Objects without those of the ids that no location has any more."""
    orphans = ids.join(locations.select("object_id"), "object_id", "left_anti")
    return objects.join(orphans.select(F.col("object_id").alias("id")), "id", "left_anti")


def relocate(locations: DataFrame, moves: DataFrame, cascade: bool = False) -> DataFrame:
    """moves: volume_id, fid, new_path. Metadata stays; cascade also rewrites paths below a moved directory."""
    m = moves.select("volume_id", "fid", "new_path")
    out = locations.join(m, ["volume_id", "fid"], "left")
    if cascade:
        dirs = locations.where("is_directory").join(m, ["volume_id", "fid"]).select("volume_id", F.col("path").alias("above"), F.col("new_path").alias("to"))
        each = out.select("id", F.explode(paths.ancestors(F.col("path"))).alias("above"), "volume_id")
        nearest = each.join(dirs, ["volume_id", "above"]).groupBy("id").agg(F.max(F.struct(F.length("above").alias("n"), "above", "to")).alias("t"))
        out = out.join(nearest, "id", "left").withColumn("new_path", F.coalesce("new_path", F.concat("t.to", F.expr("substring(path, t.n + 1)")))).drop("t")
    new = F.coalesce("new_path", "path")
    name = paths.name(new)
    columns = {"path": new, "name": name, "extension": F.when(~F.col("is_directory"), paths.extension(name)), "id": F.when(F.col("new_path").isNull(), F.col("id")).otherwise(hashing.location_id(F.col("volume_id"), new))}
    return out.withColumns(columns).select(*locations.columns)


def upgrade_deferred(locations: DataFrame, mapping: DataFrame) -> DataFrame:
    """Locations re-pointed from old_id to new_id."""
    m = mapping.where("old_id <> new_id").select(F.col("old_id").alias("object_id"), "new_id")
    return locations.join(m, "object_id", "left").withColumn("object_id", F.coalesce("new_id", "object_id")).select(*locations.columns)


def add_tags(links: DataFrame, tag: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The links, and those of them that are new."""
    fresh = ids.select(F.lit(tag).alias("tag_id"), "object_id").distinct().join(links, ["tag_id", "object_id"], "left_anti")
    return links.select("tag_id", "object_id").unionByName(fresh), fresh


def remove_tags(links: DataFrame, tag: str, ids: DataFrame) -> DataFrame:
    return links.join(ids.select(F.lit(tag).alias("tag_id"), "object_id"), ["tag_id", "object_id"], "left_anti")


def cached_hashes(entries: DataFrame, cache: DataFrame) -> DataFrame:
    """entries (volume_id, inode, mtime, size) with their cache key and the cached object_id, null if unknown."""
    keyed = entries.withColumn("key", hashing.inode_key(F.col("volume_id"), F.col("inode"), F.col("mtime"), F.col("size")))
    return keyed.join(cache.select("key", "object_id"), "key", "left")


def smart_rename(locations: DataFrame, template: str) -> DataFrame:
    """path and new_name: {year}, {month}, {day} of modified_at and {original}, the name without extension, put in; the extension stays."""
    if not any(p in template for p in ("{year}", "{month}", "{day}", "{original}")):
        raise ValueError("the template needs a placeholder")
    stem = F.when(F.col("extension").isNotNull(), F.expr("substring(name, 1, length(name) - length(extension) - 1)")).otherwise(F.col("name"))
    out = F.lit(template)
    for part, value in (("{year}", F.date_format("modified_at", "yyyy")), ("{month}", F.date_format("modified_at", "MM")), ("{day}", F.date_format("modified_at", "dd")), ("{original}", stem)):
        out = F.replace(out, F.lit(part), value)
    return locations.select("path", F.concat(out, F.coalesce(F.concat(F.lit("."), F.col("extension")), F.lit(""))).alias("new_name"))
