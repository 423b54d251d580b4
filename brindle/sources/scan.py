"""Rows for a catalog from a folder of any file system that Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import hashing, paths


def scan_files(spark: SparkSession, root: str, volume: str, with_content: bool = False) -> DataFrame:
    """volume_id, path (below root), name, extension, size_bytes, allocated_bytes, modified_at, id; contents only if asked for:
    the reader skips them otherwise. Spark's reader leaves out empty files and names that begin with . or _; directories are the paths' ancestors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    below = F.regexp_replace("path", "^[a-z0-9]+:/*", "/")
    base = "/" + root.split(":", 1)[-1].strip("/")
    path = F.when(below.startswith(base), F.expr(f"substring(regexp_replace(path, '^[a-z0-9]+:/*', '/'), {len(base) + 1})")).otherwise(below)
    out = files.select(
        F.lit(volume).alias("volume_id"), path.alias("path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"), *["content"] * with_content
    )
    name = paths.name(F.col("path"))
    return out.withColumns(
        {"name": name, "extension": paths.extension(name), "allocated_bytes": paths.allocated(F.col("size_bytes")), "id": hashing.location_id(F.col("volume_id"), F.col("path"))}
    )
