"""Read queries over a catalog: summaries, top lists, duplicates, stale files, pages of a directory, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import paths


def is_file() -> Column:
    return ~F.col("is_directory")


def volume_summary(locations: DataFrame, volume: str) -> DataFrame:
    """Always one row, zeros for an empty volume."""
    own = locations.where(F.col("volume_id") == volume)
    size, alloc = F.when(is_file(), F.col("size_bytes")), F.when(is_file(), F.col("allocated_bytes"))
    zero = F.lit(0).cast("long")
    return own.agg(
        F.count(F.when(is_file(), 1)).alias("total_files"), F.count(F.when(F.col("is_directory"), 1)).alias("total_dirs"),
        F.coalesce(F.sum(size), zero).alias("total_bytes"), F.coalesce(F.sum(alloc), zero).alias("total_allocated"),
        F.coalesce(F.sum(alloc - size), zero).alias("wasted_bytes"),
    )


def top_largest_files(locations: DataFrame, volume: str, n: int = 50) -> DataFrame:
    own = locations.where((F.col("volume_id") == volume) & is_file() & (F.col("size_bytes") > 0))
    return own.orderBy(F.desc("size_bytes"), "path").limit(n).select("path", "name", "size_bytes", "allocated_bytes", "object_id")


def duplicates_report(locations: DataFrame, objects: DataFrame, volume: str, n: int = 50) -> DataFrame:
    """Contents at several places of a volume, by the bytes that copies waste. The group comes before the join with objects."""
    own = locations.where((F.col("volume_id") == volume) & is_file() & (F.col("size_bytes") > 0))
    groups = own.groupBy("object_id").agg(F.count(F.lit(1)).alias("location_count"), F.max("size_bytes").alias("size_bytes")).where("location_count > 1")
    hashed = objects.where("hash_state = 'content'").select("object_id")
    out = groups.join(hashed, "object_id", "left_semi").withColumn("wasted_bytes", (F.col("location_count") - 1) * F.col("size_bytes"))
    return out.orderBy(F.desc("wasted_bytes"), "object_id").limit(n)


def duplicate_locations(locations: DataFrame, object_id: Column) -> DataFrame:
    return locations.where(F.col("object_id") == object_id).select("volume_id", "path").orderBy("path")


def type_breakdown(locations: DataFrame, file_types: DataFrame, volume: str) -> DataFrame:
    own = locations.where((F.col("volume_id") == volume) & is_file()).select(F.lower("extension").alias("e"), "size_bytes")
    by = own.groupBy("e").agg(F.count(F.lit(1)).alias("n"), F.sum("size_bytes").alias("b"))  # one row an extension before the join
    known = by.join(F.broadcast(file_types), by.e == file_types.extension, "left")
    keys = [F.coalesce("category", F.lit("Other")).alias("category"), F.coalesce("color", F.lit("#9E9E9E")).alias("color")]
    return known.groupBy(*keys).agg(F.sum("n").alias("file_count"), F.sum("b").alias("total_bytes"))


def stale_files(locations: DataFrame, volume: str, days: int, as_of: str, n: int = 50) -> DataFrame:
    now = F.to_timestamp(F.lit(as_of))
    own = locations.where((F.col("volume_id") == volume) & is_file() & (F.col("modified_at") < now - F.make_dt_interval(F.lit(days))))
    age = F.timestamp_diff("DAY", F.col("modified_at"), now).alias("days_stale")
    return own.select("path", "name", "extension", "size_bytes", age).orderBy(F.desc("size_bytes"), "path").limit(n)


def list_page(locations: DataFrame, objects: DataFrame, parent: str | None, cursor: str | None, n: int) -> DataFrame:
    """Children of a directory in name order, after the cursor. The page is cut before the join with objects."""
    own = locations.where(F.col("parent_id").eqNullSafe(F.lit(parent).cast("string")))
    if cursor is not None:
        own = own.where(F.col("name") > cursor)
    page = own.orderBy("name", "volume_id").limit(n)
    return page.join(objects.select("object_id", "kind", "mime_type"), "object_id").select("name", "path", "is_directory", "size_bytes", "allocated_bytes", "kind", "mime_type")


def build_artifacts(locations: DataFrame, dir_sizes: DataFrame, volume: str, n: int = 50) -> DataFrame:
    dirs = locations.where((F.col("volume_id") == volume) & F.col("is_directory") & paths.is_build_artifact(F.col("name")))
    zero = F.lit(0).cast("long")
    out = dirs.join(dir_sizes.select(F.col("location_id").alias("id"), "total_bytes", "file_count"), "id", "left").select(
        "path", "name", F.coalesce("total_bytes", zero).alias("total_bytes"), F.coalesce("file_count", zero).alias("file_count"), F.lower("name").alias("pattern")
    )
    return out.orderBy(F.desc("total_bytes"), "path").limit(n)


def deferred_batch(locations: DataFrame, objects: DataFrame, n: int) -> DataFrame:
    """Deferred objects with the columns of their location of least path."""
    first = locations.groupBy("object_id").agg(F.min(F.struct("path", "volume_id", "size_bytes", "fid", "modified_at")).alias("m"))
    due = objects.where("hash_state = 'deferred'").select("object_id")
    return first.join(due, "object_id", "left_semi").select("object_id", "m.*").orderBy("object_id").limit(n)


def tokens(locations: DataFrame) -> DataFrame:
    """The inverted index: location id, column, place, term. Terms are runs of letters and digits, lower-cased."""
    cols = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("name", "path", "extension")])
    each = locations.select("id", F.explode(cols).alias("c")).where("c.value IS NOT NULL")
    terms = F.filter(F.split(F.lower("c.value"), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    return each.select("id", F.col("c.field").alias("field"), F.posexplode(terms).alias("place", "term"))


def search(locations: DataFrame, query: str, field: str | None = None) -> DataFrame:
    """Ids that match: blanks mean AND, a trailing * a prefix, double quotes a phrase, OR alternatives, NOT exclusion."""
    index = tokens(locations)
    if field:
        index = index.where(F.col("field") == field)
    if " OR " in query:
        left, right = query.split(" OR ", 1)
        return search(locations, left, field).unionByName(search(locations, right, field)).distinct()
    if " NOT " in query:
        left, right = query.split(" NOT ", 1)
        return search(locations, left, field).join(search(locations, right, field), "id", "left_anti")
    if query.startswith('"'):
        words = [w for w in query.strip('"').lower().split()]
        wanted = F.array(*map(F.lit, words))
        placed = index.where(F.col("term").isin(words)).withColumn("nth", F.explode(F.sequence(F.lit(1), F.lit(len(words))))).where(F.get(wanted, F.col("nth") - 1) == F.col("term"))
        whole = placed.groupBy("id", "field", (F.col("place") - F.col("nth")).alias("start")).agg(F.count_distinct("nth").alias("n"))
        return whole.where(F.col("n") == len(words)).select("id").distinct()
    words = query.lower().split()
    tests = [F.col("term").startswith(w[:-1]) if w.endswith("*") else F.col("term") == w for w in words]
    hits = index.select("id", *[t.alias(f"t{i}") for i, t in enumerate(tests)]).where(" OR ".join(f"t{i}" for i in range(len(tests))))
    found = hits.groupBy("id").agg(*[F.max(f"t{i}").alias(f"t{i}") for i in range(len(tests))])
    return found.where(" AND ".join(f"t{i}" for i in range(len(tests)))).select("id")
