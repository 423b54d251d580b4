"""All queries of the library over the test tables, each with DuckDB SQL for the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import clocks, hashing, paths
from brindle.functions.similarity import jaro_winkler_column
from brindle.operators import actions, dedup, hierarchy, merge, reports, treemap
from brindle.plans import filters
from brindle.sources.corpus import AS_OF, CATALOG_SQL, Corpus
from brindle.streaming import changes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
A_DIR = "/docs/src1/en"


def query(name: str, sql: str | None = None, catalog: bool = True):
    """Registers f(corpus). catalog: the SQL goes on after the catalog's common table expressions."""

    def add(f: Callable[[Corpus], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Corpus(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = f"{CATALOG_SQL}\n{sql}" if catalog else sql
        return f

    return add


def stamp(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


# --- reports -------------------------------------------------------------------------------------------------------


@query("catalog_locations", "SELECT id, object_id, volume_id, path, name, extension, parent_id, is_directory, size_bytes, allocated_bytes, strftime(modified_at, '%Y-%m-%d %H:%M:%S') AS modified_at, fid, hash_state FROM locations")
def _(c):
    return c.locations.select("id", "object_id", "volume_id", "path", "name", "extension", "parent_id", "is_directory", "size_bytes", "allocated_bytes", stamp("modified_at"), "fid", "hash_state")


@query("catalog_objects", "SELECT * FROM objects")
def _(c):
    return c.objects


@query("list_page", f""", page AS (SELECT * FROM locations WHERE parent_id = sha256('docs:{A_DIR}') AND name > 'doc_2' ORDER BY name, volume_id LIMIT 25)
SELECT name, path, is_directory, page.size_bytes, allocated_bytes, kind, mime_type FROM page JOIN objects USING (object_id)""")  # fmt: skip
def _(c):
    parent = c.spark.range(1).select(hashing.location_id(F.lit("docs"), F.lit(A_DIR))).first()[0]
    return reports.list_page(c.locations, c.objects, parent, "doc_2", 25)


@query("list_roots", """, page AS (SELECT * FROM locations WHERE parent_id IS NULL ORDER BY name, volume_id LIMIT 25)
SELECT name, path, is_directory, page.size_bytes, allocated_bytes, kind, mime_type FROM page JOIN objects USING (object_id)""")  # fmt: skip
def _(c):
    return reports.list_page(c.locations, c.objects, None, None, 25)


_tokens = r""", tok AS (SELECT id, field, term, place FROM (SELECT id, field, list_filter_empty AS terms FROM (
  SELECT id, field, regexp_split_to_array(trim(regexp_replace(lower(value), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS list_filter_empty FROM (
    SELECT id, 'name' AS field, name AS value FROM locations UNION ALL SELECT id, 'path', path FROM locations UNION ALL SELECT id, 'extension', extension FROM locations) WHERE value IS NOT NULL)) t, unnest(terms) WITH ORDINALITY AS u(term, place) WHERE term <> '')"""


@query("search_and", _tokens + " SELECT id FROM tok GROUP BY id HAVING bool_or(term = 'src1') AND bool_or(term = 'en')")
def _(c):
    return reports.search(c.locations, "src1 en")


@query("search_prefix", _tokens + " SELECT DISTINCT id FROM tok WHERE term LIKE 'assist%'")
def _(c):
    return reports.search(c.locations, "assist*")


@query("search_phrase", _tokens + " SELECT DISTINCT a.id FROM tok a JOIN tok b ON a.id = b.id AND a.field = b.field AND b.place = a.place + 1 WHERE a.term = 'src2' AND b.term = 'fr'")
def _(c):
    return reports.search(c.locations, '"src2 fr"')


@query("search_or_field", _tokens + " SELECT DISTINCT id FROM tok WHERE field = 'extension' AND term IN ('json', 'html')")
def _(c):
    return reports.search(c.locations, "json OR html", "extension")


@query("search_not", _tokens + " SELECT id FROM tok GROUP BY id HAVING bool_or(term = 'docs') AND NOT bool_or(term = 'en')")
def _(c):
    return reports.search(c.locations, "docs NOT en")


@query("locations_per_object", "SELECT object_id, count(*) AS locations FROM locations GROUP BY object_id")
def _(c):
    return c.locations.groupBy("object_id").agg(F.count(F.lit(1)).alias("locations"))


@query("volume_summary", """SELECT count(*) FILTER (NOT is_directory) AS total_files, count(*) FILTER (is_directory) AS total_dirs, CAST(sum(size_bytes) AS BIGINT) AS total_bytes,
CAST(sum(allocated_bytes) AS BIGINT) AS total_allocated, CAST(sum(allocated_bytes - size_bytes) AS BIGINT) AS wasted_bytes FROM locations WHERE volume_id = 'docs'""")  # fmt: skip
def _(c):
    return reports.volume_summary(c.locations, "docs")


@query("top_largest_files", "SELECT path, name, size_bytes, allocated_bytes, object_id FROM locations WHERE volume_id = 'docs' AND NOT is_directory AND size_bytes > 0 ORDER BY size_bytes DESC, path LIMIT 50")
def _(c):
    return reports.top_largest_files(c.locations, "docs")


_dirs = """, up AS (SELECT l.volume_id, l.size_bytes, l.allocated_bytes, l.is_directory, l.parent_path, array_to_string(p[1:i], '/') AS path
  FROM (SELECT *, string_split(parent_path || '/x', '/') AS p FROM locations WHERE parent_path IS NOT NULL) l, unnest(range(2, len(p))) AS u(i)
), dir_sizes AS (SELECT sha256(volume_id || ':' || path) AS location_id, volume_id, path,
  count(*) FILTER (path = parent_path AND NOT is_directory) AS file_count, CAST(coalesce(sum(size_bytes) FILTER (path = parent_path AND NOT is_directory), 0) AS BIGINT) AS total_bytes,
  CAST(coalesce(sum(allocated_bytes) FILTER (path = parent_path AND NOT is_directory), 0) AS BIGINT) AS allocated_bytes, CAST(coalesce(sum(allocated_bytes) FILTER (NOT is_directory), 0) AS BIGINT) AS cumulative_allocated
  FROM up GROUP BY volume_id, path)"""


@query("dir_sizes", _dirs + " SELECT * FROM dir_sizes")
def _(c):
    return hierarchy.dir_sizes(c.locations)


@query("dir_sizes_of_volume", _dirs + " SELECT location_id, cumulative_allocated FROM dir_sizes WHERE volume_id = 'web'")
def _(c):
    return hierarchy.dir_sizes(c.locations, "web").select("location_id", "cumulative_allocated")


@query("top_largest_dirs", _dirs + " SELECT path, file_count, total_bytes, cumulative_allocated FROM dir_sizes WHERE volume_id = 'docs' ORDER BY cumulative_allocated DESC, path LIMIT 10")
def _(c):
    return hierarchy.dir_sizes(c.locations, "docs").orderBy(F.desc("cumulative_allocated"), "path").limit(10).select("path", "file_count", "total_bytes", "cumulative_allocated")


@query("wasted_space", _dirs + """ SELECT path, total_bytes, allocated_bytes, allocated_bytes - total_bytes AS wasted_bytes, round(CAST(allocated_bytes AS DOUBLE) / greatest(total_bytes, 1), 6) AS waste_ratio
FROM dir_sizes WHERE volume_id = 'docs' AND total_bytes > 0 ORDER BY allocated_bytes - total_bytes DESC, path LIMIT 20""")  # fmt: skip
def _(c):
    d = hierarchy.dir_sizes(c.locations, "docs").where("total_bytes > 0").withColumn("wasted_bytes", F.expr("allocated_bytes - total_bytes"))
    ratio = F.round(F.col("allocated_bytes").cast("double") / F.greatest("total_bytes", F.lit(1)), 6).alias("waste_ratio")
    return d.orderBy(F.desc("wasted_bytes"), "path").limit(20).select("path", "total_bytes", "allocated_bytes", "wasted_bytes", ratio)


@query("duplicates_report", """SELECT object_id, count(*) AS location_count, max(l.size_bytes) AS size_bytes, (count(*) - 1) * max(l.size_bytes) AS wasted_bytes FROM locations l JOIN objects o USING (object_id)
WHERE volume_id = 'docs' AND NOT is_directory AND l.size_bytes > 0 AND o.hash_state = 'content' GROUP BY object_id HAVING count(*) > 1 ORDER BY wasted_bytes DESC, object_id LIMIT 50""")  # fmt: skip
def _(c):
    return reports.duplicates_report(c.locations, c.objects, "docs")


@query("duplicate_locations", """SELECT volume_id, path FROM locations WHERE object_id IN (SELECT object_id FROM locations WHERE path = '/docs/src0/en/doc_0.txt' UNION SELECT min(object_id) FROM (SELECT object_id FROM locations GROUP BY 1 HAVING count(*) > 1))""")
def _(c):
    l = c.locations  # noqa: E741
    twice = l.groupBy("object_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.min("object_id").alias("object_id"))
    ids = l.where("path = '/docs/src0/en/doc_0.txt'").select("object_id").unionByName(twice).distinct()
    return l.join(F.broadcast(ids), "object_id", "left_semi").select("volume_id", "path")  # two ids


@query("type_breakdown", """, n AS (SELECT * REPLACE ('all' AS volume_id, CASE fid % 5 WHEN 0 THEN 'xyz' WHEN 1 THEN 'JPG' ELSE extension END AS extension) FROM locations WHERE fid IS NOT NULL)
SELECT coalesce(category, 'Other') AS category, coalesce(color, '#9E9E9E') AS color, count(*) AS file_count, CAST(sum(size_bytes) AS BIGINT) AS total_bytes
FROM n l LEFT JOIN file_types t ON lower(l.extension) = t.extension WHERE NOT is_directory GROUP BY 1, 2""")  # fmt: skip
def _(c):
    # the files of all volumes, some under other extensions: known ones in other case, and unknown ones
    other = F.when(F.col("fid") % 5 == 0, "xyz").when(F.col("fid") % 5 == 1, "JPG").otherwise(F.col("extension"))
    return reports.type_breakdown(c.locations.where("fid IS NOT NULL").withColumns({"volume_id": F.lit("all"), "extension": other}), c.file_types, "all")


@query("stale_files", f"""SELECT path, name, extension, size_bytes, CAST(date_sub('day', modified_at, TIMESTAMP '{AS_OF}') AS BIGINT) AS days_stale FROM locations
WHERE volume_id = 'docs' AND NOT is_directory AND modified_at < TIMESTAMP '{AS_OF}' - INTERVAL 365 DAY ORDER BY size_bytes DESC, path LIMIT 50""")  # fmt: skip
def _(c):
    return reports.stale_files(c.locations, "docs", 365, AS_OF)


@query("build_artifacts", """, n AS (SELECT * FROM (VALUES ('node_modules', 1), ('Target', 2), ('src', 3)) t(name, m)), f AS (SELECT '/v/' || n.name AS dir, size_bytes FROM locations, n WHERE fid IS NOT NULL AND fid % 4 = m)
SELECT dir AS path, substr(dir, 4) AS name, CAST(sum(size_bytes) AS BIGINT) AS total_bytes, count(*) AS file_count, lower(substr(dir, 4)) AS pattern FROM f WHERE dir <> '/v/src' GROUP BY dir""")  # fmt: skip
def _(c):
    names = F.get(F.array(F.lit("node_modules"), F.lit("Target"), F.lit("src")), (F.col("fid") % 4 - 1).cast("int"))
    placed = c.locations.where("fid IS NOT NULL AND fid % 4 > 0").select(F.concat(F.lit("/v/"), names).alias("parent_path"), "size_bytes", "allocated_bytes", F.lit(False).alias("is_directory"), F.lit("v").alias("volume_id"))
    sizes = hierarchy.dir_sizes(placed)
    dirs = placed.select("volume_id", F.col("parent_path").alias("path")).distinct().select(hashing.location_id(F.col("volume_id"), F.col("path")).alias("id"), "volume_id", "path", paths.name(F.col("path")).alias("name"), F.lit(True).alias("is_directory"))
    return reports.build_artifacts(dirs, sizes, "v")


@query("ancestor_chain", f""", chain AS (SELECT 0 AS level, id, parent_id, path FROM locations WHERE path = (SELECT min(path) FROM locations WHERE volume_id = 'docs' AND NOT is_directory)
UNION ALL SELECT c.level + 1, l.id, l.parent_id, l.path FROM chain c JOIN locations l ON l.id = c.parent_id) SELECT level, id, path FROM chain WHERE level > 0""")  # fmt: skip
def _(c):
    first = c.locations.where("volume_id = 'docs' AND NOT is_directory").agg(F.min("path")).first()[0]
    return hierarchy.ancestor_chain(c.locations, "docs", first)


@query("pending_hash_count", "SELECT count(*) AS pending FROM objects WHERE hash_state = 'deferred'")
def _(c):
    return c.objects.where("hash_state = 'deferred'").agg(F.count(F.lit(1)).alias("pending"))


@query("deferred_batch", """, f AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY path, volume_id) AS r FROM locations)
SELECT object_id, path, volume_id, f.size_bytes, fid, strftime(modified_at, '%Y-%m-%d %H:%M:%S') AS modified_at FROM f JOIN objects o USING (object_id) WHERE r = 1 AND o.hash_state = 'deferred' ORDER BY object_id LIMIT 500""")  # fmt: skip
def _(c):
    return reports.deferred_batch(c.locations, c.objects, 500).withColumn("modified_at", stamp("modified_at"))


@query("lookup_location", "SELECT id, object_id, name FROM locations WHERE volume_id = 'bench' AND path = '/bench/item_3.json'")
def _(c):
    return c.locations.where("volume_id = 'bench' AND path = '/bench/item_3.json'").select("id", "object_id", "name")


@query("tags_for_objects", "SELECT object_id, t.id, t.name, t.parent_id FROM tag_links k JOIN tags t ON t.id = k.tag_id")
def _(c):
    tags = c.tags.withColumnRenamed("id", "tag_id")
    return c.tag_links.join(F.broadcast(tags), "tag_id").select("object_id", F.col("tag_id").alias("id"), "name", "parent_id")  # five tags


for _name, _desc, _sql in (("name", False, "name ASC NULLS FIRST"), ("size", True, "size_bytes DESC NULLS LAST"), ("modified", True, "modified_at DESC NULLS LAST"), ("extension", False, "extension ASC NULLS FIRST"),
    ("category", False, "CASE extension WHEN 'txt' THEN 'Document' WHEN 'md' THEN 'Document' WHEN 'html' THEN 'Code' WHEN 'json' THEN 'Code' ELSE 'Other' END ASC")):

    @query(f"sort_by_{_name}", f"SELECT path FROM locations ORDER BY {_sql}, path LIMIT 40")
    def _(c, name=_name, desc=_desc):
        return c.locations.orderBy(filters.sort_key(name, desc), "path").limit(40).select("path")


# --- filters -------------------------------------------------------------------------------------------------------

_w = filters.where
_FILTERS = {
    "empty_and": (filters.Filter("and"), "true"),
    "empty_or": (filters.Filter("or"), "false"),
    "file_type": (_w("file_type", category="Document"), "extension IN ('txt', 'md')"),
    "extension": (_w("extension", extension="HTML"), "lower(extension) = 'html'"),
    "size": (_w("size", min=500, max=2000), "size_bytes BETWEEN 500 AND 2000"),
    "allocated": (_w("allocated", min=8192, max=2**64), "allocated_bytes BETWEEN 8192 AND 9223372036854775807"),
    "modified": (_w("modified", start="2022-03-01 00:00:00", end="2022-06-01 00:00:00"), "modified_at BETWEEN TIMESTAMP '2022-03-01' AND TIMESTAMP '2022-06-01'"),
    "tag": (_w("tag", tag="toxic"), "object_id IN (SELECT object_id FROM tag_links WHERE tag_id = 'toxic')"),
    "wasteful": (_w("wasteful", ratio=3.0), "CAST(allocated_bytes AS DOUBLE) / greatest(size_bytes, 1) > 3.0"),
    "duplicate": (_w("duplicate"), "object_id IN (SELECT object_id FROM locations GROUP BY object_id HAVING count(*) > 1)"),
    "nested": (~_w("extension", extension="txt") & (_w("size", min=0, max=300) | _w("wasteful", ratio=20.0)), "NOT (lower(extension) = 'txt') AND (size_bytes BETWEEN 0 AND 300 OR CAST(allocated_bytes AS DOUBLE) / greatest(size_bytes, 1) > 20.0)"),
    "not_tag_or_duplicate": (~(_w("tag", tag="good") | _w("duplicate")), "NOT (object_id IN (SELECT object_id FROM tag_links WHERE tag_id = 'good') OR object_id IN (SELECT object_id FROM locations GROUP BY object_id HAVING count(*) > 1))"),
    "palette_query": (filters.parse_query("type:document size:>2KB"), "extension IN ('txt', 'md') AND size_bytes > 2048"),
}
for _name, (_filter, _sql) in _FILTERS.items():

    @query(f"filter_{_name}", f"SELECT id, path FROM locations WHERE {_sql}")
    def _(c, f=_filter):
        return filters.apply_filter(c.locations, filters.Filter.from_json(f.to_json()), c.tag_links).select("id", "path")


@query("filter_stale_for", f"SELECT id, path FROM locations WHERE fid % 3 > 0 AND modified_at < TIMESTAMP '{AS_OF}' - INTERVAL 300 DAY")
def _(c):
    # the catalog has no times of access: two files in three were read when they were written, of the rest none is known
    read = c.locations.withColumn("accessed_at", F.when(F.col("fid") % 3 > 0, F.col("modified_at")))
    return filters.apply_filter(read, _w("stale_for", days=300, as_of=AS_OF), c.tag_links).select("id", "path")


@query("filter_build_artifact", """, p AS (SELECT id, '/v' || CASE fid % 7 WHEN 0 THEN '/node_modules' WHEN 1 THEN '/Target/x' WHEN 2 THEN '/a/__pycache__' WHEN 3 THEN '/.git/objects' WHEN 4 THEN '/dist' WHEN 5 THEN '/targets' ELSE '/src' END || path AS path, fid FROM locations)
SELECT id, path FROM p WHERE fid % 7 < 5""")  # fmt: skip
def _(c):
    below = F.array(*[F.lit(x) for x in ("/node_modules", "/Target/x", "/a/__pycache__", "/.git/objects", "/dist", "/targets", "/src")])
    placed = c.locations.withColumn("path", F.concat(F.lit("/v"), F.get(below, (F.col("fid") % 7).cast("int")), F.col("path")))
    return filters.apply_filter(placed, _w("build_artifact"), c.tag_links).select("id", "path")


# --- maintenance ---------------------------------------------------------------------------------------------------

_BATCH_SQL = """, old AS (SELECT object_id AS id, kind, mime_type, size_bytes, 1 AS created_at, 1 AS updated_at, hash_state FROM objects WHERE substr(object_id, 1, 1) < 'c'
), batch AS (SELECT object_id AS id, 'New' AS kind, CASE WHEN fid % 2 = 0 THEN 'application/x-new' END AS mime_type, size_bytes + fid % 7 AS size_bytes, 2 AS created_at, 2 AS updated_at, hash_state, fid AS seq FROM locations WHERE fid % 3 = 0
), last_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS r FROM batch) WHERE r = 1)"""


@query("upsert_objects", _BATCH_SQL + """ SELECT coalesce(o.id, n.id) AS id, coalesce(o.kind, n.kind) AS kind, coalesce(n.mime_type, o.mime_type) AS mime_type, CAST(coalesce(n.size_bytes, o.size_bytes) AS BIGINT) AS size_bytes,
coalesce(o.created_at, n.created_at) AS created_at, coalesce(n.updated_at, o.updated_at) AS updated_at, CASE WHEN o.hash_state = 'content' OR n.hash_state = 'content' THEN 'content' ELSE coalesce(o.hash_state, n.hash_state) END AS hash_state
FROM old o FULL JOIN last_ n ON o.id = n.id""")  # fmt: skip
def _(c):
    old = c.objects.where("substring(object_id, 1, 1) < 'c'").selectExpr("object_id AS id", "kind", "mime_type", "size_bytes", "1 AS created_at", "1 AS updated_at", "hash_state")
    batch = c.locations.where("fid % 3 = 0").selectExpr("object_id AS id", "'New' AS kind", "CASE WHEN fid % 2 = 0 THEN 'application/x-new' END AS mime_type", "size_bytes + fid % 7 AS size_bytes", "2 AS created_at", "2 AS updated_at", "hash_state", "fid AS seq")
    return merge.upsert_objects(old, batch)


@query("upsert_locations", """, old AS (SELECT id, volume_id, path, parent_id, size_bytes, 1 AS created_at FROM locations WHERE fid % 2 = 0), n AS (SELECT 'x' || id AS id, volume_id, path, 'p' AS parent_id, size_bytes + 1 AS size_bytes, 2 AS created_at FROM locations WHERE fid % 3 = 0)
SELECT coalesce(o.volume_id, n.volume_id) AS volume_id, coalesce(o.path, n.path) AS path, coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN n.parent_id ELSE o.parent_id END AS parent_id, coalesce(n.size_bytes, o.size_bytes) AS size_bytes, coalesce(o.created_at, n.created_at) AS created_at
FROM old o FULL JOIN n ON o.volume_id = n.volume_id AND o.path = n.path""")  # fmt: skip
def _(c):
    old = c.locations.where("fid % 2 = 0").selectExpr("id", "volume_id", "path", "parent_id", "size_bytes", "1 AS created_at")
    new = c.locations.where("fid % 3 = 0").selectExpr("concat('x', id) AS id", "volume_id", "path", "'p' AS parent_id", "size_bytes + 1 AS size_bytes", "2 AS created_at", "fid AS seq")
    return merge.upsert_locations(old, new)


@query("delete_by_path", """, gone AS (SELECT * FROM locations WHERE path LIKE '/docs/src1%') SELECT id, path, CASE WHEN parent_id IN (SELECT id FROM gone) THEN NULL ELSE parent_id END AS parent_id FROM locations WHERE path NOT LIKE '/docs/src1%'""")
def _(c):
    gone = c.locations.where("path LIKE '/docs/src1%'").select("volume_id", "path")
    return merge.delete_locations(c.locations.select("id", "volume_id", "path", "parent_id", "object_id"), gone, ["volume_id", "path"])[0].select("id", "path", "parent_id")


@query("delete_by_fid", "SELECT DISTINCT object_id FROM locations WHERE volume_id = 'docs' AND fid % 5 = 0")
def _(c):
    gone = c.locations.where("volume_id = 'docs' AND fid % 5 = 0").select("volume_id", "fid")
    return merge.delete_locations(c.locations.select("id", "volume_id", "fid", "parent_id", "object_id"), gone, ["volume_id", "fid"])[1]


@query("delete_orphans", "SELECT object_id AS id FROM objects WHERE NOT (object_id IN (SELECT object_id FROM locations WHERE fid % 5 = 0) AND object_id NOT IN (SELECT object_id FROM locations WHERE fid IS NULL OR fid % 5 <> 0))")
def _(c):
    gone = c.locations.where("fid % 5 = 0").select("object_id").distinct()
    return merge.delete_orphan_objects(c.objects.select(F.col("object_id").alias("id")), c.locations.where("fid IS NULL OR fid % 5 <> 0"), gone)


@query("relocate", """SELECT path_, regexp_extract(path_, '[^/]+$') AS name, CASE WHEN path_ = path THEN id ELSE sha256(volume_id || ':' || path_) END AS id FROM (SELECT *, CASE WHEN fid % 9 = 0 THEN '/moved/' || fid || '.bin' ELSE path END AS path_ FROM locations)""")
def _(c):
    moves = c.locations.where("fid % 9 = 0").select("volume_id", "fid", F.concat(F.lit("/moved/"), F.col("fid"), F.lit(".bin")).alias("new_path"))
    return merge.relocate(c.locations, moves).select(F.col("path").alias("path_"), "name", "id")


@query("upgrade_deferred", "SELECT id, CASE WHEN hash_state = 'deferred' THEN 'real-' || object_id ELSE object_id END AS object_id FROM (SELECT l.id, l.object_id, o.hash_state FROM locations l JOIN objects o USING (object_id))")
def _(c):
    mapping = c.objects.where("hash_state = 'deferred'").select(F.col("object_id").alias("old_id"), F.concat(F.lit("real-"), F.col("object_id")).alias("new_id"))
    return merge.upgrade_deferred(c.locations, mapping).select("id", "object_id")


@query("floored_totals", """, e AS (SELECT user_id, event_id, CAST(CASE WHEN event_type = 'error' THEN -round(value * 100) ELSE round(value * 10) END AS BIGINT) AS d FROM events), s AS (SELECT user_id, sum(d) OVER (PARTITION BY user_id ORDER BY event_id DESC) AS t FROM e)
SELECT user_id, CAST(greatest(max(t), 0) AS BIGINT) AS total FROM s GROUP BY user_id""")  # fmt: skip
def _(c):
    d = F.when(F.col("event_type") == "error", -F.round(F.col("value") * 100)).otherwise(F.round(F.col("value") * 10)).cast("long")
    return hierarchy.floored_totals(c.table("events").select("user_id", "event_id", d.alias("d")), "user_id", "event_id", "d")


@query("add_tags", ", good AS (SELECT object_id FROM locations WHERE volume_id = 'docs' AND fid % 4 = 0) SELECT tag_id, object_id FROM tag_links UNION SELECT 'good', object_id FROM good")
def _(c):
    return merge.add_tags(c.tag_links, "good", c.locations.where("volume_id = 'docs' AND fid % 4 = 0"))[0]


@query("add_tags_count", ", good AS (SELECT DISTINCT object_id FROM locations WHERE volume_id = 'docs' AND fid % 4 = 0) SELECT count(*) AS added FROM good WHERE object_id NOT IN (SELECT object_id FROM tag_links WHERE tag_id = 'good')")
def _(c):
    return merge.add_tags(c.tag_links, "good", c.locations.where("volume_id = 'docs' AND fid % 4 = 0"))[1].agg(F.count(F.lit(1)).alias("added"))


@query("remove_tags", "SELECT * FROM tag_links WHERE NOT (tag_id = 'good' AND object_id IN (SELECT object_id FROM locations WHERE fid % 4 = 0))")
def _(c):
    return merge.remove_tags(c.tag_links, "good", c.locations.where("fid % 4 = 0").select("object_id").distinct())


@query("inode_cache", """SELECT fid, format('v2:{}:{}:{:016x}:{:016x}:{:016x}', length(volume_id), volume_id, fid, CAST(epoch(modified_at) AS BIGINT), size_bytes) AS key, CASE WHEN fid % 2 = 0 THEN object_id END AS object_id FROM locations WHERE fid IS NOT NULL""")
def _(c):
    e = c.locations.where("fid IS NOT NULL").select("volume_id", F.col("fid").alias("inode"), F.unix_timestamp("modified_at").alias("mtime"), F.col("size_bytes").alias("size"), "object_id")
    cache = e.where("inode % 2 = 0").select(hashing.inode_key(F.col("volume_id"), F.col("inode"), F.col("mtime"), F.col("size")).alias("key"), "object_id")
    return merge.cached_hashes(e.drop("object_id"), cache).select(F.col("inode").alias("fid"), "key", "object_id")


@query("smart_rename", """SELECT path, strftime(modified_at, '%Y') || '-' || strftime(modified_at, '%m') || '-' || strftime(modified_at, '%d') || '_' || left(name, length(name) - length(extension) - 1) || '.' || extension AS new_name FROM locations WHERE NOT is_directory""")
def _(c):
    return merge.smart_rename(c.locations.where("NOT is_directory"), "{year}-{month}-{day}_{original}")


# --- hierarchy -----------------------------------------------------------------------------------------------------


def _topology(c: Corpus) -> DataFrame:
    r = c.table("region").selectExpr("CAST(r_regionkey AS BIGINT) AS fid", "CAST(r_regionkey AS BIGINT) AS parent_fid", "r_name AS name")
    n = c.table("nation").selectExpr("CAST(n_nationkey + 100 AS BIGINT) AS fid", "CAST(n_regionkey AS BIGINT) AS parent_fid", "n_name AS name")
    s = c.table("supplier").selectExpr("s_suppkey + 1000 AS fid", "CAST(s_nationkey + 100 AS BIGINT) AS parent_fid", "s_name AS name")
    return r.unionByName(n).unionByName(s)


_TOPOLOGY_SQL = """WITH RECURSIVE t AS (SELECT CAST(r_regionkey AS BIGINT) AS fid, CAST(r_regionkey AS BIGINT) AS parent_fid, r_name AS name FROM region UNION ALL SELECT n_nationkey + 100, n_regionkey, n_name FROM nation UNION ALL SELECT s_suppkey + 1000, s_nationkey + 100, s_name FROM supplier
), tree AS (SELECT fid, name AS path, 0 AS depth FROM t WHERE fid = parent_fid UNION ALL SELECT t.fid, p.path || '/' || t.name, p.depth + 1 FROM tree p JOIN t ON t.parent_fid = p.fid AND t.fid <> t.parent_fid)"""


@query("full_paths", _TOPOLOGY_SQL + " SELECT CAST(fid AS BIGINT) AS fid, path, depth FROM tree", catalog=False)
def _(c):
    return hierarchy.full_paths(_topology(c))


@query("tag_closure", ", c AS (SELECT id AS ancestor, id AS descendant, 0 AS depth FROM tags UNION ALL SELECT c.ancestor, t.id, c.depth + 1 FROM c JOIN tags t ON t.parent_id = c.descendant) SELECT * FROM c")
def _(c):
    return hierarchy.closure(c.tags)


@query("bubble_up", """, d AS (SELECT volume_id, string_split(path, '/') AS p, size_bytes, allocated_bytes FROM locations)
SELECT volume_id, array_to_string(p[1:i], '/') AS path, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes, CAST(sum(allocated_bytes) AS BIGINT) AS allocated FROM d, unnest(range(2, len(p))) AS u(i) GROUP BY 1, 2""")  # fmt: skip
def _(c):
    return hierarchy.bubble_up(c.locations.selectExpr("volume_id", "path", "1 AS files", "size_bytes AS bytes", "allocated_bytes AS allocated"))


@query("mount_of_path", """, m AS (SELECT * FROM (VALUES ('/', 'ext4'), ('/docs', 'xfs'), ('/docs/src1', 'btrfs'), ('/web', 'ntfs')) t(mount_point, fs_type))
SELECT path, (SELECT arg_max(fs_type, length(mount_point)) FROM m WHERE starts_with(l.path, mount_point)) AS fs_type FROM locations l""")  # fmt: skip
def _(c):
    mounts = c.spark.createDataFrame([("/", "ext4"), ("/docs", "xfs"), ("/docs/src1", "btrfs"), ("/web", "ntfs")], "mount_point string, fs_type string")
    near = c.locations.select("path").join(F.broadcast(mounts), F.expr("startswith(path, mount_point)"))  # a machine's mounts
    return near.groupBy("path").agg(F.max_by("fs_type", F.length("mount_point")).alias("fs_type"))


# --- scalar functions ----------------------------------------------------------------------------------------------


@query("path_functions", """SELECT path, name, extension, parent_path, len(list_filter_len) AS depth FROM (SELECT path, name, extension, parent_path, string_split(path, '/') AS list_filter_len FROM locations)""")
def _(c):
    p = F.col("path")
    return c.locations.select("path", paths.name(p).alias("name"), "extension", paths.parent(p).alias("parent_path"), paths.depth(p).cast("long").alias("depth"))


@query("file_categories", "SELECT path, CASE extension WHEN 'txt' THEN 'Document' WHEN 'md' THEN 'Document' WHEN 'html' THEN 'Code' WHEN 'json' THEN 'Code' ELSE 'Other' END AS category, CASE extension WHEN 'txt' THEN 'text/plain' WHEN 'html' THEN 'text/html' WHEN 'md' THEN 'text/markdown' WHEN 'json' THEN 'application/json' END AS mime FROM locations")
def _(c):
    return c.locations.select("path", paths.category(F.col("extension")).alias("category"), paths.mime(F.col("extension")).alias("mime"))


@query("scan_priority", "SELECT path, CASE WHEN lower(path) LIKE '/web/%' THEN 1 WHEN lower(path) LIKE '/chat/%' THEN 4 ELSE 2 END AS priority FROM locations WHERE NOT is_directory")
def _(c):
    shown = F.when(F.col("volume_id") == "web", F.concat(F.lit("/home"), F.col("path"))).when(F.col("volume_id") == "chat", F.concat(F.lit("C:\\Build"), F.col("path"))).otherwise(F.col("path"))
    return c.locations.where("NOT is_directory").select("path", paths.scan_priority(shown).alias("priority"))


@query("normalized_names", """SELECT p_partkey, lower(p_name) AS plain, lower(p_name) AS marked FROM part""", catalog=False)
def _(c):
    n = F.col("p_name")
    return c.table("part").select("p_partkey", paths.normalized_name(F.concat(n, F.lit(".pdf"))).alias("plain"), paths.normalized_name(F.concat(F.lit("Copy of "), n, F.lit(" (2) ().txt"))).alias("marked"))


@query("copy_patterns", "SELECT p_partkey, p_partkey % 4 > 0 AS is_copy FROM part", catalog=False)
def _(c):
    k, n = F.col("p_partkey") % 4, F.col("p_name")
    name = F.when(k == 1, F.concat(n, F.lit(" - Copy.txt"))).when(k == 2, F.concat(n, F.lit(" (7).txt"))).when(k == 3, F.concat(n, F.lit("~2.txt"))).otherwise(F.concat(n, F.lit(" (100).txt")))
    return c.table("part").select("p_partkey", paths.has_copy_pattern(name).alias("is_copy"))


@query("partial_hashes", "SELECT path, sha256(substr(content, 1, 40)) AS h FROM files WHERE volume_id = 'bench'")
def _(c):
    return c.files.where("volume_id = 'bench'").select("path", F.sha2(F.substring("content", 1, 40), 256).alias("h"))


@query("deferred_ids", "SELECT path, sha256('deferred-v1|' || length(volume_id) || '|' || volume_id || '|' || fid || '|' || CAST(epoch(modified_at) AS BIGINT) || '|' || size_bytes) AS id FROM locations WHERE fid IS NOT NULL")
def _(c):
    return c.locations.where("fid IS NOT NULL").select("path", hashing.deferred_id(F.col("volume_id"), F.col("fid"), F.unix_timestamp("modified_at"), F.col("size_bytes")).alias("id"))


@query("storage_tiers", f"""SELECT path, CASE WHEN d < 90 THEN 'Hot' WHEN d < 365 THEN 'Warm' ELSE 'Cold' END AS tier FROM (SELECT path, date_sub('day', modified_at, TIMESTAMP '{AS_OF}') AS d FROM locations)""")
def _(c):
    d = F.timestamp_diff("DAY", F.col("modified_at"), F.to_timestamp(F.lit(AS_OF)))
    return c.locations.select("path", F.when(d < 90, "Hot").when(d < 365, "Warm").otherwise("Cold").alias("tier"))


@query("missing_chunks", "SELECT user_id, count(*) AS missing FROM (SELECT DISTINCT user_id, n FROM events, unnest(range(0, 20)) AS u(n)) x WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = x.user_id AND e.event_id % 20 = x.n) GROUP BY user_id", catalog=False)
def _(c):
    done = c.table("events").groupBy("user_id").agg(F.collect_set((F.col("event_id") % 20).cast("int")).alias("done"))
    return done.select("user_id", F.size(F.array_except(F.sequence(F.lit(0), F.lit(19)), "done")).cast("long").alias("missing")).where("missing > 0")


def _clocks(c: Corpus) -> DataFrame:
    own = c.table("events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    clock = own.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("a"))
    return clock.withColumn("b", F.create_map(F.lit("view"), F.lit(2).cast("long"), F.lit("click"), F.lit(2).cast("long")))


@query("clock_merge", """, e AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2 UNION ALL SELECT DISTINCT user_id, t, 2 FROM events, unnest(['view', 'click']) AS u(t)) SELECT user_id, event_type, max(n) AS n FROM e GROUP BY 1, 2""")
def _(c):
    return _clocks(c).select("user_id", F.explode(clocks.merge(F.col("a"), F.col("b"))).alias("event_type", "n"))


@query("clock_order", """, e AS (SELECT user_id, t AS event_type, coalesce(sum(CASE WHEN event_type = t THEN 1 END), 0) AS x, CASE WHEN t IN ('view', 'click') THEN 2 ELSE 0 END AS y FROM events, (SELECT DISTINCT event_type AS t FROM events UNION SELECT 'view' UNION SELECT 'click') GROUP BY user_id, t)
SELECT user_id, CASE WHEN bool_or(x < y) AND bool_or(x > y) THEN NULL WHEN bool_or(x < y) THEN 'less' WHEN bool_or(x > y) THEN 'greater' ELSE 'equal' END AS relation FROM e GROUP BY user_id""")  # fmt: skip
def _(c):
    return _clocks(c).select("user_id", clocks.order(F.col("a"), F.col("b")).alias("relation"))


# --- duplicates ----------------------------------------------------------------------------------------------------


@query("content_groups", "SELECT path, object_id AS \"group\" FROM locations WHERE NOT is_directory AND object_id IN (SELECT object_id FROM locations WHERE NOT is_directory GROUP BY 1 HAVING count(*) > 1)")
def _(c):
    return dedup.content_groups(c.files.select("path", "content", F.octet_length("content").cast("long").alias("size_bytes")))


_NAMES = "SELECT DISTINCT p_type AS block, lower(p_name) AS name FROM part"


@query("similar_names", f"""SELECT a.block, a.name AS a, b.name AS b, round(jaro_winkler_similarity(a.name, b.name), 6) AS similarity FROM ({_NAMES}) a JOIN ({_NAMES}) b ON a.block = b.block AND a.name < b.name
WHERE jaro_winkler_similarity(a.name, b.name) >= 0.85 AND least(length(a.name), length(b.name)) >= ceil(greatest(length(a.name), length(b.name)) * 0.68)""", catalog=False)  # fmt: skip
def _(c):
    names = c.table("part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("block"), F.concat("p_name", F.lit(".pdf")).alias("name"))
    return dedup.similar_names(names).withColumn("similarity", F.round("similarity", 6))


@query("jaro_winkler", "SELECT a.n_name AS a, b.n_name AS b, round(jaro_winkler_similarity(a.n_name, b.n_name), 6) AS similarity FROM nation a, nation b WHERE a.n_nationkey < b.n_nationkey", catalog=False)
def _(c):
    n = c.table("nation")
    pairs = n.select(F.col("n_name").alias("a"), F.col("n_nationkey").alias("i")).join(n.select(F.col("n_name").alias("b"), F.col("n_nationkey").alias("j")), F.col("i") < F.col("j"))
    return pairs.select("a", "b", F.round(jaro_winkler_column("a", "b"), 6).alias("similarity"))


#: A hash of 64 bits that copies with few edits nearly share: the parities of a text's characters.
_PARITIES = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 ."


@query("hamming_pairs", f"""WITH s AS (SELECT doc_id, CAST(sum(CASE WHEN (length(text) - length(replace(text, substr('{_PARITIES}', i + 1, 1), ''))) % 2 = 1 THEN CAST(1 AS UBIGINT) << i ELSE 0 END) AS UBIGINT) AS h FROM documents, unnest(range(0, 64)) AS u(i) GROUP BY doc_id)
SELECT a.doc_id AS a, b.doc_id AS b, CAST(bit_count(xor(a.h, b.h)) AS INTEGER) AS distance FROM s a JOIN s b ON a.doc_id < b.doc_id WHERE bit_count(xor(a.h, b.h)) <= 3""", catalog=False)  # fmt: skip
def _(c):
    bits = [F.shiftleft(F.pmod(F.length("text") - F.length(F.replace("text", F.lit(x), F.lit(""))), F.lit(2)).cast("long"), i) for i, x in enumerate(_PARITIES)]
    h = reduce(lambda a, x: a.bitwiseOR(x), bits)
    return dedup.hamming_pairs(c.table("documents").select(F.col("doc_id").alias("id"), h.alias("h")), 3).withColumn("distance", F.col("distance").cast("int"))


def _referenced(c: Corpus) -> DataFrame:
    twice = c.locations.where("NOT is_directory").groupBy("object_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    g = c.locations.where("NOT is_directory").join(twice, "object_id", "left_semi")
    return dedup.with_reference(g.select(F.col("object_id").alias("group"), "path", "name", "size_bytes", F.unix_timestamp("modified_at").alias("modified")))


_REF = """, g AS (SELECT object_id AS "group", path, size_bytes, CAST(epoch(modified_at) AS BIGINT) AS m, len(string_split(path, '/')) AS depth FROM locations WHERE NOT is_directory), k AS (SELECT *, min(m) OVER w AS lo, max(m) OVER w AS hi, count(*) OVER w AS n FROM g WINDOW w AS (PARTITION BY "group")
), sc AS (SELECT *, CAST(-10 * depth - floor((m - lo) * 100.0 / greatest(hi - lo, 1)) AS BIGINT) AS score FROM k WHERE n > 1), r AS (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY score DESC, path DESC) = 1 AS is_reference FROM sc)"""


@query("reference_selection", _REF + ' SELECT "group", path, score, is_reference FROM r')
def _(c):
    return _referenced(c).select("group", "path", "score", "is_reference")


@query("duplicate_group_report", _REF + ' SELECT "group", max(CASE WHEN is_reference THEN path END) AS reference, count(*) FILTER (NOT is_reference) AS duplicates, CAST(coalesce(sum(size_bytes) FILTER (NOT is_reference), 0) AS BIGINT) AS wasted_bytes FROM r GROUP BY "group"')
def _(c):
    return dedup.group_report(_referenced(c))


#: Numbers of nations, customers and orders as nodes of one graph.
_CUSTOMER, _ORDER = 1_000, 1_000_000_000_000


@query("components", f"""WITH n AS (SELECT CAST(c_nationkey AS BIGINT) AS component, c_custkey FROM customer)
SELECT component AS node, component FROM n UNION SELECT {_CUSTOMER} + c_custkey, component FROM n UNION SELECT {_ORDER} + o_orderkey, component FROM orders JOIN n ON o_custkey = c_custkey""", catalog=False)  # fmt: skip
def _(c):
    # all customers with their nations, and all orders with their customers: a few hubs with very many nodes
    nations = c.table("customer").selectExpr("CAST(c_nationkey AS BIGINT) AS a", f"{_CUSTOMER} + c_custkey AS b")
    return dedup.group_pairs(nations.unionByName(c.table("orders").selectExpr(f"{_CUSTOMER} + o_custkey AS a", f"{_ORDER} + o_orderkey AS b")))


def _folders(c: Corpus) -> DataFrame:
    # chats as folders: each turn a file named by its number and role
    f = c.files.where("volume_id = 'chat'").select("volume_id", "path", F.octet_length("content").cast("long").alias("size_bytes"))
    return dedup.folder_digests(f)


@query("folder_digests", """, f AS (SELECT regexp_extract(path, '^(.*)/', 1) AS dir, regexp_extract(path, '[^/]+$') || ':' || strlen(content) AS item, strlen(content) AS s FROM files WHERE volume_id = 'chat'), d AS (SELECT dir AS path, sha256(string_agg(item, '|' ORDER BY item)) AS digest, count(*) AS file_count, CAST(sum(s) AS BIGINT) AS total_size FROM f GROUP BY dir)
SELECT 'chat' AS volume_id, path, digest, file_count, total_size FROM d UNION ALL SELECT 'chat', '/chat', sha256(string_agg('/' || digest, '|' ORDER BY '/' || digest)), CAST(sum(file_count) AS BIGINT), CAST(sum(total_size) AS BIGINT) FROM d""")  # fmt: skip
def _(c):
    return _folders(c)


@query("duplicate_folders", """, f AS (SELECT regexp_extract(path, '^(.*)/', 1) AS dir, regexp_extract(path, '[^/]+$') || ':' || (strlen(content) // 1000) AS item, strlen(content) // 1000 AS s FROM files WHERE volume_id = 'chat'), d AS (SELECT dir AS path, string_agg(item, '|' ORDER BY item) AS k, count(*) AS file_count, CAST(sum(s) AS BIGINT) AS total_size FROM f GROUP BY dir)
SELECT sha256(k) AS digest, count(*) AS directories, min(path) AS first_path, max(file_count) AS file_count, max(total_size) AS total_size FROM d WHERE file_count >= 2 GROUP BY k HAVING count(*) > 1""")  # fmt: skip
def _(c):
    f = c.files.where("volume_id = 'chat'").select("volume_id", "path", F.floor(F.octet_length("content") / 1000).cast("long").alias("size_bytes"))
    return dedup.duplicate_folders(dedup.folder_digests(f))


@query("treemap")
def _(c):
    items = c.table("orders").select(F.col("o_orderpriority").alias("parent"), F.col("o_orderkey").cast("string").alias("id"), F.col("o_totalprice").alias("weight"))
    return treemap.treemap(items)


# --- the change stream ---------------------------------------------------------------------------------------------


def _events(c: Corpus) -> DataFrame:
    kind = "CASE event_type WHEN 'signup' THEN 'Created' WHEN 'purchase' THEN 'Moved' WHEN 'error' THEN 'Deleted' ELSE 'Modified' END AS kind"
    return c.table("events").selectExpr("concat('v', user_id % 4) AS volume_id", "user_id AS fid", "event_id AS seq", kind, "CAST(value * 100 AS BIGINT) AS new_size")


_FOLD = """WITH RECURSIVE e AS (SELECT 'v' || (user_id % 4) AS volume_id, user_id AS fid, event_id AS seq, CASE event_type WHEN 'signup' THEN 'Created' WHEN 'purchase' THEN 'Moved' WHEN 'error' THEN 'Deleted' ELSE 'Modified' END AS kind, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events
), f AS (SELECT fid, volume_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS k, CAST(NULL AS BIGINT) AS s1, CAST(NULL AS BIGINT) AS s2 FROM (SELECT DISTINCT fid, volume_id FROM e)
  UNION ALL SELECT f.fid, f.volume_id, e.n,
    CASE WHEN s2 IS NOT NULL AND e.kind = 'Modified' THEN k WHEN s2 IS NOT NULL AND e.kind = 'Deleted' THEN NULL WHEN k = 'Created' AND e.kind = 'Deleted' THEN NULL WHEN k = 'Created' AND e.kind = 'Modified' THEN k WHEN k = 'Deleted' AND e.kind = 'Created' THEN 'Modified' WHEN k = 'Moved' AND e.kind = 'Modified' THEN k ELSE e.kind END,
    CASE WHEN s2 IS NOT NULL AND e.kind = 'Modified' THEN s1 WHEN s2 IS NOT NULL AND e.kind = 'Deleted' THEN NULL WHEN k = 'Created' AND e.kind = 'Deleted' THEN NULL WHEN k = 'Created' AND e.kind = 'Modified' THEN s1 WHEN k = 'Moved' AND e.kind = 'Modified' THEN s1 ELSE e.seq END,
    CASE WHEN (s2 IS NOT NULL OR k = 'Moved') AND e.kind = 'Modified' THEN e.seq ELSE NULL END
  FROM f JOIN e ON e.fid = f.fid AND e.n = f.n + 1
), last_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fid ORDER BY n DESC) AS r FROM f) WHERE r = 1 AND k IS NOT NULL)"""


@query("coalesced_changes", _FOLD + " SELECT volume_id, fid, 1 AS step, k AS kind, s1 AS seq FROM last_ UNION ALL SELECT volume_id, fid, 2, 'Modified', s2 FROM last_ WHERE s2 IS NOT NULL", catalog=False)
def _(c):
    return changes.coalesce_changes(_events(c)).select("volume_id", "fid", "step", "kind", "seq")


@query("applied_changes", _FOLD + """, ch AS (SELECT volume_id, fid, k AS kind, s1 AS seq FROM last_ UNION ALL SELECT volume_id, fid, 'Modified', s2 FROM last_ WHERE s2 IS NOT NULL), keys AS (SELECT 'v' || (c_custkey % 4) AS volume_id, c_custkey AS fid FROM customer UNION SELECT volume_id, fid FROM ch WHERE kind IN ('Created', 'Modified'))
SELECT volume_id, fid, CASE WHEN fid IN (SELECT fid FROM ch WHERE kind = 'Modified') THEN 2 WHEN fid IN (SELECT fid FROM ch WHERE kind = 'Created') THEN 1 ELSE 0 END AS src, CAST(CASE WHEN fid IN (SELECT fid FROM ch WHERE kind = 'Moved') THEN 1 ELSE 0 END AS BIGINT) AS moved FROM keys WHERE fid NOT IN (SELECT fid FROM ch WHERE kind = 'Deleted')""", catalog=False)  # fmt: skip
def _(c):
    state = c.table("customer").selectExpr("concat('v', c_custkey % 4) AS volume_id", "c_custkey AS fid", "CAST(0 AS BIGINT) AS size", "CAST(0 AS BIGINT) AS moved")
    ch = changes.coalesce_changes(_events(c)).withColumn("new_size", F.when(F.col("kind") == "Modified", 2).otherwise(1).cast("long"))
    return changes.apply_changes(state, ch).select("volume_id", "fid", F.col("size").cast("int").alias("src"), "moved")


# --- search by links, ranks and vectors; sync ----------------------------------------------------------------------


@query("rank_fusion", """, a AS (SELECT path, row_number() OVER (ORDER BY size_bytes DESC, path) AS r FROM locations WHERE volume_id = 'docs' AND NOT is_directory QUALIFY r <= 100), b AS (SELECT path, row_number() OVER (ORDER BY modified_at DESC, path) AS r FROM locations WHERE volume_id = 'docs' AND NOT is_directory QUALIFY r <= 100)
SELECT path, round(sum(1.0 / (60 + r)), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY path""")  # fmt: skip
def _(c):
    files = c.locations.where("volume_id = 'docs' AND NOT is_directory")
    from pyspark.sql import Window as W

    def ranked(*order):
        top = files.orderBy(*order).limit(100).select("path", "size_bytes", "modified_at")
        return top.select("path", F.row_number().over(W.orderBy(*order)).alias("r"))  # a hundred rows

    both = ranked(F.desc("size_bytes"), "path").unionByName(ranked(F.desc("modified_at"), "path"))
    return both.groupBy("path").agg(F.round(F.sum(1.0 / (60 + F.col("r"))), 9).alias("score"))


@query("vector_search", """WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0) SELECT vec_id FROM (SELECT vec_id, round(sum(CAST(embedding[i] AS DOUBLE) * CAST(q[i] AS DOUBLE)), 6) AS score FROM embeddings, q, unnest(range(1, len(q) + 1)) AS u(i) GROUP BY vec_id) ORDER BY score DESC, vec_id LIMIT 20""", catalog=False)
def _(c):
    e = c.table("embeddings")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("q"))  # one row
    dot = F.aggregate(F.zip_with("embedding", "q", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return e.join(F.broadcast(q)).select("vec_id", F.round(dot, 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(20).select("vec_id")


@query("sync_last_writer", """SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events WHERE event_id > 200 GROUP BY user_id""", catalog=False)
def _(c):
    ops = c.table("events").where("event_id > 200").select("user_id", "event_id", "event_type")
    return merge.last_of_key(ops, ["user_id"], "event_id")


@query("backlinks", """SELECT doc_id AS source, regexp_extract(w, '^([^,.]+)', 1) AS target, count(*) AS n FROM documents, unnest(regexp_extract_all(text, '(?:^|[ \n])the ([a-z]+)', 1)) AS u(w) WHERE lang = 'en' GROUP BY 1, 2""", catalog=False)
def _(c):
    docs = c.table("documents").where("lang = 'en'")
    each = docs.select(F.col("doc_id").alias("source"), F.explode(F.regexp_extract_all("text", F.lit(r"(?:^|[ \n])the ([a-z]+)"), F.lit(1))).alias("target"))
    return each.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))


# --- actions, schedules and the sparse tables ----------------------------------------------------------------------


@query("copy_files", """SELECT sha256(volume_id || ':' || p) AS id, object_id, volume_id, p AS path, regexp_extract(p, '[^/]+$') AS name, 'bak' AS extension, size_bytes, size_bytes AS allocated_bytes FROM (SELECT *, path || '.bak' AS p FROM locations WHERE fid % 6 = 0)""")
def _(c):
    plan = c.locations.where("fid % 6 = 0").select("volume_id", "path", F.concat("path", F.lit(".bak")).alias("new_path"))
    return actions.copies(c.locations, plan)


@query("create_directories", """SELECT sha256('new:/new/' || n_name) AS id, sha256('dir-v1|/new/' || n_name) AS object_id, 'new' AS volume_id, '/new/' || n_name AS path, n_name AS name, true AS is_directory, CAST(0 AS BIGINT) AS size_bytes, CAST(NULL AS VARCHAR) AS parent_id FROM nation""", catalog=False)
def _(c):
    return actions.new_directories(c.table("nation").select(F.lit("new").alias("volume_id"), F.concat(F.lit("/new/"), F.col("n_name")).alias("path")))


@query("share_plan", _REF + ' SELECT a.path AS source, b.path AS destination, b.size_bytes AS bytes FROM r a JOIN r b ON a."group" = b."group" AND a.is_reference AND NOT b.is_reference AND a.size_bytes = b.size_bytes')
def _(c):
    return actions.share_plan(_referenced(c))


@query("content_id_rules", """SELECT path, CASE WHEN fid % 4 = 0 THEN 'cached' WHEN strlen(content) = 0 THEN sha256('') WHEN k % 10 = 0 THEN sha256('deferred-v1|' || length(volume_id) || '|' || volume_id || '|' || fid || '|0|' || strlen(content)) ELSE sha256(content) END AS id FROM files""")
def _(c):
    size = F.octet_length("content").cast("long")
    cached = F.when(F.col("fid") % 4 == 0, "cached")
    return c.files.select("path", actions.content_ids(F.col("volume_id"), F.col("path"), F.col("fid"), F.lit(0), size, F.lit(False), cached, F.col("content"), F.col("k") % 10 == 0).alias("id"))


@query("cursor_store", "SELECT CAST(n_nationkey AS VARCHAR) AS volume_key, CASE WHEN n_regionkey < 2 THEN 'new' ELSE 'old' END AS cursor FROM nation WHERE n_regionkey <> 4 OR n_nationkey > 0", catalog=False)
def _(c):
    n = c.table("nation").select(F.col("n_nationkey").cast("string").alias("volume_key"), "n_regionkey")
    return actions.save_cursors(n.select("volume_key", F.lit("old").alias("cursor")), n.where("n_regionkey < 2").select("volume_key", F.lit("new").alias("cursor")))


@query("paired_moves", """WITH f AS (SELECT event_id // 4 AS cookie, event_id AS a, 'p' || event_id AS path FROM events WHERE event_id % 4 = 0), t AS (SELECT event_id // 4 AS cookie, event_id + CASE WHEN user_id % 3 = 0 THEN 1000 ELSE 0 END AS b, 'q' || event_id AS new_path FROM events WHERE event_id % 4 = 1 AND user_id % 2 = 0), j AS (SELECT coalesce(f.cookie, t.cookie) AS cookie, a, b, path, new_path, a IS NULL OR b IS NULL OR b NOT BETWEEN a AND a + 500 AS late FROM f FULL JOIN t ON f.cookie = t.cookie)
SELECT cookie, 'Moved' AS kind, path, new_path FROM j WHERE NOT late UNION ALL SELECT cookie, 'Deleted', path, NULL FROM j WHERE late AND a IS NOT NULL UNION ALL SELECT cookie, 'Created', NULL, new_path FROM j WHERE late AND b IS NOT NULL""", catalog=False)  # fmt: skip
def _(c):
    e = c.table("events")
    cookie = F.floor(F.col("event_id") / 4).alias("cookie")
    start = e.where("event_id % 4 = 0").select(cookie, F.lit("from").alias("kind"), F.col("event_id").alias("at"), F.concat(F.lit("p"), "event_id").alias("path"))
    end = e.where("event_id % 4 = 1 AND user_id % 2 = 0").select(cookie, F.lit("to").alias("kind"), F.expr("event_id + CASE WHEN user_id % 3 = 0 THEN 1000 ELSE 0 END").alias("at"), F.concat(F.lit("q"), "event_id").alias("path"))
    return changes.pair_moves(start.unionByName(end))


@query("hash_deferred", "SELECT l.id, sha256(content) AS object_id FROM locations l JOIN files f USING (volume_id, path) JOIN objects o ON o.object_id = l.object_id WHERE o.hash_state = 'deferred'")
def _(c):
    due = c.objects.where("hash_state = 'deferred'").select("object_id")
    named = c.locations.select("id", "volume_id", "path", "object_id").join(due, "object_id", "left_semi")
    return named.join(c.files.select("volume_id", "path", hashing.content_id(F.col("content")).alias("real")), ["volume_id", "path"]).select("id", F.col("real").alias("object_id"))


@query("temporal_index", "SELECT id, CAST(year(modified_at) AS INTEGER) AS year, CAST(month(modified_at) AS INTEGER) AS month, CAST(day(modified_at) AS INTEGER) AS day FROM locations")
def _(c):
    return c.locations.select("id", F.year("modified_at").alias("year"), F.month("modified_at").alias("month"), F.day("modified_at").alias("day"))


@query("metadata_pivot", "SELECT doc_id, max(CASE WHEN k = 'lang' THEN v END) AS lang, max(CASE WHEN k = 'source' THEN v END) AS source FROM (SELECT doc_id, 'lang' AS k, lang AS v FROM documents UNION ALL SELECT doc_id, 'source', source FROM documents) GROUP BY doc_id", catalog=False)
def _(c):
    eav = c.table("documents").select("doc_id", F.explode(F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"))).alias("k", "v"))
    return eav.groupBy("doc_id").pivot("k", ["lang", "source"]).agg(F.first("v"))


@query("sync_missing", "SELECT event_id, user_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE user_id % 3 = 0)", catalog=False)
def _(c):
    e = c.table("events").select("event_id", "user_id")
    return e.join(e.where("user_id % 3 = 0").select("event_id"), "event_id", "left_anti")


@query("delete_to_trash_effect", "SELECT object_id FROM objects WHERE object_id NOT IN (SELECT object_id FROM locations WHERE path LIKE '/chat/%' AND NOT is_directory) OR object_id IN (SELECT object_id FROM locations WHERE NOT (path LIKE '/chat/%' AND NOT is_directory))")
def _(c):
    gone = c.locations.where("path LIKE '/chat/%' AND NOT is_directory").select("volume_id", "path")
    stay, ids = merge.delete_locations(c.locations.select("id", "volume_id", "path", "parent_id", "object_id"), gone, ["volume_id", "path"])
    return merge.delete_orphan_objects(c.objects.select(F.col("object_id").alias("id")), stay, ids).select(F.col("id").alias("object_id"))
