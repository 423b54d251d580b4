"""A file catalog over text tables: rows as files, their contents as objects, their paths as locations."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import hashing, paths

EPOCH = "2022-01-01 00:00:00"
AS_OF = "2024-06-01 00:00:00"

# A small dimension of extensions: category, label and colour.
FILE_TYPES = [
    ("txt", "Document", "Plain Text", "#2196F3"), ("md", "Document", "Markdown", "#1976D2"), ("pdf", "Document", "PDF", "#D32F2F"),
    ("html", "Code", "HTML", "#FF5722"), ("json", "Config", "JSON", "#795548"), ("jpg", "Image", "JPEG", "#4CAF50"), ("zip", "Archive", "ZIP", "#607D8B"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass(frozen=True)
class Corpus:
    """The catalog's tables, all lazy: nothing reads contents that a query doesn't need."""

    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @cached_property
    def files(self) -> DataFrame:
        """volume_id, path, content, k (row key), fid."""
        url = r"^https?://([^/]+)/([^/?#]+)"
        docs = self.table("documents").selectExpr("'docs' AS volume_id", "concat('/docs/', source, '/', lang, '/doc_', doc_id, '.txt') AS path", "text AS content", "doc_id AS k", "doc_id AS fid")
        web = self.table("pages").select(
            F.lit("web").alias("volume_id"),
            F.concat(F.lit("/web/"), F.regexp_extract("url", url, 1), F.lit("/"), F.regexp_extract("url", url, 2), F.lit("/"), F.col("page_id"), F.lit(".html")).alias("path"),
            F.col("html").alias("content"), F.col("page_id").alias("k"), (F.col("page_id") + 10**12).alias("fid"),
        )
        chat = self.table("conversations").selectExpr(
            "'chat' AS volume_id", "concat('/chat/', conv_id, '/', turn, '_', role, '.md') AS path", "text AS content", "conv_id AS k", "2000000000000 + conv_id * 1000 + turn AS fid"
        )
        bench = self.table("benchmark").selectExpr("'bench' AS volume_id", "concat('/bench/item_', item_id, '.json') AS path", "text AS content", "item_id AS k", "3000000000000 + item_id AS fid")
        return docs.unionByName(web).unionByName(chat).unionByName(bench)

    @cached_property
    def locations(self) -> DataFrame:
        f = self.files
        files = f.select(
            "volume_id", "path", hashing.content_id(F.col("content")).alias("object_id"), F.octet_length("content").cast("long").alias("size_bytes"),
            F.lit(False).alias("is_directory"), (F.col("k") % 1000).cast("int").alias("days"), "fid", F.when(F.col("k") % 10 == 0, "deferred").otherwise("content").alias("hash_state"),
        )
        above = f.select("volume_id", F.explode(paths.ancestors(F.col("path"))).alias("path")).distinct()
        dirs = above.select(
            "volume_id", "path", hashing.directory_id(F.col("path")).alias("object_id"), F.lit(0).cast("long").alias("size_bytes"),
            F.lit(True).alias("is_directory"), F.lit(0).alias("days"), F.lit(None).cast("long").alias("fid"), F.lit("content").alias("hash_state"),
        )
        both = files.unionByName(dirs)
        name, up = paths.name(F.col("path")), paths.parent(F.col("path"))
        when = F.to_timestamp(F.lit(EPOCH)) + F.make_dt_interval(F.col("days"))
        return both.select(
            hashing.location_id(F.col("volume_id"), F.col("path")).alias("id"), "object_id", "volume_id", "path", name.alias("name"),
            F.when(~F.col("is_directory"), paths.extension(name)).alias("extension"), up.alias("parent_path"),
            hashing.location_id(F.col("volume_id"), up).alias("parent_id"), "is_directory", "size_bytes", paths.allocated(F.col("size_bytes")).alias("allocated_bytes"),
            when.alias("modified_at"), F.lit(None).cast("timestamp").alias("accessed_at"), "fid", "hash_state",
        )

    @cached_property
    def objects(self) -> DataFrame:
        """One row a content; deferred only while no location has had its content hashed."""
        return self.locations.groupBy("object_id").agg(
            F.when(F.max("is_directory"), "Directory").otherwise("File").alias("kind"), F.max("size_bytes").alias("size_bytes"),
            F.max(F.when(~F.col("is_directory"), paths.mime(F.col("extension")))).alias("mime_type"), F.min("hash_state").alias("hash_state"),
        )

    @cached_property
    def file_types(self) -> DataFrame:
        return self.spark.createDataFrame(FILE_TYPES, "extension string, category string, label string, color string")

    @cached_property
    def tags(self) -> DataFrame:
        """A small tag tree."""
        rows = [("root", "all", None), ("quality", "quality", "root"), ("toxic", "toxic", "root"), ("good", "good", "quality"), ("bad", "bad", "quality")]
        return self.spark.createDataFrame(rows, "id string, name string, parent_id string")

    @cached_property
    def tag_links(self) -> DataFrame:
        """tag_id, object_id: labels put on documents' contents."""
        docs = self.table("documents").select("doc_id", hashing.content_id(F.col("text")).alias("object_id"))
        marks = self.table("labels").select("doc_id", F.explode(F.array(F.when(F.col("quality") == 1, "good").otherwise("bad"), F.when(F.col("toxic") == 1, "toxic"))).alias("tag_id"))
        return marks.where("tag_id IS NOT NULL").join(docs, "doc_id").select("tag_id", "object_id").distinct()


_types = ", ".join(f"('{e}', '{c}', '{lab}', '{col}')" for e, c, lab, col in FILE_TYPES)
#: The same catalog in DuckDB's SQL: what each oracle begins with.
CATALOG_SQL = rf"""WITH RECURSIVE files AS (
  SELECT 'docs' AS volume_id, '/docs/' || source || '/' || lang || '/doc_' || doc_id || '.txt' AS path, text AS content, doc_id AS k, doc_id AS fid FROM documents
  UNION ALL SELECT 'web', '/web/' || regexp_extract(url, '^https?://([^/]+)/([^/?#]+)', 1) || '/' || regexp_extract(url, '^https?://([^/]+)/([^/?#]+)', 2) || '/' || page_id || '.html', html, page_id, page_id + 1000000000000 FROM pages
  UNION ALL SELECT 'chat', '/chat/' || conv_id || '/' || turn || '_' || role || '.md', text, conv_id, 2000000000000 + conv_id * 1000 + turn FROM conversations
  UNION ALL SELECT 'bench', '/bench/item_' || item_id || '.json', text, item_id, 3000000000000 + item_id FROM benchmark
), parts AS (SELECT volume_id, string_split(path, '/') AS p FROM files
), both_ AS (
  SELECT volume_id, path, sha256(content) AS object_id, CAST(strlen(content) AS BIGINT) AS size_bytes, false AS is_directory, CAST(k % 1000 AS INTEGER) AS days, CAST(fid AS BIGINT) AS fid, CASE WHEN k % 10 = 0 THEN 'deferred' ELSE 'content' END AS hash_state FROM files
  UNION ALL SELECT DISTINCT volume_id, array_to_string(p[1:i], '/') AS path, sha256('dir-v1|' || array_to_string(p[1:i], '/')), CAST(0 AS BIGINT), true, 0, CAST(NULL AS BIGINT), 'content' FROM parts, unnest(range(2, len(p))) AS u(i)
), named AS (SELECT *, regexp_extract(path, '[^/]+$') AS name FROM both_
), located AS (SELECT *, nullif(left(path, length(path) - length(name) - 1), '') AS parent_path FROM named
), locations AS (
  SELECT sha256(volume_id || ':' || path) AS id, object_id, volume_id, path, name, CASE WHEN NOT is_directory THEN nullif(regexp_extract(name, '^.+\.([^.]*)$', 1), '') END AS extension, parent_path,
    sha256(volume_id || ':' || parent_path) AS parent_id, is_directory, size_bytes, (size_bytes + 4095) // 4096 * 4096 AS allocated_bytes, TIMESTAMP '{EPOCH}' + to_days(days) AS modified_at, fid, hash_state FROM located
), objects AS (
  SELECT object_id, CASE WHEN bool_or(is_directory) THEN 'Directory' ELSE 'File' END AS kind, max(size_bytes) AS size_bytes,
    max(CASE extension WHEN 'txt' THEN 'text/plain' WHEN 'html' THEN 'text/html' WHEN 'md' THEN 'text/markdown' WHEN 'json' THEN 'application/json' END) AS mime_type, min(hash_state) AS hash_state FROM locations GROUP BY object_id
), file_types AS (SELECT * FROM (VALUES {_types}) AS t(extension, category, label, color)
), tags AS (SELECT * FROM (VALUES ('root', 'all', NULL), ('quality', 'quality', 'root'), ('toxic', 'toxic', 'root'), ('good', 'good', 'quality'), ('bad', 'bad', 'quality')) AS t(id, name, parent_id)
), tag_links AS (
  SELECT DISTINCT m.tag_id, sha256(d.text) AS object_id FROM (
    SELECT doc_id, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS tag_id FROM labels UNION ALL SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1) m JOIN documents d USING (doc_id)
)"""
