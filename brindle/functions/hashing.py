"""Content identity. SHA-256 stands for any collision-free digest: equal contents, equal ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_id(content: Column) -> Column:
    return F.sha2(content, 256)


def partial_id(content: Column, n: int = 4096) -> Column:
    return F.sha2(F.substring(content.cast("binary"), 1, n), 256)


def location_id(volume: Column, path: Column) -> Column:
    return F.sha2(F.concat(volume, F.lit(":"), path), 256)


def directory_id(path: Column) -> Column:
    return F.sha2(F.concat(F.lit("dir-v1|"), path), 256)


def deferred_id(volume: Column, fid: Column, mtime: Column, size: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit("deferred-v1"), F.length(volume), volume, fid, mtime, size), 256)


def inode_key(volume: Column, inode: Column, mtime: Column, size: Column) -> Column:
    """v2:<length>:<volume>:<inode>:<mtime>:<size>, numbers as 16 hex digits."""
    return F.format_string("v2:%d:%s:%016x:%016x:%016x", F.length(volume), volume, inode, mtime, size)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
