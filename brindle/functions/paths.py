"""Path and name functions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 4096

# File categories and the extensions they stand for.
CATEGORIES = {
    "Video": "mp4 mkv avi mov wmv flv webm m4v mpg mpeg 3gp m2ts mts",
    "Image": "jpg jpeg png gif bmp webp svg ico tiff tif heic heif avif raw cr2 nef psd",
    "Audio": "mp3 flac wav aac ogg wma m4a opus aiff alac",
    "Document": "pdf doc docx xls xlsx ppt pptx txt rtf odt ods odp csv md epub",
    "Code": "rs py js ts jsx tsx html css c cpp h hpp java go rb php swift kt scala zig toml yaml yml json xml sh bash ps1 sql graphql proto lua dart",
    "Archive": "zip tar gz bz2 xz 7z rar zst lz4 lzma cab iso dmg",
    "Executable": "exe msi app deb rpm appimage snap flatpak dll so dylib",
    "Font": "ttf otf woff woff2 eot",
}
# Media types by extension.
MIME = {
    "pdf": "application/pdf", "doc": "application/msword", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xls": "application/vnd.ms-excel", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "ppt": "application/vnd.ms-powerpoint",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation", "odt": "application/vnd.oasis.opendocument.text",
    "ods": "application/vnd.oasis.opendocument.spreadsheet", "csv": "text/csv", "txt": "text/plain", "md": "text/markdown", "markdown": "text/markdown",
    "html": "text/html", "htm": "text/html", "css": "text/css", "xml": "application/xml", "json": "application/json", "yaml": "application/yaml",
    "yml": "application/yaml", "toml": "application/toml", "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif",
    "webp": "image/webp", "svg": "image/svg+xml", "bmp": "image/bmp", "ico": "image/x-icon", "tiff": "image/tiff", "tif": "image/tiff", "avif": "image/avif",
    "heic": "image/heic", "heif": "image/heif", "mp4": "video/mp4", "mkv": "video/x-matroska", "avi": "video/x-msvideo", "mov": "video/quicktime",
    "wmv": "video/x-ms-wmv", "webm": "video/webm", "flv": "video/x-flv", "mp3": "audio/mpeg", "wav": "audio/wav", "ogg": "audio/ogg", "flac": "audio/flac",
    "aac": "audio/aac", "m4a": "audio/mp4", "wma": "audio/x-ms-wma", "zip": "application/zip", "tar": "application/x-tar", "gz": "application/gzip",
    "gzip": "application/gzip", "bz2": "application/x-bzip2", "xz": "application/x-xz", "7z": "application/x-7z-compressed", "rar": "application/vnd.rar",
    "zst": "application/zstd", "zstd": "application/zstd", "rs": "text/x-rust", "py": "text/x-python", "js": "text/javascript", "ts": "text/typescript",
    "go": "text/x-go", "java": "text/x-java", "c": "text/x-c", "cpp": "text/x-c++", "cc": "text/x-c++", "cxx": "text/x-c++", "h": "text/x-c-header",
    "hpp": "text/x-c-header", "rb": "text/x-ruby", "sh": "text/x-shellscript", "bash": "text/x-shellscript", "sql": "application/sql",
    "exe": "application/x-msdownload", "dll": "application/x-msdownload", "so": "application/x-sharedlib", "dmg": "application/x-apple-diskimage",
    "msi": "application/x-msi", "deb": "application/vnd.debian.binary-package", "rpm": "application/x-rpm", "appimage": "application/x-executable",
    "ttf": "font/ttf", "otf": "font/otf", "woff": "font/woff", "woff2": "font/woff2",
}
# Directory names of build output and caches.
BUILD_ARTIFACTS = [
    "node_modules", "target", "__pycache__", ".git/objects", "dist", ".next", ".nuxt", "build", ".gradle", ".cache", "vendor", ".tox",
    ".pytest_cache", ".mypy_cache", "egg-info",
]
# Path components that decide how soon a directory is scanned, first rung that matches.
SCAN_RUNGS = [
    (4, ["node_modules", ".git", "target", "__pycache__", ".tox", ".mypy_cache", "dist", "build", ".next", ".nuxt", ".cache", "vendor", ".gradle", ".m2"]),
    (3, ["appdata", ".local", ".config", "library", ".cache", ".thumbnails", "temp", "tmp"]),
    (0, ["desktop", "documents", "downloads", "pictures", "photos"]),
    (1, ["music", "videos", "movies", "home"]),
    (2, ["program files", "program files (x86)", "programdata", "usr", "opt", "etc", "var"]),
]


def _lookup(pairs: dict[str, str], key: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return F.try_element_at(table, key)


def name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    """The path without its last component; null at the top."""
    cut = F.substring(path, F.lit(1), F.length(path) - F.length(name(path)) - 1)
    return F.nullif(cut, F.lit(""))


def extension(file_name: Column) -> Column:
    """After the last dot, unless that is the first character; null if there is none."""
    return F.nullif(F.regexp_extract(file_name, r"^.+\.([^.]*)$", 1), F.lit(""))


def depth(path: Column) -> Column:
    """Components, the root included."""
    return F.size(F.filter(F.split(path, "/"), lambda x: x != "")) + 1


def ancestors(path: Column) -> Column:
    """All proper prefixes of an absolute path, the topmost first."""
    parts = F.split(path, "/")
    inner = F.transform(F.sequence(F.lit(2), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return F.when(F.size(parts) > 2, inner).otherwise(F.array().cast("array<string>"))


def category(ext: Column) -> Column:
    pairs = {e: c for c, es in CATEGORIES.items() for e in es.split()}
    return F.coalesce(_lookup(pairs, F.lower(ext)), F.lit("Other"))


def mime(ext: Column) -> Column:
    return _lookup(MIME, F.lower(ext))


def allocated(size: Column) -> Column:
    """Whole blocks; none for an empty file."""
    return F.floor((size + (BLOCK - 1)) / BLOCK).cast("long") * BLOCK


def scan_priority(path: Column) -> Column:
    parts = F.split(F.lower(path), r"[/\\]")
    rungs = [F.when(F.arrays_overlap(parts, F.array(*map(F.lit, names))), F.lit(rung)) for rung, names in SCAN_RUNGS]
    return F.coalesce(*rungs, F.lit(2))


def volume_id(path: Column) -> Column:
    """C of C:\\, wsl:<distro> of a WSL share, root of /, else the last component."""
    wsl = F.regexp_extract(path, r"(?i)^[\\/]{2}wsl(?:\.localhost|\$)[\\/]([^\\/]+)", 1)
    drive = F.regexp_extract(path, r"^([A-Za-z]):[\\/]*$", 1)
    last = F.regexp_extract(path, r"([^\\/]+)[\\/]*$", 1)
    return F.when(wsl != "", F.concat(F.lit("wsl:"), wsl)).when(drive != "", F.upper(drive)).when(last == "", "root").otherwise(last)


def is_build_artifact(dir_name: Column) -> Column:
    return F.lower(dir_name).isin(BUILD_ARTIFACTS)


def in_build_artifact(path: Column) -> Column:
    inside = ["node_modules", "target", "__pycache__", ".git/objects", "dist"]
    return reduce(lambda a, b: a | b, [path.ilike(f"%/{d}/%") for d in inside])


def has_copy_pattern(file_name: Column) -> Column:
    low = F.lower(file_name)
    numbered = F.regexp_extract(low, r"^.* \(([0-9]{1,2})\)", 1)
    return (
        low.contains("copy of ") | low.contains(" - copy") | low.contains(" copy.")
        | (F.coalesce(F.try_to_number(numbered, F.lit("99")), F.lit(0)) > 0)
        | F.substring_index(low, ".", 1).rlike("~[123]$")
    )


def normalized_name(file_name: Column) -> Column:
    """Lower case, no extension, no marks of a copy."""
    low = F.lower(file_name)
    stem = F.regexp_replace(low, r"\.[^.]*$", "")
    bare = F.regexp_replace(F.regexp_replace(stem, "^copy of ", ""), " - copy$", "")
    return F.trim(F.regexp_replace(bare, r"(\s* \([0-9]*\))+\s*$", ""))
