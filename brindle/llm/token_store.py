"""A content-addressed store of token ids.

A rolling hash over the ids cuts each document's stream into chunks, so equal passages give equal chunks. A chunk is
stored once, under the SHA-256 of its bytes. A document's recipe lists its chunks; recipes lie in ascending doc_id
order, in numbered files, with the place of the document in its file's stream and the Merkle root of its chunks. The
manifest holds, for each recipe file, its place in the whole stream and the Merkle root of its recipes' roots. Reading
verifies all three levels. Three Parquet tables make the format: chunks (in staged), recipes, manifest.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import id_and_text, mix, shared_folder
from .tokens import encoder, vocabulary

#: Least, usual and most ids of a chunk, and the ids that the rolling hash sees.
LEAST, USUAL, MOST, WINDOW = 128, 512, 4096, 16

#: Recipes of one file, at most about so many: what a task that orders or places them handles.
FILE = 200_000

STAGED = "kind string, name binary, doc_id long, n_tokens long, chunks array<binary>, sizes array<int>, root binary, ids binary"
RECIPES = "file int, pos long, before long, doc_id long, n_tokens long, chunks array<binary>, sizes array<int>, root binary"
MANIFEST = "file int, n_tokens long, n_docs long, root binary"


def rolling_hits(ids: np.ndarray) -> np.ndarray:
    """Places where a chunk may end: the hash of the WINDOW ids before them says so."""
    if len(ids) < WINDOW:
        return np.zeros(0, np.int64)
    g = mix(ids.astype(np.uint64))
    n = len(ids) - WINDOW + 1
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for i in range(WINDOW):
            h = h * np.uint64(0x9E3779B97F4A7C15) + g[i : n + i]
    return np.flatnonzero((h >> np.uint64(33)) % np.uint64(USUAL - LEAST) == 0) + WINDOW


def cuts(n: int, hits: list[int]) -> list[int]:
    """Where the chunks of n ids end, given the hits. A chunk has LEAST ids or more, so no hash reaches beyond it."""
    ends, last = [], 0
    for e in [*hits, n]:
        while e - last > MOST:
            last += MOST
            ends.append(last)
        if e - last >= LEAST or e == n > last:
            ends.append(e)
            last = e
    return ends


def merkle(names: list[bytes]) -> bytes:
    """The root of a binary tree of SHA-256 over the names; an odd one out moves up as it is."""
    level = names or [b""]
    while len(level) > 1:
        level = [hashlib.sha256(b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def packed(ids: np.ndarray) -> bytes:
    """b'2' or b'4' for the bytes of an id, then the ids, little-endian."""
    return b"2" + ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 65536 else b"4" + ids.astype("<u4").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u2" if data[:1] == b"2" else "<u4", offset=1).astype("<u4")


def stage(path: str, end_id: int):
    """Batches of (doc_id, text) to rows of new chunks and of recipes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx = TaskContext.get()
        where, count, sent = ctx.partitionId() if ctx else 0, 0, set()
        encode, end = encoder(path).encode, np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part, rows = batch.slice(at, 500), []
                streams = [x + end for x in encode(part.column(1).to_pylist())]
                whole = np.frombuffer(b"".join(streams), "<u4")
                hits, narrow, first = rolling_hits(whole), packed(whole), 0
                width = int(narrow[:1])
                for doc, data in zip(part.column(0).to_pylist(), streams, strict=True):
                    n = len(data) // 4
                    inside = hits[np.searchsorted(hits, first + LEAST) : np.searchsorted(hits, first + n)] - first
                    names, sizes, last = [], [], 0
                    for e in cuts(n, inside.tolist()):
                        own = narrow[:1] + narrow[1 + width * (first + last) : 1 + width * (first + e)]
                        if width == 4:  # the width is each chunk's own, whatever stands beside it
                            own = packed(unpacked(own))
                        name = hashlib.sha256(own).digest()
                        if name not in sent:
                            sent.add(name)
                            rows.append(("chunk", name, None, None, None, None, None, own))
                        names.append(name)
                        sizes.append(e - last)
                        last = e
                    first += n
                    rows.append(("recipe", f"{where}/{count}".encode(), doc, n, names, sizes, merkle(names), None))
                    count += 1
                if len(sent) > 200_000:
                    sent.clear()
                kinds = [pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)],
                    names=["kind", "name", "doc_id", "n_tokens", "chunks", "sizes", "root", "ids"],
                )

    return run


def write_store(docs: DataFrame, folder: str, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the store of all whole texts below folder.

    Null and empty texts are the end id alone. A null doc_id comes first; rows of one doc_id stand in the order of
    their Merkle roots, repeated rows each for themselves. An empty table gives empty tables.
    """
    spark = docs.sparkSession
    staged = id_and_text(docs, id_col, text_col).mapInArrow(stage(vocabulary(tokenizer), end_id), STAGED)
    # one pass: recipes have names of their own, so only chunks are ever equal; copies go before the shuffle and after it
    staged.dropDuplicates(["kind", "name"]).write.partitionBy("kind").option("compression", "zstd").parquet(f"{folder}/staged")
    # the staged chunks are the stored chunks; the recipes get their order and places
    recipes = _part(spark, folder, "recipe").select("doc_id", "n_tokens", "chunks", "sizes", "root", "name")
    order = [F.asc_nulls_first("doc_id"), F.col("root"), F.col("name")]
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-recipes.count() // FILE))
    ordered = recipes.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_placed, RECIPES)
    ordered.write.option("compression", "zstd").parquet(f"{folder}/recipes")
    _sealed(_recipes(spark, folder)).write.parquet(f"{folder}/manifest")


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted partition's recipes with its number as their file, and their places in it."""
    file, pos, before = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        sizes = batch.column("n_tokens").to_numpy()
        n = len(sizes)
        places = before + np.cumsum(sizes) - sizes
        numbers = [pa.array(np.full(n, file, np.int32)), pa.array(np.arange(pos, pos + n)), pa.array(places)]
        yield pa.RecordBatch.from_arrays([*numbers, *batch.columns[:5]], names=["file", "pos", "before", *batch.schema.names[:5]])
        pos, before = pos + n, before + int(sizes.sum())


def _sealed(recipes: DataFrame) -> DataFrame:
    """One row a recipe file, of about FILE rows at most: its numbers and its Merkle root."""

    def seal(table: pa.Table) -> pa.Table:
        rows = table.sort_by("pos")
        root = merkle(rows["root"].to_pylist())
        return pa.table({"file": rows["file"].slice(0, 1), "n_tokens": pa.array([sum(rows["n_tokens"].to_pylist())], pa.int64()), "n_docs": pa.array([rows.num_rows], pa.int64()), "root": pa.array([root], pa.binary())})

    return recipes.select("file", "pos", "n_tokens", "root").groupBy("file").applyInArrow(seal, MANIFEST)


def _recipes(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(RECIPES).parquet(f"{folder}/recipes")


def places(spark: SparkSession, folder: str) -> DataFrame:
    """file, place: where each recipe file begins in the whole stream. An error if its recipes aren't those of the manifest."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    running = F.coalesce(F.sum("n_tokens").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row a file
    read = _sealed(_recipes(spark, folder)).select("file", *[F.col(c).alias(f"own_{c}") for c in ("n_tokens", "n_docs", "root")])
    good = (F.col("root") == F.col("own_root")) & (F.col("n_tokens") == F.col("own_n_tokens")) & (F.col("n_docs") == F.col("own_n_docs"))
    bad = F.raise_error(F.concat(F.lit("recipe file "), F.col("file"), F.lit(" isn't what the manifest says"))).cast("long")
    return manifest.withColumn("place", running).join(read, "file", "full").select("file", F.when(good, F.col("place")).otherwise(bad).alias("place"))


def _part(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    return spark.read.schema(STAGED).parquet(f"{folder}/staged").where(F.col("kind") == kind)


def read_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return _part(spark, folder, "chunk").select("name", "ids")


def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks to their names, numbers of ids and CRC-32; an error if the bytes aren't those of the name."""
    for batch in batches:
        names, data = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for name, own in zip(names, data, strict=True):
            if hashlib.sha256(own).digest() != name:
                raise ValueError(f"chunk {name.hex()} is damaged")
        ids = [unpacked(x) for x in data]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())], names=["name", "n", "crc"]
        )


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products in the field of CRC-32 (bits reversed: x to the 0 is the highest bit)."""
    out, a, b = np.zeros_like(a), a.copy(), b.copy()
    for i in range(32):
        out ^= np.where((a >> np.uint32(31 - i)) & np.uint32(1), b, np.uint32(0))
        b = np.where(b & np.uint32(1), (b >> np.uint32(1)) ^ np.uint32(0xEDB88320), b >> np.uint32(1))
    return out


@cache
def _shift_tables(bit: int) -> np.ndarray:
    """4 x 256: what the four bytes of a CRC-32 become when 2**bit zero bytes follow, to be XORed."""
    power = np.array([1 << 23], np.uint32)  # x to the 8: one byte
    for _ in range(bit):
        power = _times(power, power)
    values = np.arange(256, dtype=np.uint32)
    return np.array([_times(values << np.uint32(8 * i), np.repeat(power, 256)) for i in range(4)])


def crc_before(crc: np.ndarray, follow: np.ndarray) -> np.ndarray:
    """What a part with this CRC-32 adds to that of a whole in which so many bytes follow; the parts' shares are XORed."""
    out, follow = crc.astype(np.uint32), follow.astype(np.int64)
    for bit in range(int(follow.max(initial=0)).bit_length()):
        odd = np.flatnonzero((follow >> bit) & 1)
        if len(odd):
            t, x = _shift_tables(bit), out[odd]
            out[odd] = t[0][x & 255] ^ t[1][(x >> 8) & 255] ^ t[2][(x >> 16) & 255] ^ t[3][x >> 24]
    return out


def _chunks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Recipes to one row a chunk, with the ids that follow it; an error if a recipe's root isn't that of its chunks."""
    for batch in batches:
        roots, names, sizes = (batch.column(c).to_pylist() for c in ("root", "chunks", "sizes"))
        for root, own in zip(roots, names, strict=True):
            if merkle(own) != root:
                raise ValueError(f"a recipe isn't that of root {root.hex()}")
        n = np.array([len(x) for x in names], np.int64)
        flat = np.concatenate([np.asarray(x, np.int64) for x in sizes]) if len(sizes) else np.zeros(0, np.int64)
        ends, total = np.cumsum(flat), np.cumsum(n)
        last = np.append(0, ends)[total]  # ids up to the end of each document
        cols = [pa.array(np.repeat(batch.column(c).to_numpy(), n)) for c in ("file", "pos")]
        cols += [pa.array([x for own in names for x in own], pa.binary()), pa.array(np.repeat(last, n) - ends), pa.array(flat)]
        yield pa.RecordBatch.from_arrays(cols, names=["file", "pos", "name", "follow", "size"])


def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        c = dict(zip(batch.schema.names, batch.columns, strict=True))
        share = crc_before(c["crc"].to_numpy(zero_copy_only=False), 4 * c["follow"].to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([c["file"], c["pos"], c["n"], pa.array(share.astype(np.int64))], names=["file", "pos", "n", "share"])


def digest(spark: SparkSession, folder: str) -> DataFrame:
    """From the files: doc_id, start, n_tokens, ids_crc32 of each document, in no order.

    Every chunk is read and checked against its name once, every recipe's root against its chunks, every file's root
    against the manifest. A document's CRC-32 is put together from those of its chunks, so that a chunk that many
    documents share isn't copied to all of them.
    """
    chunks = read_chunks(spark, folder).mapInArrow(checked, "name binary, n long, crc long")
    recipes = _recipes(spark, folder)
    parts = recipes.select("file", "pos", "chunks", "sizes", "root").mapInArrow(_chunks_of, "file int, pos long, name binary, follow long, size long")
    found = parts.join(chunks, "name").where("size = n").select("file", "pos", "n", "crc", "follow").mapInArrow(shares, "file int, pos long, n long, share long")
    crcs = found.groupBy("file", "pos").agg(F.bit_xor("share").alias("ids_crc32"), F.sum("n").alias("n"))
    whole = F.when(F.col("n") == F.col("n_tokens"), F.col("n_tokens")).otherwise(F.raise_error(F.lit("a document lacks chunks")).cast("long"))
    out = recipes.select("file", "pos", "before", "doc_id", "n_tokens").join(crcs, ["file", "pos"], "left").join(places(spark, folder), "file")
    return out.select("doc_id", (F.col("place") + F.col("before")).alias("start"), whole.alias("n_tokens"), "ids_crc32")


def restore(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, ids (array<int>): the streams themselves, put together again; the roots are checked."""

    def join(key, table):
        rows = sorted(table.to_pylist(), key=lambda r: r["at"])
        if merkle([r["name"] for r in rows]) != rows[0]["root"]:
            raise ValueError(f"document {rows[0]['doc_id']} isn't what was written")
        ids = np.concatenate([unpacked(r["ids"]) for r in rows]).astype(np.int32)
        return pa.table({"doc_id": pa.array([rows[0]["doc_id"]], pa.int64()), "start": pa.array([rows[0]["start"]], pa.int64()), "ids": pa.array([ids.tolist()], pa.list_(pa.int32()))})

    recipes = _recipes(spark, folder).join(places(spark, folder), "file").withColumn("start", F.col("place") + F.col("before"))
    parts = recipes.select("file", "pos", "doc_id", "start", "root", F.posexplode("chunks").alias("at", "name"))
    return parts.join(read_chunks(spark, folder), "name").groupBy("file", "pos").applyInArrow(join, "doc_id long, start long, ids array<int>")


def encode_and_read_back(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2) -> DataFrame:
    folder = shared_folder(docs.sparkSession, "tokens")
    write_store(docs, folder, tokenizer, end_id)
    return digest(docs.sparkSession, folder)
