"""Best-fit packing of tokenized documents into sequences, by hierarchical residual packing.

Each input partition tokenizes its documents, cuts those over the capacity, and packs its pieces best-fit, largest
first. Nearly full bins are final. The underfull ones travel on as single items: a tree of rounds merges those of
FAN_IN nodes, again best-fit. After a best-fit round at most one bin is half empty, so of the others only the
emptiest KEPT can still take something in; the rest are final too, which bounds what a node holds at any size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, shared_folder, written
from .tokens import encoder, vocabulary

CAPACITY = 4096
FAN_IN = 32
KEPT = 128
#: Bins with no more room than this are final at once.
NEARLY_FULL = 8
#: Pieces packed together in a partition before their bins are handed on.
AT_ONCE = 50_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, open boolean, filled int"
BINS = "bin long, root long, base long, filled int, open boolean"


class BestFit:
    """Bins of one capacity; an item goes where it leaves least room."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.rooms = 0  # bit r is set if a bin has room r
        self.filled: list[int] = []

    def open(self, filled: int) -> int:
        self.filled.append(filled)
        self._put(len(self.filled) - 1)
        return len(self.filled) - 1

    def _put(self, b: int) -> None:
        room = self.capacity - self.filled[b]
        if room:
            self.by_room[room].append(b)
            self.rooms |= 1 << room

    def add(self, size: int) -> tuple[int, int]:
        """The bin and the place in it."""
        fitting = self.rooms >> size
        if not fitting:
            return self.open(size), 0
        room = size + (fitting & -fitting).bit_length() - 1
        b = self.by_room[room].pop()
        if not self.by_room[room]:
            self.rooms &= ~(1 << room)
        place = self.filled[b]
        self.filled[b] += size
        self._put(b)
        return b, place


def pack_locally(capacity: int, path: str, end_id: int):
    """Batches of (doc_id, text) to pieces with bins of their own partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx = TaskContext.get()
        first = (ctx.partitionId() if ctx else 0) << 32
        encode, end = encoder(path).encode, np.array([end_id], "<u4").tobytes()
        kept: list[tuple[int, int]] = []  # (bin, filled) that later pieces of this partition may still enter
        used = 0
        held: list[tuple[int, int, int, int, int]] = []

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal kept, used
            fit = BestFit(capacity)
            names = [b for b, _ in kept]
            for _, filled in kept:
                fit.open(filled)
            order = sorted(range(len(held)), key=lambda i: (-held[i][3], held[i][:3]))
            placed = [(0, 0)] * len(held)
            for i in order:
                placed[i] = fit.add(held[i][3])
            names += range(first + used, first + used + len(fit.filled) - len(kept))
            used += len(fit.filled) - len(kept)
            loose = sorted((b for b, f in enumerate(fit.filled) if capacity - f > NEARLY_FULL), key=lambda b: (fit.filled[b], b))
            if not last:
                # a piece that went into a bin that stays open is told so; the bin's final filling comes with its last piece
                loose = loose[: 8 * KEPT]
            else:
                loose = loose[:KEPT]
            kept = [(names[b], fit.filled[b]) for b in loose]
            touched = set(loose)
            cols = list(zip(*held)) if held else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()),
                    pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64()),
                    pa.array([names[b] for b, _ in placed], pa.int64()), pa.array([p for _, p in placed], pa.int64()),
                    pa.array([b in touched for b, _ in placed], pa.bool_()), pa.array([fit.filled[b] for b, _ in placed], pa.int32()),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset", "open", "filled"],
            )
            held.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                for doc, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist()), strict=True):
                    ids += end
                    for n, at_byte in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at_byte : at_byte + 4 * capacity]
                        held.append((doc, n, at_byte // 4, len(own) // 4, zlib.crc32(own)))
                if len(held) >= AT_ONCE:
                    held[:] = [(d, *x) for d, *x in held]
                    yield from flush(False)
        yield from flush(True)

    return run


def merge_node(capacity: int):
    """Underfull bins of one node of the tree: each row keeps the bin, and gets the sequence it ends in and its place there."""

    def run(key, table):
        t = table.select(["bin", "root", "base", "filled"]).to_pandas()
        roots = t[t.bin == t.root].sort_values(["filled", "root"], ascending=[False, True])
        fit, host, place = BestFit(capacity), {}, {}
        names: list[int] = []
        for root, filled in zip(roots.root.tolist(), roots.filled.tolist(), strict=True):
            b, at = fit.add(filled)
            if b == len(names):
                names.append(root)
            host[root], place[root] = b, at
        loose = {b for b in sorted(range(len(names)), key=lambda b: (fit.filled[b], names[b]))[:KEPT] if capacity - fit.filled[b] > NEARLY_FULL}
        hosts = [host[r] for r in t.root.tolist()]
        return pa.table(
            {
                "bin": pa.array(t.bin, pa.int64()),
                "root": pa.array([names[b] for b in hosts], pa.int64()),
                "base": pa.array([x + place[r] for x, r in zip(t.base.tolist(), t.root.tolist(), strict=True)], pa.int64()),
                "filled": pa.array([fit.filled[b] for b in hosts], pa.int32()),
                "open": pa.array([b in loose for b in hosts], pa.bool_()),
            }
        )

    return run


def best_fit_pack(
    docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document's ids are those of its text and end_id. Null and empty texts are the end id alone; a null doc_id and
    repeated rows stay, each packed by itself; an empty table gives none. Documents over the capacity are cut.
    """
    spark = docs.sparkSession
    pieces = written(id_and_text(docs, id_col, text_col).mapInArrow(pack_locally(capacity, vocabulary(tokenizer), end_id), PIECES), "pieces")
    # a bin that was open for a while shows its last filling in its last piece
    bins = pieces.groupBy("bin").agg(F.max("filled").alias("filled"), F.max_by("open", "filled").alias("open")).where("open")
    level, folder = bins.select("bin", F.col("bin").alias("root"), F.lit(0).cast("long").alias("base"), "filled", "open"), shared_folder(spark, "bins")
    final, depth = [], 0
    top = pieces.agg(F.max(F.shiftright("bin", 32))).first()[0] or 0
    while True:
        width = FAN_IN ** (depth + 1)
        node = F.floor(F.shiftright("root", 32) / F.lit(width)).alias("node")
        merged = level.groupBy(node).applyInArrow(merge_node(capacity), BINS)
        level = written(merged, "bins", f"{folder}/level-{depth}")
        if width > top:
            final.append(level)
            break
        final.append(level.where("NOT open"))
        level, depth = level.where("open"), depth + 1
    moved = final[0]
    for x in final[1:]:
        moved = moved.unionByName(x)
    moved = moved.select("bin", "root", "base")
    # bins that never left their partition need no join; each of the others has one row here
    return (
        pieces.join(moved, "bin", "left")
        .select(
            "doc_id", "piece", "start", "length", "ids_crc32",
            F.coalesce("root", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset"),
        )
    )
