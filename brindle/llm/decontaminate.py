"""Benchmark decontamination: SimHash fingerprints of item-sized windows, found by multi-index Hamming blocks, verified.

Every item has a fingerprint over its five-word shingles. A document is slid over in windows of each item length. Of
the windows only those that share a shingle with an item of their length can be similar to one; these get fingerprints. Fingerprints
are cut into RADIUS + 1 blocks of bits: two within RADIUS agree in a block, so looking up each block finds all of
them. Candidates are verified by the exact weighted Jaccard similarity of shingles, weights being counts.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, id_and_text, mix, pick, shingle_rows, shingles, written

SIMILARITY = 0.8
#: Texts of similarity 0.8 have fingerprints about 9 of 64 bits apart; beyond 22 are fewer than one in a thousand pairs.
RADIUS = 22
#: Items, and their characters, that are sent to the executors at once; more items are searched block after block.
ITEMS_AT_ONCE, CHARS_AT_ONCE = 5_000, 8_000_000
WORDS = 5


def lowered(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def signs(shingle: np.ndarray) -> np.ndarray:
    """n x 64 of 1 and -1: the bits of each shingle's hash."""
    bits = np.unpackbits(mix(shingle, 11).view(np.uint8).reshape(-1, 8), axis=1)
    return bits.astype(np.int32) * 2 - 1


def fingerprint(sums: np.ndarray) -> np.ndarray:
    """Rows of 64 sums to 64-bit numbers: a bit is set where the sum is positive."""
    return np.packbits(sums > 0, axis=1).reshape(-1, 8).copy().view(np.uint64).ravel()


class Items:
    """Items by length, each length with its multi-index; items of fewer words than a shingle by their phrases."""

    def __init__(self, items: list[tuple[int, str]], radius: int = RADIUS) -> None:
        self.radius, self.hasher = radius, WordHasher()
        self.width = 64 // (radius + 1)
        self.bags: list[tuple[int, Counter]] = []
        self.by_length: dict[int, tuple[np.ndarray, list[int], list[dict[int, list[int]]]]] = {}
        #: By words of a phrase (less than WORDS), and for all longer items: hashes of shingles, ascending, and whose they are.
        self.known: dict[int, tuple[np.ndarray, list[list[int]]]] = {}
        prints: dict[int, list[tuple[int, int]]] = defaultdict(list)
        owners: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            words = lowered(text)
            s = shingles(self.hasher(words), WORDS)
            k = min(len(words), WORDS)
            for x in s.tolist():  # of a phrase the item, else the length of the item
                owners[k][x].add(item if k < WORDS else len(words))
            if k == WORDS:
                prints[len(words)].append((len(self.bags), int(fingerprint(signs(s).sum(0, keepdims=True))[0])))
                self.bags.append((item, Counter(s.tolist())))
        for k, of in owners.items():
            names = sorted(of)
            self.known[k] = np.array(names, np.uint64), [sorted(of[x]) for x in names]
        #: The items' words, numbered from 1: so many of them in a row must stand where a shingle of an item is to be.
        names = sorted({w for _, text in items for w in lowered(text)})
        self.number = {w: i for i, w in enumerate(names, 1)}
        self.hashes = np.concatenate([np.zeros(1, np.uint64), self.hasher(names)])
        for length, rows in prints.items():
            tables: list[dict[int, list[int]]] = [defaultdict(list) for _ in range(-(-64 // self.width))]
            for at, (_, p) in enumerate(rows):
                for b, table in enumerate(tables):
                    table[(p >> (b * self.width)) & ((1 << self.width) - 1)].append(at)
            self.by_length[length] = (np.array([p for _, p in rows], np.uint64), [i for i, _ in rows], tables)

    def near(self, length: int, prints: np.ndarray) -> Iterator[tuple[int, int]]:
        """(window, item) of all fingerprints within the radius."""
        own, names, tables = self.by_length[length]
        mask = np.uint64((1 << self.width) - 1)
        seen = np.zeros((len(prints), len(own)), bool)
        for b, table in enumerate(tables):
            keys = (prints >> np.uint64(b * self.width)) & mask
            for key, at in table.items():
                seen[np.ix_(keys == np.uint64(key), at)] = True
        w, i = np.nonzero(seen)
        close = np.bitwise_count(prints[w] ^ own[i]) <= self.radius
        for x, y in zip(w[close].tolist(), i[close].tolist(), strict=True):
            yield x, names[y]

    def hits(self, numbers: np.ndarray, unknown: np.ndarray, k: int) -> dict[int, list[int]]:
        """By owner, where shingles of k words stand that are an item's: no other place can be in a similar window."""
        out: dict[int, list[int]] = defaultdict(list)
        if len(numbers) < k:
            return out
        may = np.flatnonzero(unknown[k:] == unknown[:-k])
        if len(may):
            s = shingle_rows(self.hashes[numbers[may[:, None] + np.arange(k)]])
            names, owners = self.known[k]
            at = np.minimum(np.searchsorted(names, s), len(names) - 1)
            for place, i in zip(may[names[at] == s].tolist(), at[names[at] == s].tolist(), strict=True):
                for owner in owners[i]:
                    out[owner].append(place)
        return out

    def search(self, text: str, threshold: float) -> dict[int, float]:
        """Items in the text and their best similarities."""
        words = lowered(text)
        numbers = np.fromiter(map(self.number.get, words, repeat(0)), np.int32, len(words))
        unknown = np.concatenate([[0], np.cumsum(numbers == 0)])
        found: dict[int, float] = {}
        for k in self.known:
            hits = self.hits(numbers, unknown, k)
            if k < WORDS:
                found |= dict.fromkeys(hits, 1.0)
            elif hits:
                s = shingles(self.hasher(words), WORDS)
                for length, places in hits.items():
                    self.windows(s, length, np.array(places), threshold, found)
        return found

    def windows(self, s: np.ndarray, length: int, hits: np.ndarray, threshold: float, found: dict[int, float]) -> None:
        n = length - WORDS + 1  # shingles of a window
        last = max(0, len(s) - n)
        # the windows that hold a hit, in runs
        reach = np.zeros(last + 2, np.int64)
        np.add.at(reach, np.clip(hits - n + 1, 0, last), 1)
        np.add.at(reach, np.minimum(hits, last) + 1, -1)
        starts = np.flatnonzero(np.cumsum(reach[:-1]) > 0)
        for part in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
            for i in range(0, len(part), 4096):
                run = part[i : i + 4096]
                region = s[run[0] : run[-1] + n]
                sums = np.vstack([np.zeros((1, 64), np.int32), np.cumsum(signs(region), 0)])
                ends = np.minimum(run - run[0] + n, len(region))
                prints = fingerprint(sums[ends] - sums[run - run[0]])
                for w, item in self.near(length, prints):
                    name, bag = self.bags[item]
                    own = Counter(s[run[w] : run[w] + n].tolist())
                    both = (own & bag).total()
                    value = both / (own.total() + bag.total() - both)
                    if value >= threshold and value > found.get(name, 0.0):
                        found[name] = value


def _search(items: list[tuple[int, str]], radius: int, threshold: float):
    """Rows of text, found (item_ids, similarity) and whatever else to the same with what these items add."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Items(items, radius)
        for batch in batches:
            before = batch.column("found").to_pylist()
            more = [index.search(t or "", threshold) for t in batch.column("text").to_pylist()]
            now = [{"item_ids": sorted({*b["item_ids"], *f}), "similarity": max([b["similarity"], *f.values()])} for b, f in zip(before, more, strict=True)]
            at = batch.schema.get_field_index("found")
            yield batch.set_column(at, batch.schema.field(at), pa.array(now, batch.schema.field(at).type))

    return run


def _searched(rows: DataFrame, benchmark: DataFrame, threshold: float, radius: int, at_once: int) -> DataFrame:
    """rows (text and other columns) with found, a struct of item_ids and similarity."""
    items = pick(benchmark, item_id="item_id", text="text").where("item_id IS NOT NULL AND text IS NOT NULL")
    n, chars = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // at_once), -(-chars // CHARS_AT_ONCE))
    out = rows.withColumn("found", F.struct(F.array().cast("array<long>").alias("item_ids"), F.lit(0.0).alias("similarity")))
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()  # about at_once items
        if b:  # a pass of its own, so that a task holds one block of items
            out = written(out, "searched")
        out = out.mapInArrow(_search([(r.item_id, r.text) for r in own], radius, threshold), out.schema)
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame, threshold: float = SIMILARITY, radius: int = RADIUS, at_once: int = ITEMS_AT_ONCE) -> DataFrame:
    """The rows of docs without items, with all their columns."""
    rows = docs.select(F.col("text").cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("rest"))
    kept = _searched(rows, benchmark, threshold, radius, at_once).where(F.size("found.item_ids") == 0)
    return kept.select(*["text" if c == "text" else F.col(f"rest.`{c}`") for c in docs.columns])


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = SIMILARITY, radius: int = RADIUS, at_once: int = ITEMS_AT_ONCE) -> DataFrame:
    """One row a document: doc_id, contaminated, n_items, item_ids (ascending), similarity (the best, 0 without items).

    Words are split at white space, A-Z lower-cased. Items of fewer than five words are found as phrases, word by
    word; items of null id or without a word identify nothing; items of one id count as one. Null, empty and short
    texts are clean, unless they hold such a phrase; a null doc_id and repeated rows stay; an empty table gives none,
    an empty benchmark no items.
    """
    found = _searched(id_and_text(docs), benchmark, threshold, radius, at_once)
    size = F.size("found.item_ids").cast("long")
    return found.select("doc_id", (size > 0).alias("contaminated"), size.alias("n_items"), "found.item_ids", "found.similarity")
