"""Repeated passages: MinHash bands over content-anchored paragraphs, exact checks, components of removals.

A shared passage can stand anywhere in a line, so paragraphs are runs of WORDS words that begin where the hash of two
words is the least of some WINDOW in a row: the same passage has the same paragraphs wherever it stands. Bands of
MinHashes over five-word shingles make colliding paragraphs meet in one sorted stream, from which equal ones go to the
places of repeats and buckets of different ones to the search for links; a bucket of any size passes through. There
members are compared with a hub by exact Jaccard similarity, and all pairs that hubs leave undecided with each other
(see near_dedup); links make classes. Of a class that several documents hold, the first stays; what goes of the others
is extended word by word, as long as they agree with the first.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, forget, id_and_text, mix, portions, shared_folder, shingles, written
from .near_dedup import BLOCK, FEW, linked, with_hubs

SIMILARITY = 0.8
WORDS, SHINGLE = 25, 5
#: Each run of so many places has an anchor: passages of WINDOW + WORDS - 1 = 50 words have one, and less than WINDOW
#: words of a passage lie before its first paragraph or behind its last.
WINDOW = 26
#: Similar paragraphs may begin so many words apart; two words inside must agree before words outside are compared.
SHIFT, INSIDE = 2, 2
#: Four bands of two: a similarity of 0.8 collides with probability 0.98, equal paragraphs always.
BANDS, ROWS = 4, 2
#: A bucket's hash has the number of its band in the lowest bits; a row without a band is a place of a repeat.
BAND_BITS = 3
#: Rounds of hubs; more would cost more than comparing the pairs they leave.
HUBS = 1
#: Characters of texts that are hashed together: arrays of their words fit into a processor's cache.
TOGETHER = 200_000
PLACE = "h long, name long, row long, pos int"


def _last_least(x: np.ndarray, width: int) -> np.ndarray:
    """Where the least of each run of width values stands; of equal ones the last."""
    at, span = np.arange(len(x)), 1
    while span < width:
        step = min(span, width - span)
        at = np.where(x[step:] <= x[:-step], at[step:], at[:-step])
        x, span = np.minimum(x[step:], x[:-step]), span + step
    return at


def _minima(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of width values."""
    span = 1
    while span < width:
        step = min(span, width - span)
        x, span = np.minimum(x[step:], x[:-step]), span + step
    return x


def anchored(hashed: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of texts of so many words, one behind another: which texts have paragraphs, one entry for each, and where in all words these begin."""
    first, places = np.cumsum(lengths) - lengths, lengths - WORDS + 1
    some = np.flatnonzero(places > 0)
    if not len(some):
        return some, some
    with np.errstate(over="ignore"):
        pair = mix(hashed[:-1] * np.uint64(3) + hashed[1:], 31) >> np.uint64(1)
    pair = np.r_[pair, np.full(WINDOW, np.iinfo(np.uint64).max, np.uint64)]
    # a text's last words begin no paragraph: a text with fewer places than WINDOW has one run, which they fill up
    none = np.minimum(lengths, WORDS - 1)
    ends = np.cumsum(none)
    pair[np.repeat(first + lengths - none, none) + np.arange(ends[-1]) - np.repeat(ends - none, none)] = np.iinfo(np.uint64).max
    runs = np.maximum(places[some] - WINDOW + 1, 1)
    text = np.repeat(some, runs)
    run = first[text] + np.arange(len(text)) - np.repeat(np.cumsum(runs) - runs, runs)
    at = np.where(places[text] == 1, first[text], _last_least(pair, WINDOW)[run])
    new = np.r_[True, at[1:] != at[:-1]]
    return text[new], at[new]


def paragraphs_of(hashed: np.ndarray, lengths: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts of so many words, one behind another: paragraphs' texts, places, names (hashes of all words) and n x bands band hashes."""
    text, at = anchored(hashed, lengths)
    joint = np.zeros((len(at), bands), np.uint64)
    if not len(at):
        return text, at, hashed[:0], joint
    s = shingles(hashed, SHINGLE)
    name = np.full(len(at), WORDS, np.uint64)
    for i in range(0, WORDS - SHINGLE + 1, SHINGLE):
        name = mix(name ^ s[at + i], 32)
    for b in range(bands):
        for r in range(rows):
            joint[:, b] = mix(joint[:, b] ^ _minima(mix(s, 40 + b * rows + r), WORDS - SHINGLE + 1)[at], b)
    return text, at - (np.cumsum(lengths) - lengths)[text], name, joint


def paragraphs(hashed: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One text's places, names and band hashes."""
    return paragraphs_of(hashed, np.array([len(hashed)]), bands, rows)[1:]


def _batch(h: np.ndarray, name: np.ndarray, row: np.ndarray, pos: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """Rows of PLACE; h is null where place is set."""
    columns = [pa.array(h.view(np.int64), mask=place), pa.array(name.view(np.int64)), pa.array(row.astype(np.int64)), pa.array(pos.astype(np.int32))]
    return pa.RecordBatch.from_arrays(columns, names=["h", "name", "row", "pos"])


def _emit(bands: int, rows: int):
    """(row, text) to band rows of the task's first paragraphs of a name, and the places of names that the task repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, first = WordHasher(), {}
        band = np.arange(bands, dtype=np.uint64)
        for batch in batches:
            for part, texts in portions(batch, 1, 500, TOGETHER):
                words = [text.encode("utf-8", "surrogatepass").split() for text in texts]
                lengths = np.array([len(w) for w in words])
                text, at, name, joint = paragraphs_of(hasher(list(chain.from_iterable(words))), lengths, bands, rows)
                if not len(at):
                    continue
                row = part.column(0).to_numpy()[text]
                places = list(zip(row.tolist(), at.tolist(), strict=True))
                hubs = [first.setdefault(n, p) for n, p in zip(name.tolist(), places, strict=True)]
                new = np.array([hub is p for hub, p in zip(hubs, places, strict=True)])
                old = np.flatnonzero(~new)
                hub_row, hub_pos = np.array([hubs[i] for i in old.tolist()], np.int64).reshape(-1, 2).T
                h = mix(joint[new], 50) & ~np.uint64((1 << BAND_BITS) - 1) | band
                n, both = h.size, np.r_[old, old]
                of_h, of_name = np.r_[h.ravel(), np.zeros(len(both), np.uint64)], np.r_[np.repeat(name[new], bands), name[both]]
                of_row, of_pos = np.r_[np.repeat(row[new], bands), row[old], hub_row], np.r_[np.repeat(at[new], bands), at[old], hub_pos]
                if len(first) > 300_000:
                    first.clear()
                yield _batch(of_h, of_name, of_row, of_pos, np.arange(n + len(both)) >= n)

    return run


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A stream sorted by h, name, row, pos to the places of names that stand in it twice (by the first band), and to the
    members (h, name and its first place) of buckets with several names. Places without a bucket pass."""
    carried = None  # the first rows of the bucket and of the name that the stream is in
    for batch in batches:
        yield batch.filter(batch.column("h").is_null())
        batch = batch.filter(batch.column("h").is_valid())
        if not batch.num_rows:
            continue
        h, name, row, pos = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        skip = 0
        if carried is not None:
            skip = 2
            h, name, row, pos = (np.r_[[a, b], x] for a, b, x in zip(*carried, (h, name, row, pos), strict=True))
        index = np.arange(len(h))
        new_h = np.r_[True, h[1:] != h[:-1]]
        new_name = new_h | np.r_[True, name[1:] != name[:-1]]
        bucket, same = np.maximum.accumulate(np.where(new_h, index, 0)), np.maximum.accumulate(np.where(new_name, index, 0))
        repeat = (same != index) & (h & ((1 << BAND_BITS) - 1) == 0) & (index >= skip) & ((row != row[same]) | (pos != pos[same]))
        places = np.unique(np.r_[index[repeat], same[repeat]])
        # a bucket of one document's paragraphs, which overlap, is none; the batch's first and last one may go on
        starts = np.flatnonzero(new_h)
        several = np.minimum.reduceat(row, starts) < np.maximum.reduceat(row, starts)
        several[0] = several[-1] = True
        other = new_name & (bucket != index) & np.repeat(several, np.diff(np.r_[starts, len(h)]))
        members = np.unique(np.r_[index[other], bucket[other]])
        pick = np.r_[members, places]
        yield _batch(h[pick], name[pick], row[pick], pos[pick], np.arange(len(pick)) >= len(members))
        i, j = bucket[-1], same[-1]
        carried = (h[i], name[i], row[i], pos[i]), (h[j], name[j], row[j], pos[j])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, places array<struct<name, pos>>) to the shingles of the named paragraphs."""
    hasher = WordHasher()
    for batch in batches:
        names, sets = [], []
        for text, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            s = shingles(hasher(text.encode("utf-8", "surrogatepass").split()), SHINGLE)
            for p in places:
                names.append(p["name"])
                sets.append(np.unique(s[p["pos"] : p["pos"] + WORDS - SHINGLE + 1]).view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "units"])


def _around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, text, places array<int>) to the hashes of the words before each paragraph, nearest first, and after it.

    Both begin SHIFT + INSIDE words inside the paragraph."""
    hasher = WordHasher()
    for batch in batches:
        rows, at, before, after = [], [], [], []
        for row, text, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            hashed = hasher(text.encode("utf-8", "surrogatepass").split()).view(np.int64)
            for p in places:
                rows.append(row)
                at.append(p)
                before.append(hashed[max(0, p - WINDOW - SHIFT) : p + SHIFT + INSIDE][::-1])
                after.append(hashed[p + WORDS - SHIFT - INSIDE : p + WORDS + WINDOW + SHIFT])
        lists = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(at, pa.int32()), pa.array(before, lists), pa.array(after, lists)], names=["row", "pos", "before", "after"])


def _extended(ranges: DataFrame, base: DataFrame, folder: str) -> DataFrame:
    """row, s, e, and the places of the first ones of the outer paragraphs (lrow, lpos, rrow, rpos) to row, s, e, extended."""
    ends = {"l": F.col("s"), "r": F.col("e") - WORDS}
    wanted = None
    for k, pos in ends.items():
        both = F.array(F.struct("row", pos.alias("pos")), F.struct(F.col(f"{k}row").alias("row"), F.col(f"{k}pos").alias("pos")))
        part = ranges.where(F.col(f"{k}row") != F.col("row")).select(F.inline(both))
        wanted = part if wanted is None else wanted.unionByName(part)
    by_row = wanted.distinct().groupBy("row").agg(F.collect_list("pos").alias("places"))
    around = base.select("row", "text").join(by_row.hint("merge"), "row").select("row", "text", "places").mapInArrow(_around, "row long, pos int, before array<long>, after array<long>")
    around = written(around, "around", f"{folder}/around")
    out = ranges
    for k, words in (("l", "before"), ("r", "after")):
        own = around.select("row", F.col("pos").alias(f"{k}at"), F.col(words).alias("x"))
        first = around.select(F.col("row").alias(f"{k}row"), F.col("pos").alias(f"{k}pos"), F.col(words).alias("y"))
        out = out.withColumn(f"{k}at", ends[k]).join(own, ["row", f"{k}at"], "left").join(first, [f"{k}row", f"{k}pos"], "left")
        lengths = []
        for shift in range(2 * SHIFT + 1):
            x, y = (F.slice(c, at + 1, WINDOW + INSIDE) for c, at in (("x", SHIFT), ("y", shift)))
            differs = F.array_position(F.zip_with(x, y, lambda a, b: a.eqNullSafe(b)), False)
            lengths.append(F.when(differs > 0, differs - 1).otherwise(F.size(x)).cast("int"))
        same = F.greatest(F.lit(0), F.greatest(*lengths) - INSIDE)
        # within one row a copy might grow into the first one
        out = out.withColumn(f"{k}more", F.when((F.col(f"{k}row") != F.col("row")) & F.col("x").isNotNull() & F.col("y").isNotNull(), same).otherwise(0)).drop("x", "y")
    return out.select("row", (F.col("s") - F.col("lmore")).alias("s"), (F.col("e") + F.col("rmore")).alias("e"))


def repeated_passages(docs: DataFrame, threshold: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row a document: doc_id, n_repeated, n_removed, removed_words, removed.

    n_repeated: its paragraphs that other rows hold too; n_removed: those of them that aren't the first of their class,
    in the table's order; removed: the words they cover, as ranges start:end (words from 0, end exclusive), comma-joined.
    Null, empty and short texts have none; a null doc_id and repeated rows stay; an empty table gives none.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark, "passages")
    # the numbers of rows name them in all that follows: given once, and written
    base = written(id_and_text(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "rows", f"{folder}/rows")
    emitted = base.select("row", "text").mapInArrow(_emit(bands, rows), PLACE)
    # places without a bucket only pass; they are dealt evenly
    key = F.coalesce("h", F.xxhash64("name", "row", "pos"))
    ordered = emitted.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key).sortWithinPartitions("h", "name", "row", "pos")
    met = written(ordered.mapInArrow(_link, PLACE), "met", f"{folder}/met")
    buckets = met.where("h IS NOT NULL").select("h", F.col("name").alias("node"), "row").distinct()
    shared = buckets.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("least"), F.max("row").alias("most")).where("least < most").select("h", "n")
    members = with_hubs(buckets.select("h", "node").join(shared, "h"), folder)
    known = members.select(F.col("node").alias("name")).distinct()
    places = met.where("h IS NULL").select("name", "row", "pos").unionByName(met.where("h IS NOT NULL").select("name", "row", "pos").join(known, "name", "left_semi"))
    places = written(places.distinct(), "places", f"{folder}/places")
    one = places.join(known, "name", "left_semi").groupBy("name").agg(F.min(F.struct("row", "pos")).alias("p"))
    by_row = one.groupBy("p.row").agg(F.collect_list(F.struct("name", F.col("p.pos").alias("pos"))).alias("places"))
    units = base.select("row", "text").join(by_row.hint("merge"), "row").select("text", "places").mapInArrow(_sets, "node long, units array<long>")
    units = written(units, "units", f"{folder}/units")
    own = places.withColumn("c", F.col("name"))
    maps = linked(members, units, threshold, HUBS, FEW, BLOCK, folder)
    for m in maps:
        own = own.join(m, F.col("c") == F.col("node"), "left").select("name", "row", "pos", F.coalesce("component", "c").alias("c"))
    own = written(own, "own", f"{folder}/own")
    forget(met, places, members, units, *maps)
    heads = own.groupBy("c").agg(F.min(F.struct("row", "pos")).alias("first"), F.max("row").alias("last_row")).where("first.row < last_row")
    # what a paragraph is extended against: the first equal one, as the first of its class may begin a word or two elsewhere
    twins = own.groupBy("name").agg(F.min(F.struct("row", "pos")).alias("twin"))
    against = F.when(F.col("twin.row") != F.col("row"), F.col("twin")).otherwise(F.col("first")).alias("against")
    # similar paragraphs that begin inside the first one are part of it
    is_first = (F.col("first.row") == F.col("row")) & (F.col("pos") - F.col("first.pos") < WORDS)
    marked = own.join(heads, "c").join(twins, "name").select("row", "pos", against, is_first.alias("is_first"))
    # a document that begins a class keeps all of its own occurrences' first; the other ones go
    place = F.struct("pos", F.col("against.row").alias("frow"), F.col("against.pos").alias("fpos"))
    gone = F.sort_array(F.collect_set(F.when(~F.col("is_first"), place)))
    per = marked.groupBy("row").agg(F.count_distinct("pos").alias("n_repeated"), gone.alias("gone"))

    def grow(acc, s, e, left, right):
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.struct(last["s"].alias("s"), F.greatest(last["e"], e).alias("e"), *[last[n].alias(n) for n in left], *[x.alias(n) for n, x in right.items()])
        new = F.struct(s.alias("s"), e.alias("e"), *[x.alias(n) for n, x in left.items()], *[x.alias(n) for n, x in right.items()])
        return F.when((F.size(acc) > 0) & (last["e"] >= s), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(joined))).otherwise(F.array_append(acc, new))

    start = F.array().cast("array<struct<s:int,e:int,lrow:bigint,lpos:int,rrow:bigint,rpos:int>>")
    runs = F.aggregate("gone", start, lambda acc, p: grow(acc, p["pos"], p["pos"] + WORDS, {"lrow": p["frow"], "lpos": p["fpos"]}, {"rrow": p["frow"], "rpos": p["fpos"]}))
    per = written(per.withColumn("runs", runs).select("row", "n_repeated", F.size("gone").cast("long").alias("n_removed"), "runs"), "runs", f"{folder}/runs")
    longer = _extended(per.select("row", F.inline("runs")), base, folder)
    start = F.array().cast("array<struct<s:int,e:int>>")
    ranges = longer.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("r"))
    ranges = ranges.select("row", F.aggregate("r", start, lambda acc, p: grow(acc, p["s"], p["e"], {}, {})).alias("ranges"))
    per = per.drop("runs").join(ranges, "row", "left")
    zero = F.lit(0).cast("long")
    return base.select("row", "doc_id").join(per, "row", "left").select(
        "doc_id", F.coalesce("n_repeated", zero).alias("n_repeated"), F.coalesce("n_removed", zero).alias("n_removed"),
        F.coalesce(F.aggregate("ranges", zero, lambda a, r: a + r["e"] - r["s"]), zero).alias("removed_words"),
        F.coalesce(F.array_join(F.transform("ranges", lambda r: F.concat_ws(":", r["s"], r["e"])), ","), F.lit("")).alias("removed"),
    )
