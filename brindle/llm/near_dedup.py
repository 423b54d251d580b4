"""Near-duplicate documents by DartMinHash signatures, banded joins and exact checks.

A document is the multiset of its five-word shingles: element weights are counts. A fixed random process throws darts
into the plane (weight x rank) of each element, independent of the document; a document owns the darts below its
weights and hashes each to one of K coordinates, keeping the earliest rank of each. Two documents agree in a
coordinate with the probability of their weighted Jaccard similarity. Equal texts are collapsed first. In each bucket
of equal bands, members are compared with one hub, exactly; what the hub doesn't take gets other hubs in later rounds.
After these, every pair of a bucket whose members are still of different components is compared, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.operators.components import components

from .common import WordHasher, forget, mix, portions, shared_folder, shingles, written

SIMILARITY = 0.8
#: 28 bands of 5 coordinates miss a pair of similarity 0.8 with probability 0.00002.
BANDS, ROWS = 28, 5
K = BANDS * ROWS
#: Rounds of hubs, at most: later ones see only buckets that still have members of different components, and end when few
#: pairs turn out similar. They only save work: whatever pairs of different components they leave are all compared.
HUBS = 5
#: Of what is left, buckets of so many members list their pairs; larger ones are compared in blocks of BLOCK members.
FEW, BLOCK = 16, 256
#: Texts signed together: their darts fit into a processor's cache.
SIGNED_AT_ONCE = 256
_BLOCKS = [(2**i - 1, 2 ** (i + 1) - 1) for i in range(40)]  # numbers of an element's darts that are thrown together


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def dart_signatures(elements: np.ndarray, weights: np.ndarray, sets: np.ndarray, n_sets: int, k: int = K) -> np.ndarray:
    """n_sets x k signatures of the weighted sets: for each coordinate the name of the earliest dart.

    elements: 64-bit names, with their weights and the numbers of their sets, which all have some weight. On each unit
    of an element's weight darts arrive along the rank axis with exponential gaps, which depend on the element and the
    dart's number alone; a set needs those up to a rank at which its coordinates have all been hit.
    """
    layers = np.ceil(weights).astype(np.int64)
    unit = np.repeat(np.arange(len(elements)), layers)  # an element's weight axis in cells of 1, the last one cut off
    layer = np.arange(len(unit)) - np.repeat(np.cumsum(layers) - layers, layers)
    names = mix(elements[unit] + mix(layer.astype(np.uint64), 7), 1)
    room = weights[unit] - layer
    owner = sets[unit]
    limits = k * (np.log(k) + 3) / np.bincount(sets, weights, n_sets)
    out, todo = np.zeros((n_sets, k), np.uint64), np.ones(n_sets, bool)
    while todo.any():
        live = np.flatnonzero(todo[owner])
        clock = np.zeros(len(live))
        slots, ranks, darts = [], [], []
        for low, high in _BLOCKS:
            dart = mix(names[live][:, None] + mix(np.arange(low, high, dtype=np.uint64), 3), 2)
            rank = clock[:, None] + np.cumsum(-np.log1p(-_unit(mix(dart, 5))), 1)
            hit = rank < limits[owner[live]][:, None]
            of = np.broadcast_to(live[:, None], hit.shape)
            here = np.flatnonzero(hit & (_unit(mix(dart, 4)) < room[of])) if (room < 1).any() else np.flatnonzero(hit)
            dart, of = dart.ravel()[here], of.ravel()[here]
            slots.append(owner[of] * k + (mix(dart, 6) % np.uint64(k)).astype(np.int64))
            ranks.append(rank.ravel()[here])
            darts.append(dart)
            on = hit[:, -1]
            live, clock = live[on], rank[on, -1]
            if not len(live):
                break
        slot, rank, dart = (np.concatenate(x) for x in (slots, ranks, darts))
        first = np.full(n_sets * k, np.inf)
        np.minimum.at(first, slot, rank)
        won = rank == first[slot]
        out.reshape(-1)[slot[won]] = dart[won]
        todo &= ~np.isfinite(first.reshape(n_sets, k)).all(1)
        limits = limits * 2  # some coordinate got no dart: more ranks for these
    return out


def weighted(text: str, hasher: WordHasher, k: int = 5) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The 16-byte name of the text's words in order, its distinct shingles and their counts."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").split()
    elements, counts = np.unique(shingles(hasher(words), k), return_counts=True)
    return xxhash.xxh3_128_digest(b" ".join(words)), elements, counts


def signatures(bands: int, rows: int):
    """Batches of (doc_id, text, more) with the name of the text's words and its band hashes, null where it has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, band = WordHasher(), np.arange(bands, dtype=np.uint64)
        for batch in batches:
            for part, texts in portions(batch, 1, SIGNED_AT_ONCE):
                names, parts, kept = [], [], []
                for t in texts:
                    name, elements, counts = weighted(t, hasher)
                    names.append(name if len(elements) else None)
                    if len(elements):
                        kept.append(len(names) - 1)
                        parts.append((elements, counts, np.full(len(elements), len(kept) - 1)))
                lists: list = [None] * len(names)
                if kept:
                    e, c, s = (np.concatenate(x) for x in zip(*parts, strict=True))
                    sig = dart_signatures(e, c.astype(float), s, len(kept), bands * rows)
                    joint = np.tile(band, (len(kept), 1))
                    for r in range(rows):
                        joint = mix(joint ^ sig[:, r::rows], r)
                    for i, row in zip(kept, joint.view(np.int64).tolist(), strict=True):
                        lists[i] = row
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.binary()), pa.array(lists, pa.list_(pa.int64()))], names=[*part.schema.names, "name", "bands"])

    return run


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, text) to nodes and their units: an element of count c is c units, so that sets of units have the Jaccard
    similarity of the weighted sets."""
    hasher = WordHasher()
    for batch in batches:
        units = []
        for t in batch.column(1).to_pylist():
            _, e, c = weighted(t, hasher)
            u = np.repeat(e, c)
            which = np.arange(len(u)) - np.repeat(np.cumsum(c) - c, c)
            units.append(mix(u + mix(which.astype(np.uint64), 9)).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(units, pa.list_(pa.int64()))], names=["node", "units"])


def _verified(pairs: DataFrame, units: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b, more) of nodes with sim, their similarity; pairs of sizes too far apart, which can't reach the threshold, are left out."""
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = units.join(wanted, "node", "left_semi")
    left = sets.select(F.col("node").alias("a"), F.col("units").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("units").alias("y"))
    sized = pairs.join(left, "a").join(right, "b").where(F.least(F.size("x"), F.size("y")) >= threshold * F.greatest(F.size("x"), F.size("y")))
    both = F.size(F.array_intersect("x", "y"))
    return sized.withColumn("sim", both / (F.size("x") + F.size("y") - both)).drop("x", "y")


def _compare(threshold: float, columns: int = 4096):
    """Of two blocks (or one, with itself) links between components with similar members, as many as join what is similar."""

    def run(group: pa.Table) -> pa.Table:
        side, c = group["side"].to_numpy(), group["c"].to_numpy()
        units = group["units"].combine_chunks()
        sizes = np.diff(units.offsets.to_numpy())
        names, flat, often = np.unique(units.flatten().to_numpy(), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(side)), sizes)
        # what only one text has is shared by no pair; the rest is a matrix, taken a few columns at a time
        column = np.cumsum(often > 1) - 1
        shared = often[flat] > 1
        flat, owner = column[flat[shared]], owner[shared]
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        x, y = np.flatnonzero(side == 0), np.flatnonzero(side == side.max())
        both = np.zeros((len(x), len(y)), np.float32)
        for low in range(0, int((often > 1).sum()), columns):
            i, j = np.searchsorted(flat, [low, low + columns])
            part = np.zeros((len(side), columns), np.float32)
            part[owner[i:j], flat[i:j] - low] = 1
            both += part[x] @ part[y].T
        similar = both >= threshold * (sizes[x][:, None] + sizes[y][None, :] - both)
        similar &= c[x][:, None] != c[y][None, :]
        i, j = np.nonzero(similar)
        links = np.unique(np.column_stack([np.maximum(c[x[i]], c[y[j]]), np.minimum(c[x[i]], c[y[j]])]), axis=0)
        return pa.table({"a": pa.array(links[:, 0], pa.int64()), "b": pa.array(links[:, 1], pa.int64())})

    return run


def _left_over(own: DataFrame, tested: DataFrame, units: DataFrame, threshold: float, folder: str, few: int, block: int) -> DataFrame:
    """Links (a, b) of components: among all pairs of different ones in a bucket that no hub has decided. own: h, node, n, c, far."""
    small = own.where(F.col("n") <= few)
    y = small.select("h", F.col("node").alias("b"), F.col("c").alias("cb"), F.col("far").alias("far_b"))
    # distance is a metric: two members whose distances from their hub differ by more can't be similar
    near = F.coalesce(F.abs(F.col("far") - F.col("far_b")) <= 1 - threshold + 1e-9, F.lit(True))
    pairs = small.select("h", F.col("node").alias("a"), F.col("c").alias("ca"), "far").join(y, "h").where((F.col("ca") != F.col("cb")) & (F.col("a") > F.col("b")) & near)
    pairs = pairs.select("a", "b", "ca", "cb").distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti")
    found = _verified(written(pairs, "pairs", f"{folder}/pairs-rest"), units, threshold).where(F.col("sim") >= threshold).select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    large = own.where(F.col("n") > few)
    if large.isEmpty():
        return found
    # a component of many members has blocks of its own, which aren't compared with each other; small ones share blocks
    per = large.groupBy("h", "c").agg(F.count(F.lit(1)).alias("of_c"))
    total = per.groupBy("h").agg(F.sum(F.when(F.col("of_c") <= block, F.col("of_c"))).alias("of_small"))
    by = large.join(per, ["h", "c"]).join(total, "h").withColumn("alone", F.when(F.col("of_c") > block, F.col("c")).otherwise(F.lit(-1)))
    salt = F.when(F.col("of_c") > block, F.pmod(F.xxhash64("node"), F.ceil(F.col("of_c") / block))).otherwise(F.pmod(F.xxhash64("c"), F.ceil(F.col("of_small") / block)))
    by = written(by.select("h", "node", "c", "alone", salt.alias("part")), "blocks", f"{folder}/blocks")
    one = by.select("h", F.struct("alone", "part").alias("x")).distinct()
    two = one.join(one.withColumnRenamed("x", "y"), "h").where("x = y AND x.alone < 0 OR x < y AND (x.alone < 0 OR x.alone <> y.alone)")
    sets = units.join(by.select("node").distinct(), "node", "left_semi")
    named = by.select("h", F.struct("alone", "part").alias("of"), "node", "c")
    left = two.withColumn("of", F.col("x")).join(named, ["h", "of"]).withColumn("side", F.lit(0))
    right = two.where("x < y").withColumn("of", F.col("y")).join(named, ["h", "of"]).withColumn("side", F.lit(1))
    rows = left.unionByName(right).join(sets, "node").select("h", "x", "y", "side", "c", "units")
    return found.unionByName(rows.groupBy("h", "x", "y").applyInArrow(_compare(threshold), "a long, b long")).distinct()


def with_hubs(met: DataFrame, folder: str) -> DataFrame:
    """Members of buckets (h, node, n) with hub: the member that meets most others in all its buckets. Of edited copies that is the original."""
    popular = met.groupBy("node").agg(F.sum("n").alias("popular"))
    hub = met.join(popular, "node").groupBy("h").agg(F.max_by("node", F.struct("popular", -F.col("node"))).alias("hub"))
    return written(met.join(hub, "h"), "members", f"{folder}/members")


def linked(members: DataFrame, units: DataFrame, threshold: float, hubs: int, few: int, block: int, folder: str) -> list[DataFrame]:
    """Tables (node, component) to be applied one after the other: the classes of the members (h, node, n, hub)."""
    pairs = members.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    tested = written(_verified(pairs, units, threshold), "tested", f"{folder}/pairs-0")
    found = tested.where(F.col("sim") >= threshold).select("a", "b")
    if found.isEmpty():
        maps, labels = [], found.select(F.col("a").alias("node"), F.col("b").alias("component"))
    else:
        maps = [labels := components(found)]
    far = tested.select(F.col("a").alias("node"), F.col("b").alias("hub"), "sim")
    # a pair of sizes too far apart has no similarity here, and says nothing about the distances of its members
    own = members.where("n > 2").join(labels, "node", "left").join(far, ["node", "hub"], "left")
    own = own.select("h", "node", "n", F.coalesce("component", "node").alias("c"), F.when(F.col("node") == F.col("hub"), 0.0).otherwise(1 - F.col("sim")).alias("far"))

    def mixed(own: DataFrame, name: str) -> DataFrame:
        several = own.groupBy("h").agg(F.min("c").alias("least"), F.max("c").alias("most")).where("least < most").select("h")
        return written(own.join(several, "h"), "own", f"{folder}/{name}")

    own = mixed(own, "own-0")
    for n in range(1, hubs):
        # of each bucket and component one member, other ones each round, against that of one component
        by = own.groupBy("h", "c").agg(F.min_by("node", F.xxhash64("node", F.lit(n))).alias("m"))
        hub = by.groupBy("h").agg(F.min_by(F.struct("m", "c"), F.xxhash64("m", F.lit(n))).alias("hub"))
        pairs = by.join(hub, "h").where("c <> hub.c").select(F.greatest("m", "hub.m").alias("a"), F.least("m", "hub.m").alias("b"), "c", F.col("hub.c").alias("hub_c"))
        pairs = pairs.select("a", "b", F.greatest("c", "hub_c").alias("ca"), F.least("c", "hub_c").alias("cb"))
        pairs = written(pairs.distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti"), "pairs", f"{folder}/pairs-{n}")
        found = written(_verified(pairs, units, threshold).where(F.col("sim") >= threshold), "found", f"{folder}/found-{n}").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        of, good = pairs.count(), found.count()
        if good:
            maps.append(components(found))
            own = mixed(own.join(maps[-1], own["c"] == maps[-1]["node"], "left").select("h", own["node"], "n", F.coalesce("component", "c").alias("c"), "far"), f"own-{n}")
        tested = tested.select("a", "b").unionByName(pairs.select("a", "b"))
        if 10 * good < of or not of:
            break
    rest = written(_left_over(own, tested, units, threshold, folder, few, block), "rest", f"{folder}/rest")
    return maps if rest.isEmpty() else [*maps, components(rest)]


def _judged(docs: DataFrame, carry: list[str], threshold: float, bands: int, rows: int, hubs: int, few: int, block: int) -> tuple[DataFrame, DataFrame]:
    """The rows, numbered and written once (row, doc_id, text, carried, name), and their verdicts (row, doc_id, class_id, class_size, kept)."""
    spark = docs.sparkSession
    folder = shared_folder(spark, "near")
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        *[F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried")] * bool(carry),
    )
    schema = T.StructType([*base.schema.fields, T.StructField("name", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])
    signed = written(base.mapInArrow(signatures(bands, rows), schema).withColumn("row", F.monotonically_increasing_id()), "signed", f"{folder}/signed")
    # one row a distinct text; its node is a row number, so that all that follows handles plain numbers
    head = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    texts = signed.where("name IS NOT NULL").groupBy("name").agg(F.min("row").alias("node"), F.min(head).alias("head"), F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands"))
    texts = written(texts, "texts", f"{folder}/texts")
    buckets = texts.select("node", F.explode("bands").alias("h"))
    shared = buckets.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = written(buckets.join(shared, "h"), "met", f"{folder}/met")
    members = with_hubs(met, folder)
    wanted = members.select("node").distinct()
    # never broadcast, at any size: the texts are dealt once, as on a large table
    units = signed.select(F.col("row").alias("node"), "text").join(wanted.hint("merge"), "node", "left_semi").mapInArrow(_elements, "node long, units array<long>")
    units = written(units, "units", f"{folder}/units")

    classes = texts.select("name", "head", "n", F.col("node").alias("c"))
    maps = linked(members, units, threshold, hubs, few, block, folder)
    for m in maps:
        classes = classes.join(m, F.col("c") == F.col("node"), "left").select("name", "head", "n", F.coalesce("component", "c").alias("c"))
    classes = written(classes, "classes", f"{folder}/classes")
    heads = classes.groupBy("c").agg(F.min("head").alias("head"), F.sum("n").alias("class_size"))
    of_name = classes.select("name", "c").join(heads, "c").select("name", F.col("head.doc_id").alias("class_id"), "class_size", F.col("head.row").alias("first"))
    named = signed.where("name IS NOT NULL").select("row", "doc_id", "name")
    some = named.join(of_name, "name").select("row", "doc_id", "class_id", "class_size", (F.col("row") == F.col("first")).alias("kept"))
    alone = signed.where("name IS NULL").select("row", "doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"))
    verdicts = written(some.unionByName(alone), "verdicts", f"{folder}/verdicts")
    forget(texts, met, members, units, classes, *maps)
    return signed, verdicts


def near_duplicates(docs: DataFrame, threshold: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, hubs: int = HUBS, few: int = FEW, block: int = BLOCK) -> DataFrame:
    """One row a document: doc_id, class_id (the least doc_id of its class), class_size (documents), kept.

    A class: rows linked by equal words or a weighted Jaccard similarity of threshold or more, directly or through
    others. Of a class exactly one row is kept, one of the least doc_id (null ids come last); so of repeated rows one
    stays. Texts of fewer than five words are one shingle. Null, empty and blank texts are each a class of their own
    and kept, with their own doc_id as class_id. Columns but doc_id and text aren't read. An empty table gives none.
    """
    signed, verdicts = _judged(docs, [], threshold, bands, rows, hubs, few, block)
    forget(signed)
    return verdicts.drop("row")


def distinct_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that near_duplicates() keeps, with all their columns."""
    defaults = {"threshold": SIMILARITY, "bands": BANDS, "rows": ROWS, "hubs": HUBS, "few": FEW, "block": BLOCK}
    numbered, verdicts = _judged(docs, [c for c in docs.columns if c != "text"], **defaults | options)
    kept = numbered.join(verdicts.where("NOT kept").select("row").hint("merge"), "row", "left_anti")
    return kept.select(*["text" if c == "text" else F.col(f"carried.`{c}`") for c in docs.columns])
