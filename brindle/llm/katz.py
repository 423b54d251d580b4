"""Katz backoff language model over bytes, and an additive word model as its base.

Words are split at white space, A-Z lower-cased. The model spells a document: its words with one blank between them,
byte by byte in UTF-8, and its end; so its alphabet is closed and no word is unknown. A byte's history are the ORDER - 1
bytes before it, whatever words they belong to. Counts of each order are discounted by Good and Turing; what a history
loses goes to the bytes it has not been seen with, in proportion to their probabilities after the history that is one
byte shorter, exactly normalised, and so on down to single bytes, whose own loss goes to unseen bytes evenly.

Counting and scoring at scale. Chunks of whole documents are written once: their spelling, and their words as numbers.
A chunk asks for each distinct word and n-gram once, so a frequent one is one key a chunk. Requests lie in buckets by
hash, n-grams by the last two bytes of their history: a bucket then has all that the n-gram backs off to, down to
order three; the table of order two, of 65,536 entries at most, goes everywhere. A bucket's counts are summed in a
tree, salted by chunk, and the model's tables are partitioned by bucket. Answers go back to the chunk, which scores its
documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from zstandard import ZstdCompressor, ZstdDecompressor

from .common import id_and_text, mix, shared_folder

#: Bytes of a history, and the one that follows.
ORDER = 6
#: Bytes of a chunk, at most, unless one document has more.
CHUNK = 8_000_000
#: Counts over this aren't discounted.
GT_MOST = 5
#: Chunks whose counts are summed, and whose requests are answered, in one task.
SALT = 64
#: Bytes that UTF-8 never has: the place before a document, which is a history only, and a document's end.
BEGIN, END = 0xFE, 0xFF
BETWEEN = bytes(32 if i in (BEGIN, END) else i for i in range(256))
SYMBOLS = [i for i in range(256) if i != BEGIN]
REQUEST = "kind string, chunk long, bucket int, at long, keys binary, counts binary, ids array<long>, lengths binary, learn binary, line binary"


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def squeezed(a: np.ndarray, ascending: bool = False) -> bytes:
    """The numbers, ascending ones as differences, first all highest bytes and so on, compressed."""
    if ascending:
        a = np.diff(a, prepend=a.dtype.type(0))
    return ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes())


def unsqueezed(data: bytes, dtype, ascending: bool = False) -> np.ndarray:
    a = np.frombuffer(ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    a = np.ascontiguousarray(a.T).view(dtype).ravel()
    return np.cumsum(a, dtype=dtype) if ascending else a


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split()


def spelled(words: list[bytes]) -> bytes:
    return bytes([BEGIN] * (ORDER - 1)) + b" ".join(words) + bytes([END])


def grams_of(line: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Of spelled documents, one after the other, the n-gram of each byte and the number of its document.

    An n-gram has its history in the higher bytes, the nearest byte on top, and the byte itself in the lowest.
    """
    b = np.frombuffer(line, np.uint8)
    n = len(b) - ORDER + 1
    key = b[ORDER - 1 :].astype(np.uint64)
    for back in range(1, ORDER):
        part = b[ORDER - 1 - back : ORDER - 1 - back + n].astype(np.uint64)
        part <<= np.uint64(8 * (ORDER - back))
        key |= part
    own = b[ORDER - 1 :]
    doc = np.cumsum(own == END, dtype=np.int32) - (own == END)
    real = own != BEGIN
    return key[real], doc[real]


def of_order(keys: np.ndarray, k: int) -> np.ndarray:
    """n-grams cut to the k - 1 nearest bytes of their histories."""
    return (keys >> np.uint64(8 * (ORDER - k + 1)) << np.uint64(8)) | (keys & np.uint64(255))


def by_bucket(keys: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys by bucket and key, and where in it each bucket begins (with the end)."""
    order = np.lexsort((keys, buckets))
    return order, np.searchsorted(buckets[order], np.arange((buckets.max() if len(buckets) else 0) + 2))


def word_bucket(keys: np.ndarray, n: int) -> np.ndarray:
    return (mix(keys, 21) % np.uint64(n)).astype(np.int64)


def gram_bucket(keys: np.ndarray, n: int) -> np.ndarray:
    return (mix(keys >> np.uint64(8 * (ORDER - 2)), 22) % np.uint64(n)).astype(np.int64)


def _rows(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"kind": pa.string(), "chunk": pa.int64(), "bucket": pa.int32(), "at": pa.int64(), "ids": pa.list_(pa.int64())}
    names = [x.split()[0] for x in REQUEST.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds.get(n, pa.binary())) for n in names], names=names)


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def numbered(words: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words as numbers, in the order of their requests; the keys of the distinct words in that order, and where buckets begin."""
    import xxhash

    numbers = _Numbers()
    line = np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))
    keys = np.fromiter(map(xxhash.xxh3_64_intdigest, numbers), np.uint64, len(numbers))
    order, edges = by_bucket(keys, word_bucket(keys, buckets))
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    return rank[line], keys[order], edges


def chunks(buckets: int, most: int = CHUNK):
    """Batches of (doc_id, text) to chunk rows and request rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx = TaskContext.get()
        chunk = (ctx.partitionId() if ctx else 0) << 32
        ids: list = []
        lines: list[bytes] = []
        lengths: list[int] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            line, learn = b"".join(lines), np.array([not held_out(d) for d in ids], bool)
            yield _rows([{
                "kind": "chunk", "chunk": chunk, "bucket": -1, "ids": ids, "lengths": np.array(lengths, np.int64).tobytes(), "learn": learn.tobytes(), "line": ZstdCompressor().compress(line),
            }])
            words, keys, edges = numbered(line.translate(BETWEEN).split(), buckets)
            yield from requests("word", keys, np.bincount(words[np.repeat(learn, lengths)], minlength=len(keys)), edges)
            del words
            grams, doc = grams_of(line)
            grams <<= np.uint64(1)
            grams |= (~learn)[doc]
            del doc
            grams.sort()
            held = (grams & np.uint64(1)).astype(bool)
            grams >>= np.uint64(1)
            first = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
            counts, keys = np.diff(np.r_[first, len(grams)]) - np.add.reduceat(held, first, dtype=np.int64), grams[first]
            del grams, held, first
            order, edges = by_bucket(keys, gram_bucket(keys, buckets))
            yield from requests("gram", keys[order], counts[order], edges)

        def requests(kind: str, keys: np.ndarray, counts: np.ndarray, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
            rows = [
                {"kind": kind, "chunk": chunk, "bucket": b, "at": int(i), "keys": squeezed(keys[i:j], True), "counts": squeezed(counts[i:j].astype(np.uint32))}
                for b, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True))
                if j > i
            ]
            for i in range(0, len(rows), 64):
                yield _rows(rows[i : i + 64])

        for batch in batches:
            for i in range(batch.num_rows):
                words = words_of(batch.column(1)[i].as_py())
                line = spelled(words)
                if size and size + len(line) > most:
                    yield from flush()
                    chunk += 1
                    size = 0
                    for x in (ids, lines, lengths):
                        x.clear()
                ids.append(batch.column(0)[i].as_py())
                lines.append(line)
                lengths.append(len(words))
                size += len(line)
        if ids:
            yield from flush()

    return run


TABLE = "kind string, bucket int, salt long, keys binary, counts binary, n long, types long, r array<long>"


def counts_of_counts(counts: np.ndarray) -> list[int]:
    return [int((counts == i).sum()) for i in range(1, GT_MOST + 2)]


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts


def sum_counts(kind, final: bool):
    """Rows of one kind and bucket to one: keys that were learned, ascending, their counts; at last also counts of counts, of n-grams by order."""

    def run(table: pa.Table) -> pa.Table:
        keys = np.concatenate([unsqueezed(x.as_py(), np.uint64, True) for x in table["keys"]])
        counts = np.concatenate([unsqueezed(x.as_py(), kind) for x in table["counts"]]).astype(np.int64)
        keys, counts = summed(keys[counts > 0], counts[counts > 0])
        what = table["kind"][0].as_py()
        r = [x for k in range(3, ORDER + 1) for x in counts_of_counts(summed(of_order(keys, k), counts)[1])] if final and what == "gram" else []
        return pa.table({
            "kind": [what], "bucket": table["bucket"].slice(0, 1), "salt": pa.array([table["salt"][0].as_py() // SALT], pa.int64()), "keys": pa.array([squeezed(keys, True)], pa.binary()),
            "counts": pa.array([squeezed(counts)], pa.binary()), "n": [int(counts.sum())], "types": [len(keys)], "r": pa.array([r], pa.list_(pa.int64())),
        })

    return run


def discounts(r: list[int]) -> np.ndarray:
    """Factors for counts 0 to GT_MOST + 1 (the last one, for all larger counts, is 1) from counts of counts.

    Katz's formula; where the counts of counts don't allow it (none, or no proper factor), a fixed one half off each
    count stands in, so that some mass is always left to back off with.
    """
    k, out = GT_MOST, np.ones(GT_MOST + 2)
    common = (k + 1) * r[k] / r[0] if r[0] else 1.0
    for i in range(1, k + 1):
        d = ((i + 1) * r[i] / (i * r[i - 1]) - common) / (1 - common) if r[i - 1] and common < 1 else 0.0
        out[i] = d if 0 < d < 1 else 1 - 0.5 / i
    return out


def unigram_probabilities(counts: np.ndarray) -> np.ndarray:
    """Of a closed alphabet; sums to 1. What discounting frees is spread over tokens without counts."""
    total = counts.sum()
    if not total:
        return np.full(len(counts), 1 / len(counts))
    d = discounts([int((counts == i).sum()) for i in range(1, GT_MOST + 2)])
    p = d[np.minimum(counts, GT_MOST + 1)] * counts / total
    unseen = counts == 0
    if unseen.any():
        left = 1 - p.sum()
        if left <= 1e-9:  # no count was small enough to be discounted
            p, left = p * (1 - 1 / (total + 1)), 1 / (total + 1)
        p[unseen] = left / unseen.sum()
    return p / p.sum()


def discounted(keys: np.ndarray, counts: np.ndarray, low: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one order's n-grams the probabilities; the histories, ascending, and their backoff weights.

    keys: ascending; low: the probabilities of the n-grams after a history one byte shorter.
    """
    names, at = np.unique(keys >> np.uint64(8), return_inverse=True)
    total = np.bincount(at, counts, len(names))
    p = d[np.minimum(counts, GT_MOST + 1)] * counts / total[at]
    used = np.bincount(at, p, len(names))
    known = np.bincount(at, low, len(names))
    # a history whose counts are all large frees nothing: give it one count more
    full = (used >= 1 - 1e-12) & (known < 1)
    p = np.where(full[at], p * (total / (total + 1))[at], p)
    used = np.bincount(at, p, len(names))
    every = known >= 1 - 1e-12  # seen with all bytes: nothing to back off to
    p = np.where(every[at], p / used[at], p)
    weight = np.where(every, 0.0, np.maximum(1 - used, 1e-300) / np.maximum(1 - known, 1e-300))
    return p, names, weight


def found(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where in known, ascending, the keys stand, and whether they do."""
    if not len(known):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return at, known[at] == keys


def order_two(counts: np.ndarray) -> np.ndarray:
    """256 x 256 probabilities of a byte (column) after another (row), from their counts."""
    p1 = np.zeros(256)
    p1[SYMBOLS] = unigram_probabilities(counts.sum(0)[SYMBOLS])
    out = np.tile(p1, (256, 1))
    h, w = np.nonzero(counts)
    if len(h):
        c = counts[h, w]
        p, names, weight = discounted((h.astype(np.uint64) << np.uint64(8)) | w.astype(np.uint64), c, p1[w], discounts(counts_of_counts(c)))
        out[names.astype(np.int64)] *= weight[:, None]
        out[h, w] = p
    return out


class Grams:
    """The model of one bucket: all orders from three on, from its n-grams of the highest order."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, two: np.ndarray, d: dict[int, np.ndarray]) -> None:
        self.two, self.orders = two, {}
        for k in range(3, ORDER + 1):
            own, c = summed(of_order(keys, k), counts)
            if k == 3:
                low = two[(own >> np.uint64(16)).astype(np.int64), (own & np.uint64(255)).astype(np.int64)]
            else:
                before, p, *_ = self.orders[k - 1]
                low = p[found(before, (own >> np.uint64(16) << np.uint64(8)) | (own & np.uint64(255)))[0]]
            self.orders[k] = own, *discounted(own, c, low, d[k])

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """log10 probabilities: of the longest history that was seen with the byte, times the weights of those that weren't."""
        p = self.two[(keys >> np.uint64(8 * (ORDER - 1))).astype(np.int64), (keys & np.uint64(255)).astype(np.int64)]
        for k, (own, known, names, weight) in self.orders.items():
            if len(own):
                key = of_order(keys, k)
                h, seen = found(names, key >> np.uint64(8))
                p = np.where(seen, weight[h], 1.0) * p
                at, hit = found(own, key)
                p = np.where(hit, known[at], p)
        return np.log10(p)


def answer(two: np.ndarray, d: dict[int, np.ndarray]):
    """A bucket's table and requests to answers: counts of words, log10 probabilities of n-grams."""

    def run(table: pa.Table) -> pa.Table:
        what, out = table["kind"][0].as_py(), []
        of = [c is None for c in table["chunk"].to_pylist()]
        model = [i for i, x in enumerate(of) if x]
        known = unsqueezed(table["keys"][model[0]].as_py(), np.uint64, True) if model else np.zeros(0, np.uint64)
        counts = unsqueezed(table["counts"][model[0]].as_py(), np.int64) if model else np.zeros(0, np.int64)
        grams = Grams(known, counts, two, d) if what == "gram" else None
        for i in range(table.num_rows):
            if of[i]:
                continue
            keys = unsqueezed(table["keys"][i].as_py(), np.uint64, True)
            if grams is None:
                at, hit = found(known, keys)
                data = np.where(hit, counts[at], 0) if len(known) else np.zeros(len(keys), np.int64)
            else:
                data = grams(keys).astype(np.float32)
            out.append({"kind": what, "chunk": table["chunk"][i].as_py(), "bucket": table["bucket"][i].as_py(), "at": table["at"][i].as_py(), "counts": squeezed(data)})
        return pa.Table.from_batches([_rows(out)])

    return run


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def score_chunk(buckets: int, ends: int, n: int, types: int):
    """A chunk and its answers to its documents' scores. ends: documents learned from; n, types: of the word model."""

    def run(table: pa.Table) -> pa.Table:
        kinds = table["kind"].to_pylist()
        c = table.slice(kinds.index("chunk"), 1).to_pylist()[0]
        lengths, text = np.frombuffer(c["lengths"], np.int64), ZstdDecompressor().decompress(c["line"])
        words, keys, _ = numbered(text.translate(BETWEEN).split(), buckets)

        def answered(kind: str, size: int, dtype) -> np.ndarray:
            line = np.zeros(size, dtype)
            for i, k in enumerate(kinds):
                if k == kind:
                    x = unsqueezed(table["counts"][i].as_py(), dtype)
                    at = table["at"][i].as_py()
                    line[at : at + len(x)] = x
            return line

        counts = answered("word", len(keys), np.int64)
        grams, doc = grams_of(text)
        order = np.argsort(grams)
        grams = grams[order]
        first = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
        keys = grams[first]
        logs = np.empty(len(keys))
        logs[by_bucket(keys, gram_bucket(keys, buckets))[0]] = answered("gram", len(keys), np.float32)
        score = np.bincount(doc[order], np.repeat(logs, np.diff(np.r_[first, len(grams)])), len(lengths))
        owner = np.repeat(np.arange(len(lengths)), lengths)
        bottom = n + 0.1 * (types + 1)
        base = np.bincount(owner, np.log10((counts + 0.1) / bottom)[words], len(lengths)) + np.log10((ends + 0.1) / bottom)
        known = np.bincount(owner, (counts > 0)[words], len(lengths)).astype(np.int64) + (ends > 0)
        return pa.table({
            "doc_id": pa.array(c["ids"], pa.int64()), "held_out": [held_out(d) for d in c["ids"]], "n_tokens": lengths + 1, "n_known": known, "base_score": base, "score": score,
        })

    return run


def katz_scores(docs: DataFrame, chunk_bytes: int = CHUNK) -> DataFrame:
    """One row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from documents with crc32(doc_id as text) mod 10 other than 0 (a null doc_id counts as empty text: held
    out). Null and empty texts are the end token alone; repeated rows count and are scored each; an empty table gives
    none. Words are told apart by 64-bit hashes; the model's own probabilities travel as 32-bit numbers.
    """
    spark = docs.sparkSession
    folder, buckets = shared_folder(spark, "katz"), max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    id_and_text(docs).mapInArrow(chunks(buckets, chunk_bytes), REQUEST).write.partitionBy("kind").option("compression", "zstd").parquet(f"{folder}/chunks")
    rows = spark.read.schema(REQUEST).parquet(f"{folder}/chunks")
    whole = rows.where("kind = 'chunk'")
    salt = (F.shiftrightunsigned("chunk", 32) / SALT + F.col("chunk").bitwiseAND(0xFFFFFFFF)).cast("long")
    requests = rows.where("kind <> 'chunk'").select("kind", "chunk", "bucket", "at", "keys", "counts", salt.alias("salt"))
    ends, salts = whole.select("learn", salt.alias("salt")).mapInArrow(_learned, "n long, salt long").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("salt"), F.lit(0))).first()
    sums, kind = requests, np.uint32
    while salts >= SALT:  # a tree: SALT rows of a bucket to one
        sums, kind, salts = sums.groupBy("kind", "bucket", "salt").applyInArrow(sum_counts(kind, False), TABLE), np.int64, salts // SALT
    sums = sums.groupBy("kind", "bucket", "salt").applyInArrow(sum_counts(kind, False), TABLE)
    sums.groupBy("kind", "bucket").applyInArrow(sum_counts(np.int64, True), TABLE).write.partitionBy("kind").option("compression", "zstd").parquet(f"{folder}/model")
    model = spark.read.schema(TABLE).parquet(f"{folder}/model")

    totals = {r.kind: r for r in model.groupBy("kind").agg(F.sum("n").alias("n"), F.sum("types").alias("types"), *[F.sum(F.get("r", F.lit(i))).alias(f"r{i}") for i in range((ORDER - 2) * (GT_MOST + 1))]).collect()}
    words, grams = totals.get("word"), totals.get("gram")
    n, types = (words.n + ends if words else ends), (words.types if words else 0) + (ends > 0)
    r = [grams[f"r{i}"] or 0 for i in range((ORDER - 2) * (GT_MOST + 1))] if grams else [0] * (ORDER - 2) * (GT_MOST + 1)
    d = {k: discounts(r[(k - 3) * (GT_MOST + 1) : (k - 2) * (GT_MOST + 1)]) for k in range(3, ORDER + 1)}
    # bytes after bytes: 65,536 rows at most
    counts = np.zeros((256, 256), np.int64)
    for x in model.where("kind = 'gram'").select("keys", "counts").mapInArrow(_pairs, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        counts[x.pair >> 8, x.pair & 255] = x.n
    # a table joins each group of SALT chunks' requests for its bucket
    tables = requests.select("kind", "bucket", "salt").distinct().join(model.select("kind", "bucket", "keys", "counts"), ["kind", "bucket"])
    asked = requests.drop("counts").unionByName(tables.withColumn("chunk", F.lit(None).cast("long")), allowMissingColumns=True)
    answered = asked.groupBy("kind", "bucket", "salt").applyInArrow(answer(order_two(counts), d), REQUEST)
    scored = whole.unionByName(answered).groupBy("chunk").applyInArrow(score_chunk(buckets, ends, n, types), SCORED)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def _learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([sum(x) for x in batch.column(0).to_pylist()], pa.int64()), batch.column(1)], names=["n", "salt"])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for keys, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            pair = of_order(unsqueezed(keys, np.uint64, True), 2).astype(np.int64)
            n = np.zeros(65536, np.int64)
            np.add.at(n, pair, unsqueezed(counts, np.int64))
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], names=["pair", "n"])
