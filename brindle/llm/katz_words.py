"""Katz backoff language model over words, of order three, and an additive model of the same words as its base.

Words are split at white space, A-Z lower-cased; a document is its words and its end. The alphabet is that of the base:
the words that were learned, the end, and one unknown word for all others. Counts of each order are discounted by Good
and Turing; what a history loses goes to the words it has not been seen with, in proportion to their probabilities after
the history that is one word shorter, exactly normalised, and so on down to single words, whose own loss is the unknown
word's probability. Before a document stand two beginnings, which are histories only.

Counting and scoring at scale. Chunks of whole documents are written once, as numbers, and ask for each distinct word
once; words lie in buckets by hash. Words are then numbered by their counts, most frequent first: a number tells the
count, hence the probability of a single word, by a short table of the distinct counts. With these numbers a chunk asks
for each distinct trigram once. Trigrams lie in buckets by their middle word, so that a bucket has all that they back
off to; a word too frequent for one bucket has several, by the trigrams' first word, and the sums of its pairs go to
each of them. If the first word is that frequent too, what follows the two words is dealt by the last word, and the sums
of the two words go to each of these buckets. A bucket is read twice: for its counts of counts, then for the answers,
with which a chunk scores its documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, id_and_text, mix, shared_folder
from .katz import CHUNK, GT_MOST, by_bucket, counts_of_counts, discounts, found, held_out, numbered, squeezed, summed, unsqueezed, word_bucket, words_of

#: Numbers of what stands before a document, of its end, and of all words that were not learned; words follow.
BEGIN, END, UNKNOWN, WORDS = 0, 1, 2, 3
HALF = np.uint64(32)
ROW = "kind string, chunk long, bucket int, at long, ids array<long>, lengths binary, learn binary, line binary, times binary, known binary, base binary, keys binary, first binary, counts binary"
NAMES = [x.split()[0] for x in ROW.split(", ")]
KINDS = {"kind": pa.string(), "chunk": pa.int64(), "bucket": pa.int32(), "at": pa.int64(), "ids": pa.list_(pa.int64())}


def rows_of(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], KINDS.get(n, pa.binary())) for n in NAMES], names=NAMES)


def chunks(buckets: int, most: int = CHUNK):
    """Batches of (doc_id, text) to chunk rows and requests for words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx = TaskContext.get()
        chunk = (ctx.partitionId() if ctx else 0) << 32
        ids: list = []
        words: list[bytes] = []
        lengths: list[int] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            learn = np.array([not held_out(d) for d in ids], bool)
            line, keys, edges = numbered(words, buckets)
            counts = np.bincount(line[np.repeat(learn, lengths)], minlength=len(keys)).astype(np.uint32)
            yield rows_of([{"kind": "chunk", "chunk": chunk, "ids": ids, "lengths": np.array(lengths, np.int64).tobytes(), "learn": learn.tobytes(), "line": squeezed(line)}])
            rows = [
                {"kind": "word", "chunk": chunk, "bucket": b, "at": int(i), "keys": squeezed(keys[i:j], True), "counts": squeezed(counts[i:j])}
                for b, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True))
                if j > i
            ]
            for i in range(0, len(rows), 64):
                yield rows_of(rows[i : i + 64])

        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py()
                own = words_of(text)
                if size and size + len(text) > most:
                    yield from flush()
                    chunk += 1
                    size = 0
                    for x in (ids, words, lengths):
                        x.clear()
                ids.append(batch.column(0)[i].as_py())
                words.extend(own)
                lengths.append(len(own))
                size += len(text) + 1
        if ids:
            yield from flush()

    return run


def word_counts(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Of a bucket the words that were learned and their counts."""
    keys = np.concatenate([unsqueezed(x.as_py(), np.uint64, True) for x in table["keys"]])
    counts = np.concatenate([unsqueezed(x.as_py(), np.uint32) for x in table["counts"]]).astype(np.int64)
    return summed(keys[counts > 0], counts[counts > 0])


def how_many(table: pa.Table) -> pa.Table:
    """Of a bucket each distinct count, and how many words have it."""
    c, n = np.unique(word_counts(table)[1], return_counts=True)
    return pa.table({"bucket": pa.array([table["bucket"][0].as_py()] * len(c), pa.int32()), "c": pa.array(c, pa.int64()), "n": pa.array(n, pa.int64())})


class Singles:
    """Single words by their counts: the numbers with which the counts begin, and their probabilities.

    counts: distinct, descending; types: how many words have them; ends: documents learned from.
    """

    def __init__(self, counts: np.ndarray, types: np.ndarray, ends: int) -> None:
        self.counts, self.ends = counts, ends
        self.firsts = np.r_[BEGIN, END, UNKNOWN, WORDS + np.cumsum(types) - types].astype(np.uint64)
        self.types, self.n = int(types.sum()) + (ends > 0), int((counts * types).sum()) + ends
        self.of = np.r_[0, ends, 0, counts].astype(np.int64)
        if not self.n:
            self.p = np.array([0, 0.5, 0.5])
            return
        many = np.r_[0, 1, 0, types]
        d = discounts([int(many[self.of == i].sum()) for i in range(1, GT_MOST + 2)])
        p = d[np.minimum(self.of, GT_MOST + 1)] * self.of / self.n
        left = 1 - (many * p).sum()
        if left <= 1e-9:  # no count was small enough to be discounted
            p, left = p * (1 - 1 / (self.n + 1)), 1 / (self.n + 1)
        p[UNKNOWN] = left
        self.p = p / ((many * p).sum() + left)

    def at(self, numbers: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.firsts, numbers, side="right") - 1


class Buckets:
    """Where trigrams lie: by their middle word, or, if that has more than a bucket's share, in buckets of its own.

    These are by the first word, from n on; by first and last word, from split on, if the first one has more than a
    bucket's share too.
    """

    def __init__(self, n: int, singles: Singles) -> None:
        many = np.diff(np.r_[singles.firsts[WORDS:].astype(np.int64), WORDS + singles.types - (singles.ends > 0)])
        over = singles.counts * n > singles.n
        # of the beginning (none, if it has no more than a share), then of words
        counts = np.r_[singles.ends if singles.ends * n > singles.n else 0, np.repeat(singles.counts[over], many[over])]
        self.n, self.shares = n, -(-counts * n // max(1, singles.n)).astype(np.int64)
        self.firsts = n + np.cumsum(self.shares) - self.shares
        self.split = n + int(self.shares.sum())

    def frequent(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words have buckets of their own, and where they stand in shares."""
        at = np.where(words == BEGIN, 0, words.astype(np.int64) - WORDS + 1)
        yes = (words == BEGIN) | (words >= WORDS)
        yes &= at < len(self.shares)
        at[~yes] = 0
        return yes & (self.shares[at] > 0), at

    def of(self, word: int, split: bool) -> range:
        at = 0 if word == BEGIN else word - WORDS + 1
        start = int(self.firsts[at]) + (self.split - self.n if split else 0)
        return range(start, start + int(self.shares[at]))

    def __call__(self, keys: np.ndarray, first: np.ndarray) -> np.ndarray:
        middle = keys >> HALF
        by_first = mix(first, 23)
        # nothing was learned after the unknown word: any bucket will do
        out = (np.where(middle == UNKNOWN, by_first, mix(middle, 22)) % np.uint64(self.n)).astype(np.int64)
        yes, at = self.frequent(middle)
        own = np.flatnonzero(yes)
        split, at = self.frequent(first[own])[0], at[own]
        by = np.where(split, mix(by_first[own] ^ keys[own], 24), by_first[own]) % self.shares[at].astype(np.uint64)
        out[own] = self.firsts[at] + by.astype(np.int64) + np.where(split, self.split - self.n, 0)
        return out


def number_words(singles: Singles):
    """A bucket's requests, and the numbers with which its words of each count begin, to answers: the words' numbers."""

    def run(table: pa.Table, starts: pa.Table) -> pa.Table:
        keys, counts = word_counts(table)
        begin = dict(zip(starts["c"].to_pylist(), starts["before"].to_pylist(), strict=True))
        order = np.lexsort((keys, -counts))
        numbers = np.empty(len(keys), np.uint32)
        c, first, n = np.unique(-counts[order], return_index=True, return_counts=True)
        for x, i, m in zip(-c, first, n, strict=True):
            at = int(singles.firsts[WORDS + np.searchsorted(-singles.counts, -x)]) + begin[int(x)]
            numbers[order[i : i + m]] = np.arange(at, at + m, dtype=np.uint32)
        out = []
        for chunk, at, asked in zip(table["chunk"].to_pylist(), table["at"].to_pylist(), table["keys"], strict=True):
            i, hit = found(keys, unsqueezed(asked.as_py(), np.uint64, True))
            out.append({"kind": "word", "chunk": chunk, "at": at, "counts": squeezed(np.where(hit, numbers[i], UNKNOWN).astype(np.uint32) if len(keys) else np.full(len(i), UNKNOWN, np.uint32))})
        return pa.Table.from_batches([rows_of(out)])

    return run


def grams_of(words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of numbered documents, one after the other, the trigram of each word and end, and the number of its document.

    A trigram is its middle and last word in one key, and its first word.
    """
    ends = np.cumsum(lengths + 1) - 1
    line = np.full(len(words) + len(lengths), END, np.uint64)
    inner = np.ones(len(line), bool)
    inner[ends] = False
    line[inner] = words
    starts = ends - lengths
    middle, first = np.r_[np.uint64(BEGIN), line[:-1]], np.r_[np.uint64(BEGIN), np.uint64(BEGIN), line[:-2]][: len(line)]
    middle[starts] = BEGIN
    first[starts] = BEGIN
    first[(starts + 1)[lengths > 0]] = BEGIN
    return (middle << HALF) | line, first.astype(np.uint32), np.repeat(np.arange(len(lengths)), lengths + 1)


def answers_of(table: pa.Table, kinds: list, kind: str, dtype) -> np.ndarray:
    """A chunk's answers in the order of its requests."""
    parts = sorted((table["at"][i].as_py(), i) for i, k in enumerate(kinds) if k == kind)
    return np.concatenate([np.zeros(0, dtype), *[unsqueezed(table["counts"][i].as_py(), dtype) for _, i in parts]])


def number_chunk(singles: Singles, bucket: Buckets):
    """A chunk and its words' numbers to its documents' base scores and its requests for trigrams."""

    def run(table: pa.Table) -> pa.Table:
        kinds = table["kind"].to_pylist()
        c = table.slice(kinds.index("chunk"), 1).to_pylist()[0]
        lengths, learn = np.frombuffer(c["lengths"], np.int64), np.frombuffer(c["learn"], bool)
        words = answers_of(table, kinds, "word", np.uint32)
        line = unsqueezed(c["line"], np.int32)
        bottom = singles.n + 0.1 * (singles.types + 1)
        counts = singles.of[singles.at(words)]
        owner = np.repeat(np.arange(len(lengths)), lengths)
        base = np.bincount(owner, np.log10((counts + 0.1) / bottom)[line], len(lengths)) + np.log10((singles.ends + 0.1) / bottom)
        known = np.bincount(owner, (counts > 0)[line], len(lengths)).astype(np.int64) + (singles.ends > 0)
        keys, first, doc = grams_of(words[line], lengths)
        order = np.lexsort((first, keys))
        keys, first, doc = keys[order], first[order], doc[order]
        of = bucket(keys, first)
        order = np.argsort(of, kind="stable")
        keys, first, doc, of = keys[order], first[order], doc[order], of[order]
        new = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (first[1:] != first[:-1]) | (of[1:] != of[:-1])])
        counts = np.add.reduceat(learn[doc], new, dtype=np.int64).astype(np.uint32)
        times = np.diff(np.r_[new, len(keys)]).astype(np.uint32)
        keys, first, of = keys[new], first[new], of[new]
        edges = np.r_[np.flatnonzero(np.r_[True, of[1:] != of[:-1]]), len(of)]
        out = [{
            "kind": "chunk", "chunk": c["chunk"], "ids": c["ids"], "lengths": c["lengths"], "line": squeezed(doc.astype(np.uint32)), "times": squeezed(times), "known": known.tobytes(), "base": base.tobytes(),
        }]
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            out.append({"kind": "gram", "chunk": c["chunk"], "bucket": int(of[i]), "at": int(i), "keys": squeezed(keys[i:j], True), "first": squeezed(first[i:j]), "counts": squeezed(counts[i:j])})
        return pa.Table.from_batches([rows_of(out)])

    return run


def gram_counts(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a bucket the distinct trigrams, ascending, in keys and first words, their counts (0: not learned), and which one each request is, one after the other."""
    keys = np.concatenate([unsqueezed(x.as_py(), np.uint64, True) for x in table["keys"]])
    first = np.concatenate([unsqueezed(x.as_py(), np.uint32) for x in table["first"]])
    counts = np.concatenate([unsqueezed(x.as_py(), np.uint32) for x in table["counts"]])
    order = np.lexsort((first, keys))
    keys, first, counts = keys[order], first[order], counts[order]
    new = np.r_[True, (keys[1:] != keys[:-1]) | (first[1:] != first[:-1])]
    which = np.empty(len(order), np.int32)
    which[order] = np.cumsum(new, dtype=np.int32) - 1
    del order
    return keys[new], first[new], np.add.reduceat(counts, np.flatnonzero(new), dtype=np.int64), which


def pairs_of(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of ascending ones, the sums of their counts, and which one each is."""
    new = np.r_[True, keys[1:] != keys[:-1]]
    return keys[new], np.add.reduceat(counts, np.flatnonzero(new)), np.cumsum(new, dtype=np.int32) - 1


#: Of a bucket or word: its pairs (used is null) or its histories of two words.
SUMS = "word long, bucket int, keys binary, counts binary, used binary, known binary, two array<long>, three array<long>"
SUMS_ARROW = pa.schema([("word", pa.int64()), ("bucket", pa.int32()), *[(k, pa.binary()) for k in ("keys", "counts", "used", "known")], ("two", pa.list_(pa.int64())), ("three", pa.list_(pa.int64()))])


def joined(column: pa.ChunkedArray, dtype, ascending: bool = False) -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype), *[unsqueezed(x.as_py(), dtype, ascending) for x in column]])


def count(n: int):
    """A bucket's counts of counts, of pairs and of trigrams; if its word has several buckets, its pairs instead."""

    def run(table: pa.Table) -> pa.Table:
        keys, _, counts, _ = gram_counts(table)
        row = {"three": counts_of_counts(counts)}
        own, c, _ = pairs_of(keys, counts)
        own, c = own[c > 0], c[c > 0]
        if table["bucket"][0].as_py() < n:
            row["two"] = counts_of_counts(c)
        elif len(own):
            row |= {"word": int(keys[0] >> HALF), "keys": squeezed(own, True), "counts": squeezed(c)}
        return pa.Table.from_pylist([row], SUMS_ARROW)

    return run


def sum_pairs(bucket: Buckets):
    """The pairs of a word that has several buckets, from all of them to each; counts of counts stand with the first."""

    def run(table: pa.Table) -> pa.Table:
        word = table["word"][0].as_py()
        keys, counts = summed(joined(table["keys"], np.uint64, True), joined(table["counts"], np.int64))
        row = {"word": word, "keys": squeezed(keys, True), "counts": squeezed(counts)}
        rows = [row | {"bucket": b} for split in (False, True) for b in bucket.of(word, split)]
        rows[0]["two"] = counts_of_counts(counts)
        return pa.Table.from_pylist(rows, SUMS_ARROW)

    return run


def sums_of(histories: np.ndarray, counts: np.ndarray, low: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of learned n-grams the distinct histories, ascending, with the sums of counts, of discounted counts, and of low, the probabilities after a history one word shorter."""
    names, at = np.unique(histories, return_inverse=True)
    return names, np.bincount(at, counts, len(names)), np.bincount(at, d[np.minimum(counts, GT_MOST + 1)] * counts, len(names)), np.bincount(at, low, len(names))


def factors(total: np.ndarray, used: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From these sums of histories what makes a discounted count a probability, and the backoff weight."""
    used = used / total
    # a history whose counts are all large frees nothing: give it one count more
    scale = np.where((used >= 1 - 1e-12) & (known < 1), total / (total + 1), 1.0)
    used = used * scale
    every = known >= 1 - 1e-12  # seen with all words: nothing to back off to
    weight = np.where(every, 0.0, np.maximum(1 - used, 1e-300) / np.maximum(1 - known, 1e-300))
    return np.where(every, scale / used, scale) / total, weight


def backed_off(asked: np.ndarray, low: np.ndarray, own: np.ndarray, counts: np.ndarray, d: np.ndarray, sums: tuple) -> np.ndarray:
    """Probabilities of n-grams: of those with counts (places own) their share, of others that of low, times their history's weight, if that was learned.

    asked: histories; sums: of histories, as by sums_of.
    """
    if not len(sums[0]):
        return low
    factor, weight = factors(*sums[1:])
    at, seen = found(sums[0], asked)
    out = low * np.where(seen, weight[at], 1.0)
    out[own] = d[np.minimum(counts, GT_MOST + 1)] * counts * factor[at[own]]
    return out


def after_one(singles: Singles, keys: np.ndarray, counts: np.ndarray, pairs: tuple[np.ndarray, np.ndarray] | None, d: np.ndarray) -> np.ndarray:
    """Of a bucket's trigrams the probabilities of their last words after their middle ones. pairs: of a word that has several buckets."""

    def single(keys: np.ndarray) -> np.ndarray:
        return singles.p[singles.at(keys & np.uint64(0xFFFFFFFF))]

    asked, c, pair = pairs_of(keys, counts)
    own, c = (asked[c > 0], c[c > 0]) if pairs is None else pairs
    at, hit = found(own, asked)
    sums = sums_of(own >> HALF, c, single(own), d)
    return backed_off(asked >> HALF, single(asked), np.flatnonzero(hit), c[at[hit]], d, sums)[pair]


def pairs_in(table: pa.Table) -> tuple[np.ndarray, np.ndarray] | None:
    rows = [r for r in table.to_pylist() if r["used"] is None]
    return (unsqueezed(rows[0]["keys"], np.uint64, True), unsqueezed(rows[0]["counts"], np.int64)) if rows else None


def count_histories(singles: Singles, two: np.ndarray, three: np.ndarray):
    """A bucket by first and last word, and its middle word's pairs, to the sums of its histories."""

    def run(table: pa.Table, known: pa.Table) -> pa.Table:
        if not table.num_rows or not known.num_rows:
            return SUMS_ARROW.empty_table()
        keys, first, counts, _ = gram_counts(table)
        low = after_one(singles, keys, counts, pairs_in(known), two)
        yes = counts > 0
        names, total, used, low = sums_of((keys[yes] >> HALF << HALF) | first[yes], counts[yes], low[yes], three)
        row = {"word": int(keys[0] >> HALF), "bucket": table["bucket"][0].as_py(), "keys": squeezed(names, True), "counts": squeezed(total), "used": squeezed(used), "known": squeezed(low)}
        return pa.Table.from_pylist([row] if len(names) else [], SUMS_ARROW)

    return run


def sum_histories(bucket: Buckets):
    """The histories' sums of a middle word, from all of its buckets by first and last word to each."""

    def run(table: pa.Table) -> pa.Table:
        word, table = table["word"][0].as_py(), table.sort_by("bucket")
        names, at = np.unique(joined(table["keys"], np.uint64, True), return_inverse=True)
        sums = {k: squeezed(np.bincount(at, joined(table[k], np.float64), len(names))) for k in ("counts", "used", "known")}
        return pa.Table.from_pylist([{"word": word, "bucket": b, "keys": squeezed(names, True), **sums} for b in bucket.of(word, True)], SUMS_ARROW)

    return run


def answer(singles: Singles, two: np.ndarray, three: np.ndarray, split: int):
    """A bucket's requests, and the pairs and histories that it shares with others, to answers: log10 probabilities of trigrams. two, three: factors of the counts."""

    def run(table: pa.Table, known: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.Table.from_batches([rows_of([])])
        keys, first, counts, which = gram_counts(table)
        low = after_one(singles, keys, counts, pairs_in(known), two)
        keys >>= HALF
        keys <<= HALF
        keys |= first
        own = np.flatnonzero(counts)
        counts = counts[own]
        if table["bucket"][0].as_py() < split:
            sums = sums_of(keys[own], counts, low[own], three)
        else:
            rows = [r for r in known.to_pylist() if r["used"] is not None]
            sums = (unsqueezed(rows[0]["keys"], np.uint64, True), *[unsqueezed(rows[0][k], np.float64) for k in ("counts", "used", "known")]) if rows else (keys[:0],)
        logs = np.log10(backed_off(keys, low, own, counts, three, sums)).astype(np.float32)[which]
        out, done = [], 0
        for chunk, at, x in zip(table["chunk"].to_pylist(), table["at"].to_pylist(), table["counts"], strict=True):
            n = len(unsqueezed(x.as_py(), np.uint32))
            out.append({"kind": "gram", "chunk": chunk, "at": at, "counts": squeezed(logs[done : done + n])})
            done += n
        return pa.Table.from_batches([rows_of(out)])

    return run


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def score_chunk(table: pa.Table) -> pa.Table:
    """A chunk and its answers to its documents' scores."""
    kinds = table["kind"].to_pylist()
    c = table.slice(kinds.index("chunk"), 1).to_pylist()[0]
    lengths = np.frombuffer(c["lengths"], np.int64)
    logs = np.repeat(answers_of(table, kinds, "gram", np.float32).astype(np.float64), unsqueezed(c["times"], np.uint32))
    return pa.table({
        "doc_id": pa.array(c["ids"], pa.int64()), "held_out": [held_out(d) for d in c["ids"]], "n_tokens": lengths + 1, "n_known": np.frombuffer(c["known"], np.int64),
        "base_score": np.frombuffer(c["base"], np.float64), "score": np.bincount(unsqueezed(c["line"], np.uint32), logs, len(lengths)),
    })


def katz_word_scores(docs: DataFrame, chunk_bytes: int = CHUNK) -> DataFrame:
    """One row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from documents with crc32(doc_id as text) mod 10 other than 0 (a null doc_id counts as empty text: held
    out). Null and empty texts are the end token alone; repeated rows count and are scored each; an empty table gives
    none. Words are told apart by 64-bit hashes; the model's own probabilities travel as 32-bit numbers.
    """
    spark = docs.sparkSession
    folder, n = shared_folder(spark, "katz"), max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def stored(df: DataFrame, name: str, schema: str, *by: str) -> DataFrame:
        df.write.partitionBy(*by).option("compression", "zstd").parquet(f"{folder}/{name}")
        return spark.read.schema(schema).parquet(f"{folder}/{name}")

    texts = stored(id_and_text(docs).mapInArrow(chunks(n, chunk_bytes), ROW), "chunks", ROW, "kind")
    asked = texts.where("kind = 'word'").select("chunk", "bucket", "at", "keys", "counts")
    ends = texts.where("kind = 'chunk'").select("learn").mapInArrow(_learned, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    many = stored(asked.groupBy("bucket").applyInArrow(how_many, "bucket int, c long, n long"), "words", "bucket int, c long, n long")
    # distinct counts: no more than the root of twice the words
    totals = many.groupBy("c").agg(F.sum("n").alias("n")).toArrow().sort_by([("c", "descending")])
    singles = Singles(totals["c"].to_numpy(), totals["n"].to_numpy(), ends)
    if singles.types > 2**32 - WORDS:
        raise ValueError("more distinct words than 32-bit numbers")
    bucket = Buckets(n, singles)
    before = Window.partitionBy("c").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = many.select("bucket", "c", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    named = asked.groupBy("bucket").cogroup(starts.groupBy("bucket")).applyInArrow(number_words(singles), ROW)
    grams = texts.where("kind = 'chunk'").unionByName(named).groupBy("chunk").applyInArrow(number_chunk(singles, bucket), ROW)
    numbers = stored(grams, "grams", ROW, "kind")
    forget(texts, many)

    asked = numbers.where("kind = 'gram'").select("chunk", "bucket", "at", "keys", "first", "counts")
    sums = stored(asked.groupBy("bucket").applyInArrow(count(n), SUMS), "counts", SUMS)
    pairs = stored(sums.where("word IS NOT NULL").groupBy("word").applyInArrow(sum_pairs(bucket), SUMS), "pairs", SUMS)
    of = [F.coalesce(F.sum(F.get(k, F.lit(i))), F.lit(0)) for k in ("two", "three") for i in range(GT_MOST + 1)]
    r = sums.select("two", "three").unionByName(pairs.select("two", "three")).agg(*of).first()
    two, three = discounts(list(r[: GT_MOST + 1])), discounts(list(r[GT_MOST + 1 :]))
    split = F.col("bucket") >= bucket.split
    histories = asked.where(split).groupBy("bucket").cogroup(pairs.where(split).groupBy("bucket")).applyInArrow(count_histories(singles, two, three), SUMS)
    known = pairs.unionByName(stored(histories.groupBy("word").applyInArrow(sum_histories(bucket), SUMS), "histories", SUMS))
    answered = asked.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(answer(singles, two, three, bucket.split), ROW)
    scored = numbers.where("kind = 'chunk'").unionByName(answered).groupBy("chunk").applyInArrow(score_chunk, SCORED)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(singles.n).cast("long").alias("train_tokens"), "base_score", "score")


def _learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([sum(x) for x in batch.column(0).to_pylist()], pa.int64())], names=["n"])
