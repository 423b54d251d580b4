"""What the operators of this package share: input columns, shared folders and word splitting."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.plans.storage import forget, shared_folder, written  # noqa: F401

#: ASCII white space: what separates words in the contracts of this package.
SPACES = " \t\n\r\x0b\x0c"


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns alone, renamed to the keywords. Other columns, whatever they are called, can't clash."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id (long, null stays null) and text (null becomes empty)."""
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): equal inputs give equal outputs, nearly equal ones unrelated ones."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def portions(batch: pa.RecordBatch, column: int, rows: int, size: int = 500_000) -> Iterator[tuple[pa.RecordBatch, list]]:
    """A batch in slices of so many rows and characters of the column, at most (a longer row alone), with its values; null is empty."""
    at = 0
    while at < batch.num_rows:
        values = [x or "" for x in batch.column(column).slice(at, rows).to_pylist()]
        ends = np.cumsum([len(x) for x in values])
        n = max(1, int(np.searchsorted(ends, size, side="right")))
        yield batch.slice(at, n), values[:n]
        at += n


class WordHasher:
    """64-bit hashes of words. Most words of a large corpus are rare: hashing each costs less than remembering them."""

    def __call__(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_rows(rows: np.ndarray) -> np.ndarray:
    """The hash of each row of word hashes: what shingles() gives for these words."""
    with np.errstate(over="ignore"):
        h = np.full(len(rows), rows.shape[1], np.uint64)
        for i in range(rows.shape[1]):
            h = h * np.uint64(0x9FB21C651E98DF25) + rows[:, i]
    return mix(h)


def shingles(hashed: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of all k-word windows in order; of the whole, if there are fewer words; none, if there are none."""
    if not len(hashed):
        return hashed
    k = min(k, len(hashed))
    n = len(hashed) - k + 1
    with np.errstate(over="ignore"):
        h = np.full(n, k, np.uint64)
        for i in range(k):
            h = h * np.uint64(0x9FB21C651E98DF25) + hashed[i : n + i]
    return mix(h)
