"""Quality rules: an ordered decision list, learned by sequential covering from labelled statistics.

Statistics of whole texts are counted per document. On a bounded sample of labelled documents, rules that reject are
grown one condition at a time by FOIL's information gain, pruned on held-back rows, and kept while they are precise;
each new rule sees only the rows that the earlier ones left. The list becomes one ordered Spark conditional expression.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, id_and_text, pick

#: Labelled documents that a list is learned from, at most: those with the smallest hashes of doc_id.
SAMPLE = 20_000
SYMBOLS = b"#*$%&|<>"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bangs", "n_distinct", "n_numbers")
#: What conditions may test: shares of the counts, so that they hold at every length.
FEATURES = {
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "bang_share": "n_bangs / greatest(n_words, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "number_share": "n_numbers / greatest(n_words, 1)",
    "words_a_line": "n_words / greatest(n_lines, 1)",
    "n_words": "n_words",
}


def repeated_words(words: list[bytes], k: int = 5) -> int:
    """Words inside k-word windows that occur twice or more, first ones included."""
    windows = list(zip(*(words[i:] for i in range(k)), strict=False))
    if len(windows) == len(set(windows)):
        return 0
    often = Counter(windows)
    total = reach = 0
    for i, w in enumerate(windows):
        if often[w] > 1:
            total += i + k - max(i, reach)
            reach = i + k
    return total


def counts(text: str) -> tuple[int, ...]:
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        len(data) - len(data.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(data) - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
        data.count(b"!"),
        len(set(words)),
        len(data) - len(data.translate(None, b"0123456789")),
    )


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [counts(t) for t in batch.column(1).to_pylist()]
        cols = list(zip(*rows)) if rows else [()] * len(COUNTS)
        rest = batch.columns[2:]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols), *rest], names=["doc_id", *COUNTS, *["whole"] * len(rest)])


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """One row a document: doc_id and COUNTS, and if asked for its whole row, a struct. Null texts count as empty."""
    rest = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")] * whole
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), *rest)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *[T.StructField(c, T.LongType()) for c in COUNTS], *[f for f in rows.schema if f.name == "whole"]])
    return rows.mapInArrow(_count_batches, schema)


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.at_least else x[self.feature] <= self.threshold

    def column(self) -> Column:
        value = F.expr(FEATURES[self.feature]).cast("double")
        return value >= self.threshold if self.at_least else value <= self.threshold


@dataclass
class DecisionList:
    """Rules in order; the first whose conditions all hold rejects the document; if none does, it is kept."""

    rules: list[list[Condition]] = field(default_factory=list)

    def keeps(self) -> Column:
        out = None
        for rule in self.rules:
            test = rule[0].column()
            for c in rule[1:]:
                test = test & c.column()
            out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))

    def predict(self, x: dict[str, np.ndarray]) -> np.ndarray:
        keep = np.ones(len(next(iter(x.values()))), bool)
        for rule in self.rules:
            keep &= ~np.logical_and.reduce([c.holds(x) for c in rule])
        return keep


def _gain(p0: float, n0: float, p: np.ndarray, n: np.ndarray) -> np.ndarray:
    """FOIL's: positives still covered, times the bits by which they are surer."""
    return p * (np.log2((p + 1e-9) / (p + n + 1e-9)) - np.log2(p0 / (p0 + n0)))


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int) -> list[Condition]:
    rule, inside = [], np.ones(len(bad), bool)
    while len(rule) < most and (inside & ~bad).any():
        p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
        best = (1e-6, None)
        for name, all_values in x.items():
            v, b = all_values[inside], bad[inside]
            order = np.argsort(v, kind="stable")
            v, b = v[order], b[order]
            ends = np.flatnonzero(np.diff(v)) + 1  # a threshold lies midway between neighbours
            if not len(ends):
                continue
            below, mid = np.cumsum(b)[ends - 1], (v[ends - 1] + v[ends]) / 2
            for at_least, p, n in ((True, p0 - below, len(b) - ends - (p0 - below)), (False, below, ends - below)):
                g = _gain(p0, n0, p, n)
                i = int(np.argmax(g))
                if g[i] > best[0]:
                    best = (g[i], Condition(name, at_least, float(mid[i])))
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= best[1].holds(x)
    return rule


def _prune(rule: list[Condition], x: dict[str, np.ndarray], bad: np.ndarray) -> list[Condition]:
    """The beginning of the rule that is worth most on held-back rows: (p - n) / (p + n), longer ones only if better."""
    best, worth, inside = rule, -2.0, np.ones(len(bad), bool)
    for i, c in enumerate(rule):
        inside = inside & c.holds(x)
        p, n = (inside & bad).sum(), (inside & ~bad).sum()
        value = (p - n) / (p + n) if p + n else -1.0
        if value > worth:
            best, worth = rule[: i + 1], value
    return best


def learn_list(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.9, least: int = 3, most_rules: int = 12, most_conditions: int = 4) -> DecisionList:
    """Sequential covering. bad: the rows to reject. A rule needs least positives, and the precision on both parts."""
    out = DecisionList()
    left, part = np.ones(len(bad), bool), np.arange(len(bad)) % 3 == 2
    while len(out.rules) < most_rules and (left & bad & ~part).sum() >= least:
        grow, hold = left & ~part, left & part
        rule = _prune(_grow({k: v[grow] for k, v in x.items()}, bad[grow], most_conditions), {k: v[hold] for k, v in x.items()}, bad[hold])
        if not rule:
            break
        inside = np.logical_and.reduce([c.holds(x) for c in rule]) & left
        p, n = (inside & bad).sum(), (inside & ~bad).sum()
        held_p, held_n = (inside & bad & part).sum(), (inside & ~bad & part).sum()
        if p < least or p / (p + n) < precision or held_p + held_n and held_p / (held_p + held_n) < precision - 0.1:
            break
        out.rules.append(rule)
        left &= ~inside
    return out


def fit_rules(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, **options) -> DecisionList:
    """Learns from documents with a quality label (0: reject). Labels that are null or contradict each other don't count.

    At most sample labels, by the hash of doc_id, go to the executors and as many rows of numbers to the driver.
    An empty table of labels gives the empty list, which keeps all.
    """
    marks = pick(labels, doc_id="doc_id", quality="quality").where("doc_id IS NOT NULL AND quality IS NOT NULL")
    marks = marks.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most").drop("most")
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = id_and_text(docs).join(F.broadcast(chosen), "doc_id")
    # of several texts of one doc_id always the same one
    rows = statistics(texts).groupBy("doc_id").agg(F.min(F.struct(*COUNTS)).alias("s")).select("doc_id", "s.*").join(F.broadcast(chosen), "doc_id")
    table = rows.select("doc_id", "quality", *[F.expr(e).cast("double").alias(f) for f, e in FEATURES.items()]).limit(sample).toPandas()
    table = table.assign(h=mix_order(table.doc_id)).sort_values(["h", "doc_id"])
    return learn_list({f: table[f].to_numpy(float) for f in FEATURES}, (table.quality == 0).to_numpy(), **options)


def mix_order(ids) -> np.ndarray:
    from .common import mix

    return mix(ids.to_numpy().astype(np.int64).view(np.uint64))


def quality_rules(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row a document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    Null and empty texts have no words and fail the base. A null doc_id and repeated rows stay; an empty table gives none.
    """
    return _judged(docs, labels, False, **options).select("doc_id", *COUNTS[:5], "base_failed", "kept")


def _judged(docs: DataFrame, labels: DataFrame, whole: bool, **options) -> DataFrame:
    rules = fit_rules(docs, labels, **options)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return statistics(docs, whole=whole).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & rules.keeps())


def good_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns; one pass, no join."""
    return _judged(docs, labels, True, **options).where("kept").select("whole.*")
