from collections import Counter
from functools import cache

import numpy as np
from brindle.llm import katz, katz_words
from brindle.llm.queries import op9_katz_scores

END, UNKNOWN = b"\n", b"\t"


def plain_model(rows):
    """The same model in dictionaries, evaluated by recursion, word by word."""
    texts = [(d, katz.words_of(t or "")) for d, t in rows]
    words = {w for d, t in texts if not katz.held_out(d) for w in [*t, END]}
    events = []
    for d, t in texts:
        line = [b"", b"", *[w if w in words else UNKNOWN for w in t], END]
        events.append((d, [((line[i - 2], line[i - 1]), line[i]) for i in range(2, len(line))]))
    seen, d = {}, {}
    for k in (1, 2, 3):
        c = Counter((h[3 - k :], w) for doc, es in events if not katz.held_out(doc) for h, w in es)
        d[k] = katz.discounts([sum(x == i for x in c.values()) for i in range(1, katz.GT_MOST + 2)])
        for (h, w), x in c.items():
            seen.setdefault(h, {})[w] = x
    alphabet = sorted(words | {END, UNKNOWN})
    p1 = dict(zip(alphabet, katz.unigram_probabilities(np.array([seen.get((), {}).get(w, 0) for w in alphabet])), strict=True))

    @cache
    def after(h):
        own = seen[h]
        total = sum(own.values())
        q = {x: d[len(h) + 1][min(c, katz.GT_MOST + 1)] * c / total for x, c in own.items()}
        if sum(q.values()) >= 1 - 1e-12:
            q = {x: v * total / (total + 1) for x, v in q.items()}
        return q, (1 - sum(q.values())) / (1 - sum(p(h[1:], x) for x in q))

    def p(h, w):
        if not h:
            return p1[w]
        if h not in seen:
            return p(h[1:], w)
        q, weight = after(h)
        return q[w] if w in q else weight * p(h[1:], w)

    for h in list(seen)[:: max(1, len(seen) // 40)]:
        assert abs(sum(p(h, w) for w in alphabet) - 1) < 1e-9
    return sorted((str(doc), float(sum(np.log10(p(h, w)) for h, w in es))) for doc, es in events)


def base_scores(rows):
    tokens = [(d, [*katz.words_of(t or ""), None]) for d, t in rows]
    learned = Counter(w for d, t in tokens if not katz.held_out(d) for w in t)
    n, v = sum(learned.values()), len(learned)
    return sorted((str(d), katz.held_out(d), len(t), sum(learned[w] > 0 for w in t), n, round(sum(np.log10((learned[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 4)) for d, t in tokens)


def test_scores_equal_brute_force(spark, documents, odd_docs, tmp_path):
    null = spark.createDataFrame([(None, "all are held out"), (None, None)], "doc_id long, text string")
    blank = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (4, "")], "doc_id long, text string")
    for i, df in enumerate((documents, odd_docs, null, blank)):
        df.select("doc_id", "text").repartition(5).write.parquet(f"{tmp_path}/{i}/documents.parquet")
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        docs = spark.read.parquet(f"{tmp_path}/{i}/documents.parquet")
        for got in (op9_katz_scores(spark, f"{tmp_path}/{i}").collect(), katz_words.katz_word_scores(docs, chunk_bytes=20_000).collect()):
            assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == base_scores(rows)
            for (d, x), (e, y) in zip(sorted((str(r.doc_id), r.score) for r in got), plain_model(rows), strict=True):
                assert d == e and abs(x - y) < 1e-3 + 1e-6 * abs(y)


def test_spelling_of_words_does_not_matter(spark, documents, tmp_path):
    """The model's grams are of words: other names for the same words change no score."""
    docs = documents.where("n_chars < 1500").select("doc_id", "text")
    names = {}
    other = [(r.doc_id, " ".join(f"{names.setdefault(w, len(names))}" for w in katz.words_of(r.text))) for r in docs.collect()]
    docs.write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame(other, "doc_id long, text string").write.parquet(f"{tmp_path}/b/documents.parquet")
    a, b = ({r.doc_id: r.score for r in op9_katz_scores(spark, f"{tmp_path}/{x}").collect()} for x in "ab")
    assert len(a) > 20 and a.keys() == b.keys() and all(abs(a[d] - b[d]) < 1e-3 for d in a)


def test_frequent_words_have_several_buckets(spark):
    """Words, pairs and beginnings with more than a bucket's share: their trigrams are dealt out, and scores stay the same."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{min(x, 400)}" for x in rng.zipf(1.7, rng.integers(0, 12)))) for i in range(1500)]
    got = katz_words.katz_word_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), chunk_bytes=9000).collect()
    for (d, x), (e, y) in zip(sorted((str(r.doc_id), r.score) for r in got), plain_model(rows), strict=True):
        assert d == e and abs(x - y) < 1e-4
    singles = katz_words.Singles(np.array([700, 500, 1]), np.array([1, 1, 100]), 300)
    bucket = katz_words.Buckets(16, singles)
    last = np.arange(3, 100, dtype=np.uint64)
    for middle, first, several in ((0, 0, True), (3, 3, True), (3, 0, True), (4, 3, True), (3, 50, False), (50, 3, False)):
        at = bucket((np.uint64(middle) << katz_words.HALF) | last, np.full(len(last), first, np.uint32))
        assert (len(set(at)) > 1) == several and at.max() < 2 * bucket.split - bucket.n


def test_empty(no_docs):
    assert katz_words.katz_word_scores(no_docs).collect() == []
