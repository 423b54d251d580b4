from collections import Counter
from functools import cache

import numpy as np
from brindle.llm import katz


def base_scores(rows):
    learned = Counter()
    tokens = [(d, (t or "").encode().lower().split() + [None]) for d, t in rows]
    for d, t in tokens:
        if not katz.held_out(d):
            learned.update(t)
    n, v = sum(learned.values()), len(learned)
    out = []
    for d, t in tokens:
        out.append((str(d), katz.held_out(d), len(t), sum(learned[w] > 0 for w in t), n, round(sum(np.log10((learned[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 4)))
    return sorted(out)


def plain_model(rows):
    """The same model in dictionaries, evaluated by recursion, byte by byte."""
    events = [(d, [(tuple(line[i - katz.ORDER + 1 : i]), line[i]) for i in range(katz.ORDER - 1, len(line))]) for d, t in rows for line in [katz.spelled(katz.words_of(t or ""))]]
    seen, d = {}, {}
    for k in range(1, katz.ORDER + 1):
        c = Counter((h[len(h) - k + 1 :], w) for doc, es in events if not katz.held_out(doc) for h, w in es)
        d[k] = katz.discounts([sum(x == i for x in c.values()) for i in range(1, katz.GT_MOST + 2)])
        for (h, w), x in c.items():
            seen.setdefault(h, {})[w] = x
    single = np.array([seen.get((), {}).get(w, 0) for w in katz.SYMBOLS])
    p1 = dict(zip(katz.SYMBOLS, katz.unigram_probabilities(single), strict=True))

    @cache
    def p(h, w):
        if not h:
            return p1[w]
        own = seen.get(h)
        if not own:
            return p(h[1:], w)
        total = sum(own.values())
        q = {x: d[len(h) + 1][min(c, katz.GT_MOST + 1)] * c / total for x, c in own.items()}
        if sum(q.values()) >= 1 - 1e-12:
            q = {x: v * total / (total + 1) for x, v in q.items()}
        return q[w] if w in q else (1 - sum(q.values())) / (1 - sum(p(h[1:], x) for x in q)) * p(h[1:], w)

    for h in list(seen)[:: max(1, len(seen) // 40)]:
        assert abs(sum(p(h, w) for w in katz.SYMBOLS) - 1) < 1e-9
    return sorted((str(doc), float(sum(np.log10(p(h, w)) for h, w in es))) for doc, es in events)


def test_scores_equal_brute_force(documents, odd_docs):
    for df in (documents.where("n_chars < 1500").repartition(5), odd_docs.where("doc_id IS NULL OR doc_id < 7")):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        got = katz.katz_scores(df, chunk_bytes=20_000).collect()
        assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == base_scores(rows)
        for (d, x), (e, y) in zip(sorted((str(r.doc_id), r.score) for r in got), plain_model(rows), strict=True):
            assert d == e and abs(x - y) < 0.001


def test_held_out_texts_are_likelier_than_under_the_base(spark):
    import os

    docs = spark.read.parquet(f"{os.path.dirname(os.environ.get('TEST_SF_DIR', '/root/testdata/sf0.001'))}/sf0.1/documents.parquet")
    held = [r for r in katz.katz_scores(docs).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_counts_sum_in_a_tree(documents, monkeypatch):
    want = sorted((r.doc_id, round(r.score, 3)) for r in katz.katz_scores(documents).collect())
    monkeypatch.setattr(katz, "SALT", 2)
    assert sorted((r.doc_id, round(r.score, 3)) for r in katz.katz_scores(documents.repartition(11), chunk_bytes=30_000).collect()) == want


def test_empty(no_docs):
    assert katz.katz_scores(no_docs).collect() == []
