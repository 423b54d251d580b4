from collections import Counter

import numpy as np
from brindle.llm import quality as q


def brute(text):
    words = [w for w in text.translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]
    lines = [x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c")]
    often = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {j for i in range(len(words) - 4) if often[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), sum(x in lines[:i] for i, x in enumerate(lines)), len(inside))


def test_statistics_equal_brute_force(documents, odd_docs):
    for df in (documents.where("n_chars < 20000"), odd_docs.where("doc_id IS NULL OR doc_id < 7")):
        want = sorted((str(r[0]), *brute(r[1] or "")) for r in df.select("doc_id", "text").collect())
        got = sorted((str(r[0]), *r[1:6]) for r in q.statistics(df).select("doc_id", *q.COUNTS[:5]).collect())
        assert got == want


def test_list_is_learned_and_keeps_good_rows():
    rng = np.random.default_rng(1)
    x = {"a": rng.random(900), "b": rng.random(900), "c": rng.random(900)}
    bad = (x["a"] > 0.9) | ((x["b"] < 0.2) & (x["c"] > 0.5))
    rules = q.learn_list(x, bad)
    kept = rules.predict(x)
    assert (~kept & bad).sum() > 0.9 * bad.sum() and (~kept & ~bad).sum() < 0.02 * (~bad).sum()
    assert q.learn_list(x, np.zeros(900, bool)).rules == []


def test_query(spark, sf_dir, documents, odd_docs, no_docs):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = q.quality_rules(documents, labels).collect()
    kept, want = {r.doc_id: r.kept for r in rows}, {r.doc_id: r.quality for r in labels.collect()}
    good = [d for d, v in want.items() if v == 1 and d in kept]
    assert len(rows) == documents.count() and sum(kept[d] for d in good) > 0.9 * len(good)
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept) for r in rows)
    none = labels.limit(0)
    assert sorted(str(r.doc_id) for r in q.quality_rules(odd_docs, none).collect() if r.kept) == ["6", "None"]  # the rest is short or repeats itself
    assert q.quality_rules(no_docs, none).collect() == []
    nulls = spark.createDataFrame([(None, 1), (3, None), (4, 0), (4, 1)], "doc_id long, quality int")
    assert q.fit_rules(odd_docs, nulls).rules == []
