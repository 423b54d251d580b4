from collections import Counter, defaultdict

import numpy as np
from brindle.llm.near_dedup import dart_signatures, distinct_documents, near_duplicates
from pyspark.sql import functions as F


def brute(texts):
    bags = []
    for _, t in texts:
        w = (t or "").split()
        bags.append(Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter())
    parent = list(range(len(bags)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(set)
    for i, b in enumerate(bags):
        for s in b:
            holders[s].add(i)
    for i, j in {(i, j) for h in holders.values() if len(h) < 200 for i in h for j in h if i < j}:
        both = (bags[i] & bags[j]).total()
        if both >= 0.8 * (bags[i].total() + bags[j].total() - both):
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    return [root(i) for i in range(len(bags))]


def test_classes_equal_brute_force(documents):
    rows = sorted((r.doc_id, r.text) for r in documents.select("doc_id", "text").collect())
    want = {d: rows[c][0] for (d, _), c in zip(rows, brute(rows), strict=True)}
    got = near_duplicates(documents).collect()
    assert {r.doc_id: r.class_id for r in got} == want
    sizes = Counter(want.values())
    assert all(r.class_size == sizes[r.class_id] and r.kept == (r.doc_id == r.class_id) for r in got)


def test_signatures_estimate_the_weighted_similarity():
    rng = np.random.default_rng(3)
    names = rng.integers(0, 2**63, 300).astype(np.uint64)
    a, b = rng.random(300) * 4, rng.random(300) * 4
    b[100:] = a[100:]
    sig = dart_signatures(np.r_[names, names], np.r_[a, b], np.repeat([0, 1], 300), 2, 2000)
    assert abs((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04


def test_edges(odd_docs, no_docs):
    got = near_duplicates(odd_docs).collect()
    assert len(got) == 10
    by = {r.doc_id: r for r in got}
    assert by[5].class_id == 4 and by[5].class_size == 3 and not by[5].kept and by[4].kept
    assert all(by[d].class_id == d and by[d].class_size == 1 and by[d].kept for d in (None, 1, 2, 3, 6, 7, 8))
    assert near_duplicates(no_docs).collect() == []


def star(n):
    """An original and n copies with other edits: each is similar to the original, hardly any two to each other."""
    rng = np.random.default_rng(8)
    words = [f"w{x}" for x in rng.integers(0, 10**9, 400)]
    rows = []
    for i in range(n):
        own = list(words)
        for p in 5 + 10 * rng.choice(39, 6, replace=False):
            own[p] = f"e{i}x{p}"
        rows.append((i, " ".join(own)))
    return [*rows, (n, " ".join(words))]


def test_no_bucket_loses_a_link(spark):
    rows = star(120)
    assert set(brute(rows)) == {0}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for options in ({}, {"few": 2, "block": 7}):  # pairs listed, and blocks
        got = near_duplicates(docs, hubs=1, **options).collect()
        assert {r.class_id for r in got} == {0} and len(got) == 121 and sum(r.kept for r in got) == 1


def test_a_hub_unlike_the_rest_hides_no_pair(spark):
    """All texts but two share buckets with a hub that is hardly like them; the last two are alike."""
    a = [f"a{x}" for x in range(300)]
    b = list(a)
    b[150] = "edited"
    rows = [(i, " ".join([f"f{i}x{j}" for j in range(90)] + a[:210])) for i in range(40)] + [(100, " ".join(a)), (101, " ".join(b))]
    want = brute(rows)
    for options in ({}, {"hubs": 1, "few": 2, "block": 5}):
        got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), bands=60, rows=1, **options).collect()}
        assert got == {d: rows[c][0] for (d, _), c in zip(rows, want, strict=True)}


def test_rows_without_an_id_and_repeated_rows(spark):
    words = [f"w{i}" for i in range(200)]
    near = [*words[:100], "other", *words[101:]]
    c = " ".join(f"c{i}" for i in range(50))
    rows = [(None, " ".join(words)), (None, " ".join(near)), (3, " ".join(near)), (7, c), (7, c), (None, "u v w x y z"), (None, "u v w x y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, near_duplicates(docs).collect()), key=str)
    want = [(3, 3, 3, True), (7, 7, 2, False), (7, 7, 2, True), (None, 3, 3, False), (None, 3, 3, False), (None, None, 2, False), (None, None, 2, True)]
    assert got == sorted(want, key=str)
    kept = distinct_documents(docs.withColumn("row", F.lit(1)).withColumn("name", F.lit("n")))
    assert kept.columns == ["doc_id", "text", "row", "name"] and sorted(map(str, kept.collect())) == sorted(
        str(r) for r in docs.where("doc_id IS NOT NULL").distinct().unionByName(docs.where("text LIKE 'u%'").distinct()).withColumn("row", F.lit(1)).withColumn("name", F.lit("n")).collect()
    )
