import random
from collections import Counter

from brindle.llm.decontaminate import Items, clean_documents, decontaminate
from pyspark.sql import functions as F


def bag(words):
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(text, items):
    words = text.lower().split()
    found = {}
    for item, t in items:
        w = t.lower().split()
        if len(w) < 5 or not (bag(words) & bag(w)):
            continue
        for i in range(max(1, len(words) - len(w) + 1)):
            own = bag(words[i : i + len(w)])
            both = (own & bag(w)).total()
            value = both / max(1, own.total() + bag(w).total() - both)
            if value >= 0.8 and value > found.get(item, 0):
                found[item] = value
    return found


def test_equals_brute_force(spark, sf_dir, documents):
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    want = {r.doc_id: brute(r.text, items) for r in documents.select("doc_id", "text").collect()}
    got = decontaminate(documents, benchmark).collect()
    assert {r.doc_id: r.item_ids for r in got} == {d: sorted(f) for d, f in want.items()}
    assert all(r.contaminated == bool(want[r.doc_id]) and abs(r.similarity - max(want[r.doc_id].values(), default=0)) < 1e-9 for r in got)
    assert any(want.values())
    blocks = decontaminate(documents, benchmark, at_once=9).collect()
    assert sorted(map(str, blocks)) == sorted(map(str, got))


def test_edges(spark, odd_docs, no_docs):
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty " * 3
    items = spark.createDataFrame([(1, text), (1, text), (2, "too short"), (None, text), (3, None), (4, "the same text in two rows of one id")], "item_id long, text string")
    near = spark.createDataFrame([(10, "Before it. " + text.upper().replace("TWENTY ONE", "TWENTY 1", 1) + " after"), (11, text[:60]), (12, "too short")], "doc_id long, text string")
    got = {r.doc_id: r for r in decontaminate(near, items).collect()}
    assert got[10].item_ids == [1] and 0.8 <= got[10].similarity < 1 and not got[11].contaminated and got[12].item_ids == [2] and got[12].similarity == 1
    rows = decontaminate(odd_docs, items).collect()
    assert len(rows) == odd_docs.count() and sorted(r.doc_id for r in rows if r.contaminated) == [4, 4, 5]
    assert decontaminate(no_docs, items).collect() == [] and not any(r.contaminated for r in decontaminate(odd_docs, items.limit(0)).collect())


def test_rows_keep_their_columns(spark, odd_docs):
    items = spark.createDataFrame([(4, "the same text in two rows of one id")], "item_id long, text string")
    docs = odd_docs.withColumn("found", F.lit(3)).withColumn("rest", F.lit("x"))
    got = clean_documents(docs, items)
    assert got.columns == docs.columns and sorted(map(str, got.collect())) == sorted(str(r) for r in docs.collect() if r.doc_id not in (4, 5))


def test_edited_items_are_found():
    """Of windows that are just similar enough, all but a few in a thousand have fingerprints within the radius."""
    r, want, got = random.Random(6), 0, 0
    items = [(i, " ".join(f"w{r.randrange(10**6)}" for _ in range(r.randint(25, 120)))) for i in range(400)]
    index = Items(items)
    for i, text in items:
        words, whole = text.split(), bag(text.split())
        while True:
            edited = list(words)
            edited[r.randrange(len(words))] = f"e{r.random()}"
            both = (bag(edited) & whole).total()
            if both < 0.8 * (2 * whole.total() - both):
                break
            words = edited
        want += 1
        got += i in index.search(" ".join(["before"] * 9 + words + ["after"] * 9), 0.8)
    assert got >= 0.995 * want
