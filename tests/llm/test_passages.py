import random

import pyarrow as pa

from brindle.llm import passages
from brindle.llm.common import WordHasher
from brindle.llm.passages import repeated_passages


def words(r, n):
    return ["".join(r.choices("abcdefghij", k=r.randint(2, 9))) for _ in range(n)]


def test_planted_passages_are_found_and_clean_texts_left(spark):
    r = random.Random(4)
    passage, second = words(r, 70), words(r, 90)
    rows, want = [], {}
    for i in range(60):
        own = words(r, r.randint(60, 300))
        if i % 4 == 0:
            at = r.randint(0, len(own))
            own[at:at] = passage
            want[i] = (at, at + 70)
        elif i % 4 == 1:
            at, copy = r.randint(0, len(own)), list(second)
            copy[45] = f"edit{i}"
            own[at:at] = copy
            want[i] = (at, at + 90)
        rows.append((i, r.choice([" ", "\n"]).join(own)))
    got = {x.doc_id: x for x in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d for d, x in got.items() if x.n_repeated} == set(want)
    assert {d for d, x in got.items() if x.n_removed} >= set(want) - {min(d for d in want if d % 4 == k) for k in (0, 1)}
    for d, (a, b) in want.items():
        for span in filter(None, got[d].removed.split(",")):
            s, e = map(int, span.split(":"))
            assert a - 3 <= s < e <= b + 3  # similar paragraphs begin a little earlier or end later


def test_edges(odd_docs, no_docs):
    got = repeated_passages(odd_docs).collect()
    assert len(got) == 10
    by = {}
    for x in got:
        by.setdefault(x.doc_id, []).append(x)
    assert all(x.n_removed == 0 for d in (None, 1, 2, 3, 6, 8) for x in by[d])
    three = by[4] + by[5]
    assert len({x.n_repeated for x in three}) == 1 and sorted(x.n_removed > 0 for x in three) in ([False] * 3, [False, True, True])
    assert repeated_passages(no_docs).collect() == []


def test_passages_of_fifty_words_are_found_whole(spark):
    r = random.Random(5)
    rows, want = [], {}
    for i in range(150):
        passage = words(r, 50)
        for d in (i, 1000 + i):
            own = words(r, r.randint(60, 120))
            at = r.randint(0, len(own))
            own[at:at] = passage
            rows.append((d, " ".join(own)))
            want[d] = (at, at + 50)
    got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(1).sortWithinPartitions("doc_id")).collect()
    for x in got:
        a, b = want[x.doc_id]
        spans = [tuple(map(int, s.split(":"))) for s in x.removed.split(",") if s]
        assert x.n_repeated > 0
        if x.doc_id < 1000:
            assert spans == []
        else:
            assert len(spans) == 1 and a - 3 <= spans[0][0] <= a and b <= spans[0][1] <= b + 3


def brute(rows):
    """Paragraphs by row, linked when equal or similar, by trying all pairs: rows that hold a class with another row."""
    paras = []
    for row, text in rows:
        w = [x.encode() for x in text.split()]
        at, _, _ = passages.paragraphs(WordHasher()(w))
        paras += [(row, int(p), {tuple(w[i : i + 5]) for i in range(p, p + 21)}) for p in at]
    parent = list(range(len(paras)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, _, a) in enumerate(paras):
        for j in range(i):
            b = paras[j][2]
            if len(a & b) >= 0.8 * len(a | b):
                parent[root(i)] = root(j)
    of = {}
    for i, (row, p, _) in enumerate(paras):
        of.setdefault(root(i), set()).add((row, p))
    found = {}
    for group in of.values():
        if len({r for r, _ in group}) > 1:
            for r, p in group:
                found.setdefault(r, set()).add(p)
    return {r: len(p) for r, p in found.items()}


def test_links_equal_brute_force(spark):
    """Paragraphs that begin a word or two apart, copies with edits, and texts that share some words: with bands that miss
    next to nothing, all classes are those of trying all pairs."""
    r = random.Random(11)
    common = words(r, 120)
    rows = []
    for i in range(60):
        copy = list(common)
        for _ in range(r.randint(0, 6)):
            copy[r.randrange(len(copy))] = f"e{r.random()}"
        at = r.randint(0, 60)
        rows.append((i, " ".join(words(r, r.randint(5, 40)) + copy[at : at + r.randint(30, 60)] + words(r, r.randint(5, 40)))))
    want = brute(rows)
    got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), bands=8, rows=1).collect()
    assert {x.doc_id: x.n_repeated for x in got if x.n_repeated} == want


def test_many_texts_are_hashed_together(monkeypatch):
    """The paragraphs of texts of all lengths are those of one text at a time, but the hashing isn't called for each text."""
    r = random.Random(7)
    texts = [" ".join(r.choices("abcdef", k=n) if n % 3 else words(r, n)) for n in [*range(80), 24, 25, 25, 26, 50, 400, 3000]]
    hashed = [WordHasher()(t.encode().split()) for t in texts]
    want = [(i, *x) for i, h in enumerate(hashed) for x in zip(*(c.tolist() for c in passages.paragraphs(h)), strict=True)]
    # of each run of places the last of the least pairs of words
    for i, h in enumerate(hashed):
        pair = passages.mix(h[:-1] * passages.np.uint64(3) + h[1:], 31).tolist()[: max(0, len(h) - passages.WORDS + 1)]
        width = min(passages.WINDOW, len(pair))
        runs = [range(s, s + width) for s in range(len(pair) - width + 1) if width]
        assert sorted({min(run, key=lambda p: (pair[p], -p)) for run in runs}) == [x[1] for x in want if x[0] == i]
    calls = []
    mix = passages.mix
    monkeypatch.setattr(passages, "mix", lambda *a: calls.append(1) or mix(*a))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["row", "text"])
    got = [x for b in passages._emit(passages.BANDS, passages.ROWS)([batch]) for x in b.to_pylist() if x["h"] is not None]
    assert len(calls) < len(texts)
    first = {name: (i, p) for i, p, name, _ in reversed(want)}
    band = passages.np.arange(passages.BANDS, dtype=passages.np.uint64)
    low = passages.np.uint64((1 << passages.BAND_BITS) - 1)
    bands = {(*first[name], name, h) for i, p, name, joint in want if first[name] == (i, p) for h in (mix(passages.np.array(joint, passages.np.uint64), 50) & ~low | band).tolist()}
    assert len(got) == len(bands) and {(x["row"], x["pos"], x["name"] % 2**64, x["h"] % 2**64) for x in got} == bands
