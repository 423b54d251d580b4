import random
import re

from brindle.llm import licenses as lic


def brute(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    at, labels = [], set()
    for label, phrase in lic.PHRASES.items():
        p = phrase.split()
        here = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        at += here
        labels |= {label} if here else set()
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


CASES = [
    "Licensed under the Apache License, Version 2.0.",
    "This work is licensed under the GNU General Public License, version 3. All rights reserved. CC-BY cc by",
    "Released under the MIT License.",
    "Licensed under CC BY-NC 4.0.",
    "licensed under the sea, version of a story",
    "Permission is hereby granted, free of charge, to any person obtaining one copy of this software and associated documentation files",
    "all rights all rights reserved reserved",
]


def test_base_equals_brute_force(spark, documents, odd_docs):
    for df in (documents, odd_docs, spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string")):
        want = sorted((str(r[0]), *map(str, brute(r[1] or ""))) for r in df.select("doc_id", "text").collect())
        got = lic.scan_licenses(df).collect()
        assert sorted(tuple(map(str, r[:6])) for r in got) == want
        assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)


def test_labels_by_voting(spark, no_docs):
    df = spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string")
    labels = [r.labels for r in lic.scan_licenses(df).orderBy("doc_id").collect()]
    assert labels == ["apache", "cc-by,gpl,reserved", "mit", "cc-by,cc-by-nc", "", "mit", "reserved"]
    assert lic.scan_licenses(no_docs).collect() == []


def votes(text, templates):
    """Labels and score by trying all places."""
    words, best, labels = re.findall("[a-z0-9]+", text), 0.0, set()
    for label, t in templates:
        t = t.split()
        hits = {(i - p, p) for i in range(len(words) - 2) for p in range(len(t) - 2) if words[i : i + 3] == t[p : p + 3]}
        for first in {d for d, _ in hits}:
            covered = {p + n for d, p in hits if first <= d <= first + lic.NEAR for n in range(3)}
            best = max(best, len(covered) / len(t))
            labels |= {label} if len(covered) / len(t) >= lic.COVER else set()
    return labels, best


def test_votes_equal_brute_force(spark):
    r = random.Random(4)
    templates = [("x", "a b c d e f g h i j"), ("y", "a b c a b c a b"), ("z", "d e f d e f")]
    texts = [" ".join(r.choice("a b c d e f g h i j other".split()) for _ in range(r.randint(0, 30))) for _ in range(60)]
    for _ in range(120):
        words = [w for _ in range(r.randint(1, 3)) for w in r.choice(templates)[1].split() + ["other"] * r.randint(0, 4)]
        for _ in range(r.randint(0, 3)):
            at = r.randrange(len(words))
            words[at : at + r.randint(0, 1)] = ["new"] * r.randint(0, 1)
        texts.append(" ".join(words))
    texts += texts[:20]
    got = lic.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), templates=templates).collect()
    want = {i: votes(t, templates) for i, t in enumerate(texts)}
    assert {r.doc_id: (set(filter(None, r.labels.split(","))), round(r.score, 9)) for r in got} == {i: (a, round(b, 9)) for i, (a, b) in want.items()}
