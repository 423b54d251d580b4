import hashlib
import re
import time

from brindle.llm.pii import digest, find_pii, redacted
from pyspark.sql import functions as F

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text):
    spans = []
    for rank, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True,
                "card": 12 <= len(d) <= 19 and luhn(d),
                "phone": 9 <= len(d) <= 15,
            }[kind]
            if good:
                spans.append((m.start(), rank, m.end(), kind))
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(spans))


TRICKY = [
    "a.b@c.d_e@f.g and x@y@z.com, @no, a@b, 1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.4",
    "4111 1111 1111 1111 and 4111111111111112 5500-0000-0000-0004 12 34 56 78 90 12 34 56 78 90 12",
    "+1 (234) 555-1234 ext, +49 30 1234567890123, ++44 20 7946 0958, +1.2.3.4.5.6.7.8.9",
    "é🎉 a@b.co 日 10.0.0.1\n+1 212 555 0100",
    "1" * 5000 + " " + "a" * 5000 + "@" + "b." * 3000,
    "DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432 or GB82WEST12345698765431",
    "ssn 123-45-6789, call (212) 555-0199, token = \"0123456789abcdef0123456789\" 987-65-4321",
]


def test_base_spans_equal_brute_force(spark, documents, texts, odd_docs):
    for df in (documents, odd_docs, spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string")):
        want = sorted((str(r[0]), hashlib.sha256(brute(r[1] or "").encode()).hexdigest()) for r in df.select("doc_id", "text").collect())
        got = digest(df).collect()
        assert sorted((str(r.doc_id), r.base_sha256) for r in got) == want


def test_added_spans_and_redaction(spark, no_docs):
    df = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string")
    found = find_pii(df, keep_text=True).withColumn("clean", redacted(F.col("text"), F.col("spans"))).orderBy("doc_id").collect()
    kinds = [[(s.kind, s.text) for s in r.spans if s.rank > 3] for r in found]
    assert kinds[5] == [("iban", "DE89 3704 0044 0532 0130 00"), ("iban", "GB82WEST12345698765432")]
    assert [k for k, _ in kinds[6]] == ["ssn", "national_phone", "secret"]
    assert found[6].clean == 'ssn [SSN], call [NATIONAL_PHONE], token = "[SECRET]" 987-65-4321'
    assert found[3].clean == "é🎉 [EMAIL] 日 [IP]\n[PHONE]"
    assert digest(no_docs).collect() == []


def test_long_texts_full_of_matches(spark):
    """A megabyte of matches takes seconds, spans and redaction included."""
    texts = {"email": "a@b.c ", "ip": "10.20.30.40 ", "phone": "+49 30 1234567 ", "ssn": "ssn 123-45-6789, "}
    docs = spark.createDataFrame([(i, t * (1_000_000 // len(t))) for i, t in enumerate(texts.values())], "doc_id long, text string")
    began = time.perf_counter()
    rows = {r.doc_id: r for r in find_pii(docs, keep_text=True).select("doc_id", "spans", redacted(F.col("text"), F.col("spans")).alias("clean")).collect()}
    for i, (kind, t) in enumerate(texts.items()):
        n, at = 1_000_000 // len(t), t.index("1") if kind == "ssn" else 0
        assert [(s.start, s.end, s.kind) for s in rows[i].spans] == [(at + k * len(t), (k + 1) * len(t) - len(t[at:]) + len(t[at:].rstrip(" ,")), kind) for k in range(n)]
        assert rows[i].clean == (t[:at] + f"[{kind.upper()}]" + t[at + len(t[at:].rstrip(" ,")) :]) * n
    assert time.perf_counter() - began < 60


def test_added_spans_keep_clear_of_base_ones(spark):
    text = "card 4111 1111 1111 1111 tel 555-123-4567 mail password-a1b2c3d4e5f6g7h8i9j0@example.org token a1b2c3d4e5f6g7h8i9j0k1 😀 ssn 123-45-6789"
    r = find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    assert [(s.kind, text[s.start : s.end]) for s in r.spans] == [
        ("card", "4111 1111 1111 1111"), ("national_phone", "555-123-4567"), ("email", "password-a1b2c3d4e5f6g7h8i9j0@example.org"), ("secret", "a1b2c3d4e5f6g7h8i9j0k1"), ("ssn", "123-45-6789"),
    ]
