"""Personal data, with DataFrame functions only: patterns propose spans, checksums confirm, context words adjust scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters before a proposal in which context words count.
CONTEXT = 40
#: Proposals of the kinds beyond the base ones need this score.
LEAST_SCORE = 0.6

# A pattern's leading class is not entered in the middle, except right after a match (\G), and runs are possessive: the
# matches are those of the plain patterns, in time linear in the text.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){11,}+"  # a maximal run of fewer digits can't be valid, nor can its tails
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}+|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"
NATIONAL = r"(?<![0-9+(-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])"
SECRET = r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{20,}+"


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _numbers(s: Column) -> Column:
    return F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.ascii(c) - 48)


def luhn(s: Column) -> Column:
    """Whether the digits of s pass: every second one from the right counts double, less nine if over nine."""
    d = _numbers(F.reverse(digits(s)))
    total = F.aggregate(
        F.transform(d, lambda x, i: F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x)), F.lit(0), lambda a, x: a + x
    )
    return total % 10 == 0


def mod97(s: Column) -> Column:
    """Whether an IBAN's characters, the first four moved to the end, letters as 10 to 35, leave 1."""
    plain = F.regexp_replace(s, " ", "")
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    values = F.transform(F.filter(F.split(turned, ""), lambda c: c != ""), F.ascii)
    rest = F.aggregate(values, F.lit(0), lambda r, c: F.when(c < 65, (r * 10 + c - 48) % 97).otherwise((r * 100 + c - 55) % 97))
    return rest == 1


def _ip(s: Column) -> Column:
    return F.forall(F.split(s, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def _size(s: Column, low: int, high: int) -> Column:
    return F.length(digits(s)).between(low, high)


@dataclass(frozen=True)
class Kind:
    """needs: what any text with a match contains. valid: of the match's text. score, plus hint near context words."""

    name: str
    pattern: str
    needs: str
    valid: object = None
    score: float = 1.0
    words: str = ""
    hint: float = 0.0


BASE = (
    Kind("email", EMAIL, "@"),
    Kind("ip", IP, ".", _ip),
    Kind("card", CARD, "", lambda s: F.when(_size(s, 12, 19), luhn(s)).otherwise(False)),
    Kind("phone", PHONE, "+", lambda s: _size(s, 9, 15)),
)
ADDED = (
    Kind("iban", IBAN, "", mod97, 0.8, "iban|account|konto|compte|cuenta|bank", 0.2),
    Kind("ssn", SSN, "-", None, 0.3, "ssn|social security", 0.4),
    Kind("national_phone", NATIONAL, "", None, 0.3, "phone|tel|call|mobile|cell|fax|contact", 0.4),
    Kind("secret", SECRET, "", lambda s: s.rlike("[0-9]") & s.rlike("[A-Za-z]"), 0.3, "token|secret|passw|api.?key|access.?key|credential", 0.4),
)


def _matches(text: Column, kind: Kind) -> Column:
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    return F.when(F.contains(text, F.lit(kind.needs)), found).otherwise(F.array().cast("array<string>")) if kind.needs else found


def let(value: Column, use) -> Column:
    """use(value), with the value computed once, however often a lambda inside uses it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, combine) -> Column:
    """The values combined from the first one to each. Runs of the square root's length are combined, then their ends:
    appending to an array copies it, so one run over n values would take n * n steps."""

    def one(run: Column) -> Column:
        start = F.slice(run, 1, 1)
        return F.aggregate(F.slice(run, 2, F.greatest(F.size(run), F.lit(1))), start, lambda acc, v: F.array_append(acc, combine(F.element_at(acc, -1), v)))

    def runs(v: Column) -> Column:
        step = F.ceil(F.sqrt(F.size(v))).cast("int")
        return F.transform(F.sequence(F.lit(0), F.size(v) - 1, step), lambda i: one(F.slice(v, i + 1, step)))

    def joined(inner: Column) -> Column:
        ends = one(F.transform(inner, lambda x: F.element_at(x, -1)))
        return let(ends, lambda before: F.flatten(F.transform(inner, lambda x, i: F.when(i == 0, x).otherwise(F.transform(x, lambda v: combine(F.get(before, i - 1), v))))))

    return let(values, lambda v: let(runs(v), joined))


def _places(text: Column, pattern: str, found: Column) -> Column:
    """array<struct<start, end, text, before>> in code points: what splitting leaves between the matches tells where they are.

    before: at most CONTEXT characters before the match, of the text since the last match but one.
    """
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    empty = F.array().cast("array<struct<start:int,end:int,text:string,before:string>>")

    def last(x: Column) -> Column:
        return F.coalesce(F.substring(x, -CONTEXT, CONTEXT), F.lit(""))

    def spans(gap: Column) -> Column:
        ends = running(F.zip_with(gap, found, lambda g, m: F.length(g) + F.length(m)), lambda a, b: a + b)
        before = F.transform(gap, lambda g, i: last(F.concat(last(F.get(gap, i - 1)), last(F.get(found, i - 1)), last(g))))
        return F.transform(
            F.arrays_zip(ends.alias("end"), found.alias("text"), before.alias("before")),
            lambda x: F.struct((x["end"] - F.length(x["text"])).alias("start"), x["end"].alias("end"), x["text"].alias("text"), x["before"].alias("before")),
        )

    return F.when(F.size(found) > 0, let(gaps, spans)).otherwise(empty)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, carry: list[str] | None = None) -> DataFrame:
    """One row a document: doc_id, base and spans (arrays of struct start, rank, end, kind, text, score, by start).

    Null and empty texts have no spans; a null doc_id and repeated rows stay; an empty table gives none. Each row
    depends on its own text alone. keep_text adds the text, carry a struct of other columns, named carried.
    """
    kept = [*["text"] * keep_text, *["carried"] * bool(carry)]
    df = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
        *[F.struct(*[F.col(f"`{c}`") for c in carry or []]).alias("carried")] * bool(carry),
    )
    own = ["doc_id", "text", *["carried"] * bool(carry)]
    kinds = [*BASE, *ADDED]
    df = df.select(*own, *[_matches(F.col("text"), k).alias(f"m{i}") for i, k in enumerate(kinds)])
    df = df.select(*own, *[_places(F.col("text"), k.pattern, F.col(f"m{i}")).alias(f"p{i}") for i, k in enumerate(kinds)])

    def checked(i: int, kind: Kind) -> Column:
        spans = F.col(f"p{i}")
        if kind.valid is not None:
            spans = F.filter(spans, lambda s: kind.valid(s["text"]))

        def scored(s: Column) -> Column:
            score = F.lit(kind.score)
            if kind.words:
                score = score + F.when(F.lower(s["before"]).rlike(f"(?<![a-z])(?:{kind.words})"), kind.hint).otherwise(0.0)
            return F.struct(s["start"].alias("start"), F.lit(i).alias("rank"), s["end"].alias("end"), F.lit(kind.name).alias("kind"), s["text"].alias("text"), score.alias("score"))

        return F.transform(spans, scored)

    df = df.select(*own, F.sort_array(F.concat(*[checked(i, k) for i, k in enumerate(BASE)])).alias("base"), F.concat(*[checked(i + len(BASE), k) for i, k in enumerate(ADDED)]).alias("more"))
    df = df.withColumn("more", F.filter("more", lambda s: s["score"] >= LEAST_SCORE))
    fresh = F.when(F.size("base") > 0, _apart(F.col("more"), F.col("base"))).otherwise(F.col("more"))
    df = df.withColumn("spans", F.when(F.size("more") > 0, F.sort_array(F.concat("base", fresh))).otherwise(F.col("base")))
    return df.select("doc_id", *kept, "base", "spans")


def _apart(more: Column, base: Column) -> Column:
    """Those of more that overlap none of base, which is ascending: found by halving, n log n."""

    def free(reach: Column, base: Column) -> Column:
        def overlaps(s: Column) -> Column:
            def halve(acc: Column, _: Column) -> Column:
                mid = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
                left = F.get(base, mid)["start"] < s["end"]
                new = F.struct(F.when(left, mid + 1).otherwise(acc["low"]).alias("low"), F.when(left, acc["high"]).otherwise(mid).alias("high"))
                return F.when(acc["low"] < acc["high"], new).otherwise(acc)

            whole = F.struct(F.lit(0).alias("low"), F.size(base).alias("high"))
            steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(base) + 1)).cast("int"))
            before = F.aggregate(steps, whole, halve, lambda acc: acc["low"])  # so many begin before s ends
            return let(before, lambda n: (n > 0) & (F.get(reach, n - 1) > s["start"]))

        return F.filter(more, lambda s: ~overlaps(s))

    return let(base, lambda b: let(running(F.transform(b, lambda x: x["end"]), F.greatest), lambda reach: free(reach, b)))


def joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(docs: DataFrame) -> DataFrame:
    def count(name: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")

    n = [count(k.name) for k in BASE]
    return find_pii(docs).select("doc_id", *n, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping spans, replaced by the first one's kind in brackets."""

    def whole(chars: Column, spans: Column, reach: Column) -> Column:
        def part(s: Column, i: Column) -> Column:
            at = F.when(i == 0, F.lit(0)).otherwise(F.get(reach, i - 1))
            gap = F.array_join(F.slice(chars, at + 1, F.greatest(s["start"] - at, F.lit(0))), "")
            return F.when(s["start"] >= at, F.concat(gap, F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(F.lit(""))

        rest = F.slice(chars, F.element_at(reach, -1) + 1, F.size(chars))
        return F.concat(F.array_join(F.transform(spans, part), ""), F.array_join(rest, ""))

    ends = running(F.transform(spans, lambda s: s["end"]), F.greatest)
    return F.when(F.size(spans) > 0, let(spans, lambda s: let(F.split(text, ""), lambda c: let(ends, lambda r: whole(c, s, r))))).otherwise(text)
