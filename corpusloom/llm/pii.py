"""Personal data: patterns propose, checksums confirm, nearby words weigh. DataFrame functions only.

Everything is linear in a text and its matches: places come from running sums over blocks of matches, and words near a
match are read from the text cut into pieces of fixed length, never by counting from the text's start.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import read_table

#: Fixed by the contract: kinds in their order. The look-behinds and possessive quantifiers leave the language
#: and the leftmost matches as they are and keep a scan linear in runs of thousands of letters or digits.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Fixed by ISO 13616: the length of an IBAN, by country.
IBAN_LENGTHS = {
    15: "NO",
    16: "BE",
    18: "DK FI FK FO GL NL SD",
    19: "MK SI",
    20: "AT BA EE KZ LT LU MN XK",
    21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST",
    26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA",
    30: "JO KW MU YE",
    31: "MT SC",
    32: "LC",
    33: "RU",
}
#: Added by this operator. A country's own length ends an IBAN, so the word behind it is never taken along.
IBAN = (
    r"\b(?:"
    + "|".join(rf"(?:{'|'.join(c.split())})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())
    + r")\b"
)
NATIONAL_ID = r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"
#: Code points on either side in which words weigh; what they add and take, in hundredths; the least score of an added kind.
CONTEXT_CHARS, FOR, AGAINST, ACCEPT = 40, 25, 20, 70
#: Words near a match that speak of a number of another sort.
OTHER_NUMBERS = r"(?i)\b(order|invoice|serial|model|version|part|tracking)\b"
#: Matches of a block whose running sums are made at once, and code points of a piece of text.
RUN, PIECE = 256, 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is named inside."""
    return F.element_at(F.transform(F.array(value), body), 1)


def plus(a: Column, b: Column) -> Column:
    return a + b


def running(values: Column, step: Callable[[Column, Column], Column] = plus, levels: int = 3) -> Column:
    """Running sums of an array of numbers from 0 on, or running maxima: within blocks, behind the blocks before, level by level."""
    zero = F.lit(0).cast("long")

    def plain(block: Column) -> Column:
        start = F.struct(zero.alias("last"), F.array().cast("array<bigint>").alias("out"))

        def add(acc: Column, x: Column) -> Column:
            return let(step(acc["last"], x), lambda y: F.struct(y.alias("last"), F.array_append(acc["out"], y).alias("out")))

        return F.aggregate(block, start, add, lambda acc: acc["out"])

    if levels == 1:
        return plain(values)

    def joined(blocks: Column) -> Column:
        ends = running(F.transform(blocks, lambda b: F.element_at(b, -1)), step, levels - 1)
        before = F.slice(F.concat(F.array(zero), ends), F.lit(1), F.size(blocks))
        return F.flatten(F.zip_with(blocks, before, lambda b, at: F.transform(b, lambda x: step(at, x))))

    def blocked(values: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(values), F.lit(RUN))
        return let(F.transform(starts, lambda at: plain(F.slice(values, at, F.lit(RUN)))), joined)

    return let(values.cast("array<bigint>"), lambda v: F.when(F.size(v) > RUN, blocked(v)).otherwise(plain(v)))


def text_pieces(text: Column) -> Column:
    """The text cut after every ``PIECE`` code points."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))


def cut(pieces: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` to ``end`` (exclusive) of a text in pieces."""
    first = F.floor(start / PIECE).cast("int")
    count = F.greatest(F.floor((end - 1) / PIECE).cast("int") - first + 1, F.lit(0))
    return F.substring(F.array_join(F.slice(pieces, first + 1, count), ""), start - first * PIECE + 1, F.greatest(end - start, F.lit(0)))


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(match: Column) -> Column:
    """12 to 19 digits whose Luhn sum is a multiple of ten."""
    doubled = lambda d: d * 2 - F.when(d > 4, 9).otherwise(0)

    def valid(number: Column) -> Column:
        at = lambda i: F.substring(number, i, F.lit(1)).cast("int")
        step = lambda acc, i: acc + F.when(i % 2 == 0, doubled(at(i))).otherwise(at(i))
        total = F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), step)
        return F.when(F.length(number).between(12, 19), total % 10 == 0).otherwise(F.lit(False))

    return let(F.reverse(digits(match)), valid)


def mod97(match: Column) -> Column:
    """The remainder of a rearranged IBAN: letters count as 10 to 35, four leading characters move to the end."""
    plain = F.replace(match, F.lit(" "))
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))
    step = lambda acc, c: F.when(c.rlike("[0-9]"), (acc * 10 + c.try_cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(turned, "(?!^)(?!$)"), F.lit(0), step) == 1


def octets(match: Column) -> Column:
    part = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(p.try_cast("long"), F.lit(999)) <= 255)
    return F.forall(F.split(match, r"\."), part)


@dataclass(frozen=True)
class Kind:
    """``hint`` is cheap to look for and part of every match; ``score`` is in hundredths."""

    name: str
    pattern: str
    hint: str
    confirmed: Callable[[Column], Column]
    score: int
    words: str
    base: bool


KINDS = (
    Kind("email", EMAIL, "@", lambda m: F.lit(True), 90, r"(?i)\b(e-?mail|contact|address)\b", True),
    Kind("ip", IP, r"\.[0-9]", octets, 80, r"(?i)\b(ip|host|server)\b", True),
    Kind("card", CARD, "[0-9]", luhn, 80, r"(?i)\b(card|visa|credit|payment)\b", True),
    Kind("phone", PHONE, r"\+[0-9]", lambda m: F.length(digits(m)).between(9, 15), 80, r"(?i)\b(phone|tel|call|mobile)\b", True),
    Kind("iban", IBAN, r"[A-Z]{2}[0-9]{2}", mod97, 80, r"(?i)\b(iban|account|bank|konto)\b", False),
    Kind("national_id", NATIONAL_ID, r"[0-9]-[0-9]", lambda m: ~m.startswith("000") & ~m.startswith("9"), 50, r"(?i)\b(ssn|social|security|identity)\b", False),
)

SPAN = "struct<start:int,rank:int,kind:string,end:int,score:int>"


def _found(kind: Kind, rank: int, text: Column, pieces: Column) -> Column:
    """Spans of one kind: what lies between the matches gives their places, in code points."""

    def confirmed(matches: Column) -> Column:
        gaps = F.slice(F.split(text, kind.pattern, -1), F.lit(1), F.size(matches))
        sizes = F.zip_with(gaps, matches, lambda gap, m: F.length(gap) + F.length(m))
        span = lambda end, m: F.when(kind.confirmed(m), F.struct((end - F.length(m)).cast("int").alias("start"), end.cast("int").alias("end")))
        return F.array_compact(F.zip_with(running(sizes), matches, span))

    def scored(x: Column) -> Column:
        before = cut(pieces, F.greatest(x["start"] - CONTEXT_CHARS, F.lit(0)), x["start"])
        after = cut(pieces, x["end"], x["end"] + CONTEXT_CHARS)
        near = lambda words: before.rlike(words) | after.rlike(words)
        score = F.lit(kind.score) + F.when(near(kind.words), FOR).otherwise(0) - F.when(near(OTHER_NUMBERS), AGAINST).otherwise(0)
        return F.struct(
            x["start"].alias("start"),
            F.lit(rank).alias("rank"),
            F.lit(kind.name).alias("kind"),
            x["end"].alias("end"),
            F.least(score, F.lit(100)).cast("int").alias("score"),
        )

    spans = F.transform(let(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), confirmed), scored)
    if not kind.base:
        spans = F.filter(spans, lambda x: x["score"] >= ACCEPT)
    return F.when(text.rlike(kind.hint), spans.cast(f"array<{SPAN}>")).otherwise(F.array().cast(f"array<{SPAN}>"))


def pii_spans(docs: DataFrame, into: str = "spans") -> DataFrame:
    """Adds ``into``: an array of ``start, rank, kind, end, score`` by start, then kind; ends are exclusive.

    Scores are hundredths: a kind's own, more by ``FOR`` if its words stand within ``CONTEXT_CHARS`` on either side, less
    by ``AGAINST`` if words of other numbers do. Base kinds (email, ip, card, phone) are taken whenever their check passes,
    whatever their score; added kinds (iban, national_id) need ``ACCEPT``. Spans of different kinds may overlap. A
    null or empty text has no span; repeated rows have equal ones; an empty table gives no row. A column
    named ``into`` is replaced, others are kept.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    found = lambda pieces: F.array_sort(F.concat(*[_found(kind, rank, text, pieces) for rank, kind in enumerate(KINDS)]))
    proposed = F.when(text.rlike("[0-9@]"), let(text_pieces(text), found)).otherwise(F.array().cast(f"array<{SPAN}>"))
    return docs.withColumn(into, proposed)


def redacted(text: Column, spans: Column) -> Column:
    """The text with each run of overlapping spans replaced by the upper-case kind of its first span in brackets."""

    def replaced(pieces: Column, reach: Column) -> Column:
        # a span that starts behind the reach of all before it begins a run; the others only carry its reach further
        part = lambda x, at: F.when(
            x["start"] >= at, F.concat(cut(pieces, at, x["start"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))
        ).otherwise("")
        parts = F.zip_with(spans, F.slice(reach, F.lit(1), F.size(spans)), part)
        return F.concat(F.array_join(parts, ""), cut(pieces, F.element_at(reach, -1), F.length(text)))

    ends = running(F.transform(spans, lambda x: x["end"]), F.greatest)
    reach = F.concat(F.array(F.lit(0).cast("long")), ends)
    return let(text_pieces(text), lambda pieces: let(reach, lambda r: replaced(pieces, r)))


def without_personal_data(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by its kind, and ``n_chars``, if there, counted anew.

    Every row stays, repeated ones too; a null text stays null, an empty one empty; all other columns come back
    as they were, whatever their names; an empty table gives no row.
    """
    spans = "_pii_spans"
    found = pii_spans(docs, spans)
    clean = found.withColumn("text", F.when(F.size(spans) > 0, redacted(F.col("text"), F.col(spans))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast("long"))
    return clean.select(*[F.col(f"`{c}`") for c in docs.columns])


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and ``scores``: those of ``spans`` in hundredths, in the same order."""
    found = pii_spans(read_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans")
    base = F.filter("spans", lambda x: x["rank"] < sum(k.base for k in KINDS))
    count = lambda rank: F.size(F.filter("spans", lambda x: x["rank"] == rank)).cast("long")
    counts = [count(i).alias(f"n_{k.name}") for i, k in enumerate(KINDS) if k.base]
    scores = F.array_join(F.transform("spans", lambda x: x["score"].cast("string")), ",")
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), scores.alias("scores"))
