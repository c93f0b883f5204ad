"""Column functions on text: tokens, normal forms, hashes, signals, licences, splits, truncation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lexical tokens, pinned hashes, permissive licences, benchmark paths.
TOKEN = r"[A-Za-z_][A-Za-z0-9_]*|\d+|[^\s]"
HEX64, HEX40 = r"^[0-9a-f]{64}$", r"^[0-9a-f]{40}$"
BENCHMARK_PATH = r"(?i)(?:^|[-_/])(?:eval|evaluation|[a-z0-9]*bench(?:marks?)?|tests?)(?:$|[-_/])"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def token_count(text: Column) -> Column:
    return F.size(tokens(text)).cast("long")


def squeeze(text: Column) -> Column:
    """Words joined by one space."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def ascii_json(json: Column) -> Column:
    """JSON with every character outside printed ASCII as the escapes of its UTF-16 units, and all escapes in lower case."""
    tokens = F.regexp_extract_all(json, F.lit(r"(?s)\\(?:u[0-9A-Fa-f]{4}|.)|[^\x00-\x7e]|[\x00-\x5b\x5d-\x7e]+"), F.lit(0))
    units = lambda c: F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), "(.{4})", r"\\u$1")
    escaped = F.transform(tokens, lambda t: F.when(t.rlike(r"^[^\x00-\x7e]"), units(t)).when(t.rlike(r"^\\u"), F.lower(t)).otherwise(t))
    return F.when(json.rlike(r"[^\x00-\x7e]|\\u"), F.array_join(escaped, "")).otherwise(json)


def canonical_digest(**fields: Column) -> Column:
    """SHA-256 of the compact ASCII JSON of the fields in alphabetical order, nulls kept."""
    ordered = F.struct(*[fields[k].alias(k) for k in sorted(fields)])
    return F.sha2(ascii_json(F.to_json(ordered, {"ignoreNullFields": "false"})), 256)


def contains_any(text: Column, signals: Sequence[str], fold: bool = False) -> Column:
    where = F.lower(text) if fold else text
    found = F.lit(False)
    for s in signals:
        found = found | where.contains(s.lower() if fold else s)
    return found


def signals_present(text: Column, signals: Sequence[str]) -> Column:
    """The signals that occur in the text, sorted."""
    return F.array_sort(F.filter(F.array(*map(F.lit, signals)), lambda s: F.contains(text, s)))


def reasons(*rules: tuple[str, Column]) -> Column:
    """The codes of all rules that hold, distinct and sorted; a rule that is null doesn't hold."""
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(rule, F.lit(code)) for code, rule in rules]))))


def first_reason(*rules: tuple[str, Column]) -> Column:
    """The code of the first rule that holds, else null."""
    found = F.lit(None).cast("string")
    for code, rule in reversed(rules):
        found = F.when(rule, F.lit(code)).otherwise(found)
    return found


def licence_of_tags(tags: Column) -> Column:
    """The one licence that the tags name; ``unverified`` without any, ``multiple:...`` with several."""
    named = F.array_sort(F.array_distinct(F.transform(F.filter(tags, lambda t: t.startswith("license:")), lambda t: F.substring(t, 9, 1000))))
    return F.when(F.size(named) == 1, F.element_at(named, 1)).when(F.size(named) == 0, F.lit("unverified")).otherwise(F.concat(F.lit("multiple:"), F.array_join(named, ",")))


def licence_conflict(licence: Column, card: Column) -> Column:
    """Whether a card names another licence than the tags do."""
    return card.isNotNull() & (licence != "unverified") & (F.lower(card) != F.lower(licence))


def merged_licence(licence: Column, card: Column) -> Column:
    return F.when((licence == "unverified") & card.isNotNull(), F.lower(card)).otherwise(licence)


def licences_allowed(observed: Column, allowed: Sequence[str]) -> Column:
    """Whether every observed licence is allowed, whatever the case; none observed is not."""
    folded = F.transform(observed, lambda x: F.lower(x))
    return F.coalesce(F.size(observed) > 0, F.lit(False)) & (F.size(F.array_except(folded, F.array(*[F.lit(a.lower()) for a in allowed]))) == 0)


def hash_fraction(key: Column) -> Column:
    """The first 32 bits of the key's SHA-256 as a fraction of the largest value."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)


def hash_split(key: Column, validation: float) -> Column:
    return F.when(hash_fraction(key) < validation, F.lit("validation")).otherwise(F.lit("train"))


def quarter_tokens(text: Column) -> Column:
    """A token per four characters: at least one, none for an empty text."""
    return F.when(F.length(text) == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(F.length(text) / 4))).cast("long")


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))).cast("long")


def head(text: Column, chars: int, marker: str = "\n...[truncated]") -> Column:
    return F.when(F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit(marker))).otherwise(text)


def tail(text: Column, chars: int) -> Column:
    return F.when(F.length(text) > chars, F.right(text, F.lit(chars))).otherwise(text)


def slug(text: Column, chars: int = 60) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, chars)


def join_hyphens(text: Column) -> Column:
    """Words that a line break split are put together; other white space becomes one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"([a-z])-\n([a-z])", "$1$2"), r"\s+", " "))


#: What diagnostics must not show.
PATHS = r"(?<![\w.])/(?:[^\s:'\"]+/)+[^\s:'\"]*"
ASSIGNMENTS = r"(?i)\b(api[_-]?key|authorization|bearer|credential|password|secret|token)\b\s*[:=]\s*[^\s,;]+"
HIDDEN_NAMES = r"(?i)\b(hidden[\w.-]*|tests?|solutions?|references?)\b"
NO_DIAGNOSTIC = "No diagnostic text was produced."


def sanitize_diagnostic(text: Column, limit: int = 4000) -> Column:
    """Compiler output without paths, secrets and hidden names; lines lose their trailing space."""
    clean = F.replace(F.coalesce(text, F.lit("")), F.lit("\x00"), F.lit(""))
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(clean, PATHS, "<path>"), ASSIGNMENTS, "$1=<redacted>"), HIDDEN_NAMES, "<hidden>")
    clean = F.regexp_replace(F.regexp_replace(clean, r"[ \t\r]+(?=\n|$)", ""), r"^\s+|\s+$", "")
    return F.when(clean == "", F.lit(NO_DIAGNOSTIC)).otherwise(F.substring(clean, 1, limit))


def fenced_blocks(text: Column, language: str = "(?:python|py)?") -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?s)```{language}\n(.*?)```"), F.lit(1))


def single_action(text: Column) -> Column:
    """The one fenced command of a reply; null unless there is exactly one."""
    found = F.regexp_extract_all(text, F.lit(r"(?s)```[a-z]*\n(.*?)\n?```"), F.lit(1))
    return F.when(F.size(found) == 1, F.element_at(found, 1))


def marker_counts(text: Column, markers: Sequence[str]) -> list[Column]:
    return [F.regexp_count(F.lower(text), F.lit(m)).cast("long").alias(f"n_{m}") for m in markers]


def call_name(text: Column) -> Column:
    """The function of an action such as ``click(x=1, y=2)``."""
    return F.nullif(F.regexp_extract(text, r"([A-Za-z_]\w*)\(", 1), F.lit(""))


def call_arguments(text: Column) -> Column:
    """Its arguments by name; values are quoted or bare."""
    names = F.regexp_extract_all(text, F.lit(r"(\w+)\s*=\s*(?:\"([^\"]*)\"|([^\s,()]+))"), F.lit(1))
    quoted = F.regexp_extract_all(text, F.lit(r"(\w+)\s*=\s*(?:\"([^\"]*)\"|([^\s,()]+))"), F.lit(2))
    bare = F.regexp_extract_all(text, F.lit(r"(\w+)\s*=\s*(?:\"([^\"]*)\"|([^\s,()]+))"), F.lit(3))
    return F.map_from_arrays(names, F.zip_with(quoted, bare, lambda q, b: F.when(q != "", q).otherwise(b)))
