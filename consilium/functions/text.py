"""String functions: normalisation, vote keys, spellings, seeds and lexical claims."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Marks that are dropped, and ASCII symbols that separate words as punctuation does.
APOSTROPHES = "'’‘ʻʼʹ`´"
SYMBOLS = "+$<=>|~^"
# Spellings that one vote key stands for.
SYNONYMS = {
    "nyse": "new york stock exchange",
    "lse": "london stock exchange",
    "nasdaq": "nasdaq",
    "usa": "united states",
    "us": "united states",
    "u s a": "united states",
    "uk": "united kingdom",
    "u k": "united kingdom",
    "uae": "united arab emirates",
    "prc": "china",
}
# Words that initials leave out.
STOPWORDS = ("a", "an", "and", "at", "for", "in", "of", "on", "the", "to")

_DROP = dict.fromkeys(map(ord, APOSTROPHES))


class _Folding(dict):
    """What each code point becomes after NFKD and case folding; filled as code points turn up."""

    def __missing__(self, point: int) -> str | None:
        char = chr(point)
        if char in APOSTROPHES or unicodedata.combining(char):
            out = None
        elif char in SYMBOLS or unicodedata.category(char)[0] == "P":
            out = " "
        else:
            out = char
        self[point] = out
        return out


_FOLDING = _Folding()


def normalized(value: str) -> str:
    """One string's normal form: folded case, no marks, words with single spaces between."""
    folded = unicodedata.normalize("NFKD", value.strip().translate(_DROP)).casefold()
    return " ".join(folded.translate(_FOLDING).split())


@F.arrow_udf(StringType())
def normalize(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Column of normal forms (null stays null); Unicode decomposition and case folding are not built in."""
    for batch in batches:
        yield pa.array([None if v is None else normalized(v) for v in batch.to_pylist()], pa.string())


def strip(value: Column, chars: str = r"\s") -> Column:
    """Both ends without Unicode white space, or without the characters of a regex class body."""
    return F.regexp_replace(value, rf"(?U)^[{chars}]+|[{chars}]+$", "")


def strip_dots(value: Column) -> Column:
    return strip(value, r" .")


def synonym(form: Column) -> Column:
    """The vote key of a normal form."""
    table = F.create_map(*[F.lit(x) for pair in SYNONYMS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, form), form)


@F.arrow_udf(StringType())
def shortest_number(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Integral doubles without a point, others as the shortest text that reads back."""
    for batch in batches:
        yield pa.array([None if v is None else str(int(v)) if v == v and abs(v) != float("inf") and v == int(v) else repr(v) for v in batch.to_pylist()], pa.string())


def number_text(digits: int):
    """A UDF for doubles with ``digits`` significant digits and no trailing zeros."""

    @F.arrow_udf(StringType())
    def general(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if v is None else f"{v:.{digits}g}" for v in batch.to_pylist()], pa.string())

    return general


number_12g = number_text(12)
number_15g = number_text(15)


def canonical_key(item: Column, number: Column, is_numeric: Column) -> Column:
    """``numeric:`` and 15 digits for positive finite numbers, the synonym key for names, empty where a number is none."""
    good = (number > 0) & (number < float("inf"))
    return F.when(is_numeric, F.when(good, F.concat(F.lit("numeric:"), number_15g(number))).otherwise(F.lit(""))).otherwise(synonym(normalize(item)))


def without_parenthesis(item: Column) -> Column:
    """The text before a closing parenthesis of up to 40 characters."""
    return F.regexp_replace(item, r"(?U)\s*\([^()]{1,40}\)\s*$", "")


def acronym(item: Column) -> Column:
    """Lower-case letters of an item that is two to six capitals, else null."""
    letters = F.regexp_replace(item, "[^A-Za-z]", "")
    alpha = F.regexp_replace(item, r"[^\p{L}]", "")
    fits = F.length(letters).between(2, 6) & (alpha == F.upper(alpha)) & ~alpha.rlike(r"\p{Lo}|\p{Lm}")
    return F.when(fits, F.lower(alpha))


def initials(item: Column) -> Column:
    """First letters of at least two words, stop words left out; null unless two to eight."""
    words = F.filter(F.regexp_extract_all(item, F.lit("[A-Za-z]+"), F.lit(0)), lambda w: ~F.lower(w).isin(*STOPWORDS))
    short = F.array_join(F.transform(words, lambda w: F.lower(F.substring(w, 1, 1))), "")
    return F.when((F.size(words) >= 2) & F.length(short).between(2, 8), short)


def reasoning(text: Column) -> Column:
    """The span inside think tags, or else what stands before the answer label."""
    tagged = strip(F.regexp_extract(text, r"(?is)<think>(.*?)(?:</think>|$)", 1))
    before = F.split(text, r"(?i)\bANSWER\s*:", 2)[0]
    plain = strip(F.regexp_replace(before, r"(?i)^\s*REASONING\s*:\s*", ""))
    return F.when(text.rlike("(?i)<think>"), tagged).otherwise(plain)


# Claim label, relation, pattern that must occur, pattern that must not.
CLAIMS = (
    ("area_km2_unit", "hasArea", r"\b(square\s+kilomet(?:er|re)s?|sq\.?\s*km|km\s*[²2])\b", None),
    ("area_non_km_unit", "hasArea", r"\b(square\s+miles?|sq\.?\s*mi|acres?|hectares?)\b", r"\b(square\s+kilomet(?:er|re)s?|sq\.?\s*km|km\s*[²2])\b|convert"),
    ("capacity_variant", "hasCapacity", r"\b(seated|seating|standing|concert|temporary|configuration)\b", None),
    ("capacity_total", "hasCapacity", r"\b(total|official|spectator)\s+(?:seating\s+)?capacity\b", None),
    ("listing_historical", "companyTradesAtStockExchange", r"\b(formerly|previously|historically|used to|at one time)\b", None),
    ("listing_inactive", "companyTradesAtStockExchange", r"\b(delisted|no longer (?:listed|traded)|taken private|privately held|not publicly traded|acquired)\b", None),
    ("listing_current", "companyTradesAtStockExchange", r"\b(currently|shares (?:are )?traded|shares trade|listed on|publicly traded)\b", r"\b(formerly|previously|historically|used to|at one time|delisted|no longer (?:listed|traded)|taken private|privately held|not publicly traded|acquired)\b"),
    ("award_partial_scope", "awardWonBy", r"\b(?:19|20)\d{2}\b|\b(recent|latest|for example|focus on|specific year)\b", None),
    ("border_land", "countryLandBordersCountry", r"\bland border", None),
    ("border_maritime_only", "countryLandBordersCountry", r"\bmaritime (?:border|boundary)", r"\bland border"),
    ("city_explicit", "personHasCityOfDeath", r"\b(city of|died in|death (?:in|at))\b", None),
    ("city_noncity_scope", "personHasCityOfDeath", r"\b(province|state|region|country)\b", r"\b(city|town|municipality)\b"),
)


# Claims that speak against an answer.
RISKS = ("area_non_km_unit", "award_partial_scope", "border_maritime_only", "capacity_variant", "city_noncity_scope", "listing_historical", "listing_inactive")


def claims(text: Column, relation: Column) -> Column:
    """Sorted labels of what the reasoning says outright, by relation."""
    value = F.regexp_replace(F.lower(reasoning(text)), r"(?U)\s+", " ")
    found = []
    for label, of, must, must_not in CLAIMS:
        hit = (relation == of) & value.rlike("(?U)" + must)
        found.append(F.when(hit & ~value.rlike("(?U)" + must_not) if must_not else hit, F.lit(label)))
    return F.array_sort(F.array_compact(F.array(*found)))


def first_sentence(text: Column) -> Column:
    return strip(F.regexp_extract(text, r"(?s)^\s*(.*?[.!?])(?:\s|$)", 1))


def capped(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, back to the last sentence end where there is one."""
    head = F.substring(text, 1, limit)
    ended = F.regexp_extract(head, r"(?s)^(.*[.!?])(?:\s.*|)$", 1)
    return F.when(F.length(text) <= limit, text).when(F.length(ended) > 0, ended).otherwise(head)


def counts_of(spec: Column) -> Column:
    """A map from ``NAME=COUNT`` pairs; pairs without a whole number are null."""
    return F.transform_values(F.str_to_map(spec, F.lit(","), F.lit("=")), lambda k, v: F.try_to_number(F.trim(v), F.lit("999999999")).cast("int"))


def slug(route: Column) -> Column:
    return F.replace(route, F.lit(":"), F.lit("_"))


def character_overlap(text: Column, option: Column) -> Column:
    """The share of an option's distinct characters that a text holds."""
    chars = F.array_distinct(F.filter(F.split(F.lower(option), ""), lambda c: c != ""))
    return F.try_divide(F.size(F.filter(chars, lambda c: F.contains(F.lower(text), c))).cast("double"), F.size(chars).cast("double"))


def seed_hex(*values: Column) -> Column:
    """The first eight bytes, in hex, of the SHA-256 of the values with unit separators between."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *[v.cast("string") for v in values]), 256), 1, 16)


def stable_seed(*values: Column) -> Column:
    """An unsigned 64-bit seed as a decimal, the same for the same values wherever they stand."""
    return F.conv(seed_hex(*values), 16, 10).cast("decimal(20,0)")


def utc_text(moment: Column) -> Column:
    """A timestamp as ISO 8601 in UTC, to the second, whatever the session's time zone."""
    return F.date_format(F.to_utc_timestamp(moment, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def elapsed_seconds(start: Column, end: Column) -> Column:
    return F.round((F.unix_micros(end) - F.unix_micros(start)) / 1e6, 3)
