"""Answer parsing: from generated text to a status and a list of items."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bind import let
from .text import strip, strip_dots

# Texts that stand for no answer, and suffixes that belong to the name before the comma.
NULL_TEXT = ("none", "n/a", "na", "unknown", "no answer", "empty", "null")
SUFFIXES = ("jr", "jr.", "sr", "sr.", "ii", "iii", "iv", "v", "junior", "senior")

_NONE = "cast(array() as array<string>)"
_LABEL = r"(?i)^([ \t]*ANSWER[ \t]*:[ \t]*)+"


def none() -> Column:
    return F.expr(_NONE)


def after_think(text: Column) -> Column:
    """What follows the closing tag; nothing if the tag never closes; all of it if there is none."""
    at = F.instr(text, "</think>")
    return F.when(at > 0, strip(F.substring(text, at + len("</think>"), F.length(text)))).when(F.contains(text, F.lit("<think>")), F.lit("")).otherwise(strip(text))


def answer_status(text: Column, protocol: str = "legacy-cot") -> Column:
    """struct<answer, status>: valid, explicit-none, unclosed-think or empty."""

    def judged(bad: Column, answer: Column) -> Column:
        status = F.coalesce(bad, F.when(answer == "", F.lit("empty")).when(F.lower(answer).isin(*NULL_TEXT), F.lit("explicit-none")).otherwise(F.lit("valid")))
        return F.struct(F.when(bad.isNotNull(), F.lit("")).otherwise(answer).alias("answer"), status.alias("status"))

    def reasoned(raw: Column) -> Column:
        unclosed = F.contains(raw, F.lit("<think>")) & ~F.contains(raw, F.lit("</think>"))
        return let(strip_dots(after_think(raw)), lambda a: judged(F.when(unclosed, F.lit("unclosed-think")), a))

    def labelled(raw: Column) -> Column:
        label = r"(?i)(?:^|\n)\s*ANSWER\s*:\s*([^\n]*)"
        isolated = strip(F.when(raw.rlike(label), F.regexp_extract(raw, label, 1)).otherwise(F.split(raw, "\\R", 2)[0]))

        def of(line: Column) -> Column:
            opens = F.when(F.startswith(line, F.lit("<think>")), F.when(F.contains(raw, F.lit("</think>")), F.lit("empty")).otherwise(F.lit("unclosed-think")))
            return judged(F.when(raw == "", F.lit("empty")).otherwise(opens), strip_dots(line))

        return let(isolated, of)

    return let(strip(F.coalesce(text, F.lit(""))), reasoned if protocol == "legacy-cot" else labelled)


def first_line(text: Column) -> Column:
    return strip_dots(strip(F.split(strip(text), "\n", 2)[0]))


def first_number(text: Column) -> Column:
    """The first number with its commas, or null."""
    return F.nullif(F.regexp_extract(text, r"(?U)-?\d[\d,]*\.?\d*", 0), F.lit(""))


def is_null_text(text: Column) -> Column:
    return (text == "") | F.lower(text).isin(*NULL_TEXT)


def split_items(line: Column) -> Column:
    """Items between commas and semicolons; a leading "and " goes, a name suffix joins the item before it."""
    parts = F.transform(F.split(line, "[,;]"), strip_dots)
    parts = F.transform(parts, lambda p: F.when(F.lower(F.substring(p, 1, 4)) == "and ", strip(F.substring(p, 5, F.length(p)))).otherwise(p))

    def step(acc: Column, p: Column) -> Column:
        glued = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(F.try_element_at(acc, F.lit(-1)), F.lit(", "), p)))
        suffix = F.lower(F.regexp_replace(p, r"\.+$", "")).isin(*SUFFIXES)
        return F.when((F.size(acc) > 0) & suffix, glued).otherwise(F.concat(acc, F.array(p)))

    return F.aggregate(F.filter(parts, lambda p: p != ""), none(), step)


def items(text: Column, is_numeric: Column) -> Column:
    """The items of an answer's first line; a numeric relation has its first number alone."""

    def of(line: Column) -> Column:
        number = F.array_compact(F.array(first_number(line)))
        return F.when(is_null_text(line), none()).when(is_numeric, number).otherwise(split_items(line))

    return let(first_line(text), of)


def answer_items(answer: Column, is_numeric: Column, protocol: str = "legacy-cot") -> Column:
    """Items of an isolated answer; the answer-first protocol may part names by double bars."""
    empty = F.coalesce(answer, F.lit("")) == ""
    out = items(answer, is_numeric)
    if protocol == "answer-first":
        barred = F.filter(F.transform(F.split(answer, r"\|\|"), strip_dots), lambda p: p != "")
        out = F.when(~is_numeric & F.contains(answer, F.lit("||")), barred).otherwise(out)
    return F.when(empty | F.lower(strip(answer)).isin(*NULL_TEXT), none()).otherwise(out)


def without_label(value: Column) -> Column:
    """No answer label at the start, however often it is repeated."""
    return strip(F.regexp_replace(strip(value), _LABEL, ""))


def answer_field(text: Column) -> Column:
    """struct<status, answer> of explicit answer lines; lines that disagree give no answer."""

    def of(found: Column) -> Column:
        forms = F.array_distinct(F.transform(found, lambda v: F.lower(strip(F.regexp_replace(v, "[ \t]+", " ")))))
        status = F.when(F.size(found) == 0, F.lit("missing_answer_field")).when(F.size(forms) > 1, F.lit("conflicting_answer_fields")).otherwise(F.lit("answer_field"))
        return let(status, lambda s: F.struct(s.alias("status"), F.when(s == "answer_field", F.try_element_at(found, F.lit(-1))).alias("answer")))

    lines = F.regexp_extract_all(text, F.lit(r"(?im)^[ \t]*ANSWER[ \t]*:[ \t]*([^\r\n]*)$"), F.lit(1))
    return let(F.filter(F.transform(lines, strip), lambda v: v != ""), of)


def _null_form(value: Column) -> Column:
    # compared after normalisation, where "n/a" has become "n a" and so is no null
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(value, r"['’‘ʻʼʹ`´]", ""), r"[\p{P}+$<=>|~^\s]+", " "))).isin(*NULL_TEXT)


def proposal(text: Column, is_numeric: Column, legacy: bool = False) -> Column:
    """struct<status, items> of a proposal: parsed_nonempty, explicit_none, or why it is neither.

    ``legacy`` keeps an echoed label and knows three null texts only.
    """

    def out(status: Column, kept: Column) -> Column:
        return F.struct(status.alias("status"), F.when(status == "parsed_nonempty", kept).otherwise(none()).alias("items"))

    def of_items(answer: Column, raw: Column) -> Column:
        if legacy:
            nothing, kept = F.lower(strip(answer)).isin("none", "null", "no answer"), raw
        else:
            bare = F.transform(raw, without_label)
            kept = F.filter(bare, lambda v: (v != "") & ~_null_form(v))
            nothing = _null_form(answer) | (F.size(kept) == 0) & (F.size(raw) > 0) & F.forall(bare, _null_form)
        status = F.when(nothing, F.lit("explicit_none")).when(F.size(kept) == 0, F.lit("unparseable_answer_field")).otherwise(F.lit("parsed_nonempty"))
        return let(status, lambda s: out(s, kept))

    def of_field(field: Column) -> Column:
        answer = field["answer"] if legacy else without_label(field["answer"])
        parsed = let(answer, lambda a: let(answer_items(a, is_numeric), lambda raw: of_items(a, raw)))
        return F.when(field["answer"].isNull(), out(field["status"], none())).otherwise(parsed)

    return let(answer_field(text), of_field)


def listing_phrases(text: Column) -> Column:
    """Exchanges that a sentence says a company is listed or traded on."""
    found = F.regexp_extract_all(text, F.lit(r"(?i)\b(?:listed|traded|trades|trade)\s+(?:primarily\s+)?on\s+(?:the\s+)?([^.;\n]+)"), F.lit(1))
    cut = F.transform(found, lambda v: strip(F.split(strip(v, " ,"), r"(?i)\s+(?:under|with|via|as)\s+", 2)[0], " ,"))
    return F.filter(cut, lambda v: v != "")


def final_text(answer: Column) -> Column:
    """The part of a final answer that holds it: an explicit label's line, or the last line where the first is a sentence."""

    def of(lines: Column) -> Column:
        first = F.try_element_at(lines, F.lit(1))
        prose = (F.length(first) > 80) | (F.size(F.split(first, r"(?U)\s+")) > 12) | first.rlike(r"[.!?] ")
        labels = F.filter(F.regexp_extract_all(answer, F.lit(r"(?i)(?:^|\n)\s*ANSWER\s*:\s*([^\n]+)"), F.lit(1)), lambda v: v != "")
        last = F.when((F.size(lines) > 1) & prose, F.try_element_at(lines, F.lit(-1))).otherwise(answer)
        return let(labels, lambda x: F.when(F.size(x) > 0, strip(F.try_element_at(x, F.lit(-1)))).otherwise(last))

    return let(F.filter(F.transform(F.split(answer, "\\R"), strip), lambda v: v != ""), of)


def classify(text: Column, relation: Column, is_numeric: Column, protocol: str = "legacy-cot") -> Column:
    """struct<kind, status, answer, items> of one sample: entity, explicit-abstention or invalid; prose is repaired."""

    def of_items(parsed: Column, chosen: Column, found: Column) -> Column:
        valid, some = parsed["status"] == "valid", F.size(found) > 0
        kind = F.when(parsed["status"] == "explicit-none", F.lit("explicit-abstention")).when(valid & some, F.lit("entity")).otherwise(F.lit("invalid"))
        status = F.when(valid & ~some, F.lit("valid-but-unparseable")).otherwise(parsed["status"])
        entity = valid & some
        return F.struct(kind.alias("kind"), status.alias("status"), F.when(entity, chosen).otherwise(parsed["answer"]).alias("answer"), F.when(entity, found).otherwise(none()).alias("items"))

    def of_chosen(parsed: Column, chosen: Column) -> Column:
        listed = F.when(relation == "companyTradesAtStockExchange", listing_phrases(chosen)).otherwise(none())
        found = let(listed, lambda x: F.when(F.size(x) > 0, x).otherwise(answer_items(chosen, is_numeric, protocol)))
        return let(found, lambda f: of_items(parsed, chosen, f))

    def of_parsed(parsed: Column) -> Column:
        return let(final_text(parsed["answer"]) if protocol == "legacy-cot" else parsed["answer"], lambda c: of_chosen(parsed, c))

    return let(answer_status(text, protocol), of_parsed)


def is_pure_number(text: Column) -> Column:
    """No letter at all: a value typed as a number, not prose about one."""
    return ~text.rlike(r"\p{L}")
