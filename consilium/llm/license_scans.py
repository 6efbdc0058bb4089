"""License scans by canonical digest lookup.

A text is normalised (case, punctuation, copyright lines, equivalent
spellings), digested whole, and hash-joined to the digests of known licence
texts.  So is a document's licence body: its lines from the first that speaks
of a licence to its end, or else to the last that does.  Single lines that
speak of a licence are digested the same way as texts of their own, so one-line
notices anywhere in a longer document are found too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, let, load, materialize
from .license_texts import EQUIVALENT, KNOWN, whole_texts

#: A line of a holder and a year, not a sentence that speaks of copyright.
COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n]*(?:copyright[ \t]*(?:\(c\)|©|[0-9]{4}|by\b|:)|\(c\)[ \t]*(?:copyright|[0-9]{4})|©)[^\n]*$|(?m)^[^a-z0-9\n]*all rights reserved\.?[ \t]*$"
#: A line is digested on its own only if one of these stems occurs; every known notice has one.
NOTICE = r"(?i)licen[sc]e|public domain"
#: ASCII that is no letter or digit, and the common typographic marks.
PUNCTUATION = r"[\x00-\x2F\x3A-\x60\x7B-\x7F\x{2010}-\x{2027}\x{A9}\x{AE}\x{AB}\x{BB}\x{A0}]+"
_SPELLING = r"\b(" + "|".join(EQUIVALENT) + r")\b"


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, one spelling, and single spaces for all that is no letter or digit.

    Null is empty.  Letters beyond ASCII count as letters.
    """
    lowered = F.lower(F.coalesce(text, F.lit("")))
    bare = F.when(lowered.rlike(r"copyright|\(c\)|©|all rights reserved"), F.regexp_replace(lowered, COPYRIGHT_LINE, "")).otherwise(lowered)
    flat = F.trim(F.regexp_replace(bare, PUNCTUATION, " "))

    def one_spelling(t: Column) -> Column:
        out = t
        for old, new in EQUIVALENT.items():
            out = F.regexp_replace(out, rf"\b{old}\b", new)
        return out

    return let(flat, lambda t: F.when(t.rlike(_SPELLING), one_spelling(t)).otherwise(t))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def catalogue(spark: SparkSession, known: dict[str, list[str]] | None = None) -> DataFrame:
    """(digest, license_id) of the known texts, one row a digest; the smaller id wins a tie.

    Without ``known`` those are ``KNOWN`` and the whole texts in ``licenses``.
    """
    sources = [known] if known else [KNOWN, whole_texts()]
    rows = [(name, text) for source in sources for name, texts in source.items() for text in texts]
    df = spark.createDataFrame(rows, "license_id string, text string")
    return df.select(digest(F.col("text")).alias("digest"), "license_id").groupBy("digest").agg(F.min("license_id").alias("license_id"))


#: Parts of a document that are digested as texts of their own, the first that is known counts.
BODIES = ("whole", "tail", "span")


def _lined(text: Column) -> Column:
    """struct<notices, bodies>: distinct digests of the lines that speak of a licence, and of the tail and the span that begin at the first of them."""

    def of(lines: Column) -> Column:
        spoken = F.transform(lines, lambda x: x.rlike(NOTICE))

        def cut(flags: Column) -> Column:
            first = F.array_position(flags, True).cast("int")
            count = F.size(flags) - F.array_position(F.reverse(flags), True).cast("int") + 1 - first + 1
            part = lambda n: digest(F.array_join(F.slice(lines, first, n), "\n"))
            return F.array(part(F.size(flags) - first + 1), part(count))

        notices = F.array_distinct(F.transform(F.filter(lines, lambda x: x.rlike(NOTICE)), digest))
        return let(spoken, lambda f: F.struct(notices.alias("notices"), cut(f).alias("bodies")))

    return F.when(text.rlike(NOTICE), let(F.split(text, "\n"), of))


def scan_licenses(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One row a document: doc_id, text_digest, license_id, body_id, body, n_notices, notice_ids.

    ``license_id`` names the licence whose text the whole document is, or is
    null.  ``body_id`` names the one that the whole document or its licence
    body is, and ``body`` which of ``BODIES`` that was.  ``notice_ids`` lists,
    sorted and joined by commas, the licences that single lines name;
    ``n_notices`` counts those distinct ids.  Null and empty texts have the
    digest of nothing and match no licence.  Null ids and repeated rows are
    judged row by row; other columns are not read; an empty table gives no
    rows.  ``known`` (digest, license_id) may hold any number of rows: it is
    broadcast only when counted to be small.
    """
    spark = docs.sparkSession
    known = catalogue(spark) if known is None else known
    n_known = known.count()
    own = docs.select(docs["doc_id"].alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("t"))
    digested = own.select("doc_id", digest(F.col("t")).alias("text_digest"), _lined(F.col("t")).alias("l"), F.monotonically_increasing_id().alias("row"))
    slim = materialize(digested.select("row", "doc_id", "text_digest", "l.notices", "l.bodies"), "license-digests")
    parts = slim.where("notices IS NOT NULL").select("row", F.posexplode(F.concat("bodies", "notices")).alias("at", "digest"))
    met = parts.join(bounded(known, n_known), "digest")
    line = F.col("at") >= len(BODIES) - 1
    found = met.groupBy("row").agg(F.array_sort(F.collect_set(F.when(line, F.col("license_id")))).alias("ids"), F.min(F.when(~line, F.struct("at", "license_id"))).alias("b"))
    whole = bounded(known.select(F.col("digest").alias("text_digest"), "license_id"), n_known)
    out = slim.select("row", "doc_id", "text_digest").join(whole, "text_digest", "left").join(found, "row", "left")
    kind = F.when(F.col("license_id").isNotNull(), F.lit(BODIES[0])).otherwise(F.get(F.array(*map(F.lit, BODIES[1:])), F.col("b.at")))
    return out.select("doc_id", "text_digest", "license_id", F.coalesce("license_id", "b.license_id").alias("body_id"), kind.alias("body"), F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_notices"), F.coalesce(F.array_join("ids", ","), F.lit("")).alias("notice_ids"))


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(load(spark, sf_dir, "documents"))
