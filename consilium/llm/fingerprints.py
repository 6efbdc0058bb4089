"""Document fingerprints by winnowing.

A text becomes tokens (words; very long words in stretches), each hashed once.
A polynomial over bits rolls over them: the hash of a run is its tokens' hashes,
shifted by their place and combined by exclusive or, so longer runs come from
overlapping shorter ones without hashing a token again.  Of every ``WINDOW``
neighbouring hashes of runs of ``GRAM`` tokens the least is kept, the rightmost
on ties, with its position.  Any two texts that share ``GRAM + WINDOW - 1``
tokens in a row share a fingerprint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, load, materialize

GRAM, WINDOW = 5, 16
#: A word longer than this counts as several tokens, so that unspaced text has many.
STRETCH = 32
TOKEN = rf"[^\x20\x09-\x0D]{{1,{STRETCH}}}"
#: Ids that one window of the neighbour search sorts.
RANGE_ROWS = 1_000_000
#: A hash of a run has 36 bits, the upper ones of a long, so that it and a position from the end (27 bits) can share one.
_LOW, _POS = 28, 1 << 27
_LOWEST = -(2**63)


def rolled(tokens: Column, gram: int) -> Column:
    """Polynomials of all runs of ``gram`` (32 at most) of ``tokens``, hashes of which there are as many at least.

    The tokens' hashes are coefficients, a shift by one multiplies by x, and
    powers from 64 on drop out.  A run of w + v tokens is the run of its first
    w, shifted by v, combined with the run of its last v; runs double until
    their sizes add up to ``gram``.
    """
    if not 1 <= gram <= 32:
        raise ValueError(f"gram out of range: {gram}")

    def joined(a: Column, wide: int, b: Column, narrow: int) -> Column:
        # runs that reach beyond the end are null, and are cut off at last
        return F.transform(a, lambda x, i: F.shiftleft(x, narrow).bitwiseXOR(F.get(b, i + wide)))

    def grown(runs: Column, width: int, done: Column | None, size: int, left: int) -> Column:
        if left & width:
            both = runs if done is None else joined(done, size, runs, width)
            if left == width:
                return F.slice(both, 1, F.size(both) - gram + 1)
            return let(F.struct(both.alias("d"), runs.alias("r")), lambda s: grown(s["r"], width, s["d"], size + width, left - width))
        return let(joined(runs, width, runs, width), lambda q: grown(q, 2 * width, done, size, left))

    return grown(tokens, 1, None, 0, gram)


def gram_hashes(text: Column, gram: int = GRAM) -> Column:
    """Hashes of 36 bits (the lower bits are 0) of all runs of ``gram`` tokens; of the whole text where it has fewer; none of a blank text."""
    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    short = lambda x: F.xxhash64(x).bitwiseAND(F.lit(-(1 << _LOW)))

    def runs(t: Column) -> Column:
        each = let(F.transform(t, lambda w: F.xxhash64(w)), lambda h: rolled(h, gram))
        return F.when(F.size(t) >= gram, F.transform(each, short)).when(F.size(t) > 0, F.array(short(F.array_join(t, " ")))).otherwise(F.expr("cast(array() as array<bigint>)"))

    return let(tokens, runs)


def winnowed(hashes: Column, window: int = WINDOW) -> Column:
    """array<struct<hash, pos>> by position: the least of each window of ``hashes``, unsigned and by 36 bits, rightmost on ties.

    A hash and its position counted from the end share one long, so a plain
    minimum picks the rightmost tie; minima of doubled widths build up the window.
    ``window`` is a power of two.
    """

    def packed(h: Column) -> Column:
        return F.transform(h, lambda x, i: F.shiftrightunsigned(x, _LOW) * _POS + (F.lit(_POS - 1).cast("long") - i))

    def doubled(p: Column, width: int) -> Column:
        # windows that reach beyond the end are cut off at last
        if width == window:
            return F.slice(p, 1, F.size(p) - window + 1)
        return let(F.transform(p, lambda x, i: F.least(x, F.get(p, i + width))), lambda q: doubled(q, width * 2))

    def chosen(h: Column) -> Column:
        minima = F.when(F.size(h) <= window, F.array(F.array_min(packed(h)))).otherwise(let(packed(h), lambda p: doubled(p, 1)))
        at = F.sort_array(F.transform(F.array_distinct(minima), lambda m: (F.lit(_POS - 1).cast("long") - F.pmod(m, F.lit(_POS))).cast("int")))
        return F.transform(at, lambda i: F.struct(F.get(h, i).alias("hash"), i.alias("pos")))

    return F.when(F.size(hashes) == 0, F.expr("cast(array() as array<struct<hash:bigint,pos:int>>)")).otherwise(let(hashes, chosen))


def fingerprint(text: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """The winnowed fingerprint of a text: array<struct<hash, pos>> by position.  Null and blank texts have none."""
    return let(gram_hashes(F.coalesce(text, F.lit("")), gram), lambda h: winnowed(h, window))


def digest_of(print_: Column) -> Column:
    """One string for a whole fingerprint, hashes and positions."""
    return F.sha2(F.array_join(F.transform(print_, lambda x: F.concat_ws("@", F.hex(x["hash"]), x["pos"])), ","), 256)


def marks(print_: Column) -> Column:
    """The distinct hashes of a fingerprint, sorted."""
    return F.sort_array(F.array_distinct(F.transform(print_, lambda x: x["hash"])))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct hashes; 1 of two empty ones."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def successors(keys: DataFrame) -> DataFrame:
    """(key, next) for every distinct key: the next larger one, and the smallest after the largest.

    Keys are dealt out by range, each range is sorted by itself, and only the
    first key of each range is looked at across ranges.
    """
    distinct = keys.select("key").distinct()
    parts = max(1, -(-keys.count() // RANGE_ROWS))
    ranged = materialize(distinct.repartitionByRange(parts, "key").select("key", F.spark_partition_id().alias("part")), "fingerprint-ids")
    firsts = ranged.groupBy("part").agg(F.min("key").alias("first"))
    over = Window.orderBy("part")
    around = F.min("first").over(Window.partitionBy())
    after = firsts.select("part", F.coalesce(F.lead("first").over(over), around).alias("after"))
    inside = F.lead("key").over(Window.partitionBy("part").orderBy("key"))
    # one row a range: at most a millionth of the ids
    return ranged.withColumn("inside", inside).join(after, "part").select("key", F.coalesce("inside", "after").alias("next"))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_marks.

    The edited text is the text with its last quarter replaced by the start of
    the next document's.  Null texts are empty; two empty fingerprints are
    alike (1), an empty and another unlike (0).  A null id counts as the
    smallest; among rows that share an id, the least text stands for the id as
    somebody's next document.  A lone document is its own next.
    """
    own = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(_LOWEST)).alias("key"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    order = materialize(successors(own), "fingerprint-order")
    # only lengths go to the next document, and only that much of its text comes back
    wanted = own.groupBy("key").agg(F.max(F.expr("length(text) div 4")).alias("quarter")).join(order, "key").withColumnRenamed("key", "reader")
    # with one row an id, both sides below read one and the same exchange of the texts
    ranked, given = own, own
    if order.count() != own.count():
        ranked = own.withColumn("turn", F.row_number().over(Window.partitionBy("key").orderBy("text")))
        given = ranked.where("turn = 1")
    given = given.select(F.col("key").alias("next"), F.col("text").alias("next_text"))
    heads = wanted.join(given, "next").select(F.col("reader").alias("key"), "next", F.expr("substring(next_text, 1, cast(quarter as int))").alias("head"))
    both = ranked.join(heads, "key").withColumn("turn", F.col("turn") if "turn" in ranked.columns else F.lit(1)).withColumn("n_chars", F.length("text")).withColumn("quarter", F.expr("cast(n_chars div 4 as int)"))
    both = both.withColumn("edited", F.expr("concat(substring(text, 1, n_chars - quarter), substring(head, 1, quarter))"))
    prints = both.select(
        "key", "next", "turn", F.col("n_chars").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("text")).alias("own"), fingerprint(F.col("edited")).alias("other")
    )
    # the arrays of a row are evaluated once each
    digested = prints.select("key", "next", "turn", "n_chars", "edited_sha256", let(F.struct("own", "other"), _summary).alias("s"))
    slim = materialize(digested.select("key", "next", "turn", "n_chars", "edited_sha256", "s.*"), "fingerprint-marks")
    following = slim.where("turn = 1").select(F.col("key").alias("next"), F.col("marks").alias("next_marks"))
    out = slim.join(following, "next")
    return out.select(F.nullif("key", F.lit(_LOWEST)).alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", likeness(F.col("marks"), F.col("next_marks")).alias("near_next"), F.size("marks").cast("long").alias("n_marks"))


def _summary(pair: Column) -> Column:
    own, other = pair["own"], pair["other"]
    near = let(marks(own), lambda a: F.struct(a.alias("marks"), likeness(a, marks(other)).alias("near")))
    return let(near, lambda n: F.struct(n["marks"].alias("marks"), n["near"].alias("near_edited"), digest_of(own).alias("fingerprint"), digest_of(other).alias("edited_fingerprint")))


def op5_winnowing_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(load(spark, sf_dir, "documents"))
