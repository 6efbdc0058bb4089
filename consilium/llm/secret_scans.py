"""Secret scans over an incremental ledger of content-addressed blobs.

Every version of every path is addressed by the SHA-256 of its text.  A ledger
row says that one blob was scanned by one version of one rule, and what was
found.  A scan touches only (blob, rule version) pairs that the ledger lacks;
findings then join back to all paths that hold the blob.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, let, load, materialize


@dataclass(frozen=True)
class Rule:
    """``group`` of a match must hold ``least`` characters, else the match drops out (but still uses up its text)."""

    kind: str
    pattern: str
    least: int
    group: int = 0
    version: int = 1
    base: bool = False

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The base rules as the contract states them.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2, base=True),
    Rule("access", r"AKIA[A-Z0-9]+", 18, base=True),
    Rule("hex", r"[0-9a-f]{16,}", 16, base=True),
)
# Published formats of well-known credentials, on top of the base rules.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----", 10),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 20),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 15),
)
RULES = BASE_RULES + MORE_RULES

_BEGIN, _END = (f"-----{x} [A-Z ]{{0,24}}PRIVATE KEY-----" for x in ("BEGIN", "END"))
# All up to the END line (header lines hold single dashes), or the lines of base64 that follow where there is none.
_KEY = rf"{_BEGIN}(?:(?:[^-]*+-(?!----)){{0,64}}[^-]*+{_END}|(?:\s*[A-Za-z0-9+/=]{{32,}}+){{1,1000}}(?:\s*\n[A-Za-z0-9+/]{{1,76}}={{0,2}}(?=\r?\n|$))?)?"
#: What ``redact`` masks: ``RULES``, but a private key with its body, of which the scan's span is the BEGIN line.
MASKED = tuple(Rule("pem", _KEY, 10, version=2) if r.kind == "pem" else r for r in RULES)

#: Blobs, or spans of findings, that are broadcast at most; more are joined by a shuffle.
FEW = 500_000

SPAN = "array<struct<start:int,rank:int,kind:string,stop:int>>"


def spans_of(text: Column, rule: Rule, rank: int) -> Column:
    """All matches of one rule in code points, leftmost and not overlapping.

    Splitting by the pattern gives the stretches between the matches and
    extraction gives the matches, so running lengths give the positions.
    """

    def located(t: Column) -> Column:
        gaps, hits = F.split(t, rule.pattern, -1), F.regexp_extract_all(t, F.lit(rule.pattern), F.lit(0))
        held = F.regexp_extract_all(t, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else hits
        sizes = F.zip_with(F.transform(hits, F.length), F.transform(held, F.length), lambda h, k: F.struct(h.alias("hit"), k.alias("held")))
        rows = F.zip_with(F.transform(gaps, F.length), sizes, lambda g, x: F.struct(g.alias("gap"), x["hit"].alias("hit"), x["held"].alias("held")))
        zero = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {SPAN})").alias("out"))

        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["gap"]
            stop = start + x["hit"]
            span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), stop.alias("stop"))
            keep = x["hit"].isNotNull() & (x["held"] >= rule.least)
            return F.struct(F.coalesce(stop, start).alias("at"), F.when(keep, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

        return F.aggregate(rows, zero, step, lambda acc: acc["out"])

    return F.when(text.rlike(rule.pattern), let(text, located)).otherwise(F.expr(f"cast(array() as {SPAN})"))


def content_address(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _none(kind: str) -> Column:
    return F.expr(f"cast(array() as {kind})")


def scan_blobs(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows (blob, found map<rule key, spans>) of the blobs in ``versions(blob, text)``.

    ``ledger(blob, found)`` holds earlier rows, in any number for each blob;
    without one nothing is seen.  Only blobs that lack some rule version are
    scanned, each once and by the lacking rules.  Copies are combined before
    they move; beside a ledger with few unseen blobs only those move at all.
    """
    spark = versions.sparkSession
    known = spark.createDataFrame([], f"blob string, found map<string, {SPAN}>") if ledger is None else ledger
    seen = known.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list(F.map_keys("found")))).alias("seen"))
    want = F.array(*[F.lit(r.key) for r in rules])

    def lacking(blobs: DataFrame) -> DataFrame:
        with_seen = blobs.join(seen, "blob", "left").withColumn("seen", F.coalesce("seen", _none("array<string>")))
        return with_seen.where(F.size(F.array_except(want, F.col("seen"))) > 0)

    if ledger is not None:
        unseen = materialize(lacking(versions.select("blob").distinct()).select("blob"), "secret-unseen")
        if (n := unseen.count()) <= FEW:
            versions = versions.join(bounded(unseen, n, FEW), "blob", "left_semi")
    blobs = lacking(versions.groupBy("blob").agg(F.first("text").alias("text")))
    per_rule = [
        F.when(~F.array_contains("seen", F.lit(r.key)), F.struct(F.lit(r.key).alias("key"), spans_of(F.col("text"), r, i).alias("value")))
        for i, r in enumerate(rules)
    ]
    return blobs.select("blob", F.map_from_entries(F.array_compact(F.array(*per_rule))).alias("found"))


def hits(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, found) of the blobs of ``ledger`` with spans of the current rule versions; broadcast where these are counted to be few."""
    keys = F.array(*[F.lit(r.key) for r in rules])
    current = ledger.select("blob", F.flatten(F.map_values(F.map_filter("found", lambda k, v: F.array_contains(keys, k)))).alias("one"))
    current = current.where(F.size("one") > 0)
    spans = current.agg(F.coalesce(F.sum(F.size("one")), F.lit(0))).first()[0]
    current = current.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("one")))).alias("found"))
    return bounded(current, spans, FEW)


def findings(paths: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``paths`` (with a column blob) plus ``found``: sorted spans of the current rule versions.

    Few findings are broadcast, so paths do not move.  Beyond that the right
    side has a row for each blob at most and only blobs with a finding, so a
    blob that many paths share adds no rows; a hot blob on the left is split by
    the adaptive skew join.
    """
    return paths.join(hits(ledger, rules), "blob", "left").withColumn("found", F.coalesce("found", _none(SPAN)))


def joined(spans: Column) -> Column:
    """``kind:start:stop`` by start, then kind as listed, with commas between."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def scan_documents(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, paths: tuple[str, ...] = ("doc_id",)) -> tuple[DataFrame, DataFrame]:
    """(docs' path columns, blob, found; the new ledger rows), the latter written once to the shared folder.

    ``docs`` holds every version of every path, named by ``paths`` (say path
    and version): a version that repeats an earlier blob, of its own or any
    other path, is found without a scan.  A null text is an empty blob;
    repeated rows and copies share one blob and are scanned once; null ids pass
    through.  Extra columns, whatever their names, are not read.  An empty
    table gives empty results.  Passing the ledger of earlier tables, with
    these rows appended, scans what is new.
    """
    held = [f"__k{i}" for i in range(len(paths))]
    own = docs.select(*[docs[k].alias(h) for k, h in zip(paths, held, strict=True)], F.coalesce(docs["text"], F.lit("")).alias("text"))
    addressed = own.withColumn("blob", content_address(F.col("text")))
    fresh = materialize(scan_blobs(addressed.select("blob", "text"), ledger, rules), "secret-ledger")
    whole = fresh if ledger is None else fresh.unionByName(ledger.select("blob", "found"))
    met = findings(addressed.select(*held, "blob"), whole, rules)
    return met.select(*[F.col(h).alias(k) for k, h in zip(paths, held, strict=True)], "blob", "found"), fresh


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = scan_documents(load(spark, sf_dir, "documents"))
    ranks = [i for i, r in enumerate(RULES) if r.base]
    base = F.filter("found", lambda s: s["rank"] <= max(ranks))
    count_of = lambda i: F.size(F.filter("found", lambda s: s["rank"] == i)).cast("long")
    counts = [count_of(i).alias(f"n_{RULES[i].kind}") for i in ranks]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of ``text`` that ``MASKED`` finds replaced by ``mask``, and n_chars recounted.

    Overlapping spans are merged first.  Every column, row and clean text stays
    as it was, whatever the names of other columns: null and empty texts hold
    no secret, null ids and repeated rows are rows like any other, and an empty
    table stays empty.
    """
    names = docs.columns
    inner = [f"__k{i}" for i in range(len(names))]
    text = F.col(inner[names.index("text")])
    work = docs.select(*[docs[k].alias(h) for k, h in zip(names, inner, strict=True)], content_address(docs["text"]).alias("blob"))
    fresh = materialize(scan_blobs(work.select("blob", F.coalesce(text, F.lit("")).alias("text")), rules=MASKED), "secret-ledger")
    out = work.join(hits(fresh, MASKED), "blob", "left")

    def step(acc: Column, s: Column) -> Column:
        apart = s["start"] >= acc["at"]
        more = F.concat(acc["out"], F.when(apart, F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))).otherwise(F.lit("")))
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), more.alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    masked = F.aggregate("found", zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    out = out.withColumn("masked", F.when(F.col("found").isNotNull(), masked))
    columns = []
    for name, held in zip(names, inner, strict=True):
        if name == "text":
            columns.append(F.coalesce("masked", held).alias(name))
        elif name == "n_chars":
            columns.append(F.when(F.col("masked").isNull(), F.col(held)).otherwise(F.length("masked").cast(docs.schema[name].dataType)).alias(name))
        else:
            columns.append(F.col(held).alias(name))
    return out.select(*columns)
