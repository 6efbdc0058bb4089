"""Votes over sampled answers.

Every operator takes one row an item, with the key columns named by the
caller, the sample it came from and its place in it (``pos``), so that
first-seen order survives any shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers


def vote_table(rows: DataFrame, keys: Sequence[str], item: str, sample: str, pos: str, display: str | None = None, samples: bool = False) -> DataFrame:
    """(keys, item, votes, first_seen, display[, in_samples]): one vote for each sample that names the item.

    The surface first seen is displayed; rank is by votes, then first seen.
    Blank items are no votes.  Two partial aggregations, no window over raw rows.
    """
    shown = display or item
    seen = F.struct(F.col(sample), F.col(pos))
    once = rows.where(F.col(item).isNotNull() & (F.col(item) != "")).groupBy(*keys, F.col(item).alias("item"), F.col(sample).alias("sample"))
    once = once.agg(F.min(F.struct(seen.alias("at"), F.col(shown).alias("shown"))).alias("first"))
    more = [F.array_sort(F.collect_list("sample")).alias("in_samples")] if samples else []
    return once.groupBy(*keys, "item").agg(F.count(F.lit(1)).alias("votes"), F.min("first").alias("first"), *more).select(*keys, "item", "votes", F.col("first.at").alias("first_seen"), F.col("first.shown").alias("display"), *(["in_samples"] if samples else []))


def ranked(votes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``votes`` with ``rank`` by votes, then first seen."""
    return votes.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("votes"), "first_seen")))


def threshold_vote(votes: DataFrame, totals: DataFrame, keys: Sequence[str], share: float | Column, denominator: str = "n") -> DataFrame:
    """Items that at least ``share`` of a key's samples name; ``totals(keys, n)`` counts all or only valid samples."""
    met = votes.join(totals, list(keys))
    return met.where(F.col("votes") / F.greatest(F.col(denominator), F.lit(1)) >= share)


def plurality(votes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The item with most votes of each key, the first seen on ties; one aggregation."""
    best = F.min(F.struct((-F.col("votes")).alias("order"), "first_seen", "item", "display"))
    return votes.groupBy(*keys).agg(best.alias("w")).select(*keys, F.col("w.item").alias("item"), (-F.col("w.order")).alias("votes"), F.col("w.display").alias("display"))


def plurality_or_none(rows: DataFrame, keys: Sequence[str], item: str, sample: str, pos: str, display: str | None = None) -> DataFrame:
    """As ``plurality`` over raw rows, where a sample without an item votes for having none; a winning none has a null item."""
    shown = display or item
    told = F.when(F.col(item) != "", F.col(item))
    marked = rows.withColumn("__item", F.coalesce(told, F.lit("\0"))).withColumn("__shown", F.when(told.isNotNull(), F.col(shown)))
    won = plurality(vote_table(marked, keys, "__item", sample, pos, "__shown"), keys)
    return won.withColumn("item", F.when(F.col("item") != "\0", F.col("item"))).withColumn("display", F.when(F.col("item").isNotNull(), F.col("display")))


def support_gate(votes: DataFrame, keys: Sequence[str], least: int) -> DataFrame:
    """The plurality item of each key, if at least ``least`` samples name it."""
    return plurality(votes, keys).where(F.col("votes") >= least)


def ties(votes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys whose highest vote several items share, with those items sorted."""
    top = votes.withColumn("top", F.max("votes").over(Window.partitionBy(*keys))).where("votes = top")
    return top.groupBy(*keys, "votes").agg(F.count(F.lit(1)).alias("n_tied"), F.array_sort(F.collect_list("item")).alias("tied")).where("n_tied > 1")


def supported(votes: DataFrame, keys: Sequence[str], least: int, numeric: bool = False) -> DataFrame:
    """Items with ``least`` votes; a numeric key gives its single highest item and nothing on a tie."""
    good = votes.where(F.col("votes") >= least)
    if not numeric:
        return good
    top = good.withColumn("rank", F.rank().over(Window.partitionBy(*keys).orderBy(F.desc("votes"))))
    return top.where("rank = 1").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where("n = 1").drop("rank", "n")


def thresholds(n: int) -> dict[str, int]:
    """Votes that any, a majority, two thirds and all of ``n`` samples are."""
    return {"any": 1, "majority": n // 2 + 1, "two_thirds": -(-2 * n // 3), "unanimous": n}


def fuse_sources(rows: DataFrame, keys: Sequence[str], item: str, source: str, pos: str, least: int) -> DataFrame:
    """(keys, item, n_sources, display_rank): items that at least ``least`` different sources name, in first-seen order."""
    seen = F.min(F.struct(source, pos)).alias("first")
    got = rows.where(F.col(item).isNotNull() & (F.col(item) != "")).groupBy(*keys, F.col(item).alias("item")).agg(F.count_distinct(source).alias("n_sources"), seen)
    got = got.where(F.col("n_sources") >= least)
    return got.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("first"))).drop("first")


def fuse_numbers(rows: DataFrame, keys: Sequence[str], value: str, least: int) -> DataFrame:
    """The plain median of the sources' values where at least ``least`` gave one."""
    got = rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(value).alias("n_values"), numbers.median(F.collect_list(value)).alias("value"))
    return got.where(F.col("n_values") >= least)


#: Fusion arms as data: the least number of sources each needs, of k.
ARMS = {"union": lambda k: 1, "agreement": lambda k: 2, "majority": lambda k: k // 2 + 1, "unanimous": lambda k: k}


def corroborated_list(votes: DataFrame, other: DataFrame, keys: Sequence[str], strong: int = 4, weak: int = 3) -> DataFrame:
    """Items with ``strong`` votes, or ``weak`` and named by a second system ``other(keys, item)``; by votes, then promotions."""
    named = other.select(*keys, "item").distinct().withColumn("corroborated", F.lit(True))
    met = votes.join(named, [*keys, "item"], "left").withColumn("corroborated", F.coalesce("corroborated", F.lit(False)))
    kept = met.where((F.col("votes") >= strong) | (F.col("votes") >= weak) & F.col("corroborated"))
    return kept.withColumn("promoted", F.col("votes") < strong)


def corroborated_single(votes: DataFrame, other: DataFrame, keys: Sequence[str], least: int = 5, promote: int = 2) -> DataFrame:
    """(keys, item, display, promoted): the gated plurality item, else the same one where a second system names it first and ``promote`` samples do.

    ``other(keys, pos, item, display)``; a promoted item shows the second system's surface.
    """
    top = plurality(votes, keys)
    first = other.groupBy(*keys).agg(F.min(F.struct("pos", "item", "display")).alias("o")).select(*keys, F.col("o.item").alias("__item"), F.col("o.display").alias("__shown"))
    met = top.join(first, list(keys), "left").withColumn("promoted", F.col("votes") < least)
    good = ~F.col("promoted") | (F.col("__item") == F.col("item")) & (F.col("votes") >= promote)
    return met.where(good).select(*keys, "item", F.when(F.col("promoted"), F.col("__shown")).otherwise(F.col("display")).alias("display"), "promoted")


def evidence_summary(samples: DataFrame, keys: Sequence[str], votes: DataFrame, top: int | None = None) -> DataFrame:
    """Counts by kind and status of each key's samples, and its first ``top`` candidates by rank."""
    count = samples.groupBy(*keys, "kind", "status").agg(F.count(F.lit(1)).alias("n"))
    kinds = count.groupBy(*keys).agg(
        F.sum("n").alias("n_samples"),
        F.sum(F.when(F.col("kind") == "entity", F.col("n")).otherwise(0)).alias("n_entity"),
        F.sum(F.when(F.col("kind") == "explicit-abstention", F.col("n")).otherwise(0)).alias("n_abstained"),
        F.sum(F.when(F.col("kind") == "invalid", F.col("n")).otherwise(0)).alias("n_invalid"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat_ws("/", "kind", "status"), "n")))).alias("by_status"),
    )
    best = ranked(votes, keys)
    best = best.where(F.col("rank") <= top) if top else best
    lists = best.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", "item", "votes"))).alias("candidates"))
    return kinds.join(lists, list(keys), "left")


def dispatch(relation: Column, votes_share: Column, threshold: dict[str, float], default: float) -> Column:
    """A vote share against the threshold of its relation."""
    least = F.create_map(*[F.lit(x) for pair in threshold.items() for x in pair])
    return votes_share >= F.coalesce(F.try_element_at(least, relation), F.lit(default))


def counters(rows: DataFrame, *by: str) -> DataFrame:
    """(by, n): how many rows have each status, layer, route or divergence."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def pool_coverage(pool: DataFrame, subject: str = "SubjectEntity", group: str = "Relation") -> DataFrame:
    """(group, n_rows, n_subjects, fewest, most): examples of each relation and of its subjects."""
    per = pool.groupBy(group, subject).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(group).agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_subjects"), F.min("n").alias("fewest"), F.max("n").alias("most"))


def route_evidence(items: DataFrame, statuses: DataFrame, keys: Sequence[str], item: str, generation: str, pos: str, display: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Each item's generations, (keys, item, display, generations), and (keys, none_generations): those that say outright there is none.

    ``statuses(keys, generation, status)`` has a row for each generation.
    """
    found = vote_table(items, keys, item, generation, pos, display, samples=True).select(*keys, "item", "display", F.col("in_samples").alias("generations"))
    none = statuses.groupBy(*keys).agg(F.array_sort(F.collect_set(F.when(F.col("status") == "explicit_none", F.col(generation)))).alias("none_generations"))
    return found, none


def ties_with_traces(rows: DataFrame, keys: Sequence[str], item: str, sample: str, pos: str, trace: str, top: int = 2) -> DataFrame:
    """(keys, votes, tied): the first items of samples that share a key's highest vote, each with its first ``top`` traces.

    A sample without an item votes for none, shown as a null item; keys with a
    single leader are left out.  A null trace is no trace.
    """
    told = F.when(F.col(item) != "", F.col(item))
    each = rows.groupBy(*keys, sample).agg(F.min(F.struct(pos, told.alias("item"), F.col(trace).alias("trace"))).alias("f")).select(*keys, sample, "f.item", "f.trace")
    held = each.groupBy(*keys, "item").agg(F.count(F.lit(1)).alias("votes"), F.min(sample).alias("first"), F.array_sort(F.collect_list(F.when(F.col("trace").isNotNull(), F.struct(sample, "trace")))).alias("t"))
    per = held.groupBy(*keys).agg(F.max("votes").alias("votes"), F.collect_list(F.struct("votes", "first", "item", F.transform(F.slice("t", 1, top), lambda x: x["trace"]).alias("traces"))).alias("all"))
    lead = F.array_sort(F.transform(F.filter("all", lambda x: x["votes"] == F.col("votes")), lambda x: F.struct(x["first"], x["item"], x["traces"])))
    tied = per.withColumn("lead", lead).where(F.size("lead") > 1)
    return tied.select(*keys, "votes", F.transform("lead", lambda x: F.struct(x["item"].alias("item"), x["traces"].alias("traces"))).alias("tied"))


def parsed_items(samples: DataFrame, keys: Sequence[str], parser: Callable[[Column, Column], Column], text: str = "text", relation: str = "Relation") -> DataFrame:
    """(keys, sample, pos, item) of every sample by a caller's parser, a function from text and relation to an array of items.

    The parser may be column expressions or an Arrow function, see ``python_parser``.
    """
    return samples.select(*keys, "sample", F.posexplode(parser(F.col(text), F.col(relation))).alias("pos", "item"))


def python_parser(parse: Callable[[str, str], Sequence[str]]) -> Callable[[Column, Column], Column]:
    """A plain Python parser as one for ``parsed_items``: called in Arrow batches, null texts give no items."""

    @F.arrow_udf("array<string>")
    def run(texts: pa.Array, relations: pa.Array) -> pa.Array:
        return pa.array([[] if t is None else [str(i) for i in parse(t, r)] for t, r in zip(texts.to_pylist(), relations.to_pylist(), strict=True)], pa.list_(pa.string()))

    return run


def strict_dispatch(relation: Column, by_relation: dict[str, Column]) -> Column:
    """Each relation's own expression; a relation without one is an error."""
    out = None
    for name, value in by_relation.items():
        out = F.when(relation == name, value) if out is None else out.when(relation == name, value)
    kind = F.raise_error(F.concat(F.lit("unknown relation "), relation))
    return out.otherwise(kind)
