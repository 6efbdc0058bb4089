"""Entry points as plans: score a prediction file, compose five sources, run the decoding stack."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers, parse
from ..functions.text import normalize, number_12g, shortest_number, synonym
from ..operators import metrics, relational, tasks, votes
from ..schemas import GOLD, NUMERIC_RELATIONS, PREDICTION, relation_dimension
from ..sources.files import jsonl

KEYS = ["SubjectEntity", "Relation"]


def score_files(spark: SparkSession, predictions: str, gold: str) -> DataFrame:
    """Macro, micro and statistics by relation and over all, as the scorer prints them."""
    pred = jsonl(spark, predictions, PREDICTION).withColumn("pos", F.monotonically_increasing_id())
    return metrics.result_table(metrics.score_pairs(pred, jsonl(spark, gold, GOLD), relation_dimension(spark)))


def sample_items(raw: DataFrame, protocol: str = "legacy-cot") -> DataFrame:
    """(keys, sample, kind, status, pos, item, key) of every sample's items; samples without items have one row without."""
    numeric = F.col("Relation").isin(*NUMERIC_RELATIONS)
    each = raw.select(*KEYS, F.posexplode("raw_samples").alias("sample", "text"))
    seen = each.withColumn("s", parse.classify(F.col("text"), F.col("Relation"), numeric, protocol))
    rows = seen.select(*KEYS, "sample", "s.kind", "s.status", "s.answer", F.posexplode_outer("s.items").alias("pos", "item"))
    return rows.withColumn("key", synonym(normalize("item")))


def aggregate_samples(raw: DataFrame, relations: DataFrame, profile: str = "robust", city_votes: int = 5, width: float = 0.20) -> DataFrame:
    """(keys, ObjectEntities): each relation's rule over its samples.

    Names: share of all samples (``legacy``) or of valid ones (``robust``,
    ``relation-v1``); a single name needs ``city_votes``; numbers take the
    median (``legacy``) or the densest cluster's.
    """
    rows = sample_items(raw)
    kind = relational.bounded(relations)
    n = rows.groupBy(*KEYS).agg(F.count_distinct("sample").alias("n_all"), F.count_distinct(F.when(F.col("kind") == "entity", F.col("sample"))).alias("n_valid"))
    named = rows.join(kind.where("kind = 'string'").select("Relation"), "Relation", "left_semi")
    table = votes.vote_table(named, KEYS, "key", "sample", "pos", "item").join(n, KEYS).join(kind, "Relation")
    denominator = F.col("n_all") if profile == "legacy" else F.greatest("n_valid", F.lit(1))
    theta = F.col("theta_all") if profile == "legacy" else F.col("theta_valid")
    lists = table.where(~F.col("single") & (F.col("votes") / denominator >= theta))
    lists = lists.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("first_seen", "display"))).alias("o")).select(*KEYS, F.transform("o", lambda x: x["display"]).alias("o"))
    one = votes.support_gate(table.where("single"), KEYS, city_votes).select(*KEYS, F.array("display").alias("o"))
    values = rows.join(kind.where("kind = 'numeric'").select("Relation"), "Relation", "left_semi").where("pos = 0").withColumn("v", numbers.positive(numbers.parse_number(F.col("item"))))
    pure = values.groupBy(*KEYS).agg(F.collect_list(F.when(parse.is_pure_number(F.col("answer")), F.col("v"))).alias("vs"), F.collect_list("v").alias("loose"))
    chosen = F.when(F.size("vs") > 0, numbers.median(F.col("vs")) if profile == "legacy" else numbers.densest_cluster(F.col("vs"), width)["value"]).otherwise(numbers.median(F.col("loose")))
    number = pure.select(*KEYS, F.lit(None).cast("array<string>").alias("o"), chosen.alias("v")).where("v IS NOT NULL")
    found = lists.unionByName(one).withColumn("v", F.lit(None).cast("double")).unionByName(number)
    out = raw.select(*KEYS).join(found, KEYS, "left").withColumn("text", shortest_number("v"))
    return out.select(*KEYS, F.coalesce("o", F.when(F.col("text").isNotNull(), F.array("text")), F.expr("cast(array() as array<string>)")).alias("ObjectEntities"))


def compose(reference: DataFrame, sources: dict[str, DataFrame], by_relation: dict[str, str]) -> DataFrame:
    """(keys, pos, ObjectEntities): each relation's answer from the source it is routed to; all sources must cover their rows."""
    if reference.where(~F.col("Relation").isin(*by_relation)).limit(1).count():
        raise relational.ContractError("a relation has no route")
    # each source is read once, for all its relations
    routed = [rows.where(F.col("Relation").isin(*[r for r, n in by_relation.items() if n == name])) for name, rows in sources.items() if name in by_relation.values()]
    met = relational.required_join(reference.select(*KEYS, "pos"), {"routed sources": reduce(lambda a, b: a.unionByName(b), routed)}, KEYS)
    return met.orderBy("pos")


def area_quantile(raw: DataFrame, q: float = 0.55) -> DataFrame:
    """(keys, ObjectEntities): the index quantile of the pure positive values of a numeric key."""
    rows = sample_items(raw).where("pos = 0").where(parse.is_pure_number(F.col("answer"))).withColumn("v", numbers.positive(numbers.parse_number(F.col("item"))))
    got = rows.where("v IS NOT NULL").groupBy(*KEYS).agg(numbers.index_quantile(F.collect_list("v"), q).alias("v"))
    return got.select(*KEYS, F.array(number_12g("v")).alias("ObjectEntities"))


# Votes and width of the relation-aware composition.
CITY_VOTES, CAPACITY_WIDTH = 6, 0.30


def plain_items(raw: DataFrame) -> DataFrame:
    """(keys, sample, answer, pos, item, key) of the items that each sample's answer lists, without any repair."""
    numeric = F.col("Relation").isin(*NUMERIC_RELATIONS)
    each = raw.select(*KEYS, F.posexplode("raw_samples").alias("sample", "text")).withColumn("answer", parse.after_think(F.col("text")))
    rows = each.select(*KEYS, "sample", "answer", F.posexplode_outer(parse.items(F.col("answer"), numeric)).alias("pos", "item"))
    return rows.withColumn("key", synonym(normalize("item")))


def _required(reference: DataFrame, relation: Sequence[str], source: DataFrame, name: str) -> DataFrame:
    """``source`` for the keys of some relations, all of which it must have once."""
    keys = reference.where(F.col("Relation").isin(*relation)).select(*KEYS)
    return relational.required_join(keys, {name: source.where(F.col("Relation").isin(*relation))}, KEYS)


def relation_aware(reference: DataFrame, border_raw: DataFrame, sampled: DataFrame, second: DataFrame, awards: DataFrame, relations: DataFrame, corroborate: bool = True, city_votes: int = CITY_VOTES, capacity_cluster: bool = True, area_quantile_: float | None = None) -> DataFrame:
    """(keys, pos, ObjectEntities) of ``reference(keys, pos)`` from five sources, each relation by its own rule.

    Borders: shares of valid samples.  Companies: four votes, or three that a
    second system names too.  Cities: the gated plurality, or that a second
    system names first.  Areas: the median of pure numbers, or an index
    quantile of them; capacities: the densest cluster's.  Awards as predicted.
    A key that a source lacks, or has twice, is an error, as is a relation
    without a rule; without corroboration the second system is not read.
    """
    known = ("countryLandBordersCountry", "companyTradesAtStockExchange", "personHasCityOfDeath", "hasArea", "hasCapacity", "awardWonBy")
    unknown = reference.where(~F.col("Relation").isin(*known)).limit(1).collect()
    if unknown:
        raise relational.ContractError(f"unknown relation {unknown[0]['Relation']}")
    borders, company, city, area, capacity, award = known
    rows = plain_items(_required(reference, (company, city, area, capacity), sampled, "samples"))
    named = rows.where(F.col("Relation").isin(company, city))
    table = votes.vote_table(named, KEYS, "key", "sample", "pos", "item")
    told = second.limit(0)
    if corroborate:
        told = _required(reference, (company, city), second, "second system")
    other = told.select(*KEYS, F.posexplode("ObjectEntities").alias("pos", "display")).withColumn("item", synonym(normalize("display")))
    own = lambda objects: tasks.drop_self(F.col("SubjectEntity"), objects)

    listed = votes.corroborated_list(table.where(F.col("Relation") == company), other.where(F.col("Relation") == company), KEYS)
    place = other.groupBy(*KEYS, "item").agg(F.min("pos").alias("at"))
    # by order seen, then promotions in the second system's order
    listed = listed.join(place, [*KEYS, "item"], "left").groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("promoted", F.when(F.col("promoted"), F.col("at")).alias("at"), "first_seen", "display"))).alias("o"))
    companies = listed.select(*KEYS, own(F.transform("o", lambda x: x["display"])).alias("ObjectEntities"))
    cities = votes.corroborated_single(table.where(F.col("Relation") == city), other.where(F.col("Relation") == city), KEYS, city_votes).select(*KEYS, own(F.array("display")).alias("ObjectEntities"))
    valid = aggregate_samples(_required(reference, (borders,), border_raw, "border samples"), relations, "relation-v1")

    values = rows.where(F.col("Relation").isin(area, capacity)).where("pos = 0").withColumn("v", numbers.positive(numbers.parse_number(F.col("item"))))
    packed = values.groupBy(*KEYS).agg(F.collect_list(F.when(parse.is_pure_number(F.col("answer")), F.col("v"))).alias("pure"), F.collect_list("v").alias("loose"))
    best = F.when(F.size("pure") > 0, F.col("pure")).otherwise(F.col("loose"))
    chosen = F.when(F.lit(capacity_cluster) & (F.col("Relation") == capacity), numbers.densest_cluster(best, CAPACITY_WIDTH)["value"]).otherwise(numbers.median(best))
    if area_quantile_ is not None:
        chosen = F.when((F.col("Relation") == area) & (F.size("pure") > 0), numbers.index_quantile(F.col("pure"), area_quantile_)).otherwise(chosen)
    digits = packed.where(F.size(best) > 0).select(*KEYS, F.lit(None).cast("array<string>").alias("ObjectEntities"), chosen.alias("n"))
    awarded = _required(reference, (award,), awards, "award predictions").select(*KEYS, "ObjectEntities")
    named_parts = reduce(lambda a, b: a.unionByName(b), [companies, cities, valid, awarded]).withColumn("n", F.lit(None).cast("double"))
    # numbers become text last, in one place; quantiles have twelve digits at most
    met = reference.select(*KEYS, "pos").join(named_parts.unionByName(digits), KEYS, "left").withColumns({"plain": shortest_number("n"), "short": number_12g("n")})
    ranked = F.lit(area_quantile_ is not None) & (F.col("Relation") == area)
    number = F.when(F.col("n").isNotNull(), F.array(F.when(ranked, F.col("short")).otherwise(F.col("plain"))))
    return met.select(*KEYS, "pos", F.coalesce("ObjectEntities", number, F.expr("cast(array() as array<string>)")).alias("ObjectEntities"))
