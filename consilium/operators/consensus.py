"""Answers from several agents' commitments and proposals.

``proposals(keys, agent, key, item, value, support)`` has a row for each
candidate of each agent (``value`` is the item's positive number, or null);
``commitments(keys, agent, existence, cardinality, samples)`` a row for each
agent; ``context(keys, kind, single, nullable)`` a row for each key.  Answers
are lists of items, empty where an agent or a majority says there is none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import positive
from ..functions.text import number_12g
from . import stats

_NONE = "cast(array() as array<string>)"


def _listed(rows: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """(keys, objects): each key's items in order."""
    packed = F.array_sort(F.collect_list(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], "item")))
    return rows.groupBy(*keys).agg(packed.alias("p")).select(*keys, F.transform("p", lambda x: x["item"]).alias("objects"))


def _first(rows: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """(keys, objects): each key's first item in order."""
    least = F.min(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], "item"))
    return rows.groupBy(*keys).agg(least.alias("f")).select(*keys, F.array("f.item").alias("objects"))


def _numeric(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, objects): the median of positive values, each repeated by its support, as text."""
    valued = rows.withColumn("v", positive(F.col("value"))).where("v IS NOT NULL").withColumn("times", F.greatest(F.lit(1), F.col("support")).cast("long"))
    middle = stats.replicated_median(valued, keys, "v", "times", "m")
    return middle.withColumn("text", number_12g(F.col("m").cast("double"))).select(*keys, F.array("text").alias("objects"))


def _every_key(context: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    return context.select(*keys).join(found, list(keys), "left").select(*keys, F.coalesce("objects", F.expr(_NONE)).alias("objects"))


def self_consistency(support: DataFrame, totals: DataFrame, context: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, objects) by one agent's own samples, without any other signal.

    Numbers: the median weighted by support.  A single name: the first by
    support, then order seen, unless as many samples say there is none.  Lists:
    names that half of the samples back.  ``support(keys, key, item, value,
    support, first_seen)``; ``totals(keys, n_samples, n_none)``.
    """
    rows = support.join(context, list(keys)).join(totals, list(keys))
    order = (-F.col("support"), F.col("first_seen"))
    number = _numeric(rows.where("kind = 'numeric' AND support > 0"), keys)
    named = rows.where("kind <> 'numeric'")
    top = named.where("single").groupBy(*keys, "n_none").agg(F.max("support").alias("most"))
    one = _first(named.where("single").join(top.where("n_none < most").select(*keys), list(keys), "left_semi"), keys, *order)
    many = _listed(named.where(~F.col("single") & (F.col("support") >= F.greatest(F.lit(1), F.ceil(F.col("n_samples") / 2)))), keys, *order)
    return _every_key(context, number.unionByName(one).unionByName(many), keys)


def exists_by_vote(commitments: DataFrame, context: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(keys, by, there): whether more agents say YES than NO; always, for a relation that cannot be empty."""
    votes = commitments.groupBy(*keys, *by).agg(F.count_if(F.col("existence") == "YES").alias("yes"), F.count_if(F.col("existence") == "NO").alias("no"))
    return votes.join(context.select(*keys, "nullable"), list(keys)).select(*keys, *by, (~F.col("nullable") | (F.col("yes") > F.col("no"))).alias("there"))


def agent_answers(proposals: DataFrame, commitments: DataFrame, context: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, agent, objects): each agent's own answer behind its existence commitment; lists need half of its samples."""
    each = [*keys, "agent"]
    gate = exists_by_vote(commitments, context, keys, ["agent"]).join(commitments.select(*each, "samples"), each)
    rows = proposals.where("support > 0").join(gate.where("there"), each).join(context, list(keys))
    order = (-F.col("support"), F.col("key"))
    number = _numeric(rows.where("kind = 'numeric'"), each)
    one = _first(rows.where("kind <> 'numeric' AND single"), each, *order)
    many = _listed(rows.where("kind <> 'numeric' AND NOT single").where(F.col("support") >= F.greatest(F.lit(1), F.ceil(F.col("samples") / 2))), each, *order)
    return _every_key(commitments, number.unionByName(one).unionByName(many), each)


def majority_cardinality(commitments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, cardinality): the label that most agents chose, UNKNOWN where none is usable or several share the lead."""
    label = F.coalesce("cardinality", F.lit("UNKNOWN"))
    counts = commitments.groupBy(*keys, label.alias("label")).agg(F.count(F.lit(1)).alias("n"))
    usable = F.col("label") != "UNKNOWN"
    lead = counts.groupBy(*keys).agg(F.max(F.when(usable, F.col("n"))).alias("most"), F.collect_list(F.when(usable, F.struct("n", "label"))).alias("all"))
    winners = F.filter("all", lambda x: x["n"] == F.col("most"))
    return lead.select(*keys, F.when(F.size(winners) == 1, F.get(winners, F.lit(0))["label"]).otherwise(F.lit("UNKNOWN")).alias("cardinality"))


def consensus(proposals: DataFrame, commitments: DataFrame, context: DataFrame, keys: Sequence[str], reviews: DataFrame | None = None, use_cardinality: bool = False) -> DataFrame:
    """(keys, objects): names that two agents propose or support and no review contradicts; numbers by the median of all.

    ``reviews(keys, key, agent, label)`` say SUPPORTED or CONTRADICTED.  With
    ``use_cardinality`` the majority label ZERO empties an answer and ONE cuts
    it to its first.  Names go by agents behind them, proposers, support, key.
    """
    there = exists_by_vote(commitments, context, keys)
    size = majority_cardinality(commitments, keys) if use_cardinality else there.select(*keys, F.lit("UNKNOWN").alias("cardinality"))
    open_ = context.join(there.where("there").select(*keys), list(keys), "left_semi").join(size, list(keys), "left").where("cardinality IS NULL OR cardinality <> 'ZERO'")
    rows = proposals.where("support > 0").join(open_, list(keys))
    number = _numeric(rows.where("kind = 'numeric'").groupBy(*keys, "key").agg(F.first("value").alias("value"), F.sum("support").alias("support")), keys)
    held = rows.where("kind <> 'numeric'").groupBy(*keys, "key", "single", "cardinality").agg(F.min_by("item", "agent").alias("item"), F.collect_set("agent").alias("proposers"), F.sum("support").alias("support"))
    if reviews is not None:
        told = reviews.groupBy(*keys, "key").agg(F.collect_set(F.when(F.col("label") == "SUPPORTED", F.col("agent"))).alias("backers"), F.count_if(F.col("label") == "CONTRADICTED").alias("against"))
        held = held.join(told, [*keys, "key"], "left")
    else:
        held = held.withColumns({"backers": F.expr(_NONE), "against": F.lit(0)})
    agents = F.size(F.array_union("proposers", F.coalesce("backers", F.expr(_NONE))))
    good = held.withColumn("agents", agents).where((F.col("agents") >= 2) & (F.coalesce("against", F.lit(0)) == 0))
    order = (-F.col("agents"), -F.size("proposers"), -F.col("support"), F.col("key"))
    one = F.col("single") | F.coalesce(F.col("cardinality") == "ONE", F.lit(False))
    found = number.unionByName(_first(good.where(one), keys, *order)).unionByName(_listed(good.where(~one), keys, *order))
    return _every_key(context, found, keys)


def candidate_union(proposals: DataFrame, context: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, objects): every candidate once, by proposers, then support, then key."""
    held = proposals.groupBy(*keys, "key").agg(F.min_by("item", "agent").alias("item"), F.count_distinct("agent").alias("agents"), F.sum("support").alias("support"))
    return _every_key(context, _listed(held, keys, -F.col("agents"), -F.col("support"), F.col("key")), keys)


#: Policies as data: the reviews and cardinality labels each uses beside the proposals.
POLICIES = {
    "proposal_consensus": (False, False),
    "proposal_cardinality_consensus": (False, True),
    "blind_review_consensus": (True, False),
    "blind_review_cardinality_consensus": (True, True),
}


def by_policy(policy: str, proposals: DataFrame, commitments: DataFrame, context: DataFrame, keys: Sequence[str], reviews: DataFrame | None = None) -> DataFrame:
    """(keys, objects) under a named policy: ``agent:<id>``, ``candidate_union`` or one of ``POLICIES``; any other is an error."""
    if policy.startswith("agent:"):
        agent = policy.removeprefix("agent:")
        own = agent_answers(proposals, commitments.where(F.col("agent") == agent), context, keys)
        return _every_key(context, own.drop("agent"), keys)
    if policy == "candidate_union":
        return candidate_union(proposals, context, keys)
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy}")
    use_reviews, use_cardinality = POLICIES[policy]
    if use_reviews and reviews is None:
        raise ValueError(f"{policy} needs reviews")
    return consensus(proposals, commitments, context, keys, reviews if use_reviews else None, use_cardinality)


def numeric_centres(proposals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, agent, centre): each agent's median of positive values, each repeated by its support, once at least."""
    valued = proposals.withColumn("v", positive(F.col("value"))).where("v IS NOT NULL").withColumn("times", F.greatest(F.lit(1), F.col("support")).cast("long"))
    return stats.replicated_median(valued, [*keys, "agent"], "v", "times", "centre")


def commitment_probability(available: Column, probabilities: Column, label: Column | str) -> Column:
    """An agent's probability of a label; 0 where the commitment or the label is missing."""
    name = F.lit(label) if isinstance(label, str) else label
    return F.when(F.coalesce(available, F.lit(False)), F.coalesce(F.try_element_at(probabilities, name), F.lit(0.0))).otherwise(F.lit(0.0))


def selected_keys(outputs: Column, agent: str, required: bool = False) -> Column:
    """The distinct non-empty keys an agent selected, of a map from agent to keys; a missing agent is an error where required."""
    found = F.try_element_at(outputs, F.lit(agent))
    absent = F.raise_error(F.lit(f"required output missing: {agent}")).cast("array<string>") if required else F.expr(_NONE)
    return F.when(found.isNull(), absent).otherwise(F.array_sort(F.array_distinct(F.filter(found, lambda k: k.isNotNull() & (k != "")))))


def choice_winner(probabilities: Column, choices: Column) -> Column:
    """The listed choice of highest probability, the earliest on ties; choices without one count 0."""
    scored = F.transform(choices, lambda c, i: F.struct(F.coalesce(F.try_element_at(probabilities, c), F.lit(0.0)).alias("p"), (-i).alias("order"), c.alias("choice")))
    return F.array_max(scored)["choice"]


def averaged_choices(variants: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, probabilities): each choice's mean score over the variants that score it, as shares that sum to 1.

    ``variants(keys, variant, choice, score)`` has one row for each choice of
    each code permutation.
    """
    mean = variants.groupBy(*keys, "choice").agg(F.avg("score").alias("s"))
    top = Window.partitionBy(*keys)
    raised = mean.withColumn("e", F.exp(F.col("s") - F.max("s").over(top)))
    share = raised.withColumn("p", F.col("e") / F.sum("e").over(top))
    return share.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("choice", "p")))).alias("probabilities"))
