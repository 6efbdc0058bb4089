"""Decoding: actions, frozen linear models, guarded switches, proofs and the layer trace.

A layer is a DataFrame function from (keys, objects, ...) to (keys, objects,
detail); a row that cannot be judged keeps its objects and says why.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers
from ..schemas import FAMILIES

EPSILON = 1e-12
# Proof thresholds, margins and support rules.
MIN_FRACTION = MIN_ADVANTAGE = 2 / 3
MIN_SIMILARITY = 0.5
SUPPORT_K, SUPPORT_N, UNANIMOUS = 7, 10, 3
CARDINALITY_MARGIN = 0.2
NUMERIC_MARGINS = {"hasArea": 0.02, "hasCapacity": 0.0}
NUMERIC_ENABLED = ("hasArea",)

_EMPTY = "cast(array() as array<string>)"


# -- linear models -----------------------------------------------------------------


def logistic_score(features: Column, coefficients: Column) -> Column:
    return numbers.sigmoid(numbers.dot(features, coefficients))


def ridge_score(features: Column, mean: Column, scale: Column, coefficients: Column) -> Column:
    """Standardised features (the first, an intercept, as it is) times coefficients."""
    rest = numbers.standardised(features, mean, scale)
    return numbers.dot(F.concat(F.slice(features, 1, 1), F.slice(rest, 2, F.size(rest))), coefficients)


def checked_features(*columns: Column) -> Column:
    """An array of finite doubles; any other value is an error."""
    out = F.array(*[c.cast("double") for c in columns])
    bad = F.exists(out, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(bad, F.raise_error(F.lit("non-finite feature")).cast("array<double>")).otherwise(out)


def gram(rows: DataFrame, xs: Sequence[str], y: str, weight: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, i, j, value): weighted sums of products of features, and of features with y (j = -1); one aggregation."""
    w = F.col(weight) if weight else F.lit(1.0)
    cells = [(i, j, F.sum(w * F.col(a) * F.col(b))) for i, a in enumerate(xs) for j, b in enumerate(xs) if i <= j] + [(i, -1, F.sum(w * F.col(a) * F.col(y))) for i, a in enumerate(xs)]
    wide = rows.groupBy(*keys).agg(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), c.alias("value")) for i, j, c in cells]).alias("cells"))
    return wide.select(*keys, F.inline("cells"))


def fit_ridge(rows: DataFrame, xs: Sequence[str], y: str, weight: str | None = None, l2: float = 10.0) -> np.ndarray:
    """Coefficients for ``xs`` (the first is the intercept, free of the penalty); products in Spark, a small solve here."""
    n = len(xs)
    a, b = np.zeros((n, n)), np.zeros(n)
    for r in gram(rows, xs, y, weight).collect():
        if r.j < 0:
            b[r.i] = r.value
        else:
            a[r.i, r.j] = a[r.j, r.i] = r.value
    penalty = np.eye(n) * l2
    penalty[0, 0] = 0
    return np.linalg.lstsq(a + penalty, b, rcond=None)[0]


def fit_residual_ridge(rows: DataFrame, xs: Sequence[str], y: str, weight: str, l2: float = 10.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(coefficients, mean, scale): ridge on standardised ``xs`` after an intercept free of the penalty; weights sum to the rows.

    No row, a weight that is not above zero or a value that is not finite is an error.
    """
    finite = lambda c: F.coalesce(F.abs(F.col(c).cast("double")) < float("inf"), F.lit(False))
    wrong = F.count_if(~functools.reduce(lambda a, b: a & b, [finite(c) for c in (*xs, y, weight)]) | (F.col(weight) <= 0))
    n, total, bad, *sums = rows.agg(F.count(F.lit(1)), F.sum(weight), wrong, *[F.sum(F.col(weight) * F.col(x)) for x in xs]).first()
    if not n or bad:
        raise ValueError("invalid ridge rows")
    mean = np.array(sums) / total
    variance = np.array(rows.agg(*[F.sum(F.col(weight) * (F.col(x) - float(m)) ** 2) for x, m in zip(xs, mean, strict=True)]).first()) / total
    scale = np.where(variance > 1e-12, np.sqrt(variance), 1.0)
    design = [F.lit(1.0).alias("z0")] + [((F.col(x) - float(m)) / float(s)).alias(f"z{i}") for i, (x, m, s) in enumerate(zip(xs, mean, scale, strict=True), 1)]
    scaled = rows.select(*design, F.col(y).alias("y"), (F.col(weight) * float(n / total)).alias("w"))
    return fit_ridge(scaled, [f"z{i}" for i in range(len(xs) + 1)], "y", "w", l2), mean, scale


def fit_logistic(rows: DataFrame, xs: Sequence[str], y: str, weight: str | None = None, l2: float = 2.0, rounds: int = 60, tolerance: float = 1e-9) -> np.ndarray:
    """Newton steps over Spark sums; at most ``rounds`` passes, fewer once the step is small."""
    beta = np.zeros(len(xs))
    w = F.col(weight) if weight else F.lit(1.0)
    for _ in range(rounds):
        score = numbers.sigmoid(sum((F.col(x) * float(c) for x, c in zip(xs, beta, strict=True)), F.lit(0.0)))
        cells = [F.sum(w * score * (1 - score) * F.col(a) * F.col(b)) for i, a in enumerate(xs) for b in xs[i:]] + [F.sum(w * (F.col(y) - score) * F.col(a)) for a in xs]
        got = rows.agg(F.array(*cells).alias("c")).first()["c"]
        h, k = np.zeros((len(xs),) * 2), 0
        for i in range(len(xs)):
            for j in range(i, len(xs)):
                h[i, j] = h[j, i] = got[k]
                k += 1
        pull = np.full(len(xs), l2)
        pull[0] = 0
        step = np.linalg.lstsq(h + np.diag(pull) + np.eye(len(xs)) * 1e-9, np.array(got[k:]) - pull * beta, rcond=None)[0]
        beta += step
        if np.abs(step).max() < tolerance:
            break
    return beta


def fit_by_relation(rows: DataFrame, l2: float = 2.0) -> DataFrame:
    """(Relation, coefficients) from ``rows(Relation, x array, y, weight)``: sums over all relations in one pass a round."""
    from .models import fit_logistic_by

    width = rows.select(F.max(F.size("x"))).first()[0] or 0
    xs = [f"x{i}" for i in range(width)]
    wide = rows.select("Relation", "y", "weight", *[F.get("x", F.lit(i)).alias(x) for i, x in enumerate(xs)])
    beta = fit_logistic_by(wide, ["Relation"], xs, "y", "weight", l2)
    return rows.sparkSession.createDataFrame([(k[0], b.tolist()) for k, b in beta.items()], "Relation string, coefficients array<double>")


# -- actions and set utilities -------------------------------------------------------


def actions(control: Column, candidates: Column) -> Column:
    """All answers one edit away: keep, empty, replace by each, add each, drop each; equal sets once, the first stays.

    Token arrays in, an array of sorted token arrays out.
    """
    fresh = F.array_except(candidates, control)
    keep = F.array(F.array_sort(F.array_distinct(control)))
    nothing = F.array(F.expr(_EMPTY))
    replace = F.transform(candidates, lambda c: F.array(c))
    add = F.transform(fresh, lambda c: F.array_sort(F.array_union(control, F.array(c))))
    drop = F.transform(control, lambda c: F.array_sort(F.array_except(control, F.array(c))))
    return F.array_distinct(F.concat(keep, nothing, replace, add, drop))


def prefix_utility(ranked: DataFrame, keys: Sequence[str], probability: str, tie: str, expected: str) -> DataFrame:
    """(keys, size, utility): the prefix of candidates by probability with the best expected F1, the shorter on ties."""
    w = Window.partitionBy(*keys).orderBy(F.desc(probability), tie)
    run = ranked.withColumn("size", F.row_number().over(w).cast("long")).withColumn("mass", F.sum(probability).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    run = run.withColumn("utility", F.try_divide(2.0 * F.col("mass"), F.col("size") + F.col(expected)))
    return run.groupBy(*keys).agg(F.max(F.struct("utility", (-F.col("size")).alias("neg"))).alias("b")).select(*keys, (-F.col("b.neg")).alias("size"), F.col("b.utility").alias("utility"))


def set_utility(mass: Column, size: Column, expected: Column) -> Column:
    return F.coalesce(F.try_divide(2.0 * mass, size + expected), F.lit(0.0))


def cardinality_shares(scores: Column) -> Column:
    """One-vs-rest scores as shares that sum to 1."""
    whole = numbers.total(F.map_values(scores))
    return F.transform_values(scores, lambda k, v: v / whole)


def guarded(baseline: Column, proposed: Column, baseline_utility: Column, proposed_utility: Column, margin: float = CARDINALITY_MARGIN) -> Column:
    """Proposed objects only where they beat the baseline by more than the margin."""
    return F.when(baseline_utility + margin >= proposed_utility, baseline).otherwise(proposed)


def decode_cardinality(scored: DataFrame, context: DataFrame, keys: Sequence[str], margin: float = CARDINALITY_MARGIN) -> DataFrame:
    """(keys, objects, used_baseline): the best set by kind of relation, behind the guard.

    ``scored(keys, key, item, probability)``; ``context(keys, kind, single,
    nullable, zero, expected, baseline array<key>)`` with the probability of no
    answer and the expected size.
    """
    lists = scored.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("probability")).alias("order"), "key", "item", "probability"))).alias("ranked"))
    base = context.join(lists, list(keys), "left").withColumn("ranked", F.coalesce("ranked", F.expr("cast(array() as array<struct<order:double,key:string,item:string,probability:double>>)")))
    one = (F.col("kind") == "numeric") | F.col("single")
    top = F.try_element_at("ranked", F.lit(1))
    mass = lambda xs: numbers.total(F.transform(xs, lambda x: x["probability"]))
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size("ranked"), F.lit(1))), lambda k: F.struct(set_utility(mass(F.slice("ranked", 1, k)), k.cast("double"), F.col("expected")).alias("utility"), (-k).alias("neg")))
    best = F.array_max(prefixes)
    base = base.withColumn("top", top).withColumn("best", best)
    utility = F.when(one, F.coalesce("top.probability", F.lit(0.0))).otherwise(F.when(F.size("ranked") > 0, F.col("best.utility")).otherwise(F.lit(0.0)))
    size = F.when(F.size("ranked") == 0, 0).when(one, 1).otherwise(-F.col("best.neg"))
    absent = F.col("nullable") & (F.col("zero") >= utility)
    proposed = F.when(absent, F.slice("ranked", 1, 0)).otherwise(F.slice("ranked", 1, size))
    chosen = F.filter("ranked", lambda x: F.array_contains("baseline", x["key"]))
    worth = lambda xs: F.when(F.size(xs) == 0, F.when(F.col("nullable"), F.col("zero")).otherwise(F.lit(0.0))).when(one, F.array_max(F.transform(xs, lambda x: x["probability"]))).otherwise(set_utility(mass(xs), F.size(xs).cast("double"), F.col("expected")))
    base = base.withColumn("proposed", proposed).withColumn("proposed_utility", worth(F.col("proposed"))).withColumn("kept", chosen)
    known = F.when(F.size("baseline") == 0, worth(F.slice("ranked", 1, 0))).when(F.size("kept") == 0, F.lit(0.0)).otherwise(worth(F.col("kept")))
    base = base.withColumn("baseline_utility", known)
    used = F.col("baseline_utility") + margin >= F.col("proposed_utility")
    return base.select(*keys, F.when(used, F.col("baseline")).otherwise(F.transform("proposed", lambda x: x["key"])).alias("objects"), used.alias("used_baseline"), "proposed_utility", "baseline_utility")


# -- numeric options -----------------------------------------------------------------


def numeric_options(nodes: DataFrame, baseline: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, value, kinds, place): legal outputs of a numeric key, equal ones merged, in order of first mention.

    The baseline, each node, and of each node's 5 % neighbourhood the weighted
    median and weighted geometric mean.  ``nodes(keys, pos, value, weight)``.
    """
    packed = nodes.where(F.col("value") > 0).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "value", "weight"))).alias("nodes"))
    row = baseline.select(*keys, F.col("value").alias("base")).join(packed, list(keys), "left").withColumn("nodes", F.coalesce("nodes", F.expr("cast(array() as array<struct<pos:int,value:double,weight:double>>)")))
    option = lambda v, kind: F.struct(v.alias("value"), F.lit(kind).alias("kind"))

    def around(anchor: Column) -> Column:
        near = F.filter("nodes", lambda n: numbers.within_right(n["value"], anchor["value"]))
        weight = numbers.total(F.transform(near, lambda n: n["weight"]))
        mean = F.exp(numbers.total(F.transform(near, lambda n: F.ln(n["value"]) * n["weight"])) / weight)
        return F.when(weight > 0, F.array(option(weighted_median(near), "cluster_median"), option(mean, "cluster_geomean"))).otherwise(F.expr("cast(array() as array<struct<value:double,kind:string>>)"))

    every = F.concat(F.array(option(F.col("base"), "baseline")), F.transform("nodes", lambda n: option(n["value"], "node")), F.flatten(F.transform("nodes", around)))
    each = row.select(*keys, F.posexplode(every).alias("at", "o")).select(*keys, "at", "o.*").where("value > 0")
    # options equal on the log scale are one: rounding to the scale's resolution makes that a group
    same = F.round(F.ln("value") * 1e9)
    return each.groupBy(*keys, same.alias("cell")).agg(F.min_by("value", "at").alias("value"), F.array_sort(F.collect_set("kind")).alias("kinds"), F.min("at").alias("place")).drop("cell")


def weighted_median(entries: Column) -> Column:
    """The first value, in order, at which the running weight reaches half; ``entries`` of (value, weight)."""
    ordered = F.array_sort(F.transform(entries, lambda e: F.struct(e["value"].alias("value"), e["weight"].alias("weight"))))
    half = numbers.total(F.transform(ordered, lambda e: e["weight"])) / 2

    def step(acc: Column, e: Column) -> Column:
        run = acc["run"] + e["weight"]
        return F.struct(run.alias("run"), F.when(acc["out"].isNull() & (run >= half), e["value"]).otherwise(acc["out"]).alias("out"))

    return F.aggregate(ordered, F.struct(F.lit(0.0).alias("run"), F.lit(None).cast("double").alias("out")), step, lambda acc: acc["out"])


def switch_numeric(options: DataFrame, keys: Sequence[str], margin: Column | float) -> DataFrame:
    """(keys, value, used_baseline) from (keys, value, kinds, place, probability): the best option, if better by more than the margin."""
    best = options.groupBy(*keys).agg(
        F.max(F.struct("probability", (-F.col("place")).alias("order"), "value")).alias("best"),
        F.min(F.when(F.array_contains("kinds", "baseline"), F.struct("place", "probability", "value"))).alias("base"),
    )
    moves = F.col("best.probability") - F.col("base.probability") > margin
    return best.select(*keys, F.when(moves, F.col("best.value")).otherwise(F.col("base.value")).alias("value"), (~moves).alias("used_baseline"))


def capacity_options(events: DataFrame, groups: DataFrame, keys: Sequence[str], families: Sequence[str] = FAMILIES) -> DataFrame:
    """(keys, grp, value, members, rates, family_fraction, event_rate): each group's log-medoid and, by family and over all, the share of generations it holds.

    ``events(keys, id, family, value)`` has every generation, failures with a
    null value; ``groups(keys, value, grp)``.
    """
    totals = events.groupBy(*keys, "family").agg(F.count(F.lit(1)).alias("n"))
    held = events.where(F.col("value").isNotNull()).join(groups, [*keys, "value"])
    per = held.groupBy(*keys, "grp", "family").agg(F.count(F.lit(1)).alias("hits")).join(totals, [*keys, "family"]).withColumn("rate", F.col("hits") / F.col("n"))
    rates = per.groupBy(*keys, "grp").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("family", "rate")))).alias("rates"), (F.count(F.lit(1)) / float(len(families))).alias("family_fraction"))
    medoid = held.groupBy(*keys, "grp").agg(numbers.log_medoid(F.collect_list("value")).alias("value"), F.array_sort(F.collect_set("value")).alias("members"), F.count(F.lit(1)).alias("__hits"))
    whole = totals.groupBy(*keys).agg(F.sum("n").alias("__all"))
    return medoid.join(rates, [*keys, "grp"]).join(whole, list(keys)).withColumn("event_rate", F.col("__hits") / F.col("__all")).drop("__hits", "__all")


# -- support rules and proofs ----------------------------------------------------------


def support_rule(support: DataFrame, answers: DataFrame, keys: Sequence[str], least: int = SUPPORT_K) -> DataFrame:
    """(keys, objects, changed): items that ``least`` generations back; a numeric key is replaced by its single highest, names are added.

    ``support(keys, key, item, support)``; ``answers(keys, kind, objects)``.
    """
    top = support.where(F.col("support") >= least).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("support")).alias("order"), "key"))).alias("s"))
    row = answers.join(top, list(keys), "left").withColumn("s", F.coalesce("s", F.expr("cast(array() as array<struct<order:bigint,key:string>>)")))
    first = F.try_element_at("s", F.lit(1))
    single = (F.size("s") > 0) & (F.size(F.filter("s", lambda x: x["order"] == first["order"])) == 1)
    new = F.when(F.col("kind") == "numeric", F.when(single, F.array(first["key"])).otherwise(F.col("objects"))).otherwise(F.array_union("objects", F.transform("s", lambda x: x["key"])))
    return row.select(*keys, "kind", new.alias("objects"), (new != F.col("objects")).alias("changed"))


def unanimous_rule(supply: DataFrame, answers: DataFrame, keys: Sequence[str], n: int = UNANIMOUS) -> DataFrame:
    """A value that all ``n`` samples give and no route had replaces the answer, if it is the only one."""
    one = supply.where((F.col("support") == n) & F.col("novel")).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("key")).where("n = 1").drop("n")
    return answers.join(one, list(keys), "left").select(*keys, F.when(F.col("key").isNotNull(), F.array("key")).otherwise(F.col("objects")).alias("objects"), F.col("key").isNotNull().alias("changed"))


def eligible(challenger: Column, incumbent: Column, arm: str = "strict_proof_graph") -> Column:
    """Whether a challenger's metrics prove it against the incumbent's; arms differ in which guards they add."""
    c, i = (lambda m: lambda k: m[k])(challenger), (lambda m: lambda k: m[k])(incumbent)
    ok = (c("exact_family_fraction") + EPSILON >= MIN_FRACTION) & (c("exact_family_fraction") > i("exact_family_fraction") + EPSILON) & (c("minimum_similarity") + EPSILON >= MIN_SIMILARITY)
    proofs = ("loose_proof_graph", "strict_proof_graph", "strict_proof_graph_cardinality_shifted")
    if arm in ("support_cardinality", *proofs):
        ok = ok & (c("exact_cardinality_match_rate") > i("exact_cardinality_match_rate") + EPSILON) & (c("existence_match_rate") + EPSILON >= i("existence_match_rate"))
    if arm in ("support_nonexpanding", *proofs):
        ok = ok & (c("set_size") <= i("set_size") + EPSILON)
    if arm in proofs[1:]:
        ok = ok & (c("exact_family_fraction") - i("exact_family_fraction") + EPSILON >= MIN_ADVANTAGE)
    return ok


METRICS = ("exact_family_fraction", "minimum_similarity", "exact_cardinality_match_rate", "mean_similarity", "within_family_exact_rate_mean", "independent_similarity")


def prove(hyps: DataFrame, keys: Sequence[str], arm: str = "strict_proof_graph") -> DataFrame:
    """(keys, tokens, changed) from hypotheses with metrics: the best proven challenger, else the incumbent."""
    metric = F.struct(*METRICS, "existence_match_rate", "set_size")
    inc = hyps.where("is_incumbent").select(*keys, F.col("tokens").alias("kept"), metric.alias("i"))
    met = hyps.withColumn("c", metric).join(inc, list(keys))
    order = F.struct(*METRICS, (-F.col("set_size")).alias("neg"), "tokens")
    won = met.where(~F.col("is_incumbent") & eligible(F.col("c"), F.col("i"), arm)).groupBy(*keys).agg(F.max(order).alias("w"))
    return inc.join(won, list(keys), "left").select(*keys, F.coalesce("w.tokens", "kept").alias("tokens"), F.col("w").isNotNull().alias("changed"))


SHIFTED = "strict_proof_graph_cardinality_shifted"


def shifted_rates(records: DataFrame, keys: Sequence[str], group: str = "Relation") -> DataFrame:
    """(keys, cards, n): of every key the sizes that its relation's next key, in order, states; the first key's after the last.

    A control: sizes keep their distribution and lose their subject.  Sizes
    travel as counts, of which a key has few.  A relation of one key cannot be
    shifted, which is an error.
    """
    own = records.groupBy(*keys, "exact_cardinality").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("exact_cardinality", "n"))).alias("cards"))
    alone = own.groupBy(group).agg(F.count(F.lit(1)).alias("n")).where("n < 2")
    if alone.limit(1).count():
        raise ValueError(f"cannot shift {alone.first()[0]}: it has one key")
    w = Window.partitionBy(group).orderBy(*keys)
    first = F.first("cards").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    moved = own.withColumn("cards", F.coalesce(F.lead("cards").over(w), first))
    return moved.withColumn("n", F.aggregate(F.map_values("cards"), F.lit(0).cast("long"), lambda a, x: a + x))


def with_shifted_rates(hyps: DataFrame, shifted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``hyps`` with the size and existence rates of the shifted records instead of their own."""
    met = hyps.drop("exact_cardinality_match_rate", "existence_match_rate").join(shifted, list(keys))
    size = F.col("set_size").cast("int")
    same = F.coalesce(F.try_element_at("cards", size), F.lit(0))
    empty = F.coalesce(F.try_element_at("cards", F.lit(0)), F.lit(0))
    return met.withColumns({"exact_cardinality_match_rate": same / F.col("n"), "existence_match_rate": F.when(size == 0, empty).otherwise(F.col("n") - empty) / F.col("n")}).drop("cards", "n")


def proof_stage(hyps: DataFrame, records: DataFrame, invalid: DataFrame, keys: Sequence[str], arm: str = "strict_proof_graph", identity: Sequence[str] = ()) -> DataFrame:
    """(keys, tokens, changed, fallback): ``prove`` behind the gates of the stage.

    Keys in ``invalid`` (broken evidence) and relations in ``identity`` keep
    their incumbent; the shifted arm proves with the next key's sizes.
    """
    used = with_shifted_rates(hyps, shifted_rates(records, keys), keys) if arm == SHIFTED else hyps
    won = prove(used, keys, arm)
    kept = hyps.where("is_incumbent").select(*keys, F.col("tokens").alias("__kept"))
    bad = invalid.select(*keys).distinct().withColumn("__bad", F.lit(True))
    met = won.join(kept, list(keys)).join(bad, list(keys), "left")
    same = F.coalesce(F.col("__bad"), F.lit(False)) | F.col("Relation").isin(*identity) if identity else F.coalesce(F.col("__bad"), F.lit(False))
    return met.select(*keys, F.when(same, F.col("__kept")).otherwise(F.col("tokens")).alias("tokens"), (F.col("changed") & ~same).alias("changed"), F.coalesce(F.col("__bad"), F.lit(False)).alias("fallback"))


def numeric_proof(challenger: Column, incumbent: Column, members: Column, families: Sequence[str] = FAMILIES) -> Column:
    """A single value proven by all families, two thirds of them more than the incumbent has, with members within 5 % of each other.

    Structs of (value, family_fraction, rates).
    """
    coherent = (F.size(members) > 0) & F.forall(members, lambda a: F.forall(members, lambda b: F.abs(a - b) / F.greatest(F.abs(b), F.lit(EPSILON)) <= 0.05 + EPSILON))
    everyone = F.forall(F.array(*[F.lit(f) for f in families]), lambda f: F.coalesce(F.try_element_at(challenger["rates"], f), F.lit(0.0)) > 0)
    positive = numbers.positive(challenger["value"]).isNotNull() & numbers.positive(incumbent["value"]).isNotNull()
    return positive & coherent & (challenger["family_fraction"] + EPSILON >= MIN_FRACTION) & (challenger["family_fraction"] - incumbent["family_fraction"] + EPSILON >= MIN_ADVANTAGE) & everyone


def prove_numbers(options: DataFrame, keys: Sequence[str], families: Sequence[str] = FAMILIES) -> DataFrame:
    """(keys, value, changed, eligible): the best option proven against the incumbent, else the incumbent.

    ``options(keys, value, is_incumbent, members, rates, family_fraction,
    event_rate)`` has one incumbent a key; a key without one is left out.  Of
    the proven, most families win, then the least and the mean family rate (to
    twelve digits, so that the order of summing does not matter), the rate over
    all events, nearness to the incumbent and the smaller value.
    """
    option = F.struct("value", "family_fraction", "rates")
    inc = options.where("is_incumbent").select(*keys, option.alias("i"))
    met = options.withColumn("c", option).join(inc, list(keys))
    rate = F.transform(F.array(*map(F.lit, families)), lambda f: F.coalesce(F.try_element_at(F.col("rates"), f), F.lit(0.0)))
    order = F.struct(
        "family_fraction",
        F.round(F.array_min(rate), 12).alias("least"),
        F.round(numbers.total(rate) / len(families), 12).alias("mean"),
        "event_rate",
        (-F.abs(F.ln(F.col("value") / F.col("i.value")))).alias("near"),
        (-F.col("value")).alias("small"),
    )
    good = met.where(~F.col("is_incumbent") & numeric_proof(F.col("c"), F.col("i"), F.col("members"), families))
    won = good.groupBy(*keys).agg(F.max(order).alias("w"), F.count(F.lit(1)).alias("eligible"))
    return inc.join(won, list(keys), "left").select(*keys, F.coalesce(-F.col("w.small"), F.col("i.value")).alias("value"), F.col("w").isNotNull().alias("changed"), F.coalesce("eligible", F.lit(0)).alias("eligible"))


def edit_features(control: Column, action: Column) -> list[Column]:
    """What an edit is, apart from any evidence: which side is empty, sizes up to five, additions, removals, overlap, and whether it keeps."""
    added, dropped = F.size(F.array_except(action, control)), F.size(F.array_except(control, action))
    share = lambda n: F.least(F.lit(1.0), n / 5.0)
    return [(F.size(control) == 0).cast("double"), (F.size(action) == 0).cast("double"), share(F.size(control)), share(F.size(action)), share(added), share(dropped), numbers.jaccard(control, action), ((added == 0) & (dropped == 0)).cast("double")]


def action_rows(answers: DataFrame, candidates: DataFrame, keys: Sequence[str], features: Callable[[DataFrame], DataFrame], mean: Column, scale: Column, coefficients: Column) -> DataFrame:
    """(keys, tokens, is_keep, estimate) of all answers one edit away, each with a model's estimate of what it gains.

    ``answers(keys, objects)`` hold tokens; ``candidates(keys, token)`` may join
    them.  ``features`` adds an array column ``features`` to (keys, control,
    tokens); ``ridge_score`` weighs it after an intercept.
    """
    offered = candidates.groupBy(*keys).agg(F.array_sort(F.collect_set("token")).alias("offered"))
    met = answers.join(offered, list(keys), "left").withColumn("offered", F.coalesce("offered", F.expr(_EMPTY)))
    control = F.array_sort(F.array_distinct("objects"))
    each = met.select(*keys, control.alias("control"), F.explode(actions(F.col("objects"), F.col("offered"))).alias("tokens"))
    scored = features(each)
    with_one = F.concat(F.array(F.lit(1.0)), F.col("features"))
    unit = lambda c, v: F.concat(F.array(F.lit(v)), c)
    estimate = ridge_score(with_one, unit(mean, 0.0), unit(scale, 1.0), coefficients)
    return scored.select(*keys, "tokens", (F.col("tokens") == F.col("control")).alias("is_keep"), estimate.alias("estimate"))


def residual(action_rows: DataFrame, keys: Sequence[str], margin: float) -> DataFrame:
    """(keys, tokens, changed) from (keys, tokens, is_keep, estimate): the best action above the margin, else keep."""
    best = action_rows.groupBy(*keys).agg(F.max(F.when(~F.col("is_keep"), F.struct("estimate", (-F.size("tokens")).alias("neg"), "tokens"))).alias("b"), F.max(F.when(F.col("is_keep"), F.struct("tokens"))).alias("k"))
    moves = F.coalesce(F.col("b.estimate") > margin, F.lit(False))
    return best.select(*keys, F.when(moves, F.col("b.tokens")).otherwise(F.col("k.tokens")).alias("tokens"), moves.alias("changed"))


def ledger_veto(answers: DataFrame, ledger: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Answers that a frozen ledger (keys, objects, switched) overrules."""
    led = ledger.select(*keys, F.col("objects").alias("__led"), "switched")
    return answers.join(led, list(keys), "left").withColumn("changed", F.coalesce("switched", F.lit(False))).withColumn("objects", F.when(F.col("changed"), F.col("__led")).otherwise(F.col("objects"))).drop("__led", "switched")


Layer = Callable[[DataFrame], DataFrame]


def layered(answers: DataFrame, layers: Sequence[tuple[str, Layer]], keys: Sequence[str]) -> DataFrame:
    """``answers(keys, objects)`` after each layer in turn, with ``trace``: array<struct<policy, before, after, changed>>."""
    out = answers.withColumn("trace", F.expr("cast(array() as array<struct<policy:string,before:array<string>,after:array<string>,changed:boolean>>)"))
    for policy, layer in layers:
        new = layer(out.drop("trace")).select(*keys, F.col("objects").alias("__after"))
        out = out.join(new, list(keys), "left").withColumn("__after", F.coalesce("__after", "objects"))
        record = F.struct(F.lit(policy).alias("policy"), F.col("objects").alias("before"), F.col("__after").alias("after"), (F.col("objects") != F.col("__after")).alias("changed"))
        out = out.withColumn("trace", F.concat("trace", F.array(record))).withColumn("objects", F.col("__after")).drop("__after")
    return out


def routed(answers: DataFrame, by_relation: dict[str, Layer]) -> DataFrame:
    """Each relation through its own layer, the others as they are."""
    parts = [answers.where(~F.col("Relation").isin(*by_relation))]
    parts += [layer(answers.where(F.col("Relation") == r)).select(answers.columns) for r, layer in by_relation.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def component_support_rule(support: DataFrame, answers: DataFrame, keys: Sequence[str], least: int = SUPPORT_K) -> DataFrame:
    """(keys, objects, changed): the representative of the single component with most generations, if it has ``least`` of them.

    ``support(keys, representative, support)`` has a row for each component.
    """
    top = support.groupBy(*keys).agg(F.max("support").alias("most"), F.collect_list(F.struct("support", "representative")).alias("all"))
    lead = F.filter("all", lambda x: (x["support"] == F.col("most")) & (x["support"] >= least))
    won = top.select(*keys, F.when(F.size(lead) == 1, F.get(lead, F.lit(0))["representative"]).alias("__won"))
    met = answers.join(won, list(keys), "left").withColumn("__new", F.when(F.col("__won").isNotNull(), F.array("__won")).otherwise(F.col("objects")))
    return met.select(*keys, F.col("__new").alias("objects"), (F.col("__new") != F.col("objects")).alias("changed"))


def scored_candidates(candidates: DataFrame, features: Callable[[DataFrame], DataFrame], coefficients: Column) -> DataFrame:
    """``candidates`` with ``probability`` by a caller's feature function, which adds an array column ``features``."""
    return features(candidates).withColumn("probability", logistic_score(F.col("features"), coefficients)).drop("features")
