"""Scoring: alias-aware matching, precision, recall and F1, macro and micro averages, diagnostics."""

from __future__ import annotations

import bisect
import math
from collections import deque
from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers
from ..functions.text import normalize
from .relational import bounded


def last_of_each(rows: DataFrame, keys: Sequence[str], pos: str) -> DataFrame:
    """One row a key, the one with the largest position."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(pos)).alias("r")).select(*keys, "r.*")


def scores(n_pred: Column, n_gold: Column, hits: Column) -> list[Column]:
    """Precision, recall and F1; nothing predicted is precise, nothing to find is recalled."""
    p = F.when(n_pred == 0, F.lit(1.0)).otherwise(F.try_divide(hits.cast("double"), n_pred))
    r = F.when(n_gold == 0, F.lit(1.0)).otherwise(F.try_divide(hits.cast("double"), n_gold))
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return [p.alias("p"), r.alias("r"), f1.alias("f1")]


def _augment(edges: pd.DataFrame) -> int:
    """A maximum matching of (pred, gold) edges, by augmenting paths without recursion."""
    near: dict[int, list[int]] = {}
    for p, g in zip(edges["pred"], edges["gold"], strict=True):
        near.setdefault(p, []).append(g)
    owner: dict[int, int] = {}
    holds: dict[int, int] = {}
    for start in near:
        came: dict[int, int] = {}
        queue = [start]
        end = None
        while queue and end is None:
            p = queue.pop(0)
            for g in near[p]:
                if g not in came:
                    came[g] = p
                    if g not in owner:
                        end = g
                        break
                    queue.append(owner[g])
        while end is not None:
            p = came[end]
            before = holds.get(p)
            owner[end], holds[p] = p, end
            end = before
    return len(owner)


def string_hits(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, hits): most gold entities that predictions can be paired with, one to one.

    ``edges(keys, pred, gold)`` are distinct ids.  Where no prediction and no
    gold entity has two edges the count is the answer; only keys with an
    ambiguous edge go through a matching, each a handful of rows.
    """
    per = edges.withColumn("dp", F.count(F.lit(1)).over(Window.partitionBy(*keys, "pred"))).withColumn("dg", F.count(F.lit(1)).over(Window.partitionBy(*keys, "gold")))
    marked = per.withColumn("hard", F.max((F.col("dp") > 1) & (F.col("dg") > 1)).over(Window.partitionBy(*keys)))
    # an edge alone on one side never blocks another, so counting the smaller side is exact
    easy = marked.where(~F.col("hard")).withColumn("pair", F.when(F.col("dp") > 1, F.struct(F.lit(0).alias("side"), F.col("pred").alias("id"))).otherwise(F.struct(F.lit(1).alias("side"), F.col("gold").alias("id")))).groupBy(*keys).agg(F.count_distinct("pair").alias("hits"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in edges.schema if f.name in keys)

    def solve(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, _augment(rows))], columns=[*keys, "hits"])

    hard = marked.where("hard").select(*keys, "pred", "gold").groupBy(*keys).applyInPandas(solve, f"{fields}, hits long")
    return easy.unionByName(hard)


def alias_edges(preds: DataFrame, golds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, pred, gold) where a prediction's form is one of a gold entity's alias forms: an equi-join, no nested loop.

    ``preds(keys, form)`` are distinct; ``golds(keys, gold, form)`` has a row an alias.
    """
    ids = preds.withColumn("pred", F.row_number().over(Window.partitionBy(*keys).orderBy("form")))
    return ids.join(golds, [*keys, "form"]).select(*keys, "pred", "gold").distinct()


def _first_fits(preds: Sequence[float | None], golds: Sequence[float | None], tolerance: float) -> int:
    """How many predictions, in order, find a free gold value within the tolerance, each taking the first in gold order.

    The gold values that fit are a stretch of the sorted ones, and all negative
    ones; a tree of least free positions finds the first of a stretch, so the
    work grows as n log n (tolerances of half and more look at every value).
    """
    # zero never matches, and neither do values that are not finite
    positions: dict[float, list[int]] = {}
    for i, g in enumerate(golds):
        if g is not None and math.isfinite(g) and g != 0:
            positions.setdefault(g, []).append(i)
    values = sorted(positions)
    queues = [deque(positions[v]) for v in values]
    size, none = len(values), len(golds)
    least = [none] * size + [q[0] for q in queues]
    for node in range(size - 1, 0, -1):
        least[node] = min(least[2 * node], least[2 * node + 1])
    negative = bisect.bisect_left(values, 0.0)

    def first(start: int, stop: int) -> int:
        found, start, stop = none, start + size, stop + size
        while start < stop:
            if start % 2:
                found, start = min(found, least[start]), start + 1
            if stop % 2:
                stop -= 1
                found = min(found, least[stop])
            start, stop = start // 2, stop // 2
        return found

    hits = 0
    for p in preds:
        if p is None or p != p:
            continue
        fits = lambda g, p=p: abs(p - g) / g <= tolerance
        if 0 <= tolerance < 0.5:
            # beyond half or twice the prediction nothing fits, and nearer the difference is exact: the test changes once on either side
            middle = max(negative, bisect.bisect_left(values, p))
            start = bisect.bisect_left(values, True, negative, middle, key=fits)
            stop = bisect.bisect_left(values, True, middle, size, key=lambda g: not fits(g))
            at = min(first(0, negative), first(start, stop))
        else:
            at = min((q[0] for g, q in zip(values, queues, strict=True) if q and fits(g)), default=none)
        if at == none:
            continue
        hits += 1
        place = bisect.bisect_left(values, golds[at])
        queues[place].popleft()
        node = place + size
        least[node] = queues[place][0] if queues[place] else none
        while node > 1:
            node //= 2
            least[node] = min(least[2 * node], least[2 * node + 1])
    return hits


def numeric_hits(preds: Column, golds: Column, tolerance: float = 0.05) -> Column:
    """One-to-one first-fit matches in prediction order, then gold order, within the tolerance of the gold value; null of a null array."""

    @F.arrow_udf("int")
    def hits(preds: pa.Array, golds: pa.Array) -> pa.Array:
        return pa.array([None if p is None or g is None else _first_fits(p, g, tolerance) for p, g in zip(preds.to_pylist(), golds.to_pylist(), strict=True)], pa.int32())

    return hits(preds, golds)


def score_pairs(pred: DataFrame, gold: DataFrame, relations: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """(SubjectEntity, Relation, p, r, f1, tp, total_pred, total_gold) of every gold row.

    ``gold`` has ObjectEntities as lists of aliases; ``pred`` has flat lists and
    ``pos``: missing rows are empty, extra rows are ignored, of repeated keys the
    last counts.  Predictions are compared by normal form, each form once; a
    numeric gold value is its first alias.
    """
    keys = ["SubjectEntity", "Relation"]
    told = last_of_each(pred, keys, "pos").select(*keys, "ObjectEntities")
    base = gold.select(*keys, F.col("ObjectEntities").alias("gold")).join(told.withColumnRenamed("ObjectEntities", "pred"), keys, "left").withColumn("pred", F.coalesce("pred", F.expr("cast(array() as array<string>)")))
    base = base.join(bounded(relations.select("Relation", "kind")), "Relation", "left")
    each = base.select(*keys, "kind", F.posexplode_outer("pred").alias("at", "item"))
    forms = each.where(F.col("item").isNotNull()).withColumn("form", normalize("item")).groupBy(*keys, "form").agg(F.min(F.struct("at", "item")).alias("first"))
    counts = forms.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_pred"), F.array_sort(F.collect_list("first")).alias("firsts"))
    aliases = base.where("kind = 'string'").select(*keys, F.posexplode("gold").alias("gold", "alias_list")).select(*keys, "gold", F.explode("alias_list").alias("alias")).select(*keys, "gold", normalize("alias").alias("form")).distinct()
    hits = string_hits(alias_edges(forms.select(*keys, "form"), aliases, keys), keys)
    joined = base.join(counts, keys, "left").join(hits, keys, "left")
    values = F.filter(F.transform(F.coalesce("firsts", F.expr("cast(array() as array<struct<at:int,item:string>>)")), lambda x: numbers.parse_number(x["item"])), lambda v: v.isNotNull())
    targets = F.filter(F.transform("gold", lambda a: numbers.parse_number(F.try_element_at(a, F.lit(1)))), lambda v: v.isNotNull())
    numeric = F.col("kind") == "numeric"
    tp = F.when(numeric, numeric_hits(F.when(numeric, values), F.when(numeric, targets), tolerance)).otherwise(F.coalesce("hits", F.lit(0))).cast("long")
    out = joined.select(*keys, tp.alias("tp"), F.coalesce("total_pred", F.lit(0)).alias("total_pred"), F.size("gold").cast("long").alias("total_gold"))
    return out.select(*keys, *scores(F.col("total_pred"), F.col("total_gold"), F.col("tp")), "tp", "total_pred", "total_gold")


def macro(pairs: DataFrame, group: str = "Relation") -> DataFrame:
    """Means by group and, as a row without a group, over all pairs (not over groups)."""
    return pairs.rollup(group).agg(F.avg("p").alias("p"), F.avg("r").alias("r"), F.avg("f1").alias("f1"), F.count(F.lit(1)).alias("n_pairs"))


def micro(pairs: DataFrame, group: str = "Relation") -> DataFrame:
    """Scores of the summed counts by group and over all."""
    sums = pairs.rollup(group).agg(F.sum("tp").alias("tp"), F.sum("total_pred").alias("total_pred"), F.sum("total_gold").alias("total_gold"))
    return sums.select(group, *scores(F.col("total_pred"), F.col("total_gold"), F.col("tp")), "tp", "total_pred", "total_gold")


def prediction_statistics(pairs: DataFrame, group: str = "Relation") -> DataFrame:
    return pairs.rollup(group).agg(F.avg("total_pred").alias("avg_preds"), F.count_if(F.col("total_pred") == 0).alias("n_empty"))


def result_table(pairs: DataFrame, digits: int = 3) -> DataFrame:
    """Macro, micro and statistics side by side, rounded half to even."""
    tag = lambda df, t: df.select("Relation", *[F.col(c).alias(f"{t}_{c}") for c in ("p", "r", "f1")])
    a, b, c = tag(macro(pairs), "macro"), tag(micro(pairs), "micro"), prediction_statistics(pairs)
    same = lambda x, y: x["Relation"].eqNullSafe(y["Relation"])
    out = a.join(b, same(a, b)).drop(b["Relation"]).join(c, same(a, c)).drop(c["Relation"])
    return out.select("Relation", *[F.bround(F.col(x), digits).alias(x) for x in out.columns if x not in ("Relation", "n_empty")], "n_empty")


def confusion(rows: DataFrame, truth: str, told: str) -> DataFrame:
    return rows.groupBy(truth, told).agg(F.count(F.lit(1)).alias("n"))


def correlation(rows: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation by key from one pass of sums; null where a side is constant."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    sums = rows.where(a.isNotNull() & b.isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(a).alias("sx"), F.sum(b).alias("sy"), F.sum(a * a).alias("sxx"), F.sum(b * b).alias("syy"), F.sum(a * b).alias("sxy"))
    return sums.select(*keys, "n", numbers.pearson(*[F.col(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")]).alias("corr"))


def uniquely_correct(rows: DataFrame, keys: Sequence[str], agent: str, correct: str) -> DataFrame:
    """(agent, n_unique): keys that this agent alone got right."""
    right = rows.where(F.col(correct))
    alone = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(agent).alias(agent)).where("n = 1")
    return alone.groupBy(agent).agg(F.count(F.lit(1)).alias("n_unique"))


def oracle_bound(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, hits): true positives of the best subset of candidates, which is the size of a maximum matching."""
    return string_hits(edges, keys)


def ordered(pairs: DataFrame) -> DataFrame:
    """Scores by relation, then subject, as the scorer lists them."""
    return pairs.orderBy("Relation", "SubjectEntity")


def macro_f1(pred: DataFrame, gold: DataFrame, relations: DataFrame) -> dict[str | None, float]:
    """Macro F1 by relation, and under None over all pairs, of a prediction set."""
    return {r["Relation"]: r["f1"] for r in macro(score_pairs(pred, gold, relations)).collect()}


def null_false_positives(candidates: DataFrame, gold: DataFrame, keys: Sequence[str], agent: str = "agent") -> DataFrame:
    """(agent, n): keys without an answer for which the agent proposes one; ``gold(keys, n_gold)``."""
    empty = gold.where("n_gold = 0").select(*keys)
    return candidates.select(*keys, agent).distinct().join(empty, list(keys), "left_semi").groupBy(agent).agg(F.count(F.lit(1)).alias("n"))


def cardinality_diagnostics(commitments: DataFrame, gold: DataFrame, keys: Sequence[str], agent: str = "agent") -> DataFrame:
    """(agent, n, correct, unknown, accuracy, confusion map) of agents' cardinality labels against ``gold(keys, n_gold)``."""
    truth = F.when(F.col("n_gold") == 0, "ZERO").when(F.col("n_gold") == 1, "ONE").otherwise("MANY")
    told = F.coalesce("cardinality", F.lit("UNKNOWN"))
    cells = commitments.join(gold, list(keys)).groupBy(agent, truth.alias("truth"), told.alias("told")).agg(F.count(F.lit(1)).alias("n"))
    some = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    out = cells.groupBy(agent).agg(F.sum("n").alias("n"), some(F.col("truth") == F.col("told")).alias("correct"), some(F.col("told") == "UNKNOWN").alias("unknown"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat_ws("->", "truth", "told"), "n")))).alias("confusion"))
    return out.withColumn("accuracy", F.col("correct") / F.col("n"))


def correctness_correlations(rows: DataFrame, keys: Sequence[str], agent: str, correct: str) -> DataFrame:
    """(left, right, n, corr) of every two agents' correctness over the keys both have; null where one is constant.

    Agents are few: each key's row holds them all, and makes its pairs itself.
    """
    packed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(agent).alias("a"), F.col(correct).cast("double").alias("c")))).alias("r"))
    left = packed.select("r", F.posexplode("r").alias("i", "l"))
    pairs = left.select("l", F.explode(F.slice("r", F.col("i") + 2, F.size("r"))).alias("x")).select(F.col("l.a").alias("left"), F.col("x.a").alias("right"), F.col("l.c").alias("u"), F.col("x.c").alias("v"))
    return correlation(pairs, "u", "v", ["left", "right"])
