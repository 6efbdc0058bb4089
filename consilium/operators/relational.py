"""Joins, guards and window-shaped operators over keyed rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers


class ContractError(ValueError):
    """Rows break a structural rule that no later stage may see broken."""


def bounded(rows: DataFrame, limit: int = 4096) -> DataFrame:
    """``rows`` marked for a broadcast where a count, which stops at the limit, finds them to be few; else as they are."""
    return F.broadcast(rows) if rows.limit(limit + 1).count() <= limit else rows


def unique_keys(rows: DataFrame, keys: Sequence[str], name: str = "rows") -> DataFrame:
    """``rows`` as they are, or an error naming repeated keys."""
    twice = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys).limit(5).collect()
    if twice:
        raise ContractError(f"{name}: duplicate keys {[tuple(r) for r in twice]}")
    return rows


def coverage(rows: DataFrame, reference: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, problem) of keys that one side lacks: missing or extra."""
    left, right = rows.select(*keys).distinct(), reference.select(*keys).distinct()
    return right.join(left, list(keys), "left_anti").withColumn("problem", F.lit("missing")).unionByName(left.join(right, list(keys), "left_anti").withColumn("problem", F.lit("extra")))


def required_join(base: DataFrame, sources: dict[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """``base`` joined with every source on unique keys; keys that a source lacks are an error naming the first five."""
    out = base
    for name, source in sources.items():
        unique_keys(source, keys, name)
        lacking = base.join(source, list(keys), "left_anti").select(*keys)
        n = lacking.count()
        if n:
            raise ContractError(f"{name}: Missing {n} required rows: {[tuple(r) for r in lacking.limit(5).collect()]}")
        out = out.join(source, list(keys))
    return out


def replace_if_present(rows: DataFrame, newer: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """``rows`` with ``column`` from ``newer`` where it has the key."""
    fresh = newer.select(*keys, F.col(column).alias("__new"))
    return rows.join(fresh, list(keys), "left").withColumn(column, F.coalesce("__new", column)).drop("__new")


def rekey(rows: DataFrame, mapping: DataFrame, key: str, dropped: DataFrame | None = None) -> DataFrame:
    """``rows`` with keys renamed by ``mapping(key, new_key)`` and dropped ones left out."""
    kept = rows if dropped is None else rows.join(dropped.select(key), key, "left_anti")
    return kept.join(mapping.select(key, "new_key"), key, "left").withColumn(key, F.coalesce("new_key", key)).drop("new_key")


def phase_pivot(rows: DataFrame, keys: Sequence[str], phase: str, phases: Sequence[str], value: Column) -> DataFrame:
    """One row a key with a column for each phase: a hash aggregation instead of a scan for each lookup."""
    return rows.groupBy(*keys).agg(*[F.max(F.when(F.col(phase) == p, value)).alias(p) for p in phases])


def cyclic_next(rows: DataFrame, group: str, order: Sequence[str], value: str, out: str) -> DataFrame:
    """``rows`` with the next row's ``value`` in the group's order, the first row's after the last."""
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn(out, F.coalesce(F.lead(value).over(w), F.first(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))


def co_occurrence(rows: DataFrame, basket: Sequence[str], item: str) -> DataFrame:
    """(left, right, n): baskets that hold both items.

    Items of a basket are few (its distinct values); a pair is made once, in
    order, inside the row that holds the basket's set.
    """
    sets = rows.select(*basket, F.col(item).alias("item")).distinct().groupBy(*basket).agg(F.array_sort(F.collect_list("item")).alias("items")).where(F.size("items") > 1)
    # baskets with the same set are one row with a count before any pair is made
    counted = sets.groupBy("items").agg(F.count(F.lit(1)).alias("n"))
    left = counted.select("n", "items", F.posexplode("items").alias("i", "left"))
    pairs = left.select("n", "left", F.explode(F.slice("items", F.col("i") + 2, F.size("items"))).alias("right"))
    return pairs.groupBy("left", "right").agg(F.sum("n").alias("n"))


def fixed_groups(rows: DataFrame, part: Sequence[str], order: Sequence[str], same: Sequence[str], size: int) -> DataFrame:
    """``rows`` with ``island`` (runs of equal ``same`` columns in order) and ``chunk`` (``size`` rows of an island at most)."""
    w = Window.partitionBy(*part).orderBy(*order)
    value = F.struct(*same)
    changed = F.when(F.lag(value).over(w).eqNullSafe(value) & (F.row_number().over(w) > 1), 0).otherwise(1)
    islands = rows.withColumn("__new", changed).withColumn("island", F.sum("__new").over(w).cast("long"))
    inside = Window.partitionBy(*part, "island").orderBy(*order)
    return islands.withColumn("chunk", F.floor((F.row_number().over(inside) - 1) / size).cast("long")).drop("__new")


def equal_slices(rows: DataFrame, part: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """``rows`` with ``slice``: the i-th of n slices holds ranks floor(i * N / n) up to floor((i + 1) * N / n)."""
    w = Window.partitionBy(*part)
    ranked = rows.withColumn("__rank", F.row_number().over(w.orderBy(*order)) - 1).withColumn("__n", F.count(F.lit(1)).over(w))
    bounds = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.floor(i * F.col("__n") / n))
    return ranked.withColumn("slice", F.size(F.filter(bounds, lambda b: b <= F.col("__rank")))).drop("__rank", "__n")


def exact_then_unique_near(rows: DataFrame, known: DataFrame, keys: Sequence[str], form: str, value: str) -> DataFrame:
    """(rows, target, how): the target with the same form, else the one numeric target within 5 % if there is only one.

    The second join is keyed, so a row meets its own key's targets alone.
    """
    exact = rows.join(known.select(*keys, form, "target"), [*keys, form], "left")
    open_ = exact.where(F.col("target").isNull()).drop("target")
    near = open_.join(known.select(*keys, F.col(value).alias("__v"), F.col("target")), list(keys)).where(numbers.within_larger(F.col(value), F.col("__v")))
    one = near.groupBy(*rows.columns).agg(F.count_distinct("target").alias("n"), F.min("target").alias("target")).where("n = 1").drop("n")
    return exact.where(F.col("target").isNotNull()).withColumn("how", F.lit("exact")).select(*rows.columns, "target", "how").unionByName(one.withColumn("how", F.lit("near")).select(*rows.columns, "target", "how"))


def nearest(rows: DataFrame, known: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(rows, target): the nearest target within 5 % where it is strictly nearer than the next."""
    far = F.abs(F.col(value) - F.col("__v"))
    met = rows.join(known.select(*keys, F.col(value).alias("__v"), "target"), list(keys)).where(numbers.within_target(F.col(value), F.col("__v"))).withColumn("__far", far)
    best = met.groupBy(*rows.columns).agg(F.min(F.struct("__far", "target")).alias("b"), F.array_sort(F.collect_list("__far")).alias("all"))
    return best.where((F.size("all") == 1) | (F.get("all", F.lit(0)) < F.get("all", F.lit(1)))).select(*rows.columns, F.col("b.target").alias("target"))


def first_of_each(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")


def differing(a: DataFrame, b: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Keys on which two answer sets disagree, with both sides."""
    return a.select(*keys, F.col(column).alias("left")).join(b.select(*keys, F.col(column).alias("right")), list(keys)).where(~F.col("left").eqNullSafe(F.col("right")))


def keyed(rows: DataFrame, response: bool = False) -> DataFrame:
    """(SubjectEntity, Relation) of rows, or of responses, which name them in lower case."""
    names = ("subject", "relation") if response else ("SubjectEntity", "Relation")
    return rows.select(F.col(names[0]).alias("SubjectEntity"), F.col(names[1]).alias("Relation"))


def optional_join(base: DataFrame, other: DataFrame, keys: Sequence[str], column: str = "ObjectEntities") -> DataFrame:
    """``base`` with ``column`` of ``other``, an empty list where it lacks the key."""
    kind = other.schema[column].dataType.simpleString()
    return base.join(other.select(*keys, column), list(keys), "left").withColumn(column, F.coalesce(column, F.expr(f"cast(array() as {kind})")))


def restore_order(rows: DataFrame, inputs: DataFrame, keys: Sequence[str], pos: str = "pos") -> DataFrame:
    """``rows`` in the order of ``inputs``; a key that either side lacks, or that repeats, is an error."""
    unique_keys(rows, keys, "rows")
    unique_keys(inputs, keys, "inputs")
    wrong = coverage(rows, inputs, keys).limit(5).collect()
    if wrong:
        raise ContractError(f"coverage differs: {[tuple(r) for r in wrong]}")
    return rows.join(inputs.select(*keys, pos), list(keys)).orderBy(pos)


def routed_inputs(rows: DataFrame, routes: dict[str, Sequence[str]], relation: str = "Relation") -> dict[str, DataFrame]:
    """The rows of each route's relations; a relation that no route or several have is an error."""
    every = [r for of in routes.values() for r in of]
    if len(every) != len(set(every)):
        raise ContractError("a relation has several routes")
    unknown = rows.where(~F.col(relation).isin(*every)).select(relation).distinct().limit(5).collect()
    if unknown:
        raise ContractError(f"relations without a route: {[r[0] for r in unknown]}")
    return {name: rows.where(F.col(relation).isin(*of)) for name, of in routes.items()}


def incumbent_tokens(items: DataFrame, exact: DataFrame, members: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, tokens): the sorted distinct components that an answer's items stand for.

    ``items(keys, pos, key, value)``; ``exact(keys, key, component)``;
    ``members(keys, component, value)``.  An item is its exact component, else
    the component with the nearest member within 5 % where no other is as near,
    else a token of its own, ``incumbent:pos:key``.
    """
    own = [*keys, "pos", "key"]
    named = items.join(exact, [*keys, "key"], "left")
    open_ = named.where("component IS NULL AND value > 0").drop("component")
    far = F.abs(F.col("__v") - F.col("value")) / F.abs(F.col("value"))
    met = open_.join(members.where("value > 0").select(*keys, F.col("component").alias("__c"), F.col("value").alias("__v")), list(keys)).withColumn("far", far).where(F.col("far") <= 0.05 + numbers.EPSILON)
    near = met.groupBy(*own, "__c").agg(F.min("far").alias("far")).groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("far", "__c"))).alias("n"))
    first = F.get("n", F.lit(0))
    alone = (F.size("n") == 1) | (first["far"] < F.get("n", F.lit(1))["far"] - numbers.EPSILON)
    found = named.join(near.select(*own, F.when(alone, first["__c"]).alias("near")), own, "left")
    token = F.coalesce("component", "near", F.concat_ws(":", F.lit("incumbent"), F.col("pos").cast("string"), F.col("key")))
    return found.groupBy(*keys).agg(F.array_sort(F.collect_set(token)).alias("tokens"))
