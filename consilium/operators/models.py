"""Frozen linear models as rows, read from and written to JSON, and fits by key.

A model is one row of ``schemas.LINEAR_MODEL``: names, penalty and
coefficients, with means and scales where features are standardised.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers
from ..schemas import LINEAR_MODEL
from . import decode
from .relational import ContractError

# Schema tags of the three kinds of model, and the classes of a cardinality model.
CARDINALITY = "explicit-cardinality-ovr-v1"
NUMERIC = "relation-specific-numeric-model-v1"
RESIDUAL = "signed-standardized-residual-ridge-v1"
CLASSES = ("ZERO", "ONE", "MANY")
#: Mean size of an answer of many where no training row has one, and the least that counts as many.
MANY = 2.0


def _row(schema: str, relation: str | None, label: str | None, value: Mapping, l2: float, standardised: bool = False) -> tuple:
    names, beta = [str(n) for n in value["feature_names"]], [float(c) for c in value["coefficients"]]
    mean = [float(x) for x in value["mean"]] if standardised else None
    scale = [float(x) for x in value["scale"]] if standardised else None
    # a standardised model has an intercept beside its named features
    if len(beta) != len(names) + standardised or standardised and not len(mean) == len(scale) == len(names):
        raise ContractError(f"{schema}: shapes of {relation} {label} differ")
    if not all(map(math.isfinite, [*beta, *(mean or []), *(scale or [])])):
        raise ContractError(f"{schema}: {relation} {label} is not finite")
    return (schema, relation, label, names, float(l2), beta, mean, scale)


def parse(value: Mapping, expected: str) -> list[tuple]:
    """Rows of ``LINEAR_MODEL`` of one serialised model; a schema other than ``expected`` is an error."""
    if value.get("schema") != expected:
        raise ContractError(f"{value.get('schema')!r} is not {expected}")
    if expected == RESIDUAL:
        return [_row(expected, None, None, value, value["l2"], True)]
    if expected == NUMERIC:
        return [_row(expected, relation, None, m, m.get("l2", value["l2"])) for relation, m in sorted(value["models"].items())]
    return [_row(expected, relation, label, m, m.get("l2", value["l2"])) for relation, labels in sorted(value["models"].items()) for label, m in sorted(labels.items())]


def load(spark: SparkSession, text: str, expected: str) -> DataFrame:
    """The models of a JSON text as a table of a few rows."""
    return spark.createDataFrame(parse(json.loads(text), expected), LINEAR_MODEL)


def many_means(value: Mapping) -> dict[str, float]:
    """The mean size of an answer of many by relation, of a cardinality model."""
    return {str(k): float(v) for k, v in value["many_mean"].items()}


def dump(models: DataFrame, many_mean: Mapping[str, float] | None = None) -> str:
    """The JSON text that ``load`` reads back to the same rows; all rows have one schema."""
    rows = models.orderBy("relation", "label").collect()
    kinds = {r.schema for r in rows}
    if len(kinds) != 1:
        raise ContractError(f"models of {sorted(kinds)} in one file")
    kind = kinds.pop()
    one = lambda r: {"feature_names": r.feature_names, "l2": r.l2, "coefficients": r.coefficients}
    if kind == RESIDUAL:
        value = {"schema": kind, **one(rows[0]), "mean": rows[0].mean, "scale": rows[0].scale}
    elif kind == NUMERIC:
        value = {"schema": kind, "l2": rows[0].l2, "models": {r.relation: one(r) for r in rows}}
    else:
        value = {"schema": kind, "l2": rows[0].l2, "feature_names": rows[0].feature_names, "many_mean": dict(many_mean or {}), "models": {}}
        for r in rows:
            value["models"].setdefault(r.relation, {})[r.label] = one(r)
    return json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False)


def fit_logistic_by(rows: DataFrame, keys: Sequence[str], xs: Sequence[str], y: str, weight: str | None = None, l2: float = 2.0, rounds: int = 60, tolerance: float = 1e-9) -> dict[tuple, np.ndarray]:
    """Coefficients for every key by Newton steps over Spark sums: one aggregation a round for all keys together.

    Keys are few (relations, classes); their rows are not, and never leave the
    executors.  The first of ``xs`` is the intercept, free of the penalty.
    """
    n = len(xs)
    w = F.col(weight) if weight else F.lit(1.0)
    beta = {tuple(r): np.zeros(n) for r in rows.select(*keys).distinct().collect()}
    open_ = set(beta)
    for _ in range(rounds):
        if not open_:
            break
        table = rows.sparkSession.createDataFrame([(*k, b.tolist()) for k, b in beta.items() if k in open_], ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keys) + ", __beta array<double>")
        # a row a key
        met = rows.join(F.broadcast(table), list(keys))
        score = numbers.sigmoid(sum((F.col(x) * F.get("__beta", F.lit(i)) for i, x in enumerate(xs)), F.lit(0.0)))
        cells = [F.sum(w * score * (1 - score) * F.col(a) * F.col(b)) for i, a in enumerate(xs) for b in xs[i:]] + [F.sum(w * (F.col(y) - score) * F.col(a)) for a in xs]
        for r in met.groupBy(*keys).agg(F.array(*cells).alias("c")).collect():
            key, got = tuple(r[k] for k in keys), r["c"]
            h = np.zeros((n, n))
            h[np.triu_indices(n)] = got[: n * (n + 1) // 2]
            h = h + np.triu(h, 1).T
            pull = np.full(n, l2)
            pull[0] = 0
            step = np.linalg.lstsq(h + np.diag(pull) + np.eye(n) * 1e-9, np.array(got[n * (n + 1) // 2 :]) - pull * beta[key], rcond=None)[0]
            beta[key] = beta[key] + step
            if np.abs(step).max() < tolerance:
                open_.discard(key)
    return beta


def fit_numeric(options: DataFrame, xs: Sequence[str], l2: float = 2.0) -> DataFrame:
    """A model a relation for whether an option is right; each key's options weigh one together.

    ``options(Relation, keys..., correct, *xs)`` with a column ``n_options``.
    """
    rows = options.withColumn("__w", 1 / F.col("n_options")).withColumn("__y", F.col("correct").cast("double"))
    beta = fit_logistic_by(rows, ["Relation"], xs, "__y", "__w", l2)
    return options.sparkSession.createDataFrame([(NUMERIC, k[0], None, list(xs), l2, b.tolist(), None, None) for k, b in sorted(beta.items())], LINEAR_MODEL)


def fit_cardinality(rows: DataFrame, xs: Sequence[str], l2: float = 2.0) -> tuple[DataFrame, dict[str, float]]:
    """A one-vs-rest model a relation and class, and each relation's mean size of an answer of many.

    ``rows(Relation, n_gold, *xs)``; without an answer of many the mean is ``MANY``.
    """
    label = F.when(F.col("n_gold") == 0, "ZERO").when(F.col("n_gold") == 1, "ONE").otherwise("MANY")
    each = rows.withColumn("__label", label).withColumn("label", F.explode(F.array(*map(F.lit, CLASSES)))).withColumn("__y", (F.col("label") == F.col("__label")).cast("double"))
    beta = fit_logistic_by(each, ["Relation", "label"], xs, "__y", None, l2)
    models = rows.sparkSession.createDataFrame([(CARDINALITY, k[0], k[1], list(xs), l2, b.tolist(), None, None) for k, b in sorted(beta.items())], LINEAR_MODEL)
    mean = rows.groupBy("Relation").agg(F.coalesce(F.avg(F.when(F.col("n_gold") > 1, F.col("n_gold"))), F.lit(MANY)).alias("m"))
    return models, {r.Relation: float(r.m) for r in mean.collect()}


def cardinality_probabilities(rows: DataFrame, models: DataFrame, features: str, fixed: Mapping[str, str]) -> DataFrame:
    """``rows(Relation, features array)`` plus ``probabilities``: shares of the classes, or certainty of a relation's class in ``fixed``."""
    betas = models.groupBy(F.col("relation").alias("Relation")).agg(F.map_from_entries(F.collect_list(F.struct("label", "coefficients"))).alias("__betas"))
    met = rows.join(F.broadcast(betas), "Relation", "left")
    raw = F.transform_values("__betas", lambda k, v: decode.logistic_score(F.col(features), v))
    certain = F.create_map(*[F.lit(x) for pair in fixed.items() for x in pair]) if fixed else F.expr("cast(map() as map<string,string>)")
    sure = F.try_element_at(certain, F.col("Relation"))
    known = F.map_from_arrays(F.array(*map(F.lit, CLASSES)), F.array(*[(sure == c).cast("double") for c in CLASSES]))
    lost = F.raise_error(F.concat(F.lit("no cardinality model for "), F.col("Relation"))).cast("map<string,double>")
    return met.withColumn("probabilities", F.when(sure.isNotNull(), known).when(F.col("__betas").isNotNull(), decode.cardinality_shares(raw)).otherwise(lost)).drop("__betas")


def expected_size(probabilities: Column, many_mean: Column, candidate_mass: Column) -> Column:
    """The size a set is expected to have, never below what its candidates' probabilities add up to."""
    many = F.greatest(F.lit(MANY), F.coalesce(many_mean, F.lit(MANY)))
    return F.greatest(probabilities["ONE"] + probabilities["MANY"] * many, candidate_mass)


def mean_summary(rows: DataFrame, keys: Sequence[str], base: DataFrame, names: Sequence[str]) -> DataFrame:
    """``base(keys)`` with the mean of each summary over a key's tokens, 0 where it has none."""
    means = rows.groupBy(*keys).agg(*[F.avg(n).alias(n) for n in names])
    return base.select(*keys).join(means, list(keys), "left").select(*keys, *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names])
