"""The decoding stack: cardinality, numbers, routes, components, area, support, then proof, with a trace of every layer."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import number_12g
from ..operators import decode, relational

KEYS = ("SubjectEntity", "Relation")
# Relations that the last stage never changes, and those with a numeric proof.
IDENTITY = ("awardWonBy",)
NUMERIC_PROOF = ("hasCapacity",)
LAYERS = ("cardinality", "numeric", "route_residual", "component_surface_residual", "area_unanimous_new_component", "support_two_thirds", "proof")

#: From answers (keys, objects) to actions (keys, tokens, is_keep, estimate).
Actions = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Evidence:
    """What each layer judges by; a layer without its evidence leaves answers as they are.

    ``scored`` and ``context`` are those of ``decode_cardinality`` (without a
    baseline), ``options`` those of ``switch_numeric``, ``supply`` and
    ``support`` those of the two rules; ``context`` has ``kind`` for the last.
    ``hypotheses`` carry proof metrics, ``records`` their events; ``invalid``
    names keys whose evidence is broken.  ``numeric`` has the options of
    ``prove_numbers`` for the relations of ``NUMERIC_PROOF``, which no set
    proof touches.
    """

    scored: DataFrame | None = None
    context: DataFrame | None = None
    options: DataFrame | None = None
    route_actions: Actions | None = None
    component_actions: Actions | None = None
    supply: DataFrame | None = None
    support: DataFrame | None = None
    hypotheses: DataFrame | None = None
    records: DataFrame | None = None
    invalid: DataFrame | None = None
    numeric: DataFrame | None = None
    objects_of_tokens: Callable[[DataFrame], DataFrame] | None = None
    cardinality_margin: float = decode.CARDINALITY_MARGIN
    numeric_margins: Mapping[str, float] = field(default_factory=lambda: dict(decode.NUMERIC_MARGINS))
    numeric_enabled: Sequence[str] = decode.NUMERIC_ENABLED
    route_margin: float = 0.0
    component_margin: float = 0.0
    arm: str = "strict_proof_graph"
    identity: Sequence[str] = IDENTITY


def _patched(answers: DataFrame, found: DataFrame, column: str = "objects") -> DataFrame:
    """``answers`` with ``found``'s objects where it has the key."""
    return relational.replace_if_present(answers, found.select(*KEYS, F.col(column).alias("objects")), KEYS, "objects")


def cardinality_layer(e: Evidence) -> decode.Layer:
    def run(answers: DataFrame) -> DataFrame:
        if e.scored is None or e.context is None:
            return answers
        context = e.context.join(answers.select(*KEYS, F.col("objects").alias("baseline")), list(KEYS))
        return _patched(answers, decode.decode_cardinality(e.scored, context, KEYS, e.cardinality_margin))

    return run


def numeric_layer(e: Evidence) -> decode.Layer:
    """Only relations whose model is enabled switch; the others keep what they have."""

    def run(answers: DataFrame) -> DataFrame:
        if e.options is None:
            return answers
        margin = F.create_map(*[F.lit(x) for pair in e.numeric_margins.items() for x in pair])
        rows = e.options.where(F.col("Relation").isin(*e.numeric_enabled))
        best = rows.groupBy(*KEYS).agg(
            F.max(F.struct("probability", (-F.col("place")).alias("order"), "value")).alias("best"),
            F.min(F.when(F.array_contains("kinds", "baseline"), F.struct("place", "probability"))).alias("base"),
        )
        moved = best.where(F.col("best.probability") - F.col("base.probability") > F.coalesce(F.try_element_at(margin, F.col("Relation")), F.lit(0.0)))
        return _patched(answers, moved.withColumn("text", number_12g(F.col("best.value"))).select(*KEYS, F.array("text").alias("objects")))

    return run


def residual_layer(actions: Actions | None, margin: float) -> decode.Layer:
    def run(answers: DataFrame) -> DataFrame:
        if actions is None:
            return answers
        return _patched(answers, decode.residual(actions(answers), KEYS, margin), "tokens")

    return run


def area_layer(e: Evidence) -> decode.Layer:
    return lambda answers: answers if e.supply is None else _patched(answers, decode.unanimous_rule(e.supply, answers, KEYS))


def support_layer(e: Evidence) -> decode.Layer:
    def run(answers: DataFrame) -> DataFrame:
        if e.support is None or e.context is None:
            return answers
        return _patched(answers, decode.support_rule(e.support, answers.join(e.context.select(*KEYS, "kind"), list(KEYS)), KEYS))

    return run


def proof_layer(e: Evidence) -> decode.Layer:
    """Proven sets, and proven single numbers of ``NUMERIC_PROOF``, in place of incumbents.

    The caller's ``objects_of_tokens`` turns tokens (keys, tokens) into objects.
    Keys with broken evidence keep what they have.
    """

    def run(answers: DataFrame) -> DataFrame:
        out, scalar = answers, F.col("Relation").isin(*NUMERIC_PROOF)
        if e.hypotheses is not None and e.records is not None:
            invalid = e.hypotheses.select(*KEYS).limit(0) if e.invalid is None else e.invalid
            won = decode.proof_stage(e.hypotheses.where(~scalar), e.records.where(~scalar), invalid, KEYS, e.arm, e.identity).where("changed")
            out = _patched(out, won if e.objects_of_tokens is None else e.objects_of_tokens(won), "tokens" if e.objects_of_tokens is None else "objects")
        if e.numeric is not None:
            options = e.numeric.where(scalar)
            if e.invalid is not None:
                options = options.join(e.invalid.select(*KEYS), list(KEYS), "left_anti")
            proven = decode.prove_numbers(options, KEYS).where("changed").withColumn("text", number_12g("value"))
            out = _patched(out, proven.select(*KEYS, F.array("text").alias("objects")))
        return out

    return run


def frozen_stack(answers: DataFrame, e: Evidence) -> DataFrame:
    """``answers(keys, objects)`` after all layers in their fixed order, with ``trace``."""
    layers = (cardinality_layer(e), numeric_layer(e), residual_layer(e.route_actions, e.route_margin), residual_layer(e.component_actions, e.component_margin), area_layer(e), support_layer(e), proof_layer(e))
    return decode.layered(answers, list(zip(LAYERS, layers, strict=True)), KEYS)


def run_stage(name: str, inputs: Mapping[str, DataFrame], stage: Callable[..., DataFrame], path: str, manifest: Path | None = None) -> DataFrame:
    """A stage driver: run ``stage`` on named inputs, write its rows and say what they are, and read them back.

    The manifest has the inputs' row counts, the output's rows, and a sum of
    row hashes that is the same however rows are dealt.
    """
    spark = next(iter(inputs.values())).sparkSession
    out = stage(**inputs)
    out.write.mode("overwrite").parquet(path)
    back = spark.read.schema(out.schema).parquet(path)
    n, digest = back.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64(F.to_json(F.struct("*"))).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()
    value = {"stage": name, "inputs": {k: v.count() for k, v in sorted(inputs.items())}, "rows": n, "row_hash_sum": str(digest)}
    if manifest is not None:
        manifest.write_text(json.dumps(value, indent=2, sort_keys=True) + "\n", encoding="utf-8")
    return back
