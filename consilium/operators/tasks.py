"""Task tables, codebooks, prompts and demonstration draws."""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.text import seed_hex, stable_seed, strip
from .relational import bounded

# Codes of choices, and the choices of the two commitment phases.
CODES = ("A", "B", "C", "D", "E", "F", "G", "H")
EXISTENCE = ("EMPTY", "NONEMPTY")
PHASES = ("commit_existence", "commit_cardinality", "propose")
#: Agents of a portfolio, at most.
MOST_AGENTS = 1000


def cardinality_choices(nullable: Column, single: Column) -> Column:
    """What a relation's answer may count: none only where it may be empty, many only where it is no single answer."""
    return F.array_compact(F.array(F.when(nullable, F.lit("ZERO")), F.lit("ONE"), F.when(~single, F.lit("MANY"))))


@F.arrow_udf(ArrayType(StringType()))
def shuffled_codes(seeds: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The codes in the order of a Mersenne Twister shuffle; input ``seed/n``."""
    for batch in seeds:
        out = []
        for s in batch.to_pylist():
            seed, n = s.split("/")
            codes = list(CODES[: int(n)])
            random.Random(int(seed)).shuffle(codes)
            out.append(codes)
        yield pa.array(out, pa.list_(pa.string()))


def with_codebooks(rows: DataFrame, choices: Column, out: str, *salt: Column) -> DataFrame:
    """``rows`` with ``out``: maps from choice to code, one for each cyclic shift of a seeded shuffle, so every choice has every code once."""
    seed = stable_seed(F.lit("choice-codes"), *salt)
    drawn = rows.withColumn("__choices", choices).withColumn("__codes", shuffled_codes(F.concat_ws("/", seed.cast("string"), F.size("__choices").cast("string"))))
    n = F.size("__choices")
    books = F.transform(F.sequence(F.lit(0), n - 1), lambda shift: F.map_from_arrays("__choices", F.transform("__choices", lambda c, i: F.get("__codes", (i + shift) % n))))
    return drawn.withColumn(out, books).drop("__choices", "__codes")


def agent_tasks(rows: DataFrame, agents: DataFrame, relations: DataFrame, n_proposals: int) -> DataFrame:
    """One task for each row, agent and phase; commitments with one choice are constant and need no model.

    Agents and phases are a few rows by contract, so each row is unfolded in
    place instead of crossed.
    """
    phases = F.array(*[F.lit(p) for p in PHASES])
    met = rows.join(bounded(relations.select("Relation", "nullable", "single")), "Relation")
    # one row that holds the portfolio, met by every input row; agents are a configuration, and more than a few are an error
    if agents.limit(MOST_AGENTS + 1).count() > MOST_AGENTS:
        raise ValueError(f"more than {MOST_AGENTS} agents")
    listed = agents.groupBy(F.lit(1).alias("all")).agg(F.array_sort(F.collect_list(F.struct("agent_id", "temperature"))).alias("agents"))
    each = met.withColumn("all", F.lit(1)).join(F.broadcast(listed), "all").select("SubjectEntity", "Relation", "pos", "nullable", "single", F.explode("agents").alias("a"))
    each = each.withColumn("phase", F.explode(phases))
    choices = F.when(F.col("phase") == PHASES[0], F.when(F.col("nullable"), F.array(*map(F.lit, EXISTENCE))).otherwise(F.array(F.lit("NONEMPTY")))).when(F.col("phase") == PHASES[1], cardinality_choices(F.col("nullable"), F.col("single")))
    each = each.withColumn("choices", choices)
    return each.select(
        seed_hex(F.col("a.agent_id"), F.col("SubjectEntity"), F.col("Relation"), F.col("phase")).alias("task_id"),
        F.col("a.agent_id").alias("agent_id"),
        F.col("SubjectEntity").alias("subject"),
        F.col("Relation").alias("relation"),
        F.col("pos").alias("input_index"),
        "phase",
        F.when(F.col("phase") == "propose", "generate").otherwise("choice").alias("mode"),
        "choices",
        F.when(F.size("choices") == 1, F.get("choices", F.lit(0))).alias("constant_choice"),
        F.when(F.col("phase") == "propose", F.lit(n_proposals)).otherwise(F.lit(0)).alias("n_samples"),
        F.col("a.temperature").alias("temperature"),
    )


def review_tasks(candidates: DataFrame, agents: Sequence[str], relations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A task for each candidate of a relation with names and each agent that did not propose it."""
    named = candidates.join(bounded(relations.where("kind = 'string'").select("Relation")), "Relation", "left_semi")
    others = F.array_except(F.array(*[F.lit(a) for a in agents]), F.col("proposers"))
    return named.select(*keys, "key", "item", F.explode(others).alias("agent_id"))


def constant_responses(tasks: DataFrame) -> DataFrame:
    """Responses of tasks with a single choice."""
    one = tasks.where("constant_choice IS NOT NULL")
    return one.select("task_id", "agent_id", "subject", "relation", "phase", "mode", F.col("constant_choice").alias("selected_choice"), F.create_map("constant_choice", F.lit(1.0)).alias("choice_probabilities"))


def demonstrations(targets: DataFrame, pool: DataFrame, n: int, salt: str, distinct_subject: bool = True) -> DataFrame:
    """(target columns, place, shot): ``n`` examples of a target's relation, never the target itself, each subject once.

    The draw orders the pool by a hash of target and example, so it is the same
    wherever rows stand.  The pool is a curated list, joined by relation.
    """
    met = targets.join(pool.select("Relation", F.col("SubjectEntity").alias("shot"), F.col("example")), "Relation").where(strip(F.lower("shot")) != strip(F.lower("SubjectEntity")))
    drawn = met.withColumn("draw", seed_hex(F.lit(salt), F.col("SubjectEntity"), F.col("Relation"), F.col("shot"), F.col("example")))
    if distinct_subject:
        drawn = drawn.groupBy("SubjectEntity", "Relation", "shot").agg(F.min(F.struct("draw", "example")).alias("d")).select("SubjectEntity", "Relation", "shot", "d.*")
    w = Window.partitionBy("SubjectEntity", "Relation").orderBy("draw")
    return drawn.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).drop("draw")


def stratified_demonstrations(targets: DataFrame, pool: DataFrame, n: int, empty_of_five: int, salt: str) -> DataFrame:
    """As ``demonstrations``, with a fixed share of examples without an answer (column ``is_empty`` of the pool)."""
    n_empty = n * empty_of_five // 5
    full = demonstrations(targets, pool.where("NOT is_empty"), n - n_empty, salt)
    bare = demonstrations(targets, pool.where("is_empty"), n_empty, salt) if n_empty else full.limit(0)
    return full.unionByName(bare.withColumn("place", F.col("place") + (n - n_empty)))


def head_of_each(pool: DataFrame, key: str, order: str, n: int) -> DataFrame:
    return pool.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("__n") <= n).drop("__n")


def chat_prompt(system: Column, turns: Column, question: Column) -> Column:
    """ChatML text of a system line, demonstration turns (structs of question and answer) and an open question."""
    say = lambda role, body: F.concat(F.lit(f"<|im_start|>{role}\n"), body, F.lit("<|im_end|>\n"))
    shots = F.array_join(F.transform(turns, lambda t: F.concat(say("user", t["question"]), say("assistant", t["answer"]))), "")
    return F.concat(say("system", system), shots, say("user", question), F.lit("<|im_start|>assistant\n"))


def filled(template: Column, subject: Column) -> Column:
    return F.replace(template, F.lit("{subject_entity}"), subject)


def pending(tasks: DataFrame, done: DataFrame) -> DataFrame:
    """Tasks without a finished response: what a resumed run has left."""
    return tasks.join(done.select("task_id"), "task_id", "left_anti")


def without_labels(rows: DataFrame) -> DataFrame:
    """Only keys reach a prompt: ``rows`` with an empty list for an answer."""
    return rows.select("SubjectEntity", "Relation", F.expr("cast(array() as array<string>)").alias("ObjectEntities"))


def drop_self(subject: Column, items: Column) -> Column:
    """Items but those that are the subject itself, apart from case and outer white space."""
    plain = lambda x: F.lower(strip(x))
    return F.filter(items, lambda x: plain(x) != plain(subject))


def balanced_demonstrations(draws: DataFrame, pool: DataFrame, n: int, empty_of_five: dict[str, int], salt: str = "balanced") -> DataFrame:
    """(draw, Relation, place, shot, example): ``n`` different subjects for each draw, then one example of each.

    ``draws(draw, Relation)`` names each draw; ``pool(Relation, SubjectEntity,
    example, is_empty, value)`` has a value for numbers.  Numeric subjects come
    one from each of ``n`` slices of the sorted values; others hold a fixed
    share without an answer; what is short is filled from the rest.  Order is
    by hashes of the draw, so it is the same wherever rows stand.  A subject's
    kind and value are those of its least example.
    """
    subjects = pool.groupBy("Relation", "SubjectEntity").agg(F.min(F.struct("example", "is_empty", "value")).alias("f"), F.array_sort(F.collect_set("example")).alias("examples"))
    subjects = subjects.select("Relation", F.col("SubjectEntity").alias("shot"), "f.is_empty", F.when(F.col("f.value") > 0, F.col("f.value")).alias("value"), "examples")
    valued = Window.partitionBy("Relation")
    has = F.col("value").isNotNull()
    ranked = subjects.withColumn("rank", F.row_number().over(valued.orderBy(F.desc(has), "value", "shot")) - 1).withColumn("valued", F.sum(has.cast("long")).over(valued))
    slices = F.least(F.lit(n), F.col("valued"))
    # the slice that holds rank r is the last whose first rank, floor(i * N / n), is not beyond it
    bounds = F.transform(F.sequence(F.lit(1), F.greatest(slices, F.lit(1))), lambda i: F.floor(i * F.col("valued") / slices))
    ranked = ranked.withColumn("slice", F.when(has, F.size(F.filter(bounds, lambda b: b <= F.col("rank")))))
    met = draws.join(ranked, "Relation").withColumn("order", seed_hex(F.lit(salt), F.col("draw").cast("string"), F.col("Relation"), F.col("shot")))
    per = F.create_map(*[F.lit(x) for pair in empty_of_five.items() for x in pair]) if empty_of_five else F.expr("cast(map() as map<string,int>)")
    wanted = F.bround(F.coalesce(F.try_element_at(per, F.col("Relation")), F.lit(0)) * n / 5).cast("int")
    group = Window.partitionBy("draw", "Relation")
    # first choices: the first of each slice, or the first so many with and without an answer
    in_slice = F.row_number().over(Window.partitionBy("draw", "Relation", "slice").orderBy("order"))
    in_kind = F.row_number().over(Window.partitionBy("draw", "Relation", "is_empty").orderBy("order"))
    numeric = F.col("valued") > 0
    n_empty = F.least(wanted, F.sum(F.col("is_empty").cast("int")).over(group))
    first = F.when(numeric, F.col("slice").isNotNull() & (F.col("in_slice") == 1)).when(F.col("is_empty"), F.col("in_kind") <= F.col("n_empty")).otherwise(F.col("in_kind") <= n - F.col("n_empty"))
    chosen = met.withColumns({"in_slice": in_slice, "in_kind": in_kind, "n_empty": n_empty}).withColumn("first", first)
    placed = chosen.withColumn("at", F.row_number().over(group.orderBy(F.desc("first"), "order"))).where(F.col("at") <= n)
    shuffled = seed_hex(F.lit(salt + ":place"), F.col("draw").cast("string"), F.col("Relation"), F.col("shot"))
    pick = F.pmod(F.xxhash64(F.lit(salt), F.col("draw").cast("string"), "Relation", "shot"), F.size("examples").cast("long")).cast("int")
    return placed.withColumn("place", F.row_number().over(group.orderBy(shuffled))).select("draw", "Relation", "place", "shot", F.get("examples", pick).alias("example"))


def diverse_demonstrations(targets: DataFrame, pool: DataFrame, n: int, n_samples: int, empty_of_five: dict[str, int], retries: int = 8) -> DataFrame:
    """(SubjectEntity, Relation, sample, place, shot, example): a demonstration set of its own for each sample of a target.

    Each sample may draw ``retries`` times; the first draw whose set no earlier
    sample's chosen draw has is taken, the last where all are taken already.
    """
    name = F.concat_ws("/", "SubjectEntity", "Relation", F.col("sample").cast("string"), F.col("retry").cast("string"))
    every = targets.select("SubjectEntity", "Relation", F.explode(F.transform(F.sequence(F.lit(0), F.lit(n_samples * retries - 1)), lambda i: F.struct(F.floor(i / retries).cast("int").alias("sample"), (i % retries).alias("retry")))).alias("t")).select("SubjectEntity", "Relation", "t.*")
    named = every.withColumn("draw", name)
    drawn = balanced_demonstrations(named.select("draw", "Relation"), pool, n, empty_of_five, "diverse")
    sets = drawn.groupBy("draw", "Relation").agg(F.array_sort(F.collect_list(F.struct("place", "shot", "example"))).alias("shots"))
    signature = F.sha2(F.to_json(F.transform("shots", lambda x: F.struct(x["shot"].alias("s"), x["example"].alias("e")))), 256)
    options = named.join(sets, ["draw", "Relation"]).groupBy("SubjectEntity", "Relation").agg(F.array_sort(F.collect_list(F.struct("sample", "retry", signature.alias("sig"), "shots"))).alias("options"))

    # (sample, retry) in order: the open sample takes the first signature that is not used, or its last retry
    zero = F.struct(F.lit(-1).alias("done"), F.expr("cast(array() as array<string>)").alias("used"), F.expr("cast(array() as array<int>)").alias("picks"))

    def step(acc: Column, o: Column) -> Column:
        take = (o["sample"] > acc["done"]) & (~F.array_contains(acc["used"], o["sig"]) | (o["retry"] == retries - 1))
        return F.struct(
            F.when(take, o["sample"]).otherwise(acc["done"]).alias("done"),
            F.when(take, F.concat(acc["used"], F.array(o["sig"]))).otherwise(acc["used"]).alias("used"),
            F.when(take, F.concat(acc["picks"], F.array(o["retry"]))).otherwise(acc["picks"]).alias("picks"),
        )

    slim = F.transform("options", lambda o: F.struct(o["sample"].alias("sample"), o["retry"].alias("retry"), o["sig"].alias("sig")))
    picked = options.withColumn("picks", F.aggregate(slim, zero, step, lambda acc: acc["picks"]))
    kept = picked.select("SubjectEntity", "Relation", F.explode(F.filter("options", lambda o: F.get("picks", o["sample"]) == o["retry"])).alias("o"))
    return kept.select("SubjectEntity", "Relation", F.col("o.sample").alias("sample"), F.inline("o.shots"))
