"""Typed evidence graphs as node and edge tables, keyed by (subject, relation).

A graph is two DataFrames: nodes ``(keys, id, node_type, ...)`` and edges
``(keys, source, target, edge_type, ...)``.  Each edge type is one query.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers, text
from ..schemas import FAMILIES
from . import stats
from .relational import bounded
from .storage import checkpointed

# How sure each rule of equivalence is.
CONFIDENCE = {"normalized_exact": 1.0, "parenthetical_alias": 0.98, "explicit_acronym": 0.97}


def all_of(conditions: list[Column]) -> Column:
    return reduce(and_, conditions)


def merge_candidates(facts: DataFrame, keys: Sequence[str], entry: Sequence[str], agent: str = "agent") -> DataFrame:
    """One row a (key, candidate): the surface first seen, who proposed it and with what support.

    ``facts(keys, key, item, pos, agent, *entry)`` has a row for each agent's candidate.
    """
    return facts.groupBy(*keys, "key").agg(
        F.min_by("item", F.struct("pos", agent)).alias("item"),
        F.array_sort(F.collect_set(agent)).alias("proposers"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(agent), F.struct(*entry))))).alias("sources"),
        F.sum("support").alias("total_support"),
    )


def claim_order(candidates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``candidates`` with ``idx``: most proposers, then most support, then key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(F.size("proposers")), F.desc("total_support"), "key")
    return candidates.withColumn("idx", F.row_number().over(w) - 1)


def route_summary(routes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, key, n_families, n_routes, selected_any, cross_family, total_support) from (keys, key, route, family, support, selected)."""
    return routes.groupBy(*keys, "key").agg(
        F.count_distinct("family").alias("n_families"),
        F.count_distinct("route").alias("n_routes"),
        F.bool_or("selected").alias("selected_any"),
        (F.count_distinct("family") > 1).alias("cross_family"),
        F.sum("support").alias("total_support"),
    )


def route_order(summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("n_families"), F.desc("n_routes"), F.desc("total_support"), "key")
    return summary.withColumn("idx", F.row_number().over(w) - 1)


def in_scope(nodes: DataFrame, routes: Sequence[str], column: str = "routes") -> DataFrame:
    """Only routes in scope; nodes that keep none go, nodes without a map of routes stay."""
    scope = F.array(*[F.lit(r) for r in routes])
    cut = nodes.withColumn(column, F.map_filter(column, lambda k, v: F.array_contains(scope, k)))
    return cut.where(F.col(column).isNull() | (F.size(column) > 0))


def equivalences(candidates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, left, right, rule, confidence, blocked) of string candidates (keys, idx, item) of one key.

    Three equi-joins (normal form, base before a parenthesis, acronym to
    initials) instead of comparing all pairs; the surest rule of a pair counts.
    An acronym that two different expansions of the same key fit is blocked.
    """
    form = text.normalize("item")
    c = candidates.select(*keys, "idx", "item", form.alias("form"), text.normalize(text.without_parenthesis(F.col("item"))).alias("base"), text.acronym(F.col("item")).alias("short"), text.initials(F.col("item")).alias("letters"))
    left, right = c.alias("l"), c.alias("r")
    same_key = lambda: [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys]

    def met(on: list[Column], order: Column, rule: str) -> DataFrame:
        return left.join(right, all_of([*same_key(), *on, order])).select(*[F.col(f"l.{k}").alias(k) for k in keys], F.least("l.idx", "r.idx").alias("left"), F.greatest("l.idx", "r.idx").alias("right"), F.lit(rule).alias("rule"), F.col("l.short").alias("short"))

    apart = F.col("l.idx") < F.col("r.idx")
    exact = met([F.col("l.form") == F.col("r.form")], apart, "normalized_exact")
    based = met([F.col("l.base") == F.col("r.base"), F.col("l.base") != ""], apart, "parenthetical_alias")
    spelled = met([F.col("l.short") == F.col("r.letters")], F.col("l.idx") != F.col("r.idx"), "explicit_acronym")
    wide = left.join(right, all_of([*same_key(), F.col("l.short") == F.col("r.letters"), F.col("r.short").isNull()])).select(*[F.col(f"l.{k}").alias(k) for k in keys], F.col("l.short").alias("short"), F.col("r.form").alias("expansion"))
    wide = wide.groupBy(*keys, "short").agg(F.count_distinct("expansion").alias("n_expansions"))
    rank = F.create_map(*[F.lit(x) for i, r in enumerate(CONFIDENCE) for x in (r, i)])
    every = exact.unionByName(based).unionByName(spelled).withColumn("rank", rank[F.col("rule")])
    best = every.groupBy(*keys, "left", "right").agg(F.min(F.struct("rank", "rule", "short")).alias("b")).select(*keys, "left", "right", F.col("b.rule").alias("rule"), F.col("b.short").alias("short"))
    conf = F.create_map(*[F.lit(x) for pair in CONFIDENCE.items() for x in pair])
    out = best.join(wide, [*keys, "short"], "left")
    return out.select(*keys, "left", "right", "rule", conf[F.col("rule")].alias("confidence"), ((F.col("rule") == "explicit_acronym") & (F.coalesce("n_expansions", F.lit(0)) != 1)).alias("blocked"))


def connected(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links(u, v)``, u != v: nodes of one connected component share a root.

    A round points every node to the least of itself and its neighbours, by a
    hash that differs from round to round, follows pointers to their ends and
    keeps the links between different ends.  A good share of the nodes of any
    graph, chains and stars among them, lose their standing in each round, so
    rounds are logarithmic.  Every step is written to the shared folder.
    """
    edges = checkpointed(links.select("u", "v").union(links.select("v", "u")).distinct())
    trees: list[DataFrame] = []
    while edges.limit(1).count():
        order = lambda c, k=len(trees): F.struct(F.xxhash64(F.lit(k), F.col(c)).alias("turn"), F.col(c).alias("node"))
        tree = checkpointed(edges.groupBy("u").agg(F.min(order("v")).alias("near")).select(F.col("u").alias("node"), F.least("near", order("u"))["node"].alias("parent")))
        moved = 1
        while moved:
            above = tree.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
            step = checkpointed(tree.join(above, "parent").select("node", "parent", "above"))
            moved, tree = step.where("above <> parent").limit(1).count(), step.select("node", F.col("above").alias("parent"))
        trees.append(tree)
        for side in ("u", "v"):
            edges = edges.join(tree.toDF(side, f"r{side}"), side)
        edges = checkpointed(edges.where("ru <> rv").select(F.col("ru").alias("u"), F.col("rv").alias("v")).distinct())
    if not trees:
        return edges.toDF("node", "root")
    # from the last round back, so that no join is larger than its round
    roots = trees.pop().toDF("node", "root")
    for tree in reversed(trees):
        roots = tree.join(roots.toDF("parent", "root"), "parent", "left").select("node", F.coalesce("root", "parent").alias("root"))
    return roots


def string_components(candidates: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, idx, component): the least idx of each candidate's component over unblocked equivalences."""
    at = lambda idx: F.struct(*[F.col(k).alias(k) for k in keys], F.col(idx).cast(candidates.schema["idx"].dataType).alias("idx"))
    roots = connected(edges.where("NOT blocked").where(F.col("left") != F.col("right")).select(at("left").alias("u"), at("right").alias("v")))
    least = roots.groupBy("root").agg(F.min("node.idx").alias("component"))
    named = roots.join(least, "root").select("node.*", "component")
    return candidates.select(*keys, "idx").join(named, [*keys, "idx"], "left").select(*keys, "idx", F.coalesce("component", "idx").alias("component"))


def numeric_components(candidates: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, component, members): complete-link runs of a key's values, anchored at each run's least value.

    Keys are read in order, a batch at a time; only a run's members meet in a row.
    """
    runs = stats.anchored_runs(candidates, keys, value)
    return runs.groupBy(*keys, F.col("run").cast("int").alias("component")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("v", "w"))), lambda x: F.array_repeat(x["v"], x["w"].cast("int")))).alias("members"))


def complete_link(component_values: DataFrame, keys: Sequence[str], tolerance: float = 0.05) -> DataFrame:
    """(keys, id, grp): each value joins, of the groups that all fit it, the one with the nearest log-median.

    Sequential by definition: one small sorted list a key in a grouped function.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in component_values.schema if f.name in keys)

    def solve(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        import math
        import statistics

        groups: list[list[float]] = []
        out = []
        for r in rows.sort_values(["value", "id"]).itertuples():
            fits = [i for i, g in enumerate(groups) if all(abs(r.value - m) / max(abs(m), 1e-12) <= tolerance for m in g)]
            at = min(fits, key=lambda i: abs(math.log(r.value) - statistics.median(map(math.log, groups[i]))), default=len(groups))
            if at == len(groups):
                groups.append([])
            groups[at].append(r.value)
            out.append((*key, r.id, at))
        return pd.DataFrame(out, columns=[*keys, "id", "grp"])

    return component_values.groupBy(*keys).applyInPandas(solve, f"{fields}, id string, grp long")


def contradictions(components: DataFrame, relations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Edges between the null hypothesis and every component, and between any two of a single-answer relation."""
    null = components.select(*keys, F.lit("null").alias("source"), F.col("id").alias("target"))
    one = components.join(bounded(relations.where("single").select("Relation")), "Relation")
    a, b = one.alias("a"), one.alias("b")
    cond = F.col("a.id") < F.col("b.id")
    for k in keys:
        cond = cond & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    pairs = a.join(b, cond).select(*[F.col(f"a.{k}").alias(k) for k in keys], F.col("a.id").alias("source"), F.col("b.id").alias("target"))
    return null.unionByName(pairs).withColumn("edge_type", F.lit("contradicts"))


def shared_routes(routes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Edges between components that a route holds both of, typed by whether generations name both.

    ``routes(keys, id, route, generations, selected)``; co-supported beats
    co-selected beats sharing a route alone.
    """
    a, b = routes.alias("a"), routes.alias("b")
    cond = (F.col("a.route") == F.col("b.route")) & (F.col("a.id") < F.col("b.id"))
    for k in keys:
        cond = cond & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    common = F.array_intersect("a.generations", "b.generations")
    each = a.join(b, cond).select(*[F.col(f"a.{k}").alias(k) for k in keys], F.col("a.id").alias("source"), F.col("b.id").alias("target"), F.col("a.route").alias("route"), F.array_sort(common).alias("common"), (F.col("a.selected") & F.col("b.selected")).alias("both"))
    kinds = each.groupBy(*keys, "source", "target").agg(F.max(F.size("common")).alias("most"), F.bool_or("both").alias("selected"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("route", "common")))).alias("by_route"))
    return kinds.select(*keys, "source", "target", F.when(F.col("most") > 0, "co_supported_with").when(F.col("selected"), "co_selected_with").otherwise("shares_route_with").alias("edge_type"), "by_route")


def relational_graph(candidates: DataFrame, components: DataFrame, routes: DataFrame, relations: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes (null hypothesis, routes, surfaces, components) and all their typed edges.

    ``candidates(keys, idx, item)``, ``components(keys, idx, component)`` and
    ``routes(keys, idx, route, generations, selected)``.
    """
    cid = lambda c: F.concat(F.lit("component:"), F.col(c).cast("string"))
    sid = F.concat(F.lit("surface:"), F.col("idx").cast("string"))
    comp = components.join(candidates, [*keys, "idx"])
    strength = routes.groupBy(*keys, "idx").agg(F.sum(F.size("generations")).cast("double").alias("strength"), F.count_if("selected").alias("n_selected"))
    ranked = comp.join(strength, [*keys, "idx"], "left").withColumns({"value": F.lit(None).cast("double"), "n_selected": F.coalesce("n_selected", F.lit(0))})
    comp_nodes = representatives(ranked, keys).select(*keys, cid("component").alias("id"), F.lit("candidate_component").alias("node_type"), "representative")
    blank = F.lit(None).cast("string").alias("representative")
    nodes = (
        candidates.select(*keys).distinct().select(*keys, F.lit("null").alias("id"), F.lit("null_hypothesis").alias("node_type"), blank)
        .unionByName(routes.select(*keys, "route").distinct().select(*keys, F.concat(F.lit("route:"), "route").alias("id"), F.lit("evidence_route").alias("node_type"), blank))
        .unionByName(candidates.select(*keys, sid.alias("id"), F.lit("candidate_surface").alias("node_type"), F.col("item").alias("representative")))
        .unionByName(comp_nodes)
    )
    member = components.select(*keys, sid.alias("source"), cid("component").alias("target"), F.lit("member_of").alias("edge_type"))
    told = routes.select(*keys, sid.alias("source"), F.concat(F.lit("route:"), "route").alias("target"), F.lit("proposed_by").alias("edge_type"))
    per = routes.join(components, [*keys, "idx"]).groupBy(*keys, cid("component").alias("id"), "route").agg(F.array_distinct(F.flatten(F.collect_list("generations"))).alias("generations"), F.bool_or("selected").alias("selected"))
    against = contradictions(comp_nodes.select(*keys, "id"), relations, keys)
    shared = shared_routes(per, keys).drop("by_route")
    return nodes, member.unionByName(told).unionByName(against).unionByName(shared)


def generation_events(records: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One event a generation: (keys, id, route, model_family, generation_index, status, claims, sha256).

    ``records(keys, route, family, generation, status, raw)``.
    """
    name = F.concat_ws(":", F.lit("event"), "route", F.col("generation").cast("string"))
    return records.select(*keys, name.alias("id"), F.lit("evidence_event").alias("node_type"), "route", F.col("family").alias("model_family"), F.col("generation").alias("generation_index"), "status", text.claims(F.col("raw"), F.col("Relation")).alias("claims"), F.sha2(text.reasoning(F.col("raw")), 256).alias("sha256"))


def event_violations(events: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, id, problem): candidate sets without support, stated absence with support, and supports without an event."""
    sup = edges.where("edge_type = 'supports'").groupBy(*keys, F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    met = events.join(sup, [*keys, "id"], "left")
    bare = met.where("status = 'candidate_set' AND n IS NULL").select(*keys, "id", F.lit("unsupported_candidate_set").alias("problem"))
    odd = met.where("status = 'explicit_none' AND n IS NOT NULL").select(*keys, "id", F.lit("supported_explicit_none").alias("problem"))
    lost = sup.join(events, [*keys, "id"], "left_anti").select(*keys, "id", F.lit("orphan_support").alias("problem"))
    return bare.unionByName(odd).unionByName(lost)


def repair_events(events: DataFrame, edges: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Candidate sets without support become unparsed and lose their assertion edges."""
    bad = event_violations(events, edges, keys).where("problem = 'unsupported_candidate_set'").select(*keys, "id").withColumn("__bad", F.lit(True))
    fixed = events.join(bad, [*keys, "id"], "left").withColumn("status", F.when(F.col("__bad"), F.lit("unparsed_or_no_candidate")).otherwise(F.col("status"))).drop("__bad")
    kept = edges.join(bad.select(*keys, F.col("id").alias("source"), F.lit("asserts").alias("edge_type")), [*keys, "source", "edge_type"], "left_anti")
    return fixed, kept.select(edges.columns)


def state_edges(events: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Assertion edges from parseable events to cardinality, existence and claim states."""
    sup = edges.where("edge_type = 'supports'").groupBy(*keys, F.col("source").alias("id")).agg(F.count_distinct("target").alias("n"))
    e = events.where(F.col("status").isin("candidate_set", "explicit_none")).join(sup, [*keys, "id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    size = F.when(F.col("n") == 0, "cardinality:ZERO").when(F.col("n") == 1, "cardinality:ONE").otherwise("cardinality:MANY")
    exists = F.when(F.col("n") == 0, "existence:EMPTY").otherwise("existence:NONEMPTY")
    targets = F.concat(F.array(size, exists), F.transform("claims", lambda c: F.concat(F.lit("claim:"), c)))
    return e.select(*keys, F.col("id").alias("source"), F.explode(targets).alias("target"), F.lit("asserts").alias("edge_type"))


def event_records(events: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, id, family, tokens, exact_cardinality, exists) of parseable events, tokens sorted."""
    sup = edges.where("edge_type = 'supports'").groupBy(*keys, F.col("source").alias("id")).agg(F.array_sort(F.collect_set("target")).alias("tokens"))
    e = events.where(F.col("status").isin("candidate_set", "explicit_none")).join(sup, [*keys, "id"], "left")
    tokens = F.coalesce("tokens", F.expr("cast(array() as array<string>)"))
    return e.select(*keys, "id", F.col("model_family").alias("family"), tokens.alias("tokens"), F.size(tokens).alias("exact_cardinality"), (F.size(tokens) > 0).alias("exists"))


def hypotheses(records: DataFrame, incumbents: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, tokens, is_incumbent, families, event_ids): every complete set some event states, and the incumbent's.

    A set is its sorted tokens; ``incumbents(keys, tokens)``.
    """
    stated = records.groupBy(*keys, "tokens").agg(F.array_sort(F.collect_set("family")).alias("families"), F.array_sort(F.collect_list("id")).alias("event_ids"))
    kept = incumbents.select(*keys, "tokens").withColumn("is_incumbent", F.lit(True))
    out = stated.join(kept, [*keys, "tokens"], "full")
    return out.select(*keys, "tokens", F.coalesce("is_incumbent", F.lit(False)).alias("is_incumbent"), F.coalesce("families", F.expr("cast(array() as array<string>)")).alias("families"), F.coalesce("event_ids", F.expr("cast(array() as array<string>)")).alias("event_ids"))


def proof_metrics(hyps: DataFrame, records: DataFrame, keys: Sequence[str], families: Sequence[str] = FAMILIES) -> DataFrame:
    """``hyps`` with the eight proof metrics, from all records of the key."""
    by_family = records.groupBy(*keys, "family").agg(F.collect_list("tokens").alias("sets")).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("family", "sets"))).alias("by_family"))
    rates = records.groupBy(*keys).agg(F.collect_list(F.struct("exact_cardinality", "exists")).alias("recs"))
    met = hyps.join(by_family, list(keys)).join(rates, list(keys))
    fam = F.array(*[F.lit(f) for f in families])
    sets_of = lambda f: F.coalesce(F.try_element_at(F.col("by_family"), f), F.expr("cast(array() as array<array<string>>)"))
    best = F.transform(fam, lambda f: F.coalesce(F.array_max(F.transform(sets_of(f), lambda s: numbers.set_f1(F.col("tokens"), s))), F.lit(0.0)))
    exact = F.transform(fam, lambda f: F.coalesce(F.try_divide(F.size(F.filter(sets_of(f), lambda s: s == F.col("tokens"))).cast("double"), F.size(sets_of(f)).cast("double")), F.lit(0.0)))
    k = float(len(families))
    met = met.withColumn("similarities", best).withColumn("exact_rates", exact)
    met = met.withColumn("__reviews", F.filter("similarities", lambda s, i: ~F.array_contains("families", F.get(fam, i))))
    mean = lambda c: numbers.total(F.col(c)) / F.size(c)
    share = lambda hit: F.size(F.filter("recs", hit)).cast("double") / F.size("recs")
    return met.select(
        *hyps.columns,
        (F.size("families") / k).alias("exact_family_fraction"),
        F.array_min("similarities").alias("minimum_similarity"),
        mean("similarities").alias("mean_similarity"),
        mean("exact_rates").alias("within_family_exact_rate_mean"),
        F.when(F.size("__reviews") == 0, F.lit(1.0)).otherwise(F.coalesce(F.try_divide(numbers.total(F.col("__reviews")), F.size("__reviews").cast("double")), F.lit(1.0))).alias("independent_similarity"),
        share(lambda r: r["exact_cardinality"] == F.size("tokens")).alias("exact_cardinality_match_rate"),
        share(lambda r: r["exists"] == (F.size("tokens") > 0)).alias("existence_match_rate"),
        F.size("tokens").cast("double").alias("set_size"),
    )


def component_co_occurrence(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, left, right, n_events): components that one event supports together."""
    sets = edges.where("edge_type = 'supports'").groupBy(*keys, "source").agg(F.array_sort(F.collect_set("target")).alias("items"))
    left = sets.select(*keys, "items", F.posexplode("items").alias("i", "left"))
    return left.select(*keys, "left", F.explode(F.slice("items", F.col("i") + 2, F.size("items"))).alias("right")).groupBy(*keys, "left", "right").agg(F.count(F.lit(1)).alias("n_events"))


def attach_supply(existing: DataFrame, supply: DataFrame, keys: Sequence[str], samples: int) -> DataFrame:
    """Supply values with an admission: unanimous if all samples agree, and new if no existing value lies within 5 %."""
    near = supply.alias("s").join(existing.alias("e"), list(keys)).where(numbers.within_product(F.col("s.value"), F.col("e.value"))).select(*[F.col(k) for k in keys], F.col("s.value").alias("value")).distinct().withColumn("known", F.lit(True))
    out = supply.join(near, [*keys, "value"], "left")
    return out.select(*keys, "value", "support", (F.col("support") == samples).alias("unanimous"), F.col("known").isNull().alias("novel"))


# -- candidates and components ----------------------------------------------------------


def eligible_candidates(candidates: DataFrame, second: str, routes: str = "routes") -> DataFrame:
    """Candidates but those that the route ``second`` alone proposes; ``routes`` maps route to evidence."""
    alone = (F.size(F.col(routes)) == 1) & F.array_contains(F.map_keys(F.col(routes)), second)
    return candidates.where(~F.coalesce(alone, F.lit(False)))


def eligible_components(components: DataFrame, members: DataFrame, eligible: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Components (keys, component, ...) that hold an eligible candidate; ``members(keys, component, idx)``."""
    good = members.join(eligible.select(*keys, "idx"), [*keys, "idx"], "left_semi").select(*keys, "component")
    return components.join(good, [*keys, "component"], "left_semi")


def aligned_candidates(proposals: DataFrame, exact: DataFrame, selected: DataFrame, keys: Sequence[str], agent: str = "agent") -> DataFrame:
    """Proposals (keys, agent, key, item, support) that the strict parser reproduces or that the agent selected, and what only the strict parser finds.

    ``exact(keys, agent, key, item, support)`` is the strict parser's count;
    its support counts where it has one, and a selected key without any raw
    support stays with support 0.  Other proposals lose their agent, and with
    their last agent go.
    """
    on = [*keys, agent, "key"]
    strict = exact.select(*on, F.col("item").alias("exact_item"), F.col("support").alias("exact_support"))
    chosen = selected.select(*on).distinct().withColumn("selected", F.lit(True))
    met = proposals.join(strict, on, "full").join(chosen, on, "left")
    met = met.where(F.col("exact_support").isNotNull() | F.col("selected"))
    # a selected proposal that the strict parser lacks keeps the support it had
    return met.select(*on, F.coalesce("item", "exact_item").alias("item"), F.coalesce("exact_support", "support", F.lit(0)).alias("support"), F.coalesce("selected", F.lit(False)).alias("selected"))


def component_keys(components: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, key, component): every spelling that names a component, distinct; blanks name none.

    ``components(keys, component, member_keys, item_keys, representative_key)``;
    a numeric key also names its component without the ``numeric:`` prefix.
    """
    named = F.concat("member_keys", "item_keys", F.array("representative_key"))
    every = components.select(*keys, "component", F.explode(F.concat(named, F.transform(named, lambda k: F.regexp_replace(k, "^numeric:", "")))).alias("key"))
    return every.where("key <> ''").distinct()


def ambiguous_keys(lookup: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, key): spellings that name several components, which no mapping may use."""
    return lookup.groupBy(*keys, "key").agg(F.count_distinct("component").alias("n")).where("n > 1").select(*keys, "key")


def map_items(items: DataFrame, lookup: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, owner, components, unknown): the components that items name, once each in order, and items that name none.

    ``items(keys, owner, pos, item, spellings)``: the first spelling that names a
    component counts; ``lookup`` must be free of ``ambiguous_keys``.  An item
    whose first spelling, its key, is blank is neither mapped nor unknown.
    """
    each = items.select(*keys, "owner", "pos", "item", F.get("spellings", F.lit(0)).alias("main"), F.posexplode("spellings").alias("at", "key"))
    best = each.join(lookup, [*keys, "key"], "left").groupBy(*keys, "owner", "pos", "item", "main").agg(F.min_by("component", F.when(F.col("component").isNotNull(), F.col("at"))).alias("component"))
    first = F.array_sort(F.collect_list(F.when(F.col("component").isNotNull(), F.struct("pos", "component"))))
    lost = F.array_sort(F.collect_list(F.when(F.col("component").isNull() & (F.coalesce("main", F.lit("")) != ""), F.struct("pos", "item"))))
    packed = best.groupBy(*keys, "owner").agg(first.alias("f"), lost.alias("l"))
    return packed.select(*keys, "owner", F.array_distinct(F.transform("f", lambda x: x["component"])).alias("components"), F.transform("l", lambda x: x["item"]).alias("unknown"))


def component_map(members: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, key, component): of components that share a key the last in order counts; ``members(keys, place, component, key)``."""
    return members.where("key <> ''").groupBy(*keys, "key").agg(F.max_by("component", "place").alias("component"))


def objects_of(components: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, objects): representatives of the wanted components (keys, component) in component order (place)."""
    met = components.join(wanted.select(*keys, "component").distinct(), [*keys, "component"], "left_semi")
    packed = met.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", "representative"))).alias("p"))
    return packed.select(*keys, F.transform("p", lambda x: x["representative"]).alias("objects"))


def collapse(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, objects): a prediction with each component's items as its representative, once, and each key once, in order.

    ``items(keys, pos, item, key, component, representative,
    representative_key)`` with a null component where an item has none.
    """
    value = F.coalesce("representative", "item")
    each = items.withColumn("value", value).withColumn("value_key", F.when(F.col("component").isNotNull(), F.col("representative_key")).otherwise(F.col("key")))
    # the first item of a component stands for it; then the first of each key stays
    group = F.coalesce(F.concat(F.lit("c:"), F.col("component").cast("string")), F.concat(F.lit("i:"), F.col("pos").cast("string")))
    by_component = each.groupBy(*keys, group.alias("group")).agg(F.min(F.struct("pos", "value", "value_key")).alias("f")).select(*keys, "f.*")
    by_key = by_component.groupBy(*keys, "value_key").agg(F.min(F.struct("pos", "value")).alias("f"))
    packed = by_key.groupBy(*keys).agg(F.array_sort(F.collect_list("f")).alias("p"))
    return packed.select(*keys, F.transform("p", lambda x: x["value"]).alias("objects"))


def representatives(members: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, component, representative): the surface that stands for each component.

    Numbers: the text at which the running strength, by value, reaches half.
    Names: no acronym before one, then by selections, strength, length up to
    80, text.  ``members(keys, component, item, value, strength, n_selected)``;
    a null value is a name.
    """
    on = [*keys, "component"]
    w = Window.partitionBy(*on)
    weight = F.greatest(F.lit(1e-6), F.coalesce("strength", F.lit(0.0)))
    run = members.where("value IS NOT NULL").withColumn("w", weight).withColumn("run", F.sum("w").over(w.orderBy("value", "item").rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("half", F.sum("w").over(w) / 2)
    number = run.where(F.col("run") >= F.col("half")).groupBy(*on).agg(F.min(F.struct("value", "item")).alias("b")).select(*on, F.col("b.item").alias("representative"))
    order = F.struct(text.acronym(F.col("item")).isNull(), F.col("n_selected"), F.coalesce("strength", F.lit(0.0)), F.least(F.length("item"), F.lit(80)), F.col("item"))
    name = members.groupBy(*on).agg(F.max_by("item", order).alias("representative"))
    return name.join(number.withColumnRenamed("representative", "number"), on, "left").select(*on, F.coalesce("number", "representative").alias("representative"))


# -- routes and events --------------------------------------------------------------------


def attach_route(candidates: DataFrame, evidence: DataFrame, keys: Sequence[str], route: str, family: str, samples: int, least: int) -> DataFrame:
    """Candidates (keys, key, item, routes) with ``route`` added to those that ``evidence(keys, key, item, generations)`` names, and new ones for the rest.

    ``routes`` maps route to struct<family, support, samples, support_rate,
    selected, generations>; a route selects what ``least`` generations back.
    """
    n = F.size("generations")
    entry = F.struct(F.lit(family).alias("family"), n.alias("support"), F.lit(samples).alias("samples"), (n / F.lit(float(samples))).alias("support_rate"), (n >= least).alias("selected"), F.col("generations").alias("generations"))
    fresh = evidence.select(*keys, "key", F.col("item").alias("__item"), F.map_from_arrays(F.array(F.lit(route)), F.array(entry)).alias("__route"))
    met = candidates.join(fresh, [*keys, "key"], "full")
    older = F.when(F.col("__route").isNull(), F.col("routes")).otherwise(F.map_filter("routes", lambda k, v: k != route))
    merged = F.when(F.col("routes").isNull(), F.col("__route")).when(F.col("__route").isNull(), F.col("routes")).otherwise(F.map_concat(older, F.col("__route")))
    return met.select(*keys, "key", F.coalesce("item", "__item").alias("item"), merged.alias("routes"), F.col("item").isNull().alias("admitted"))


def replace_route_events(events: DataFrame, edges: DataFrame, records: DataFrame, keys: Sequence[str], route: str, family: str) -> tuple[DataFrame, DataFrame]:
    """Events and edges with a route's events replaced by one exact event a generation.

    ``records(keys, generation, status, components, claims, sha256)`` has every
    generation; each event supports its components with weight 1 / generations.
    Edges at a removed event go with it.
    """
    old = events.where(F.col("route") == route).select(*keys, "id")
    kept = events.where(~F.col("route").eqNullSafe(route))
    bare = edges.join(old.withColumnRenamed("id", "source"), [*keys, "source"], "left_anti").join(old.withColumnRenamed("id", "target"), [*keys, "target"], "left_anti")
    name = F.concat(F.lit(f"evidence:{route}:generation:"), F.col("generation").cast("string"))
    total = records.groupBy(*keys).agg(F.count(F.lit(1)).alias("samples"))
    fresh = records.join(total, list(keys)).select(*keys, name.alias("id"), F.lit("evidence_event").alias("node_type"), F.lit(route).alias("route"), F.lit(family).alias("model_family"), F.col("generation").alias("generation_index"), "status", "claims", "sha256", "components", "samples")
    support = fresh.select(*keys, F.col("id").alias("source"), F.explode("components").alias("target"), F.lit("supports").alias("edge_type"), (1 / F.col("samples")).alias("weight"))
    return kept.unionByName(fresh.drop("components", "samples"), allowMissingColumns=True), bare.unionByName(support, allowMissingColumns=True)


def support_bounds(records: DataFrame, claimed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, component, actual, least, samples): components whose exact support is below the claimed one or above the generations.

    ``claimed(keys, component, rate)`` is the largest support rate of any of a
    component's surfaces on the route.  Union support may exceed it, not fall short.
    """
    total = records.groupBy(*keys).agg(F.count(F.lit(1)).alias("samples"))
    hits = records.select(*keys, F.explode("components").alias("component")).groupBy(*keys, "component").agg(F.count(F.lit(1)).alias("actual"))
    met = claimed.join(total, list(keys)).join(hits, [*keys, "component"], "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    least = F.ceil(F.col("rate") * F.col("samples") - 1e-9)
    return met.withColumn("least", least).where((F.col("actual") < F.col("least")) | (F.col("actual") > F.col("samples"))).select(*keys, "component", "actual", "least", "samples")


def evidence_graph(nodes: DataFrame, edges: DataFrame, routes: dict[str, tuple[str, DataFrame]], claimed: dict[str, DataFrame], keys: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, problems): a relational graph with the exact events of every route, repaired, and its states.

    ``routes`` gives each route's family and records.  Problems are support
    below a claim and what ``event_violations`` still finds; a caller that must
    not go on with them passes them to ``contracts.require``.
    """
    spark = nodes.sparkSession
    kinds = {f.name: f.dataType for f in nodes.schema}
    event_schema = ", ".join(f"`{k}` {kinds[k].simpleString()}" for k in keys) + ", id string, node_type string, route string, model_family string, generation_index int, status string, claims array<string>, sha256 string"
    events = spark.createDataFrame([], event_schema)
    out, problems = edges, None
    for route, (family, records) in routes.items():
        events, out = replace_route_events(events, out, records, keys, route, family)
        if route in claimed:
            low = support_bounds(records, claimed[route], keys).select(*keys, F.concat(F.lit(f"{route}:"), F.col("component")).alias("id"), F.lit("support_below_claim").alias("problem"))
            problems = low if problems is None else problems.unionByName(low)
    events, out = repair_events(events, out, keys)
    states = state_edges(events, out, keys)
    out = out.unionByName(states, allowMissingColumns=True)
    left = event_violations(events, out, keys)
    problems = left if problems is None else problems.unionByName(left)
    dims = states.select(*keys, F.col("target").alias("id"), F.split("target", ":")[0].alias("node_type")).distinct()
    every = nodes.unionByName(events, allowMissingColumns=True).unionByName(dims, allowMissingColumns=True)
    return every, out, problems


def by_id(rows: DataFrame, keys: Sequence[str], prefix: str, index: str, value: str) -> DataFrame:
    """(keys, lookup): a map from ``prefix:index`` to ``value`` for each key's few rows."""
    name = F.concat(F.lit(f"{prefix}:"), F.col(index).cast("string"))
    return rows.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, F.col(value))))).alias("lookup"))


def component_routes(members: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, component, route, member_count, max_support_rate, component_support_rate, generations, samples, selected).

    ``members(keys, component, route, support_rate, samples, generations,
    selected)`` has a row for each surface's route.  Surfaces that one
    generation names are one piece of evidence: where generations are known
    the component's support is their union over the samples.
    """
    on = [*keys, "component", "route"]
    got = members.groupBy(*on).agg(F.count(F.lit(1)).alias("member_count"), F.max("support_rate").alias("max_support_rate"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("generations")))).alias("generations"), F.max("samples").alias("samples"), F.bool_or("selected").alias("selected"))
    n = F.size("generations")
    rate = F.when((n > 0) & (F.col("samples") > 0), n / F.greatest("samples", F.lit(1))).otherwise(F.col("max_support_rate"))
    return got.select(*on, "member_count", "max_support_rate", rate.alias("component_support_rate"), "generations", "samples", "selected")


def co_occurrence_edges(events: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, source, target, edge_type, n, rate, by_family, by_route) of components that parseable events support together.

    The rate is over all of a key's parseable events, also those that support nothing.
    """
    good = events.where(F.col("status").isin("candidate_set", "explicit_none"))
    total = good.groupBy(*keys).agg(F.count(F.lit(1)).alias("parseable"))
    sets = edges.where("edge_type = 'supports'").groupBy(*keys, F.col("source").alias("id")).agg(F.array_sort(F.collect_set("target")).alias("items"))
    left = good.join(sets, [*keys, "id"]).select(*keys, "model_family", "route", "items", F.posexplode("items").alias("i", "source"))
    pairs = left.select(*keys, "model_family", "route", "source", F.explode(F.slice("items", F.col("i") + 2, F.size("items"))).alias("target"))
    cells = pairs.groupBy(*keys, "source", "target", "model_family", "route").agg(F.count(F.lit(1)).alias("n"))
    on = [*keys, "source", "target"]
    by = lambda c, out: cells.groupBy(*on, c).agg(F.sum("n").alias("n")).groupBy(*on).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(c, "n")))).alias(out))
    met = cells.groupBy(*on).agg(F.sum("n").alias("n")).join(by("model_family", "by_family"), on).join(by("route", "by_route"), on).join(total, list(keys))
    return met.select(*on, F.lit("co_occurs_with").alias("edge_type"), "n", (F.col("n") / F.greatest("parseable", F.lit(1))).alias("rate"), "by_family", "by_route")


def claim_edges(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, source, target, edge_type, risk) from parseable events to what their reasoning claims."""
    good = events.where(F.col("status").isin("candidate_set", "explicit_none"))
    each = good.select(*keys, F.col("id").alias("source"), F.explode("claims").alias("claim"))
    return each.select(*keys, "source", F.concat(F.lit("claim:"), "claim").alias("target"), F.lit("asserts_claim").alias("edge_type"), F.col("claim").isin(*text.RISKS).alias("risk"))


def hypothesis_order(hyps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``hyps`` with ``place``: the incumbent first, then by tokens."""
    return hyps.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("is_incumbent"), "tokens")) - 1)
