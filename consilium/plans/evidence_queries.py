"""Queries of candidates, components, events, hypotheses and decoding layers, beside their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decode, graph, relational
from .base import answers, of_largest, query, table, user_votes

KEYS = ["user_id"]
FAMILY = ("f0", "f1", "f2")


def _agent() -> F.Column:
    return F.concat(F.lit("a"), (F.col("event_id") % 3).cast("string"))


# -- candidates ----------------------------------------------------------------------------


@query("""WITH c AS (SELECT c_nationkey AS k, c_custkey AS idx, lower(c_mktsegment) AS base, CASE c_custkey % 3 WHEN 0 THEN lower(c_mktsegment) WHEN 1 THEN lower(c_mktsegment) || ' note' ELSE lower(c_mktsegment) || ' group' END AS form, CASE c_custkey % 3 WHEN 2 THEN lower(c_mktsegment) || ' group' ELSE lower(c_mktsegment) END AS b FROM customer WHERE c_acctbal > 5000)
 SELECT l.k, l.idx AS "left", r.idx AS "right", CASE WHEN l.form = r.form THEN 'normalized_exact' ELSE 'parenthetical_alias' END AS rule, CASE WHEN l.form = r.form THEN 1.0 ELSE 0.98 END::DOUBLE AS confidence, false AS blocked FROM c l JOIN c r ON l.k = r.k AND l.idx < r.idx AND (l.form = r.form OR l.b = r.b)""")
def equivalences(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("c_custkey") % 3
    item = F.when(kind == 0, F.col("c_mktsegment")).when(kind == 1, F.concat(F.lower("c_mktsegment"), F.lit(" (Note)"))).otherwise(F.concat("c_mktsegment", F.lit(" Group")))
    c = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("idx"), item.alias("item"))
    return graph.equivalences(c, ["k"])


@query("SELECT user_id, event_type AS key FROM events WHERE value > 45 GROUP BY ALL HAVING NOT (count(DISTINCT event_id % 3) = 1 AND min(event_id % 3) = 2)")
def eligible_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.eligible_candidates(_routed(spark, sf_dir), "a2").select("user_id", "key")


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = answers(spark, sf_dir).where("value > 45").groupBy("user_id", F.col("event_type").alias("key"), _agent().alias("route")).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("user_id", "key").agg(F.map_from_entries(F.collect_list(F.struct("route", "n"))).alias("routes"))


@query("""WITH e AS (SELECT user_id, event_type AS key FROM events WHERE value > 45 GROUP BY ALL HAVING NOT (count(DISTINCT event_id % 3) = 1 AND min(event_id % 3) = 2) )
 SELECT DISTINCT user_id, substr(key, 1, 1) IN ('p', 's') AS component FROM e""")
def eligible_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = _routed(spark, sf_dir).withColumn("idx", F.col("key")).withColumn("component", F.substring("key", 1, 1).isin("p", "s"))
    good = graph.eligible_candidates(every, "a2")
    return graph.eligible_components(every.select("user_id", "component").distinct(), every.select("user_id", "component", "idx"), good, KEYS)


@query("""WITH p AS (SELECT user_id, 'a' || (event_id % 3) AS agent, event_type AS key, count(*) AS support FROM events WHERE value > 20 GROUP BY ALL), x AS (SELECT user_id, 'a' || (event_id % 3) AS agent, event_type AS key, count(*) AS n FROM events WHERE value > 40 OR value < 1 GROUP BY ALL), s AS (SELECT DISTINCT user_id, 'a' || (event_id % 3) AS agent, event_type AS key, true AS selected FROM events WHERE value BETWEEN 25 AND 30)
 SELECT user_id, agent, key, upper(key) AS item, coalesce(n, support) AS support, coalesce(selected, false) AS selected FROM p FULL JOIN x USING (user_id, agent, key) LEFT JOIN s USING (user_id, agent, key) WHERE n IS NOT NULL OR selected""")
def aligned_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = answers(spark, sf_dir).withColumns({"agent": _agent(), "key": F.col("event_type"), "item": F.upper("event_type")})
    count = lambda rows: rows.groupBy("user_id", "agent", "key", "item").agg(F.count(F.lit(1)).alias("support"))
    return graph.aligned_candidates(count(a.where("value > 20")), count(a.where("value > 40 OR value < 1")), a.where("value BETWEEN 25 AND 30"), KEYS)


# -- components ----------------------------------------------------------------------------


def _lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("component", (F.col("p_partkey") % 50).cast("string"))
    c = p.groupBy("p_brand", "component").agg(F.collect_set(F.lower("p_name")).alias("member_keys"), F.array_distinct(F.collect_list(F.concat(F.lit("numeric:"), F.col("p_size").cast("string")))).alias("item_keys"), F.min("p_type").alias("representative_key"))
    return graph.component_keys(c, ["p_brand"])


LOOKUP = "k AS (SELECT p_brand, (p_partkey % 50)::VARCHAR AS component, lower(p_name) AS key FROM part UNION SELECT p_brand, (p_partkey % 50)::VARCHAR, unnest(['numeric:' || p_size, p_size::VARCHAR]) FROM part UNION SELECT p_brand, (p_partkey % 50)::VARCHAR, min(p_type) FROM part GROUP BY ALL)"


@query(f"WITH {LOOKUP} SELECT * FROM k")
def component_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lookup(spark, sf_dir).select("p_brand", "component", "key")


@query(f"WITH {LOOKUP} SELECT p_brand, key FROM k GROUP BY ALL HAVING count(DISTINCT component) > 1")
def ambiguous_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.ambiguous_keys(_lookup(spark, sf_dir), ["p_brand"])


@query("""WITH f AS (SELECT user_id, CAST(ts AS DATE) AS owner, event_type AS t, min(event_id) AS pos FROM events WHERE event_type <> 'error' GROUP BY ALL), c AS (SELECT user_id, owner, string_agg('c:' || t, ',' ORDER BY pos) AS components FROM f GROUP BY ALL), u AS (SELECT user_id, CAST(ts AS DATE) AS owner, string_agg('ERROR', ',' ORDER BY event_id) FILTER (event_type = 'error') AS unknown FROM events GROUP BY ALL)
 SELECT u.user_id, u.owner, coalesce(components, '') AS components, coalesce(unknown, '') AS unknown FROM u LEFT JOIN c USING (user_id, owner)""")
def map_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = answers(spark, sf_dir)
    lookup = a.where("event_type <> 'error'").select("user_id", F.concat(F.lit("c:"), "event_type").alias("component"), F.col("event_type").alias("key")).distinct()
    items = a.select("user_id", F.col("day").alias("owner"), F.col("event_id").alias("pos"), F.upper("event_type").alias("item"), F.array(F.upper("event_type"), "event_type").alias("spellings"))
    got = graph.map_items(items, lookup, KEYS)
    return got.select("user_id", "owner", F.array_join("components", ",").alias("components"), F.array_join("unknown", ",").alias("unknown"))


@query("SELECT p_brand, lower(p_name) AS key, max_by(p_partkey % 50, p_partkey) AS component FROM part GROUP BY ALL")
def component_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "part").select("p_brand", F.lower("p_name").alias("key"), (F.col("p_partkey") % 50).alias("component"), F.col("p_partkey").alias("place"))
    return graph.component_map(m, ["p_brand"])


@query("WITH c AS (SELECT p_brand, p_partkey % 50 AS component, min(p_partkey) AS place, min(p_name) AS r FROM part GROUP BY ALL), w AS (SELECT DISTINCT p_brand, p_partkey % 50 AS component FROM part WHERE p_size > 45) SELECT p_brand, string_agg(r, '|' ORDER BY place) AS objects FROM c JOIN w USING (p_brand, component) GROUP BY 1")
def objects_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("component", F.col("p_partkey") % 50)
    c = p.groupBy("p_brand", "component").agg(F.min("p_partkey").alias("place"), F.min("p_name").alias("representative"))
    return graph.objects_of(c, p.where("p_size > 45"), ["p_brand"]).select("p_brand", F.array_join("objects", "|").alias("objects"))


@query("""WITH i AS (SELECT user_id, event_id AS pos, event_type AS item, CASE WHEN event_type IN ('view', 'click') THEN 'seen' WHEN event_type = 'purchase' THEN 'bought' END AS r FROM events WHERE value > 40), g AS (SELECT user_id, min(pos) AS pos, coalesce(r, item) AS value FROM i GROUP BY user_id, coalesce(r, item)) SELECT user_id, string_agg(value, '|' ORDER BY pos) AS objects FROM g GROUP BY 1""")
def collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.when(F.col("event_type").isin("view", "click"), "seen").when(F.col("event_type") == "purchase", "bought")
    items = answers(spark, sf_dir).where("value > 40").select("user_id", F.col("event_id").alias("pos"), F.col("event_type").alias("item"), F.col("event_type").alias("key"), r.alias("component"), r.alias("representative"), r.alias("representative_key"))
    return graph.collapse(items, KEYS).select("user_id", F.array_join("objects", "|").alias("objects"))


@query("""WITH m AS (SELECT c_nationkey AS k, c_mktsegment AS c, c_name AS item, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal END AS v, c_custkey % 5 AS s, c_custkey % 3 AS n FROM customer WHERE c_acctbal > 0),
 w AS (SELECT *, sum(greatest(1e-6, s)) OVER (PARTITION BY k, c ORDER BY v, item ROWS UNBOUNDED PRECEDING) AS run, sum(greatest(1e-6, s)) OVER (PARTITION BY k, c) / 2 AS half FROM m WHERE v IS NOT NULL)
 SELECT k, c AS component, item AS representative FROM w WHERE run >= half QUALIFY row_number() OVER (PARTITION BY k, c ORDER BY v, item) = 1 UNION ALL SELECT k, c, item FROM m WHERE v IS NULL QUALIFY row_number() OVER (PARTITION BY k, c ORDER BY n DESC, s DESC, least(length(item), 80) DESC, item DESC) = 1""")
def representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").where("c_acctbal > 0")
    m = c.select(F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("component"), F.col("c_name").alias("item"), F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_acctbal")).alias("value"), (F.col("c_custkey") % 5).cast("double").alias("strength"), (F.col("c_custkey") % 3).alias("n_selected"))
    return graph.representatives(m, ["k"])


# -- routes and events -----------------------------------------------------------------------


@query("""WITH b AS (SELECT DISTINCT user_id, event_type AS key FROM events WHERE value > 60), e AS (SELECT user_id, event_type AS key, list_sort(list(DISTINCT day)) AS g FROM (SELECT user_id, event_type, day(ts)::INT AS day FROM events WHERE value BETWEEN 30 AND 50) GROUP BY ALL)
 SELECT user_id, key, b.key IS NULL AS admitted, coalesce(len(g), 0)::INT AS support, coalesce(len(g) >= 3, false) AS selected, CASE WHEN b2.key IS NULL THEN 1 ELSE 1 + (g IS NOT NULL)::INT END AS n_routes FROM (SELECT user_id, key FROM b UNION SELECT user_id, key FROM e) u LEFT JOIN b USING (user_id, key) LEFT JOIN b b2 USING (user_id, key) LEFT JOIN e USING (user_id, key)""")
def attach_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = answers(spark, sf_dir).withColumns({"key": F.col("event_type"), "item": F.col("event_type")})
    entry = F.struct(F.lit("f0").alias("family"), F.lit(1).alias("support"), F.lit(1).alias("samples"), F.lit(1.0).alias("support_rate"), F.lit(True).alias("selected"), F.expr("cast(array() as array<int>)").alias("generations"))
    base = a.where("value > 60").select("user_id", "key", "item").distinct().withColumn("routes", F.create_map(F.lit("first"), entry))
    evidence = a.where("value BETWEEN 30 AND 50").groupBy("user_id", "key", "item").agg(F.array_sort(F.collect_set(F.dayofmonth("day"))).alias("generations"))
    got = graph.attach_route(base, evidence, KEYS, "second", "f1", 10, 3)
    second = F.try_element_at("routes", F.lit("second"))
    return got.select("user_id", "key", "admitted", F.coalesce(second["support"], F.lit(0)).alias("support"), F.coalesce(second["selected"], F.lit(False)).alias("selected"), F.size("routes").alias("n_routes"))


def _records(spark: SparkSession, sf_dir: str, agent: int) -> DataFrame:
    """Generations of an agent: a user's days, which state the types of large values; a day without one states nothing, an unparsed one is odd."""
    a = answers(spark, sf_dir).where(F.col("event_id") % 3 == agent)
    got = a.groupBy("user_id", "day").agg(F.array_sort(F.collect_set(F.when(F.col("value") > 15, F.concat(F.lit("component:"), "event_type")))).alias("components"), F.max("value").alias("top"))
    status = F.when(F.size("components") > 0, "candidate_set").when(F.col("top") > 5, "explicit_none").otherwise("unparsed_or_no_candidate")
    return got.select("user_id", F.datediff("day", F.lit("2024-01-01").cast("date")).alias("generation"), status.alias("status"), "components", F.expr("cast(array() as array<string>)").alias("claims"), F.sha2(F.col("day").cast("string"), 256).alias("sha256"))


def _full_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    types = answers(spark, sf_dir).select("user_id", F.concat(F.lit("component:"), "event_type").alias("id")).distinct().withColumn("node_type", F.lit("candidate_component"))
    edges = types.select("user_id", F.lit("null").alias("source"), F.col("id").alias("target"), F.lit("contradicts").alias("edge_type"))
    claimed = answers(spark, sf_dir).where("event_id % 3 = 0 AND value > 15").groupBy("user_id", F.concat(F.lit("component:"), "event_type").alias("component")).agg((F.count_distinct("day") / 9.0).alias("rate"))
    routes = {f"r{i}": (FAMILY[i], _records(spark, sf_dir, i)) for i in range(3)}
    return graph.evidence_graph(types, edges, routes, {"r0": claimed}, KEYS)


DAYS = "d AS (SELECT user_id, event_id % 3 AS a, CAST(ts AS DATE) AS day, list_sort(list(DISTINCT 'component:' || event_type) FILTER (value > 15)) AS c, max(value) AS top FROM events GROUP BY ALL), g AS (SELECT user_id, a, date_diff('day', DATE '2024-01-01', day) AS generation, coalesce(c, []) AS c, CASE WHEN len(c) > 0 THEN 'candidate_set' WHEN top > 5 THEN 'explicit_none' ELSE 'unparsed_or_no_candidate' END AS status FROM d)"


@query(f"""WITH {DAYS}, s AS (SELECT user_id, unnest(CASE WHEN len(c) = 0 THEN ['cardinality:ZERO', 'existence:EMPTY'] WHEN len(c) = 1 THEN ['cardinality:ONE', 'existence:NONEMPTY'] ELSE ['cardinality:MANY', 'existence:NONEMPTY'] END) AS id FROM g WHERE status <> 'unparsed_or_no_candidate')
 SELECT user_id, 'candidate_component' AS node_type, count(DISTINCT event_type) AS n FROM events GROUP BY 1 UNION ALL SELECT user_id, 'evidence_event', count(*) FROM g GROUP BY 1 UNION ALL SELECT user_id, split_part(id, ':', 1), count(DISTINCT id) FROM s GROUP BY ALL""")
def evidence_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the whole evidence graph, by type."""
    nodes, _, _ = _full_graph(spark, sf_dir)
    return nodes.groupBy("user_id", "node_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {DAYS} SELECT user_id, 'contradicts' AS edge_type, count(DISTINCT event_type) AS n, 0.0 AS weight FROM events GROUP BY 1
 UNION ALL SELECT user_id, 'supports', sum(len(c)), round(sum(len(c) / n), 6) FROM (SELECT *, count(*) OVER (PARTITION BY user_id, a) AS n FROM g) GROUP BY 1 HAVING sum(len(c)) > 0 UNION ALL SELECT user_id, 'asserts', 2 * count(*), 0.0 FROM g WHERE status <> 'unparsed_or_no_candidate' GROUP BY 1""")
def evidence_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the whole evidence graph, by type, with the weight of supports."""
    _, edges, _ = _full_graph(spark, sf_dir)
    return edges.groupBy("user_id", "edge_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.sum("weight"), F.lit(0.0)), 6).alias("weight"))


@query(f"""WITH {DAYS}, t AS (SELECT user_id, count(*) AS samples FROM g WHERE a = 0 GROUP BY 1), h AS (SELECT user_id, component, count(*) AS actual FROM (SELECT user_id, unnest(c) AS component FROM g WHERE a = 0) GROUP BY ALL)
 SELECT user_id, component, actual, ceil(actual / 9.0 * samples - 1e-9)::BIGINT AS least, samples FROM h JOIN t USING (user_id) WHERE actual < ceil(actual / 9.0 * samples - 1e-9)""")
def support_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components whose claimed rate, of nine generations, is more than the exact events of all show."""
    claimed = answers(spark, sf_dir).where("event_id % 3 = 0 AND value > 15").groupBy("user_id", F.concat(F.lit("component:"), "event_type").alias("component")).agg((F.count_distinct("day") / 9.0).alias("rate"))
    return graph.support_bounds(_records(spark, sf_dir, 0), claimed, KEYS)


def _events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Days as events of a family, stating the types of values above 15."""
    records = [_records(spark, sf_dir, i).withColumns({"id": F.concat_ws(":", F.lit(str(i)), F.col("generation").cast("string")), "model_family": F.lit(FAMILY[i])}) for i in range(3)]
    every = records[0].unionByName(records[1]).unionByName(records[2])
    edges = every.select("user_id", F.col("id").alias("source"), F.explode("components").alias("target"), F.lit("supports").alias("edge_type"))
    return every.select("user_id", "id", "model_family", "status", "claims"), edges


@query(f"WITH {DAYS} SELECT user_id, a || ':' || generation AS id, 'f' || a AS family, array_to_string(c, ',') AS tokens, len(c)::INT AS exact_cardinality, len(c) > 0 AS \"exists\" FROM g WHERE status <> 'unparsed_or_no_candidate'")
def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = graph.event_records(*_events(spark, sf_dir), KEYS)
    return got.withColumn("tokens", F.array_join("tokens", ","))


@query(f"WITH {DAYS} SELECT user_id, target, count(*) AS n FROM (SELECT user_id, unnest(CASE WHEN len(c) = 0 THEN ['cardinality:ZERO', 'existence:EMPTY'] WHEN len(c) = 1 THEN ['cardinality:ONE', 'existence:NONEMPTY'] ELSE ['cardinality:MANY', 'existence:NONEMPTY'] END) AS target FROM g WHERE status <> 'unparsed_or_no_candidate') GROUP BY ALL")
def state_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.state_edges(*_events(spark, sf_dir), KEYS).groupBy("user_id", "target").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id::VARCHAR AS id, CASE WHEN event_type = 'click' THEN 'unsupported_candidate_set' WHEN event_type = 'view' THEN 'supported_explicit_none' END AS problem FROM events WHERE event_type = 'click' AND value < 20 OR event_type = 'view' AND value >= 20 UNION ALL SELECT 'lost:' || event_id, 'orphan_support' FROM events WHERE event_type = 'error' AND value > 100""")
def event_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("id", F.col("event_id").cast("string"))
    events = e.select("user_id", "id", F.when(F.col("event_type") == "click", "candidate_set").when(F.col("event_type") == "view", "explicit_none").otherwise("other").alias("status"))
    lost = e.where("event_type = 'error' AND value > 100").withColumn("id", F.concat(F.lit("lost:"), "id"))
    edges = e.where("value >= 20").unionByName(lost).select("user_id", F.col("id").alias("source"), F.lit("t").alias("target"), F.lit("supports").alias("edge_type"))
    return graph.event_violations(events, edges, KEYS).select("id", "problem")


@query("SELECT x.user_id, 'component:' || x.event_type AS \"left\", 'component:' || y.event_type AS \"right\", count(*) AS n_events FROM (SELECT DISTINCT user_id, event_id % 3 AS a, CAST(ts AS DATE) AS d, event_type FROM events WHERE value > 15) x JOIN (SELECT DISTINCT user_id, event_id % 3 AS a, CAST(ts AS DATE) AS d, event_type FROM events WHERE value > 15) y ON x.user_id = y.user_id AND x.a = y.a AND x.d = y.d AND x.event_type < y.event_type GROUP BY ALL")
def component_co_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.component_co_occurrence(_events(spark, sf_dir)[1], KEYS)


# -- hypotheses and proofs ---------------------------------------------------------------------


def _hypotheses(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    records = graph.event_records(*_events(spark, sf_dir), KEYS)
    incumbents = user_votes(spark, sf_dir).where("votes >= 11").groupBy("user_id").agg(F.array_sort(F.collect_list(F.concat(F.lit("component:"), "item"))).alias("tokens"))
    users = answers(spark, sf_dir).select("user_id").distinct()
    every = users.join(incumbents, "user_id", "left").withColumn("tokens", F.coalesce("tokens", F.expr("cast(array() as array<string>)")))
    return graph.hypotheses(records, every, KEYS), records


HYPOTHESES = f"""{DAYS}, r AS (SELECT user_id, a, c AS tokens, a || ':' || generation AS id FROM g WHERE status <> 'unparsed_or_no_candidate'),
 u AS (SELECT DISTINCT user_id FROM events), v AS (SELECT user_id, event_type AS item, count(DISTINCT CAST(ts AS DATE)) AS votes FROM events GROUP BY ALL), i AS (SELECT user_id, coalesce(list_sort(list('component:' || item) FILTER (votes >= 11)), []) AS tokens, true AS inc FROM u LEFT JOIN v USING (user_id) GROUP BY 1),
 s AS (SELECT user_id, tokens, list_sort(list(DISTINCT 'f' || a)) AS families, count(*) AS n FROM r GROUP BY ALL),
 h AS (SELECT user_id, tokens, coalesce(inc, false) AS is_incumbent, coalesce(families, []) AS families, coalesce(n, 0) AS n FROM s FULL JOIN i USING (user_id, tokens))"""


@query(f"WITH {HYPOTHESES} SELECT user_id, array_to_string(tokens, ',') AS tokens, is_incumbent, array_to_string(families, ',') AS families, n AS n_events FROM h")
def hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    got, _ = _hypotheses(spark, sf_dir)
    return got.select("user_id", F.array_join("tokens", ",").alias("tokens"), "is_incumbent", F.array_join("families", ",").alias("families"), F.size("event_ids").cast("long").alias("n_events"))


F1 = "CASE WHEN len(h.tokens) + len(r.tokens) = 0 THEN 1.0 ELSE 2.0 * len(list_intersect(h.tokens, r.tokens)) / (len(h.tokens) + len(r.tokens)) END"
METRICS = f"""{HYPOTHESES}, x AS (SELECT h.user_id, h.tokens, f.a, coalesce(max({F1}), 0) AS similarity, coalesce(avg((h.tokens = r.tokens)::INT), 0) AS exact FROM h CROSS JOIN (VALUES (0), (1), (2)) f(a) LEFT JOIN r ON r.user_id = h.user_id AND r.a = f.a GROUP BY ALL),
 y AS (SELECT user_id, tokens, min(similarity) AS minimum_similarity, avg(similarity) AS mean_similarity, avg(exact) AS within_family_exact_rate_mean FROM x GROUP BY ALL),
 z AS (SELECT x.user_id, x.tokens, coalesce(avg(similarity), 1.0) AS independent_similarity FROM x JOIN h USING (user_id, tokens) WHERE NOT list_contains(families, 'f' || a) GROUP BY ALL),
 q AS (SELECT h.user_id, h.tokens, avg((len(r.tokens) = len(h.tokens))::INT) AS exact_cardinality_match_rate, avg(((len(r.tokens) > 0) = (len(h.tokens) > 0))::INT) AS existence_match_rate FROM h JOIN r USING (user_id) GROUP BY ALL),
 p AS (SELECT h.*, len(families) / 3 AS exact_family_fraction, minimum_similarity, mean_similarity, within_family_exact_rate_mean, coalesce(independent_similarity, 1.0) AS independent_similarity, exact_cardinality_match_rate, existence_match_rate, len(h.tokens)::DOUBLE AS set_size FROM h JOIN y USING (user_id, tokens) LEFT JOIN z USING (user_id, tokens) JOIN q USING (user_id, tokens))""".replace("r.tokens) = len(h.tokens)", "r.tokens) = len(h.tokens)").replace("h JOIN r USING (user_id)", "h JOIN r ON r.user_id = h.user_id")
NAMES = ("exact_family_fraction", "minimum_similarity", "mean_similarity", "within_family_exact_rate_mean", "independent_similarity", "exact_cardinality_match_rate", "existence_match_rate")


@query(f"WITH {METRICS} SELECT user_id, array_to_string(tokens, ',') AS tokens, is_incumbent, {', '.join(f'round({n}, 9) AS {n}' for n in NAMES)}, set_size FROM p")
def proof_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    hyps, records = _hypotheses(spark, sf_dir)
    got = graph.proof_metrics(hyps, records, KEYS, FAMILY)
    return got.select("user_id", F.array_join("tokens", ",").alias("tokens"), "is_incumbent", *[F.round(n, 9).alias(n) for n in NAMES], "set_size")


RULE = "p.exact_family_fraction + 1e-12 >= 2 / 3 AND p.exact_family_fraction > b.exact_family_fraction + 1e-12 AND p.minimum_similarity + 1e-12 >= 0.5 AND p.set_size <= b.set_size + 1e-12"


@query(f"""WITH {METRICS}, b AS (SELECT * FROM p WHERE is_incumbent), w AS (SELECT p.user_id, p.tokens FROM p JOIN b ON b.user_id = p.user_id WHERE NOT p.is_incumbent AND {RULE}
 QUALIFY row_number() OVER (PARTITION BY p.user_id ORDER BY p.exact_family_fraction DESC, p.minimum_similarity DESC, p.exact_cardinality_match_rate DESC, round(p.mean_similarity, 12) DESC, round(p.within_family_exact_rate_mean, 12) DESC, p.independent_similarity DESC, p.set_size, p.tokens DESC) = 1)
 SELECT b.user_id, array_to_string(coalesce(w.tokens, b.tokens), ',') AS tokens, w.tokens IS NOT NULL AS changed FROM b LEFT JOIN w ON w.user_id = b.user_id""")
def prove(spark: SparkSession, sf_dir: str) -> DataFrame:
    hyps, records = _hypotheses(spark, sf_dir)
    measured = graph.proof_metrics(hyps, records, KEYS, FAMILY)
    rounded = measured.withColumns({c: F.round(c, 12) for c in ("mean_similarity", "within_family_exact_rate_mean")})
    return decode.prove(rounded, KEYS, "support_nonexpanding").withColumn("tokens", F.array_join("tokens", ","))


@query(f"""WITH {DAYS}, r AS (SELECT user_id, len(c) AS size, user_id % 4 AS rel FROM g WHERE status <> 'unparsed_or_no_candidate'), o AS (SELECT user_id, rel, coalesce(lead(user_id) OVER w, first_value(user_id) OVER w) AS donor FROM (SELECT DISTINCT user_id, rel FROM r) WINDOW w AS (PARTITION BY rel ORDER BY user_id))
 SELECT o.user_id, o.rel::VARCHAR AS "Relation", count(*) AS n, count(*) FILTER (size = 0) AS n_empty, count(*) FILTER (size = 2) AS n_two FROM o JOIN r ON r.user_id = o.donor GROUP BY ALL""")
def shifted_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The control arm: each user proves with the sizes that the next user of the same relation states."""
    records = graph.event_records(*_events(spark, sf_dir), KEYS).withColumn("Relation", (F.col("user_id") % 4).cast("string"))
    got = decode.shifted_rates(records, ["user_id", "Relation"])
    of = lambda k: F.coalesce(F.try_element_at("cards", F.lit(k)), F.lit(0)).cast("long")
    return got.select("user_id", "Relation", "n", of(0).alias("n_empty"), of(2).alias("n_two"))


# -- decoding layers -----------------------------------------------------------------------------


WON = "once AS (SELECT user_id, event_type AS item, CAST(ts AS DATE) AS sample, min(event_id) AS pos FROM events GROUP BY ALL), v AS (SELECT user_id, item, count(*) AS votes, min(struct_pack(s := sample, p := pos)) AS f FROM once GROUP BY ALL), w AS (SELECT user_id, item FROM v QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, f) = 1)"


def _won(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import votes

    return votes.plurality(user_votes(spark, sf_dir), KEYS).select("user_id", F.array("item").alias("objects"))


@query(f"""WITH {WON}, s AS (SELECT user_id, item, votes FROM v WHERE votes >= 10), l AS (SELECT user_id, list(item ORDER BY votes DESC, item) AS items, list(votes ORDER BY votes DESC, item) AS n FROM s GROUP BY 1)
 SELECT w.user_id, CASE WHEN w.user_id % 2 = 1 THEN CASE WHEN len(n) > 0 AND (len(n) = 1 OR n[1] > n[2]) THEN items[1] ELSE w.item END ELSE array_to_string(list_concat([w.item], list_filter(coalesce(items, []), lambda x: x <> w.item)), ',') END AS objects FROM w LEFT JOIN l USING (user_id)""")
def support_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = user_votes(spark, sf_dir).select("user_id", F.col("item").alias("key"), "item", F.col("votes").alias("support"))
    rows = _won(spark, sf_dir).withColumn("kind", F.when(F.col("user_id") % 2 == 1, "numeric").otherwise("string"))
    return decode.support_rule(facts, rows, KEYS, 10).select("user_id", F.array_join("objects", ",").alias("objects"))


@query(f"""WITH {WON}, s AS (SELECT user_id, event_type AS key, count(*) = 3 AND max(value) > 30 AS good FROM events WHERE value > 12 AND event_id % 3 = 1 GROUP BY ALL), o AS (SELECT user_id, min(key) AS key FROM s WHERE good GROUP BY 1 HAVING count(*) = 1) SELECT w.user_id, coalesce(o.key, w.item) AS objects, o.key IS NOT NULL AS changed FROM w LEFT JOIN o USING (user_id)""")
def unanimous_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    supply = answers(spark, sf_dir).where("value > 12 AND event_id % 3 = 1").groupBy("user_id", F.col("event_type").alias("key")).agg(F.count(F.lit(1)).alias("support"), (F.max("value") > 30).alias("novel"))
    return decode.unanimous_rule(supply, _won(spark, sf_dir), KEYS).withColumn("objects", F.array_join("objects", ","))


@query(f"""WITH {WON}, l AS (SELECT user_id, max_by(event_type, value) AS led, max(value) > 150 AS switched FROM events WHERE value > 100 GROUP BY 1) SELECT w.user_id, CASE WHEN switched THEN led ELSE w.item END AS objects, coalesce(switched, false) AS changed FROM w LEFT JOIN l USING (user_id)""")
def ledger_veto(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = F.array(of_largest("event_type", "value", "event_id"))
    ledger = answers(spark, sf_dir).where("value > 100").groupBy("user_id").agg(led.alias("objects"), (F.max("value") > 150).alias("switched"))
    return decode.ledger_veto(_won(spark, sf_dir), ledger, KEYS).withColumn("objects", F.array_join("objects", ","))


@query(f"""WITH {WON}, a AS (SELECT w.user_id, w.item AS token, true AS is_keep, 0.0 AS estimate FROM w UNION ALL SELECT e.user_id, e.event_type, false, round(sum(value) / 1000, 6) FROM events e JOIN w ON w.user_id = e.user_id AND w.item <> e.event_type GROUP BY ALL), b AS (SELECT user_id, token, estimate FROM a WHERE NOT is_keep QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY estimate DESC, token DESC) = 1)
 SELECT w.user_id, CASE WHEN estimate > 0.5 THEN token ELSE w.item END AS tokens, coalesce(estimate > 0.5, false) AS changed FROM w LEFT JOIN b USING (user_id)""")
def residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    won = _won(spark, sf_dir)
    keep = won.select("user_id", F.col("objects").alias("tokens"), F.lit(True).alias("is_keep"), F.lit(0.0).alias("estimate"))
    other = answers(spark, sf_dir).groupBy("user_id", "event_type").agg(F.round(F.sum("value") / 1000, 6).alias("estimate")).join(won, "user_id").where(~F.array_contains("objects", F.col("event_type")))
    rows = keep.unionByName(other.select("user_id", F.array("event_type").alias("tokens"), F.lit(False).alias("is_keep"), "estimate"))
    return decode.residual(rows, KEYS, 0.5).withColumn("tokens", F.array_join("tokens", ","))


@query("""WITH r AS (SELECT user_id, event_type AS key, round(avg(value) / 60, 9) AS p FROM events GROUP BY ALL), o AS (SELECT *, row_number() OVER w AS size, sum(p) OVER w AS mass FROM r WINDOW w AS (PARTITION BY user_id ORDER BY p DESC, key ROWS UNBOUNDED PRECEDING)),
 b AS (SELECT user_id, size, 2 * mass / (size + 2.5) AS utility FROM o QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(2 * mass / (size + 2.5), 12) DESC, size) = 1),
 f AS (SELECT user_id, key AS base, 2 * p / (1 + 2.5) AS base_utility FROM r WHERE key = 'view')
 SELECT b.user_id, CASE WHEN coalesce(base_utility, 0) + 0.05 >= utility THEN 'view' ELSE (SELECT string_agg(o.key, ',' ORDER BY o.size) FROM o WHERE o.user_id = b.user_id AND o.size <= b.size) END AS objects, coalesce(base_utility, 0) + 0.05 >= utility AS used_baseline FROM b LEFT JOIN f USING (user_id)""")
def decode_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = answers(spark, sf_dir).groupBy("user_id", F.col("event_type").alias("key")).agg(F.round(F.avg("value") / 60, 9).alias("probability")).withColumn("item", F.col("key"))
    context = scored.select("user_id").distinct().select("user_id", F.lit("string").alias("kind"), F.lit(False).alias("single"), F.lit(True).alias("nullable"), F.lit(0.0).alias("zero"), F.lit(2.5).alias("expected"), F.array(F.lit("view")).alias("baseline"))
    got = decode.decode_cardinality(scored, context, KEYS, 0.05)
    return got.select("user_id", F.array_join("objects", ",").alias("objects"), "used_baseline")


@query("""WITH n AS (SELECT user_id, event_id AS pos, value AS v, CAST(value > 20 AS INT) + 1 AS w FROM events WHERE event_id % 3 = 0 AND value > 0), b AS (SELECT user_id, max(value) AS base FROM events GROUP BY 1),
 a AS (SELECT x.user_id, x.pos, x.v AS anchor, y.v, y.w, y.pos AS p FROM n x JOIN n y ON y.user_id = x.user_id AND abs(y.v - x.v) / greatest(abs(x.v), 1e-12) <= 0.05),
 m AS (SELECT user_id, pos, min(v) AS med FROM (SELECT *, sum(w) OVER (PARTITION BY user_id, pos ORDER BY v, w ROWS UNBOUNDED PRECEDING) AS run, sum(w) OVER (PARTITION BY user_id, pos) / 2 AS half FROM a) WHERE run >= half GROUP BY ALL),
 g AS (SELECT user_id, pos, exp(sum(w * ln(v)) / sum(w)) AS geo FROM a GROUP BY ALL),
 o AS (SELECT user_id, base AS v FROM b UNION ALL SELECT user_id, v FROM n UNION ALL SELECT user_id, med FROM m UNION ALL SELECT user_id, geo FROM g)
 SELECT user_id, count(DISTINCT round(ln(v) * 1e6)) AS n_options, round(min(v), 6) AS low, round(max(v), 6) AS high FROM o GROUP BY 1""")
def numeric_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options of each user's values, counted to a millionth, as logarithms differ in the last digits between engines."""
    a = answers(spark, sf_dir)
    nodes = a.where("event_id % 3 = 0").select("user_id", F.col("event_id").cast("int").alias("pos"), "value", ((F.col("value") > 20).cast("int") + 1).cast("double").alias("weight"))
    got = decode.numeric_options(nodes, a.groupBy("user_id").agg(F.max("value").alias("value")), KEYS)
    return got.groupBy("user_id").agg(F.count_distinct(F.round(F.ln("value") * 1e6)).alias("n_options"), F.round(F.min("value"), 6).alias("low"), F.round(F.max("value"), 6).alias("high"))


@query("""WITH o AS (SELECT user_id, event_id AS place, value, round(1 / (1 + abs(ln(value / 20))), 9) AS p, event_id = min(event_id) OVER (PARTITION BY user_id) AS base FROM events WHERE value > 0), b AS (SELECT user_id, value, p FROM o QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY p DESC, place) = 1), k AS (SELECT user_id, value, p FROM o WHERE base)
 SELECT user_id, CASE WHEN b.p - k.p > 0.3 THEN b.value ELSE k.value END AS value, NOT b.p - k.p > 0.3 AS used_baseline FROM b JOIN k USING (user_id)""")
def switch_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = answers(spark, sf_dir).where("value > 0")
    first = a.groupBy("user_id").agg(F.min("event_id").alias("first"))
    rows = a.join(first, "user_id").select("user_id", "value", F.when(F.col("event_id") == F.col("first"), F.array(F.lit("baseline"))).otherwise(F.array(F.lit("node"))).alias("kinds"), F.col("event_id").alias("place"), F.round(1 / (1 + F.abs(F.ln(F.col("value") / 20))), 9).alias("probability"))
    return decode.switch_numeric(rows, KEYS, 0.3)


@query("""WITH e AS (SELECT user_id, 'f' || (event_id % 3) AS family, CASE WHEN event_type <> 'error' THEN round(value) + 1 END AS v FROM events), t AS (SELECT user_id, family, count(*) AS n FROM e GROUP BY ALL), h AS (SELECT *, floor(v / 25)::INT AS grp FROM e WHERE v IS NOT NULL),
 r AS (SELECT user_id, grp, family, count(*) / any_value(n) AS rate FROM h JOIN t USING (user_id, family) GROUP BY ALL), m AS (SELECT user_id, grp, v FROM (SELECT *, row_number() OVER (PARTITION BY user_id, grp ORDER BY v) AS i, count(*) OVER (PARTITION BY user_id, grp) AS n FROM h) WHERE i = (n + 1) // 2)
 SELECT user_id, grp, v AS value, round(sum(rate), 9) AS mass, round(count(*) / 3, 9) AS family_fraction FROM m JOIN r USING (user_id, grp) GROUP BY ALL""")
def capacity_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = answers(spark, sf_dir).select("user_id", F.col("event_id").alias("id"), F.concat(F.lit("f"), (F.col("event_id") % 3).cast("string")).alias("family"), F.when(F.col("event_type") != "error", F.round("value") + 1).alias("value"))
    groups = events.where("value IS NOT NULL").select("user_id", "value", F.floor(F.col("value") / 25).cast("int").alias("grp")).distinct()
    got = decode.capacity_options(events, groups, KEYS, FAMILY)
    return got.select("user_id", "grp", "value", F.round(F.aggregate(F.map_values("rates"), F.lit(0.0), lambda a, x: a + x), 9).alias("mass"), F.round("family_fraction", 9).alias("family_fraction"))


@query("""WITH s AS (SELECT user_id, round(value) AS value, count(*) AS support FROM events WHERE event_id % 3 = 1 AND value > 50 GROUP BY ALL), e AS (SELECT user_id, value FROM events WHERE event_id % 3 = 0 AND value > 50) SELECT user_id, s.value, support, support = 1 AS unanimous, NOT EXISTS (SELECT 1 FROM e WHERE e.user_id = s.user_id AND abs(s.value - e.value) <= 0.05 * greatest(abs(s.value), abs(e.value))) AS novel FROM s""")
def attach_supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = answers(spark, sf_dir).where("value > 50")
    supply = a.where("event_id % 3 = 1").groupBy("user_id", F.round("value").alias("value")).agg(F.count(F.lit(1)).alias("support"))
    return graph.attach_supply(a.where("event_id % 3 = 0").select("user_id", "value"), supply, KEYS, 1)


@query("""WITH r AS (SELECT s_nationkey AS k, s_name AS name, s_acctbal AS v FROM supplier), t AS (SELECT s_nationkey AS k, s_name AS name, s_acctbal AS v, s_suppkey AS target FROM supplier WHERE s_suppkey % 2 = 0),
 x AS (SELECT r.*, t.target FROM r JOIN t USING (k, name)), o AS (SELECT r.* FROM r ANTI JOIN x USING (k, name)), n AS (SELECT o.k, o.name, count(DISTINCT t.target) AS c, min(t.target) AS target FROM o JOIN t ON t.k = o.k AND abs(o.v - t.v) / greatest(abs(o.v), abs(t.v)) <= 0.05 + 1e-12 GROUP BY ALL)
 SELECT k, name, target, 'exact' AS how FROM x UNION ALL SELECT k, name, target, 'near' FROM n WHERE c = 1""")
def exact_then_unique_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("v"), F.col("s_suppkey").alias("target"))
    return relational.exact_then_unique_near(s.drop("target"), s.where("target % 2 = 0"), ["k"], "name", "v").select("k", "name", "target", "how")


@query("""WITH r AS (SELECT c_nationkey AS k, c_custkey AS id, c_acctbal AS v FROM customer), t AS (SELECT s_nationkey AS k, s_acctbal AS w, s_suppkey AS target FROM supplier), m AS (SELECT r.k, id, target, abs(v - w) AS far, row_number() OVER (PARTITION BY r.k, id ORDER BY abs(v - w), target) AS i, count(*) OVER (PARTITION BY r.k, id, abs(v - w)) AS same FROM r JOIN t ON t.k = r.k AND abs(v - w) / greatest(abs(w), 1e-12) <= 0.05 + 1e-12) SELECT k, id, target FROM m WHERE i = 1 AND same = 1""")
def nearest_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_acctbal").alias("v"), F.col("s_suppkey").alias("target"))
    return relational.nearest(c, s, ["k"], "v").select("k", "id", "target")


@query("SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey")
def required_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer and nation, each of which must have every key."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_nationkey").alias("n_nationkey"))
    met = relational.required_join(orders, {"customers": customers}, ["c_custkey"])
    return relational.required_join(met, {"nations": table(spark, sf_dir, "nation").select("n_nationkey", "n_name")}, ["n_nationkey"]).select("o_orderkey", "c_name", "n_name")


@query("SELECT n_nationkey AS key, 'N' || n_name AS name FROM nation WHERE n_nationkey % 5 = 0 UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 5 IN (1, 2, 3)")
def rekeyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").withColumn("name", F.col("n_name"))
    mapping = n.where("n_nationkey % 5 = 0").select("name", F.concat(F.lit("N"), "name").alias("new_key"))
    return relational.rekey(n.select("n_nationkey", "name"), mapping, "name", n.where("n_nationkey % 5 = 4")).select(F.col("n_nationkey").alias("key"), "name")


@query("SELECT a.user_id, a.m AS \"left\", b.m AS \"right\" FROM (SELECT user_id, max_by(event_type, value) AS m FROM events WHERE event_id % 2 = 0 GROUP BY 1) a JOIN (SELECT user_id, max_by(event_type, value) AS m FROM events WHERE event_id % 2 = 1 GROUP BY 1) b USING (user_id) WHERE a.m <> b.m")
def differing_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = lambda k: answers(spark, sf_dir).where(F.col("event_id") % 2 == k).groupBy("user_id").agg(of_largest("event_type", "value", "event_id").alias("m")).where("m IS NOT NULL")
    return relational.differing(side(0), side(1), KEYS, "m")


@query("SELECT c_nationkey AS k, 'null' AS source, c_mktsegment AS target FROM customer GROUP BY ALL UNION ALL SELECT x.k, x.g, y.g FROM (SELECT DISTINCT c_nationkey AS k, c_mktsegment AS g FROM customer) x JOIN (SELECT DISTINCT c_nationkey AS k, c_mktsegment AS g FROM customer) y ON x.k = y.k AND x.g < y.g WHERE x.k % 2 = 0")
def contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.when(F.col("c_nationkey") % 2 == 0, "one").otherwise("many").alias("Relation"), F.col("c_mktsegment").alias("id")).distinct()
    relations = spark.createDataFrame([("one", True), ("many", False)], "Relation string, single boolean")
    return graph.contradictions(c, relations, ["k", "Relation"]).select("k", "source", "target")


@query("""WITH r AS (SELECT user_id, event_type AS id, 'a' || (event_id % 3) AS route, list(DISTINCT CAST(ts AS DATE)) AS g, max(value) > 60 AS sel FROM events WHERE value > 25 GROUP BY ALL), p AS (SELECT x.user_id, x.id AS source, y.id AS target, len(list_intersect(x.g, y.g)) AS n, x.sel AND y.sel AS chosen FROM r x JOIN r y ON y.user_id = x.user_id AND y.route = x.route AND x.id < y.id)
 SELECT user_id, source, target, CASE WHEN max(n) > 0 THEN 'co_supported_with' WHEN bool_or(chosen) THEN 'co_selected_with' ELSE 'shares_route_with' END AS edge_type FROM p GROUP BY ALL""")
def shared_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = answers(spark, sf_dir).where("value > 25").groupBy("user_id", F.col("event_type").alias("id"), _agent().alias("route")).agg(F.collect_set("day").alias("generations"), (F.max("value") > 60).alias("selected"))
    return graph.shared_routes(r, KEYS).drop("by_route")


@query("WITH s AS (SELECT user_id, event_type AS key, count(DISTINCT event_id % 3) AS n_families, count(DISTINCT event_id % 3) AS n_routes, bool_or(value > 60) AS selected_any, count(DISTINCT event_id % 3) > 1 AS cross_family, count(*) AS total_support FROM events WHERE value > 25 GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n_families DESC, total_support DESC, key) - 1 AS idx FROM s")
def route_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = answers(spark, sf_dir).where("value > 25").groupBy("user_id", F.col("event_type").alias("key"), _agent().alias("route")).agg(F.count(F.lit(1)).alias("support"), (F.max("value") > 60).alias("selected")).withColumn("family", F.col("route"))
    return graph.route_order(graph.route_summary(r, KEYS), KEYS).withColumn("idx", F.col("idx").cast("long"))


@query("WITH s AS (SELECT user_id, event_type AS key, min_by(upper(event_type) || (event_id % 3), event_id) AS item, count(DISTINCT event_id % 3) AS n_proposers, count(*) AS total_support FROM events GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n_proposers DESC, total_support DESC, key) - 1 AS idx FROM s")
def claim_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = answers(spark, sf_dir).withColumn("agent", _agent()).groupBy("user_id", F.col("event_type").alias("key"), "agent").agg(F.count(F.lit(1)).alias("support"), F.min("event_id").alias("pos")).withColumn("item", F.concat(F.upper("key"), F.substring("agent", 2, 1)))
    got = graph.claim_order(graph.merge_candidates(facts, KEYS, ["support"]), KEYS)
    return got.select("user_id", "key", "item", F.size("proposers").cast("long").alias("n_proposers"), "total_support", F.col("idx").cast("long").alias("idx"))


# -- component evidence ------------------------------------------------------------------------------


@query("""WITH s AS (SELECT user_id, substr(event_type, 1, 1) IN ('p', 's') AS c, 'a' || (event_id % 3) AS r, event_type AS t, list(DISTINCT day(ts)::INT) AS g, count(*) / 100.0 AS rate, max(value) > 60 AS sel FROM events GROUP BY ALL)
 SELECT user_id, c AS component, r AS route, count(*) AS member_count, round(max(rate), 9)::DOUBLE AS max_support_rate, round(len(list_distinct(flatten(list(g)))) / 40.0, 9)::DOUBLE AS component_support_rate, bool_or(sel) AS selected FROM s GROUP BY ALL""")
def component_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = answers(spark, sf_dir)
    members = a.groupBy("user_id", F.substring("event_type", 1, 1).isin("p", "s").alias("component"), _agent().alias("route"), "event_type").agg(F.collect_set(F.dayofmonth("day")).alias("generations"), (F.count(F.lit(1)) / 100.0).alias("support_rate"), (F.max("value") > 60).alias("selected")).withColumn("samples", F.lit(40))
    got = graph.component_routes(members, KEYS)
    return got.select("user_id", "component", "route", "member_count", F.round("max_support_rate", 9).alias("max_support_rate"), F.round("component_support_rate", 9).alias("component_support_rate"), "selected")


@query(f"""WITH {DAYS}, t AS (SELECT user_id, count(*) AS n FROM g WHERE status <> 'unparsed_or_no_candidate' GROUP BY 1), e AS (SELECT user_id, a, generation, unnest(c) AS c FROM g), p AS (SELECT x.user_id, x.c AS source, y.c AS target, x.a FROM e x JOIN e y ON x.user_id = y.user_id AND x.a = y.a AND x.generation = y.generation AND x.c < y.c)
 SELECT user_id, source, target, count(*) AS n, round(count(*) / any_value(t.n), 9) AS rate, count(*) FILTER (a = 1) AS of_f1, count(DISTINCT a) AS n_routes FROM p JOIN t USING (user_id) GROUP BY ALL""")
def co_occurrence_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, edges = _events(spark, sf_dir)
    got = graph.co_occurrence_edges(events.withColumn("route", F.concat(F.lit("r"), F.substring("id", 1, 1))), edges, KEYS)
    return got.select("user_id", "source", "target", "n", F.round("rate", 9).alias("rate"), F.coalesce(F.try_element_at("by_family", F.lit("f1")), F.lit(0)).alias("of_f1"), F.size("by_route").cast("long").alias("n_routes"))


@query("SELECT event_id::VARCHAR AS source, 'claim:' || CASE event_type WHEN 'view' THEN 'border_land' ELSE 'capacity_variant' END AS target, event_type <> 'view' AS risk FROM events WHERE event_type IN ('view', 'click') AND value > 10")
def claim_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").cast("string").alias("id"), F.when(F.col("value") > 10, "candidate_set").otherwise("other").alias("status"), F.when(F.col("event_type") == "view", F.array(F.lit("border_land"))).when(F.col("event_type") == "click", F.array(F.lit("capacity_variant"))).otherwise(F.expr("cast(array() as array<string>)")).alias("claims"))
    return graph.claim_edges(e, KEYS).select("source", "target", "risk")


@query(f"WITH {HYPOTHESES} SELECT user_id, array_to_string(tokens, ',') AS tokens, row_number() OVER (PARTITION BY user_id ORDER BY is_incumbent DESC, tokens) - 1 AS place FROM h")
def hypothesis_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = graph.hypothesis_order(_hypotheses(spark, sf_dir)[0], KEYS)
    return got.select("user_id", F.array_join("tokens", ",").alias("tokens"), F.col("place").cast("long").alias("place"))


@query(f"""WITH {WON}, s AS (SELECT user_id, event_type AS r, count(DISTINCT CAST(ts AS DATE)) AS n FROM events GROUP BY ALL), m AS (SELECT user_id, max(n) AS most FROM s GROUP BY 1), l AS (SELECT s.user_id, min(r) AS r FROM s JOIN m ON m.user_id = s.user_id AND n = most AND n >= 11 GROUP BY 1 HAVING count(*) = 1)
 SELECT w.user_id, coalesce(l.r, w.item) AS objects, coalesce(l.r <> w.item, false) AS changed FROM w LEFT JOIN l USING (user_id)""")
def component_support_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    support = answers(spark, sf_dir).groupBy("user_id", F.col("event_type").alias("representative")).agg(F.count_distinct("day").alias("support"))
    return decode.component_support_rule(support, _won(spark, sf_dir), KEYS, 11).withColumn("objects", F.array_join("objects", ","))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(1 / (1 + exp(-(0.5 - 0.02 * l_quantity))), 9) AS probability FROM lineitem")
def scored_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    features = lambda df: df.withColumn("features", decode.checked_features(F.lit(1.0), F.col("l_quantity")))
    got = decode.scored_candidates(rows, features, F.array(F.lit(0.5), F.lit(-0.02)))
    return got.select("l_orderkey", "l_linenumber", "l_partkey", F.round("probability", 9).alias("probability"))


# -- joins of prediction rows -------------------------------------------------------------------------


@query("SELECT c_custkey, coalesce(n, 0) AS n_orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def optional_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_list(F.col("o_orderkey").cast("string")).alias("ObjectEntities"))
    got = relational.optional_join(table(spark, sf_dir, "customer").select("c_custkey"), lists, ["c_custkey"])
    return got.select("c_custkey", F.size("ObjectEntities").cast("long").alias("n_orders"))


@query("SELECT n_name, row_number() OVER (ORDER BY n_name DESC) - 1 AS pos FROM nation")
def restored_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    n = table(spark, sf_dir, "nation")
    inputs = n.select("n_name", (F.row_number().over(Window.orderBy(F.desc("n_name"))) - 1).cast("long").alias("pos"))
    return relational.restore_order(n.select("n_name"), inputs, ["n_name"])


@query("SELECT CASE WHEN event_type IN ('view', 'click') THEN 'seen' ELSE 'done' END AS route, count(*) AS n FROM events GROUP BY 1")
def routed_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = relational.routed_inputs(table(spark, sf_dir, "events"), {"seen": ["view", "click"], "done": ["error", "signup", "purchase"]}, "event_type")
    count = lambda name: parts[name].select(F.lit(name).alias("route")).groupBy("route").agg(F.count(F.lit(1)).alias("n"))
    return count("seen").unionByName(count("done"))


@query("""WITH i AS (SELECT c_nationkey AS k, c_custkey AS pos, c_name AS key, c_acctbal AS v FROM customer), m AS (SELECT s_nationkey AS k, 's' || (s_suppkey % 10) AS c, s_acctbal AS v FROM supplier WHERE s_acctbal > 0), x AS (SELECT c_nationkey AS k, c_name AS key, 'exact' AS c FROM customer WHERE c_custkey % 5 = 0),
 f AS (SELECT i.k, i.pos, m.c, min(abs(m.v - i.v) / abs(i.v)) AS far FROM i JOIN m ON m.k = i.k AND i.v > 0 AND abs(m.v - i.v) / abs(i.v) <= 0.05 + 1e-12 GROUP BY ALL), r AS (SELECT *, lead(far) OVER w AS next, row_number() OVER w AS n FROM f WINDOW w AS (PARTITION BY k, pos ORDER BY far, c)),
 t AS (SELECT DISTINCT i.k, coalesce(x.c, CASE WHEN r.next IS NULL OR r.far < r.next - 1e-12 THEN r.c END, 'incumbent:' || i.pos || ':' || i.key) AS token FROM i LEFT JOIN x USING (k, key) LEFT JOIN r ON r.k = i.k AND r.pos = i.pos AND n = 1) SELECT k, count(*) AS n_tokens, md5(string_agg(token, ',' ORDER BY token)) AS tokens FROM t GROUP BY 1""")
def incumbent_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("pos"), F.col("c_name").alias("key"), F.col("c_acctbal").alias("value"))
    members = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.concat(F.lit("s"), (F.col("s_suppkey") % 10).cast("string")).alias("component"), F.col("s_acctbal").alias("value"))
    got = relational.incumbent_tokens(c, c.where("pos % 5 = 0").select("k", "key", F.lit("exact").alias("component")), members, ["k"])
    return got.select("k", F.size("tokens").cast("long").alias("n_tokens"), F.md5(F.array_join("tokens", ",")).alias("tokens"))


# -- numeric proofs and scored edits -------------------------------------------------------------------


@query("""WITH e AS (SELECT user_id, 'f' || (event_id % 3) AS family, event_type AS g, round(value) + 1 AS v FROM events), t AS (SELECT user_id, family, count(*) AS n FROM e GROUP BY ALL), u AS (SELECT user_id, count(*) AS n FROM e GROUP BY 1),
 o AS (SELECT user_id, g, max(v) AS value, max(v) <= 1.05 * min(v) AS coherent, count(*) AS hits FROM e WHERE v > 40 GROUP BY ALL),
 r AS (SELECT o.user_id, o.g, f.family, count(e.v) / any_value(t.n) AS rate FROM o CROSS JOIN (VALUES ('f0'), ('f1'), ('f2')) f(family) LEFT JOIN t ON t.user_id = o.user_id AND t.family = f.family LEFT JOIN e ON e.user_id = o.user_id AND e.g = o.g AND e.family = f.family AND e.v > 40 GROUP BY ALL),
 p AS (SELECT o.user_id, o.g, value, hits / any_value(u.n) AS event_rate, count(*) FILTER (rate > 0) AS families, coalesce(min(rate), 0) AS least, sum(coalesce(rate, 0)) / 3 AS mean FROM o JOIN r USING (user_id, g) JOIN u USING (user_id) GROUP BY o.user_id, o.g, value, hits),
 i AS (SELECT user_id, 30.0 AS value FROM u), w AS (SELECT user_id, value, count(*) OVER (PARTITION BY user_id) AS eligible FROM p WHERE families = 3 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(least, 12) DESC, round(mean, 12) DESC, event_rate DESC, abs(ln(value / 30.0)), value) = 1)
 SELECT i.user_id, coalesce(w.value, i.value)::DOUBLE AS value, w.value IS NOT NULL AS changed, coalesce(eligible, 0) AS eligible FROM i LEFT JOIN w USING (user_id)""")
def prove_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each type's largest value as an option, backed by families; an incumbent that none backs."""
    e = answers(spark, sf_dir).select("user_id", "event_type", F.concat(F.lit("f"), (F.col("event_id") % 3).cast("string")).alias("family"), (F.round("value") + 1).alias("v"))
    n = e.groupBy("user_id", "family").agg(F.count(F.lit(1)).alias("n"))
    per = e.where("v > 40").groupBy("user_id", "event_type", "family").agg(F.count(F.lit(1)).alias("hits"), F.max("v").alias("top")).join(n, ["user_id", "family"])
    whole = n.groupBy("user_id").agg(F.sum("n").alias("all"))
    options = per.groupBy("user_id", "event_type").agg(F.max("top").alias("value"), F.map_from_entries(F.collect_list(F.struct("family", F.col("hits") / F.col("n")))).alias("rates"), (F.count(F.lit(1)) / 3.0).alias("family_fraction"), F.sum("hits").alias("hits"))
    options = options.join(whole, "user_id").select("user_id", "value", F.lit(False).alias("is_incumbent"), F.array("value").alias("members"), "rates", "family_fraction", (F.col("hits") / F.col("all")).alias("event_rate"))
    none = whole.select("user_id", F.lit(30.0).alias("value"), F.lit(True).alias("is_incumbent"), F.array(F.lit(30.0)).alias("members"), F.expr("cast(map() as map<string,double>)").alias("rates"), F.lit(0.0).alias("family_fraction"), F.lit(0.0).alias("event_rate"))
    return decode.prove_numbers(options.unionByName(none), KEYS, FAMILY).select("user_id", "value", "changed", "eligible")


@query(f"""WITH {WON}, c AS (SELECT DISTINCT user_id, event_type AS t FROM events WHERE value > 60), x AS (SELECT user_id, item AS k, t FROM w LEFT JOIN c USING (user_id)),
 a AS (SELECT DISTINCT user_id, k, unnest([[k], CAST([] AS VARCHAR[])]) AS tokens FROM x UNION SELECT user_id, k, [t] FROM x WHERE t IS NOT NULL UNION SELECT user_id, k, list_sort([k, t]) FROM x WHERE t <> k),
 f AS (SELECT user_id, k, tokens, len(list_filter(tokens, lambda y: y <> k)) AS added, (NOT list_contains(tokens, k))::INT AS dropped, len(tokens) AS n FROM a)
 SELECT user_id, array_to_string(tokens, ',') AS tokens, tokens = [k] AS is_keep, round(0.1 + 0.5 * (added / 5.0 - 0.1) / 0.2 - 0.3 * dropped / 5.0 + 0.2 * (CASE WHEN n = 0 THEN 0 ELSE (1 - dropped) / (n + dropped) END), 9)::DOUBLE AS estimate FROM f""")
def action_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All edits of users' winners, scored by additions (standardised), removals and overlap."""
    offered = answers(spark, sf_dir).where("value > 60").select("user_id", F.col("event_type").alias("token"))

    def features(rows: DataFrame) -> DataFrame:
        every = decode.edit_features(F.col("control"), F.col("tokens"))
        return rows.withColumn("features", F.array(every[4], every[5], every[6]))

    doubles = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    got = decode.action_rows(_won(spark, sf_dir), offered, KEYS, features, doubles(0.1, 0, 0), doubles(0.2, 1, 1), doubles(0.1, 0.5, -0.3, 0.2))
    return got.select("user_id", F.array_join("tokens", ",").alias("tokens"), "is_keep", F.round("estimate", 9).alias("estimate"))
