"""Queries of gating, consensus and scoring, beside their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numbers, text
from ..operators import consensus, metrics, models, stats, votes
from ..operators import tasks as task_ops
from .base import Query, answers, query, table, user_votes

KEYS = ["user_id"]
NUMBER = "CASE WHEN v = floor(v) THEN CAST(CAST(v AS BIGINT) AS VARCHAR) ELSE CAST(v AS VARCHAR) END"

#: A third of the users each has lists, single names and numbers; those of even id may have no answer.
CONTEXT = "c AS (SELECT DISTINCT user_id, CASE user_id % 3 WHEN 2 THEN 'numeric' ELSE 'string' END AS kind, user_id % 3 > 0 AS single, user_id % 2 = 0 AS nullable FROM events)"
PROPOSALS = "p AS (SELECT user_id, 'a' || (event_id % 3) AS agent, event_type AS key, upper(event_type) AS item, round(max(value)) AS value, count(*) AS support, min(event_id) AS first_seen FROM events GROUP BY user_id, event_id % 3, event_type)"
COMMITMENTS = "m AS (SELECT user_id, 'a' || (event_id % 3) AS agent, CASE WHEN sum(value) > 450 THEN 'YES' ELSE 'NO' END AS existence, CASE WHEN count(*) % 7 = 0 THEN NULL WHEN count(*) FILTER (value > 60) = 0 THEN 'ZERO' WHEN count(*) FILTER (value > 60) < 3 THEN 'ONE' ELSE 'MANY' END AS cardinality, count(DISTINCT CAST(ts AS DATE)) AS samples FROM events GROUP BY user_id, event_id % 3)"
REVIEWS = "v AS (SELECT user_id, event_type AS key, 'a' || ((event_id + 1) % 3) AS agent, CASE WHEN value < 1 THEN 'CONTRADICTED' WHEN value > 30 THEN 'SUPPORTED' ELSE 'UNKNOWN' END AS label FROM events)"
THERE = "e AS (SELECT c.user_id, NOT nullable OR count(*) FILTER (existence = 'YES') > count(*) FILTER (existence = 'NO') AS there FROM c JOIN m USING (user_id) GROUP BY c.user_id, nullable)"
MAJORITY = "l AS (SELECT user_id, cardinality AS label, count(*) AS n FROM m WHERE cardinality IS NOT NULL GROUP BY ALL), k AS (SELECT user_id, CASE WHEN count(*) = 1 THEN min(label) ELSE 'UNKNOWN' END AS cardinality FROM (SELECT *, max(n) OVER (PARTITION BY user_id) AS most FROM l) WHERE n = most GROUP BY 1), q AS (SELECT user_id, coalesce(k.cardinality, 'UNKNOWN') AS cardinality FROM c LEFT JOIN k USING (user_id))"


def _agent(shift: int = 0) -> F.Column:
    return F.concat(F.lit("a"), ((F.col("event_id") + shift) % 3).cast("string"))


def context(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    third = F.col("user_id") % 3
    return users.select("user_id", F.when(third == 2, "numeric").otherwise("string").alias("kind"), (third > 0).alias("single"), (F.col("user_id") % 2 == 0).alias("nullable"))


def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("agent", _agent())
    got = e.groupBy("user_id", "agent", F.col("event_type").alias("key")).agg(F.round(F.max("value")).alias("value"), F.count(F.lit(1)).alias("support"), F.min("event_id").alias("first_seen"))
    return got.withColumn("item", F.upper("key"))


def commitments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("agent", _agent())
    large = F.count_if(F.col("value") > 60)
    label = F.when(F.count(F.lit(1)) % 7 == 0, F.lit(None)).when(large == 0, "ZERO").when(large < 3, "ONE").otherwise("MANY")
    return e.groupBy("user_id", "agent").agg(F.when(F.sum("value") > 450, "YES").otherwise("NO").alias("existence"), label.alias("cardinality"), F.count_distinct(F.to_date("ts")).alias("samples"))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("key"), _agent(1).alias("agent"), F.when(v < 1, "CONTRADICTED").when(v > 30, "SUPPORTED").otherwise("UNKNOWN").alias("label"))


def _joined(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.array_join("objects", "|").alias("objects"))


# -- one agent alone --------------------------------------------------------------------


@query(f"""WITH {CONTEXT}, s AS (SELECT user_id, event_type AS key, upper(event_type) AS item, round(max(value)) AS value, count(DISTINCT CAST(ts AS DATE)) AS support, min(event_id) AS first_seen FROM events GROUP BY ALL),
 t AS (SELECT user_id, count(DISTINCT CAST(ts AS DATE)) AS n_samples, count(*) FILTER (value > 45) AS n_none FROM events GROUP BY 1),
 num AS (SELECT user_id, median(value) AS v FROM (SELECT user_id, value, unnest(range(support)) FROM s JOIN c USING (user_id) WHERE kind = 'numeric' AND value > 0) GROUP BY 1),
 one AS (SELECT user_id, item AS objects FROM s JOIN c USING (user_id) JOIN t USING (user_id) WHERE kind <> 'numeric' AND single QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY support DESC, first_seen) = 1 AND n_none < support),
 many AS (SELECT user_id, string_agg(item, '|' ORDER BY support DESC, first_seen) AS objects FROM s JOIN c USING (user_id) JOIN t USING (user_id) WHERE kind <> 'numeric' AND NOT single AND support >= greatest(1, ceil(n_samples / 2)) GROUP BY 1),
 every AS (SELECT user_id, {NUMBER} AS objects FROM num UNION ALL FROM one UNION ALL FROM many)
 SELECT c.user_id, coalesce(objects, '') AS objects FROM c LEFT JOIN every USING (user_id)""")
def self_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = answers(spark, sf_dir)
    support = a.groupBy("user_id", F.col("event_type").alias("key")).agg(F.round(F.max("value")).alias("value"), F.count_distinct("day").alias("support"), F.min("event_id").alias("first_seen")).withColumn("item", F.upper("key"))
    totals = a.groupBy("user_id").agg(F.count_distinct("day").alias("n_samples"), F.count_if(F.col("value") > 45).alias("n_none"))
    return _joined(consensus.self_consistency(support, totals, context(spark, sf_dir), KEYS), "user_id")


AGENT = f"""g AS (SELECT m.*, kind, single, NOT nullable OR existence = 'YES' AS there FROM m JOIN c USING (user_id)), o AS (SELECT g.*, p.key, p.item, p.value, p.support FROM g JOIN p USING (user_id, agent) WHERE there),
 num AS (SELECT user_id, agent, median(value) AS v FROM (SELECT user_id, agent, value, unnest(range(greatest(1, support))) FROM o WHERE kind = 'numeric' AND value > 0) GROUP BY ALL),
 one AS (SELECT user_id, agent, item AS objects FROM o WHERE kind <> 'numeric' AND single QUALIFY row_number() OVER (PARTITION BY user_id, agent ORDER BY support DESC, key) = 1),
 many AS (SELECT user_id, agent, string_agg(item, '|' ORDER BY support DESC, key) AS objects FROM o WHERE kind <> 'numeric' AND NOT single AND support >= greatest(1, ceil(samples / 2)) GROUP BY ALL),
 every AS (SELECT user_id, agent, {NUMBER} AS objects FROM num UNION ALL FROM one UNION ALL FROM many),
 own AS (SELECT m.user_id, m.agent, coalesce(objects, '') AS objects FROM m LEFT JOIN every USING (user_id, agent))"""


@query(f"WITH {CONTEXT}, {PROPOSALS}, {COMMITMENTS}, {AGENT} SELECT * FROM own")
def agent_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(consensus.agent_answers(proposals(spark, sf_dir), commitments(spark, sf_dir), context(spark, sf_dir), KEYS), "user_id", "agent")


@query(f"WITH {CONTEXT}, {PROPOSALS}, {COMMITMENTS}, {AGENT} SELECT c.user_id, coalesce(objects, '') AS objects FROM c LEFT JOIN own ON own.user_id = c.user_id AND agent = 'a1'")
def policy_of_one_agent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(consensus.by_policy("agent:a1", proposals(spark, sf_dir), commitments(spark, sf_dir), context(spark, sf_dir), KEYS), "user_id")


@query(f"WITH {PROPOSALS} SELECT user_id, agent, median(value) AS centre FROM (SELECT user_id, agent, value, unnest(range(greatest(1, support))) FROM p WHERE value > 0) GROUP BY ALL")
def numeric_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.numeric_centres(proposals(spark, sf_dir), KEYS)


# -- several agents ----------------------------------------------------------------------


@query(f"WITH {CONTEXT}, {COMMITMENTS}, {THERE} SELECT user_id, there FROM e")
def existence_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.exists_by_vote(commitments(spark, sf_dir), context(spark, sf_dir), KEYS)


@query(f"WITH {CONTEXT}, {COMMITMENTS}, {MAJORITY} SELECT * FROM q")
def majority_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.majority_cardinality(commitments(spark, sf_dir), KEYS)


def _consensus_sql(use_reviews: bool, use_cardinality: bool) -> str:
    label = "q.cardinality" if use_cardinality else "'UNKNOWN'"
    backers = "list(DISTINCT v.agent) FILTER (label = 'SUPPORTED')" if use_reviews else "NULL"
    against = "count(*) FILTER (label = 'CONTRADICTED')" if use_reviews else "0"
    return f"""WITH {CONTEXT}, {PROPOSALS}, {COMMITMENTS}, {REVIEWS}, {THERE}, {MAJORITY},
 o AS (SELECT c.*, {label} AS cardinality FROM c JOIN e USING (user_id) JOIN q USING (user_id) WHERE there AND {label} <> 'ZERO'),
 told AS (SELECT user_id, key, {backers} AS backers, {against} AS against FROM v GROUP BY ALL),
 h AS (SELECT user_id, key, single, cardinality, min(item) AS item, list(DISTINCT agent) AS proposers, sum(support) AS support FROM p JOIN o USING (user_id) WHERE kind <> 'numeric' GROUP BY ALL),
 good AS (SELECT h.*, len(list_distinct(list_concat(proposers, coalesce(backers, [])))) AS agents FROM h LEFT JOIN told USING (user_id, key) WHERE coalesce(against, 0) = 0 AND len(list_distinct(list_concat(proposers, coalesce(backers, [])))) >= 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY agents DESC, len(proposers) DESC, support DESC, key) AS i FROM good),
 names AS (SELECT user_id, string_agg(item, '|' ORDER BY i) AS objects FROM r WHERE i = 1 OR NOT (single OR cardinality = 'ONE') GROUP BY 1),
 s AS (SELECT user_id, key, first(value ORDER BY agent) AS value, sum(support) AS support FROM (SELECT user_id, key, agent, max(value) OVER (PARTITION BY user_id, key) AS value, support FROM p) JOIN o USING (user_id) WHERE kind = 'numeric' GROUP BY ALL),
 num AS (SELECT user_id, median(value) AS v FROM (SELECT user_id, value, unnest(range(greatest(1, support)::BIGINT)) FROM s WHERE value > 0) GROUP BY 1),
 every AS (SELECT user_id, {NUMBER} AS objects FROM num UNION ALL FROM names)
 SELECT c.user_id, coalesce(objects, '') AS objects FROM c LEFT JOIN every USING (user_id)"""


def _policy(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        # one value a key, as candidates of one key are one number
        p = proposals(spark, sf_dir).withColumn("value", F.max("value").over(Window.partitionBy("user_id", "key")))
        return _joined(consensus.by_policy(name, p, commitments(spark, sf_dir), context(spark, sf_dir), KEYS, reviews(spark, sf_dir)), "user_id")

    run.__name__ = f"policy_{name}"
    return run


for _name, _flags in consensus.POLICIES.items():
    query(_consensus_sql(*_flags))(_policy(_name))


@query(f"WITH {CONTEXT}, {PROPOSALS}, h AS (SELECT user_id, key, min(item) AS item, count(DISTINCT agent) AS agents, sum(support) AS support FROM p GROUP BY ALL) SELECT user_id, string_agg(item, '|' ORDER BY agents DESC, support DESC, key) AS objects FROM h GROUP BY 1")
def candidate_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(consensus.by_policy("candidate_union", proposals(spark, sf_dir), commitments(spark, sf_dir), context(spark, sf_dir), KEYS), "user_id")


@query("SELECT user_id, CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'purchase') / count(*) AS share FROM events GROUP BY ALL")
def commitment_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = answers(spark, sf_dir).groupBy("user_id", "day", "event_type").agg(F.count(F.lit(1)).alias("n"))
    shares = n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("user_id", "day"))).groupBy("user_id", "day").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "p"))).alias("m"))
    return shares.select("user_id", "day", consensus.commitment_probability(F.lit(True), F.col("m"), "purchase").alias("share"))


@query("SELECT user_id, coalesce(array_to_string(list_sort(list(DISTINCT event_type) FILTER (event_id % 3 = 1 AND value > 20)), ','), '') AS chosen FROM events GROUP BY 1")
def selected_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("value > 20").withColumn("agent", _agent())
    maps = e.groupBy("user_id", "agent").agg(F.collect_list("event_type").alias("keys")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("agent", "keys"))).alias("outputs"))
    users = table(spark, sf_dir, "events").select("user_id").distinct().join(maps, "user_id", "left").withColumn("outputs", F.coalesce("outputs", F.expr("cast(map() as map<string,array<string>>)")))
    return users.select("user_id", F.array_join(consensus.selected_keys(F.col("outputs"), "a1"), ",").alias("chosen"))


@query("""WITH s AS (SELECT user_id, event_type AS choice, avg(x) AS s FROM (SELECT user_id, event_id % 3 AS variant, event_type, ln(1 + sum(value)) AS x FROM events GROUP BY ALL) GROUP BY ALL), e AS (SELECT *, exp(s - max(s) OVER (PARTITION BY user_id)) AS e FROM s), r AS (SELECT user_id, choice, e / sum(e) OVER (PARTITION BY user_id) AS p FROM e)
 SELECT user_id, choice AS winner, round(p, 9) AS probability FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(p, 12) DESC, list_position(['view', 'click', 'error', 'signup', 'purchase'], choice)) = 1""")
def choice_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    variants = table(spark, sf_dir, "events").groupBy("user_id", (F.col("event_id") % 3).alias("variant"), F.col("event_type").alias("choice")).agg(F.log1p(F.sum("value")).alias("score"))
    got = consensus.averaged_choices(variants, KEYS).withColumn("probabilities", F.transform_values("probabilities", lambda k, v: F.round(v, 12)))
    winner = consensus.choice_winner(F.col("probabilities"), F.array(*map(F.lit, ("view", "click", "error", "signup", "purchase"))))
    return got.select("user_id", winner.alias("winner"), F.round(F.element_at("probabilities", winner), 9).alias("probability"))


# -- votes, from raw rows ------------------------------------------------------------------


@query("""WITH r AS (SELECT user_id, CAST(ts AS DATE) AS day, CASE WHEN value > 25 THEN event_type END AS item, event_id FROM events), o AS (SELECT user_id, coalesce(item, '-') AS item, day, min(event_id) AS pos FROM r GROUP BY ALL), v AS (SELECT user_id, item, count(*) AS votes, min(struct_pack(d := day, p := pos)) AS first FROM o GROUP BY ALL)
 SELECT user_id, nullif(item, '-') AS item, votes FROM v QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, first) = 1""")
def plurality_or_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = answers(spark, sf_dir).withColumn("item", F.when(F.col("value") > 25, F.col("event_type")))
    return votes.plurality_or_none(rows, KEYS, "item", "day", "event_id").select("user_id", "item", "votes")


@query("""WITH o AS (SELECT DISTINCT user_id, event_type AS item, CAST(ts AS DATE) AS day FROM events), v AS (SELECT user_id, item, count(*) AS votes, list_sort(list(day)) AS days FROM o GROUP BY ALL) SELECT user_id, item, votes, array_to_string(days, ',') AS days FROM v""")
def vote_table_with_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = votes.vote_table(answers(spark, sf_dir), KEYS, "event_type", "day", "event_id", samples=True)
    return got.select("user_id", "item", "votes", F.array_join(F.transform("in_samples", lambda d: d.cast("string")), ",").alias("days"))


@query("""WITH once AS (SELECT user_id, event_type AS item, CAST(ts AS DATE) AS d FROM events GROUP BY ALL), v AS (SELECT user_id, item, count(*) AS votes FROM once GROUP BY ALL), t AS (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY votes DESC) AS r FROM v WHERE votes >= 6)
 SELECT 'list' AS arm, user_id, item, votes FROM v WHERE votes >= 6 UNION ALL SELECT 'numeric', user_id, min(item), min(votes) FROM t WHERE r = 1 GROUP BY user_id HAVING count(*) = 1""")
def supported(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = user_votes(spark, sf_dir)
    arm = lambda name, numeric: votes.supported(v, KEYS, 6, numeric).select(F.lit(name).alias("arm"), "user_id", "item", "votes")
    return arm("list", False).unionByName(arm("numeric", True))


@query("""WITH once AS (SELECT user_id, event_type AS item, CAST(ts AS DATE) AS sample, min(event_id) AS pos FROM events GROUP BY ALL), v AS (SELECT user_id, item, count(*) AS votes, min(struct_pack(s := sample, p := pos)) AS f FROM once GROUP BY ALL),
 w AS (SELECT user_id, item, votes FROM v QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, f) = 1), o AS (SELECT user_id, event_type AS item FROM events WHERE value > 45 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1)
 SELECT user_id, w.item, CASE WHEN votes >= 11 THEN w.item ELSE 'second:' || o.item END AS display, votes < 11 AS promoted FROM w LEFT JOIN o USING (user_id) WHERE votes >= 11 OR (o.item = w.item AND votes >= 4)""")
def corroborated_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = answers(spark, sf_dir).where("value > 45").select("user_id", F.col("event_type").alias("item"), F.col("event_id").alias("pos"), F.concat(F.lit("second:"), "event_type").alias("display"))
    return votes.corroborated_single(user_votes(spark, sf_dir), other, KEYS, 11, 4)


@query("SELECT user_id, median(value) AS value, count(*) AS n_values FROM (SELECT user_id, event_id % 3 AS source, max(value) AS value FROM events WHERE value > 60 GROUP BY ALL) GROUP BY 1 HAVING count(*) >= 2")
def fuse_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = answers(spark, sf_dir).where("value > 60").groupBy("user_id", (F.col("event_id") % 3).alias("source")).agg(F.max("value").alias("v"))
    return votes.fuse_numbers(rows, KEYS, "v", votes.ARMS["agreement"](3)).select("user_id", "value", "n_values")


@query("""WITH s AS (SELECT user_id, CASE WHEN event_type = 'error' THEN 'invalid' WHEN event_type = 'view' THEN 'explicit-abstention' ELSE 'entity' END AS kind, event_type AS status FROM events), once AS (SELECT user_id, event_type AS item, CAST(ts AS DATE) AS sample, min(event_id) AS pos FROM events GROUP BY ALL), v AS (SELECT user_id, item, count(*) AS votes, min(struct_pack(s := sample, p := pos)) AS f FROM once GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, f) AS rank FROM v)
 SELECT user_id, count(*) AS n_samples, count(*) FILTER (kind = 'entity') AS n_entity, count(*) FILTER (kind = 'explicit-abstention') AS n_abstained, count(*) FILTER (kind = 'invalid') AS n_invalid, any_value(c.candidates) AS candidates FROM s JOIN (SELECT user_id, string_agg(item || ':' || votes, ',' ORDER BY rank) AS candidates FROM r WHERE rank <= 3 GROUP BY 1) c USING (user_id) GROUP BY 1""")
def evidence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "invalid").when(F.col("event_type") == "view", "explicit-abstention").otherwise("entity")
    samples = answers(spark, sf_dir).select("user_id", kind.alias("kind"), F.col("event_type").alias("status"))
    got = votes.evidence_summary(samples, KEYS, user_votes(spark, sf_dir), 3)
    return got.select("user_id", "n_samples", "n_entity", "n_abstained", "n_invalid", F.array_join(F.transform("candidates", lambda c: F.concat_ws(":", c["item"], c["votes"])), ",").alias("candidates"))


@query("SELECT event_type, value > 50 AS large, count(*) AS n FROM events GROUP BY ALL")
def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.counters(table(spark, sf_dir, "events").withColumn("large", F.col("value") > 50), "event_type", "large")


@query("SELECT source, sum(n)::BIGINT AS n_rows, count(*) AS n_subjects, min(n) AS fewest, max(n) AS most FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) GROUP BY 1")
def pool_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.pool_coverage(table(spark, sf_dir, "documents"), "lang", "source")


@query("SELECT user_id, count(*) AS n_kept FROM events WHERE lower(event_type) <> CASE user_id % 4 WHEN 0 THEN 'view' WHEN 1 THEN 'click' ELSE 'x' END GROUP BY 1")
def drop_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    subject = F.when(F.col("user_id") % 4 == 0, " VIEW ").when(F.col("user_id") % 4 == 1, "\tClick ").otherwise("x")
    got = answers(spark, sf_dir).groupBy("user_id").agg(F.collect_list("event_type").alias("items"))
    return got.select("user_id", F.size(task_ops.drop_self(subject, F.col("items"))).cast("long").alias("n_kept"))


# -- scoring ----------------------------------------------------------------------------------

#: Gold rows from parts by brand: names with an alias each (equal ones ambiguous), or prices; predictions from other parts, some brands without, some twice.


def gold_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").where("p_partkey % 5 < 2")
    numeric = F.substring("p_brand", 7, 9).try_cast("int") % 2 == 1
    entry = F.when(numeric, F.array(F.col("p_retailprice").cast("string"))).otherwise(F.array("p_name", F.concat("p_type", F.lit(" "), F.split("p_name", " ")[0])))
    return p.groupBy(F.col("p_brand").alias("SubjectEntity"), F.when(numeric, "hasArea").otherwise("companyTradesAtStockExchange").alias("Relation")).agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", entry.alias("e")))), lambda x: x["e"]).alias("ObjectEntities"))


def told_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of all brands but every seventh, an older row of every third before the one that counts, and a brand without gold."""
    p = table(spark, sf_dir, "part").where("p_partkey % 7 = 3").withColumn("n", F.substring("p_brand", 7, 9).try_cast("int"))
    numeric = F.col("n") % 2 == 1
    item = F.when(numeric, F.format_string("%.1f", F.col("p_retailprice") * 1.03)).when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.concat("p_type", F.lit(", "), F.split("p_name", " ")[0]))
    rows = p.groupBy("p_brand", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", item.alias("i")))), lambda x: x["i"]).alias("ObjectEntities"))
    named = rows.select(F.col("p_brand").alias("SubjectEntity"), F.when(numeric, "hasArea").otherwise("companyTradesAtStockExchange").alias("Relation"), "n", "ObjectEntities")
    last = named.where("n % 7 <> 0").withColumn("pos", F.lit(2))
    older = named.where("n % 3 = 0").withColumn("ObjectEntities", F.array(F.lit("older"))).withColumn("pos", F.lit(1))
    lost = named.limit(1).withColumns({"SubjectEntity": F.lit("nobody"), "pos": F.lit(3)})
    return last.unionByName(older).unionByName(lost).drop("n")


@query("""WITH g AS (SELECT p_brand AS s, CAST(substr(p_brand, 7) AS INT) AS n, count(*) AS total_gold FROM part WHERE p_partkey % 5 < 2 GROUP BY ALL),
 t AS (SELECT p_brand AS s, CAST(substr(p_brand, 7) AS INT) AS n, CASE WHEN CAST(substr(p_brand, 7) AS INT) % 2 = 1 THEN printf('%.1f', p_retailprice * 1.03) WHEN p_partkey % 2 = 0 THEN lower(p_name) ELSE lower(p_type || ' ' || split_part(p_name, ' ', 1)) END AS form FROM part WHERE p_partkey % 7 = 3),
 u AS (SELECT s, CASE WHEN n % 7 <> 0 THEN count(DISTINCT form) WHEN n % 3 = 0 THEN 1 ELSE 0 END AS total_pred FROM t GROUP BY s, n)
 SELECT g.s AS "SubjectEntity", CASE WHEN n % 2 = 1 THEN 'hasArea' ELSE 'companyTradesAtStockExchange' END AS "Relation", coalesce(total_pred, 0)::BIGINT AS total_pred, total_gold FROM g LEFT JOIN u USING (s)""")
def scored_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the scorer counts of either side: distinct forms told, entities to find, missing rows and the last of repeated ones."""
    from ..schemas import relation_dimension

    got = metrics.score_pairs(told_rows(spark, sf_dir), gold_rows(spark, sf_dir), relation_dimension(spark))
    return got.select("SubjectEntity", "Relation", "total_pred", "total_gold")


@query("""WITH RECURSIVE g AS (SELECT p_brand AS s, list(p_retailprice ORDER BY p_partkey) AS gold FROM part WHERE p_partkey % 5 < 2 AND CAST(substr(p_brand, 7) AS INT) % 2 = 1 GROUP BY 1),
 d AS (SELECT p_brand AS s, CAST(printf('%.1f', p_retailprice * 1.03) AS DOUBLE) AS v, min(p_partkey) AS k FROM part WHERE p_partkey % 7 = 3 AND CAST(substr(p_brand, 7) AS INT) % 2 = 1 AND CAST(substr(p_brand, 7) AS INT) % 7 <> 0 GROUP BY ALL),
 t AS (SELECT s, list(v ORDER BY k) AS told FROM d GROUP BY 1),
 f AS (SELECT s, gold, coalesce(told, []) AS told, 0 AS i, CAST([] AS BIGINT[]) AS used FROM g LEFT JOIN t USING (s)
  UNION ALL SELECT s, gold, told, i + 1, CASE WHEN hit IS NULL THEN used ELSE list_append(used, hit) END FROM (SELECT *, list_filter(range(1, len(gold) + 1), lambda j: NOT list_contains(used, j) AND abs(told[i + 1] - gold[j]) / gold[j] <= 0.05)[1] AS hit FROM f WHERE i < len(told)))
 SELECT s AS "SubjectEntity", len(used)::BIGINT AS tp, round(CASE WHEN len(told) = 0 THEN 1.0 ELSE len(used) / len(told) END, 9) AS p, round(len(used) / len(gold), 9) AS r FROM f WHERE i = len(told)""")
def scored_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric rows by the scorer: one-to-one first fits in order, within 5 % of the gold value."""
    from ..schemas import relation_dimension

    told = told_rows(spark, sf_dir).where(F.size("ObjectEntities") > 0).where("NOT array_contains(ObjectEntities, 'older')")
    got = metrics.score_pairs(told, gold_rows(spark, sf_dir).where("Relation = 'hasArea'"), relation_dimension(spark))
    return got.select("SubjectEntity", "tp", F.round("p", 9).alias("p"), F.round("r", 9).alias("r"))


@query("""WITH e AS (SELECT DISTINCT s_nationkey AS k, s_suppkey % 4 AS pred, CAST(floor(s_acctbal) AS INT) % 2 AS gold FROM supplier), d AS (SELECT k, count(DISTINCT pred) AS np, count(DISTINCT gold) AS ng, count(*) AS ne FROM e GROUP BY 1),
 l AS (SELECT k, max(CASE WHEN n0 > 0 THEN 1 ELSE 0 END) + 0 AS one FROM (SELECT k, count(*) AS n0 FROM e GROUP BY k) GROUP BY k)
 SELECT k, CASE WHEN ng = 1 OR np = 1 THEN 1 ELSE 2 END::BIGINT AS hits FROM d""")
def matched_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most one-to-one pairs of up to four predictions and two gold entities: two, where each side has two."""
    s = table(spark, sf_dir, "supplier")
    edges = s.select(F.col("s_nationkey").alias("k"), (F.col("s_suppkey") % 4).cast("int").alias("pred"), F.pmod(F.floor("s_acctbal"), F.lit(2)).cast("int").alias("gold")).distinct()
    return metrics.string_hits(edges, ["k"])


@query("""WITH j AS (SELECT l.doc_id, source, quality AS a, 1 - toxic AS b, (doc_id % 2) AS c FROM labels l JOIN documents USING (doc_id)), r AS (SELECT doc_id, 'a' AS agent FROM j WHERE a = 1 UNION ALL SELECT doc_id, 'b' FROM j WHERE b = 1 UNION ALL SELECT doc_id, 'c' FROM j WHERE c = 1), o AS (SELECT doc_id, min(agent) AS agent FROM r GROUP BY 1 HAVING count(*) = 1) SELECT agent, count(*) AS n_unique FROM o GROUP BY 1""")
def uniquely_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    rows = j.select("doc_id", F.explode(F.array(*[F.struct(F.lit(a).alias("agent"), (c == 1).alias("right")) for a, c in (("a", F.col("quality")), ("b", 1 - F.col("toxic")), ("c", F.col("doc_id") % 2))])).alias("x")).select("doc_id", "x.*")
    return metrics.uniquely_correct(rows, ["doc_id"], "agent", "right")


# -- numbers and models ---------------------------------------------------------------------------


@query("SELECT p_partkey, round(least(1, abs(ln(p_retailprice / 1000.0)) / 0.2), 9) AS distance, round(least(1, greatest(0, (p_retailprice - 1000) / 100) / 2), 9) AS deviation FROM part")
def clipped_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("p_retailprice")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(numbers.log_distance(price, F.lit(1000.0), 0.2), 9).alias("distance"), F.round(numbers.clipped_deviation((price - 1000) / 100), 9).alias("deviation"))


@query("SELECT p_brand, round(least(1, ln(max(p_retailprice) / min(p_retailprice)) / ln(1.05)), 9) AS spread FROM part GROUP BY 1")
def numeric_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.round(numbers.spread(F.array(F.min("p_retailprice"), F.max("p_retailprice"))), 9).alias("spread"))


@query("WITH s AS (SELECT p_partkey % 50 AS k, p_retailprice AS v, p_size AS w FROM part), r AS (SELECT k, v, unnest(range(w)) FROM s) SELECT k, median(v) AS m FROM r GROUP BY 1")
def replicated_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.replicated_median(table(spark, sf_dir, "part").select((F.col("p_partkey") % 50).alias("k"), F.col("p_retailprice").alias("v"), "p_size"), ["k"], "v", "p_size", "m")


@query("WITH r AS (SELECT c_custkey, c_mktsegment AS g, 1 / (1 + exp(-greatest(-30, least(30, 0.3 + c_acctbal / 10000)))) AS z, 1 / (1 + exp(-greatest(-30, least(30, -0.2 + c_acctbal / 5000)))) AS o, 1 / (1 + exp(-greatest(-30, least(30, 0.1 - c_acctbal / 8000)))) AS m FROM customer) SELECT c_custkey, CASE WHEN g = 'FURNITURE' THEN 0.0 ELSE round(z / (z + o + m), 9) END AS zero, CASE WHEN g = 'FURNITURE' THEN 1.0 ELSE round(o / (z + o + m), 9) END AS one, CASE WHEN g = 'FURNITURE' THEN 0.0 ELSE round(m / (z + o + m), 9) END AS many FROM r")
def cardinality_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-vs-rest classes as shares, with one segment whose class is certain."""
    from ..schemas import LINEAR_MODEL

    c = table(spark, sf_dir, "customer").withColumn("Relation", F.col("c_mktsegment")).withColumn("x", F.array(F.lit(1.0), F.col("c_acctbal")))
    segments = ["AUTOMOBILE", "BUILDING", "HOUSEHOLD", "MACHINERY"]
    rows = [(models.CARDINALITY, s, label, ["one", "balance"], 2.0, beta, None, None) for s in segments for label, beta in (("ZERO", [0.3, 1 / 10000]), ("ONE", [-0.2, 1 / 5000]), ("MANY", [0.1, -1 / 8000]))]
    got = models.cardinality_probabilities(c, spark.createDataFrame(rows, LINEAR_MODEL), "x", {"FURNITURE": "ONE"})
    return got.select("c_custkey", *[F.round(F.col("probabilities")[k], 9).alias(a) for k, a in (("ZERO", "zero"), ("ONE", "one"), ("MANY", "many"))])


@query("SELECT n.n_nationkey, coalesce(avg(s_acctbal), 0) AS balance, coalesce(avg(s_suppkey), 0)::DOUBLE AS place FROM nation n LEFT JOIN supplier s ON s.s_nationkey = n.n_nationkey AND s.s_suppkey % 3 = 0 GROUP BY 1")
def mean_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_nationkey").alias("n_nationkey"), F.col("s_acctbal").alias("balance"), F.col("s_suppkey").cast("double").alias("place"))
    return models.mean_summary(s, ["n_nationkey"], table(spark, sf_dir, "nation"), ["balance", "place"])


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS at, round((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 1e6, 3) AS elapsed FROM events")
def utc_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", text.utc_text(F.col("ts").cast("timestamp")).alias("at"), text.elapsed_seconds(F.lit("2024-01-01 00:00:00").cast("timestamp"), F.col("ts").cast("timestamp")).alias("elapsed"))


# -- parsers, ties, diagnostics ---------------------------------------------------------------------


def _split(value: str, relation: str) -> list[str]:
    return [p for p in value.split("+") if p != relation]


@query("SELECT user_id, CAST(ts AS DATE) AS sample, event_type AS item, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY ALL")
def parsed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A caller's Python parser over joined answers, in Arrow batches; it leaves the relation's own name out."""
    samples = answers(spark, sf_dir).groupBy("user_id", F.col("day").alias("sample")).agg(F.array_join(F.collect_list("event_type"), "+").alias("text")).withColumn("Relation", F.lit("error"))
    got = votes.parsed_items(samples, KEYS, votes.python_parser(_split))
    return got.groupBy("user_id", "sample", "item").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, CASE event_type WHEN 'view' THEN round(value) WHEN 'click' THEN -1.0 WHEN 'error' THEN 0.0 ELSE 2 * value END AS routed FROM events")
def strict_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    rules = {"view": F.round(v), "click": F.lit(-1.0), "error": F.lit(0.0), "signup": 2 * v, "purchase": 2 * v}
    return table(spark, sf_dir, "events").select("event_id", votes.strict_dispatch(F.col("event_type"), rules).alias("routed"))


@query("""WITH g AS (SELECT user_id, event_type AS item, string_agg(DISTINCT CAST(ts AS DATE)::VARCHAR, ',' ORDER BY CAST(ts AS DATE)::VARCHAR) AS generations FROM events GROUP BY ALL), n AS (SELECT user_id, string_agg(DISTINCT CAST(ts AS DATE)::VARCHAR, ',' ORDER BY CAST(ts AS DATE)::VARCHAR) FILTER (value > 60) AS none FROM events GROUP BY 1) SELECT user_id, item, generations, coalesce(none, '') AS none_generations FROM g JOIN n USING (user_id)""")
def route_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = answers(spark, sf_dir)
    statuses = a.select("user_id", "day", F.when(F.col("value") > 60, "explicit_none").otherwise("valid").alias("status"))
    found, none = votes.route_evidence(a, statuses, KEYS, "event_type", "day", "event_id")
    days = lambda c: F.array_join(F.transform(c, lambda d: d.cast("string")), ",")
    return found.join(none, "user_id").select("user_id", "item", days("generations").alias("generations"), days("none_generations").alias("none_generations"))


@query("""WITH s AS (SELECT user_id, CAST(ts AS DATE) AS d, min_by(CASE WHEN event_type <> 'error' THEN event_type ELSE '-' END, event_id) AS item, min_by('t' || event_id, event_id) AS trace FROM events GROUP BY ALL), v AS (SELECT user_id, item, count(*) AS votes, min(d) AS f, list(trace ORDER BY d)[1:2] AS t FROM s GROUP BY ALL), m AS (SELECT *, max(votes) OVER (PARTITION BY user_id) AS top FROM v)
 SELECT user_id, votes, string_agg(item || ':' || array_to_string(t, '/'), ',' ORDER BY f) AS tied FROM m WHERE votes = top GROUP BY ALL HAVING count(*) > 1""")
def ties_with_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = answers(spark, sf_dir).withColumns({"item": F.when(F.col("event_type") != "error", F.col("event_type")), "trace": F.concat(F.lit("t"), F.col("event_id").cast("string"))})
    got = votes.ties_with_traces(rows, KEYS, "item", "day", "event_id", "trace")
    return got.select("user_id", "votes", F.array_join(F.transform("tied", lambda x: F.concat(F.coalesce(x["item"], F.lit("-")), F.lit(":"), F.array_join(x["traces"], "/"))), ",").alias("tied"))


@query(f"WITH {COMMITMENTS}, g AS (SELECT user_id, (user_id * 7) % 4 AS n_gold FROM events GROUP BY ALL), j AS (SELECT agent, CASE n_gold WHEN 0 THEN 'ZERO' WHEN 1 THEN 'ONE' ELSE 'MANY' END AS truth, coalesce(cardinality, 'UNKNOWN') AS told FROM m JOIN g USING (user_id)) SELECT agent, count(*) AS n, count(*) FILTER (truth = told) AS correct, count(*) FILTER (told = 'UNKNOWN') AS unknown, round(count(*) FILTER (truth = told) / count(*), 9) AS accuracy, count(*) FILTER (truth = 'ONE' AND told = 'MANY') AS one_as_many FROM j GROUP BY 1")
def cardinality_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = table(spark, sf_dir, "events").select("user_id").distinct().withColumn("n_gold", (F.col("user_id") * 7) % 4)
    got = metrics.cardinality_diagnostics(commitments(spark, sf_dir), gold, KEYS)
    return got.select("agent", "n", "correct", "unknown", F.round("accuracy", 9).alias("accuracy"), F.coalesce(F.try_element_at("confusion", F.lit("ONE->MANY")), F.lit(0)).alias("one_as_many"))


@query(f"WITH {PROPOSALS} SELECT agent, count(DISTINCT user_id) AS n FROM p WHERE (user_id * 7) % 4 = 0 AND value > 40 GROUP BY 1")
def null_false_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = table(spark, sf_dir, "events").select("user_id").distinct().withColumn("n_gold", (F.col("user_id") * 7) % 4)
    return metrics.null_false_positives(proposals(spark, sf_dir).where("value > 40"), gold, KEYS)


@query("WITH r AS (SELECT user_id, 'a' || (event_id % 3) AS a, (max(value) > 80)::INT AS c FROM events GROUP BY ALL) SELECT x.a AS \"left\", y.a AS \"right\", count(*) AS n, CASE WHEN min(x.c) = max(x.c) OR min(y.c) = max(y.c) THEN NULL ELSE round(corr(x.c, y.c), 9) END AS corr FROM r x JOIN r y ON x.user_id = y.user_id AND x.a < y.a GROUP BY ALL")
def correctness_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy("user_id", _agent().alias("agent")).agg((F.max("value") > 80).cast("int").alias("right"))
    return metrics.correctness_correlations(rows, KEYS, "agent", "right").withColumn("corr", F.round("corr", 9))


@query("SELECT p_partkey, abs(ln(p_retailprice / 950.0)) <= 1e-10 AS same, abs(p_retailprice - 950) / 950 <= 0.05 + 1e-12 AS of_target, p_retailprice > 0 AND abs(p_retailprice - 950) / 950 <= 0.05 AS of_right FROM part")
def further_tolerances(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, goal = F.col("p_retailprice"), F.lit(950.0)
    return table(spark, sf_dir, "part").select("p_partkey", numbers.same_option(price, goal).alias("same"), numbers.within_target(price, goal).alias("of_target"), numbers.within_right(price, goal).alias("of_right"))
