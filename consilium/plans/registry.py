"""Queries: each operator family on the driver's tables, beside its DuckDB equivalent.

A user's day acts as one sample of that user, an event type as an answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numbers, parse, text
from ..operators import decode, graph, metrics, relational, stats, tasks, votes
from .base import ORACLES, QUERIES, VOTES, Query, answers, query, table, user_votes


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, truth, told): quality labels against not-toxic labels."""
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").select("doc_id", "source", F.col("quality").alias("truth"), (1 - F.col("toxic")).alias("told"))


def pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(spark, sf_dir)
    n_pred, n_gold = F.col("told").cast("long"), F.col("truth").cast("long")
    hits = F.when((F.col("told") == 1) & (F.col("truth") == 1), 1).otherwise(0).cast("long")
    return rows.select("doc_id", F.col("source").alias("Relation"), *metrics.scores(n_pred, n_gold, hits), hits.alias("tp"), n_pred.alias("total_pred"), n_gold.alias("total_gold"))


PAIRS = """judged AS (SELECT l.doc_id, d.source, l.quality AS truth, 1 - l.toxic AS told FROM labels l JOIN documents d USING (doc_id)),
pairs AS (SELECT doc_id, source AS Relation, CASE WHEN told = 0 THEN 1.0 ELSE (told = 1 AND truth = 1)::INT::DOUBLE END AS p, CASE WHEN truth = 0 THEN 1.0 ELSE (told = 1 AND truth = 1)::INT::DOUBLE END AS r,
 (told = 1 AND truth = 1)::BIGINT AS tp, told::BIGINT AS total_pred, truth::BIGINT AS total_gold FROM judged),
scored AS (SELECT *, CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END AS f1 FROM pairs)"""


# -- text and parsing ----------------------------------------------------------------


@query(r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(replace(lower(strip_accents(regexp_replace(text, '[''’‘ʻʼʹ`´]', '', 'g'))), 'ß', 'ss'), '[\p{P}+$<=>|~^]', ' ', 'g'), '\s+', ' ', 'g'))) AS normal_md5 FROM documents""")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalize("text")).alias("normal_md5"))


@query("""SELECT n_nationkey, CASE lower(n_name) WHEN 'us' THEN 'united states' WHEN 'usa' THEN 'united states' WHEN 'uk' THEN 'united kingdom' WHEN 'prc' THEN 'china' WHEN 'uae' THEN 'united arab emirates'
 ELSE trim(regexp_replace(lower(n_name), '[^a-z0-9]+', ' ', 'g')) END AS name_key, 'numeric:' || (n_nationkey + 1)::VARCHAR AS number_key FROM nation""")
def canonical_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    number = (F.col("n_nationkey") + 1).cast("double")
    return n.select("n_nationkey", text.canonical_key(F.col("n_name"), number, F.lit(False)).alias("name_key"), text.canonical_key(F.col("n_name"), number, F.lit(True)).alias("number_key"))


@query(r"""WITH p AS (SELECT conv_id, turn, trim(string_split(trim(text, E' \n\t\r'), E'\n')[1], ' .') AS line FROM conversations),
 q AS (SELECT conv_id, turn, list_filter(list_transform(list_transform(string_split_regex(line, '[,;]'), lambda x: trim(x, ' .')), lambda y: CASE WHEN lower(substr(y, 1, 4)) = 'and ' THEN trim(substr(y, 5)) ELSE y END), lambda z: z <> '') AS parts, line FROM p)
 SELECT conv_id, turn, CASE WHEN lower(line) IN ('', 'none', 'n/a', 'na', 'unknown', 'no answer', 'empty', 'null') THEN 0 ELSE len(parts) END::BIGINT AS n_items,
 CASE WHEN lower(line) IN ('', 'none', 'n/a', 'na', 'unknown', 'no answer', 'empty', 'null') THEN '' ELSE array_to_string(parts, '|') END AS joined FROM q""")
def parse_answer_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = table(spark, sf_dir, "conversations").select("conv_id", "turn", parse.items(F.col("text"), F.lit(False)).alias("items"))
    return got.select("conv_id", "turn", F.size("items").cast("long").alias("n_items"), F.array_join("items", "|").alias("joined"))


@query(r"""SELECT page_id, nullif(regexp_extract(html, '-?\d[\d,]*\.?\d*'), '') AS first_number, TRY_CAST(replace(nullif(regexp_extract(html, '-?\d[\d,]*\.?\d*'), ''), ',', '') AS DOUBLE) AS number FROM pages""")
def first_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "pages").select("page_id", parse.first_number(F.col("html")).alias("first_number"))
    return found.select("page_id", "first_number", numbers.parse_number(F.col("first_number")).alias("number"))


@query(r"""WITH a AS (SELECT conv_id, turn, trim(trim(text, E' \n\t\r'), ' .') AS answer, text FROM conversations)
 SELECT conv_id, turn, CASE WHEN contains(text, '<think>') AND NOT contains(text, '</think>') THEN 'unclosed-think' WHEN answer = '' THEN 'empty' WHEN lower(answer) IN ('none', 'n/a', 'na', 'unknown', 'no answer', 'empty', 'null') THEN 'explicit-none' ELSE 'valid' END AS status,
 md5(answer) AS answer_md5, 'missing_answer_field' AS field_status FROM a""")
def answer_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = table(spark, sf_dir, "conversations").select("conv_id", "turn", parse.answer_status(F.col("text")).alias("s"), parse.answer_field(F.col("text"))["status"].alias("field_status"))
    return got.select("conv_id", "turn", "s.status", F.md5("s.answer").alias("answer_md5"), "field_status")


@query(r"""WITH v AS (SELECT doc_id, regexp_replace(lower(text), '\s+', ' ', 'g') AS v FROM documents)
 SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(v, '\b(?:19|20)[0-9]{2}\b|\b(recent|latest|for example|focus on|specific year)\b') THEN 'award_partial_scope' END], lambda x: x IS NOT NULL), ',') AS award_claims,
 array_to_string(list_filter([CASE WHEN regexp_matches(v, '\b(city of|died in|death (?:in|at))\b') THEN 'city_explicit' END, CASE WHEN regexp_matches(v, '\b(province|state|region|country)\b') AND NOT regexp_matches(v, '\b(city|town|municipality)\b') THEN 'city_noncity_scope' END], lambda x: x IS NOT NULL), ',') AS city_claims FROM v""")
def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    said = lambda r: F.array_join(text.claims(F.col("text"), F.lit(r)), ",")
    return d.select("doc_id", said("awardWonBy").alias("award_claims"), said("personHasCityOfDeath").alias("city_claims"))


# -- votes ----------------------------------------------------------------------------


@query(f"WITH {VOTES} SELECT user_id, item, votes, first_seen.p AS first_pos, row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, first_seen) AS rank FROM votes")
def vote_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = votes.ranked(user_votes(spark, sf_dir), ["user_id"])
    return got.select("user_id", "item", "votes", F.col("first_seen.event_id").alias("first_pos"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {VOTES}, n AS (SELECT user_id, count(DISTINCT CAST(ts AS DATE)) AS n, count(DISTINCT CAST(ts AS DATE)) FILTER (value > 50) AS m FROM events GROUP BY 1) SELECT 'all' AS rule, user_id, item, votes FROM votes JOIN n USING (user_id) WHERE votes / greatest(n, 1) >= 0.35 UNION ALL SELECT 'valid', user_id, item, votes FROM votes JOIN n USING (user_id) WHERE votes / greatest(m, 1) >= 0.5")
def threshold_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of all days, and of days with a large value."""
    days = answers(spark, sf_dir).groupBy("user_id").agg(F.count_distinct("day").alias("n"), F.count_distinct(F.when(F.col("value") > 50, F.col("day"))).alias("m"))
    every = user_votes(spark, sf_dir)
    rule = lambda name, share, of: votes.threshold_vote(every, days, ["user_id"], share, of).select(F.lit(name).alias("rule"), "user_id", "item", "votes")
    return rule("all", 0.35, "n").unionByName(rule("valid", 0.5, "m"))


@query(f"WITH {VOTES} SELECT user_id, item, votes FROM votes QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, first_seen) = 1")
def plurality_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.plurality(user_votes(spark, sf_dir), ["user_id"]).select("user_id", "item", "votes")


@query(f"WITH {VOTES}, w AS (SELECT user_id, item, votes FROM votes QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, first_seen) = 1) SELECT * FROM w WHERE votes >= 5")
def support_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.support_gate(user_votes(spark, sf_dir), ["user_id"], 5).select("user_id", "item", "votes")


@query(f"WITH {VOTES}, t AS (SELECT *, max(votes) OVER (PARTITION BY user_id) AS top FROM votes) SELECT user_id, votes, count(*) AS n_tied, string_agg(item, ',' ORDER BY item) AS tied FROM t WHERE votes = top GROUP BY ALL HAVING count(*) > 1")
def tie_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.ties(user_votes(spark, sf_dir), ["user_id"]).withColumn("tied", F.array_join("tied", ","))


def _fused(arm: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = answers(spark, sf_dir).withColumn("source", F.pmod("event_id", F.lit(3)))
        return votes.fuse_sources(rows, ["user_id"], "event_type", "source", "event_id", votes.ARMS[arm](3)).select("user_id", "item", "n_sources", F.col("place").cast("long").alias("place"))

    return run


for _name, _arm in (("source_union", "union"), ("source_agreement", "agreement"), ("source_majority", "majority"), ("source_unanimous", "unanimous")):
    QUERIES[_name] = _fused(_arm)
    ORACLES[_name] = f"WITH s AS (SELECT user_id, event_type AS item, count(DISTINCT event_id % 3) AS n_sources, min(struct_pack(s := event_id % 3, p := event_id)) AS first FROM events GROUP BY ALL) SELECT user_id, item, n_sources, row_number() OVER (PARTITION BY user_id ORDER BY first) AS place FROM s WHERE n_sources >= {votes.ARMS[_arm](3)}"


@query(f"WITH {VOTES}, o AS (SELECT DISTINCT user_id, event_type AS item FROM events WHERE value > 90) SELECT user_id, item, votes, votes < 4 AS promoted FROM votes LEFT JOIN (SELECT *, true AS c FROM o) USING (user_id, item) WHERE votes >= 4 OR (votes >= 3 AND coalesce(c, false))")
def corroborated_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = answers(spark, sf_dir).where("value > 90").select("user_id", F.col("event_type").alias("item"))
    return votes.corroborated_list(user_votes(spark, sf_dir), other, ["user_id"]).select("user_id", "item", "votes", "promoted")


# -- numbers --------------------------------------------------------------------------


@query("SELECT user_id, coalesce(median(value) FILTER (value > 60), median(value)) AS value, count(*) FILTER (value > 60) > 0 AS strict FROM events GROUP BY 1")
def purity_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.purity_median(answers(spark, sf_dir), ["user_id"], "value", F.col("value") > 60)


@query("WITH r AS (SELECT l_returnflag, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) SELECT l_returnflag, max(v) FILTER (i = least(n - 1, floor(0.55 * n))) AS q55 FROM r GROUP BY 1")
def index_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.index_quantile(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", 0.55, "q55")


@query("WITH g AS (SELECT user_id, CAST(ts AS DATE) AS day, list_sort(list(value)) AS v FROM events GROUP BY ALL) SELECT user_id, day, v[least(len(v) - 1, floor(0.55 * len(v))::INT) + 1] AS q55 FROM g")
def small_index_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rank inside one row's handful of samples."""
    return answers(spark, sf_dir).groupBy("user_id", "day").agg(numbers.index_quantile(F.collect_list("value"), 0.55).alias("q55"))


@query("""WITH c AS (SELECT a.p_brand, a.p_partkey AS c, a.p_retailprice AS center, count(*) AS size, round(sum(abs(ln(b.p_retailprice / a.p_retailprice))), 6) AS spread, median(b.p_retailprice) AS value
 FROM part a JOIN part b ON a.p_brand = b.p_brand AND abs(b.p_retailprice - a.p_retailprice) / a.p_retailprice <= 0.02 GROUP BY ALL)
 SELECT p_brand, value, size FROM c QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY size DESC, spread, center) = 1""")
def densest_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.densest(table(spark, sf_dir, "part"), ["p_brand"], "p_retailprice", 0.02).select("p_brand", "value", "size")


@query("""WITH c AS (SELECT a.user_id, a.day, a.event_id, a.value AS c, count(*) AS size, round(sum(abs(ln(b.value / a.value))), 9) AS spread, median(b.value) AS value
 FROM (SELECT *, CAST(ts AS DATE) AS day FROM events) a JOIN (SELECT *, CAST(ts AS DATE) AS day FROM events) b ON a.user_id = b.user_id AND a.day = b.day AND abs(b.value - a.value) / a.value <= 0.3 GROUP BY ALL)
 SELECT user_id, day, value, size FROM c QUALIFY row_number() OVER (PARTITION BY user_id, day ORDER BY size DESC, spread, c) = 1""")
def small_densest_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same cluster inside one row's handful of samples; a day without a value above 0 has none."""
    got = answers(spark, sf_dir).groupBy("user_id", "day").agg(numbers.densest_cluster(F.collect_list("value"), 0.3).alias("c")).where("c IS NOT NULL")
    return got.select("user_id", "day", F.col("c.value").alias("value"), F.col("c.size").cast("long").alias("size"))


@query("""WITH RECURSIVE s AS (SELECT p_brand, p_retailprice AS v, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice) AS i FROM part),
 g AS (SELECT p_brand, i, v, v AS anchor, 0 AS grp FROM s WHERE i = 1
  UNION ALL SELECT s.p_brand, s.i, s.v, CASE WHEN (s.v - g.anchor) / s.v <= 0.05 + 1e-12 THEN g.anchor ELSE s.v END, CASE WHEN (s.v - g.anchor) / s.v <= 0.05 + 1e-12 THEN g.grp ELSE g.grp + 1 END FROM g JOIN s ON s.p_brand = g.p_brand AND s.i = g.i + 1)
 SELECT p_brand, grp::BIGINT AS grp, count(*) AS n, min(v) AS low, max(v) AS high FROM g GROUP BY ALL""")
def complete_link_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = stats.anchored_runs(table(spark, sf_dir, "part"), ["p_brand"], "p_retailprice")
    return got.groupBy("p_brand", F.col("run").alias("grp")).agg(F.sum("w").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))


@query("WITH c AS (SELECT l_suppkey, l_extendedprice AS v, sum(l_quantity) AS w FROM lineitem GROUP BY ALL), r AS (SELECT *, sum(w) OVER (PARTITION BY l_suppkey ORDER BY v) AS run, sum(w) OVER (PARTITION BY l_suppkey) AS total FROM c) SELECT l_suppkey, min(v) AS weighted_median FROM r WHERE run >= total / 2 GROUP BY 1")
def weighted_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.weighted_median(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice", "l_quantity", "weighted_median")


@query("WITH b AS (SELECT p_brand, min(p_retailprice) AS anchor FROM part GROUP BY 1) SELECT p_brand, round(exp(sum(p_size * ln(p_retailprice)) / sum(p_size)), 6) AS geo_mean, count(*) AS n FROM part JOIN b USING (p_brand) WHERE abs(p_retailprice - anchor) / anchor <= 0.05 GROUP BY 1")
def geo_mean_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    got = stats.band_mean(p, p.groupBy("p_brand").agg(F.min("p_retailprice").alias("anchor")), ["p_brand"], "p_retailprice", "p_size")
    return got.select("p_brand", F.round("mean", 6).alias("geo_mean"), "n")


@query("WITH c AS (SELECT a.p_type, a.p_brand, a.p_retailprice AS v, round(sum(abs(ln(b.p_retailprice / a.p_retailprice))), 9) AS cost, a.p_partkey FROM part a JOIN part b ON a.p_type = b.p_type AND a.p_brand = b.p_brand GROUP BY ALL) SELECT p_type, p_brand, v AS medoid FROM c QUALIFY row_number() OVER (PARTITION BY p_type, p_brand ORDER BY cost, v) = 1")
def log_medoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.log_medoid(table(spark, sf_dir, "part"), ["p_type", "p_brand"], "p_retailprice", "medoid")


@query("""WITH s AS (SELECT l_orderkey, sum(l_extendedprice) AS total FROM lineitem GROUP BY 1)
 SELECT o_orderkey, coalesce(abs(o_totalprice - total) / nullif(total, 0) <= 0.05, false) AS of_gold, coalesce(abs(o_totalprice - total) / nullif(greatest(abs(o_totalprice), abs(total)), 0) <= 0.05 + 1e-12, o_totalprice = total) AS of_larger, abs(o_totalprice - total) <= 0.05 * greatest(abs(o_totalprice), abs(total)) AS of_product FROM orders JOIN s ON o_orderkey = l_orderkey""")
def numeric_tolerance_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("total"))
    a, b = F.col("o_totalprice"), F.col("total")
    return table(spark, sf_dir, "orders").join(total, "o_orderkey").select("o_orderkey", numbers.within_gold(a, b).alias("of_gold"), numbers.within_larger(a, b).alias("of_larger"), numbers.within_product(a, b).alias("of_product"))


# -- scoring --------------------------------------------------------------------------


@query(f"WITH {PAIRS} SELECT doc_id, p, r, f1 FROM scored")
def pair_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_scores(spark, sf_dir).select("doc_id", "p", "r", "f1")


@query(f"WITH {PAIRS} SELECT Relation, round(avg(p), 9) AS p, round(avg(r), 9) AS r, round(avg(f1), 9) AS f1, count(*) AS n_pairs FROM scored GROUP BY ROLLUP (Relation)")
def macro_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.macro(pair_scores(spark, sf_dir)).select("Relation", *[F.round(c, 9).alias(c) for c in ("p", "r", "f1")], "n_pairs")


@query(f"WITH {PAIRS}, s AS (SELECT Relation, sum(tp)::BIGINT AS tp, sum(total_pred)::BIGINT AS total_pred, sum(total_gold)::BIGINT AS total_gold FROM scored GROUP BY ROLLUP (Relation)), q AS (SELECT *, CASE WHEN total_pred = 0 THEN 1.0 ELSE tp / total_pred END AS p, CASE WHEN total_gold = 0 THEN 1.0 ELSE tp / total_gold END AS r FROM s) SELECT Relation, p, r, CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END AS f1, tp, total_pred, total_gold FROM q")
def micro_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.micro(pair_scores(spark, sf_dir))


@query(f"WITH {PAIRS} SELECT Relation, round(avg(total_pred), 9) AS avg_preds, count(*) FILTER (total_pred = 0) AS n_empty FROM scored GROUP BY ROLLUP (Relation)")
def pred_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.prediction_statistics(pair_scores(spark, sf_dir)).select("Relation", F.round("avg_preds", 9).alias("avg_preds"), "n_empty")


@query("""WITH p AS (SELECT DISTINCT c_nationkey AS k, lower(c_mktsegment) AS form FROM customer WHERE c_acctbal > 9000), g AS (SELECT DISTINCT c_nationkey AS k, c_mktsegment AS gold, lower(c_mktsegment) AS form FROM customer WHERE c_acctbal > 0)
 SELECT k, count(DISTINCT form) AS hits FROM p JOIN g USING (k, form) GROUP BY 1""")
def alias_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("seg"), "c_acctbal")
    preds = c.where("c_acctbal > 9000").select("k", text.normalize("seg").alias("form")).distinct()
    golds = c.where("c_acctbal > 0").select("k", F.dense_rank().over(Window.partitionBy("k").orderBy("seg")).alias("gold"), text.normalize("seg").alias("form")).distinct()
    return metrics.string_hits(metrics.alias_edges(preds, golds, ["k"]), ["k"])


@query("SELECT truth, told, count(*) AS n FROM (SELECT l.quality AS truth, 1 - l.toxic AS told FROM labels l JOIN documents USING (doc_id)) GROUP BY ALL")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(judged(spark, sf_dir), "truth", "told")


@query("WITH s AS (SELECT source, count(*) AS n, sum(quality)::DOUBLE AS sx, sum(1 - toxic)::DOUBLE AS sy, sum(quality * (1 - toxic))::DOUBLE AS sxy FROM labels JOIN documents USING (doc_id) GROUP BY 1) SELECT source, n, round((n * sxy - sx * sy) / nullif(sqrt(n * sx - sx * sx) * sqrt(n * sy - sy * sy), 0), 9) AS corr FROM s")
def guarded_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = metrics.correlation(judged(spark, sf_dir), "truth", "told", ["source"])
    return got.select("source", "n", F.round("corr", 9).alias("corr"))


# -- joins and windows -------------------------------------------------------------------


@query("SELECT d.doc_id, 'missing' AS problem FROM documents d ANTI JOIN labels l USING (doc_id) UNION ALL SELECT l.doc_id, 'extra' FROM labels l ANTI JOIN documents d USING (doc_id)")
def coverage_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.coverage(table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"), ["doc_id"])


@query("SELECT c_custkey, coalesce(n.n_name, c.c_name) AS c_name FROM customer c LEFT JOIN nation n ON c.c_custkey = n.n_nationkey")
def replace_if_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    newer = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("c_custkey"), F.col("n_name").alias("c_name"))
    return relational.replace_if_present(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), newer, ["c_custkey"], "c_name")


@query("SELECT conv_id, max(length(text)) FILTER (role = 'user') AS user, max(length(text)) FILTER (role = 'assistant') AS assistant, max(length(text)) FILTER (role = 'system') AS system FROM conversations GROUP BY 1")
def phase_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = relational.phase_pivot(table(spark, sf_dir, "conversations"), ["conv_id"], "role", ["user", "assistant", "system"], F.length("text"))
    return got.select("conv_id", *[F.col(c).cast("long").alias(c) for c in ("user", "assistant", "system")])


@query("SELECT s_suppkey, coalesce(lead(s_name) OVER w, first_value(s_name) OVER w) AS next_name FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_suppkey)")
def cyclic_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.cyclic_next(table(spark, sf_dir, "supplier"), "s_nationkey", ["s_suppkey"], "s_name", "next_name").select("s_suppkey", "next_name")


@query("WITH b AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day, event_type FROM events) SELECT x.event_type AS \"left\", y.event_type AS \"right\", count(*) AS n FROM b x JOIN b y ON x.user_id = y.user_id AND x.day = y.day AND x.event_type < y.event_type GROUP BY ALL")
def co_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.co_occurrence(answers(spark, sf_dir), ["user_id", "day"], "event_type")


@query("""WITH c AS (SELECT *, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS island FROM c)
 SELECT event_id, island, ((row_number() OVER (PARTITION BY user_id, island ORDER BY ts, event_id) - 1) // 2)::BIGINT AS chunk FROM i""")
def fixed_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.fixed_groups(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], ["event_type"], 2).select("event_id", "island", "chunk")


@query("WITH r AS (SELECT c_custkey, c_mktsegment, row_number() OVER w - 1 AS r, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey)) SELECT c_custkey, len(list_filter([n // 5, 2 * n // 5, 3 * n // 5, 4 * n // 5, n], lambda b: b <= r))::BIGINT AS slice FROM r")
def equal_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = relational.equal_slices(table(spark, sf_dir, "customer"), ["c_mktsegment"], ["c_acctbal", "c_custkey"], 5)
    return got.select("c_custkey", F.col("slice").cast("long").alias("slice"))


# -- sets ---------------------------------------------------------------------------------


def _baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, a, b): the event types of a user's small and large values."""
    e = answers(spark, sf_dir)
    pick = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("event_type"))))
    return e.groupBy("user_id").agg(pick(F.col("value") < 10).alias("a"), pick(F.col("value") > 30).alias("b"))


BASKETS = "s AS (SELECT user_id, coalesce(list_sort(list(DISTINCT event_type) FILTER (value < 10)), []) AS a, coalesce(list_sort(list(DISTINCT event_type) FILTER (value > 30)), []) AS b FROM events GROUP BY 1), n AS (SELECT *, len(list_intersect(a, b)) AS k, len(a) AS x, len(b) AS y FROM s)"


@query(f"WITH {BASKETS} SELECT user_id, round(CASE WHEN x + y = 0 THEN 1.0 ELSE 2.0 * k / (x + y) END, 9) AS set_f1 FROM n")
def set_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _baskets(spark, sf_dir).select("user_id", F.round(numbers.set_f1(F.col("a"), F.col("b")), 9).alias("set_f1"))


@query(f"WITH {BASKETS} SELECT user_id, round(CASE WHEN x + y = 0 THEN 1.0 ELSE k / (x + y - k) END, 9) AS jaccard, (y - k)::BIGINT AS added, (x - k)::BIGINT AS dropped FROM n")
def jaccard_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return _baskets(spark, sf_dir).select("user_id", F.round(numbers.jaccard(a, b), 9).alias("jaccard"), F.size(F.array_except(b, a)).cast("long").alias("added"), F.size(F.array_except(a, b)).cast("long").alias("dropped"))


@query(f"WITH {BASKETS} SELECT user_id, CASE WHEN x = 0 THEN 1 + y ELSE 2 + y - CASE WHEN x = 1 AND k = 1 THEN 1 ELSE 0 END + (y - k) + x - CASE WHEN x = 1 THEN 1 ELSE 0 END - CASE WHEN x = 2 THEN k ELSE 0 END END::BIGINT AS n_actions FROM n")
def action_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _baskets(spark, sf_dir).select("user_id", F.size(decode.actions(F.col("a"), F.col("b"))).cast("long").alias("n_actions"))


@query("WITH b AS (SELECT user_id, CAST(ts AS DATE) AS day, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS tokens FROM events GROUP BY ALL), g AS (SELECT user_id, tokens, count(*) AS n_days FROM b GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n_days DESC, tokens) AS place FROM g")
def hypothesis_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's days as events that state a complete set; the sets by how many days state them."""
    a = answers(spark, sf_dir).withColumn("day_id", F.col("day").cast("string"))
    events = a.select("user_id", F.col("day_id").alias("id"), F.lit("candidate_set").alias("status"), F.lit("f").alias("model_family")).distinct()
    edges = a.select("user_id", F.col("day_id").alias("source"), F.col("event_type").alias("target"), F.lit("supports").alias("edge_type")).distinct()
    nobody = events.select("user_id").distinct().limit(0).withColumn("tokens", F.expr("cast(array() as array<string>)"))
    got = graph.hypotheses(graph.event_records(events, edges, ["user_id"]), nobody, ["user_id"])
    got = got.select("user_id", F.array_join("tokens", ",").alias("tokens"), F.size("event_ids").cast("long").alias("n_days"))
    return got.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n_days"), "tokens")).cast("long"))


# -- graphs -----------------------------------------------------------------------------------


@query("""WITH RECURSIVE n AS (SELECT n_regionkey AS k, n_nationkey AS i, lower(n_name) AS f FROM nation), e AS (SELECT a.k, a.i AS u, b.i AS v FROM n a JOIN n b ON a.k = b.k AND a.i <> b.i AND substr(a.f, 1, 1) = substr(b.f, 1, 1)),
 r AS (SELECT k, i, i AS c FROM n UNION SELECT e.k, e.v, r.c FROM r JOIN e ON r.k = e.k AND r.i = e.u) SELECT k, i AS idx, min(c) AS component FROM r GROUP BY ALL""")
def string_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("k"), F.col("n_nationkey").alias("idx"), F.substring(F.lower("n_name"), 1, 1).alias("f"))
    a, b = n.alias("a"), n.alias("b")
    edges = a.join(b, (F.col("a.k") == F.col("b.k")) & (F.col("a.f") == F.col("b.f")) & (F.col("a.idx") < F.col("b.idx"))).select(F.col("a.k").alias("k"), F.col("a.idx").alias("left"), F.col("b.idx").alias("right"), F.lit(False).alias("blocked"))
    return graph.string_components(n, edges, ["k"])


@query("SELECT event_id, CASE WHEN event_type = 'purchase' AND value < 20 THEN 'unparsed_or_no_candidate' WHEN event_type = 'purchase' THEN 'candidate_set' ELSE 'other' END AS status FROM events")
def event_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    events = e.select(F.lit(1).alias("k"), F.col("event_id").alias("id"), F.when(F.col("event_type") == "purchase", "candidate_set").otherwise("other").alias("status"))
    edges = e.where("event_type = 'purchase' AND value >= 20").select(F.lit(1).alias("k"), F.col("event_id").alias("source"), F.col("user_id").cast("string").alias("target"), F.lit("supports").alias("edge_type"))
    fixed, _ = graph.repair_events(events, edges, ["k"])
    return fixed.select(F.col("id").alias("event_id"), "status")


@query("SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS routes FROM events WHERE event_type IN ('click', 'purchase') GROUP BY 1")
def route_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = answers(spark, sf_dir).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    nodes = counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("routes"))
    return graph.in_scope(nodes, ["click", "purchase"]).select("user_id", F.array_join(F.array_sort(F.map_keys("routes")), ",").alias("routes"))


# -- decoding ----------------------------------------------------------------------------------


@query("""WITH p AS (SELECT c_nationkey, c_custkey, 1 / (1 + exp(-c_acctbal / 5000)) AS pr FROM customer), r AS (SELECT *, row_number() OVER w AS size, sum(pr) OVER w AS mass FROM p WINDOW w AS (PARTITION BY c_nationkey ORDER BY pr DESC, c_custkey ROWS UNBOUNDED PRECEDING))
 SELECT c_nationkey, size, round(2 * mass / (size + 5.0), 9) AS utility FROM r QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY 2 * mass / (size + 5.0) DESC, size) = 1""")
def prefix_utility(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", numbers.sigmoid(F.col("c_acctbal") / 5000).alias("pr"), F.lit(5.0).alias("expected"))
    got = decode.prefix_utility(c, ["c_nationkey"], "pr", "c_custkey", "expected")
    return got.select("c_nationkey", "size", F.round("utility", 9).alias("utility"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(1 / (1 + exp(-greatest(-30, least(30, 0.5 - 0.02 * l_quantity + 3 * l_discount - 2 * l_tax)))), 9) AS probability FROM lineitem")
def logistic_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    beta = F.array(*[F.lit(b) for b in (0.5, -0.02, 3.0, -2.0)])
    x = F.array(F.lit(1.0), "l_quantity", "l_discount", "l_tax")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(decode.logistic_score(x, beta), 9).alias("probability"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(0.1 + 0.4 * (l_quantity - 25) / 14 - 1.5 * (l_discount - 0.05) / 0.03, 9) AS estimate FROM lineitem")
def ridge_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    doubles = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    got = decode.ridge_score(F.array(F.lit(1.0), "l_quantity", "l_discount"), doubles(0, 25, 0.05), doubles(1, 14, 0.03), doubles(0.1, 0.4, -1.5))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(got, 9).alias("estimate"))


@query("""WITH s AS (SELECT sum(1.0) a, sum(l_quantity) b, sum(l_discount) c, sum(l_quantity * l_quantity) d, sum(l_quantity * l_discount) e, sum(l_discount * l_discount) f, sum(l_tax) g, sum(l_quantity * l_tax) h, sum(l_discount * l_tax) i FROM lineitem)
 SELECT x.i, x.j, round(x.v, 4) AS value FROM s, (VALUES (0, 0, 1), (0, 1, 2), (0, 2, 3), (1, 1, 4), (1, 2, 5), (2, 2, 6), (0, -1, 7), (1, -1, 8), (2, -1, 9)) k(i, j, n), LATERAL (SELECT k.i AS i, k.j AS j, [a, b, c, d, e, f, g, h, i][k.n] AS v) x""".replace("[a, b, c, d, e, f, g, h, i][k.n]", "[s.a, s.b, s.c, s.d, s.e, s.f, s.g, s.h, s.i][k.n]"))
def gram_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("one", F.lit(1.0))
    return decode.gram(rows, ["one", "l_quantity", "l_discount"], "l_tax").select("i", "j", F.round("value", 4).alias("value"))


@query("WITH c AS (SELECT user_id, event_type, avg(value) / 100 AS s FROM events GROUP BY ALL), e AS (SELECT *, exp(s - max(s) OVER (PARTITION BY user_id)) AS x FROM c) SELECT user_id, event_type, round(x / sum(x) OVER (PARTITION BY user_id), 9) AS share FROM e")
def softmax_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = answers(spark, sf_dir).groupBy("user_id", "event_type").agg((F.avg("value") / 100).alias("s"))
    maps = means.groupBy("user_id").agg(numbers.softmax(F.map_from_entries(F.collect_list(F.struct("event_type", "s")))).alias("m"))
    return maps.select("user_id", F.explode("m").alias("event_type", "share")).withColumn("share", F.round("share", 9))


@query("SELECT c_custkey, substr(sha256('system' || chr(31) || c_name || chr(31) || c_custkey::VARCHAR), 1, 16) AS seed_hex FROM customer")
def stable_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", text.seed_hex(F.lit("system"), F.col("c_name"), F.col("c_custkey")).alias("seed_hex"))


@query(f"""WITH {VOTES}, w AS (SELECT user_id, item FROM votes QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, first_seen) = 1),
 s AS (SELECT user_id, list(item ORDER BY votes DESC, item) AS s FROM votes WHERE votes >= 7 GROUP BY 1),
 a AS (SELECT w.user_id, w.item, list_concat([w.item], list_filter(coalesce(s.s, []), lambda x: x <> w.item)) AS o FROM w LEFT JOIN s USING (user_id))
 SELECT user_id, array_to_string(o[1:2], ',') AS objects, ((len(o) > 1)::INT + (len(o) > 2)::INT) AS n_changed FROM a""")
def layer_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two layers over users' first votes, with what each changed."""
    won = votes.plurality(user_votes(spark, sf_dir), ["user_id"]).select("user_id", F.array("item").alias("objects"))
    strong = user_votes(spark, sf_dir).where("votes >= 7")

    def support(rows: DataFrame) -> DataFrame:
        facts = strong.select("user_id", F.col("item").alias("key"), "item", F.col("votes").alias("support"))
        return decode.support_rule(facts, rows.withColumn("kind", F.lit("string")), ["user_id"])

    def single(rows: DataFrame) -> DataFrame:
        return rows.withColumn("objects", F.slice("objects", 1, 2))

    out = decode.layered(won, [("support-7", support), ("two at most", single)], ["user_id"])
    return out.select("user_id", F.array_join("objects", ",").alias("objects"), F.size(F.filter("trace", lambda t: t["changed"])).alias("n_changed"))


@query()
def codebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balanced codes of four choices for every nation."""
    choices = F.array(*[F.lit(c) for c in ("ZERO", "ONE", "MANY", "UNKNOWN")])
    return tasks.with_codebooks(table(spark, sf_dir, "nation"), choices, "books", F.col("n_name")).select("n_nationkey", F.to_json("books").alias("books"))


# the other families register themselves in the same tables
from . import answer_queries, evidence_queries, task_queries  # noqa: E402, F401
