"""Operators over keyed rows against golden vectors and brute force."""

import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from consilium.operators import contracts, decode, graph, metrics, relational, tasks, votes
from consilium.plans import evaluate
from consilium.schemas import FAMILIES, GOLD, PREDICTION, RAW_CACHE, relation_dimension
from consilium.sources import files
from consilium.streaming import running_votes

KEYS = ["SubjectEntity", "Relation"]
VOTE = "k string, s int, p int, item string, shown string"


@pytest.fixture(scope="module")
def relations(spark):
    return relation_dimension(spark)


def voted(spark, answers, **more):
    rows = [("k", s, p, i.lower(), i) for s, items in enumerate(answers) for p, i in enumerate(items)]
    return votes.vote_table(spark.createDataFrame(rows, VOTE), ["k"], "item", "s", "p", "shown", **more)


def test_votes_count_a_sample_once(spark):
    got = votes.ranked(voted(spark, [["NYSE", "nyse", "B"], ["B"], [""], ["b", "NYSE"]], samples=True), ["k"]).orderBy("rank").collect()
    assert [(r.item, r.votes, r.display, r.in_samples) for r in got] == [("b", 3, "B", [0, 1, 3]), ("nyse", 2, "NYSE", [0, 3])]


def test_ties_go_to_the_first_seen(spark):
    t = voted(spark, [["b"], ["a"], ["a"], ["b"]])
    assert votes.plurality(t, ["k"]).first().item == "b"
    assert votes.ties(t, ["k"]).first().tied == ["a", "b"]
    assert votes.supported(t, ["k"], 1, numeric=True).count() == 0 and votes.supported(t, ["k"], 2).count() == 2


def test_gates_and_thresholds(spark):
    t = voted(spark, [["Paris"]] * 5)
    assert votes.support_gate(t, ["k"], 5).first().display == "Paris" and votes.support_gate(t, ["k"], 6).count() == 0
    totals = spark.createDataFrame([("k", 10, 2)], "k string, n int, m int")
    assert votes.threshold_vote(t, totals, ["k"], 0.5).count() == 1 and votes.threshold_vote(t, totals, ["k"], 0.51).count() == 0
    assert votes.threshold_vote(t, totals, ["k"], 0.51, "m").count() == 1
    assert votes.thresholds(10) == {"any": 1, "majority": 6, "two_thirds": 7, "unanimous": 10} and list(votes.thresholds(3).values()) == [1, 2, 2, 3]


@pytest.mark.parametrize("least, want", [(1, ["nyse", "nasdaq"]), (2, ["nyse", "nasdaq"]), (3, [])])
def test_source_fusion(spark, least, want):
    rows = [("k", s, p, i, i) for s, items in enumerate([["nyse", "nyse"], ["nyse", "nasdaq"], ["nasdaq"]]) for p, i in enumerate(items)]
    got = votes.fuse_sources(spark.createDataFrame(rows, VOTE), ["k"], "item", "s", "p", least).orderBy("place").collect()
    assert [r.item for r in got] == want


def test_number_fusion(spark):
    f = lambda xs: votes.fuse_numbers(spark.createDataFrame([("k", x) for x in xs], "k string, v double"), ["k"], "v", 2).collect()
    assert [r.value for r in f([100.0, 120.0, 1000.0])] == [120.0] and f([100.0, None, None]) == []


def test_corroboration(spark):
    t = voted(spark, [["NYSE"]] * 3)
    other = spark.createDataFrame([("k", "nyse", 0, "NYSE!")], "k string, item string, pos int, display string")
    assert votes.corroborated_list(t, other, ["k"]).first().promoted and votes.corroborated_list(t, other.limit(0), ["k"]).count() == 0
    assert votes.corroborated_list(voted(spark, [["NYSE"]] * 2), other, ["k"]).count() == 0
    city = voted(spark, [["Paris"]] * 3 + [["London"]] * 2)
    pick = lambda name: spark.createDataFrame([("k", name.lower(), 0, name)], "k string, item string, pos int, display string")
    assert [r.display for r in votes.corroborated_single(city, pick("Paris"), ["k"]).collect()] == ["Paris"]
    six = voted(spark, [["Paris"]] * 5)
    assert votes.corroborated_single(six, pick("London"), ["k"], least=6).count() == 0
    assert [r.display for r in votes.corroborated_single(six, pick("PARIS"), ["k"], least=6).collect()] == ["PARIS"]


SCORED = [
    ("s1", "companyTradesAtStockExchange", [], [], (1, 1, 1)),
    ("s2", "countryLandBordersCountry", [["Haiti"]], None, (1, 0, 0)),
    ("s3", "companyTradesAtStockExchange", [], ["X"], (0, 1, 0)),
    ("s4", "companyTradesAtStockExchange", [["New York Stock Exchange", "NYSE"]], ["nyse"], (1, 1, 1)),
    ("s5", "awardWonBy", [["NYC", "New York City"]], ["NYC", "New York City"], (0.5, 1, 2 / 3)),
    ("s6", "awardWonBy", [["Kauai"]], ["Kaua'i", "Kauai"], (1, 1, 1)),
    ("s7", "hasArea", [["100"]], ["105"], (1, 1, 1)),
    ("s8", "hasArea", [["100"]], ["105.1"], (0, 0, 0)),
    ("s9", "hasArea", [["0"]], ["0"], (0, 0, 0)),
    ("s10", "awardWonBy", [["a", "b"], ["b", "c"], ["c"]], ["b", "c", "a"], (2 / 3, 2 / 3, 2 / 3)),
]


def test_scorer_fixtures(spark, relations):
    gold = spark.createDataFrame([(s, r, g) for s, r, g, _, _ in SCORED], GOLD)
    rows = [(s, r, p, i) for i, (s, r, _, p, _) in enumerate(SCORED) if p is not None] + [("s4", "companyTradesAtStockExchange", ["wrong"], -1), ("extra", "hasArea", ["1"], 99)]
    pairs = metrics.score_pairs(spark.createDataFrame(rows, PREDICTION + ", pos int"), gold, relations).cache()
    got = {r.SubjectEntity: (r.p, r.r, r.f1) for r in pairs.collect()}
    for s, _, _, _, want in SCORED[:-1]:
        assert got[s] == pytest.approx(want), s
    assert got["s10"][1] == pytest.approx(1.0)
    overall = metrics.macro(pairs).where("Relation IS NULL").first()
    assert overall.n_pairs == len(SCORED) and overall.f1 == pytest.approx(sum(x[2] for x in got.values()) / len(SCORED))
    micro = metrics.micro(pairs).where("Relation IS NULL").first()
    assert micro.p == pytest.approx(micro.tp / micro.total_pred)
    assert metrics.result_table(pairs).count() == pairs.select("Relation").distinct().count() + 1


def test_matching_equals_brute_force(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for k in range(25):
        edges = {(rng.randrange(4), rng.randrange(4)) for _ in range(rng.randrange(1, 8))}
        rows += [(k, p, g) for p, g in edges]
        want[k] = max(n for n in range(5) for s in itertools.combinations(edges, n) if len({p for p, _ in s}) == len({g for _, g in s}) == n)
    got = metrics.string_hits(spark.createDataFrame(rows, "k int, pred int, gold int"), ["k"]).collect()
    assert {r.k: r.hits for r in got} == want


def first_fits(preds, golds, tolerance):
    used = set()
    for p in preds:
        fit = [i for i, g in enumerate(golds) if i not in used and p is not None and g and abs(p - g) / g <= tolerance]
        used.update(fit[:1])
    return len(used)


def test_numeric_matches_take_the_first_that_fits(spark):
    rng = random.Random(5)
    odd = [0.0, -0.0, None, -3.0, -200.0, 1e308, -1e308, 5e-324, float("inf"), float("-inf"), float("nan")]
    near = [100.0, 100 / 1.05, 100 / 0.95, 105.0, 95.0]
    some = lambda: [rng.choice(odd) if rng.random() < 0.1 else rng.choice([round(rng.uniform(90, 110), 1), float(rng.randint(1, 25)), rng.choice(near)]) for _ in range(rng.randint(0, 25))]
    rows = [(k, some(), some()) for k in range(300)] + [(300, None, [1.0])]
    frame = spark.createDataFrame(rows, "k int, p array<double>, g array<double>")
    for tolerance in (0.05, 0.0, 0.6):
        got = {r.k: r.n for r in frame.select("k", metrics.numeric_hits(F.col("p"), F.col("g"), tolerance).alias("n")).collect()}
        assert got == {k: None if p is None else first_fits(p, g, tolerance) for k, p, g in rows}


def test_numeric_matches_of_long_lists(spark, relations):
    n = 20_000
    one = spark.range(1).select(F.lit("s").alias("SubjectEntity"), F.lit("hasArea").alias("Relation"), F.sequence(F.lit(1), F.lit(n)).alias("i"))
    gold = one.select(*KEYS, F.transform("i", lambda i: F.array(F.when(i % 2 == 0, "101").otherwise("500"))).alias("ObjectEntities"))
    told = one.select(*KEYS, F.transform("i", lambda i: (100 + i / 10_000).cast("string")).alias("ObjectEntities"), F.lit(1).alias("pos"))
    got = metrics.score_pairs(told, gold, relations).first()
    assert (got.tp, got.total_pred, got.total_gold) == (n // 2, n, n)


def test_constant_sides_have_no_correlation(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 4.0), ("b", 1.0, 1.0), ("b", 1.0, 2.0)], "g string, x double, y double")
    assert {r.g: r["corr"] for r in metrics.correlation(df, "x", "y", ["g"]).collect()} == {"a": pytest.approx(1.0), "b": None}


def test_required_sources(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2)], "k string, pos int")
    with pytest.raises(relational.ContractError, match="Missing 1 required rows"):
        relational.required_join(base, {"src": spark.createDataFrame([("a", 5)], "k string, v int")}, ["k"])
    with pytest.raises(relational.ContractError, match="duplicate"):
        relational.unique_keys(spark.createDataFrame([("a",), ("a",)], "k string"), ["k"])


def test_lookups(spark):
    known = spark.createDataFrame([("k", "f1", 100.0, "c1"), ("k", "f2", 103.0, "c2"), ("k", "f3", 500.0, "c3")], "k string, form string, v double, target string")
    rows = spark.createDataFrame([("k", "f1", 100.0), ("k", "zz", 510.0), ("k", "yy", 101.0)], "k string, form string, v double")
    got = {r.form: (r.target, r.how) for r in relational.exact_then_unique_near(rows, known, ["k"], "form", "v").collect()}
    assert got == {"f1": ("c1", "exact"), "zz": ("c3", "near")}
    assert {r.form: r.target for r in relational.nearest(rows, known.drop("form"), ["k"], "v").collect()} == {"f1": "c1", "zz": "c3", "yy": "c1"}
    mapping = spark.createDataFrame([("k", "new")], "k string, new_key string")
    assert relational.rekey(known, mapping, "k").select("k").distinct().first().k == "new"


def test_equivalences_and_components(spark):
    items = ["NYSE", "New York Stock Exchange", "new york stock exchange", "TSE", "Tokyo Stock Exchange", "Toronto Stock Exchange", "Foo (bar)", "Foo"]
    c = spark.createDataFrame([("k", i, x) for i, x in enumerate(items)], "k string, idx int, item string")
    edges = graph.equivalences(c, ["k"])
    rules = {(r.left, r.right): (r.rule, r.blocked) for r in edges.collect()}
    assert rules[0, 1] == ("explicit_acronym", False) and rules[1, 2] == ("normalized_exact", False) and rules[6, 7] == ("parenthetical_alias", False)
    assert rules[3, 4] == ("explicit_acronym", True) and rules[3, 5] == ("explicit_acronym", True)
    comp = {r.idx: r.component for r in graph.string_components(c, edges, ["k"]).collect()}
    assert comp == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 5, 6: 6, 7: 6}


def test_complete_link_picks_the_nearest_group(spark):
    df = spark.createDataFrame([("k", str(i), float(v)) for i, v in enumerate([100, 104, 108, 200])], "k string, id string, value double")
    got = {r.id: r.grp for r in graph.complete_link(df, ["k"]).collect()}
    assert got["0"] == got["1"] and got["2"] != got["0"] and got["3"] not in (got["0"], got["2"])


EVENTS = [("s", "r", "e:q", "candidate_set", FAMILIES[0]), ("s", "r", "e:g", "candidate_set", FAMILIES[1]), ("s", "r", "e:m", "explicit_none", FAMILIES[2])]
EDGES = [("s", "r", "e:q", "c1", "supports"), ("s", "r", "e:g", "c1", "supports")]


def event_tables(spark, events=EVENTS, edges=EDGES):
    e = spark.createDataFrame(events, "SubjectEntity string, Relation string, id string, status string, model_family string").withColumn("claims", F.expr("cast(array() as array<string>)"))
    return e, spark.createDataFrame(edges, "SubjectEntity string, Relation string, source string, target string, edge_type string")


def test_event_records_and_repair(spark):
    e, edges = event_tables(spark)
    assert [r.exact_cardinality for r in graph.event_records(e, edges, KEYS).orderBy("id").collect()] == [1, 0, 1]
    bad_e, bad_edges = event_tables(spark, [("s", "r", "x", "candidate_set", FAMILIES[0])], [("s", "r", "x", "cardinality:ONE", "asserts"), ("s", "r", "x", "claim:y", "asserts")])
    fixed, kept = graph.repair_events(bad_e, bad_edges, KEYS)
    assert fixed.first().status == "unparsed_or_no_candidate" and kept.count() == 0
    odd_e, odd_edges = event_tables(spark, [("s", "r", "x", "explicit_none", FAMILIES[0])], [("s", "r", "x", "c", "supports")])
    with pytest.raises(relational.ContractError, match="supported_explicit_none"):
        contracts.require(graph.event_violations(odd_e, odd_edges, KEYS), "events")
    states = {r.target for r in graph.state_edges(e, edges, KEYS).collect()}
    assert states == {"cardinality:ONE", "existence:NONEMPTY", "cardinality:ZERO", "existence:EMPTY"}


def test_proof_replaces_the_incumbent_only_when_proven(spark):
    agree = [("s", "r", f"e{i}", "candidate_set", f) for i, f in enumerate(FAMILIES)]
    e, edges = event_tables(spark, agree, [("s", "r", f"e{i}", "new", "supports") for i in range(3)])
    records = graph.event_records(e, edges, KEYS)
    inc = spark.createDataFrame([("s", "r", ["old"])], "SubjectEntity string, Relation string, tokens array<string>")
    hyps = graph.proof_metrics(graph.hypotheses(records, inc, KEYS), records, KEYS)
    new = hyps.where("NOT is_incumbent").first()
    assert new.exact_family_fraction == 1.0 and new.minimum_similarity == 1.0 and new.independent_similarity == 1.0
    # equal cardinality on both sides proves nothing under the cardinality guard
    assert decode.prove(hyps, KEYS).first().tokens == ["old"]
    two = spark.createDataFrame([("s", "r", ["old", "older"])], "SubjectEntity string, Relation string, tokens array<string>")
    got = decode.prove(graph.proof_metrics(graph.hypotheses(records, two, KEYS), records, KEYS), KEYS).first()
    assert got.tokens == ["new"] and got.changed


@pytest.mark.parametrize("keep, challenger, arm, want", [(1 / 3, 2 / 3, "loose_proof_graph", True), (1 / 3, 2 / 3, "strict_proof_graph", False), (1 / 3, 1.0, "strict_proof_graph", True)])
def test_proof_predicate(spark, keep, challenger, arm, want):
    m = lambda f, c: F.struct(F.lit(f).alias("exact_family_fraction"), F.lit(1.0).alias("minimum_similarity"), F.lit(c).alias("exact_cardinality_match_rate"), F.lit(1.0).alias("existence_match_rate"), F.lit(1.0).alias("set_size"))
    assert spark.range(1).select(decode.eligible(m(challenger, 1.0), m(keep, 0.5), arm).alias("x")).first().x is want


@pytest.mark.parametrize("fraction, members, want", [(1.0, [10000.0, 10400.0], True), (2 / 3, [10000.0, 10400.0], False), (1.0, [10000.0, 12000.0], False)])
def test_numeric_proof(spark, fraction, members, want):
    option = lambda v, f, r: F.struct(F.lit(v).alias("value"), F.lit(f).alias("family_fraction"), F.create_map(*[F.lit(x) for fam in FAMILIES for x in (fam, r)]).alias("rates"))
    got = decode.numeric_proof(option(10000.0, fraction, 0.5), option(9000.0, 1 / 3, 0.1), F.array(*[F.lit(m) for m in members]))
    assert spark.range(1).select(got.alias("x")).first().x is want


def test_numeric_options_and_switch(spark):
    nodes = spark.createDataFrame([("k", 0, 100.0, 3.0), ("k", 1, 102.0, 1.0), ("k", 2, 900.0, 1.0)], "k string, pos int, value double, weight double")
    base = spark.createDataFrame([("k", 100.0)], "k string, value double")
    got = decode.numeric_options(nodes, base, ["k"]).orderBy("place").collect()
    assert got[0].value == 100.0 and got[0].kinds == ["baseline", "cluster_median", "node"]
    assert any("cluster_geomean" in r.kinds and abs(r.value - (100**3 * 102) ** 0.25) < 1e-9 for r in got)
    rows = spark.createDataFrame([("k", r.value, r.kinds, r.place, 0.9 if r.value == 900 else 0.5) for r in got], "k string, value double, kinds array<string>, place int, probability double")
    assert decode.switch_numeric(rows, ["k"], 0.02).first().value == 900.0
    assert decode.switch_numeric(rows, ["k"], 0.4).first().used_baseline


def test_guarded_set_decoding(spark):
    scored = spark.createDataFrame([("k", "a", "A", 0.9), ("k", "b", "B", 0.8), ("k", "c", "C", 0.1)], "k string, key string, item string, probability double")
    ctx = lambda base: spark.createDataFrame([("k", "string", False, True, 0.05, 2.0, base)], "k string, kind string, single boolean, nullable boolean, zero double, expected double, baseline array<string>")
    assert decode.decode_cardinality(scored, ctx(["c"]), ["k"]).first().objects == ["a", "b"]
    kept = decode.decode_cardinality(scored, ctx(["a"]), ["k"]).first()
    assert kept.objects == ["a", "b"] or kept.used_baseline
    assert decode.decode_cardinality(scored.limit(0), ctx([]), ["k"]).first().objects == []


def test_actions(spark):
    got = spark.range(1).select(decode.actions(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c"))).alias("x")).first().x
    assert got == [["a", "b"], [], ["b"], ["c"], ["a", "b", "c"], ["a"]]


def test_fits_recover_their_models(spark):
    rng = random.Random(1)
    rows = [(1.0, rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(400)]
    df = spark.createDataFrame([(*r, 2 + 3 * r[1] - r[2], float(rng.random() < 1 / (1 + 2.718 ** -(2 * r[1])))) for r in rows], "one double, a double, b double, y double, z double")
    assert decode.fit_ridge(df, ["one", "a", "b"], "y", l2=1e-6) == pytest.approx([2, 3, -1], abs=1e-3)
    beta = decode.fit_logistic(df, ["one", "a", "b"], "z")
    assert beta[1] > 1 and abs(beta[2]) < 0.5
    by = df.select(F.lit("hasArea").alias("Relation"), F.array("one", "a", "b").alias("x"), F.col("z").alias("y"), F.lit(1.0).alias("weight"))
    assert decode.fit_by_relation(by).first().coefficients == pytest.approx(list(beta), abs=1e-6)


def test_support_and_unanimity_rules(spark):
    support = spark.createDataFrame([("n", "5", 7), ("n", "6", 7), ("m", "9", 8), ("t", "x", 7)], "k string, key string, support int")
    ans = spark.createDataFrame([("n", "numeric", ["1"]), ("m", "numeric", ["1"]), ("t", "string", ["y"])], "k string, kind string, objects array<string>")
    assert {r.k: r.objects for r in decode.support_rule(support, ans, ["k"]).collect()} == {"n": ["1"], "m": ["9"], "t": ["y", "x"]}
    supply = spark.createDataFrame([("n", "7", 3, True), ("m", "8", 3, True), ("m", "9", 3, True)], "k string, key string, support int, novel boolean")
    assert {r.k: r.changed for r in decode.unanimous_rule(supply, ans, ["k"]).collect()} == {"n": True, "m": False, "t": False}


def test_contracts(spark, relations):
    rows = spark.createDataFrame([(" ", "hasArea"), ("a", "nope"), ("b", "hasArea"), ("b", "hasArea")], "SubjectEntity string, Relation string")
    assert {r.problem for r in contracts.input_violations(rows, relations).collect()} == {"blank subject", "unknown relation", "duplicate key"}
    ref = spark.createDataFrame([("a", "hasArea"), ("b", "hasArea")], "SubjectEntity string, Relation string")
    pred = spark.createDataFrame([("a", "hasArea", []), ("c", "hasArea", ["1"])], PREDICTION)
    assert {(r.SubjectEntity, r.problem) for r in contracts.prediction_violations(pred, ref, relations).collect()} == {("b", "missing"), ("c", "extra"), ("a", "empty answer")}
    raw = spark.createDataFrame([("a", "hasArea", ["x"] * 8, ["valid"] * 8, None, None, [[]] * 7 + [["a"]], None)], RAW_CACHE)
    with pytest.raises(relational.ContractError, match="sample 7"):
        contracts.require(contracts.raw_violations(raw, 8, exclude_target=True), "raw")
    assert contracts.budget_problems([{"agent_id": "x", "checkpoint": "c", "parameters": 5}, {"agent_id": "y", "checkpoint": "c", "parameters": 5}], 5) == []
    with pytest.raises(relational.ContractError):
        contracts.inside(__import__("pathlib").Path("/tmp"), "../x")


def test_tasks(spark, relations):
    rows = spark.createDataFrame([("a", "hasArea", 0), ("b", "personHasCityOfDeath", 1)], "SubjectEntity string, Relation string, pos bigint")
    agents = spark.createDataFrame([("g1", 0.8), ("g2", 0.8)], "agent_id string, temperature double")
    t = tasks.agent_tasks(rows, agents, relations, 10)
    assert t.count() == 12 and t.select("task_id").distinct().count() == 12
    assert tasks.constant_responses(t).count() == 4
    assert tasks.pending(t, t.where("phase = 'propose'")).count() == 8
    got = json.loads(tasks.with_codebooks(rows, F.array(*map(F.lit, "wxyz")), "books", F.col("SubjectEntity")).select(F.to_json("books").alias("b")).first().b)
    assert len(got) == 4 and all({book[c] for book in got} == set("ABCD") for c in "wxyz")
    pool = spark.createDataFrame([("hasArea", s, f"ex{i}", i % 2 == 0) for i, s in enumerate(["a", "A ", "c", "c", "d", "e"])], "Relation string, SubjectEntity string, example string, is_empty boolean")
    shots = tasks.demonstrations(rows, pool, 3, "45").collect()
    assert len(shots) == 3 and {r.shot for r in shots} <= {"c", "d", "e"} and len({r.shot for r in shots}) == 3


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("é", "hasArea", ["1"], 1), ("a", "hasArea", [], 0)], PREDICTION + ", pos int")
    sha = files.write_jsonl_file(df, tmp_path / "p.jsonl", "pos")
    assert (tmp_path / "p.jsonl").read_text().splitlines()[1] == '{"ObjectEntities": ["1"], "Relation": "hasArea", "SubjectEntity": "é"}'
    assert files.jsonl(spark, str(tmp_path / "p.jsonl"), PREDICTION).count() == 2
    assert files.hashes(spark, str(tmp_path / "p.jsonl")).first().sha256 == sha
    zsha = files.write_zip(tmp_path / "p.jsonl", tmp_path / "p.zip", "predictions.jsonl")
    assert files.zip_member(spark, str(tmp_path / "p.zip"), "predictions.jsonl", PREDICTION, zsha, 2).count() == 2
    (tmp_path / "bad.jsonl").write_text('{"SubjectEntity": "a"}\n\n[1]\n')
    with pytest.raises(Exception, match="bad JSON"):
        files.strict_jsonl(spark, str(tmp_path / "bad.jsonl"), PREDICTION).collect()
    (tmp_path / "m.json").write_text('{"r": ["a", "b", "c"]}')
    assert files.lists_by_key(spark, str(tmp_path / "m.json"), "string", 2).count() == 2
    files.write_manifest({"b": 1, "a": "é"}, tmp_path / "manifest.json")
    assert json.loads((tmp_path / "manifest.json").read_text()) == {"a": "é", "b": 1}
    assert "| hasArea |" in files.markdown(df.select("Relation").distinct(), "t")


def test_aggregating_samples(spark, relations):
    rows = [
        ("c", "countryLandBordersCountry", ["France", "France"] + ["<think>x"] * 8),
        ("o", "companyTradesAtStockExchange", ["NYSE", "New York Stock Exchange", "None"]),
        ("p", "personHasCityOfDeath", ["Paris"] * 5 + ["None"] * 5),
        ("q", "personHasCityOfDeath", ["Paris"] * 4 + ["None"] * 6),
        ("n", "hasCapacity", ["10000", "10200", "9800", "50000", "60000"]),
    ]
    raw = spark.createDataFrame(rows, "SubjectEntity string, Relation string, raw_samples array<string>")
    got = {r.SubjectEntity: r.ObjectEntities for r in evaluate.aggregate_samples(raw, relations).collect()}
    assert got == {"c": ["France"], "o": ["NYSE"], "p": ["Paris"], "q": [], "n": ["10000"]}
    legacy = {r.SubjectEntity: r.ObjectEntities for r in evaluate.aggregate_samples(raw, relations, "legacy").collect()}
    assert legacy["c"] == [] and legacy["n"] == ["10200"]
    ten = spark.createDataFrame([("a", "hasArea", [str(i) for i in range(1, 11)])], "SubjectEntity string, Relation string, raw_samples array<string>")
    assert evaluate.area_quantile(ten).first().ObjectEntities == ["6"]


def test_running_votes_keep_samples_apart(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", "k", "s1", "a"), ("2024-01-01 00:01:00", "k", "s1", "a"), ("2024-01-01 00:02:00", "k", "s2", "a")]
    spark.createDataFrame(rows, "ts string, key string, sample string, item string").select(F.to_timestamp("ts").alias("ts"), "key", "sample", "item").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, key string, sample string, item string").parquet(str(tmp_path / "in"))
    q = running_votes.running_votes(stream).writeStream.outputMode("update").format("memory").queryName("votes_now").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT max(votes) AS v FROM votes_now").first().v == 2


def test_residual_ridge_is_standardised_and_weighted(spark):
    rng = np.random.default_rng(3)
    x = rng.normal([5, -2, 7], [10, 0.1, 0], (40, 3))
    y, w = x @ [0.5, 4, 1] + rng.normal(size=40), rng.uniform(0.2, 3, 40)
    rows = [(*map(float, r), float(b), float(c)) for r, b, c in zip(x, y, w, strict=True)]
    got, mean, scale = decode.fit_residual_ridge(spark.createDataFrame(rows, "a double, b double, c double, y double, w double"), ["a", "b", "c"], "y", "w")
    v = w * 40 / w.sum()
    m = np.average(x, axis=0, weights=v)
    var = np.average((x - m) ** 2, axis=0, weights=v)
    s = np.where(var > 1e-12, np.sqrt(var), 1.0)
    d = np.column_stack([np.ones(40), (x - m) / s])
    want = np.linalg.solve((d * v[:, None]).T @ d + np.diag([0, 10.0, 10, 10]), d.T @ (v * y))
    assert got == pytest.approx(want, abs=1e-8) and mean == pytest.approx(m) and scale == pytest.approx(s)
    with pytest.raises(ValueError):
        decode.fit_residual_ridge(spark.createDataFrame([(1.0, 1.0, 0.0)], "a double, y double, w double"), ["a"], "y", "w")
