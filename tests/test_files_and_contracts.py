"""Manifests, frozen bundles, bound responses, snapshots and partitioned sinks."""

import json
import random

import pytest
from pyspark.sql import functions as F

from consilium.operators import contracts, graph, metrics, votes
from consilium.operators.relational import ContractError
from consilium.schemas import PREDICTION, RESPONSE
from consilium.sources import files


def test_manifests_name_every_difference(tmp_path):
    (tmp_path / "a").write_text("x")
    sha = contracts.file_sha256(tmp_path / "a")
    assert contracts.manifest_problems({"rows": 3, "a_sha256": sha}, {"rows": 3}, {"a_sha256": tmp_path / "a"}) == []
    wrong = contracts.manifest_problems({"rows": 3}, {"rows": 4, "split": "test"}, {"a_sha256": tmp_path / "a", "b_sha256": tmp_path / "none"})
    # a file that is not there has no hash, and a manifest without one agrees
    assert len(wrong) == 3 and wrong[0].startswith("rows:") and wrong[1].startswith("split:") and wrong[2].startswith("a_sha256:")


def test_budgets_and_blind_splits():
    agents = [{"agent_id": "x", "checkpoint": "c", "parameters": 5}, {"agent_id": "x", "checkpoint": "d", "parameters": 6}]
    assert contracts.budget_problems(agents, 10) == ["duplicate agent x", "11 parameters exceed 10"]
    contracts.refuse_blind({"has_gold": True})
    for split in ({"has_gold": False}, {"has_gold": True, "blind": True}, {}):
        with pytest.raises(ContractError, match="blind"):
            contracts.refuse_blind(split)


def test_bundles_are_reused_only_when_whole(tmp_path):
    (tmp_path / "p.jsonl").write_text("{}\n")
    manifest = {"policy": "v1", "p.jsonl_sha256": contracts.file_sha256(tmp_path / "p.jsonl")}
    assert not contracts.reusable(tmp_path, {"policy": "v1"}, ["p.jsonl"])
    files.write_manifest(manifest, tmp_path / "manifest.json")
    assert contracts.reusable(tmp_path, {"policy": "v1"}, ["p.jsonl"])
    assert not contracts.reusable(tmp_path, {"policy": "v2"}, ["p.jsonl"])
    assert not contracts.reusable(tmp_path, {"policy": "v1"}, ["p.jsonl", "q.jsonl"])
    (tmp_path / "p.jsonl").write_text("{ }\n")
    assert not contracts.reusable(tmp_path, {"policy": "v1"}, ["p.jsonl"])


def test_a_freeze_pins_inputs_and_stages(tmp_path):
    (tmp_path / "in").write_text("x")
    value = contracts.freeze({"in": tmp_path / "in"}, ["b", "a"], tmp_path / "policy.json")
    assert json.loads((tmp_path / "policy.json").read_text()) == value == {"inputs": {"in": contracts.file_sha256(tmp_path / "in")}, "stages": ["b", "a"]}
    contracts.require_hash(tmp_path / "in", value["inputs"]["in"], "s")
    (tmp_path / "in").write_text("y")
    with pytest.raises(ContractError, match="s: reconstruction drift"):
        contracts.require_hash(tmp_path / "in", value["inputs"]["in"], "s")
    assert contracts.inside(tmp_path, "a/b") == tmp_path / "a" / "b"
    for path in ("/etc/x", "a/../../x"):
        with pytest.raises(ContractError, match="leaves its root"):
            contracts.inside(tmp_path, path)


def test_responses_are_bound_to_their_manifest(spark, tmp_path):
    path = tmp_path / "r.jsonl"
    path.write_text('{"task_id": "t1", "agent_id": "a"}\n\n{"task_id": "t2", "agent_id": "a"}\n')
    good = {"agent_id": "a", "responses_sha256": contracts.file_sha256(path), "tasks": 2}
    assert sorted(r.task_id for r in files.responses(spark, str(path), good, "a", RESPONSE).collect()) == ["t1", "t2"]
    for bad, match in ((good | {"agent_id": "b"}, "not the responses"), (good | {"responses_sha256": "0"}, "not the responses"), (good | {"tasks": 3}, "not 3 tasks")):
        with pytest.raises(ContractError, match=match):
            files.responses(spark, str(path), bad, "a", RESPONSE)


def test_snapshots_share_their_keys(spark, tmp_path):
    row = lambda s: json.dumps({"SubjectEntity": s, "Relation": "r", "ObjectEntities": []}) + "\n"
    for name, subjects in (("a", "xy"), ("b", "yx"), ("c", "xz")):
        (tmp_path / name).write_text("".join(map(row, subjects)))
    pin = lambda n, rows=2: (str(tmp_path / n), contracts.file_sha256(tmp_path / n), rows)
    keys = ("SubjectEntity", "Relation")
    assert {k: v.count() for k, v in files.snapshot(spark, {"a": pin("a"), "b": pin("b")}, PREDICTION, keys).items()} == {"a": 2, "b": 2}
    for artifacts, match in (({"a": pin("a"), "c": pin("c")}, "keys differ"), ({"a": pin("a", 3)}, "not 3 rows"), ({"a": (str(tmp_path / "a"), "0", 2)}, "hash differs")):
        with pytest.raises(ContractError, match=match):
            files.snapshot(spark, artifacts, PREDICTION, keys)


def test_documents_templates_and_task_files(spark, tmp_path):
    (tmp_path / "d.json").write_text('{\n "a": 1,\n "b": "x"\n}\n')
    assert tuple(files.json_document(spark, str(tmp_path / "d.json"), "a int, b string").first()) == (1, "x")
    (tmp_path / "t.csv").write_text('Relation,PromptTemplate\nr,"Where, {subject_entity}?"\n')
    assert tuple(files.templates(spark, str(tmp_path / "t.csv")).first()) == ("r", "Where, {subject_entity}?")
    tasks = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "agent_id string, n int")
    assert files.write_tasks(tasks, str(tmp_path / "tasks")) == {"a": 2, "b": 1}
    assert spark.read.json(str(tmp_path / "tasks" / "agent_id=a")).count() == 2


def test_summaries_of_empty_and_single_keys(spark):
    nothing = spark.createDataFrame([], "k string, s int, p int, item string")
    assert votes.vote_table(nothing, ["k"], "item", "s", "p").count() == 0
    assert votes.plurality(votes.vote_table(nothing, ["k"], "item", "s", "p"), ["k"]).count() == 0
    edges = spark.createDataFrame([], "k string, pred int, gold int")
    assert metrics.oracle_bound(edges, ["k"]).count() == 0
    one = spark.createDataFrame([("k", 0), ("k", 1)], "k string, idx int")
    links = spark.createDataFrame([], "k string, left int, right int, blocked boolean")
    assert sorted((r.idx, r.component) for r in graph.string_components(one, links, ["k"]).collect()) == [(0, 0), (1, 1)]
    lookup = graph.by_id(one.withColumn("v", F.concat(F.lit("c"), F.col("idx").cast("string"))), ["k"], "candidate", "idx", "v").first().lookup
    assert lookup == {"candidate:0": "c0", "candidate:1": "c1"}


def test_components_of_chains_stars_and_keys(spark):
    rng = random.Random(3)
    ids = rng.sample(range(10_000), 600)
    chain, star = ids[:300], ids[300:500]
    links = [("a", x, y) for x, y in zip(chain, chain[1:])] + [("a", star[0], x) for x in star[1:]] + [("b", ids[0], ids[450]), ("b", ids[450], ids[450])]
    nodes = [(k, i) for k in "ab" for i in ids]
    got = graph.string_components(spark.createDataFrame(nodes, "k string, idx int"), spark.createDataFrame([(*x, False) for x in links] + [("a", chain[0], star[0], True)], "k string, left int, right int, blocked boolean"), ["k"])
    want = {("a", i): min(chain) if i in chain else min(star) if i in star else i for i in ids} | {("b", i): i for i in ids}
    want[("b", ids[0])] = want[("b", ids[450])] = min(ids[0], ids[450])
    found = {(r.k, r.idx): r.component for r in got.collect()}
    assert found == want and got.count() == len(nodes)
