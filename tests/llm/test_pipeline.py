"""The pipeline's stages, each on its own input and all together."""

import corpus_pipeline
from consilium.llm import common, packing
from consilium.llm.token_counts import Encoder

from . import brute
from .test_jaccard_join import shingles

SMALL = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    docs = common.load(spark, SMALL, "documents")
    names = docs.columns
    seen = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, SMALL), "test-stage")
        assert docs.columns == names and docs.schema == common.load(spark, SMALL, "documents").schema
        seen.append(docs.collect())
    raw, good, unique, safe, mixed = seen
    assert all(not brute.base_rules(r.text)[5] for r in good) and {r.doc_id for r in good} <= {r.doc_id for r in raw}
    passing = [r for r in raw if not brute.base_rules(r.text)[5]]
    assert len(good) > 0.75 * len(passing)
    sets = {r.doc_id: shingles(r.text) for r in unique}
    for a in sets:
        for b in sets:
            if a < b:
                both = len(sets[a] & sets[b])
                assert both * 100 < 80 * (len(sets[a]) + len(sets[b]) - both) or not both
    for r in good:
        s = shingles(r.text)
        assert r.doc_id in sets or any(len(s & t) for t in sets.values())
    assert {r.doc_id for r in safe} == set(sets)
    assert all(sum(brute.secrets(r.text)[:3]) == 0 for r in safe)
    clean = {r.doc_id: r.text for r in unique if sum(brute.secrets(r.text)[:3]) == 0}
    assert all(r.text == clean[r.doc_id] for r in safe if r.doc_id in clean)
    whole = {r.doc_id: r.text for r in safe}
    for r in mixed:
        words = r.text.split()
        assert words and len(r.text) == r.n_chars
        assert r.text == whole[r.doc_id] or set(words) <= set(whole[r.doc_id].split())
    target = 1.5 * sum(len(brute.WORD.findall(t)) for t in whole.values())
    assert abs(sum(len(brute.WORD.findall(r.text)) for r in mixed) - target) <= 25
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    tok = Encoder(fast=False)
    assert sum(r.length for r in packed) == sum(len(tok.ids([r.text])[0]) + 1 for r in mixed)
    assert max(r.offset + r.length for r in packed) <= packing.CAPACITY


def test_run_is_all_stages(spark):
    again = corpus_pipeline.run(spark, SMALL)
    assert again.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "copy"]
    assert again.count() > 0


def test_stages_on_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, "a b", "en", None, 3), (1, "a b", "en", None, 3), (2, "w " * 300_000, None, "s", 0), (3, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SMALL).count() >= 0
        assert stage(spark, docs.limit(0), SMALL).count() == 0
    one = corpus_pipeline.near_duplicate_stage(spark, docs, SMALL).collect()
    assert sorted(str(r.doc_id) for r in one) == ["1", "2", "3", "None"]
