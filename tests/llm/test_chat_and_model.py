"""Chat formatting against a plain rendering, and the quality classifier against held-out labels."""

import zlib

import duckdb
import numpy as np
from pyspark.sql import functions as F

from consilium.llm import chat_format, quality_model

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def test_rotation_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS FROM '{SMALL}/conversations.parquet'")
    want = sorted(map(str, con.execute(chat_format.OP1_SQL).fetchall()))
    assert sorted(str(tuple(r)) for r in chat_format.op1_chat_format(spark, SMALL).collect()) == want


ODD_TURNS = [
    (1, 0, "system", "be kind"), (1, 1, "ann lee", "hi <|im_end|> é"), (1, 2, "bob", None), (1, 2, "bob", None), (1, 3, None, "who"), (1, 4, "ann_lee", "me too"), (1, 5, "nobody", "no"), (1, 6, "%nobody", "x"),
    (1, 300, "ann lee", "late"), (1, None, "a<b|c>\td", "first"), (None, None, "x", "y"), (None, 1, "x", "y"), (None, 0, "system", "s"), (2, 0, "system", "alone"), (3, 1, "", ""),
]


def odd_turns(spark):
    return spark.createDataFrame([(*t, "clash", 5) for t in ODD_TURNS], "conv_id long, turn long, role string, text string, speaker string, said int")


def test_masks_cover_the_assistant_alone(spark):
    got = chat_format.rotate(odd_turns(spark)).collect()
    names = {(r.conv_id, r.perspective) for r in got}
    # different roles stay apart, also those that a name alone could not tell
    assert names == {(1, n) for n in ("ann_lee", "ann%5Flee", "bob", "%nobody", "nobody", "%25nobody", "a%3Cb%7Cc%3E%09d")} | {(None, "x"), (3, "")}
    assert len(got) == 10 and sum(r.conv_id is None for r in got) == 2
    for r in got:
        assert len(r.mask.split(",")) == r.n_masked
        for span in r.mask.split(","):
            start, end = map(int, span.split(":"))
            assert r.rendered[:start].endswith("<|im_start|>assistant\n") and r.rendered[start:end].endswith("<|im_end|>")
        assert r.rendered.count("<|im_start|>") == r.rendered.count("<|im_end|>") == r.n_turns
    by = {r.perspective: r for r in got if r.conv_id == 1}
    assert {r.n_turns for r in by.values()} == {10}
    assert {n: r.n_masked for n, r in by.items()} == {"ann_lee": 2, "ann%5Flee": 1, "bob": 2, "%nobody": 1, "nobody": 1, "%25nobody": 1, "a%3Cb%7Cc%3E%09d": 1}
    assert by["bob"].rendered.startswith("<|im_start|>user name=a%3Cb%7Cc%3E%09d\nfirst<|im_end|>\n<|im_start|>system\nbe kind")
    assert chat_format.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_odd_dialogues_equal_sql(spark, tmp_path):
    odd_turns(spark).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = sorted(map(str, con.execute(chat_format.OP1_SQL).fetchall()))
    assert sorted(str(tuple(r)) for r in chat_format.op1_chat_format(spark, str(tmp_path)).collect()) == want


def test_a_turn_said_thousands_of_times(spark):
    docs = spark.range(5000).selectExpr("1L AS conv_id", "7L AS turn", "if(id % 2 = 0, 'a', 'b') AS role", "'w' AS text")
    got = chat_format.rotate(docs).collect()
    assert [(r.n_turns, r.n_masked) for r in got] == [(5000, 2500)] * 2
    long = chat_format.rotate(spark.createDataFrame([(1, 1, "a", "é" * 3_000_000)], "conv_id long, turn long, role string, text string")).first()
    assert long.mask == f"22:{22 + 3_000_000 + 10}"


def test_long_dialogues_stay_whole(spark, tmp_path):
    turns = [(1, 0, "system", "be kind")] + [(1, i, "ann" if i % 2 else "bob", f"t{i}") for i in range(1, 700)] + [(1, 700, "eve", "late")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.perspective: r for r in chat_format.op1_chat_format(spark, str(tmp_path)).collect()}
    assert set(got) == {"ann", "bob", "eve"}
    for who, r in got.items():
        heads = {"system": "system", who: "assistant"}
        assert r.rendered == "".join(f"<|im_start|>{heads.get(role, 'user name=' + role)}\n{text}<|im_end|>\n" for _, _, role, text in turns)
        spans = [tuple(map(int, s.split(":"))) for s in r.mask.split(",")]
        assert [r.rendered[a:b] for a, b in spans] == [text + "<|im_end|>" for _, _, role, text in turns if role == who]
        assert (r.n_turns, r.n_masked) == (701, len(spans))


def test_held_out_accuracy(spark):
    rows = quality_model.op8_quality_classifier(spark, MIDDLE).join(spark.read.parquet(f"{MIDDLE}/labels.parquet"), "doc_id").collect()
    out = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.predicted == r.quality for r in out]) > 0.93


def test_labels_lang_and_source_do_not_touch_a_score(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    a = {r.doc_id: r.score for r in quality_model.score_documents(docs, labels).collect()}
    turned = labels.withColumn("quality", F.when(quality_model.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    b = {r.doc_id: r.score for r in quality_model.score_documents(docs.withColumn("lang", F.lit("zz")).withColumn("score", F.lit(1)), turned).collect()}
    assert a == b


def test_odd_rows_and_missing_labels(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, None), (1, ""), (2, "x" * 50_000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality_model.score_documents(docs, none).collect()
    assert len(rows) == 4 and {r.score for r in rows} == {0.5}
    assert quality_model.score_documents(docs.limit(0), none).count() == 0


def test_training_rows_are_bounded_and_one_a_document(spark):
    table = spark.range(4000).selectExpr("id AS doc_id", "array(cast(id AS double)) AS x").unionByName(spark.createDataFrame([(7, [0.5]), (None, [1.0])], "doc_id long, x array<double>"))
    labels = spark.range(4000).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS quality").unionByName(spark.createDataFrame([(7, 0), (8, 1), (9, None), (None, 1)], "doc_id long, quality int"))
    every = quality_model.training_rows(table, labels).collect()
    assert len(every) == len({r.doc_id for r in every}) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(4000))
    by = {r.doc_id: r for r in every}
    assert all(zlib.crc32(str(i).encode()) % 5 for i in by) and (by[7].x, by[7].quality) == ([0.5], 1) and by[8].quality == 1
    few = quality_model.training_rows(table, labels, 1000).collect()
    assert 700 < len(few) <= 1000 and {r.doc_id for r in few} < set(by)
    assert sorted(r.doc_id for r in quality_model.training_rows(table.repartition(3), labels, 1000).collect()) == sorted(r.doc_id for r in few)


def test_tables_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, len(quality_model.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_model.fit(x, y)
    assert (0, 1) in model.pairs
    assert np.mean((model.scores(x) > 0.5) == y) > 0.9
