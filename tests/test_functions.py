"""Column functions against golden vectors and plain Python."""

import math
import random
import statistics
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from consilium.functions import numbers, parse, text
from consilium.plans.registry import QUERIES


def one(spark, column, **values):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in values.items())
    return spark.createDataFrame([tuple(v for _, v in values.values())], schema).select(column.alias("x")).first().x


def s(spark, f, value):
    return one(spark, f(F.col("t")), t=("string", value))


@pytest.mark.parametrize("raw, form", [("Kaua'i", "kauai"), ("O’Brien", "obrien"), ("Straße™", "strassetm"), ("72.9", "72 9"), ("-5", "5"), ("Canal+", "canal"), ("  A -- b ", "a b"), ("ÉÎ", "ei"), ("", "")])
def test_normal_forms(spark, raw, form):
    assert s(spark, text.normalize, raw) == form


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=30))
def test_normal_form_is_stable(value):
    form = text.normalized(value)
    assert form == " ".join(form.split())
    assert not any(unicodedata.category(c).startswith("P") or unicodedata.combining(c) for c in form)


@pytest.mark.parametrize("form, key", [("nyse", "new york stock exchange"), ("u k", "united kingdom"), ("paris", "paris")])
def test_synonyms(spark, form, key):
    assert s(spark, text.synonym, form) == key


def test_typed_keys(spark):
    f = lambda n: one(spark, text.canonical_key(F.lit("x"), F.col("n"), F.lit(True)), n=("double", n))
    assert [f(72.9), f(100.0), f(-1.0), f(0.0)] == ["numeric:72.9", "numeric:100", "", ""]


@pytest.mark.parametrize("raw, protocol, want", [
    ("<think>Person died in Paris.", "legacy-cot", ("", "unclosed-think")),
    ("<think>x</think> Paris.", "legacy-cot", ("Paris", "valid")),
    ("New York City\nEVIDENCE: A short fact.", "answer-first", ("New York City", "valid")),
    ("ANSWER: None\nEVIDENCE: Still living.", "answer-first", ("None", "explicit-none")),
    ("", "answer-first", ("", "empty")),
    ("N/A", "legacy-cot", ("N/A", "explicit-none")),
])
def test_answer_status(spark, raw, protocol, want):
    got = s(spark, lambda t: parse.answer_status(t, protocol), raw)
    assert (got.answer, got.status) == want


@pytest.mark.parametrize("raw, want", [("France, Spain; and Italy.", ["France", "Spain", "Italy"]), ("Guy L. Steele, Jr., Ann", ["Guy L. Steele, Jr", "Ann"]), ("none", []), ("A\nB", ["A"]), ("Bosnia and Herzegovina", ["Bosnia and Herzegovina"])])
def test_items(spark, raw, want):
    assert s(spark, lambda t: parse.items(t, F.lit(False)), raw) == want


def test_barred_items_keep_commas(spark):
    got = s(spark, lambda t: parse.answer_items(t, F.lit(False), "answer-first"), "Woman, Life, Freedom movement || Guy L. Steele, Jr.")
    assert got == ["Woman, Life, Freedom movement", "Guy L. Steele, Jr"]


def test_numbers_in_answers(spark):
    assert s(spark, lambda t: parse.items(t, F.lit(True)), "about 1,234.5 km") == ["1,234.5"]
    assert s(spark, lambda t: parse.items(t, F.lit(True)), "many") == []


@pytest.mark.parametrize("raw, want", [
    ("ANSWER: ANSWER: None", ("explicit_none", [])),
    ("ANSWER: N/A", ("parsed_nonempty", ["n/a"])),
    ("no label", ("missing_answer_field", [])),
    ("ANSWER: a\nANSWER: b", ("conflicting_answer_fields", [])),
    ("ANSWER: Nasdaq; Nasdaq\nlater prose", ("parsed_nonempty", ["Nasdaq", "Nasdaq"])),
    ("ANSWER: ANSWER: Moscow Exchange", ("parsed_nonempty", ["Moscow Exchange"])),
])
def test_proposals(spark, raw, want):
    got = s(spark, lambda t: parse.proposal(t, F.lit(False)), raw)
    if raw == "ANSWER: N/A":
        # a null text to the item parser, but no null key after normalisation
        assert (got.status, got["items"]) == ("unparseable_answer_field", [])
    else:
        assert (got.status, got["items"]) == want


@pytest.mark.parametrize("raw, relation, kind, items", [
    ("None", "awardWonBy", "explicit-abstention", []),
    ("<think>x", "awardWonBy", "invalid", []),
    ("", "awardWonBy", "invalid", []),
    ("The company is listed on the Dubai Financial Market.", "companyTradesAtStockExchange", "entity", ["Dubai Financial Market"]),
    ("NYSE, Nasdaq", "companyTradesAtStockExchange", "entity", ["NYSE", "Nasdaq"]),
])
def test_samples(spark, raw, relation, kind, items):
    got = s(spark, lambda t: parse.classify(t, F.lit(relation), F.lit(False)), raw)
    assert (got.kind, got["items"]) == (kind, items)


def test_claims(spark):
    got = lambda t, r: s(spark, lambda c: text.claims(c, F.lit(r)), t)
    assert got("<think>Shares are traded; formerly listed on X</think>", "companyTradesAtStockExchange") == ["listing_historical"]
    assert got("<think>about 5 sq km</think>", "hasArea") == ["area_km2_unit"]
    assert got("REASONING: maritime border only ANSWER: land border", "countryLandBordersCountry") == ["border_maritime_only"]


@pytest.mark.parametrize("raw, want", [("1,234", 1234.0), ("1_000", 1000.0), ("inf", math.inf), ("1d", None), ("x", None), (" 2.5e3 ", 2500.0), (".5", 0.5)])
def test_number_grammar(spark, raw, want):
    assert s(spark, numbers.parse_number, raw) == want


def test_five_tolerances_differ(spark):
    a, b = F.col("a"), F.col("b")
    at = lambda f, x, y: one(spark, f(a, b), a=("double", x), b=("double", y))
    assert at(numbers.within_gold, 105.0, 100.0) and not at(numbers.within_gold, 105.1, 100.0)
    assert not at(numbers.within_gold, 0.0, 0.0) and at(numbers.within_gold, 50.0, -1.0)
    assert at(numbers.within_larger, 95.0, 100.0) and at(numbers.within_larger, 0.0, 0.0)
    assert not at(numbers.within_right, -1.0, -1.0)
    assert at(numbers.within_product, 95.0, 100.0) and at(numbers.within_target, 105.0, 100.0)


def array(spark, f, values):
    return one(spark, f(F.col("v")), v=("array<double>", [float(x) for x in values]))


def test_index_quantile(spark):
    assert array(spark, lambda v: numbers.index_quantile(v, 0.55), range(1, 11)) == 6
    assert array(spark, lambda v: numbers.index_quantile(v, 0.5), range(1, 11)) == 6
    with pytest.raises(ValueError, match="out of range"):
        numbers.index_quantile(F.col("v"), 1.1)


def test_densest_cluster_in_any_order(spark):
    assert array(spark, lambda v: numbers.densest_cluster(v, 0.2), [10000, 10200, 9800, 50000, 60000]).value == 10000
    values = [100, 104, 97, 300, 305, 310, 290, 100, 900, 901]
    found = {array(spark, lambda v: numbers.densest_cluster(v, 0.3), random.Random(k).sample(values, len(values))) for k in range(5)}
    assert len(found) == 1
    assert array(spark, lambda v: numbers.densest_cluster(v, 0.1), [900, 900, 100, 100]).value == 100


def test_densest_cluster_of_odd_values(spark):
    cluster = lambda *v: array(spark, lambda x: numbers.densest_cluster(x, 0.3), v)
    assert tuple(cluster(0, 20, 21, 0, 0)) == (20.5, 2, 20.0)
    assert tuple(cluster(-5, -5, float("nan"), float("inf"), 7)) == (7.0, 1, 7.0)
    assert cluster(0, 0) is None and cluster() is None
    # two pairs as far apart but for the last digits of their logarithms
    for low, high in ((10, 12), (11, 13), (49, 50), (3, 3.7)):
        assert all(cluster(low, high, low * k, high * k).center == low for k in (3, 7, 10, 1.9))


def test_days_without_a_value_above_zero_have_no_cluster(spark, tmp_path):
    spark.sql("SELECT col1 AS event_id, timestamp_ntz '2024-01-01 10:00:00' AS ts, col2 AS user_id, 'view' AS event_type, cast(col3 AS double) AS value FROM VALUES (1L, 1L, 0), (2L, 1L, 8), (3L, 2L, 0), (4L, 3L, 5)").write.parquet(f"file://{tmp_path}/events.parquet")
    got = QUERIES["small_densest_cluster"](spark, f"file://{tmp_path}").orderBy("user_id").collect()
    assert [(r.user_id, r.value, r.size) for r in got] == [(1, 8.0, 1), (3, 5.0, 1)]


def test_anchored_groups_do_not_chain(spark):
    assert array(spark, numbers.anchored_groups, [108, 100, 104, 103, 106]) == [[100, 103, 104], [106, 108]]
    assert array(spark, numbers.median, [3, 1, 2, 10]) == statistics.median([3, 1, 2, 10])
    assert array(spark, numbers.log_medoid, [100, 10, 100, 1000]) == 100


def test_scores(spark):
    x = spark.createDataFrame([([1.0, 2.0], [0.5, -1.0], {"a": 1.0, "b": 1.0})], "x array<double>, w array<double>, m map<string,double>")
    r = x.select(numbers.sigmoid(numbers.dot(F.col("x"), F.col("w"))).alias("p"), numbers.softmax(F.col("m")).alias("s"), numbers.set_f1(F.array(F.lit("a")), F.array(F.lit("a"), F.lit("b"))).alias("f")).first()
    assert r.p == pytest.approx(1 / (1 + math.exp(1.5))) and r.s == {"a": 0.5, "b": 0.5} and r.f == pytest.approx(2 / 3)


def test_numbers_as_text(spark):
    df = spark.createDataFrame([(100.0,), (2.5,), (1e10,), (0.1 + 0.2,)], "v double")
    assert [r.x for r in df.select(text.shortest_number("v").alias("x")).collect()] == ["100", "2.5", "10000000000", "0.30000000000000004"]
    assert [r.x for r in df.select(text.number_12g("v").alias("x")).collect()] == ["100", "2.5", "10000000000", "0.3"]


def test_spellings(spark):
    assert s(spark, text.acronym, "N.Y.S.E.") == "nyse" and s(spark, text.acronym, "Nyse") is None
    assert s(spark, text.initials, "Bank of the New York") == "bny"
    assert s(spark, text.without_parenthesis, "Foo (bar)") == "Foo"


def test_seed_does_not_depend_on_the_row(spark):
    import hashlib

    want = int.from_bytes(hashlib.sha256("45\x1fa\x1fb".encode()).digest()[:8], "big")
    assert int(one(spark, text.stable_seed(F.lit(45), F.col("a"), F.lit("b")), a=("string", "a"))) == want
