from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions import messages
from tidemark.operators import catalog as cat
from tidemark.operators import index, ledger, parsing, respond, simulate

PRODUCT = "parent_asin string, title string, features array<string>, description array<string>, price double, categories array<string>, details map<string,string>, average_rating double, rating_number bigint, store string"
ROWS = [
    ("DRESS1", "Red Cotton Summer Dress", ["Lightweight"], [], 39.99, ["Clothing", "Women", "Dresses"], {"Material": "Cotton"}, 4.6, 1200, "Sunny"),
    ("SHOE1", "Blue Mesh Running Shoes", ["Breathable"], [], 79.99, ["Clothing", "Shoes", "Athletic"], {"Material": "Mesh"}, 4.8, 3400, "Swift"),
    ("BELT1", "Black Leather Work Belt", [], [], 49.5, ["Accessories", "Belts"], {"Material": "Leather"}, 4.3, 800, "Rugged"),
    ("JACKET1", "White Waterproof Winter Jacket", ["Insulated"], [], 129.0, ["Clothing", "Jackets"], {"Material": "Nylon"}, 4.7, 2100, "Alpine"),
]
T = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def products(spark):
    return spark.createDataFrame(ROWS, PRODUCT).cache()


@pytest.fixture(scope="module")
def words(products):
    return parsing.vocabulary(cat.postings(cat.attributes(products))).cache()


def one(spark, column, message):
    return spark.createDataFrame([(message,)], "m string").select(column(F.col("m")).alias("x")).first().x


def test_quality_and_order(products, rows):
    got = {r.parent_asin: round(r.quality, 6) for r in cat.with_quality(products).collect()}
    assert got == {"DRESS1": 0.905598, "SHOE1": 0.972, "BELT1": 0.848655, "JACKET1": 0.940231}
    assert [r.parent_asin for r in cat.popular(products, 3).collect()] == ["SHOE1", "JACKET1", "DRESS1"]


@pytest.mark.parametrize(("message", "wanted"), [
    ("under $80", [("lte", "80.00", None)]), ("from 50 to 80", [("between", "50.00", "80.00")]), ("from 50", [("gte", "50.00", None)]), ("over 20 and under $50", [("gte", "20.00", None), ("lte", "50.00", None)]),
    ("budget around 45.5", [("lte", "45.50", None)]), ("between $10 and $20, at most 15", [("between", "10.00", "20.00"), ("lte", "15.00", None)]), ("size 50", []), ("", []), (None, []),
])
def test_budgets(spark, message, wanted):
    assert [tuple(b) for b in one(spark, messages.budgets, message)] == wanted


@pytest.mark.parametrize(("message", "flag", "wanted"), [
    ("Actually, show me boots", "is_override", True), ("I've changed my mind", "replaces_preferences", True), ("show me more", "is_continuation", True), ("I don't have a preference for color", "no_preference", True), ("no preference", "no_preference", True),
    ("I'm just browsing", "route_hint", "browsing"), ("I need shoes", "route_hint", "buying"), ("blue", "route_hint", None), (None, "is_override", False),
])
def test_flags(spark, message, flag, wanted):
    assert one(spark, lambda m: messages.flags(m)[flag], message) == wanted


@pytest.mark.parametrize(("message", "wanted"), [("Actually, ignore my earlier preference. What I need is: mesh shoes.", "mesh shoes"), ("Ignore my earlier preferences. Wool socks", "wool socks"), ("x", None), (None, None)])
def test_override_payload(spark, message, wanted):
    assert one(spark, messages.override_payload, message) == wanted


def stated(spark, words, message):
    df = spark.createDataFrame([(1, message)], "message_id bigint, message string")
    return {(r.attribute, r.operator, r.alternatives or r.value) for r in parsing.constraints(df, words).collect()}


@pytest.mark.parametrize(("message", "wanted"), [
    ("I need a red cotton dress", {("color", "eq", "red"), ("material", "eq", "cotton"), ("category", "eq", "dresses")}), ("red or blue", {("color", "in", "red|blue")}), ("without leather", {("material", "not_in", "leather")}),
    ("shoes by Swift under $80", {("brand", "eq", "swift"), ("budget", "lte", "80.00")}), ("swift delivery", set()), ("show me more red", set()), ("casual", {("style", "eq", "casual"), ("use_case", "eq", "casual")}), ("grey please", {("color", "eq", "gray")}),
])
def test_constraints(spark, words, message, wanted):
    got = stated(spark, words, message)
    assert got == wanted or {g for g in got if g[0] != "category"} == {w for w in wanted if w[0] != "category"}


def turns(spark, *dialogues):
    data = [(f"s{i}", n, m, T + timedelta(minutes=n)) for i, d in enumerate(dialogues) for n, m in enumerate(d, 1)]
    return spark.createDataFrame(data, "session_id string, turn int, user_message string, updated_at timestamp")


def test_ledger(spark, words):
    df = turns(spark, ["I need a red cotton dress", "Actually, ignore red cotton dresses. What I need is blue mesh running shoes.", "under $90"], ["cotton", "I'm flexible, no preference for material", "cotton or wool", "wool"])
    got = {(r.session_id, r.turn): r for r in ledger.fold(ledger.parsed_turns(df.unionByName(df), words)).collect()}
    second = got["s0", 2]
    assert "red" not in second.active and "blue" in second.active and "mesh" in second.active and second.override_scope in ("goal", "attribute")
    assert "budget lte 90.00" in got["s0", 3].active and "blue" in got["s0", 3].active
    assert got["s1", 1].active == "material eq cotton" and got["s1", 2].active == "" and got["s1", 3].active == "material in cotton|wool" and got["s1", 4].active == "material eq wool"


def test_profile_is_soft_and_survives(spark, words):
    df = turns(spark, ["red", "Actually, ignore my earlier preferences. What I need is a dress."])
    profiles = spark.createDataFrame([("s0", ["Long Walks", " ", "long walks"]), ("other", ["x"])], "session_id string, tags array<string>")
    got = {r.turn: r for r in ledger.fold(ledger.parsed_turns(df, words), profiles).collect()}
    assert "feature eq long walks" in got[1].active and "color eq red" in got[1].active
    assert "feature eq long walks" in got[2].active and "red" not in got[2].active and "long walks" not in got[2].constraints


def test_repeated_turn_changes_nothing():
    turn = {"turn": 1, "message": "red", "is_override": False, "replaces_preferences": False, "no_preference": False, "mentioned": None, "route_hint": None, "constraints": [{"attribute": "color", "operator": "eq", "value": "red", "upper_value": None, "alternatives": ""}]}
    once = ledger.step(ledger.start(), turn)
    before = str(once)
    assert str(ledger.step(once, turn)) == before


def test_dialogues(spark, products):
    got = respond.respond(turns(spark, ["I'm looking for running shoes. A key requirement is: under $80."], ["I need a red cotton dress", "Actually, ignore red cotton dresses. What I need is blue mesh running shoes."], ["I'm still exploring shoes.", "cotton"]), index.of_products(products)).collect()
    first = {(r.session_id, r.turn): r for r in got if r.rank == 1}
    assert first["s0", 1].parent_asin == "SHOE1" and not first["s0", 1].relaxed
    assert first["s1", 1].parent_asin == "DRESS1" and first["s1", 2].parent_asin == "SHOE1"
    assert first["s2", 1].route == first["s2", 2].route == "browsing"
    by_turn = {}
    for r in got:
        by_turn.setdefault((r.session_id, r.turn), []).append((r.rank, r.relaxed, r.parent_asin))
    for shown in by_turn.values():
        shown.sort()
        assert [s[1] for s in shown] == sorted(s[1] for s in shown) and len({s[2] for s in shown}) == len(shown) <= 10


def test_simulation_finds_every_target(spark, products):
    labels = spark.createDataFrame([(f"s{i}", r[0]) for i, r in enumerate(ROWS)], "session_id string, target string")
    got = simulate.run(labels, index.of_products(products), rounds=2, k=2).collect()
    assert all(r.hit and r.first_hit_turn in (1, 2) for r in got) and len(got) == 4


def test_free_answers_fill_the_question_before(spark, words):
    rows = [("s", 1, "red", '{"ask_attribute": "use_case"}', T), ("s", 2, "for that, what matters is: long hikes", '{"ask_attribute": "style"}', T), ("s", 3, "blue", '{"ask_attribute": "material"}', T), ("s", 4, "something soft", None, T), ("s", 5, "something odd", None, T)]
    df = spark.createDataFrame(rows, "session_id string, turn int, user_message string, response_json string, updated_at timestamp")
    got = {r.turn: r for r in ledger.fold(ledger.parsed_turns(df, words)).collect()}
    assert "use_case eq long hikes" in got[2].active and "long hikes" not in got[2].constraints
    # a value of the vocabulary answers nothing else; materials aren't answered in free words; nothing was asked before 5
    assert "style" not in got[3].active and "color eq blue" in got[3].active
    assert "soft" not in got[4].active and "odd" not in got[5].active and "long hikes" in got[5].active
    asked = [(1, "just do it", "style"), (2, "sneakers", "category"), (3, "sneakers", "style"), (4, "under $50", "size"), (5, "I don't have a preference", "style"), (6, None, "style"), (7, "wide ones", "size")]
    free = {r.message_id: r.value for r in parsing.pending(spark.createDataFrame(asked, "message_id bigint, message string, expected string"), words).collect()}
    assert free == {3: "sneakers", 7: "wide ones"}
