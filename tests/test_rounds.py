from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import index, retrieval, simulate
from tidemark.plans import dialogue_queries

PRODUCT = "parent_asin string, title string, features array<string>, description array<string>, price double, categories array<string>, details map<string,string>, average_rating double, rating_number bigint, store string"


def test_sessions_have_ten_rounds(spark, monkeypatch):
    rows = [(f"P{i:03d}", "Zorblat", [], [], None, [], {}, 4.0, 10, "Shop") for i in range(110)]
    feedback = spark.createDataFrame([("late", 1, "P093", "x", None, datetime(2024, 1, 1)), ("never", 1, "P105", "x", None, datetime(2024, 1, 1))], "session_id string, turn int, parent_asin string, reason string, note string, updated_at timestamp")
    monkeypatch.setattr(dialogue_queries, "table", lambda *_: feedback)
    monkeypatch.setattr(dialogue_queries, "index", lambda *_: index.of_products(spark.createDataFrame(rows, PRODUCT)))
    got = {r.session_id: (r.hit, r.first_hit_turn, r.best_rank) for r in dialogue_queries.simulate_sessions(spark, "").collect()}
    assert got == {"late": (True, 10, 4), "never": (False, None, None)}


def test_each_target_is_run_once_in_any_parts(spark):
    """As round by round with all products, in one part or several; sessions of one target are one query."""
    words = ["red", "blue", "soft", "warm", "light", "long"]
    rows = [(f"P{i:03d}", f"Item {words[i % 6]} {words[i % 5]}", [f"{words[i % 4]} {words[i % 3]}", words[i * 7 % 6]], [], None, [], {"Size": words[i % 2]}, i * 13 % 7 / 2, i * 5 % 11, "Shop") for i in range(90)]
    shop = index.of_products(spark.createDataFrame(rows, PRODUCT))
    labels = spark.createDataFrame([(f"s{i}", f"P{i // 2:03d}") for i in range(180)], "session_id string, target string")
    queries = []
    with pytest.MonkeyPatch.context() as patch:
        plain = retrieval.by_part
        patch.setattr(retrieval, "by_part", lambda each, *rest: queries.append(each.count()) or plain(each, *rest))
        got = [{r.session_id: (r.hit, r.first_hit_turn, r.best_rank) for r in simulate.run(labels, shop, 4, 3, part).collect()} for part in (1000, 40)]
    assert queries == [90, 90]
    cards = {r.parent_asin: r.card for r in simulate.intent_cards(shop.products).collect()}
    order = [r.parent_asin for r in shop.products.orderBy(F.round("quality", 9).desc(), "parent_asin").collect()]
    weights = {}
    for r in shop.terms.collect():
        weights.setdefault(r.parent_asin, {})[r.term] = r.weight
    want = {}
    for i in range(180):
        target, shown = f"P{i // 2:03d}", set()
        want[f"s{i}"] = (False, None, None)
        for n in range(1, 5):
            said = dict.fromkeys(" ".join(cards[target][:n]).lower().replace(":", " ").split())
            scores = {p: sum(weights[p].get(t, 0) for t in said) for p in order}
            page = [p for p in sorted(order, key=lambda p: -scores[p]) if scores[p] and p not in shown][:3]
            shown.update(page)
            if target in page:
                want[f"s{i}"] = (True, n, page.index(target) + 1)
                break
    assert got == [want, want] and len({w[1] for w in want.values()}) > 2
