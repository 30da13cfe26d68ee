import random
from datetime import datetime

from tidemark.operators import index, respond, retrieval

PRODUCT = "parent_asin string, title string, features array<string>, description array<string>, price double, categories array<string>, details map<string,string>, average_rating double, rating_number bigint, store string"


def test_common_words_search(spark):
    rows = [(f"P{i:04d}", "Plain Zorblat", [], [], 10.0, ["Things"], {}, 4.0, 10, "Shop") for i in range(1100)]
    turns = spark.createDataFrame([("s", 1, "zorblat", datetime(2024, 1, 1))], "session_id string, turn int, user_message string, updated_at timestamp")
    got = respond.respond(turns, index.of_products(spark.createDataFrame(rows, PRODUCT).repartition(4))).collect()
    assert sorted((r.rank, r.parent_asin) for r in got) == [(i + 1, f"P{i:04d}") for i in range(10)]


def test_mask_top_against_brute_force(spark):
    rng = random.Random(3)
    fields = {(f"P{i:05d}", t): rng.choice([1.0, 2.5, 6.0, 10.5]) for i in range(6000) for t in "abcdef" if rng.random() < {"a": 0.9, "b": 0.3, "c": 0.01}.get(t, 0.002)}
    quality = {f"P{i:05d}": rng.choice([0.1, 0.5, 0.9]) for i in range(6000)}
    asked = {q: rng.sample("abcdefg", rng.randint(1, 5)) for q in range(20)} | {99: ["g"]}
    terms = spark.createDataFrame([(q, t) for q, ts in asked.items() for t in ts], "query_id bigint, term string")
    fields_of, quality_of = (spark.createDataFrame([(p, t, w) for (p, t), w in fields.items()], "parent_asin string, term string, weight double"), spark.createDataFrame(list(quality.items()), "parent_asin string, quality double"))
    wanted = {}
    for q, ts in asked.items():
        scores = {p: s for p in quality if (s := sum(fields.get((p, t), 0.0) for t in ts))}
        wanted[q] = [(p, scores[p]) for p in sorted(scores, key=lambda p: (-scores[p], -quality[p], p))[:30]]
    prepared = retrieval.mask_columns(terms, fields_of, quality_of)
    for part, block in (1000, 7), (100_000, 50_000):
        got = {q: [] for q in asked}
        for r in retrieval.mask_top(terms, prepared, 30, part, block).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.parent_asin, r.score))
        assert got == {q: w for q, w in wanted.items()}


def test_answers_search_in_bounded_blocks(spark, monkeypatch):
    """A task's lists are bounded, whatever the number of turns; turns without constraints take no more than a page."""
    rows = [(f"P{i:04d}", "Plain Zorblat", [], [], 10.0, ["Things"], {}, 4.0, 10, "Shop") for i in range(500)]
    turns = spark.createDataFrame([("s", 1, "zorblat", datetime(2024, 1, 1))], "session_id string, turn int, user_message string, updated_at timestamp")
    blocks, kept = [], []
    by_part, stored = retrieval.by_part, respond.stored
    monkeypatch.setattr(retrieval, "by_part", lambda *a: blocks.append(a[-1]) or by_part(*a))
    monkeypatch.setattr(respond, "stored", lambda df: kept.append(df.count()) or stored(df))
    got = respond.respond(turns, index.of_products(spark.createDataFrame(rows, PRODUCT))).collect()
    assert len(got) == 10 and kept == [10] and blocks[0] * 450 <= 5_000_000
