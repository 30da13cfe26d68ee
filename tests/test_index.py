from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import catalog as cat
from tidemark.operators import hybrid, index, policy, predicates, ranking, respond, retrieval

SCHEMA = "parent_asin string, title string, features array<string>, description array<string>, price double, categories array<string>, details map<string,string>, average_rating double, rating_number bigint, store string, loaded_at timestamp, extra string"
DAY = datetime(2025, 1, 1)


def product(i, title, price=10.0, rating=4.0, categories=("Shoes", "Boots"), features=()):
    return (f"P{i:03d}", title, list(features), None, price, list(categories), None, rating, i, "Store", DAY, "clash")


DATA = [product(i, f"{'Blue' if i % 2 else 'Green'} {'cotton' if i % 3 else 'leather'} boots {'waterproof' if i % 5 == 0 else ''}", price=None if i == 7 else float(i), features=["comfortable"] if i % 4 == 0 else []) for i in range(1, 41)]
DATA += [product(50, None), product(51, "", price=-1.0), (None, "no id", [], [], 1.0, [], {}, 1.0, 1, "", DAY, "")]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("catalogue") / "c.parquet")
    spark.createDataFrame(DATA, SCHEMA).write.parquet(path)
    return path, index.of_catalog(spark, path)


def test_tables_hold_what_the_catalogue_gives(spark, rows, stored):
    path, idx = stored
    products = cat.latest(spark.read.parquet(path))
    assert rows(idx.terms, "parent_asin", "term", "mask", "weight", "tf") == rows(cat.term_fields(products), "parent_asin", "term", "mask", "weight", "tf")
    assert rows(idx.postings, "parent_asin", "attribute", "value", "pos") == rows(cat.postings(cat.attributes(products)), "parent_asin", "attribute", "value", "pos")
    assert idx.counts.agg(F.sum("df")).first()[0] == idx.terms.count() and idx.totals.first().n == idx.products.filter("length > 0").count()


def test_same_files_same_index(spark, stored, tmp_path):
    path, idx = stored
    again = index.of_catalog(spark, path)
    assert again.terms.inputFiles() == idx.terms.inputFiles()
    other = str(tmp_path / "c.parquet")
    spark.createDataFrame(DATA[:3], SCHEMA).write.parquet(other)
    assert index.of_catalog(spark, other).products.count() == 3


def test_only_the_terms_folders_are_read(spark, stored):
    _, idx = stored
    wanted = spark.createDataFrame([("waterproof",)], "term string")
    plan = idx.of(wanted)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(part" in plan or "PartitionFilters: [(part" in plan
    assert idx.of(wanted).filter("term = 'waterproof'").count() == 8


def test_lexical_agrees_with_plain_scores(spark, rows, stored):
    path, idx = stored
    products = cat.latest(spark.read.parquet(path))
    queries = spark.createDataFrame([(1, "blue waterproof boots"), (2, "leather"), (3, "no such words"), (4, None)], "query_id bigint, text string")
    lengths = idx.products.select("parent_asin", "length").filter("length > 0")
    plain = retrieval.bm25(queries, cat.term_fields(products).select("parent_asin", "term", "tf"), lengths, "parent_asin")
    short = lambda df: rows(df.select("query_id", "parent_asin", F.round("score", 9)))
    assert short(hybrid.lexical(queries, idx, 1000)) == short(plain)
    assert short(hybrid.by_mask(queries, idx, 1000)) == short(retrieval.mask_scores(queries, cat.term_fields(products)))


def constraint(q, i, attribute, operator, value, hard=True, alternatives=None, source="message"):
    return (q, i, attribute, operator, value, None, alternatives, hard, source)


CONSTRAINTS = "query_id bigint, constraint_id int, attribute string, operator string, value string, upper_value string, alternatives array<string>, is_hard boolean, source string"


def test_attribute_source_meets_all_hard_constraints(spark, stored):
    _, idx = stored
    asked = [constraint(1, 1, "color", "in", "blue", alternatives=["blue", "red"]), constraint(1, 2, "material", "not_in", "leather"), constraint(1, 3, "budget", "lte", "20"), constraint(2, 1, "budget", "lte", "5"), constraint(3, 1, "color", "eq", "blue", hard=False), constraint(4, 1, "category", "eq", "boot")]
    got = {}
    for r in hybrid.by_attributes(spark.createDataFrame(asked, CONSTRAINTS), idx, 150).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.parent_asin))
    of = {q: [p for _, p in sorted(v)] for q, v in got.items()}
    assert set(of[1]) == {d[0] for d in DATA[:40] if "Blue" in d[1] and "leather" not in d[1] and d[4] and d[4] <= 20}
    assert set(of[2]) == {"P001", "P002", "P003", "P004", "P005"} and 3 not in of and len(of[4]) == 42
    assert of[2] == ["P005", "P004", "P003", "P002", "P001"]


def test_candidates_and_fallbacks(spark, stored):
    _, idx = stored
    queries = spark.createDataFrame([(1, "blue boots"), (2, "blue boots"), (3, "boots")], "query_id bigint, text string")
    asked = spark.createDataFrame([constraint(1, 1, "color", "eq", "blue"), constraint(2, 1, "budget", "lte", "2"), constraint(3, 1, "budget", "lte", "0.5")], CONSTRAINTS)
    vectors = queries.select("query_id", index.unit(index.vector(F.split("text", " "))).alias("vector"))
    found = hybrid.sources(queries, asked, vectors, idx)
    judged = predicates.coverages(found.select("query_id", "parent_asin"), asked, idx.products)
    shown = spark.createDataFrame([(1, "P001"), (2, "P002")], "query_id bigint, parent_asin string")
    kept = hybrid.exact(found, judged, shown)
    weights = spark.createDataFrame([("lexical", 0.35), ("attribute", 0.45), ("dense", 0.2)], "source string, weight double")
    rows = hybrid.candidates(kept, weights, queries, asked, shown, idx).collect()
    of = lambda q: [(r.stage, r.parent_asin) for r in sorted(rows, key=lambda r: r.rank) if r.query_id == q]
    assert {p for _, p in of(1)} == {d[0] for d in DATA[:40] if "Blue" in d[1]} - {"P001"} and {s for s, _ in of(1)} == {0}
    # one exact product, then popular ones that violate the budget, shown ones only after those
    assert of(2)[0] == (0, "P001") and len(of(2)) == 10 and {s for s, _ in of(2)[1:]} == {2}
    assert len(of(3)) == 10 and {s for s, _ in of(3)} == {2}


def test_conflict_counts_once(spark):
    signals = spark.createDataFrame([(1, "A", 1.0), (1, "B", 0.5), (1, "C", 0.0)], "query_id int, parent_asin string, hard double")
    got = {r.parent_asin: (round(r.score, 6), r.relaxed) for r in ranking.rank(signals).collect()}
    assert got == {"A": (0.3, False), "B": (-0.45, True), "C": (-0.6, True)}


def test_agreement_bonuses(spark):
    signals = spark.createDataFrame([(1, "A", 1.0, True, 3), (1, "B", 1.0, True, 11), (1, "C", 1.0, False, 1), (1, "D", 0.5, True, 1)], "query_id int, parent_asin string, hard double, agreed boolean, pre_rank int")
    got = {r.parent_asin: round(r.score, 6) for r in ranking.rank(signals, consensus_bonus=0.05, boundary_bonus=0.025).collect()}
    assert got == {"A": 0.375, "B": 0.35, "C": 0.3, "D": -0.4}


def test_coverages(spark, stored):
    _, idx = stored
    asked = [constraint(1, 1, "color", "eq", "blue"), constraint(1, 2, "budget", "lte", "3"), constraint(1, 3, "category", "eq", "boots", hard=False), constraint(1, 4, "feature", "eq", "comfortable", hard=False, source="profile")]
    pairs = spark.createDataFrame([(1, "P001"), (1, "P004"), (2, "P001"), (1, "P007")], "query_id bigint, parent_asin string")
    got = {(r.query_id, r.parent_asin): (r.hard, r.soft, r.profile, r.category, r.missed) for r in predicates.coverages(pairs, spark.createDataFrame(asked, CONSTRAINTS), idx.products).collect()}
    assert got == {(1, "P001"): (1.0, 1.0, 0.0, 1.0, 0), (1, "P004"): (0.0, 1.0, 1.0, 1.0, 2), (1, "P007"): (0.5, 1.0, 0.0, 1.0, 1), (2, "P001"): (0.0, 0.0, 0.0, 0.0, 0)}


def test_empty_catalogue(spark, tmp_path):
    path = str(tmp_path / "c.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    idx = index.of_catalog(spark, path)
    queries = spark.createDataFrame([(1, "boots")], "query_id bigint, text string")
    assert idx.terms.count() == idx.postings.count() == hybrid.lexical(queries, idx, 5).count() == 0


def test_old_filters(spark):
    schema = "id int, filters map<string,array<string>>, constraints array<struct<attribute:string,operator:string,value:string,alternatives:array<string>>>"
    own = [("size", "eq", "wide", [])]
    data = [(1, {"color": ["red", "blue"], "budget": ["20", "9", "100"], "size": [], "material": ["wool"]}, None), (2, {"color": ["red"]}, own), (3, {}, []), (4, None, None)]
    got = {r.id: [tuple(c) for c in r.effective] for r in policy.from_filters(spark.createDataFrame(data, schema)).collect()}
    assert got == {1: [("budget", "lte", "100", []), ("color", "in", "red", ["red", "blue"]), ("material", "eq", "wool", [])], 2: own, 3: [], 4: []}


def test_hard_needs_to_be_sure(spark):
    data = [(True, 0.9), (True, 0.89), (False, 1.0), (True, None), (None, 1.0)]
    assert [r[0] for r in spark.createDataFrame(data, "h boolean, c double").select(policy.hard(F.col("h"), F.col("c"))).collect()] == [True, False, False, False, False]


def test_answers(spark):
    data = [(None, False, []), ("color", False, []), ("color", True, ["budget at most 5", "color red"]), ("nonsense", True, []), (None, None, None)]
    got = [r[0] for r in spark.createDataFrame(data, "a string, r boolean, d array<string>").select(respond.message(F.col("a"), F.col("r"), F.col("d"))).collect()]
    closest, alternatives = "Here are the closest matches I found.", "These are close alternatives after relaxing"
    ask = "Which color would you prefer?"
    assert got == [closest, ask, f"{ask} {alternatives} budget at most 5, color red.", f"{closest} {alternatives} a strict preference.", closest]
