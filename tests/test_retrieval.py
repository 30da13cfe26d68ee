import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import metrics, policy, predicates, ranking, retrieval, sampling


def test_fusion(spark):
    ranked = spark.createDataFrame([(1, "lexical", "A", 1), (1, "lexical", "B", 2), (1, "attribute", "B", 1), (1, "attribute", "C", 2), (1, "other", "D", 1)], "query_id int, source string, parent_asin string, rank int")
    weights = spark.createDataFrame([("lexical", 0.35), ("attribute", 0.45), ("other", -1.0)], "source string, weight double")
    got = [(r.parent_asin, round(r.score, 6), r.rank) for r in retrieval.fuse(ranked, weights).orderBy("rank").collect()]
    assert got == [("B", 0.013022, 1), ("C", 0.007258, 2), ("A", 0.005738, 3), ("D", 0.0, 4)]


@pytest.mark.parametrize(("evidence", "document", "run"), [("water resistant", "a water resistant b", 2), ("water resistant", "water b resistant", 1), ("a b c", "x a b c y", 3), ("missing", "a b", None), ("", "a b", None), ("a a b", "a a a b", 3)])
def test_longest_run(spark, evidence, document, run):
    e = spark.createDataFrame([(1, 0, evidence.split())], "query_id int, phrase_id int, tokens array<string>")
    d = spark.createDataFrame([(1, "P", document.split())], "query_id int, parent_asin string, tokens array<string>")
    got = retrieval.longest_runs(e, d).collect()
    assert [r.run for r in got] == ([run] if run else [])


def greedy(items, k, balance):
    low, high = min(i[1] for i in items), max(i[1] for i in items)
    left = [(a, (s - low) / (high - low) if high > low else 0.0, t) for a, s, t in items]
    out = []
    while left and len(out) < k:
        def gain(c):
            return round(balance * c[1] - (1 - balance) * max((len(c[2] & d[2]) / len(c[2] | d[2]) for d in out), default=0.0), 9)

        best = sorted(left, key=lambda c: (-gain(c), c[0]))[0]
        left.remove(best)
        out.append(best)
    return [c[0] for c in out]


def test_mmr_against_brute_force(spark):
    rng, data = random.Random(3), []
    for q in range(20):
        for i in range(rng.randrange(1, 16)):
            data.append((q, f"P{i:02d}", round(rng.random(), 3), i + 1, sorted({rng.choice("abcdefgh") for _ in range(4)})))
    df = spark.createDataFrame(data, "query_id bigint, parent_asin string, score double, rank int, terms array<string>")
    got = {}
    for r in retrieval.mmr(df, 10).collect():
        got.setdefault(r.query_id, {})[r.mmr_rank] = r.parent_asin
    for q in {d[0] for d in data}:
        assert [got[q][i] for i in sorted(got[q])] == greedy([(d[1], d[2], set(d[4])) for d in data if d[0] == q], 10, 0.85)


def test_dense_against_brute_force(spark):
    rng = random.Random(5)
    data = [(i, [rng.choice([-1.0, 0.0, 1.0]) for _ in range(4)]) for i in range(200)] + [(500, None)]
    rows = spark.createDataFrame(data, "vec_id bigint, embedding array<float>")
    asked = spark.createDataFrame(data[:5], "query_id bigint, vector array<float>")
    got = {(r.query_id, r.rank): r.vec_id for r in retrieval.dense_top_k(rows, asked, 7).collect()}
    for q, v in data[:5]:
        best = sorted(data[:-1], key=lambda d: (-sum(a * b for a, b in zip(v, d[1], strict=True)), d[0]))[:7]
        assert [got[q, i] for i in range(1, 8)] == [d[0] for d in best]
    assert retrieval.dense_top_k(rows.limit(0), asked, 3).count() == 0


def test_bm25_formula(spark):
    docs = spark.createDataFrame([(1, "a b b"), (2, "a c"), (3, "d e f g"), (4, "a a b")], "doc_id int, text string")
    lengths = docs.select("doc_id", F.size(text.tokens(F.col("text"))).alias("length"))
    got = {r.doc_id: r.score for r in retrieval.bm25(spark.createDataFrame([(1, "b c")], "query_id int, text string"), retrieval.document_terms(docs, "doc_id"), lengths, "doc_id").collect()}
    part = lambda n, df, tf, d: max(math.log((n - df + 0.5) / (df + 0.5)), 0) and math.log((n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * d / 3)) or 1e-6 * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * d / 3))
    assert got == pytest.approx({1: part(4, 2, 2, 3), 2: part(4, 1, 1, 2), 4: part(4, 2, 1, 3)})


def test_metrics_and_scores(spark):
    outcomes = spark.createDataFrame([("a", "s", True, 2, 2, 0.5), ("b", "s", False, None, None, 0.0)], "session_id string, scenario string, hit boolean, first_hit_turn int, best_rank int, reciprocal_rank double")
    r = outcomes.agg(*metrics.summary()).first()
    assert (r.sessions, r.hit_rate, r.mrr, r.mttc) == (2, 0.5, 0.25, 6.5)
    assert metrics.with_score(spark.createDataFrame([(0.965, 0.580968, 2.715)], "hit_rate double, mrr double, mttc double")).first().score == 0.82249
    folds = spark.createDataFrame([(0.817467,), (0.824997,), (0.769402,), (0.836976,)], "score double")
    got = metrics.selection(folds).first()
    assert got.deviation == pytest.approx(0.025676) and got.selection == pytest.approx(0.799373, abs=1e-6)
    lat = metrics.latency(spark.createDataFrame([(1, float(x)) for x in (1, 2, 3, 4, 100)], "g int, elapsed_ms double"), ["g"]).first()
    assert (lat.n, lat.median, lat.p95, lat.max) == (5, 3.0, 100.0, 100.0)
    empty = outcomes.limit(0).agg(*metrics.summary()).first()
    assert empty.sessions == 0 and empty.hit_rate is None


@pytest.mark.parametrize(("attribute", "asked", "disclosed", "wanted"), [("feature", 111, 108, 0.9546), ("other", 17, 13, 0.76), ("material", 76, 57, 0.7643), ("color", 39, 22, 0.6213), ("style", 17, 4, 0.416), ("size", 6, 1, 0.5571), ("budget", 16, 0, 0.3)])
def test_posterior(spark, attribute, asked, disclosed, wanted):
    stats = spark.createDataFrame([("global", "", attribute, asked, disclosed)], "scope string, key string, attribute string, asked bigint, disclosed bigint")
    contexts = spark.createDataFrame([("r", "s", attribute)], "route string, segment string, attribute string")
    assert policy.posterior(contexts, stats).first().estimate == pytest.approx(wanted, abs=5e-5)


def test_question_choice(spark):
    c = spark.createDataFrame([(1, f"P{i:02d}", i + 1, float(12 - i)) for i in range(12)], "query_id int, parent_asin string, rank int, score double")
    posts = [(f"P{i:02d}", "material", "cotton" if i % 2 else "leather") for i in range(12)] + [("P00", "color", "blue"), ("P01", "color", "blue")]
    found = policy.utilities(policy.probabilities(c), spark.createDataFrame(posts, "parent_asin string, attribute string, value string"))
    assert policy.probabilities(c).agg(F.sum("p")).first()[0] == pytest.approx(1)
    assert policy.choose(found, spark.createDataFrame([], "query_id int, attribute string")).first().attribute == "material"


def test_bins_schedule_folds(spark):
    rows = spark.createDataFrame([(float(i), f"k{i}") for i in range(1, 9)] + [(None, "x")], "v double, parent_asin string")
    got = {r.v: r.b for r in sampling.quartile_bins(rows, "v", "b").collect()}
    assert [got[float(i)] for i in range(1, 9)] == ["q1", "q1", "q2", "q2", "q3", "q3", "q4", "q4"] and got[None] == "missing"
    shares = spark.createDataFrame([("buying", 0.4), ("browsing", 0.4), ("intent_override", 0.15), ("boundary", 0.05)], "key string, weight double")
    assert {r.key: r.n for r in sampling.apportion(shares, 20).collect()} == {"buying": 8, "browsing": 8, "intent_override": 3, "boundary": 1}
    strata = spark.createDataFrame([(s, d, f"{s}{d}{i}") for s in "abcd" for d in "xyz" for i in range(5)], "s string, d string, k string")
    folded = metrics.folds(strata.repartition(3), ["s", "d"], "k")
    assert folded.groupBy("s", "d").agg(F.countDistinct("fold").alias("n")).filter("n <> 5").count() == 0


def test_samples(spark):
    rows = spark.createDataFrame([(f"p{i}", "ab"[i % 10 > 7], "xyz"[i % 3]) for i in range(300)], "parent_asin string, category string, bin string")
    got = sampling.representative_sample(rows, ["category", "bin"], 30)
    assert got.count() == 30 and got.filter("category = 'b'").count() == 6
    assert {r.parent_asin for r in got.collect()} == {r.parent_asin for r in sampling.representative_sample(rows.repartition(5), ["category", "bin"], 30).collect()}
    assert sampling.stress_sample(rows, ["category", "bin"], 40).filter("category = 'b'").count() > 8
    assert sampling.representative_sample(rows.limit(0), ["category", "bin"], 5).count() == 0


def test_constraints_fail_closed(spark):
    products = spark.createDataFrame([("A", 10.0, {"color": ["red"], "category": ["boots"]}, ["red", "boots"]), ("B", None, {"color": []}, []), ("C", float("nan"), None, None)], "parent_asin string, price double, attributes map<string,array<string>>, search_terms array<string>")
    asked = [(1, "color", "not_in", "blue", None, None, True, "m"), (2, "budget", "lte", "10", None, None, True, "m"), (3, "budget", "gte", "1", None, None, True, "m"), (4, "budget", "not_in", "5", None, None, True, "m"), (5, "category", "not_in", "dress", None, None, True, "m"), (6, "color", "gte", "1", None, None, True, "m"), (7, "budget", "between", "10", "x", None, True, "m")]
    got = {(r.parent_asin, r.constraint_id): r.met for r in predicates.check(products, spark.createDataFrame(asked, predicates.SCHEMA)).collect()}
    assert {k[1] for k, met in got.items() if met} == {1, 2, 3, 4, 5} and {k[0] for k, met in got.items() if met} == {"A"}


def test_ranking_order(spark):
    signals = spark.createDataFrame([(1, "A", 1.0, 0.1), (1, "B", 0.5, 0.9), (1, "C", 1.0, None)], "query_id int, parent_asin string, hard double, lexical double")
    assert [(r.parent_asin, r.relaxed) for r in ranking.rank(signals).orderBy("rank").collect()] == [("A", False), ("C", False), ("B", True)]


def test_quantization(spark):
    q = spark.createDataFrame([([3.0, 4.0],), ([-2.0, 0.5],), ([0.0, 0.0],)], "v array<float>").select(text.quantize(F.col("v")).alias("q")).collect()
    for row in q[:2]:
        assert abs(math.sqrt(sum((v * row.q.scale) ** 2 for v in row.q["values"])) - 1) <= 0.02
    assert list(q[2].q["values"]) == [0, 0]


@pytest.mark.parametrize(("word", "wanted"), [("booties", "bootie"), ("parties", "party"), ("dresses", "dress"), ("watches", "watch"), ("boxes", "box"), ("shoes", "shoe"), ("glass", "glass"), ("ties", "tie"), ("as", "as"), ("ies", "ie")])
def test_singular(spark, word, wanted):
    assert spark.createDataFrame([(word,)], "w string").select(text.singular(F.col("w"))).first()[0] == wanted
