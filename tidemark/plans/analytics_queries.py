"""Outcome analytics, question policy and data sets over sessions, turns, vectors and products."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.engine import table
from tidemark.functions import text
from tidemark.operators import catalog as cat
from tidemark.operators import metrics, policy, retrieval, sampling
from tidemark.plans import sql
from tidemark.plans.catalog_queries import index, products

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


# Outcomes: a vector with an id divisible by a hundred is a session, its target any other one of its label; ten turns
# show the others by similarity, ten a turn. A second run knows similarities to one digit only.
def _near(name: str = "", digits: int = 9, places: int = 100) -> str:
    return _NEAR.replace("{n}", name).replace("{d}", str(digits)).replace("{p}", str(places))


_NEAR = """near{n} AS (SELECT q.vec_id AS q, v.vec_id AS v, q.label = v.label AS same, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_inner_product(list_transform(q.embedding, lambda x: x::DOUBLE), list_transform(v.embedding, lambda x: x::DOUBLE)), {d}) DESC, v.vec_id) AS place
  FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id QUALIFY place <= {p}),
outcomes{n} AS (SELECT q AS session_id, any_value(label % 4) AS scenario, min(CASE WHEN same THEN place END) AS first FROM near{n} JOIN embeddings ON q = vec_id GROUP BY q),
o{n} AS (SELECT session_id, scenario, first IS NOT NULL AS hit, (first - 1) // 10 + 1 AS first_hit_turn, (first - 1) % 10 + 1 AS best_rank, CASE WHEN first IS NULL THEN 0 ELSE 1.0::DOUBLE / ((first - 1) % 10 + 1) END AS reciprocal_rank FROM outcomes{n})"""


def outcomes(spark, sf_dir, digits=9, places=100):
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    near = retrieval.dense_top_k(rows, asked, places + 1, digits=digits).filter("query_id <> vec_id")
    near = retrieval.top_k(near.drop("rank"), ["query_id"], places, F.round("score", digits).desc(), F.col("vec_id")).withColumnRenamed("rank", "place")
    labels = rows.select("vec_id", "label")
    both = near.join(labels.select("vec_id", F.col("label").alias("found")), "vec_id").join(labels.select(F.col("vec_id").alias("query_id"), "label"), "query_id")
    best = both.groupBy("query_id", "label").agg(F.min(F.when(F.col("found") == F.col("label"), F.col("place"))).alias("first"))
    turn, rank = F.floor((F.col("first") - 1) / 10) + 1, (F.col("first") - 1) % 10 + 1
    return best.select(F.col("query_id").alias("session_id"), (F.col("label") % 4).alias("scenario"), F.col("first").isNotNull().alias("hit"), turn.cast("bigint").alias("first_hit_turn"), rank.cast("bigint").alias("best_rank"), F.coalesce(1.0 / rank, F.lit(0.0)).alias("reciprocal_rank"))


_METRICS = "count(*) AS sessions, round(avg(CASE WHEN hit THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_rate, round(avg(reciprocal_rank), 6) AS mrr, round(avg(coalesce(first_hit_turn, 11)::DOUBLE), 6) AS mttc"
_SCORED = "*, round(greatest(0, least(1, (11 - mttc) / 10)), 6) AS efficiency, round(0.5::DOUBLE * hit_rate + 0.3::DOUBLE * mrr + 0.2::DOUBLE * round(greatest(0, least(1, (11 - mttc) / 10)), 6), 6) AS score"


@query(f"WITH {_near()} SELECT session_id, scenario, hit, first_hit_turn, best_rank, round(reciprocal_rank, 6) AS reciprocal_rank FROM o")
def session_outcomes(spark, sf_dir):
    return outcomes(spark, sf_dir).withColumn("reciprocal_rank", F.round("reciprocal_rank", 6))


@query(f"WITH {_near()}, m AS (SELECT scenario, {_METRICS} FROM o GROUP BY GROUPING SETS ((scenario), ())) SELECT {_SCORED} FROM m")
def metrics_by_scenario(spark, sf_dir):
    return metrics.by_scenario(outcomes(spark, sf_dir))


_FOLDS = f"""WITH {_near()}, f AS (SELECT *, (row_number() OVER (PARTITION BY scenario ORDER BY sha256(concat('fold', chr(0), session_id::VARCHAR)), session_id::VARCHAR) - 1) % 5 + 1 AS fold FROM o)"""


def folded(spark, sf_dir):
    return metrics.folds(outcomes(spark, sf_dir).withColumn("key", F.col("session_id").cast("string")), ["scenario"], "key")


@query(f"{_FOLDS} SELECT session_id, scenario, fold FROM f")
def fold_assignment(spark, sf_dir):
    return folded(spark, sf_dir).select("session_id", "scenario", F.col("fold").cast("bigint").alias("fold"))


@query(f"{_FOLDS}, m AS (SELECT fold, {_METRICS} FROM f GROUP BY fold), s AS (SELECT {_SCORED} FROM m) SELECT round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS deviation, round(avg(score) - 0.5::DOUBLE * stddev_pop(score), 6) AS selection FROM s")
def cv_selection_score(spark, sf_dir):
    return metrics.selection(metrics.with_score(folded(spark, sf_dir).groupBy("fold").agg(*metrics.summary())))


@query(f"{_FOLDS} SELECT 'scenario' AS dimension, scenario::VARCHAR AS value, count(*) AS misses FROM f WHERE NOT hit GROUP BY 2 UNION ALL SELECT 'fold', fold::VARCHAR, count(*) FROM f WHERE NOT hit GROUP BY 2")
def failure_breakdown(spark, sf_dir):
    return metrics.failures(folded(spark, sf_dir), ["scenario", "fold"])


_TWO = f"""WITH {_near()}, {_near('2', 1)}, b AS (FROM o2)"""


@query(f"""{_TWO} SELECT CASE WHEN b.session_id IS NULL OR o.session_id IS NULL THEN 'missing' WHEN NOT o.hit AND b.hit THEN 'recovered' WHEN o.hit AND NOT b.hit THEN 'regressed' WHEN NOT o.hit THEN 'same'
  WHEN b.first_hit_turn < o.first_hit_turn OR (b.first_hit_turn = o.first_hit_turn AND b.best_rank < o.best_rank) THEN 'improved' WHEN b.first_hit_turn > o.first_hit_turn OR b.best_rank > o.best_rank THEN 'worsened' ELSE 'same' END AS change, count(*) AS sessions
  FROM o FULL JOIN b USING (session_id) GROUP BY 1""")
def paired_transitions(spark, sf_dir):
    return metrics.transitions(outcomes(spark, sf_dir), outcomes(spark, sf_dir, 1))


@query(f"""{_TWO}, m AS (SELECT scenario, {_METRICS} FROM o GROUP BY scenario), a AS (SELECT {_SCORED} FROM m), m2 AS (SELECT scenario, {_METRICS} FROM b GROUP BY scenario), c AS (SELECT {_SCORED} FROM m2)
SELECT scenario, CAST(round((c.score - a.score) * 1000000) AS BIGINT) AS delta, coalesce(round((c.score - a.score) * 1000000) >= -15000, false) AS passed FROM a FULL JOIN c USING (scenario)""")
def stage_gate(spark, sf_dir):
    score = lambda df: metrics.with_score(df.groupBy("scenario").agg(*metrics.summary()))
    return metrics.gate(score(outcomes(spark, sf_dir)), score(outcomes(spark, sf_dir, 1)), "scenario", 0.015)


_TRACE = "SELECT json_extract_string(trace_json, '$.route') AS route, CAST(json_extract_string(trace_json, '$.elapsed_ms') AS DOUBLE) AS elapsed_ms FROM turns WHERE json_valid(trace_json)"


def traces(spark, sf_dir):
    trace = F.try_parse_json("trace_json")
    rows = table(spark, sf_dir, "turns").filter(trace.isNotNull())
    return rows.select("session_id", "turn", F.try_variant_get(trace, "$.route", "string").alias("route"), F.try_variant_get(trace, "$.elapsed_ms", "double").alias("elapsed_ms"))


@query(f"SELECT route, count(elapsed_ms) AS n, median(elapsed_ms) AS median, quantile_disc(elapsed_ms, 0.95) AS p95, max(elapsed_ms) AS max FROM ({_TRACE}) GROUP BY route")
def latency_summary(spark, sf_dir):
    return metrics.latency(traces(spark, sf_dir), ["route"])


@query("SELECT json_extract_string(response_json, '$.ask_attribute') AS attribute, count(*) AS turns, sum(CASE WHEN CAST(json_extract_string(response_json, '$.usage.prompt_tokens') AS BIGINT) >= 0 THEN CAST(json_extract_string(response_json, '$.usage.prompt_tokens') AS BIGINT) END)::BIGINT AS prompt_tokens, sum(json_array_length(response_json, '$.recommendations'))::BIGINT AS recommendations FROM turns WHERE json_valid(response_json) AND json_type(response_json) = 'OBJECT' GROUP BY 1")
def usage_totals(spark, sf_dir):
    v = F.try_parse_json("response_json")
    rows = table(spark, sf_dir, "turns").filter(v.isNotNull()).select(v.alias("v")).filter(F.schema_of_variant("v").startswith("OBJECT"))
    tokens = F.try_variant_get("v", "$.usage.prompt_tokens", "bigint")
    shown = F.coalesce(F.size(F.try_variant_get("v", "$.recommendations", "array<variant>")), F.lit(0))
    return rows.groupBy(F.try_variant_get("v", "$.ask_attribute", "string").alias("attribute")).agg(F.count("*").alias("turns"), F.sum(F.when(tokens >= 0, tokens)).alias("prompt_tokens"), F.sum(F.greatest(shown, F.lit(0)).cast("bigint")).alias("recommendations"))


_ASKS = """asks AS (SELECT lower(trim(t.session_id)) AS session_id, turn, json_extract_string(response_json, '$.ask_attribute') AS attribute, coalesce(json_extract_string(trace_json, '$.route'), 'browsing') AS route, status = 'completed' AS disclosed
  FROM turns t WHERE json_valid(response_json) AND json_extract_string(response_json, '$.ask_attribute') IS NOT NULL AND (trace_json IS NULL OR json_valid(trace_json))),
stats AS (SELECT 'global' AS scope, '' AS key, attribute, count(*) AS asked, sum(disclosed::INT)::BIGINT AS disclosed FROM asks GROUP BY ALL UNION ALL SELECT 'route', route, attribute, count(*), sum(disclosed::INT)::BIGINT FROM asks GROUP BY ALL
  UNION ALL SELECT 'segment', 's' || (turn % 3)::VARCHAR, attribute, count(*), sum(disclosed::INT)::BIGINT FROM asks GROUP BY ALL)"""


def asks(spark, sf_dir):
    """Questions asked in the turns; whether the turn completed stands for an answer, turn modulo 3 for a segment."""
    v, t = F.try_parse_json("response_json"), F.try_parse_json("trace_json")
    rows = table(spark, sf_dir, "turns").filter(v.isNotNull() & (F.col("trace_json").isNull() | t.isNotNull()))
    out = rows.select(F.try_variant_get(v, "$.ask_attribute", "string").alias("attribute"), F.coalesce(F.try_variant_get(t, "$.route", "string"), F.lit("browsing")).alias("route"), F.concat(F.lit("s"), (F.col("turn") % 3).cast("string")).alias("segment"), (F.col("status") == "completed").alias("disclosed"))
    return out.filter("attribute IS NOT NULL")


@query(f"WITH {_ASKS} SELECT * FROM stats")
def question_yields(spark, sf_dir):
    return policy.yields(asks(spark, sf_dir))


_PRIOR = " ".join(f"WHEN '{a}' THEN {p}::DOUBLE" for a, p in policy.PRIORS.items())


@query(f"""WITH {_ASKS}, c AS (SELECT DISTINCT attribute, route, segment FROM (SELECT attribute, route, 's' || (turn % 3)::VARCHAR AS segment FROM asks)),
g AS (SELECT c.*, (CASE attribute {_PRIOR} ELSE 0.75::DOUBLE END * 8 + coalesce(disclosed, 0)) / (8 + coalesce(asked, 0)) AS e FROM c LEFT JOIN (FROM stats WHERE scope = 'global') USING (attribute)),
r AS (SELECT g.*, CASE WHEN coalesce(s.asked, 0) >= 12 THEN (e * 8 + s.disclosed) / (8 + s.asked) ELSE e END AS e2 FROM g LEFT JOIN stats s ON s.scope = 'route' AND s.key = g.route AND s.attribute = g.attribute)
SELECT r.route, r.segment, r.attribute, round(CASE WHEN coalesce(s.asked, 0) >= 12 THEN (e2 * 8 + s.disclosed) / (8 + s.asked) ELSE e2 END, 6) AS estimate FROM r LEFT JOIN stats s ON s.scope = 'segment' AND s.key = r.segment AND s.attribute = r.attribute""")
def beta_posterior(spark, sf_dir):
    rows = asks(spark, sf_dir)
    return policy.posterior(rows.select("route", "segment", "attribute").distinct(), policy.yields(rows))


_CANDIDATES = f"""{sql.attribute_ctes()}, {sql.QUALITY},
c AS (SELECT CAST(b.n AS BIGINT) AS query_id, parent_asin, quality AS score, row_number() OVER (PARTITION BY b.n ORDER BY round(quality, 9) DESC, parent_asin) AS rank FROM quality JOIN cat USING (parent_asin) JOIN (VALUES (1, 'neoprene'), (2, 'waterproof'), (3, 'tee')) b(n, w) ON list_contains({sql.tokens(sql.SEARCH_TEXT)}, b.w) QUALIFY rank <= 150),
p AS (SELECT *, CASE WHEN s > 0 THEN moved / s ELSE 1.0::DOUBLE / n END AS p FROM (SELECT *, sum(moved) OVER (PARTITION BY query_id) AS s, count(*) OVER (PARTITION BY query_id) AS n FROM (SELECT *, CASE WHEN min(score) OVER (PARTITION BY query_id) <= 0 THEN score - min(score) OVER (PARTITION BY query_id) + 1e-9 ELSE score END AS moved FROM c)))"""


def candidates(spark, sf_dir):
    rows = products(spark, sf_dir)
    words = spark.createDataFrame([(1, "neoprene"), (2, "waterproof"), (3, "tee")], "query_id bigint, word string")
    has = rows.select("parent_asin", F.explode(text.terms(text.search_text())).alias("word")).join(F.broadcast(words), "word")
    scored = has.join(cat.with_quality(rows).select("parent_asin", F.col("quality").alias("score")), "parent_asin").select("query_id", "parent_asin", "score")
    return policy.probabilities(retrieval.top_k(scored, ["query_id"], 150, F.round("score", 9).desc(), F.col("parent_asin")))


_UTILITY = f"""WITH {_CANDIDATES},
j AS (SELECT query_id, parent_asin, rank, p, attribute, value FROM p JOIN posts USING (parent_asin)),
v AS (SELECT query_id, attribute, value, sum(CASE WHEN r <= 10 THEN p END) AS top, sum(p) AS mass FROM (SELECT *, row_number() OVER (PARTITION BY query_id, attribute, value ORDER BY rank, parent_asin) AS r FROM j) GROUP BY ALL),
a AS (SELECT query_id, attribute, sum(top) AS top, sum(mass) AS mass FROM v GROUP BY ALL),
cov AS (SELECT query_id, attribute, sum(p) AS coverage FROM (SELECT DISTINCT query_id, attribute, parent_asin, p FROM j) GROUP BY ALL),
now AS (SELECT query_id, sum(CASE WHEN rank <= 10 THEN p END) AS now FROM p GROUP BY 1),
u AS (SELECT query_id, attribute, coverage, greatest(least(top / mass, 1) - now, 0) AS gain FROM a JOIN cov USING (query_id, attribute) JOIN now USING (query_id)),
utility AS (SELECT *, gain * coverage * CASE attribute {_PRIOR} ELSE 0.75::DOUBLE END AS utility FROM u)"""


@query(f"WITH {_CANDIDATES} SELECT query_id, parent_asin, rank, round(p, 6) AS p FROM p")
def candidate_probabilities(spark, sf_dir):
    return candidates(spark, sf_dir).select("query_id", "parent_asin", "rank", F.round("p", 6).alias("p"))


@query(f"{_UTILITY} SELECT query_id, attribute, round(coverage, 6) AS coverage, round(gain, 6) AS gain, round(utility, 6) AS utility FROM utility")
def question_utility(spark, sf_dir):
    found = policy.utilities(candidates(spark, sf_dir), index(spark, sf_dir).postings)
    return found.select("query_id", "attribute", *[F.round(c, 6).alias(c) for c in ("coverage", "gain", "utility")])


_PLACE = " ".join(f"WHEN '{a}' THEN {i}" for i, a in enumerate(policy.PRIORS))


@query(f"{_UTILITY} SELECT query_id, attribute, round(utility, 6) AS utility FROM utility WHERE utility > 0 AND attribute <> 'brand' QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(utility, 9) DESC, CASE attribute {_PLACE} ELSE 99 END, attribute) = 1")
def question_choice(spark, sf_dir):
    found = policy.utilities(candidates(spark, sf_dir), index(spark, sf_dir).postings)
    blocked = found.select("query_id", F.lit("brand").alias("attribute")).distinct()
    return policy.choose(found, blocked).withColumn("utility", F.round("utility", 6))


# Data sets.
_POP = f"pop AS (SELECT parent_asin, price, rating_number, coalesce(array_to_string({sql.CATEGORIES}[-1:], ''), '') AS category FROM cat)"
_BINS = f"""WITH {sql.CAT}, {_POP}, q AS (SELECT quantile_disc(price, [0.25, 0.5, 0.75]) AS p, quantile_disc(rating_number, [0.25, 0.5, 0.75]) AS r FROM pop),
binned AS (SELECT parent_asin, category, CASE WHEN price IS NULL THEN 'missing' WHEN price <= p[1] THEN 'q1' WHEN price <= p[2] THEN 'q2' WHEN price <= p[3] THEN 'q3' ELSE 'q4' END AS price_bin,
  CASE WHEN rating_number IS NULL THEN 'missing' WHEN rating_number <= r[1] THEN 'q1' WHEN rating_number <= r[2] THEN 'q2' WHEN rating_number <= r[3] THEN 'q3' ELSE 'q4' END AS popularity_bin FROM pop, q)"""
_DIMS = ["category", "price_bin", "popularity_bin"]


def binned(spark, sf_dir):
    last = F.coalesce(F.try_element_at(text.categories(), F.lit(-1)), F.lit(""))
    rows = products(spark, sf_dir).select("parent_asin", "price", "rating_number", last.alias("category"))
    rows = sampling.quartile_bins(sampling.quartile_bins(rows, "price", "price_bin"), "rating_number", "popularity_bin")
    return rows.select("parent_asin", *_DIMS)


@query(f"{_BINS} SELECT * FROM binned")
def quartile_bins(spark, sf_dir):
    return binned(spark, sf_dir)


@query(f"{_BINS} " + " UNION ALL ".join(f"SELECT '{d}' AS dim, {d} AS value, count(*) AS n FROM binned GROUP BY 2" for d in _DIMS))
def marginal_frequencies(spark, sf_dir):
    return sampling.marginals(binned(spark, sf_dir), _DIMS)


@query(f"{_BINS}, w AS (SELECT category AS key, count(*) AS weight FROM binned GROUP BY 1), x AS (SELECT key, weight * 997::DOUBLE / sum(weight) OVER () AS x FROM w), b AS (SELECT key, x, floor(round(x, 9)) AS b FROM x) SELECT key, CAST(b + CASE WHEN row_number() OVER (ORDER BY round(x - b, 9) DESC, key) <= 997 - sum(b) OVER () THEN 1 ELSE 0 END AS BIGINT) AS n FROM b")
def largest_remainder(spark, sf_dir):
    shares = binned(spark, sf_dir).groupBy(F.col("category").alias("key")).agg(F.count("*").alias("weight"))
    return sampling.apportion(shares, 997)


_HASH48 = "CAST('0x' || substr(sha256(concat('stress', chr(0), parent_asin)), 1, 12) AS BIGINT)"


@query(f"{_BINS}, " + ", ".join(f"n{i} AS (SELECT {d}, count(*) AS n{i} FROM binned GROUP BY 1)" for i, d in enumerate(_DIMS)) + f" SELECT parent_asin, category, price_bin, popularity_bin FROM binned JOIN n0 USING (category) JOIN n1 USING (price_bin) JOIN n2 USING (popularity_bin) ORDER BY round(-ln(({_HASH48} + 1)::DOUBLE / 281474976710656::DOUBLE) / (1.0::DOUBLE / n0 + 1.0::DOUBLE / n1 + 1.0::DOUBLE / n2), 6), parent_asin LIMIT 200")
def stress_sample(spark, sf_dir):
    return sampling.stress_sample(binned(spark, sf_dir), _DIMS, 200)


@query()
def representative_sample(spark, sf_dir):
    return sampling.representative_sample(binned(spark, sf_dir), _DIMS, 200)


@query(f"{_BINS} SELECT category, parent_asin FROM binned QUALIFY row_number() OVER (PARTITION BY category ORDER BY sha256(concat('first', chr(0), parent_asin)), parent_asin) = 1")
def first_per_category(spark, sf_dir):
    hashed = binned(spark, sf_dir).groupBy("category").agg(F.min_by("parent_asin", F.struct(text.stable_hash("first", F.col("parent_asin")), "parent_asin")).alias("parent_asin"))
    return hashed
