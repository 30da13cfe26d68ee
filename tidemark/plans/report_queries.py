"""Checks of evaluation reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import metrics, reports
from tidemark.plans.analytics_queries import _METRICS, _SCORED, _TWO, outcomes, traces

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def report(rows, by="scenario"):
    return metrics.with_score(rows.groupBy(by).agg(*metrics.summary()))


def second(spark, sf_dir):
    return outcomes(spark, sf_dir, 1)


_FIGURES = ("sessions", "hit_rate", "mrr", "mttc", "efficiency", "score")
_LONG = lambda of: " UNION ALL ".join(f"SELECT scenario, '{f}' AS figure, CAST({f} AS DOUBLE) AS value FROM {of}" for f in _FIGURES)
_REPORTS = f"""{_TWO}, m AS (SELECT scenario, {_METRICS} FROM o GROUP BY scenario), one AS (SELECT {_SCORED} FROM m), m2 AS (SELECT scenario, {_METRICS} FROM b GROUP BY scenario), two AS (SELECT {_SCORED} FROM m2)"""


@query(f"""{_REPORTS}, l1 AS ({_LONG('one')}), l2 AS ({_LONG('two')})
SELECT scenario, figure, l1.value AS reported, l2.value AS recomputed, CAST(round(l1.value * 1000000) AS BIGINT) IS NOT DISTINCT FROM CAST(round(l2.value * 1000000) AS BIGINT) AS equal FROM l1 FULL JOIN l2 USING (scenario, figure)""")
def report_verification(spark, sf_dir):
    return reports.verified(report(outcomes(spark, sf_dir)), second(spark, sf_dir), "scenario")


@query(f"""{_REPORTS}, bad AS (SELECT scenario, sessions, hit_rate + 0.9::DOUBLE AS hit_rate, mrr, mttc - 1 AS mttc, efficiency, score FROM one), l AS ({_LONG('bad')})
SELECT scenario, figure, 'range' AS problem FROM l WHERE (figure = 'sessions' AND value < 1) OR (figure IN ('hit_rate', 'mrr', 'efficiency', 'score') AND (value < 0 OR value > 1)) OR (figure = 'mttc' AND (value < 1 OR value > 11))
UNION ALL SELECT scenario, 'mrr', 'above hit rate' FROM bad WHERE mrr > hit_rate""")
def report_ranges(spark, sf_dir):
    """A report with figures made wrong, so that the check finds some."""
    bad = report(outcomes(spark, sf_dir)).withColumn("hit_rate", F.col("hit_rate") + 0.9).withColumn("mttc", F.col("mttc") - 1)
    return reports.out_of_range(bad, "scenario")


@query(f"""{_REPORTS}, w AS (SELECT {_METRICS} FROM o), v AS (SELECT sum(hit_rate * sessions) / sum(sessions) AS hit_rate, sum(mrr * sessions) / sum(sessions) AS mrr, sum(mttc * sessions) / sum(sessions) AS mttc FROM one)
SELECT figure, round(weighted, 5) AS weighted, round(whole, 5) AS whole, abs(weighted - whole) <= 2e-6 AS equal FROM (SELECT 'hit_rate' AS figure, v.hit_rate AS weighted, w.hit_rate AS whole FROM v, w UNION ALL SELECT 'mrr', v.mrr, w.mrr FROM v, w UNION ALL SELECT 'mttc', v.mttc, w.mttc FROM v, w)""")
def report_consistency(spark, sf_dir):
    rows = outcomes(spark, sf_dir)
    found = reports.uneven(report(rows), rows.agg(*metrics.summary()))
    return found.select("figure", F.round("weighted", 5).alias("weighted"), F.round("whole", 5).alias("whole"), "equal")


@query(f"{_TWO} (SELECT session_id, 'first only' AS side FROM o WHERE hit EXCEPT ALL SELECT session_id, 'first only' FROM b WHERE hit) UNION ALL (SELECT session_id, 'second only' FROM b WHERE hit EXCEPT ALL SELECT session_id, 'second only' FROM o WHERE hit)")
def report_sample_sets(spark, sf_dir):
    return reports.set_difference(outcomes(spark, sf_dir).filter("hit"), second(spark, sf_dir).filter("hit"), "session_id")


@query(f"""{_REPORTS}, slow AS (SELECT max(CAST(json_extract_string(trace_json, '$.elapsed_ms') AS DOUBLE)) < 1500 AS ok FROM turns WHERE json_valid(trace_json)),
g AS (SELECT 'ranges' AS gate, true AS passed UNION ALL SELECT 'latency', coalesce((SELECT ok FROM slow), false)
  UNION ALL SELECT 'score', coalesce((SELECT bool_and(coalesce(round((two.score - one.score) * 1000000) >= -15000, false)) FROM one FULL JOIN two USING (scenario)), false)
  UNION ALL SELECT 'samples', (SELECT count(*) FROM (SELECT session_id FROM o EXCEPT SELECT session_id FROM b)) = 0)
SELECT bool_and(passed) AS accepted, coalesce(string_agg(gate, ', ' ORDER BY gate) FILTER (NOT passed), '') AS failures FROM g""")
def report_acceptance(spark, sf_dir):
    one, two = report(outcomes(spark, sf_dir)), report(second(spark, sf_dir))
    none = lambda df: df.agg((F.count("*") == 0).alias("passed"))
    return reports.accepted({
        "score": metrics.gate(one, two, "scenario", 0.015), "ranges": none(reports.out_of_range(two, "scenario")),
        "samples": none(reports.set_difference(outcomes(spark, sf_dir), second(spark, sf_dir), "session_id")),
        "latency": traces(spark, sf_dir).agg((F.max("elapsed_ms") < 1500).alias("passed")),
    })
