"""Checks of evaluation reports: recomputed figures, ranges, sample sets, and acceptance of a candidate run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import metrics

#: Figures of a report with the range that each must lie in. Fixed values.
RANGES = {"sessions": (1, None), "hit_rate": (0.0, 1.0), "mrr": (0.0, 1.0), "mttc": (1.0, 11.0), "efficiency": (0.0, 1.0), "score": (0.0, 1.0)}


def units(value: Column) -> Column:
    """A figure in whole millionths, halves away from zero, as reports are compared."""
    return F.round(value * 1_000_000).cast("bigint")


def long_form(report: DataFrame, by: str) -> DataFrame:
    """(by, figure, value): one row for each figure of RANGES that a report has."""
    each = [F.struct(F.lit(f).alias("figure"), F.col(f).cast("double").alias("value")) for f in RANGES if f in report.columns]
    return report.select(by, F.explode(F.array(*each)).alias("f")).select(by, "f.*")


def verified(reported: DataFrame, outcomes: DataFrame, by: str) -> DataFrame:
    """(by, figure, reported, recomputed, equal): each figure of a report against the one that its sessions give; null
    where one side lacks the group."""
    again = metrics.with_score(outcomes.groupBy(by).agg(*metrics.summary()))
    a = long_form(reported, by).withColumnRenamed("value", "reported")
    b = long_form(again, by).withColumnRenamed("value", "recomputed")
    both = a.join(b, [by, "figure"], "full_outer")
    return both.withColumn("equal", units(F.col("reported")).eqNullSafe(units(F.col("recomputed"))))


def out_of_range(report: DataFrame, by: str) -> DataFrame:
    """(by, figure, problem): figures that are missing, not finite or outside their range, and a mean reciprocal rank
    above the hit rate, which no sessions can have."""
    rows = long_form(report, by)
    low = F.create_map(*[F.lit(x) for f, (a, _) in RANGES.items() for x in (f, float(a))])
    high = F.create_map(*[F.lit(x) for f, (_, b) in RANGES.items() for x in (f, float("inf") if b is None else float(b))])
    value, figure = F.col("value"), F.col("figure")
    problem = F.when(value.isNull(), "missing").when(F.isnan(value) | (F.abs(value) == float("inf")), "not finite")
    problem = problem.when((value < low[figure]) | (value > high[figure]), "range")
    found = rows.select(by, "figure", problem.alias("problem")).filter("problem IS NOT NULL")
    above = report.filter("mrr > hit_rate").select(by, F.lit("mrr").alias("figure"), F.lit("above hit rate").alias("problem"))
    return found.unionByName(above)


def uneven(parts: DataFrame, whole: DataFrame) -> DataFrame:
    """(figure, weighted, whole, equal): whether the session-weighted means of the groups give the figures of the whole,
    to the millionth that rounding may cost."""
    weight = F.sum("sessions")
    names = ("hit_rate", "mrr", "mttc")
    means = parts.agg(*[(F.sum(F.col(n) * F.col("sessions")) / weight).alias(n) for n in names])
    pick = lambda df, name: df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("figure"), F.col(n).cast("double").alias(name)) for n in names])).alias("f")).select("f.*")
    both = pick(means, "weighted").join(pick(whole, "whole"), "figure")
    return both.withColumn("equal", F.abs(F.col("weighted") - F.col("whole")) <= 2e-6)


def set_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): what only one of two sample sets holds, repeats counted."""
    one, two = a.select(key), b.select(key)
    return one.exceptAll(two).withColumn("side", F.lit("first only")).unionByName(two.exceptAll(one).withColumn("side", F.lit("second only")))


def accepted(gates: dict[str, DataFrame]) -> DataFrame:
    """(accepted, failures): whether no gate fails. Each gate is a frame with a boolean column ``passed``; one without
    rows fails too."""
    rows = [df.agg(F.lit(name).alias("gate"), F.coalesce(F.bool_and(F.coalesce("passed", F.lit(False))), F.lit(False)).alias("passed")) for name, df in gates.items()]
    every = reduce(DataFrame.unionByName, rows)
    failed = F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("gate"))))
    return every.agg(F.bool_and("passed").alias("accepted"), F.array_join(failed, ", ").alias("failures"))
