"""Outcome analytics: hit rate, reciprocal rank, turns to conversion, folds, latency, transitions, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.engine import rank_in_groups

MISS_TURN = 11


def summary() -> list:
    """Aggregates of outcomes (hit, first_hit_turn, reciprocal_rank): a miss counts as turn 11."""
    return [F.count("*").alias("sessions"), F.round(F.avg(F.col("hit").cast("double")), 6).alias("hit_rate"), F.round(F.avg("reciprocal_rank"), 6).alias("mrr"), F.round(F.avg(F.coalesce(F.col("first_hit_turn").cast("double"), F.lit(float(MISS_TURN)))), 6).alias("mttc")]


def with_score(metrics: DataFrame) -> DataFrame:
    """Add efficiency, ten turns' share that was spared, and score: half hit rate, 0.3 reciprocal rank, 0.2 efficiency."""
    efficiency = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (MISS_TURN - F.col("mttc")) / 10))
    out = metrics.withColumn("efficiency", F.round(efficiency, 6))
    return out.withColumn("score", F.round(0.5 * F.col("hit_rate") + 0.3 * F.col("mrr") + 0.2 * F.col("efficiency"), 6))


def by_scenario(outcomes: DataFrame) -> DataFrame:
    """The metrics of each scenario and of all (scenario null), in one pass."""
    return with_score(outcomes.rollup("scenario").agg(*summary()))


def folds(rows: DataFrame, strata: list, key: str, seed: str = "fold", n: int = 5) -> DataFrame:
    """Add ``fold`` 1..n: round robin inside each stratum in the order of a hash of the key."""
    hashed = rows.withColumn("_h", F.sha2(F.concat(F.lit(seed), F.char(F.lit(0)), F.col(key)), 256))
    return rank_in_groups(hashed, strata, ["_h", key], "_r").withColumn("fold", (F.col("_r") - 1) % n + 1).drop("_h", "_r")


def selection(fold_metrics: DataFrame) -> DataFrame:
    """(mean, deviation, selection) over folds: the mean less half the population deviation."""
    out = fold_metrics.agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("deviation"))
    return out.select(F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"), F.round(F.col("mean") - 0.5 * F.col("deviation"), 6).alias("selection"))


def latency(rows: DataFrame, by: list, column: str = "elapsed_ms") -> DataFrame:
    """count, median, nearest-rank 95th percentile and maximum of a column."""
    return rows.groupBy(*by).agg(F.count(column).alias("n"), F.median(column).alias("median"), F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {column})").alias("p95"), F.max(column).alias("max"))


def failures(outcomes: DataFrame, dims: list) -> DataFrame:
    """(dimension, value, misses) of the missed sessions, by each of ``dims`` on its own, in one pass."""
    missed = outcomes.filter("NOT hit")
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dims])).alias("p")
    return missed.select(pairs).groupBy("p.dimension", "p.value").agg(F.count("*").alias("misses"))


def transitions(baseline: DataFrame, candidate: DataFrame, key: str = "session_id") -> DataFrame:
    """(change, sessions) between two runs: recovered, regressed, improved, worsened, same, or missing in one of them.

    Earlier turn is better, then better rank."""
    a, b = baseline.select(key, F.struct("hit", "first_hit_turn", "best_rank").alias("a")), candidate.select(key, F.struct("hit", "first_hit_turn", "best_rank").alias("b"))
    was, now = F.struct("a.first_hit_turn", "a.best_rank"), F.struct("b.first_hit_turn", "b.best_rank")
    change = F.when(F.col("a").isNull() | F.col("b").isNull(), "missing").when(~F.col("a.hit") & F.col("b.hit"), "recovered").when(F.col("a.hit") & ~F.col("b.hit"), "regressed")
    change = change.when(~F.col("a.hit"), "same").when(now < was, "improved").when(now > was, "worsened").otherwise("same")
    return a.join(b, key, "full_outer").groupBy(change.alias("change")).agg(F.count("*").alias("sessions"))


def gate(baseline: DataFrame, candidate: DataFrame, by: str, tolerance: float) -> DataFrame:
    """(by, delta, passed): the score's change in each group, in whole millionths; a fall of more than ``tolerance`` fails."""
    joined = baseline.select(by, F.col("score").alias("_a")).join(candidate.select(by, F.col("score").alias("_b")), by, "full_outer")
    delta = F.round((F.col("_b") - F.col("_a")) * 1_000_000).cast("bigint")
    return joined.select(by, delta.alias("delta"), F.coalesce(delta >= -round(tolerance * 1_000_000), F.lit(False)).alias("passed"))


def outcomes(labels: DataFrame, shown: DataFrame, k: int = 10) -> DataFrame:
    """(session_id, scenario, hit, first_hit_turn, best_rank, reciprocal_rank) from ``labels`` (session_id, scenario,
    target) and ``shown`` (session_id, turn, rank, parent_asin)."""
    hits = shown.filter(F.col("rank") <= k).join(labels.select("session_id", F.col("target").alias("parent_asin")), ["session_id", "parent_asin"], "left_semi")
    best = hits.groupBy("session_id").agg(F.min(F.struct("turn", "rank")).alias("f"), F.min("rank").alias("best_rank"))
    joined = labels.join(best, "session_id", "left")
    return joined.select("session_id", "scenario", F.col("f").isNotNull().alias("hit"), F.col("f.turn").alias("first_hit_turn"), "best_rank", F.coalesce(1.0 / F.col("f.rank"), F.lit(0.0)).alias("reciprocal_rank"))
