"""The constraint ranker: one weighted score of a candidate's signals, exact candidates before relaxed ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import lookups, text
from tidemark.operators.catalog import with_ranks
from tidemark.operators.retrieval import normalized


def source_signals(ranked: DataFrame, weights: DataFrame, k: int = lookups.RRF_K) -> DataFrame:
    """(query_id, parent_asin, lexical, dense, attribute): each source's part of the fused score."""
    part = F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)) / (k + F.col("rank"))
    joined = ranked.join(F.broadcast(weights), "source", "left").withColumn("part", part)
    return joined.groupBy("query_id", "parent_asin").agg(*[F.sum(F.when(F.col("source") == s, F.col("part"))).alias(s) for s in ("lexical", "dense", "attribute")])


def coverage(met: DataFrame) -> DataFrame:
    """(query_id, parent_asin, coverage) from (query_id, parent_asin, met): the share of a group of constraints met."""
    return met.groupBy("query_id", "parent_asin").agg(F.avg(F.col("met").cast("double")).alias("coverage"))


def consensus(ranked: DataFrame) -> DataFrame:
    """(query_id, parent_asin, agreed): in at least two sources besides the profile, one of them by words or attributes."""
    others = F.col("source") != "profile"
    agreed = (F.count_if(others & (F.col("rank") > 0)) >= 2) & F.bool_or(F.col("source").isin("lexical", "attribute") & (F.col("rank") > 0))
    return ranked.groupBy("query_id", "parent_asin").agg(agreed.alias("agreed"))


def rank(signals: DataFrame, weights: dict | None = None, consensus_bonus: float = 0.0, boundary_bonus: float = 0.0) -> DataFrame:
    """Add score, relaxed and rank. ``signals`` (query_id, parent_asin) may have any of hard, lexical, dense, fusion,
    attribute, category, soft, profile and quality; those of sources are scaled by the query's largest. ``hard`` is the
    share of hard constraints met; what misses any loses the conflict weight, once. ``relaxed``, if given, says which
    candidates come last, else those that miss any. A candidate on which the sources agree (``agreed``) gets the
    consensus bonus, and the boundary bonus if it was among the first ten (``pre_rank``) without conflict. Order by
    relaxed, score, then id. A null signal counts as 0."""
    weights = weights or lookups.RANK_WEIGHTS
    scaled = [c for c in ("lexical", "dense", "fusion", "attribute") if c in signals.columns]
    plain = [c for c in ("hard", "category", "soft", "profile", "quality") if c in signals.columns]
    out = signals.withColumns({f"_{c}": normalized(c, ["query_id"]) for c in scaled} | {f"_{c}": F.coalesce(c, F.lit(0.0)) for c in plain})
    conflict = F.col("_hard") < 1 if "hard" in plain else F.lit(False)
    relaxed = F.col("relaxed") if "relaxed" in signals.columns else conflict
    parts = [F.col(f"_{c}") * weights[c] for c in scaled + plain] + [F.when(conflict, weights["conflict"]).otherwise(0.0)]
    if "agreed" in signals.columns:
        agreed = F.coalesce("agreed", F.lit(False))
        early = F.coalesce(F.col("pre_rank") <= lookups.RESULT_LIMIT, F.lit(False)) if "pre_rank" in signals.columns else F.lit(False)
        parts.append(F.when(agreed, consensus_bonus).otherwise(0.0))
        parts.append(F.when(agreed & early & ~relaxed & ~conflict, boundary_bonus).otherwise(0.0))
    out = out.withColumn("score", reduce(lambda a, b: a + b, parts)).withColumn("relaxed", relaxed)
    return with_ranks(out, ["query_id"], ["relaxed", F.round("score", 9).desc(), "parent_asin"]).drop(*[f"_{c}" for c in scaled + plain])


def diversity_terms(attributes) -> Column:
    """The words by which products are alike: those of category, material, style and use case."""
    values = F.concat(*[F.coalesce(F.col(attributes)[a], F.array().cast("array<string>")) for a in ("category", "material", "style", "use_case")])
    return F.array_distinct(F.flatten(F.transform(values, text.terms)))
