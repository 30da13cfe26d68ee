"""Question policy: yields of past questions, shrunk estimates, utilities of asking, and the choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import lookups
from tidemark.operators.catalog import with_ranks

# How likely a question about an attribute is answered, before any observation; in order of preference.
PRIORS = {"category": 0.95, "material": 0.90, "color": 0.90, "size": 0.85, "style": 0.80, "brand": 0.65, "budget": 0.90, "feature": 0.70, "use_case": 0.85, "other": 0.75}


def prior(attribute) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in PRIORS.items() for x in p]), attribute), F.lit(PRIORS["other"]))


def yields(asked: DataFrame) -> DataFrame:
    """(scope, key, attribute, asked, disclosed) at three grains, of (attribute, route, segment, disclosed) rows."""
    d = F.sum(F.col("disclosed").cast("bigint")).alias("disclosed")
    pairs = F.explode(F.array(F.struct(F.lit("global").alias("scope"), F.lit("").alias("key")), F.struct(F.lit("route").alias("scope"), F.col("route").alias("key")), F.struct(F.lit("segment").alias("scope"), F.col("segment").alias("key")))).alias("g")
    return asked.select("attribute", "disclosed", pairs).groupBy("g.scope", "g.key", "attribute").agg(F.count("*").alias("asked"), d)


def posterior(contexts: DataFrame, stats: DataFrame, strength: float = lookups.PRIOR_STRENGTH, least: int = lookups.MIN_ASKED) -> DataFrame:
    """(route, segment, attribute, estimate): the prior refined by the global yield, then by the route's and the
    segment's where each was asked about often enough. ``contexts`` has (route, segment, attribute)."""
    pick = lambda scope, key, name: stats.filter(F.col("scope") == scope).select(F.col("key").alias(key), "attribute", F.col("asked").alias(f"{name}_asked"), F.col("disclosed").alias(f"{name}_disclosed"))
    out = contexts.join(pick("global", "_", "g").drop("_"), "attribute", "left").join(pick("route", "route", "r"), ["route", "attribute"], "left").join(pick("segment", "segment", "s"), ["segment", "attribute"], "left")
    shrunk = lambda base, name: (base * strength + F.coalesce(f"{name}_disclosed", F.lit(0))) / (strength + F.coalesce(f"{name}_asked", F.lit(0)))
    out = out.withColumn("_e", shrunk(prior(F.col("attribute")), "g"))
    for name in ("r", "s"):
        out = out.withColumn("_e", F.when(F.coalesce(f"{name}_asked", F.lit(0)) >= least, shrunk(F.col("_e"), name)).otherwise(F.col("_e")))
    return out.select("route", "segment", "attribute", F.round("_e", 6).alias("estimate"))


def probabilities(scored: DataFrame) -> DataFrame:
    """Add ``p``: each candidate's share of its query's scores; shifted above zero where the least is not, uniform
    where they sum to nothing."""
    from pyspark.sql import Window

    w = Window.partitionBy("query_id")
    least = F.min("score").over(w)
    shifted = F.when(least <= 0, F.col("score") - least + 1e-9).otherwise(F.col("score"))
    moved = scored.withColumn("_s", shifted)
    total = F.sum("_s").over(w)
    return moved.withColumn("p", F.when(total > 0, F.col("_s") / total).otherwise(1.0 / F.count("*").over(w))).drop("_s")


def utilities(candidates: DataFrame, postings: DataFrame, remaining: float = 1.0) -> DataFrame:
    """(query_id, attribute, coverage, gain, utility) of asking about an attribute.

    ``candidates`` (query_id, parent_asin, rank, p). An answer keeps the products with one value; its worth is the
    probability mass of the first ten of them. gain is what the expected worth adds to the first ten of all."""
    joined = candidates.join(postings.select("parent_asin", "attribute", "value").distinct(), "parent_asin")
    top = with_ranks(joined, ["query_id", "attribute", "value"], ["rank", "parent_asin"], "_r")
    by_value = top.groupBy("query_id", "attribute", "value").agg(F.sum(F.when(F.col("_r") <= 10, F.col("p"))).alias("top"), F.sum("p").alias("mass"))
    per = by_value.groupBy("query_id", "attribute").agg(F.sum(F.col("top")).alias("_top"), F.sum("mass").alias("_mass"))
    covered = joined.select("query_id", "attribute", "parent_asin", "p").distinct().groupBy("query_id", "attribute").agg(F.sum("p").alias("coverage"))
    now = candidates.groupBy("query_id").agg(F.sum(F.when(F.col("rank") <= 10, F.col("p"))).alias("_now"))
    out = per.join(covered, ["query_id", "attribute"]).join(now, "query_id")
    gain = F.greatest(F.least(F.col("_top") / F.col("_mass"), F.lit(1.0)) - F.col("_now"), F.lit(0.0))
    return out.select("query_id", "attribute", "coverage", gain.alias("gain"), (gain * F.col("coverage") * prior(F.col("attribute")) * remaining).alias("utility"))


def choose(utility: DataFrame, blocked: DataFrame, threshold: float = 0.0) -> DataFrame:
    """(query_id, attribute, utility) of the best question above the threshold, by the attributes' order where equal;
    ``blocked`` (query_id, attribute) were asked, refused or are settled."""
    place = F.create_map(*[F.lit(x) for i, a in enumerate(PRIORS) for x in (a, i)])
    open_ = utility.join(blocked, ["query_id", "attribute"], "left_anti").filter(F.col("utility") > threshold)
    return with_ranks(open_, ["query_id"], [F.round("utility", 9).desc(), F.coalesce(F.try_element_at(place, F.col("attribute")), F.lit(99)), "attribute"]).filter("rank = 1").select("query_id", "attribute", "utility")


def route(hint, hard_count, has_budget, has_size, has_material, terms, previous) -> Column:
    """The route of a turn: the hint if any, buying if the signals reach 1.25, else the one before."""
    signals = hard_count + has_budget.cast("int") + has_size.cast("int") + has_material.cast("int") + F.least(terms, F.lit(8)) / 8
    return F.coalesce(hint, F.when(signals >= 1.25, "buying").otherwise(previous))


#: Least confidence of a constraint that the router takes as hard. Fixed value.
SURE = 0.9


def hard(is_hard, confidence) -> Column:
    """Whether the router takes a constraint as hard: stated as such, and sure. The ranker asks for the first only."""
    return F.coalesce(is_hard & (confidence >= SURE), F.lit(False))


def from_filters(plans: DataFrame, filters: str = "filters", constraints: str = "constraints") -> DataFrame:
    """``plans`` with ``effective``: a plan's own constraints if it has any, else what its old filters (MAP of attribute to
    values) say: the largest budget is a ceiling, one value must be met, of several any. Empty lists say nothing.

    ``constraints`` is ARRAY<STRUCT<attribute, operator, value, alternatives>>; attributes come in order of their names."""
    entries = F.array_sort(F.filter(F.map_entries(filters), lambda e: F.size(e["value"]) > 0))
    none = F.array().cast("array<string>")
    largest = lambda v: F.array_max(F.transform(v, lambda x: F.struct(F.coalesce(x.try_cast("double"), F.lit(float("-inf"))).alias("n"), x.alias("x"))))["x"]

    def one(e):
        budget, several = e["key"] == "budget", F.size(e["value"]) > 1
        operator = F.when(budget, "lte").when(several, "in").otherwise("eq")
        value = F.when(budget, largest(e["value"])).otherwise(e["value"][0])
        return F.struct(e["key"].alias("attribute"), operator.alias("operator"), value.alias("value"), F.when(~budget & several, e["value"]).otherwise(none).alias("alternatives"))

    rewritten = F.transform(entries, one)
    own = F.col(constraints) if constraints in plans.columns else F.lit(None).cast("array<struct<attribute:string,operator:string,value:string,alternatives:array<string>>>")
    return plans.withColumn("effective", F.when(F.size(own) > 0, own).otherwise(F.coalesce(rewritten, F.array().cast("array<struct<attribute:string,operator:string,value:string,alternatives:array<string>>>"))))
