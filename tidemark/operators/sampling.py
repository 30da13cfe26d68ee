"""Deterministic data sets: bins, marginal frequencies, apportionment, weighted and quota samples."""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.engine import broadcast_if_small, cut, number_rows, rank_in_groups


def quartile_bins(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Add ``name``: q1 to q4 by nearest-rank quartiles of all rows, missing for null."""
    first, second, third = nearest_ranks(rows, column, (0.25, 0.5, 0.75))
    value = F.col(column)
    label = F.when(value.isNull(), "missing").when(value <= F.lit(first), "q1").when(value <= F.lit(second), "q2").when(value <= F.lit(third), "q3").otherwise("q4")
    return rows.withColumn(name, label)


def nearest_ranks(rows: DataFrame, column: str, shares: tuple) -> list:
    """The value at the nearest rank of each share of the values that aren't null, None without any. Exact, by one
    range sort: the values are never gathered, as an aggregate of all distinct ones would."""
    numbered = cut(number_rows(rows.select(column).filter(F.col(column).isNotNull()), [column]))
    total = numbered.count()
    places = [max(0, math.ceil(total * s) - 1) for s in shares]
    found = {r._seq: r[0] for r in numbered.filter(F.col("seq").isin(*places)).select(column, F.col("seq").alias("_seq")).collect()}
    return [found.get(p) for p in places]


def marginals(rows: DataFrame, dims: list) -> DataFrame:
    """(dim, value, n) of each dimension, in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("value")) for d in dims])).alias("p")
    return rows.select(pairs).groupBy("p.dim", "p.value").agg(F.count("*").alias("n"))


def apportion(shares: DataFrame, total: int, key: str = "key", weight: str = "weight") -> DataFrame:
    """(key, n): whole numbers that sum to ``total``, by largest remainder, ties by key."""
    from pyspark.sql import Window

    every = Window.partitionBy()
    exact = F.col(weight) * total / F.sum(weight).over(every)
    base = shares.withColumn("_x", exact).withColumn("_b", F.floor(F.round("_x", 9)))
    ranked = base.withColumn("_r", F.row_number().over(Window.orderBy((F.round(F.col("_x") - F.col("_b"), 9)).desc(), key))).withColumn("_left", total - F.sum("_b").over(every))
    return ranked.select(key, (F.col("_b") + (F.col("_r") <= F.col("_left")).cast("int")).cast("bigint").alias("n"))


def unit_hash(seed: str, key) -> F.Column:
    """A number above 0 and up to 1 from the first 12 hex digits of a hash."""
    return (F.conv(F.substring(F.sha2(F.concat(F.lit(seed), F.char(F.lit(0)), key), 256), 1, 12), 16, 10).cast("double") + 1) / float(16**12)


def stress_sample(rows: DataFrame, dims: list, size: int, seed: str = "stress", key: str = "parent_asin") -> DataFrame:
    """The ``size`` rows with the least −ln(u) / w: drawn without replacement with weight w, the sum over ``dims`` of
    one over the frequency of the row's value."""
    out = rows
    for d in dims:
        counts = rows.groupBy(d).agg(F.count("*").alias(f"_n_{d}"))
        out = out.join(broadcast_if_small(counts), out[d].eqNullSafe(counts[d])).drop(counts[d])
    weight = sum((1.0 / F.col(f"_n_{d}") for d in dims), F.lit(0.0))
    drawn = out.withColumn("_draw", F.round(-F.log(unit_hash(seed, F.col(key))) / weight, 6)).orderBy("_draw", key).limit(size)
    return drawn.select(rows.columns)


def representative_sample(rows: DataFrame, dims: list, size: int, seed: str = "proxy", key: str = "parent_asin") -> DataFrame:
    """``size`` rows chosen one by one for the largest sum of the open quotas of their values, ties by hash.

    Quotas are the values' shares of ``size``. The choice runs over the table of cells (distinct combinations of the
    values, so at most the product of their numbers), not over rows; each cell then gives its rows by hash."""
    cells = rows.groupBy(*dims).agg(F.count("*").alias("n")).orderBy(*dims)
    total = rows.count()

    def choose(_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        values = [tuple(r) for r in pdf[dims].itertuples(index=False)]
        counts = pdf["n"].tolist()
        quota = {}
        for v, n in zip(values, counts, strict=True):
            for d, x in zip(dims, v, strict=True):
                quota[d, x] = quota.get((d, x), 0.0) + n * size / total
        gain = lambda i: sum(max(quota[d, x], 0.0) for d, x in zip(dims, values[i], strict=True))
        heap = [(-round(gain(i), 9), i) for i in range(len(values))]
        heapq.heapify(heap)
        take = [0] * len(values)
        left = min(size, sum(counts))
        while left and heap:
            old, i = heapq.heappop(heap)
            now = -round(gain(i), 9)
            if now != old:
                heapq.heappush(heap, (now, i))
                continue
            take[i] += 1
            left -= 1
            for d, x in zip(dims, values[i], strict=True):
                quota[d, x] -= 1
            if take[i] < counts[i]:
                heapq.heappush(heap, (-round(gain(i), 9), i))
        return pdf[dims].assign(take=take)

    schema = ", ".join(f"{d} string" for d in dims) + ", take bigint"
    taken = cells.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(choose, schema)
    ranked = rank_in_groups(rows.withColumn("_h", F.sha2(F.concat(F.lit(seed), F.char(F.lit(0)), F.col(key)), 256)), dims, ["_h", key], "_r")
    on = [ranked[d].eqNullSafe(taken[d]) for d in dims]
    return ranked.join(broadcast_if_small(taken), on).filter("_r <= take").select(*[ranked[c] for c in rows.columns])
