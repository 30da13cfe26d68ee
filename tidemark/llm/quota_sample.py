"""Samples that meet target shares of several categories at once: systematic unequal-probability sampling."""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.engine import cut, number_rows, trimmed

DIMS = ("category", "price_bin", "popularity_bin")
SEED = "tidemark"
#: Largest table of target rows; the cells of buckets that they span, and those that all plans take rows of, are counted
#: on the driver. Rows of a cell for which the prefix sums stay exact.
MAX_TARGETS, MAX_CELLS, MAX_ROWS = 20_000, 1_000_000, 3_000_000_000
#: Cells of all plans up to which they are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 200_000
#: One row in prefix sums of inclusion probabilities.
UNIT = 1 << 20


def normal(column):
    """A bin as it is compared: trimmed, lower case, null if blank."""
    text = F.lower(trimmed(column))
    return F.when(text != "", text)


def latest_products(products: DataFrame) -> DataFrame:
    """One row for each product (id trimmed, lower case; null and blank left out) with the bins of its row with the
    latest loaded_at; of rows equal in it, the larger by its bins. Combined before the shuffle."""
    rows = products.select(normal("parent_asin").alias("parent_asin"), F.struct("loaded_at", *[normal(d).alias(d) for d in DIMS]).alias("r")).filter("parent_asin IS NOT NULL")
    return rows.groupBy("parent_asin").agg(F.max("r").alias("r")).select("parent_asin", *[F.col(f"r.{d}").alias(d) for d in DIMS])


class Plan(NamedTuple):
    """What one plan takes of each cell: its weight in UNITs (a row's inclusion probability is weight / UNIT / rows), the
    sum of the weights before it, how many of its rows the random start crosses, how many are taken after repairs."""

    weight: np.ndarray
    before: np.ndarray
    crossed: np.ndarray
    take: np.ndarray
    start: int


def fitted(counts: np.ndarray, bucket: np.ndarray, size: int, shares: np.ndarray, dims: np.ndarray) -> np.ndarray:
    """Expected rows of each cell: fitted to the target shares dimension by dimension (raking), never above its rows.

    ``bucket`` (dimension, cell) numbers the target that a cell counts in, the number of targets for none; ``shares``
    are permilles of the targets, ``dims`` their dimensions. Memory goes with the cells, not with targets times cells."""
    n = counts.astype(float)
    total, none = n.sum(), len(shares)
    goals = [np.minimum(size * shares / 1000, np.bincount(row, n, none + 1)[:none]) for row in bucket]
    weight = size * n / total
    for _ in range(60):
        for d, row in enumerate(bucket):
            own = dims == d
            if not own.any():
                continue
            have = np.bincount(row, weight, none + 1)[:none]
            factor = np.append(np.where(own & (have > 0), goals[d] / np.where(have > 0, have, 1), 0.0), 0.0)
            weight = weight * factor[row]
        weight = np.minimum(weight, n)
    for _ in range(60):  # what the shares leave open is spread over what is left
        gap = min(size, total) - weight.sum()
        if gap < 1e-9:
            break
        room = n - weight
        served = room * (weight > 0)
        room = served if served.sum() > 1e-9 else room
        weight = np.minimum(n, weight + room * min(1.0, gap / room.sum()))
    return weight


def crossings(prefix, start: int):
    """Integer crossings of a prefix sum up to ``prefix`` UNITs, from ``start`` (1 to UNIT) on."""
    return (prefix - start + UNIT) // UNIT


def plan_cells(counts: np.ndarray, keys: list[tuple], size: int, wants: dict, seed: str) -> Plan:
    """How many rows each cell gives to one plan's sample.

    One random start takes the integer crossings of the prefix sums of the fitted inclusion probabilities over the
    cells in sorted order. Then buckets below their need get rows from cells that serve the most such buckets, in
    exchange for rows of cells whose buckets are all above their need; without such an exchange the floor stays short.
    """
    start = 1 + (int(hashlib.sha256(seed.encode()).hexdigest()[:12], 16) >> 28)
    zero = np.zeros(len(keys), dtype=np.int64)
    if not counts.sum() or not size:
        return Plan(zero, zero, zero, zero.copy(), start)
    order = list(wants)
    numbers = [{b: k for k, (dim, b) in enumerate(order) if dim == d} for d in range(len(DIMS))]
    # target of each cell in each dimension (one more, without need, for cells in no bucket of it)
    bucket = np.array([[numbers[d].get(k[d], len(order)) for k in keys] for d in range(len(DIMS))])
    shares = np.array([wants[w][1] for w in order], dtype=float)
    expected = fitted(counts, bucket, size, shares, np.array([w[0] for w in order], dtype=int))
    ends = np.rint(np.cumsum(expected) * UNIT).astype(np.int64)
    weight = np.minimum(np.diff(ends, prepend=0), counts * UNIT)
    before = np.cumsum(weight) - weight
    crossed = crossings(before + weight, start) - crossings(before, start)
    take = crossed.copy()

    def inside(rows: np.ndarray) -> np.ndarray:
        return sum(np.bincount(b, rows, len(order) + 1)[: len(order)] for b in bucket).astype(np.int64)

    there = inside(counts)
    need = np.minimum(np.array([wants[w][0] for w in order], dtype=np.int64), there)
    floor = np.minimum(np.array([wants[w][2] for w in order], dtype=np.int64), there)

    def surplus(need: np.ndarray = need) -> np.ndarray:
        return np.append(inside(take) - need, np.iinfo(np.int64).max)

    while (gap := int(min(size, counts.sum()) - take.sum())) > 0:
        short = (surplus()[bucket] < 0).sum(axis=0)
        i = max(np.flatnonzero(take < counts), key=lambda i: (short[i], (bucket[:, i] < len(order)).sum(), counts[i] - take[i], -i))
        take[i] += min(gap, counts[i] - take[i], max(1, gap // 8))
    while (over := int(take.sum() - size)) > 0:
        least = surplus()[bucket].min(axis=0)
        j = max(np.flatnonzero(take > 0), key=lambda j: (least[j], take[j], -j))
        take[j] -= min(over, take[j], max(1, over // 8))
    for level in (floor, need):  # the minimum of small buckets comes before the shares
        stuck: set = set()
        while True:
            extra = surplus(level)
            open_ = [k for k in np.flatnonzero(extra < 0) if k not in stuck]
            if not open_:
                break
            k = min(open_, key=lambda k: (extra[k], k))
            gains = np.flatnonzero((bucket[order[k][0]] == k) & (take < counts))
            for i in sorted(gains, key=lambda i: (-(extra[bucket[:, i]] < 0).sum(), take[i] - counts[i], i)):
                # what a cell can give: its rows, down to the need of each of its buckets that doesn't get them back
                room = np.where(bucket == bucket[:, [i]], np.iinfo(np.int64).max, extra[bucket]).min(axis=0)
                room = np.where(bucket[order[k][0]] == k, 0, np.minimum(room, take))
                j = int(np.argmax(room))
                if room[j] > 0:
                    many = int(min(room[j], -extra[k], counts[i] - take[i]))
                    take[i] += many
                    take[j] -= many
                    break
            else:
                stuck.add(k)
    return Plan(weight, before, crossed, take, start)


#: A row's prefix sums before and after it, in UNITs, from its place in its cell: exact in 64 bits up to MAX_ROWS a cell.
_BEFORE = "_before + (seq - _first) * (_weight div _n) + ((seq - _first) * (_weight % _n)) div _n"
_AFTER = "_before + (seq - _first + 1) * (_weight div _n) + ((seq - _first + 1) * (_weight % _n)) div _n"


def chosen_rows(numbered: DataFrame, cells: DataFrame) -> DataFrame:
    """``numbered`` rows that a plan takes. Of each row the inclusion probabilities are summed up to it, across all
    partitions, by its number ``seq`` and the sum before its cell; rows in which the sum crosses a whole number from
    the random start on are chosen. Repairs drop a cell's last ones, or add the first rows that weren't chosen."""
    count = lambda prefix: f"(({prefix}) - _start + {UNIT}) div {UNIT}"
    rows = numbered.join(cells, [f"{d}_no" for d in DIMS]).filter("seq >= _first")
    rows = rows.withColumn("_hit", F.expr(f"{count(_AFTER)} > {count(_BEFORE)}")).withColumn("_nth", F.expr(f"{count(_AFTER)} - {count('_before')}"))
    taken = "(_hit AND _nth <= _take) OR (NOT _hit AND seq - _first + 1 - _nth <= _take - _crossed)"
    return rows.filter(taken).select("plan_id", "parent_asin", *DIMS)


def draw(products: DataFrame, targets: DataFrame, seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """(sample, report) of all plans.

    sample: plan_id, parent_asin and the bins as counted. report: for each target row plan_id, dim_name, bucket,
    need, available, selected (counted in the sample) and met. Products are ordered by cell (the combination of target
    buckets they count in) and, inside a cell, at random by a hash of their id; see chosen_rows. Only counts by cell
    reach the driver: their number is at most the product of the numbers of buckets, whatever the number of products.
    Null and blank bins are in no bucket; targets that can't all be met are reported, the sample then keeps its size
    as far as there are products. Empty tables give an empty sample, and a report in which nothing is available.
    """
    spark = products.sparkSession
    rows = targets.select("plan_id", "sample_permille", "dim_name", "bucket", normal("bucket").alias("norm"), "target_permille", "min_rows").distinct().take(MAX_TARGETS + 1)
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} target rows")
    known = {d: sorted({r.norm for r in rows if r.dim_name == d and r.norm}) for d in DIMS}
    if np.prod([len(v) + 1.0 for v in known.values()]) > MAX_CELLS:
        raise ValueError(f"targets span more than {MAX_CELLS} cells")
    lookup = {d: spark.createDataFrame([(b, i) for i, b in enumerate(known[d])], f"{d} string, {d}_no int") for d in DIMS}
    placed = latest_products(products)
    for d in DIMS:
        placed = placed.join(F.broadcast(lookup[d]), d, "left")
    placed = placed.withColumns({f"{d}_no": F.coalesce(f"{d}_no", F.lit(-1)) for d in DIMS} | {"_hash": F.sha2(F.concat(F.lit(seed + ":"), "parent_asin"), 256)})
    nos = [f"{d}_no" for d in DIMS]
    numbered = cut(number_rows(placed, [*nos, "_hash", "parent_asin"]))
    cells = sorted(tuple(r) for r in numbered.groupBy(*nos).agg(F.count("*")).collect())
    keys = [tuple(known[d][c[k]] if c[k] >= 0 else None for k, d in enumerate(DIMS)) for c in cells]
    counts = np.array([c[3] for c in cells], dtype=np.int64)
    if len(counts) and counts.max() > MAX_ROWS:
        raise ValueError(f"more than {MAX_ROWS} products in a cell")
    firsts = np.concatenate([[0], np.cumsum(counts)])[:-1] if cells else counts
    by_dim = [{b: i for i, b in enumerate(known[d])} for d in DIMS]
    available = [np.bincount([c[k] + 1 for c in cells], counts, len(known[d]) + 1).astype(np.int64)[1:] if cells else np.zeros(len(known[d]), dtype=np.int64) for k, d in enumerate(DIMS)]
    picks, needs = [], []
    for plan in sorted({r.plan_id for r in rows if r.plan_id is not None}):
        own = sorted((r for r in rows if r.plan_id == plan), key=lambda r: (r.dim_name or "", r.bucket or ""))
        size = int(counts.sum()) * (own[0].sample_permille or 0) // 1000
        need = {id(r): max(r.min_rows or 0, -(-size * (r.target_permille or 0) // 1000)) for r in own}
        wants = {(DIMS.index(r.dim_name), r.norm): (need[id(r)], r.target_permille or 0, r.min_rows or 0) for r in own if r.dim_name in DIMS and r.norm}
        p = plan_cells(counts, keys, size, wants, f"{seed}:{plan}")
        picks += [(plan, *cells[i][:3], *(int(x[i]) for x in (firsts, counts, p.weight, p.before, p.crossed, p.take)), p.start) for i in np.flatnonzero(p.take)]
        if len(picks) > MAX_CELLS:
            raise ValueError(f"the plans take rows of more than {MAX_CELLS} cells")
        for r in own:
            at = by_dim[DIMS.index(r.dim_name)].get(r.norm) if r.dim_name in DIMS else None
            needs.append((plan, r.dim_name, r.bucket, r.norm, need[id(r)], 0 if at is None else int(available[DIMS.index(r.dim_name)][at])))
    chosen = spark.createDataFrame(picks, "plan_id int, " + ", ".join(f"{n} int" for n in nos) + ", _first bigint, _n bigint, _weight bigint, _before bigint, _crossed bigint, _take bigint, _start bigint")
    sample = chosen_rows(numbered, F.broadcast(chosen) if len(picks) <= MOST_BROADCAST else chosen)
    told = spark.createDataFrame(needs, "plan_id int, dim_name string, bucket string, norm string, need bigint, available bigint")
    bins = F.explode(F.array(*[F.struct(F.lit(d).alias("dim_name"), F.col(d).alias("norm")) for d in DIMS])).alias("b")
    drawn = sample.select("plan_id", bins).groupBy("plan_id", "b.dim_name", "b.norm").agg(F.count("*").alias("_drawn"))
    report = told.join(drawn, ["plan_id", "dim_name", "norm"], "left").withColumn("selected", F.coalesce("_drawn", F.lit(0).cast("bigint")))
    report = report.select("plan_id", "dim_name", "bucket", "need", "available", "selected")
    return sample, report.withColumn("met", F.col("selected") >= F.col("need"))


def impossible(report: DataFrame) -> DataFrame:
    """(plan_id, dim_name, bucket) of the targets that no sample meets: short in it, and fewer products than the need."""
    return report.filter("NOT met AND available < need").select("plan_id", "dim_name", "bucket")
