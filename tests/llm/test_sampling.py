from datetime import datetime, timedelta

import numpy as np
import pytest

from tidemark.llm import quota_sample as qs
from tidemark.llm import stable_sample as ss

START = datetime(2024, 1, 1)
SCHEMA = "parent_asin string, loaded_at timestamp, category string, price_bin string, popularity_bin string, seq string"
TARGETS = "plan_id int, sample_permille int, dim_name string, bucket string, target_permille int, min_rows int"


def products(spark, n=2500):
    data = [(f" P{i}" if i % 3 else f"p{i}\u00a0", START + timedelta(minutes=i // 2), ["A", "B", "c "][i % 10 % 3], f"q{i % 4}", None if i % 11 == 0 else f"q{i % 2}", "x") for i in range(n)]
    return spark.createDataFrame(data, SCHEMA)


def ids(df):
    return {r.parent_asin for r in df.select("parent_asin").collect()}


def test_same_sample_whatever_the_partitions(spark):
    data = products(spark)
    first = ids(ss.stable_sample(data))
    assert first == ids(ss.stable_sample(data.unionByName(data).repartition(7)))
    assert 200 <= len(first) <= 300
    full = ss.stable_sample(data).filter("seq < 2000").count()
    assert full == 200


@pytest.mark.parametrize("minutes", [0, 1, 100, 777, 1249])
def test_chosen_ones_stay(spark, minutes):
    data = products(spark)
    early = data.filter(data.loaded_at <= START + timedelta(minutes=minutes))
    assert ids(ss.stable_sample(early)) <= ids(ss.stable_sample(data))


def test_sample_edges(spark):
    odd = spark.createDataFrame([(None, START, None, None, None, ""), ("  ", START, None, None, None, ""), ("X", None, None, None, None, "")], SCHEMA)
    assert ss.numbered_products(odd).count() == 1
    assert ss.stable_sample(odd.limit(0)).count() == 0
    assert ids(ss.stable_sample(products(spark))) == ids(ss.stable_sample(products(spark).unionByName(odd)))


def test_positions_are_a_fair_choice():
    counts = sum(ss.chosen_positions(b, 50, 5, "s").astype(int) for b in range(400))
    assert counts.sum() == 2000 and counts.min() > 10 and counts.max() < 80


def targets(spark, rows):
    return spark.createDataFrame(rows, TARGETS)


def test_shares_minimum_and_report(spark):
    rows = [(1, 200, "category", "a", 500, 3), (1, 200, "category", "B", 300, 3), (1, 200, "category", "C", 190, 3), (1, 200, "category", "none", 10, 3), (1, 200, "price_bin", "q0", 250, 1), (1, 200, "price_bin", "q1", 250, 1), (1, 200, "price_bin", "Q2 ", 250, 1), (1, 200, "price_bin", "q3", 250, 1)]
    data = products(spark)
    sample, report = qs.draw(data.unionByName(data), targets(spark, rows))
    got = sample.collect()
    assert len(got) == 500 and len({r.parent_asin for r in got}) == 500
    told = {r.bucket: r for r in report.collect()}
    assert told["none"].available == 0 and not told["none"].met
    for bucket, share in (("a", 250), ("B", 150), ("C", 95), ("q0", 125), ("q1", 125), ("Q2 ", 125), ("q3", 125)):
        assert abs(told[bucket].selected - share) <= 6, bucket
        assert told[bucket].selected == sum((r.category if bucket in "aBC" else r.price_bin) == bucket.strip().lower() for r in got)
    assert [tuple(r) for r in qs.impossible(report).collect()] == [(1, "category", "none")]
    again = {r.parent_asin for r in qs.draw(data.repartition(9), targets(spark, rows))[0].collect()}
    assert again == {r.parent_asin for r in got}


def test_small_bucket_keeps_its_minimum(spark):
    data = spark.createDataFrame([(f"p{i}", START, "rare" if i < 12 else "big", "q1", "q1", "") for i in range(2000)], SCHEMA)
    rows = [(1, 50, "category", "rare", 0, 10), (1, 50, "category", "big", 1000, 1)]
    sample, report = qs.draw(data, targets(spark, rows))
    assert sample.count() == 100 and sample.filter("category = 'rare'").count() == 10
    assert {r.bucket: r.met for r in report.collect()} == {"rare": True, "big": False}


def test_quota_edges(spark):
    rows = [(1, 100, "category", "a", 1000, 2), (2, 0, "category", "a", 1000, 0)]
    sample, report = qs.draw(products(spark).limit(0), targets(spark, rows))
    assert sample.count() == 0 and [r.available for r in report.collect()] == [0, 0]
    sample, report = qs.draw(products(spark, 50), targets(spark, []))
    assert sample.count() == 0 and report.count() == 0


def test_plan_never_takes_more_than_there_is():
    rng = np.random.default_rng(3)
    for _ in range(30):
        keys = [(a, b, None) for a in "xyz" for b in ("p", "q", None)]
        counts = rng.integers(0, 40, len(keys))
        wants = {(0, a): (int(rng.integers(0, 30)), int(rng.integers(0, 500)), 1) for a in "xyz"} | {(1, b): (5, 500, 5) for b in "pq"}
        size = int(rng.integers(0, 120))
        take = qs.plan_cells(counts, keys, size, wants, "s").take
        assert (take >= 0).all() and (take <= counts).all() and take.sum() == min(size, counts.sum())


def test_rows_are_those_where_the_prefix_sum_crosses(spark):
    rng = np.random.default_rng(11)
    counts = np.array([1, 7, 40, 200, 3], dtype=np.int64)
    weight = (rng.random(5) * counts * qs.UNIT).astype(np.int64)
    weight[1] = 7 * qs.UNIT  # certain
    before, start = np.cumsum(weight) - weight, 123_456
    crossed = qs.crossings(before + weight, start) - qs.crossings(before, start)
    firsts = np.cumsum(counts) - counts
    cells = [(1, i, 0, 0, int(firsts[i]), int(counts[i]), int(weight[i]), int(before[i]), int(crossed[i]), int(crossed[i]), start) for i in range(5)]
    schema = "plan_id int, category_no int, price_bin_no int, popularity_bin_no int, _first bigint, _n bigint, _weight bigint, _before bigint, _crossed bigint, _take bigint, _start bigint"
    rows = [(s, f"p{s}", int(np.searchsorted(firsts, s, "right") - 1), 0, 0, "", "", "") for s in range(int(counts.sum()))]
    numbered = spark.createDataFrame(rows, "seq bigint, parent_asin string, category_no int, price_bin_no int, popularity_bin_no int, category string, price_bin string, popularity_bin string")
    total, wanted = 0, []
    for i in range(5):  # row by row
        for k in range(counts[i]):
            old, total = total, before[i] + (k + 1) * (weight[i] // counts[i]) + (k + 1) * (weight[i] % counts[i]) // counts[i]
            wanted += [f"p{firsts[i] + k}"] * int(qs.crossings(total, start) - qs.crossings(old, start))
    draw = lambda cells: sorted(r.parent_asin for r in qs.chosen_rows(numbered.repartition(5), spark.createDataFrame(cells, schema)).collect())
    assert draw(cells) == sorted(wanted) and len(set(wanted)) == len(wanted) == crossed.sum()
    for change in (3, -3):
        moved = [(*c[:9], c[9] + (change if c[1] == 3 else 0), c[10]) for c in cells]
        assert len(draw(moved)) == crossed.sum() + change


def test_many_targets_need_memory_by_cells():
    keys = [(f"c{i}", f"q{i % 7}", None) for i in range(20_000)]
    counts = np.full(len(keys), 5, dtype=np.int64)
    bucket = np.array([np.arange(20_000), np.full(20_000, 20_000), np.full(20_000, 20_000)])
    expected = qs.fitted(counts, bucket, 1000, np.full(20_000, 0.05), np.zeros(20_000, dtype=int))
    assert abs(expected.sum() - 1000) < 1e-6 and np.allclose(expected, 0.05)
    assert len(keys) == len(expected)
