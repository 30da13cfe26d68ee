from types import SimpleNamespace

import pytest

from tidemark import engine
from tidemark.operators import catalog as cat


def test_number_rows(spark):
    data = [(i % 7, f"k{i:04d}") for i in range(1000)]
    for n in (1, 5):
        got = engine.number_rows(spark.createDataFrame(data, "a int, k string").repartition(n), ["a", "k"]).collect()
        assert [(r.a, r.k) for r in sorted(got, key=lambda r: r.seq)] == sorted(data)
        assert sorted(r.seq for r in got) == list(range(1000))
    assert engine.number_rows(spark.createDataFrame([], "a int, k string"), ["a", "k"]).count() == 0


def test_lookup_skewed(spark, rows):
    left = spark.createDataFrame([("hot", i) for i in range(500)] + [("a", 1), (None, 2), ("z", 3)], "k string, v int")
    book = spark.createDataFrame([("hot", 500, 1.0), ("a", 1, 2.0)], "k string, n int, w double")
    found = engine.lookup_skewed(left, book, ["k"], "n", ["w"], share=2)
    assert found.columns == ["k", "v", "w"]
    assert rows(found.filter("k IS NULL OR k <> 'hot'")) == sorted([("a", 1, 2.0), (None, 2, None), ("z", 3, None)], key=repr)
    assert found.filter("w = 1.0").count() == 500


def test_ranks_in_groups(spark):
    data = [("hot", f"{i:05d}") for i in range(3000)] + [("b", "x"), (None, "y")]
    got = engine.rank_in_groups(spark.createDataFrame(data, "g string, k string").repartition(6), ["g"], ["k"], "r")
    assert [r.k for r in sorted(got.filter("g = 'hot'").collect(), key=lambda r: r.r)] == [k for g, k in data if g == "hot"]
    assert sorted((r.g or "", r.r) for r in got.filter("g IS NULL OR g <> 'hot'").collect()) == [("", 1), ("b", 1)]


def test_shared_dir_is_the_sessions(spark):
    assert engine.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_no_local_folder_on_a_cluster():
    conf = SimpleNamespace(get=lambda *_: None)
    context = SimpleNamespace(master="spark://host:7077", getConf=lambda: conf, getCheckpointDir=lambda: None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        engine.shared_dir(SimpleNamespace(sparkContext=context, conf=conf))


def test_trimmed_takes_any_white_space(spark):
    df = spark.createDataFrame([(" \t x y　 ",), (None,), (" ",)], "t string")
    assert [r[0] for r in df.select(engine.trimmed("t")).collect()] == ["x y", None, ""]


def test_latest_wins(spark, rows):
    schema = "parent_asin string, loaded_at timestamp, price double, average_rating double, rating_number bigint, title string"
    from datetime import datetime

    data = [("a", datetime(2024, 1, 1), 1.0, None, 1, "old"), ("a", datetime(2024, 1, 2), 2.0, 3.0, 2, "new"), ("a", datetime(2024, 1, 2), 2.0, 3.0, 2, "new"), ("b", None, None, None, None, None), (None, None, None, None, None, "x")]
    assert rows(cat.latest(spark.createDataFrame(data, schema)), "parent_asin", "title") == [("a", "new"), ("b", None)]
