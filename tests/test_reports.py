import pytest

from tidemark.operators import metrics, reports

SCHEMA = "session_id string, scenario string, hit boolean, first_hit_turn int, best_rank int, reciprocal_rank double"
ROWS = [("a", "x", True, 1, 1, 1.0), ("b", "x", False, None, None, 0.0), ("c", "y", True, 3, 2, 0.5)]


def report(df):
    return metrics.with_score(df.groupBy("scenario").agg(*metrics.summary()))


def test_verification(spark, rows):
    one = spark.createDataFrame(ROWS, SCHEMA)
    assert all(r.equal for r in reports.verified(report(one), one, "scenario").collect())
    other = spark.createDataFrame([*ROWS[:2], ("c", "y", True, 3, 4, 0.25), ("d", "z", True, 1, 1, 1.0)], SCHEMA)
    wrong = {(r.scenario, r.figure) for r in reports.verified(report(one), other, "scenario").filter("NOT equal").collect()}
    assert wrong == {("y", "mrr"), ("y", "score")} | {("z", f) for f in reports.RANGES}


def test_ranges(spark, rows):
    bad = spark.createDataFrame([("x", 0, 1.5, 0.2, float("nan"), None, 0.5), ("y", 3, 0.1, 0.4, 11.5, 0.0, 1.0)], "scenario string, sessions bigint, hit_rate double, mrr double, mttc double, efficiency double, score double")
    assert rows(reports.out_of_range(bad, "scenario")) == sorted([("x", "sessions", "range"), ("x", "hit_rate", "range"), ("x", "mttc", "not finite"), ("x", "efficiency", "missing"), ("y", "mttc", "range"), ("y", "mrr", "above hit rate")], key=repr)


def test_weighted_groups_give_the_whole(spark):
    one = spark.createDataFrame(ROWS, SCHEMA)
    assert all(r.equal for r in reports.uneven(report(one), one.agg(*metrics.summary())).collect())
    assert not all(r.equal for r in reports.uneven(report(one), one.limit(2).agg(*metrics.summary())).collect())


def test_sample_sets(spark, rows):
    a, b = spark.createDataFrame([("p",), ("p",), ("q",)], "k string"), spark.createDataFrame([("p",), ("r",)], "k string")
    assert rows(reports.set_difference(a, b, "k")) == [("p", "first only"), ("q", "first only"), ("r", "second only")]


@pytest.mark.parametrize(("gates", "accepted", "failures"), [({"a": [True], "b": [True, True]}, True, ""), ({"a": [True], "b": [True, None], "c": []}, False, "b, c")])
def test_acceptance(spark, gates, accepted, failures):
    frames = {name: spark.createDataFrame([(v,) for v in values], "passed boolean") for name, values in gates.items()}
    row = reports.accepted(frames).first()
    assert (row.accepted, row.failures) == (accepted, failures)
