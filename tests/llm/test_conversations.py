import json
import random
from datetime import datetime, timedelta

from tidemark.llm import conversations as cv

SCHEMA = "session_id string, turn int, request_id string, status string, user_message string, response_json string, created_at timestamp, updated_at timestamp, reply string, ok string"
T = datetime(2024, 1, 1)


def turn(session, n, status="completed", said="hi", response='{"message": "yes"}', at=0):
    return (session, n, "r", status, said, response, T, None if at is None else T + timedelta(seconds=at), "clash", "clash")


def dropped(spark, data):
    return {r.session_id for r in cv.broken_sessions(spark.createDataFrame(data, SCHEMA)).collect()}


def test_cases(spark):
    data = [
        turn("ok", 1), turn(" OK ", 2, " Completed"), turn("dup", 1), turn("dup", 1), turn("late", 1, "failed"), turn("late", 1, at=5), turn("gap", 1), turn("gap", 3), turn("null", 1), turn("null", None), turn("zero", 0), turn("zero", 1), turn("start", 2),
        turn("blank", 1, said="\u200b \u00a0"), turn("none", 1, said=None), turn("noreply", 1, response=None), turn("cut", 1, response='{"message": "a'), turn("list", 1, response='["message"]'), turn("number", 1, response='{"message": 5}'), turn("empty", 1, response='{"message": " "}'),
        turn("tail", 1, response='{"message": "a"} x'), turn("two", 1, response='{"message": "a"},{"message": "b"}'), turn("pending", 1, "pending"), turn("nostatus", 1, None), turn("worse", 1), turn("worse", 1, "failed", at=9), turn(None, 1), turn("  ", 1), turn("undated", 1, at=None), turn("undated", 1, "failed"),
        *[turn("ten", i) for i in range(1, 11)], *[turn("eleven", i) for i in range(1, 12)], *[turn("hot", i % 3 - 1) for i in range(3000)], turn("spaces", 1, response=' \n{"message": "a"}\n '),
    ]
    assert dropped(spark, data) == {"gap", "null", "zero", "start", "blank", "none", "noreply", "cut", "list", "number", "empty", "tail", "two", "pending", "nostatus", "worse", "undated", "eleven", "hot"}
    kept = cv.conversations(spark.createDataFrame(data, SCHEMA)).filter("session_id IN ('ok', 'late')").collect()
    assert sorted((r.session_id, r.seq, r.role, r.content) for r in kept) == [("late", 1, "user", "hi"), ("late", 2, "agent", "yes"), ("ok", 1, "user", "hi"), ("ok", 2, "agent", "yes"), ("ok", 3, "user", "hi"), ("ok", 4, "agent", "yes")]


def test_against_brute_force(spark):
    rng, data = random.Random(1), []
    for s in range(300):
        for n in range(1, rng.randrange(2, 7)):
            for _ in range(rng.choice([1, 1, 1, 2])):
                data.append(turn(f"s{s}", rng.choice([n] * 12 + [None, n + 1]), rng.choice(["completed"] * 12 + ["failed"]), rng.choice(["a"] * 15 + [" "]), rng.choice(['{"message": "x"}'] * 15 + ["[]"]), rng.randrange(5)))
    by = {}
    for r in data:
        key = (r[0], r[1])
        order = (r[7], r[6], r[3], r[4], r[5])
        if key not in by or order > by[key][0]:
            by[key] = (order, r)
    wanted = set()
    for s in {r[0] for r in data}:
        own = {k[1]: v[1] for k, v in by.items() if k[0] == s}
        sound = None not in own and sorted(own) == list(range(1, len(own) + 1)) and all(r[3] == "completed" and r[4].strip() and r[5] != "[]" for r in own.values())
        wanted |= set() if sound else {s}
    assert dropped(spark, data) == wanted


def test_empty_and_long(spark):
    assert dropped(spark, []) == set()
    assert dropped(spark, [turn("long", 1, said="a" * 3_000_000, response=json.dumps({"message": "b" * 3_000_000}))]) == set()
