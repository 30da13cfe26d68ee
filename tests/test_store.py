import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.operators import ledger, store

T0 = datetime(2025, 1, 1)
TURNS = "session_id string, turn int, request_id string, status string, user_message string, response_json string, products_json string, error_json string, state_json string, created_at timestamp, updated_at timestamp"


def turn(session, n, status="completed", message="hello", response='{"message": "hi"}', error=None, minutes=0, state=None):
    at = T0 + timedelta(minutes=minutes)
    return (session, n, f"r{n}", status, message, response, '["A"]', error, state, at, at)


def test_export_drops_sensitive_members_at_any_depth(spark):
    error = json.dumps({"API_Key": "x", "inner": [{"password": "y", "path": "/home/me/secret.txt", "n": float("nan")}], "kept": 1})
    latest = spark.createDataFrame([turn("a", 1, error=error, message="see C:\\tmp\\x"), turn("a", 2, response="no json", error=None)], TURNS)
    documents = [json.loads(r.document) for r in store.export_turns(latest).orderBy("turn").collect()]
    assert json.loads(documents[0]["error"]) == {"inner": [{"n": None, "path": "[redacted]"}], "kept": 1}
    assert documents[0]["user_message"] == "see [redacted]" and json.loads(documents[1]["response"]) == "no json"
    assert store.export_turns(latest.limit(0)).count() == 0


def test_export_and_import_round_trip(spark):
    latest = spark.createDataFrame([turn("a", 1), turn("a", 2), turn("b", 11), turn("c", 1, status="odd"), turn("d", 1, response=None), turn("e", 1, status="pending", response=None)], TURNS)
    documents = store.export_turns(latest).select("document")
    got = {(r.session_id, r.turn): r.problem for r in store.import_turns(documents).collect()}
    assert got == {("a", 1): None, ("a", 2): None, ("b", 11): "turn", ("c", 1): "status", ("d", 1): "response", ("e", 1): None}
    again = store.import_turns(documents.unionByName(documents)).groupBy("problem").count().collect()
    assert {r.problem: r["count"] for r in again}["repeated"] == 3
    bad = spark.createDataFrame([("no json",), (None,), ("[1]",), ('{"version": 2, "session_id": "a", "turn": 1}',), ('{"version": 1, "session_id": " ", "turn": 1}',)], "document string")
    assert sorted(r.problem for r in store.import_turns(bad).collect()) == ["session", "unreadable", "unreadable", "unreadable", "version"]
    known = spark.createDataFrame([(" A ",)], "session_id string")
    assert {r.problem for r in store.import_turns(documents, known).filter("session_id = 'a'").collect()} == {"session"}


def test_patches_and_status(spark, rows):
    schema = "session_id string, name string, archived int, dirty int, read_only_reason string, created_at timestamp, updated_at timestamp"
    data = [("S ", "one", 0, 0, None, T0, T0), ("s", None, 1, None, None, T0, T0 + timedelta(1)), ("t", "two", 0, 1, "import", T0, T0), (None, "x", 0, 0, None, T0, T0), (" ", "x", 0, 0, None, T0, T0)]
    df = spark.createDataFrame(data, schema)
    assert rows(store.status_of(df), "session_id", "status", "dirty", "read_only") == [("s", "archived", False, False), ("t", "active", True, True)]
    patched = store.patched(df.withColumn("session_id", store.session_key()).filter("session_id <> ''"), "session_id", ["name", "archived"])
    assert rows(patched) == [("s", "one", 1), ("t", "two", 0)]
    assert store.status_of(df.limit(0)).count() == 0


def test_deletions(spark, rows):
    feedback = spark.createDataFrame([("s", 1, "A", T0), ("s", 1, "B", T0), ("s", 2, "A", T0), ("s", 2, "B", T0 + timedelta(2)), ("t", 1, "A", T0)], "session_id string, turn int, parent_asin string, updated_at timestamp")
    gone = lambda *d: spark.createDataFrame(list(d), "session_id string, turn int, parent_asin string, deleted_at timestamp")
    left = lambda *d: rows(store.after_deletions(feedback, gone(*d)), "session_id", "turn", "parent_asin")
    assert left(("s", None, None, T0 + timedelta(1))) == [("s", 2, "B"), ("t", 1, "A")]
    assert left(("s", 1, None, T0)) == [("s", 2, "A"), ("s", 2, "B"), ("t", 1, "A")]
    assert ("s", 1, "A") not in left(("s", 1, "A", T0)) and len(left(("s", 1, "A", T0 - timedelta(1)))) == 5


def test_guards(spark, rows):
    sessions = spark.createDataFrame([("a", "n", 0, 0, None, T0, T0), ("b", "n", 1, 0, None, T0, T0), ("c", "n", 0, 0, "import", T0, T0)], "session_id string, name string, archived int, dirty int, read_only_reason string, created_at timestamp, updated_at timestamp")
    feedback = spark.createDataFrame([("a", 1, "A"), ("a", 1, "Z"), ("b", 1, "A"), ("c", 1, "A"), ("x", 1, "A")], "session_id string, turn int, parent_asin string")
    shown = spark.createDataFrame([("a", 1, 1, "A"), ("a", 1, 2, "A")], "session_id string, turn int, rank int, parent_asin string")
    assert rows(store.guarded(feedback, sessions, shown), "session_id", "parent_asin", "outcome") == [("a", "A", "accepted"), ("a", "Z", "not shown"), ("b", "A", "archived"), ("c", "A", "read only"), ("x", "A", "unknown session")]


def test_transcripts_and_rejects(spark, rows):
    latest = spark.createDataFrame([turn("good", n) for n in (1, 2, 3, 4)] + [turn("short", 1), turn("gap", 1), turn("gap", 2), turn("gap", 3), turn("gap", 5), turn("mute", 1, message=" "), *[turn("mute", n) for n in (2, 3, 4)]], TURNS)
    assert rows(store.transcript_problems(latest)) == [("gap", "order"), ("mute", "message"), ("short", "count")]
    odd = spark.createDataFrame([turn("A ", 11), turn("a", 11), turn("a", 0), turn("a", None), turn("a", 3), turn(None, 12)], TURNS)
    assert rows(ledger.rejected(odd), "turn", "problem", "rows") == sorted([(11, "above 10", 2), (0, "below 1", 1), (None, "no turn", 1)], key=repr)


def test_replay(spark, rows):
    stored = spark.createDataFrame([turn("a", 1, state='{"intent_version": 1}'), turn("a", 2, state='{"intent_version": 3}'), turn("a", 3, state="bad")], TURNS)
    folded = spark.createDataFrame([("a", 1, 1), ("a", 2, 2)], "session_id string, turn int, intent_version int")
    assert rows(store.replayed(stored, folded)) == [("a", 1, 1, 1, True), ("a", 2, 3, 2, False)]


def test_health(spark, rows):
    got = store.health({"t": spark.range(3).select(F.col("id").alias("a"))}, {"t": ("a", "b")})
    assert rows(got) == [("t", 3, "b")]
