import hashlib
import json

import pytest

from tidemark.operators import catalog as cat
from tidemark.operators import ledger, parsing
from tidemark.sources import files
from tidemark.streaming import events


def test_catalog_lines(spark, tmp_path, rows):
    lines = [json.dumps({"parent_asin": "A", "title": "old"}), "", json.dumps({"parent_asin": "B", "price": 2.5, "details": {"x": "y"}, "features": ["f"]}), json.dumps({"parent_asin": "A", "title": "new"}), json.dumps({"title": "no id"}), "{broken"]
    (tmp_path / "c.jsonl").write_text("\n".join(lines))
    assert rows(files.read_catalog(spark, str(tmp_path / "c.jsonl")), "parent_asin", "title", "price") == [("A", "new", None), ("B", None, 2.5)]
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        files.read_catalog(spark, str(tmp_path / "c.jsonl"), strict=True).collect()


def test_manifest(spark, tmp_path, rows):
    (tmp_path / "d" / "sub").mkdir(parents=True)
    (tmp_path / "d" / "a.bin").write_bytes(b"one")
    (tmp_path / "d" / "sub" / "b.bin").write_bytes(b"two")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    expected = spark.createDataFrame([("a.bin", sha(b"one").upper()), ("sub/b.bin", sha(b"other")), ("c.bin", sha(b"x")), ("../up", sha(b"x"))], "name string, sha256 string")
    found = files.checksums(spark, str(tmp_path / "d"))
    assert rows(found, "name", "bytes") == [("a.bin", 3), ("sub/b.bin", 3)]
    assert rows(files.verify(expected, found)) == [("../up", "outside"), ("a.bin", "ok"), ("c.bin", "missing"), ("sub/b.bin", "mismatch")]


def test_writes(spark, tmp_path):
    path = str(tmp_path / "t")
    files.write_new(spark.range(3), path)
    with pytest.raises(Exception, match="(?i)exist"):
        files.write_new(spark.range(3), path)
    files.replace(spark.read.parquet(path).union(spark.range(5)), path)
    assert spark.read.parquet(path).count() == 8
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_content_hash(spark):
    df = spark.createDataFrame([(i, None if i % 3 else "x") for i in range(50)], "a int, b string")
    one, two = (files.content_hash(d, ["b", "a"]).first() for d in (df, df.repartition(7)))
    assert one == two and one.hash != files.content_hash(df.limit(49), ["a", "b"]).first().hash
    assert files.content_hash(df.limit(0), ["a", "b"]).first().rows == 0


def test_stream_against_batch(spark, sf, rows):
    stream = events.run_to_table(events.counts(events.read(spark, sf), "1 day"), "update", ["start", "event_type"])
    batch = spark.read.parquet(f"{sf}/events.parquet")
    assert stream.agg({"n": "sum"}).first()[0] == batch.count()


def test_ledger_stream_against_batch(spark, tmp_path, rows):
    products = spark.createDataFrame([("A", "Red boots", None, None, 1.0, ["Boots"], None, 1.0, 1.0, "S")], files.PRODUCT)
    words = parsing.vocabulary(cat.postings(cat.attributes(products)))
    turns = spark.createDataFrame([(f"s{i % 3}", i // 3 + 1, m, None) for i, m in enumerate(["red", "blue boots", "I need boots under $50", "actually I need cotton boots", "no preference", "or red", "show me more", "green", "budget 20"])], "session_id string, turn int, user_message string, updated_at timestamp")
    parsed = ledger.parsed_turns(turns, words)
    parsed.write.parquet(str(tmp_path / "p"))
    streamed = events.run_to_table(ledger.fold_stream(spark.readStream.schema(parsed.schema).parquet(str(tmp_path / "p"))), "append")
    assert rows(streamed) == rows(ledger.fold(parsed))
