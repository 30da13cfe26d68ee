"""Streams run to their end over the event and turn tables; the SQL is that of their batch twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.engine import shared_dir, table
from tidemark.operators import ledger
from tidemark.plans.catalog_queries import index
from tidemark.streaming import events

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def _us(*names):
    return [F.unix_micros(F.col(n)).alias(n) for n in names]


@query("SELECT DISTINCT event_id, user_id, event_type, value FROM events")
def stream_dedup(spark, sf_dir):
    return events.run_to_table(events.deduplicated(events.read(spark, sf_dir)).select("event_id", "user_id", "event_type", "value"), "append")


@query("SELECT epoch_us(time_bucket(INTERVAL 6 HOUR, ts)) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def stream_tumbling(spark, sf_dir):
    rows = events.run_to_table(events.counts(events.read(spark, sf_dir), "6 hours"), "update", ["start", "event_type"])
    return rows.select(*_us("start"), "event_type", "n", "value")


@query("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR * k) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events, (SELECT unnest(range(6)) AS k) GROUP BY ALL")
def stream_sliding(spark, sf_dir):
    rows = events.run_to_table(events.counts(events.read(spark, sf_dir), "6 hours", "1 hour"), "update", ["start", "event_type"])
    return rows.select(*_us("start"), "event_type", "n", "value")


@query("""WITH s AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 2 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM s)
SELECT user_id, epoch_us(min(ts)) AS start, epoch_us(max(ts) + INTERVAL 2 HOUR) AS end, count(*) AS n FROM g GROUP BY user_id, run""")
def stream_sessions(spark, sf_dir):
    rows = events.run_to_table(events.sessions(events.read(spark, sf_dir), "2 hours"), "complete", ["user_id", "start"])
    return rows.select("user_id", *_us("start", "end"), "n")


@query()
def stream_ledger(spark, sf_dir):
    words = index(spark, sf_dir).vocabulary
    parsed = ledger.parsed_turns(table(spark, sf_dir, "turns"), words)
    folder = f"{shared_dir(spark)}/turns-{uuid.uuid4().hex}"
    parsed.write.parquet(folder)
    return events.run_to_table(ledger.fold_stream(spark.readStream.schema(parsed.schema).parquet(folder)), "append")
