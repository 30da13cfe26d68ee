"""The conversation store as append-only tables: latest states, prefixes, feedback, integrity."""

from __future__ import annotations

import json
import re
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from tidemark.operators.catalog import with_ranks


def session_key(column="session_id"):
    return F.lower(F.trim(column))


def latest_turns(turns: DataFrame) -> DataFrame:
    """The row with the latest updated_at of each session and turn (then by created_at, status and request), with
    status trimmed in lower case; combined before the shuffle."""
    rows = turns.withColumn("session_id", session_key()).withColumn("status", F.lower(F.trim("status"))).filter("session_id <> '' AND turn IS NOT NULL")
    kept = [c for c in rows.columns if c not in ("session_id", "turn")]
    best = rows.groupBy("session_id", "turn").agg(F.max_by(F.struct(*kept), F.struct("updated_at", "created_at", "status", "request_id")).alias("r"))
    return best.select("session_id", "turn", "r.*")


def next_turns(latest: DataFrame, limit: int = 10) -> DataFrame:
    """(session_id, turns, next_turn, unresolved): null next_turn once ``limit`` is reached."""
    out = latest.groupBy("session_id").agg(F.count("*").alias("turns"), F.max("turn").alias("_m"), F.bool_or(F.coalesce(F.col("status") == "pending", F.lit(False))).alias("unresolved"))
    return out.select("session_id", "turns", F.when(F.col("_m") < limit, F.col("_m") + 1).alias("next_turn"), "unresolved")


def completed_prefix(latest: DataFrame) -> DataFrame:
    """The completed turns before the first one that isn't: as the first such turn's number, so that a session of any
    length is never put in order."""
    stop = latest.filter(~F.coalesce(F.col("status") == "completed", F.lit(False))).groupBy("session_id").agg(F.min("turn").alias("_stop"))
    return latest.join(stop, "session_id", "left").filter("status = 'completed' AND (_stop IS NULL OR turn < _stop)").drop("_stop")


def latest_feedback(feedback: DataFrame) -> DataFrame:
    """The latest row of each (session_id, turn, parent_asin), blank notes as null."""
    note = F.when(F.trim("note") != "", F.trim("note"))
    rows = feedback.withColumn("session_id", session_key()).withColumn("note", note).filter("session_id <> ''")
    best = rows.groupBy("session_id", "turn", "parent_asin").agg(F.max(F.struct("updated_at", "reason", "note")).alias("r"))
    return best.select("session_id", "turn", "parent_asin", "r.reason", "r.note", "r.updated_at")


def shown_products(latest: DataFrame) -> DataFrame:
    """(session_id, turn, rank, parent_asin) of the products in each turn's products_json."""
    ids = F.try_variant_get(F.try_parse_json("products_json"), "$", "array<string>")
    return latest.select("session_id", "turn", F.posexplode(ids).alias("rank", "parent_asin")).withColumn("rank", F.col("rank") + 1)


def feedback_in_order(feedback: DataFrame, shown: DataFrame, unknown: int = 1_000_000) -> DataFrame:
    """Feedback with the rank at which its product was shown (``unknown`` if it wasn't) and its place in that order."""
    best = shown.groupBy("session_id", "turn", "parent_asin").agg(F.min("rank").alias("rank"))
    joined = feedback.join(best, ["session_id", "turn", "parent_asin"], "left").withColumn("rank", F.coalesce("rank", F.lit(unknown)))
    return with_ranks(joined, ["session_id", "turn"], ["rank", "parent_asin"], "place")


def integrity(sessions: DataFrame, turns: DataFrame, feedback: DataFrame) -> DataFrame:
    """(problem, rows): broken keys, references and values, in one row each."""
    known = sessions.select(session_key().alias("session_id")).distinct()
    t = turns.withColumn("session_id", session_key())
    f = feedback.withColumn("session_id", session_key())
    counted = [
        t.join(known, "session_id", "left_anti").agg(F.lit("turn without session").alias("problem"), F.count("*").alias("rows")),
        f.join(known, "session_id", "left_anti").agg(F.lit("feedback without session").alias("problem"), F.count("*").alias("rows")),
        t.filter("turn IS NULL OR turn NOT BETWEEN 1 AND 10").agg(F.lit("turn number").alias("problem"), F.count("*").alias("rows")),
        t.filter(F.col("response_json").isNotNull() & F.try_parse_json("response_json").isNull()).agg(F.lit("unreadable response").alias("problem"), F.count("*").alias("rows")),
        t.filter("updated_at < created_at").agg(F.lit("updated before created").alias("problem"), F.count("*").alias("rows")),
        sessions.groupBy(session_key().alias("k")).agg(F.count("*").alias("n")).filter("n > 1").agg(F.lit("repeated session").alias("problem"), F.count("*").alias("rows")),
        t.filter("request_id IS NOT NULL").groupBy("request_id").agg(F.countDistinct("session_id", "turn").alias("n")).filter("n > 1").agg(F.lit("repeated request").alias("problem"), F.count("*").alias("rows")),
    ]
    out = counted[0]
    for c in counted[1:]:
        out = out.unionByName(c)
    return out


def gaps(latest: DataFrame) -> DataFrame:
    """(session_id, turn, previous) where a session's turns don't follow each other."""
    before = F.lag("turn").over(Window.partitionBy("session_id").orderBy("turn"))
    return latest.select("session_id", "turn", before.alias("previous")).filter("turn <> coalesce(previous, 0) + 1")


def recent_messages(latest: DataFrame, n: int = 4) -> DataFrame:
    """(session_id, turn, messages): the last ``n`` messages up to each turn, joined by bars."""
    w = Window.partitionBy("session_id").orderBy("turn").rowsBetween(-(n - 1), 0)
    return latest.select("session_id", "turn", F.array_join(F.collect_list("user_message").over(w), " | ").alias("messages"))


def identities(sessions: DataFrame) -> DataFrame:
    """(session_id, agent_version, same_catalog, same_config, same_assets): each session against the one it was cloned
    from, nulls being equal."""
    rows = sessions.withColumn("session_id", session_key()).withColumn("source", session_key("source_session_id"))
    cols = ["agent_version", "catalog_sha256", "config_sha256", "assets_sha256"]
    one = rows.groupBy("session_id").agg(F.max(F.struct("updated_at", "source", *cols)).alias("r")).select("session_id", "r.*")
    other = one.select(F.col("session_id").alias("source"), *[F.col(c).alias(f"_{c}") for c in cols])
    joined = one.filter("source IS NOT NULL").join(other, "source")
    return joined.select("session_id", "agent_version", *[F.col(c).eqNullSafe(F.col(f"_{c}")).alias(n) for c, n in zip(cols[1:], ("same_catalog", "same_config", "same_assets"), strict=True)])


def one_session(sessions: DataFrame) -> DataFrame:
    """The latest row of each session, by updated_at, then by its other values; blank ids are left out."""
    rows = sessions.withColumn("session_id", session_key()).filter("session_id <> ''")
    kept = ("updated_at", "created_at", "name", "archived", "dirty", "read_only_reason")
    return rows.groupBy("session_id").agg(F.max(F.struct(*kept)).alias("r")).select("session_id", "r.*")


def status_of(sessions: DataFrame) -> DataFrame:
    """(session_id, name, status, dirty, read_only, created_at) of the latest rows: active or archived."""
    status = F.when(F.col("archived") == 1, "archived").otherwise("active")
    return one_session(sessions).select("session_id", "name", status.alias("status"), (F.coalesce("dirty", F.lit(0)) == 1).alias("dirty"), F.col("read_only_reason").isNotNull().alias("read_only"), "created_at")


def patched(rows: DataFrame, key: str, fields: list, at: str = "updated_at") -> DataFrame:
    """One row for each ``key`` with the latest value of each field that isn't null: a patch is a row that sets some
    fields and leaves the others null. Of values equal in time the larger counts."""
    newest = [F.max(F.when(F.col(f).isNotNull(), F.struct(F.col(at), F.col(f).alias("v")))).alias(f) for f in fields]
    return rows.groupBy(key).agg(*newest).select(key, *[F.col(f"{f}.v").alias(f) for f in fields])


def after_deletions(feedback: DataFrame, deletions: DataFrame) -> DataFrame:
    """Feedback that no deletion took away. ``deletions`` (session_id, turn, parent_asin, deleted_at) are tombstones: a
    null turn or product means all of them; what is given again later than the deletion stays."""
    whole = deletions.filter("turn IS NULL AND parent_asin IS NULL").groupBy("session_id").agg(F.max("deleted_at").alias("_all"))
    turn = deletions.filter("turn IS NOT NULL AND parent_asin IS NULL").groupBy("session_id", "turn").agg(F.max("deleted_at").alias("_turn"))
    one = deletions.filter("parent_asin IS NOT NULL").groupBy("session_id", "turn", "parent_asin").agg(F.max("deleted_at").alias("_one"))
    out = feedback.join(whole, "session_id", "left").join(turn, ["session_id", "turn"], "left").join(one, ["session_id", "turn", "parent_asin"], "left")
    gone = F.greatest("_all", "_turn", "_one")
    return out.filter(gone.isNull() | (F.col("updated_at") > gone)).drop("_all", "_turn", "_one")


def guarded(feedback: DataFrame, sessions: DataFrame, shown: DataFrame) -> DataFrame:
    """(session_id, turn, parent_asin, outcome) of each feedback row before it is appended: accepted, or why not
    (unknown session, archived, read only, not shown)."""
    known = status_of(sessions).select("session_id", "status", "read_only")
    seen = shown.select("session_id", "turn", "parent_asin").distinct().withColumn("_seen", F.lit(True))
    joined = feedback.join(known, "session_id", "left").join(seen, ["session_id", "turn", "parent_asin"], "left")
    outcome = F.when(F.col("status").isNull(), "unknown session").when(F.col("status") == "archived", "archived").when(F.col("read_only"), "read only")
    return joined.select("session_id", "turn", "parent_asin", outcome.when(F.col("_seen").isNull(), "not shown").otherwise("accepted").alias("outcome"))


def health(tables: dict[str, DataFrame], needed: dict[str, tuple]) -> DataFrame:
    """(table, rows, missing): the number of rows of each table, and the needed columns that it lacks, in order."""
    parts = [df.agg(F.lit(name).alias("table"), F.count("*").alias("rows"), F.lit(", ".join(c for c in needed[name] if c not in df.columns)).alias("missing")) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def transcript_problems(latest: DataFrame, turns: int = 4) -> DataFrame:
    """(session_id, problem) of sessions that are no transcript of ``turns`` turns: count (another number of turns),
    order (numbers aren't 1 to that number), message (a blank one)."""
    said = F.coalesce(F.trim("user_message") != "", F.lit(False))
    per = latest.groupBy("session_id").agg(F.count("*").alias("n"), F.min("turn").alias("low"), F.max("turn").alias("high"), F.bool_and(said).alias("said"))
    found = F.array_compact(F.array(F.when(F.col("n") != turns, "count"), F.when((F.col("low") != 1) | (F.col("high") != F.col("n")), "order"), F.when(~F.col("said"), "message")))
    return per.select("session_id", F.explode(found).alias("problem"))


# Member names that an export leaves out, and texts that it blanks.
SENSITIVE = "(?i)(api_?key|token|secret|password|authorization|cookie)"
REDACTED = r"(?:[A-Za-z]:\\|/(?:home|Users|root|tmp|var|etc)/)[^\s\"',]*|\b[\w-]+\.(?:local|internal|lan)\b|\bTraceback \(most recent call last\)[^\"]*"
#: Deepest JSON that is walked; what lies deeper is left out of an export.
MAX_DEPTH = 64


def _clean(value, depth: int = 0):
    """A JSON value without sensitive members at any depth and without what REDACTED means in its texts."""
    if depth > MAX_DEPTH:
        return None
    if isinstance(value, dict):
        return {k: _clean(v, depth + 1) for k, v in value.items() if not re.search(SENSITIVE, k)}
    if isinstance(value, list):
        return [_clean(v, depth + 1) for v in value]
    return re.sub(REDACTED, "[redacted]", value) if isinstance(value, str) else value


@pandas_udf(T.StringType())
def cleaned_json(texts: pd.Series) -> pd.Series:
    """JSON texts without sensitive members and texts, members sorted, numbers that aren't finite as null; a text that is
    no JSON comes out as a JSON text, redacted; null stays null."""

    def one(text):
        if text is None:
            return None
        try:
            value = json.loads(text, parse_constant=lambda _: None)
        except (ValueError, RecursionError):
            value = text
        return json.dumps(_clean(value), sort_keys=True, ensure_ascii=False)

    return texts.map(one, na_action="ignore")


def export_turns(latest: DataFrame) -> DataFrame:
    """(session_id, turn, document): the turn as a JSON document, version 1: its message, response, shown products and
    error without sensitive members at any depth, and without paths, host names and stack traces."""
    clean = lambda c: F.regexp_replace(c, REDACTED, "[redacted]")
    parts = [clean("user_message").alias("user_message"), *[cleaned_json(c).alias(n) for c, n in (("response_json", "response"), ("products_json", "products"), ("error_json", "error"))]]
    body = F.struct(F.lit(1).alias("version"), "session_id", "turn", "request_id", "status", *parts)
    return latest.select("session_id", "turn", F.to_json(body).alias("document"))


DOCUMENT = "version int, session_id string, turn int, request_id string, status string, user_message string, response string, products string, error string"
# What a turn can be.
STATUSES = ("pending", "completed", "failed")


def import_turns(documents: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """(session_id, turn, request_id, status, user_message, response, products, error, problem) of exported documents
    (document), one row for each; problem is null for what may be appended, else the first of: unreadable, version,
    session (blank, or one of ``sessions`` already), turn (not 1 to 10), status, response (a completed turn without a
    readable one), repeated (another document of the same turn comes before it)."""
    d = F.from_json("document", DOCUMENT, {"mode": "PERMISSIVE"})
    rows = documents.select("document", d.alias("d")).select("document", "d.*")
    have = sessions.select(session_key().alias("session_id"), F.lit(True).alias("_have")).distinct() if sessions is not None else None
    rows = rows.join(have, "session_id", "left") if have is not None else rows.withColumn("_have", F.lit(None).cast("boolean"))
    unreadable = F.try_parse_json("document").isNull() | ~F.coalesce(F.schema_of_variant(F.try_parse_json("document")).startswith("OBJECT"), F.lit(False))
    problem = F.when(unreadable, "unreadable").when(~F.coalesce(F.col("version") == 1, F.lit(False)), "version")
    problem = problem.when(F.coalesce(F.trim("session_id") == "", F.lit(True)) | F.col("_have").isNotNull(), "session")
    problem = problem.when(~F.coalesce(F.col("turn").between(1, 10), F.lit(False)), "turn").when(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), "status")
    problem = problem.when((F.col("status") == "completed") & F.try_parse_json("response").isNull(), "response")
    first = F.row_number().over(Window.partitionBy("session_id", "turn").orderBy("document"))
    out = rows.withColumn("problem", problem).withColumn("_n", F.when(F.col("problem").isNull(), first))
    # documents without a problem have one of ten turns of a session: a group is as large as a turn's repeats
    problem = F.coalesce("problem", F.when(F.col("_n") > 1, "repeated"))
    return out.select("session_id", "turn", "request_id", "status", "user_message", "response", "products", "error", problem.alias("problem"))


def replayed(stored: DataFrame, folded: DataFrame) -> DataFrame:
    """(session_id, turn, stored, replayed, equal): the intent version that each completed turn's state holds against the
    one that the ledger comes to when the session's messages are replayed from a reset. ``folded`` (session_id, turn,
    intent_version)."""
    kept = stored.select("session_id", "turn", F.try_variant_get(F.try_parse_json("state_json"), "$.intent_version", "int").alias("stored")).filter("stored IS NOT NULL")
    both = kept.join(folded.select("session_id", "turn", F.col("intent_version").alias("replayed")), ["session_id", "turn"], "left")
    return both.withColumn("equal", F.col("stored").eqNullSafe(F.col("replayed")))
