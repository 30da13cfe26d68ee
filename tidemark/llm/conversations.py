"""Conversations rebuilt from turn rows, with a finite-state automaton that finds those to drop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.engine import UNSEEN, trimmed

MAX_TURN = 10

#: States of the automaton after a turn: the number of the turn expected next, or BROKEN for good.
BROKEN = 0


def is_blank(column) -> Column:
    """Null, empty or only white space or invisible characters."""
    return F.coalesce(F.regexp_replace(column, f"{UNSEEN}+", "") == "", F.lit(True))


def reply_of(column) -> Column:
    """Text member ``message`` of a text that is one JSON object, else null (no JSON, text after it, another type)."""
    wrapped = F.try_parse_json(F.concat(F.lit("["), column, F.lit("]")))
    kind = F.schema_of_variant(F.try_variant_get(wrapped, "$[0].message", "variant"))
    alone = F.try_variant_get(wrapped, "$[1]", "variant").isNull()
    return F.when(alone & (kind == "STRING"), F.try_variant_get(wrapped, "$[0].message", "string"))


def counting_turns(turns: DataFrame) -> DataFrame:
    """One row for each session and turn number that could belong to a whole conversation, the row with the latest
    updated_at, and one for all others of a session (turn null, the rest null): session_id, turn, user_message,
    reply, ok.

    The latest row is found by a max over structs, so rows of one key are combined before the shuffle however many
    they are; a session never has more than MAX_TURN + 1 rows after it. Equal updated_at: the larger row by
    created_at, then by its texts.
    """
    rows = turns.select(F.lower(trimmed("session_id")).alias("session_id"), F.when(F.col("turn").between(1, MAX_TURN), F.col("turn")).alias("turn"), "updated_at", "created_at", "status", "user_message", "response_json").filter("session_id <> ''")
    content = [F.when(F.col("turn").isNotNull(), F.col(c)).alias(c) for c in ("updated_at", "created_at", "status", "user_message", "response_json")]
    latest = rows.groupBy("session_id", "turn").agg(F.max(F.struct(*content)).alias("r"))
    reply = reply_of(F.col("r.response_json"))
    ok = (F.lower(trimmed(F.col("r.status"))) == "completed") & ~is_blank(F.col("r.user_message")) & ~is_blank(F.col("reply"))
    return latest.withColumn("reply", reply).select("session_id", "turn", F.col("r.user_message").alias("user_message"), "reply", F.coalesce(ok, F.lit(False)).alias("ok"))


def run_automaton(turns: DataFrame, *payload: str) -> DataFrame:
    """One row for each session: ``turns`` sorted by number (array of structs turn, ok and ``payload``) and ``state``,
    that of the automaton after the last turn. It starts at 1; at state n a sound turn n leads to n + 1; anything
    else, a turn without number among it, leads to BROKEN."""
    gathered = turns.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("turn", "ok", *payload))).alias("turns"))
    step = lambda state, t: F.when((state != BROKEN) & t["ok"] & (t["turn"].eqNullSafe(state)), state + 1).otherwise(F.lit(BROKEN))
    return gathered.withColumn("state", F.aggregate("turns", F.lit(1), step))


def broken_sessions(turns: DataFrame) -> DataFrame:
    """(session_id) of the sessions to drop, trimmed and in lower case.

    A null or blank session_id names no session. A session is kept only if its counting rows have exactly the
    numbers 1 to k, k at most MAX_TURN, each with a text of the user, status completed and a JSON reply with a text.
    Repeated rows count once; extra columns are ignored; an empty table gives none.
    """
    return run_automaton(counting_turns(turns).select("session_id", "turn", "ok")).filter(F.col("state") == BROKEN).select("session_id")


def conversations(turns: DataFrame) -> DataFrame:
    """The messages of the sessions that are kept: session_id, seq (from 1), role (user or agent), content."""
    whole = run_automaton(counting_turns(turns), "user_message", "reply").filter(F.col("state") != BROKEN)
    each = whole.select("session_id", F.explode("turns").alias("t"))
    messages = F.explode(F.array(
        F.struct((F.col("t.turn") * 2 - 1).alias("seq"), F.lit("user").alias("role"), F.col("t.user_message").alias("content")),
        F.struct((F.col("t.turn") * 2).alias("seq"), F.lit("agent").alias("role"), F.col("t.reply").alias("content")),
    ))
    return each.select("session_id", messages.alias("m")).select("session_id", "m.*")
