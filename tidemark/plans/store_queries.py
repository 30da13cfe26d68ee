"""The conversation store's writes and checks: patches, deletions, guards, export and import, replay, transcripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.engine import table
from tidemark.operators import ledger, store
from tidemark.plans.catalog_queries import index
from tidemark.plans.dialogue_queries import _FEEDBACK, _LATEST, _SHOWN, latest

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


_SESSION = """session AS (SELECT lower(trim(session_id)) AS session_id, updated_at, created_at, name, archived, dirty, read_only_reason FROM sessions WHERE trim(session_id) <> ''
  QUALIFY row_number() OVER (PARTITION BY lower(trim(session_id)) ORDER BY updated_at DESC NULLS LAST, created_at DESC NULLS LAST, name DESC NULLS LAST, archived DESC NULLS LAST, dirty DESC NULLS LAST, read_only_reason DESC NULLS LAST) = 1)"""


def sessions(spark, sf_dir):
    return table(spark, sf_dir, "sessions")


@query(f"WITH {_SESSION} SELECT session_id, name, archived, epoch_us(created_at) AS created_us FROM session WHERE archived = 0")
def list_sessions(spark, sf_dir):
    rows = store.one_session(sessions(spark, sf_dir)).filter("archived = 0")
    created = F.unix_micros(F.col("created_at").cast("timestamp"))
    return rows.select("session_id", "name", "archived", created.alias("created_us")).orderBy("created_us", "session_id")


@query(f"WITH {_SESSION} SELECT session_id, name, CASE WHEN archived = 1 THEN 'archived' ELSE 'active' END AS status, coalesce(dirty, 0) = 1 AS dirty, read_only_reason IS NOT NULL AS read_only FROM session")
def session_status(spark, sf_dir):
    return store.status_of(sessions(spark, sf_dir)).drop("created_at")


@query("""SELECT lower(trim(session_id)) AS session_id, max({'t': updated_at, 'v': name}) FILTER (name IS NOT NULL).v AS name, max({'t': updated_at, 'v': archived}) FILTER (archived IS NOT NULL).v AS archived,
  max({'t': updated_at, 'v': agent_version}) FILTER (agent_version IS NOT NULL).v AS agent_version FROM sessions WHERE trim(session_id) <> '' GROUP BY 1""".replace("max({'t': updated_at, 'v': ", "(max({'t': updated_at, 'v': ").replace(" IS NOT NULL).v", " IS NOT NULL)).v"))
def session_patches(spark, sf_dir):
    rows = sessions(spark, sf_dir).withColumn("session_id", store.session_key()).filter("session_id <> ''")
    return store.patched(rows, "session_id", ["name", "archived", "agent_version"])


@query(f"WITH {_SESSION}, {_FEEDBACK} SELECT fb.session_id, turn, parent_asin, reason FROM fb LEFT JOIN (SELECT session_id, updated_at AS gone FROM session WHERE archived = 1) d USING (session_id) WHERE gone IS NULL OR fb.updated_at > gone")
def feedback_after_deletion(spark, sf_dir):
    archived = store.one_session(sessions(spark, sf_dir)).filter("archived = 1")
    none = F.lit(None)
    gone = archived.select("session_id", none.cast("int").alias("turn"), none.cast("string").alias("parent_asin"), F.col("updated_at").alias("deleted_at"))
    kept = store.after_deletions(store.latest_feedback(table(spark, sf_dir, "product_feedback")), gone)
    return kept.select("session_id", "turn", "parent_asin", "reason")


@query(f"""WITH {_SHOWN}, {_SESSION}, {_FEEDBACK} SELECT fb.session_id, fb.turn, fb.parent_asin, CASE WHEN s.session_id IS NULL THEN 'unknown session' WHEN archived = 1 THEN 'archived' WHEN read_only_reason IS NOT NULL THEN 'read only'
  WHEN NOT EXISTS (SELECT 1 FROM shown x WHERE x.session_id = fb.session_id AND x.turn = fb.turn AND x.parent_asin = fb.parent_asin) THEN 'not shown' ELSE 'accepted' END AS outcome FROM fb LEFT JOIN session s ON s.session_id = fb.session_id""")
def feedback_guard(spark, sf_dir):
    given = store.latest_feedback(table(spark, sf_dir, "product_feedback"))
    return store.guarded(given, sessions(spark, sf_dir), store.shown_products(latest(spark, sf_dir)))


#: Columns that the store's tables must have. Fixed values.
NEEDED = {
    "sessions": ("session_id", "name", "archived", "updated_at", "schema_version"),
    "turns": ("session_id", "turn", "request_id", "status", "user_message", "response_json"),
    "product_feedback": ("session_id", "turn", "parent_asin", "reason", "note"),
}


@query("SELECT 'sessions' AS table, count(*) AS rows, 'schema_version' AS missing FROM sessions UNION ALL SELECT 'turns', count(*), '' FROM turns UNION ALL SELECT 'product_feedback', count(*), '' FROM product_feedback")
def store_health(spark, sf_dir):
    return store.health({name: table(spark, sf_dir, name) for name in NEEDED}, NEEDED)


@query(f"""WITH {_LATEST}, p AS (SELECT session_id, count(*) AS n, min(turn) AS low, max(turn) AS high, bool_and(coalesce(trim(user_message) <> '', false)) AS said FROM latest GROUP BY 1)
SELECT session_id, 'count' AS problem FROM p WHERE n <> 4 UNION ALL SELECT session_id, 'order' FROM p WHERE low <> 1 OR high <> n UNION ALL SELECT session_id, 'message' FROM p WHERE NOT said""")
def transcript_check(spark, sf_dir):
    return store.transcript_problems(latest(spark, sf_dir))


@query()
def export_turns(spark, sf_dir):
    return store.export_turns(latest(spark, sf_dir))


@query(f"""WITH {_LATEST} SELECT session_id, turn, request_id, CASE WHEN turn NOT BETWEEN 1 AND 10 THEN 'turn' WHEN NOT coalesce(status IN ('pending', 'completed', 'failed'), false) THEN 'status' WHEN status = 'completed' AND response_json IS NULL THEN 'response' END AS problem FROM latest""")
def import_round_trip(spark, sf_dir):
    documents = store.export_turns(latest(spark, sf_dir)).select("document")
    return store.import_turns(documents).select("session_id", "turn", "request_id", "problem")


@query()
def replay_check(spark, sf_dir):
    done = store.completed_prefix(latest(spark, sf_dir))
    folded = ledger.fold(ledger.parsed_turns(done, index(spark, sf_dir).vocabulary))
    return store.replayed(done, folded)


@query("SELECT lower(trim(session_id)) AS session_id, turn, CASE WHEN turn IS NULL THEN 'no turn' WHEN turn < 1 THEN 'below 1' ELSE 'above 10' END AS problem, count(*) AS rows FROM turns WHERE trim(session_id) <> '' AND (turn IS NULL OR turn NOT BETWEEN 1 AND 10) GROUP BY ALL")
def ledger_rejects(spark, sf_dir):
    return ledger.rejected(table(spark, sf_dir, "turns"))
