"""Messages, ledgers and the conversation store."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.engine import table
from tidemark.functions import messages
from tidemark.operators import catalog as cat
from tidemark.operators import ledger, parsing, respond, simulate, store
from tidemark.plans import sql
from tidemark.plans.catalog_queries import index

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def _q(pattern: str) -> str:
    return "'(?i)" + pattern.replace("'", "''") + "'"


_MESSAGES = f"msg AS (SELECT DISTINCT user_message AS message, {sql.normal('user_message')} AS m FROM turns WHERE user_message IS NOT NULL)"


def texts(spark, sf_dir):
    return table(spark, sf_dir, "turns").filter("user_message IS NOT NULL").select(F.col("user_message").alias("message")).distinct()


@query(f"WITH {_MESSAGES} SELECT message, regexp_matches(m, {_q(messages.OVERRIDE)}) AS is_override, regexp_matches(m, {_q(messages.RESET)}) AS replaces_preferences, regexp_matches(m, {_q(messages.CONTINUATION)}) AS is_continuation, regexp_matches(m, {_q(messages.NO_PREFERENCE)}) AS no_preference, CASE WHEN regexp_matches(m, {_q(messages.BUYING)}) THEN 'buying' WHEN regexp_matches(m, {_q(messages.BROWSING)}) THEN 'browsing' END AS route_hint FROM msg")
def parse_flags(spark, sf_dir):
    return texts(spark, sf_dir).select("message", *[c.alias(n) for n, c in messages.flags(F.col("message")).items()])


_FLOORS = sql.quoted(messages.FLOOR_WORDS)


@query(f"""WITH {_MESSAGES}, r AS (SELECT message, m, regexp_replace(m, {_q(messages.BETWEEN)}, ' | ', 'g') AS m2 FROM msg), d AS (SELECT *, regexp_replace(m2, {_q(messages.DIRECTION)}, ' | ', 'g') AS m3 FROM r),
b AS (SELECT message, 'between' AS operator, unnest(regexp_extract_all(m, {_q(messages.BETWEEN)})) AS s FROM r), g AS (SELECT message, unnest(regexp_extract_all(m2, {_q(messages.DIRECTION)})) AS s FROM d), p AS (SELECT message, unnest(regexp_extract_all(m3, {_q(messages.PLAIN)})) AS s FROM d)
SELECT DISTINCT message, operator, printf('%.2f', CAST(regexp_extract(s, {_q(messages.BETWEEN)}, 1) AS DOUBLE)) AS value, printf('%.2f', CAST(regexp_extract(s, {_q(messages.BETWEEN)}, 2) AS DOUBLE)) AS upper_value FROM b
UNION SELECT message, CASE WHEN lower(regexp_extract(s, {_q(messages.DIRECTION)}, 1)) IN ({_FLOORS}) THEN 'gte' ELSE 'lte' END, printf('%.2f', CAST(regexp_extract(s, {_q(messages.DIRECTION)}, 2) AS DOUBLE)), NULL FROM g
UNION SELECT message, 'lte', printf('%.2f', CAST(regexp_extract(s, {_q(messages.PLAIN)}, 1) AS DOUBLE)), NULL FROM p""")
def parse_budget(spark, sf_dir):
    return texts(spark, sf_dir).select("message", F.explode(messages.budgets(F.col("message"))).alias("b")).select("message", "b.*").distinct()


_MENTION = " ".join(rf"WHEN regexp_matches(m, '\b{a.replace('_', ' ')}\b') THEN '{a}'" for a in messages.ATTRIBUTES)


@query(f"WITH {_MESSAGES} SELECT message, CASE {_MENTION} END AS attribute FROM msg")
def parse_mentioned_attribute(spark, sf_dir):
    return texts(spark, sf_dir).select("message", messages.mentioned_attribute(F.col("message")).alias("attribute"))


@query()
def parse_category_and_payload(spark, sf_dir):
    return texts(spark, sf_dir).select("message", messages.named_category(F.col("message")).alias("category"), messages.override_payload(F.col("message")).alias("payload"))


def words(spark, sf_dir):
    return index(spark, sf_dir).vocabulary


@query()
def parse_constraints(spark, sf_dir):
    rows = texts(spark, sf_dir).withColumn("message_id", F.xxhash64("message"))
    return parsing.constraints(rows, words(spark, sf_dir)).join(rows, "message_id").drop("message_id")


@query()
def parse_vocabulary(spark, sf_dir):
    return words(spark, sf_dir)


@query()
def ledger_fold(spark, sf_dir):
    return ledger.fold(ledger.parsed_turns(table(spark, sf_dir, "turns"), words(spark, sf_dir)), ledger.profile_tags(table(spark, sf_dir, "sessions")))


@query()
def respond_turns(spark, sf_dir):
    return respond.respond(table(spark, sf_dir, "turns"), index(spark, sf_dir))


@query()
def simulate_sessions(spark, sf_dir):
    feedback = store.latest_feedback(table(spark, sf_dir, "product_feedback"))
    labels = feedback.groupBy("session_id").agg(F.min("parent_asin").alias("target"))
    return simulate.run(labels, index(spark, sf_dir))


_LATEST = """latest AS (SELECT * REPLACE (lower(trim(session_id)) AS session_id, lower(trim(status)) AS status) FROM turns WHERE trim(session_id) <> '' AND turn IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY lower(trim(session_id)), turn ORDER BY updated_at DESC NULLS LAST, created_at DESC NULLS LAST, lower(trim(status)) DESC NULLS LAST, request_id DESC NULLS LAST) = 1)"""


def latest(spark, sf_dir):
    return store.latest_turns(table(spark, sf_dir, "turns"))


@query(f"WITH {_LATEST} SELECT session_id, turn, request_id, status FROM latest")
def latest_state_view(spark, sf_dir):
    return latest(spark, sf_dir).select("session_id", "turn", "request_id", "status")


@query(f"WITH {_LATEST} SELECT session_id, count(*) AS turns, CASE WHEN max(turn) < 10 THEN max(turn) + 1 END AS next_turn, bool_or(coalesce(status = 'pending', false)) AS unresolved FROM latest GROUP BY 1")
def next_turns(spark, sf_dir):
    return store.next_turns(latest(spark, sf_dir))


@query(f"WITH {_LATEST} SELECT session_id, turn FROM latest l WHERE status = 'completed' AND NOT EXISTS (SELECT 1 FROM latest x WHERE x.session_id = l.session_id AND x.turn < l.turn AND coalesce(x.status, '') <> 'completed')")
def completed_prefix(spark, sf_dir):
    return store.completed_prefix(latest(spark, sf_dir)).select("session_id", "turn")


_FEEDBACK = """fb AS (SELECT lower(trim(session_id)) AS session_id, turn, parent_asin, reason, CASE WHEN trim(note) <> '' THEN trim(note) END AS note, updated_at FROM product_feedback WHERE trim(session_id) <> ''
  QUALIFY row_number() OVER (PARTITION BY lower(trim(session_id)), turn, parent_asin ORDER BY updated_at DESC NULLS LAST, reason DESC NULLS LAST, CASE WHEN trim(note) <> '' THEN trim(note) END DESC NULLS LAST) = 1)"""


@query(f"WITH {_FEEDBACK} SELECT session_id, turn, parent_asin, reason, note FROM fb")
def feedback_latest(spark, sf_dir):
    return store.latest_feedback(table(spark, sf_dir, "product_feedback")).drop("updated_at")


_SHOWN = f"""{_LATEST}, shown AS (SELECT session_id, turn, unnest(range(1, CAST(json_array_length(products_json) AS BIGINT) + 1)) AS rank, unnest(from_json(products_json, '["VARCHAR"]')) AS parent_asin FROM latest WHERE json_valid(products_json) AND json_type(products_json) = 'ARRAY')"""


@query(f"WITH {_SHOWN}, {_FEEDBACK} SELECT session_id, turn, parent_asin, CAST(coalesce(r, 1000000) AS INT) AS rank, row_number() OVER (PARTITION BY session_id, turn ORDER BY coalesce(r, 1000000), parent_asin) AS place FROM fb LEFT JOIN (SELECT session_id, turn, parent_asin, min(rank) AS r FROM shown GROUP BY ALL) USING (session_id, turn, parent_asin)")
def feedback_rank_order(spark, sf_dir):
    found = store.feedback_in_order(store.latest_feedback(table(spark, sf_dir, "product_feedback")), store.shown_products(latest(spark, sf_dir)))
    return found.select("session_id", "turn", "parent_asin", "rank", "place")


@query("""SELECT 'turn without session' AS problem, count(*) AS rows FROM turns WHERE lower(trim(session_id)) NOT IN (SELECT lower(trim(session_id)) FROM sessions WHERE session_id IS NOT NULL)
UNION ALL SELECT 'feedback without session', count(*) FROM product_feedback WHERE lower(trim(session_id)) NOT IN (SELECT lower(trim(session_id)) FROM sessions WHERE session_id IS NOT NULL)
UNION ALL SELECT 'turn number', count(*) FROM turns WHERE turn IS NULL OR turn NOT BETWEEN 1 AND 10 UNION ALL SELECT 'unreadable response', count(*) FROM turns WHERE response_json IS NOT NULL AND NOT json_valid(response_json)
UNION ALL SELECT 'updated before created', count(*) FROM turns WHERE updated_at < created_at UNION ALL SELECT 'repeated session', count(*) FROM (SELECT lower(trim(session_id)) FROM sessions GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'repeated request', count(*) FROM (SELECT request_id FROM (SELECT DISTINCT request_id, lower(trim(session_id)) AS s, turn FROM turns WHERE request_id IS NOT NULL AND session_id IS NOT NULL AND turn IS NOT NULL) GROUP BY 1 HAVING count(*) > 1)""")
def store_integrity(spark, sf_dir):
    return store.integrity(table(spark, sf_dir, "sessions"), table(spark, sf_dir, "turns"), table(spark, sf_dir, "product_feedback"))


@query(f"WITH {_LATEST}, g AS (SELECT session_id, turn, lag(turn) OVER (PARTITION BY session_id ORDER BY turn) AS previous FROM latest) SELECT * FROM g WHERE turn <> coalesce(previous, 0) + 1")
def turn_gaps(spark, sf_dir):
    return store.gaps(latest(spark, sf_dir))


@query(f"WITH {_LATEST} SELECT session_id, turn, coalesce(array_to_string(list(user_message) FILTER (user_message IS NOT NULL) OVER (PARTITION BY session_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), ' | '), '') AS messages FROM latest")
def last4_messages(spark, sf_dir):
    return store.recent_messages(latest(spark, sf_dir))


_ONE = """one AS (SELECT lower(trim(session_id)) AS session_id, lower(trim(source_session_id)) AS source, agent_version, catalog_sha256, config_sha256, assets_sha256 FROM sessions
  QUALIFY row_number() OVER (PARTITION BY lower(trim(session_id)) ORDER BY updated_at DESC NULLS LAST, lower(trim(source_session_id)) DESC NULLS LAST, agent_version DESC NULLS LAST, catalog_sha256 DESC NULLS LAST, config_sha256 DESC NULLS LAST, assets_sha256 DESC NULLS LAST) = 1)"""


@query(f"WITH {_ONE} SELECT a.session_id, a.agent_version, a.catalog_sha256 IS NOT DISTINCT FROM b.catalog_sha256 AS same_catalog, a.config_sha256 IS NOT DISTINCT FROM b.config_sha256 AS same_config, a.assets_sha256 IS NOT DISTINCT FROM b.assets_sha256 AS same_assets FROM one a JOIN one b ON a.source = b.session_id")
def identity_comparison(spark, sf_dir):
    return store.identities(table(spark, sf_dir, "sessions"))


@query("SELECT session_id, turn, row_number() OVER (ORDER BY updated_at DESC NULLS LAST, session_id DESC, turn DESC, request_id DESC NULLS LAST) AS age FROM turns WHERE session_id IS NOT NULL AND turn IS NOT NULL QUALIFY age <= 5000")
def trace_ring(spark, sf_dir):
    recent = table(spark, sf_dir, "turns").filter("session_id IS NOT NULL AND turn IS NOT NULL").orderBy(F.desc_nulls_last("updated_at"), F.desc("session_id"), F.desc("turn"), F.desc_nulls_last("request_id")).limit(5000)
    return cat.with_ranks(recent, [], [F.desc_nulls_last("updated_at"), F.desc("session_id"), F.desc("turn"), F.desc_nulls_last("request_id")], "age").select("session_id", "turn", "age")
