"""Cards, documents, schedules, responses, gates and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.engine import broadcast_if_small, cut, number_rows, table
from tidemark.functions import cards, lookups, messages, text
from tidemark.operators import hybrid, metrics, policy, retrieval, sampling, simulate, store
from tidemark.plans import sql
from tidemark.plans.analytics_queries import _BINS, _DIMS, binned, traces
from tidemark.plans.catalog_queries import index, products
from tidemark.plans.dialogue_queries import _FEEDBACK, _MESSAGES, _SHOWN, _q, latest
from tidemark.plans.search_queries import _RANKED, _WORDS, heads
from tidemark.sources import files

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


_CLASSES = " ".join(f"WHEN regexp_matches(lower(value), '{p}') THEN '{a}'" for a, p in cards.CLASSES)


@query(f"WITH {sql.CAT}, v AS (SELECT DISTINCT unnest(features) AS value FROM cat) SELECT value, CASE {_CLASSES} ELSE 'feature' END AS attribute FROM v WHERE value IS NOT NULL")
def fn_classify_constraint(spark, sf_dir):
    values = products(spark, sf_dir).select(F.explode("features").alias("value")).filter("value IS NOT NULL").distinct()
    return values.withColumn("attribute", cards.classify(F.col("value")))


@query(f"""WITH {sql.CAT}, p AS (SELECT parent_asin, list_filter(list_transform(flatten(list_transform(list_filter(coalesce(categories, []), lambda v: v IS NOT NULL), lambda v: string_split(v, ','))), lambda x: trim(x)), lambda x: x <> '' AND lower(x) NOT IN ({sql.quoted(cards.ROOTS)})) AS k FROM cat)
SELECT parent_asin, CASE WHEN len(k) = 0 THEN 'clothing item' ELSE array_to_string(k[-2:], ' ') END AS category FROM p""")
def fn_coarse_category(spark, sf_dir):
    return products(spark, sf_dir).select("parent_asin", cards.coarse_category(F.col("categories")).alias("category"))


@query(f"""WITH {sql.CAT}, f AS (SELECT parent_asin, list_filter([{', '.join(f'trim({sql.FIELDS[x]})' for x in lookups.SEARCH_FIELDS)}], lambda x: x <> '') AS l FROM cat)
SELECT parent_asin, array_to_string(list_filter(list_transform(l, lambda x, i: substr(x, 1, greatest(0, 200 - coalesce(list_sum(list_transform(l[1:i - 1], lambda y: length(y))), 0))::BIGINT)), lambda x: x <> ''), ' | ') AS document FROM f""")
def fn_compact_document(spark, sf_dir):
    return products(spark, sf_dir).select("parent_asin", cards.compact_document(200).alias("document"))


@query()
def fn_intent_card(spark, sf_dir):
    return simulate.intent_cards(products(spark, sf_dir)).select("parent_asin", F.array_join(F.slice("card", 1, 2), " | ").alias("hard"), F.array_join(F.slice("card", 3, 2), " | ").alias("soft"))


@query("SELECT DISTINCT lower(trim(session_id)) AS session_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(from_json(profile_json -> '$.preference_tags', '[\"VARCHAR\"]'), lambda t: lower(trim(t))), lambda t: t <> '')))[1:4], '|') AS segment FROM sessions WHERE json_valid(profile_json) AND json_type(profile_json, '$.preference_tags') = 'ARRAY'")
def fn_profile_segment(spark, sf_dir):
    tags = F.try_variant_get(F.try_parse_json("profile_json"), "$.preference_tags", "array<string>")
    return table(spark, sf_dir, "sessions").filter(tags.isNotNull()).select(store.session_key().alias("session_id"), text.profile_segment(tags).alias("segment")).distinct()


@query(f"""WITH {sql.CAT}, f AS (SELECT parent_asin, price, CAST(trim(coalesce(title, '')) <> '' AS INT) + CAST(len(list_filter(coalesce(features, []), lambda x: trim(x) <> '')) > 0 AS INT) + CAST(len(list_filter(coalesce(map_values(details), []), lambda x: trim(x) <> '')) > 0 AS INT)
  + CAST(len(list_filter(coalesce(description, []), lambda x: trim(x) <> '')) > 0 AS INT) + CAST(len(list_filter(coalesce(categories, []), lambda x: trim(x) <> '')) > 0 AS INT) + CAST(trim(coalesce(store, '')) <> '' AS INT) AS n FROM cat)
SELECT parent_asin, n AS fields, CASE WHEN n <= 2 THEN '0-2' WHEN n <= 4 THEN '3-4' ELSE '5+' END AS completeness_bin, n <= 2 OR price IS NULL AS hard FROM f""")
def fn_completeness(spark, sf_dir):
    kinds = {"title": "text", "features": "array", "details": "map", "description": "array", "categories": "array", "store": "text"}
    n = sum((cards.has_content(F.col(c), k).cast("int") for c, k in kinds.items()), F.lit(0))
    rows = products(spark, sf_dir).select("parent_asin", "price", n.alias("fields"))
    return rows.select("parent_asin", "fields", F.when(F.col("fields") <= 2, "0-2").when(F.col("fields") <= 4, "3-4").otherwise("5+").alias("completeness_bin"), ((F.col("fields") <= 2) | F.col("price").isNull()).alias("hard"))


@query("""WITH l AS (SELECT *, lower(trim(session_id)) AS s FROM turns WHERE trim(session_id) <> '' AND turn IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lower(trim(session_id)), turn ORDER BY updated_at DESC NULLS LAST, created_at DESC NULLS LAST, lower(trim(status)) DESC NULLS LAST, request_id DESC NULLS LAST) = 1),
h AS (SELECT s, turn, list_filter(list_transform(list(user_message) FILTER (user_message IS NOT NULL) OVER (PARTITION BY s ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), lambda x: trim(x)), lambda x: x <> '') AS said, trim(coalesce(user_message, '')) AS now FROM l)
SELECT s AS session_id, turn, rtrim(substr(trim(array_to_string(coalesce(said, []) || CASE WHEN now <> '' AND NOT coalesce(list_contains(said, now), false) THEN [now] ELSE [] END, ' ')), 1, 512)) AS query FROM h""")
def fn_query_text(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("session_id").orderBy("turn").rowsBetween(-4, -1)
    rows = latest(spark, sf_dir).withColumn("history", F.collect_list("user_message").over(w))
    return rows.select("session_id", "turn", cards.query_text(F.col("history"), F.col("user_message"), F.array().cast("array<string>")).alias("query"))


@query(f"WITH {sql.CAT} SELECT parent_asin, sha256('{{\"parent_asin\":\"' || parent_asin || '\",\"store\":' || CASE WHEN store IS NULL THEN 'null' ELSE to_json(store)::VARCHAR END || '}}') AS hash FROM cat")
def fn_canonical_hash(spark, sf_dir):
    return products(spark, sf_dir).select("parent_asin", F.sha2(F.to_json(F.struct("parent_asin", "store"), {"ignoreNullFields": "false"}), 256).alias("hash"))


@query()
def table_content_hash(spark, sf_dir):
    return files.content_hash(products(spark, sf_dir), ["parent_asin", "title", "store", "price"])


@query(f"WITH {sql.CAT}, p AS (SELECT lower(trim(parent_asin)) AS id FROM proxy_products WHERE trim(parent_asin) <> '') SELECT lower(parent_asin) AS id, 'catalog only' AS side FROM cat WHERE lower(parent_asin) NOT IN (SELECT id FROM p) UNION SELECT id, 'proxy only' FROM p WHERE id NOT IN (SELECT lower(parent_asin) FROM cat)")
def set_disjointness(spark, sf_dir):
    a = products(spark, sf_dir).select(F.lower("parent_asin").alias("id")).distinct()
    b = table(spark, sf_dir, "proxy_products").select(F.lower(F.trim("parent_asin")).alias("id")).filter("id <> ''").distinct()
    return a.join(b, "id", "left_anti").withColumn("side", F.lit("catalog only")).unionByName(b.join(a, "id", "left_anti").withColumn("side", F.lit("proxy only")))


@query(f"WITH {sql.attribute_ctes()} SELECT DISTINCT parent_asin FROM posts WHERE attribute = 'color' AND parent_asin NOT IN (SELECT parent_asin FROM posts WHERE attribute = 'color' AND value IN ('black', 'white'))")
def set_present_minus_matched(spark, sf_dir):
    colors = index(spark, sf_dir).postings.filter("attribute = 'color'")
    return colors.select("parent_asin").distinct().join(colors.filter(F.col("value").isin("black", "white")).select("parent_asin"), "parent_asin", "left_anti")


@query(f"""{_RANKED}, {_WORDS}, h AS (SELECT * FROM head WHERE NOT relaxed),
g AS (SELECT query_id, count(*) AS n, max(CASE WHEN rank = 10 THEN score END) - max(CASE WHEN rank = 11 THEN score END) AS gap, max(score) - min(score) AS span FROM h GROUP BY 1),
s AS (SELECT x.query_id, count(*) AS similar_pairs FROM h x JOIN h y ON x.query_id = y.query_id AND x.rank < y.rank WHERE y.rank <= 10 AND len(list_intersect(x.t, y.t)) >= 0.6::DOUBLE * len(list_distinct(x.t || y.t)) AND len(list_distinct(x.t || y.t)) > 0 GROUP BY 1)
SELECT query_id, n >= 11 AND round(CASE WHEN span > 0 THEN abs(gap) / span ELSE 0 END, 9) <= 0.025 AND coalesce(similar_pairs, 0) >= 3 AS diverse FROM g LEFT JOIN s USING (query_id)""")
def mmr_gate(spark, sf_dir):
    return retrieval.mmr_gate(cut(heads(spark, sf_dir, hybrid.CANDIDATE_LIMIT)))


_SHARES = "(VALUES " + ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in cards.SCENARIOS.items()) + ") s(key, weight)"
_SCHEDULE = f"""t AS (SELECT parent_asin, category, row_number() OVER (ORDER BY sha256(concat('suite', chr(0), parent_asin)), parent_asin) AS place FROM binned),
n AS (SELECT count(*) AS total FROM t), x AS (SELECT key, weight * total AS x FROM {_SHARES}, n), b AS (SELECT key, x, floor(round(x, 9)) AS b FROM x),
c AS (SELECT key, CAST(b + CASE WHEN row_number() OVER (ORDER BY round(x - b, 9) DESC, key) <= (SELECT total FROM n) - sum(b) OVER () THEN 1 ELSE 0 END AS BIGINT) AS n FROM b),
slots AS (SELECT key AS scenario, unnest(range(n)) AS ordinal FROM c),
schedule AS (SELECT scenario, row_number() OVER (ORDER BY sha256(concat('schedule', chr(0), scenario || ':' || ordinal)), scenario, ordinal) AS place FROM slots)"""


def schedule(spark, n: int):
    """(scenario, place) for n sessions in exact shares, in hash order."""
    shares = spark.createDataFrame(list(cards.SCENARIOS.items()), "key string, weight double")
    slots = sampling.apportion(shares, n).select(F.col("key").alias("scenario"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("ordinal"))
    hashed = slots.withColumn("_h", text.stable_hash("schedule", F.concat("scenario", F.lit(":"), F.col("ordinal").cast("string"))))
    return number_rows(hashed, ["_h", "scenario", "ordinal"], "_at").select("scenario", (F.col("_at") + 1).alias("place"))


@query(f"{_BINS}, {_SCHEDULE} SELECT scenario, count(*) AS n, min(place) AS first FROM schedule GROUP BY 1")
def scenario_schedule(spark, sf_dir):
    return schedule(spark, binned(spark, sf_dir).count()).groupBy("scenario").agg(F.count("*").alias("n"), F.min("place").alias("first"))


_OPEN = " ".join(
    f"WHEN scenario = '{s}' AND variant = {i} THEN " + " || ".join([f"'{t.partition('{0}')[0]}'".replace("I'm", "I''m"), "category"] + [("'" + t.partition("{0}")[2].partition("{1}")[0].replace("'", "''") + "'")] + (["category", "'" + t.partition("{1}")[2] + "'"] if "{1}" in t else []))
    for s, ts in cards.OPENINGS.items()
    for i, t in enumerate(ts)
)


@query(f"{_BINS}, {_SCHEDULE}, m AS (SELECT parent_asin, scenario, category, CAST(('0x' || substr(sha256(concat('variant', chr(0), parent_asin)), 63, 2)) AS INT) % 4 AS variant FROM t JOIN schedule USING (place)) SELECT parent_asin, scenario, variant, CASE {_OPEN} ELSE 'I''m looking for ' || category || ', but I''m still exploring.' END AS message FROM m")
def suite_openings(spark, sf_dir):
    rows = binned(spark, sf_dir).select("parent_asin", "category")
    placed = number_rows(rows.withColumn("_h", text.stable_hash("suite", F.col("parent_asin"))), ["_h", "parent_asin"], "_at").withColumn("place", F.col("_at") + 1)
    joined = placed.join(schedule(spark, rows.count()), "place")
    variant = F.conv(F.substring(text.stable_hash("variant", F.col("parent_asin")), 63, 2), 16, 10).cast("int") % 4
    rows = joined.select("parent_asin", "scenario", "category", variant.alias("variant"))
    return rows.select("parent_asin", "scenario", "variant", cards.opening(F.col("scenario"), F.col("variant"), F.col("category"), F.col("category")).alias("message"))


@query(f"{_BINS}, difficulty AS (SELECT *, row_number() OVER (PARTITION BY price_bin, popularity_bin ORDER BY sha256(concat('fold', chr(0), parent_asin)), parent_asin) AS r FROM binned) SELECT parent_asin, (r - 1) % 5 + 1 AS fold FROM difficulty")
def proxy_folds(spark, sf_dir):
    return metrics.folds(binned(spark, sf_dir), _DIMS[1:], "parent_asin").select("parent_asin", F.col("fold").cast("bigint").alias("fold"))


_BASE_STOP = sql.quoted(cards.STOPWORDS)


@query(f"""WITH items AS (SELECT DISTINCT item_id AS query_id, unnest({sql.tokens('text')}) AS term FROM benchmark_items), q AS (SELECT * FROM items WHERE length(term) > 1 AND term NOT IN ({_BASE_STOP})), {sql.CAT},
w AS (SELECT DISTINCT parent_asin, unnest({sql.tokens(sql.SEARCH_TEXT)}) AS term FROM cat)
SELECT query_id, parent_asin, hits, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, parent_asin) AS rank FROM (SELECT query_id, parent_asin, count(*) AS hits FROM q JOIN w USING (term) GROUP BY ALL) QUALIFY rank <= 10""")
def starter_search(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark_items").select(F.col("item_id").alias("query_id"), F.explode(text.terms(F.col("text"))).alias("term"))
    asked = items.filter((F.length("term") > 1) & ~F.col("term").isin(*cards.STOPWORDS))
    hits = index(spark, sf_dir).of(asked).select("parent_asin", "term").join(broadcast_if_small(asked), "term").groupBy("query_id", "parent_asin").agg(F.count("*").alias("hits"))
    return retrieval.top_k(hits, ["query_id"], 10, F.col("hits").desc(), F.col("parent_asin")).select("query_id", "parent_asin", "hits", "rank")


@query("SELECT lower(trim(session_id)) AS session_id FROM turns WHERE trim(session_id) <> '' GROUP BY 1 ORDER BY sha256(concat('transcript', chr(0), lower(trim(session_id)))) LIMIT 200")
def transcript_sample(spark, sf_dir):
    ids = table(spark, sf_dir, "turns").select(store.session_key().alias("session_id")).filter("session_id <> ''").distinct()
    return ids.orderBy(text.stable_hash("transcript", F.col("session_id"))).limit(200)


@query(f"WITH {_SHOWN} SELECT session_id, sha256(string_agg(turn || ':' || rank || ':' || parent_asin, ',' ORDER BY turn, rank)) AS hash FROM shown WHERE turn BETWEEN 1 AND 10 GROUP BY 1")
def response_hash(spark, sf_dir):
    shown = store.shown_products(latest(spark, sf_dir)).filter("turn BETWEEN 1 AND 10")
    listed = shown.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("turn", "rank", "parent_asin"))).alias("l"))
    joined = F.array_join(F.transform("l", lambda x: F.concat_ws(":", x["turn"], x["rank"], x["parent_asin"])), ",")
    return listed.select("session_id", F.sha2(joined, 256).alias("hash"))


@query(f"""WITH {_SHOWN}, {sql.CAT}, fallback AS (SELECT parent_asin, row_number() OVER (ORDER BY parent_asin) AS r FROM cat QUALIFY r <= 10),
every AS (SELECT session_id, turn, parent_asin, 0 AS stage, rank FROM shown WHERE parent_asin IN (SELECT parent_asin FROM cat) UNION ALL SELECT session_id, turn, f.parent_asin, 1, r FROM latest, fallback f),
firsts AS (SELECT session_id, turn, parent_asin, min(stage * 1000000 + rank) AS f FROM every GROUP BY ALL)
SELECT session_id, turn, parent_asin, row_number() OVER (PARTITION BY session_id, turn ORDER BY f, parent_asin) AS rank FROM firsts QUALIFY rank <= 10""")
def response_fill(spark, sf_dir):
    turns = latest(spark, sf_dir)
    rows = products(spark, sf_dir).select("parent_asin")
    key = F.struct("session_id", "turn")
    shown = store.shown_products(turns).join(rows, "parent_asin", "left_semi").select(key.alias("query_id"), "parent_asin", "rank")
    first = [r.parent_asin for r in rows.orderBy("parent_asin").limit(10).collect()]
    spare = turns.select(key.alias("query_id"), F.posexplode(text.literals(first)).alias("rank", "parent_asin")).select("query_id", "parent_asin", (F.col("rank") + 1).alias("rank"))
    filled = retrieval.fill(shown, spare, spare.limit(0), 10)
    return filled.select("query_id.session_id", "query_id.turn", "parent_asin", "rank")


@query(f"WITH {_SHOWN}, {_FEEDBACK} SELECT s.session_id, s.turn, count(*) AS shown, count(fb.parent_asin) AS commented FROM (SELECT DISTINCT session_id, turn, parent_asin FROM shown) s LEFT JOIN fb USING (session_id, turn, parent_asin) GROUP BY ALL")
def feedback_coverage(spark, sf_dir):
    shown = store.shown_products(latest(spark, sf_dir)).select("session_id", "turn", "parent_asin").distinct()
    said = store.latest_feedback(table(spark, sf_dir, "product_feedback")).select("session_id", "turn", "parent_asin", F.lit(1).alias("_c"))
    return shown.join(said, ["session_id", "turn", "parent_asin"], "left").groupBy("session_id", "turn").agg(F.count("*").alias("shown"), F.count("_c").alias("commented"))


_TRIALS = "tr AS (SELECT turn AS trial, CAST(json_extract_string(trace_json, '$.elapsed_ms') AS DOUBLE) AS ms FROM turns WHERE json_valid(trace_json) AND turn BETWEEN 1 AND 5)"


@query(f"WITH {_TRIALS}, p AS (SELECT trial, quantile_disc(ms, 0.95) AS p95 FROM tr GROUP BY 1) SELECT (SELECT median(ms) FROM tr) AS p50, (SELECT max(ms) FROM tr) AS max, median(p95) AS p95, count(*) AS trials FROM p")
def benchmark_aggregate(spark, sf_dir):
    rows = traces(spark, sf_dir).filter("turn BETWEEN 1 AND 5 AND elapsed_ms IS NOT NULL")
    per = metrics.latency(rows, ["turn"]).agg(F.median("p95").alias("p95"), F.count("*").alias("trials"))
    pooled = rows.agg(F.median("elapsed_ms").alias("p50"), F.max("elapsed_ms").alias("max"))
    return pooled.crossJoin(per).select("p50", "max", "p95", "trials")  # one row each


@query(f"""WITH {_SHOWN}, h AS (SELECT session_id, turn, json_extract_string(response_json, '$.ask_attribute') AS question, CASE WHEN json_valid(products_json) AND json_type(products_json) = 'ARRAY' THEN CAST(json_array_length(products_json) AS BIGINT) ELSE 0 END AS n FROM latest WHERE json_valid(response_json))
SELECT session_id, turn, CASE WHEN question IS NULL AND n > 10 THEN 'open_probe' WHEN n BETWEEN 1 AND 10 THEN 'exploit' ELSE 'probe' END AS strategy FROM h""")
def strategy_choice(spark, sf_dir):
    v = F.try_parse_json("response_json")
    n = F.greatest(F.coalesce(F.size(F.try_variant_get(F.try_parse_json("products_json"), "$", "array<string>")), F.lit(0)), F.lit(0))
    rows = latest(spark, sf_dir).filter(v.isNotNull())
    return rows.select("session_id", "turn", cards.strategy(F.try_variant_get(v, "$.ask_attribute", "string"), n, F.lit(False)).alias("strategy"))


_SIZED = r"\bsize\b"


@query(f"""WITH {_MESSAGES}, w AS (SELECT message, m, {sql.tokens('message')} AS toks FROM msg),
c AS (SELECT message, m, len({sql.terms('message')}) AS n, len({sql.matches('toks', lookups.MATERIALS)}) AS materials, len({sql.matches('toks', lookups.COLORS)}) AS colors, regexp_matches(m, '{_SIZED}') AS sized,
  regexp_matches(m, {_q(messages.BETWEEN)}) OR regexp_matches(m, {_q(messages.DIRECTION)}) OR regexp_matches(m, {_q(messages.PLAIN)}) AS money FROM w)
SELECT message, CASE WHEN regexp_matches(m, {_q(messages.BUYING)}) THEN 'buying' WHEN regexp_matches(m, {_q(messages.BROWSING)}) THEN 'browsing'
  WHEN materials + colors + money::INT + money::INT + sized::INT + (materials > 0)::INT + least(n, 8) / 8 >= 1.25 THEN 'buying' ELSE 'browsing' END AS route FROM c""")
def route_decision(spark, sf_dir):
    """The route of each message on its own: its hint, else what it states by the fixed vocabularies."""
    rows = table(spark, sf_dir, "turns").filter("user_message IS NOT NULL").select(F.col("user_message").alias("message")).distinct()
    words = text.terms(F.col("message"))
    m = text.normalize_value(F.col("message"))
    count = lambda vocabulary: F.size(text.matches(words, vocabulary))
    money = F.size(messages.budgets(F.col("message"))) > 0
    hard = count(lookups.MATERIALS) + count(lookups.COLORS) + money.cast("int")
    hint = messages.flags(F.col("message"))["route_hint"]
    return rows.select("message", policy.route(hint, hard, money, m.rlike(_SIZED), count(lookups.MATERIALS) > 0, F.size(words), F.lit("browsing")).alias("route"))


@query("SELECT lower(trim(session_id)) AS session_id, turn FROM turns WHERE trim(session_id) <> '' AND regexp_matches(coalesce(trace_json, '') || coalesce(error_json, ''), '(?i)(api_?key|secret|password|authorization|cookie|traceback)')")
def sensitive_scan(spark, sf_dir):
    rows = table(spark, sf_dir, "turns").withColumn("_t", F.concat(F.coalesce("trace_json", F.lit("")), F.coalesce("error_json", F.lit(""))))
    found = files.sensitive(rows, "_t", "(?i)(api_?key|secret|password|authorization|cookie|traceback)")
    return found.select(store.session_key().alias("session_id"), "turn").filter("session_id <> ''")


@query(f"WITH {sql.CAT} SELECT parent_asin, CASE WHEN average_rating BETWEEN 0 AND 5 THEN 'ok' WHEN average_rating IS NULL THEN 'missing' ELSE 'range' END AS rating, CASE WHEN price IS NULL THEN 'missing' WHEN price > 0 THEN 'ok' ELSE 'range' END AS price FROM cat WHERE length(parent_asin) <> 10 OR price IS NULL OR price <= 0 OR average_rating IS NULL OR average_rating NOT BETWEEN 0 AND 5")
def input_validation(spark, sf_dir):
    rows = products(spark, sf_dir)
    bad = rows.filter("length(parent_asin) <> 10 OR price IS NULL OR price <= 0 OR average_rating IS NULL OR average_rating NOT BETWEEN 0 AND 5")
    rating = F.when(F.col("average_rating").between(0, 5), "ok").when(F.col("average_rating").isNull(), "missing").otherwise("range")
    price = F.when(F.col("price").isNull(), "missing").when(F.col("price") > 0, "ok").otherwise("range")
    return bad.select("parent_asin", rating.alias("rating"), price.alias("price"))


#: Fixed example statements: attribute, operator, value, upper value, alternatives, source, is_hard.
STATED = [("budget", "lte", "80.00", None, [], "message", True), ("budget", "between", "20.00", "50.00", [], "message", True), ("color", "in", "red", None, ["red", "blue"], "message", True), ("material", "not_in", "wool", None, ["wool"], "message", True), ("feature", "eq", "warm", None, [], "profile", False), ("style", "eq", "long coat", None, [], "clarification", False)]


@query("""SELECT * FROM (VALUES ('budget: at most $80.00', 'hard'), ('budget: between $20.00 and $50.00', 'hard'), ('color: one of red, blue', 'hard'), ('material: wool', 'excluded'), ('feature: warm', 'inferred'), ('style: long coat', 'stated')) t(said, role)""")
def fn_requirement_text(spark, sf_dir):
    rows = spark.createDataFrame(STATED, "attribute string, operator string, value string, upper string, alternatives array<string>, source string, is_hard boolean")
    return rows.select(cards.requirement(*[F.col(c) for c in ("attribute", "operator", "value", "upper", "alternatives")]).alias("said"), cards.role(F.col("operator"), F.col("source"), F.col("is_hard")).alias("role"))


@query(f"""WITH {sql.CAT}, t AS (SELECT parent_asin, {sql.terms("array_to_string(list_transform(coalesce(features, []), lambda f: coalesce(f, '')), ' ') || ' ' || coalesce(title, '')")} AS l FROM cat) SELECT parent_asin, array_to_string(l[1:12], ' ') AS query FROM t""")
def fn_evidence_query(spark, sf_dir):
    phrases = F.array(
        F.struct(F.lit(0.6).alias("weight"), F.lit(1).alias("place"), text.tokens(F.col("title")).alias("tokens")),
        F.struct(F.lit(1.0).alias("weight"), F.lit(0).alias("place"), text.tokens(text.flatten_array(F.col("features"))).alias("tokens")),
    )
    return products(spark, sf_dir).select("parent_asin", cards.evidence_query(phrases, 12).alias("query"))


@query(f"""WITH {sql.CAT}, v AS (SELECT DISTINCT e.value AS value FROM (SELECT unnest(map_entries(details)) AS e FROM cat)) SELECT value, length({sql.normal('value')}) BETWEEN 1 AND 80 AND len({sql.terms('value')}) BETWEEN 1 AND 8 AND NOT regexp_full_match({sql.normal('value')}, '[0-9 ]+') AND NOT regexp_matches(lower(value), 'https?://|www\\.') AS safe FROM v WHERE value IS NOT NULL""")
def fn_safe_value(spark, sf_dir):
    values = products(spark, sf_dir).select(F.explode("details").alias("name", "value")).filter("value IS NOT NULL").select("value").distinct()
    normal = text.normalize_value(F.col("value"))
    safe = F.length(normal).between(1, 80) & F.size(text.terms(F.col("value"))).between(1, 8) & ~normal.rlike("^[0-9 ]+$") & ~F.lower("value").rlike(r"https?://|www\.")
    return values.withColumn("safe", safe)


_RUNS = """tr AS (SELECT CASE WHEN turn % 2 = 1 THEN 'baseline' ELSE 'candidate' END AS run, CAST(json_extract_string(trace_json, '$.elapsed_ms') AS DOUBLE) AS ms FROM turns WHERE json_valid(trace_json) AND turn BETWEEN 1 AND 10),
m AS (SELECT run, median(ms) AS p50, quantile_disc(ms, 0.95) AS p95, max(ms) AS max FROM tr GROUP BY 1)"""


@query(f"WITH {_RUNS} SELECT round((c.p50 - b.p50) / b.p50, 6) AS p50_change, round((c.p95 - b.p95) / b.p95, 6) AS p95_change, c.p50 <= 1.05 * b.p50 AND c.p95 <= 1.05 * b.p95 AND c.max < 1500 AS passed FROM m b, m c WHERE b.run = 'baseline' AND c.run = 'candidate'")
def benchmark_comparison(spark, sf_dir):
    rows = traces(spark, sf_dir).filter("turn BETWEEN 1 AND 10").withColumn("run", F.when(F.col("turn") % 2 == 1, "baseline").otherwise("candidate"))
    runs = metrics.latency(rows, ["run"])
    pick = lambda run, p: F.max(F.when(F.col("run") == run, F.col(p)))
    change = lambda p: (pick("candidate", p) - pick("baseline", p)) / pick("baseline", p)
    passed = (change("median") <= 0.05) & (change("p95") <= 0.05) & (pick("candidate", "max") < 1500)
    return runs.agg(F.round(change("median"), 6).alias("p50_change"), F.round(change("p95"), 6).alias("p95_change"), passed.alias("passed"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)), 6) AS k FROM events GROUP BY 1")
def event_summary(spark, sf_dir):
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "double")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.avg(k), 6).alias("k"))


_KEPT = ("budget", "color", "material")


@query(f"""WITH {sql.attribute_ctes()}, l AS (SELECT parent_asin, attribute, list_sort(list(value)) AS v FROM posts WHERE attribute IN ({sql.quoted(_KEPT)}) GROUP BY ALL)
SELECT parent_asin, attribute, CASE WHEN attribute = 'budget' THEN 'lte' WHEN len(v) > 1 THEN 'in' ELSE 'eq' END AS operator, v[1] AS value, CASE WHEN attribute <> 'budget' AND len(v) > 1 THEN array_to_string(v, '|') ELSE '' END AS alternatives FROM l""")
def fn_legacy_filters(spark, sf_dir):
    """Each product's price, colours and materials, taken as old filters."""
    kept = F.map_filter("attributes", lambda k, _: k.isin(*_KEPT))
    plans = index(spark, sf_dir).products.select("parent_asin", F.transform_values(kept, lambda _, v: F.array_sort(v)).alias("filters"))
    each = policy.from_filters(plans).select("parent_asin", F.explode("effective").alias("c"))
    return each.select("parent_asin", "c.attribute", "c.operator", "c.value", F.array_join("c.alternatives", "|").alias("alternatives"))
