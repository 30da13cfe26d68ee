"""Queries of the training-data operators and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from tidemark.engine import table
from tidemark.llm import canonical, conversations, leakage, product_match, quota_sample, stable_sample, stuffing, tokenizer

_TRIM = r"regexp_replace({0}, '^[\s\p{{Z}}\x{{85}}\x{{1c}}-\x{{1f}}\x{{0b}}]+|[\s\p{{Z}}\x{{85}}\x{{1c}}-\x{{1f}}\x{{0b}}]+$', '', 'g')"
_UNSEEN = r"regexp_replace({0}, '[\s\p{{Z}}\p{{Cc}}\p{{Cf}}\x{{34f}}\x{{115f}}\x{{1160}}\x{{17b4}}\x{{17b5}}\x{{2800}}\x{{3164}}\x{{ffa0}}\x{{fe00}}-\x{{fe0f}}]+', '', 'g')"


def p1_stable_sample(spark, sf_dir):
    return stable_sample.stable_sample(table(spark, sf_dir, "proxy_products"))


def p3_found(spark, sf_dir):
    return canonical.map_details(table(spark, sf_dir, "product_catalog"), table(spark, sf_dir, "canonical_values"))


def p3_unmatched(spark, sf_dir):
    return canonical.unmatched(table(spark, sf_dir, "product_catalog"), table(spark, sf_dir, "canonical_values"))


def p4_found(spark, sf_dir):
    _, report = quota_sample.draw(table(spark, sf_dir, "proxy_products"), table(spark, sf_dir, "sample_targets"))
    return quota_sample.impossible(report)


def p4_sample(spark, sf_dir):
    return quota_sample.draw(table(spark, sf_dir, "proxy_products"), table(spark, sf_dir, "sample_targets"))[0]


def p4_report(spark, sf_dir):
    return quota_sample.draw(table(spark, sf_dir, "proxy_products"), table(spark, sf_dir, "sample_targets"))[1]


def p5_found(spark, sf_dir):
    return conversations.broken_sessions(table(spark, sf_dir, "turns"))


def p5_conversations(spark, sf_dir):
    return conversations.conversations(table(spark, sf_dir, "turns"))


def _listings(spark, sf_dir):
    return table(spark, sf_dir, "product_catalog"), table(spark, sf_dir, "canonical_values").filter("field_name = 'Color'")


def p6_found(spark, sf_dir):
    return product_match.same_products(*_listings(spark, sf_dir))


def p6_groups(spark, sf_dir):
    return product_match.product_groups(*_listings(spark, sf_dir)).select("asin", "group_id")


def p8_ids(spark, sf_dir):
    return tokenizer.encode_corpus(table(spark, sf_dir, "documents"))


def p9_found(spark, sf_dir):
    return leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark_items"))


def p9_items(spark, sf_dir):
    return leakage.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark_items"))


def p9_clean(spark, sf_dir):
    return leakage.without_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark_items")).select("doc_id")


def p10_found(spark, sf_dir):
    return stuffing.stuffed_pages(table(spark, sf_dir, "documents"))


def p10_measures(spark, sf_dir):
    return stuffing.measure_pages(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p1_stable_sample, p3_found, p3_unmatched, p4_found, p4_sample, p4_report, p5_found, p5_conversations, p6_found, p6_groups, p8_ids, p9_found, p9_items, p9_clean, p10_found, p10_measures)}

_PRODUCTS = f"SELECT lower({_TRIM.format('parent_asin')}) AS parent_asin, * EXCLUDE (parent_asin) FROM proxy_products"

_TURNS = f"""
WITH rows AS (
  SELECT lower({_TRIM.format('session_id')}) AS session_id, CASE WHEN turn BETWEEN 1 AND 10 THEN turn END AS turn,
         updated_at, created_at, status, user_message, response_json
  FROM turns),
latest AS (
  SELECT session_id, turn, lower({_TRIM.format('status')}) AS status, user_message,
         CASE WHEN json_valid(response_json) AND json_type(response_json) = 'OBJECT' AND json_type(response_json, '$.message') = 'VARCHAR'
              THEN response_json ->> '$.message' END AS reply
  FROM rows WHERE session_id <> ''
  QUALIFY row_number() OVER (PARTITION BY session_id, turn ORDER BY updated_at DESC NULLS LAST, created_at DESC NULLS LAST,
                             status DESC NULLS LAST, user_message DESC NULLS LAST, response_json DESC NULLS LAST) = 1),
judged AS (
  SELECT *, turn IS NOT NULL AND coalesce(status = 'completed', false) AND coalesce({_UNSEEN.format('user_message')} <> '', false)
         AND coalesce({_UNSEEN.format('reply')} <> '', false) AS ok
  FROM latest),
sessions_kept AS (
  SELECT session_id FROM judged GROUP BY session_id HAVING bool_and(ok) AND min(turn) = 1 AND max(turn) = count(*))
"""

ORACLES = {
    "p1_stable_sample": f"""
        WITH firsts AS (SELECT parent_asin, min(loaded_at) AS first_loaded_at FROM ({_PRODUCTS}) WHERE parent_asin <> '' GROUP BY 1),
        numbered AS (SELECT *, row_number() OVER (ORDER BY first_loaded_at NULLS LAST, parent_asin) - 1 AS seq FROM firsts),
        places AS (SELECT b, i, row_number() OVER (PARTITION BY b ORDER BY sha256('tidemark:' || b || ':' || i)) AS place
                   FROM (SELECT unnest(range((SELECT max(seq) // {stable_sample.BLOCK} + 1 FROM numbered))) AS b), (SELECT unnest(range({stable_sample.BLOCK})) AS i))
        SELECT parent_asin, seq FROM numbered JOIN places ON b = seq // {stable_sample.BLOCK} AND i = seq % {stable_sample.BLOCK}
        WHERE place <= {stable_sample.CHOSEN}""",
    "p4_found": f"""
        WITH latest AS (
          SELECT lower({_TRIM.format('category')}) AS category, lower({_TRIM.format('price_bin')}) AS price_bin, lower({_TRIM.format('popularity_bin')}) AS popularity_bin
          FROM ({_PRODUCTS}) WHERE parent_asin <> ''
          QUALIFY row_number() OVER (PARTITION BY parent_asin ORDER BY loaded_at DESC NULLS LAST, nullif(lower({_TRIM.format('category')}), '') DESC NULLS LAST,
            nullif(lower({_TRIM.format('price_bin')}), '') DESC NULLS LAST, nullif(lower({_TRIM.format('popularity_bin')}), '') DESC NULLS LAST) = 1),
        counts AS (
          SELECT 'category' AS dim_name, category AS b, count(*) AS n FROM latest GROUP BY ALL
          UNION ALL SELECT 'price_bin', price_bin, count(*) FROM latest GROUP BY ALL
          UNION ALL SELECT 'popularity_bin', popularity_bin, count(*) FROM latest GROUP BY ALL),
        sizes AS (SELECT DISTINCT plan_id, (SELECT count(*) FROM latest) * sample_permille // 1000 AS size FROM sample_targets)
        SELECT t.plan_id, t.dim_name, t.bucket
        FROM sample_targets t JOIN sizes s USING (plan_id) LEFT JOIN counts c ON c.dim_name = t.dim_name AND c.b = lower({_TRIM.format('t.bucket')})
        WHERE coalesce(c.n, 0) < greatest(t.min_rows, (s.size * t.target_permille + 999) // 1000)""",
    "p5_found": _TURNS + "SELECT DISTINCT session_id FROM judged WHERE session_id NOT IN (SELECT session_id FROM sessions_kept)",
    "p5_conversations": _TURNS + """
        SELECT session_id, CAST(turn * 2 - 1 AS INT) AS seq, 'user' AS role, user_message AS content FROM judged WHERE session_id IN (SELECT session_id FROM sessions_kept)
        UNION ALL
        SELECT session_id, CAST(turn * 2 AS INT), 'agent', reply FROM judged WHERE session_id IN (SELECT session_id FROM sessions_kept)""",
}
