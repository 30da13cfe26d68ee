"""Catalog scans, scalar functions, index tables, postings and predicates over the product catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.engine import number_rows, table
from tidemark.functions import lookups, text
from tidemark.operators import catalog as cat
from tidemark.operators.index import Index, of_catalog
from tidemark.plans import sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def products(spark, sf_dir):
    return cat.latest(table(spark, sf_dir, "product_catalog"))


def index(spark, sf_dir) -> Index:
    """The stored search index of the catalogue."""
    return of_catalog(spark, f"{sf_dir}/product_catalog.parquet")


@query(f"WITH {sql.CAT}, {sql.QUALITY} SELECT parent_asin, round(quality, 6) AS quality FROM quality ORDER BY round(quality, 9) DESC, parent_asin LIMIT 10")
def popular_topk(spark, sf_dir):
    return cat.popular(products(spark, sf_dir), 10).select("parent_asin", F.round("quality", 6).alias("quality"))


@query(f"WITH {sql.CAT} SELECT parent_asin, title, store, price, average_rating, rating_number FROM cat")
def scan_latest_products(spark, sf_dir):
    return products(spark, sf_dir).select("parent_asin", "title", "store", "price", "average_rating", "rating_number")


@query("SELECT trim(coalesce(parent_asin, '')) AS parent_asin, count(*) AS rows, CASE WHEN trim(coalesce(parent_asin, '')) = '' THEN 'empty id' ELSE 'duplicate id' END AS problem FROM product_catalog GROUP BY 1 HAVING count(*) > 1 OR trim(coalesce(parent_asin, '')) = ''")
def scan_strict_violations(spark, sf_dir):
    return cat.id_violations(table(spark, sf_dir, "product_catalog"))


@query(f"WITH {sql.CAT} SELECT parent_asin, array_to_string(list_transform(coalesce(categories, []), lambda c: coalesce(c, '')), '>') AS path FROM cat")
def scan_projection(spark, sf_dir):
    return products(spark, sf_dir).select("parent_asin", F.coalesce(F.array_join("categories", ">", ""), F.lit("")).alias("path"))


@query("SELECT DISTINCT lower(trim(session_id)) AS session_id, json_extract_string(profile_json, '$.purchase_frequency') AS purchase_frequency FROM sessions WHERE trim(session_id) <> '' AND json_valid(profile_json)")
def scan_session_profiles(spark, sf_dir):
    profile = F.try_parse_json("profile_json")
    rows = table(spark, sf_dir, "sessions").filter((F.trim("session_id") != "") & profile.isNotNull())
    return rows.select(F.lower(F.trim("session_id")).alias("session_id"), F.try_variant_get(profile, "$.purchase_frequency", "string").alias("purchase_frequency")).distinct()


@query(f"WITH {sql.CAT} SELECT parent_asin, array_to_string({sql.terms(sql.SEARCH_TEXT)}, ' ') AS terms FROM cat")
def fn_terms(spark, sf_dir):
    return products(spark, sf_dir).select("parent_asin", F.array_join(text.terms(text.search_text()), " ").alias("terms"))


@query(f"WITH toks AS (SELECT doc_id, {sql.tokens('text')} AS t FROM documents) SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_terms, array_to_string(t[1:12], ' ') AS head FROM toks")
def fn_token_sequence(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("t"))
    return docs.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("t")).cast("bigint").alias("n_terms"), F.array_join(F.slice("t", 1, 12), " ").alias("head"))


@query(f"WITH {sql.CAT} SELECT parent_asin, e.key AS name, {sql.normal('e.value')} AS value FROM (SELECT parent_asin, unnest(map_entries(details)) AS e FROM cat)")
def fn_normalize_value(spark, sf_dir):
    each = products(spark, sf_dir).select("parent_asin", F.explode("details").alias("name", "value"))
    return each.withColumn("value", text.normalize_value(F.col("value")))


@query(f"WITH {sql.CAT}, w AS (SELECT DISTINCT unnest({sql.tokens('title')}) AS term FROM cat) SELECT term, {sql.singular('term')} AS singular FROM w")
def fn_singular(spark, sf_dir):
    words = products(spark, sf_dir).select(F.explode(text.terms(F.col("title"))).alias("term")).distinct()
    return words.withColumn("singular", text.singular(F.col("term")))


@query(f"WITH {sql.CAT} SELECT parent_asin, array_to_string({sql.category_terms('title')}, ' ') AS terms FROM cat")
def fn_category_terms(spark, sf_dir):
    return products(spark, sf_dir).select("parent_asin", F.array_join(text.category_terms(F.col("title")), " ").alias("terms"))


_SCOPE_CASES = " ".join(f"WHEN list_has_any(w, [{sql.quoted(v)}]) THEN '{k}'" for k, v in lookups.SCOPES.items())


@query(f"WITH {sql.CAT}, c AS (SELECT parent_asin, flatten(list_transform({sql.CATEGORIES}, lambda p: {sql.category_terms('p')})) AS w FROM cat) SELECT parent_asin, CASE {_SCOPE_CASES} ELSE 'other' END AS scope FROM c")
def fn_category_scope(spark, sf_dir):
    return products(spark, sf_dir).select("parent_asin", text.scope(F.flatten(F.transform(text.categories(), text.category_terms))).alias("scope"))


@query(f"WITH {sql.CAT}, {sql.QUALITY} SELECT parent_asin, round(quality, 6) AS quality FROM quality")
def fn_quality(spark, sf_dir):
    return cat.with_quality(products(spark, sf_dir)).select("parent_asin", F.round("quality", 6).alias("quality"))


@query("SELECT vec_id, array_to_string(list_transform(q, lambda v: CAST(v AS INT)::VARCHAR), ',') AS code, round(scale, 9) AS scale FROM (SELECT vec_id, scale, list_transform(u, lambda x: greatest(-127, least(127, round_even(x / scale, 0)))) AS q FROM (SELECT vec_id, u, greatest(list_max(list_transform(u, lambda x: abs(x))) / 127.0::DOUBLE, 1.1920928955078125e-07::DOUBLE) AS scale FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS u FROM embeddings)))")
def fn_quantize_int8(spark, sf_dir):
    q = text.quantize(F.col("embedding"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", q.alias("q"))
    return rows.select("vec_id", F.array_join(F.transform("q.values", lambda v: v.cast("string")), ",").alias("code"), F.round("q.scale", 9).alias("scale"))


@query(f"WITH {sql.CAT} SELECT parent_asin, sha256(concat('seed', chr(0), parent_asin)) AS hash, row_number() OVER (ORDER BY sha256(concat('seed', chr(0), parent_asin)), parent_asin) AS place FROM cat")
def fn_stable_hash_order(spark, sf_dir):
    hashed = products(spark, sf_dir).select("parent_asin", text.stable_hash("seed", F.col("parent_asin")).alias("hash"))
    return number_rows(hashed, ["hash", "parent_asin"], "_at").select("parent_asin", "hash", (F.col("_at") + 1).alias("place"))


@query("SELECT DISTINCT 'session_' || substr(sha256(lower(trim(session_id))), 1, 20) AS opaque_id FROM turns WHERE trim(session_id) <> ''")
def fn_opaque_session_id(spark, sf_dir):
    ids = table(spark, sf_dir, "turns").select(F.lower(F.trim("session_id")).alias("s")).filter("s <> ''").distinct()
    return ids.select(text.opaque_id("session_", F.col("s")).alias("opaque_id")).distinct()


@query(f"WITH {sql.CAT} SELECT parent_asin, CASE WHEN price > 0 AND NOT isnan(price) AND NOT isinf(price) THEN price END AS price FROM cat")
def fn_positive_finite(spark, sf_dir):
    return products(spark, sf_dir).select("parent_asin", text.positive_finite(F.col("price")).alias("price"))


@query(f"WITH {sql.attribute_ctes()} SELECT * FROM posts")
def idx_postings(spark, sf_dir):
    return index(spark, sf_dir).postings.select("parent_asin", "attribute", "value").distinct()


@query(f"WITH {sql.attribute_ctes()}, n AS (SELECT count(*) AS total FROM cat), v AS (SELECT attribute, value, count(*) AS support FROM posts GROUP BY ALL) SELECT attribute, count(*) AS values, count(*) FILTER (support >= greatest(12, ceil(total * 0.001))) AS supported, any_value(p.products) AS products, round(any_value(p.products) / any_value(total), 6) AS coverage FROM v JOIN (SELECT attribute, count(DISTINCT parent_asin) AS products FROM posts GROUP BY 1) p USING (attribute) CROSS JOIN n GROUP BY attribute")
def idx_schema_mining(spark, sf_dir):
    return cat.mine_schema(index(spark, sf_dir).products.select("parent_asin", "attributes"))


_FIELD_TOKENS = " UNION ALL ".join(f"SELECT parent_asin, {i} AS field, unnest({sql.tokens(sql.FIELDS[f])}) AS term FROM cat" for i, f in enumerate(lookups.SEARCH_FIELDS))
_WEIGHTS = " ".join(f"WHEN {i} THEN {w}::DOUBLE" for i, w in enumerate(lookups.FIELD_WEIGHTS))
TERM_FIELDS = f"""ft AS ({_FIELD_TOKENS}),
fields AS (SELECT parent_asin, term, field, count(*) AS n, CASE field {_WEIGHTS} END AS w FROM ft GROUP BY ALL),
term_fields AS (SELECT parent_asin, term, CAST(sum(1 << field) AS INT) AS mask, sum(w) AS weight, sum(w * n) AS tf FROM fields GROUP BY ALL)"""


@query(f"WITH {sql.CAT}, {TERM_FIELDS} SELECT term, count(*) AS df, CAST(bit_or(mask) AS INT) AS mask, round(sum(tf), 6) AS tf FROM term_fields GROUP BY term")
def idx_term_statistics(spark, sf_dir):
    return index(spark, sf_dir).counts.select("term", "df", "mask", F.round("tf", 6).alias("tf"))


_LAYER_SCOPE = " ".join(f"WHEN scope = '{s}' AND attribute IN ({sql.quoted(a)}) THEN 'category'" for s, a in lookups.SCOPE_ATTRIBUTES.items())
_ALIAS_ROWS = ", ".join(f"('{a}', '{b}')" for a, b in lookups.DETAIL_ALIASES.items())
_BLOCKED = " AND ".join(f"NOT contains(plain, '{b}')" for b in lookups.DETAIL_BLOCKED)
_PARTS = " UNION ".join(
    f"SELECT parent_asin, scope, '{a}' AS attribute, '{m}' AS value FROM base WHERE regexp_matches(normal_text, '"
    + "|".join(rf"\b{m}\b(?:\s+[a-z0-9-]+){{0,2}}\s+\b{x}\b|\b{x}(?:\s+material)?\b\s*(?:(?:is|made\s+of)\s+|[:=-]\s*)?\b{m}\b" for x in labels)
    + "')"
    for a, labels in lookups.MATERIAL_PARTS.items()
    for m in lookups.MATERIALS
)


@query(f"""
WITH {sql.CAT},
base AS (SELECT *, {sql.normal(sql.SEARCH_TEXT)} AS normal_text, CASE {_SCOPE_CASES} ELSE 'other' END AS scope FROM (SELECT *, flatten(list_transform({sql.CATEGORIES}, lambda p: {sql.category_terms('p')})) AS w FROM cat)),
named AS (SELECT parent_asin, scope, array_to_string({sql.terms('e.key')}, ' ') AS plain, {sql.normal('e.value')} AS value FROM (SELECT parent_asin, scope, unnest(map_entries(details)) AS e FROM base)),
kept AS (SELECT parent_asin, scope, attribute, value FROM named JOIN (VALUES {_ALIAS_ROWS}) a(alias, attribute) ON plain = alias WHERE {_BLOCKED} AND value <> '' AND length(value) <= 160 AND len({sql.terms('value')}) <= 16),
parts AS (SELECT * FROM kept UNION SELECT parent_asin, scope, attribute, {sql.normal('p')} FROM (SELECT parent_asin, scope, attribute, unnest(regexp_split_to_array(value, '[,;/|]')) AS p FROM kept WHERE attribute IN ({sql.quoted(lookups.ENUMERATED_ATTRIBUTES)})) WHERE {sql.normal('p')} <> ''),
every AS (SELECT * FROM parts UNION {_PARTS}),
layered AS (SELECT *, CASE {_LAYER_SCOPE} WHEN attribute IN ({sql.quoted(lookups.DYNAMIC_ATTRIBUTES)}) THEN 'dynamic' END AS layer FROM every)
SELECT DISTINCT parent_asin, layer, attribute, value FROM layered WHERE layer IS NOT NULL""")
def idx_layer_postings(spark, sf_dir):
    return cat.layers(products(spark, sf_dir))
