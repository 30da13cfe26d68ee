"""Search over the catalogue, documents and vectors: candidate sources, fusion, ranking, reranking, predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.engine import cut, fixed, table
from tidemark.functions import lookups, text
from tidemark.operators import hybrid, predicates, ranking, retrieval
from tidemark.operators import index as idx
from tidemark.plans import sql
from tidemark.plans.catalog_queries import TERM_FIELDS, index

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def asked(spark, sf_dir):
    """The query set on the catalogue: the canonical values, a fixed table."""
    return fixed(table(spark, sf_dir, "canonical_values").select(F.col("ref_id").cast("bigint").alias("query_id"), F.col("canonical").alias("text")))


_ASKED = f"asked AS (SELECT DISTINCT CAST(ref_id AS BIGINT) AS query_id, unnest({sql.tokens('canonical')}) AS term FROM canonical_values)"
_MASK = f"""WITH {sql.CAT}, {sql.QUALITY}, {TERM_FIELDS}, {_ASKED},
mask_scores AS (SELECT query_id, parent_asin, sum(weight) AS score FROM asked JOIN term_fields USING (term) GROUP BY ALL),
lexical AS (SELECT query_id, parent_asin, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, round(quality, 9) DESC, parent_asin) AS rank
            FROM mask_scores JOIN quality USING (parent_asin))"""


@query(f"{_MASK} SELECT query_id, parent_asin, score, rank FROM lexical WHERE rank <= {lookups.SOURCE_LIMIT}")
def lexical_mask_topk(spark, sf_dir):
    found = hybrid.by_mask(asked(spark, sf_dir), index(spark, sf_dir), lookups.SOURCE_LIMIT)
    return found.select("query_id", "parent_asin", "score", "rank")


def _bm25(terms: str, key: str, queries: str, k: int) -> str:
    return f"""lengths AS (SELECT {key}, sum(n) AS length FROM {terms} GROUP BY 1), stats AS (SELECT count(*) AS n, avg(length) AS avgdl FROM lengths),
df AS (SELECT term, count(*) AS df FROM {terms} GROUP BY 1),
bm AS (SELECT query_id, {key}, sum(CASE WHEN ln((stats.n - df + 0.5) / (df + 0.5)) > 0 THEN ln((stats.n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END
   * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / avgdl))) AS score
   FROM {queries} JOIN {terms} USING (term) JOIN df USING (term) JOIN lengths USING ({key}) CROSS JOIN stats GROUP BY ALL),
bm_ranked AS (SELECT query_id, {key}, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, {key}) AS rank FROM bm)"""


_PRODUCT_TERMS = "pt AS (SELECT parent_asin, term, sum(n) AS n, sum(w * n) AS tf FROM fields GROUP BY ALL)"


@query(f"WITH {sql.CAT}, {TERM_FIELDS}, {_ASKED}, {_PRODUCT_TERMS}, {_bm25('pt', 'parent_asin', 'asked', 50)} SELECT query_id, parent_asin, round(score, 6) AS score, rank FROM bm_ranked WHERE rank <= 50")
def bm25_products_topk(spark, sf_dir):
    return hybrid.lexical(asked(spark, sf_dir), index(spark, sf_dir), 50).withColumn("score", F.round("score", 6))


@query(f"""WITH items AS (SELECT item_id AS query_id, {sql.terms('text')}[1:40] AS t FROM benchmark_items), q AS (SELECT query_id, unnest(t) AS term FROM items),
toks AS (SELECT doc_id, unnest({sql.tokens('text')}) AS term FROM documents), dt AS (SELECT doc_id, term, count(*) AS n, CAST(count(*) AS DOUBLE) AS tf FROM toks GROUP BY ALL),
{_bm25('dt', 'doc_id', 'q', 10)} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM bm_ranked WHERE rank <= 10""")
def bm25_documents_topk(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    terms = retrieval.document_terms(docs, "doc_id")
    lengths = docs.select("doc_id", F.size(text.tokens(F.col("text"))).alias("length")).filter("length > 0")
    items = table(spark, sf_dir, "benchmark_items").select(F.col("item_id").alias("query_id"), "text")
    top = retrieval.top_k(retrieval.bm25(items, terms, lengths, "doc_id"), ["query_id"], 10, F.round("score", 9).desc(), F.col("doc_id"))
    return top.withColumn("score", F.round("score", 6))


@query(f"WITH {sql.CAT}, {TERM_FIELDS}, {_ASKED} SELECT query_id AS request_id, parent_asin FROM asked JOIN term_fields USING (term) JOIN (SELECT query_id, count(*) AS need FROM asked GROUP BY 1) USING (query_id) GROUP BY query_id, parent_asin, need HAVING count(*) = need")
def join_and_terms(spark, sf_dir):
    requests = retrieval.query_terms(asked(spark, sf_dir)).withColumnRenamed("query_id", "request_id")
    return retrieval.all_terms(requests, index(spark, sf_dir).of(requests).select("parent_asin", "term"))


#: Fixed example plans: query_id, constraint_id, operator, attribute, value.
PLANS = [
    (1, 1, "eq", "color", "blue"), (1, 2, "eq", "category", "sneakers"), (2, 1, "in", "color", "green"), (2, 1, "in", "color", "white"), (2, 2, "not_in", "category", "frocks"),
    (3, 1, "eq", "material", "cotton"), (3, 2, "not_in", "color", "black"), (4, 1, "eq", "category", "handbags"), (4, 2, "not_in", "brand", "marrowgate outlet"), (5, 1, "eq", "color", "no such color"), (5, 2, "eq", "category", "boots"),
]


def plans(spark):
    return spark.createDataFrame(PLANS, "query_id bigint, constraint_id int, operator string, attribute string, value string")


_PLANS = "plans AS (SELECT * FROM (VALUES " + ", ".join(f"(CAST({q} AS BIGINT), {c}, '{o}', '{a}', '{v}')" for q, c, o, a, v in PLANS) + ") p(query_id, constraint_id, operator, attribute, value))"


@query(f"""WITH {sql.attribute_ctes()}, {_PLANS},
hit AS (SELECT DISTINCT query_id, constraint_id, operator, parent_asin FROM plans JOIN posts USING (attribute, value)),
good AS (SELECT query_id, constraint_id, parent_asin FROM hit WHERE operator <> 'not_in'
  UNION SELECT query_id, constraint_id, parent_asin FROM (SELECT DISTINCT query_id, constraint_id, parent_asin FROM plans JOIN posts USING (attribute) WHERE operator = 'not_in') p
  WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.query_id = p.query_id AND h.constraint_id = p.constraint_id AND h.parent_asin = p.parent_asin))
SELECT query_id, parent_asin FROM good JOIN (SELECT query_id, count(DISTINCT constraint_id) AS need FROM plans GROUP BY 1) USING (query_id) GROUP BY query_id, parent_asin, need HAVING count(*) = need""")
def join_multi_constraint(spark, sf_dir):
    return retrieval.attribute_candidates(plans(spark), index(spark, sf_dir).postings).select("query_id", "parent_asin")


@query(f"""WITH {sql.attribute_ctes()}, {_PLANS}, {sql.QUALITY},
hits AS (SELECT query_id, parent_asin, count(*) AS hits FROM (SELECT DISTINCT query_id, attribute, value FROM plans) JOIN posts USING (attribute, value) GROUP BY ALL)
SELECT query_id, parent_asin, hits, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, round(quality, 9) DESC, parent_asin) AS rank FROM hits JOIN quality USING (parent_asin) QUALIFY rank <= {lookups.SOURCE_LIMIT}""")
def profile_topk(spark, sf_dir):
    hits = retrieval.profile_hits(plans(spark).select("query_id", "attribute", "value"), index(spark, sf_dir).postings)
    order = [F.col("hits").desc(), F.round("quality", 9).desc(), F.col("parent_asin")]
    return retrieval.top_k(hits, ["query_id"], lookups.SOURCE_LIMIT, *order).select("query_id", "parent_asin", "hits", "rank")


def vectors(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return rows, rows.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


@query("""WITH scored AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(list_transform(q.embedding, lambda x: x::DOUBLE), list_transform(v.embedding, lambda x: x::DOUBLE)) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0)
SELECT query_id, vec_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM scored QUALIFY rank <= 10""")
def dense_topk(spark, sf_dir):
    return retrieval.dense_top_k(*vectors(spark, sf_dir), 10).withColumn("score", F.round("score", 6))


#: The constraints of the query set, by the query's own words and its number: colours and materials that it names and a
#: budget are hard; styles and a category are wishes; two come from a profile.
_KIND = ("sneakers", "boots")
_PLAN = f"""plan AS (
  SELECT CAST(ref_id AS BIGINT) AS query_id, list_transform({sql.matches(sql.tokens('canonical'), lookups.COLORS)}, lambda c: CASE WHEN c = 'grey' THEN 'gray' ELSE c END) AS wc,
    {sql.matches(sql.tokens('canonical'), lookups.MATERIALS)} AS wm, {sql.matches(sql.tokens('canonical'), lookups.STYLES)} AS ws,
    CASE ref_id % 10 WHEN 0 THEN 0.01::DOUBLE WHEN 1 THEN 15 ELSE 120 END AS most, CASE WHEN ref_id % 2 = 0 THEN '{_KIND[0]}' ELSE '{_KIND[1]}' END AS kind FROM canonical_values)"""


def wishes(spark, sf_dir):
    """The query set's constraints: predicates.SCHEMA with query_id."""
    words = text.terms(F.col("text"))
    rows = asked(spark, sf_dir).select("query_id", words.alias("w"))
    colors = F.transform(text.matches(F.col("w"), lookups.COLORS), lambda c: F.when(c == "grey", "gray").otherwise(c))
    none = F.array().cast("array<string>")
    most = F.when(F.col("query_id") % 10 == 0, "0.01").when(F.col("query_id") % 10 == 1, "15").otherwise("120")
    kind = F.when(F.col("query_id") % 2 == 0, _KIND[0]).otherwise(_KIND[1])
    stated = [
        ("color", "in", colors, True, "message"), ("material", "in", text.matches(F.col("w"), lookups.MATERIALS), True, "message"), ("budget", "lte", F.array(most), True, "message"),
        ("style", "in", text.matches(F.col("w"), lookups.STYLES), False, "message"), ("category", "eq", F.array(kind), False, "message"),
        ("feature", "eq", F.array(F.lit("comfortable")), False, "profile"), ("use_case", "eq", F.array(F.lit("casual")), False, "profile"),
    ]
    each = [F.struct(F.lit(i).alias("constraint_id"), F.lit(a).alias("attribute"), F.lit(o).alias("operator"), v.alias("values"), F.lit(h).alias("is_hard"), F.lit(s).alias("source")) for i, (a, o, v, h, s) in enumerate(stated, 1)]
    flat = rows.select("query_id", F.explode(F.array(*each)).alias("c")).select("query_id", "c.*").filter(F.size("values") > 0)
    return fixed(flat.select("query_id", "constraint_id", "attribute", "operator", F.col("values")[0].alias("value"), F.lit(None).cast("string").alias("upper_value"), F.coalesce("values", none).alias("alternatives"), "is_hard", "source"))


def shown(spark, sf_dir):
    """(query_id, parent_asin): products with feedback count as shown to every query."""
    seen = table(spark, sf_dir, "product_feedback").select("parent_asin").filter("parent_asin IS NOT NULL").distinct()
    return seen.crossJoin(F.broadcast(asked(spark, sf_dir).select("query_id")))  # a fixed table of queries


_TITLE_VECTOR = """{n}_spots AS (SELECT id, CAST('0x' || substr(md5(t), 1, 4) AS INT) % 64 AS d, 1 - 2 * (CAST('0x' || substr(md5(t), 5, 1) AS INT) % 2) AS s FROM (SELECT {i} AS id, unnest({w}) AS t FROM {f})),
{n}_sums AS (SELECT id, d, CAST(sum(s) AS DOUBLE) AS v FROM {n}_spots GROUP BY ALL), {n}_vec AS (SELECT id, d, CASE WHEN sqrt(sum(v * v) OVER (PARTITION BY id)) > 0 THEN v / sqrt(sum(v * v) OVER (PARTITION BY id)) ELSE 0 END AS v FROM {n}_sums)"""
_DENSE = f"""{_TITLE_VECTOR.format(n='q', i='CAST(ref_id AS BIGINT)', w=sql.terms('canonical'), f='canonical_values')}, {_TITLE_VECTOR.format(n='p', i='parent_asin', w=sql.terms('title'), f='cat')},
dots AS (SELECT q.id AS query_id, p.id AS parent_asin, sum(q.v * p.v) AS dot FROM q_vec q JOIN p_vec p USING (d) GROUP BY ALL),
dense AS (SELECT query_id, parent_asin, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(round(dot, 9), 0) DESC, parent_asin) AS rank
  FROM (SELECT query_id, p.id AS parent_asin FROM (SELECT DISTINCT query_id FROM plan), (SELECT DISTINCT id FROM p_vec) p) LEFT JOIN dots USING (query_id, parent_asin) QUALIFY rank <= {lookups.SOURCE_LIMIT})"""
_JUDGED = f"""cw AS (SELECT parent_asin, list_distinct(flatten(list({sql.category_terms('value')}))) AS cats FROM posts WHERE attribute = 'category' GROUP BY 1),
have AS (SELECT parent_asin, list(value) FILTER (attribute = 'color') AS colors, list(value) FILTER (attribute = 'material') AS materials, list(value) FILTER (attribute = 'style') AS styles, list(value) FILTER (attribute = 'category') AS kinds,
  list(value) FILTER (attribute = 'feature') AS feats, list(value) FILTER (attribute = 'use_case') AS uses FROM posts GROUP BY 1),
judged AS (SELECT *, hc + hm + hb AS hard_met, 1 + (len(wc) > 0)::INT + (len(wm) > 0)::INT AS hard_n FROM (
  SELECT query_id, cat.parent_asin, cat.price, quality, wc, wm, ws, (len(wc) > 0 AND coalesce(list_has_any(colors, wc), false))::INT AS hc, (len(wm) > 0 AND coalesce(list_has_any(materials, wm), false))::INT AS hm, coalesce(cat.price > 0 AND cat.price <= most, false)::INT AS hb,
    (len(ws) > 0 AND coalesce(list_has_any(styles, ws), false))::INT AS ss, coalesce(list_contains(cats, CASE kind WHEN '{_KIND[0]}' THEN 'sneaker' ELSE 'boot' END), false)::INT AS sc, coalesce(list_contains(feats, 'comfortable'), false)::INT AS pf, coalesce(list_contains(uses, 'casual'), false)::INT AS pu,
    len(list_intersect(coalesce(styles, []), ws)) + coalesce(list_contains(kinds, kind), false)::INT AS hits0
  FROM plan, cat JOIN quality USING (parent_asin) LEFT JOIN have USING (parent_asin) LEFT JOIN cw USING (parent_asin)))"""
_SOURCES = f"""WITH {sql.attribute_ctes()}, {sql.QUALITY}, {TERM_FIELDS}, {_ASKED}, {_PLAN}, {_PRODUCT_TERMS}, {_bm25('pt', 'parent_asin', 'asked', 0)}, {_DENSE}, {_JUDGED},
by_attribute AS (SELECT query_id, parent_asin, row_number() OVER (PARTITION BY query_id ORDER BY round(quality, 9) DESC, parent_asin) AS rank FROM judged WHERE hard_met = hard_n QUALIFY rank <= {lookups.SOURCE_LIMIT}),
by_profile AS (SELECT query_id, parent_asin, row_number() OVER (PARTITION BY query_id ORDER BY hits0 + pf + pu DESC, round(quality, 9) DESC, parent_asin) AS rank FROM judged WHERE hits0 + pf + pu > 0 QUALIFY rank <= {lookups.SOURCE_LIMIT}),
sources AS (SELECT query_id, 'lexical' AS source, parent_asin, rank FROM bm_ranked WHERE rank <= {3 * lookups.SOURCE_LIMIT} UNION ALL SELECT query_id, 'attribute', parent_asin, rank FROM by_attribute
  UNION ALL SELECT query_id, 'profile', parent_asin, rank FROM by_profile UNION ALL SELECT query_id, 'dense', parent_asin, rank FROM dense)"""


def sources(spark, sf_dir):
    """Four ranked lists a query: by words, by attributes, by wishes, by vectors."""
    queries = asked(spark, sf_dir)
    near = queries.select("query_id", idx.unit(idx.vector(text.terms(F.col("text")))).alias("vector")).filter("vector IS NOT NULL")
    return cut(hybrid.sources(queries, wishes(spark, sf_dir), near, index(spark, sf_dir)))


def _weights(spark, **w):
    return spark.createDataFrame(list(w.items()), "source string, weight double")


def _fused(weights: dict, of: str = "sources") -> str:
    cases = " ".join(f"WHEN '{s}' THEN {w}::DOUBLE" for s, w in weights.items())
    return f"fused AS (SELECT query_id, parent_asin, sum(greatest(coalesce(CASE source {cases} END, 0), 0) / (60 + rank)) AS score FROM {of} GROUP BY ALL), fused_ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, parent_asin) AS rank FROM fused)"


@query(f"{_SOURCES}, {_fused(lookups.ROUTE_WEIGHTS['buying'])} SELECT query_id, parent_asin, round(score, 9) AS score, rank FROM fused_ranked")
def rrf_fusion(spark, sf_dir):
    return retrieval.fuse(sources(spark, sf_dir), _weights(spark, **lookups.ROUTE_WEIGHTS["buying"])).withColumn("score", F.round("score", 9))


@query(f"{_SOURCES}, {_fused({'lexical': 0.3})} SELECT query_id, parent_asin, round(score, 9) AS score, rank FROM fused_ranked")
def rrf_zero_weight(spark, sf_dir):
    return retrieval.fuse(sources(spark, sf_dir), _weights(spark, lexical=0.3)).withColumn("score", F.round("score", 9))


_ALIVE = f"""shown AS (SELECT DISTINCT parent_asin FROM product_feedback WHERE parent_asin IS NOT NULL),
alive AS (SELECT query_id, source, parent_asin, place AS rank FROM (SELECT query_id, source, parent_asin, row_number() OVER (PARTITION BY query_id, source ORDER BY s.rank, parent_asin) AS place FROM sources s JOIN judged USING (query_id, parent_asin) WHERE hard_met = hard_n AND parent_asin NOT IN (FROM shown)) WHERE place <= {lookups.SOURCE_LIMIT})"""


def alive(spark, sf_dir):
    """The sources, what they are judged, and the exact ones ranked anew."""
    found = sources(spark, sf_dir)
    judged = cut(predicates.coverages(found.select("query_id", "parent_asin"), wishes(spark, sf_dir), index(spark, sf_dir).products))
    return found, judged, cut(hybrid.exact(found, judged, shown(spark, sf_dir)))


@query(f"{_SOURCES}, {_ALIVE} SELECT * FROM alive")
def rank_after_filter(spark, sf_dir):
    return alive(spark, sf_dir)[2].select("query_id", "source", "parent_asin", "rank")


@query(f"""{_SOURCES}, {_ALIVE},
staged AS (SELECT query_id, parent_asin, 0 AS stage, rank FROM alive WHERE source = 'attribute' AND rank <= 4 UNION ALL SELECT query_id, parent_asin, 1, rank FROM sources WHERE source = 'lexical' AND rank <= 4
  UNION ALL SELECT query_id, parent_asin, 2, rank FROM sources WHERE source = 'attribute' AND rank <= 20),
firsts AS (SELECT query_id, parent_asin, min(stage * 1000 + rank) AS f FROM staged GROUP BY ALL)
SELECT query_id, parent_asin, CAST(f // 1000 AS INT) AS stage, row_number() OVER (PARTITION BY query_id ORDER BY f, parent_asin) AS rank FROM firsts QUALIFY rank <= 10""")
def relaxed_fill(spark, sf_dir):
    found, _, kept = alive(spark, sf_dir)
    pick = lambda df, source, k: df.filter((F.col("source") == source) & (F.col("rank") <= k)).select("query_id", "parent_asin", "rank")
    return retrieval.fill(pick(kept, "attribute", 4), pick(found, "lexical", 4), pick(found, "attribute", 20), 10).select("query_id", "parent_asin", "stage", "rank")


@query(f"{_SOURCES}, {_ALIVE} SELECT query_id FROM plan WHERE query_id NOT IN (SELECT query_id FROM alive WHERE source IN ('lexical', 'attribute'))")
def dense_rescue_gate(spark, sf_dir):
    return retrieval.rescue_gate(alive(spark, sf_dir)[2], _weights(spark, **lookups.ROUTE_WEIGHTS["buying"]), asked(spark, sf_dir))


_CANDIDATES = f"""{_SOURCES}, {_ALIVE}, {_fused(lookups.ROUTE_WEIGHTS['buying'], 'alive')},
first AS (SELECT query_id, parent_asin, score, rank FROM fused_ranked WHERE rank <= {hybrid.CANDIDATE_LIMIT}),
short AS (SELECT query_id FROM plan LEFT JOIN (SELECT query_id, count(*) AS n FROM first GROUP BY 1) USING (query_id) WHERE coalesce(n, 0) < 10),
popular AS (SELECT parent_asin, row_number() OVER (ORDER BY round(quality, 9) DESC, parent_asin) AS place FROM quality QUALIFY place <= {lookups.FALLBACK_LIMIT}),
spare AS (SELECT j.query_id, popular.parent_asin, CASE WHEN popular.parent_asin IN (FROM shown) THEN 3 WHEN hard_met < hard_n THEN 2 ELSE 1 END AS stage, 0.0::DOUBLE AS score, place FROM short, popular JOIN judged j USING (parent_asin) WHERE j.query_id = short.query_id AND NOT EXISTS (SELECT 1 FROM first f WHERE f.query_id = short.query_id AND f.parent_asin = popular.parent_asin)),
candidates AS (SELECT query_id, parent_asin, CAST(stage AS INT) AS stage, score, row_number() OVER (PARTITION BY query_id ORDER BY stage, place, parent_asin) AS rank
  FROM (SELECT query_id, parent_asin, 0 AS stage, score, rank AS place FROM first UNION ALL SELECT short.query_id, parent_asin, stage, score, place FROM spare short) QUALIFY stage = 0 OR rank <= 10)"""


def candidates(spark, sf_dir):
    """The sources' exact products, what all are judged, and the query set's candidates."""
    found, judged, kept = alive(spark, sf_dir)
    weights = _weights(spark, **lookups.ROUTE_WEIGHTS["buying"])
    return kept, judged, cut(hybrid.candidates(kept, weights, asked(spark, sf_dir), wishes(spark, sf_dir), shown(spark, sf_dir), index(spark, sf_dir)))


@query(f"{_CANDIDATES} SELECT query_id, parent_asin, stage, round(score, 9) AS score, rank FROM candidates")
def hybrid_retrieve(spark, sf_dir):
    return candidates(spark, sf_dir)[2].withColumn("score", F.round("score", 9))


_RANKED = f"""{_CANDIDATES},
parts AS (SELECT query_id, parent_asin, sum(CASE WHEN source = 'lexical' THEN 0.35::DOUBLE / (60 + rank) END) AS lex, sum(CASE WHEN source = 'attribute' THEN 0.45::DOUBLE / (60 + rank) END) AS att, sum(CASE WHEN source = 'dense' THEN 0.20::DOUBLE / (60 + rank) END) AS den,
  count(*) FILTER (source IN ('lexical', 'attribute', 'dense')) >= 2 AND bool_or(source IN ('lexical', 'attribute')) AS agreed FROM alive GROUP BY ALL),
scaled AS (SELECT c.*, coalesce(lex, 0) / nullif(max(coalesce(lex, 0)) OVER w, 0) AS l, coalesce(den, 0) / nullif(max(coalesce(den, 0)) OVER w, 0) AS d, c.score / nullif(max(c.score) OVER w, 0) AS fu, coalesce(agreed AND c.stage = 0, false) AS agreed
  FROM candidates c LEFT JOIN parts USING (query_id, parent_asin) WINDOW w AS (PARTITION BY query_id)),
scores AS (SELECT s.query_id, s.parent_asin, stage, rank AS pre_rank, 0.30::DOUBLE * hard_met / hard_n + 0.075::DOUBLE * coalesce(l, 0) + 0.075::DOUBLE * coalesce(d, 0) + 0.25::DOUBLE * coalesce(fu, 0) + 0.10::DOUBLE * sc + 0.10::DOUBLE * CASE WHEN len(ws) > 0 THEN (ss + sc) / 2.0::DOUBLE ELSE sc END
  + 0.05::DOUBLE * (pf + pu) / 2.0::DOUBLE + 0.05::DOUBLE * quality + CASE WHEN agreed THEN 0.025::DOUBLE ELSE 0 END + CASE WHEN agreed AND rank <= 10 AND stage = 0 AND hard_met = hard_n THEN 0.025::DOUBLE ELSE 0 END - CASE WHEN hard_met < hard_n THEN 0.60::DOUBLE ELSE 0 END AS score, hard_met < hard_n AS relaxed
  FROM scaled s JOIN judged USING (query_id, parent_asin)),
scored AS (SELECT query_id, parent_asin, score, relaxed, row_number() OVER (PARTITION BY query_id ORDER BY relaxed, round(score, 9) DESC, parent_asin) AS rank FROM scores)"""


def ranked(spark, sf_dir):
    """The candidates in the ranker's order, with its evidence for agreement at 0.025 each."""
    kept, _, found = candidates(spark, sf_dir)
    parts = ranking.source_signals(kept, _weights(spark, **lookups.ROUTE_WEIGHTS["buying"]))
    pairs = found.select("query_id", "parent_asin", "stage", F.col("score").alias("fusion"), F.col("rank").alias("pre_rank"))
    pairs = pairs.join(parts, ["query_id", "parent_asin"], "left").join(ranking.consensus(kept), ["query_id", "parent_asin"], "left")
    pairs = pairs.withColumn("agreed", F.col("agreed") & (F.col("stage") == 0))
    products_ = index(spark, sf_dir).products
    judged = predicates.coverages(found, wishes(spark, sf_dir), products_)
    few = products_.select("parent_asin", "quality").join(F.broadcast(found.select("parent_asin").distinct()), "parent_asin", "left_semi")
    signals = pairs.join(judged, ["query_id", "parent_asin"]).join(few, "parent_asin")
    return ranking.rank(signals.withColumn("relaxed", F.col("missed") > 0), consensus_bonus=0.025, boundary_bonus=0.025)


@query(f"{_RANKED} SELECT query_id, parent_asin, round(score, 6) AS score, relaxed, rank FROM scored")
def rank_scores(spark, sf_dir):
    return ranked(spark, sf_dir).select("query_id", "parent_asin", F.round("score", 6).alias("score"), "relaxed", "rank")


_WORDS = f"""div AS (SELECT parent_asin, list_distinct(flatten(list({sql.terms('value')}))) AS t FROM posts WHERE attribute IN ('category', 'material', 'style', 'use_case') GROUP BY 1),
head AS (SELECT query_id, parent_asin, score, relaxed, rank, coalesce(t, []) AS t FROM scored LEFT JOIN div USING (parent_asin))"""


def heads(spark, sf_dir, k):
    """The first k of the ranker's exact candidates with the words by which they are alike."""
    found = ranked(spark, sf_dir).filter("NOT relaxed").filter(F.col("rank") <= k).select("query_id", "parent_asin", "score", "rank")
    few = index(spark, sf_dir).products.select("parent_asin", "attributes").join(F.broadcast(found.select("parent_asin").distinct()), "parent_asin", "left_semi")
    return found.join(few, "parent_asin").select("query_id", "parent_asin", "score", "rank", ranking.diversity_terms("attributes").alias("terms"))


@query(f"""{_RANKED}, {_WORDS}, h AS (SELECT * FROM head WHERE rank <= 10 AND NOT relaxed)
SELECT query_id, a, b, round(CASE WHEN u > 0 THEN i / u ELSE 0 END, 6) AS similarity FROM (SELECT x.query_id, x.parent_asin AS a, y.parent_asin AS b, len(list_intersect(x.t, y.t)) AS i, len(list_distinct(x.t || y.t)) AS u FROM h x JOIN h y ON x.query_id = y.query_id AND x.parent_asin < y.parent_asin)""")
def jaccard_pairs(spark, sf_dir):
    return retrieval.jaccard_pairs(heads(spark, sf_dir, 10)).withColumn("similarity", F.round("similarity", 6))


@query()
def mmr_top10(spark, sf_dir):
    return retrieval.mmr(heads(spark, sf_dir, hybrid.CANDIDATE_LIMIT))


def evidence(spark, sf_dir):
    return asked(spark, sf_dir).select("query_id", F.lit(0).alias("phrase_id"), text.tokens(F.col("text")).alias("tokens"), F.lit(1.0).alias("weight"))


def reread(spark, sf_dir):
    """The first candidates of each query by the ranker with the first tokens of all their searched fields."""
    found = ranked(spark, sf_dir).filter(F.col("rank") <= lookups.PHRASE_WINDOW).select("query_id", "parent_asin", "rank")
    few = index(spark, sf_dir).products.join(F.broadcast(found.select("parent_asin").distinct()), "parent_asin", "left_semi")
    tokens = few.select("parent_asin", F.slice(text.tokens(text.search_text()), 1, lookups.PHRASE_TOKENS).alias("tokens"))
    return cut(found.join(tokens, "parent_asin"))


_RUNS = f"""{_RANKED},
head AS (SELECT query_id, parent_asin, rank, ({sql.tokens(sql.SEARCH_TEXT)})[1:{lookups.PHRASE_TOKENS}] AS toks FROM scored JOIN cat USING (parent_asin) WHERE rank <= {lookups.PHRASE_WINDOW}),
ev AS (SELECT CAST(ref_id AS BIGINT) AS query_id, {sql.tokens('canonical')} AS et FROM canonical_values),
e AS (SELECT query_id, unnest(range(len(et))) AS ep, unnest(et) AS token FROM ev), d AS (SELECT query_id, parent_asin, unnest(range(len(toks))) AS dp, unnest(toks) AS token FROM head),
hit AS (SELECT query_id, parent_asin, ep, dp - ep AS diagonal, token, ep - row_number() OVER (PARTITION BY query_id, parent_asin, dp - ep ORDER BY ep) AS island FROM e JOIN d USING (query_id, token)),
runs AS (SELECT query_id, parent_asin, max(n) AS run FROM (SELECT query_id, parent_asin, diagonal, island, count(*) AS n FROM hit GROUP BY ALL) GROUP BY ALL),
cover AS (SELECT query_id, parent_asin, count(DISTINCT token) AS covered FROM hit GROUP BY ALL)"""


@query(f"{_RUNS} SELECT query_id, parent_asin, covered, run FROM runs JOIN cover USING (query_id, parent_asin)")
def longest_run(spark, sf_dir):
    runs = retrieval.longest_runs(evidence(spark, sf_dir), reread(spark, sf_dir).select("query_id", "parent_asin", "tokens"))
    return runs.select("query_id", "parent_asin", F.col("covered").cast("bigint").alias("covered"), "run")


@query(f"""{_RUNS},
phrase AS (SELECT h.query_id, h.parent_asin, h.rank, coalesce(0.4::DOUBLE * covered / len(list_distinct(et)) + 0.6::DOUBLE * least(run, 6) / 6, 0) AS score
  FROM head h JOIN ev USING (query_id) LEFT JOIN runs USING (query_id, parent_asin) LEFT JOIN cover USING (query_id, parent_asin)),
mixed AS (SELECT *, 1 - (rank - 1) / greatest(max(rank) OVER w - 1, 1) AS place, min(score) OVER w AS low, max(score) OVER w AS high FROM phrase WINDOW w AS (PARTITION BY query_id))
SELECT query_id, parent_asin, rank, row_number() OVER (PARTITION BY query_id ORDER BY round(CASE WHEN high > low THEN 0.2::DOUBLE * place + 0.8::DOUBLE * (score - low) / (high - low) ELSE place END, 9) DESC, rank) AS new_rank FROM mixed""")
def phrase_rerank(spark, sf_dir):
    rows = reread(spark, sf_dir)
    scores = retrieval.phrase_scores(evidence(spark, sf_dir), rows.select("query_id", "parent_asin", "tokens"))
    return retrieval.rerank(rows.select("query_id", "parent_asin", "rank"), scores)


#: Fixed example constraints.
CONSTRAINTS = [
    (1, "budget", "lte", "60.00", None, None, True, "message"), (2, "budget", "between", "20", "80", None, True, "message"), (3, "color", "in", "blue", None, ["Green", "white"], True, "message"),
    (4, "color", "not_in", "black", None, None, True, "message"), (5, "category", "eq", "sneaker", None, None, True, "message"), (6, "category", "not_in", "dresses", None, ["frocks"], True, "message"),
    (7, "feature", "eq", "long walks", None, None, False, "clarification"), (8, "material", "lte", "5", None, None, True, "message"), (9, "budget", "eq", "not a number", None, None, True, "message"), (10, "brand", "eq", "Marrowgate Outlet", None, None, False, "profile"),
]


def constraints(spark):
    return spark.createDataFrame(CONSTRAINTS, predicates.SCHEMA)


def described(spark, sf_dir):
    return index(spark, sf_dir).products.select("parent_asin", "price", "search_terms", "attributes")


_FACTS = f"""WITH {sql.attribute_ctes()},
w AS (SELECT parent_asin, price, toks FROM words),
cw AS (SELECT parent_asin, list_distinct(flatten(list({sql.category_terms('value')}))) AS cats FROM posts WHERE attribute = 'category' GROUP BY 1),
have AS (SELECT parent_asin, list(value) FILTER (attribute = 'color') AS colors, list(value) FILTER (attribute = 'brand') AS brands FROM posts GROUP BY 1),
f AS (SELECT w.*, cats, colors, brands FROM w LEFT JOIN cw USING (parent_asin) LEFT JOIN have USING (parent_asin)),
met AS (
  SELECT parent_asin, 1 AS constraint_id, price > 0 AND price <= 60 AS met FROM f UNION ALL SELECT parent_asin, 2, price BETWEEN 20 AND 80 FROM f
  UNION ALL SELECT parent_asin, 3, list_has_any(colors, ['blue', 'green', 'white']) FROM f UNION ALL SELECT parent_asin, 4, len(colors) > 0 AND NOT list_contains(colors, 'black') FROM f
  UNION ALL SELECT parent_asin, 5, list_contains(cats, 'sneaker') FROM f UNION ALL SELECT parent_asin, 6, len(cats) > 0 AND NOT list_contains(cats, 'dress') AND NOT list_contains(cats, 'frock') FROM f
  UNION ALL SELECT parent_asin, 7, list_has_all(toks, ['long', 'walks']) FROM f UNION ALL SELECT parent_asin, 8, false FROM f UNION ALL SELECT parent_asin, 9, false FROM f
  UNION ALL SELECT parent_asin, 10, list_contains(brands, 'marrowgate outlet') FROM f)"""


@query(f"{_FACTS} SELECT parent_asin, constraint_id, coalesce(met, false) AS met FROM met")
def pred_constraints(spark, sf_dir):
    return predicates.check(described(spark, sf_dir), constraints(spark))


_TEXTS = {1: "budget at most 60.00", 2: "budget between 20 and 80", 3: "color blue or green or white", 4: "color not black", 5: "category sneaker", 6: "category not dresses or frocks", 8: "material at most 5", 9: "budget not a number"}


@query(f"{_FACTS} SELECT parent_asin, coalesce(string_agg(t, '; ' ORDER BY constraint_id) FILTER (NOT coalesce(met, false)), '') AS violations FROM met JOIN (VALUES " + ", ".join(f"({k}, '{v}')" for k, v in _TEXTS.items()) + ") x(constraint_id, t) USING (constraint_id) GROUP BY 1")
def pred_violations(spark, sf_dir):
    return predicates.violations(described(spark, sf_dir), constraints(spark)).select("parent_asin", F.array_join("violations", "; ").alias("violations"))
