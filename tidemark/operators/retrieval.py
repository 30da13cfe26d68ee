"""Candidate sources for many queries at once, and their fusion: lexical, attribute, profile and vector search."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.engine import broadcast_if_small, cut, number_rows
from tidemark.functions import lookups, text
from tidemark.operators.catalog import with_ranks

#: Most vectors that are searched for at once.
MAX_QUERY_VECTORS = 100_000


def query_terms(queries: DataFrame, limit: int = lookups.MAX_QUERY_TERMS) -> DataFrame:
    """(query_id, term): the first distinct terms of each query's text."""
    return queries.select("query_id", F.explode(F.slice(text.terms(F.col("text")), 1, limit)).alias("term"))


def document_terms(documents: DataFrame, key: str, column: str = "text") -> DataFrame:
    """(key, term, tf) of one text column."""
    return documents.select(key, F.explode(text.tokens(F.col(column))).alias("term")).groupBy(key, "term").agg(F.count("*").cast("double").alias("tf"))


def bm25(queries: DataFrame, terms: DataFrame, lengths: DataFrame, key: str) -> DataFrame:
    """(query_id, key, score) by BM25 over weighted term counts.

    ``terms`` (key, term, tf), ``lengths`` (key, length in tokens). A query's terms are joined to their postings, so
    only documents that share a term are scored; scores are summed by (query, document) before the shuffle."""
    wanted = broadcast_if_small(query_terms(queries))
    stats = lengths.agg(F.count("*").alias("_n"), F.avg("length").alias("_avg"))
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    # only the frequencies of asked terms are needed, at most as many as there are query terms
    df = broadcast_if_small(df.join(wanted, "term", "left_semi"))
    hit = terms.join(wanted, "term").join(df, "term").join(lengths, key).crossJoin(F.broadcast(stats))  # one row
    return bm25_scores(hit, key)


def bm25_scores(hit: DataFrame, key: str, *more) -> DataFrame:
    """(query_id, key, score, and the aggregates ``more``) of rows (query_id, key, tf, df, length, _n, _avg): a query's
    terms that a document has, the number of documents that have the term, of all documents, and their mean length."""
    idf = F.log((F.col("_n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(idf > 0, idf).otherwise(1e-6)
    k1, b = lookups.BM25_K1, lookups.BM25_B
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("_avg")))
    return hit.groupBy("query_id", key).agg(F.sum(part).alias("score"), *more)


def mask_scores(queries: DataFrame, term_fields: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(query_id, parent_asin, score): for each query term that a product has, the weights of the fields that have it.

    ``terms`` (query_id, term) stands for the queries' own terms. A query set of checked size goes to the term table,
    whose rows lie by product: then nothing is shuffled."""
    wanted = broadcast_if_small(query_terms(queries) if terms is None else terms)
    return term_fields.select("parent_asin", "term", "weight").join(wanted, "term").groupBy("query_id", "parent_asin").agg(F.sum("weight").alias("score"))


def mask_columns(terms: DataFrame, term_fields: DataFrame, quality: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What mask_top needs of the products: (parent_asin, place), numbered from the best quality on, by id where equal;
    (term, word), the asked terms numbered; (place, word, weight), the fields' weights of the asked terms."""
    order = quality.select("parent_asin", (-F.round("quality", 9)).alias("_q"))
    places = cut(number_rows(order, ["_q", "parent_asin"], "place").select("parent_asin", "place"))
    words = cut(number_rows(terms.select("term").distinct(), ["term"], "word").select("term", F.col("word").cast("int").alias("word")))
    columns = term_fields.select("parent_asin", "term", "weight").join(broadcast_if_small(words), "term").join(places, "parent_asin")
    return places, words, cut(columns.select("place", "word", F.col("weight").cast("float").alias("weight")))


def mask_top(terms: DataFrame, prepared: tuple[DataFrame, DataFrame, DataFrame], k: int, part: int = 262_144, block: int | None = None) -> DataFrame:
    """(query_id, parent_asin, score, rank): each query's first ``k`` products by mask_scores, then quality, then id.

    Every term of ``terms`` (query_id, term) counts, however many products have it; ``prepared`` comes of mask_columns
    for these terms or more. Products are cut into parts of up to ``part``, queries into blocks of up to ``block``, five
    million rows of a result unless given; each part meets each block in one task, in which each query adds up the
    columns of its terms. One list a query and part goes on; with one part it is the result. Nothing is broadcast or
    gathered, so both sides may grow. The field weights are halves, so the sums are exact."""
    places, words, _ = prepared
    asked = cut(terms.distinct().join(broadcast_if_small(words), "term").groupBy("query_id").agg(F.collect_list("word").alias("words")))
    lists = by_part(asked, "query_id", prepared, _mask_part(k), "query_id bigint, places array<bigint>, scores array<int>", part, block or max(1, 5_000_000 // k))
    near = lists.select("query_id", F.posexplode(F.arrays_zip("places", "scores")).alias("rank", "x"))
    near = near.select("query_id", F.col("x.places").alias("place"), (F.col("x.scores") / 2).alias("score"), (F.col("rank") + 1).alias("rank"))
    if places.count() > part:
        near = top_k(near.drop("rank"), ["query_id"], k, F.col("score").desc(), F.col("place"))
    return near.join(broadcast_if_small(places), "place").select("query_id", "parent_asin", "score", "rank")


def _mask_part(k: int):
    head = max(4096, k)

    def search(columns: Columns, start: int, alone: bool, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        for query, words in zip(queries["query_id"], queries["words"], strict=True):
            sums = columns.zeros()
            for w in words:
                columns.add(sums, w)
            least, here = 1, sums[:head]
            if len(here) > k:
                least = max(np.partition(here, len(here) - k)[len(here) - k], least)
            # if k products of the head have the least score already, only higher ones can enter behind it
            full = int((here >= least).sum()) >= k
            near = np.concatenate([np.flatnonzero(here >= least), len(here) + np.flatnonzero(sums[head:] >= least + full)])
            near = near[np.argsort(-sums[near].astype(np.int32), kind="stable")[:k]]
            if len(near):
                out.append((query, near + start, sums[near].astype(np.int32)))
        return pd.DataFrame(out, columns=["query_id", "places", "scores"])

    return search


class Columns:
    """The packed columns of one part of the products: for each word, the products that have it and their weights in
    halves. Sums of them have 16 bits: a query has at most MAX_QUERY_TERMS words."""

    def __init__(self, size: int, packed: pd.DataFrame):
        self.size, self.at, self.dense = size, {}, {}
        for words, bounds, places, weights in zip(*(packed[c] for c in ("words", "bounds", "places", "weights")), strict=True):
            bounds, places, weights = np.frombuffer(bounds, np.int32), np.frombuffer(places, np.int32), np.frombuffer(weights, np.uint8)
            for i, w in enumerate(np.frombuffer(words, np.int32).tolist()):
                self.at[w] = places[bounds[i] : bounds[i + 1]], weights[bounds[i] : bounds[i + 1]]

    def zeros(self):
        return np.zeros(self.size, np.uint16)

    def add(self, sums, word: int) -> None:
        if word not in self.at:
            return
        places, weights = self.at[word]
        if len(places) * 24 < self.size:
            sums[places] += weights
            return
        if word not in self.dense:
            if len(self.dense) * self.size > 50_000_000:  # 100 MB
                self.dense.clear()
            self.dense[word] = self.zeros()
            self.dense[word][places] = weights
        np.add(sums, self.dense[word], out=sums)


def by_part(queries: DataFrame, key: str, prepared: tuple[DataFrame, DataFrame, DataFrame], search, schema: str, part: int = 262_144, block: int = 50_000) -> DataFrame:
    """What ``search`` returns (``schema``) for each part of up to ``part`` products and each block of up to ``block``
    queries (by hash of ``key``), every pair of them in a task.

    ``prepared`` comes of mask_columns; a part's columns are packed once and sent to each block. ``search`` takes the
    part's Columns, its first place, whether it is the only part, and the block of queries."""
    places, _, columns = prepared
    n = max(places.count(), 1)
    size = min(part, n)
    parts = (n - 1) // size + 1
    cores = 2 * places.sparkSession.sparkContext.defaultParallelism
    blocks = max(-(-cores // parts), -(-queries.count() // block))
    keyed = columns.select(F.floor(F.col("place") / size).cast("int").alias("p"), F.pmod("word", F.lit(8)).alias("_w"), "place", "word", "weight")
    packed = cut(keyed.groupBy("p", "_w").applyInPandas(_pack(size), "p int, words binary, bounds binary, places binary, weights binary"))
    held = packed.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = queries.withColumn("b", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def pair(key: tuple, columns: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        return search(Columns(size, columns), key[0] * size, parts == 1, queries)

    # a number of its own for the shuffle: by their bytes the pairs would be merged into a few tasks
    apart = lambda df: df.repartition(4 * parts * blocks, "p", "b").groupBy("p", "b")
    return apart(held).cogroup(apart(asked)).applyInPandas(pair, schema)


def _pack(size: int):
    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        place, word, weight = (rows[c].to_numpy() for c in ("place", "word", "weight"))
        by = np.lexsort((place, word))
        found, first = np.unique(word[by], return_index=True)
        cells = found.astype(np.int32), np.append(first, len(by)).astype(np.int32), (place[by] - key[0] * size).astype(np.int32), np.rint(2 * weight[by]).astype(np.uint8)
        return pd.DataFrame([(key[0], *(c.tobytes() for c in cells))], columns=["p", "words", "bounds", "places", "weights"])

    return pack


def top_k(scored: DataFrame, by: list, k: int, *order) -> DataFrame:
    """The first ``k`` rows of each group with their rank; groups are cut to k rows before the shuffle."""
    return with_ranks(scored, by, list(order)).filter(F.col("rank") <= k)


def all_terms(requests: DataFrame, postings: DataFrame) -> DataFrame:
    """(request_id, parent_asin) of the products that have all of a request's terms. ``requests`` (request_id, term),
    ``postings`` (parent_asin, term)."""
    need = requests.groupBy("request_id").agg(F.countDistinct("term").alias("need"))
    have = requests.distinct().join(postings.distinct(), "term").groupBy("request_id", "parent_asin").agg(F.count("*").alias("have"))
    return have.join(need, "request_id").filter("have = need").select("request_id", "parent_asin")


def attribute_candidates(plans: DataFrame, postings: DataFrame) -> DataFrame:
    """(query_id, parent_asin, and the postings' quality and price if they have them) meeting every constraint of a plan
    by postings.

    ``plans`` (query_id, constraint_id, operator, attribute, value), one row for each value of a constraint. Values of
    one constraint are alternatives; not_in takes the products that have the attribute without the values."""
    more = [c for c in ("quality", "price") if c in postings.columns]
    plans = broadcast_if_small(plans)
    wanted = postings.select("parent_asin", "attribute", "value", *more).join(plans, ["attribute", "value"]).select("query_id", "constraint_id", "operator", "parent_asin", *more).distinct()
    matched = wanted.filter("operator <> 'not_in'").drop("operator")
    present = plans.filter("operator = 'not_in'").select("query_id", "constraint_id", "attribute").distinct()
    present = postings.select("parent_asin", "attribute", *more).distinct().join(broadcast_if_small(present), "attribute").select("query_id", "constraint_id", "parent_asin", *more)
    rest = present.join(wanted.filter("operator = 'not_in'"), ["query_id", "constraint_id", "parent_asin"], "left_anti")
    need = plans.groupBy("query_id").agg(F.countDistinct("constraint_id").alias("need"))
    have = matched.unionByName(rest).groupBy("query_id", "parent_asin").agg(F.count("*").alias("have"), *[F.max(c).alias(c) for c in more])
    return have.join(broadcast_if_small(need), "query_id").filter("have = need").select("query_id", "parent_asin", *more)


def profile_hits(preferences: DataFrame, postings: DataFrame) -> DataFrame:
    """(query_id, parent_asin, hits, and quality if the postings have it): how many of a query's soft preferences
    (attribute, value) a product has. Preferences of a checked size are broadcast, so that no value of many products
    meets in one task."""
    more = [c for c in ("quality",) if c in postings.columns]
    rows = postings.select("parent_asin", "attribute", "value", *more).distinct()
    return rows.join(broadcast_if_small(preferences.distinct()), ["attribute", "value"]).groupBy("query_id", "parent_asin").agg(F.count("*").alias("hits"), *[F.max(c).alias(c) for c in more])


def dense_top_k(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", column: str = "embedding", digits: int = 9) -> DataFrame:
    """(query_id, key, score): the k vectors of largest inner product with each query, by id where equal in so many
    digits.

    Queries (query_id, vector) are a set of checked size, broadcast as one matrix; all vectors are read once. Blocks of
    vectors meet blocks of queries, each keeps what may be among the first k, and only k rows a query and task are
    shuffled. Null vectors are left out."""
    asked = queries.orderBy("query_id").limit(MAX_QUERY_VECTORS + 1).collect()
    if len(asked) > MAX_QUERY_VECTORS:
        raise ValueError(f"search at most {MAX_QUERY_VECTORS} vectors at once")
    ids = [r.query_id for r in asked]
    matrix = vectors.sparkSession.sparkContext.broadcast(np.array([r.vector for r in asked], dtype=np.float64))
    kind = vectors.schema[key].dataType.simpleString()

    def scan(batches):
        best: dict[int, list] = {q: [] for q in range(len(ids))}
        least = np.full(len(ids), -np.inf)
        for batch in batches:
            if not len(batch) or not len(ids):
                continue
            batch = batch.sort_values(key, kind="stable")
            names, block = batch[key].tolist(), np.stack(batch[column].to_numpy()).astype(np.float64)
            for start in range(0, len(ids), 256):
                scores = np.round(block @ matrix.value[start : start + 256].T, digits)
                n = len(names)
                floor = least[start : start + scores.shape[1]]
                if n > k:
                    floor = np.maximum(floor, np.partition(scores, n - k, axis=0)[n - k])
                for c, q in enumerate(range(start, start + scores.shape[1])):
                    near = np.flatnonzero(scores[:, c] >= floor[c])
                    near = near[np.argsort(-scores[near, c], kind="stable")[:k]]
                    best[q] = sorted(best[q] + [(-float(scores[i, c]), names[i]) for i in near])[:k]
                    if len(best[q]) == k:
                        least[q] = -best[q][-1][0]
        out = [(ids[q], name, -score) for q, rows in best.items() for score, name in rows]
        yield pd.DataFrame(out, columns=["query_id", key, "score"])

    near = vectors.select(key, column).filter(F.col(column).isNotNull()).mapInPandas(scan, f"query_id bigint, {key} {kind}, score double")
    return top_k(near, ["query_id"], k, F.col("score").desc(), F.col(key))


def fuse(ranked: DataFrame, weights: DataFrame, k: int = lookups.RRF_K) -> DataFrame:
    """(query_id, parent_asin, score, rank) by weighted reciprocal-rank fusion of (query_id, source, parent_asin, rank).

    ``weights`` (source, weight) or with query_id; a source without positive weight still adds its products, with
    score 0; order by score, then id."""
    keys = ["query_id", "source"] if "query_id" in weights.columns else ["source"]
    weighted = ranked.join(F.broadcast(weights) if keys == ["source"] else weights, keys, "left")
    part = F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)) / (k + F.col("rank"))
    scores = weighted.groupBy("query_id", "parent_asin").agg(F.sum(part).alias("score"))
    return with_ranks(scores, ["query_id"], [F.round("score", 9).desc(), "parent_asin"])


def survivors(ranked: DataFrame, allowed: DataFrame, shown: DataFrame) -> DataFrame:
    """``ranked`` (query_id, source, parent_asin, rank) without products that aren't allowed for the query or were
    shown, ranked anew 1, 2, … in the old order."""
    kept = ranked.join(allowed, ["query_id", "parent_asin"], "left_semi").join(shown, ["query_id", "parent_asin"], "left_anti")
    return with_ranks(kept.withColumnRenamed("rank", "_was"), ["query_id", "source"], ["_was", "parent_asin"]).drop("_was")


def fill(exact: DataFrame, relaxed: DataFrame, again: DataFrame, k: int) -> DataFrame:
    """(query_id, parent_asin, stage, rank): the first k of exact, then relaxed, then shown products, once each.

    Each input has (query_id, parent_asin, rank)."""
    staged = exact.withColumn("stage", F.lit(0)).unionByName(relaxed.withColumn("stage", F.lit(1))).unionByName(again.withColumn("stage", F.lit(2)))
    first = staged.groupBy("query_id", "parent_asin").agg(F.min(F.struct("stage", "rank")).alias("f")).select("query_id", "parent_asin", "f.stage", F.col("f.rank").alias("_was"))
    return with_ranks(first, ["query_id"], ["stage", "_was", "parent_asin"]).filter(F.col("rank") <= k).drop("_was")


def rescue_gate(ranked: DataFrame, weights: DataFrame, queries: DataFrame) -> DataFrame:
    """Queries for which vector search is needed: no other source of positive weight has a product left."""
    good = ranked.join(F.broadcast(weights.filter("weight > 0 AND source <> 'dense'")), "source").select("query_id").distinct()
    return queries.select("query_id").distinct().join(good, "query_id", "left_anti")


def jaccard_pairs(candidates: DataFrame, terms: str = "terms") -> DataFrame:
    """(query_id, a, b, similarity) of the pairs inside each query's short candidate list (at most RESULT_LIMIT rows)."""
    short = candidates.filter(F.col("rank") <= lookups.RESULT_LIMIT)
    left, right = short.select("query_id", F.col("parent_asin").alias("a"), F.col(terms).alias("_x")), short.select("query_id", F.col("parent_asin").alias("b"), F.col(terms).alias("_y"))
    union = F.size(F.array_union("_x", "_y"))
    return left.join(right, "query_id").filter("a < b").select("query_id", "a", "b", F.when(union > 0, F.size(F.array_intersect("_x", "_y")) / union).otherwise(0.0).alias("similarity"))


def normalized(column: str, by: list):
    """A score over the largest of its group; negative ones count as 0, a group without positive ones is all 0."""
    value = F.greatest(F.coalesce(column, F.lit(0.0)), F.lit(0.0))
    most = F.max(value).over(Window.partitionBy(*by))
    return F.when(most > 0, value / most).otherwise(0.0)


def mmr_gate(candidates: DataFrame, most_gap: float = 0.025, alike: float = 0.6, pairs: int = 3) -> DataFrame:
    """(query_id, diverse): whether a list is worth making diverse: it goes on behind the tenth place at almost the same
    score, and enough pairs of the first ten are alike. ``candidates`` (query_id, parent_asin, score, rank, terms)."""
    similar = jaccard_pairs(candidates).filter(F.col("similarity") >= alike).groupBy("query_id").agg(F.count("*").alias("pairs"))
    at = lambda r: F.max(F.when(F.col("rank") == r, F.col("score")))
    last, span = lookups.RESULT_LIMIT, F.max("score") - F.min("score")
    gaps = candidates.groupBy("query_id").agg(F.count("*").alias("n"), F.abs(at(last) - at(last + 1)).alias("gap"), span.alias("span"))
    small = F.round(F.when(F.col("span") > 0, F.col("gap") / F.col("span")).otherwise(0.0), 9) <= most_gap
    diverse = (F.col("n") > last) & small & (F.coalesce("pairs", F.lit(0)) >= pairs)
    return gaps.join(similar, "query_id", "left").select("query_id", diverse.alias("diverse"))


def mmr(candidates: DataFrame, k: int = lookups.RESULT_LIMIT, balance: float = lookups.MMR_LAMBDA) -> DataFrame:
    """(query_id, parent_asin, mmr_rank): greedy choice of k products by balance · score − (1 − balance) · the largest
    Jaccard similarity to what is chosen; scores are scaled to 0..1 inside the query; ties go to the id's first letter,
    then to the better rank.

    ``candidates`` (query_id, parent_asin, score, rank, terms) are lists of bounded length (top-k output)."""
    least, most = F.min("score").over(Window.partitionBy("query_id")), F.max("score").over(Window.partitionBy("query_id"))
    scaled = candidates.withColumn("score", F.when(most > least, (F.col("score") - least) / (most - least)).otherwise(0.0))
    lists = scaled.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "parent_asin", "score", "terms"))).alias("items"))

    def choose(batches):
        for batch in batches:
            out = []
            for query, items in zip(batch["query_id"], batch["items"], strict=True):
                left = [(i["parent_asin"], i["score"], frozenset(i["terms"]), i["rank"]) for i in items]
                chosen: list = []
                while left and len(chosen) < k:
                    def gain(c):
                        near = max((len(c[2] & d[2]) / len(c[2] | d[2]) if c[2] | d[2] else 0.0 for d in chosen), default=0.0)
                        return round(balance * c[1] - (1 - balance) * near, 9)

                    best = min(left, key=lambda c: (-gain(c), c[0][:1], c[3]))
                    left.remove(best)
                    chosen.append(best)
                out += [(query, c[0], i) for i, c in enumerate(chosen, 1)]
            yield pd.DataFrame(out, columns=["query_id", "parent_asin", "mmr_rank"]).astype({"mmr_rank": "int32"})

    return lists.mapInPandas(choose, "query_id bigint, parent_asin string, mmr_rank int")


def longest_runs(evidence: DataFrame, documents: DataFrame) -> DataFrame:
    """(query_id, phrase_id, parent_asin, covered, run): how many of a phrase's tokens a product has, and the longest
    stretch that it has in the phrase's order.

    ``evidence`` (query_id, phrase_id, tokens), ``documents`` (query_id, parent_asin, tokens). Matching tokens are
    joined by position; a stretch lies on one diagonal without gaps."""
    e = evidence.select("query_id", "phrase_id", F.posexplode("tokens").alias("ep", "token"))
    d = documents.select("query_id", "parent_asin", F.posexplode("tokens").alias("dp", "token"))
    hit = e.join(d, ["query_id", "token"])
    diagonal = Window.partitionBy("query_id", "phrase_id", "parent_asin", F.col("dp") - F.col("ep")).orderBy("ep")
    islands = hit.withColumn("island", F.col("ep") - F.row_number().over(diagonal)).withColumn("diagonal", F.col("dp") - F.col("ep"))
    runs = islands.groupBy("query_id", "phrase_id", "parent_asin", "diagonal", "island").agg(F.count("*").alias("run"), F.collect_set("token").alias("seen"))
    return runs.groupBy("query_id", "phrase_id", "parent_asin").agg(F.size(F.array_distinct(F.flatten(F.collect_list("seen")))).alias("covered"), F.max("run").alias("run"))


def phrase_scores(evidence: DataFrame, documents: DataFrame) -> DataFrame:
    """(query_id, parent_asin, score): the weighted mean over the query's phrases of 0.4 of the covered share of their
    tokens and 0.6 of the longest run (up to six). ``evidence`` has also weight; products without a hit score 0."""
    runs = longest_runs(evidence, documents)
    sizes = evidence.select("query_id", "phrase_id", "weight", F.size(F.array_distinct("tokens")).alias("n"))
    totals = sizes.groupBy("query_id").agg(F.sum("weight").alias("total"))
    part = F.col("weight") * (lookups.PHRASE_COVERAGE * F.col("covered") / F.col("n") + lookups.PHRASE_RUN * F.least("run", F.lit(lookups.PHRASE_RUN_CAP)) / lookups.PHRASE_RUN_CAP)
    summed = runs.join(sizes, ["query_id", "phrase_id"]).groupBy("query_id", "parent_asin").agg(F.sum(part).alias("sum"))
    every = documents.select("query_id", "parent_asin").join(summed, ["query_id", "parent_asin"], "left").join(totals, "query_id")
    return every.select("query_id", "parent_asin", F.coalesce(F.col("sum") / F.col("total"), F.lit(0.0)).alias("score"))


def rerank(ranked: DataFrame, phrase: DataFrame, blend: float = lookups.PHRASE_BLEND, window: int = lookups.PHRASE_WINDOW) -> DataFrame:
    """(query_id, parent_asin, rank, new_rank): the head of each list in the order of a blend of its old place and its
    phrase score, both scaled to 0..1; the tail stays. A query whose scores are all equal stays as it is."""
    head = ranked.filter(F.col("rank") <= window).join(phrase, ["query_id", "parent_asin"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    w = Window.partitionBy("query_id")
    low, high = F.min("score").over(w), F.max("score").over(w)
    place = 1 - (F.col("rank") - 1) / F.greatest(F.max("rank").over(w) - 1, F.lit(1))
    mixed = head.withColumn("mixed", F.when(high > low, (1 - blend) * place + blend * (F.col("score") - low) / (high - low)).otherwise(place))
    top = with_ranks(mixed, ["query_id"], [F.round("mixed", 9).desc(), "rank"], "new_rank").select("query_id", "parent_asin", "rank", "new_rank")
    return top.unionByName(ranked.filter(F.col("rank") > window).select("query_id", "parent_asin", "rank", F.col("rank").alias("new_rank")))
