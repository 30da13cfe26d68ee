"""Closed-loop simulation: each round's answers make the next message; all sessions are run at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.engine import broadcast_if_small, cut
from tidemark.functions import lookups, text
from tidemark.operators import retrieval
from tidemark.operators.index import Index


def intent_cards(products: DataFrame) -> DataFrame:
    """(parent_asin, card): what a shopper with this product in mind would say, one point after another: material and
    colour named in its texts, then its features and details, then the price; the title if there is nothing."""
    body = text.search_text()
    first = lambda words: F.lower(F.regexp_extract(body, r"(?i)\b(" + "|".join(words) + r")\b", 1))
    material, color = first(lookups.MATERIALS[:9]), first(lookups.COLORS)
    clean = lambda c: F.regexp_replace(F.substring(F.regexp_replace(F.regexp_replace(c, r"\s+", " "), r"^[ \-;,.]+|[ \-;,.]+$", ""), 1, 180), r"\s+$", "")
    none = F.array().cast("array<string>")
    points = F.concat(
        F.when(material != "", F.array(material)).otherwise(none), F.when(color != "", F.array(F.concat(F.lit("color: "), color))).otherwise(none),
        F.coalesce("features", none), F.transform(F.array_sort(F.map_entries(F.coalesce("details", F.create_map().cast("map<string,string>")))), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("")))),
        F.when(F.col("price").isNotNull(), F.array(F.concat(F.lit("budget around $"), F.col("price").cast("string")))).otherwise(none),
    )
    said = F.array_distinct(F.filter(F.transform(points, clean), lambda p: p.isNotNull() & (p != "")))
    return products.select("parent_asin", F.when(F.size(said) > 0, said).otherwise(F.array(F.coalesce(clean(F.col("title")), F.lit("product")))).alias("card"))


def run(labels: DataFrame, index: Index, rounds: int = 10, k: int = lookups.RESULT_LIMIT, part: int = 262_144) -> DataFrame:
    """(session_id, hit, first_hit_turn, best_rank, reciprocal_rank) of sessions (session_id, target).

    Round n: each open session has said the first n points of its target's card; the k best products by field scores
    that weren't shown to it before are shown; a session ends when its target is among them. Sessions with the same
    target go the same way, so each target is run once, all its rounds in one pass.

    Until it is shown, all that a session was shown lies ahead of its target in the order of that round. So only the
    products ahead of the target can matter: those of a higher score than its own, which is known before the search, or
    of the same score and a better place; of these the first k for each round so far."""
    targets = labels.select("target").distinct().join(intent_cards(index.products).withColumnRenamed("parent_asin", "target"), "target")
    upto = F.slice(text.terms(F.array_join(F.slice("card", 1, F.col("round")), " ")), 1, lookups.MAX_QUERY_TERMS)
    said = targets.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).select("target", "round", F.explode(upto).alias("term"))
    said = cut(said.groupBy("target", "term").agg(F.min("round").alias("round")))
    places, words, columns = retrieval.mask_columns(said, index.of(said), index.products)
    asked = said.join(broadcast_if_small(words), "term").join(places.withColumnRenamed("parent_asin", "target"), "target").select("target", "place", "round", "word")
    # the target's own weights: its score in each round
    owned = asked.join(columns, ["place", "word"], "left").withColumn("own", F.coalesce("weight", F.lit(0.0)))
    each = owned.groupBy("target", "place").agg(*[F.collect_list(c).alias(c + "s") for c in ("round", "word", "own")])
    near = retrieval.by_part(each, "target", (places, words, columns), _ahead(rounds, k), "target string, place bigint, rounds binary, places binary, scores binary, own binary", part)
    lists = near.groupBy("target").agg(F.max("place").alias("place"), F.max("own").alias("own"), *[F.collect_list(c).alias(c) for c in ("rounds", "places", "scores")])
    done = cut(lists.mapInPandas(_play(rounds, k), "target string, first_hit_turn int, rank int"))
    out = labels.join(done, "target", "left")
    return out.select("session_id", F.col("rank").isNotNull().alias("hit"), "first_hit_turn", F.col("rank").alias("best_rank"), F.round(F.coalesce(1.0 / F.col("rank"), F.lit(0.0)), 6).alias("reciprocal_rank"))


def _ahead(rounds: int, k: int):
    def search(columns: retrieval.Columns, start: int, alone: bool, queries: pd.DataFrame) -> pd.DataFrame:
        """For each target and round the first k times round products of this part that are ahead of the target."""
        out = []
        for target, place, when, words, own in zip(*(queries[c] for c in ("target", "place", "rounds", "words", "owns")), strict=True):
            when, words = np.asarray(when), np.asarray(words)
            scores = np.cumsum(np.bincount(when, 2 * np.asarray(own), rounds + 1)).astype(np.int64)
            sums, found, shown = columns.zeros(), [], set()
            for n in range(1, rounds + 1):
                for w in words[when == n]:
                    columns.add(sums, w)
                score = scores[n]
                ahead = np.flatnonzero(sums >= max(score, 1))
                value = sums[ahead].astype(np.int64)
                if score:
                    good = (value > score) | (ahead + start < place)
                    ahead, value = ahead[good], value[good]
                if len(ahead) > k * n:
                    good = value >= np.partition(value, len(value) - k * n)[len(value) - k * n]
                    ahead, value = ahead[good], value[good]
                order = np.argsort(-value, kind="stable")[: k * n]
                found.append((np.full(len(order), n, np.int16), ahead[order] + start, value[order]))
                # with all products in this part, the rounds behind the hit aren't needed
                if alone and not _show(found[-1][1], shown, k) and score:
                    break
            when, ahead, value = (np.concatenate(x) for x in zip(*found, strict=True))
            out.append((target, place, when.astype(np.int16).tobytes(), ahead.astype(np.int64).tobytes(), value.astype(np.int64).tobytes(), scores.tobytes()))
        return pd.DataFrame(out, columns=["target", "place", "rounds", "places", "scores", "own"])

    return search


def _show(ahead, shown: set, k: int) -> bool:
    """Add the first k products that weren't shown to ``shown``; whether these fill the page. If not, ``ahead`` has all
    products ahead of the target, and the target comes next."""
    page = [p for p in ahead.tolist() if p not in shown][:k]
    shown.update(page)
    return len(page) == k


def _play(rounds: int, k: int):
    def play(batches):
        for batch in batches:
            out = []
            for target, own, *lists in zip(*(batch[c] for c in ("target", "own", "rounds", "places", "scores")), strict=True):
                when, ahead, value = (np.concatenate([np.frombuffer(b, kind) for b in x]) for x, kind in zip(lists, (np.int16, np.int64, np.int64), strict=True))
                scores, shown = np.frombuffer(own, np.int64), set()
                for n in range(1, rounds + 1):
                    here = np.flatnonzero(when == n)
                    here = here[np.lexsort((ahead[here], -value[here]))]
                    before = len(shown)
                    if not _show(ahead[here], shown, k) and scores[n]:
                        out.append((target, n, len(shown) - before + 1))
                        break
            yield pd.DataFrame(out, columns=["target", "first_hit_turn", "rank"]).astype({"first_hit_turn": "int32", "rank": "int32"})

    return play
