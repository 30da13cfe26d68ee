"""Evaluation texts inside a corpus: a broadcast set of the items' word n-grams, windows of every document, checked hits."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import latex

GRAM = 3
#: Share of an item's words that a document must hold, in at most two pieces.
SHARE = 0.4
#: Words that may lie between two hits of one piece (replaced ones, or words of the document's own).
GAP, DRIFT = 6, 3
#: Bounds of what is broadcast, checked before anything is gathered: the items are a fixed evaluation set.
MAX_ITEM_WORDS, MAX_ITEM_CHARS = 5_000_000, 50_000_000


class Items:
    """The n-grams of all items, as sorted codes with the (item, position) pairs of each.

    Codes are numbers, not hashes: a window's code is the number of its beginning among the items' own beginnings, times
    the size of the vocabulary, plus its last word. With at most MAX_ITEM_WORDS of each this stays in 64 bits and equal
    codes mean equal words."""

    def __init__(self, items: list[tuple[int, str]]):
        self.vocabulary: dict[str, int] = {}
        words = {i: latex.words(text) for i, text in items}
        self.sizes = {i: len(own) for i, own in words.items()}
        if sum(self.sizes.values()) > MAX_ITEM_WORDS:
            raise ValueError(f"the items have more than {MAX_ITEM_WORDS} words")
        ids = {i: np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in own], dtype=np.int64) for i, own in words.items()}
        self.base = len(self.vocabulary) + 1
        self.heads: list[np.ndarray] = []
        for n in range(2, GRAM):
            found = [self._append(n, *self._begin(own, n)) for own in ids.values()]
            self.heads.append(np.unique(np.concatenate([*found, np.zeros(0, dtype=np.int64)])))
        grams: dict[int, list] = defaultdict(list)
        for i, own in ids.items():
            for p, code in enumerate(self.codes(own).tolist()):
                grams[code].append((i, p))
        self.known = np.array(sorted(grams), dtype=np.int64)
        self.places = [grams[c] for c in self.known.tolist()]

    def _begin(self, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the first n - 1 words of each window of n (0: in no item), and its last words."""
        many = max(0, len(ids) - n + 1)
        code = ids[:many]
        for k in range(2, n):
            code = self._append(k, code, ids[k - 1 : k - 1 + many])
            heads = self.heads[k - 2]
            at = np.minimum(np.searchsorted(heads, code), max(len(heads) - 1, 0))
            code = np.where((code > 0) & (heads[at] == code), at + 1, 0) if len(heads) else np.zeros_like(code)
        return code, ids[n - 1 : n - 1 + many]

    def _append(self, n: int, head: np.ndarray, last: np.ndarray) -> np.ndarray:
        return np.where((head > 0) & (last > 0), head * self.base + last, 0)

    def codes(self, ids: np.ndarray) -> np.ndarray:
        """One code for each window of GRAM words, 0 where a word or the window's beginning is in no item."""
        return self._append(GRAM, *self._begin(ids, GRAM))


def pieces(hits: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """Pieces (first and last item word, first and last document word) of one item's hits (document place, item
    place): a hit goes on with the piece whose end lies nearest before it, in both texts."""
    done, open_ = [], []
    for k, p in sorted(hits):
        best = None
        for piece in open_:
            ahead, on = k - piece[3], p - piece[1]
            if 0 < ahead <= GAP + GRAM and 0 < on <= GAP + GRAM and abs(ahead - on) <= DRIFT and (best is None or abs(ahead - on) < abs(k - best[3] - p + best[1])):
                best = piece
        if best is None:
            open_.append([p, p, k, k])
        else:
            best[1], best[3] = p, k
        if len(open_) > 32:
            done += [q for q in open_ if k - q[3] > GAP + GRAM]
            open_ = [q for q in open_ if k - q[3] <= GAP + GRAM]
    return [(a, b + GRAM - 1, c, d + GRAM - 1) for a, b, c, d in done + open_]


def held(found: list[tuple[int, int, int, int]]) -> int:
    """Most words of an item in one piece, or in two that follow each other in both texts without overlap."""
    found = sorted(found, key=lambda q: q[1] - q[0], reverse=True)
    best = 0
    for n, (a, b, c, d) in enumerate(found):
        own = b - a + 1
        if 2 * own <= best:
            break
        best = max(best, own)
        for e, f, g, h in found[n + 1 :]:
            if own + f - e + 1 <= best:
                break
            if (e > b and g > d) or (f < a and h < c):
                best = own + f - e + 1
                break
            # overlapping in the item's order: what the second adds
            if e > a and f > b and g > d or e < a and f < b and h < c:
                best = max(best, own + (f - b if e > a else a - e))
    return best


def find_leaks(documents: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """(item_id, doc_id) of the documents that hold at least ``share`` of an item's words in its order.

    Every window of every whole text is looked up, comments and appendices included; a document is checked for an
    item from its first hit on. Null, empty and blank texts, and items without GRAM words, give no row. A doc_id or
    item_id that repeats gives one row for a pair. Other columns are ignored; empty tables give none. No shuffle but
    that of the found pairs: only the items' n-grams are broadcast, the size of the items is checked.
    """
    rows = items.filter("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").distinct()
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    if size.n > MAX_ITEM_WORDS or size.chars > MAX_ITEM_CHARS:
        raise ValueError(f"more than {MAX_ITEM_WORDS} items or {MAX_ITEM_CHARS} characters of items")
    index = Items([(r.item_id, r.text) for r in rows.collect()])
    shared = documents.sparkSession.sparkContext.broadcast(index)

    def scan(batches):
        index = shared.value
        get = index.vocabulary.get
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"].tolist(), batch["text"].tolist(), strict=True):
                if not text:
                    continue
                ids = np.array([get(w, 0) for w in latex.words(text)], dtype=np.int64)
                codes = index.codes(ids)
                at = np.flatnonzero(codes)
                where = np.searchsorted(index.known, codes[at])
                where = np.minimum(where, len(index.known) - 1)
                hit = index.known[where] == codes[at] if len(index.known) else np.zeros(0, dtype=bool)
                by_item = defaultdict(list)
                for k, w in zip(at[hit].tolist(), where[hit].tolist(), strict=True):
                    for item, p in index.places[w]:
                        by_item[item].append((k, p))
                out += [(item, doc_id) for item, hits in by_item.items() if held(pieces(hits)) >= share * index.sizes[item]]
            yield pd.DataFrame(out, columns=["item_id", "doc_id"], dtype="int64")

    texts = documents.filter("doc_id IS NOT NULL AND text IS NOT NULL AND text <> ''").select("doc_id", "text")
    return texts.mapInPandas(scan, "item_id bigint, doc_id bigint").distinct()


def without_leaks(documents: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """``documents`` without those that hold an item; a null doc_id can't be told and stays."""
    return documents.join(find_leaks(documents, items, share).select("doc_id").distinct(), "doc_id", "left_anti").select(documents.columns)


def leaked_items(documents: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """(item_id, documents): how many documents hold each item, 0 where none does."""
    counts = find_leaks(documents, items, share).groupBy("item_id").agg(F.count("*").alias("documents"))
    return items.select("item_id").distinct().join(F.broadcast(counts), "item_id", "left").withColumn("documents", F.coalesce("documents", F.lit(0).cast("bigint")))
