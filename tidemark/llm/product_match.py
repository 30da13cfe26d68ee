"""Listings of one product by different sellers: blocks on rare tokens, n-gram cosine, vetoes, clusters."""

from __future__ import annotations

import math

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.engine import cut, lookup_skewed, spread, trimmed
from tidemark.llm import listing_facts as facts

#: Least cosine of two names; a phrase tells the kind of article if this share of the listings that have it and a
#: category agree; one over the share of all listings from which a word or phrase is common; least number for a phrase.
LEAST_COSINE, PURE, SHARE, LEAST_SUPPORT = 0.45, 0.75, 5000, 3
#: Listings in which a part of a name may be on its own: so many, or one over so many of all.
FEW, FEW_SHARE = 50, 20_000
#: Measures fall into blocks by steps of this ratio; one near an edge falls into both.
STEP = 1.2
#: Inverse frequency of a trigram too rare to be listed.
RARE_GRAM = math.log(100_000)
#: Inverse frequency of a model code as a word of the name.
MODEL_WEIGHT = 8.0
#: Rounds of label propagation before giving up; clusters are stars of a few links, so a handful is enough.
MAX_ROUNDS = 50
#: Bound of the colour list, a fixed table.
MAX_COLOURS = 10_000
#: A title's words belong to its name if their inverse frequency is at least this share of its rarest word's.
NAME_SHARE = 0.5
#: Weight of a rare word that only store, features or description have, against one of the title.
TEXT_WEIGHT = 0.5
#: Classes of a block that are compared in one task; a block of more is compared part by part.
PART = 1000

NAMED = ["asin", "words", "idfs", "model", "kind", "colour", "pack", "quantity", "size"]
_NAMED = "asin string, words array<string>, idfs array<double>, model string, kind string, colour string, pack int, quantity string, size double"
_STATED = ["asin", "title", "others", "colour", "pack", "quantity", "size", "model", "leaf"]
_FACTS = "asin string, title string, others array<string>, colour string, pack int, quantity string, size double, model string, leaf string"


def listings(catalog: DataFrame) -> DataFrame:
    """One row for each parent_asin with a title (null or blank ones can't be told): of differing rows the largest."""
    rows = catalog.filter("parent_asin IS NOT NULL").select("parent_asin", F.struct("title", "features", "description", "categories", "store").alias("r"))
    rows = rows.filter(trimmed(F.col("r.title")) != "")
    return rows.groupBy("parent_asin").agg(F.max("r").alias("r")).select(F.col("parent_asin").alias("asin"), "r.*")


def _state(colours: list[str]):
    def run(batches):
        pattern = facts.colour_pattern(colours)
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                title = facts.fold(r.title)
                texts = [title, *(facts.fold(t) for part in (r.features, r.description) if part is not None for t in part if t)]
                measure = facts.measure_of(texts)
                leaf = next((c for c in reversed([] if r.categories is None else list(r.categories)) if c and c.strip()), None)
                colour = facts.colour_of(texts, pattern)
                bare = facts._MEASURE.sub(" ", facts._PACK.sub(" ", pattern.sub(" ", title)))
                words = facts._WORD.findall(bare.replace("'s ", " "))
                model = facts.model_of(bare)
                others = {w for t in [*texts[1:], facts.fold(r.store or "")] for w in facts._WORD.findall(t) if is_word(w)}
                rows.append((r.asin, " ".join(words), sorted(others.difference(words)), colour, facts.pack_of(texts), measure and measure[0], measure and measure[1], model, leaf and leaf.strip().lower()))
            yield pd.DataFrame(rows, columns=_STATED).astype({"size": "float64", "pack": "int32"})

    return run


def without_parents(stated: DataFrame, catalog: DataFrame) -> DataFrame:
    """``stated`` with leaf null where it stands above another category somewhere: such a path was cut short."""
    above = catalog.select(F.explode(F.slice("categories", 1, F.greatest(F.size("categories") - 1, F.lit(0)))).alias("leaf"))
    above = above.select(F.lower(trimmed("leaf")).alias("leaf")).distinct()
    return stated.join(above, "leaf", "left_anti")


def is_word(w: str) -> bool:
    return w.isalpha() and len(w) >= 4


def common_words(stated: DataFrame, total: int) -> tuple[DataFrame, dict[str, int], set[str]]:
    """(word, n, all): in how many titles a word is, and in how many listings at all; the counts of those in over 1/SHARE
    of the titles, and those in over 1/SHARE of the listings. The latter are at most SHARE times the words of a listing.
    Words that no title has are left out: a seller's own words name no article."""
    title = F.transform(F.array_distinct(F.split("title", " ")), lambda w: F.struct(w.alias("word"), F.lit(1).alias("t")))
    others = F.transform("others", lambda w: F.struct(w.alias("word"), F.lit(0).alias("t")))
    each = stated.select(F.explode(F.concat(title, others)).alias("w")).filter("w.word <> ''")
    counts = each.groupBy("w.word").agg(F.sum("w.t").alias("n"), F.count("*").alias("all")).filter("n > 0")
    counts = cut(counts)
    frequent = counts.filter(F.col("all") > common_from(total)).collect()
    return counts, {r.word: r.n for r in frequent if r.n > common_from(total)}, {r.word for r in frequent}


def common_from(total: int) -> float:
    """Listings that a common word is in more than."""
    return max(total / SHARE, LEAST_SUPPORT)


def _phrases(common):
    def run(batches):
        known = common.value
        for batch in batches:
            rows = set()
            out = []
            for title, leaf in zip(batch["title"], batch["leaf"], strict=True):
                words = title.split()
                rows = {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1) if all(w in known for w in words[i : i + n])}
                out += [(g, leaf) for g in rows]
            yield pd.DataFrame(out, columns=["gram", "leaf"])

    return run


def kind_phrases(stated: DataFrame, common, total: int) -> dict[str, tuple[str, float]]:
    """Phrase of one to three common words to (kind, trust): phrases of titles whose listings agree on the last
    category.

    Each has at least 1/SHARE of all listings, so their number is bounded whatever the number of listings."""
    counts = stated.filter("leaf IS NOT NULL").select("title", "leaf").mapInPandas(_phrases(common), "gram string, leaf string").groupBy("gram", "leaf").agg(F.count("*").alias("n"))
    best = counts.groupBy("gram").agg(F.sum("n").alias("all"), F.max(F.struct("n", "leaf")).alias("top"))
    best = best.filter((F.col("all") >= max(LEAST_SUPPORT, total / SHARE)) & (F.col("top.n") >= PURE * F.col("all")))
    return {r.gram: (r.leaf, (r.n - 2) / (r.all + 2)) for r in best.select("gram", "top.leaf", "top.n", "all").collect()}


def neighbours(words: list[str], common: dict, total: int) -> list[tuple[str, str, str]]:
    """Pairs of neighbouring words of over two letters, neither of them in over FEW listings, with the word they would
    make."""
    few = max(FEW, total / FEW_SHARE)
    return [(a, b, a + b) for a, b in zip(words, words[1:], strict=False) if a.isalpha() and b.isalpha() and len(a) > 2 and len(b) > 2 and common.get(a, 0) <= few and common.get(b, 0) <= few]


def _rare_words(common, everywhere, total: int):
    def run(batches):
        known, frequent = common.value, everywhere.value
        for batch in batches:
            out = []
            for asin, title, others in zip(batch["asin"], batch["title"], batch["others"], strict=True):
                words = title.split()
                rare = {w for w in words if is_word(w) and w not in known} | {j for _, _, j in neighbours(words, known, total) if j not in known}
                out += [(asin, w, True) for w in rare]
                out += [(asin, w, False) for w in others if w not in frequent and w not in rare]
            yield pd.DataFrame(out, columns=["asin", "word", "titled"])

    return run


def _name(kinds: dict, common, total: int):
    def run(batches):
        known = common.value
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                words = r.title.split()
                found = [(n, k, g) for size in (1, 2, 3) for i in range(len(words) - size + 1) if (g := " ".join(words[i : i + size])) in kinds for k, n in [kinds[g]]]
                kind = max(found)[1] if found else None
                rare = [] if r.rare is None else r.rare
                scored = {w: known[w] for w in words if is_word(w) and w in known} | {x["word"]: x["n"] for x in rare if x["titled"]}
                joined = [(a, b, j) for a, b, j in neighbours(words, known, total) if j in scored or j in known]
                scored |= {j: known[j] for _, _, j in joined if j in known}
                parts = {w for a, b, _ in joined for w in (a, b)}
                named = sorted((n, w) for w, n in scored.items() if w not in parts)
                idf = lambda n: math.log(1 + total / n)
                # the two rarest words at least, and all that are about as rare as the first
                name = [(w, idf(n)) for i, (n, w) in enumerate(named) if i < 2 or idf(n) >= NAME_SHARE * idf(named[0][0])]
                name += sorted((x["word"], TEXT_WEIGHT * idf(x["n"])) for x in rare if not x["titled"])
                rows.append((r.asin, [w for w, _ in name], [v for _, v in name], r.model, kind, r.colour, r.pack, r.quantity, r.size))
            yield pd.DataFrame(rows, columns=NAMED).astype({"size": "float64"})

    return run


def named_listings(catalog: DataFrame, colours: DataFrame) -> DataFrame:
    """Each listing's facts and its name: the words of its title whose inverse frequency is near that of the rarest, the
    two rarest in any case, and the rare words of store, features and description that other titles have, at a lower
    weight. Two neighbouring words count as one where other titles write them so. The counts are those of all listings:
    common words are broadcast, the others, each in few listings, are joined."""
    rows = colours.select("canonical").filter("canonical IS NOT NULL").distinct().take(MAX_COLOURS + 1)
    if len(rows) > MAX_COLOURS:
        raise ValueError(f"more than {MAX_COLOURS} colours")
    stated = cut(listings(catalog).mapInPandas(_state([r[0] for r in rows]), _FACTS))
    total = stated.count()
    counts, common, frequent = common_words(stated, total)
    context = catalog.sparkSession.sparkContext
    shared, everywhere = context.broadcast(common), context.broadcast(frequent)
    kinds = kind_phrases(without_parents(stated.select("title", "leaf"), catalog), shared, total)
    each = stated.select("asin", "title", "others").mapInPandas(_rare_words(shared, everywhere, total), "asin string, word string, titled boolean")
    # a word that isn't common in titles is in few of them, one of other texts in few listings: no key is hot
    few = counts.filter(F.col("n") <= common_from(total)).select("word", "n")
    scored = each.join(few, "word").groupBy("asin").agg(F.collect_list(F.struct("word", "n", "titled")).alias("rare"))
    return stated.drop("leaf", "others").join(scored, "asin", "left").mapInPandas(_name(kinds, shared, total), _NAMED)


def shortened(word: str) -> list[str]:
    """The word and what is left of it without one letter: words an edit apart share one of these."""
    return [word, *{word[:i] + word[i + 1 :] for i in range(len(word))}] if len(word) >= 6 else [word] if word else []


def _blocks(batches):
    for batch in batches:
        rows = []
        for r in batch.itertuples(index=False):
            steps = {0} if r.size != r.size else {math.floor(math.log(r.size * f) / math.log(STEP)) for f in (1.0, facts.SAME_RATIO, 1 / facts.SAME_RATIO)}
            keys = {k for w in r.words for k in shortened(w)} | ({f"#{r.model}"} if r.model else set())
            fixed = f"|{r.kind}|{r.colour}|{r.pack}|{r.quantity}|"
            rows += [(xxhash.xxh3_64_intdigest(f"{key}{fixed}{s}") - (1 << 63), r.class_id) for key in keys for s in steps]
        yield pd.DataFrame(rows, columns=["block", "class_id"], dtype="int64")


class Name:
    """A name as its character trigrams, each weighing its inverse frequency times that of its word (of several words
    the rarest), with the sum of the squares."""

    __slots__ = ("square", "weights")

    def __init__(self, words, idfs, idf: dict[str, float]):
        self.weights: dict[str, float] = {}
        for w, weight in sorted(zip(words, idfs, strict=True), key=lambda x: x[1]):
            for i in range(len(w)):
                g = f" {w} "[i : i + 3]
                self.weights[g] = idf.get(g, RARE_GRAM) * weight
        self.square = sum(v * v for v in self.weights.values())


def cosine(a: Name, b: Name, model: str | None = None) -> float:
    """Cosine of two names; a model code that both state counts as one more word of both."""
    code = len(model) * (RARE_GRAM * MODEL_WEIGHT) ** 2 if model else 0.0
    norm = math.sqrt((a.square + code) * (b.square + code))
    few, many = (a.weights, b.weights) if len(a.weights) <= len(b.weights) else (b.weights, a.weights)
    return (code + sum(v * many[g] for g, v in few.items() if g in many)) / norm if norm else 0.0


def same_size(a: float, b: float) -> bool:
    return a != a and b != b or max(a, b) <= facts.SAME_RATIO * min(a, b)


def _links(idf):
    def run(batches):
        """Rows come sorted by block and unit, then model (none first): each is compared with the classes before it in
        its unit that have its model, until all that match it are joined to it: of those that hang together already,
        one link is enough. Those with a model are also compared with those without one, in the same way. In a unit of
        two parts of a block, classes of one part aren't compared: they meet in that part's own unit."""
        weights = idf.value
        at, free, own, model = None, Joined(), Joined(), None
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                if (r.block, r.unit) != at:
                    at, free, own, model = (r.block, r.unit), Joined(), Joined(), None
                if r.model != model:
                    own, model = Joined(), r.model
                member = (r.class_id, Name(r.words, r.idfs, weights), r.size, r.part if r.crossed else None)

                def near(code, new=member):
                    return lambda m: (new[3] is None or m[3] != new[3]) and same_size(m[2], new[2]) and cosine(m[1], new[1], code) >= LEAST_COSINE

                rows += [(m, r.class_id, "same") for m in (own if r.model else free).add(member, near(r.model))]
                if r.model:
                    rows += [(r.class_id, f, r.model) for _, f in free.met(near(None))]
            yield pd.DataFrame(rows, columns=["a", "b", "through"])

    return run


def in_units(blocked: DataFrame, part: int = PART) -> DataFrame:
    """(block, class_id) of blocks with several classes, with the units in which they are compared: (unit, part,
    crossed). A block of up to ``part`` classes is one unit; a larger one is cut into parts by hash, and each part and
    each two parts make a unit, so that every two classes meet in one and no task holds the block."""
    # most blocks hold one class only: those end here, before names are sent anywhere
    counts = blocked.groupBy("block").agg(F.count("*").alias("_n")).filter("_n > 1")
    sized = blocked.join(counts, "block").withColumn("_parts", F.ceil(F.col("_n") / part).cast("int"))
    sized = sized.withColumn("part", F.pmod(F.xxhash64("class_id"), F.col("_parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))
    units = sized.withColumn("_other", other)
    unit = F.least("part", "_other") * F.col("_parts") + F.greatest("part", "_other")
    return units.select("block", "class_id", unit.alias("unit"), "part", (F.col("part") != F.col("_other")).alias("crossed"))


class Joined:
    """Members (id, name, size, part) of a block in groups that hang together."""

    def __init__(self):
        self.groups: list[list] = []

    def met(self, near) -> list[tuple[list, int]]:
        """Each group of which a member is near, with the first such member's id."""
        return [(g, m[0]) for g in self.groups for m in [next((m for m in g if near(m)), None)] if m]

    def add(self, new: tuple, near) -> list[int]:
        """Put ``new`` with all groups it is near to; the ids of the members that met it, one a group."""
        met = self.met(near)
        gone = {id(g) for g, _ in met}
        self.groups = [g for g in self.groups if id(g) not in gone] + [[m for g, _ in met for m in g] + [new]]
        return [m for _, m in met]


def components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, label) with the least node of each connected component, by label propagation with pointer jumping.

    ``links`` (a, b) BIGINT. All rounds are joins; each is cut from its lineage; only the number of changes reaches
    the driver."""
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(nodes.select("node", F.col("node").alias("label")))
    for _ in range(MAX_ROUNDS):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("seen"))
        step = labels.join(near, "node", "left").select("node", "label", F.least("label", F.coalesce("seen", "label")).alias("next"))
        jump = step.join(labels.select(F.col("node").alias("next"), F.col("label").alias("jumped")), "next", "left")
        fresh = cut(jump.select("node", F.least("next", "jumped").alias("label"), (F.col("label") != F.least("next", "jumped")).alias("changed")))
        labels = fresh.select("node", "label")
        if not fresh.filter("changed").limit(1).count():
            return labels
    raise RuntimeError(f"labels still change after {MAX_ROUNDS} rounds")


def product_groups(catalog: DataFrame, colours: DataFrame) -> DataFrame:
    """(asin, group_id, model) of all listings with a title: listings of the same article have the same group_id.

    Listings that state the same (name, model code, kind, colour, pack count, measure) make a class, however many they
    are. Classes meet in blocks of any word of the name (up to one letter) and equal kind, colour, pack count and about
    equal measure; in a block each is compared with all it doesn't hang together with yet. Two different
    model codes are never the same; classes without a code that hang together join that with the most listings among
    those they fit.
    Prices, audience, ratings and details don't decide; of the store's words only those that titles name articles by. Nulls in any field are no statement; an unstated
    colour, measure or kind equals only an unstated one; an unstated pack count is one piece. An empty table gives
    no group.
    """
    named = cut(named_listings(catalog, colours))
    size_key = F.round(F.log("size") * 100)
    signature = ["name", "model", "kind", "colour", "pack", "quantity", "size_key"]
    sized = named.withColumn("size_key", size_key).withColumn("name", F.concat_ws(" ", "words"))
    sized = sized.withColumn("class_id", F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in signature])).drop("size_key", "name")
    classes = sized.groupBy("class_id").agg(*[F.min(c).alias(c) for c in ("words", "idfs", "model", "kind", "colour", "pack", "quantity", "size")], F.count("*").alias("members"))
    classes = cut(classes)
    letters = named.select(F.explode("words").alias("w"))
    letters = letters.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("w")), lambda i: F.substring(F.concat(F.lit(" "), "w", F.lit(" ")), i, 3))).alias("g"))
    total = max(1, named.count())
    # the folded words have letters and digits only as far as \w goes; trigrams of any script are few beside the rows
    frequent = letters.groupBy("g").agg(F.count("*").alias("n")).filter(F.col("n") * 100_000 > total)
    idf = {r.g: math.log(1 + total / r.n) for r in frequent.collect()}
    shared = catalog.sparkSession.sparkContext.broadcast(idf)
    units = in_units(classes.mapInPandas(_blocks, "block bigint, class_id bigint"))
    compared = spread(units.join(classes.select("class_id", "model", "words", "idfs", "size"), "class_id"), "block", "unit")
    compared = compared.sortWithinPartitions("block", "unit", F.col("model").asc_nulls_first(), "words", "class_id")
    found = compared.mapInPandas(_links(shared), "a bigint, b bigint, through string").filter("a <> b").distinct()
    found = cut(found)
    # classes without model code that hang together go with one model only: the one with the most listings behind it
    same = found.filter("through = 'same'").select("a", "b")
    coded = found.filter("through <> 'same'")
    joined = components(same, classes.select(F.col("class_id").alias("node"))).select(F.col("node").alias("b"), F.col("label").alias("free"))
    coded = cut(coded.join(joined, "b"))
    weight = coded.select("a", "through", "free").distinct().join(classes.select(F.col("class_id").alias("a"), "members"), "a").groupBy("free", "through").agg(F.sum("members").alias("m"))
    chosen = weight.groupBy("free").agg(F.max_by("through", F.struct("m", "through")).alias("through"))
    links = same.unionByName(coded.join(chosen, ["free", "through"]).select("a", "b"))
    labels = components(links, classes.select(F.col("class_id").alias("node")))
    groups = labels.select(F.col("node").alias("class_id"), F.col("label").alias("group_id")).join(classes.select("class_id", "members"), "class_id")
    return lookup_skewed(sized, groups, ["class_id"], "members", ["group_id"]).select("asin", "group_id", "model")


def same_products(catalog: DataFrame, colours: DataFrame) -> DataFrame:
    """(asin_a, asin_b), asin_a < asin_b: the pairs of listings in one group whose model codes don't differ."""
    groups = cut(product_groups(catalog, colours))
    several = groups.join(groups.groupBy("group_id").agg(F.count("*").alias("n")).filter("n > 1"), "group_id").drop("n")
    a = several.select("group_id", F.col("asin").alias("asin_a"), F.col("model").alias("model_a"))
    b = several.select("group_id", F.col("asin").alias("asin_b"), F.col("model").alias("model_b"))
    pairs = a.join(b, "group_id").filter("asin_a < asin_b AND (model_a IS NULL OR model_b IS NULL OR model_a = model_b)")
    return pairs.select("asin_a", "asin_b")
