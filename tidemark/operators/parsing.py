"""Constraints in messages: token n-grams against a vocabulary of catalogue values, in their context."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import lookups, messages, text

MAX_WORDS = 3
#: Place behind all words of a message.
LATE = 1_000_000_000
# Single words that are never a value, and the request words, cues and negations around one.
STOPWORDS = "a an and as at brand by for from key my new of on or requirement style the to want".split()
REQUEST = r"\b(?:looking for|shopping for|need|want|find|show me)\b"
CUES = {"brand": r"\b(?:brand|by|from)(?: is)?$", "style": r"\b(?:style|styled|look|design)(?: is)?$", "size": r"\b(?:size|sized|wear|in)\b", "feature": r"\b(?:feature|need|want|must have|with|looking for|prefer)\b", "category": REQUEST}
NEGATION = r"\b(?:not|without|no|don ?t want|do not want|doesn ?t include|does not include)$"
FIXED = {"color": lookups.COLORS, "material": lookups.MATERIALS, "style": lookups.STYLES, "feature": lookups.FEATURES, "use_case": lookups.USE_CASES}


def last_word_forms(value: Column) -> Column:
    """The value with its last word in singular and plural, and grey for gray."""
    other = F.when(value.rlike("[^s]s$") & (F.length(value) > 3), F.expr("left(v, length(v) - 1)")).otherwise(F.concat(value, F.lit("s")))
    return F.array_distinct(F.array_compact(F.array(value, other, F.when(value.rlike(r"ies$"), F.regexp_replace(value, "ies$", "y")), F.when(value.rlike(r"\bgray$"), F.regexp_replace(value, "gray$", "grey")))))


def vocabulary(postings: DataFrame) -> DataFrame:
    """(alias, attribute, value, fixed): what words mean, of the catalogue's postings (attribute, value) and the fixed
    vocabularies. Values of up to MAX_WORDS words."""
    fixed = F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.lit(v).alias("value")) for a, vs in FIXED.items() for v in vs])).alias("f")
    known = postings.sparkSession.range(1).select(fixed).select("f.attribute", F.when(F.col("f.value") == "grey", "gray").otherwise(F.col("f.value")).alias("value")).distinct().withColumn("fixed", F.lit(True))
    seen = postings.filter(F.col("attribute").isin("brand", "category", "color", "feature", "material", "size", "style", "use_case")).select("attribute", text.normalize_value(F.col("value")).alias("value")).distinct()
    every = seen.join(known.select("attribute", "value"), ["attribute", "value"], "left_anti").withColumn("fixed", F.lit(False)).unionByName(known)
    words = text.terms(F.col("value"))
    usable = every.filter(F.size(words).between(1, MAX_WORDS) & ~F.exists(words, lambda w: F.length(w) < 2)).withColumn("v", F.array_join(words, " ")).filter(~F.col("v").isin(*STOPWORDS))
    aliases = usable.select(F.explode(last_word_forms(F.col("v"))).alias("alias"), "attribute", "value", "fixed")
    # of values with the same alias the longest counts, then the first in order
    return aliases.groupBy("alias", "attribute").agg(F.min(F.struct(-F.length("value"), "value", "fixed")).alias("m")).select("alias", "attribute", "m.value", "m.fixed")


def mentions(rows: DataFrame, words: DataFrame) -> DataFrame:
    """(message_id, attribute, start, end, value, negated) of ``rows`` (message_id, message): values that a message
    names, places in words from 0, end exclusive. Of overlapping values of one attribute the first, longest one stays."""
    tokens = F.filter(F.split(F.lower(F.regexp_replace(text.normalize_value(F.col("message")), r"['’]s\b", " ")), "[^a-z0-9]+"), lambda t: t != "")
    base = rows.select("message_id", tokens.alias("t"))
    def of(n: int) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.greatest(F.size("t") - n, F.lit(0))), lambda i: i + n <= F.size("t"))
        return F.transform(places, lambda i: F.struct(i.alias("start"), (i + n).alias("end"), F.array_join(F.slice("t", i + 1, n), " ").alias("alias")))

    grams = base.select("message_id", "t", F.explode(F.concat(*[of(n) for n in range(1, MAX_WORDS + 1)])).alias("g")).select("message_id", "t", "g.*")
    found = grams.join(words, "alias").withColumn("before", F.array_join(F.slice("t", 1, F.col("start")), " "))
    allowed = reduce(lambda c, a: c.when(F.col("attribute") == a, F.col("before").rlike(CUES[a])), CUES, F.when(F.col("fixed"), True))
    known = (F.col("attribute") == "category") & text.category_value(F.col("value")).isin(*sorted({w.rstrip("s") if not w.endswith("ss") else w for w in messages.KNOWN_CATEGORIES} | {"dress"}))
    kept = found.filter(allowed.otherwise(True) | known).withColumn("negated", F.col("before").rlike(NEGATION))
    spans = kept.groupBy("message_id", "attribute").agg(F.array_sort(F.collect_set(F.struct("start", (-F.col("end")).alias("back"), "value", "negated"))).alias("s"))
    empty = F.lit(None).cast("array<struct<start:int,back:int,value:string,negated:boolean>>")
    chosen = F.aggregate("s", F.coalesce(empty, F.array().cast("array<struct<start:int,back:int,value:string,negated:boolean>>")), lambda acc, x: F.when((F.size(acc) == 0) | (x["start"] >= -F.element_at(acc, -1)["back"]), F.concat(acc, F.array(x))).otherwise(acc))
    return spans.select("message_id", "attribute", F.explode(chosen).alias("m")).select("message_id", "attribute", "m.start", (-F.col("m.back")).alias("end"), "m.value", "m.negated")


def constraints(rows: DataFrame, words: DataFrame) -> DataFrame:
    """(message_id, place, attribute, operator, value, upper_value, alternatives) of each message (message_id, message);
    place orders them as the message states them, budgets and a phrase's category last.

    Values of one attribute joined by "or" are alternatives (in); a negation before them makes not_in. Budgets come
    from their own statements, a category without vocabulary from the request's phrase. Messages that only steer
    (no preference, continuation) state none."""
    flags = messages.flags(F.col("message"))
    plain = rows.filter(~flags["no_preference"] & ~flags["is_continuation"]).select("message_id", "message")
    tokens = F.filter(F.split(F.lower(F.regexp_replace(text.normalize_value(F.col("message")), r"['’]s\b", " ")), "[^a-z0-9]+"), lambda t: t != "")
    found = mentions(plain, words).join(plain.select("message_id", tokens.alias("t")), "message_id")
    from pyspark.sql import Window

    order = Window.partitionBy("message_id", "attribute").orderBy("start")
    gap = F.array_join(F.slice("t", F.lag("end").over(order) + 1, F.greatest(F.col("start") - F.lag("end").over(order), F.lit(0))), " ")
    chained = found.withColumn("new", F.when(gap == "or", 0).otherwise(1)).withColumn("chain", F.sum("new").over(order))
    grouped = chained.groupBy("message_id", "attribute", "chain").agg(F.array_sort(F.collect_list(F.struct("start", "value", "negated"))).alias("v"))
    values = F.array_distinct(F.col("v.value"))
    negated = F.col("v")[0]["negated"]
    operator = F.when(negated, "not_in").when(F.size("v") > 1, "in").otherwise("eq")
    none = F.lit(None).cast("string")
    stated = grouped.select("message_id", F.col("v")[0]["start"].alias("place"), "attribute", operator.alias("operator"), F.col("v")[0]["value"].alias("value"), none.alias("upper_value"), F.when(negated | (F.size("v") > 1), F.array_join(values, "|")).otherwise("").alias("alternatives"))
    money = plain.select("message_id", F.posexplode(messages.budgets(F.col("message"))).alias("place", "b")).select("message_id", (F.col("place") + LATE).alias("place"), F.lit("budget").alias("attribute"), "b.operator", "b.value", "b.upper_value", F.lit("").alias("alternatives"))
    category = plain.select("message_id", messages.named_category(F.col("message")).alias("value")).filter("value IS NOT NULL").join(stated.filter("attribute = 'category'").select("message_id"), "message_id", "left_anti")
    category = category.select("message_id", F.lit(2 * LATE).alias("place"), F.lit("category").alias("attribute"), F.lit("eq").alias("operator"), "value", none.alias("upper_value"), F.lit("").alias("alternatives"))
    return stated.unionByName(money).unionByName(category).distinct()


# Attributes whose question may be answered in free words, and words that answer nothing.
FREE = ("brand", "category", "feature", "other", "size", "style", "use_case")
FILLERS = ("a", "an", "and", "any", "are", "can", "do", "for", "have", "i", "id", "im", "is", "it", "just", "like", "me", "my", "need", "of", "one", "please", "prefer", "the", "that", "to", "want", "what", "would")
LEAD_IN = r"^for that,?\s*(?:what matters is:?)?\s*"


def pending(rows: DataFrame, words: DataFrame) -> DataFrame:
    """(message_id, attribute, value): free words that answer the question put before. ``rows`` (message_id, message,
    expected), expected being the attribute asked about.

    A message answers in free words if some of its words are neither values of the vocabulary nor part of a budget nor
    (unless a style was asked for) a known category, nor fillers; messages that only steer answer nothing."""
    flags = messages.flags(F.col("message"))
    m = text.normalize_value(F.col("message"))
    open_ = rows.filter(F.col("expected").isin(*FREE) & ~flags["no_preference"] & ~flags["is_continuation"])
    tokens = F.filter(F.split(F.lower(F.regexp_replace(m, r"['’]s\b", " ")), "[^a-z0-9]+"), lambda t: t != "")
    covered = mentions(open_.select("message_id", "message"), words).groupBy("message_id").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    money = F.array_join(F.concat(*[F.regexp_extract_all(m, F.lit(f"(?i){p}"), F.lit(0)) for p in (messages.BETWEEN, messages.DIRECTION, messages.PLAIN)]), " ")
    known = F.when(F.col("expected") == "style", F.array().cast("array<string>")).otherwise(text.literals(list(messages.KNOWN_CATEGORIES)))
    joined = open_.join(covered, "message_id", "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")))
    left = F.filter(tokens, lambda t, i: ~F.exists("spans", lambda s: (s["start"] <= i) & (i < s["end"])))
    left = F.array_except(F.array_except(F.array_except(left, text.tokens(money)), known), text.literals(list(FILLERS)))
    value = F.regexp_replace(F.regexp_replace(m, LEAD_IN, ""), r"^[ .;:]+|[ .;:]+$", "")
    return joined.filter(F.size(left) > 0).select("message_id", F.col("expected").alias("attribute"), value.alias("value")).filter("value <> ''")
