"""Texts about products, profiles and constraints: cards, compact documents, queries, dialogue wording."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import text

# Words that class a constraint; the first class with a hit counts.
CLASSES = [
    ("budget", r"budget|(?:\$|<=|under)\s*\d"), ("material", "cotton|polyester|nylon|leather|wool|spandex|silk|rayon|fabric"), ("color", "color|black|white|blue|red|pink|green"),
    ("size", "size|sizing|width|wide|narrow"), ("style", "department|style|fit|sleeve|neck"), ("use_case", "hiking|running|gym|winter|outdoor|work"),
]
# Category parts that are the taxonomy's root.
ROOTS = ("clothing", "clothing shoes & jewelry", "clothing, shoes & jewelry")
# Wording of the first message, by scenario and variant.
OPENINGS = {
    "buying": ("I'm looking for {0}. A key requirement is: {1}.", "Please find {0}; {1} is essential.", "I need {0}, and it must have: {1}.", "Help me choose {0}. Prioritize {1}."),
    "browsing": ("I'm looking for {0}, but I'm still exploring.", "I'm browsing {0} and have not decided on the details.", "Show me some {0}; I'm open to options.", "I want to explore {0} before narrowing it down."),
    "intent_override": ("I'm looking for {0}. I had been considering {1}.", "Please find {0}; I was initially leaning toward {1}.", "I need {0}. My earlier preference was {1}.", "Help me explore {0}; I started out wanting {1}."),
}
# Shares of the scenarios.
SCENARIOS = {"buying": 0.40, "browsing": 0.40, "intent_override": 0.15, "boundary": 0.05}
# Words that the plain baseline search leaves out.
STOPWORDS = "a an and are as at be but by for from i in is it me my of on or please some that the this to want with would you looking".split()


def classify(value) -> Column:
    """The attribute that a constraint's text is about."""
    lowered = F.lower(value)
    return reduce(lambda c, x: c.when(lowered.rlike(x[1]), x[0]), CLASSES[1:], F.when(lowered.rlike(CLASSES[0][1]), CLASSES[0][0])).otherwise("feature")


def coarse_category(values) -> Column:
    """The last two parts of a category path that aren't its root."""
    parts = F.transform(F.flatten(F.transform(F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda v: v.isNotNull()), lambda v: F.split(v, ","))), lambda p: F.trim(p))
    kept = F.filter(parts, lambda p: (p != "") & ~F.lower(p).isin(*ROOTS))
    return F.when(F.size(kept) == 0, "clothing item").otherwise(F.array_join(F.slice(kept, F.greatest(F.size(kept) - 1, F.lit(1)), 2), " "))


def compact_document(limit: int) -> Column:
    """The searched fields joined by bars, ``limit`` characters of them in all."""
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(limit).alias("left"))

    def add(state, field):
        piece = F.substring(F.trim(field), F.lit(1), state["left"])
        grown = F.struct(F.concat(state["parts"], F.array(piece)).alias("parts"), (state["left"] - F.length(piece)).alias("left"))
        return F.when((F.trim(field) == "") | (state["left"] <= 0), state).otherwise(grown)

    return F.array_join(F.aggregate(F.array(*text.search_fields()), start, add)["parts"], " | ")


def query_text(history, message, values) -> Column:
    """The last four messages, the current one and the constraints' values that they lack: 512 characters at most."""
    said = F.filter(F.transform(F.slice(F.concat(F.array().cast("array<string>"), history), F.greatest(F.size(history) - 3, F.lit(1)), 4), lambda h: F.trim(h)), lambda h: h != "")
    now = F.filter(F.array(F.trim(F.coalesce(message, F.lit("")))), lambda m: (m != "") & ~F.array_contains(said, m))
    evidence = F.concat(said, now)
    return F.rtrim(F.substring(F.trim(F.array_join(F.concat(evidence, F.array_except(F.array_distinct(F.filter(values, lambda v: v != "")), evidence)), " ")), 1, 512))


def evidence_query(phrases, limit: int) -> Column:
    """Distinct tokens of weighted phrases (weight, place, tokens), strongest phrase first, ``limit`` at most."""
    ordered = F.array_sort(F.transform(phrases, lambda p: F.struct((-p["weight"]).alias("w"), p["place"].alias("place"), p["tokens"].alias("tokens"))))
    return F.array_join(F.slice(F.array_distinct(F.flatten(F.transform(ordered, lambda p: p["tokens"]))), 1, limit), " ")


def requirement(attribute, operator, value, upper, alternatives) -> Column:
    """A constraint as a shopper would say it; amounts of money with a dollar sign."""
    money = lambda v: F.when(attribute == "budget", F.concat(F.lit("$"), v)).otherwise(v)
    several = F.size(F.coalesce(alternatives, F.array().cast("array<string>"))) > 1
    detail = F.when(operator == "lte", F.concat(F.lit("at most "), money(value))).when(operator == "gte", F.concat(F.lit("at least "), money(value)))
    detail = detail.when((operator == "between") & upper.isNotNull(), F.concat(F.lit("between "), money(value), F.lit(" and "), money(upper)))
    return F.concat(attribute, F.lit(": "), detail.when(several, F.concat(F.lit("one of "), F.array_join(alternatives, ", "))).otherwise(money(value)))


def role(operator, source, is_hard) -> Column:
    return F.when(operator == "not_in", "excluded").when(source.isin("profile", "inferred"), "inferred").when(is_hard, "hard").otherwise("stated")


def has_content(column, kind: str) -> Column:
    """Whether a field says anything: text, array or map with a text that isn't blank."""
    full = lambda v: F.coalesce(F.trim(v) != "", F.lit(False))
    if kind == "array":
        return F.coalesce(F.exists(column, full), F.lit(False))
    if kind == "map":
        return F.coalesce(F.exists(F.map_values(column), full), F.lit(False))
    return full(column)


def opening(scenario, variant, category, point) -> Column:
    """The first message of a session."""
    def text_of(template: str) -> Column:
        before, _, rest = template.partition("{0}")
        middle, mark, after = rest.partition("{1}")
        return F.concat(F.lit(before), category, F.lit(middle), point if mark else F.lit(""), F.lit(after))

    cases = None
    for name, templates in OPENINGS.items():
        for i, t in enumerate(templates):
            hit = (scenario == name) & (variant == i)
            cases = F.when(hit, text_of(t)) if cases is None else cases.when(hit, text_of(t))
    return cases.otherwise(text_of(OPENINGS["browsing"][0]))


def strategy(question, candidates, asked_open) -> Column:
    """open_probe where no question is worth asking and many candidates are left, exploit where few are, else probe."""
    return F.when(question.isNull() & (candidates > 10) & ~asked_open, "open_probe").when(candidates.between(1, 10), "exploit").otherwise("probe")
