"""Text functions over Columns: tokens, normal forms, categories, details. Nulls are empty texts unless said."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import lookups


def literals(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def tokens(text) -> Column:
    """Runs of ASCII letters and digits in lower case, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def terms(text) -> Column:
    """Distinct tokens in order of their first place."""
    return F.array_distinct(tokens(text))


def token_sequence(text, limit: int) -> Column:
    return F.slice(tokens(text), 1, limit)


def normalize_value(text) -> Column:
    """White space collapsed, lower case, without blanks, dashes, semicolons, commas and points at the ends."""
    collapsed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s\x{a0}]+", " "))
    return F.regexp_replace(F.lower(collapsed), r"^[ \-;,.]+|[ \-;,.]+$", "")


def flatten_array(values) -> Column:
    """The elements joined by blanks; a null element is an empty text."""
    return F.coalesce(F.array_join(values, " ", ""), F.lit(""))


def flatten_map(entries) -> Column:
    """Keys and values joined by blanks, by key."""
    pairs = F.array_sort(F.map_entries(entries))
    return F.coalesce(F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit(" "), F.coalesce(e["value"], F.lit("")))), " "), F.lit(""))


def search_fields() -> list[Column]:
    """The six searched fields of a product as texts, in order."""
    text = {"title": F.coalesce("title", F.lit("")), "store": F.coalesce("store", F.lit("")), "details": flatten_map(F.col("details"))}
    return [text[f] if f in text else flatten_array(F.col(f)) for f in lookups.SEARCH_FIELDS]


def search_text() -> Column:
    return F.concat_ws(" ", *search_fields())


def singular(term: Column) -> Column:
    """A category word without its plural ending: listed exceptions, then -ies, -es after a hiss, -s."""
    base = F.when(term.rlike("ies$") & (F.length(term) > 3), F.concat(F.substring(term, F.lit(1), F.length(term) - 3), F.lit("y")))
    base = base.when(term.rlike("(sses|ches|shes|xes|zes)$") & (F.length(term) > 4), F.substring(term, F.lit(1), F.length(term) - 2))
    base = base.when(term.rlike("s$") & ~term.rlike("ss$") & (F.length(term) > 2), F.substring(term, F.lit(1), F.length(term) - 1)).otherwise(term)
    for plural, one in lookups.PLURAL_EXCEPTIONS.items():
        base = F.when(term == plural, one).otherwise(base)
    return base


def category_value(text) -> Column:
    return F.array_join(F.transform(terms(text), singular), " ")


def category_terms(text) -> Column:
    """Distinct singular words without link words."""
    return F.array_distinct(F.transform(F.filter(terms(text), lambda t: ~t.isin(*lookups.LINK_TERMS)), singular))


def matches(found: Column, vocabulary) -> Column:
    """The tokens that are in a vocabulary, in their order, once each."""
    return F.array_distinct(F.filter(found, lambda t: t.isin(*vocabulary)))


def categories(column="categories") -> Column:
    """Parts of the category path between commas and angles, as plain words, without the generic ones."""
    parts = F.flatten(F.transform(F.filter(F.coalesce(column, F.array().cast("array<string>")), lambda c: c.isNotNull()), lambda c: F.split(c, "[,>]")))
    words = F.transform(parts, lambda p: F.array_join(terms(normalize_value(F.replace(p, F.lit("&"), F.lit("and")))), " "))
    return F.array_distinct(F.filter(words, lambda w: (w != "") & ~w.isin(*lookups.GENERIC_CATEGORIES)))


def scope(taxonomy: Column) -> Column:
    """The first scope that shares a word with the category words, else other."""
    result = None
    for name, words in lookups.SCOPES.items():
        hit = F.arrays_overlap(taxonomy, literals(words))
        result = F.when(hit, name) if result is None else result.when(hit, name)
    return result.otherwise("other")


def detail_values(fragment: str) -> Column:
    """Normal values of the detail entries whose normal name holds ``fragment``, by name."""
    entries = F.array_sort(F.map_entries(F.coalesce("details", F.create_map().cast("map<string,string>"))))
    kept = F.filter(entries, lambda e: normalize_value(e["key"]).contains(fragment))
    return F.filter(F.transform(kept, lambda e: normalize_value(e["value"])), lambda v: v != "")


def detail_attribute(name) -> Column:
    """The attribute that a detail entry's name means, else null."""
    plain = F.array_join(terms(name), " ")
    alias = F.create_map(*[F.lit(x) for pair in lookups.DETAIL_ALIASES.items() for x in pair])
    blocked = F.lit(False)
    for part in lookups.DETAIL_BLOCKED:
        blocked = blocked | plain.contains(part)
    return F.when(~blocked, F.try_element_at(alias, plain))


def detail_attribute_values(attribute, raw) -> Column:
    """Values of a detail entry: its normal text (none if over 160 characters or 16 words) and, of enumerated
    attributes, the parts between separators."""
    text = normalize_value(raw)
    parts = F.when(attribute.isin(*lookups.ENUMERATED_ATTRIBUTES), F.filter(F.transform(F.split(text, "[,;/|]"), normalize_value), lambda p: p != "")).otherwise(F.array().cast("array<string>"))
    usable = (text != "") & (F.length(text) <= 160) & (F.size(terms(text)) <= 16)
    return F.when(usable, F.array_distinct(F.concat(F.array(text), parts))).otherwise(F.array().cast("array<string>"))


def scoped_materials(text) -> Column:
    """Array of (attribute, material) for materials tied to a part of the product, by attribute and material."""
    normal = normalize_value(text)
    found = []
    for attribute, labels in lookups.MATERIAL_PARTS.items():
        for material in sorted(lookups.MATERIALS):
            either = "|".join(rf"\b{material}\b(?:\s+[a-z0-9-]+){{0,2}}\s+\b{label}\b|\b{label}(?:\s+material)?\b\s*(?:(?:is|made\s+of)\s+|[:=-]\s*)?\b{material}\b" for label in labels)
            found.append(F.when(normal.rlike(either), F.struct(F.lit(attribute).alias("attribute"), F.lit(material).alias("material"))))
    return F.array_compact(F.array(*found))


def positive_finite(value) -> Column:
    """The value if above zero and finite, else null; NaN is not above zero here."""
    number = value.cast("double")
    return F.when((number > 0) & ~F.isnan(number) & (number < float("inf")), number)


def stable_hash(seed: str, value) -> Column:
    """Hex SHA-256 of seed, a zero character and the value; its order is that of the number it spells."""
    return F.sha2(F.concat(F.lit(seed), F.char(F.lit(0)), value), 256)


def opaque_id(prefix: str, value) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(value, 256), 1, 20))


def bound(value: Column, body) -> Column:
    """``body`` of a value computed once: inside a lambda an outer expression would be computed for each element."""
    return F.transform(F.array(value), body)[0]


def unit_vector(vector: Column) -> Column:
    """The vector over its length, in doubles; a zero vector stays as it is."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(doubles, F.lit(0.0), lambda a, x: a + x * x))
    return bound(norm, lambda n: F.transform(doubles, lambda x: F.when(n > 0, x / n).otherwise(0.0)))


def quantize(vector: Column) -> Column:
    """(values ARRAY<INT>, scale): vector over its length, in steps of a 127th of its largest part, half to even."""

    def steps(unit: Column) -> Column:
        scale = F.greatest(F.array_max(F.transform(unit, lambda x: F.abs(x))) / 127.0, F.lit(1.1920928955078125e-07))
        return bound(scale, lambda s: F.struct(F.transform(unit, lambda x: F.least(F.greatest(F.rint(x / s), F.lit(-127.0)), F.lit(127.0)).cast("int")).alias("values"), s.alias("scale")))

    return bound(unit_vector(vector), steps)


def profile_segment(tags) -> Column:
    """First four of the distinct lower-case tags, by name, joined by bars."""
    plain = F.filter(F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.lower(F.trim(t))), lambda t: t.isNotNull() & (t != ""))
    return F.array_join(F.slice(F.array_sort(F.array_distinct(plain)), 1, 4), "|")
