"""Pieces of DuckDB SQL that the oracles share."""

from __future__ import annotations

from tidemark.functions import lookups

#: The latest row of each product.
CAT = """cat AS (
  SELECT * FROM product_catalog WHERE parent_asin IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY parent_asin ORDER BY loaded_at DESC NULLS LAST, price DESC NULLS LAST,
    average_rating DESC NULLS LAST, rating_number DESC NULLS LAST, title DESC NULLS LAST) = 1)"""


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+')"


def distinct(items: str) -> str:
    """Distinct list elements in order of their first place."""
    return f"list_transform(list_filter(list_transform({items}, lambda e, i: {{'e': e, 'i': i}}), lambda s: list_position({items}, s.e) = s.i), lambda s: s.e)"


def terms(x: str) -> str:
    return distinct(tokens(x))


def normal(x: str) -> str:
    return rf"regexp_replace(lower(trim(regexp_replace(coalesce({x}, ''), '[\s\x{{a0}}]+', ' ', 'g'))), '^[ \-;,.]+|[ \-;,.]+$', '', 'g')"


def singular(t: str) -> str:
    special = " ".join(f"WHEN {t} = '{a}' THEN '{b}'" for a, b in lookups.PLURAL_EXCEPTIONS.items())
    return (
        f"CASE {special} WHEN length({t}) > 3 AND {t} LIKE '%ies' THEN {t}[:-4] || 'y' "
        f"WHEN length({t}) > 4 AND regexp_matches({t}, '(sses|ches|shes|xes|zes)$') THEN {t}[:-3] "
        f"WHEN length({t}) > 2 AND {t} LIKE '%s' AND {t} NOT LIKE '%ss' THEN {t}[:-2] ELSE {t} END"
    )


def quoted(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def category_terms(x: str) -> str:
    words = f"list_transform(list_filter({tokens(x)}, lambda t: t NOT IN ({quoted(lookups.LINK_TERMS)})), lambda t: {singular('t')})"
    return distinct(words)


def flat_list(x: str) -> str:
    return f"array_to_string(list_transform(coalesce({x}, []), lambda e: coalesce(e, '')), ' ')"


#: Text of each searched field of a product.
FIELDS = {
    "title": "coalesce(title, '')",
    "categories": flat_list("categories"),
    "features": flat_list("features"),
    "details": "coalesce(array_to_string(list_transform(list_sort(map_entries(details)), lambda e: e.key || ' ' || coalesce(e.value, '')), ' '), '')",
    "store": "coalesce(store, '')",
    "description": flat_list("description"),
}
SEARCH_TEXT = " || ' ' || ".join(FIELDS[f] for f in lookups.SEARCH_FIELDS)

QUALITY = """quality AS (
  SELECT parent_asin, 0.7::DOUBLE * greatest(0, least(coalesce(average_rating, 0), 5)) / 5
    + 0.3::DOUBLE * ln(1 + greatest(coalesce(rating_number, 0), 0)) / (SELECT greatest(max(ln(1 + greatest(coalesce(rating_number, 0), 0))), 1) FROM cat) AS quality
  FROM cat)"""

CATEGORIES = f"""list_filter(list_transform(flatten(list_transform(list_filter(coalesce(categories, []), lambda c: c IS NOT NULL), lambda c: regexp_split_to_array(c, '[,>]'))),
  lambda p: array_to_string({terms(normal("replace(p, '&', 'and')"))}, ' ')), lambda w: w <> '' AND w NOT IN ({quoted(lookups.GENERIC_CATEGORIES)}))"""


def matches(toks: str, vocabulary) -> str:
    return distinct(f"list_filter({toks}, lambda t: t IN ({quoted(vocabulary)}))")


def attribute_ctes() -> str:
    """cat, words and posts (parent_asin, attribute, value) of the nine attributes."""
    detail = lambda frag: f"list_filter(list_transform(list_filter(list_sort(map_entries(coalesce(details, MAP {{}}))), lambda e: contains({normal('e.key')}, '{frag}')), lambda e: {normal('e.value')}), lambda v: v <> '')"
    lists = {
        "category": CATEGORIES,
        "material": matches("toks", lookups.MATERIALS),
        "color": f"list_transform({matches('toks', lookups.COLORS)}, lambda c: CASE WHEN c = 'grey' THEN 'gray' ELSE c END)",
        "size": f"{detail('size')} || CASE WHEN list_contains(toks, 'wide') THEN ['wide'] ELSE [] END || CASE WHEN list_contains(toks, 'narrow') THEN ['narrow'] ELSE [] END",
        "style": f"{detail('style')} || {matches('toks', lookups.STYLES)}",
        "brand": f"{detail('brand')} || CASE WHEN {normal('store')} <> '' THEN [{normal('store')}] ELSE [] END",
        "budget": "CASE WHEN price IS NOT NULL THEN [printf('%.2f', price)] ELSE [] END",
        "feature": matches("toks", lookups.FEATURES),
        "use_case": matches("toks", lookups.USE_CASES),
    }
    posts = " UNION ".join(f"SELECT parent_asin, '{a}' AS attribute, unnest({e}) AS value FROM words" for a, e in lists.items())
    return f"""{CAT},
words AS (SELECT *, {tokens(SEARCH_TEXT)} AS toks FROM cat),
posts AS (SELECT DISTINCT * FROM ({posts}))"""
