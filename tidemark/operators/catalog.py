"""Catalog index: latest product rows, quality, attributes, postings and term tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import lookups, text
from tidemark.functions.text import literals


def latest(catalog: DataFrame) -> DataFrame:
    """One row for each parent_asin, that of the latest load (of equal ones the larger by price, ratings and title).

    Combined before the shuffle, so a product delivered any number of times costs one row a task. Null ids are left
    out."""
    order = F.struct("loaded_at", "price", "average_rating", "rating_number", "title")
    rows = catalog.filter("parent_asin IS NOT NULL").groupBy("parent_asin").agg(F.max_by(F.struct(*[c for c in catalog.columns if c != "parent_asin"]), order).alias("r"))
    return rows.select("parent_asin", "r.*")


def id_violations(catalog: DataFrame) -> DataFrame:
    """(parent_asin, rows, problem) of ids that are blank or occur more than once."""
    key = F.trim(F.coalesce("parent_asin", F.lit("")))
    counts = catalog.groupBy(key.alias("parent_asin")).agg(F.count("*").alias("rows"))
    return counts.filter("rows > 1 OR parent_asin = ''").withColumn("problem", F.when(F.col("parent_asin") == "", "empty id").otherwise("duplicate id"))


def with_quality(products: DataFrame) -> DataFrame:
    """Add ``quality``: 0.7 of the rating over five, 0.3 of the logarithm of ratings over that of the most rated."""
    rating = F.coalesce(F.col("average_rating").cast("double"), F.lit(0.0))
    reviews = F.log1p(F.greatest(F.coalesce(F.col("rating_number").cast("double"), F.lit(0.0)), F.lit(0.0)))
    most = products.agg(F.greatest(F.max(reviews), F.lit(1.0)).alias("_most"))
    joined = products.crossJoin(F.broadcast(most))  # one row
    share = reviews / F.coalesce("_most", F.lit(1.0))
    return joined.withColumn("quality", 0.7 * F.greatest(F.lit(0.0), F.least(rating, F.lit(5.0))) / 5 + 0.3 * share).drop("_most")


def popular(products: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` products of highest quality, by id where equal."""
    return with_quality(products).orderBy(F.round("quality", 9).desc(), "parent_asin").limit(limit)


def attributes(products: DataFrame) -> DataFrame:
    """(parent_asin, attributes MAP<STRING, ARRAY<STRING>>) with the nine attributes of each product."""
    found = text.terms(F.col("_text"))
    colors = F.array_distinct(F.transform(text.matches(found, lookups.COLORS), lambda c: F.when(c == "grey", "gray").otherwise(c)))
    words = lambda w: F.when(F.array_contains(found, w), F.array(F.lit(w))).otherwise(F.array().cast("array<string>"))
    store = text.normalize_value(F.col("store"))
    parts = {
        "category": text.categories(),
        "material": text.matches(found, lookups.MATERIALS),
        "color": colors,
        "size": F.array_distinct(F.concat(text.detail_values("size"), words("wide"), words("narrow"))),
        "style": F.array_distinct(F.concat(text.detail_values("style"), text.matches(found, lookups.STYLES))),
        "brand": F.array_distinct(F.concat(text.detail_values("brand"), F.when(store != "", F.array(store)).otherwise(F.array().cast("array<string>")))),
        "budget": F.when(F.col("price").isNotNull(), F.array(F.format_string("%.2f", "price"))).otherwise(F.array().cast("array<string>")),
        "feature": text.matches(found, lookups.FEATURES),
        "use_case": text.matches(found, lookups.USE_CASES),
    }
    return products.withColumn("_text", text.search_text()).select("parent_asin", F.map_from_arrays(literals(parts), F.array(*parts.values())).alias("attributes"))


def postings(attributes_: DataFrame) -> DataFrame:
    """(parent_asin, attribute, value, pos), pos from 1 in order of the attribute's values."""
    each = attributes_.select("parent_asin", F.explode("attributes").alias("attribute", "values"))
    return each.select("parent_asin", "attribute", F.posexplode("values").alias("pos", "value")).withColumn("pos", F.col("pos") + 1)


def category_postings(attributes_: DataFrame) -> DataFrame:
    """(parent_asin, term): the words of each product's categories."""
    return attributes_.select("parent_asin", F.explode(F.array_distinct(F.flatten(F.transform(F.col("attributes")["category"], text.category_terms)))).alias("term"))


def layers(products: DataFrame) -> DataFrame:
    """(parent_asin, layer, attribute, value): attributes found in details and texts beyond the nine, by the scope of
    the product's categories; layer is category or dynamic."""
    scope = text.scope(F.flatten(F.transform(text.categories(), text.category_terms)))
    base = products.select("parent_asin", scope.alias("scope"), "details", text.search_text().alias("_text"))
    named = base.select("parent_asin", "scope", F.explode(F.coalesce("details", F.create_map().cast("map<string,string>"))).alias("name", "raw"))
    named = named.withColumn("attribute", text.detail_attribute(F.col("name"))).filter("attribute IS NOT NULL")
    from_details = named.select("parent_asin", "scope", "attribute", F.explode(text.detail_attribute_values(F.col("attribute"), F.col("raw"))).alias("value"))
    from_text = base.select("parent_asin", "scope", F.explode(text.scoped_materials(F.col("_text"))).alias("m")).select("parent_asin", "scope", "m.attribute", F.col("m.material").alias("value"))
    every = from_details.unionByName(from_text)
    in_scope = reduce(lambda a, b: a | b, [(F.col("scope") == s) & F.col("attribute").isin(*names) for s, names in lookups.SCOPE_ATTRIBUTES.items()])
    layer = F.when(in_scope, "category").when(F.col("attribute").isin(*lookups.DYNAMIC_ATTRIBUTES), "dynamic")
    return every.withColumn("layer", layer).filter("layer IS NOT NULL").select("parent_asin", "layer", "attribute", "value").distinct()


def field_tokens(products: DataFrame) -> DataFrame:
    """(parent_asin, field, token) of every token of the six searched fields; field counts from 0."""
    fields = F.array(*[F.struct(F.lit(i).alias("field"), text.tokens(f).alias("tokens")) for i, f in enumerate(text.search_fields())])
    each = products.select("parent_asin", F.explode(fields).alias("f"))
    return each.select("parent_asin", "f.field", F.explode("f.tokens").alias("token"))


def term_fields(products: DataFrame) -> DataFrame:
    """(parent_asin, term, mask, weight, tf): bit i of mask says that field i has the term, weight sums the weights of
    such fields, tf the weighted count. One shuffle, combined by product and term before it."""
    by_field = field_tokens(products).groupBy("parent_asin", F.col("token").alias("term")).agg(*[F.sum((F.col("field") == i).cast("int")).alias(f"n{i}") for i in range(len(lookups.SEARCH_FIELDS))])
    has = [F.col(f"n{i}") > 0 for i in range(len(lookups.SEARCH_FIELDS))]
    mask = reduce(lambda a, b: a + b, [F.when(h, 1 << i).otherwise(0) for i, h in enumerate(has)])
    return by_field.select("parent_asin", "term", mask.alias("mask"), reduce(lambda a, b: a + b, [F.when(h, w).otherwise(0.0) for h, w in zip(has, lookups.FIELD_WEIGHTS, strict=True)]).alias("weight"), reduce(lambda a, b: a + b, [F.col(f"n{i}") * w for i, w in enumerate(lookups.FIELD_WEIGHTS)]).alias("tf"))


def mine_schema(attributes_: DataFrame, least_support: int = 12, share: float = 0.001) -> DataFrame:
    """Each attribute's coverage, number of values, and number of values with support: at least ``least_support``
    products and ``share`` of all."""
    total = attributes_.agg(F.count("*").alias("_total"))
    values = postings(attributes_).groupBy("attribute", "value").agg(F.count("*").alias("support"))
    products = attributes_.select("parent_asin", F.explode("attributes").alias("attribute", "values")).filter(F.size("values") > 0).groupBy("attribute").agg(F.count("*").alias("products"))
    need = F.greatest(F.lit(least_support), F.ceil(F.col("_total") * share))
    joined = values.crossJoin(F.broadcast(total))  # one row
    counts = joined.groupBy("attribute").agg(F.count("*").alias("values"), F.count_if(F.col("support") >= need).alias("supported"), F.first("_total").alias("_total"))
    return counts.join(F.broadcast(products), "attribute").select("attribute", "values", "supported", "products", F.round(F.col("products") / F.col("_total"), 6).alias("coverage"))


def with_ranks(rows: DataFrame, by: list, order: list, name: str = "rank") -> DataFrame:
    """Number rows 1, 2, … inside each group ``by`` in the given total order."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
