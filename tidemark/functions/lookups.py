"""Fixed values of the retrieval domain: vocabularies, weights and word lists that results depend on."""

# Attribute vocabularies.
COLORS = ("black", "white", "blue", "red", "pink", "green", "brown", "gray", "grey", "purple", "yellow", "orange")
MATERIALS = ("cotton", "polyester", "nylon", "leather", "wool", "spandex", "silk", "rayon", "fabric", "mesh", "denim", "linen", "rubber", "synthetic")
USE_CASES = ("running", "gym", "outdoor", "hiking", "work", "winter", "casual", "formal", "party", "travel")
STYLES = ("classic", "casual", "formal", "athletic", "vintage", "modern", "puffer", "a-line", "slim", "relaxed")
FEATURES = ("breathable", "comfortable", "durable", "insulated", "lightweight", "stretch", "warm", "waterproof", "weatherproof")

# Categories that say nothing, words that link categories, irregular plurals.
GENERIC_CATEGORIES = ("accessories", "clothing", "clothing shoes jewelry", "clothing shoes and jewelry", "men", "shoes and jewelry", "women")
LINK_TERMS = ("and", "for", "of")
PLURAL_EXCEPTIONS = {"booties": "bootie", "hoodies": "hoodie", "panties": "panty", "ties": "tie"}

# Names of detail entries that mean an attribute, and parts of names that mean none.
DETAIL_ALIASES = {
    "age range description": "audience", "brand": "brand", "brand name": "brand", "closure type": "closure", "color": "color", "colour": "color",
    "country of origin": "origin", "department": "audience", "fabric type": "material", "fit type": "fit", "inner material": "inner_material",
    "lining material": "inner_material", "manufacturer": "brand", "material": "material", "material type": "material", "neck style": "neckline",
    "occasion": "occasion", "outer material": "outer_material", "pattern": "pattern", "product care instructions": "care",
    "recommended uses for product": "use_case", "shape": "shape", "size": "size", "sleeve type": "sleeve", "sole material": "sole_material",
    "special feature": "feature", "special features": "feature", "sport": "use_case", "sport type": "use_case", "style": "style",
    "suggested users": "audience", "target audience": "audience", "theme": "theme",
}
DETAIL_BLOCKED = ("batter", "best seller", "date first available", "dimension", "item model", "model name", "model number", "model year", "part number", "rank", "upc", "weight")
ENUMERATED_ATTRIBUTES = ("audience", "feature", "material", "occasion", "use_case")

# Words of a product's categories that place it in a scope, in order of priority.
SCOPES = {
    "footwear": ("boot", "clog", "flat", "footwear", "loafer", "pump", "sandal", "shoe", "slipper", "sneaker"),
    "jewelry": ("bracelet", "earring", "jewelry", "necklace", "ring", "watch"),
    "accessories": ("accessory", "bag", "belt", "glove", "handbag", "hat", "purse", "scarf", "tie", "wallet"),
    "apparel": ("blouse", "coat", "dress", "hoodie", "jacket", "jean", "pant", "shirt", "short", "skirt", "sweater", "top"),
}
# Detail attributes that count in a scope's category layer, and those of the dynamic layer.
SCOPE_ATTRIBUTES = {
    "apparel": ("audience", "closure", "fit", "neckline", "pattern", "shape", "sleeve"),
    "footwear": ("audience", "closure", "fit", "inner_material", "outer_material", "pattern", "shape", "sole_material"),
    "jewelry": ("audience", "pattern", "shape"),
    "accessories": ("audience", "closure", "pattern", "shape"),
    "other": ("audience", "closure", "fit", "pattern", "shape"),
}
DYNAMIC_ATTRIBUTES = ("occasion", "theme")
# Words that tie a material to a part of a product.
MATERIAL_PARTS = {"sole_material": ("sole",), "outer_material": ("upper", "outer", "shell"), "inner_material": ("inner", "lining")}

# Searched fields in order, and their weights in lexical scores.
SEARCH_FIELDS = ("title", "categories", "features", "details", "store", "description")
FIELD_WEIGHTS = (6.0, 4.0, 2.5, 2.5, 1.5, 1.0)
BM25_K1, BM25_B, MAX_QUERY_TERMS = 1.2, 0.75, 40

# Weights of the candidate sources by route, and the constant of reciprocal-rank fusion.
ROUTE_WEIGHTS = {
    "buying": {"attribute": 0.45, "lexical": 0.35, "dense": 0.20},
    "browsing": {"dense": 0.45, "lexical": 0.30, "profile": 0.25},
    "override": {"lexical": 0.35, "dense": 0.35, "attribute": 0.30},
}
RRF_K, SOURCE_LIMIT, RESULT_LIMIT, FALLBACK_LIMIT = 60, 150, 10, 500

# Weights of the constraint ranker, diversity, phrase reranking.
RANK_WEIGHTS = {"hard": 0.30, "lexical": 0.075, "dense": 0.075, "fusion": 0.25, "attribute": 0.0, "category": 0.10, "soft": 0.10, "profile": 0.05, "quality": 0.05, "conflict": -0.60}
MMR_LAMBDA = 0.85
PHRASE_COVERAGE, PHRASE_RUN, PHRASE_RUN_CAP, PHRASE_WINDOW, PHRASE_BLEND, PHRASE_TOKENS = 0.4, 0.6, 6, 50, 0.8, 600

# Prior strength, and asks after which a finer scope counts.
PRIOR_STRENGTH, MIN_ASKED = 8.0, 12
