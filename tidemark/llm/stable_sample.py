"""A sample that reruns, other partitionings and later rows leave as it is: randomised block selection."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tidemark.engine import number_rows, trimmed

BLOCK, CHOSEN, SEED = 1000, 100, "tidemark"


@lru_cache(maxsize=64)
def chosen_positions(block: int, size: int, chosen: int, seed: str) -> np.ndarray:
    """For each position of a block whether it is chosen: those of the ``chosen`` least hashes of (seed, block,
    position), over all positions of the block, filled or not."""
    hashes = [(hashlib.sha256(f"{seed}:{block}:{i}".encode()).hexdigest(), i) for i in range(size)]
    mask = np.zeros(size, dtype=bool)
    mask[[i for _, i in sorted(hashes)[:chosen]]] = True
    return mask


def numbered_products(products: DataFrame) -> DataFrame:
    """Distinct products (parent_asin trimmed, lower case) with the persistent sequence number ``seq``: their place
    by first loaded_at, then id. Rows that come in later, with a later loaded_at, only add numbers at the end.
    A product without any loaded_at comes after all others. Null and blank ids are left out."""
    ids = products.select(F.lower(trimmed("parent_asin")).alias("parent_asin"), "loaded_at").filter("parent_asin <> ''")
    firsts = ids.groupBy("parent_asin").agg(F.min("loaded_at").alias("first_loaded_at"))
    firsts = firsts.withColumn("_undated", F.col("first_loaded_at").isNull())
    return number_rows(firsts, ["_undated", "first_loaded_at", "parent_asin"]).drop("_undated")


def stable_sample(products: DataFrame, chosen: int = CHOSEN, block: int = BLOCK, seed: str = SEED) -> DataFrame:
    """The products at the chosen positions of each block of ``block`` sequence numbers: parent_asin, seq.

    The share is chosen / block exactly in every full block; in the last, unfilled block the positions are chosen
    as if it were full, so what comes in later never changes them. Repeated rows, other cases and white space of
    one id count once; extra columns are ignored; an empty table gives an empty sample.
    """

    @pandas_udf("boolean")
    def is_chosen(seq: pd.Series) -> pd.Series:
        numbers = seq.to_numpy()
        out = np.zeros(len(numbers), dtype=bool)
        blocks, places = np.divmod(numbers, block)
        for b in np.unique(blocks):
            own = blocks == b
            out[own] = chosen_positions(int(b), block, chosen, seed)[places[own]]
        return pd.Series(out)

    return numbered_products(products).filter(is_chosen("seq")).select("parent_asin", "seq")
