"""The catalogue's search index: built once for each state of the catalogue's files, stored, and read by all searches."""

from __future__ import annotations

import hashlib
import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.engine import cut, shared_dir
from tidemark.functions import text
from tidemark.operators import catalog as cat
from tidemark.operators.parsing import vocabulary

#: Layout of the stored tables; another number makes another folder. Folders that the terms are spread over by hash.
VERSION, PARTS = 1, 64
TABLES = {
    "products": None,
    "postings": "parent_asin string, value string, pos int, quality double, price double, attribute string",
    "terms": "parent_asin string, term string, mask int, weight double, tf double, quality double, length int, part int",
    "counts": "term string, df bigint, mask int, tf double, part int",
    "totals": "n bigint, avg double",
    "vocabulary": None,
}
#: Dimensions of the hashed vectors of titles.
DIMENSIONS = 64


_OPEN: dict = {}


class Index(NamedTuple):
    """products: the latest rows with quality, attributes, length (tokens), search_terms and vector. postings: parent_asin,
    value, pos, quality and price by attribute. terms: term, parent_asin, mask, weight, tf, quality and length by part, a hash of the
    term. counts: df, mask and tf of each term, by part. totals: one row with n and avg, the mean length. vocabulary:
    words of attributes."""

    products: DataFrame
    postings: DataFrame
    terms: DataFrame
    counts: DataFrame
    totals: DataFrame
    vocabulary: DataFrame

    def of(self, wanted: DataFrame, table: DataFrame | None = None) -> DataFrame:
        """The rows of ``table`` (terms unless given) in the parts of ``wanted``'s terms: only their folders are read,
        the numbers of which, at most PARTS, are all that reaches the driver."""
        parts = [r[0] for r in wanted.select(part("term")).distinct().collect()]
        return (self.terms if table is None else table).filter(F.col("part").isin(parts))


def part(term) -> Column:
    """The folder of a term."""
    return F.pmod(F.xxhash64(term), F.lit(PARTS)).cast("int").alias("part")


def vector(terms) -> Column:
    """A text's vector: each distinct term adds 1 or -1 to a dimension, both by its hash; then of length 1. Null for a text
    without terms. Equal texts have equal vectors, texts that share terms near ones: it needs no model."""
    digits = lambda t, at, n: F.conv(F.substring(F.md5(t), at, n), 16, 10).cast("int")
    spot = F.transform(terms, lambda t: F.struct((digits(t, 1, 4) % DIMENSIONS).alias("d"), (1 - 2 * (digits(t, 5, 1) % 2)).alias("s")))
    sums = F.aggregate(spot, F.array_repeat(F.lit(0), DIMENSIONS), lambda acc, x: F.transform(acc, lambda v, i: v + F.when(i == x["d"], x["s"]).otherwise(0)))
    return F.when(F.size(terms) > 0, sums)


def unit(sums) -> Column:
    """A vector over its length; one of zeros stays."""
    norm = F.sqrt(F.aggregate(sums, F.lit(0), lambda acc, v: acc + v * v).cast("double"))
    return F.transform(sums, lambda v: F.when(norm > 0, v / norm).otherwise(0.0))


def described(products: DataFrame) -> DataFrame:
    """``products`` with quality, attributes, search_terms, length and vector."""
    tokens = [F.size(text.tokens(f)) for f in text.search_fields()]
    rows = cat.with_quality(products).withColumn("search_terms", text.terms(text.search_text()))
    rows = rows.withColumn("vector", vector(text.terms(F.col("title")))).withColumn("vector", unit(F.col("vector")))
    return rows.withColumn("length", sum(tokens[1:], tokens[0])).join(cat.attributes(products), "parent_asin")


def write(products: DataFrame, folder: str) -> None:
    """Build the tables of the latest rows ``products`` into ``folder``.

    Terms are sorted inside their part, so that readers skip row groups too; a term of many products is spread over
    several files by the rebalancing of partitions."""
    spark = products.sparkSession
    described(products).write.parquet(f"{folder}/products")
    rows = spark.read.parquet(f"{folder}/products")
    postings = cat.postings(rows.select("parent_asin", "attributes")).join(rows.select("parent_asin", "quality", "price"), "parent_asin")
    postings.hint("rebalance", "attribute").sortWithinPartitions("attribute", "value").write.partitionBy("attribute").parquet(f"{folder}/postings")
    facts = rows.select("parent_asin", "quality", "length")
    terms = cat.term_fields(rows).join(facts, "parent_asin").withColumn("part", part("term"))
    terms.hint("rebalance", "part").sortWithinPartitions("part", "term").write.partitionBy("part").parquet(f"{folder}/terms")
    stored = spark.read.schema(TABLES["terms"]).parquet(f"{folder}/terms")
    counts = stored.groupBy("part", "term").agg(F.count("*").alias("df"), F.bit_or("mask").alias("mask"), F.sum("tf").alias("tf"))
    counts.hint("rebalance", "part").sortWithinPartitions("part", "term").write.partitionBy("part").parquet(f"{folder}/counts")
    rows.filter("length > 0").agg(F.count("*").alias("n"), F.avg("length").alias("avg")).coalesce(1).write.parquet(f"{folder}/totals")
    vocabulary(spark.read.schema(TABLES["postings"]).parquet(f"{folder}/postings")).write.parquet(f"{folder}/vocabulary")


def read(spark: SparkSession, folder: str) -> Index:
    # an empty table of folders has no file to tell its columns
    readers = [(spark.read.schema(schema) if schema else spark.read, name) for name, schema in TABLES.items()]
    return Index(*[reader.parquet(f"{folder}/{name}") for reader, name in readers])


def files(spark: SparkSession, path: str) -> str:
    """A digest of the names, sizes and times of the files under ``path``: another one, another state of the table."""
    jvm = spark._jvm  # noqa: SLF001
    root = jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001
    states, found = [], system.listStatus(root)
    waiting = list(found)
    while waiting:
        status = waiting.pop()
        if status.isDirectory():
            waiting += list(system.listStatus(status.getPath()))
        else:
            states.append(f"{status.getPath()} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(states)).encode()).hexdigest()[:24]


def of_catalog(spark: SparkSession, path: str) -> Index:
    """The index of the catalogue at ``path``, built if the shared folder has none for its present files.

    It is built in a folder of its own and renamed at the end, so a reader finds a whole index or none; of two builders
    the second one's is dropped."""
    home = f"{shared_dir(spark)}/tidemark-index-{VERSION}-{files(spark, path)}"
    jvm = spark._jvm  # noqa: SLF001
    final, mine = jvm.org.apache.hadoop.fs.Path(home), jvm.org.apache.hadoop.fs.Path(f"{home}.{uuid.uuid4().hex}")
    system = final.getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001
    if not system.exists(final):
        _OPEN.clear()
        write(cut(cat.latest(spark.read.parquet(path))), mine.toString())
        if system.exists(final) or not system.rename(mine, final):
            system.delete(mine, True)
    # the tables' columns and folders are listed once a session
    key = spark.sparkContext.applicationId, home
    if key not in _OPEN:
        _OPEN[key] = read(spark, home)
    return _OPEN[key]


def of_products(products: DataFrame) -> Index:
    """The same tables of latest rows that are at hand, not stored beyond the session."""
    rows = cut(described(products))
    facts = rows.select("parent_asin", "quality", "length", "price")
    postings = cut(cat.postings(rows.select("parent_asin", "attributes")).join(facts.drop("length"), "parent_asin"))
    terms = cut(cat.term_fields(rows).join(facts.drop("price"), "parent_asin").withColumn("part", part("term")))
    counts = cut(terms.groupBy("part", "term").agg(F.count("*").alias("df"), F.bit_or("mask").alias("mask"), F.sum("tf").alias("tf")))
    totals = cut(rows.filter("length > 0").agg(F.count("*").alias("n"), F.avg("length").alias("avg")))
    return Index(rows, postings, terms, counts, totals, cut(vocabulary(postings)))
