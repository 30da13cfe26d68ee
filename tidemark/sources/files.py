"""File sources and sinks: line-delimited JSON catalogues, manifests of checksums, exclusive and staged writes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


PRODUCT = "parent_asin string, title string, features array<string>, description array<string>, price double, categories array<string>, details map<string,string>, average_rating double, rating_number double, store string"


def read_catalog(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """A catalogue of one JSON object a line with an explicit schema; blank lines are skipped.

    Members of another type than the schema's are null; with ``strict`` a line that is no such object is an error. A
    repeated id keeps its last line (by file and place in it)."""
    lines = spark.read.text(path).withColumn("_at", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()))
    rows = lines.filter(F.trim("value") != "").select(F.from_json("value", PRODUCT, {"mode": "FAILFAST" if strict else "PERMISSIVE"}).alias("p"), "_at").filter("p.parent_asin IS NOT NULL")
    last = rows.groupBy(F.trim("p.parent_asin").alias("parent_asin")).agg(F.max_by("p", "_at").alias("p"))
    return last.select("parent_asin", *[f"p.{c.split()[0]}" for c in PRODUCT.split(", ")[1:]])


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(name, sha256, bytes) of every file below ``path``, names relative to it; files are hashed where they lie."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toUri().getPath().rstrip("/")
    name = F.regexp_replace("path", f"^[a-z]+:/*?(?=/){full}/|^.*{full}/", "")
    return files.select(name.alias("name"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def verify(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(name, state) of each entry of a manifest (name, sha256): ok, missing, mismatch, or outside for a name that
    leaves the folder."""
    outside = F.col("name").rlike(r"(^/|(^|/)\.\.(/|$))")
    joined = expected.join(found.select("name", F.col("sha256").alias("_found")), "name", "left")
    state = F.when(outside, "outside").when(F.col("_found").isNull(), "missing").when(F.col("_found") == F.lower("sha256"), "ok").otherwise("mismatch")
    return joined.select("name", state.alias("state"))


def write_new(df: DataFrame, path: str) -> None:
    """Write a table that mustn't exist yet; nothing is visible before all of it is."""
    df.write.mode("errorifexists").parquet(path)


def replace(df: DataFrame, path: str) -> None:
    """Replace a table: the new one is written beside it and takes its name; the old one comes back if that fails."""
    spark = df.sparkSession
    Path = spark._jvm.org.apache.hadoop.fs.Path
    target, staged, old = Path(path), Path(f"{path}.staged-{uuid.uuid4().hex}"), Path(f"{path}.old-{uuid.uuid4().hex}")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    df.write.mode("errorifexists").parquet(staged.toString())
    had = fs.exists(target)
    if had and not fs.rename(target, old):
        raise OSError(f"{path} can't be moved")
    if not fs.rename(staged, target):
        if had:
            fs.rename(old, target)
        raise OSError(f"{path} can't be replaced")
    if had:
        fs.delete(old, True)


def content_hash(df: DataFrame, columns: list[str]) -> DataFrame:
    """(rows, hash): one hash of a table's rows whatever their order or partitioning: rows are hashed as canonical
    JSON, the hashes summed as 38-digit numbers by bytes 0–15, so nothing is gathered."""
    row = F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)
    part = lambda i: F.conv(F.substring(row, i, 8), 16, 10).cast("decimal(38,0)")
    sums = df.select(*[part(1 + 8 * k).alias(f"p{k}") for k in range(4)]).agg(F.count("*").alias("rows"), *[F.coalesce(F.sum(f"p{k}"), F.lit(0)).alias(f"p{k}") for k in range(4)])
    return sums.select("rows", F.sha2(F.concat_ws(":", "rows", "p0", "p1", "p2", "p3"), 256).alias("hash"))


def sensitive(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows whose JSON or text matches a pattern of what must not leave."""
    return df.filter(F.col(column).rlike(pattern))


