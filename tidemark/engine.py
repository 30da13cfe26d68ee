"""Session helpers shared by every operator: table access, lineage cuts, ordered numbering, skew-safe lookups."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of any kind (Unicode separators included), as a class valid in Java and RE2 patterns.
SPACE = r"[\s\p{Z}\x{85}\x{1c}-\x{1f}\x{0b}]"
#: White space plus characters that show nothing: controls, format characters, fillers, variation selectors.
UNSEEN = r"[\s\p{Z}\p{Cc}\p{Cf}\x{34f}\x{115f}\x{1160}\x{17b4}\x{17b5}\x{2800}\x{3164}\x{ffa0}\x{fe00}-\x{fe0f}]"

#: monotonically_increasing_id keeps the row's place inside its partition in the lower 33 bits.
_PLACE_BITS = (1 << 33) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trimmed(column):
    """``column`` without white space of any kind at both ends; null stays null."""
    return F.regexp_replace(column, f"^{SPACE}+|{SPACE}+$", "")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where the session names none, one of this machine's, gone
    at the end, if all executors are in this process (tests); on a cluster that is an error."""
    context = spark.sparkContext
    here = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not here:
            if not (context.master == "local" or context.master.startswith("local[")):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            here = tempfile.mkdtemp(prefix="tidemark-")
            atexit.register(shutil.rmtree, here, ignore_errors=True)
        context.setCheckpointDir(here)
    return here or context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, so that later stages never recompute it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written as Parquet to a new shared folder and read back, and the folder: for long tables of few different
    values, which checkpoints keep at full length. To be deleted by discard()."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/tidemark-rows-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder), folder


def discard(spark: SparkSession, folder: str) -> None:
    """Delete a folder of stored()."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)  # noqa: SLF001
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)  # noqa: SLF001


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` shuffled by ``columns`` into enough parts for all cores: small rows of much Python work would else be
    merged into a few tasks by their bytes."""
    spark = df.sparkSession
    parts = max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(parts, *columns)


def fixed(df: DataFrame, most: int = 10_000) -> DataFrame:
    """A small table of checked size as rows that the plan itself holds: its lineage is never run again."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows in a table that should be fixed")
    return df.sparkSession.createDataFrame(rows, df.schema)


def broadcast_if_small(df: DataFrame, most: int = 200_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows, else as it is, to be joined by a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def number_rows(df: DataFrame, order: list, name: str = "seq") -> DataFrame:
    """Add ``name``: 0-based BIGINT position of each row in the total order ``order`` (column names).

    The order should be unique; equal rows get neighbouring numbers in no defined order. One range shuffle, then
    the rows are cut from their lineage (range bounds are sampled, so a recomputed stage could place rows
    elsewhere). Only one count per partition is gathered, never rows. An empty frame gives an empty frame.
    """
    placed = cut(
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_nr_part", F.spark_partition_id()).withColumn("_nr_place", F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE_BITS)))
    )
    starts = placed.groupBy("_nr_part").agg(F.count("*").alias("_n"))
    starts = starts.select("_nr_part", (F.sum("_n").over(Window.orderBy("_nr_part")) - F.col("_n")).alias("_nr_start"))
    return placed.join(F.broadcast(starts), "_nr_part").withColumn(name, F.col("_nr_start") + F.col("_nr_place")).drop("_nr_part", "_nr_place", "_nr_start")


def rank_in_groups(df: DataFrame, by: list, order: list, name: str = "rank") -> DataFrame:
    """Add ``name``: 1, 2, … inside each group ``by`` in the total order ``order``, as row_number does, but with no
    group in one task: rows are numbered over all groups, then each group's first number is taken off."""
    numbered = number_rows(df, [*by, *order], "_seq")
    firsts = numbered.groupBy(*by).agg(F.min("_seq").alias("_first"), F.count("*").alias("_n")).withColumn("_key", F.to_json(F.struct(*by)))
    keyed = numbered.withColumn("_key", F.to_json(F.struct(*by)))
    return lookup_skewed(keyed, firsts, ["_key"], "_n", ["_first"]).withColumn(name, F.col("_seq") - F.col("_first") + 1).drop("_seq", "_first", "_key")


def lookup_skewed(left: DataFrame, counted: DataFrame, key: list, count: str, keep: list, share: int = 1000) -> DataFrame:
    """Left join of ``left`` with the dictionary ``counted`` (unique on ``key``) in which hot keys never meet in one task.

    ``count`` is the number of ``left`` rows of a dictionary key, or something proportional to it. Keys holding more
    than 1/``share`` of the total are at most ``share`` many, so they are broadcast; the rest is joined by a shuffle
    whose largest key has less than 1/``share`` of the rows. Null keys match nothing.
    """
    total = counted.agg(F.coalesce(F.sum(count), F.lit(0)).alias("_total"))
    ranked = counted.crossJoin(F.broadcast(total))  # one row
    ranked = ranked.withColumn("_hot", F.col(count) * share > F.col("_total")).drop("_total")
    hot = ranked.filter("_hot").select(*key, F.struct(*keep).alias("_hot_value"))
    cold = ranked.filter("NOT _hot").select(*key, F.struct(*keep).alias("_cold_value"))
    seen = left.join(F.broadcast(hot), key, "left")
    without_key = F.lit(False)
    for k in key:
        without_key = without_key | F.col(k).isNull()
    settled = F.col("_hot_value").isNotNull() | without_key
    # hot and keyless rows are done here: with a null key in the join below they would all meet in one task
    done = seen.filter(settled).select(*left.columns, *[F.col("_hot_value")[k].alias(k) for k in keep])
    rest = seen.filter(~settled).drop("_hot_value").join(cold, key, "left")
    return done.unionByName(rest.select(*left.columns, *[F.col("_cold_value")[k].alias(k) for k in keep]))
