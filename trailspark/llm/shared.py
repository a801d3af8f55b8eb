"""What several operators of this subpackage use."""

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Fixed value: a word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def load(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the storage that the driver and all executors see.

    A session on one machine may go without the setting; a cluster may not.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.gettempdir() + "/trailspark-llm"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


# Lets Spark drop the shuffle files of a finished write, which nothing reads again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read again: computed once, and safe
    when executors are lost. The shuffle files behind them are removed."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


def same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    """Equality of keys in which null equals null."""
    return reduce(lambda a, b: a & b, [left[n].eqNullSafe(right[n]) for n in names])


def spread_copies(df: DataFrame, count: str, number: str, block: int = 65_536) -> DataFrame:
    """``count`` rows for each row, numbered from 0; blocks keep the lists short."""
    blocks = df.withColumn("__block", F.explode(F.expr(f"sequence(0L, ({count} - 1) div {block})")))
    first = F.col("__block") * block
    last = F.least(first + block, F.col(count)) - 1
    return blocks.withColumn(number, F.explode(F.sequence(first, last))).drop("__block", count)
