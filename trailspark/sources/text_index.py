"""A store of texts with an index of three-character grams, from which few files answer a search.

A batch is a folder of two tables. ``texts`` holds the rows as given, numbered in blocks of
neighbours. ``grams`` holds a row per gram and block: (gram, file, block), sorted, so that
Parquet stores each value as its difference from the one before, in folders by a hash of
the gram. A batch counts from the moment its manifest is renamed into place.
"""

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from trailspark.operators.tools import search_text, search_terms
from trailspark.session import create_json, names_in, read_json

GRAM = 3
# Rows of a block: a power of two, so that blocks of two tasks never share a number.
BLOCK_BITS = 6
BUCKETS = 64
# Blocks that a search may name one by one. Beyond them it reads all files.
LISTED = 10_000
POSTINGS = "gram string, file string, block long, bucket long"
# Sorted values are kept as differences (delta encodings of the second format).
SORTED_FILES = {"parquet.writer.version": "v2", "parquet.enable.dictionary": "false", "compression": "zstd"}


def grams_of(text: Column) -> Column:
    """The different grams of the lower-cased text, found in one pass over it."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"(?s)(?=(.{{{GRAM}}}))"), 1))


def bucket_of(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS))


def index_texts(texts: DataFrame, store: str, text: str = "text", block_bits: int = BLOCK_BITS) -> str:
    """Add the rows as one batch and return its name. All columns are kept.

    Grams are counted once a block in the task that reads it, so a gram that stands in every
    row is shuffled once a block; frequent grams are dealt over several files. If the job
    ends early, the batch does not count and the rows can be added again.
    """
    spark = texts.sparkSession
    batch = uuid.uuid4().hex
    number = F.shiftright(F.monotonically_increasing_id(), block_bits)
    texts.withColumn("__block", number).write.parquet(f"{store}/{batch}/texts")
    rows = spark.read.parquet(f"{store}/{batch}/texts").select(
        F.col("_metadata.file_name").alias("file"), F.col("__block").alias("block"),
        F.explode(grams_of(F.col(f"`{text}`"))).alias("gram"),
    )
    postings = rows.distinct().withColumn("bucket", bucket_of(F.col("gram")))
    postings.hint("rebalance", "bucket").sortWithinPartitions("bucket", "gram", "file", "block").write.options(
        **SORTED_FILES
    ).partitionBy("bucket").parquet(f"{store}/{batch}/grams")
    create_json(spark, {"schema": json.loads(texts.schema.json()), "text": text}, store, "batches", f"{batch}.json")
    return batch


def batches_of(spark: SparkSession, store: str) -> list[str]:
    """Names of the finished batches."""
    return sorted(n.removesuffix(".json") for n in names_in(spark, store, "batches") if not n.startswith("."))


def candidate_blocks(spark: SparkSession, store: str, batch: str, needles: Sequence[str]) -> DataFrame | None:
    """(file, block) of a batch where all grams of some needle stand. None if a needle is shorter
    than a gram, as every block may hold it then."""
    wanted = [sorted({n[i:i + GRAM] for i in range(len(n) - GRAM + 1)}) for n in needles]
    if not all(wanted):
        return None
    grams = sorted(set().union(*wanted))
    postings = spark.read.schema(POSTINGS).parquet(f"{store}/{batch}/grams").filter(
        F.col("bucket").isin([bucket_of(F.lit(g)) for g in grams]) & F.col("gram").isin(grams)
    )
    found = [f"__n{i}" for i in range(len(wanted))]
    counted = postings.groupBy("file", "block").agg(
        *[F.count_if(F.col("gram").isin(w)).alias(name) for name, w in zip(found, wanted)]
    )
    any_of = F.lit(False)
    for name, w in zip(found, wanted):
        any_of = any_of | (F.col(name) == len(w))
    return counted.filter(any_of).select("file", "block")


def rows_to_search(spark: SparkSession, store: str, terms: Sequence[str]) -> DataFrame:
    """All rows that can hold a term, and some more: those of the candidate blocks.

    Files without a candidate are neither listed nor opened, and within a file the numbers
    of blocks are pushed down. A search with more than ``LISTED`` candidate blocks, or with
    a term shorter than a gram, reads everything, so results are whole in any case.
    """
    needles, names = search_terms(terms), batches_of(spark, store)
    if not names:
        raise ValueError(f"no finished batch in {store}")
    about = read_json(spark, store, "batches", f"{names[0]}.json")
    schema = T.StructType.fromJson(about["schema"]).add("__block", "long")
    read = spark.read.schema(schema)
    blocks, parts = [], [candidate_blocks(spark, store, batch, needles) for batch in names]
    for batch, part in zip(names, parts):
        if part is None or len(blocks) > LISTED:
            return read.parquet(*[f"{store}/{b}/texts" for b in names])
        blocks += [(f"{store}/{batch}/texts/{r.file}", r.block) for r in part.limit(LISTED + 1).collect()]
    if len(blocks) > LISTED:
        return read.parquet(*[f"{store}/{b}/texts" for b in names])
    if not blocks:
        return spark.createDataFrame([], schema)
    numbers = sorted({block for _, block in blocks})
    rows = read.parquet(*sorted({path for path, _ in blocks}))
    return rows.filter(F.col("__block").between(numbers[0], numbers[-1]) & F.col("__block").isin(numbers))


def search_indexed(spark: SparkSession, store: str, terms: Sequence[str], text: str = "text") -> DataFrame:
    """``search_text`` over all rows of the store."""
    return search_text(rows_to_search(spark, store, terms).drop("__block"), terms, text)
