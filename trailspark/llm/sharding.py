"""Reproducible shuffle into shards by a keyed permutation of global row numbers."""

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from trailspark.llm.shared import load, spread_copies

ROUNDS = 6
WALKS = 16  # A walk leaves the range with probability below 1/sqrt(n) a step.


def feistel(value: Column, high: Column, low: Column, seed: int) -> Column:
    """A permutation of 0 .. high * low - 1: halves modulo ``high`` and ``low`` that are
    shifted in turn by a hash of the other half."""
    left, right = F.floor(value / low), value % low
    for number in range(ROUNDS):
        key = F.lit(seed * 1_000 + number).cast("long")
        if number % 2 == 0:
            left = F.pmod(left + F.pmod(F.xxhash64(right, key), high), high)
        else:
            right = F.pmod(right + F.pmod(F.xxhash64(left, key), low), low)
    return left * low + right


def permuted(row: Column, n: Column, seed: int) -> Column:
    """Where row ``row`` of ``n`` goes; numbers beyond n are walked on until they fall below it.

    The permutation covers fewer than n + sqrt(n) + 1 numbers, so a walk is short; one
    that were longer than WALKS steps would raise an error instead of losing its row.
    """
    high = F.ceil(F.sqrt(n.cast("double")))
    low = F.ceil(n / high)
    first = feistel(row, high, low, seed)
    walk = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALKS)), first,
        lambda at, _: F.when(at < n, at).otherwise(feistel(at, high, low, seed)),
    )
    found = F.when(first < n, first).otherwise(walk)
    return F.when(found < n, found).otherwise(F.raise_error(F.lit("cycle walk too long")).cast("long"))


def shard(df: DataFrame, shards: int, seed: int = 1, cells: int = 1024) -> DataFrame:
    """Every row with ``row_number``, ``shard`` and ``slot``.

    Row numbers run over all rows in an order that only their values decide: by hash cell,
    then by the columns. A number's place in the permutation gives the shard (remainder) and
    the slot in it (quotient), so counts differ by one at most, slots have no gaps, and any
    row's place can be computed without the others. Equal rows are counted before the
    numbering, so a row repeated without end stays one row in its cell. Any column may be
    null; an empty table gives no rows. Columns named ``row_number``, ``shard`` or ``slot``
    are replaced. The table of cells has ``cells`` rows, whatever the input.
    """
    names = [c for c in df.columns if c not in ("row_number", "shard", "slot")]
    plain = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    keys = plain.columns
    cell = F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(cells)).cast("int")
    groups = plain.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).withColumn("__cell", cell)
    sizes = groups.groupBy("__cell").agg(F.sum("__n").alias("__rows"))
    up_to = Window.partitionBy(F.lit(0)).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "__cell",
        F.coalesce(F.sum("__rows").over(up_to), F.lit(0)).alias("__offset"),
        F.sum("__rows").over(Window.partitionBy(F.lit(0))).alias("__total"),
    )
    before = Window.partitionBy("__cell").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    placed = groups.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    numbered = spread_copies(placed.join(F.broadcast(offsets), "__cell"), "__n", "__copy").withColumn(
        "row_number", F.col("__offset") + F.col("__before") + F.col("__copy")
    )
    at = numbered.withColumn("__at", permuted(F.col("row_number"), F.col("__total"), seed))
    return at.select(
        *[F.col(k).alias(c) for k, c in zip(keys, names)], "row_number",
        (F.col("__at") % shards).cast("int").alias("shard"),
        F.floor(F.col("__at") / shards).alias("slot"),
    )


def write_shards(df: DataFrame, path: str, shards: int, seed: int = 1) -> None:
    """One folder per shard, rows by slot."""
    placed = shard(df, shards, seed)
    pieces = placed.repartition("shard", F.floor(F.col("slot") / 1_000_000))
    pieces.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


SHARDS = 40


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    sized = load(spark, sf_dir).select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    return shard(sized, SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
