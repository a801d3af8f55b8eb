"""Mixing sources to target weights by weighted fair queueing."""

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from trailspark.llm.shared import WORD, load, same, spread_copies, stored

WEIGHTS = (5, 2, 1)
PASSES = 3
BINS = 1024


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, passes: int = PASSES) -> DataFrame:
    """``source``, ``source_size``, ``target`` and ``rank``, from (source, size) rows.

    Weights go round over the sources by code point, null last. Targets share the total by
    weight; a target stops at ``passes`` times its source, and what is above is shared again.
    Filled sources are those with the least size per weight, so one pass over the sources in
    that order finds them. The windows hold one row per source.
    """
    all_rows = Window.partitionBy(F.lit(0))
    by_name = all_rows.orderBy(F.col("source").asc_nulls_last())
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = totals.withColumn("rank", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.lit(list(weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("w", weight.cast("double")).withColumn(
        "limit", F.col("source_size") * passes
    )
    order = all_rows.orderBy(F.col("limit") / F.col("w"), "rank")
    filled = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("source_size").over(all_rows) - F.coalesce(F.sum("limit").over(filled), F.lit(0))
    # The level that holds if this source and those after it are not filled.
    level = left / F.sum("w").over(rest)
    marked = ranked.withColumn("level", level).withColumn(
        "open", F.col("level") * F.col("w") <= F.col("limit")
    )
    first_open = F.min(F.when(F.col("open"), F.struct(F.col("limit") / F.col("w"), "rank", "level")))
    share = first_open.over(all_rows)["level"]
    target = F.least(share * F.col("w"), F.col("limit").cast("double"))
    return marked.select("source", "source_size", target.alias("target"), "rank")


def virtual_times(docs: DataFrame, weights: Sequence[int], passes: int, cells: int) -> DataFrame:
    """Every row with its source's figures and ``tokens``: those of its source up to it, in a
    shuffled order.

    The order is that of a hash of the row. A source is cut into hash ranges; sums of the
    ranges before a row's own are added to the running sum in its range, so no task holds a
    whole source. Equal rows are counted first.
    """
    names = docs.columns
    cell = F.floor((F.col("__hash") / 2.0**64 + 0.5) * cells).cast("int")
    groups = docs.groupBy(*names).agg(F.count(F.lit(1)).alias("__n")).withColumn("__cell", cell)
    words = F.col("size") * F.col("__n")
    ranges = groups.groupBy("source", "__cell").agg(F.sum(words).alias("size"))
    earlier = Window.partitionBy("source").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.withColumn("__offset", F.coalesce(F.sum("size").over(earlier), F.lit(0))).drop("size")
    targets = source_targets(ranges.select("source", "size"), weights, passes)
    ranges = offsets.join(targets, same(offsets, targets, ["source"])).select(offsets["*"], "source_size", "target", "rank")
    before = (
        Window.partitionBy("source", "__cell")
        .orderBy("__hash", *[n for n in names if n not in ("source", "__hash")])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = groups.withColumn("__before", F.coalesce(F.sum(words).over(before), F.lit(0)))
    joined = placed.join(ranges, same(placed, ranges, ["source", "__cell"])).select(
        placed["*"], "__offset", "source_size", "target", "rank"
    )
    spread = spread_copies(joined, "__n", "__copy")
    tokens = F.col("__offset") + F.col("__before") + (F.col("__copy") + 1) * F.col("size")
    return spread.withColumn("tokens", tokens).drop("__offset", "__before", "__copy", "__cell")


def finish_time(number: int) -> Column:
    """The virtual time at which a row's pass ``number`` ends: tokens of the source over its target."""
    return (F.col("source_size") * number + F.col("tokens")) / F.col("target")


def cut_time(queue: DataFrame, budget: int) -> tuple[float, int] | None:
    """Time and rank of the last entry that fits when all are taken in order of (time, rank).

    Sums over ranges of time find the range in which the budget ends; that range is
    divided again, until what is left is a few entries, so no task sorts the whole queue.
    """
    low, high, spent = 0.0, None, 0
    while True:
        inside = queue.filter((F.col("time") >= low) & (F.lit(True) if high is None else F.col("time") < high))
        span = inside.agg(F.min("time"), F.max("time"), F.count(F.lit(1))).first()
        if span[2] == 0:
            return (low, -1) if spent else None
        if span[2] <= 8 * BINS or span[0] == span[1]:
            order = Window.partitionBy(F.lit(0)).orderBy("time", "rank")
            total = F.sum("size").over(order)
            fits = inside.withColumn("total", total).filter(F.col("total") + spent <= budget)
            last = fits.agg(F.max(F.struct("time", "rank"))).first()[0]
            return (last["time"], last["rank"]) if last else ((span[0], -1) if spent else None)
        start, width = span[0], (span[1] - span[0]) / BINS
        number = F.least(F.floor((F.col("time") - start) / width), F.lit(BINS - 1))
        ranges = inside.groupBy(number.alias("bin")).agg(
            F.sum("size").alias("size"), F.min("time").alias("low"), F.max("time").alias("high")
        )
        rows = ranges.orderBy("low").collect()  # BINS rows at most
        low, high = start, None
        for row in rows:
            low = row["low"]
            if spent + row["size"] > budget:
                high = row["high"]
                break
            spent += row["size"]
        else:
            return (rows[-1]["high"], 2**31 - 1)
        high = math.nextafter(high, math.inf)


def mix(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, passes: int = PASSES, cells: int = 256
) -> DataFrame:
    """``docs`` needs ``doc_id``, ``source``, ``size`` and ``mark`` (a long that tells texts
    apart); returns doc_id, source, size, mark, source_size, target and ``taken``.

    Each source is a queue of its rows in shuffled order, repeated up to ``passes`` times; an
    entry's virtual finish time is the tokens of its source so far over the source's target.
    All queues are merged by that time and cut where the next entry would pass the total of
    all sizes. ``taken`` is the row's size times its entries before the cut. Rows without
    words take nothing; null in any column is a value like others; an empty table gives no
    rows; equal rows are entries of their own, and which of them is which does not matter.
    """
    keyed = docs.select(
        "doc_id", "source", F.coalesce("size", F.lit(0)).cast("long").alias("size"), "mark",
        F.xxhash64(F.lit(7), "doc_id", "mark").alias("__hash"),
    )
    times = stored(virtual_times(keyed, weights, passes, cells), "mix")
    live = times.filter((F.col("size") > 0) & (F.col("target") > 0))
    queue = live.select("size", "rank", F.explode(F.array(*[finish_time(i) for i in range(passes)])).alias("time"))
    budget = times.agg(F.sum("size")).first()[0] or 0
    cut = cut_time(queue, budget)
    if cut is None:
        entries = F.lit(0)  # nothing has words
    else:
        at, rank = F.lit(cut[0]), F.lit(cut[1])
        ends = [finish_time(i) for i in range(passes)]
        inside = [(e < at) | ((e == at) & (F.col("rank") <= rank)) for e in ends]
        entries = sum([F.coalesce(i.cast("int"), F.lit(0)) for i in inside], F.lit(0))
    taken = F.when((F.col("size") > 0) & (F.col("target") > 0), F.col("size") * entries).otherwise(0)
    return times.select(
        "doc_id", "source", "size", "mark", "source_size", "target", taken.cast("long").alias("taken")
    )


def words_of(text: str) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", words_of("text").alias("size"), F.xxhash64("text").alias("mark"))


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, 0 to PASSES times; same columns.

    Rows that are equal in all columns are taken together: as many of them come out as the
    mix takes of all. The texts are shuffled once. Null sources are the last source; rows
    whose text is null or has no words come out never. Columns may have any names. An
    empty table gives no rows.
    """
    names = docs.columns
    # A hash skips nulls, so which columns are null goes in too.
    told = [x for c in names for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    both = [F.xxhash64(*told), F.xxhash64(F.lit(1), *told)]
    given = docs.select(
        both[0].alias("mark"), both[1].alias("doc_id"), "source", words_of("text").alias("size")
    )
    taken = mix(given, weights).filter("taken > 0").groupBy("mark", F.col("doc_id").alias("mark2")).agg(
        F.sum(F.expr("taken div size")).alias("__n")
    )
    rows = docs.select(
        both[0].alias("mark"), both[1].alias("mark2"), *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(names)]
    ).dropDuplicates(["mark", "mark2"])
    out = spread_copies(rows.join(taken, ["mark", "mark2"]), "__n", "__copy")
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(names)])


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(sized(load(spark, sf_dir))).select("doc_id", "size", "source_size", "target", "taken")
