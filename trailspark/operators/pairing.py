"""Pairing of start and end events by position."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from trailspark.functions.ordered import with_rank
from trailspark.functions.times import micros_between, micros_to_seconds
from trailspark.schema import PRE_TOOL


def pair_kth(
    calls: DataFrame,
    keys: Sequence[str],
    first_of: Sequence[str] = (),
    end_only: Sequence[str] = (),
) -> DataFrame:
    """k-th start with k-th end event per key; both kinds of orphans stay.

    Equal to a full outer join of the numbered starts and ends, but written as
    one aggregation on (keys, k): at most two rows meet in a group, so nothing
    is skewed however many calls a key has. ``first_of`` columns are the
    start's value, else the end's; ``end_only`` columns are the end's.
    """
    keys = list(keys)
    is_start = F.col("event_name") == PRE_TOOL
    rows = calls.select(
        *keys, "ts", "event_id", F.when(is_start, 0).otherwise(1).alias("__side"),
        *first_of, *end_only,
    )
    ranked = with_rank(rows, [*keys, "__side"], "call_no")
    start, end = F.col("__side") == 0, F.col("__side") == 1
    both = ranked.groupBy(*keys, "call_no").agg(
        F.min(F.when(start, F.col("ts"))).alias("__start"),
        F.min(F.when(end, F.col("ts"))).alias("end_time"),
        F.min(F.when(start, F.col("event_id"))).alias("__start_id"),
        F.min(F.when(end, F.col("event_id"))).alias("__end_id"),
        *[
            F.coalesce(F.max(F.when(start, F.col(c))), F.max(F.when(end, F.col(c)))).alias(c)
            for c in first_of
        ],
        *[F.max(F.when(end, F.col(c))).alias(c) for c in end_only],
    )
    micros = micros_between(F.col("__start"), F.col("end_time"))
    return both.select(
        *keys, "call_no",
        F.coalesce("__start", "end_time").alias("start_time"),
        "end_time",
        F.coalesce("__start_id", "__end_id").alias("call_id"),
        micros.alias("duration_micros"),
        micros_to_seconds(micros).alias("duration_seconds"),
        (micros < 0).alias("is_out_of_order"),
        *first_of, *end_only,
    )
