"""Durations per agent and date as stored sketches, from which any span of dates is read.

``refresh_cube(spark, events, store, make=duration_sketches)`` keeps them up to date.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from trailspark.operators.agents import range_shares, whole_ms
from trailspark.schema import POST_TOOL, TASK

# Size of a quantile sketch: rank errors below 1 % (KLL: about 2.3 / k**0.9).
K = 400
SKETCH_SCHEMA = T.StructType(
    [
        T.StructField("agent_type", T.StringType()),
        T.StructField("n", T.LongType()),
        T.StructField("timed", T.LongType()),
        T.StructField("total_ms", T.DoubleType()),
        T.StructField("min_ms", T.DoubleType()),
        T.StructField("max_ms", T.DoubleType()),
        T.StructField("first_used", T.TimestampNTZType()),
        T.StructField("last_used", T.TimestampNTZType()),
        T.StructField("durations", T.BinaryType()),
        T.StructField("sessions", T.BinaryType()),
        T.StructField("event_date", T.DateType()),
    ]
)


def duration_sketches(ev: DataFrame) -> DataFrame:
    """One row per date and agent. Sketches are merged before the shuffle, so a hot agent is
    one small row per task."""
    done = ev.filter(
        (F.col("event_name") == POST_TOOL) & (F.col("tool_name") == TASK) & F.col("subagent_type").isNotNull()
    )
    return done.groupBy(F.to_date("ts").alias("event_date"), F.col("subagent_type").alias("agent_type")).agg(
        F.count(F.lit(1)).alias("n"), F.count("duration_ms").alias("timed"), F.sum("duration_ms").alias("total_ms"),
        F.min("duration_ms").alias("min_ms"), F.max("duration_ms").alias("max_ms"),
        F.min("ts").alias("first_used"), F.max("ts").alias("last_used"),
        F.kll_sketch_agg_double("duration_ms", K).alias("durations"),
        F.hll_sketch_agg("session_id").alias("sessions"),
    )


def read_sketches(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.schema(SKETCH_SCHEMA).parquet(f"{store}/cube")


def duration_profile_of_sketches(sketches: DataFrame, since=None, until=None) -> DataFrame:
    """``agent_duration_profile`` of the dates from ``since`` to before ``until``. Median and 95th
    percentile are values whose rank is off by 1 % at most, and the number of sessions is
    estimated; the other figures are exact."""
    rows = sketches
    if since is not None:
        rows = rows.filter(F.col("event_date") >= F.lit(since).cast("date"))
    if until is not None:
        rows = rows.filter(F.col("event_date") < F.lit(until).cast("date"))
    merged = rows.groupBy("agent_type").agg(
        F.sum("n").alias("total_invocations"),
        F.hll_sketch_estimate(F.hll_union_agg("sessions")).alias("approx_sessions"),
        F.min("first_used").alias("first_used"), F.max("last_used").alias("last_used"),
        (F.sum("total_ms") / F.nullif(F.sum("timed"), F.lit(0))).alias("avg_duration_ms"),
        F.min("min_ms").alias("min_duration_ms"), F.max("max_ms").alias("max_duration_ms"),
        F.sum("timed").alias("__timed"), F.kll_merge_agg_double("durations", K).alias("__all"),
    )
    at = lambda rank: F.when(F.col("__timed") > 0, F.kll_sketch_get_quantile_double("__all", F.lit(rank)))
    merged = merged.withColumns({"median_duration_ms": at(0.5), "p95_duration_ms": at(0.95)})
    return merged.select(
        "agent_type", "total_invocations", "approx_sessions", "first_used", "last_used",
        *[whole_ms(f"{name}_duration_ms") for name in ("avg", "min", "max", "median", "p95")],
    )


def duration_range_shares_of_sketches(sketches: DataFrame, since=None, until=None) -> DataFrame:
    return range_shares(duration_profile_of_sketches(sketches, since, until))
