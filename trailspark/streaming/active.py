"""Open and closed sessions, followed live."""

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from trailspark.functions.times import as_ntz, interval, seconds_between
from trailspark.streaming.jobs import read_session_rollup, stream_session_rollup


def stream_active_sessions(
    ev: DataFrame, path: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Totals per session and micro-batch, from which the state of a session follows at any time."""
    return stream_session_rollup(ev, path, checkpoint, every)


def read_active_sessions(
    spark: SparkSession, path: str, silence: str = "1 hour", delay: str = "10 minutes", as_of=None
) -> DataFrame:
    """State of each session seen so far, however late its events came.

    An end event closes a session for good, also for events that trail in behind.
    Others are closed by silence when their last event lies more than ``silence``
    before ``as_of``; by default that is the newest event seen less ``delay``.
    """
    live = read_session_rollup(spark, path)
    if as_of is not None:
        now = as_ntz(as_of)
    else:
        newest = live.agg(F.max("last_event")).first()[0]
        now = F.lit(newest).cast("timestamp_ntz") - interval(delay)
    ended, silent = F.col("is_ended"), F.col("last_event") + interval(silence) < now
    return live.select(
        "session_id",
        F.when(ended | silent, "closed").otherwise("open").alias("state"),
        F.when(ended, "end").when(silent, "silence").alias("reason"),
        "session_start", "last_event", F.col("total_events").alias("events"),
        seconds_between(F.col("session_start"), F.col("last_event")).alias("duration_seconds"),
    )
