"""Structured Streaming jobs over event files. Each returns the started query;
a ``read_*`` function turns what the job wrote into a table.

Without ``every`` a job handles all files present now and ends; with it, for
example ``"30 seconds"``, it runs on until it is stopped.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from trailspark.functions.ordered import top_n, with_rank
from trailspark.functions.times import MICROS, interval_micros, micros_between, micros_to_seconds
from trailspark.operators.sessions import is_agent_call
from trailspark.schema import POST_TOOL, PRE_TOOL, SESSION_END, SILVER_SCHEMA
from trailspark.sources.events import (
    BAD_LINE, append_events, normalize_time, raw_reader_schema, split_quarantine, to_silver,
    with_event_ids, with_file,
)
from trailspark.streaming.parts import read_parts, start_each, start_parts


def zoned(ts: str) -> Column:
    """Watermarks need TIMESTAMP; under a UTC session this is the same clock."""
    return F.col(ts).cast("timestamp")


def unzoned(ts: Column) -> Column:
    return ts.cast("timestamp_ntz")


# Ingest ---------------------------------------------------------------------


def read_raw_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Raw rows and their file; ids are made per micro-batch, which holds whole files."""
    reader = spark.readStream.schema(raw_reader_schema()).option("columnNameOfCorruptRecord", BAD_LINE)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return with_file(reader.json(path))


def stream_silver(
    spark: SparkSession, in_path: str, out_path: str, checkpoint: str,
    tz: str = "UTC", files_per_batch: int | None = None, every: str | None = None,
) -> StreamingQuery:
    """Raw files to the typed event table at ``out_path/events``, refused rows to
    ``out_path/rejected``.

    Repeats are found by id against the table itself and not in a watermarked
    state, so an event is stored once however late it, or its repeat, arrives.
    The batch is read again for each use rather than cached: a first load may be
    larger than the executors' disks.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        valid, rejected = split_quarantine(normalize_time(with_event_ids(batch), tz))
        append_events(to_silver(valid), f"{out_path}/events")
        rejected.write.mode("overwrite").parquet(f"{out_path}/rejected/batch_id={batch_id}")

    return start_each(read_raw_stream(spark, in_path, files_per_batch), write, checkpoint, every=every)


def read_silver_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """The stored event table as a stream."""
    reader = spark.readStream.schema(SILVER_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


# Live totals ----------------------------------------------------------------


def stream_session_rollup(
    ev: DataFrame, path: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Totals per session and micro-batch. They merge at read time, so no state
    grows with the number of sessions and no late event is lost."""

    def totals(batch: DataFrame) -> DataFrame:
        return batch.filter(F.col("session_id").isNotNull()).groupBy("session_id").agg(
            F.min("ts").alias("session_start"),
            F.max("ts").alias("last_event"),
            F.count(F.lit(1)).alias("total_events"),
            F.count_if(F.col("event_name") == SESSION_END).alias("end_events"),
        )

    return start_parts(ev, path, checkpoint, merged_totals, prepare=totals, every=every)


def merged_totals(parts: DataFrame) -> DataFrame:
    return parts.groupBy("session_id").agg(
        F.min("session_start").alias("session_start"),
        F.max("last_event").alias("last_event"),
        F.sum("total_events").alias("total_events"),
        F.sum("end_events").alias("end_events"),
    )


def read_session_rollup(spark: SparkSession, path: str) -> DataFrame:
    """Session totals so far; status depends on the clock and is left to the reader."""
    return merged_totals(read_parts(spark, path)).withColumn("is_ended", F.col("end_events") > 0)


def stream_window_counts(
    ev: DataFrame, path: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Events per hour and a mergeable sketch of the agents used in it.

    The state holds one small row per hour, whatever the number of events, so it
    needs no watermark and late events still count.
    """
    hours = ev.groupBy(F.window(zoned("ts"), "1 hour").alias("w")).agg(
        F.count(F.lit(1)).alias("events"),
        F.hll_sketch_agg(F.when(is_agent_call(), F.col("subagent_type"))).alias("agents"),
    )
    hours = hours.select(unzoned(F.col("w.start")).alias("hour"), "events", "agents")
    return start_parts(hours, path, checkpoint, newest_hours, mode="update", every=every)


def newest_hours(parts: DataFrame) -> DataFrame:
    """The newest row of each hour, which holds its total so far."""
    return top_n(parts, ["hour"], [F.col("batch_id").desc()], 1)


def read_window_counts(spark: SparkSession, path: str, hours: int = 24) -> DataFrame:
    """Tumbling hours and sliding windows of ``hours`` that move by one hour.

    Sliding windows are merged from the hourly rows instead of copying every
    event into each window it falls in.
    """
    hourly = newest_hours(read_parts(spark, path))
    shift = F.explode(F.sequence(F.lit(0), F.lit(hours - 1)))
    spread = hourly.withColumn("shift", shift)
    spans = F.array(
        F.struct(F.lit("1 hour").alias("span"), F.lit(1).alias("hours")),
        F.struct(F.lit(f"{hours} hours").alias("span"), F.lit(hours).alias("hours")),
    )
    spread = spread.withColumn("s", F.explode(spans)).filter(F.col("shift") < F.col("s.hours"))
    start = F.col("hour") - F.make_dt_interval(hours=F.col("shift"))
    return spread.groupBy("s.span", start.alias("window_start")).agg(
        F.sum("events").alias("events"),
        F.hll_sketch_estimate(F.hll_union_agg("agents")).alias("approx_agents"),
    )


def _merged(pieces: DataFrame, keys: list[str], gap: str) -> DataFrame:
    """Periods of the keys: pieces no further apart than ``gap`` become one."""
    order = Window.partitionBy(*keys).orderBy("period_start", "period_end")
    reached = F.max("period_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    silence = micros_between(reached, F.col("period_start"))
    fresh = F.when(silence <= interval_micros(gap), 0).otherwise(1)
    numbered = pieces.withColumn("__new", fresh).withColumn("__period", F.sum("__new").over(order))
    return numbered.groupBy(*keys, "__period").agg(
        F.min("period_start").alias("period_start"),
        F.max("period_end").alias("period_end"),
        F.sum("events").alias("events"),
    ).drop("__period")


def merged_periods(pieces: DataFrame, gap: str) -> DataFrame:
    """Periods of each session, first merged inside each hour: a busy session then is
    a few rows per hour when its hours meet."""
    hourly = pieces.withColumn("__hour", F.date_trunc("hour", "period_start"))
    return _merged(_merged(hourly, ["session_id", "__hour"], gap).drop("__hour"), ["session_id"], gap)


def stream_activity_periods(
    ev: DataFrame, path: str, checkpoint: str, gap: str = "30 seconds", every: str | None = None
) -> StreamingQuery:
    """Periods of a session without a gap longer than ``gap``, which is a second or more.

    Each micro-batch writes the periods of its own events and they merge at read
    time, so no state is kept and no late event is refused. Events of one second
    are counted first.
    """
    if interval_micros(gap) < MICROS:
        raise ValueError("a gap is at least one second")

    def periods(batch: DataFrame) -> DataFrame:
        known = batch.filter(F.col("session_id").isNotNull() & F.col("ts").isNotNull())
        seconds = known.groupBy("session_id", F.date_trunc("second", "ts").alias("__second")).agg(
            F.min("ts").alias("period_start"),
            F.max("ts").alias("period_end"),
            F.count(F.lit(1)).alias("events"),
        )
        return merged_periods(seconds.drop("__second"), gap)

    merge = lambda parts: merged_periods(parts.drop("batch_id"), gap)
    return start_parts(ev, path, checkpoint, merge, prepare=periods, every=every)


def read_activity_periods(spark: SparkSession, path: str, gap: str = "30 seconds") -> DataFrame:
    """All periods so far; the last of a session may still grow."""
    periods = merged_periods(read_parts(spark, path).drop("batch_id"), gap)
    micros = micros_between(F.col("period_start"), F.col("period_end"))
    return periods.select(
        "session_id", "period_start", "period_end", "events",
        micros_to_seconds(micros).alias("active_seconds"),
    )


# Pairing and lateness -------------------------------------------------------

CALL = ("call_key", "session_id", "agent_type")
# Fixed value: where a payload names the call that both of its events belong to.
CALL_ID = "$.tool_use_id"


def call_key(ev: DataFrame) -> Column:
    """What names a call: the column ``call_key`` if there is one, else the payload's id, else null."""
    if "call_key" in ev.columns:
        return F.col("call_key")
    return F.get_json_object("data", CALL_ID) if "data" in ev.columns else F.lit(None).cast("string")


def stream_pair_calls(
    ev: DataFrame, path: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """What each micro-batch knows of agent calls: their starts and ends.

    Events that name their call meet by that name, within the batch and at read time.
    Others are kept one by one with their id; they are numbered when they are read, so
    an event that comes late takes its place among those before it. No state is kept.
    """

    def sides(batch: DataFrame) -> DataFrame:
        is_start, is_end = F.col("event_name") == PRE_TOOL, F.col("event_name") == POST_TOOL
        rows = batch.withColumn("call_key", call_key(batch)).filter(
            F.col("session_id").isNotNull() & F.col("subagent_type").isNotNull() & (is_start | is_end)
        )
        return merged_sides(rows.select(
            "call_key", "session_id", F.col("subagent_type").alias("agent_type"), "event_id",
            F.when(is_start, F.col("ts")).alias("start_time"), F.when(is_end, F.col("ts")).alias("end_time"),
            F.when(is_end, F.col("total_tokens")).alias("total_tokens"),
        ))

    return start_parts(ev, path, checkpoint, merged_sides, prepare=sides, every=every)


def _met(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*CALL).agg(
        F.min("start_time").alias("start_time"), F.min("end_time").alias("end_time"), F.max("total_tokens").alias("total_tokens")
    )


def merged_sides(parts: DataFrame) -> DataFrame:
    """Sides that name their call as one row per call, the others as they are."""
    named, others = parts.filter(F.col("call_key").isNotNull()), parts.filter(F.col("call_key").isNull())
    columns = [*CALL, "event_id", "start_time", "end_time", "total_tokens"]
    return others.select(*columns).unionByName(_met(named), allowMissingColumns=True)


def read_pair_calls(spark: SparkSession, path: str, within: str | None = None) -> DataFrame:
    """One row per call. The k-th start of a session and agent that names no call belongs to
    the k-th such end. Starts without an end and ends without a start stay, with nulls for
    the other side; sides more than ``within`` apart are two such rows."""
    parts = read_parts(spark, path)
    ends = F.col("start_time").isNull()
    loose = parts.filter(F.col("call_key").isNull()).withColumns(
        {"ts": F.coalesce("start_time", "end_time"), "__side": F.when(ends, 1).otherwise(0)}
    )
    ranked = with_rank(loose, ["session_id", "agent_type", "__side"], "__k")
    key = F.concat_ws("|", "session_id", "agent_type", F.col("__k").cast("string"))
    numbered = ranked.withColumn("call_key", key).select(*CALL, "start_time", "end_time", "total_tokens")
    calls = _met(parts.filter(F.col("call_key").isNotNull()).select(numbered.columns).union(numbered))
    if within:
        apart = F.abs(micros_between(F.col("start_time"), F.col("end_time"))) > interval_micros(within)
        start, end = F.col("start_time"), F.col("end_time")
        side = lambda s, e, t: F.struct(s.alias("start_time"), e.alias("end_time"), t.alias("total_tokens"))
        none, tokens = F.lit(None), F.col("total_tokens")
        rows = F.when(apart, F.array(
            side(start, none.cast("timestamp_ntz"), none.cast(calls.schema["total_tokens"].dataType)),
            side(none.cast("timestamp_ntz"), end, tokens),
        )).otherwise(F.array(side(start, end, tokens)))
        calls = calls.select(*CALL, F.inline(rows))
    micros = micros_between(F.col("start_time"), F.col("end_time"))
    return calls.select(
        "session_id", "agent_type", "call_key", "start_time", "end_time",
        micros_to_seconds(micros).alias("duration_seconds"), "total_tokens",
    )


def stream_late_report(
    ev: DataFrame, path: str, checkpoint: str, delay: str = "1 hour", every: str | None = None
) -> StreamingQuery:
    """Events that came in (``ingest_ts``) more than ``delay`` after they happened,
    counted per hour and micro-batch."""
    lag = micros_between(F.col("ts"), F.col("ingest_ts"))

    def late(batch: DataFrame) -> DataFrame:
        hour = F.window("ts", "1 hour")["start"]
        slow = batch.withColumn("__lag", lag).filter(F.col("__lag") > interval_micros(delay))
        return slow.groupBy(hour.alias("hour")).agg(
            F.count(F.lit(1)).alias("late_events"), F.max("__lag").alias("lag_us")
        )

    return start_parts(ev, path, checkpoint, merged_late, prepare=late, every=every)


def merged_late(parts: DataFrame) -> DataFrame:
    return parts.groupBy("hour").agg(
        F.sum("late_events").alias("late_events"), F.max("lag_us").alias("lag_us")
    )


def read_late_report(spark: SparkSession, path: str) -> DataFrame:
    return merged_late(read_parts(spark, path)).select(
        "hour", "late_events", micros_to_seconds(F.col("lag_us")).alias("longest_delay_seconds")
    )
