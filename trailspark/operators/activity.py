"""Gap and activity operators over the sessions of a workspace."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from trailspark.functions.ordered import top_n, with_next
from trailspark.functions.times import MICROS, micros_between, micros_to_seconds
from trailspark.operators.workspaces import in_workspace, workspace_sessions
from trailspark.schema import PROMPT, SESSION_START, STOP

SESSION = ("workspace", "session_id")
# Labels of the gap buckets, shortest first.
GAP_BUCKETS = ("active", "idle", "short_wait", "medium_wait", "long_wait")


def _gap_micros() -> Column:
    return micros_between(F.col("ts"), F.col("next_ts"))


def _seconds(bound: float) -> Column:
    return F.lit(int(bound * MICROS))


def activity_states(
    ev: DataFrame, idle_s: float = 5, waiting_s: float = 30, n: int | None = None,
    workspace: str | None = None,
) -> DataFrame:
    """Gap to the next event of the session and what it says; all rows, or the
    first n per workspace, cut after the gaps are known."""
    rows = in_workspace(ev, workspace).select(
        *SESSION, "ts", "event_id", "event_name", "tool_name", "description", "command", "file_path"
    )
    gaps = with_next(rows, SESSION, {"next_ts": "ts"}).withColumn("__gap", _gap_micros())
    first = gaps if n is None else top_n(gaps, ["workspace"], [F.col("ts"), F.col("event_id")], n)
    state = (
        F.when(F.col("next_ts").isNull(), "session_end")
        .when(F.col("__gap") > _seconds(waiting_s), "waiting")
        .when(F.col("__gap") > _seconds(idle_s), "idle")
        .otherwise("active")
    )
    return first.select(
        *SESSION, "ts", "event_name", "tool_name", "description", "command", "file_path",
        "next_ts", micros_to_seconds(F.col("__gap")).alias("gap_seconds"),
        state.alias("activity_state"),
    )


def significant_gaps(
    ev: DataFrame, min_s: float = 60, n: int = 50, severity_s: tuple[float, float] = (300, 1800),
    workspace: str | None = None,
) -> DataFrame:
    """Longest gaps per workspace with the tools on both sides."""
    rows = in_workspace(ev, workspace).select(*SESSION, "ts", "event_id", "tool_name")
    gaps = with_next(rows, SESSION, {"next_ts": "ts", "next_tool": "tool_name"})
    gaps = gaps.withColumn("__gap", _gap_micros()).filter(F.col("__gap") > _seconds(min_s))
    order = [F.col("__gap").desc(), F.col("ts"), F.col("event_id")]
    severity = (
        F.when(F.col("__gap") < _seconds(severity_s[0]), "minor")
        .when(F.col("__gap") < _seconds(severity_s[1]), "moderate")
        .otherwise("major")
    )
    return top_n(gaps, ["workspace"], order, n).select(
        *SESSION, F.col("ts").alias("gap_start"), F.col("next_ts").alias("gap_end"),
        micros_to_seconds(F.col("__gap")).alias("gap_seconds"),
        F.col("tool_name").alias("last_tool"), "next_tool", severity.alias("severity"),
    )


def gap_histogram(ev: DataFrame, bounds: Sequence[float] = (2, 5, 60, 300)) -> DataFrame:
    """Gaps per workspace in buckets (low, high]."""
    rows = in_workspace(ev).select(*SESSION, "ts", "event_id")
    gaps = with_next(rows, SESSION, {"next_ts": "ts"}).filter(F.col("next_ts").isNotNull())
    gaps = gaps.withColumn("__gap", _gap_micros())
    bucket = F.when(F.col("__gap") <= _seconds(bounds[0]), GAP_BUCKETS[0])
    for bound, label in zip(bounds[1:], GAP_BUCKETS[1:]):
        bucket = bucket.when(F.col("__gap") <= _seconds(bound), label)
    return gaps.groupBy("workspace", bucket.otherwise(GAP_BUCKETS[-1]).alias("bucket")).agg(
        F.count(F.lit(1)).alias("gaps"),
        micros_to_seconds(F.sum("__gap")).alias("gap_seconds"),
    )


def _work_wait(ev: DataFrame, workspace: str | None = None) -> DataFrame:
    """Working and waiting microseconds per session.

    The event filter comes before the lead: only direct neighbours among start,
    prompt and stop count. Sessions without a stop fall out after the
    aggregation, which needs no semi-join.
    """
    rows = in_workspace(ev, workspace).filter(
        F.col("event_name").isin(SESSION_START, PROMPT, STOP)
    ).select(*SESSION, "ts", "event_id", "event_name")
    steps = with_next(rows, SESSION, {"next_ts": "ts", "next_event": "event_name"})
    at, then = F.col("event_name"), F.col("next_event")
    work = at.isin(SESSION_START, PROMPT) & (then == STOP)
    wait = (at == STOP) & (then == PROMPT)
    return steps.groupBy(*SESSION).agg(
        F.sum(F.when(work, _gap_micros()).otherwise(0)).alias("work_us"),
        F.sum(F.when(wait, _gap_micros()).otherwise(0)).alias("wait_us"),
        F.count_if(at == STOP).alias("stop_count"),
        F.count_if(at == PROMPT).alias("prompt_count"),
    ).filter(F.col("stop_count") > 0)


def _active_percentage() -> Column:
    total = F.col("work_us") + F.col("wait_us")
    return F.when(total > 0, F.col("work_us") * 100.0 / total).otherwise(0.0)


def work_wait_split(ev: DataFrame, workspace: str | None = None) -> DataFrame:
    return _work_wait(ev, workspace).select(
        *SESSION,
        micros_to_seconds(F.col("work_us")).alias("working_time_seconds"),
        micros_to_seconds(F.col("wait_us")).alias("waiting_time_seconds"),
        micros_to_seconds(F.col("work_us") + F.col("wait_us")).alias("total_time_seconds"),
        _active_percentage().alias("active_percentage"),
        "stop_count", "prompt_count",
    )


def _wait_profile(ev: DataFrame, bounds: tuple[float, float], workspace: str | None) -> DataFrame:
    wait = F.col("wait_us")
    short, medium = _seconds(bounds[0]), _seconds(bounds[1])
    one = lambda cond: F.when((wait > 0) & cond, 1).otherwise(0).cast("bigint")
    return _work_wait(ev, workspace).withColumns(
        {
            "active_periods": F.when(F.col("work_us") > 0, F.col("stop_count")).otherwise(0),
            "short_waits": one(wait <= short),
            "medium_waits": one((wait > short) & (wait <= medium)),
            "long_waits": one(wait > medium),
        }
    )


def wait_profile(
    ev: DataFrame, bounds: tuple[float, float] = (60, 300), workspace: str | None = None
) -> DataFrame:
    """Bucket of the total waiting time of each session, and figures derived from it."""
    waiting = micros_to_seconds(F.col("wait_us"))
    return _wait_profile(ev, bounds, workspace).select(
        *SESSION, "active_periods", "short_waits", "medium_waits", "long_waits",
        waiting.alias("longest_gap_seconds"),
        (waiting / F.col("stop_count")).alias("avg_gap_seconds"),
        F.lit(True).alias("has_accurate_data"),
    )


def workspace_activity(ev: DataFrame, bounds: tuple[float, float] = (60, 300)) -> DataFrame:
    """Active and waiting totals of a workspace and their shares."""
    totals = _wait_profile(ev, bounds, None).groupBy("workspace").agg(
        F.count(F.lit(1)).alias("sessions"),
        F.sum("work_us").alias("work_us"),
        F.sum("wait_us").alias("wait_us"),
        micros_to_seconds(F.max("wait_us")).alias("longest_gap_seconds"),
        F.sum("short_waits").alias("short_waits"),
        F.sum("medium_waits").alias("medium_waits"),
        F.sum("long_waits").alias("long_waits"),
    )
    total = F.nullif(F.col("work_us") + F.col("wait_us"), F.lit(0))
    return totals.select(
        "workspace", "sessions",
        micros_to_seconds(F.col("work_us")).alias("active_time_seconds"),
        micros_to_seconds(F.col("wait_us")).alias("waiting_time_seconds"),
        "longest_gap_seconds", "short_waits", "medium_waits", "long_waits",
        (F.col("work_us") * 100.0 / total).alias("active_percentage"),
        (F.col("wait_us") * 100.0 / total).alias("waiting_percentage"),
    )


def session_activity_share(ev: DataFrame, workspace: str | None = None) -> DataFrame:
    """Sessions of a workspace with their active share: null where it is not
    known, zero where nothing was worked."""
    shares = _work_wait(ev, workspace).select(*SESSION, _active_percentage().alias("active_percentage"))
    return workspace_sessions(ev, workspace).join(shares, list(SESSION), "left").withColumn(
        "has_accurate_data", F.col("active_percentage").isNotNull()
    )
