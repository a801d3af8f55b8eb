"""Workspace operators: roll-ups over the sessions of a workspace."""

from pyspark.sql import DataFrame, functions as F

from trailspark.functions.times import as_ntz, interval, micros_between, micros_to_seconds


def in_workspace(ev: DataFrame, workspace: str | None = None) -> DataFrame:
    """Session events inside a workspace (label neither null nor empty)."""
    rows = ev.filter(F.col("session_id").isNotNull())
    if workspace is not None:
        return rows.filter(F.col("workspace") == workspace)
    return rows.filter(F.col("workspace").isNotNull() & (F.col("workspace") != ""))


def workspace_sessions(ev: DataFrame, workspace: str | None = None) -> DataFrame:
    grouped = in_workspace(ev, workspace).groupBy("workspace", "session_id").agg(
        F.min("ts").alias("start_time"),
        F.max("ts").alias("end_time"),
        F.count(F.lit(1)).alias("event_count"),
    )
    micros = micros_between(F.col("start_time"), F.col("end_time"))
    return grouped.withColumn("duration_seconds", micros_to_seconds(micros))


TOTALS = {
    "total_sessions": lambda: F.count(F.lit(1)),
    "first_activity": lambda: F.min("start_time"),
    "last_activity": lambda: F.max("end_time"),
    "total_events": lambda: F.sum("event_count"),
    "duration_micros": lambda: F.sum(micros_between(F.col("start_time"), F.col("end_time"))),
}


def _totals(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("workspace").agg(*[agg().alias(name) for name, agg in TOTALS.items()])


def workspace_rollup(ev: DataFrame, as_of, active: str = "1 hour", recent: str = "24 hours") -> DataFrame:
    """One row per workspace; its sessions are rows of ``workspace_session_ids``."""
    return rolled_workspaces(workspace_sessions(ev), as_of, active, recent)


def rolled_workspaces(sessions: DataFrame, as_of, active: str, recent: str) -> DataFrame:
    now, last = as_ntz(as_of), F.col("last_activity")
    status = (
        F.when(last > now - interval(active), "active")
        .when(last > now - interval(recent), "recent")
        .otherwise("inactive")
    )
    return _totals(sessions).select(
        "workspace", "total_sessions", "first_activity", "last_activity", "total_events",
        micros_to_seconds(F.col("duration_micros")).alias("total_duration_seconds"),
        status.alias("status"),
    )


def workspace_session_ids(ev: DataFrame, workspace: str | None = None) -> DataFrame:
    """One row per workspace and session: no row or task holds all ids of a workspace."""
    return in_workspace(ev, workspace).select("workspace", "session_id").distinct()


def workspace_avg_session(ev: DataFrame) -> DataFrame:
    seconds = micros_to_seconds(F.col("duration_micros"))
    average = seconds / F.nullif("total_sessions", F.lit(0))
    return _totals(workspace_sessions(ev)).select("workspace", average.alias("avg_session_seconds"))
