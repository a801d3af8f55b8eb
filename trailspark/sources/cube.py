"""Stored counts per date, from which the roll-ups are read without the events.

A row of the cube stands for all events of a date that agree in the columns KEYS: their
number, the first and the last time. ``refresh_cube`` counts only the dates whose files
have changed since the last time, so polling costs what has come in. The ``*_of_cube``
functions equal the operators over the events, late and repeated loads included.
"""

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from trailspark.operators.agents import summed
from trailspark.operators.sessions import is_agent_call, rolled_sessions
from trailspark.operators.workspaces import in_workspace, rolled_workspaces
from trailspark.schema import PRE_TOOL, SESSION_END, SESSION_START
from trailspark.session import create_json, delete, names_in, read_json
from trailspark.sources.events import read_events

KEYS = ("session_id", "event_name", "tool_name", "subagent_type", "source", "cwd", "workspace")
CUBE_SCHEMA = T.StructType(
    [T.StructField(k, T.StringType()) for k in KEYS]
    + [
        T.StructField("n", T.LongType()),
        T.StructField("first_ts", T.TimestampNTZType()),
        T.StructField("last_ts", T.TimestampNTZType()),
        T.StructField("event_date", T.DateType()),
    ]
)
DATE = "event_date="
NO_DATE = "__HIVE_DEFAULT_PARTITION__"  # Fixed value: Spark's folder of a null.
SEEN = "_seen"


def counted(ev: DataFrame) -> DataFrame:
    """One row per date and combination: a hash aggregate with map-side combine."""
    return ev.groupBy("event_date", *KEYS).agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


def _files(spark: SparkSession, path: str) -> dict[str, str]:
    """A mark of the files of each date. Files are written once, under names of their own."""
    dates = [n.removeprefix(DATE) for n in names_in(spark, path) if n.startswith(DATE)]
    return {
        d: hashlib.sha256("\n".join(sorted(names_in(spark, path, DATE + d))).encode()).hexdigest() for d in dates
    }


def _seen(spark: SparkSession, store: str) -> tuple[int, dict[str, str]]:
    versions = [int(n.removesuffix(".json")) for n in names_in(spark, store, SEEN) if n.endswith(".json")]
    return (max(versions), read_json(spark, store, SEEN, f"{max(versions)}.json")) if versions else (0, {})


def refresh_cube(
    spark: SparkSession, events_path: str, store: str, make: Callable[[DataFrame], DataFrame] = counted
) -> list[str]:
    """Bring the cube up to the stored events; returns the dates that were counted again.

    ``make`` gives the stored rows of some dates' events, with their ``event_date``.

    The files are listed before they are read: what comes in meanwhile changes the next
    listing, and its date is counted once more. A run that dies before its last write
    is repeated by the next. One job at a time may refresh a store.
    """
    files = _files(spark, events_path)
    version, seen = _seen(spark, store)
    changed = sorted(d for d in files if files[d] != seen.get(d))
    gone = sorted(set(seen) - set(files))
    if changed:
        known = F.col("event_date").isin([d for d in changed if d != NO_DATE])
        dated = known | F.col("event_date").isNull() if NO_DATE in changed else known
        rows = make(read_events(spark, events_path).filter(dated))
        writer = rows.hint("rebalance", F.col("event_date")).write.mode("overwrite")
        writer.option("partitionOverwriteMode", "dynamic").partitionBy("event_date").parquet(f"{store}/cube")
    for date in gone:
        delete(spark, store, "cube", DATE + date)
    if changed or gone:
        if not create_json(spark, files, store, SEEN, f"{version + 1}.json"):
            raise RuntimeError(f"another job has refreshed {store}")
        if version:
            delete(spark, store, SEEN, f"{version}.json")
    return changed


def read_cube(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.schema(CUBE_SCHEMA).parquet(f"{store}/cube")


def session_rollup_of_cube(
    cube: DataFrame, as_of, active_within: str = "5 minutes", context: str = "max"
) -> DataFrame:
    is_start, is_end = F.col("event_name") == SESSION_START, F.col("event_name") == SESSION_END
    combinations = cube.filter(F.col("session_id").isNotNull()).groupBy(
        "session_id", "tool_name", "cwd", "workspace",
        F.when(is_agent_call(), F.col("subagent_type")).alias("agent"),
        F.when(is_start, F.col("source")).alias("start_source"),
    ).agg(
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
        F.sum("n").alias("n"),
        F.sum(F.when(is_start, F.col("n")).otherwise(0)).alias("starts"),
        F.sum(F.when(is_end, F.col("n")).otherwise(0)).alias("ends"),
    )
    return rolled_sessions(combinations, as_of, active_within, context)


def workspace_rollup_of_cube(
    cube: DataFrame, as_of, active: str = "1 hour", recent: str = "24 hours"
) -> DataFrame:
    sessions = in_workspace(cube).groupBy("workspace", "session_id").agg(
        F.min("first_ts").alias("start_time"), F.max("last_ts").alias("end_time"), F.sum("n").alias("event_count")
    )
    return rolled_workspaces(sessions, as_of, active, recent)


def tool_usage_of_cube(cube: DataFrame) -> DataFrame:
    used = cube.filter(F.col("event_name") == PRE_TOOL).groupBy(F.col("tool_name").alias("tool")).agg(
        F.sum("n").alias("usage_count")
    )
    return used.orderBy(F.col("usage_count").desc(), "tool")


def summary_of_cube(cube: DataFrame, approximate: bool = False) -> DataFrame:
    return summed(cube.groupBy("session_id", "subagent_type").agg(F.sum("n").alias("n")), approximate)
