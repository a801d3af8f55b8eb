"""Session operators: life cycle, timelines, roll-ups and paging."""

from pyspark.sql import Column, DataFrame, functions as F

from trailspark.functions.ordered import newest_page, top_n, with_rank
from trailspark.functions.times import as_ntz, interval, seconds_between
from trailspark.schema import (
    FILE_TOOLS, POST_TOOL, PRE_COMPACT, PRE_TOOL, SESSION_END, SESSION_START, TASK,
)

def newest_first() -> list[Column]:
    return [F.col("ts").desc(), F.col("event_id").desc()]


def is_agent_call() -> Column:
    """Start of an agent: a Task call that names one."""
    return (
        (F.col("event_name") == PRE_TOOL)
        & (F.col("tool_name") == TASK)
        & F.col("subagent_type").isNotNull()
    )


def of_session(ev: DataFrame, session_id: str | None) -> DataFrame:
    """Events with a session, or of one session (a filter the scan can take)."""
    if session_id is None:
        return ev.filter(F.col("session_id").isNotNull())
    return ev.filter(F.col("session_id") == session_id)


def latest_session(ev: DataFrame) -> DataFrame:
    return of_session(ev, None).orderBy(*newest_first()).select("session_id", "ts").limit(1)


def session_lifecycle(ev: DataFrame, session_id: str | None = None) -> DataFrame:
    steps = of_session(ev, session_id).filter(
        F.col("event_name").isin(SESSION_START, SESSION_END, PRE_COMPACT)
    )
    return steps.orderBy("session_id", "ts", "event_id").select(
        "session_id", "ts", "event_name", "source"
    )


def session_tool_stats(ev: DataFrame, session_id: str | None = None) -> DataFrame:
    """Tool use per session. The first, hash-only round counts events per distinct
    (command, file), so a hot session reaches the second round already reduced."""
    used = of_session(ev, session_id).filter(F.col("event_name").isin(PRE_TOOL, POST_TOOL))
    per_target = used.groupBy("session_id", "tool_name", "command", "file_path").agg(
        F.count_if(F.col("event_name") == PRE_TOOL).alias("pre"),
        F.count_if(F.col("event_name") == POST_TOOL).alias("post"),
    )
    return per_target.groupBy(
        "session_id", F.coalesce("tool_name", F.lit("Unknown")).alias("tool_name")
    ).agg(
        F.sum("pre").alias("pre_count"),
        F.sum("post").alias("post_count"),
        F.count_distinct("command").alias("unique_commands"),
        F.count_distinct("file_path").alias("unique_files"),
    )


def recent_timeline(ev: DataFrame, n: int = 100, session_id: str | None = None) -> DataFrame:
    columns = ("session_id", "ts", "event_name", "tool_name", "command", "file_path",
               "pattern", "url", "description")
    rows = of_session(ev, session_id).select(*columns, "event_id")
    return top_n(rows, ["session_id"], newest_first(), n).select(*columns)


def file_operations(ev: DataFrame, n: int = 50, session_id: str | None = None) -> DataFrame:
    """Newest file events of all sessions; ``session_id`` narrows them to one."""
    if session_id is not None:
        ev = of_session(ev, session_id)
    touched = ev.filter(F.col("tool_name").isin(*FILE_TOOLS) & F.col("file_path").isNotNull())
    return touched.orderBy(*newest_first()).select("ts", "tool_name", "file_path", "event_name").limit(n)


def _combinations(ev: DataFrame) -> DataFrame:
    """Events counted per distinct combination of the texts the roll-ups look at: texts are
    grouping keys and only longs are aggregated, so it is a hash aggregate with map-side
    combine, and a hot session shrinks to its combinations."""
    is_start = F.col("event_name") == SESSION_START
    return of_session(ev, None).groupBy(
        "session_id", "tool_name", "cwd", "workspace",
        F.when(is_agent_call(), F.col("subagent_type")).alias("agent"),
        F.when(is_start, F.col("source")).alias("start_source"),
    ).agg(
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(is_start).alias("starts"),
        F.count_if(F.col("event_name") == SESSION_END).alias("ends"),
    )


def _session_profile(combinations: DataFrame, context: str = "max") -> DataFrame:
    """Session figures per (session, agent); events outside agent calls have no agent. One row
    per agent is left, so what is gathered by session afterwards is as long as the
    agent vocabulary."""
    return combinations.groupBy("session_id", "agent").agg(
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
        F.sum("n").alias("n"),
        F.sum("starts").alias("starts"),
        F.sum("ends").alias("ends"),
        F.max("start_source").alias("start_source"),
        F.collect_set("tool_name").alias("tools"),
        F.max(_placed("cwd", context)).alias("cwd"),
        F.max(_placed("workspace", context)).alias("workspace"),
    )


def _placed(name: str, context: str) -> Column:
    """What the context column is chosen by: its text, or the time it was last seen."""
    if context == "max":
        seen = F.struct(F.col(name).alias("value"))
    elif context == "latest":
        seen = F.struct("last_ts", F.col(name).alias("value"))
    else:
        raise ValueError(f"context must be 'max' or 'latest', not {context!r}")
    return F.when(F.col(name).isNotNull(), seen)


def _agents_by_first_use() -> Column:
    """Agents of the group, earliest first; one input row per agent."""
    uses = F.collect_list(
        F.when(F.col("agent").isNotNull(), F.struct(F.col("first_ts").alias("at"), "agent"))
    )
    return F.transform(F.array_sort(uses), lambda use: use["agent"])


def session_rollup(
    ev: DataFrame, as_of, active_within: str = "5 minutes", context: str = "max"
) -> DataFrame:
    """One row per session. Agent lists come out of the same aggregations, so
    there is one scan and no join."""
    return rolled_sessions(_combinations(ev), as_of, active_within, context)


def rolled_sessions(combinations: DataFrame, as_of, active_within: str, context: str) -> DataFrame:
    rolled = _session_profile(combinations, context).groupBy("session_id").agg(
        F.min("first_ts").alias("session_start"),
        F.max("last_ts").alias("session_end"),
        F.sum("n").alias("total_events"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("tools")))).alias("__tools"),
        F.sum("starts").alias("start_events"),
        F.sum("ends").alias("end_events"),
        F.max("start_source").alias("start_source"),
        F.max("cwd")["value"].alias("cwd"),
        F.max("workspace")["value"].alias("workspace"),
        _agents_by_first_use().alias("agents_used"),
    )
    recent = F.col("session_end") > as_ntz(as_of) - interval(active_within)
    return rolled.select(
        "session_id", "session_start", "session_end", "total_events",
        F.size("__tools").cast("bigint").alias("unique_tools"),
        "start_events", "end_events", "start_source", "cwd", "workspace",
        F.when(F.size("__tools") > 0, F.array_join("__tools", ", ")).alias("tools_used"),
        F.when(F.col("end_events") > 0, "completed").when(recent, "active")
        .otherwise("inactive").alias("status"),
        "agents_used",
        F.size("agents_used").cast("bigint").alias("unique_agents"),
        seconds_between(F.col("session_start"), F.col("session_end")).alias("duration_seconds"),
    )


def session_agent_list(ev: DataFrame) -> DataFrame:
    """Agents of each session, ordered by first use."""
    first_use = of_session(ev, None).filter(is_agent_call()).groupBy(
        "session_id", F.col("subagent_type").alias("agent")
    ).agg(F.min("ts").alias("first_ts"))
    return first_use.groupBy("session_id").agg(
        _agents_by_first_use().alias("agents_list"),
        F.count("agent").alias("unique_agents_count"),
    )


def active_sessions(ev: DataFrame, as_of, within: str = "1 hour", n: int = 10) -> DataFrame:
    """Newest open sessions: no end event and a last event inside ``within``."""
    now = as_ntz(as_of)
    grouped = _session_profile(_combinations(ev)).groupBy("session_id").agg(
        F.min("first_ts").alias("session_start"),
        F.max("last_ts").alias("last_event"),
        F.sum("n").alias("total_events"),
        F.max("cwd")["value"].alias("cwd"),
        F.max("workspace")["value"].alias("workspace"),
        F.sum("ends").alias("__ends"),
        _agents_by_first_use().alias("agents_used"),
    )
    open_now = grouped.filter((F.col("__ends") == 0) & (F.col("last_event") > now - interval(within)))
    return open_now.orderBy(F.col("last_event").desc(), "session_id").limit(n).select(
        "session_id", "session_start", "last_event", "total_events", "cwd", "workspace",
        seconds_between(F.col("last_event"), now).alias("seconds_since_last"),
        "agents_used",
        seconds_between(F.col("session_start"), F.col("last_event")).alias("duration_seconds"),
    )


def session_timeline(
    ev: DataFrame, session_id: str | None = None, parsed: bool = False
) -> DataFrame:
    """Every event, oldest first per session, with the raw payload.

    A range-partitioned sort, so one long session spans many partitions.
    ``parsed`` turns the payload into a VARIANT (null where it is not JSON).
    """
    rows = of_session(ev, session_id)
    if parsed:
        rows = rows.withColumn("data", F.try_parse_json("data"))
    return rows.orderBy("session_id", "ts", "event_id")


def session_context(ev: DataFrame) -> DataFrame:
    """Context per session; events without session form a group of their own."""
    per_place = ev.groupBy("session_id", "cwd", "workspace").agg(
        F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts")
    )
    return per_place.groupBy(F.col("session_id").alias("session")).agg(
        F.max("cwd").alias("working_dir"),
        F.max("workspace").alias("workspace"),
        F.sum("n").alias("events"),
        F.max("last_ts").alias("last_event"),
    )


# Rows that the driver may order to show a page; deeper pages are found by counting.
SHALLOW = 10_000


def recent_events(ev: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    if offset + limit > SHALLOW:
        return newest_page(ev, ("ts", "event_id"), newest_first(), offset, limit)
    return ev.orderBy(*newest_first()).offset(offset).limit(limit)


def events_before(ev: DataFrame, ts, event_id: int, limit: int = 100) -> DataFrame:
    """The page that follows the event (``ts``, ``event_id``), the last of the page before: however
    deep, only older events are looked at."""
    moment = as_ntz(ts)
    older = (F.col("ts") < moment) | ((F.col("ts") == moment) & (F.col("event_id") < event_id))
    rows = ev.filter((F.col("ts") <= moment) & older)
    if "event_date" in ev.columns:
        rows = rows.filter(F.col("event_date") <= moment.cast("date"))
    return rows.orderBy(*newest_first()).limit(limit)


def recent_sessions(ev: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    grouped = of_session(ev, None).groupBy("session_id").agg(
        F.min("ts").alias("session_start"),
        F.max("ts").alias("session_end"),
        F.count(F.lit(1)).alias("total_events"),
    )
    order = [F.col("session_start").desc(), F.col("session_id")]
    if offset + limit > SHALLOW:
        page = newest_page(grouped, ("session_start",), order, offset, limit)
    else:
        page = grouped.orderBy(*order).offset(offset).limit(limit)
    return page.withColumn(
        "duration_seconds", seconds_between(F.col("session_start"), F.col("session_end"))
    )


def events_since(ev: DataFrame, start: Column) -> DataFrame:
    """Events from ``start`` on; the stored table also skips older ``event_date`` folders."""
    rows = ev.filter(F.col("ts") >= start)
    if "event_date" in ev.columns:
        rows = rows.filter(F.col("event_date") >= start.cast("date"))
    return rows


def events_between(ev: DataFrame, start, end) -> DataFrame:
    """Half-open range, pruned on both sides."""
    upper = as_ntz(end)
    rows = events_since(ev, as_ntz(start)).filter(F.col("ts") < upper)
    if "event_date" in ev.columns:
        rows = rows.filter(F.col("event_date") <= upper.cast("date"))
    return rows


def session_replay(ev: DataFrame, session_id: str | None = None) -> DataFrame:
    rows = of_session(ev, session_id).select(
        "session_id", "ts", "event_id", "event_name", "tool_name"
    )
    numbered = with_rank(rows, ["session_id"], "step", first="__start")
    return numbered.select(
        "session_id", "step", "ts",
        seconds_between(F.col("__start"), F.col("ts")).alias("offset_seconds"),
        "event_name", "tool_name",
    )
