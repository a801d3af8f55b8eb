"""Registered queries that go through files or streams.

Their inputs are written from the given tables into the shared scratch folder,
run through the source, sink or streaming job, and read back.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from trailspark.operators import sessions
from trailspark.plans import parameters as P
from trailspark.plans.fixture_view import (
    load_events, load_silver, load_typed, raw_from_silver,
)
from trailspark.schema import TASK, TYPED_COLUMNS, WORKSPACE_KEY
from trailspark.session import pin_session, scratch_path
from trailspark.sources import cube, events as E, export, heartbeat, text_index
from trailspark.streaming import active, jobs


def _raw_files(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_path(spark, "raw")
    raw_from_silver(load_silver(pin_session(spark), sf_dir)).write.json(path)
    return path


def read_raw_events(spark, sf_dir):
    raw = E.read_raw_events(spark, _raw_files(spark, sf_dir))
    return raw.select(
        "event_id", "ts", "event_name", "tool_arg", "matcher",
        F.get_json_object("data", "$.session_id").alias("session_id"),
    )


def normalize_time(spark, sf_dir):
    """Event times as zoned text, UTC text and local text of a zone west of UTC."""
    rows = load_events(pin_session(spark), sf_dir)
    clock = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    form = (
        F.when(F.col("event_type") == "click", F.concat(clock, F.lit("-03:00")))
        .when(F.col("event_type") == "view", F.concat(clock, F.lit("Z")))
        .otherwise(clock)
    )
    return E.normalize_time(rows.select("event_id", form.alias("ts")), "-05:00")


def split_quarantine(spark, sf_dir):
    """Valid JSON, truncated JSON and blanks, by event type."""
    cut = F.expr("left(props, length(props) - 1)")
    data = (
        F.when(F.col("event_type") == "error", cut)
        .when(F.col("event_type") == "view", F.lit(" "))
        .otherwise(F.col("props"))
    )
    rows = load_events(pin_session(spark), sf_dir).select("event_id", "ts", data.alias("data"))
    valid, rejected = E.split_quarantine(rows)
    valid = valid.withColumn("reason", F.lit(None).cast("string"))
    return valid.unionByName(rejected).select("event_id", "reason")


def to_silver(spark, sf_dir):
    silver = load_silver(pin_session(spark), sf_dir)
    return E.to_silver(silver.select("event_id", "ts", "event_name", "data")).select(*TYPED_COLUMNS)


def attach_workspace(spark, sf_dir):
    silver = load_silver(pin_session(spark), sf_dir)
    user = F.regexp_extract("cwd", r"^/home/u(\d+)/", 1).cast("int")
    hosts = silver.select("cwd").distinct().select(
        "cwd", F.when(user % 3 == 0, "").otherwise(F.concat(F.lit("h"), user % 5)).alias("workspace")
    )
    return E.attach_workspace(silver, hosts).select(
        "event_id", "cwd", "workspace",
        F.get_json_object("data", f"$.{WORKSPACE_KEY}").alias("payload_workspace"),
    )


def append_events(spark, sf_dir):
    """A first load, then a load that repeats part of it."""
    path = scratch_path(spark, "table")
    silver = load_silver(pin_session(spark), sf_dir)
    E.append_events(silver.filter(F.col("ts") < F.lit(P.RANGE[1]).cast("timestamp_ntz")), path)
    E.append_events(silver.filter(F.col("ts") >= F.lit(P.RANGE[0]).cast("timestamp_ntz")), path)
    return E.read_events(spark, path).select("event_date", *TYPED_COLUMNS)


def _polled_cube(spark, sf_dir):
    """A cube that is refreshed after a first load, and again after one that repeats part of
    it and adds the rest."""
    events, store = scratch_path(spark, "table"), scratch_path(spark, "cube")
    silver = load_silver(pin_session(spark), sf_dir)
    for load in (F.col("ts") < F.lit(P.RANGE[1]).cast("timestamp_ntz"), F.col("ts") >= F.lit(P.RANGE[0]).cast("timestamp_ntz")):
        E.append_events(silver.filter(load), events)
        cube.refresh_cube(spark, events, store)
    return cube.read_cube(spark, store)


def session_rollup_of_cube(spark, sf_dir):
    rolled = cube.session_rollup_of_cube(_polled_cube(spark, sf_dir), P.AS_OF, P.SESSION_ACTIVE)
    return rolled.withColumn("agents_used", F.array_join("agents_used", ","))


def workspace_rollup_of_cube(spark, sf_dir):
    return cube.workspace_rollup_of_cube(_polled_cube(spark, sf_dir), P.AS_OF, P.WORKSPACE_ACTIVE, P.WORKSPACE_RECENT)


def tool_usage_of_cube(spark, sf_dir):
    return cube.tool_usage_of_cube(_polled_cube(spark, sf_dir))


def summary_of_cube(spark, sf_dir):
    return cube.summary_of_cube(_polled_cube(spark, sf_dir))


def write_audit_log(spark, sf_dir):
    path = scratch_path(spark, "audit")
    silver = load_silver(pin_session(spark), sf_dir)
    E.write_audit_log(raw_from_silver(silver).withColumn("ts", F.col("ts").cast("timestamp_ntz")), path)
    header = F.regexp_extract("value", r"^\[([^\]]+)\] Event: (\w+) \|", 2)
    lines = spark.read.text(path).select(header.alias("event_name"))
    return lines.filter(F.col("event_name") != "").groupBy("event_name").agg(
        F.count(F.lit(1)).alias("entries")
    )


def agent_event_feed(spark, sf_dir):
    return E.agent_event_feed(load_silver(pin_session(spark), sf_dir)).drop("data")


def heartbeat_rate(spark, sf_dir):
    """Event times written as heartbeat lines."""
    rows = load_events(pin_session(spark), sf_dir)
    line = F.concat(
        F.lit("Hook triggered at "), F.date_format("ts", "EEE MMM "),
        F.lpad(F.dayofmonth("ts").cast("string"), 2, " "),
        F.date_format("ts", " HH:mm:ss"), F.lit(" -03 "), F.date_format("ts", "yyyy"),
    )
    path = scratch_path(spark, "heartbeats")
    rows.select(line.alias("value")).write.text(path)
    return heartbeat.heartbeat_rate(heartbeat.read_lines(spark, path), "day")


def route_events(spark, sf_dir):
    rows = load_typed(pin_session(spark), sf_dir)
    return E.route_events(rows, P.RULES).select("event_id", "event_name", "tool_name", "rule_id")


def route_events_by(spark, sf_dir):
    """The rules of the parameters as a table."""
    rows = load_typed(pin_session(spark), sf_dir)
    rules = spark.createDataFrame(list(P.RULES), "rule_id int, event_name string, pattern string")
    return E.route_events_by(rows, rules).select("event_id", "event_name", "tool_name", "rule_id")


def export_csv(spark, sf_dir):
    path = scratch_path(spark, "csv")
    rolled = sessions.session_rollup(
        load_typed(pin_session(spark), sf_dir), P.AS_OF, P.SESSION_ACTIVE
    ).withColumn("agents_used", F.array_join("agents_used", ","))
    export.export_csv(rolled, path)
    return export.read_csv_export(spark, path, rolled.schema)


# Streams --------------------------------------------------------------------


def _finish(query) -> None:
    query.awaitTermination()


def _in_two_deliveries(spark: SparkSession, rows: DataFrame, start, **kwargs) -> str:
    """Run a job over ``rows``, of which about a tenth comes after it has handled the others."""
    path, out, progress = (scratch_path(spark, n) for n in ("delivered", "out", "progress"))
    is_late = F.pmod(F.xxhash64("event_id"), F.lit(10)) == 0
    for part in (rows.filter(~is_late), rows.filter(is_late)):
        part.write.mode("append").parquet(path)
        stream = spark.readStream.schema(rows.schema).parquet(path)
        _finish(start(stream, out, progress, **kwargs))
    return out


def stream_silver(spark, sf_dir):
    """Raw files in which finished calls stand twice and every second event has no id.

    With an id the repeat is a repeat; without, both lines are events.
    """
    raw = raw_from_silver(load_silver(pin_session(spark), sf_dir))
    times = F.when(F.col("event_name") == "PostToolUse", 2).otherwise(1)
    lines = raw.withColumn("n", F.explode(F.sequence(F.lit(1), times))).drop("n")
    lines = lines.withColumn("event_id", F.when(F.col("event_id") % 2 == 0, F.col("event_id")))
    path, out = scratch_path(spark, "raw"), scratch_path(spark, "out")
    lines.write.json(path)
    _finish(jobs.stream_silver(spark, path, out, scratch_path(spark, "progress")))
    stored = E.read_events(spark, f"{out}/events")
    return stored.select(*[c for c in TYPED_COLUMNS if c != "event_id"])


def stream_session_rollup(spark, sf_dir):
    rows = load_typed(pin_session(spark), sf_dir)
    out = _in_two_deliveries(spark, rows, jobs.stream_session_rollup)
    return jobs.read_session_rollup(spark, out)


def stream_active_sessions(spark, sf_dir):
    out = _in_two_deliveries(spark, load_typed(pin_session(spark), sf_dir), active.stream_active_sessions)
    return active.read_active_sessions(spark, out, silence=P.SILENCE, delay=P.WATERMARK_DELAY)


def stream_window_counts(spark, sf_dir):
    rows = load_typed(pin_session(spark), sf_dir)
    out = _in_two_deliveries(spark, rows, jobs.stream_window_counts)
    return jobs.read_window_counts(spark, out).drop("approx_agents")


def stream_activity_periods(spark, sf_dir):
    rows = load_typed(pin_session(spark), sf_dir)
    out = _in_two_deliveries(spark, rows, jobs.stream_activity_periods, gap=P.PERIOD_GAP)
    return jobs.read_activity_periods(spark, out, gap=P.PERIOD_GAP)


def stream_pair_calls(spark, sf_dir):
    """Task events as they come; none names its call, so they are numbered when they are read."""
    calls = load_silver(pin_session(spark), sf_dir).filter(F.col("tool_name") == TASK)
    out = _in_two_deliveries(spark, calls, jobs.stream_pair_calls)
    return jobs.read_pair_calls(spark, out, within=P.PAIR_WITHIN)


def stream_late_report(spark, sf_dir):
    """Events that arrive up to two hours late, by the minute they happened in."""
    delay = F.make_dt_interval(mins=F.minute("ts") * 2)
    arrived = load_typed(pin_session(spark), sf_dir).withColumn("ingest_ts", F.col("ts") + delay)
    out = _in_two_deliveries(spark, arrived, jobs.stream_late_report)
    return jobs.read_late_report(spark, out)


def search_indexed_documents(spark, sf_dir):
    """Documents added in two batches, then searched by their grams."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "text")
    store = scratch_path(spark, "texts")
    text_index.index_texts(docs.filter("doc_id % 2 = 0"), store)
    text_index.index_texts(docs.filter("doc_id % 2 <> 0 OR doc_id IS NULL"), store)
    return text_index.search_indexed(spark, store, P.SEARCH_TERMS)


IO = {
    fn.__name__: fn
    for fn in (
        read_raw_events, normalize_time, split_quarantine, to_silver, attach_workspace,
        append_events, session_rollup_of_cube, workspace_rollup_of_cube, tool_usage_of_cube,
        summary_of_cube, write_audit_log, agent_event_feed, heartbeat_rate, route_events, route_events_by, export_csv,
        search_indexed_documents,
        stream_silver, stream_session_rollup, stream_active_sessions, stream_window_counts,
        stream_activity_periods, stream_pair_calls, stream_late_report,
    )
}
