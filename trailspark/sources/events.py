"""From raw event files to the stored, typed event table."""

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from trailspark.functions.ordered import with_rank
from trailspark.schema import (
    PAYLOAD_SCHEMA, POST_TOOL, PRE_TOOL, RAW_SCHEMA, SILVER_COLUMNS, SILVER_SCHEMA, SUBAGENT_STOP,
    TASK, WORKSPACE_KEY,
)
from trailspark.session import delete, scratch_path

BAD_LINE = "bad_line"
FILE = "file"
# A zone after a clock time: Z, or an offset of hours with optional minutes.
ZONED = r":\d{2}(\.\d+)?\s*(Z|UTC|[+-]\d{1,2}(:?\d{2})?)$"
# The frame of an audit log entry.
SEPARATOR = "=" * 36


def raw_reader_schema() -> T.StructType:
    return T.StructType([*RAW_SCHEMA.fields, T.StructField(BAD_LINE, T.StringType())])


def with_file(raw: DataFrame) -> DataFrame:
    return raw.withColumn(FILE, F.col("_metadata.file_path"))


def with_event_ids(raw: DataFrame) -> DataFrame:
    """Rows without an ingest number get one that is the same on every re-read.

    It is a hash of the file, the whole line and, among lines of the file that are
    alike, their number: each of them is an event. Which of them gets which number
    does not matter. ``raw`` carries its file (``with_file``), all lines of it.
    """
    line = ["ts", "event_name", "tool_arg", "matcher", "data", BAD_LINE]
    alike = Window.partitionBy(FILE, "event_id", "__line").orderBy(*line)
    numbered = raw.withColumn("__line", F.xxhash64(*line)).withColumn("__number", F.row_number().over(alike))
    made = F.xxhash64(FILE, "__line", "__number")
    return numbered.withColumn("event_id", F.coalesce("event_id", made)).drop(FILE, "__line", "__number")


def read_raw_events(spark: SparkSession, path: str, file_format: str = "json") -> DataFrame:
    """Raw envelope rows; ``data`` stays text, unreadable lines are kept in ``bad_line``."""
    reader = spark.read.schema(raw_reader_schema())
    if file_format == "json":
        reader = reader.option("columnNameOfCorruptRecord", BAD_LINE)
    return with_event_ids(with_file(reader.format(file_format).load(path)))


def normalize_time(df: DataFrame, tz: str = "UTC", column: str = "ts") -> DataFrame:
    """UTC event time without zone, cut to whole seconds.

    Text with a zone is taken as that instant; anything else is local to ``tz``.
    """
    kind, value = df.schema[column].dataType, F.col(column)
    session_zone = F.current_timezone()
    utc = F.lit("UTC")

    def of_instant(instant: Column) -> Column:
        return F.convert_timezone(session_zone, utc, instant.cast("timestamp_ntz"))

    def of_local(local: Column) -> Column:
        return F.convert_timezone(F.lit(tz), utc, local)

    if isinstance(kind, T.StringType):
        moment = F.when(value.rlike(ZONED), of_instant(value.try_cast("timestamp"))).otherwise(
            of_local(value.try_cast("timestamp_ntz"))
        )
    elif isinstance(kind, T.TimestampNTZType):
        moment = of_local(value)
    else:
        moment = of_instant(value.cast("timestamp"))
    return df.withColumn(column, F.date_trunc("second", moment).cast("timestamp_ntz"))


def with_reject_reason(df: DataFrame) -> DataFrame:
    reason = F.when(F.coalesce(F.trim("data"), F.lit("")) == "", "no_data").when(
        F.try_parse_json("data").isNull(), "invalid_json"
    )
    if "ts" in df.columns:
        reason = reason.when(F.col("ts").isNull(), "no_time")
    if BAD_LINE in df.columns:
        reason = F.when(F.col(BAD_LINE).isNotNull(), "bad_line").otherwise(reason)
    return df.withColumn("reason", reason)


def split_quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events that can be stored, and the rest with the reason it was refused."""
    marked = with_reject_reason(df)
    valid = marked.filter(F.col("reason").isNull()).drop("reason", BAD_LINE)
    return valid, marked.filter(F.col("reason").isNotNull())


def to_silver(df: DataFrame) -> DataFrame:
    """All payload fields as typed columns, from one parse of the JSON text."""
    p = F.from_json("data", PAYLOAD_SCHEMA)
    parsed = df.select("event_id", "ts", "event_name", "data", p.alias("p"))
    tokens = F.coalesce("p.tool_response.totalTokens", "p.tool_response.token_usage.total_tokens")
    columns = {
        "workspace": F.col(f"p.{WORKSPACE_KEY}"),
        "response_text": F.get("p.tool_response.content", F.lit(0))["text"],
        "duration_ms": F.col("p.tool_response.totalDurationMs").try_cast("double"),
        "total_tokens": F.coalesce(
            tokens.try_cast("bigint"), tokens.try_cast("double").try_cast("bigint")
        ),
    }
    for name in ("session_id", "tool_name", "source", "cwd", "permission_mode"):
        columns[name] = F.col(f"p.{name}")
    for field in PAYLOAD_SCHEMA["tool_input"].dataType.fieldNames():
        columns[field] = F.col(f"p.tool_input.{field}")
    return parsed.withColumns(columns).select(*SILVER_COLUMNS)


def attach_workspace(df: DataFrame, hosts: DataFrame) -> DataFrame:
    """Label events with the workspace of their working directory.

    ``hosts`` is (cwd, workspace). A non-empty label replaces what the event
    carries, in the typed column and inside the payload. The join has no hint:
    a small host table is broadcast once its size is known, a large one is not.
    """
    labels = hosts.filter(F.col("workspace") != "").groupBy("cwd").agg(
        F.max("workspace").alias("__label")
    )
    joined = df.join(labels, "cwd", "left")
    out = joined.withColumn("workspace", F.coalesce("__label", "workspace"))
    if "data" in df.columns:
        fields = F.from_json("data", "map<string,variant>")
        others = F.map_filter(fields, lambda key, _: key != WORKSPACE_KEY)
        label = F.create_map(F.lit(WORKSPACE_KEY), F.col("__label").cast("variant"))
        merged = F.to_json(F.map_concat(others, label))
        out = out.withColumn(
            # Text that is no JSON object stays as it is.
            "data", F.when(F.col("__label").isNotNull(), F.coalesce(merged, "data")).otherwise(F.col("data"))
        )
    return out.select(*df.columns)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The stored event table; ``event_date`` is its partition column."""
    schema = T.StructType([*SILVER_SCHEMA.fields, T.StructField("event_date", T.DateType())])
    return spark.read.schema(schema).parquet(path)


# Sessions that a row group's bloom filter is made for.
SESSIONS_PER_GROUP = 50_000


def append_events(df: DataFrame, path: str) -> None:
    """Append events whose id the table does not hold yet for their date, each id once;
    events without a time have no date and are told apart by id alike.

    The batch is written aside once, so it is parsed once. Only ids and row numbers are
    compared: the date folders of the batch are read for their ids, and the rows to leave
    out, few as a rule, are taken from the batch. The rest is dealt by date, session and
    time: a crowded date is many files, and a session lies in few row groups, which their
    bounds and bloom filters tell.
    """
    spark = df.sparkSession
    aside = scratch_path(spark, "batch")
    numbered = df.withColumns({"event_date": F.to_date("ts"), "__row": F.monotonically_increasing_id()})
    numbered.write.parquet(aside)
    batch = spark.read.schema(numbered.schema).parquet(aside)
    firsts = batch.groupBy("event_date", "event_id").agg(F.min("__row").alias("__row"))
    try:
        stored = read_events(spark, path).select("event_date", "event_id")
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
    else:
        dates = [row[0] for row in batch.select("event_date").distinct().collect()]
        known = F.col("event_date").isin([d for d in dates if d])
        stored = stored.filter(known | F.col("event_date").isNull() if None in dates else known)
        alike = (stored["event_id"] == firsts["event_id"]) & stored["event_date"].eqNullSafe(firsts["event_date"])
        firsts = firsts.join(stored, alike, "left_anti")
    repeats = batch.select("__row").join(firsts.select("__row"), "__row", "left_anti")
    clustered = ["event_date", "session_id", "ts"]
    rows = batch.join(repeats, "__row", "left_anti").drop("__row")
    writer = rows.repartitionByRange(*clustered).sortWithinPartitions(*clustered).write.mode("append")
    writer = writer.option("parquet.bloom.filter.enabled#session_id", "true")
    writer = writer.option("parquet.bloom.filter.expected.ndv#session_id", str(SESSIONS_PER_GROUP))
    writer.partitionBy("event_date").parquet(path)
    delete(spark, aside)


def audit_lines(df: DataFrame) -> DataFrame:
    """One text block per event: separator, header line, indented payload."""
    pretty = F.to_json(F.from_json("data", "map<string,variant>"), {"pretty": "true"})
    header = F.concat(
        F.lit("["), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("] Event: "),
        F.coalesce("event_name", F.lit("unknown")),
        F.lit(" | Tool: "), F.coalesce("tool_arg", F.lit("")),
        F.lit(" | Matcher: "), F.coalesce("matcher", F.lit("")),
    )
    body = F.coalesce(pretty, "data", F.lit(""))
    return df.select(F.concat_ws("\n", F.lit(SEPARATOR), header, body).alias("value"))


def write_audit_log(df: DataFrame, path: str) -> None:
    audit_lines(df.sortWithinPartitions("ts", "event_id")).write.mode("append").text(path)


def agent_event_feed(ev: DataFrame) -> DataFrame:
    """Agent-only feed with a sequential id per event date."""
    name, is_task = F.col("event_name"), F.col("tool_name") == TASK
    phase = (
        F.when((name == PRE_TOOL) & is_task, "pre")
        .when((name == POST_TOOL) & is_task, "post")
        .when(name == SUBAGENT_STOP, "stop")
    )
    feed = ev.withColumn("phase", phase).filter(F.col("phase").isNotNull()).select(
        F.to_date("ts").alias("event_date"), "event_id", "ts", "phase", "data"
    )
    return with_rank(feed, ["event_date"], "id").select(
        "event_date", "id", "event_id", "ts", "phase", "data"
    )


def route_events(ev: DataFrame, rules: Sequence[tuple[int, str, str]]) -> DataFrame:
    """Events with each rule they match: same event name, and a tool pattern (``*`` = any).

    Rules are configuration, so they become expressions of one narrow step.
    """
    matches = []
    for rule_id, event_name, pattern in rules:
        match = F.col("event_name") == event_name
        if pattern != "*":
            match = match & F.coalesce(F.col("tool_name").rlike(pattern), F.lit(False))
        matches.append(F.when(match, F.lit(rule_id)))
    return ev.withColumn("rule_id", F.explode(F.array_compact(F.array(*matches))))


def route_events_by(ev: DataFrame, rules: DataFrame) -> DataFrame:
    """``route_events`` with rules from a table (rule_id, event_name, pattern), however many.

    Rules meet the different pairs of event and tool name, not the events: patterns are
    tried once per pair and the rules of a pair become an index that the events look
    up. The plan has one size for all tables; no hint, since a small index is broadcast
    once its size is known.
    """
    pairs = ev.select("event_name", "tool_name").distinct()
    fits = (F.col("pattern") == "*") | F.coalesce(F.regexp_like("tool_name", F.col("pattern")), F.lit(False))
    index = pairs.join(rules, "event_name").filter(fits).groupBy("event_name", "tool_name").agg(
        F.array_sort(F.collect_list("rule_id")).alias("__rules")
    ).withColumnsRenamed({"event_name": "__event", "tool_name": "__tool"})
    alike = (F.col("event_name") == F.col("__event")) & F.col("tool_name").eqNullSafe(F.col("__tool"))
    return ev.join(index, alike).select(*ev.columns, F.explode("__rules").alias("rule_id"))
