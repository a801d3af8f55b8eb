"""Silver events derived from the ``events`` test table, by expressions only."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trailspark.schema import (
    EDIT_TOOLS, FILE_TOOLS, POST_TOOL, PRE_COMPACT, PRE_TOOL, PROMPT, SESSION_END, SESSION_START,
    SILVER_COLUMNS, STOP, SUBAGENT_STOP, TASK, TYPED_COLUMNS, WORKSPACE_KEY,
)

TOOLS = (TASK, TASK, TASK, "Bash", "Read", "Write", "Edit", "MultiEdit", "Grep", "WebFetch")
AGENTS = ("pr-creator", "code-reviewer", "test-validator", "security-reviewer", "doc-generator", None)
SOURCES = ("startup", "resume", "clear")


def _pick(values, index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index)


def _text(prefix: str, *parts) -> Column:
    return F.concat(F.lit(prefix), *parts)


def silver_from_events(events: DataFrame) -> DataFrame:
    kind, user = F.col("event_type"), F.col("user_id")
    k, j = F.col("k"), F.col("j")
    tool = F.col("tool_name")
    is_task = tool == TASK
    event_name = (
        F.when(kind == "signup", F.when(k < 50, SESSION_START).otherwise(PROMPT))
        .when(kind == "view", PRE_TOOL)
        .when(kind == "click", POST_TOOL)
        .when(kind == "purchase", F.when(k < 50, PRE_TOOL).otherwise(POST_TOOL))
        .otherwise(_pick((SESSION_END, PRE_COMPACT, SUBAGENT_STOP, STOP), F.least(j, F.lit(3))))
    )
    is_pre, is_post = F.col("event_name") == PRE_TOOL, F.col("event_name") == POST_TOOL
    base = (
        # A generator parses the text once per row: filters on the columns built
        # from it stay above, where a plain expression would be copied into them.
        events.select("*", F.json_tuple("props", "k").alias("k"))
        .withColumn("k", k.cast("int"))
        .withColumn("j", F.floor(k / 10).cast("int"))
        .withColumn("event_name", event_name)
        .withColumn("tool_name", F.when(is_pre | is_post, _pick(TOOLS, k % 10)))
    )
    part = F.floor((F.dayofmonth("ts") - 1) / 10).cast("int")
    silver = base.select(
        "event_id", "ts", "event_name",
        _text("s", user, F.lit("-"), part).alias("session_id"),
        "tool_name",
        F.when(F.col("event_name") == SESSION_START, _pick(SOURCES, k % 3)).alias("source"),
        _text("/home/u", user, F.lit("/proj"), k % 4).alias("cwd"),
        F.when(user % 7 == 0, F.lit(None)).when(user % 7 == 1, F.lit(""))
        .otherwise(_text("w", user % 20)).alias("workspace"),
        F.lit("default").alias("permission_mode"),
        F.when(tool == "Bash", _text("cmd ", j)).alias("command"),
        F.when(tool.isin(*FILE_TOOLS), _text("/src/f", j, F.lit(".py"))).alias("file_path"),
        F.when(tool == "Grep", _text("pat", j)).alias("pattern"),
        F.when(tool == "WebFetch", _text("http://x/", j)).alias("url"),
        F.lit(None).cast("string").alias("query"),
        F.when(is_task, _text("task ", k)).alias("description"),
        F.when(tool.isin(*EDIT_TOOLS), F.repeat(F.lit("a"), k % 7 + 1)).alias("old_string"),
        F.when(tool.isin(*EDIT_TOOLS), F.repeat(F.lit("b"), k % 11 + 1)).alias("new_string"),
        F.when(is_task, _pick(AGENTS, j % 6)).alias("subagent_type"),
        F.when(is_task & is_pre, _text("run ", k)).alias("prompt"),
        F.when(is_task & is_post, _text("done ", k)).alias("response_text"),
        F.when(is_task & is_post, F.floor(F.col("value") * 100).cast("double")).alias("duration_ms"),
        F.when(is_task & is_post, F.floor(F.col("value") * 10)).alias("total_tokens"),
    )
    return silver.withColumn("data", payload_json()).select(*SILVER_COLUMNS)


def payload_json() -> Column:
    """The silver columns nested back into a payload; null fields are left out."""
    tool_input = F.struct(
        "command", "file_path", "pattern", "url", "query", "description",
        "old_string", "new_string", "subagent_type", "prompt",
    )
    response = F.struct(
        F.array(F.struct(F.col("response_text").alias("text"))).alias("content"),
        F.col("duration_ms").alias("totalDurationMs"),
        F.col("total_tokens").alias("totalTokens"),
    )
    return F.to_json(
        F.struct(
            "session_id", "tool_name", "source", "cwd",
            F.col("workspace").alias(WORKSPACE_KEY), "permission_mode",
            F.when(F.col("tool_name").isNotNull(), tool_input).alias("tool_input"),
            F.when(F.col("response_text").isNotNull(), response).alias("tool_response"),
        )
    )


def raw_from_silver(silver: DataFrame) -> DataFrame:
    """Raw envelope rows (RAW_SCHEMA) of silver events."""
    return silver.select(
        "event_id",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"),
        "event_name",
        F.lit("").alias("tool_arg"),
        F.lit("*").alias("matcher"),
        "data",
    )


def load_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def load_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver_from_events(load_events(spark, sf_dir))


def load_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_silver(spark, sf_dir).select(*TYPED_COLUMNS)
