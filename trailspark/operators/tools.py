"""Tool operators: usage, call pairing, edits, time series and text search."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from trailspark.functions.ordered import with_rank
from trailspark.operators.pairing import pair_kth
from trailspark.operators.sessions import of_session
from trailspark.schema import EDIT_TOOLS, POST_TOOL, PRE_TOOL

# Characters shown before a hit and in the whole excerpt.
LEAD_IN = 20
EXCERPT = 80


def tool_usage(ev: DataFrame) -> DataFrame:
    calls = ev.filter(F.col("event_name") == PRE_TOOL)
    used = calls.groupBy(F.col("tool_name").alias("tool")).agg(
        F.count(F.lit(1)).alias("usage_count")
    )
    return used.orderBy(F.col("usage_count").desc(), "tool")


def pair_tool_calls(ev: DataFrame, session_id: str | None = None) -> DataFrame:
    """k-th start joined to k-th end per (session, tool), for every tool."""
    calls = of_session(ev, session_id).filter(F.col("event_name").isin(PRE_TOOL, POST_TOOL))
    calls = calls.withColumn("tool_name", F.coalesce("tool_name", F.lit("Unknown")))
    paired = pair_kth(calls, ["session_id", "tool_name"], first_of=("command", "file_path"))
    return paired.select(
        "session_id", "tool_name", "call_no", "start_time", "end_time", "duration_seconds",
        "command", "file_path",
    )


def edit_changes(ev: DataFrame) -> DataFrame:
    """Size change of each finished edit and the running number of edits to its file."""
    edits = of_session(ev, None).filter(
        (F.col("event_name") == POST_TOOL) & F.col("tool_name").isin(*EDIT_TOOLS) & F.col("file_path").isNotNull()
    ).select(
        "session_id", "ts", "event_id", "file_path",
        F.length("old_string").cast("bigint").alias("old_len"),
        F.length("new_string").cast("bigint").alias("new_len"),
    )
    counted = with_rank(edits, ["session_id", "file_path"], "edits_to_file")
    return counted.select(
        "session_id", "ts", "file_path", "old_len", "new_len",
        (F.col("new_len") - F.col("old_len")).alias("delta_chars"),
        "edits_to_file",
    )


def event_timeseries(ev: DataFrame, bucket: str = "1 hour", pivot: Sequence[str] = ()) -> DataFrame:
    """Events per time bucket and name; ``pivot`` lists names to spread into columns."""
    spans = ev.groupBy(F.window("ts", bucket)["start"].alias("bucket_start"), "event_name")
    counts = spans.agg(F.count(F.lit(1)).alias("events"))
    if not pivot:
        return counts
    return counts.groupBy("bucket_start").agg(
        *[
            F.coalesce(F.sum(F.when(F.col("event_name") == name, F.col("events"))), F.lit(0)).alias(name)
            for name in pivot
        ]
    )


def event_texts(ev: DataFrame) -> DataFrame:
    """Prompts and responses as (id, role, ts, text)."""
    texts = F.array(
        F.struct(F.lit("prompt").alias("role"), F.col("prompt").alias("text")),
        F.struct(F.lit("response").alias("role"), F.col("response_text").alias("text")),
    )
    rows = ev.select(F.col("event_id").alias("id"), "ts", F.explode(texts).alias("t"))
    return rows.select("id", "t.role", "ts", "t.text").filter(F.col("text").isNotNull())


def search_terms(terms: Sequence[str]) -> list[str]:
    needles = [term.lower() for term in terms if term]
    if not needles:
        raise ValueError("search needs at least one non-empty term")
    return needles


def search_text(df: DataFrame, terms: Sequence[str], text: str = "text") -> DataFrame:
    """Rows whose text holds a term, whatever the case, with hit count and excerpt.

    Works on any DataFrame; all columns but the text are kept.
    """
    needles = search_terms(terms)
    lowered = F.lower(text)
    hits = sum(
        (
            (F.length(lowered) - F.length(F.replace(lowered, F.lit(needle), F.lit(""))))
            / F.lit(len(needle))
        ).cast("bigint")
        for needle in needles
    )
    places = [F.nullif(F.instr(lowered, needle), F.lit(0)) for needle in needles]
    first = F.least(*places) if len(places) > 1 else places[0]
    start = F.greatest(first - LEAD_IN, F.lit(1))
    found = df.withColumn("hits", hits).filter(F.col("hits") > 0)
    return found.withColumn("snippet", F.substring(F.col(text), start, F.lit(EXCERPT))).drop(text)
