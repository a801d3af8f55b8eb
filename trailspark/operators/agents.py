"""Agent operators: usage, durations, invocations, parallel runs and cost."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from trailspark.functions.ordered import BORDERS, PIECE, before, borders, in_pieces, top_n
from trailspark.functions.quantiles import exact_percentiles
from trailspark.functions.times import (
    as_ntz, interval, interval_micros, micros_between, micros_to_seconds, seconds_between,
)
from trailspark.operators.pairing import pair_kth
from trailspark.operators.sessions import events_since, is_agent_call, newest_first, of_session
from trailspark.schema import AGENT_CATEGORIES, OTHER_CATEGORY, POST_TOOL, PRE_TOOL, TASK

def _agent() -> Column:
    return F.col("subagent_type").alias("agent_type")


def _calls(ev: DataFrame, agent_type: str | None = None) -> DataFrame:
    rows = ev.filter(is_agent_call())
    return rows if agent_type is None else rows.filter(F.col("subagent_type") == agent_type)


def _results(ev: DataFrame, agent_type: str | None = None) -> DataFrame:
    rows = ev.filter(
        (F.col("event_name") == POST_TOOL)
        & (F.col("tool_name") == TASK)
        & F.col("subagent_type").isNotNull()
    )
    return rows if agent_type is None else rows.filter(F.col("subagent_type") == agent_type)


def window_stats(ev: DataFrame, as_of, spans: Sequence[str] = ("7 days", "24 hours")) -> DataFrame:
    """Counts over trailing spans from one scan of the widest span.

    Events are first counted per (workspace, agent) for all spans at once; the
    distinct counts then look at those few combinations, not at the events.
    """
    now = as_ntz(as_of)
    widest = max(spans, key=interval_micros)
    inside = [F.col("ts") >= now - interval(span) for span in spans]
    per_pair = (
        events_since(ev, now - interval(widest))
        .groupBy(
            F.nullif("workspace", F.lit("")).alias("workspace"),
            F.when(is_agent_call(), F.col("subagent_type")).alias("agent"),
        )
        .agg(*[F.count_if(cond).alias(f"n{i}") for i, cond in enumerate(inside)])
    )
    totals = per_pair.agg(
        *[
            agg
            for i in range(len(spans))
            for agg in (
                F.coalesce(F.sum(f"n{i}"), F.lit(0)).alias(f"e{i}"),
                F.count_distinct(F.when(F.col(f"n{i}") > 0, F.col("workspace"))).alias(f"w{i}"),
                F.count_distinct(F.when(F.col(f"n{i}") > 0, F.col("agent"))).alias(f"a{i}"),
            )
        ]
    )
    rows = [
        F.struct(
            F.lit(span).alias("span"),
            F.col(f"e{i}").alias("total_events"),
            F.col(f"w{i}").alias("unique_workspaces"),
            F.col(f"a{i}").alias("unique_agents"),
        )
        for i, span in enumerate(spans)
    ]
    return totals.select(F.inline(F.array(*rows)))


def agent_usage(ev: DataFrame) -> DataFrame:
    used = _calls(ev).groupBy(_agent()).agg(
        F.count(F.lit(1)).alias("usage_count"),
        F.count_distinct("session_id").alias("sessions_used"),
        F.min("ts").alias("first_used"),
        F.max("ts").alias("last_used"),
    )
    return used.orderBy(F.col("usage_count").desc(), "agent_type")


def whole_ms(value: str) -> Column:
    """Half-even rounding to whole milliseconds, stable against float noise."""
    return F.bround(F.round(value, 6), 0).alias(value)


def agent_duration_profile(
    ev: DataFrame, agent_type: str | None = None, exact: bool = True
) -> DataFrame:
    """Duration statistics of finished calls. ``exact=False`` takes sketched percentiles."""
    done = _results(ev, agent_type).select(_agent(), "session_id", "ts", "duration_ms")
    sketch = [] if exact else [
        F.percentile_approx("duration_ms", p).alias(name)
        for name, p in (("median_duration_ms", 0.5), ("p95_duration_ms", 0.95))
    ]
    stats = done.groupBy("agent_type").agg(
        F.count(F.lit(1)).alias("total_invocations"),
        F.count_distinct("session_id").alias("unique_sessions"),
        F.min("ts").alias("first_used"),
        F.max("ts").alias("last_used"),
        F.avg("duration_ms").alias("avg_duration_ms"),
        F.min("duration_ms").alias("min_duration_ms"),
        F.max("duration_ms").alias("max_duration_ms"),
        *sketch,
    )
    if exact:
        points = {"median_duration_ms": 0.5, "p95_duration_ms": 0.95}
        stats = stats.join(
            exact_percentiles(done, ["agent_type"], "duration_ms", points), "agent_type", "left"
        )
    return stats.select(
        "agent_type", "total_invocations", "unique_sessions", "first_used", "last_used",
        *[whole_ms(f"{name}_duration_ms") for name in ("avg", "min", "max", "median", "p95")],
    )


def duration_range_shares(ev: DataFrame) -> DataFrame:
    """Percent of the min-max range below median, p95 and max, and where the mean lies."""
    return range_shares(agent_duration_profile(ev))


def range_shares(profile: DataFrame) -> DataFrame:
    lowest, highest = F.col("min_duration_ms"), F.col("max_duration_ms")
    width = F.nullif(highest - lowest, F.lit(0.0))
    median, p95 = F.col("median_duration_ms"), F.col("p95_duration_ms")
    percent = lambda part: F.round(part / width * 100, 6)
    return profile.select(
        "agent_type",
        (highest - lowest).alias("range_ms"),
        percent(median - lowest).alias("share_0_50"),
        percent(p95 - median).alias("share_50_95"),
        percent(highest - p95).alias("share_95_100"),
        percent(F.col("avg_duration_ms") - lowest).alias("avg_position"),
    )


def agent_recent_invocations(ev: DataFrame, n: int = 50, agent_type: str | None = None) -> DataFrame:
    columns = ("agent_type", "ts", "session_id", "description", "cwd", "workspace")
    rows = _calls(ev, agent_type).select(
        _agent(), "ts", "session_id", "description", "cwd", "workspace", "event_id"
    )
    return top_n(rows, ["agent_type"], newest_first(), n).select(*columns)


def agent_sessions(ev: DataFrame, n: int = 20, agent_type: str | None = None) -> DataFrame:
    """Newest sessions of each agent, with statistics over all their events.

    One scan: the agents of a session are gathered next to its statistics, so
    neither a distinct nor a join back to the events is needed.
    """
    named = is_agent_call()
    if agent_type is not None:
        named = named & (F.col("subagent_type") == agent_type)
    profile = of_session(ev, None).groupBy(
        "session_id", "cwd", "workspace", F.when(named, F.col("subagent_type")).alias("agent")
    ).agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n")
    )
    sessions = profile.groupBy("session_id").agg(
        F.collect_set("agent").alias("agents"),
        F.min("first_ts").alias("session_start"),
        F.max("last_ts").alias("session_end"),
        F.sum("n").alias("total_events"),
        F.max("cwd").alias("cwd"),
        F.max("workspace").alias("workspace"),
    )
    per_agent = sessions.select(
        F.explode("agents").alias("agent_type"), "session_id", "session_start", "session_end",
        "total_events", "cwd", "workspace",
    )
    newest = top_n(per_agent, ["agent_type"], [F.col("session_end").desc(), F.col("session_id")], n)
    return newest.withColumn(
        "duration_seconds", seconds_between(F.col("session_start"), F.col("session_end"))
    )


def _call_events(ev: DataFrame, session_id: str | None = None) -> DataFrame:
    return of_session(ev, session_id).filter(
        (F.col("tool_name") == TASK)
        & F.col("subagent_type").isNotNull()
        & F.col("event_name").isin(PRE_TOOL, POST_TOOL)
    ).withColumn("agent_type", F.col("subagent_type"))


def _agent_calls(ev: DataFrame, session_id: str | None = None) -> DataFrame:
    return pair_kth(
        _call_events(ev, session_id), ["session_id", "agent_type"],
        first_of=("description",), end_only=("total_tokens",),
    )


CALL_COLUMNS = (
    "session_id", "agent_type", "description", "start_time", "end_time", "duration_seconds",
    "total_tokens",
)


def pair_agent_calls(ev: DataFrame, session_id: str | None = None) -> DataFrame:
    return _agent_calls(ev, session_id).select(*CALL_COLUMNS, "call_no", "is_out_of_order")


def _numbered_starts(ev: DataFrame, gap: str, session_id: str | None = None) -> DataFrame:
    """Calls with their piece of the session, and inside it their number and that of their
    island: starts no further apart than ``gap``.

    A call starts when one of its events happened, so borders of the events cut the
    calls as well, and the pairing runs once.
    """
    order = ("start_time", "call_id")
    events = _call_events(ev, session_id).select(
        "session_id", F.col("ts").alias("start_time"), F.col("event_id").alias("call_id")
    )
    cut = borders(events, ["session_id"], order)
    calls = in_pieces(_agent_calls(ev, session_id), ["session_id"], order, cut)
    calls = calls.withColumn("__cut", F.col(BORDERS).isNotNull()).drop(BORDERS)
    inside = Window.partitionBy("session_id", PIECE).orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    silence = micros_between(F.lag("start_time").over(inside), F.col("start_time"))
    return calls.withColumns(
        {"__rank": F.row_number().over(inside), "__new": F.when(silence <= interval_micros(gap), 0).otherwise(1)}
    ).withColumn("__island", F.sum("__new").over(so_far)).drop("__new")


def _pieces(starts: DataFrame, whole: bool) -> DataFrame:
    """One row per piece: its calls and islands, its first and last start, and the sizes of
    the first and the last island, which may go on in the pieces beside it.

    With ``whole`` all columns of the calls are looked at, so that Spark finds the exchange
    of the calls themselves below and does it once.
    """
    seen = F.bit_xor(F.xxhash64(*[c for c in starts.columns if c not in ("__rank", "__island")])) if whole else F.lit(0)
    islands = starts.groupBy("session_id", PIECE, "__island").agg(
        F.count(F.lit(1)).alias("n"), F.min("start_time").alias("first"), F.max("start_time").alias("last"),
        F.sum("duration_micros").alias("micros"), F.count("duration_micros").alias("timed"),
        F.max("__cut").alias("cut"), seen.alias("seen"),
    )
    return islands.groupBy("session_id", PIECE).agg(
        F.sum("n").alias("n"), F.max("__island").alias("islands"),
        F.min("first").alias("first"), F.max("last").alias("last"),
        F.max(F.when(F.col("__island") == 1, F.col("n"))).alias("left"), F.max_by("n", "__island").alias("right"),
        F.count_if(F.col("n") > 1).alias("parallel"), F.sum("micros").alias("micros"), F.sum("timed").alias("timed"),
        F.max("cut").alias("cut"), F.bit_xor("seen").alias("seen"),
    )


def _joined(pieces: DataFrame, gap: str) -> DataFrame:
    """Pieces with what they inherit: ``groups`` and ``calls`` before them, and for their first
    and last island the size over all pieces, the calls before it, and whether it starts here."""
    order = Window.partitionBy("session_id").orderBy(PIECE)
    silence = micros_between(F.lag("last").over(order), F.col("first"))
    goes_on = F.when(silence <= interval_micros(gap), 1).otherwise(0)
    numbered = pieces.withColumn("goes_on", goes_on).withColumns(
        {
            "groups": F.coalesce(F.sum("islands").over(order.rowsBetween(*before)), F.lit(0))
            - F.sum("goes_on").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
            "calls": F.coalesce(F.sum("n").over(order.rowsBetween(*before)), F.lit(0)),
        }
    )
    edge = lambda side, island, size, start: F.struct(
        F.lit(side).alias("__side"), (F.col("groups") + island).alias("__group"), size.alias("__size"), start.alias("__start")
    )
    left = edge("left", F.lit(1), F.col("left"), F.col("calls"))
    right = edge("right", F.col("islands"), F.col("right"), F.col("calls") + F.col("n") - F.col("right"))
    edges = numbered.select("*", F.inline(F.when(F.col("islands") > 1, F.array(left, right)).otherwise(F.array(left))))
    group = Window.partitionBy("session_id", "__group")
    edges = edges.withColumns(
        {"size": F.sum("__size").over(group), "start": F.min("__start").over(group)}
    )
    of = lambda side, value: F.max(F.when(F.col("__side") == side, value))
    here = F.col("__start") == F.col("start")
    return edges.groupBy("session_id", PIECE).agg(
        *[F.max(c).alias(c) for c in ("groups", "calls", "n", "islands", "left", "right", "parallel", "micros", "timed", "cut", "seen")],
        of("left", F.col("size")).alias("left_size"), of("right", F.col("size")).alias("right_size"),
        of("left", F.col("start")).alias("left_start"),
        F.count_if(here & (F.col("size") > 1)).alias("parallel_edges"),
    )


def parallel_groups(ev: DataFrame, gap: str = "1 second", session_id: str | None = None) -> DataFrame:
    """Gaps and islands: a call that starts at most ``gap`` after the one before
    it belongs to the same parallel group.

    Islands are found inside pieces of a session. Pieces are then one row each, and what
    their first and last islands have in common with the pieces beside them is joined
    back to the calls of sessions that are cut; a session's window sees pieces, not calls.
    """
    starts = _numbered_starts(ev, gap, session_id)
    carried = _joined(_pieces(starts, whole=True).filter(F.col("cut") & F.col("seen").isNotNull()), gap).select(
        "session_id", PIECE, "groups", "calls", "islands", "left_size", "right_size", "left_start"
    )
    island = Window.partitionBy("session_id", PIECE, "__island")
    placed = starts.withColumns(
        {"__size": F.count(F.lit(1)).over(island), "__first": F.min("__rank").over(island)}
    ).join(F.broadcast(carried), ["session_id", PIECE], "left")
    before_piece = F.coalesce("calls", F.lit(0))
    opens = F.col("__island") == 1
    group_before = F.when(opens & F.col("calls").isNotNull(), F.col("left_start")).otherwise(before_piece + F.col("__first") - 1)
    size = (
        F.when(F.col("calls").isNull(), F.col("__size")).when(opens, F.col("left_size"))
        .when(F.col("__island") == F.col("islands"), F.col("right_size")).otherwise(F.col("__size"))
    )
    placed = placed.withColumns(
        {
            "execution_order": (before_piece + F.col("__rank")).cast("bigint"),
            "group_id": (F.col("__island") + F.coalesce("groups", F.lit(0))).cast("bigint"),
            "group_size": size,
        }
    )
    return placed.select(
        *CALL_COLUMNS,
        "execution_order", "group_id", "group_size",
        (F.col("execution_order") - group_before).alias("position_in_group"),
        (F.col("group_size") > 1).alias("is_parallel"),
    )


def session_agent_summary(ev: DataFrame, gap: str = "1 second") -> DataFrame:
    """Agent summary per session; calls are summed, and parallel groups counted, on pieces."""
    seen = of_session(ev, None).filter(
        (F.col("tool_name") == TASK) & F.col("subagent_type").isNotNull()
    ).groupBy("session_id", "subagent_type").agg(
        F.max(F.when(F.col("event_name") == PRE_TOOL, 1).otherwise(0)).cast("bigint").alias("pre"),
        F.max(F.when(F.col("event_name") == POST_TOOL, 1).otherwise(0)).cast("bigint").alias("post"),
    )
    agents = seen.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("unique_agents"),
        F.sum(F.col("pre") + F.col("post")).alias("distinct_agent_events"),
    )
    # Islands inside a piece count there, those at its edges where they start.
    inner = (
        F.col("parallel") - F.when(F.col("left") > 1, 1).otherwise(0)
        - F.when((F.col("islands") > 1) & (F.col("right") > 1), 1).otherwise(0)
    )
    timing = _joined(_pieces(_numbered_starts(ev, gap), whole=False), gap).groupBy("session_id").agg(
        F.sum("n").alias("total_invocations"),
        (micros_to_seconds(F.sum("micros")) / F.nullif(F.sum("timed"), F.lit(0)))
        .alias("avg_duration_seconds"),
        F.sum(inner + F.col("parallel_edges")).alias("parallel_groups"),
    )
    joined = agents.join(timing, "session_id", "left")
    return joined.select(
        "session_id", "unique_agents", "distinct_agent_events",
        F.coalesce("total_invocations", F.lit(0)).alias("total_invocations"),
        "avg_duration_seconds",
        F.coalesce("parallel_groups", F.lit(0)).alias("parallel_groups"),
    )


def summary(ev: DataFrame, approximate: bool = False) -> DataFrame:
    per_pair = ev.groupBy("session_id", "subagent_type").agg(F.count(F.lit(1)).alias("n"))
    return summed(per_pair, approximate)


def summed(per_pair: DataFrame, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    return per_pair.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_events"),
        count("session_id").alias("unique_sessions"),
        count("subagent_type").alias("unique_agents"),
    )


def agent_performance(ev: DataFrame) -> DataFrame:
    done = _results(ev).groupBy(_agent()).agg(
        F.count(F.lit(1)).alias("invocations"),
        F.round(F.avg("duration_ms"), 3).alias("avg_duration_ms"),
        F.sum("total_tokens").alias("total_tokens"),
        F.round(F.avg("total_tokens"), 3).alias("avg_tokens"),
    )
    return done.orderBy(F.col("invocations").desc(), "agent_type")


def token_cost(ev: DataFrame, prices: DataFrame) -> DataFrame:
    """Tokens and cost per session and agent; agents without a price cost null.

    The events are summed first; the price join is left to the optimizer, which
    broadcasts the table only where its measured size allows.
    """
    used = _results(ev).filter(F.col("total_tokens").isNotNull()).groupBy("session_id", _agent()).agg(
        F.sum("total_tokens").alias("total_tokens")
    )
    cost = F.round(F.col("total_tokens") * F.col("usd_per_1k_tokens") / 1000, 6)
    return used.join(prices, "agent_type", "left").select(
        "session_id", "agent_type", "total_tokens", cost.alias("cost")
    )


def _uses_per_agent(ev: DataFrame) -> DataFrame:
    return _calls(ev).groupBy(_agent()).agg(F.count(F.lit(1)).alias("n"))


def agent_category_usage(ev: DataFrame) -> DataFrame:
    """Usage per category; the first rule with a substring in the name wins."""
    category = None
    for name, parts in AGENT_CATEGORIES:
        hit = F.lit(False)
        for part in parts:
            hit = hit | F.col("agent_type").contains(part)
        category = F.when(hit, name) if category is None else category.when(hit, name)
    uses = _uses_per_agent(ev).groupBy(category.otherwise(OTHER_CATEGORY).alias("category"))
    return uses.agg(F.sum("n").alias("usage_count"), F.count(F.lit(1)).alias("agents")).orderBy(
        F.col("usage_count").desc(), "category"
    )


def agent_alias_usage(ev: DataFrame, aliases: DataFrame) -> DataFrame:
    """Usage per short name: the alias, else the text before the first dash."""
    named = _uses_per_agent(ev).join(aliases, "agent_type", "left")
    short = F.coalesce("short_name", F.split_part("agent_type", F.lit("-"), F.lit(1)))
    return named.groupBy(short.alias("short_name")).agg(F.sum("n").alias("usage_count")).orderBy(
        F.col("usage_count").desc(), "short_name"
    )


def project_usage(ev: DataFrame) -> DataFrame:
    """Activity per project, the last two parts of the working directory."""
    parts = F.split("cwd", "/")
    tail = F.when(F.size(parts) > 2, F.slice(parts, -2, 2)).otherwise(parts)
    per_session = ev.filter(F.col("cwd").isNotNull()).groupBy("cwd", "session_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts")
    )
    return per_session.groupBy(F.array_join(tail, "/").alias("project")).agg(
        F.count_distinct("session_id").alias("sessions"),
        F.sum("n").alias("events"),
        F.max("last_ts").alias("last_event"),
    )
