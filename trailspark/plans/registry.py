"""Every operator as a query over the given tables: ``(spark, sf_dir) -> DataFrame``."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from trailspark.functions.ordered import newest_page
from trailspark.operators import activity, agents, sessions, tools, workspaces
from trailspark.plans import parameters as P
from trailspark.plans.fixture_view import load_silver, load_typed
from trailspark.plans.io_queries import IO
from trailspark.schema import AGENT_ALIASES, TYPED_COLUMNS
from trailspark.session import pin_session

Query = Callable[[SparkSession, str], DataFrame]


def _over_events(operator: Callable[..., DataFrame], *args, joined=(), **kwargs) -> Query:
    """Run an operator over the fixture view; list columns become text."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = operator(load_typed(pin_session(spark), sf_dir), *args, **kwargs)
        return out.withColumns({name: F.array_join(name, ",") for name in joined})

    return run


def _literals(spark: SparkSession, rows, *columns: str) -> DataFrame:
    """A small table as part of the plan, so the optimizer knows its size."""
    structs = [F.struct(*[F.lit(v).alias(c) for v, c in zip(row, columns)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def _with_table(operator, rows, *columns: str) -> Query:
    """Run an operator over the fixture view and a small table of literals."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return operator(load_typed(pin_session(spark), sf_dir), _literals(spark, rows, *columns))

    return run


def _timeline(spark, sf_dir):
    rows = sessions.session_timeline(load_silver(pin_session(spark), sf_dir), parsed=True)
    return rows.select(*TYPED_COLUMNS)


def _search(table, columns):
    def run(spark, sf_dir):
        texts = pin_session(spark).read.parquet(f"{sf_dir}/{table}.parquet").select(*columns, "text")
        return tools.search_text(texts, P.SEARCH_TERMS)

    return run


def _search_events(spark, sf_dir):
    return tools.search_text(tools.event_texts(load_typed(pin_session(spark), sf_dir)), P.EVENT_TERMS)


BATCH: dict[str, Query] = {
    "latest_session": _over_events(sessions.latest_session),
    "session_lifecycle": _over_events(sessions.session_lifecycle),
    "session_tool_stats": _over_events(sessions.session_tool_stats),
    "recent_timeline": _over_events(sessions.recent_timeline),
    "file_operations": _over_events(sessions.file_operations),
    "session_rollup": _over_events(
        sessions.session_rollup, P.AS_OF, P.SESSION_ACTIVE, joined=("agents_used",)
    ),
    "session_agent_list": _over_events(sessions.session_agent_list, joined=("agents_list",)),
    "active_sessions": _over_events(
        sessions.active_sessions, P.AS_OF, P.OPEN_WITHIN, joined=("agents_used",)
    ),
    "session_timeline": _timeline,
    "session_context": _over_events(sessions.session_context),
    "recent_events": _over_events(sessions.recent_events, limit=100, offset=50),
    "events_page": _over_events(lambda ev: newest_page(ev, ("ts", "event_id"), sessions.newest_first(), 400, 100)),
    "recent_sessions": _over_events(sessions.recent_sessions, limit=20, offset=10),
    "events_between": _over_events(sessions.events_between, *P.RANGE),
    "session_replay": _over_events(sessions.session_replay),
    "tool_usage": _over_events(tools.tool_usage),
    "pair_tool_calls": _over_events(tools.pair_tool_calls),
    "edit_changes": _over_events(tools.edit_changes),
    "event_timeseries": _over_events(tools.event_timeseries),
    "search_text": _search("conversations", ("conv_id", "turn", "role")),
    "search_documents": _search("documents", ("doc_id", "lang", "source")),
    "search_event_texts": _search_events,
    "window_stats": _over_events(agents.window_stats, P.AS_OF),
    "agent_usage": _over_events(agents.agent_usage),
    "agent_duration_profile": _over_events(agents.agent_duration_profile),
    "duration_range_shares": _over_events(agents.duration_range_shares),
    "agent_recent_invocations": _over_events(agents.agent_recent_invocations),
    "agent_sessions": _over_events(agents.agent_sessions),
    "pair_agent_calls": _over_events(agents.pair_agent_calls),
    "parallel_groups": _over_events(agents.parallel_groups, P.PARALLEL_GAP),
    "session_agent_summary": _over_events(agents.session_agent_summary, P.PARALLEL_GAP),
    "summary": _over_events(agents.summary),
    "agent_performance": _over_events(agents.agent_performance),
    "token_cost": _with_table(agents.token_cost, P.PRICES, "agent_type", "usd_per_1k_tokens"),
    "agent_category_usage": _over_events(agents.agent_category_usage),
    "agent_alias_usage": _with_table(
        agents.agent_alias_usage, AGENT_ALIASES, "agent_type", "short_name"
    ),
    "project_usage": _over_events(agents.project_usage),
    "workspace_rollup": _over_events(
        workspaces.workspace_rollup, P.AS_OF, P.WORKSPACE_ACTIVE, P.WORKSPACE_RECENT
    ),
    "workspace_session_ids": _over_events(workspaces.workspace_session_ids),
    "workspace_avg_session": _over_events(workspaces.workspace_avg_session),
    "workspace_sessions": _over_events(workspaces.workspace_sessions),
    "activity_states": _over_events(activity.activity_states, P.IDLE_S, P.WAITING_S),
    "significant_gaps": _over_events(
        activity.significant_gaps, P.SIGNIFICANT_S, severity_s=P.SEVERITY_S
    ),
    "gap_histogram": _over_events(activity.gap_histogram, P.BUCKETS_S),
    "work_wait_split": _over_events(activity.work_wait_split),
    "wait_profile": _over_events(activity.wait_profile, P.WAIT_BOUNDS_S),
    "workspace_activity": _over_events(activity.workspace_activity, P.WAIT_BOUNDS_S),
    "session_activity_share": _over_events(activity.session_activity_share),
}


def queries() -> dict[str, Query]:
    return {**BATCH, **IO}


def entry(spark: SparkSession) -> DataFrame:
    return BATCH["session_rollup"](spark, "/root/testdata/sf0.001")
