"""Known totals of the fixture view and of the operators over it."""

import pytest
from pyspark.sql import functions as F

from fixtures import SF_MIDDLE, SF_SMALL
from trailspark.operators import activity, agents, sessions, workspaces
from trailspark.plans import parameters as P
from trailspark.plans.fixture_view import load_silver, load_typed
from trailspark.sources.events import to_silver

SCALES = [SF_SMALL, SF_MIDDLE]


def counts(df, column):
    return {row[0]: row[1] for row in df.groupBy(column).count().collect()}


@pytest.mark.parametrize(
    "sf,expected",
    list(zip(
        SCALES,
        [
            {"SessionStart": 103, "UserPromptSubmit": 96, "PreToolUse": 292, "PostToolUse": 308,
             "SessionEnd": 16, "PreCompact": 20, "SubagentStop": 18, "Stop": 147},
            {"SessionStart": 1010, "UserPromptSubmit": 1007, "PreToolUse": 2966,
             "PostToolUse": 3003, "SessionEnd": 205, "PreCompact": 189, "SubagentStop": 185,
             "Stop": 1435},
        ],
    )),
)
def test_event_names(spark, sf, expected):
    assert counts(load_typed(spark, sf), "event_name") == expected


@pytest.mark.parametrize("sf,tasks,timed,tokens", [(SF_SMALL, 169, 109, 59379), (SF_MIDDLE, 1580, 921, 434690)])
def test_tasks(spark, sf, tasks, timed, tokens):
    row = load_typed(spark, sf).agg(
        F.count_if(F.col("subagent_type").isNotNull()),
        F.count("duration_ms"),
        F.sum("total_tokens"),
    ).first()
    assert tuple(row) == (tasks, timed, tokens)


def test_rollup_status(spark):
    for sf, expected in zip(
        SCALES, [{"completed": 11, "active": 9, "inactive": 25},
                 {"completed": 170, "active": 69, "inactive": 211}]
    ):
        rolled = sessions.session_rollup(load_typed(spark, sf), P.AS_OF, P.SESSION_ACTIVE)
        assert counts(rolled, "status") == expected


def test_window_stats(spark):
    rows = {r.span: r.total_events for r in agents.window_stats(load_typed(spark, SF_MIDDLE), P.AS_OF).collect()}
    assert rows == {"7 days": 2331, "24 hours": 329}


def test_open_sessions_before_the_limit(spark):
    for sf, expected in zip(SCALES, (12, 82)):
        open_now = sessions.active_sessions(load_typed(spark, sf), P.AS_OF, P.OPEN_WITHIN, n=10_000)
        assert open_now.count() == expected


def test_workspace_status(spark):
    for sf, expected in zip(
        SCALES, [{"active": 1, "recent": 8, "inactive": 1}, {"active": 6, "recent": 14}]
    ):
        rolled = workspaces.workspace_rollup(
            load_typed(spark, sf), P.AS_OF, P.WORKSPACE_ACTIVE, P.WORKSPACE_RECENT
        )
        assert counts(rolled, "status") == expected


def test_activity_states(spark):
    for sf, expected in zip(
        SCALES,
        [{"active": 81, "idle": 263, "waiting": 283, "session_end": 30},
         {"active": 842, "idle": 2912, "waiting": 3024, "session_end": 318}],
    ):
        states = activity.activity_states(load_typed(spark, sf), P.IDLE_S, P.WAITING_S, n=1_000_000)
        assert counts(states, "activity_state") == expected


def test_work_wait_sessions(spark):
    for sf, expected in zip(SCALES, (28, 302)):
        assert activity.work_wait_split(load_typed(spark, sf)).count() == expected


def test_significant_gaps(spark):
    for sf, expected in zip(SCALES, (123, 1319)):
        gaps = activity.significant_gaps(load_typed(spark, sf), P.SIGNIFICANT_S, n=1_000_000)
        assert gaps.count() == expected


def test_pairs(spark):
    for sf, expected in zip(SCALES, ((16, 59, 78, 5), (219, 563, 579, 113))):
        pairs = agents.pair_agent_calls(load_typed(spark, sf))
        both, ends_only = F.col("duration_seconds").isNotNull(), F.col("start_time") == F.col("end_time")
        row = pairs.agg(
            F.count_if(both), F.count_if(F.col("end_time").isNull()),
            F.count_if(~both & ends_only), F.count_if(F.col("is_out_of_order")),
        ).first()
        assert tuple(row) == expected


def test_gap_histogram(spark):
    for sf, expected in zip(SCALES, ((43, 38, 423, 123, 0), (348, 494, 4617, 1319, 0))):
        rows = activity.gap_histogram(load_typed(spark, sf), P.BUCKETS_S).groupBy("bucket").agg(
            F.sum("gaps")
        ).collect()
        found = {r[0]: r[1] for r in rows}
        assert tuple(found.get(label, 0) for label in activity.GAP_BUCKETS) == expected


def test_file_operations(spark):
    for sf, expected in zip(SCALES, (215, 2360)):
        assert sessions.file_operations(load_typed(spark, sf), n=10_000).count() == expected


def test_invariants(spark):
    ev = load_typed(spark, SF_MIDDLE).cache()
    rolled = sessions.session_rollup(ev, P.AS_OF)
    assert rolled.agg(F.sum("total_events")).first()[0] == ev.filter("session_id is not null").count()

    sides = ev.filter("tool_name = 'Task' and subagent_type is not null").groupBy(
        "session_id", "subagent_type"
    ).agg(
        F.greatest(
            F.count_if(F.col("event_name") == "PreToolUse"),
            F.count_if(F.col("event_name") == "PostToolUse"),
        ).alias("n")
    )
    assert agents.pair_agent_calls(ev).count() == sides.agg(F.sum("n")).first()[0]

    groups = agents.parallel_groups(ev, P.PARALLEL_GAP)
    off = groups.groupBy("session_id", "group_id").agg(
        F.array_sort(F.collect_list("position_in_group")).alias("p"), F.max("group_size").alias("n")
    ).filter(F.col("p") != F.sequence(F.lit(1), F.col("n")))
    assert off.count() == 0

    states = activity.activity_states(ev, n=1_000_000)
    spans = workspaces.workspace_sessions(ev)
    total = states.agg(F.round(F.sum("gap_seconds"), 3)).first()[0]
    assert total == spans.agg(F.round(F.sum("duration_seconds"), 3)).first()[0]

    shares = activity.workspace_activity(ev).filter("active_percentage is not null")
    assert shares.filter(F.abs(F.col("active_percentage") + F.col("waiting_percentage") - 100) > 1e-9).count() == 0


def test_payload_round_trip(spark):
    """Reading the rebuilt JSON gives the silver columns back."""
    silver = load_silver(spark, SF_SMALL)
    again = to_silver(silver.select("event_id", "ts", "event_name", "data"))
    assert silver.exceptAll(again).count() == 0
