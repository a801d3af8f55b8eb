"""Hand-written rows for default thresholds, ties, orphans, nulls and rounding."""

import random

import pytest
from pyspark.sql import functions as F

from fixtures import T0, at, task
from trailspark.functions import ordered
from trailspark.operators import activity, agents, sessions, tools, workspaces
from trailspark.schema import SILVER_SCHEMA


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def work(name, second, **more):
    return {"event_name": name, "at": second, "workspace": "w", **more}


def test_ties_follow_the_event_id(events):
    ev = events(*[{"at": 0, "event_id": i, "workspace": "w", "tool_name": f"t{i}"} for i in (3, 0, 5, 1, 4, 2)])
    newest = sessions.recent_timeline(ev, n=2)
    assert {r.tool_name for r in newest.collect()} == {"t5", "t4"}
    steps = sessions.session_replay(ev).orderBy("step")
    assert rows(steps, "step", "tool_name") == [(i + 1, f"t{i}") for i in range(6)]
    states = activity.activity_states(ev).groupBy("activity_state").count()
    assert dict(rows(states, "activity_state", "count")) == {"active": 5, "session_end": 1}


def test_default_gap_thresholds(events):
    gaps = [1, 2, 5, 5.5, 30, 31, 60, 61, 300, 301, 1800]
    moments = [sum(gaps[:i]) for i in range(len(gaps) + 1)]
    ev = events(*[work("Stop", m, tool_name=f"t{i}") for i, m in enumerate(moments)])
    states = activity.activity_states(ev).orderBy("ts")
    assert [r.activity_state for r in states.collect()] == (
        ["active"] * 3 + ["idle"] * 2 + ["waiting"] * 6 + ["session_end"]
    )
    long = activity.significant_gaps(ev).orderBy(F.col("gap_seconds").desc())
    assert rows(long, "gap_seconds", "severity", "last_tool", "next_tool") == [
        (1800.0, "major", "t10", "t11"), (301.0, "moderate", "t9", "t10"),
        (300.0, "moderate", "t8", "t9"), (61.0, "minor", "t7", "t8"),
    ]
    histogram = dict(rows(activity.gap_histogram(ev), "bucket", "gaps"))
    assert histogram == {"active": 2, "idle": 1, "short_wait": 4, "medium_wait": 2, "long_wait": 2}


def test_limits_cut_after_the_gap_is_known(events):
    ev = events(*[work("Stop", s) for s in (0, 100, 150)])
    first = activity.activity_states(ev, n=2).orderBy("ts")
    assert rows(first, "gap_seconds") == [(100.0,), (50.0,)]
    assert rows(activity.significant_gaps(ev, n=1), "gap_seconds") == [(100.0,)]


def test_two_workspaces_of_one_session(events):
    ev = events(
        work("UserPromptSubmit", 0), work("Stop", 10),
        {"event_name": "UserPromptSubmit", "at": 20, "workspace": "x"},
        {"event_name": "UserPromptSubmit", "at": 30, "workspace": "x"},
    )
    assert rows(activity.work_wait_split(ev), "workspace", "working_time_seconds") == [("w", 10.0)]
    per_workspace = activity.activity_states(ev).filter("next_ts is null")
    assert per_workspace.count() == 2


def test_only_direct_neighbours_count(events):
    ev = events(
        work("SessionStart", 0), work("UserPromptSubmit", 10), work("PreToolUse", 12),
        work("Stop", 20), work("UserPromptSubmit", 50), work("UserPromptSubmit", 60), work("Stop", 100),
    )
    split = activity.work_wait_split(ev).first()
    assert (split.working_time_seconds, split.waiting_time_seconds) == (50.0, 30.0)
    assert (split.stop_count, split.prompt_count) == (2, 3)
    assert split.active_percentage == 62.5
    profile = activity.wait_profile(ev).first()
    assert (profile.short_waits, profile.medium_waits, profile.long_waits) == (1, 0, 0)
    assert (profile.active_periods, profile.longest_gap_seconds, profile.avg_gap_seconds) == (2, 30.0, 15.0)


def test_zero_and_missing_shares(events):
    ev = events(
        work("Stop", 0, session_id="waits"), work("UserPromptSubmit", 90, session_id="waits"),
        work("UserPromptSubmit", 0, session_id="no-stop"), work("Stop", 0, session_id="lone"),
    )
    shares = {r.session_id: (r.active_percentage, r.has_accurate_data) for r in activity.session_activity_share(ev).collect()}
    assert shares == {"waits": (0.0, True), "no-stop": (None, False), "lone": (0.0, True)}
    total = activity.workspace_activity(ev).first()
    assert (total.active_percentage, total.waiting_percentage, total.medium_waits) == (0.0, 100.0, 1)
    assert total.sessions == 2


def test_no_time_at_all_has_no_shares(events):
    total = activity.workspace_activity(events(work("Stop", 0))).first()
    assert total.active_percentage is None and total.waiting_percentage is None


def test_parallel_groups_at_one_second(events):
    ev = events(*[task("Pre", f"a{i}", at=s) for i, s in enumerate((0.0, 0.9, 1.9, 3.0))])
    groups = agents.parallel_groups(ev).orderBy("execution_order")
    assert rows(groups, "execution_order", "group_id", "group_size", "position_in_group", "is_parallel") == [
        (1, 1, 3, 1, True), (2, 1, 3, 2, True), (3, 1, 3, 3, True), (4, 2, 1, 1, False)
    ]


def test_orphans_and_order(events):
    ev = events(
        task("Post", "late", at=0), task("Pre", "late", at=5), task("Pre", "open", at=6),
        task("Post", "done", at=7, total_tokens=9), task("Pre", "zero", at=8), task("Post", "zero", at=8),
    )
    calls = {r.agent_type: r for r in agents.pair_agent_calls(ev).collect()}
    assert calls["late"].duration_seconds == -5.0 and calls["late"].is_out_of_order
    assert calls["open"].end_time is None and calls["open"].duration_seconds is None
    assert calls["done"].start_time == calls["done"].end_time == at(7)
    assert calls["done"].total_tokens == 9 and calls["done"].is_out_of_order is None
    assert calls["zero"].duration_seconds == 0.0 and not calls["zero"].is_out_of_order
    row = agents.session_agent_summary(ev).first()
    assert (row.unique_agents, row.distinct_agent_events, row.total_invocations) == (4, 6, 4)
    assert row.avg_duration_seconds == -2.5


def test_description_comes_from_the_start(events):
    ev = events(task("Pre", at=0, description="asked"), task("Post", at=2, description="told"),
                task("Post", at=3, description="orphan"))
    pairs = agents.pair_agent_calls(ev).orderBy("call_no")
    assert rows(pairs, "call_no", "description") == [(1, "asked"), (2, "orphan")]


def test_durations_keep_zero_and_round_half_even(events):
    ev = events(
        task("Post", "zero", duration_ms=0.0), task("Post", "none"),
        task("Post", "half", duration_ms=2.0), task("Post", "half", duration_ms=3.0),
    )
    found = {r.agent_type: r for r in agents.agent_duration_profile(ev).collect()}
    assert found["zero"].avg_duration_ms == 0.0 and found["zero"].median_duration_ms == 0.0
    assert found["none"].avg_duration_ms is None and found["none"].p95_duration_ms is None
    assert found["half"].avg_duration_ms == 2.0 and found["half"].median_duration_ms == 2.0
    shares = {r.agent_type: r.share_0_50 for r in agents.duration_range_shares(ev).collect()}
    assert shares["zero"] is None and shares["half"] == 0.0


def test_sketched_percentiles(events):
    ev = events(*[task("Post", duration_ms=float(d)) for d in range(100)])
    row = agents.agent_duration_profile(ev, exact=False).first()
    assert 45 <= row.median_duration_ms <= 55 and 90 <= row.p95_duration_ms <= 99


def test_events_without_session_or_workspace(events):
    ev = events(
        {"session_id": None, "at": 9, "cwd": "/x"}, {"session_id": "s", "at": 1, "workspace": ""},
        {"session_id": "s", "at": 2, "workspace": None}, {"session_id": "s", "at": 3, "workspace": "w"},
    )
    assert rows(sessions.latest_session(ev), "session_id", "ts") == [("s", at(3))]
    assert sessions.session_rollup(ev, T0).count() == 1
    kept = {r.session: r.events for r in sessions.session_context(ev).collect()}
    assert kept == {None: 1, "s": 3}
    rolled = workspaces.workspace_rollup(ev, T0)
    assert rows(rolled, "workspace", "total_events", "total_sessions") == [("w", 1, 1)]
    assert workspaces.workspace_sessions(ev).count() == 1


def test_context_max_or_latest(events):
    ev = events({"cwd": "/z/old"}, {"cwd": "/m"}, {"cwd": "/a/b/new"}, {})
    assert sessions.session_rollup(ev, T0).first().cwd == "/z/old"
    assert sessions.session_rollup(ev, T0, context="latest").first().cwd == "/a/b/new"
    assert {r.project for r in agents.project_usage(ev).collect()} == {"z/old", "/m", "b/new"}
    with pytest.raises(ValueError):
        sessions.session_rollup(ev, T0, context="first")


def test_rollup_status_and_lists(events):
    ev = events(
        task("Pre", "second", at=5, session_id="a"), task("Pre", "first", at=1, session_id="a"),
        task("Pre", "second", at=9, session_id="a"), {"session_id": "b", "at": 0, "event_name": "SessionEnd"},
        {"session_id": "c", "at": 0, "event_name": "Stop"},
    )
    found = {r.session_id: r for r in sessions.session_rollup(ev, at(301)).collect()}
    assert found["a"].agents_used == ["first", "second"] and found["a"].unique_agents == 2
    assert [found[s].status for s in "abc"] == ["active", "completed", "inactive"]
    assert found["c"].agents_used == [] and found["c"].tools_used is None and found["c"].unique_tools == 0
    open_now = sessions.active_sessions(ev, at(3600))
    assert rows(open_now, "session_id", "seconds_since_last") == [("a", 3591.0)]


def test_workspace_totals_once_and_ids_as_rows(events):
    ev = events(*[{"session_id": f"s{i % 101:03d}", "workspace": "w" if i % 101 else "tiny"} for i in range(202)])
    rolled = workspaces.workspace_rollup(ev, T0)
    assert sorted(rows(rolled, "workspace", "total_sessions", "total_events")) == [("tiny", 1, 2), ("w", 100, 200)]
    listed = workspaces.workspace_session_ids(ev, "w").collect()
    assert sorted(r.session_id for r in listed) == [f"s{i:03d}" for i in range(1, 101)]


def test_file_operations_of_all_or_one_session(events):
    ev = events(
        {"tool_name": "Read", "file_path": "/a"}, {"tool_name": "Edit", "file_path": "/b", "session_id": "t"},
        {"tool_name": "Read"}, {"tool_name": "Bash", "file_path": "/c"},
    )
    assert [r.file_path for r in sessions.file_operations(ev).collect()] == ["/b", "/a"]
    assert [r.file_path for r in sessions.file_operations(ev, session_id="s").collect()] == ["/a"]


def test_unknown_tools(events):
    ev = events({}, {"event_name": "PostToolUse", "at": 4}, {"tool_name": "Bash", "command": "ls"},
                {"tool_name": "Bash", "command": "ls"})
    stats = {r.tool_name: tuple(r)[2:] for r in sessions.session_tool_stats(ev).collect()}
    assert stats == {"Unknown": (1, 1, 0, 0), "Bash": (2, 0, 1, 0)}
    pairs = {(r.tool_name, r.call_no): r.duration_seconds for r in tools.pair_tool_calls(ev).collect()}
    assert pairs[("Unknown", 1)] == 4.0 and pairs[("Bash", 2)] is None


def test_edits_are_counted_per_file(events):
    edit = {"event_name": "PostToolUse", "tool_name": "Edit", "old_string": "abc", "new_string": "a"}
    ev = events({**edit, "file_path": "/a", "event_name": "PreToolUse"}, {**edit, "file_path": "/a"}, {**edit, "file_path": "/b"}, {**edit, "file_path": "/a"})
    changes = tools.edit_changes(ev).orderBy("ts")
    assert rows(changes, "file_path", "delta_chars", "edits_to_file") == [("/a", -2, 1), ("/b", -2, 1), ("/a", -2, 2)]


def test_categories_and_short_names(spark, events):
    names = ["athena-pr-reviewer", "PR-bot", "code-reviewer", "atlas", "jira-analyst", "test-developer",
             "security-scan", "doc-generator", "architect"]
    ev = events(*[task("Pre", n) for n in names])
    found = {r.category: (r.usage_count, r.agents) for r in agents.agent_category_usage(ev).collect()}
    assert found == {"pr": (2, 2), "review": (1, 1), "jira": (2, 2), "test": (1, 1),
                     "security": (1, 1), "doc": (1, 1), "other": (1, 1)}
    aliases = spark.createDataFrame([("atlas", "JIRA"), ("jira-analyst", "JIRA")], "agent_type string, short_name string")
    short = {r.short_name: r.usage_count for r in agents.agent_alias_usage(ev, aliases).collect()}
    assert short["JIRA"] == 2 and short["code"] == 1 and short["architect"] == 1


def test_cost_without_a_price_is_null(spark, events):
    ev = events(task("Post", "a", total_tokens=1500), task("Post", "a", total_tokens=500), task("Post", "b", total_tokens=1))
    prices = spark.createDataFrame([("a", 2.0)], "agent_type string, usd_per_1k_tokens double")
    found = {r.agent_type: (r.total_tokens, r.cost) for r in agents.token_cost(ev, prices).collect()}
    assert found == {"a": (2000, 4.0), "b": (1, None)}


def test_search_ignores_case_and_counts_hits(spark):
    df = spark.createDataFrame([(1, "x" * 50 + "Needle and NEEDLE, pin"), (2, "none"), (3, None)], "id int, text string")
    row = tools.search_text(df, ["needle", "Pin"]).first()
    assert (row.id, row.hits) == (1, 3)
    assert row.snippet.startswith("x" * 20) and "Needle" in row.snippet
    assert tools.search_text(df, ["needle", ""]).count() == 1
    with pytest.raises(ValueError):
        tools.search_text(df, [""])


def test_paging_covers_everything_once(events):
    ev = events(*[{"session_id": f"s{i}"} for i in range(7)])
    seen = [r.session_id for page in range(3) for r in sessions.recent_sessions(ev, 3, 3 * page).collect()]
    assert seen == [f"s{i}" for i in reversed(range(7))]
    ids = [r.event_id for page in range(3) for r in sessions.recent_events(ev, 3, 3 * page).collect()]
    assert ids == list(reversed(range(7)))


def test_time_series_pivot(events):
    ev = events({"at": 0}, {"at": 10}, {"at": 3700, "event_name": "Stop"})
    wide = tools.event_timeseries(ev, pivot=("PreToolUse", "Stop")).orderBy("bucket_start")
    assert rows(wide, "bucket_start", "PreToolUse", "Stop") == [(at(0), 2, 0), (at(3600), 0, 1)]


def test_half_open_range(events):
    ev = events({"at": 0}, {"at": 10}, {"at": 20})
    assert [r.event_id for r in sessions.events_between(ev, at(0), at(20)).collect()] == [0, 1]


def test_timeline_payload(events):
    ev = events({"data": '{"a": 1}'}, {"data": "broken"})
    parsed = sessions.session_timeline(ev, parsed=True)
    assert parsed.filter("data is null").count() == 1
    assert sessions.session_timeline(ev, session_id="other").count() == 0


def test_summary_counts(events):
    ev = events(task("Pre", "a"), task("Post", "a"), {"session_id": None})
    assert tuple(agents.summary(ev).first()) == (3, 1, 1)
    assert tuple(agents.summary(ev, approximate=True).first()) == (3, 1, 1)
    assert tuple(agents.summary(ev.limit(0)).first()) == (0, 0, 0)


@pytest.mark.parametrize("rate, step", [(1, 1), (1, 2), (2, 3)])
def test_islands_across_pieces(spark, events, monkeypatch, rate, step):
    """Cut sessions have the groups of uncut ones: plain windows see them whole."""
    rng = random.Random(rate * 10 + step)
    seconds, rows = 0, []
    for _ in range(150):
        seconds += rng.choice([0, 0.5, 1, 1, 3])
        rows.append(task(rng.choice(["Pre", "Pre", "Post"]), rng.choice("ab"), at=seconds, session_id=rng.choice(["s", "s", "t"])))
    ev = events(*rows)
    groups, summary = agents.parallel_groups(ev).collect(), agents.session_agent_summary(ev).collect()
    monkeypatch.setattr(ordered, "RATE", rate)
    monkeypatch.setattr(ordered, "STEP", step)
    assert sorted(agents.parallel_groups(ev).collect(), key=str) == sorted(groups, key=str)
    assert sorted(agents.session_agent_summary(ev).collect(), key=str) == sorted(summary, key=str)
    assert {r.group_size for r in groups} > {1, 2}


def test_a_session_of_a_million_calls_spreads(spark, tmp_path, monkeypatch):
    """One start a second at a gap of one second: one island over all pieces."""
    monkeypatch.setattr(ordered, "RATE", 1 << 10)
    n, path = 1_000_000, str(tmp_path / "events")
    made = {
        "event_id": F.col("id"), "ts": F.timestamp_seconds("id").cast("timestamp_ntz"), "session_id": F.lit("s"),
        "event_name": F.lit("PreToolUse"), "tool_name": F.lit("Task"), "subagent_type": F.lit("a"),
    }
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in SILVER_SCHEMA if f.name not in made]
    spark.range(n).select(*[c.alias(k) for k, c in made.items()], *empty).write.parquet(path)
    ev = spark.read.parquet(path)
    starts = agents._numbered_starts(ev, "1 second")
    assert starts.groupBy("session_id", ordered.PIECE).count().agg(F.max("count")).first()[0] < 80_000
    groups = agents.parallel_groups(ev).agg(
        F.min("group_size"), F.max("group_size"), F.max("group_id"), F.max("execution_order"),
        F.count_if(F.col("position_in_group") != F.col("execution_order")),
    )
    assert groups.first() == (n, n, 1, n, 0)
    assert agents.session_agent_summary(ev).first().parallel_groups == 1


def test_pages_by_offset_and_by_cursor(events, monkeypatch):
    ev = events(*[{"at": n // 3, "session_id": f"s{n % 7}"} for n in range(60)])
    first = sessions.recent_events(ev, limit=10, offset=20).collect()
    names = sessions.recent_sessions(ev, limit=3, offset=2).collect()
    monkeypatch.setattr(sessions, "SHALLOW", 5)
    monkeypatch.setattr(ordered, "RATE", 2)
    monkeypatch.setattr(ordered, "STEP", 2)
    assert sessions.recent_events(ev, limit=10, offset=20).collect() == first
    assert sessions.recent_sessions(ev, limit=3, offset=2).collect() == names
    last = sessions.recent_events(ev, limit=20).collect()[-1]
    assert sessions.events_before(ev, last.ts, last.event_id, 10).collect() == first
