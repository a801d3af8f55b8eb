"""Ingest: raw files, time zones, quarantine, payload fields, sinks, heartbeats."""

import json

import pytest
from pyspark.sql import functions as F

from fixtures import SF_SMALL, T0, at, task
from trailspark.operators import agents, sessions, tools, workspaces
from trailspark.operators.agents import window_stats
from trailspark.operators.sessions import events_between, session_rollup
from trailspark.plans.fixture_view import load_silver
from trailspark.schema import SILVER_SCHEMA
from trailspark.session import names_in, scratch_path
from trailspark.sources import cube, events as E, export, heartbeat, sketches


def raw(spark, *payloads):
    rows = [(i, at(i), "PreToolUse", p) for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_name string, data string")


def write_lines(path, *lines):
    path.mkdir(exist_ok=True)
    (path / "events.json").write_text("\n".join(lines) + "\n")
    return str(path)


def test_read_raw_keeps_nested_data_and_bad_lines(spark, tmp_path):
    good = {"ts": "2025-09-01 10:00:00", "event_name": "Stop", "data": {"session_id": "s", "n": [1, {"a": None}]}}
    path = write_lines(tmp_path / "in", json.dumps(good), '{"ts": "2025-', json.dumps({**good, "event_id": 7}))
    rows = E.read_raw_events(spark, path).collect()
    assert len(rows) == 3
    bad = [r for r in rows if r.bad_line]
    assert len(bad) == 1 and bad[0].bad_line == '{"ts": "2025-'
    kept = [r for r in rows if not r.bad_line]
    assert {json.loads(r.data)["session_id"] for r in kept} == {"s"}
    assert 7 in {r.event_id for r in kept} and all(r.event_id is not None for r in rows)
    again = {r.event_id for r in E.read_raw_events(spark, path).collect()}
    assert again == {r.event_id for r in rows}


def test_times_become_utc_seconds(spark):
    same_instant = [
        "2025-09-01 07:00:00.900-03:00", "2025-09-01 07:00:00 -03", "2025-09-01T10:00:00Z",
        "2025-09-01T10:00:00.5+00:00", "2025-09-01 07:00:00.25",
    ]
    df = spark.createDataFrame([(s,) for s in same_instant] + [("soon",), (None,)], "ts string")
    times = [r.ts for r in E.normalize_time(df, "-03:00").collect()]
    assert times == [T0] * 5 + [None] * 2
    local = spark.sql("select timestamp_ntz'2025-09-01 07:00:00.7' ts")
    assert E.normalize_time(local, "America/Sao_Paulo").first().ts == T0
    instant = spark.sql("select timestamp'2025-09-01 10:00:00.7Z' ts")
    assert E.normalize_time(instant, "America/Sao_Paulo").first().ts == T0


def test_quarantine_keeps_every_row(spark):
    df = raw(spark, '{"a": 1}', '{"a": ', "", None, "  ", "[1]", '{"a": null}')
    df = df.withColumn("ts", F.when(F.col("event_id") < 6, F.col("ts")))
    valid, rejected = E.split_quarantine(df)
    assert {r.event_id for r in valid.collect()} == {0, 5}
    reasons = {r.event_id: r.reason for r in rejected.collect()}
    assert reasons == {1: "invalid_json", 2: "no_data", 3: "no_data", 4: "no_data", 6: "no_time"}


def test_payload_fields(spark):
    df = raw(
        spark,
        '{"session_id": "s", "tool_response": {"totalDurationMs": "12x", "totalTokens": 5}}',
        '{"tool_response": {"totalDurationMs": 1.5e3, "token_usage": {"total_tokens": 6}}}',
        '{"tool_response": {"totalTokens": 7, "token_usage": {"total_tokens": 8}, "content": [{"text": "hi"}]}}',
        '{"session_id": null, "cwd": 5, "tool_response": "plain text", "tool_input": {"command": {"x": 1}}}',
        '{"tool_response": {"content": []}}',
        "broken",
    )
    rows = {r.event_id: r for r in E.to_silver(df).collect()}
    assert rows[0].duration_ms is None and rows[0].total_tokens == 5 and rows[0].session_id == "s"
    assert rows[1].duration_ms == 1500.0 and rows[1].total_tokens == 6
    assert rows[2].total_tokens == 7 and rows[2].response_text == "hi"
    assert rows[3].session_id is None and rows[3].cwd == "5"
    assert rows[3].response_text is None and rows[3].command == '{"x":1}'
    assert rows[4].response_text is None
    assert rows[5].session_id is None and rows[5].data == "broken"


def test_workspace_label(spark, events):
    ev = events(
        {"cwd": "/a", "workspace": "old", "data": '{"cwd":"/a","tmux_session":"old","n":{"x":1.50}}'},
        {"cwd": "/a", "data": '{"cwd":"/a"}'}, {"cwd": "/b", "workspace": "keep", "data": "{}"},
        {"cwd": "/c", "workspace": "own", "data": '{"tmux_session":"own"}'},
    )
    hosts = spark.createDataFrame([("/a", "new"), ("/a", ""), ("/b", ""), ("/a", "less")], "cwd string, workspace string")
    rows = {r.event_id: r for r in E.attach_workspace(ev, hosts).collect()}
    assert len(rows) == 4
    assert [rows[i].workspace for i in range(4)] == ["new", "new", "keep", "own"]
    assert json.loads(rows[0].data) == {"cwd": "/a", "tmux_session": "new", "n": {"x": 1.5}}
    assert json.loads(rows[1].data)["tmux_session"] == "new"
    assert rows[2].data == "{}" and json.loads(rows[3].data) == {"tmux_session": "own"}


def test_append_is_repeatable_and_prunes(spark):
    path = scratch_path(spark, "table")
    silver = load_silver(spark, SF_SMALL)
    E.append_events(silver, path)
    E.append_events(silver, path)
    stored = E.read_events(spark, path)
    assert stored.count() == 1000
    assert stored.drop("event_date").exceptAll(silver).count() == 0

    one_day = events_between(stored, "2024-01-10", "2024-01-11")
    plan = one_day._jdf.queryExecution().executedPlan().toString()
    partition_filters = plan.split("PartitionFilters:")[1].split("PushedFilters")[0]
    assert "event_date" in partition_filters
    assert "GreaterThanOrEqual(ts" in plan
    assert one_day.count() == silver.filter("ts >= '2024-01-10' and ts < '2024-01-11'").count()
    recent = window_stats(stored, "2024-01-31")
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "event_date" in plan.split("PartitionFilters:")[1].split("PushedFilters")[0]
    assert {r.total_events for r in recent.collect()} == {207, 40}
    keyed = stored.filter("session_id = 's1-0'").select("ts")
    plan = keyed._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(session_id,s1-0)" in plan and "data:string" not in plan.split("ReadSchema")[1]


def test_audit_log(spark):
    path = scratch_path(spark, "audit")
    df = raw(spark, '{"a":1}', "not json").withColumns({"tool_arg": F.lit("Bash"), "matcher": F.lit("*")})
    E.write_audit_log(df, path)
    lines = [r.value for r in spark.read.text(path).collect()]
    assert lines.count(E.SEPARATOR) == 2
    assert "[2025-09-01 10:00:00] Event: PreToolUse | Tool: Bash | Matcher: *" in lines
    assert "not json" in lines and any('"a"' in line for line in lines)


def test_agent_feed_numbers_each_day(events):
    day = 86_400
    ev = events(
        task("Post", at=5), task("Pre", at=1), {"event_name": "SubagentStop", "at": 9},
        task("Pre", at=day), {"event_name": "PreToolUse", "tool_name": "Bash", "at": 2},
    )
    feed = E.agent_event_feed(ev).orderBy("event_date", "id")
    assert [(r.id, r.phase) for r in feed.collect()] == [(1, "pre"), (2, "post"), (3, "stop"), (1, "pre")]


def test_rules(events):
    ev = events({"tool_name": "Task"}, {"tool_name": "Bash"}, {"event_name": "Stop"}, {})
    rules = [(1, "PreToolUse", "Task"), (2, "PreToolUse", "*"), (3, "Stop", "*"), (4, "SessionEnd", "*")]
    found = sorted((r.event_id, r.rule_id) for r in E.route_events(ev, rules).collect())
    assert found == [(0, 1), (0, 2), (1, 2), (2, 3), (3, 2)]


def test_heartbeats(spark):
    lines = [
        "Hook triggered at Fri Aug 29 18:43:11 -03 2025", "Hook triggered at Fri Aug 29 18:43:41 -03 2025",
        "Hook triggered at Fri Aug 29 23:59:59 -03 2025", "Hook triggered at Mon Sep  1 00:00:00 -03 2025",
        "Hook triggered at", "something else",
    ]
    df = spark.createDataFrame([(line,) for line in lines], "value string")
    days = heartbeat.heartbeat_rate(df).orderBy("bucket_start").collect()
    assert [(str(d.bucket_start), d.beats, d.max_gap_s) for d in days] == [
        ("2025-08-29 00:00:00", 3, 18978), ("2025-09-01 00:00:00", 1, None)
    ]
    assert heartbeat.heartbeat_rate(df, "hour").count() == 3
    twice = df.limit(1).union(df.limit(1))
    assert tuple(heartbeat.heartbeat_rate(twice).first())[1:] == (2, 0)
    first = heartbeat.parse_heartbeats(df).orderBy("ts").first()
    assert str(first.ts) == "2025-08-29 21:43:11"


def test_heartbeat_zones(spark):
    zones = ["-03", "UTC", "+0530", "-0300", "CEST", "+05:30"]
    refused = ["XYZ", "+9900", "IST"]
    lines = [f"Hook triggered at Fri Aug 29 18:43:11 {z} 2025" for z in zones + refused]
    df = spark.createDataFrame([(line,) for line in [*lines, "else"]], "value string")
    beats, rest = heartbeat.split_heartbeats(df)
    hours = ["13:13:11"] * 2 + ["16:43:11", "18:43:11"] + ["21:43:11"] * 2
    assert sorted(str(r.ts)[11:] for r in beats.collect()) == hours
    assert {r.value for r in rest.collect()} == {*lines[len(zones):], "else"}


def test_csv_round_trip(spark, events):
    ev = events(
        {"workspace": "", "cwd": 'a "quoted", text', "command": "x"}, {"session_id": "t", "workspace": None},
    )
    rolled = session_rollup(ev, T0)
    path = scratch_path(spark, "csv")
    export.export_csv(rolled, path)
    flat = rolled.withColumn("agents_used", F.array_join("agents_used", ","))
    again = export.read_csv_export(spark, path, flat.schema)
    assert flat.exceptAll(again).count() == 0 and again.count() == 2


def test_an_event_twice_in_one_batch_is_stored_once(spark, events):
    path = scratch_path(spark, "table")
    ev = events({"event_id": 1}, {"event_id": 1}, {"event_id": 2})
    E.append_events(ev, path)
    E.append_events(ev, path)
    assert sorted(r.event_id for r in E.read_events(spark, path).collect()) == [1, 2]


def test_labels_keep_text_that_is_no_object(spark):
    texts = ['{"cwd": "/x"}', "[1, 2]", '{"cut', None]
    df = spark.createDataFrame([(i, "/x", None, t) for i, t in enumerate(texts)], "event_id long, cwd string, workspace string, data string")
    hosts = spark.createDataFrame([("/x", "w")], "cwd string, workspace string")
    got = {r.event_id: (r.workspace, r.data) for r in E.attach_workspace(df, hosts).collect()}
    assert {i: got[i] for i in (1, 2, 3)} == {i: ("w", texts[i]) for i in (1, 2, 3)}


def test_events_without_a_time_are_stored_once(spark, events):
    path = scratch_path(spark, "table")
    ev = events({"event_id": 1}, {"event_id": 2}).withColumn("ts", F.when(F.col("event_id") == 1, F.col("ts")))
    for _ in range(2):
        E.append_events(ev, path)
    assert sorted((r.event_id, r.event_date is None) for r in E.read_events(spark, path).collect()) == [(1, False), (2, True)]


def scanned_rows(df):
    """Rows that the file scan of a run handed on."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    found = [leaves.apply(i).metrics().get("numOutputRows").get().value() for i in range(leaves.size()) if "FileScan" in leaves.apply(i).toString()]
    return sum(found)


def test_a_session_is_read_from_few_row_groups(spark):
    """Sessions are clustered in a date's files; bounds and bloom filters skip the others."""
    path = scratch_path(spark, "table")
    made = {
        "event_id": F.col("id"), "session_id": F.concat(F.lit("s"), F.col("id") * 7919 % 500),
        "ts": F.timestamp_seconds(F.col("id") % 80_000).cast("timestamp_ntz"),
    }
    empty = [F.lit("x" * 20).cast(f.dataType).alias(f.name) if f.dataType.simpleString() == "string" else F.lit(None).cast(f.dataType).alias(f.name) for f in SILVER_SCHEMA if f.name not in made]
    ev = spark.range(50_000).select(*[c.alias(n) for n, c in made.items()], *empty)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")  # Several files a date.
    try:
        for part in range(2):
            E.append_events(ev.filter(F.col("event_id") % 2 == part), path)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    one = E.read_events(spark, path).filter("session_id = 's77'").select("ts", "event_id")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert scanned_rows(one) <= 50_000 / 3
        none = E.read_events(spark, path).filter("session_id = 's77x'").select("ts", "event_id")
        assert scanned_rows(none) == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert one.count() == 100


def same_rows(left, right):
    assert sorted(map(str, left.collect())) == sorted(map(str, right.collect()))


def test_a_cube_counts_only_touched_dates_again(spark):
    path, store = scratch_path(spark, "table"), scratch_path(spark, "cube")
    silver = load_silver(spark, SF_SMALL)
    assert cube.refresh_cube(spark, path, store) == []
    E.append_events(silver.filter("event_id % 3 > 0"), path)
    assert len(cube.refresh_cube(spark, path, store)) == 30
    assert cube.refresh_cube(spark, path, store) == []
    files = {d: names_in(spark, store, "cube", d) for d in names_in(spark, store, "cube") if d.startswith("event_date=")}
    E.append_events(silver.filter("ts >= '2024-01-10' and ts < '2024-01-12'"), path)  # late and repeated
    assert cube.refresh_cube(spark, path, store) == ["2024-01-10", "2024-01-11"]
    for date, before in files.items():
        assert (names_in(spark, store, "cube", date) == before) == (date[-2:] not in ("10", "11"))
    E.append_events(silver.withColumn("ts", F.when(F.col("event_id") != 5, F.col("ts"))).withColumn("event_id", F.when(F.col("event_id") == 5, -5).otherwise(F.col("event_id"))), path)
    assert "__HIVE_DEFAULT_PARTITION__" in cube.refresh_cube(spark, path, store)
    stored, rows = E.read_events(spark, path), cube.read_cube(spark, store)
    as_of = "2024-01-31"
    same_rows(cube.session_rollup_of_cube(rows, as_of), sessions.session_rollup(stored, as_of))
    same_rows(cube.session_rollup_of_cube(rows, as_of, context="latest"), sessions.session_rollup(stored, as_of, context="latest"))
    same_rows(cube.workspace_rollup_of_cube(rows, as_of), workspaces.workspace_rollup(stored, as_of))
    same_rows(cube.tool_usage_of_cube(rows), tools.tool_usage(stored))
    same_rows(cube.summary_of_cube(rows), agents.summary(stored))


def test_a_refresh_that_dies_is_repeated(spark, monkeypatch):
    path, store = scratch_path(spark, "table"), scratch_path(spark, "cube")
    silver = load_silver(spark, SF_SMALL)
    E.append_events(silver.filter("event_id < 500"), path)
    cube.refresh_cube(spark, path, store)
    E.append_events(silver, path)
    monkeypatch.setattr(cube, "create_json", lambda *args: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        cube.refresh_cube(spark, path, store)
    monkeypatch.undo()
    assert cube.refresh_cube(spark, path, store)
    same_rows(cube.summary_of_cube(cube.read_cube(spark, store)), agents.summary(silver))


def test_rules_of_a_table_equal_rules_of_a_list(spark):
    silver = load_silver(spark, SF_SMALL).select("event_id", "event_name", "tool_name")
    silver = silver.union(spark.createDataFrame([(-1, None, "Task"), (-2, "PreToolUse", None)], silver.schema))
    rules = [(1, "PreToolUse", "Task"), (2, "PreToolUse", "*"), (3, "Stop", "*"), (4, "SessionEnd", "*"), (5, "PostToolUse", "Edit|^Ba.h$"), (6, "Stop", "x"), (2, "PreToolUse", "*")]
    table = spark.createDataFrame(rules, "rule_id int, event_name string, pattern string")
    expected = E.route_events(silver, rules)
    found = E.route_events_by(silver, table)
    assert found.exceptAll(expected).count() == 0 and expected.exceptAll(found).count() == 0
    many = spark.range(10_000).select(
        F.col("id").cast("int").alias("rule_id"), F.lit("PreToolUse").alias("event_name"),
        F.when(F.col("id") % 100 == 0, "Task").otherwise(F.concat(F.lit("no"), "id")).alias("pattern"),
    )
    routed = E.route_events_by(silver, many)
    assert len(routed._jdf.queryExecution().executedPlan().toString()) < 20_000
    tasks = silver.filter("event_name = 'PreToolUse' and tool_name = 'Task'").count()
    assert routed.count() == 100 * tasks


def test_sketched_durations_are_close_to_exact_ones(spark):
    path, store = scratch_path(spark, "table"), scratch_path(spark, "sketches")
    made = {
        "event_id": F.col("id"), "session_id": F.concat(F.lit("s"), F.col("id") % 300), "event_name": F.lit("PostToolUse"),
        "tool_name": F.lit("Task"), "ts": F.timestamp_seconds(F.col("id") * 3).cast("timestamp_ntz"),
        "subagent_type": F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("a"), F.col("id") % 5)),
        "duration_ms": F.when(F.col("id") % 50 > 0, F.exp(F.pmod(F.xxhash64("id"), F.lit(10_000)) / 1000.0)),
    }
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in SILVER_SCHEMA if f.name not in made]
    ev = spark.range(120_000).select(*[c.alias(n) for n, c in made.items()], *empty)
    for part in range(2):
        E.append_events(ev.filter(F.col("event_id") % 2 == part), path)
        assert len(cube.refresh_cube(spark, path, store, make=sketches.duration_sketches)) == 5
    stored = E.read_events(spark, path)
    for since, until in ((None, None), ("1970-01-02", "1970-01-04")):
        inside = stored if since is None else stored.filter(f"event_date >= '{since}' and event_date < '{until}'")
        exact = {r.agent_type: r for r in agents.agent_duration_profile(inside).collect()}
        found = {r.agent_type: r for r in sketches.duration_profile_of_sketches(sketches.read_sketches(spark, store), since, until).collect()}
        assert found.keys() == exact.keys()
        for name, row in found.items():
            for column in ("total_invocations", "first_used", "last_used", "min_duration_ms", "max_duration_ms", "avg_duration_ms"):
                assert row[column] == pytest.approx(exact[name][column]) if "ms" in column else row[column] == exact[name][column]
            assert abs(row.approx_sessions - exact[name].unique_sessions) <= 0.05 * exact[name].unique_sessions
            values = inside.filter((F.col("subagent_type") == name) & F.col("duration_ms").isNotNull())
            for column, rank in (("median_duration_ms", 0.5), ("p95_duration_ms", 0.95)):
                # Ranks of the whole milliseconds around the value found.
                low, high, n = values.agg(
                    F.count_if(F.col("duration_ms") < row[column] - 1), F.count_if(F.col("duration_ms") <= row[column] + 1), F.count("*")
                ).first()
                assert low / n - 0.01 <= rank <= high / n + 0.01
    shares = sketches.duration_range_shares_of_sketches(sketches.read_sketches(spark, store))
    assert shares.columns == agents.duration_range_shares(stored).columns and shares.count() == len(exact)
