"""Streams over several micro-batches: same results as the batch operators."""

import json

import pytest
from pyspark.sql import functions as F

from fixtures import SF_SMALL, at
from trailspark.plans.fixture_view import load_silver, raw_from_silver
from trailspark.schema import SILVER_COLUMNS, SILVER_SCHEMA
from trailspark.session import names_in, scratch_path
from trailspark.sources.events import read_events
from trailspark.streaming import active, jobs, parts


@pytest.fixture(scope="module")
def silver(spark):
    return load_silver(spark, SF_SMALL).cache()


@pytest.fixture(scope="module")
def silver_files(spark, silver):
    """Ten files in time order."""
    path = scratch_path(spark, "silver")
    silver.repartitionByRange(10, "ts", "event_id").write.parquet(path)
    return path


def progress(spark):
    return scratch_path(spark, "progress")


def drop_file(spark, folder, *rows):
    """Add one file of silver events to a folder."""
    full = [tuple({"event_id": i, "session_id": "s", **r}.get(c) for c in SILVER_COLUMNS) for i, r in enumerate(rows)]
    spark.createDataFrame(full, SILVER_SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_silver_stream_stores_each_event_once(spark, silver):
    raw, out = scratch_path(spark, "raw"), scratch_path(spark, "out")
    check = progress(spark)
    raw_from_silver(silver).repartition(6).write.json(raw)
    jobs.stream_silver(spark, raw, out, check, files_per_batch=2).awaitTermination()
    late_and_repeated = raw_from_silver(silver.filter("event_id < 50")).withColumn("matcher", F.lit("again"))
    late_and_repeated.write.mode("append").json(raw)
    broken = spark.createDataFrame([('{"event_id": 1, "ts": "2024',), ('{"ts": "soon", "data": {}}',)], "value string")
    broken.write.mode("append").text(raw + "/extra")
    spark.read.text(raw + "/extra").coalesce(1).write.mode("append").format("text").save(raw)
    jobs.stream_silver(spark, raw, out, check).awaitTermination()
    stored = read_events(spark, f"{out}/events")
    assert stored.count() == stored.select("event_id").distinct().count() == 1000
    expected = silver.withColumn("ts", F.date_trunc("second", "ts").cast("timestamp_ntz")).drop("data")
    assert expected.exceptAll(stored.select(*expected.columns)).count() == 0
    rejected = spark.read.parquet(f"{out}/rejected")
    assert {r.reason for r in rejected.collect()} == {"bad_line", "no_time"}


def test_session_rollup_equals_batch(spark, silver, silver_files):
    out = scratch_path(spark, "out")
    ev = jobs.read_silver_stream(spark, silver_files, files_per_batch=3)
    jobs.stream_session_rollup(ev, out, progress(spark)).awaitTermination()
    assert spark.read.parquet(out).select("batch_id").distinct().count() == 4
    batch = silver.groupBy("session_id").agg(
        F.min("ts"), F.max("ts"), F.count("*"), F.count_if(F.col("event_name") == "SessionEnd")
    )
    live = jobs.read_session_rollup(spark, out).drop("is_ended")
    assert live.exceptAll(batch).count() == 0 and live.count() == batch.count()


def test_a_replayed_micro_batch_counts_once(spark, silver):
    out = scratch_path(spark, "out")
    for _ in range(2):
        silver.groupBy("session_id").agg(
            F.min("ts").alias("session_start"), F.max("ts").alias("last_event"),
            F.count("*").alias("total_events"), F.lit(0).cast("long").alias("end_events"),
        ).write.mode("overwrite").parquet(f"{out}/batch_id=0")
    assert jobs.read_session_rollup(spark, out).agg(F.sum("total_events")).first()[0] == 1000


def test_window_counts_equal_batch(spark, silver, silver_files):
    out = scratch_path(spark, "out")
    ev = jobs.read_silver_stream(spark, silver_files, files_per_batch=4)
    jobs.stream_window_counts(ev, out, progress(spark)).awaitTermination()
    live = jobs.read_window_counts(spark, out)
    assert live.filter("span = '1 hour'").agg(F.sum("events")).first()[0] == 1000
    sliding = silver.groupBy(F.window("ts", "24 hours", "1 hour")["start"].alias("window_start")).agg(
        F.count("*").alias("events")
    )
    found = live.filter("span = '24 hours'").select("window_start", "events")
    assert found.exceptAll(sliding).count() == 0 and found.count() == sliding.count()
    assert live.agg(F.max("approx_agents")).first()[0] == 5


def test_activity_periods(spark):
    folder, out, check = scratch_path(spark, "in"), scratch_path(spark, "out"), progress(spark)

    def run(*moments):
        drop_file(spark, folder, *[{"ts": at(s)} for s in moments])
        ev = jobs.read_silver_stream(spark, folder)
        jobs.stream_activity_periods(ev, out, check).awaitTermination()
        periods = jobs.read_activity_periods(spark, out).orderBy("period_start").collect()
        return [(p.period_start, p.period_end, p.events, p.active_seconds) for p in periods]

    first = (at(0), at(40), 3, 40.0)
    assert run(0, 10, 40, 70.5, 200) == [first, (at(70.5), at(70.5), 1, 0.0), (at(200), at(200), 1, 0.0)]
    days_late = [(at(-400_000), at(-399_999.5), 2, 0.5)]
    assert run(-400_000, -399_999.5, 45) == [*days_late, (at(0), at(70.5), 5, 70.5), (at(200), at(200), 1, 0.0)]
    assert run(3595, 3620) [-1] == (at(3595), at(3620), 2, 25.0)  # across an hour


def test_activity_periods_refuse_short_gaps(spark):
    with pytest.raises(ValueError):
        jobs.stream_activity_periods(None, "", "", gap="0 seconds")


def test_sessions_open_and_close(spark):
    folder, out, check = scratch_path(spark, "in"), scratch_path(spark, "out"), progress(spark)

    def run():
        ev = jobs.read_silver_stream(spark, folder)
        active.stream_active_sessions(ev, out, check).awaitTermination()
        return {r.session_id: r for r in active.read_active_sessions(spark, out).collect()}

    drop_file(
        spark, folder, {"ts": at(0), "session_id": "ends"}, {"ts": at(5), "session_id": "ends", "event_name": "SessionEnd"},
        {"ts": at(0), "session_id": "quiet"}, {"ts": at(60), "session_id": "busy"},
    )
    found = run()
    assert {s: (r.state, r.reason) for s, r in found.items()} == {
        "ends": ("closed", "end"), "quiet": ("open", None), "busy": ("open", None)
    }
    assert found["ends"].events == 2 and found["ends"].duration_seconds == 5.0
    drop_file(spark, folder, {"ts": at(3000), "session_id": "busy"}, {"ts": at(9), "session_id": "ends"})
    drop_file(spark, folder, {"ts": at(6000), "session_id": "busy"})
    found = run()
    assert (found["quiet"].state, found["quiet"].reason) == ("closed", "silence")
    assert (found["busy"].state, found["busy"].events) == ("open", 3)
    assert (found["ends"].state, found["ends"].events) == ("closed", 3)
    drop_file(spark, folder, {"ts": at(-400_000), "session_id": "days late"}, {"ts": at(1), "session_id": "quiet"})
    found = run()
    assert found["days late"].reason == "silence" and found["quiet"].events == 2
    then = active.read_active_sessions(spark, out, as_of=at(600)).filter("session_id = 'quiet'")
    assert then.first().state == "open"


def test_pairs_and_both_orphans(spark):
    folder, out, check = scratch_path(spark, "calls"), scratch_path(spark, "out"), progress(spark)
    schema = "call_key string, event_id long, session_id string, subagent_type string, event_name string, ts timestamp_ntz, total_tokens long"

    def run(*rows, within=None):
        df = spark.createDataFrame([(k, None, "s", "a", f"{side}ToolUse", at(s), n) for k, side, s, n in rows], schema)
        df.coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        jobs.stream_pair_calls(stream, out, check).awaitTermination()
        return {r.call_key: r for r in jobs.read_pair_calls(spark, out).collect()}

    found = run(("k1", "Pre", 0, None), ("k2", "Pre", 1, None), ("k3", "Post", 2, 4), ("k4", "Post", 3, 5))
    assert found["k1"].end_time is None and found["k3"].start_time is None
    found = run(("k1", "Post", 30, 7), ("k3", "Pre", 40, None), ("k5", "Pre", 0, None), ("k5", "Post", 5000, 1))
    assert (found["k1"].duration_seconds, found["k1"].total_tokens) == (30.0, 7)
    assert found["k3"].duration_seconds == -38.0
    assert found["k2"].end_time is None and found["k4"].start_time is None and found["k4"].total_tokens == 5
    assert found["k5"].duration_seconds == 5000.0
    near = jobs.read_pair_calls(spark, out, within="10 minutes").filter("call_key = 'k5'").collect()
    assert sorted((r.start_time is None, r.total_tokens) for r in near) == [(False, None), (True, 1)]


def test_a_job_that_runs_on(spark, silver):
    folder, out = scratch_path(spark, "in"), scratch_path(spark, "out")
    drop_file(spark, folder, {"ts": at(0)})
    ev = jobs.read_silver_stream(spark, folder)
    query = jobs.stream_session_rollup(ev, out, progress(spark), every="1 second")
    try:
        query.processAllAvailable()
        assert query.isActive
        drop_file(spark, folder, {"ts": at(9)}, {"ts": at(4)})
        query.processAllAvailable()
    finally:
        query.stop()
    assert jobs.read_session_rollup(spark, out).first().total_events == 3


def test_lines_without_ids_are_events_of_their_own(spark, tmp_path):
    line = {"ts": "2025-09-01 10:00:00", "event_name": "Stop", "data": {"session_id": "s"}}
    folder = tmp_path / "raw"
    folder.mkdir()
    text = "\n".join(json.dumps(x) for x in (line, line, {**line, "matcher": "*"}, {**line, "tool_arg": "*"}))
    (folder / "a.json").write_text(text)
    out, check = scratch_path(spark, "out"), progress(spark)
    for _ in range(2):
        jobs.stream_silver(spark, str(folder), out, check).awaitTermination()
    assert read_events(spark, f"{out}/events").count() == 4
    jobs.stream_silver(spark, str(folder), out, progress(spark)).awaitTermination()  # all files again
    assert read_events(spark, f"{out}/events").count() == 4


def test_late_report(spark, silver_files):
    out = scratch_path(spark, "out")
    ev = jobs.read_silver_stream(spark, silver_files, files_per_batch=5)
    hours = F.make_dt_interval(hours=F.when(F.col("event_id") < 10, 2).otherwise(0))
    arrived = ev.withColumn("ingest_ts", F.col("ts") + hours)
    jobs.stream_late_report(arrived, out, progress(spark)).awaitTermination()
    report = jobs.read_late_report(spark, out)
    assert report.agg(F.sum("late_events"), F.max("longest_delay_seconds")).first() == (10, 7200.0)


def write_part(spark, path, number, repeat=1):
    rows = [(f"s{(number * 7 + i) % 5}", at(number * 10 + i), at(number * 10 + i + repeat), 1, 0) for i in range(3)]
    schema = "session_id string, session_start timestamp_ntz, last_event timestamp_ntz, total_events long, end_events long"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/batch_id={number}")


def totals(spark, path):
    return sorted(tuple(r) for r in jobs.read_session_rollup(spark, path).collect())


def test_parts_are_folded_in_levels(spark, monkeypatch):
    monkeypatch.setattr(parts, "FAN", 3)
    plain, folded = scratch_path(spark, "plain"), scratch_path(spark, "folded")
    for number in range(31):
        write_part(spark, plain, number)
        write_part(spark, folded, number)
        parts.fold(spark, folded, jobs.merged_totals)
        if number % 10 == 0:
            assert totals(spark, folded) == totals(spark, plain)
    manifest = parts.read_manifest(spark, folded)
    assert [(f["first"], f["last"], f["level"]) for f in manifest["folds"]] == [(0, 26, 3), (27, 29, 1)]
    assert len(names_in(spark, folded, parts.FOLDS)) <= 2 + 3 + 3 and len(names_in(spark, folded)) <= 3 + 3 + 4
    write_part(spark, folded, 30)  # The newest batch is run again.
    parts.fold(spark, folded, jobs.merged_totals)
    assert totals(spark, folded) == totals(spark, plain)


def test_a_fold_that_dies_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(parts, "FAN", 2)
    path = scratch_path(spark, "parts")
    for number in range(6):
        write_part(spark, path, number)
    expected = totals(spark, path)
    whole, swap = parts.read_parts(spark, path), parts.swap_manifest
    calls = []

    def dies(*args):
        calls.append(args)
        if len(calls) == 2:
            raise RuntimeError("lost")
        swap(*args)

    monkeypatch.setattr(parts, "swap_manifest", dies)
    with pytest.raises(RuntimeError):
        parts.fold(spark, path, jobs.merged_totals)
    assert parts.read_manifest(spark, path)["version"] == 1 and len(names_in(spark, path, parts.FOLDS)) == 2
    assert totals(spark, path) == expected
    assert whole.count() == 18  # A reader from before the fold.
    monkeypatch.setattr(parts, "swap_manifest", swap)
    parts.fold(spark, path, jobs.merged_totals)
    assert totals(spark, path) == expected
    used = {f["folder"] for f in parts.read_manifest(spark, path)["folds"]}
    assert used <= set(names_in(spark, path, parts.FOLDS))
    with pytest.raises(RuntimeError):
        parts.swap_manifest(spark, path, parts.read_manifest(spark, path))


@pytest.mark.parametrize("job", ["session_rollup", "window_counts", "activity_periods", "pair_calls", "late_report"])
def test_folded_streams_read_like_unfolded_ones(spark, silver, silver_files, monkeypatch, job):
    found = []
    for fan in (2, 1000):
        monkeypatch.setattr(parts, "FAN", fan)
        out = scratch_path(spark, "out")
        ev = jobs.read_silver_stream(spark, silver_files, files_per_batch=1)
        if job == "pair_calls":
            ev = ev.withColumn("call_key", F.concat("session_id", F.lit("|"), (F.col("event_id") % 40).cast("string")))
        if job == "late_report":
            ev = ev.withColumn("ingest_ts", F.col("ts") + F.make_dt_interval(hours=F.col("event_id") % 5))
        getattr(jobs, f"stream_{job}")(ev, out, progress(spark)).awaitTermination()
        rows = getattr(jobs, f"read_{job}")(spark, out)
        found.append(sorted((tuple(r) for r in rows.collect()), key=str))
        folds = parts.read_manifest(spark, out)["folds"]
        assert bool(folds) == (fan == 2)
    assert found[0] == found[1] and found[0]


def test_calls_without_a_name_are_numbered_when_read(spark, monkeypatch):
    """Late events take their place; calls that the payload names meet by that name."""
    monkeypatch.setattr(parts, "FAN", 2)
    folder, out, check = scratch_path(spark, "calls"), scratch_path(spark, "out"), progress(spark)

    def run(first, *rows):
        full = [
            {"event_id": first + i, "ts": at(s), "event_name": f"{side}ToolUse", "tool_name": "Task", "subagent_type": "a", "data": data}
            for i, (side, s, data) in enumerate(rows)
        ]
        drop_file(spark, folder, *full)
        jobs.stream_pair_calls(jobs.read_silver_stream(spark, folder), out, check).awaitTermination()
        found = jobs.read_pair_calls(spark, out).collect()
        return {r.call_key: tuple(None if m is None else (m - at(0)).total_seconds() for m in (r.start_time, r.end_time)) for r in found}

    named = '{"tool_use_id": "u1"}'
    assert run(0, ("Pre", 10, "{}"), ("Post", 12, "{}"), ("Pre", 20, "{}"), ("Pre", 30, named)) == {
        "s|a|1": (10, 12), "s|a|2": (20, None), "u1": (30, None)
    }
    assert run(10, ("Post", 25, "{}"), ("Post", 90, named)) == {"s|a|1": (10, 12), "s|a|2": (20, 25), "u1": (30, 90)}
    late = {"s|a|1": (1, 2), "s|a|2": (10, 12), "s|a|3": (20, 25), "u1": (30, 90)}
    assert run(20, ("Pre", 1, "{}"), ("Post", 2, None)) == late
    assert run(30, ("Stop", 3, "{}")) == late
    assert parts.read_manifest(spark, out)["folds"]
