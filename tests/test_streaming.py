"""The streams give what the same question over the whole table gives."""

import os

from creditloom.operators import reports
from creditloom.session import scratch_path
from creditloom.sources import files
from creditloom.sources.requests import APPLICATION_SCHEMA, applications
from creditloom.streaming import applications as streams


def test_log_is_not_appended_twice(spark, folder):
    log, state = scratch_path(spark, "log"), scratch_path(spark, "state")
    first = streams.append_log(spark, folder, log, state).count()
    assert first == applications(spark, folder).count() == streams.append_log(spark, folder, log, state).count()


def test_new_files_are_added(spark, folder):
    source, log, state = (scratch_path(spark, n) for n in ("in", "log", "state"))
    events = spark.read.parquet(f"{folder}/events.parquet")
    run = lambda: streams.append_log(spark, source, log, state)
    target = scratch_path(spark, "days")
    days = lambda: streams.daily_counts(spark, source, target, state + "-days")
    for half in ("event_id % 2 = 0", "event_id % 2 = 1"):
        events.filter(half).coalesce(1).write.mode("append").parquet(source)
        stream_files = "part-*"
        original = streams.application_stream
        streams.application_stream = lambda s, f: original(s, f, stream_files)
        try:
            run(), days()
        finally:
            streams.application_stream = original
    log_rows = spark.read.parquet(log)
    assert log_rows.count() == log_rows.select("application_id").distinct().count() == events.count()
    want = reports.daily_applications(applications(spark, folder)).collect()
    assert sorted(map(tuple, spark.read.parquet(target).collect())) == sorted(map(tuple, want))


def test_closed_days_agree_with_the_batch(spark, folder):
    got = {r.day: r.n_applications for r in streams.closed_days(
        spark, folder, scratch_path(spark, "closed"), scratch_path(spark, "state")).collect()}
    want = {r.day: r.n_applications for r in reports.daily_applications(applications(spark, folder)).collect()}
    assert got and all(want[d] == n for d, n in got.items()) and len(got) < len(want)
    assert max(got) < max(want)


def test_upserts_take_late_rows_and_replays(spark, folder):
    """A late row changes its day alone, and a batch that is played again changes nothing."""
    source, target, state = (scratch_path(spark, n) for n in ("in", "days", "state"))
    events = spark.read.parquet(f"{folder}/events.parquet")
    original = streams.application_stream
    streams.application_stream = lambda s, f: original(s, f, "part-*")
    try:
        for part in ("event_id % 3 > 0", "event_id % 3 = 0"):  # the second part is late for every day
            events.filter(part).coalesce(1).write.mode("append").parquet(source)
            got = streams.daily_upserts(spark, source, target, state)
        want = sorted(map(tuple, reports.daily_applications(applications(spark, folder)).collect()))
        assert sorted(map(tuple, got.collect())) == want
        # The last batch is taken back from the log of finished ones: it is run again.
        commits = sorted((f for f in os.listdir(f"{state}/commits") if f.isdigit()), key=int)
        os.remove(f"{state}/commits/{commits[-1]}")
        for crc in (f"{state}/commits/.{commits[-1]}.crc",):
            if os.path.exists(crc):
                os.remove(crc)
        assert sorted(map(tuple, streams.daily_upserts(spark, source, target, state).collect())) == want
    finally:
        streams.application_stream = original


def test_upsert_leaves_other_days_alone(spark, folder):
    source, target, state = (scratch_path(spark, n) for n in ("in", "days", "state"))
    events = spark.read.parquet(f"{folder}/events.parquet")
    first = events.selectExpr("min(date(ts))").first()[0]
    original = streams.application_stream
    streams.application_stream = lambda s, f: original(s, f, "part-*")
    try:
        events.coalesce(1).write.parquet(source)
        streams.daily_upserts(spark, source, target, state)
        before = {d: sorted(os.listdir(f"{target}/{d}")) for d in os.listdir(target) if d.startswith("day=")}
        events.filter(f"date(ts) = '{first}'").limit(1).coalesce(1).write.mode("append").parquet(source)
        streams.daily_upserts(spark, source, target, state)
        after = {d: sorted(os.listdir(f"{target}/{d}")) for d in os.listdir(target) if d.startswith("day=")}
        assert {d for d in before if before[d] != after[d]} == {f"day={first}"}
    finally:
        streams.application_stream = original


def test_append_that_is_run_again_writes_once(spark, folder):
    rows, log = applications(spark, folder), scratch_path(spark, "log")
    files.append_rows(rows.filter("purpose = 'click'"), log, "a")
    for _ in range(2):  # cut after the write, then repeated
        files.append_rows(rows.filter("purpose <> 'click'"), log, "b")
    got = files.read_log(spark, log, APPLICATION_SCHEMA)
    assert got.columns == rows.columns and sorted(map(repr, got.collect())) == sorted(map(repr, rows.collect()))
