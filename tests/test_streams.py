import hashlib
import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from deedloom.streaming import contents, jobs, runs, windows

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def sequential(events, heartbeat, ready):
    """Ended runs of one job when its whole history is known and time goes on for ever."""
    out, run = [], None
    for sec, status in [*sorted(events), (10**9, None)]:
        if run:
            limit = min([run["last"] + heartbeat] + ([run["waits"] + ready] if run["waits"] is not None else []))
            if sec > limit:
                out.append((run["start"], limit, "failed", "Timeout", run["n"]))
                run = None
        if status is None:
            break
        run = run or {"start": sec, "waits": None, "n": 0}
        waits = status == "waiting_for_login"
        run |= {"last": sec, "n": run["n"] + 1, "waits": (sec if run["waits"] is None else run["waits"]) if waits else None}
        if status in ("completed", "failed", "cancelled"):
            out.append((run["start"], sec, status, None, run["n"]))
            run = None
    return out


def test_runs_of_jobs_over_shuffled_batches(spark, tmp_path):
    rnd = random.Random(3)
    kinds = ["pending", "waiting_for_login", "waiting_for_login", "importing_documents", "completed", "cancelled"]
    events = []
    for job in range(6):
        sec = rnd.randrange(100)
        for _ in range(40):
            events.append((f"j{job}", sec, rnd.choice(kinds)))
            sec += rnd.choice([0, 100, 150, 250, 299, 300, 301, 400])
    # one event in the far future lets all timers end
    events += [("other", 10**6, "completed"), ("other", 10**6 + 5000, "completed")]
    # out of order by less than the delay
    events.sort(key=lambda e: e[1] + rnd.random() * 500)
    src = tmp_path / "in"
    schema = "job_id string, ts timestamp, status string"
    third = len(events) // 3
    cuts = [events[:third], events[third : 2 * third], events[2 * third :]]
    store, got = str(tmp_path / "store"), None
    for part in cuts:
        rows = [(j, T0 + timedelta(seconds=s), st) for j, s, st in part] + [(None, T0, "x"), ("j1", None, "x"), ("j1", T0, None)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
        # the state of one run of the stream is taken up by the next
        got = runs.job_runs(spark.readStream.schema(schema).parquet(str(src)), folder=store)
    second = lambda c: f"(unix_micros({c}) - {int(T0.timestamp())} * 1000000L) div 1000000L as {c}"
    found = sorted(tuple(r) for r in got.where("job_id <> 'other'").selectExpr("job_id", second("started_at"), second("ended_at"), "status", "error_message", "events").collect())
    want = sorted((f"j{job}", *r) for job in range(6) for r in sequential([(s, st) for j, s, st in events if j == f"j{job}"], 300, 600))
    assert found == want and {r[4] for r in want} == {None, "Timeout"}


def test_contents_in_runs_over_many_batches(spark, tmp_path):
    fanout, rnd = 3, random.Random(5)
    schema = spark.createDataFrame([], "path string, modificationTime timestamp, content binary").schema
    index = contents.Contents(spark, schema, str(tmp_path / "index"), fanout)
    assert index.stored().count() == 0
    first, folders = {}, []
    for batch in range(10):
        # small numbers come again and again; one batch brings nothing new, one is empty, one has no content
        values = [rnd.randrange(60) for _ in range(12)] + [1000 * batch + i for i in range(5)]
        values = {6: list(first)[:5], 7: [], 8: [None]}.get(batch, values)
        rows = [(f"f{batch}-{i:02d}", T0 + timedelta(seconds=i % 4), None if v is None else str(v).encode()) for i, v in enumerate(values)]
        files = spark.createDataFrame(rows, schema)
        index.add(files, batch)
        if batch in (4, 8):
            # a batch that is run again, here after its merges
            index.add(files, batch)
        for path, at, v in sorted(rows, key=lambda r: (r[1], r[0])):
            if v is not None:
                first.setdefault(int(v), (path, batch))
        folders.append(len(list((tmp_path / "index" / "rows").glob("run=*"))))
        if batch in (8, 9):
            got = {(r.path, r.content_hash) for r in index.stored().collect()}
            assert got == {(p, hashlib.sha256(str(v).encode()).hexdigest()) for v, (p, _) in first.items()}
    # fanout - 1 of each of three sizes, and those of the last merge that the next batch deletes
    assert max(folders) <= 3 * (fanout - 1) + fanout + 1
    # wholly new contents read no run (the filters err in one of 300)
    index.add(spark.createDataFrame([("x", T0, b"new")], schema), 10)
    assert index.read_runs == []


def test_runs_cover_all_batches_once():
    for batch in range(700):
        runs = contents.cover(batch, 8)
        assert [x for a, b in runs for x in range(a, b)] == list(range(batch)) and len(runs) <= 7 * 4
        for run, parts in contents.merges(batch, 8):
            assert [x for a, b in parts for x in range(a, b)] == list(range(*run)) and run[1] == batch + 1
            assert set(parts) <= {*contents.cover(batch, 8), (batch, batch + 1), *[r for r, _ in contents.merges(batch, 8)]}


def test_windows_close_and_keep_late_rows(spark, tmp_path):
    rnd = random.Random(9)
    hour = timedelta(hours=1)
    events = [(T0 + hour * (i / 4) - hour * rnd.choice([0, 0, 1, 3, 9]), rnd.choice(["a", "b", None]), i) for i in range(200)]
    schema = "ts timestamp, stage string, n int"
    cuts = [events[:60], events[60:100], [], events[100:150], [(None, "a", -1)], events[150:]]
    ws = windows.Windows(spark, spark.createDataFrame([], schema).schema, str(tmp_path / "w"), ["stage"], "2 hours", 7200)
    newest, late, counts = None, set(), {}
    for batch, part in enumerate(cuts):
        df = spark.createDataFrame(part, schema)
        ws.add(df, batch)
        if batch in (1, 3):
            ws.add(df, batch)
        mark = newest and newest - 2 * hour
        for ts, stage, n in part:
            if ts is None:
                continue
            start = T0 + 2 * hour * ((ts - T0) // (2 * hour))
            if mark and start + 2 * hour <= mark:
                late.add(n)
            else:
                counts[start, stage] = counts.get((start, stage), 0) + 1
            newest = max(newest or ts, ts)
    closed, still, rest = ws.stored()
    rows = lambda df: {(r.window_start.astimezone(timezone.utc), r.stage): r.events for r in df.collect()}
    done, open_ = rows(closed), rows(still)
    assert {r.n for r in rest.collect()} == late and late
    assert {**done, **open_} == counts and not done.keys() & open_.keys() and done
    assert all(s + 2 * hour > newest - 2 * hour for s, _ in open_) and all(s + 2 * hour <= newest - 2 * hour for s, _ in done)
    # nothing is lost: with the late rows the counts are those of the batch
    both = windows.with_late(closed, still, rest, width="2 hours").selectExpr("sum(events + late)", "sum(late)").first()
    assert tuple(both) == (200, len(late))
    assert len(list((tmp_path / "w" / "counts").glob("batch=*"))) == 2


def test_of_job_events_at_one_time_the_first_counts(spark):
    at = lambda sec: T0 + timedelta(seconds=sec)
    ev = spark.createDataFrame(
        [("a", at(5), 1, "importing_documents"), ("a", at(5), 2, "pending"), ("b", at(5), 7, "failed"), ("b", at(5), 8, "completed"), ("b", at(5), 9, "aborted"),
         ("c", at(5), 4, "completed"), ("c", at(5), 3, "failed")],
        "job_id string, ts timestamp, seq long, status string",
    )
    got = {r.job_id: r.status for r in jobs.job_status(jobs.job_states(ev), F.lit("2024-01-01 00:00:10").cast("timestamp"), 300).collect()}
    assert got == {"a": "importing_documents", "b": "failed", "c": "failed"}
    got = {r.job_id: r.status for r in jobs.job_status(jobs.job_states(ev.withColumn("seq", -F.col("seq"))), F.lit("2024-01-01 00:00:10").cast("timestamp"), 300).collect()}
    assert got == {"a": "pending", "b": "completed", "c": "completed"}


def test_job_state_query_lets_live_jobs_wait(spark, tmp_path):
    from checks.queries import QUERIES

    rows = [(1, "2024-01-03 00:00:00", 1, "refund"), (2, "2024-01-30 12:00:00", 1, "refund"), (3, "2024-01-28 12:00:00", 2, "refund")]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string")
    events.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    got = {r.job_id: (r.status, r.error_message) for r in QUERIES["stream_job_state"](spark, str(tmp_path)).collect()}
    assert got == {"job-1": ("waiting_for_login", None), "job-2": ("failed", "Timeout")}
