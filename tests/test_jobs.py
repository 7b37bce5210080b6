"""The job queue: its rules, the fold, and the same on a stream with timers."""

import datetime as dt
import random

import pytest

from civicframe.streaming import jobs

SCHEMA = "job string, at timestamp, seq long, event string"
START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def folded(spark, events, **how):
    df = spark.createDataFrame([(j, at(t), i, e) for i, (j, t, e) in enumerate(events)], SCHEMA)
    return {r.job: r for r in jobs.job_states(df, **how).collect()}


@pytest.mark.parametrize(
    ("events", "want"),
    [
        ([(0, "enqueue"), (1, "enqueue"), (2, "claim"), (3, "enqueue")], ("running", 1, 1, 2, 0)),  # a live key takes no second job
        ([(0, "enqueue"), (1, "claim"), (2, "done"), (3, "enqueue")], ("queued", 0, 2, 0, 0)),  # an ended one is free again
        ([(0, "enqueue"), (1, "claim"), (50, "heartbeat"), (140, "done")], ("done", 1, 1, 0, 0)),
        ([(0, "enqueue"), (1, "claim"), (140, "done")], ("queued", 1, 1, 0, 1)),  # the lease of 100 s ran out: a zombie's result is refused
        ([(0, "enqueue"), (1, "claim"), (2, "retry"), (61, "claim")], ("queued", 1, 1, 0, 0)),  # not due yet
        ([(0, "enqueue"), (1, "claim"), (2, "retry"), (62, "claim"), (63, "retry")], ("dead", 2, 1, 0, 0)),
        ([(0, "enqueue"), (1, "claim"), (2, "failed"), (3, "done")], ("failed", 1, 1, 0, 1)),
        ([(0, "claim"), (1, "what")], ("", 0, 0, 0, 0)),
    ],
)
def test_rules(events, want):
    job = jobs.Job()
    for t, e in events:
        job.take(e, t * jobs.MICROS, 100, 2)
    assert (job.status, job.attempts, job.jobs, job.duplicates, job.stale) == want


def some_events(n):
    rng = random.Random(n)
    kinds = ["enqueue", "claim", "claim", "heartbeat", "done", "failed", "retry"]
    return [(f"j{rng.randrange(12)}", t, rng.choice(kinds)) for t in sorted(rng.randrange(20_000) for _ in range(n))]


def test_fold(spark):
    events = some_events(800)
    want = {}
    for j, t, e in events:
        want.setdefault(j, jobs.Job()).take(e, int(at(t).timestamp()) * jobs.MICROS, 900, 3)
    got = folded(spark, events)
    assert {j: tuple(r)[1:] for j, r in got.items()} == {j: tuple(vars(s).values()) for j, s in want.items()}
    assert folded(spark, []) == {}
    odd = spark.createDataFrame([(None, at(0), 1, "enqueue"), ("a", None, 1, "enqueue"), ("a", at(1), 2, None), ("b", at(1), 1, "enqueue")], SCHEMA)
    assert [r.job for r in jobs.job_states(odd).collect()] == ["b"]


def test_stream_equals_fold(spark, tmp_path):
    events = [*some_events(300), ("late", 21_000, "enqueue"), ("late", 21_001, "claim"), ("clock", 40_000, "enqueue")]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    got = {}

    def collect(batch, _):
        got.update({r.job: r for r in batch.collect()})

    for part in range(3):
        rows = [(j, at(t), i, e) for i, (j, t, e) in enumerate(events) if min(2, t // 8000) == part]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = jobs.job_states(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), retain=10**9)
        q = stream.writeStream.outputMode("update").foreachBatch(collect).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination(120)  # each part goes on from the state that the one before left
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    want = folded(spark, events, until=int(at(40_000 - 600).timestamp()) * jobs.MICROS)
    assert {j: tuple(r) for j, r in got.items()} == {j: tuple(r) for j, r in want.items()}
    assert got["late"].status == "queued" and got["late"].attempts == 1  # by a timer alone
