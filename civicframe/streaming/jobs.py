"""A job queue as a state machine over its events, one state for each key: on a stream with keyed state and timers, on a frame as a fold.

Events (job, at, seq, event) are taken in the order of at and seq. *enqueue* makes a job unless one of this key is queued or running (then it is a duplicate); *claim* starts a queued one
that is due, with a lease; *heartbeat* renews the lease; *done* and *failed* end it; *retry* puts it back with a growing delay, or kills it after the last attempt. Whatever comes for a job that
isn't running is stale. A lease that ran out puts the job back likewise, from that moment on, whether a timer or the next event finds it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, astuple, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from civicframe.session import ship

MICROS = 1_000_000
#: Fixed values, in seconds: delays after the first attempts and after all others.
DELAYS, LAST_DELAY = (60, 300, 900), 1800
STATE = "status string, attempts int, due long, lease long, jobs int, duplicates int, stale int"
OUT = f"job string, {STATE}"


@dataclass
class Job:
    """due and lease are microseconds since 1970; 0 where there is none."""

    status: str = ""
    attempts: int = 0
    due: int = 0
    lease: int = 0
    jobs: int = 0
    duplicates: int = 0
    stale: int = 0

    def delay(self) -> int:
        return (DELAYS[self.attempts - 1] if self.attempts <= len(DELAYS) else LAST_DELAY) * MICROS

    def lapse(self, now: int, most: int) -> None:
        """The lease ran out before ``now``."""
        if self.status == "running" and self.lease < now:
            self.status = "queued" if self.attempts < most else "dead"
            self.due, self.lease = self.lease + self.delay(), 0

    def take(self, event: str, at: int, lease: int, most: int) -> None:
        self.lapse(at, most)
        running = self.status == "running"
        if event == "enqueue":
            if running or self.status == "queued":
                self.duplicates += 1
            else:
                self.status, self.attempts, self.due, self.jobs = "queued", 0, at, self.jobs + 1
        elif event == "claim":
            if self.status == "queued" and self.due <= at:
                self.status, self.attempts, self.lease = "running", self.attempts + 1, at + lease * MICROS
        elif event in ("heartbeat", "done", "failed", "retry"):
            if not running:
                self.stale += 1
            elif event == "heartbeat":
                self.lease = at + lease * MICROS
            elif event == "retry" and self.attempts < most:
                self.status, self.due, self.lease = "queued", at + self.delay(), 0
            else:
                self.status, self.lease = {"retry": "dead"}.get(event, event), 0


def _micros(times: pd.Series) -> list[int]:
    return times.astype("datetime64[us]").astype("int64").tolist()


class Queue(StatefulProcessor):
    """Emits the state of every key that an event or a lapsed lease changed. A key that has ended is forgotten once the watermark is ``retain`` seconds beyond its last event."""

    def __init__(self, lease: int, most: int, retain: int) -> None:
        self.lease, self.most, self.retain = lease, most, retain

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", STATE)

    def _read(self) -> Job:
        return Job(*self.job.get()) if self.job.exists() else Job()

    def _write(self, key: tuple, job: Job, last: int) -> Iterator[pd.DataFrame]:
        """last: microseconds of the last event."""
        self.job.update(astuple(job))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if job.status == "running":
            self.handle.registerTimer(job.lease // 1000 + 1)
        elif job.status != "queued":
            self.handle.registerTimer(last // 1000 + 1000 * self.retain)
        yield pd.DataFrame([{"job": key[0], **asdict(job)}])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        events: list[tuple[int, int, str]] = []
        for p in rows:
            events += zip(_micros(p["at"]), p["seq"].tolist(), p["event"].tolist(), strict=True)
        job = self._read()
        for at, _, event in sorted(events):
            job.take(event, at, self.lease, self.most)
        yield from self._write(key, job, max(events)[0])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        job, now = self._read(), timerValues.getCurrentWatermarkInMs() * 1000
        if job.status not in ("running", "queued"):
            self.job.clear()
        else:
            job.lapse(now, self.most)
            yield from self._write(key, job, now)

    def close(self) -> None:
        pass


def _folded(lease: int, most: int, until: int | None):
    """Of rows sorted by job and time the last state of each job; no more than one job is held at a time."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, job = None, Job()

        def ended() -> dict:
            if until is not None:
                job.lapse(until, most)
            return {"job": key, **asdict(job)}

        for p in parts:
            out = []
            for name, at, event in zip(p["job"], _micros(p["at"]), p["event"], strict=True):
                if name != key:
                    if key is not None:
                        out.append(ended())
                    key, job = name, Job()
                job.take(event, at, lease, most)
            if out:
                yield pd.DataFrame(out)
        if key is not None:
            yield pd.DataFrame([ended()])

    return run


def job_states(events: DataFrame, lease: int = 900, most: int = 3, until: int | None = None, delay: str = "10 minutes", retain: int = 86_400) -> DataFrame:
    """The state of each job of events (job, at, seq, event): job, status, attempts, due, lease, jobs, duplicates, stale.

    On a frame one row for each job, as of ``until`` (microseconds; none: as of its last event). On a stream, which needs the RocksDB state store, a row for each change, in update mode: events may be late
    by ``delay``, and leases run out as the watermark passes. lease: seconds; most: attempts. Events without a job or a time are left out; unknown events change nothing.
    """
    ship(events.sparkSession)
    rows = events.select("job", "at", "seq", "event").where("job is not null and at is not null and seq is not null and event is not null")
    if rows.isStreaming:
        return rows.withWatermark("at", delay).groupBy("job").transformWithStateInPandas(Queue(lease, most, retain), OUT, "Update", "EventTime")
    return rows.repartition("job").sortWithinPartitions("job", "at", "seq").mapInPandas(_folded(lease, most, until), OUT)
