"""One stream, many consumers: each has its own progress, retries and dead letters, so that one that fails or lags doesn't hold the others.

Every micro-batch is first written to a log in the shared folder; then each consumer is given what it hasn't had, in order. Its state (the batch it has reached, whole failures
of the next, the rows to be tried again) is one small file that is replaced as a whole after the handler's work, so delivery is at least once: a replay has the same rows and the same key, by which
a handler overwrites what it wrote. A batch leaves the log when all consumers have it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicframe.functions.domain import disposition
from civicframe.session import ship
from civicframe.storage import removed
from civicframe.streaming.events import routed

#: What a handler may return: the rows that it could not handle.
FAILED = "dedup_key string, error string, poison boolean"


class Poison(Exception):
    """Trying the same rows again would fail again."""


@dataclass(frozen=True)
class Consumer:
    """name; pattern of subjects (``events.routed``); handler(rows, key): it does its work, raises if none of it can be done, and may return the rows that failed (FAILED);
    most: deliveries of a row, or of a batch that fails whole, before it goes to the dead letters.

    Rows have the log's columns and ``delivered``, from 1. Failed rows come again with the next batch or ``drain``. A key failing twice in one answer counts once.
    """

    name: str
    pattern: str
    handler: Callable[[DataFrame, str], DataFrame | None]
    most: int = 5


@dataclass(frozen=True)
class State:
    batch: int = -1
    failures: int = 0
    round: int = 0
    pending: str = ""


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _children(spark: SparkSession, path: str) -> list[str]:
    p, fs = _fs(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


class Fanout:
    """For ``foreachBatch``: ``stream.writeStream.foreachBatch(Fanout(spark, folder, consumers))``. Names of consumers are unique; one that is new begins with the oldest batch of the log."""

    def __init__(self, spark: SparkSession, folder: str, consumers: Sequence[Consumer]):
        if len({c.name for c in consumers}) < len(consumers):
            raise ValueError("two consumers of one name")
        self.spark, self.folder, self.consumers = spark, folder, list(consumers)
        ship(spark)

    def __call__(self, batch: DataFrame, number: int) -> None:
        if number not in self._logged() and all(self.state(c.name).batch < number for c in self.consumers):
            batch.write.mode("overwrite").parquet(f"{self.folder}/log/{number:09d}")
        self.deliver()

    def _logged(self) -> list[int]:
        """Batches that were written whole."""
        names = _children(self.spark, f"{self.folder}/log")
        return [int(b) for b in names if b.isdigit() and "_SUCCESS" in _children(self.spark, f"{self.folder}/log/{b}")]

    def _states(self, name: str) -> list[int]:
        return [int(f) for f in _children(self.spark, f"{self.folder}/progress/{name}") if f.isdigit()]

    def state(self, name: str) -> State:
        known = self._states(name)
        if not known:
            return State()
        p, fs = _fs(self.spark, f"{self.folder}/progress/{name}/{known[-1]:09d}")
        stream = fs.open(p)
        try:
            return State(**json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def _save(self, name: str, state: State) -> None:
        known = self._states(name)
        folder = f"{self.folder}/progress/{name}"
        draft, fs = _fs(self.spark, f"{folder}/.{uuid.uuid4().hex}")
        stream = fs.create(draft, False)
        stream.write(bytearray(json.dumps(asdict(state)).encode()))
        stream.close()
        if not fs.rename(draft, _fs(self.spark, f"{folder}/{known[-1] + 1 if known else 0:09d}")[0]):
            raise RuntimeError(f"{name}: another run has saved its progress")
        for old in known[:-1]:
            fs.delete(_fs(self.spark, f"{folder}/{old:09d}")[0], False)

    def deliver(self) -> None:
        """Gives every consumer the batches it hasn't had, all consumers at once, and removes from the log what all have."""
        logged = self._logged()
        with ThreadPoolExecutor(max(1, len(self.consumers))) as pool:
            list(pool.map(lambda c: self._catch_up(c, logged), self.consumers))
        reached = min((self.state(c.name).batch for c in self.consumers), default=-1)
        for b in logged:
            if b <= reached:
                removed(self.spark, f"{self.folder}/log/{b:09d}")

    def _catch_up(self, consumer: Consumer, logged: list[int]) -> None:
        for b in logged:
            state = self.state(consumer.name)
            if b > state.batch and not self._step(consumer, state, b):
                return

    def drain(self) -> None:
        """Delivers batches that were left, then failed rows, without a new batch, until nothing is open."""
        while True:
            self.deliver()
            logged, states = self._logged(), [(c, self.state(c.name)) for c in self.consumers]
            for c, s in states:
                if s.pending and not any(b > s.batch for b in logged):
                    self._step(c, s, None)
            if not logged and not any(s.pending for _, s in states):
                return

    def _step(self, consumer: Consumer, state: State, batch: int | None) -> bool:
        """One delivery; whether the consumer is past it."""
        spark, rows = self.spark, None
        if batch is not None:
            rows = spark.read.parquet(f"{self.folder}/log/{batch:09d}").where(routed("subject", consumer.pattern)).withColumn("delivered", F.lit(1))
        if state.pending:
            again = spark.read.parquet(state.pending).withColumn("delivered", F.col("delivered") + 1)
            rows = again if rows is None else rows.unionByName(again)
        key = f"{state.batch + 1 if batch is None else batch:09d}" + (f"-again-{state.round:03d}" if batch is None else "")
        after = State(state.batch, 0, state.round + 1) if batch is None else State(batch)
        dead, pending = f"{self.folder}/dead/{consumer.name}/{key}", f"{self.folder}/pending/{consumer.name}/{key}-{uuid.uuid4().hex}"
        try:
            failed = consumer.handler(rows, key)
        except Exception as e:  # a failure of the handler is told by its state and its dead letters, and isn't one of the stream
            if not isinstance(e, Poison) and state.failures + 1 < consumer.most:
                self._save(consumer.name, replace(state, failures=state.failures + 1))
                return False
            rows.withColumn("error", F.lit(f"{type(e).__name__}: {e}"[:1000])).write.mode("overwrite").parquet(dead)
            self._save(consumer.name, after)
            return True
        if failed is not None:
            why = failed.groupBy("dedup_key").agg(F.min("error").alias("error"), F.bool_or(F.coalesce("poison", F.lit(False))).alias("_poison"))
            judged = rows.join(why, "dedup_key").withColumn("_to", disposition(F.lit(True), F.col("_poison"), F.col("delivered"), consumer.most))
            judged.where("_to = 'dead_letter'").drop("_to", "_poison").write.mode("overwrite").parquet(dead)
            left = judged.where("_to = 'retry'").drop("_to", "_poison", "error")
            left.write.mode("overwrite").parquet(pending)
            if not spark.read.schema(left.schema).parquet(pending).isEmpty():
                after = replace(after, pending=pending)
        self._save(consumer.name, after)
        return True

    def dead_letters(self, name: str) -> DataFrame | None:
        """The rows that a consumer gave up, with ``error``; None if it never did."""
        keys = _children(self.spark, f"{self.folder}/dead/{name}")
        return self.spark.read.parquet(*(f"{self.folder}/dead/{name}/{k}" for k in keys)) if keys else None
