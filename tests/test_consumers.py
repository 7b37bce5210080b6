"""One stream to several consumers."""

import os

import pytest
from pyspark.sql import functions as F

from civicframe.streaming.consumers import Consumer, Fanout, Poison

EVENT = "subject string, dedup_key string, v int"


def events(spark, first, n=6):
    return spark.createDataFrame([("case.new" if i % 2 else "case.closed.won", f"k{i}", i) for i in range(first, first + n)], EVENT)


class Sink:
    """A handler that writes by key, after failing as it is told."""

    def __init__(self, path, fail=()):
        self.path, self.fail, self.keys = str(path), list(fail), []

    def __call__(self, rows, key):
        self.keys.append(key)
        if self.fail and (e := self.fail.pop(0)):
            raise e
        rows.write.mode("overwrite").parquet(f"{self.path}/{key}")

    def rows(self, spark):
        return sorted(r.v for r in spark.read.parquet(*(f"{self.path}/{k}" for k in os.listdir(self.path))).collect())


def test_a_failing_consumer_does_not_hold_the_others(spark, tmp_path):
    good, bad = Sink(tmp_path / "good"), Sink(tmp_path / "bad", [None, OSError("down"), OSError("down")])
    fan = Fanout(spark, str(tmp_path / "log"), [Consumer("good", "case.>", good), Consumer("bad", "case.new", bad)])
    for b in range(3):
        fan(events(spark, 6 * b), b)
    assert good.rows(spark) == list(range(18))
    assert bad.rows(spark) == [1, 3, 5] and fan.state("bad").batch == 0 and fan.state("bad").failures == 2
    assert fan._logged() == [1, 2]  # kept for the one that lags
    fan.drain()
    assert bad.rows(spark) == list(range(1, 18, 2)) and bad.keys == ["000000000"] + ["000000001"] * 3 + ["000000002"]
    assert good.keys == ["000000000", "000000001", "000000002"] and fan._logged() == []
    assert fan.dead_letters("bad") is None


def test_a_replay_delivers_nothing_twice(spark, tmp_path):
    sink, late = Sink(tmp_path / "a"), Sink(tmp_path / "b")
    folder = str(tmp_path / "log")
    Fanout(spark, folder, [Consumer("a", "case.>", sink)])(events(spark, 0), 0)
    fan = Fanout(spark, folder, [Consumer("a", "case.>", sink)])  # the driver starts again
    fan(events(spark, 0), 0)
    assert sink.keys == ["000000000"]
    fan = Fanout(spark, folder, [Consumer("a", "case.>", sink), Consumer("b", "case.closed.*", late)])
    fan(events(spark, 6), 1)
    assert late.rows(spark) == [6, 8, 10] and sink.rows(spark) == list(range(12))
    with pytest.raises(ValueError, match="one name"):
        Fanout(spark, folder, [Consumer("a", "x", sink)] * 2)


def test_poison_and_given_up_batches_go_to_the_dead_letters(spark, tmp_path):
    poison, broken = Sink(tmp_path / "p", [Poison("no such form")]), Sink(tmp_path / "b", [OSError("down")] * 9)
    fan = Fanout(spark, str(tmp_path / "log"), [Consumer("p", "case.new", poison), Consumer("b", "case.>", broken, most=2)])
    fan(events(spark, 0), 0)
    fan.drain()
    dead = fan.dead_letters("p").collect()
    assert sorted(r.v for r in dead) == [1, 3, 5] and {r.error for r in dead} == {"Poison: no such form"}
    assert fan.dead_letters("b").count() == 6 and broken.keys == ["000000000"] * 2


def test_rows_fail_alone(spark, tmp_path):
    seen = []

    def handler(rows, key):
        seen.append(sorted((r.v, r.delivered) for r in rows.collect()))
        bad = rows.where("v % 3 = 0 and not (v = 3 and delivered = 2)")
        return bad.select("dedup_key", F.lit("odd").alias("error"), (F.col("v") == 6).alias("poison"))

    fan = Fanout(spark, str(tmp_path / "log"), [Consumer("c", "case.>", handler, most=3)])
    fan(events(spark, 0), 0)
    fan(events(spark, 6, 2), 1)
    fan.drain()
    assert seen == [[(v, 1) for v in range(6)], [(0, 2), (3, 2), (6, 1), (7, 1)], [(0, 3)]]
    assert sorted((r.v, r.delivered, r.error) for r in fan.dead_letters("c").collect()) == [(0, 3, "odd"), (6, 1, "odd")]


def test_on_a_stream(spark, tmp_path):
    for i in range(3):
        events(spark, 6 * i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    good, bad = Sink(tmp_path / "good"), Sink(tmp_path / "bad", [OSError("down")])
    fan = Fanout(spark, str(tmp_path / "log"), [Consumer("good", "case.>", good), Consumer("bad", "case.>", bad)])

    def run():
        stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        stream.writeStream.foreachBatch(fan).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()

    run()
    assert good.rows(spark) == bad.rows(spark) == list(range(18))
    events(spark, 18).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert good.rows(spark) == list(range(24))
