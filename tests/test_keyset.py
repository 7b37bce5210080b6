"""A relational source by keyset pages, against a small database."""

import sqlite3

import pytest

from civicframe.sources import keyset

QUERY = "select c.*, ct.kind from cases c left join courts ct on ct.id = c.court"
SCHEMA = "court string, number string, title string, kind string"


def filled(path, rows):
    with sqlite3.connect(path) as db:
        db.execute("create table if not exists courts (id text, kind text)")
        db.execute("create table if not exists cases (seq integer, court text, number text, title text)")
        if not db.execute("select count(*) from courts").fetchone()[0]:
            db.executemany("insert into courts values (?, ?)", [("a", "high"), ("b", "district")])
        db.executemany("insert into cases values (?, ?, ?, ?)", rows)


def cases(first, count):
    return [(i, "abc"[i % 3], f"{i:05d}", None if i % 5 == 0 else f"t{i}") for i in range(first, first + count)]


def options(path, **more):
    return {"module": "sqlite3", "dsn": str(path), "query": QUERY, "key": "court, number", "mark": "?", **{k: str(v) for k, v in more.items()}}


def want(first, count):
    return sorted((c, n, t or "", {"a": "high", "b": "district"}.get(c, "")) for _, c, n, t in cases(first, count))


def got(df):
    return sorted(tuple(v or "" for v in r) for r in df.collect())


@pytest.mark.parametrize(("partitions", "page"), [(1, 1000), (4, 7), (400, 5), (3, 1)])
def test_every_row_once(spark, tmp_path, partitions, page):
    path = tmp_path / "db"
    filled(path, cases(0, 100) + [(999, None, "1", "no key")])
    keyset.register(spark)
    df = spark.read.format("keyset").schema(SCHEMA).options(**options(path, partitions=partitions, page=page)).load()
    assert got(df) == want(0, 100)
    assert df.rdd.getNumPartitions() == min(partitions, 100)
    assert got(df.where("court = 'c'").select("number", "kind")) == sorted((f"{i:05d}", "") for i in range(2, 100, 3))


def test_columns_without_the_key_and_an_empty_table(spark, tmp_path):
    path = tmp_path / "db"
    filled(path, [])
    keyset.register(spark)
    read = spark.read.format("keyset").options(**options(path, partitions=3, page=4))
    assert read.schema(SCHEMA).load().collect() == []
    filled(path, cases(0, 20))
    assert sorted(r.title or "" for r in read.schema("title string").load().collect()) == sorted(t or "" for *_, t in cases(0, 20))


def test_a_restart_reads_the_rest_once(spark, tmp_path):
    path, out = tmp_path / "db", str(tmp_path / "out")
    filled(path, cases(0, 50))
    keyset.register(spark)
    fail = []

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        if fail:
            raise OSError(fail.pop())

    def run():
        stream = spark.readStream.format("keyset").schema(f"seq long, {SCHEMA}").options(**options(path, partitions=3, page=8) | {"key": "seq"}).load()
        q = stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "check")).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    def rows():
        return got(spark.read.parquet(out).select("court", "number", "title", "kind"))

    run()
    assert rows() == want(0, 50)
    filled(path, cases(50, 30))
    fail.append("disk is full")
    with pytest.raises(Exception, match="disk is full"):
        run()
    filled(path, cases(80, 10))
    run()  # the batch that failed again, with its own rows, then those behind it
    assert rows() == want(0, 90)
    run()
    assert rows() == want(0, 90)
