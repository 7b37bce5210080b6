"""Merges that rewrite only the files they touch."""

import pytest
from pyspark.sql import functions as F

from civicframe.sources import generations, keyed


@pytest.fixture
def store(spark, tmp_path):
    rows = spark.range(4000).select((F.col("id") % 4).alias("court"), (F.col("id") * 2).alias("number"), F.concat(F.lit("s"), F.col("id") % 7).alias("status"), F.lit(None).cast("string").alias("note"))
    return keyed.create(spark, str(tmp_path / "store"), rows, ["court", "number"], [F.col("court")], rows_per_file=250)


def contents(store):
    return {(r.court, r.number): (r.status, r.note) for r in keyed.rows(store).collect()}


def names(store):
    return {r.file for r in keyed.files(store).collect()}


def changes(spark, rows):
    return spark.createDataFrame(rows, "court long, number long, status string, note string")


def test_only_hit_files_are_rewritten(spark, store):
    before, old = contents(store), names(store)
    assert len(before) == 4000 and len(old) >= 16
    new = [(0, 0, "x", None), (0, 8, "y", "n"), (1, 3, "new", None), (None, 5, "no key", None)]
    report = keyed.merge(store, changes(spark, new))
    assert {k: report[k] for k in ("rewritten", "updated", "deleted", "inserted")} == {"rewritten": 1, "updated": 2, "deleted": 0, "inserted": 1}
    assert report["read"] <= 2  # the new key may pass a filter by chance
    assert contents(store) == before | {(0, 0): ("x", None), (0, 8): ("y", "n"), (1, 3): ("new", None)}
    assert len(old & names(store)) == len(old) - 1


def test_rows_that_do_not_differ_rewrite_nothing(spark, store):
    before, old = contents(store), names(store)
    at = generations.manifest(spark, store.meta)[0]
    report = keyed.merge(store, changes(spark, [(*k, *before[k]) for k in list(before)[:500]]))
    assert report["rewritten"] == report["updated"] == report["inserted"] == 0
    assert names(store) == old and generations.manifest(spark, store.meta)[0] == at


def test_deletes_dry_runs_and_repeated_keys(spark, store):
    before = contents(store)
    rows = changes(spark, [(0, 0, "gone", None), (2, 4, "z", None), (3, 1, "gone", None)])
    report = keyed.merge(store, rows, F.col("status") == "gone", dry_run=True)
    assert (report["rewritten"], report["updated"], report["deleted"], report["inserted"]) == (2, 1, 1, 0)
    assert contents(store) == before
    keyed.merge(store, rows, F.col("status") == "gone")
    want = before | {(2, 4): ("z", None)}
    del want[(0, 0)]
    assert contents(store) == want
    with pytest.raises(ValueError, match="two changes"):
        keyed.merge(store, changes(spark, [(0, 0, "a", None), (0, 0, "b", None)]))
    keyed.merge(store, changes(spark, []))
    assert contents(store) == want


def computed(df):
    low = F.col("number") < 300
    return df.withColumn("status", F.when(low, "old").otherwise(F.col("status"))).withColumn("note", F.when(low & (F.col("court") == 1), "noted").otherwise(F.col("note")))


def test_backfill_goes_on_where_it_broke_off(spark, store):
    before, old = contents(store), names(store)
    dry = list(keyed.backfill(store, computed, "status", batch=5))
    assert contents(store) == before and sum(r["rewritten"] for r in dry) == 4 and len(dry) >= 4
    sets = {}
    for r in dry:
        for k, v in r["changed"].items():
            sets[k] = sets.get(k, 0) + v
    assert sets == {"status": 112, "status,note": 38}
    run = keyed.backfill(store, computed, "status", batch=5, dry_run=False)
    next(run), next(run)
    run.close()  # the job breaks off after two batches
    seen = []

    def watched(df):
        seen.append(df.count())
        return computed(df)

    list(keyed.backfill(store, watched, "status", batch=5, dry_run=False))
    assert sum(seen) < 4000 - 8 * 250  # what was done is not read again
    assert contents(store) == {(c, n): (("old", "noted" if c == 1 else None) if n < 300 else v) for (c, n), v in before.items()}
    assert len(old & names(store)) == len(old) - 4
    assert list(keyed.backfill(store, computed, "status", dry_run=False)) == []


def test_empty_store(spark, tmp_path):
    rows = changes(spark, [])
    store = keyed.create(spark, str(tmp_path / "none"), rows, ["court", "number"], [F.col("court")])
    assert contents(store) == {}
    assert keyed.merge(store, changes(spark, [(1, 1, "a", None)]))["inserted"] == 1
    assert contents(store) == {(1, 1): ("a", None)}
