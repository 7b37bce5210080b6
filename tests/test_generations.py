"""Stores that change as one."""

import pytest
from pyspark.sql import functions as F

from civicframe.sources import generations

COLUMNS = {"cases": "entity", "binds": "entity", "media": "owner", "search": "id"}


def contents(spark, folder):
    return {k: sorted(tuple(r) for r in df.collect()) for k, df in generations.live(spark, folder).items()}


@pytest.fixture
def folder(spark, tmp_path):
    path = str(tmp_path / "stores")
    stores = {name: spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "a")], f"k int, {column} string") for name, column in COLUMNS.items()}
    assert generations.manifest(spark, path) == (0, {})
    assert generations.commit(spark, path, stores) == 1
    return path


MAPPING = "old string, new string"


def test_merge_is_one_commit(spark, folder):
    assert generations.merge(spark, folder, spark.createDataFrame([("a", "z"), ("c", "c"), ("q", "z")], MAPPING), COLUMNS) == 2
    now = contents(spark, folder)
    assert all(now[name] == [(1, "z"), (2, "b"), (3, "c"), (4, "z")] for name in COLUMNS)
    assert now["lineage"] == [("a", "z", name, 2, "merge") for name in sorted(COLUMNS)]
    generations.merge(spark, folder, spark.createDataFrame([("b", "z")], MAPPING), COLUMNS, "again")
    assert len(contents(spark, folder)["lineage"]) == 8


def test_a_failed_store_leaves_all_as_they_were(spark, folder, monkeypatch):
    before = contents(spark, folder)
    real = generations.repointed

    def broken(stores, mapping):
        moved, counts = real(stores, mapping)
        moved["media"] = moved["media"].withColumn("owner", F.raise_error(F.lit("disk is full")).cast("string"))
        return moved, counts

    monkeypatch.setattr(generations, "repointed", broken)
    with pytest.raises(Exception, match="disk is full"):
        generations.merge(spark, folder, spark.createDataFrame([("a", "z")], MAPPING), COLUMNS)
    monkeypatch.undo()
    assert contents(spark, folder) == before and generations.manifest(spark, folder)[0] == 1
    gone = generations.pruned(spark, folder)  # what the failed commit wrote
    assert gone and contents(spark, folder) == before


def test_a_commit_between_is_a_conflict(spark, folder):
    cases = generations.live(spark, folder)["cases"]
    generations.commit(spark, folder, {"cases": cases.where("k > 1")})
    with pytest.raises(generations.Conflict):
        generations.commit(spark, folder, {"cases": cases}, since=1)
    assert len(contents(spark, folder)["cases"]) == 3
    for _ in range(2):
        generations.commit(spark, folder, {"cases": generations.live(spark, folder)["cases"]})
    generations.pruned(spark, folder, keep=1)
    assert {k: len(v) for k, v in contents(spark, folder).items()} == {"cases": 3, "binds": 4, "media": 4, "search": 4}
