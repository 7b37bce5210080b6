"""Ordinals over ranges against a plain sort."""

import random

import pytest
from pyspark.sql import functions as F

from civicframe.operators.numbering import numbered


@pytest.mark.parametrize("by", [None, "g"])
def test_numbered_is_a_sort(spark, by):
    rng = random.Random(3)
    groups = ["hot"] * 6 + ["a", "b", None]
    rows = [(rng.choice(groups), rng.choice([None, 1, 2, 3, 4]), i % 700) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, k int, v int").repartition(7)
    got = numbered(df, [F.asc_nulls_first("k"), "v"], by).collect()
    assert sorted((r.g or "", r.k or 0, r.v) for r in got) == sorted((g or "", k or 0, v) for g, k, v in rows)
    of = {}
    for r in got:
        of.setdefault(r.g if by else 0, []).append(r)
    for part in of.values():
        part.sort(key=lambda r: r.ordinal)
        assert [r.ordinal for r in part] == [*range(1, len(part) + 1)]
        keys = [(r.k is not None, r.k or 0, r.v) for r in part]
        assert keys == sorted(keys)


def test_a_group_over_many_tasks(spark):
    df = spark.range(5000).selectExpr("cast(id = 4000 as int) g", "id")
    got = {r.id: r.n for r in numbered(df, [F.desc("id")], "g", "n", 0).collect()}
    assert got[4000] == 0
    assert all(got[i] == 4999 - i - (i < 4000) for i in range(5000) if i != 4000)
    same = numbered(spark.range(3000).selectExpr("7 k"), ["k"]).collect()  # one row, repeated
    assert sorted(r.ordinal for r in same) == [*range(1, 3001)]


def test_numbered_odd_tables(spark):
    empty = spark.createDataFrame([], "g int, k int")
    assert numbered(empty, ["k"]).collect() == [] == numbered(empty, ["k"], "g").collect()
    with pytest.raises(ValueError, match="_row"):
        numbered(empty.withColumn("_row", F.lit(1)), ["k"])
    again = numbered(spark.createDataFrame([(5, 9)], "k int, ordinal int"), ["k"])
    assert [tuple(r) for r in again.collect()] == [(5, 1)]


def test_shards_in_one_order(spark, tmp_path):
    from civicframe.sources.readers import in_order, shards

    rows = [(f"d{i % 3}", i, i * 7 % 50) for i in range(300)]
    spark.createDataFrame(rows, "doc string, k int, page int").repartition(5).write.parquet(f"{tmp_path}/tables/body")
    spark.createDataFrame(rows, "doc string, k int, page int").repartition(2).write.parquet(f"{tmp_path}/other/body.parquet")
    want = {k: (i + 1) for i, (_, _, k) in enumerate(sorted((d, p, k) for d, k, p in rows))}
    for folder in ("tables", "other"):
        got = in_order(shards(spark, f"{tmp_path}/{folder}", "body"), "doc", ["page", "k"]).collect()
        assert {r.k: r.place for r in got} == want
        assert {r.k: r.ordinal for r in got} == {k: p - 100 * int(d[1]) for d, k, _ in rows for p in [want[k]]}
