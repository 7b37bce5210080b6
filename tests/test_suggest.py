"""Did-you-mean by hand-made vocabularies."""

from pyspark.sql import functions as F

from civicframe.operators import suggest

HELD = [(1, "nepal"), (1, "telecom"), (2, "nepali"), (2, "congress"), (3, "nepal"), (3, "bank"), (4, "telecoms")]
AUTHORITY = {"nepal": 2, "telecom": 1, "nepali": 1, "congress": 1, "bank": 1, "telecoms": 9}


def suggestions(spark, queries):
    held = spark.createDataFrame(HELD, "doc int, word string")
    voc = held.groupBy("word").agg(F.count("*").alias("freq")).join(spark.createDataFrame([*AUTHORITY.items()], "word string, authority int"), "word")
    asked = spark.createDataFrame([(q, q.split()) for q in queries], "query_id string, tokens array<string>")
    return {r.query_id: r.suggestion for r in suggest.did_you_mean(asked, voc, held).collect()}


def test_did_you_mean(spark):
    got = suggestions(spark, ["nepl telecm", "nepal bank", "nepall", "nepal congress", "xqzw", "", "bank bnk", "nepl telecmo zz"])
    assert got["nepl telecm"] == "nepal telecom"  # telecoms has more authority, but no document with nepal
    assert "nepal bank" not in got  # it finds something
    assert got["nepall"] == "nepal"  # authority before all
    assert got["nepal congress"] == "nepali congress"  # known words that don't go together
    assert not {"xqzw", ""} & set(got)
    assert "nepl telecmo zz" not in got  # zz stays, and nothing holds it


def test_more_combinations_than_are_kept(spark):
    words = [("a", f"w{i}", i % 3, 10 - i, 1) for i in range(5)] + [("b", f"v{i}", 0, i, i % 2) for i in range(5)]
    df = spark.createDataFrame(words, "token string, word string, distance long, freq long, authority long")
    q = spark.createDataFrame([(1, ["a", "b", "c"])], "query_id int, tokens array<string>")
    every = sorted((-x[4] - y[4], x[2] + y[2], -x[3] - y[3], f"{x[1]} {y[1]} c") for x in words[:5] for y in words[5:])
    got = {r.place: " ".join(r.words) for r in suggest.combinations(q, df, 7).collect()}
    assert got == {i + 1: e[3] for i, e in enumerate(every[:7])}
