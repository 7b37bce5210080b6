"""The index gives the scan's scores and reads the query's terms."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from civicframe.operators import postings, search

WORDS = [f"w{i}" for i in range(40)] + ["red", "plate", "दा", "w1"]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(7)
    made = [(i, rng.choice(["case", "entity", None]), " ".join(rng.choices(WORDS, k=rng.randrange(0, 30))), rng.choice([None, "Red plate", "plate red red  plate", "w3"])) for i in range(900)]
    made.append((5000, "case", "red " * 3000, "red"))
    return spark.createDataFrame(made, "id long, type string, body string, title_en string").repartition(4)


@pytest.fixture(scope="module")
def index(spark, docs, tmp_path_factory):
    return postings.build(docs, "id", ["body", "title_en"], str(tmp_path_factory.mktemp("index")), "type", block=64, buckets=16)


@pytest.mark.parametrize("tokens", [["red"], ["w3", "दा", "plate"], ["nothing"], ["red", "nothing", "w39"]])
@pytest.mark.parametrize("k", [1, 10, 2000])
def test_best_equals_a_scan(docs, index, tokens, k):
    scan = search.bm25(docs, "id", {"body": 1.0, "title_en": 2.0}, tokens).withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "id").limit(k)
    got = postings.best(index, {"body": 1.0, "title_en": 2.0}, tokens, k, first=2)
    assert [(r.key, pytest.approx(r.score, abs=2e-6)) for r in got.collect()] == [(r.id, r.score) for r in scan.collect()]


@pytest.mark.parametrize("query", ["Red", "red plate", "plate red w3 red", "w1 w2"])
def test_weighted_equals_a_scan(docs, index, query):
    want = {r.id: round(r.score, 6) for r in search.search(docs, query, "en").collect()}
    assert {r.key: round(r.score, 6) for r in postings.weighted(index, query, "en", ["body", "title_en"]).collect()} == want


def test_only_the_terms_are_read(index):
    plan = index.postings(["red", "plate"])._jdf.queryExecution().explainString(index.spark.sparkContext._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    filters = {k: next(x for x in plan.splitlines() if k in x) for k in ("PartitionFilters", "PushedFilters")}
    assert all(str(postings.bucket(t, 16)) in filters["PartitionFilters"] for t in ("red", "plate"))  # no other bucket's folder is opened
    assert "In(term, [plate,red])" in filters["PushedFilters"]  # nor other row groups of theirs


def test_phrases(index):
    assert {r.n for r in postings.phrases(index, "title_en", ["plate", "red"]).collect()} == {1}
    assert {r.n for r in postings.phrases(index, "body", ["red", "red"]).where("key = 5000").collect()} == {2999}


def shuffled(spark):
    """Bytes that the session's stages have written to shuffles."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_a_build_keeps_words_once(spark, docs, tmp_path):
    """Neither texts nor postings are shuffled, or stored beside the index."""
    before = shuffled(spark)
    postings.build(docs, "id", ["body", "title_en"], str(tmp_path), "type")
    rows = docs.repartition(1).write.mode("overwrite")
    dealt = shuffled(spark) - before
    rows.format("noop").save()  # the texts themselves, which the fixture deals out anew for each pass over them
    passes = (dealt - 20_000) / (shuffled(spark) - before - dealt)
    assert passes < 2.1  # one to count words, one to write
    assert {p.name for p in tmp_path.iterdir()} == {"fields", "postings"}


@pytest.mark.parametrize("sizes", [[], [0], [5], [0, 3, 0, 9, 1], [64] * 3, [200]])
@pytest.mark.parametrize("limit", [1, 7, 50, 1 << 22])
def test_blocks_end_at_documents_or_bytes(monkeypatch, sizes, limit):
    monkeypatch.setattr(postings, "BYTES", limit)
    rng, made, at = random.Random(1), [], 0
    for n in sizes:
        words = [["w" * rng.choice([1, 2, 5, 60]) for _ in range(n)] for _ in range(2)]
        arrays = [pa.array(range(at, at + n), pa.int64()), pa.nulls(n, pa.string()), *(pa.array(w, pa.string()) for w in words)]
        made.append(pa.RecordBatch.from_arrays(arrays, names=["key", "kind", "_0", "_1"]))
        at += n
    blocks = [pa.Table.from_batches(b).to_pylist() for b in postings._blocks(iter(made), 64)]
    assert [r["key"] for b in blocks for r in b] == [*range(at)]
    counts = [[len(r["_0"]) + len(r["_1"]) for r in b] for b in blocks]
    assert all(0 < len(c) <= 64 and (sum(c) <= limit or len(c) == 1) for c in counts)
    assert all(len(c) == 64 or sum(c) + after[0] > limit for c, after in zip(counts, counts[1:]))  # no block ends sooner


def test_keys_and_kinds_of_other_types(spark, tmp_path):
    df = spark.createDataFrame([("x", 1, "red red"), ("é", None, None), ("", 2, "blue \x0b red")], "k string, c int, body string")
    index = postings.build(df, "k", ["body"], str(tmp_path), "c")
    assert sorted((r.term, r.key, r.kind, r.len, r.places, r.tf) for r in index.postings(["red", ""]).collect() if r.term) == [("red", "", 2, 2, [1], 1), ("red", "x", 1, 2, [0, 1], 2)]
    assert [(r.key, r.len) for r in index.postings([""]).collect()] == [("é", 1)]
    assert [(r.term, r.n) for r in index.blocks(["blue"]).collect()] == [("blue", 1)]
