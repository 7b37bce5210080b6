"""Pages, envelopes and the checks of whole stores by examples and plain versions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from civicframe.functions import text as tx
from civicframe.operators import review, search, upsert
from civicframe.sources import pages, sinks
from civicframe.streaming import events as ev


def read(spark, htmls, f):
    df = spark.createDataFrame(list(enumerate(htmls)), "i int, html string")
    return [r.v for r in df.select("i", f("html").alias("v")).orderBy("i").collect()]


def test_pages(spark):
    htmls = [None, "", "<p>a<script>var x='<td>y</td>'</script>b", "<h1>A &amp; <b>B</b></h1><table><tr><td>1<td>2<tr><td>3</td></table><h1>no</h1><a href='x.pdf'>", "<td>loose"]
    got = read(spark, htmls, pages.page)
    assert [(p.title, p.text, p.rows, p.links) for p in got] == [
        ("", "", [], []), ("", "", [], []), ("", "a b", [], []), ("A & B", "A & B 1 2 3 no", [["1", "2"], ["3"]], ["x.pdf"]), ("", "loose", [["loose"]], []),
    ]
    deep = read(spark, ["<div>" * 50_000 + "<td>x"], pages.page)[0]
    assert deep.rows == [["x"]]


def test_label_values(spark):
    html = ["<tr><td>No:</td><td></td><td>7</td><td>Office</td><td>No</td><td>8</td></tr>", "<td>Office</td><td>", "x", None]
    got = read(spark, html, lambda x: pages.label_values(pages.page(x), {"No": "no", "Office": "office"}))
    assert got == [{"no": "7"}, {}, {}, {}]


def test_press_release(spark):
    html = ["<h1>T</h1>मिति २०८१/५/७ गते <a href='/A.PDF'>", "<h1>2080.1.2</h1>", None]
    got = read(spark, html, pages.press_release)
    assert [(r.title, r.date, r.files) for r in got] == [("T", "2081-05-07", ["/A.PDF"]), ("2080.1.2", "2080-01-02", []), ("", None, [])]


def test_envelopes(spark):
    lines = ['{"entity_prefix": "p", "entity_data": {"a": [1, {"b": null}]}, "sources": ["u", {"url": "v", "authority": "w"}]}', '{"@id": "x", "n": {"z": 1}}', '{"entity_data": {"entity_prefix": "q"}}', '{"n": 1}', "[]", "", None, "{bad", '{"entity_prefix": ""}']
    rows = pages.entity_records(spark.createDataFrame(list(enumerate(lines)), "i int, value string"), keep=["i"]).orderBy("i").collect()
    assert [r.prefix for r in rows] == ["p", None, "q"] + [None] * 6
    assert [r.data and json.loads(r.data) for r in rows] == [{"a": [1, {"b": None}]}, {"@id": "x", "n": {"z": 1}}, {"entity_prefix": "q"}] + [None] * 6
    assert [r.problem for r in rows[3:]] == ["neither prefix nor id", "not an object", "not an object", "not an object", "not an object", "neither prefix nor id"]
    assert [tuple(s) for s in rows[0].sources] == [("u", None), ("v", "w")]


def test_ceiling(spark):
    rows = spark.range(10)
    assert tuple(review.under_ceiling(rows, F.col("id") < 5, 0.5).first()) == (10, 5, 0.5)
    assert tuple(review.under_ceiling(rows.limit(0), F.col("id") < 5, 0.5).first()) == (0, 0, 0.0)
    assert review.under_ceiling(rows, F.col("id") < 9, 0.5, 11).first().rate == 0.9
    with pytest.raises(Exception, match="too many truncated rows: 6 of 10"):
        review.under_ceiling(rows, F.col("id") < 6, 0.5).collect()


def test_evaluation(spark):
    truth = spark.createDataFrame([("a", "C", False), ("a", "C", False), ("b", "A", False), ("b", "C", False), ("c", "A", True), ("d", "A", False), ("e", "C", False), ("f", None, False)], "case_number string, verdict string, derived boolean")
    got = review.evaluated(truth, spark.createDataFrame([("a", "C"), ("c", "A"), ("d", None)], "case_number string, verdict string"))
    assert {tuple(r) for r in got.collect()} == {("C", "C", 1), ("A", "abstained", 1), ("C", "missing", 1)}
    assert tuple(review.accuracy(got).first()) == (3, 1, 1, 0.6667, 1.0)
    assert tuple(review.accuracy(got.limit(0)).first()) == (0, 0, 0, None, None)


def test_rebuilt(spark):
    cases = spark.createDataFrame([(1, ["Graft", "old", "x"]), (2, ["graft"]), (3, None), (4, ["old"]), (5, ["graft-id", "GRAFT"])], "case_id int, tags array<string>")
    aliases = spark.createDataFrame([("graft", "graft-id", None), ("graft id", "graft-id", None), ("old", None, "dropped")], "key string, tag string, reason string")
    report, new = review.rebuilt(cases, aliases, spark.createDataFrame([("graft-id", None)], "id string, merged_into string"))
    assert {r.case_id: r.tags for r in new.collect()} == {1: ["graft-id", "x"], 2: ["graft-id"], 4: [], 5: ["graft-id"]}
    assert {(r.resolution, r.raw): r.n for r in report.collect()} == {("canonical", "Graft"): 1, ("canonical", "graft"): 1, ("canonical", "GRAFT"): 1, ("canonical", "graft-id"): 1, ("retired", "old"): 2, ("unknown", "x"): 1}


def test_document_hits(spark):
    p = spark.createDataFrame([("d", 1, "Bribery case"), ("d", 3, "nothing"), ("d", 12, "a vaari list"), ("e", 3, None)], "document string, page_no int, text string")
    t = spark.createDataFrame([("d", 1, "t1", "bribery sums"), ("d", 3, "t2", None)], "document string, page_no int, key string, text string")
    hits = lambda q, most=9: [(r.document, r.page_no, r.kind, r.total, r.by) for r in review.document_hits(p, t, t.limit(0), q, most).orderBy("document", "place").collect()]
    assert hits("3") == [("d", 3, "page", 1, "folio"), ("e", 3, "page", 1, "folio")]
    assert hits("BRIBERY") == [("d", 1, "page", 2, "literal"), ("d", 1, "table", 2, "literal")]
    assert hits("bribery", 1) == [("d", 1, "page", 2, "literal")]
    assert hits("bhari list") == [("d", 12, "page", 1, "sound")] and hits("bhora") == []
    assert hits("nothing 3") == [("d", 3, "page", 1, "words and folio")]
    assert hits("  ") == [] and hits("nothing 4") == []


def test_duplicate_persons(spark):
    rows = [("p-q123", " Ram  Rai", "x"), ("p2", "ram rai", "see Q123"), ("p3", "ram rai", "Q12"), ("p4", "Sita", "Q123"), ("p5", "", "Q123"), ("p6", None, None)]
    got = review.duplicate_persons(spark.createDataFrame(rows, "iri string, name_en string, ids string")).collect()
    assert [tuple(r) for r in got] == [("p-q123", "p2", "Q123")]


def test_detected(spark):
    base = "https://r.example/courtcase/"
    rows = [
        ([base + "special/1", base + "patanhc/2"], ["VERDICT"], None, "verdict", True), ([base + "supreme/081-cr-1"], ["CHARGE_SHEET"], "x", "extended", True), ([base + "supreme/075-wo-1"], ["CHARGE_SHEET"], None, "other", False),
        (None, ["PRESS_RELEASE"], None, "basic", False), (None, None, None, "other", False), ([base + "special/1"], [], "laundering", "other", False),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, iris array<string>, kinds array<string>, offence string, want string, number boolean")
    for r in df.select("*", review.detected("iris", "kinds", "offence", ["LAUNDERING"]).alias("d")).collect():
        assert (r.d.type, r.d.needs_number) == (r.want, r.number), r


def test_generations(spark, tmp_path):
    folder = str(tmp_path)
    docs = spark.createDataFrame([(1,), (2,)], "k int")
    sinks.rebuild(spark, docs, folder, 1, None)
    sinks.point(spark, folder, 1)
    sinks.rebuild(spark, docs.limit(1), folder, 2, docs)
    assert sinks.live(spark, folder, docs.schema).count() == 2  # built, not live yet
    sinks.point(spark, folder, 2)
    assert sinks.live(spark, folder, docs.schema).count() == 1
    sinks.point(spark, folder, 1)
    assert sinks.live(spark, folder, docs.schema).count() == 2


def test_clipped(spark):
    texts = ["short", "a long sentence here", "unbreakablelongword", "a verylongwordhere", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    got = [r.c for r in df.select("i", tx.clipped("x", 10).alias("c")).orderBy("i").collect()]
    assert got == ["short", "a long…", "unbreakab…", "a verylon…", None, ""]


def test_within_bytes(spark):
    random.seed(2)
    rows = [(s, i, f"2024-01-0{1 + i % 3} 0{i % 7}:00:00", random.randint(1, 9)) for s in ("a", "b") for i in range(60)]
    df = spark.createDataFrame(rows, "subject string, dedup_key int, at string, size int").withColumn("occurred_at", F.to_timestamp("at"))
    for most in (0, 1, 40, 150, 10_000):
        got = {(r.subject, r.dedup_key) for r in ev.within_bytes(df, F.col("size"), most).collect()}
        want = set()
        for s in ("a", "b"):
            left = most
            for r in sorted((r for r in rows if r[0] == s), key=lambda r: (r[2], r[1]), reverse=True):
                left -= r[3]
                if left < 0:
                    break
                want.add((s, r[1]))
        assert got == want


def test_enriched(spark):
    stored = spark.createDataFrame([(1, "j", None, {"a": "1"}), (2, "j", "OLD", None), (3, None, None, None)], "k int, judge string, verdict_type string, extra map<string,string>")
    parsed = spark.createDataFrame([(1, None, None, {"b": "2"}), (2, None, None, {}), (9, "n", None, None)], "k int, judge string, verdict_type string, extra map<string,string>")
    got = {r.k: (r.judge, r.verdict_type, r.extra, r.action) for r in upsert.enriched(stored, parsed, ["k"], "extra", F.lit("V")).collect()}
    assert got == {1: ("j", "V", {"a": "1", "b": "2"}, "updated"), 2: ("j", "OLD", None, "rejected"), 3: (None, None, None, "kept")}


def test_sort_modes():
    with pytest.raises(ValueError):
        search.sort_order("random")
