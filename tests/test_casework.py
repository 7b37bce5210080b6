"""Scripts, names, evidence, places, drafts and intents by examples and plain versions."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from civicframe.functions import evidence, names, scripts, web
from civicframe.operators import casework, documents, places
from civicframe.operators.rules import Rules


def values(spark, texts, *makers):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    return [tuple(r)[1:] for r in df.select("i", *(m("x").alias(f"c{k}") for k, m in enumerate(makers))).orderBy("i").collect()]


def test_scripts(spark):
    words = ["भरत ताल", "कृष्ण", "राम", "सीता", "न", "Bharat", "काठमाडौं", "शर्मा", "", None, "बड़ा", "२०८१ । अं"]
    got = values(spark, words, scripts.to_roman, scripts.to_roman_colloquial, lambda x: scripts.to_devanagari(scripts.to_roman(x)))
    assert [g[0] for g in got] == ["bharata tāla", "kṛṣṇa", "rāma", "sītā", "na", "Bharat", "kāṭhamāḍauṃ", "śarmā", "", None, "baḍā", "2081 . aṃ"]
    assert [g[1] for g in got[:4]] == ["bharata tala bharat tal", "krishna krishn", "rama ram", "sita"]
    assert [g[2] for g in got[:4]] == words[:4] and got[6][2] == words[6]


def test_nfc_is_that_of_the_standard(spark):
    letters = "कखगजडढफयनरऴक़ड़य़ऩऱऴािa 1"
    random.seed(3)
    texts = ["".join(random.choice(letters) for _ in range(12)) for _ in range(200)]
    texts = [t for t in texts if "़़" not in t]
    assert [g[0] for g in values(spark, texts, scripts.devanagari_nfc)] == [unicodedata.normalize("NFC", t) for t in texts]


def test_titles(spark):
    rows = [(" न ", None, "x"), (None, "e", "x"), (None, " ", "नाम"), ("", "", "name "), (None, None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, ne string, en string, plain string")
    got = [(r.t.ne, r.t.en) for r in df.select("i", scripts.titles("ne", "en", "plain").alias("t")).orderBy("i").collect()]
    assert got == [("न", None), (None, "e"), ("नाम", None), (None, "name"), (None, None)]


def test_names(spark):
    a = ["चापागाईँ", "गुरुङ्ग", "डा. राम वहादुर समेत ६४", "कमल", None, "साह", "तामांग"]
    b = ["चापागाई", "गुरुङ", "रामबहादुर", "कमला", "", "शाह", "तामाङ"]
    keys = [g[0] for g in values(spark, a, names.name_key)], [g[0] for g in values(spark, b, names.name_key)]
    assert [x == y for x, y in zip(*keys)] == [True, True, True, False, True, False, True]
    cells = ["परिवर्तित नाम पोखरा", "नाम परिव‍र्तित क", "एक्स हाल परिवर्तित नाम वाई प्रा.लि.", "ए लिमिटेड (परिवर्तित नाम) र परिवर्तित नाम क", "राम", None]
    assert [g[0] for g in values(spark, cells, names.anonymised_party)] == [True, True, False, True, False, False]
    assert values(spark, ["टिकाराम  ज्ञवालीः", "A.B - C", None], names.normalised_name) == [("टिकाराम ज्ञवाली",), ("a b - c",), ("",)]


def test_match_score(spark):
    pairs = [
        ("राम थापा", "राम थापा", 1.0), ("घुरनी देवी खत्वे", "घुरनी देवी", 0.0), ("Ram Thapa", "राम थापा", 0.96), ("थापा मगर", "मगर थापा", 0.0), ("राम थापा", "थापा राम", 1.0),
        ("गणेश थापा", "गनेश थापा", 0.0), ("राम देवी थापा", "राम थापा", 0.95), ("", "राम", 0.0), (None, None, 0.0), ("राम राम थापा", "राम थापा", 0.0),
    ]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string, want double")
    score = names.match_score(names.name_tokens("a"), names.name_tokens("b"), surnames=["थापा", "मगर"], particles=["देवी"])
    both = names.match_score(names.name_tokens("b"), names.name_tokens("a"), surnames=["थापा", "मगर"], particles=["देवी"])
    got = df.select("a", "b", "want", score.alias("got"), both.alias("turned")).collect()
    assert [(r.a, r.b, r.got, r.turned) for r in got] == [(r.a, r.b, r.want, r.want) for r in got]


def plain_quote(e, t, least=0.0):
    whole, body = evidence._plain(e), evidence._plain(t)
    if len(whole) < 12:
        return ""
    if whole in body:
        return e.strip()
    w = e.split()
    runs = [" ".join(w[i:j]) for i in range(len(w)) for j in range(i + 1, len(w) + 1) if evidence._plain(" ".join(w[i:j])) in body]
    best = max((len(evidence._plain(r)) for r in runs), default=0)
    return best if best >= max(40, least * len(whole)) else ""


def test_verbatim_quote(spark):
    random.seed(5)
    word = lambda: random.choice(["alpha", "beta*", "ga‍mma", "delta", "पाँच", "epsilon"])
    rows = [(i, " ".join(word() for _ in range(14)), "  ".join(word() for _ in range(900))) for i in range(40)] + [(40, None, "x"), (41, "some evidence here", None), (42, "same text as this", " *same* text\nas this one ")]
    rows += [(43 + i, " ".join(t.split()[20:30] + ["lost", "words"]), t) for i, (_, _, t) in enumerate(rows[:10])]
    got = spark.createDataFrame(rows, "i int, e string, t string").select("i", "e", "t", evidence.verbatim_quote("e", "t").alias("q")).orderBy("i").collect()
    for r in got:
        want = plain_quote(r.e, r.t)
        assert (len(evidence._plain(r.q)) if isinstance(want, int) else r.q) == want
    assert sum(r.q != "" for r in got) >= 11


def test_places(spark):
    gazetteer = spark.createDataFrame([("d1", "district", None, "Bara"), ("d2", "district", None, "Dang"), ("u1", "unit", "d1", "Lake Side"), ("u2", "unit", "d2", "Lake Side"), ("u3", "unit", "d2", "Hill")], "iri string, kind string, parent string, name string")
    rows = [
        ("in Bara.", None, None, "d1", None, None), ("Lake Side", None, None, None, None, "no single district"), ("Lake-Side", "Dang", "at Dang", "d2", "u2", None), ("Lake Side", "Dang", None, None, None, "claim not in the quote"),
        ("Hill, Bara", None, None, None, None, "district lacks the municipality"), ("Hill", "Bara", "", None, None, "claim not named"), (None, "Bara", None, None, None, "claim not named"), ("Lake Side and Hill", "Dang", "Dang", "d2", None, "several municipalities"),
        ("Barabar", None, None, None, None, "no single district"),
    ]
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)], "i int, place string, claim string, evidence string")
    got = {r.i: (r.district, r.unit, r.reason) for r in places.resolved_places(df, "i", gazetteer).collect()}
    assert got == {i: r[3:] for i, r in enumerate(rows)}


def test_intents(spark):
    binds = spark.createDataFrame([("c", "a", "accused", None), ("c", "b", "accused", "charged"), ("c", "w", "witness", None), ("d", "a", "accused", None)], "case_id string, iri string, role string, outcome string")
    intents = spark.createDataFrame(
        [(1, "c", [("a", "convicted"), ("b", "acquitted")]), (2, "c", [("a", "abated"), ("w", "convicted")]), (3, "d", []), (4, "d", [("b", "convicted")]), (5, "d", [("a", None)]), (6, "c", [("b", "abated")])],
        "intent int, case_id string, outcomes array<struct<iri:string,outcome:string>>",
    )
    got = {r.intent: r.problem for r in casework.outcome_intents(intents, binds).collect()}
    assert got == {1: None, 2: "not accused", 3: "no outcomes", 4: "not of this case", 5: "incomplete", 6: None}
    after = {(r.case_id, r.iri): r.outcome for r in casework.outcomes_applied(intents, binds).collect()}
    assert after == {("c", "a"): "convicted", ("c", "b"): "abated", ("c", "w"): None, ("d", "a"): None}


def test_drafts_and_promotions(spark):
    drafts = spark.createDataFrame([("1", "t", ["x"], "राम समेत ३", ["r"]), ("2", "t", ["x"], None, None), ("3", None, ["y"], "राम", ["r"]), ("4", "t", ["held", "z"], "राम", ["r"]), ("5", "t", [], "राम समेत", ["r"])], "case_no string, case_title string, dockets array<string>, defendant string, names array<string>")
    got = {r.case_no: (r.status, r.truncated) for r in casework.draft_imports(drafts, spark.createDataFrame([("held",), ("held",)], "docket string")).collect()}
    assert got == {"1": ("created", True), "2": ("skipped", False), "3": ("failed", False), "4": ("skipped", False), "5": ("created", True)}
    held = spark.createDataFrame([("a", [("VAT", "60-1")], []), ("b", [("phone", "601")], [("X", None), ("x ", None)]), ("c", None, [(None, "https://a.np/x"), ("", "http://b.np")])], "id string, identifiers array<struct<kind:string,value:string>>, sources array<struct<authority:string,url:string>>")
    got = {r.id: (r.publishers, r.contractor, r.promoted) for r in casework.contractor_promotions(held, spark.createDataFrame([("601",)], "number string"), 2).collect()}
    assert got == {"a": (0, True, True), "b": (1, False, False), "c": (2, False, True)}


def test_stale_and_files(spark):
    m = spark.createDataFrame([("new", "1"), ("same", "1"), ("changed", "2"), ("unknown", None), ("dead", "3"), ("dead-new", "4"), ("dead-unknown", None)], "iri string, sha256 string")
    c = spark.createDataFrame([("same", "sha256:1"), ("changed", "sha256:1"), ("unknown", "sha256:9")], "iri string, revision string")
    f = spark.createDataFrame([("dead", "3"), ("dead-new", "3"), ("dead-unknown", None)], "iri string, sha256 string")
    got = {r.iri: (r.stale, r.queue) for r in casework.stale_content(m, c, f).collect()}
    assert got == {"new": (True, True), "same": (False, False), "changed": (True, True), "unknown": (False, False), "dead": (True, False), "dead-new": (True, True), "dead-unknown": (True, False)}


def test_once(spark, tmp_path):
    """A stream that delivers keys again, in a batch, over batches and in a replay of a batch, has each effect once."""
    source, out, checkpoint = tmp_path / "in", tmp_path / "out", tmp_path / "cp"
    source.mkdir()
    spark.createDataFrame([], "key string").write.parquet(f"{out}/n=-1")
    read = lambda: spark.read.option("basePath", str(out)).schema("key string, n int").parquet(str(out))
    seen = []

    def apply(batch, number):
        batch.select("key").write.mode("overwrite").parquet(f"{out}/n={number}")
        seen.append(number)

    step = casework.once(lambda: read().select("key"), "key", apply)
    (source / "a.json").write_text('{"key": "a"}\n{"key": "a"}\n{"key": "b"}\n')
    (source / "b.json").write_text('{"key": "b"}\n{"key": "c"}\n')
    stream = spark.readStream.schema("key string").option("maxFilesPerTrigger", 1).json(str(source))
    q = stream.writeStream.foreachBatch(step).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted(r.key for r in read().collect()) == ["a", "b", "c"] and len(seen) == 2


def test_documents_and_rules(spark):
    df = spark.createDataFrame([("a", 1), ("b", None)], "kind string, v int")
    rules = Rules()
    rules.rule("positive", weight=2)(lambda: F.col("v") > 0)
    rules.rule("only b", kind="b", gate=True)(lambda: F.col("v").isNotNull())
    assert {r.kind: (r.score, r.issues, r.passed) for r in rules.report(df).collect()} == {"a": (100.0, [], True), "b": (0.0, ["positive", "only b"], False)}
    with pytest.raises(ValueError):
        rules.rule("positive")(lambda: F.lit(True))
    assert {r.score for r in Rules().report(df).collect()} == {None}
    with pytest.raises(ValueError):
        documents.document(df, "x", {"nothing": F.lit(1)})
    made = documents.document(df, "x", {"iri": F.col("kind"), "title_ne": F.lit(" भरत  "), "keywords": F.array(F.lit("b"), F.lit("a"), F.lit("b"), F.lit(" "))}).first()
    assert (made.title_ne, made.title_translit, made.keywords, made.body) == ("भरत", "bharata bharata bharat", ["a", "b"], None)


def test_canonical_ids(spark):
    ids = ["http://evil.com/entity/person/a-b/", "https://x.org/entity/organization/gov/x", "https://x.org/entity/a", "https://x.org/entity/person/A", "entity/person/a", "", None]
    got = [g[0] for g in values(spark, ids, lambda x: web.canonical_iri("https://r.org", x))]
    assert got == ["https://r.org/entity/person/a-b", "https://r.org/entity/organization/gov/x", None, None, None, None, None]


def test_twins_without_a_code_lead_to_the_gazetteer(spark):
    gazetteer = spark.createDataFrame(
        [("d1", "district", None, "Kavre"), ("d2", "district", None, "Rukum"), ("d3", "district", None, "Rukum"), ("u1", "unit", "d1", "Banepa"), ("u2", "unit", "d1", "Panauti"), ("u3", "unit", "d2", "Musikot"),
         ("u4", "unit", "d3", "Musikot"), ("u5", "unit", None, "Lost")],
        "iri string, kind string, parent string, name string",
    )
    twins = spark.createDataFrame(
        [("t1", ["Old Town", "Banepa"]), ("t2", ["Valley", "Banepa"]), ("t3", ["Valley", "Panauti"]), ("t4", ["Hills", "Musikot"]), ("t5", ["Both", "Kavre"]), ("t6", ["Both", "Lost"]),
         ("t7", [None, "Far", "Lost"]), ("u1", ["Coded", "Banepa"]), ("t8", ["Kavre", "Banepa", "First"]), ("t9", ["Rukum", "Banepa"]), ("t10", None)],
        "iri string, titles array<string>",
    )
    asked = ["old  town!", "Valley", "Hills", "Both", "far", "Coded", "First", "Rukum", "nowhere", None, ""]
    out = places.redirected(spark.createDataFrame(list(enumerate(asked)), "k int, place string"), "k", "place", twins, gazetteer)
    assert [tuple(r)[1:] for r in sorted(out.collect())] == [
        ("u1", "d1", None), ("d1", "d1", None), (None, None, "no twin"), (None, None, "twins disagree"), ("u5", None, None), (None, None, "no twin"), ("d1", "d1", None), ("u1", "d1", None),
        (None, None, "no twin"), (None, None, "no twin"), (None, None, "no twin"),
    ]
