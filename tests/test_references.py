"""Identifiers at any depth against a plain walk."""

import json

from civicframe.operators.references import distinct_elements, references, referring


def walk(value, depth=1):
    if isinstance(value, dict):
        for k, v in value.items():
            if k == "@id" and isinstance(v, str):
                yield v, depth
            yield from walk(v, depth + 1)
    elif isinstance(value, list):
        for v in value:
            yield from walk(v, depth + 1)


DOCS = [
    {"@id": "a", "x": [{"@id": "b"}, [{"@id": "b"}, {"y": {"z": [{"@id": "c", "n": None}]}}]]},
    {"@id": "b", "text": 'says "@id": "a"', "in": {"@id": 7, "of": {"@id": ""}}},
    [{"@id": "a"}, 3, None, "@id"],
    {"plain": 1}, {}, [], "@id", None,
    {"@id": "दा", "deep": {"a": {"b": {"c": {"d": {"e": {"f": [[[{"@id": "a"}]]]}}}}}}},
]


def frame(spark):
    rows = [(i, json.dumps(d, ensure_ascii=False)) for i, d in enumerate(DOCS)] + [(90, None), (91, '{"@id": "a"'), (92, ""), (None, '{"in": {"@id": "a"}}'), (0, json.dumps(DOCS[0]))]
    return spark.createDataFrame(rows, "k int, body string"), rows


def test_references(spark):
    df, rows = frame(spark)
    want = []
    for k, text in rows:
        try:
            want += [(k, iri, d, d == 1) for iri, d in walk(json.loads(text or ""))]
        except ValueError:
            continue
    assert sorted(map(str, (tuple(r) for r in references(df, "k", "body").collect()))) == sorted(map(str, want))
    retired = spark.createDataFrame([("a",), ("c",), ("a",), ("q",)], "iri string")
    got = {tuple(r) for r in referring(df, "k", "body", retired).collect()}
    assert got == {(k, iri) for k, iri, _, own in want if not own and iri in ("a", "c")}
    assert references(df.limit(0), "k", "body").collect() == []


def test_distinct_elements(spark):
    df = spark.createDataFrame([('["a", "b", "a", 1, null, ["c"]]',), ('{"x": "y"}',), ('"z"',), ("[]",), (None,), ("[",), ('["d"]',)], "body string")
    assert sorted(r.value for r in distinct_elements(df, "body").collect()) == ["a", "b", "d"]
