"""Each stage of the pipeline against a plain version, on its own input."""

import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from civicframe.llm import catalog, pii

from .test_operators import UPPER, brute_components

COLUMNS = list(corpus_pipeline.COLUMNS)
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def leaks(texts, items):
    """Whether each text holds a window of 10 words of an item, or a whole shorter item."""
    windows = defaultdict(set)
    for t in items:
        w = WORDS.findall((t or "").translate(UPPER))
        k = min(10, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            windows[k].add(tuple(w[i : i + k]))
    out = []
    for t in texts:
        w = WORDS.findall((t or "").translate(UPPER))
        out.append(any(tuple(w[i : i + k]) in own for k, own in windows.items() for i in range(len(w) - k + 1)))
    return out


@pytest.fixture(scope="module")
def results(spark, sf, tmp_path_factory):
    """The rows of each stage, each made from what the stage before wrote."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), {}
    out["documents"] = docs.collect()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert made.columns == COLUMNS
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
        out[name] = docs.collect()
    return out


def test_quality_stage(spark, sf, results):
    kept = {r.doc_id for r in catalog.op3_decision_list(spark, sf).collect() if r.kept}
    want = sorted(tuple(r[c] for c in COLUMNS) for r in results["documents"] if r.doc_id in kept)
    assert sorted(map(tuple, results["quality rules"])) == want
    assert 0 < len(want) < len(results["documents"])


def test_dedup_stage(results):
    given = results["quality rules"]
    first = brute_components([(r.doc_id, r.text) for r in given])
    want = sorted(tuple(r) for r in given if first[r.doc_id][1] == r.doc_id)
    assert sorted(map(tuple, results["near-dedup"])) == want
    assert 0 < len(want) < len(given)


def test_decontamination_stage(spark, sf, results):
    given = results["near-dedup"]
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    bad = leaks([r.text for r in given], items)
    assert sorted(map(tuple, results["decontamination"])) == sorted(tuple(r) for r, b in zip(given, bad, strict=True) if not b)
    assert 0 < sum(bad) < len(given)


def test_pseudonym_stage(spark, results):
    given, got = {r.doc_id: r for r in results["decontamination"]}, {r.doc_id: r for r in results["pseudonyms"]}
    assert given.keys() == got.keys() and len(got) == len(results["pseudonyms"])
    mail = re.compile(r"[A-Za-z0-9._]+@[A-Za-z0-9.]+\.[a-z]+")
    changed = 0
    for i, r in got.items():
        old = given[i]
        assert (r.lang, r.source, r.n_chars) == (old.lang, old.source, len(r.text) if r.text is not None else old.n_chars)
        assert not set(mail.findall(r.text or "")) & set(mail.findall(old.text or ""))
        changed += r.text != old.text
    assert changed
    again = pii.pseudonymize(spark.createDataFrame(results["decontamination"], SCHEMA), catalog.KEY).select("doc_id", "text").collect()
    assert {r.doc_id: r.text for r in again} == {i: r.text for i, r in got.items()}


def test_packing_stage(results):
    from tokenizers import Tokenizer

    t, pieces = Tokenizer.from_file(catalog.tokenizer("word_bpe_49k.json")), defaultdict(list)
    for p in results["packing"]:
        pieces[p.doc_id].append(p)
    assert pieces.keys() == {r.doc_id for r in results["pseudonyms"]}
    for r in results["pseudonyms"]:
        ids, at = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for p in sorted(pieces[r.doc_id], key=lambda p: p.start):
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + p.length].tobytes()))
            at += p.length
        assert at == len(ids)


def test_run_is_the_stages(spark, sf, results):
    got = corpus_pipeline.run(spark, sf).collect()
    total = lambda rows: sorted((r.doc_id, r.doc_tokens) for r in {(r.doc_id, r.doc_tokens): r for r in rows}.values())
    assert total(got) == total(results["packing"])


def prose(word):
    return " ".join(f"{word}{k} stands here" for k in range(40)) + "."


def test_rows_of_one_id_are_judged_each(spark, sf):
    """A good text stays, whatever becomes of another with its id; rows without an id are judged too."""
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    leak = f"{prose('leak')} {bench} {prose('tail')}"
    made = [(1, prose("good"), "en", "a", 9), (1, "# $ " * 60, "en", "a", 9), (1, leak, "en", "a", 9), (None, leak, "en", "a", 9), (None, "# $ " * 60, "en", "a", 9), (None, prose("none"), None, None, None),
            (2, prose("twice"), "en", "a", 9), (2, prose("twice"), "en", "a", 9), (3, prose("twice"), "en", "b", 9), (None, prose("twice"), "en", "b", 9)]
    docs = spark.createDataFrame(made, SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, sf)
    assert sorted(str(tuple(r)) for r in docs.collect()) == sorted(str(made[k]) for k in (0, 5, 6))


def test_odd_rows(spark, sf):
    """Nulls, empty and repeated rows, extra columns and an empty table go through all stages."""
    text = prose("word")
    made = [(1, text, "en", "a", len(text)), (1, text, "en", "a", len(text)), (2, None, None, None, None), (3, "", "en", "", 0), (None, text + " tail", None, "b", None)]
    for rows in (made, []):
        docs = spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA + ", n int, key string")
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf)
        got = docs.collect()
        assert {p.doc_id for p in got} == ({1} if rows else set())  # null and empty texts fail the base rules, and the tail is near the first
