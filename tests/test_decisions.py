"""Names to entities: one case for each rung."""

import pytest

from civicframe.operators.decisions import Lexicon, decided

MENTION = "mention int, name string, complete boolean"
CANDIDATE = "mention int, entity string, titles array<string>, relevance double, coded boolean, province string, election boolean"
WORDS = Lexicon(honorifics=["mr"], particles=["bahadur"], generic=["office", "district"], provinces={"gandaki": ["gandaki"]})


def c(m, entity, *titles, relevance=5.0, coded=False, province=None, election=False):
    return (m, entity, list(titles), relevance, coded, province, election)


CASES = [
    ("Mr Ram Thapa", True, [c(0, "e1", "Ram Thapa"), c(0, "e1", "Rama Other"), c(0, "e2", "Sita Thapa")], ("e1", "e1", "BIND", None)),
    ("Ram Thapa", True, [c(0, "e1", "Ram Thapa"), c(0, "e2", "Ram Bahadur Thapa"), c(0, "", "Ram Thapa")], (None, "e1", "REVIEW", "ambiguous")),
    ("Ram Thapa", True, [c(0, "e2", "Hari Rai")], (None, None, "NO_MATCH", "below the threshold")),
    ("Ram Thapa", True, [], (None, None, "NO_MATCH", "below the threshold")),
    ("Ram Thapa", False, [c(0, "e1", "Ram Thapa"), c(0, None, "x", relevance=5.0)], (None, "e1", "REVIEW", "search cut")),
    ("Ram Thapa", None, [c(0, "e1", "Ram Thapa"), c(0, "e2", "x", relevance=4.0)], ("e1", "e1", "BIND", None)),
    ("Ram", True, [c(0, "e1", "Ram")], (None, "e1", "REVIEW", "single token")),
    ("Jhapa", True, [c(0, "e1", "Jhapa", coded=True), c(0, "e0", "Jhapa")], ("e1", "e1", "BIND", None)),
    ("District Office", True, [c(0, "e1", "District Office")], (None, "e1", "REVIEW", "generic")),
    ("राम थापा", True, [c(0, "e1", "Ram Thapa")], (None, "e1", "REVIEW", "other script only")),
    ("राम थापा", True, [c(0, "e1", "Ram Thapa", "राम थापा")], ("e1", "e1", "BIND", None)),
    ("Roads Board", True, [c(0, "e1", "Roads Board", province="gandaki")], (None, "e1", "REVIEW", "province not named")),
    ("Gandaki Roads Board", True, [c(0, "e1", "Gandaki Roads Board", province="gandaki")], ("e1", "e1", "BIND", None)),
    ("Land Office", True, [c(0, "e1", "Land Office", "Land Office Centre"), c(0, "e2", "Land Office, Parsa")], (None, "e1", "REVIEW", "unqualified organisation")),
    ("Land Office", True, [c(0, "e1", "Land Office", "Land Office Centre"), c(0, "e3", "Ward Land Office")], ("e1", "e1", "BIND", None)),
    ("Land Board", True, [c(0, "e1", "Land Board"), c(0, "e2", "Land Board Parsa")], ("e1", "e1", "BIND", None)),
    ("Ram Thapa", True, [c(0, "e1", "Ram Thapa", election=True)], (None, "e1", "REVIEW", "election record")),
    ("Ram Thapa", True, [c(0, "e1", "Ram Thapa", election=None)], (None, "e1", "REVIEW", "record not read")),
    (None, True, [c(0, "e1", "Ram Thapa"), c(0, "e2"), c(0, "e3", None, " ")], (None, None, "NO_MATCH", "below the threshold")),
    ("Rama Thapa", True, [c(0, "e2", "Rama Thapa"), c(0, "e1", "Rama Thapa", coded=True), c(0, "e3", "Rama Thapa", coded=True)], (None, "e1", "REVIEW", "ambiguous")),
]


@pytest.fixture(scope="module")
def results(spark):
    mentions = spark.createDataFrame([(i, name, complete) for i, (name, complete, _, _) in enumerate(CASES)], MENTION)
    rows = spark.createDataFrame([(i, *r[1:]) for i, (_, _, cs, _) in enumerate(CASES) for r in cs], CANDIDATE)
    return {r.mention: r for r in decided(mentions, rows, WORDS, prefer_coded=True).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_rungs(results, i):
    r = results[i]
    assert (r.entity, r.best, r.verdict, r.reason) == CASES[i][3]


def test_without_word_lists_and_without_preference(spark):
    mentions = spark.createDataFrame([(0, "Jhapa Town", True)], MENTION)
    rows = spark.createDataFrame([c(0, "e1", "Jhapa Town", coded=True), c(0, "e0", "Jhapa Town")], CANDIDATE)
    assert [tuple(r) for r in decided(mentions, rows, Lexicon()).collect()] == [(0, None, "e0", 1.0, "Jhapa Town", "REVIEW", "ambiguous")]
