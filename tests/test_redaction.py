"""Tiers of redaction, residue and withholding; windows that end at lines."""

import random

import pytest
from pyspark.sql import functions as F

from civicframe.functions import redaction
from civicframe.functions import text as tx

TEXT = "Ram, citizenship 12-34-56-78901, born: 2040-01-02, ram@mail.example.org, 9841234567, passport AB123456, account 0123456789012."
DONE = {
    "identifiers": "Ram, citizenship [citizenship], born: [birth], ram@mail.example.org, 9841234567, passport AB123456, account 0123456789012.",
    "contact": "Ram, citizenship [citizenship], born: [birth], [email], [phone], passport AB123456, account 0123456789012.",
    "strict": "Ram, citizenship [citizenship], born: [birth], [email], [phone], passport [passport], account [account].",
}


def rows(spark, texts, tier, **more):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r.asDict() for r in redaction.published(df, "text", tier, **more).orderBy("i").collect()]


@pytest.mark.parametrize("tier", redaction.TIERS)
def test_tiers(spark, tier):
    r = rows(spark, [TEXT], tier)[0]
    assert (r["text"], r["source_text"], r["action"], r["residual"]) == (DONE[tier], TEXT, "redacted", {})
    assert r["counts"] == {x.kind: 1 for x in redaction.rules(tier)}


def test_residue_is_withheld_or_refused(spark):
    texts = ["account no: 12-3456-7890 of ram@mail.example.org", "nothing", None, "", "नागरिकता नं: १२/३४५/६७८९०", "pan 123456789"]
    strict = rows(spark, texts, "strict")
    assert [r["action"] for r in strict] == ["withheld", "same", "same", "same", "withheld", "same"]
    assert strict[0]["text"] is None and strict[0]["source_text"] == texts[0] and strict[0]["residual"] == {"account": 1} and strict[0]["counts"] == {"email": 1}
    kept = rows(spark, texts, "strict", on_residue="keep")
    assert kept[0]["action"] == "refused" and kept[0]["text"] == texts[0] and kept[0]["source_text"] is None
    assert rows(spark, texts, "contact")[0]["action"] == "redacted"  # accounts aren't this tier's
    for bad in ({"tier": "none"}, {"tier": "strict", "on_residue": "drop"}):
        with pytest.raises(ValueError, match="tuple|on_residue"):
            rows(spark, texts, **bad)


def test_names_of_classes_are_no_labels(spark):
    texts = [
        "to +1 (836) 555-9331 4913187196670932 53.121.55.90", "passport AB123456 1234567, account 012345678 12345678, 12-34-56-78901 1234567",  # numbers that follow what was taken out
        "[phone] 4913187196670932", "+1 (836) 555-9331 4913187196670932, mobile: 12-345-678", "phone +1 (836) 555-9331 4913187196670932",  # labels of the text itself, the last one's number is gone
    ]
    got = rows(spark, texts, "strict")
    assert [(r["action"], r["residual"]) for r in got] == [("redacted", {}), ("redacted", {}), ("withheld", {"phone": 1}), ("withheld", {"phone": 1}), ("redacted", {})]
    assert got[0]["text"] == "to [phone] 4913187196670932 53.121.55.90" and got[1]["text"] == "passport [passport] 1234567, account [account] 12345678, [citizenship] 1234567"


def plain_windows(t, size, overlap, slack, first, most):
    out, start, target = [], 0, size + first
    while most is None or len(out) < most:
        end = len(t)
        if target < len(t):
            at = t.rfind("\n", max(start, target - slack), target)
            end = at + 1 if at >= 0 and at + 1 > start + overlap else target
        out.append((start, end, t[start:end]))
        if end >= len(t):
            return out
        start = end - overlap
        target = start + size
    return out


@pytest.mark.parametrize(("size", "overlap", "slack", "first", "most"), [(20, 5, 8, 0, None), (20, 5, 30, 7, None), (10, 0, 10, 3, 2), (30, 10, 19, 0, 4), (7, 6, 7, 0, None)])
def test_windows_end_at_lines(spark, size, overlap, slack, first, most):
    r = random.Random(7)
    texts = ["", "\n", "abc", "x" * 200, "\n" * 90, *("".join(r.choice("ab é\n") for _ in range(r.randrange(300))) for _ in range(30))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", tx.snapped_windows("t", size, overlap, slack, first, most).alias("w"))
    got = {x.i: [tuple(w) for w in x.w] for x in df.collect()}
    assert got == {i: plain_windows(t, size, overlap, slack, first, most) for i, t in enumerate(texts)}
    assert spark.range(1).select(tx.snapped_windows(F.lit(None).cast("string"), 5, 1, 1).alias("w")).first().w == [(0, 0, "")]
