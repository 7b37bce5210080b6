"""Evidence of documents: quotes that a text holds, what became of extracted pages, which captures are public."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicframe.session import ship_active

from .text import c

#: What is dropped before a comparison, and the shortest evidence and run that count.
DROPPED = dict.fromkeys(map(ord, "​‌‍﻿*_"))
LEAST_EVIDENCE, LEAST_RUN = 12, 40
#: The share of Devanagari from which a page counts as read, and the roles of captures with what replaces them.
LEAST_DEVANAGARI = 0.15


def _plain(text: str | None) -> str:
    return re.sub(r"\s+", " ", unicodedata.normalize("NFC", text or "").translate(DROPPED).replace("ँ", "ं")).strip()


def _quote(evidence: str | None, text: str | None, least: float) -> str:
    whole, body = _plain(evidence), _plain(text)
    if len(whole) < LEAST_EVIDENCE:
        return ""
    if whole in body:
        return evidence.strip()
    words, best, size, j = evidence.split(), "", 0, 0
    for i in range(len(words)):  # a run that the body holds holds its later starts too: the end never goes back
        j = max(i, j)
        while j < len(words) and _plain(" ".join(words[i : j + 1])) in body:
            j += 1
        run = " ".join(words[i:j])
        if len(_plain(run)) > size:
            best, size = run, len(_plain(run))
    return best if size >= max(LEAST_RUN, least * len(whole)) else ""


def verbatim_quote(evidence: str | Column, text: str | Column, least: float = 0.0) -> Column:
    """What of the evidence stands in the text word for word, as the evidence writes it: all of it, or its longest run of whole words, or "".

    Joiners, stars and white space don't count. A run has 40 characters at least and the share ``least`` of the evidence.
    """
    ship_active()

    @F.pandas_udf("string")
    def quotes(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for quoted, bodies in batches:
            yield pd.Series([_quote(e, t, least) for e, t in zip(quoted, bodies)], dtype=object)

    return quotes(c(evidence), c(text))


def coverage(text: str | Column, has_ink: Column, needs_ocr: Column) -> Column:
    """unread, anchored or blank: an empty page with something on it is unread, and so is one whose text layer is a decoy."""
    return F.when(needs_ocr, "unread").when(F.trim(F.coalesce(c(text), F.lit(""))) != "", "anchored").when(has_ink, "unread").otherwise("blank")


def fidelity(text: str | Column, suspicious: Column) -> Column:
    """tight, repaired or suspect by the text that came out, not by the font that went in; empty text has none."""
    body = F.regexp_replace(F.coalesce(c(text), F.lit("")), r"(?U)\s+", "")
    read = F.regexp_count(body, F.lit("[ऀ-ॿ]")) >= LEAST_DEVANAGARI * F.length(body)
    odd = F.coalesce(suspicious, F.lit(False))
    return F.when(body == "", "").when(read & odd, "repaired").when(odd, "suspect").otherwise("tight")


def transcript_verdicts(pages: DataFrame, key: str) -> DataFrame:
    """key and verdict of documents by their pages (text, state): unread without any text, partial with an unread page, else clean."""
    some = F.bool_or(F.trim(F.coalesce("text", F.lit(""))) != "")
    return pages.groupBy(key).agg(F.when(~some, "unread").when(F.bool_or(F.col("state") == "unread"), "partial").otherwise("clean").alias("verdict"))


def public_media(media: str | Column, replaced_by: Mapping[str, str], ours: str, always: bool = False) -> Column:
    """struct(public, withheld) of array<struct<role, url, ...>>: an original (a key of ``replaced_by``) in our storage (``ours``, a prefix) is withheld if its redacted form is there."""
    known = F.create_map(*(F.lit(v) for kv in replaced_by.items() for v in kv))
    links = F.coalesce(c(media), F.array())
    roles = F.transform(links, lambda m: m["role"])

    def withheld(m: Column) -> Column:
        other = F.try_element_at(known, m["role"])
        return F.coalesce(other.isNotNull() & m["url"].startswith(ours) & (F.lit(always) | F.array_contains(roles, other)), F.lit(False))

    kept = F.filter(links, lambda m: ~withheld(m))
    return F.struct(kept.alias("public"), (F.size(links) - F.size(kept)).alias("withheld"))
