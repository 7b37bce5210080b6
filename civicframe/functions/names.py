"""Names of people and bodies: keys that fold spelling, anonymised parties, scores with anchors, vetoes."""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scripts import to_roman_colloquial
from .text import bound, c, devanagari_nfc, has_devanagari

ZERO_WIDTH = "​‌‍﻿"
#: Letters that registers interchange, as they are and as they are folded.
REGISTER_FOLD = ("वीूणष", "बिुनश")
#: How a court marks a party whose name it changed, and what marks a company, whose name may have changed too.
ANONYMISED = ("परिवर्तित नाम", "परिवर्तित संकेत नाम", "नाम परिवर्तित", "नामथर परिवर्तित")
COMPANY = (
    "प्रा.लि", "प्रा. लि", "प्रा.ली", "प्रालि", "लिमिटेड", "कम्पनी", "इन्टरप्राइज", "उद्योग", "इण्डष्ट्रि", "इन्डष्ट्रि", "इनभेस्टमेन्ट", "हायर पर्चेज", "सोलुसन", "बैंक", "फाइनान्स", "सहकारी", "ट्रेडर्स",
    "सप्लायर्स", "मिल्स",
)
#: The word for "and" between parties, a doctor's title, and the words of a group's suffix ("with 3", "3 persons").
AND, DOCTOR, WITH, PERSONS = "र", "डा", "समेत", "जना"
#: Fixed values of the name key: vowel length and one pair of consonants.
LENGTH_FOLD = ("ीूईऊव", "िुइउब")
#: The consonants by place of articulation; the last of each row is its nasal.
ROWS = ("कखगघङ", "चछजझञ", "टठडढण", "तथदधन", "पफबभम")
NASALS = "".join(row[-1] for row in ROWS)
CONSONANTS = f"{ROWS[0][0]}-ह"
ANUSVARA, CANDRABINDU, NUKTA, VIRAMA = "\u0902", "\u0901", "\u093c", "\u094d"
DIGITS = "0123456789०१२३४५६७८९"
#: What a variant spelling, an omitted particle, and each further omission take from a score.
VARIANT, PARTICLE, OMISSION = 0.02, 0.05, 0.10


def register_fold(x: str | Column) -> Column:
    """Devanagari letters alone, in one spelling; null becomes empty. What differs in spaces, joiners or interchanged letters is equal."""
    s = F.regexp_replace(devanagari_nfc(F.coalesce(c(x), F.lit(""))), "[^ऀ-ॿ]+", "")
    return F.translate(s, *REGISTER_FOLD)


def holds_any(folded: Column, terms: Collection[str]) -> Column:
    """Whether a folded text holds any of the terms, folded likewise."""
    return F.exists(F.array(*(F.lit(t) for t in terms)), lambda t: F.contains(folded, register_fold(t)))


def anonymised_party(*cells: str | Column) -> Column:
    """Whether a cell names a party whose name the court changed. Each party is judged alone: a renamed company beside it excuses only itself."""
    person = lambda p: bound(register_fold(p), lambda f: holds_any(f, ANONYMISED) & ~holds_any(f, COMPANY))
    parties = lambda x: F.split(F.translate(F.coalesce(c(x), F.lit("")), ",;|/", "\n\n\n\n"), rf"(?U)\n+|\b{AND}\b")
    return F.exists(F.flatten(F.array(*map(parties, cells))), person)


def _without_group(s: Column) -> Column:
    """Without "with 3", "with others" or "3 persons" at the end."""
    cut = lambda x, word: F.substr(x, F.lit(1), F.length(x) - len(word))
    bare = F.rtrim(s, F.lit(DIGITS + " "))
    counted = F.rtrim(cut(F.rtrim(s), PERSONS))
    persons = F.endswith(F.rtrim(s), F.lit(PERSONS)) & (F.rtrim(counted, F.lit(DIGITS)) != counted)
    return F.when(F.endswith(bare, F.lit(WITH)), cut(bare, WITH)).when(persons, F.rtrim(counted, F.lit(DIGITS))).otherwise(s)


def _spelt(word: Column) -> Column:
    """A word in one spelling: a nasal before a consonant is one sign, so is nga at the end; vowels are short; a virama stands behind consonants only."""
    s = F.replace(word, F.lit(ROWS[0][-1] + VIRAMA + ROWS[0][2]), F.lit(ANUSVARA + ROWS[0][2]))
    nga = ANUSVARA + ROWS[0][2]
    s = F.when(F.endswith(s, F.lit(nga)), F.concat(F.substr(s, F.lit(1), F.length(s) - len(nga)), F.lit(ROWS[0][-1]))).otherwise(s)
    s = F.regexp_replace(s, f"[{NASALS}]{VIRAMA}(?=[{CONSONANTS}])", ANUSVARA)
    s = F.replace(F.translate(s, *LENGTH_FOLD), F.lit(CANDRABINDU), F.lit(""))
    return F.regexp_replace(s, f"(^|[^{CONSONANTS}]){VIRAMA}+", "$1")


def name_key(x: str | Column) -> Column:
    """A name without spaces, punctuation, a doctor's title and a group suffix, in one spelling of length and nasals; other consonants stay apart."""
    s = F.translate(devanagari_nfc(F.coalesce(c(x), F.lit(""))), ZERO_WIDTH + NUKTA, "")
    titled = F.contains(s, F.lit(".")) & (F.trim(F.substring_index(s, ".", 1)) == DOCTOR)
    s = F.when(titled, F.substr(s, F.instr(s, ".") + 1)).otherwise(s)
    words = bound(s, lambda t: F.regexp_extract_all(_without_group(t), F.lit("[ऀ-ॿ]+|[A-Za-z0-9]+"), F.lit(0)))
    return F.array_join(F.transform(words, _spelt), "")


def name_skeleton(x: str | Column, fold: tuple[str, str] = ("", "")) -> Column:
    """The consonants of a Latin name, those of ``fold`` as one, doubles once."""
    s = F.regexp_replace(F.lower(F.coalesce(c(x), F.lit(""))), "[^a-z]|[aeiou]", "")
    return F.regexp_replace(F.translate(s, *fold), r"(.)\1+", "$1")


def normalised_name(x: str | Column) -> Column:
    """Lower case, punctuation as spaces, without marks at the end; hyphens stay."""
    s = F.trim(F.translate(devanagari_nfc(F.coalesce(c(x), F.lit(""))), ZERO_WIDTH, ""))
    s = F.regexp_replace(F.regexp_replace(s, r"[ः:।.]+\s*$", ""), r"(?U)[^\wऀ-ॿ\s-]", " ")
    return F.lower(F.trim(F.regexp_replace(s, r"(?U)\s+", " ")))


def name_tokens(x: str | Column, honorifics: Collection[str] = (), variants: Sequence[Collection[str]] = ()) -> Column:
    """array<struct<raw, forms>>: each word and the spellings that count as it: its plain Latin ones, and the groups of ``variants`` that it belongs to."""

    def token(raw: Column) -> Column:
        own = F.array_distinct(F.concat(F.array(raw), F.when(raw.rlike(r"[^\x00-\x7F]"), F.split(to_roman_colloquial(raw), " ")).otherwise(F.array())))
        groups = [F.array(*(F.lit(w) for w in sorted(g))) for g in variants]
        forms = bound(own, lambda f: F.array_union(f, F.flatten(F.array(*(F.when(F.arrays_overlap(f, g), g).otherwise(F.array()) for g in groups))))) if groups else own
        return F.struct(raw.alias("raw"), forms.alias("forms"))

    words = F.split(F.replace(normalised_name(x), F.lit("-"), F.lit(" ")), r"\s+")
    return F.transform(F.filter(words, lambda w: (w != "") & ~w.isin(*honorifics) if honorifics else w != ""), token)


def _same(a: Column, b: Column) -> Column:
    """Equal words; across scripts, or between Latin variants, a common form. Two Devanagari words never meet through their Latin forms, which lose letters."""
    return (a["raw"] == b["raw"]) | (~(has_devanagari(a["raw"]) & has_devanagari(b["raw"])) & F.arrays_overlap(a["forms"], b["forms"]))


def heads(short: Column, long: Column) -> Column:
    """Whether a name (``name_tokens``) is how a longer one begins, word by word."""
    places = F.sequence(F.lit(1), F.size(short))
    begins = F.forall(places, lambda i: _same(F.try_element_at(short, i), F.try_element_at(long, i)))
    return F.when((F.size(short) > 0) & (F.size(long) > F.size(short)), begins).otherwise(False)


def match_score(left: Column, right: Column, surnames: Collection[str] = (), particles: Collection[str] = ()) -> Column:
    """How near two names (``name_tokens``) are to one entity's: 1 if equal, 0 if they must not bind.

    First and last word have to match, straight, or swapped if just one of the two is a surname. Every word of the shorter needs its own in the longer; what is left
    there may be particles only.
    """
    return bound(F.struct(left.alias("left"), right.alias("right")), lambda pair: _score(pair["left"], pair["right"], surnames, particles))


def _score(left: Column, right: Column, surnames: Collection[str], particles: Collection[str]) -> Column:
    is_in = lambda t, words: F.arrays_overlap(t["forms"], F.array(*(F.lit(w) for w in words))) if words else F.lit(False)
    end = lambda s, i: F.try_element_at(s, F.lit(i))
    straight = _same(end(left, 1), end(right, 1)) & _same(end(left, -1), end(right, -1))
    swapped = _same(end(left, 1), end(right, -1)) & _same(end(left, -1), end(right, 1)) & (is_in(end(left, 1), surnames) != is_in(end(left, -1), surnames))
    swap = F.size(left) >= F.size(right)
    longer, shorter = F.when(swap, left).otherwise(right), F.when(swap, right).otherwise(left)

    def take(state: Column, token: Column) -> Column:
        pool = state["pool"]
        at = F.try_element_at(F.filter(F.sequence(F.lit(0), F.size(pool)), lambda i: (i > 0) & _same(token, F.try_element_at(pool, i))), F.lit(1))

        def taken(i: Column) -> Column:
            rest = F.filter(pool, lambda _, place: place + 1 != i)
            other = (F.try_element_at(pool, i)["raw"] != token["raw"]).cast("int")
            return F.struct(F.when(i.isNull(), pool).otherwise(rest).alias("pool"), (state["n"] + F.coalesce(other, F.lit(0))).alias("n"), (state["fine"] & i.isNotNull()).alias("fine"))

        return bound(at, taken)

    def scored(s: Column) -> Column:
        left_over = F.size(s["pool"])
        only = F.forall(s["pool"], lambda t: is_in(t, particles))
        score = 1.0 - VARIANT * s["n"] - PARTICLE * left_over - OMISSION * F.greatest(left_over - 1, F.lit(0))
        return F.when(s["fine"] & only, F.greatest(F.round(score, 6), F.lit(0.0))).otherwise(0.0)

    result = F.aggregate(shorter, F.struct(longer.alias("pool"), F.lit(0).alias("n"), F.lit(True).alias("fine")), take, scored)
    return F.when(F.coalesce(straight | swapped, F.lit(False)), result).otherwise(0.0)


def name_veto(x: str | Column, generic: Collection[str], place: Column | None = None) -> Column:
    """Why a name may never bind by itself, or null: two names in one, a single word (unless it is a coded place), or generic words alone."""
    words = name_tokens(x)
    named = F.coalesce(place, F.lit(False)) if place is not None else F.lit(False)
    listed = F.array(*(F.lit(w) for w in generic))
    return (
        F.when(F.contains(normalised_name(x), F.lit(" - ")), "composite")
        .when((F.size(words) < 2) & ~(named & (F.size(words) > 0)), "single token")
        .when(F.forall(words, lambda t: F.arrays_overlap(t["forms"], listed)), "generic")
    )


def province_veto(x: str | Column, province: str | Column, spellings: dict[str, Sequence[str]]) -> Column:
    """Why a candidate of a province (null: none) may not bind to a name: the province has no known spelling, or the name doesn't say it."""
    known = F.create_map(*(v for k, ws in spellings.items() for v in (F.lit(k), F.array(*(F.lit(w) for w in ws)))))
    said = F.exists(name_tokens(x), lambda t: F.arrays_overlap(t["forms"], F.try_element_at(known, c(province))))
    return F.when(F.coalesce(c(province), F.lit("")) == "", None).when(F.try_element_at(known, c(province)).isNull(), "unknown province").when(~F.coalesce(said, F.lit(False)), "province not named")
