"""Devanagari and Latin spellings of one text as column expressions; no transliteration library is needed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ASCII, DEVANAGARI, bound, c, devanagari_nfc, has_devanagari

NUKTA = "\u093c"
#: Fixed values (the IAST scheme): consonants, independent vowels, vowel signs, other marks.
CONSONANTS = {
    "क": "k", "ख": "kh", "ग": "g", "घ": "gh", "ङ": "ṅ", "च": "c", "छ": "ch", "ज": "j", "झ": "jh", "ञ": "ñ", "ट": "ṭ", "ठ": "ṭh", "ड": "ḍ", "ढ": "ḍh", "ण": "ṇ", "त": "t", "थ": "th",
    "द": "d", "ध": "dh", "न": "n", "प": "p", "फ": "ph", "ब": "b", "भ": "bh", "म": "m", "य": "y", "र": "r", "ल": "l", "ळ": "ḻ", "व": "v", "श": "ś", "ष": "ṣ", "स": "s", "ह": "h",
}
VOWELS = {"अ": "a", "आ": "ā", "इ": "i", "ई": "ī", "उ": "u", "ऊ": "ū", "ऋ": "ṛ", "ॠ": "ṝ", "ऌ": "ḷ", "ए": "e", "ऐ": "ai", "ओ": "o", "औ": "au"}
SIGNS = {"ा": "ā", "ि": "i", "ी": "ī", "ु": "u", "ू": "ū", "ृ": "ṛ", "ॄ": "ṝ", "ॢ": "ḷ", "े": "e", "ै": "ai", "ो": "o", "ौ": "au"}
MARKS = {"ं": "ṃ", "ः": "ḥ", "ँ": "m̐", "ऽ": "'"}
VIRAMA = "्"
#: How the sounds are spelt by those who type them, and the plain letters of IAST.
SPELT = (("ṛ", "ri"), ("ṝ", "ri"), ("ś", "sh"), ("ṣ", "sh"), ("ñ", "ny"), ("ṅ", "n"), ("ṃ", "n"), ("ḥ", "h"))
ACCENTED, PLAIN = "āīūḷṭḍṇḻ", "aiultdnl"


def _mapped(s: Column, table: dict[str, str]) -> Column:
    """Every key as its value, the longest first; keys of one letter to one letter in one pass."""
    for old, new in sorted(table.items(), key=lambda kv: -len(kv[0])):
        if len(old) > 1 or len(new) != 1:
            s = F.replace(s, F.lit(old), F.lit(new))
    short = {old: new for old, new in table.items() if len(old) == len(new) == 1}
    return F.translate(s, "".join(short), "".join(short.values())) if short else s


def to_roman(x: str | Column) -> Column:
    """Devanagari as IAST; a consonant without a sign takes its inherent a. The dot of borrowed letters is dropped. Other text passes through."""
    signs = "".join(SIGNS) + VIRAMA
    s = F.regexp_replace(F.replace(devanagari_nfc(x), F.lit(NUKTA), F.lit("")), f"([{''.join(CONSONANTS)}])(?![{signs}])", "$1a")
    s = F.replace(s, F.lit(VIRAMA), F.lit(""))
    s = F.replace(F.replace(s, F.lit("॥"), F.lit("..")), F.lit("।"), F.lit("."))
    return F.translate(_mapped(s, CONSONANTS | VOWELS | SIGNS | MARKS), DEVANAGARI, ASCII)


def to_devanagari(x: str | Column) -> Column:
    """IAST as Devanagari, the longest match first; letters outside the scheme pass through. ``to_roman`` gives the same text back, but for its dots and digits."""
    s = F.replace(F.lower(c(x)), F.lit(MARKS["ँ"]), F.lit("ँ"))
    s = _mapped(s, {latin: f"{letter}{VIRAMA}" for letter, latin in CONSONANTS.items()})
    s = _mapped(s, {f"{VIRAMA}{latin}": sign for sign, latin in SIGNS.items()})
    s = F.replace(s, F.lit(f"{VIRAMA}a"), F.lit(""))
    return _mapped(s, {latin: letter for letter, latin in (VOWELS | MARKS).items()})


def _spelt(token: Column) -> Column:
    for old, new in SPELT:
        token = F.replace(token, F.lit(old), F.lit(new))
    return F.lower(F.translate(F.replace(token, F.lit("̐"), F.lit("")), ACCENTED, PLAIN))


def to_roman_colloquial(x: str | Column) -> Column:
    """The plain spelling of ``to_roman``, and after it, if it differs, the one without the final short a of each word of three letters or more."""

    def both(tokens: Column) -> Column:
        kept = F.array_join(F.transform(tokens, _spelt), " ")
        dropped = F.array_join(F.transform(tokens, lambda t: _spelt(F.regexp_replace(t, "^(.{2,})a$", "$1"))), " ")
        return F.when((dropped == kept) | (dropped == ""), kept).otherwise(F.concat_ws(" ", kept, dropped))

    return bound(F.filter(F.split(to_roman(x), r"(?U)\s+"), lambda t: t != ""), both)


def titles(ne: str | Column, en: str | Column, plain: str | Column) -> Column:
    """struct(ne, en) of a name: its language map's two sides, else the plain name under its script; blanks are null."""
    text = lambda v: F.nullif(F.trim(c(v)), F.lit(""))
    mapped = text(ne).isNotNull() | text(en).isNotNull()
    return F.struct(
        F.when(mapped, text(ne)).when(has_devanagari(plain), text(plain)).alias("ne"), F.when(mapped, text(en)).when(~has_devanagari(plain), text(plain)).alias("en")
    )


def title_translit(ne: str | Column, en: str | Column) -> Column:
    """Both scripts of a title in one field: IAST and plain spelling of the Devanagari side, the Devanagari of the Latin side and itself; null if both are empty."""
    text = lambda v: F.nullif(c(v), F.lit(""))
    a, b = text(ne), text(en)
    parts = F.array_distinct(F.array_compact(F.array(to_roman(a), to_roman_colloquial(a), to_devanagari(b), b)))
    return F.nullif(F.array_join(F.filter(parts, lambda p: p != ""), " "), F.lit(""))
