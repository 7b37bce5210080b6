"""Text scalars as column expressions: they stay inside whole-stage codegen and need no Python on the executors."""

from __future__ import annotations

from collections.abc import Callable
from unicodedata import normalize

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The Devanagari digits.
DEVANAGARI = "०१२३४५६७८९"
ASCII = "0123456789"
#: Letters with a nukta (U+0958 to U+095F) that NFC takes apart, and the three that it puts together.
APART = [(chr(n), normalize("NFD", chr(n))) for n in range(0x958, 0x960)]
TOGETHER = [(normalize("NFD", chr(n)), chr(n)) for n in (0x929, 0x931, 0x934)]


def c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def ascii_digits(x: str | Column) -> Column:
    return F.translate(c(x), DEVANAGARI, ASCII)


def devanagari_digits(x: str | Column) -> Column:
    return F.translate(c(x), ASCII, DEVANAGARI)


def devanagari_nfc(x: str | Column) -> Column:
    """NFC of Devanagari letters; marks are taken to be in their order, and other scripts are left alone."""
    s = c(x)
    for old, new in APART + TOGETHER:
        s = F.replace(s, F.lit(old), F.lit(new))
    return s


def squeezed(x: str | Column) -> Column:
    """White space runs become one space; the ends are trimmed; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(c(x), F.lit("")), r"\s+", " "))


def unquoted(x: str | Column) -> Column:
    """``squeezed``, without a pair of quotes around all of it."""
    s = squeezed(x)
    return F.when(s.rlike("^(\".*\"|'.*')$") & (F.length(s) >= 2), F.trim(s.substr(F.lit(2), F.length(s) - 2))).otherwise(s)


def query_key(x: str | Column) -> Column:
    """A query in lower case, trimmed and squeezed, its Devanagari in NFC; other scripts are left to ``nfc`` in ``functions.arrow``."""
    return F.lower(squeezed(devanagari_nfc(x)))


def padded(x: Column, width: int) -> Column:
    """Zero-padded, and never cut as ``lpad`` alone would."""
    return F.when(F.length(x) >= width, x).otherwise(F.lpad(x, width, "0"))


def case_number(x: str | Column) -> Column:
    """``XXX-YY-XXXX`` in capitals, zero-padded; what has another form passes through as it is."""
    up = F.upper(ascii_digits(x))
    form = r"^(\d+)-([A-Z][A-Z0-9]*)-(\d+)$"
    part = lambda i: F.regexp_extract(up, form, i)
    return F.when(up.rlike(form), F.concat_ws("-", padded(part(1), 3), part(2), padded(part(3), 4))).otherwise(c(x))


def register(x: str | Column) -> Column:
    """year, series, seq and pad of a case number, or null."""
    n, form = case_number(x), r"^(\d{3})-([A-Z][A-Z0-9]*)-(\d{1,9})$"
    part = lambda i: F.regexp_extract(n, form, i)
    return F.when(n.rlike(form), F.struct(part(1).alias("year"), part(2).alias("series"), part(3).try_cast("int").alias("seq"), F.length(part(3)).alias("pad")))


def bs_date(x: str | Column) -> Column:
    """Zero-padded ASCII ``YYYY-MM-DD`` from any separator; other shapes keep theirs."""
    s = F.regexp_replace(ascii_digits(unquoted(x)), r"[/।|. ]", "-")
    parts = F.split(s, "-")
    whole = F.concat_ws("-", padded(parts[0], 4), padded(F.try_element_at(parts, F.lit(2)), 2), padded(F.try_element_at(parts, F.lit(3)), 2))
    return F.when(F.size(parts) == 3, whole).otherwise(s)


def bs_year(x: str | Column) -> Column:
    """The leading four digits as a year, or null."""
    return F.regexp_extract(ascii_digits(x), r"^\s*(\d{4})", 1).try_cast("int")


def counted(x: str | Column) -> Column:
    """All digits of a scraped count as one number, or null."""
    return F.regexp_replace(ascii_digits(x), "[^0-9]", "").try_cast("int")


def no_verdict(x: str | Column) -> Column:
    """True for null and for values of stars, spaces and dashes alone."""
    return F.regexp_replace(F.coalesce(c(x), F.lit("")), "[* -]", "") == ""


#: The word for "and others" behind a defendant, and how a judge is addressed.
OTHERS, JUDGE = "समेत", (r"मा\.", "माननीय")


def stated_defendants(x: str | Column) -> Column:
    """struct(total, bare): the stated total, or whether the cell ends in the bare word for "and others"."""
    s = ascii_digits(x)
    total = F.regexp_extract(s, rf"{OTHERS}\s*([0-9]+)", 1).try_cast("int")
    bare = F.regexp_replace(s, r"[ \t\r\n।॥.,;:-]+$", "").endswith(OTHERS)
    return F.struct(total.alias("total"), (total.isNull() & F.coalesce(bare, F.lit(False))).alias("bare"))


def spaced_parentheses(x: str | Column) -> Column:
    s = F.regexp_replace(unquoted(x), r"(\S)\(", "$1 (")
    return F.regexp_replace(F.regexp_replace(s, r"\(\s+", "("), r"\s+\)", ")")


def split_judges(x: str | Column) -> Column:
    """Puts the separator back before an honorific that is glued to a name; blank becomes null."""
    return F.nullif(F.regexp_replace(unquoted(x), rf"(\S)({'|'.join(JUDGE)})", "$1, $2"), F.lit(""))


def sound_fold(x: str | Column) -> Column:
    """Latin text by sound classes: letters and digits, aspirates without h, v and w as b, doubles as one."""
    s = F.regexp_replace(F.lower(c(x)), "[^a-z0-9]+", " ")
    for pattern, to in (("([bcdgjkpt])h", "$1"), ("[vw]", "b"), (r"([a-z])\1+", "$1")):
        s = F.regexp_replace(s, pattern, to)
    return F.trim(s)


def matches(text: str | Column, query: str | Column) -> Column:
    """A literal substring in any case, else every folded token of the query in the folded text; a blank query matches all."""
    t, q = c(text), F.trim(c(query))
    tokens = F.filter(F.split(sound_fold(q), " "), lambda w: w != "")
    return (q == "") | F.contains(F.lower(t), F.lower(q)) | ((F.size(tokens) > 0) & F.forall(tokens, lambda w: F.contains(sound_fold(t), w)))


def has_devanagari(x: str | Column) -> Column:
    return c(x).rlike(r"[ऀ-ॿ]")


def repaired_mojibake(x: str | Column) -> Column:
    """UTF-8 that was read as Latin-1; anything else is left alone."""
    raw = F.when(~c(x).rlike(r"[^\x00-\xFF]"), F.encode(c(x), "ISO-8859-1"))
    return F.coalesce(F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")), c(x))


def slug(x: str | Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c(x)), "[^a-z0-9]+", "-"), F.lit("-"))


def amount_tier(x: str | Column) -> Column:
    """An amount in arab, crore, lakh and hazar; null for null."""
    n = F.floor(c(x)).cast("long")
    arab, crore = F.expr("0"), F.expr("0")
    arab, rest = F.floor(n / 1_000_000_000), n % 1_000_000_000
    crore, rest = F.floor(rest / 10_000_000), rest % 10_000_000
    lakh, hazar = F.floor(rest / 100_000), F.floor(rest % 100_000 / 1_000)
    named = lambda v, unit, also: F.when((v > 0) & also, F.concat(v.cast("string"), F.lit(f" {unit}")))
    text = F.concat_ws(" ", named(arab, "Arab", F.lit(True)), named(crore, "Crore", F.lit(True)), named(lakh, "Lakh", arab == 0), named(hazar, "Hazar", (arab == 0) & (crore == 0)))
    return F.when(n.isNotNull(), F.when(text == "", "Under 1 Hazar").otherwise(F.concat(F.lit("~"), text)))


def snippet(text: str | Column, at: Column, width: int = 90) -> Column:
    """``width`` characters around the place ``at``, from 1."""
    return c(text).substr(F.greatest(at - width // 3, F.lit(1)), F.lit(width))


def clipped(x: str | Column, most: int, mark: str = "…") -> Column:
    """At most ``most`` characters: a longer text ends with the mark, which counts, after a whole word where one ends in the second half."""
    room = F.substring(c(x), 1, most - len(mark))
    whole = F.regexp_replace(room, r"\s+\S*$", "")
    cut = F.when(F.substring(c(x), most - len(mark) + 1, 1).rlike(r"\S") & (F.length(whole) * 2 >= most), whole).otherwise(F.rtrim(room))
    return F.when(F.length(c(x)) <= most, c(x)).otherwise(F.concat(cut, F.lit(mark)))


def windows(text: str | Column, size: int, overlap: int) -> Column:
    """Overlapping windows of a text as array<struct<no, start, body>>; an empty text has none."""
    t, step = F.coalesce(c(text), F.lit("")), size - overlap
    n = F.when(F.length(t) == 0, 0).otherwise(F.ceil(F.greatest(F.length(t) - overlap, F.lit(1)) / step)).cast("int")
    no = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: i < n)
    return F.transform(no, lambda i: F.struct(i.alias("no"), (i * step).alias("start"), t.substr(i * step + 1, F.lit(size)).alias("body")))


def snapped_windows(text: str | Column, size: int, overlap: int, slack: int, first: str | Column | int = 0, most: int | None = None) -> Column:
    """Windows whose ends snap back to a line end, as array<struct<start, end, body>>: at most ``most`` of them, if given.

    A window aims at ``size`` characters (the first one at ``first`` more, such as a caption); it ends behind the last line end in the last ``slack`` of these, if that leaves more than
    ``overlap``, and the next starts ``overlap`` before its end. An empty text has one empty window.
    """
    t = F.coalesce(c(text), F.lit(""))
    n = F.length(t)
    steps = F.floor(n / max(1, size - overlap - slack)).cast("int") + 2
    steps = F.least(steps, F.lit(most)) if most else steps
    extra = F.lit(first) if isinstance(first, int) else F.coalesce(c(first), F.lit(0)).cast("int")

    def window(state: Column, step: Column) -> Column:
        start = state["start"]
        target = start + size + F.when(step == 1, extra).otherwise(0)
        low = F.greatest(start, target - slack)
        back = F.instr(F.reverse(t.substr(low + 1, target - low)), "\n")
        end = F.when(target >= n, n).when((back > 0) & (target - back + 1 > start + overlap), target - back + 1).otherwise(target)
        made = bound(end, lambda e: F.struct(F.array_append(state["out"], F.struct(start.alias("start"), e.alias("end"))).alias("out"), (e - overlap).alias("start"), (e >= n).alias("done")))
        return F.when(state["done"], state).otherwise(made)

    empty = F.array().cast("array<struct<start: int, end: int>>")
    cuts = F.aggregate(F.sequence(F.lit(1), steps), F.struct(empty.alias("out"), F.lit(0).alias("start"), F.lit(False).alias("done")), window, lambda s: s["out"])
    return F.transform(cuts, lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), t.substr(w["start"] + 1, w["end"] - w["start"]).alias("body")))


#: Patterns of what is redacted, by class; our own.
REDACTED = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "phone": r"\+[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-[0-9]{4}", "card": r"[0-9]{16}"}


def redacted(x: str | Column) -> Column:
    for kind, pattern in REDACTED.items():
        x = F.regexp_replace(c(x), pattern, f"[{kind}]")
    return x


def redaction_counts(x: str | Column) -> dict[str, Column]:
    return {kind: F.regexp_count(c(x), F.lit(pattern)) for kind, pattern in REDACTED.items()}
