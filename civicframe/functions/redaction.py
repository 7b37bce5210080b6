"""Personal data in texts: taken out by tiers, counted by class, and looked for again by wider patterns, so that what wasn't taken out is withheld."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: From the mildest to the strictest; a tier takes out what those before it do.
TIERS = ("identifiers", "contact", "strict")
D = "[0-9०-९]"
_GAP = r"[^\p{L}\n]{0,6}"
#: Stands for what was taken out while a text is looked at again: a letter, so that no gap reaches over it, but of no label and no value, as the names of classes are.
MARK = "[ʘ]"


@dataclass(frozen=True)
class Rule:
    """remove: what the tier takes out. find: where such a value seems to stand, also in a shape that ``remove`` doesn't know."""

    kind: str
    tier: str
    remove: str
    find: str


#: Our own patterns. Numbers of businesses are public and in no class.
RULES = (
    Rule("citizenship", "identifiers", rf"(?<!{D})(?:{D}{{2}}-){{3}}{D}{{5}}(?!{D})", rf"(?i)(?:citizenship(?: no| number)?|नागरिकता(?: नं)?){_GAP}{D}[0-9०-९/-]{{5,}}"),
    Rule("birth", "identifiers", rf"(?i)(?<=born: ){D}{{4}}-{D}{{2}}-{D}{{2}}(?!{D})", rf"(?i)(?:born|date of birth|जन्म मिति){_GAP}{D}{{2,4}}[-/.]{D}{{1,2}}[-/.]{D}{{1,4}}"),
    Rule("email", "contact", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"[A-Za-z0-9._%+-]+ ?(?:@|\(at\)) ?[A-Za-z0-9-]+\.[A-Za-z]{2,}"),
    Rule("phone", "contact", rf"(?<!{D})(?:\+{D}{{1,3}} \({D}{{3}}\) {D}{{3}}-{D}{{4}}|[9९][78७८]{D}{{8}})(?!{D})", rf"(?i)(?:phone(?: no)?|mobile|फोन){_GAP}{D}[0-9०-९ -]{{5,}}"),
    Rule("passport", "strict", r"(?i)(?<=passport )[A-Z]{1,2}[0-9]{6,8}\b", rf"(?i)passport(?: no| number)?{_GAP}[A-Z]{{0,2}}[0-9]{{6,}}"),
    Rule("account", "strict", rf"(?i)(?<=account ){D}{{9,18}}(?!{D})", rf"(?i)(?:account(?: no| number)?|खाता(?: नं)?){_GAP}{D}[0-9०-९-]{{7,}}"),
)


def rules(tier: str) -> list[Rule]:
    """The rules of a tier and those before it; an unknown tier is an error."""
    return [r for r in RULES if TIERS.index(r.tier) <= TIERS.index(tier)]


def redacted(x: str | Column, tier: str, mark: str | None = None) -> Column:
    """The text with the name of its class in the place of each value, or with ``mark``."""
    out = F.col(x) if isinstance(x, str) else x
    for r in rules(tier):
        out = F.regexp_replace(out, r.remove, mark or f"[{r.kind}]")
    return out


def _found(x: Column, patterns: dict[str, str]) -> Column:
    """map of class and count, of classes that occur."""
    counts = F.create_map(*(v for kind, p in patterns.items() for v in (F.lit(kind), F.coalesce(F.regexp_count(x, F.lit(p)), F.lit(0)))))
    return F.map_filter(counts, lambda _, n: n > 0)


def residue(x: str | Column, tier: str) -> Column:
    """What the wider patterns still find of the tier's classes, by class."""
    return _found(F.col(x) if isinstance(x, str) else x, {r.kind: r.find for r in rules(tier)})


def published(df: DataFrame, column: str, tier: str, on_residue: str = "withhold") -> DataFrame:
    """``df`` with ``column`` redacted, and source_text (the text as it came, if redaction changed it or it is withheld), counts and residual (maps by class) and action.

    action: *same*, *redacted*, or with residue *withheld* (the text becomes null) or, with ``on_residue`` "keep", *refused*: the row stays as it was, as someone has to look at it first.
    A null text is *same*.
    """
    if on_residue not in ("withhold", "keep"):
        raise ValueError(f"on_residue is withhold or keep, not {on_residue!r}")
    done = df.withColumns({"_new": redacted(column, tier), "counts": _found(F.col(column), {r.kind: r.remove for r in rules(tier)})})
    # "[phone] 4913187196670932" has no label but the one that redaction wrote: such texts, and no others, are looked at with marks
    done = done.withColumn("_left", residue("_new", tier))
    done = done.withColumn("residual", F.when(F.size("_left") > 0, residue(redacted(column, tier, MARK), tier)).otherwise(F.col("_left")))
    left, changed = F.size("residual") > 0, ~F.col("_new").eqNullSafe(F.col(column))
    bad = "withheld" if on_residue == "withhold" else "refused"
    done = done.withColumn("action", F.when(left, bad).when(changed, "redacted").otherwise("same"))
    source = F.when(F.col("action").isin("withheld", "redacted"), F.col(column))
    text = F.when(F.col("action") == "refused", F.col(column)).when(F.col("action") != "withheld", F.col("_new"))
    return done.withColumns({"source_text": source, column: text}).drop("_new", "_left")
