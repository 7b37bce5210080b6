"""The tag vocabulary: keys, resolution over aliases and merges, and broader tags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicframe.functions.text import c, devanagari_nfc

from .graph import resolve_chain

#: Vowel signs that are typed as two.
REPAIRS = (("ाे", "ो"), ("ाै", "ौ"))
EDGES = ".,;:!?\"'()[]{}"


def tag_key(x: str | Column) -> Column:
    """The key of a raw tag: signs repaired, separators as spaces, no punctuation at the ends, in lower case."""
    s = devanagari_nfc(x)
    for broken, whole in REPAIRS:
        s = F.replace(s, F.lit(broken), F.lit(whole))
    s = F.trim(F.regexp_replace(F.regexp_replace(s, "[-_]+", " "), r"(?U)\s+", " "))
    return F.lower(F.trim(F.btrim(s, F.lit(EDGES))))


def resolved(raw: DataFrame, column: str, aliases: DataFrame, tags: DataFrame) -> DataFrame:
    """``raw`` with resolution (canonical, retired or unknown), tag and reason.

    aliases: key, tag (null if retired), reason. tags: id, merged_into. Merges are followed, cycle-safe.
    """
    ends = resolve_chain(tags.select("id", F.col("merged_into").alias("next"))).select(F.col("id").alias("_tag"), F.col("target").alias("_end"))
    known = aliases.join(ends, aliases.tag == ends._tag, "left").select(F.col("key").alias("_key"), F.coalesce("_end", "tag").alias("tag"), F.col("reason").alias("reason"), F.lit(True).alias("_known"))
    out = raw.join(known, tag_key(column) == F.col("_key"), "left")
    how = F.when(F.col("_known").isNull(), "unknown").when(F.col("tag").isNull(), "retired").otherwise("canonical")
    return out.withColumn("resolution", how).drop("_key", "_known")


def with_broader(tags: DataFrame, depth: int = 6) -> DataFrame:
    """id and ancestor of each tag (id, broader), itself included, up to ``depth`` levels; a cycle ends there."""
    up = tags.where("broader is not null").select(F.col("id").alias("ancestor"), F.col("broader").alias("next"))
    level = tags.select("id", F.col("id").alias("ancestor"))
    out = level
    for _ in range(depth):
        level = level.join(up, "ancestor").select("id", F.col("next").alias("ancestor"))
        out = out.unionByName(level)
    return out.distinct()


def keyword_tags(text: str | Column, rules: Sequence[tuple[str, str, Sequence[str]]], most: int) -> Column:
    """The tags (tag, class, keywords) whose keywords the text holds, in the order of the rules, ``most`` of each class."""
    low = F.lower(F.coalesce(c(text), F.lit("")))
    out = []
    for name in dict.fromkeys(r[1] for r in rules):
        hits = []
        for tag, _, words in (r for r in rules if r[1] == name):
            met = F.lit(False)
            for w in words:
                met = met | F.contains(low, F.lit(w.lower()))
            hits.append(F.when(met, F.lit(tag)))
        out.append(F.slice(F.array_distinct(F.array_compact(F.array(*hits))), 1, most))
    return F.array_distinct(F.concat(*out))
