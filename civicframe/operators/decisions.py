"""What becomes of a name that a text mentions: bound to one entity, left to a person, or unknown."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicframe.functions import names
from civicframe.functions.domain import ladder
from civicframe.functions.text import has_devanagari


@dataclass(frozen=True)
class Lexicon:
    """The callers' word lists, in lower case: honorifics, groups of spellings of one word, surnames, particles, words for forms of organisations, and spellings of provinces."""

    honorifics: Sequence[str] = ()
    variants: Sequence[Sequence[str]] = ()
    surnames: Sequence[str] = ()
    particles: Sequence[str] = ()
    generic: Sequence[str] = ("office",)
    provinces: Mapping[str, Sequence[str]] = field(default_factory=lambda: {"": [""]})


def decided(mentions: DataFrame, candidates: DataFrame, lexicon: Lexicon, least: float = 0.85, prefer_coded: bool = False) -> DataFrame:
    """mention, entity (bound, else null), best, score, matched, verdict (BIND, REVIEW, NO_MATCH) and reason.

    mentions: mention (unique), name, complete (the search for it had no more rows; null counts as false). candidates: mention, entity, titles, relevance, coded (from the coded gazetteer), province,
    election (null: its record couldn't be read). Rows of one entity count as one, by their best title; titles in the script of the name are compared if there are any. A row without an
    entity counts only for the edge of the search.

    One entity of ``least`` or more binds, unless, in this order: there are several (``prefer_coded``: several coded ones, if any); the search may have been cut among rows as relevant
    as it; the name by itself is too weak; only another script could be compared; its province isn't in the name; the name is that of an organisation and begins other candidates' names, so it is
    a family; its record is of an election, or wasn't read.
    """
    tokens = lambda x: names.name_tokens(x, lexicon.honorifics, lexicon.variants)
    named = mentions.select("mention", "name", F.coalesce("complete", F.lit(False)).alias("complete"), tokens("name").alias("_tokens"))
    forms = F.filter(F.coalesce("titles", F.array().cast("array<string>")), lambda t: F.trim(F.coalesce(t, F.lit(""))) != "")
    rows = candidates.join(named.select("mention", "name", "_tokens"), "mention").withColumn("_forms", forms)
    rows = rows.withColumn("_own", F.exists("_forms", lambda t: has_devanagari(t) == has_devanagari("name")))
    each = rows.select("*", F.posexplode_outer("_forms").alias("_at", "_form")).withColumn("_long", tokens("_form"))
    compared = F.col("_form").isNotNull() & (~F.col("_own") | (has_devanagari("_form") == has_devanagari("name")))
    score = F.when(compared, names.match_score(F.col("_tokens"), F.col("_long"), lexicon.surnames, lexicon.particles)).otherwise(0.0)
    each = each.withColumn("_score", score).withColumn("_longer", F.col("_form").isNotNull() & names.heads(F.col("_tokens"), F.col("_long")))
    by = F.struct(-F.col("_score"), "_at", "_form")
    entities = each.withColumn("entity", F.nullif(F.trim("entity"), F.lit(""))).groupBy("mention", "entity").agg(
        F.max("_score").alias("score"), F.min_by("_form", by).alias("matched"), F.max("relevance").alias("relevance"), F.min("relevance").alias("_low"),
        F.coalesce(F.bool_or("coded"), F.lit(False)).alias("coded"), F.max("province").alias("province"), F.bool_or("election").alias("election"), F.bool_or("_longer").alias("longer"),
    )
    known = F.col("entity").isNotNull()
    fits, coded = known & (F.col("score") >= least), F.col("coded")
    whole = F.struct("entity", "score", "matched", "relevance", "coded", "province", "election", "longer")
    rank = F.struct(-F.col("score"), "entity")
    found = entities.groupBy("mention").agg(
        F.count_if(fits).alias("_n"), F.count_if(fits & coded).alias("_nc"), F.min_by(whole, F.when(known & (F.col("score") > 0), rank)).alias("_top"),
        F.min_by(whole, F.when(fits & coded, rank)).alias("_topc"), F.count_if(known & F.col("longer")).alias("_families"), F.min("_low").alias("_edge"),
    )
    narrow = F.lit(prefer_coded) & (F.col("_n") > 1) & (F.col("_nc") > 0)
    out = named.join(found, "mention", "left").withColumns({"_w": F.when(narrow, F.col("_topc")).otherwise(F.col("_top")), "_n": F.coalesce(F.when(narrow, F.col("_nc")).otherwise(F.col("_n")), F.lit(0))})
    w = F.col("_w")
    organisation = F.exists("_tokens", lambda t: F.arrays_overlap(t["forms"], F.array(*(F.lit(g) for g in lexicon.generic))))
    others = F.col("_families") - F.when(w["longer"], 1).otherwise(0)
    cut = ~F.col("complete") & (F.coalesce("_edge", F.lit(0.0)) >= F.coalesce(w["relevance"], F.lit(0.0)))
    reason = (
        F.when(F.col("_n") == 0, "below the threshold")
        .when(F.col("_n") > 1, "ambiguous")
        .when(cut, "search cut")
        .otherwise(
            F.coalesce(
                names.name_veto("name", lexicon.generic, w["coded"]),
                F.when(has_devanagari("name") & ~has_devanagari(w["matched"]), "other script only"),
                names.province_veto("name", w["province"], dict(lexicon.provinces)),
                F.when(organisation & (others > 0), "unqualified organisation"),
                F.when(w["election"].isNull(), "record not read").when(w["election"], "election record"),
            )
        )
    )
    out = out.withColumn("reason", reason)
    verdict = ladder((F.col("_n") == 0, "NO_MATCH"), (F.col("reason").isNotNull(), "REVIEW"), otherwise="BIND")
    return out.select("mention", F.when(F.col("reason").isNull(), w["entity"]).alias("entity"), w["entity"].alias("best"), F.coalesce(w["score"], F.lit(0.0)).alias("score"), w["matched"].alias("matched"), verdict.alias("verdict"), "reason")
