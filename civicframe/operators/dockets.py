"""The docket import: one projection of flags over scraped rows, counters, statuses recomputed, hearings taken from stored JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicframe.functions import dockets as dk
from civicframe.functions import text as tx

#: Keys of a stored hearing that may hold its date.
DATE_KEYS = ("hearing_date_bs", "hearing_date", "date_bs")


def imported(raw: DataFrame) -> DataFrame:
    """Dockets of (court, case_number, case_type, case_status, defendant, defendants, extra), each with a flag for every rule it met.

    A row without a whole key is rejected. The case number and type are normalised, and the type as scraped goes to ``original_type`` if it changed. A header cell
    is no status. A roster is truncated if its stated total is over the number of names (``defendants``, an array), or if its last cell says "and others".
    """
    stated = tx.stated_defendants("defendant")
    made = raw.withColumns({"number": tx.case_number(F.trim("case_number")), "type": dk.case_type("case_type"), "status": dk.case_status("case_status"), "stated": stated})
    keyed = (F.trim(F.coalesce("court", F.lit(""))) != "") & (F.trim(F.coalesce("number", F.lit(""))) != "")
    changed = ~F.col("type").eqNullSafe(F.col("case_type"))
    names = F.coalesce(F.size("defendants"), F.lit(0))
    return made.select(
        F.trim("court").alias("court"), F.col("number").alias("case_number"), F.col("type").alias("case_type"), F.when(changed, F.col("case_type")).alias("original_type"),
        F.when(~dk.status_artifact("case_status"), F.col("case_status")).alias("case_status"), "status.lifecycle", "status.verdict", F.col("status.date_bs").alias("verdict_date_bs"),
        keyed.alias("keyed"), changed.alias("retyped"), dk.status_artifact("case_status").alias("header_status"), F.col("status.unmapped").alias("unmapped"),
        (F.coalesce(F.col("stated.total") > names, F.lit(False)) | F.col("stated.bare")).alias("truncated"), (F.col("number") != F.col("case_number")).alias("renumbered"),
    )


def counters(rows: DataFrame) -> DataFrame:
    """stage and n: how many rows each rule of the import met; one pass."""
    flags = {"rejected": ~F.col("keyed"), "retyped": F.col("retyped"), "header_status": F.col("header_status"), "unmapped": F.col("unmapped"), "truncated": F.col("truncated"), "renumbered": F.col("renumbered")}
    sums = rows.agg(F.count("*").alias("read"), *(F.count_if(v).alias(k) for k, v in flags.items()))
    return sums.unpivot([], ["read", *flags], "stage", "n")


def recomputed(cases: DataFrame) -> DataFrame:
    """``cases`` (case_status, verdict_type, verdict_date_bs, and outcome and outcome_date of the disposing hearing) as they ought to be.

    A header status goes. The outcome of the status wins over that of the hearing; a date only fills a missing one, that of the status first.
    """
    s = dk.case_status("case_status")
    return cases.withColumns({
        "verdict_type": F.coalesce(s["verdict"], "outcome", "verdict_type"),
        "verdict_date_bs": F.coalesce(F.nullif("verdict_date_bs", F.lit("")), s["date_bs"], "outcome_date"),
        "case_status": F.when(~dk.status_artifact("case_status"), F.col("case_status")),
    })


def stored_hearings(cases: DataFrame, held: DataFrame, column: str = "hearings") -> DataFrame:
    """court, case_number, hearing_date_bs and body of the hearings in a JSON list of each case, but for those in ``held`` already.

    The date is that of the first known key that has one; entries without are left out; of the same date in one case, the first.
    """
    entries = F.from_json(column, "array<map<string,string>>")
    rows = cases.select("court", "case_number", F.posexplode(entries).alias("place", "h"))
    date = F.coalesce(*(F.nullif(tx.bs_date(F.try_element_at("h", F.lit(k))), F.lit("")) for k in DATE_KEYS))
    rows = rows.select("court", "case_number", date.alias("hearing_date_bs"), "place", F.to_json("h").alias("body")).where(F.col("hearing_date_bs").rlike(r"^\d{4}-\d{2}-\d{2}$"))
    first = rows.groupBy("court", "case_number", "hearing_date_bs").agg(F.min_by("body", "place").alias("body"))
    return first.join(held.select("court", "case_number", "hearing_date_bs"), ["court", "case_number", "hearing_date_bs"], "left_anti")


def sweep_order(holes: DataFrame, probes: DataFrame, keys: list[str], today: Column, retry_days: int, most_misses: int) -> DataFrame:
    """Holes worth a probe, with their priority: never probed first, then by fewest misses and oldest probe; recent or hopeless ones wait."""
    both = holes.join(probes, keys, "left")
    due = F.col("last_probed").isNull() | ((F.col("misses") < most_misses) & (F.datediff(today, "last_probed") >= retry_days))
    return both.where(due).select(*holes.columns, F.coalesce("misses", F.lit(0)).alias("misses"), F.col("last_probed").isNull().alias("fresh"))


def probed(probes: DataFrame, found: DataFrame, keys: list[str], today: Column) -> DataFrame:
    """Probes after a sweep (``found``: keys and present): an absence adds a miss, a presence removes the row."""
    both = probes.withColumnsRenamed({"misses": "_m", "last_probed": "_l"}).join(found, keys, "full").where(~F.coalesce("present", F.lit(False)))
    absent = F.col("present").isNotNull()
    return both.select(*keys, (F.coalesce("_m", F.lit(0)) + absent.cast("int")).alias("misses"), F.when(absent, today).otherwise(F.col("_l")).alias("last_probed"))
