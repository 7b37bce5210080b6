"""Rules of the domain as column expressions: proceedings, visibility, dispositions, job states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import c

VISIBILITY = ("PRIVATE", "UNLISTED", "LISTED")


def ladder(*arms: tuple[Column, object], otherwise: object = None) -> Column:
    """The value of the first arm whose condition holds."""
    out = F.lit(otherwise) if not isinstance(otherwise, Column) else otherwise
    for condition, value in reversed(arms):
        out = F.when(condition, value).otherwise(out)
    return out


def proceeding_dates(stages: str | Column, court: tuple[str, ...]) -> Column:
    """struct(started, decided) of array<struct<stage, start, end>>: the earliest start, and the latest end unless a stage is open."""
    own = F.filter(c(stages), lambda s: s["stage"].isin(*court))
    started = F.array_min(F.transform(own, lambda s: s["start"]))
    ends = F.transform(own, lambda s: s["end"])
    return F.struct(started.alias("started"), F.when(~F.exists(ends, lambda e: e.isNull()), F.array_max(ends)).alias("decided"))


def single_stage_dates(stages: str | Column, stage: str) -> Column:
    """struct(start, end) of the only stage of this name, else null."""
    own = F.filter(c(stages), lambda s: s["stage"] == stage)
    return F.when(F.size(own) == 1, F.struct(own[0]["start"].alias("start"), own[0]["end"].alias("end")))


def visibility_rank(state: str | Column, public: tuple[str, ...], unlisted: tuple[str, ...]) -> Column:
    """2, 1 or 0; unknown and null states confer nothing."""
    return ladder((c(state).isin(*public), 2), (c(state).isin(*unlisted), 1), otherwise=0)


def visibility(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, VISIBILITY)), F.coalesce(rank, F.lit(0)).cast("int") + 1)


def policy_visibility(policy: str | Column, rank: Column) -> Column:
    """PUBLIC and PRIVATE are fixed, anything else defers to the citing cases."""
    return ladder((c(policy) == "PUBLIC", "LISTED"), (c(policy) == "PRIVATE", "PRIVATE"), otherwise=visibility(rank))


def disposition(error: Column, poison: Column, delivered: Column, most: int) -> Column:
    """ack, dead_letter or retry; an unknown delivery count is buried, as it could be the last."""
    return ladder((~error, "ack"), (poison | delivered.isNull() | (delivered >= most), "dead_letter"), otherwise="retry")


def review_disposition(gates: Column, overall: Column, passing: float, revising: float) -> Column:
    return ladder((~gates, "REJECT"), (overall >= passing, "PASS"), (overall >= revising, "REVISE"), otherwise="REJECT")


def backoff(attempts: Column) -> Column:
    """Seconds until a job is tried again."""
    return ladder((attempts <= 1, 60), (attempts == 2, 300), (attempts == 3, 900), otherwise=1800)


def job_state(succeeded: Column, retryable: Column, attempts: Column, most: int) -> Column:
    return ladder((succeeded, "done"), (retryable & (attempts < most), "queued"), (retryable, "dead"), otherwise="failed")


def percent(part: Column, whole: Column) -> Column:
    """One place, 0 for an empty whole."""
    return F.when(F.coalesce(whole, F.lit(0)) == 0, 0.0).otherwise(F.round(100.0 * part.cast("double") / whole, 1))


def clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def confidence(std: Column, n: Column) -> Column:
    return ladder((n < 2, "single"), (std <= 5, "high"), (std <= 12, "medium"), otherwise="low")


def finite(x: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
