"""The event path on Structured Streaming; every step also runs on a static frame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicframe.functions.domain import disposition


def envelope(df: DataFrame, subject: Column, key: Column, occurred: Column, payload: list[str]) -> DataFrame:
    """subject, dedup_key, occurred_at (kept as it is, for the watermark), occurred (UTC text with Z) and the payload as JSON."""
    text = F.date_format(occurred, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return df.select(subject.alias("subject"), key.alias("dedup_key"), occurred.alias("occurred_at"), text.alias("occurred"), F.to_json(F.struct(*payload)).alias("payload"))


def deduplicated(df: DataFrame, delay: str = "48 hours") -> DataFrame:
    """First sight of each key: overlapping scans emit a row again and again, and state is kept for ``delay`` only."""
    if df.isStreaming:
        return df.withWatermark("occurred_at", delay).dropDuplicatesWithinWatermark(["dedup_key"])
    return df.dropDuplicates(["dedup_key"])


def window_totals(df: DataFrame, width: str, delay: str = "1 hour") -> DataFrame:
    out = df.withWatermark("occurred_at", delay) if df.isStreaming else df
    return out.groupBy(F.window("occurred_at", width).alias("w"), "subject").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "subject", "n")


def lookback(df: DataFrame, now: Column, hours: int = 48, most: int = 5000) -> tuple[DataFrame, DataFrame]:
    """(rows, report): the newest ``most`` rows of the last ``hours``, ties by dedup_key, to be emitted again on every run; and found and saturated, in one row.

    A saturated scan has dropped rows that the next one may not see either: it has to be reported, not passed over.
    """
    inside = df.where((F.col("occurred_at") >= now - F.make_dt_interval(F.lit(0), F.lit(hours))) & (F.col("occurred_at") <= now))
    report = inside.agg(F.count("*").alias("found")).withColumn("saturated", F.col("found") > most)
    return inside.orderBy(F.desc("occurred_at"), "dedup_key").limit(most), report


def backfill_totals(df: DataFrame, width: str, lag: str = "48 hours") -> DataFrame:
    """start, subject, fresh and backfilled: rows that were written (written_at) later than ``lag`` after they occurred tell of a backfill, not of what happened in the window."""
    late = F.col("written_at") > F.col("occurred_at") + F.expr(f"interval {lag}")
    counted = df.groupBy(F.window("occurred_at", width).alias("w"), "subject").agg(F.count_if(~late).alias("fresh"), F.count_if(late).alias("backfilled"))
    return counted.select(F.col("w.start").alias("start"), "subject", "fresh", "backfilled")


def within_bytes(df: DataFrame, size: Column, most: int, bucket: str = "hour") -> DataFrame:
    """The newest rows of each subject whose sizes sum to ``most`` bytes or less.

    Sums run over whole buckets of time first, a row for each; only the one bucket in which the bound falls is gone through row by row.
    """
    sized = df.withColumns({"_size": size, "_b": F.date_trunc(bucket, "occurred_at")})
    newer = Window.partitionBy("subject").orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    sums = sized.groupBy("subject", "_b").agg(F.sum("_size").alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(newer), F.lit(0))).where(F.col("_before") <= most)
    rows = sized.join(sums, ["subject", "_b"])
    edge = rows.where(F.col("_before") + F.col("_sum") > most)
    run = Window.partitionBy("subject", "_b").orderBy(F.desc("occurred_at"), F.desc("dedup_key"))
    kept = edge.withColumn("_run", F.sum("_size").over(run.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("_before") + F.col("_run") <= most)
    return rows.where(F.col("_before") + F.col("_sum") <= most).select(*df.columns).unionByName(kept.select(*df.columns))


def routed(subject: str | Column, pattern: str) -> Column:
    """Whether a subject meets a pattern: ``*`` is one token, a final ``>`` one or more."""
    out = []
    for token in pattern.split("."):
        out.append("[^.]+" if token == "*" else ".+" if token == ">" else token.replace("-", r"\-"))
    x = F.col(subject) if isinstance(subject, str) else subject
    return x.rlike("^" + r"\.".join(out) + "$")


def split(df: DataFrame, most: int) -> DataFrame:
    """Adds ``disposition`` from error, poison and delivered."""
    return df.withColumn("disposition", disposition(F.col("error"), F.col("poison"), F.col("delivered"), most))


def retained(df: DataFrame, now: Column, days: dict[str, int], otherwise: int) -> DataFrame:
    """Rows that are younger than what their subject's first token keeps."""
    keep = F.lit(otherwise)
    for subject, n in days.items():
        keep = F.when(F.split("subject", r"\.")[0] == subject, n).otherwise(keep)
    return df.where(F.col("occurred_at") >= now - F.make_dt_interval(keep))


def match_batches(static: DataFrame, match: Callable[[DataFrame, DataFrame], DataFrame], sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each micro-batch is matched to the static side; the sink gets its id, so that a replay overwrites."""
    return lambda batch, number: sink(match(batch, static), number)
