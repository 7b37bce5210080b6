"""Bikram Sambat dates by a table of month lengths, which the caller supplies (year, month, days): no rule gives them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import ascii_digits, c


def month_starts(months: DataFrame, first_day: str) -> DataFrame:
    """year, month, days and the Gregorian start of each month; ``first_day`` is that of the first. A table of a few thousand rows at most."""
    before = F.sum("days").over(Window.orderBy("year", "month")) - F.col("days")
    return months.select("year", "month", "days", F.date_add(F.lit(first_day).cast("date"), before.cast("int")).alias("start"))


def _parts(x: str | Column) -> Column:
    """struct(y, m, d) of a date with - or /, in digits of either script; null for other shapes."""
    s = F.replace(F.trim(ascii_digits(x)), F.lit("/"), F.lit("-"))
    form = r"^(\d{1,4})-(\d{1,2})-(\d{1,2})$"
    part = lambda i: F.regexp_extract(s, form, i).try_cast("int")
    return F.when(s.rlike(form), F.struct(part(1).alias("y"), part(2).alias("m"), part(3).alias("d")))


def bs_to_ad(df: DataFrame, column: str, starts: DataFrame, name: str) -> DataFrame:
    """``df`` with the Gregorian date of a Bikram Sambat one; null for anything that is none in the table."""
    table = starts.select(F.col("year").alias("_y"), F.col("month").alias("_m"), F.col("days").alias("_days"), F.col("start").alias("_start"))
    out = df.withColumn("_p", _parts(column)).join(F.broadcast(table), (F.col("_p.y") == F.col("_y")) & (F.col("_p.m") == F.col("_m")), "left")
    day = F.when(F.col("_p.d").between(1, F.col("_days")), F.date_add("_start", F.col("_p.d") - 1))
    return out.withColumn(name, day).drop("_p", "_y", "_m", "_days", "_start")


def ad_to_bs(df: DataFrame, column: str, starts: DataFrame, name: str) -> DataFrame:
    """``df`` with the Bikram Sambat date, zero-padded, of a Gregorian one. A month of either calendar meets three of the other at most, so this is an equi-join on the Gregorian month."""
    last = F.date_add("start", F.col("days") - 1)
    met = F.array_distinct(F.array(F.trunc("start", "month"), F.trunc(F.date_add("start", F.lit(15)), "month"), F.trunc(last, "month")))
    table = starts.select(F.explode(met).alias("_month"), F.col("year").alias("_y"), F.col("month").alias("_m"), F.col("start").alias("_start"), last.alias("_last"))
    day = c(column).cast("date")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    text = F.concat_ws("-", F.lpad(F.col("_y").cast("string"), 4, "0"), two(F.col("_m")), two(F.datediff(day, "_start") + 1))
    on = (F.trunc(day, "month") == F.col("_month")) & (day >= F.col("_start")) & (day <= F.col("_last"))
    return df.join(F.broadcast(table), on, "left").withColumn(name, F.when(F.col("_y").isNotNull(), text)).drop("_month", "_y", "_m", "_start", "_last")


def lookback_days(df: DataFrame, day: Column, days: int, starts: DataFrame) -> DataFrame:
    """ad and bs of the ``days`` days up to ``day`` (an aggregate of df, or a literal), newest first in the calendar; days beyond the table have no bs."""
    series = df.agg(F.sequence(F.date_sub(day, days - 1), day).alias("_s")).select(F.explode("_s").alias("ad"))
    return ad_to_bs(series, "ad", starts, "bs")
