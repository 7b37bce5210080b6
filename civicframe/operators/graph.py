"""Pointers, trees and registers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def resolve_chain(nodes: DataFrame, hops: int = 10) -> DataFrame:
    """id, target and hops of nodes (id, next): pointers followed by doubling, so ten hops take four joins; a cycle ends at the bound."""
    ends = nodes.select("id", F.coalesce("next", "id").alias("target"), F.when(F.col("next").isNull(), 0).otherwise(1).alias("hops"))
    span = 1
    while span < hops:
        to = ends.select(F.col("id").alias("target"), F.col("target").alias("_t"), F.col("hops").alias("_h"))
        ends = ends.join(to, "target", "left").select("id", F.coalesce("_t", "target").alias("target"), (F.col("hops") + F.coalesce("_h", F.lit(0))).alias("hops"))
        span *= 2
    return ends


def nearest(start: Column, parent: Callable[[Column], Column], found: Callable[[Column], Column], hops: int) -> Column:
    """``start`` if it is found, else the first found value above it, at most ``hops`` above; null if there is none.

    For trees whose parents follow from the key (numbers, codes, paths), so that each row walks by itself: no join, and no recursion with a bound on all rows. ``parent`` is null at the top.
    """
    up = F.aggregate(F.sequence(F.lit(1), F.lit(hops)), start, lambda at, _: F.when(found(at), at).otherwise(parent(at)))
    return F.when(found(up), up)


def gaps(registers: DataFrame, keys: list[str], seq: str, tail: int = 0, block: int = 1 << 16) -> DataFrame:
    """keys, seq and kind (interior, tail) of the numbers that a register implies but doesn't hold.

    Holes come from neighbours, so nothing is exploded but the holes themselves. Neighbours are looked for within blocks of numbers and then between
    blocks, so that one register may be of any size.
    """
    held = registers.select(*keys, seq).where(F.col(seq) >= 1).distinct().withColumn("_b", F.floor(F.col(seq) / block))
    before = F.lag(seq).over(Window.partitionBy(*keys, "_b").orderBy(seq))
    within = held.select(*keys, seq, before.alias("_p")).where(F.col("_p").isNotNull())
    edges = held.groupBy(*keys, "_b").agg(F.min(seq).alias("_low"), F.max(seq).alias("_high"))
    last = F.coalesce(F.lag("_high").over(Window.partitionBy(*keys).orderBy("_b")), F.lit(0))  # a row for each block
    between = edges.select(*keys, F.col("_low").alias(seq), last.alias("_p"))
    open_ = within.unionByName(between).where(F.col(seq) > F.col("_p") + 1)
    holes = open_.select(*keys, F.explode(F.sequence(F.col("_p") + 1, F.col(seq) - 1)).alias(seq), F.lit("interior").alias("kind"))
    if tail <= 0:
        return holes
    high = edges.groupBy(*keys).agg(F.max("_high").alias("_h"))
    return holes.unionByName(high.select(*keys, F.explode(F.sequence(F.col("_h") + 1, F.col("_h") + tail)).alias(seq), F.lit("tail").alias("kind")))


def ordered_pairs(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """keys, pairs and ordered: neighbours whose value doesn't run backwards."""
    w = Window.partitionBy(*keys).orderBy(order) if keys else Window.orderBy(order)
    p = F.lag(value).over(w)
    marked = df.where(F.col(value).isNotNull()).select(*keys, F.when(p.isNotNull(), (F.col(value) >= p).cast("int")).alias("ok"))
    return marked.groupBy(*keys).agg(F.count("ok").alias("pairs"), F.coalesce(F.sum("ok"), F.lit(0)).alias("ordered"))


def sequence_pairs(df: DataFrame, keys: list[str], seq: str, value: str, block: int = 1 << 16) -> DataFrame:
    """keys, pairs and ordered, as ``ordered_pairs`` has them in the order of a number and the value: within blocks of numbers, and between the last and the first of blocks, so that a register may be of any size."""
    rows = df.where(F.col(seq).isNotNull() & F.col(value).isNotNull()).select(*keys, seq, value, F.floor(F.col(seq) / block).alias("_b"))
    before = F.lag(value).over(Window.partitionBy(*keys, "_b").orderBy(seq, value))
    within = rows.select(*keys, (F.col(value) >= before).cast("int").alias("ok"))
    by = F.struct(seq, value)
    edges = rows.groupBy(*keys, "_b").agg(F.min_by(value, by).alias("_low"), F.max_by(value, by).alias("_high"))
    between = edges.select(*keys, (F.col("_low") >= F.lag("_high").over(Window.partitionBy(*keys).orderBy("_b"))).cast("int").alias("ok"))  # a row for each block
    return within.unionByName(between).groupBy(*keys).agg(F.count("ok").alias("pairs"), F.coalesce(F.sum("ok"), F.lit(0)).alias("ordered"))


def register_report(held: DataFrame, probes: DataFrame, keys: list[str], seq: str, date: str) -> DataFrame:
    """Of each register: held (numbers), high, density, probed, hits and hit_rate of ``probes`` (keys and seq), pairs, ordered and confidence.

    Rates are percentages with one decimal, null where there is nothing to say. The confidence is the share of neighbours whose dates don't run backwards: a low one says that the numbers aren't a
    sequence, so that what looks like a gap never was.
    """
    rate = lambda a, b: F.round(F.col(a) * 100.0 / F.nullif(F.col(b), F.lit(0)), 1)
    has = held.where(F.col(seq) >= 1)
    counted = has.groupBy(*keys).agg(F.count_distinct(seq).alias("held"), F.max(seq).alias("high")).withColumn("density", rate("held", "high"))
    tried = probes.select(*keys, seq).distinct().join(has.select(*keys, seq).distinct().withColumn("_hit", F.lit(1)), [*keys, seq], "left")
    tried = tried.groupBy(*keys).agg(F.count("*").alias("probed"), F.count("_hit").alias("hits")).withColumn("hit_rate", rate("hits", "probed"))
    pairs = sequence_pairs(has, keys, seq, date).withColumn("confidence", rate("ordered", "pairs"))
    zero = [F.coalesce(x, F.lit(0)).alias(x) for x in ("probed", "hits")]
    return counted.join(tried, keys, "left").join(pairs, keys, "left").select(*keys, "held", "high", "density", *zero, "hit_rate", "pairs", "ordered", "confidence")


def disjunctive_match(left: DataFrame, right: DataFrame, left_keys: list[tuple[str, Column]], right_keys: list[tuple[str, Column]], left_id: str, right_id: str, most: int) -> DataFrame:
    """left_id, right_id, confidence: rows that meet on any kind of reference, as one equi-join of (kind, value) pairs.

    A left row with more than ``most`` partners says nothing and goes; the confidence of the others is 1/n.
    """

    def refs(df: DataFrame, key: str, pairs: list[tuple[str, Column]]) -> DataFrame:
        of = F.array(*(F.struct(F.lit(k).alias("kind"), v.cast("string").alias("value")) for k, v in pairs))
        return df.select(key, F.explode(of).alias("r")).select(key, "r.kind", "r.value").where("value is not null")

    wanted, held = refs(left, left_id, left_keys).distinct(), refs(right, right_id, right_keys).distinct()
    # a key with too many partners condemns its left rows, so that it is never joined
    hot = held.groupBy("kind", "value").agg(F.count("*").alias("n")).where(F.col("n") > most).select("kind", "value")
    condemned = wanted.join(hot, ["kind", "value"], "left_semi").select(left_id).distinct()
    met = wanted.join(condemned, left_id, "left_anti").join(held, ["kind", "value"]).select(left_id, right_id).distinct()
    counted = met.withColumn("n", F.count("*").over(Window.partitionBy(left_id)))
    return counted.where(F.col("n") <= most).select(left_id, right_id, (F.lit(1).cast("double") / F.col("n")).alias("confidence"))


def unique_pairs(a: DataFrame, b: DataFrame, a_id: str, b_id: str, key: str, within: list[str] | None = None) -> DataFrame:
    """Pairs whose key is held by one row only on each side."""
    by = [*(within or []), key]
    one = lambda df, i: df.groupBy(*by).agg(F.min(i).alias(i), F.count("*").alias("n")).where("n = 1").drop("n")
    return one(a, a_id).join(one(b, b_id), by)
