"""Mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of tokens. In every round, which is one window, a source earns ``window * share`` tokens of credit, and
it sends its next chunk once its credit covers it; what is left is its deficit, carried on. So the round of a chunk is
arithmetic on its place in the queue, and the order of service is a sort by (round, source, chunk): no
state passes from task to task, and a deficit crosses windows and partitions as a number. The chunks in this order are one
stream, cut into windows without gaps; only the last is short.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, pylists, ship, slices
from .tokens import encoder


#: Rows of (source, input split) that are broadcast.
SMALL = 500_000


def tokenize(docs: DataFrame, path: str, end_id: int = 1) -> DataFrame:
    """doc_id, source, ids (little-endian 32-bit, the end id last), n, and the place in the source's queue as (part, at)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, at = encoder(path), TaskContext.get().partitionId(), {}
        end = end_id.to_bytes(4, "little")
        for b in slices(batches, 256):
            _, texts, sources = pylists(b, "doc_id", "text", "source")
            ids = [x + end for x in encode([t or "" for t in texts])]
            starts = []
            for s, x in zip(sources, ids, strict=True):
                starts.append(at.get(s, 0))
                at[s] = starts[-1] + len(x) // 4
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sources, pa.string()), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([part] * len(ids), pa.int32()), pa.array(starts, pa.int64())],
                names=["doc_id", "source", "ids", "n", "part", "at"],
            )

    kept = docs.select("doc_id", "text", F.coalesce("source", F.lit("")).alias("source"))
    ship(docs.sparkSession)
    return kept.mapInArrow(run, "doc_id long, source string, ids binary, n long, part int, at long")


def pack(docs: DataFrame, path: str, window: int = 2048, grain: int = 256, shares: dict[str, float] | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids, doc_tokens, source, sequence_id, offset.

    path: the tokenizer's file. grain: tokens that a source sends at once. shares: target proportions of sources, from 0 and
    1 in sum at most; sources not named have what is left, by their sizes. A source without a share is served after all others; where one
    has run out, the others go on in their proportions. The pieces of a document tile its ids. Null texts count as empty: one end id. A null
    source is the source "". Repeated rows are packed each. An empty table gives no rows; other columns are ignored.
    """
    tokens = cut(tokenize(docs, path), "tokens")
    return arrange(tokens, window, grain, shares)


def checked(shares: dict[str, float] | None) -> dict[str, float]:
    """Target proportions as numbers from 0 that sum to 1 at most; raises ValueError for others."""
    out = {k: float(v) for k, v in (shares or {}).items()}
    if any(not math.isfinite(v) or v < 0 for v in out.values()) or sum(out.values()) > 1 + 1e-9:
        raise ValueError("shares must be numbers from 0 that sum to 1 at most")
    return out


def credits(sums: DataFrame, shares: dict[str, float], window: int) -> DataFrame:
    """source and credit of (source, n): the tokens that a source earns in a round; 0 for those that are served after all others."""
    named = sums.sparkSession.createDataFrame([*shares.items()], "source string, share double")
    of = sums.join(F.broadcast(named), "source", "left")  # as many rows as the caller named
    rest = of.agg(F.sum(F.when(F.col("share").isNull(), F.col("n")))).first()[0] or 1
    left = max(0.0, 1 - sum(shares.values()))
    return of.select("source", (F.coalesce("share", F.col("n") / rest * left) * window).alias("credit"))


def arrange(tokens: DataFrame, window: int = 2048, grain: int = 256, shares: dict[str, float] | None = None) -> DataFrame:
    """Pieces of what ``tokenize`` gave, written."""
    spark = tokens.sparkSession
    by_part = tokens.groupBy("source", "part").agg(F.sum("n").alias("n"))
    ordered = W.partitionBy("source").orderBy("part")  # a row for each input split at most, however large a source is
    queues = by_part.select("source", "part", (F.sum("n").over(ordered) - F.col("n")).alias("before"), F.sum("n").over(W.partitionBy("source")).alias("size"))
    weights = cut(credits(tokens.groupBy("source").agg(F.sum("n").alias("n")), checked(shares), window), "credits")
    queues = queues.join(weights, "source")
    if by_part.count() <= SMALL:  # else the tokens are shuffled to their queues
        queues = F.broadcast(queues)
    rows = tokens.join(queues, ["source", "part"]).withColumn("at", F.col("at") + F.col("before")).drop("before")
    k = F.explode(F.sequence(F.expr(f"at div {grain}"), F.expr(f"(at + n - 1) div {grain}")))
    pieces = rows.select("doc_id", "source", "ids", "n", "at", "size", "credit", k.alias("k"))
    first, last = F.greatest(F.col("at"), F.col("k") * grain), F.least(F.col("at") + F.col("n"), (F.col("k") + 1) * grain)
    pieces = pieces.withColumn("first", first).withColumn("length", last - first).withColumn("start", F.col("first") - F.col("at"))
    # A source begins with a credit of its own, or all small ones would wait for the last rounds.
    due = F.least((F.col("k") + 1) * grain, "size") - F.least(F.lit(grain), "size") * (F.pmod(F.xxhash64("source"), F.lit(1 << 20)) / float(1 << 20))
    last = queues.where("credit > 0").agg(F.max(F.ceil(F.col("size") / F.col("credit")))).first()[0] or 0
    turn = F.when(F.col("credit") > 0, F.ceil(due / F.col("credit"))).otherwise(int(last) + 1 + F.ceil(due / window))
    pieces = pieces.withColumn("round", turn.cast("long"))
    pieces = pieces.withColumn("ids", F.expr("substring(ids, cast(4 * start + 1 as int), cast(4 * length as int))"))
    pieces = pieces.select("doc_id", "source", "ids", F.col("n").alias("doc_tokens"), "start", "length", "round", "k", "first")
    before = W.partitionBy("block").orderBy("round")
    rounds = pieces.groupBy("round").agg(F.sum("length").alias("n")).withColumn("block", F.expr("round div 4096"))
    blocks = rounds.groupBy("block").agg(F.sum("n").alias("m"))
    blocks = blocks.select("block", (F.sum("m").over(W.orderBy("block")) - F.col("m")).alias("low"))  # a row for each 4,096 windows
    rounds = rounds.join(blocks, "block").select("round", (F.col("low") + F.sum("n").over(before) - F.col("n")).alias("base"))
    served = W.partitionBy("round").orderBy("source", "k", "first")
    placed = pieces.withColumn("within", F.sum("length").over(served) - F.col("length")).join(rounds, "round")
    placed = placed.withColumn("place", F.col("base") + F.col("within"))
    placed = placed.withColumn("sequence_id", F.explode(F.sequence(F.expr(f"place div {window}"), F.expr(f"(place + length - 1) div {window}"))))
    low = F.greatest(F.col("place"), F.col("sequence_id") * window)
    high = F.least(F.col("place") + F.col("length"), (F.col("sequence_id") + 1) * window)
    out = placed.withColumn("skip", low - F.col("place")).withColumn("len", high - low).withColumn("offset", low - F.col("sequence_id") * window)
    return out.select(
        "doc_id", (F.col("start") + F.col("skip")).alias("start"), F.col("len").alias("length"),
        F.expr("substring(ids, cast(4 * skip + 1 as int), cast(4 * len as int))").alias("ids"), "doc_tokens", "source", "sequence_id", "offset",
    )
