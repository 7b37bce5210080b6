"""Importance resampling towards a target distribution.

Words are hashed to buckets; a bucket's gain is the log ratio of its share in the target and in the corpus, a text's weight the mean of its features' gains, and
Gumbel noise keyed by the id turns the highest scores into a sample without replacement. The gains are one array, by which every text is scored where it lies.

The draw needs no sort of all rows: scores are integers, so their histogram is exact and has as many rows as there are scores. Its suffix sums
say how many rows have a higher score, and where the cutoff is; only the rows from there on are put in order, by id within each score.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicframe.operators.numbering import numbered

from .common import cut, pylists, ship, slices, utf8

BUCKETS = 10_000
#: Lower-cases A-Z, keeps 0-9, a-z and all bytes beyond ASCII, and makes spaces of the others.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
#: Features whose buckets a task remembers.
KNOWN = 1 << 20


class _Buckets(dict):
    """The bucket of each feature."""

    def __init__(self, n: int) -> None:
        self.n = n

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        out = self[feature] = zlib.crc32(feature) % self.n
        return out


def features(raw: bytes | None, most: int) -> tuple[list[bytes], int]:
    """The runs of 1 to ``most`` words of a text, repeats too, and the number of its words."""
    words = (raw or b"").translate(FOLD).split()
    out = words
    for k in range(2, most + 1):
        out = out + [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
    return out, len(words)


def counts(docs: DataFrame, most: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts are in each bucket. A task sends one row for each bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, total = _Buckets(buckets), np.zeros(buckets, np.int64)
        for b in slices(batches):
            of_batch = [np.zeros(0, np.int64)]
            for raw in utf8(b, "text"):
                found, _ = features(raw, most)
                of_batch.append(np.fromiter(map(of.__getitem__, found), np.int64, len(found)))
            total += np.bincount(np.concatenate(of_batch), minlength=buckets)
        has = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(total[has])], names=["bucket", "n"])

    ship(docs.sparkSession)
    sums = docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # a row for each bucket
    out = np.zeros(buckets, np.int64)
    for r in sums:
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> list[int]:
    """floor(1000 ln) of the ratio of each bucket's smoothed shares in the target and in the source."""
    n, s, t = len(source), int(source.sum()), int(target.sum())
    return [math.floor(1000 * math.log((int(b) + 1) * (s + n) / ((int(a) + 1) * (t + n)))) for a, b in zip(source, target, strict=True)]


def noise(doc_id: int | None, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: list[int], most: int = 1, seed: int = 2024) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, values = _Buckets(len(gain)), np.array(gain, np.int64)
        for b in slices(batches):
            (ids,) = pylists(b, "doc_id")
            words, sizes, weights = [], [], []
            for raw in utf8(b, "text"):
                found, n = features(raw, most)
                total = int(values[np.fromiter(map(of.__getitem__, found), np.int64, len(found))].sum())
                words.append(n)
                sizes.append(len(found))
                weights.append(total // len(found) if found else 0)
            scores = [w + noise(i, seed) for w, i in zip(weights, ids, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, words, sizes, weights, scores)], names=["doc_id", "n_words", "n_features", "weight", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def above(histogram: list[tuple[int, int]], wanted: int) -> tuple[dict[int, int], int | None]:
    """(rows with a higher score, by score; the cutoff score) of (score, rows) pairs, down to the score in which row ``wanted`` is."""
    out: dict[int, int] = {}
    higher = 0
    for score, n in sorted(histogram, reverse=True):
        if higher >= wanted:
            break
        out[score] = higher
        higher += n
    return out, min(out, default=None)


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least: int = 20, most: int = 1, buckets: int = BUCKETS, seed: int = 2024) -> DataFrame:
    """Every row of ``docs`` (doc_id, text): doc_id, n_features, weight, score and rank (1, 2, 3... of the drawn, by falling score, ties to smaller ids; null of the others).

    floor(percent * N / 100) of the N rows of ``least`` words or more are drawn. Words are runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased; features are
    runs of 1 to ``most`` words. Null texts have none, and weight 0. A null id counts as empty in the noise and comes last among ties. Repeated rows are rows,
    each; which of them has which rank isn't defined, as they are equal. Without rows in ``target`` its shares are all the same. Other columns are ignored.
    """
    ship(docs.sparkSession)
    gain = gains(counts(docs, most, buckets), counts(target, most, buckets))
    rows = cut(scored(docs, gain, most, seed), "scores")
    able = F.col("n_words") >= least
    histogram = [(r.score, r.n) for r in rows.where(able).groupBy("score").agg(F.count("*").alias("n")).collect()]  # scores span some tens of thousands
    wanted = percent * sum(n for _, n in histogram) // 100
    higher, cutoff = above(histogram, wanted)
    columns = ("doc_id", "n_features", "weight", "score")
    null = F.lit(None).cast("long")
    if cutoff is None:
        return rows.select(*columns, null.alias("rank"))
    drawn = able & (F.col("score") >= cutoff)
    offsets = docs.sparkSession.createDataFrame(sorted(higher.items()), "score long, higher long")
    ranked = numbered(rows.where(drawn).select(*columns), [F.asc_nulls_last("doc_id")], "score", "place")
    ranked = ranked.join(F.broadcast(offsets), "score").withColumn("rank", F.col("higher") + F.col("place"))  # a row for each score
    return ranked.select(*columns, F.when(F.col("rank") <= wanted, F.col("rank")).alias("rank")).unionByName(rows.where(~drawn).select(*columns, null.alias("rank")))
