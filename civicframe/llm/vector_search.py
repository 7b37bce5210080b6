"""Exact top-k search by inner product over a pivot-distance index.

Vectors are scaled to integers, and equal ones are one entry. An entry's key is its nearest pivot and its distance from it; sorted by key over the
cluster, entries form annuli: blocks with a lowest and a highest distance and a greatest norm. For a query q and an annulus around p, the triangle
inequality bounds the distance of q from its entries by that of d(q, p) from the annulus, and so the inner product, (|q|^2 + |x|^2 - |q - x|^2) / 2, from above.

A query meets its own block first, which gives it a score that its k-th best reaches at least. Then the sorted annuli are gone through outwards, by the directory of rings
and again block by block, as far as a bound reaches that score; blocks of queries meet blocks of entries as matrices. No partner is left out but by a bound.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, pylists, ship, slices

SCALE = 64
#: Pivots, chosen far from each other among so many vectors (those with the smallest hashes); every vector is indexed.
PIVOTS, SAMPLE = 16, 1024
#: Rings of a pivot in the directory, by the quantiles of the sample's distances, and entries in a block.
RINGS, BLOCK = 8, 2048
#: Sums of products below this are exact in doubles.
EXACT = float(1 << 53)
#: Relative slack of bounds, above the rounding of distances, which are roots of differences.
SLACK = 1e-6
TYPES = (np.int8, np.int16, np.int32, np.int64)


def packed(v: list[float | None] | None, scale: int = SCALE) -> tuple[int, bytes] | None:
    """(dimension, integers of the smallest width that holds them) of a vector; None if it takes no part."""
    if v is None or any(x is None for x in v):
        return None
    a = np.floor(np.array(v, np.float64) * scale)
    if not np.isfinite(a).all() or len(a) and np.abs(a).max() >= 2.0**63:
        return None
    n = a.astype(np.int64)
    return len(n), n.astype(next(t for t in TYPES if len(n) == 0 or np.iinfo(t).min <= n.min() and n.max() <= np.iinfo(t).max)).tobytes()


def matrix(raws: list[bytes], dim: int) -> np.ndarray:
    """The integers of packed vectors of one dimension, as doubles."""
    if not dim:
        return np.zeros((len(raws), 0))
    widths = {len(r) // dim for r in raws}
    if len(widths) == 1:
        return np.frombuffer(b"".join(raws), TYPES[widths.pop().bit_length() - 1]).reshape(-1, dim).astype(np.float64)
    return np.array([np.frombuffer(r, TYPES[(len(r) // dim).bit_length() - 1]).astype(np.float64) for r in raws])


def products(q: list[bytes], x: list[bytes], dim: int) -> np.ndarray:
    """Exact inner products; those beyond a long are put at its bounds."""
    a, b = matrix(q, dim), matrix(x, dim)
    if not dim or np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * dim < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = lambda raws: np.array([np.frombuffer(r, TYPES[(len(r) // dim).bit_length() - 1]).astype(np.int64).tolist() for r in raws], object)
    low, high = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    return np.array([[min(max(int(s), low), high) for s in row] for row in whole(q) @ whole(x).T], np.int64).reshape(len(q), len(x))


def _packing(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ids, made = [], []
            for i, v in zip(*pylists(b, "vec_id", "embedding"), strict=True):
                if p := packed(v, scale):
                    ids.append(i)
                    made.append(p)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([d for d, _ in made], pa.int32()), pa.array([r for _, r in made], pa.binary())], names=["vec_id", "dim", "vec"])

    return run


def pivots(vectors: DataFrame, most: int = PIVOTS, sample: int = SAMPLE) -> tuple[dict[int, np.ndarray], dict[int, list[np.ndarray]]]:
    """By dimension the pivots, and of each pivot the bounds between its rings, from a sample of bounded size."""
    taken = vectors.orderBy(F.xxhash64("vec"), "vec").limit(sample).collect()
    of: dict[int, list[bytes]] = defaultdict(list)
    for r in taken:
        of[r.dim].append(bytes(r.vec))
    points, bounds = {}, {}
    for dim, raws in of.items():
        x = matrix(raws, dim)
        chosen = [0]
        near = ((x - x[0]) ** 2).sum(1)
        while len(chosen) < most and near.max() > 0:
            chosen.append(int(near.argmax()))
            near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(1))
        points[dim] = x[chosen]
        d = distances(x, points[dim])
        home = d.argmin(1)
        bounds[dim] = [np.quantile(d[home == p, p], np.arange(1, RINGS) / RINGS) for p in range(len(chosen))]  # a pivot is at home with itself
    return points, bounds


def distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (points**2).sum(1) - 2 * (x @ points.T), 0))


def _keyed(points: dict[int, np.ndarray]):
    """The nearest pivot and the distance from it; a dimension that the sample hasn't has the origin for a pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            dims, raws = pylists(b, "dim", "vec")
            cell, far = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for dim in set(dims):
                at = [i for i, d in enumerate(dims) if d == dim]
                d = distances(matrix([raws[i] for i in at], dim), points.get(dim, np.zeros((1, dim))))
                cell[at], far[at] = d.argmin(1), d.min(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(far)], names=[*b.schema.names, "cell", "distance"])

    return run


def _kth(scores: np.ndarray, times: np.ndarray, k: int) -> np.ndarray:
    """Of each row the k-th best score, entries counted as often as they have ids; the lowest number if there are fewer."""
    if times.sum() < k:
        return np.full(len(scores), np.iinfo(np.int64).min)
    every = np.repeat(scores, times, axis=1)
    return np.partition(every, every.shape[1] - k, axis=1)[:, every.shape[1] - k]


BLOCKS = "dim int, cell int, ring int, low double, high double, peak double, ids array<array<long>>, vecs array<binary>, queries array<binary>, floors array<long>"


def _blocks(bounds: dict[int, list[np.ndarray]], k: int):
    """Annuli of rows sorted by dimension, pivot and distance: the entries, the queries among them, and the score that each query's k-th best reaches at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def close() -> pa.RecordBatch:
            dim, cell = held[0][0], held[0][1]
            vecs, ids = [h[3] for h in held], [h[4] for h in held]
            peak = float((matrix(vecs, dim) ** 2).sum(1).max())
            asked = [h for h in held if h[5]]
            floors = _kth(products([h[3] for h in asked], vecs, dim), np.array([*map(len, ids)]), k).tolist() if asked else []
            edges = bounds.get(dim)
            ring = int(np.searchsorted(edges[cell], held[0][2])) if edges else 0
            row = [dim, cell, ring, held[0][2], held[-1][2], peak, ids, vecs, [h[3] for h in asked], floors]
            held.clear()
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.list_(pa.int64())), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=[c.split()[0] for c in BLOCKS.split(", ")])

        for b in batches:
            for row in zip(*pylists(b, "dim", "cell", "distance", "vec", "ids", "asked"), strict=True):
                if held and (len(held) >= BLOCK or row[:2] != held[0][:2]):
                    yield close()
                held.append(row)
        if held:
            yield close()

    return run


def _reach(norms: np.ndarray, far: np.ndarray, low: np.ndarray, high: np.ndarray, peak: np.ndarray) -> np.ndarray:
    """The highest inner product that each query (norms, distances from the pivots) may have with an entry of each annulus."""
    apart = np.maximum(low - far, far - high) - SLACK * (np.sqrt(norms)[:, None] + 2 * np.sqrt(peak) + high)
    return (norms[:, None] + peak - np.maximum(apart, 0) ** 2) / 2 + SLACK * (norms[:, None] + peak)


def _aimed(points: dict[int, np.ndarray], rings: dict[int, list[tuple]]):
    """The targets of each block of queries: the slots of all rings that a bound doesn't exclude for one of them at least, nearest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 16):
            out = []
            for dim, queries, floors in zip(*pylists(b, "dim", "queries", "floors"), strict=True):
                q = matrix(queries, dim)
                cell, ring, low, high, peak, slots = map(np.array, zip(*rings[dim], strict=True))
                far = distances(q, points.get(dim, np.zeros((1, dim))))[:, cell]
                reach = _reach((q**2).sum(1), far, low, high, peak)
                open_ = (reach >= np.array(floors, np.float64)[:, None]).any(0)
                order = [i for i in np.argsort(-reach.max(0), kind="stable") if open_[i]]
                out.append([{"cell": int(cell[i]), "ring": int(ring[i]), "slot": s} for i in order for s in range(slots[i])])
            kind = pa.list_(pa.struct([("cell", pa.int32()), ("ring", pa.int32()), ("slot", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, kind)], names=[*b.schema.names, "targets"])

    return run


def _met(points: dict[int, np.ndarray], k: int):
    """The hits of a block of queries in a block of entries: of each query the k best ids that reach its score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 16):
            made: tuple[list, list, list, list] = ([], [], [], [])
            for dim, cell, low, high, peak, ids, vecs, queries, floors in zip(*pylists(b, "dim", "cell", "low", "high", "peak", "ids", "vecs", "queries", "floors"), strict=True):
                q = matrix(queries, dim)
                far = distances(q, points.get(dim, np.zeros((1, dim)))[cell][None, :])
                floors = np.array(floors, np.int64)
                live = np.flatnonzero(_reach((q**2).sum(1), far, np.array([low]), np.array([high]), np.array([peak]))[:, 0] >= floors)
                if not len(live):
                    continue
                scores = products([queries[i] for i in live], vecs, dim)
                floors = np.maximum(floors[live], _kth(scores, np.array([*map(len, ids)]), k))
                for i, at in enumerate(live):
                    hits = np.flatnonzero(scores[i] >= floors[i])
                    best = sorted((-int(scores[i, h]), x) for h in hits for x in ids[h])[:k]
                    made[0].extend([dim] * len(best))
                    made[1].extend([queries[at]] * len(best))
                    made[2].extend(x for _, x in best)
                    made[3].extend(-s for s, _ in best)
            yield pa.RecordBatch.from_arrays([pa.array(made[0], pa.int32()), pa.array(made[1], pa.binary()), pa.array(made[2], pa.int64()), pa.array(made[3], pa.int64())], names=["dim", "query", "vec_id", "score"])

    return run


def search(vectors: DataFrame, every: int = 20, k: int = 20, scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: of each row of (vec_id, embedding) whose id is divisible by ``every`` the k best other rows, ties to smaller ids.

    Components are floor(scale * x). Vectors that are null, hold nulls, NaN, infinities or what doesn't fit a long, and rows without an id, take no part. A repeated row counts once; of different vectors with
    one id each is a query and an entry, but none is a result of that id's queries. Only vectors of equal length meet; those of no components have the score 0. Fewer than k other rows: all of them. Other columns are
    ignored. An empty table gives no rows.
    """
    ship(vectors.sparkSession)
    rows = vectors.select("vec_id", "embedding").where("vec_id is not null").mapInArrow(_packing(scale), "vec_id long, dim int, vec binary")
    rows = cut(rows, "vectors").withColumn("asks", F.col("vec_id") % every == 0)
    # an entry for equal vectors, with the k + 1 smallest ids: no others can be among the k best of a query; the limit is put before the shuffle, too
    w = Window.partitionBy("vec", "dim", "asks").orderBy("vec_id")
    first = rows.distinct().withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1)
    entries = first.groupBy("dim", "vec").agg(F.slice(F.array_sort(F.collect_set("vec_id")), 1, k + 1).alias("ids"), F.max("asks").alias("asked"))  # twice k + 1 at most
    points, bounds = pivots(rows)
    by = ["dim", "cell", "distance", "vec"]
    entries = entries.mapInArrow(_keyed(points), "dim int, vec binary, ids array<long>, asked boolean, cell int, distance double")
    blocks = cut(entries.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_blocks(bounds, k + 1), BLOCKS), "annuli")
    place = ["dim", "cell", "ring"]
    found = blocks.groupBy(*place).agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("peak").alias("peak"), F.count("*").alias("slots")).collect()  # RINGS for each pivot at most
    rings: dict[int, list[tuple]] = defaultdict(list)
    for r in found:
        rings[r.dim].append((r.cell, r.ring, r.low, r.high, r.peak, r.slots))
    slots = vectors.sparkSession.createDataFrame([(r.dim, r.cell, r.ring, r.slots) for r in found], "dim int, cell int, ring int, slots long")
    held = blocks.select(*place, "low", "high", "peak", "ids", "vecs").join(F.broadcast(slots), place).withColumn("slot", F.pmod(F.xxhash64("vecs"), "slots")).drop("slots")
    asking = blocks.where(F.size("queries") > 0).select("dim", "queries", "floors").mapInArrow(_aimed(points, rings), "dim int, queries array<binary>, floors array<long>, targets array<struct<cell: int, ring: int, slot: bigint>>")
    pairs = asking.select("dim", "queries", "floors", F.inline("targets")).join(held, [*place, "slot"])
    hits = cut(pairs.mapInArrow(_met(points, k + 1), "dim int, query binary, vec_id long, score long"), "hits")

    best = hits.withColumn("r", F.row_number().over(Window.partitionBy("dim", "query").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1)
    best = best.groupBy("dim", "query").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("best"))  # k + 1 at most
    queries = rows.where("asks").select(F.col("vec_id").alias("query_id"), "dim", F.col("vec").alias("query")).distinct()
    own = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = queries.join(best, ["dim", "query"]).select("query_id", F.posexplode(own).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))
