"""MinHash near-duplicates by an LSH forest, links confirmed on the full shingle sets.

Every text is its set of word shingles. Equal sets are one vertex from the start. Each of ``TREES`` labels of ``DEPTH`` minima is a tree
of the forest: an order of all vertices, sorted by label over the cluster. Neighbours in an order are candidates as deep as their longest common prefix, from
``BASE`` minima on; neighbours chained over all orders form regions. The depth adapts to the region. A sparse one, of bounded size, is compared whole at
``BASE``. A dense one is cut along the orders of ``SEEDS`` trees into chunks of bounded size, where the common prefix is shortest, so deeper
where more vertices stand; the links found there join most of a group of copies, and show which members have most links; what isn't joined yet is compared with these. Then whatever still shares ``BASE`` minima, but belongs to different components,
is compared block against block: all outside the largest component with all in it. So a group of copies costs no pairs of its own, no task compares more than a few hundred
vertices at a time, and no pair of neighbours is left out at any size. The confirmed links are contracted to components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, mark, pylists, ship, sifted, slices, small, utf8

SHINGLE = 5
#: A pair of similarity 0.75 misses all trees with a probability of (1 - 0.75**4)**28 = 2e-5.
TREES, BASE, DEPTH = 28, 4, 8
#: Shingles that are compared in one task at a time, and members.
WEIGHT, MEMBERS = 1 << 20, 256
#: The same, where blocks of different components meet.
BLOCK = 512
#: Edges whose components one task finds; more go in rounds over the cluster.
FEW = 10_000
#: Trees whose orders are cut into chunks in dense regions, and vertices with many links that all others of a region are compared with then.
SEEDS, HUBS = 8, 48
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_rng = np.random.default_rng(20)
MIX = np.array([pow(0x9E3779B97F4A7C15, j + 1, 1 << 64) for j in range(64)], dtype=np.uint64)
A = _rng.integers(1, 1 << 63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
B = _rng.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64)


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(raw: bytes | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; one of all words if they are fewer; none without words."""
    words = (raw or b"").translate(LOWER).split()  # of bytes: ASCII white space only
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = _stir(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n))
    k = min(k, n)
    out = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        out += h[j : j + n - k + 1] * MIX[j]
    return np.unique(_stir(out))


def set_key(s: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes()))))


def labels(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each tree the first BASE minima and the others, 16 bits of each, as one 64-bit number."""
    low = np.full(TREES * DEPTH, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 512):
        x = s[i : i + 512, None] * A
        x += B
        np.minimum(low, x.min(0), out=low)
    part = (_stir(low) & np.uint64(0xFFFF)).reshape(TREES, DEPTH)
    shift = np.array([48, 32, 16, 0], np.uint64)
    return (part[:, :BASE] << shift).sum(1, dtype=np.uint64).view(np.int64), (part[:, BASE:] << shift).sum(1, dtype=np.uint64).view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        n, key, base, rest = [], [], [], []
        for raw in utf8(b, "text"):
            s = shingles(raw)
            n.append(len(s))
            key.append(set_key(s) if len(s) else None)
            x, y = labels(s) if len(s) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            base.append(x)
            rest.append(y)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(key, pa.int64()), pa.array(base, pa.list_(pa.int64())), pa.array(rest, pa.list_(pa.int64()))], names=["doc_id", "mark", "n", "key", "base", "rest"])


def _prefixes(tree: np.ndarray, base: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Minima that each row has in common with the row before, from ``BASE`` on; 0 for fewer, and for the first row."""
    out = np.zeros(len(tree), np.int64)
    if len(tree) > 1:
        other = rest[1:].view(np.uint64) ^ rest[:-1].view(np.uint64)
        deep = BASE + sum((other >> np.uint64(16 * k) == 0).astype(np.int64) for k in range(DEPTH - BASE))
        out[1:] = np.where((tree[1:] == tree[:-1]) & (base[1:] == base[:-1]), deep, 0)
    return out


ORDERED = "part int, edge int, key long, n long, tree int, base long, rest long, prev long, depth int"


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by tree and label, those with a neighbour on either side, each with the one before it and their common prefix.

    The first and the last row of a task are always there (edge 1, 2 or both), as their neighbours may be in other tasks.
    """
    part, held, first = TaskContext.get().partitionId(), None, True

    def out(cols: dict[str, np.ndarray], depth: np.ndarray, edge: np.ndarray, keep: np.ndarray) -> pa.RecordBatch:
        prev = np.concatenate([[0], cols["key"][:-1]])
        arrays = [np.full(keep.sum(), part, np.int32), edge[keep].astype(np.int32), *(cols[c][keep] for c in ("key", "n")), cols["tree"][keep].astype(np.int32), cols["base"][keep], cols["rest"][keep]]
        own = depth[keep]
        return pa.RecordBatch.from_arrays([*map(pa.array, arrays), pa.array(prev[keep], mask=own == 0), pa.array(own.astype(np.int32))], names=[x.split()[0] for x in ORDERED.split(", ")])

    for b in batches:
        if not b.num_rows:
            continue
        cols = {c: b.column(b.schema.get_field_index(c)).to_numpy() for c in ("key", "n", "tree", "base", "rest")}
        if held:  # the last row of the batch before, and the row before that, which only its prefix needs
            cols = {c: np.concatenate([held[c], cols[c]]) for c in cols}
        depth = _prefixes(cols["tree"], cols["base"], cols["rest"])
        keep = depth > 0
        keep[:-1] |= depth[1:] > 0
        edge = np.zeros(len(keep), np.int64)
        if first:
            edge[0] = 1
        keep |= edge > 0
        done = 1 if held and len(held["key"]) > 1 else 0
        keep[:done], keep[-1] = False, False  # the row before is out already; the last waits for its successor
        if keep.any():
            yield out(cols, depth, edge, keep)
        first = first and len(keep) == 1
        held = {c: v[-2:] for c, v in cols.items()}
    if held:
        depth = _prefixes(held["tree"], held["base"], held["rest"])
        keep = np.arange(len(depth)) == len(depth) - 1
        yield out(held, depth, np.where(keep, 3 if first else 2, 0), keep)


def _seam(ordered: DataFrame) -> list[tuple[int, int]]:
    """The neighbours that stand in different tasks: of two rows a task at most, whatever the number of rows."""
    edges = sorted(ordered.where("edge > 0").select("part", "edge", "key", "tree", "base").collect())
    pairs = [(x, y) for x, y in zip(edges, edges[1:], strict=False) if x.part != y.part and (x.tree, x.base) == (y.tree, y.base)]
    return [(x.key, y.key) for x, y in pairs]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key and group of rows sorted by tree and label: runs with a common prefix, cut where it is shortest once they are full."""
    keys: list[int] = []
    sizes: list[int] = []
    depths: list[int] = []
    tree, last, made = 0, None, ([], [])

    def close(n: int) -> None:
        if n > 1:
            group = xxhash.xxh3_64_intdigest(f"{tree} {keys[0]} {keys[n - 1]}".encode())
            made[0].extend(keys[:n])
            made[1].extend([int(np.int64(np.uint64(group)))] * n)
        del keys[:n], sizes[:n], depths[:n]

    for b in batches:
        cols = [b.column(b.schema.get_field_index(c)).to_numpy() for c in ("tree", "base", "rest", "key", "n")]
        if last is not None:
            cols = [np.concatenate([x, y]) for x, y in zip(last, cols, strict=True)]
        depth = _prefixes(*cols[:3])
        for i in range(0 if last is None else 1, len(depth)):
            if depth[i] == 0:
                close(len(keys))
                tree = int(cols[0][i])
            elif len(keys) >= MEMBERS or sum(sizes) + cols[4][i] > WEIGHT and len(keys) > 1:
                at = min(range(len(keys) // 2, len(keys)), key=lambda k: (depths[k], -k), default=0)
                close(max(1, at if depths[at] < depth[i] else len(keys)))
            keys.append(int(cols[3][i]))
            sizes.append(int(cols[4][i]))
            depths.append(int(depth[i]))
        last = [c[-1:] for c in cols]
        if made[0]:
            yield pa.RecordBatch.from_arrays([pa.array(made[0], pa.int64()), pa.array(made[1], pa.int64())], names=["key", "group"])
            made = ([], [])
    close(len(keys))
    if made[0]:
        yield pa.RecordBatch.from_arrays([pa.array(made[0], pa.int64()), pa.array(made[1], pa.int64())], names=["key", "group"])


def _sorted(rows: DataFrame) -> DataFrame:
    """The forest's orders: rows sorted by tree and label over the cluster; equal labels in another order in each tree."""
    by = ["tree", "base", "rest", F.xxhash64("key", "tree")]
    return rows.repartitionByRange(*by).sortWithinPartitions(*by)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of the members, and the groups each is compared in; of repeated rows in a task, one."""
    seen: set[int] = set()
    for b in slices(batches):
        keys, groups, sets = [], [], []
        for raw, key, own in zip(utf8(b, "text"), *pylists(b, "key", "groups"), strict=True):
            if key not in seen:
                seen.add(key)
                keys.append(key)
                groups.append(own)
                sets.append(shingles(raw).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(groups, pa.list_(pa.int64())), pa.array(sets, pa.binary())], names=["key", "groups", "hashes"])


def links(keys: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links with 100 * intersection >= percent * union: all pairs are looked at, and the members with most links are the middle of stars."""
    m = len(keys)
    if m < 2:
        return []
    sizes = np.array([len(s) for s in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    inside, near = np.zeros(int(ids.max()) + 1, bool), np.zeros((m, m), bool)
    for d in range(1, m):
        own = ids[starts[d] : starts[d] + sizes[d]]
        inside[own] = True
        both = np.add.reduceat(inside[ids[: starts[d]]].astype(np.int32), starts[:d])
        inside[own] = False
        near[d, :d] = 100 * both >= percent * (sizes[:d] + sizes[d] - both)
    near |= near.T
    of, out = np.arange(m), []
    for d in np.argsort(-near.sum(1), kind="stable"):
        for e in np.flatnonzero(near[d]):
            if of[e] != of[d]:
                out.append((keys[d], keys[e]))
                of[of == of[e]] = of[d]
    return out


def _compare(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group and key."""
        now, keys, sets = None, [], []

        def done() -> pa.RecordBatch:
            found = links(keys, sets, percent)
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["u", "v"])

        for b in batches:
            for group, key, raw in zip(*pylists(b, "group", "key", "hashes"), strict=True):
                if group != now:
                    if len(keys) > 1:
                        yield done()
                    now, keys, sets = group, [], []
                if not keys or keys[-1] != key:
                    keys.append(key)
                    sets.append(np.frombuffer(raw, np.uint64))
        if len(keys) > 1:
            yield done()

    return run


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id and root of every vertex of ``FEW`` edges at most."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := above.setdefault(x, x)) != x:
            above[x] = above.setdefault(up, up)
            x = above[x]
        return x

    for b in batches:
        for u, v in zip(*pylists(b, "u", "v"), strict=True):
            u, v = root(u), root(v)
            above[max(u, v)] = min(u, v)
    yield pa.RecordBatch.from_arrays([pa.array(above, pa.int64()), pa.array([root(x) for x in [*above]], pa.int64())], names=["id", "root"])


def components(edges: DataFrame) -> DataFrame:
    """id and root of every vertex of ``edges`` (u, v): root is the smallest id of its component.

    Each round maps a vertex to the smallest of itself and its neighbours and contracts the edges. The ids are hashes, so about
    half of the vertices go in a round, whatever the shape. Aggregates combine before the shuffle: a hub is one row from each task.
    The last ``FEW`` edges are contracted at once: rounds over them would cost the driver as many jobs and tasks as those over all.
    """
    maps = []
    edges = cut(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    while n := edges.count():
        if n <= FEW:
            maps.append(cut(edges.coalesce(1).mapInArrow(_finish, "id long, root long"), "step"))
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        step = cut(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("id"), F.least("u", "m").alias("root")), "step")
        maps.append(step)
        a, b = step.select(F.col("id").alias("u"), F.col("root").alias("x")), step.select(F.col("id").alias("v"), F.col("root").alias("y"))
        edges = edges.join(a, "u").join(b, "v").where("x <> y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct()
        edges = cut(edges, "edges")
    if not maps:
        return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
    out = maps[0]
    for step in maps[1:]:
        out = out.join(step.select(F.col("id").alias("root"), F.col("root").alias("next")), "root", "left").select("id", F.coalesce("next", "root").alias("root"))
    return cut(out, "components") if len(maps) > 1 else out


def _blocks(weight: Column, members: Column) -> Column:
    """Blocks of at most about half of what a task compares."""
    return F.ceil(F.greatest(2 * weight / WEIGHT, 2 * members / BLOCK, F.lit(1.0))).cast("long")


def _fits(members: int | None = None) -> Column:
    return (F.col("weight") <= WEIGHT) & (F.col("members") <= (members or MEMBERS))


def _hubs(dense: DataFrame, parts: DataFrame, found: DataFrame) -> DataFrame:
    """key and groups of the vertices of heavy regions that aren't in their region's largest component, in blocks, each with the ``HUBS`` vertices of the region that have most links.

    A copy of a text is linked to that text far more often than to another copy, so this joins what the chunks left, at a cost in proportion.
    """
    rows = dense.select("key", "root").join(parts, "key")
    sizes = rows.groupBy("root", "part").agg(F.count("*").alias("m"))
    top = sizes.groupBy("root").agg(F.max(F.struct("m", "part")).alias("top"), F.sum("m").alias("members"))
    top = top.select("root", F.col("top.part").alias("top"), F.ceil((F.col("members") - F.col("top.m")) / (MEMBERS - HUBS)).cast("int").alias("blocks")).where("blocks > 0")
    top = small(cut(top, "tops"))
    outside = rows.join(top, "root").where("part <> top").select("key", F.array(F.xxhash64(F.lit("hubs"), "root", F.pmod(F.xxhash64("key"), F.col("blocks").cast("long")))).alias("groups"))
    degrees = found.select(F.explode(F.array("u", "v")).alias("key")).groupBy("key").agg(F.count("*").alias("degree")).where("degree > 1")
    linked = rows.join(degrees, "key").join(top, "root").where("part = top")
    ranked = linked.groupBy("root", "blocks", F.pmod(F.xxhash64("key"), F.lit(HUBS))).agg(F.max(F.struct("degree", "key")).alias("hub")).select("root", "blocks", "hub.key")  # the first of each share of a region
    every = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.xxhash64(F.lit("hubs"), F.col("root"), k.cast("long")))
    return outside.unionByName(ranked.select("key", every.alias("groups")))


def _rest(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """key and group of the vertices in heavy regions whose bucket holds different components (``parts``: key, part).

    Pairs within the largest component of a bucket need no look. Its blocks meet those of the other vertices, and these each other.
    """
    path = ["tree", "base"]
    rows = cut(rows.select("key", "n", *path).join(parts, "key"), "parted")
    by = rows.groupBy(*path, "part").agg(F.sum("n").alias("w"), F.count("*").alias("m"))
    buckets = by.groupBy(*path).agg(F.sum("w").alias("weight"), F.sum("m").alias("members"), F.max(F.struct("w", "m", "part")).alias("top"), F.count("*").alias("parts"))
    buckets = buckets.where(F.col("parts") > 1)
    few = _blocks(F.col("weight") - F.col("top.w"), F.col("members") - F.col("top.m"))
    buckets = buckets.select(*path, _fits(BLOCK).alias("whole"), few.alias("few"), _blocks(F.col("top.w"), F.col("top.m")).alias("many"), F.col("top.part").alias("top"))
    rows = rows.join(small(cut(buckets, "buckets")), path)
    whole = rows.where("whole").select("key", F.xxhash64(F.lit("whole"), *path).alias("group"))
    split = rows.where("not whole").withColumn("inner", F.col("part") == F.col("top"))
    split = split.withColumn("block", F.expr("if(inner, few + pmod(xxhash64(key), many), pmod(xxhash64(key), few))"))
    split = split.withColumn("other", F.explode(F.expr("sequence(0L, few + if(inner, 0L, many) - 1)"))).where("block <> other")
    return whole.unionByName(split.select("key", F.xxhash64(F.lit("split"), *path, F.least("block", "other"), F.greatest("block", "other")).alias("group"))).distinct()


def _hashes(docs: DataFrame, members: DataFrame) -> DataFrame:
    """key, groups and hashes of the vertices in ``members`` (key, doc_id, mark, groups)."""
    members = cut(members.withColumnsRenamed({"doc_id": "member", "mark": "member_mark"}), "members")
    rows, few = docs.select("doc_id", "text"), small(members)
    if few is members:  # too many to broadcast: only texts that a bitmap can't rule out are shuffled
        rows = sifted(rows, members, "member_mark")
    members = few
    return rows.join(members, rows.doc_id.eqNullSafe(members.member) & (mark(rows.text) == members.member_mark)).select("key", "groups", "text").mapInArrow(_sets, "key long, groups array<long>, hashes binary")


def _links(grouped: DataFrame, percent: int) -> DataFrame:
    """The confirmed links of ``grouped`` (key, group, hashes)."""
    return grouped.repartition("group").sortWithinPartitions("group", "key").mapInArrow(_compare(percent), "u long, v long")


def classes(docs: DataFrame, percent: int = 75) -> DataFrame:
    """``near_duplicates`` with the hash of the text of each row (mark), which names a row together with its id."""
    ship(docs.sparkSession)
    signed = docs.select("doc_id", mark().alias("mark"), "text").select("doc_id", "mark", "text")
    signed = cut(signed.mapInArrow(_signed, "doc_id long, mark long, n long, key long, base array<long>, rest array<long>"), "signed")
    own = signed.where("key is not null")
    reps = own.groupBy("key").agg(F.first("n").alias("n"), F.first("base").alias("base"), F.first("rest").alias("rest"))
    trees = reps.select("key", "n", F.posexplode(F.arrays_zip("base", "rest")).alias("tree", "at")).select("key", "n", "tree", "at.base", "at.rest")
    near = cut(_sorted(trees).mapInArrow(_neighbours, ORDERED), "near")
    spark = docs.sparkSession
    chained = near.where("prev is not null").select(F.col("prev").alias("u"), F.col("key").alias("v")).unionByName(spark.createDataFrame(_seam(near), "u long, v long"))

    regions = components(chained)
    named = own.groupBy("key").agg(F.min_by(F.struct("doc_id", "mark"), F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("row"))
    sizes = near.groupBy("key").agg(F.first("n").alias("n")).join(regions.withColumnRenamed("id", "key"), "key")
    vertices = cut(sizes.join(named, "key").select("key", "n", "root", "row.doc_id", "row.mark"), "vertices")
    weights = vertices.groupBy("root").agg(F.sum("n").alias("weight"), F.count("*").alias("members"))
    heavy = small(cut(weights.where(~_fits()).select("root"), "heavy-roots"))
    light = vertices.join(heavy, "root", "left_anti").select("key", "doc_id", "mark", F.array(F.xxhash64(F.lit("region"), "root")).alias("groups"))
    dense = vertices.join(heavy, "root", "left_semi").select("key", "root", "doc_id", "mark")
    some = not heavy.isEmpty()
    members = light
    if some:
        inside = cut(near.select("key", "n", "tree", "base", "rest").join(dense.select("key"), "key", "left_semi"), "inside")
        groups = _sorted(inside.where(F.col("tree") < SEEDS)).mapInArrow(_chunks, "key long, group long").groupBy("key").agg(F.collect_set("group").alias("groups"))  # SEEDS at most
        members = light.unionByName(dense.drop("root").join(groups, "key"))
    found = cut(_links(_hashes(docs, members).select("key", F.explode("groups").alias("group"), "hashes"), percent), "links")
    joined = components(found)
    if some:
        def parts() -> DataFrame:
            return cut(dense.select("key").join(joined.withColumnRenamed("id", "key"), "key", "left").select("key", F.coalesce("root", "key").alias("part")), "parts")

        hubs = _hubs(dense, parts(), found).join(dense.select("key", "doc_id", "mark"), "key")
        more = _links(_hashes(docs, hubs).select("key", F.explode("groups").alias("group"), "hashes"), percent)
        joined = components(joined.select(F.col("id").alias("u"), F.col("root").alias("v")).unionByName(more))
        rest = cut(_rest(inside, parts()), "rest")
        if not rest.isEmpty():
            members = dense.drop("root").join(rest.select("key").distinct(), "key").withColumn("groups", F.expr("cast(array() as array<bigint>)"))
            more = _links(_hashes(docs, members).drop("groups").join(rest, "key").select("key", "group", "hashes"), percent)
            joined = components(joined.select(F.col("id").alias("u"), F.col("root").alias("v")).unionByName(more))

    keys = own.groupBy("key").agg(F.min("doc_id").alias("first"), F.min("mark").alias("least")).join(joined.withColumnRenamed("id", "key"), "key", "left")
    keys = keys.withColumn("root", F.coalesce("root", "key"))
    keys = cut(keys, "keys")
    ids = keys.groupBy("root").agg(F.min("first").alias("component_id"), F.min("least").alias("least"), F.count("*").alias("m")).where("m > 1")
    ids = small(cut(ids.drop("m"), "ids"))  # the components of several sets, so that a large one isn't a hot key of a join while they are few
    of = keys.join(ids.withColumnRenamed("least", "of_all"), "root", "left").select("key", F.coalesce("component_id", "first").alias("component_id"), F.coalesce("of_all", "least").alias("least"))
    out = signed.select("doc_id", "mark", F.col("n").alias("n_shingles"), "key").join(of, "key", "left")
    component = F.coalesce("component_id", "doc_id")
    alone = component.isNull() & F.coalesce(F.col("mark") == F.col("least"), F.lit(True))
    kept = F.when(F.col("doc_id").isNotNull(), F.col("doc_id") == component).otherwise(alone)
    return out.select("doc_id", "mark", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable), kept (doc_id = component_id).

    Texts without words (null, empty) have no shingles and are alone. Rows without a doc_id link as others do, and aren't kept where a row with one is in their
    component; a component of such rows alone has the component_id null, and those with its smallest text hash are kept. Repeated rows have the same component,
    and are kept alike. Other columns are ignored. An empty table gives no rows.
    """
    return classes(docs, percent).drop("mark")
