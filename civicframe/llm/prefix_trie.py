"""A trie of conversations by their common openings.

Each prefix of a conversation has a chained digest: that of the prefix before, and of the last turn's role and text. Prefixes grouped by
(depth, digest) are the nodes. Sums over subtrees explode each node to its ancestors and group by these.

Both go in blocks of ``BLOCK`` turns, so that one conversation may hold any share of all turns: blocks are digested side by side, the chain
goes on over whole blocks (and blocks of blocks), and a node is exploded to the ancestors in its own block; what the tops of the next blocks have gathered
goes to the block before. A conversation of n turns costs n * BLOCK rows at most, not n * n, and conversations of up to ``BLOCK`` turns are one block.
Nodes of one conversation alone need no sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicframe.operators.numbering import numbered

from .common import cut, pylists, ship

BLOCK = 32
#: Words are runs of what isn't one of the ASCII white spaces.
WORD = r"[^\x20\x09-\x0D]+"
#: Ids in one row of what ends at a node.
IDS = 4096
EMPTY = hashlib.sha256().hexdigest()


def digests(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), digest and words of each turn of (conv_id, turn, role, text), in the order of turn, null first; equal turns in that of their digests.

    Null role and text are empty. Turns without a conv_id belong to no conversation. Texts stay where they are; digests are sorted.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    both = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = turns.where("conv_id is not null").select("conv_id", "turn", F.unhex(F.sha2(both.cast("binary"), 256)).alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    return numbered(rows, [F.asc_nulls_first("turn"), "digest"], "conv_id", "pos", 0).drop("turn")


def opened(rows: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Conversations rebuilt on common openings, as ``digests`` has them: the first h turns of conversation c - c % every (all if it has fewer, none if it isn't there),
    then c's own behind its first h, with h = crc32(decimal c) % most.

    conv_id, pos, digest, words; a conversation without turns has one row with pos null.
    """
    heads = rows.where(F.col("pos") < most - 1).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "words"))).alias("head"))  # most - 1 turns
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    own = sizes.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % every).alias("donor"), h.alias("h"))
    heads = own.join(heads.withColumnRenamed("conv_id", "donor"), "donor", "left").select("conv_id", "n", "h", F.slice(F.coalesce("head", F.expr("cast(array() as array<struct<pos: bigint, digest: binary, words: bigint>>)")), 1, F.col("h")).alias("head"))
    heads = cut(heads, "openings")
    shifts = heads.select("conv_id", F.col("h").alias("_h"), (F.size("head") - F.col("h")).alias("_shift"))
    tails = rows.join(shifts, "conv_id").where(F.col("pos") >= F.col("_h")).select("conv_id", (F.col("pos") + F.col("_shift")).alias("pos"), "digest", "words")
    fronts = heads.select("conv_id", F.inline("head")).select("conv_id", "pos", "digest", "words")
    none = heads.where((F.size("head") == 0) & (F.col("n") <= F.col("h"))).select("conv_id", F.lit(None).cast("long").alias("pos"), F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("long").alias("words"))
    return tails.unionByName(fronts).unionByName(none)


def _sha(*parts: str) -> str:
    return f"unhex(sha2(concat({', '.join(parts)}), 256))"


def chained(rows: DataFrame) -> DataFrame:
    """conv_id, pos, key, before, words of (conv_id, pos, digest, words): key is the digest of the prefix that ends at pos, before that of the prefix before (empty at pos 0)."""
    by = rows.withColumn("block", F.expr(f"pos div {BLOCK}"))
    blocks = by.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "words"))).alias("turns"))  # BLOCK turns at most
    if (rows.agg(F.max("pos")).first()[0] or 0) < BLOCK:
        blocks = blocks.withColumns({"seed": F.lit(b""), "end": F.lit(None).cast("binary")})
    else:
        blocks = cut(blocks, "blocks")
        full = blocks.where(F.size("turns") == BLOCK).select("conv_id", F.col("block").alias("pos"), F.expr("unhex(sha2(array_join(transform(turns, t -> hex(t.digest)), ''), 256))").alias("digest"), F.lit(0).cast("long").alias("words"))
        upper = cut(chained(full), "upper")
        ends = upper.select("conv_id", F.col("pos").alias("block"), F.col("key").alias("end"))
        seeds = upper.select("conv_id", (F.col("pos") + 1).alias("block"), F.col("key").alias("seed"))
        blocks = blocks.join(ends, ["conv_id", "block"], "left").join(seeds, ["conv_id", "block"], "left").withColumn("seed", F.coalesce("seed", F.lit(b"")))
    # the keys within the block, one after the other; that at the end of a full block is the chain over whole blocks
    fold = f"aggregate(turns, array(seed), (acc, t) -> concat(acc, array({_sha('element_at(acc, -1)', 't.digest')})))"
    keys = blocks.select("conv_id", "turns", "end", F.expr(fold).alias("keys"))
    rows = keys.select("conv_id", "end", "keys", F.posexplode("turns").alias("at", "turn"))
    key = F.when((F.col("at") == BLOCK - 1) & F.col("end").isNotNull(), F.col("end")).otherwise(F.expr("keys[at + 1]"))
    return rows.select("conv_id", "turn.pos", key.alias("key"), F.expr("keys[at]").alias("before"), "turn.words")


SUMS = ("leaves", "saved")


def _upward(nodes: DataFrame, paths: DataFrame, first: Column, last: Column) -> DataFrame:
    """The sums of ``nodes`` (conv_id, block, pos, SUMS) by the elements first to last (from 0) of their conversation's keys in ``paths`` (conv_id, block, keys)."""
    rows = nodes.join(paths, ["conv_id", "block"]).select(F.posexplode(F.slice("keys", first + 1, last - first + 1)).alias("at", "key"), (F.col("block") * BLOCK + first).alias("low"), *SUMS)
    return rows.groupBy((F.col("low") + F.col("at")).alias("pos"), "key").agg(*(F.sum(c).alias(c) for c in SUMS))


def subtree_sums(nodes: DataFrame, prefixes: DataFrame) -> DataFrame:
    """pos, key and the sums of leaves and saved over the subtree of each of ``nodes`` (conv_id of a member, pos, key, leaves, saved), itself included.

    prefixes: conv_id, pos and key of every prefix. Nodes must have their ancestors among them.
    """
    block = F.expr(f"pos div {BLOCK}")
    of = prefixes.withColumn("block", block).groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(F.struct("pos", "key"))).alias("p"))  # BLOCK at most
    paths = of.select("conv_id", "block", F.expr("transform(p, x -> x.key)").alias("keys"))
    at = (F.col("pos") % BLOCK).cast("int")
    own = _upward(nodes.select("conv_id", block.alias("block"), "pos", *SUMS), paths, F.lit(0), at)
    if (nodes.agg(F.max("pos")).first()[0] or 0) < BLOCK:
        return own
    own, paths = cut(own, "own"), cut(paths, "paths")
    tops = nodes.where(F.col("pos") % BLOCK == 0).select("conv_id", "pos", "key").join(own, ["pos", "key"]).select("conv_id", block.alias("pos"), "key", *SUMS)
    upper = subtree_sums(cut(tops, "tops"), prefixes.where(F.col("pos") % BLOCK == 0).select("conv_id", block.alias("pos"), "key"))
    upper = upper.where("pos > 0").join(tops.select("conv_id", "pos", "key"), ["pos", "key"])
    more = _upward(upper.select("conv_id", (F.col("pos") - 1).alias("block"), "pos", *SUMS), paths, F.lit(0), F.lit(BLOCK - 1))
    return own.unionByName(more).groupBy("pos", "key").agg(*(F.sum(c).alias(c) for c in SUMS))


def trie(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, ends) of conversations as ``digests`` has them (pos null: a conversation without turns).

    nodes: conv_id (the smallest member), depth, digest (null at the root), parent_conv_id, n_convs, n_children, n_leaves, saved_tokens. ends: depth, digest and conv_id of
    the node at which each conversation ends. No conversation: no node.
    """
    chain = chained(rows.where("pos is not null"))
    prefixes = cut(chain, "prefixes")
    nodes = prefixes.groupBy("pos", "key").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("before").alias("before"), F.first("words").alias("words"))
    nodes = cut(nodes, "nodes")
    kids = nodes.where("pos > 0").groupBy((F.col("pos") - 1).alias("pos"), F.col("before").alias("key")).agg(F.count("*").alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("single"))
    nodes = nodes.join(kids, ["pos", "key"], "left").withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "single": F.coalesce("single", F.lit(0))})
    nodes = cut(nodes, "children")
    shared = nodes.where("n_convs > 1").select("conv_id", "pos", "key", (F.col("single") + (F.col("n_children") == 0).cast("long")).alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    sums = subtree_sums(cut(shared, "shared"), prefixes.select("conv_id", "pos", "key"))

    last = prefixes.groupBy("conv_id").agg(F.max_by("key", "pos").alias("digest"), (F.max("pos") + 1).alias("depth"))
    none = rows.where("pos is null").select("conv_id", F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("depth"))
    ends = last.unionByName(none).select("depth", "digest", "conv_id")

    up = nodes.select((F.col("pos") + 1).alias("pos"), F.col("key").alias("before"), F.col("conv_id").alias("parent_conv_id"))
    everyone = rows.agg(F.min("conv_id").alias("conv_id"), F.count_distinct("conv_id").alias("n_convs")).where("n_convs > 0")
    top = everyone.select("conv_id")
    full = nodes.join(sums, ["pos", "key"], "left").join(up, ["pos", "before"], "left")
    full = full.select("conv_id", (F.col("pos") + 1).alias("depth"), F.col("key").alias("digest"), F.coalesce("parent_conv_id", top.scalar()).alias("parent_conv_id"), "n_convs", "n_children", F.coalesce("leaves", F.lit(1).cast("long")).alias("n_leaves"), F.coalesce("saved", F.lit(0).cast("long")).alias("saved_tokens"))
    below = nodes.agg(F.count_if(F.col("pos") == 0).alias("n_children"), F.count_if(F.col("n_children") == 0).alias("n_leaves"), F.coalesce(F.sum((F.col("n_convs") - 1) * F.col("words")), F.lit(0)).alias("saved_tokens"))
    root = everyone.join(F.broadcast(below)).select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", F.greatest("n_leaves", F.lit(1).cast("long")).alias("n_leaves"), "saved_tokens")  # of one row each
    return full.unionByName(root), ends


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of the ids of each node, comma-joined; rows come sorted by node and block of ids."""
    node, state, made = None, None, []
    for b in batches:
        for depth, digest, ids in zip(*pylists(b, "depth", "digest", "ids"), strict=True):
            if (depth, digest) != node:
                if node:
                    made.append((*node, state.hexdigest()))
                node, state = (depth, digest), hashlib.sha256()
            else:
                state.update(b",")
            state.update(",".join(map(str, ids)).encode())
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), (pa.int64(), pa.binary(), pa.string()), strict=True)], names=["depth", "digest", "ends_sha256"])
            made = []
    if node:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*node, state.hexdigest()), (pa.int64(), pa.binary(), pa.string()), strict=True)], names=["depth", "digest", "ends_sha256"])


def ends_sha256(ends: DataFrame) -> DataFrame:
    """depth, digest and the lowercase SHA-256 of the decimal ids that end there, ascending, comma-joined.

    Ids are gathered in blocks of ``IDS`` numbers, then the blocks of a node pass through one hash, a block at a time.
    """
    block = F.shiftright("conv_id", IDS.bit_length() - 1)
    ids = ends.groupBy("depth", "digest", block.alias("block")).agg(F.array_sort(F.collect_set("conv_id")).alias("ids"))  # IDS at most
    return ids.repartition("depth", "digest").sortWithinPartitions("depth", "digest", "block").mapInArrow(_hashed, "depth long, digest binary, ends_sha256 string")


def prefix_trie(turns: DataFrame, rebuild: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, ends) of the conversations of (conv_id, turn, role, text), rebuilt on common openings first if wanted. See ``digests``, ``opened`` and ``trie``.

    Repeated rows are turns, each; turns of equal number are put in the order of their digests. Other columns are ignored.
    """
    ship(turns.sparkSession)
    rows = digests(turns)
    return trie(cut(opened(rows), "opened") if rebuild else rows)
