"""Writes as functions of two frames: what is stored and what comes in, joined once on the natural key."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _merged(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], value: Callable[[Column, Column], Column]) -> tuple[DataFrame, list[str]]:
    columns = [x for x in stored.columns if x not in keys]
    s, i = stored.select(*keys, F.struct(*columns).alias("_old")), incoming.select(*keys, F.struct(*columns).alias("_new"))
    both = s.join(i, list(keys), "full")
    return both.select(*keys, "_old", "_new", *(value(F.col(f"_new.{x}"), F.col(f"_old.{x}")).alias(x) for x in columns)), columns


def upsert(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], tombstone: str | None = None) -> DataFrame:
    """Incoming values win where they aren't null; a tombstoned row that comes in again is revived. Adds ``action``."""
    out, columns = _merged(stored, incoming, keys, F.coalesce)
    revived = F.col("_new").isNotNull() & F.col(f"_old.{tombstone}") if tombstone else F.lit(False)
    if tombstone:
        out = out.withColumn(tombstone, F.when(F.col("_new").isNotNull(), False).otherwise(F.col(tombstone)))
    action = F.when(F.col("_new").isNull(), "kept").when(F.col("_old").isNull(), "created").when(F.coalesce(revived, F.lit(False)), "revived").otherwise("updated")
    return out.select(*keys, *columns, action.alias("action"))


def gap_fill(stored: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Only fills what the stored row lacks. action: created, updated (something was filled), unchanged or kept."""
    out, columns = _merged(stored, incoming, keys, lambda new, old: F.coalesce(old, new))
    filled = F.lit(False)
    for x in columns:
        filled = filled | (F.col(f"_old.{x}").isNull() & F.col(f"_new.{x}").isNotNull())
    action = F.when(F.col("_new").isNull(), "kept").when(F.col("_old").isNull(), "created").when(filled, "updated").otherwise("unchanged")
    return out.select(*keys, *columns, action.alias("action"))


def map_union(old: Column, new: Column) -> Column:
    """Maps united; a value that isn't null wins over the old one."""
    empty = F.create_map().cast("map<string,string>")
    return F.map_zip_with(F.coalesce(old, empty), F.coalesce(new, empty), lambda k, a, b: F.coalesce(b, a))


def promoted(old_value: Column, old_at: Column, new_value: Column, new_at: Column) -> Column:
    """The new value unless it is older than what is stored: a late arrival never undoes a newer one."""
    return F.when(new_value.isNotNull() & (old_at.isNull() | (new_at >= old_at)), new_value).otherwise(old_value)


def changed_columns(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows that changed, each with the sorted names of what did: the groups of a batched update."""
    columns = sorted(x for x in before.columns if x not in keys)
    b = before.select(*keys, *(F.col(x).alias(f"_{x}") for x in columns))
    names = F.filter(F.array(*(F.when(~F.col(f"_{x}").eqNullSafe(F.col(x)), F.lit(x)) for x in columns)), lambda v: v.isNotNull())
    return after.join(b, list(keys)).select(*keys, F.array_join(names, ",").alias("changed")).where("changed <> ''")


def latest(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each group: an aggregate that combines before the shuffle, instead of a window that sorts all."""
    rest = [x for x in df.columns if x not in by]
    return df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*by, *(F.col(f"_row.{x}").alias(x) for x in rest))


def first_occurrence(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    rest = [x for x in df.columns if x not in by]
    return df.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*by, *(F.col(f"_row.{x}").alias(x) for x in rest))


def versioned(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Each incoming document with its next version; created_at of the first write stays. Of repeated keys the first by ``position`` counts."""
    once = first_occurrence(incoming, [key], ["position"])
    return once.join(stored.select(key, F.col("version").alias("_v"), F.col("created_at").alias("_c")), key, "left").select(
        *[x for x in once.columns if x not in ("position", "created_at")], (F.coalesce("_v", F.lit(0)) + 1).alias("version"), F.coalesce("_c", "created_at").alias("created_at")
    )


def fold_collisions(binds: DataFrame, mapping: DataFrame, key: str, group: Sequence[str], note: str, verdict: str) -> DataFrame:
    """Repoints ``key`` by mapping (old, new) and folds rows that now collide: notes joined, a settled verdict wins."""
    to = binds.join(mapping.withColumnRenamed("old", key), key, "left").withColumn(key, F.coalesce("new", key)).drop("new")
    return to.groupBy(key, *group).agg(F.array_join(F.array_sort(F.collect_set(note)), "; ").alias(note), F.max(verdict).alias(verdict), F.count("*").alias("folded"))


def top_n(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each group, with their place and the size of the group."""
    w = Window.partitionBy(*by)
    return df.withColumn("place", F.row_number().over(w.orderBy(*order))).withColumn("total", F.count("*").over(w)).where(F.col("place") <= n)


def replace_children(stored: DataFrame, incoming: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """Child rows after the rows of ``documents`` (key) were written anew: theirs are those of ``incoming``, none if it has none; the others stay."""
    gone = documents.select(key).distinct()
    return stored.join(gone, key, "left_anti").unionByName(incoming.join(gone, key, "left_semi"))


def request_numbers(df: DataFrame, size: Column, ceiling: int, shard: Column, order: Sequence[str]) -> DataFrame:
    """``df`` with ``shard`` and ``request``: rows of a request have at most ``ceiling`` bytes in sum. A row of more raises an error.

    A request is what begins within one step of the running sum; the step is the ceiling less the largest row, so no request overflows. Sums run within shards, in parallel.
    """
    sized = df.withColumns({"shard": shard, "_size": size})
    largest = sized.agg(F.max("_size")).first()[0] or 0
    if largest >= ceiling:
        raise ValueError(f"a row has {largest} bytes, and a request takes fewer than {ceiling}")
    start = F.sum("_size").over(Window.partitionBy("shard").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size")
    return sized.withColumn("request", F.floor(start / (ceiling - largest))).drop("_size")


def attached(media: Column, role: Column, sha256: Column, url: Column) -> Column:
    """An array of struct(role, sha256, url) with a capture: the same role and hash takes the place of the old one, anything else is appended."""
    new = F.struct(role.alias("role"), sha256.alias("sha256"), url.alias("url"))
    same = lambda m: (m["role"] == role) & (m["sha256"] == sha256)
    old = F.coalesce(media, F.array().cast("array<struct<role:string,sha256:string,url:string>>"))
    return F.when(F.exists(old, lambda m: F.coalesce(same(m), F.lit(False))), F.transform(old, lambda m: F.when(F.coalesce(same(m), F.lit(False)), new).otherwise(m))).otherwise(F.array_append(old, new))


def promoted_held(held: DataFrame, sources: DataFrame, key: str, publisher: Column, least: int) -> DataFrame:
    """Held records with ``publishers`` and ``promoted``: those that ``least`` distinct publishers confirm by now are published."""
    counted = sources.groupBy(key).agg(F.countDistinct(publisher).alias("publishers"))
    n = F.coalesce("publishers", F.lit(0))
    return held.join(counted, key, "left").withColumn("publishers", n).withColumn("promoted", n >= least)


def listed(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], extra: str) -> DataFrame:
    """A cause list on stored dockets: its columns overwrite where they aren't null, the maps in ``extra`` are united. Adds ``action``."""
    out, columns = _merged(stored, incoming, keys, F.coalesce)
    action = F.when(F.col("_new").isNull(), "kept").when(F.col("_old").isNull(), "created").otherwise("updated")
    return out.withColumn(extra, map_union(F.col(f"_old.{extra}"), F.col(f"_new.{extra}"))).select(*keys, *columns, action.alias("action"))


def enriched(stored: DataFrame, parsed: DataFrame, keys: Sequence[str], extra: str, verdict: Column) -> DataFrame:
    """Stored rows after a detail page was parsed, with ``action``: an empty parse (no column but its keys) is rejected, a row that isn't stored is never created.

    Values overwrite where they aren't null, the maps in ``extra`` are united, and ``verdict_type`` is filled by ``verdict`` (of the new row's columns) if it is missing.
    """
    columns = [x for x in stored.columns if x not in keys]
    told = F.size(F.array_compact(F.array(*(F.col(x).cast("string") for x in columns if x != extra)))) + F.size(F.coalesce(extra, F.create_map().cast("map<string,string>")))
    new = parsed.select(*keys, F.struct(*columns).alias("_new"), (told > 0).alias("_told"))
    both = stored.select(*keys, F.struct(*columns).alias("_old")).join(new, list(keys), "left")
    fine = F.coalesce("_told", F.lit(False))
    rows = both.select(*keys, fine.alias("_fine"), F.col("_new").isNotNull().alias("_met"), *(F.when(fine, F.coalesce(F.col(f"_new.{x}"), F.col(f"_old.{x}"))).otherwise(F.col(f"_old.{x}")).alias(x) for x in columns if x != extra), F.when(fine, map_union(F.col(f"_old.{extra}"), F.col(f"_new.{extra}"))).otherwise(F.col(f"_old.{extra}")).alias(extra))
    rows = rows.withColumn("verdict_type", F.when(F.col("_fine"), F.coalesce("verdict_type", verdict)).otherwise(F.col("verdict_type")))
    return rows.select(*keys, *columns, F.when(F.col("_fine"), "updated").when(F.col("_met"), "rejected").otherwise("kept").alias("action"))


def repointed(stores: Mapping[str, tuple[DataFrame, str]], mapping: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Every store (frame and its column of ids) with the ids of mapping (old, new; one new for each old) replaced, and store and n: how many rows changed."""
    moved, counts = {}, []
    for name, (df, column) in stores.items():
        to = mapping.select(F.col("old").alias(column), F.col("new").alias("_to"))
        met = df.join(to, column, "left")
        counts.append(met.agg(F.count("_to").alias("n")).select(F.lit(name).alias("store"), "n"))
        moved[name] = met.withColumn(column, F.coalesce("_to", column)).select(*df.columns)
    total = counts[0]
    for one in counts[1:]:
        total = total.unionByName(one)
    return moved, total
