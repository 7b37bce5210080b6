"""Stores on plain Parquet whose merges rewrite only the files that they touch.

Every file has an index row: the partition that its rows share, how many they are, and the least and greatest key. Beside it lie Bloom filters in blocks of 4 KB: a key's hash
names one block, and four bits in it. A change looks for its key in the files of its partition whose range holds it, then in one block of each; only what passes is read. Which
files are live is said by a manifest (``sources.generations``), so a merge is there whole or not at all, and a reader keeps the files that it began with.

Keys are unique and whole: rows with a null in the key stay out, two changes of one key are an error. The driver holds names of files only, as it does for any scan.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from civicframe.sources import generations
from civicframe.storage import cut

#: Bits of a block (4 KB), of a key in it, and bits spent on each key of a full file.
BLOCK, HASHES, PER_KEY = 32_768, 4, 12
PROGRESS = "job string, p long, lo string"


@dataclass(frozen=True)
class Store:
    """folder; key: the natural key; parts: columns that follow from the key, so that a key never moves between partitions; the most rows of a file."""

    spark: SparkSession
    folder: str
    schema: StructType
    key: tuple[str, ...]
    parts: tuple[Column, ...]
    rows_per_file: int = 1_000_000
    blocks: int = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "blocks", max(1, -(-self.rows_per_file * PER_KEY // BLOCK)))

    @property
    def meta(self) -> str:
        return f"{self.folder}/meta"

    def place(self) -> Column:
        return F.xxhash64(*self.parts).alias("p")

    def ordered_key(self) -> Column:
        return F.struct(*self.key)

    def hashes(self) -> dict[str, Column]:
        """h chooses the block, g the bits."""
        return {"_h": F.xxhash64(*self.key), "_g": F.xxhash64(*self.key, F.lit("bits"))}


def _bits(g: str) -> list[Column]:
    return [F.pmod(F.shiftright(g, 15 * i), F.lit(BLOCK)) for i in range(HASHES)]


def _is_set(bits: str, at: Column) -> Column:
    """Whether a bitmap of bytes has the bit."""
    byte = F.conv(F.hex(F.substring(F.col(bits), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1


def _read(store: Store, files: list[str]) -> DataFrame:
    """The rows of some files, each with the name of its file."""
    named = F.regexp_extract("_metadata.file_path", "/data/([^/]+/p=[^/]+/[^/]+)$", 1).alias("file")
    if not files:
        return store.spark.createDataFrame([], store.schema).withColumn("file", F.lit(""))
    return store.spark.read.schema(store.schema).option("recursiveFileLookup", "true").parquet(*(f"{store.folder}/data/{f}" for f in files)).select("*", named)


def files(store: Store) -> DataFrame:
    """file, run, p, rows, lo and hi of the live files."""
    return generations.live(store.spark, store.meta)["files"]


def rows(store: Store) -> DataFrame:
    """The store as the live manifest has it."""
    return _read(store, [r.file for r in files(store).select("file").collect()]).drop("file")


def _write(store: Store, df: DataFrame, count: int) -> DataFrame:
    """Writes rows as new files that no manifest names yet, with their filters; returns the index rows."""
    run = uuid.uuid4().hex
    path = f"{store.folder}/data/{run}"
    placed = df.withColumn("p", store.place()).repartitionByRange(max(1, count), "p", *store.key).sortWithinPartitions("p", *store.key)
    placed.write.partitionBy("p").option("maxRecordsPerFile", store.rows_per_file).parquet(path)
    named = F.regexp_extract("_metadata.file_path", "/data/([^/]+/p=[^/]+/[^/]+)$", 1).alias("file")
    keys = store.spark.read.schema(store.schema).option("recursiveFileLookup", "true").parquet(path).select(named, store.place(), store.ordered_key().alias("k"), *store.key)
    hashed = keys.withColumns(store.hashes()).select("file", F.pmod("_h", F.lit(store.blocks)).alias("block"), F.explode(F.array(*_bits("_g"))).alias("bit"))
    hashed.groupBy("file", "block").agg(F.bitmap_construct_agg("bit").alias("bits")).write.parquet(f"{store.folder}/filters/{run}")
    index = keys.groupBy("file").agg(F.first("p").alias("p"), F.count("*").alias("rows"), F.min("k").alias("lo"), F.max("k").alias("hi"))
    return cut(index.withColumn("run", F.lit(run)), "keyed-index")


def create(spark: SparkSession, folder: str, df: DataFrame, key: list[str], parts: list[Column], rows_per_file: int = 1_000_000) -> Store:
    store = Store(spark, folder, df.schema, tuple(key), tuple(parts), rows_per_file)
    whole = df.dropna(subset=key)
    n = whole.count()
    progress = spark.createDataFrame([], PROGRESS)
    generations.commit(spark, store.meta, {"files": _write(store, whole, -(-n // rows_per_file)), "progress": progress}, 0)
    return store


def candidates(store: Store, changes: DataFrame) -> DataFrame:
    """key and file: where a changed key may lie; hardly a file too many, never one too few."""
    live = files(store)
    keys = changes.select(*store.key, store.place(), store.ordered_key().alias("_k")).withColumns(store.hashes()).withColumn("block", F.pmod("_h", F.lit(store.blocks)))
    near = keys.join(live.select("p", "file", "lo", "hi"), "p").where((F.col("_k") >= F.col("lo")) & (F.col("_k") <= F.col("hi")))
    runs = [r.run for r in live.select("run").distinct().collect()]
    if not runs:
        return near.select(*store.key, "file").limit(0)
    filters = store.spark.read.schema("file string, block long, bits binary").parquet(*(f"{store.folder}/filters/{r}" for r in runs))
    passes = F.lit(True)
    for at in _bits("_g"):
        passes &= _is_set("bits", at)
    return near.join(filters, ["file", "block"]).where(passes).select(*store.key, "file")


def _apply(store: Store, since: int, changes: DataFrame, verdicts: DataFrame, dry_run: bool, also: dict[str, DataFrame] | None = None) -> dict[str, int]:
    """Rewrites the files that verdicts (key, file, changed) name, with changes (the rows, and ``_gone``) for what they had; changes without a verdict are new rows."""
    key = list(store.key)
    real = verdicts.where("changed")
    touched = {r.file: r for r in real.groupBy("file").agg(F.count("*").alias("n")).collect()}
    new = changes.join(verdicts.select(*key), key, "left_anti").where("not _gone")
    updated, gone = changes.join(real.select(*key), key, "left_semi").agg(F.count_if(~F.col("_gone")), F.count_if("_gone")).first()
    out = {"files": files(store).count(), "rewritten": len(touched), "updated": updated, "deleted": gone, "inserted": new.count()}
    if dry_run:
        return out
    stores = dict(also or {})
    if touched or out["inserted"]:
        kept = _read(store, list(touched)).drop("file").join(real.select(*key), key, "left_anti")
        fresh = changes.join(real.select(*key), key, "left_semi").where("not _gone").unionByName(new).drop("_gone")
        index = _write(store, kept.unionByName(fresh), len(touched) + -(-out["inserted"] // store.rows_per_file))
        stores["files"] = files(store).join(real.select("file").distinct(), "file", "left_anti").unionByName(index)
    if stores:
        generations.commit(store.spark, store.meta, stores, since)
    return out


def _differs(store: Store, left: str, right: str) -> Column:
    out = F.lit(False)
    for c in store.schema.names:
        if c not in store.key:
            out |= ~F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return out


def merge(store: Store, changes: DataFrame, gone: Column | None = None, dry_run: bool = False) -> dict[str, int]:
    """Merges rows on the key: new ones are added, those that differ replace, and where ``gone`` is true the row is removed.

    Returns how many files there were and were rewritten, and the rows updated, deleted and inserted. A file is rewritten only if a row of it really changes.
    """
    since, _ = generations.manifest(store.spark, store.meta)
    key = list(store.key)
    gone = F.lit(False) if gone is None else F.coalesce(gone, F.lit(False))
    rows = cut(changes.dropna(subset=key).withColumn("_gone", gone).select(*store.schema.names, "_gone"), "keyed-changes")
    if not rows.groupBy(*key).count().where("count > 1").isEmpty():
        raise ValueError("two changes of one key")
    hit = [r.file for r in candidates(store, rows).select("file").distinct().collect()]
    found = _read(store, hit).alias("a").join(rows.alias("b"), key).select(*key, "file", (F.col("_gone") | _differs(store, "a", "b")).alias("changed"))
    return _apply(store, since, rows, cut(found, "keyed-verdicts"), dry_run) | {"read": len(hit)}


def backfill(store: Store, compute: Callable[[DataFrame], DataFrame], job: str, batch: int = 64, dry_run: bool = True) -> Iterator[dict]:
    """Recomputes columns by ``compute``, ``batch`` files at a time in the order of partition and key; yields a report of each batch, with ``changed``: sets of changed columns
    and their rows. ``compute`` keeps keys and rows, and gives the same again for what it gave.

    Each batch is one commit, with the place that the job has reached: a job that broke off goes on behind its last batch. A dry run counts and writes nothing.
    """
    spark, key = store.spark, list(store.key)
    others = [c for c in store.schema.names if c not in key]
    reached = generations.live(spark, store.meta)["progress"].where(F.col("job") == job).first()
    while True:
        since, _ = generations.manifest(spark, store.meta)
        todo = files(store)
        if reached:
            lo = F.from_json(F.lit(reached.lo), todo.schema["lo"].dataType)
            todo = todo.where((F.col("p") > reached.p) | ((F.col("p") == reached.p) & (F.col("lo") > lo)))
        page = todo.orderBy("p", "lo").limit(batch).select("p", "file", F.to_json("lo").alias("lo")).collect()
        if not page:
            return
        reached = page[-1]
        before = _read(store, [r.file for r in page])
        pairs = before.alias("a").join(compute(before.drop("file")).alias("b"), key)
        sets = F.concat_ws(",", *(F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in others))
        changed = cut(pairs.select(*key, "a.file", *(F.col(f"b.{c}").alias(c) for c in others), sets.alias("_set")).where("_set <> ''"), "keyed-backfill")
        rows = changed.select(*store.schema.names, F.lit(False).alias("_gone"))
        verdicts = changed.select(*key, "file", F.lit(True).alias("changed"))
        place = spark.createDataFrame([(job, reached.p, reached.lo)], PROGRESS)
        progress = generations.live(spark, store.meta)["progress"].where(F.col("job") != job).unionByName(place)
        report = _apply(store, since, rows, verdicts, dry_run, {"progress": progress})
        yield report | {"changed": {r["_set"]: r["count"] for r in changed.groupBy("_set").count().collect()}}
