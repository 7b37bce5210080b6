"""Several stores that change as one: each write makes new generations, and a manifest says which one of each store is live.

A manifest is one small file with the next number; readers take the highest. Until it is there, nothing has changed for anyone; when it is, everything has. What a failed
commit wrote stays unread until ``pruned``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from civicframe.operators.upsert import repointed


class Conflict(RuntimeError):
    """Another commit came between: read again and retry."""


def _files(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    p, fs = _files(spark, f"{folder}/manifest")
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(p) if f.getPath().getName().isdigit()) if fs.exists(p) else []


def manifest(spark: SparkSession, folder: str) -> tuple[int, dict[str, dict]]:
    """The live manifest's number (0: none yet) and, of each store, its path and schema."""
    numbers = _numbers(spark, folder)
    if not numbers:
        return 0, {}
    p, fs = _files(spark, f"{folder}/manifest/{numbers[-1]:09d}")
    stream = fs.open(p)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return numbers[-1], json.loads(text)


def live(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The stores as the live manifest has them."""
    _, stores = manifest(spark, folder)
    return {name: spark.read.schema(StructType.fromJson(s["schema"])).parquet(s["path"]) for name, s in stores.items()}


def commit(spark: SparkSession, folder: str, stores: Mapping[str, DataFrame], since: int | None = None) -> int:
    """Writes a new generation of each of ``stores``, then one manifest; other stores stay as they are. Returns the manifest's number.

    since: the manifest that the new contents were made from. If another has been written meanwhile, nothing is committed (Conflict).
    """
    number, known = manifest(spark, folder)
    base = number if since is None else since
    if base != number:
        raise Conflict(f"manifest {number} came after {base}")
    out = dict(known)
    for name, df in stores.items():
        path = f"{folder}/{name}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        out[name] = {"path": path, "schema": df.schema.jsonValue()}
    target, fs = _files(spark, f"{folder}/manifest/{base + 1:09d}")
    draft, _ = _files(spark, f"{folder}/manifest/.{uuid.uuid4().hex}")
    stream = fs.create(draft, False)
    stream.write(bytearray(json.dumps(out, sort_keys=True).encode()))
    stream.close()
    if fs.exists(target) or not fs.rename(draft, target):  # a rename is whole or not at all
        fs.delete(draft, False)
        raise Conflict(f"manifest {base + 1} is there already")
    return base + 1


def pruned(spark: SparkSession, folder: str, keep: int = 2) -> list[str]:
    """Removes the generations that none of the last ``keep`` manifests names, and older manifests; returns what it removed."""
    numbers, named, gone = _numbers(spark, folder), set(), []
    jvm = spark.sparkContext._jvm
    for number in numbers[-keep:]:
        p, fs = _files(spark, f"{folder}/manifest/{number:09d}")
        stream = fs.open(p)
        stores = json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        stream.close()
        named |= {s["path"].rsplit("/", 2)[-2] + "/" + s["path"].rsplit("/", 1)[-1] for s in stores.values()}
    top, fs = _files(spark, folder)
    for store in [f.getPath() for f in fs.listStatus(top) if f.isDirectory() and f.getPath().getName() != "manifest"]:
        for g in [f.getPath() for f in fs.listStatus(store)]:
            if f"{store.getName()}/{g.getName()}" not in named:
                fs.delete(g, True)
                gone.append(f"{store.getName()}/{g.getName()}")
    for number in numbers[:-keep]:
        fs.delete(_files(spark, f"{folder}/manifest/{number:09d}")[0], False)
        gone.append(f"manifest/{number:09d}")
    return gone


LINEAGE = "old string, new string, store string, rows long, reason string"


def merge(spark: SparkSession, folder: str, mapping: DataFrame, columns: Mapping[str, str], reason: str = "merge") -> int:
    """Repoints the ids in ``columns`` (store: column) of the live stores by mapping (old, new), and appends to the store ``lineage`` how many rows of each store
    each old id had; all of it is one commit. A chain of mappings must be resolved before (``graph.resolve_chain``); an id that is its own target changes nothing.
    """
    number, _ = manifest(spark, folder)
    stores = live(spark, folder)
    changed = mapping.where("old <> new").select("old", "new").distinct()
    moved, _ = repointed({name: (stores[name], column) for name, column in columns.items()}, changed)
    rows = None
    for name, column in columns.items():
        of = stores[name].groupBy(F.col(column).alias("old")).agg(F.count("*").alias("rows"))
        one = changed.join(of, "old").select(F.col("old").cast("string").alias("old"), F.col("new").cast("string").alias("new"), F.lit(name).alias("store"), "rows", F.lit(reason).alias("reason"))
        rows = one if rows is None else rows.unionByName(one)
    if "lineage" in stores:
        rows = stores["lineage"].unionByName(rows)
    return commit(spark, folder, {**moved, "lineage": rows}, number)
