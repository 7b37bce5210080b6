"""Readers of the formats that the archive comes in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civicframe.operators.numbering import numbered
from civicframe.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shards(spark: SparkSession, folder: str, config: str) -> DataFrame:
    """``<folder>/<config>/*.parquet``, else ``<folder>/<config>.parquet``; schemas are merged."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in (f"{folder}/{config}", f"{folder}/{config}.parquet"):
        p = jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(conf).exists(p):
            return spark.read.option("mergeSchema", "true").option("pathGlobFilter", "*.parquet").parquet(path)
    raise FileNotFoundError(f"no shards of {config} in {folder}")


def ordinals(df: DataFrame, document: str, order: list[str], name: str = "ordinal") -> DataFrame:
    """Stable ordinals from 1 within each document."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(document).orderBy(*order)))


def in_order(df: DataFrame, document: str, order: list[str]) -> DataFrame:
    """``df`` with ``place``, from 1 in the order of all its shards by document and ``order``, and ``ordinal``, from 1 within the document.

    The place becomes public, so it must not depend on how the shards are cut: rows are put in order over the cluster, counted where they lie, and carry on from the
    counts of the ranges before. No task gets all rows, or all of a document.
    """
    return numbered(numbered(df, [document, *order], name="place"), ["place"], document, "ordinal")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Newline JSON with a declared schema; lines that don't parse are left out."""
    raw = spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return raw.where("_bad is null").drop("_bad")


def unseen(cache: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """What a resumed crawl still has to fetch."""
    return incoming.join(cache.select(key), key, "left_anti")


def batch_slugs(spark: SparkSession, path: str, column: str = "slug") -> DataFrame:
    """slug and position (from 1): the trimmed slugs of CSV files in the order of file names and lines, each at its first place."""
    at = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    rows = spark.read.option("header", "true").csv(path).select(F.trim(column).alias("slug"), at.alias("_at"))
    return numbered(rows.where("slug <> ''").groupBy("slug").agg(F.min("_at").alias("_at")), ["_at"], name="position").drop("_at")


def jdbc(spark: SparkSession, url: str, relation: str, predicates: list[str], **properties: str) -> DataFrame:
    """A relational copy, one task for each predicate."""
    return spark.read.jdbc(url, relation, predicates=predicates, properties=properties)
