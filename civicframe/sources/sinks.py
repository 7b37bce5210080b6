"""Sinks: index generations, published trees, resource lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from civicframe.storage import cut


def rebuild(spark: SparkSession, docs: DataFrame, folder: str, generation: int, live: DataFrame | None) -> DataFrame:
    """Writes a new generation and returns it; none is made if it would empty an index that has documents."""
    path = f"{folder}/generation={generation:06d}"
    docs.write.mode("overwrite").parquet(path)
    out = spark.read.schema(docs.schema).parquet(path)
    if live is not None and out.isEmpty() and not live.isEmpty():
        raise ValueError("the new generation is empty and the live one isn't")
    return out


def point(spark: SparkSession, folder: str, generation: int) -> None:
    """Makes a generation the live one: one appended row, which a reader sees whole or not at all."""
    spark.createDataFrame([(generation,)], "generation int").withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{folder}/alias")


def live(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """The documents of the generation that was made live last; going back is pointing to an older one."""
    last = spark.read.schema("generation int, at timestamp").parquet(f"{folder}/alias").agg(F.max_by("generation", "at")).first()[0]
    return spark.read.schema(schema).parquet(f"{folder}/generation={last:06d}")


def catch_up(index: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Applies what changed while the index was built; a change with ``evicted`` removes its document."""
    kept = index.join(changes.select(key), key, "left_anti")
    return kept.unionByName(changes.where("not evicted").drop("evicted"))


def index_tree(nodes: DataFrame, root: str) -> DataFrame:
    """path and body of nodes (id, parent, label) that hang on one without a parent: one JSON object for each, its path from the root, equal in every run.

    Paths grow upwards and double their reach in every round, so a tree may have any number of nodes and levels. What hangs on no top, or on a cycle, has no path.
    """
    rows = cut(nodes.select("id", "label", F.col("parent").alias("top"), F.col("id").alias("path")), "nodes")
    done, still = rows.where("top is null"), rows.where("top is not null")
    while True:
        # only the tops that are asked for: few of them, as near the root, are broadcast, and no task gets all that hangs on one
        wanted = still.select(F.col("top").alias("id")).distinct()
        tops = cut(done.unionByName(still).join(wanted, "id", "left_semi").select(F.col("id").alias("top"), F.col("top").alias("_next"), F.col("path").alias("_above")), "tops")
        grown = cut(still.join(tops, "top").select("id", "label", F.col("_next").alias("top"), F.concat("_above", F.lit("/"), "path").alias("path")), "paths")
        ended = grown.where("top is null")
        if ended.isEmpty():  # nothing ends so far up, hence nothing further up: the others go round in circles
            break
        done, still = done.unionByName(ended), grown.where("top is not null")
    paths = done.select(F.concat(F.lit(root), F.lit("/"), "path").alias("path"), "label")
    return paths.select("path", F.to_json(F.struct(F.concat("path", F.lit(".jsonld")).alias("@id"), "label", "path")).alias("body"))


def resource_list(docs: DataFrame, per_section: int = 50_000) -> DataFrame:
    """section, place and entry of (iri, lastmod): XML entries, cut to sections of a bounded size by ranges of the iri."""
    w = Window.partitionBy("bucket").orderBy("iri")
    escaped = F.replace(F.replace(F.replace("iri", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    entry = F.concat(F.lit("<url><loc>"), escaped, F.lit("</loc><lastmod>"), F.date_format("lastmod", "yyyy-MM-dd"), F.lit("</lastmod></url>"))
    placed = docs.withColumn("bucket", F.substring(F.sha2("iri", 256), 1, 2)).withColumn("place", F.row_number().over(w))
    return placed.select(F.concat_ws("-", "bucket", F.floor((F.col("place") - 1) / per_section).cast("string")).alias("section"), "place", entry.alias("entry"))
