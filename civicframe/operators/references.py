"""References in JSON documents: what stands under ``@id`` at any depth, found as variants, one level of all documents at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicframe.storage import cut

#: The key of an identifier.
ID = "@id"


def _is(v: Column, kind: str) -> Column:
    return F.startswith(F.schema_of_variant(v), F.lit(kind))


def references(docs: DataFrame, key: str, body: str) -> DataFrame:
    """key, iri, depth and own: each identifier of each document as often as it stands there; own is that of the document itself (at depth 1).

    As many passes as the deepest document has levels, each over what is nested so deep alone. A body that is null or isn't JSON has none; an identifier that isn't text is none. Repeated rows count each.
    """
    spark = docs.sparkSession
    level = docs.where(F.contains(body, F.lit(f'"{ID}"'))).select(F.col(key).alias("_key"), F.try_parse_json(body).alias("_v")).where("_v is not null")
    found, depth = None, 0
    while True:
        depth += 1
        inner = level.where(_is(F.col("_v"), "OBJECT") | _is(F.col("_v"), "ARRAY")).lateralJoin(spark.tvf.variant_explode(F.col("_v").outer()))
        inner = cut(inner.select("_key", F.col("key").alias("_name"), F.col("value").alias("_v")), "level")
        iri = F.try_variant_get("_v", "$", "string")
        here = inner.where((F.col("_name") == ID) & _is(F.col("_v"), "STRING")).select(F.col("_key").alias(key), iri.alias("iri"), F.lit(depth).alias("depth"), F.lit(depth == 1).alias("own"))
        found = here if found is None else found.unionByName(here)
        level = inner.where(_is(F.col("_v"), "OBJECT") | _is(F.col("_v"), "ARRAY")).select("_key", "_v")
        if level.isEmpty():
            return found


def referring(docs: DataFrame, key: str, body: str, retired: DataFrame) -> DataFrame:
    """key and iri, once each: the documents that refer to one of ``retired`` (iri), but for their own identifiers."""
    return references(docs, key, body).where("not own").select(key, "iri").distinct().join(retired.select("iri").distinct(), "iri", "left_semi").select(key, "iri")


def distinct_elements(docs: DataFrame, body: str, name: str = "value") -> DataFrame:
    """The distinct texts of bodies that are JSON arrays; objects, scalars, what isn't JSON and elements that aren't text have none."""
    rows = docs.select(F.try_parse_json(body).alias("_v")).where(_is(F.col("_v"), "ARRAY"))
    items = rows.lateralJoin(docs.sparkSession.tvf.variant_explode(F.col("_v").outer()))
    return items.where(_is(F.col("value"), "STRING")).select(F.try_variant_get("value", "$", "string").alias(name)).distinct()
