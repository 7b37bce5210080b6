"""Search documents of the four kinds of records in one schema, and the rows of search telemetry."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicframe.functions import scripts
from civicframe.functions import text as tx

#: The common schema; a builder names what its record has, the rest is null.
SCHEMA = {
    "iri": "string", "type": "string", "title_ne": "string", "title_en": "string", "title_translit": "string", "body": "string", "keywords": "array<string>", "date": "date", "status": "string",
    "court": "string", "amount": "double", "case_count": "long", "public": "boolean", "lastmod": "timestamp",
}


def document(rows: DataFrame, kind: str, fields: Mapping[str, Column]) -> DataFrame:
    """Rows as documents of a kind: ``title_translit`` follows from the titles, texts are squeezed, blanks are null, keywords distinct and sorted."""
    unknown = set(fields) - set(SCHEMA)
    if unknown:
        raise ValueError(f"not in the schema: {sorted(unknown)}")
    made = {"type": F.lit(kind)} | dict(fields)
    for name in ("title_ne", "title_en", "body"):
        if name in made:
            made[name] = F.nullif(tx.squeezed(made[name]), F.lit(""))
    if "keywords" in made:
        made["keywords"] = F.array_sort(F.array_distinct(F.filter(F.array_compact(made["keywords"]), lambda k: F.trim(k) != "")))
    rows = rows.select(*(made.get(name, F.lit(None)).cast(t).alias(name) for name, t in SCHEMA.items()))
    return rows.withColumn("title_translit", F.coalesce("title_translit", scripts.title_translit("title_ne", "title_en")))


def case_document(cases: DataFrame) -> DataFrame:
    """Cases (slug, name_ne, name_en, name, description, tags, accused, start, state, amount, updated_at); those that are published are public."""
    t = scripts.titles("name_ne", "name_en", "name")
    return document(cases, "case", {
        "iri": F.col("slug"), "title_ne": t["ne"], "title_en": t["en"], "body": F.col("description"), "keywords": F.concat(F.coalesce("tags", F.array()), F.coalesce("accused", F.array())), "date": F.col("start"),
        "status": F.col("state"), "amount": F.col("amount"), "public": F.col("state") == "PUBLISHED", "lastmod": F.col("updated_at"),
    })


def docket_document(dockets: DataFrame) -> DataFrame:
    """Dockets (court, case_number, case_type, plaintiff, defendant, registered, lifecycle, public, updated_at): the number is a keyword, as stored and normalised."""
    title = F.concat_ws(" ", "case_number", "case_type")
    return document(dockets, "court", {
        "iri": F.concat_ws("/", "court", "case_number"), "title_ne": F.when(tx.has_devanagari(title), title), "title_en": F.when(~tx.has_devanagari(title), title),
        "body": F.concat_ws(" / ", "plaintiff", "defendant"), "keywords": F.array("case_number", tx.case_number("case_number"), "case_type"), "date": F.col("registered"), "status": F.col("lifecycle"),
        "court": F.col("court"), "public": F.col("public"), "lastmod": F.col("updated_at"),
    })


def material_document(materials: DataFrame) -> DataFrame:
    """Materials (iri, name_ne, name_en, name, text, kinds, published, public, updated_at)."""
    t = scripts.titles("name_ne", "name_en", "name")
    return document(materials, "material", {
        "iri": F.col("iri"), "title_ne": t["ne"], "title_en": t["en"], "body": F.col("text"), "keywords": F.col("kinds"), "date": F.col("published"), "public": F.col("public"), "lastmod": F.col("updated_at"),
    })


def entity_document(entities: DataFrame, citations: DataFrame) -> DataFrame:
    """Entities (iri, name_ne, name_en, name, alternates, updated_at) with the number of cases that cite each (citations: iri, case_id); a cited one is public."""
    counted = citations.groupBy("iri").agg(F.countDistinct("case_id").alias("_n"))
    t = scripts.titles("name_ne", "name_en", "name")
    n = F.coalesce("_n", F.lit(0))
    return document(entities.join(counted, "iri", "left"), "entity", {
        "iri": F.col("iri"), "title_ne": t["ne"], "title_en": t["en"], "keywords": F.col("alternates"), "case_count": n, "public": n > 0, "lastmod": F.col("updated_at"),
    })


def corpus(*documents: DataFrame) -> DataFrame:
    """One union of all kinds."""
    out = documents[0]
    for d in documents[1:]:
        out = out.unionByName(d)
    return out


def search_events(searches: DataFrame) -> DataFrame:
    """Telemetry of searches (search_id, q, lang, types, page, cursor, filters: map of arrays, count, results: array<struct<type, score>>, took_ms), without who searched.

    The best hit is told for the true first page only: under a cursor the page number means nothing.
    """
    q = tx.query_key("q")
    top = F.when((F.col("page") == 1) & F.col("cursor").isNull(), F.try_element_at("results", F.lit(1)))
    count = F.coalesce("count", F.lit(0))
    active = F.map_filter("filters", lambda _, v: F.size(v) > 0)
    return searches.select(
        "search_id", q.alias("q_normalized"), F.length(q).alias("q_len"), (q != "").alias("has_query"), "lang", F.array_sort(F.coalesce("types", F.array().cast("array<string>"))).alias("types"), "page",
        F.when(F.size(active) > 0, active).alias("filters"), count.alias("result_count"), ((q != "") & (count == 0)).alias("zero_result"), F.coalesce(F.size("results"), F.lit(0)).alias("returned"),
        F.round("took_ms", 1).alias("took_ms"), top["type"].alias("top_type"), top["score"].alias("top_score"),
    )


def judgments(searches: DataFrame, clicks: DataFrame) -> DataFrame:
    """q_normalized, rank, shown, clicked and ctr: of searches that showed a rank, the share whose click (search_id, rank, result_id) was on it; repeated clicks count once."""
    shown = searches.select("search_id", "q_normalized", F.explode(F.sequence(F.lit(1), F.greatest("returned", F.lit(1)))).alias("rank")).join(searches.where("returned > 0").select("search_id"), "search_id", "left_semi")
    hit = clicks.select("search_id", "rank").distinct().withColumn("_hit", F.lit(1))
    both = shown.join(hit, ["search_id", "rank"], "left")
    out = both.groupBy("q_normalized", "rank").agg(F.count("*").alias("shown"), F.count("_hit").alias("clicked"))
    return out.withColumn("ctr", F.round(F.col("clicked") / F.col("shown"), 4))


def copies_removed(docs: DataFrame, proposals: DataFrame) -> DataFrame:
    """id, survivor and action of each of ``proposals`` (id, survivor) to delete a document as an exact copy of another one of docs (id, title, text, deleted).

    Title, fingerprint of the text and survivor must agree. *deleted*, else why not: *missing* (no such document), *gone* (deleted before), *no survivor* (none, itself, or deleted), *survivor goes too* (proposed as a copy
    itself), *title*, *text* (null and empty text have no fingerprint). A document that is proposed twice keeps the smallest survivor.
    """
    facts = docs.select("id", "deleted", F.trim("title").alias("title"), F.when(F.length("text") > 0, F.sha2(F.col("text").cast("binary"), 256)).alias("mark"))
    wanted = proposals.groupBy("id").agg(F.min("survivor").alias("survivor"))
    going = wanted.select(F.col("id").alias("survivor"), F.lit(True).alias("goes"))
    own = facts.select("id", F.struct("deleted", "title", "mark").alias("own"))
    other = facts.select(F.col("id").alias("survivor"), F.struct("deleted", "title", "mark").alias("other"))
    rows = wanted.join(own, "id", "left").join(other, "survivor", "left").join(going, "survivor", "left")
    action = (
        F.when(F.col("own").isNull(), "missing")
        .when(F.col("own.deleted"), "gone")
        .when(F.col("other").isNull() | F.col("other.deleted") | (F.col("id") == F.col("survivor")), "no survivor")
        .when(F.coalesce("goes", F.lit(False)), "survivor goes too")
        .when(~F.col("own.title").eqNullSafe(F.col("other.title")), "title")
        .when(F.col("own.mark").isNull() | ~F.col("own.mark").eqNullSafe(F.col("other.mark")), "text")
        .otherwise("deleted")
    )
    return rows.select("id", "survivor", action.alias("action"))
