"""What is checked over whole stores: reconciliation, ceilings, duplicates, extractors, kinds of cases, hits inside documents."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicframe.functions import text as tx

from . import tags as vocabulary

#: Register codes of writs and of corruption appeals, forums in the order in which they win, and external ids of a shared register.
WRITS, APPEAL = ("wc", "wo", "wf", "wh", "ws", "wm"), "cr"
FORUMS = ("special", "supreme_appeal", "supreme_writ", "supreme_other", "ordinary")
QID = r"Q[0-9]{3,}"


def reconciled(binds: DataFrame, cases: DataFrame, index: DataFrame) -> DataFrame:
    """iri, expected and indexed where the index (iri, case_count) differs from what it ought to say: the distinct published cases (case_id, published) that cite an entity.

    An entity that nobody cites counts 0, also where the index lacks it.
    """
    expected = binds.join(cases.where("published").select("case_id"), "case_id", "left_semi").groupBy("iri").agg(F.countDistinct("case_id").alias("expected"))
    both = expected.join(index.select("iri", F.col("case_count").alias("indexed")), "iri", "full")
    return both.select("iri", F.coalesce("expected", F.lit(0)).alias("expected"), "indexed").where("expected <> coalesce(indexed, -1)")


def under_ceiling(rows: DataFrame, flagged: Column, most: float, least_rows: int = 0) -> DataFrame:
    """created, flagged and rate of a batch, one row; reading it raises an error if more than ``most`` of at least ``least_rows`` rows are flagged: a broken source, not that many cases."""
    counts = rows.agg(F.count("*").alias("created"), F.count_if(flagged).alias("flagged"))
    rate = F.when(F.col("created") > 0, F.col("flagged") / F.col("created")).otherwise(0.0)
    over = (F.col("created") >= least_rows) & (rate > most)
    told = F.concat(F.lit("too many truncated rows: "), "flagged", F.lit(" of "), "created")
    return counts.select("created", "flagged", F.when(over, F.raise_error(told).cast("double")).otherwise(rate).alias("rate"))


def duplicate_persons(persons: DataFrame) -> DataFrame:
    """survivor, iri and qid of persons (iri, name_en, ids: text of their identifiers) that share an external id and their English name, in any case; the smallest iri survives."""
    of = F.array_distinct(F.regexp_extract_all(F.concat_ws(" ", F.upper(F.regexp_extract("iri", "(?i)-(q[0-9]+)$", 1)), "ids"), F.lit(QID), 0))
    keyed = persons.select("iri", F.lower(tx.squeezed("name_en")).alias("name"), F.explode(of).alias("qid")).where("name <> ''").distinct()
    w = Window.partitionBy("qid", "name")
    return keyed.withColumns({"survivor": F.min("iri").over(w)}).where("iri <> survivor").select("survivor", "iri", "qid").distinct()


def forum(iris: str | Column) -> Column:
    """The forum of a case by its docket IRIs (``.../courtcase/<court>/<number>``): the special court wins, then an appeal, a writ, another supreme docket, an ordinary court; none without any."""

    def one(iri: Column) -> Column:
        low = F.lower(iri)
        court, number = (F.regexp_extract(low, "/courtcase/([^/]+)/?([^/]*)", i) for i in (1, 2))
        code = F.regexp_extract(number, "[a-z]{1,3}", 0)
        supreme = F.when(code.isin(*WRITS), "supreme_writ").when(code == APPEAL, "supreme_appeal").otherwise("supreme_other")
        return F.when(court == "special", "special").when(court == "supreme", supreme).when(court != "", "ordinary")

    held = F.transform(F.coalesce(tx.c(iris), F.array().cast("array<string>")), one)
    out = F.lit("none")
    for f in reversed(FORUMS):
        out = F.when(F.array_contains(held, f), f).otherwise(out)
    return out


def detected(iris: str | Column, kinds: str | Column, offence: str | Column, other_tracks: Collection[str] = ()) -> Column:
    """struct(type, rationale, needs_number) of a case by its forum, the kinds of its sources and its offence.

    An offence of another track is never the agency's. Else the forum decides, and only without one the sources: a charge sheet or press release. Of the agency's cases, the
    best source tells how far they are: VERDICT or COURT_ORDER, CHARGE_SHEET, or less. The last two kinds but "basic" need a docket number.
    """
    f, k = forum(iris), F.coalesce(tx.c(kinds), F.array().cast("array<string>"))
    has = lambda *names: F.arrays_overlap(k, F.array(*(F.lit(x) for x in names)))
    apart = F.coalesce(F.upper(tx.c(offence)).isin(*other_tracks), F.lit(False)) if other_tracks else F.lit(False)
    agency = F.when(apart, False).when(f.isin("special", "supreme_appeal"), True).when(f != "none", False).otherwise(has("CHARGE_SHEET", "PRESS_RELEASE"))
    named = F.when(~agency, "other").when(has("VERDICT", "COURT_ORDER"), "verdict").when(has("CHARGE_SHEET"), "extended").otherwise("basic")
    told = F.coalesce(F.nullif(F.array_join(F.array_sort(F.array_distinct(k)), ", "), F.lit("")), F.lit("none"))
    why = F.concat(F.when(apart, "another track; ").otherwise(""), F.lit("forum "), f, F.lit("; sources "), told)
    return F.struct(named.alias("type"), why.alias("rationale"), named.isin("extended", "verdict").alias("needs_number"))


def evaluated(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """want, got and n over cases (case_number, verdict) that a court coded itself: rows that are ``derived`` (by an extractor) are no answer key, nor are cases with two different ones.

    got is "abstained" where the extractor has none, and "missing" where it never ran.
    """
    key = truth.where("not derived and verdict is not null").groupBy("case_number").agg(F.min("verdict").alias("want"), F.max("verdict").alias("_other")).where("want = _other").drop("_other")
    got = predicted.select("case_number", F.coalesce("verdict", F.lit("abstained")).alias("got"))
    return key.join(got, "case_number", "left").groupBy("want", F.coalesce("got", F.lit("missing")).alias("got")).agg(F.count("*").alias("n"))


def accuracy(confusion: DataFrame) -> DataFrame:
    """cases, answered, hits, abstention and precision of a confusion table, in one row."""
    answered = ~F.col("got").isin("abstained", "missing")
    zero = lambda x: F.coalesce(x, F.lit(0))
    sums = confusion.agg(zero(F.sum("n")).alias("cases"), zero(F.sum(F.when(answered, F.col("n")))).alias("answered"), zero(F.sum(F.when(F.col("want") == F.col("got"), F.col("n")))).alias("hits"))
    share = lambda a, b: F.round(F.try_divide(a, b), 4)
    return sums.select("*", share(F.col("cases") - F.col("answered"), F.col("cases")).alias("abstention"), share(F.col("hits"), F.col("answered")).alias("precision"))


def rebuilt(cases: DataFrame, aliases: DataFrame, tags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(report, rewritten) of the tags of cases (case_id, tags): resolution, raw tag, tag and n; and case_id with its new tags where they differ.

    Known tags become canonical, retired ones go, unknown ones stay as they are; the order stays, and repeated ones go.
    """
    raw = cases.select("case_id", F.posexplode("tags").alias("place", "raw"))
    met = vocabulary.resolved(raw, "raw", aliases, tags)
    report = met.groupBy("resolution", "raw", "tag").agg(F.count("*").alias("n"))
    kept = met.where("resolution <> 'retired'").select("case_id", "place", F.coalesce("tag", "raw").alias("t"))
    fresh = kept.groupBy("case_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("place", "t"))), lambda s: s["t"])).alias("_new"))
    new = F.coalesce("_new", F.array().cast("array<string>"))
    out = cases.join(fresh, "case_id", "left").where(F.coalesce(F.col("tags"), F.array().cast("array<string>")) != new)
    return report, out.select("case_id", new.alias("tags"))


def document_hits(pages: DataFrame, tables: DataFrame, figures: DataFrame, query: str, most: int) -> DataFrame:
    """document, place, total, page_no, kind, key and by of the first ``most`` hits of each document, by page, then pages before tables before figures.

    pages: document, page_no, text. tables and figures: document, page_no, key, text. A page is hit by its number alone (folio), its text (literally in any case, else by
    sound, word for word), or by words together with its number; total counts before the cut. A blank query hits nothing.
    """
    needle = query.strip()
    if not needle:
        needle = None
    rows = pages.select("document", "page_no", F.lit(0).alias("rank"), F.lit("page").alias("kind"), F.lit(None).cast("string").alias("key"), "text")
    for rank, (kind, df) in enumerate((("table", tables), ("figure", figures)), 1):
        rows = rows.unionByName(df.select("document", "page_no", F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), F.col("key").cast("string").alias("key"), "text"))
    text = F.coalesce("text", F.lit(""))

    def found(words: str) -> Column:
        return F.when(F.contains(F.lower(text), F.lit(words.lower())), "literal").when(tx.matches(text, F.lit(words)), "sound")

    if needle is None:
        by = F.lit(None).cast("string")
    else:
        folio = F.col("page_no").cast("string")
        by = F.coalesce(F.when((F.col("kind") == "page") & (folio == needle), "folio"), found(needle))
        tokens = needle.split()
        for number in dict.fromkeys(t for t in tokens if t.isdigit()):
            rest = " ".join(t for t in tokens if t != number)
            if rest:
                by = F.coalesce(by, F.when((F.col("kind") == "page") & (folio == number) & found(rest).isNotNull(), "words and folio"))
    hits = rows.withColumn("by", by).where("by is not null").drop("text")
    w = Window.partitionBy("document")
    out = hits.withColumns({"place": F.row_number().over(w.orderBy("page_no", "rank", "key")), "total": F.count("*").over(w)})
    return out.where(F.col("place") <= most).select("document", "place", "total", "page_no", "kind", "key", "by")


def changed_since(documents: DataFrame, started: str | Column, updated: str, gone: Column) -> DataFrame:
    """The documents to bring an index up to date with that was built from ``started`` on, each with evicted: what isn't shown any more leaves. The bound is closed: a tie is written twice rather than lost."""
    at = F.lit(started).cast("timestamp") if isinstance(started, str) else started
    return documents.where(F.col(updated) >= at).withColumn("evicted", F.coalesce(gone, F.lit(True)))
