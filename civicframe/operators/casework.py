"""Case drafts, discovered dockets, held records, vocabularies, intents, extraction sweeps and idempotent consumers, each as joins of whole frames."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicframe.functions import web
from civicframe.functions.text import stated_defendants

from .resolve import publisher_gate
from .tags import tag_key
from .upsert import first_occurrence, versioned

#: Outcomes that an intent may set, the role that has outcomes, and kinds of identifiers that name a tax payer.
OUTCOMES = ("convicted", "acquitted", "abated")
ACCUSED = "accused"
TAX = "vat|pan|tax"


def _blank(x: str) -> Column:
    return F.trim(F.coalesce(F.col(x), F.lit(""))) == ""


def created_when_absent(stored: DataFrame, details: DataFrame, keys: Sequence[str], identified: Column) -> DataFrame:
    """Rows of ``details`` to insert: those that identify a case which isn't stored. What is stored is never written again. Repeated keys come once."""
    fine = details.where(F.coalesce(identified, F.lit(False)))
    return fine.join(stored.select(*keys).distinct(), list(keys), "left_anti").dropDuplicates(list(keys))


def draft_imports(drafts: DataFrame, cases: DataFrame, dockets: str = "dockets") -> DataFrame:
    """``drafts`` (case_no, case_title, dockets, defendant, names) with status, errors and truncated.

    Without number or title a draft fails; if a case has its primary (first) docket, or an earlier draft of the batch (by case_no), it is skipped. The roster is
    truncated if the stated total is over the number of names, or the cell ends with "and others".
    """
    errors = F.array_compact(F.array(F.when(_blank("case_no"), "case_no"), F.when(_blank("case_title"), "case_title")))
    stated = stated_defendants("defendant")
    more = F.coalesce(stated["total"] > F.coalesce(F.size("names"), F.lit(0)), F.lit(False)) | F.coalesce(stated["bare"], F.lit(False))
    rows = drafts.withColumns({"errors": errors, "primary": F.try_element_at(dockets, F.lit(1)), "truncated": more})
    held = cases.select(F.col("docket").alias("primary")).distinct().withColumn("_held", F.lit(True))
    first = rows.where("size(errors) = 0 and primary is not null").groupBy("primary").agg(F.min("case_no").alias("_first"))
    both = rows.join(held, "primary", "left").join(first, "primary", "left")
    status = F.when(F.size("errors") > 0, "failed").when(F.col("_held"), "skipped").when(F.col("primary").isNotNull() & (F.col("case_no") != F.col("_first")), "skipped").otherwise("created")
    return both.withColumn("status", status).drop("_held", "_first")


def tax_numbers(identifiers: str | Column) -> Column:
    """The digits of identifiers (array<struct<kind, value>>) of a tax payer; a value without digits stays as it is."""
    x = F.col(identifiers) if isinstance(identifiers, str) else identifiers
    value = lambda i: F.trim(F.coalesce(i["value"], F.lit("")))
    fine = F.filter(F.coalesce(x, F.array()), lambda i: F.lower(F.coalesce(i["kind"], F.lit(""))).rlike(TAX) & (value(i) != ""))
    return F.array_distinct(F.transform(fine, lambda i: F.coalesce(F.nullif(F.regexp_replace(value(i), r"\D", ""), F.lit("")), value(i))))


def contractor_promotions(held: DataFrame, contractors: DataFrame, least: int) -> DataFrame:
    """id, publishers, contractor and promoted of held records (id, identifiers, sources): a contractor with the same tax number, or ``least`` publishers, promote one.

    Publishers are authorities, else hosts, in lower case. contractors: number.
    """
    publisher = F.coalesce(F.nullif(F.lower(F.trim("s.authority")), F.lit("")), F.nullif(web.host("s.url"), F.lit("")))
    counted = held.select("id", F.explode("sources").alias("s")).groupBy("id").agg(F.countDistinct(publisher).alias("publishers"))
    taxed = held.select("id", F.explode(tax_numbers("identifiers")).alias("number")).join(contractors.select("number").distinct(), "number").select("id").distinct().withColumn("contractor", F.lit(True))
    out = held.select("id").join(counted, "id", "left").join(taxed, "id", "left")
    out = out.select("id", F.coalesce("publishers", F.lit(0)).alias("publishers"), F.coalesce("contractor", F.lit(False)).alias("contractor"))
    return out.withColumn("promoted", F.col("contractor") | (F.col("publishers") >= least))


def alias_rows(entries: DataFrame) -> DataFrame:
    """key and tag of a vocabulary (id, label_ne, label_en, aliases): its aliases, its id and both labels, as keys."""
    raw = F.concat(F.coalesce("aliases", F.array()), F.array("id", "label_ne", "label_en"))
    return entries.select(F.explode(F.array_compact(raw)).alias("raw"), F.col("id").alias("tag")).select(tag_key("raw").alias("key"), "tag").where("key <> ''").distinct()


def alias_conflicts(entries: DataFrame) -> DataFrame:
    """key and its tags where more than one tag claims it: seeding has to stop there, as one of them would be out of reach."""
    return alias_rows(entries).groupBy("key").agg(F.array_sort(F.collect_set("tag")).alias("tags")).where(F.size("tags") > 1)


def seeded(stored: DataFrame, entries: DataFrame) -> DataFrame:
    """Tags after seeding (id, broader and the rest), with action and dangling: whether broader names no tag at all.

    All rows first, then the parents: a parent may come later in the file than its child. Tags that the file lacks stay.
    """
    rest = [x for x in entries.columns if x != "id"]
    s, e = stored.select("id", F.struct(*rest).alias("_old")), entries.select("id", F.struct(*rest).alias("_new"))
    rows = s.join(e, "id", "full")
    action = F.when(F.col("_new").isNull(), "kept").when(F.col("_old").isNull(), "created").otherwise("updated")
    rows = rows.select("id", *(F.coalesce(F.when(F.col("_new").isNotNull(), F.col(f"_new.{x}")), F.when(F.col("_new").isNull(), F.col(f"_old.{x}"))).alias(x) for x in rest), action.alias("action"))
    known = stored.select(F.col("id").alias("broader")).unionByName(entries.select(F.col("id").alias("broader"))).distinct().withColumn("_is", F.lit(True))
    return rows.join(known, "broader", "left").withColumn("dangling", F.col("broader").isNotNull() & F.col("_is").isNull()).drop("_is")


def stale_content(materials: DataFrame, contents: DataFrame, failures: DataFrame) -> DataFrame:
    """iri and queue of materials (iri, sha256: null if unknown): whether to extract it.

    Stale is what has no content, or content (iri, revision) of other known bytes; an unknown digest isn't stale. What failed (iri, sha256) for these bytes waits,
    and unknown bytes on both sides are the same.
    """
    digest = F.coalesce("sha256", F.lit(""))
    done = contents.select("iri", F.col("revision").alias("_revision"), F.lit(True).alias("_done"))
    failed = failures.select("iri", F.coalesce("sha256", F.lit("")).alias("_digest")).distinct().withColumn("_failed", F.lit(True))
    rows = materials.select("iri", digest.alias("_digest")).join(done, "iri", "left").join(failed, ["iri", "_digest"], "left")
    stale = F.col("_done").isNull() | ((F.col("_digest") != "") & ~F.col("_revision").eqNullSafe(F.concat(F.lit("sha256:"), F.col("_digest"))))
    return rows.select("iri", stale.alias("stale"), (stale & F.col("_failed").isNull()).alias("queue"))


def mapped_files(files: DataFrame, releases: DataFrame, form: str) -> DataFrame:
    """path, release and verdict of files: the id that ``form`` (one group) finds in the name; mapped, unknown id, or without one. releases: id, url."""
    rows = files.withColumn("id", F.regexp_extract(F.regexp_extract("path", "([^/]*)$", 1), form, 1).try_cast("long"))
    both = rows.join(releases.select("id", "url").dropDuplicates(["id"]), "id", "left")
    return both.select("path", "id", "url", F.when(F.col("id").isNull(), "no id").when(F.col("url").isNull(), "unknown").otherwise("mapped").alias("verdict"))


def outcome_intents(intents: DataFrame, binds: DataFrame) -> DataFrame:
    """intent and problem (null: applied) of intents (intent, case_id, outcomes: array<struct<iri, outcome>>) on binds (case_id, iri, role).

    All or nothing: an intent applies if it has outcomes, each of a kind that may be set, on an accused of its case; else the least problem is told.
    """
    items = intents.select("intent", "case_id", F.explode_outer("outcomes").alias("o")).select("intent", "case_id", "o.iri", "o.outcome")
    roles = binds.groupBy("case_id", "iri").agg(F.bool_or(F.col("role") == ACCUSED).alias("accused"))
    both = items.join(roles, ["case_id", "iri"], "left")
    problem = (
        F.when(F.col("iri").isNull() & F.col("outcome").isNull(), "1 no outcomes").when(F.col("iri").isNull() | F.col("outcome").isNull(), "2 incomplete")
        .when(~F.col("outcome").isin(*OUTCOMES), "3 outcome").when(F.col("accused").isNull(), "4 not of this case").when(~F.col("accused"), "5 not accused")
    )
    return both.groupBy("intent").agg(F.substring(F.min(problem), 3, 99).alias("problem"))


def outcomes_applied(intents: DataFrame, binds: DataFrame) -> DataFrame:
    """``binds`` (case_id, iri, role, outcome) after the intents without a problem; of several for one bind the last intent counts."""
    fine = outcome_intents(intents, binds).where("problem is null")
    items = intents.join(fine.select("intent"), "intent", "left_semi").select("intent", "case_id", F.explode("outcomes").alias("o"))
    last = items.groupBy("case_id", F.col("o.iri").alias("iri")).agg(F.max_by("o.outcome", "intent").alias("_new"))
    set_it = F.when(F.col("role") == ACCUSED, F.coalesce("_new", "outcome")).otherwise(F.col("outcome"))
    return binds.join(last, ["case_id", "iri"], "left").select(*[x for x in binds.columns if x != "outcome"], set_it.alias("outcome"))


def material_links(intents: DataFrame, references: DataFrame) -> DataFrame:
    """case_id, iri and ordinal of links to append (intents: case_id, iri, seq): after the case's last, in order; what is linked already isn't linked again."""
    from pyspark.sql import Window

    fresh = first_occurrence(intents.select("case_id", "iri", "seq"), ["case_id", "iri"], ["seq"]).join(references.select("case_id", "iri"), ["case_id", "iri"], "left_anti")
    last = references.groupBy("case_id").agg(F.max("ordinal").alias("_last"))
    place = F.row_number().over(Window.partitionBy("case_id").orderBy("seq", "iri"))
    return fresh.withColumn("_place", place).join(last, "case_id", "left").select("case_id", "iri", (F.coalesce("_last", F.lit(0)) + F.col("_place")).alias("ordinal"))


def ingested(stored: DataFrame, incoming: DataFrame, sources: DataFrame, base: str, least: int) -> DataFrame:
    """One batch of entities: raw_id, iri, destination (malformed, held or stored) and the version and created_at that it gets.

    Ids are brought to ``base`` before anything meets; of repeated ids the first by ``position`` counts; fewer than ``least`` publishers (sources: raw_id, publisher)
    hold a record back, without a version. stored: iri, version, created_at. incoming: raw_id, position, created_at.
    """
    rows = incoming.withColumn("iri", web.canonical_iri(base, "raw_id"))
    bad = rows.where("iri is null").select("raw_id", "iri", F.lit("malformed").alias("destination"), F.lit(None).cast("long").alias("version"), "created_at")
    counted = publisher_gate(sources.withColumn("iri", web.canonical_iri(base, "raw_id")).where("iri is not null"), "iri", F.col("publisher"), least)
    new = versioned(stored, rows.where("iri is not null"), "iri").join(counted, "iri", "left")
    held = F.coalesce("held", F.lit(True))
    good = new.select("raw_id", "iri", F.when(held, "held").otherwise("stored").alias("destination"), F.when(~held, F.col("version")).cast("long").alias("version"), "created_at")
    return good.unionByName(bad)


def once(read_done: Callable[[], DataFrame], key: str, apply: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: at-least-once delivery with the effect of once. Events whose key is done are left out, and of repeated ones in a batch one stays.

    ``apply`` writes effect and key together; it gets the batch's number, so that a replay of the same batch overwrites. ``read_done`` reads the keys anew each time.
    """
    return lambda batch, number: apply(batch.dropDuplicates([key]).join(read_done().select(key), key, "left_anti"), number)


def staged(proposals: DataFrame, already: DataFrame, keys: Sequence[str], least: float) -> DataFrame:
    """``proposals`` (keys, confidence, proposed_at) with verdict: below the threshold, staged before (already: keys), a weaker repeat in this batch, or staged. Of repeated ones the most confident counts, then the earliest."""
    best = proposals.where(F.col("confidence") >= least).groupBy(*keys).agg(F.max_by(F.struct("confidence", "proposed_at"), F.struct("confidence", -F.unix_micros(F.col("proposed_at").cast("timestamp")))).alias("_best"))
    held = already.select(*keys).distinct().withColumn("_held", F.lit(True))
    rows = proposals.join(held, list(keys), "left").join(best, list(keys), "left")
    first = (F.col("confidence") == F.col("_best.confidence")) & (F.col("proposed_at") == F.col("_best.proposed_at"))
    verdict = F.when(~F.coalesce(F.col("confidence") >= least, F.lit(False)), "unsure").when(F.col("_held"), "staged before").when(~first, "repeated").otherwise("staged")
    return rows.select(*proposals.columns, verdict.alias("verdict"))
