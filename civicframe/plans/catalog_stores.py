"""Queries over stores that change by files, streams with several consumers, files of other formats, scraped text and twins of places; they extend ``plans.catalog``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicframe.functions import redaction
from civicframe.functions import text as tx
from civicframe.operators import places, upsert
from civicframe.sources import keyed, readers
from civicframe.storage import shared_path
from civicframe.streaming.consumers import Consumer, Fanout

from .catalog import n, query

# -- stores ----------------------------------------------------------------------------------------------------------------

KEY = ["o_orderdate", "o_orderkey"]


def _orders(o: DataFrame) -> keyed.Store:
    rows = o.select("o_orderdate", "o_orderkey", "o_orderstatus", "o_totalprice")
    return keyed.create(o.sparkSession, shared_path(o.sparkSession, "orders-store"), rows, KEY, [F.year("o_orderdate")])


def _merged(o: DataFrame) -> tuple[keyed.Store, DataFrame]:
    """The store after a merge into 1995: every tenth order updated, every hundredth removed, some new; and its files before."""
    store = _orders(o)
    before = keyed.files(store)
    rows = o.where((F.year("o_orderdate") == 1995) & (F.col("o_orderkey") % 5 == 0)).select("o_orderdate", "o_orderkey", F.lit("M").alias("o_orderstatus"), "o_totalprice")
    new = rows.where("o_orderkey % 10 = 5").withColumn("o_orderkey", -F.col("o_orderkey"))
    keyed.merge(store, rows.where("o_orderkey % 10 = 0").unionByName(new), F.col("o_orderkey") % 100 == 0)
    return store, before


@query(
    "SNK15_file_merge",
    "orders",
    sql="""
    select o_orderkey, case when year(o_orderdate) = 1995 and o_orderkey % 10 = 0 then 'M' else o_orderstatus end o_orderstatus, o_totalprice from orders
    where not (year(o_orderdate) = 1995 and o_orderkey % 100 = 0)
    union all select -o_orderkey, 'M', o_totalprice from orders where year(o_orderdate) = 1995 and o_orderkey % 10 = 5""",
)
def _(o):
    return keyed.rows(_merged(o)[0]).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("SNK15_files_kept", "orders", sql="select year(o_orderdate)::int as y, year(o_orderdate) <> 1995 as kept from orders group by all")
def _(o):
    store, before = _merged(o)
    after = keyed.files(store).select("file", F.lit(True).alias("_live"))
    return before.join(after, "file", "left").groupBy(F.year("lo.o_orderdate").alias("y")).agg(F.every(F.coalesce("_live", F.lit(False))).alias("kept"))


def _recomputed(rows: DataFrame) -> DataFrame:
    status = F.when(F.col("o_orderkey") % 5 == 0, "N").otherwise(F.col("o_orderstatus"))
    price = F.when((F.col("o_orderkey") % 3 == 0) & (F.year("o_orderdate") < 1996), 0).otherwise(F.col("o_totalprice"))
    return rows.withColumns({"o_orderstatus": status, "o_totalprice": price})


@query(
    "SNK8_file_backfill",
    "orders",
    sql="""
    select concat_ws(',', case when o_orderkey % 5 = 0 then 'o_orderstatus' end, case when o_orderkey % 3 = 0 and year(o_orderdate) < 1996 then 'o_totalprice' end) changed,
        count(*) n from orders group by 1 having changed <> ''""",
)
def _(o):
    store = _orders(o)
    before = keyed.rows(store)
    for _ in keyed.backfill(store, _recomputed, "status", batch=4, dry_run=False):
        pass
    return upsert.changed_columns(before, keyed.rows(store), KEY).groupBy("changed").agg(n())


# -- one stream, many consumers ----------------------------------------------------------------------------------------------


@query(
    "STM9_consumers",
    "events",
    sql="""
    select 'all' as consumer, event_id, 'handled' as outcome, 1 as delivered from events
    union all select 'clicks', event_id, case when event_id % 10 in (0, 1) then 'dead' else 'handled' end,
        case event_id % 10 when 0 then 1 when 1 then 3 when 2 then 2 else 1 end from events where event_type = 'click'""",
)
def _(e):
    """Three batches; the second consumer is down for one of them at first, refuses some rows for good, some each time and some once."""
    spark, down = e.sparkSession, [False, True, False]
    folder = shared_path(spark, "consumers")
    rows = e.select(F.concat(F.lit("web."), "event_type").alias("subject"), F.col("event_id").cast("string").alias("dedup_key"), "event_id")

    def every(batch, key):
        batch.write.mode("overwrite").parquet(f"{folder}/out/all/{key}")

    def clicks(batch, key):
        if down and down.pop(0):
            raise OSError("down")
        digit = F.col("event_id") % 10
        bad = (digit == 0) | (digit == 1) | ((digit == 2) & (F.col("delivered") == 1))
        batch.where(~bad).write.mode("overwrite").parquet(f"{folder}/out/clicks/{key}")
        return batch.where(bad).select("dedup_key", F.lit("refused").alias("error"), (digit == 0).alias("poison"))

    fan = Fanout(spark, folder, [Consumer("all", "web.>", every), Consumer("clicks", "web.click", clicks, most=3)])
    for i in range(3):
        fan(rows.where(F.col("event_id") % 3 == i), i)
    fan.drain()
    told = [(name, spark.read.parquet(f"{folder}/out/{name}/*"), "handled") for name in ("all", "clicks")] + [("clicks", fan.dead_letters("clicks"), "dead")]
    out = [df.select(F.lit(name).alias("consumer"), "event_id", F.lit(outcome).alias("outcome"), "delivered") for name, df, outcome in told]
    return out[0].unionByName(out[1]).unionByName(out[2])


# -- files of other formats ----------------------------------------------------------------------------------------------------


@query("SRC2_shards", "part", sql="select p_partkey, p_name, case when p_partkey % 2 = 0 then p_size end p_size, 'deep' as config from part union all select p_partkey, p_name, null, 'flat' from part")
def _(p):
    """A config of several shards, of which some lack a column, and one of a single file's name."""
    spark, folder = p.sparkSession, shared_path(p.sparkSession, "shards")
    p.where("p_partkey % 2 = 0").select("p_partkey", "p_name", "p_size").write.parquet(f"{folder}/deep")
    p.where("p_partkey % 2 = 1").select("p_partkey", "p_name").write.mode("append").parquet(f"{folder}/deep")
    p.select("p_partkey", "p_name").write.parquet(f"{folder}/flat.parquet")
    deep, flat = (readers.shards(spark, folder, name).withColumn("config", F.lit(name)) for name in ("deep", "flat"))
    return deep.unionByName(flat, allowMissingColumns=True)


@query("SRC7_event_lines", "events", sql="select event_id, event_type, case when event_id % 4 > 1 then user_id end user_id from events where event_id % 4 > 0")
def _(e):
    """Every fourth line is cut off, and of the others some lack a field."""
    spark, path = e.sparkSession, shared_path(e.sparkSession, "event-lines")
    line = F.to_json(F.struct("event_id", "event_type", F.when(F.col("event_id") % 4 > 1, F.col("user_id")).alias("user_id")))
    e.select(F.when(F.col("event_id") % 4 == 0, F.substring(line, 1, 12)).otherwise(line)).write.text(path)
    return readers.json_lines(spark, path, "event_id long, event_type string, user_id long")


@query("SRC8_crawl_resumed", "documents", sql="select doc_id, source from documents where doc_id % 3 = 2 or doc_id % 7 = 0")
def _(d):
    """A cache of what was fetched, some of its lines broken by a crash: those are to be fetched again."""
    spark, path = d.sparkSession, shared_path(d.sparkSession, "crawl")
    line = F.to_json(F.struct("doc_id", "text"))
    d.where("doc_id % 3 < 2").select(F.when(F.col("doc_id") % 7 == 0, F.substring(line, 1, 9)).otherwise(line)).write.text(path)
    return readers.unseen(readers.json_lines(spark, path, "doc_id long, text string"), d.select("doc_id", "source"), "doc_id")


@query("SRC10_batch_slugs", "part", sql="select slug, row_number() over (order by first) as position from (select p_brand slug, min(p_partkey) as first from part where p_partkey % 3 > 0 group by 1)")
def _(p):
    """Files in the order of part keys; every third line is blank."""
    spark, path = p.sparkSession, shared_path(p.sparkSession, "slugs")
    slug = F.when(F.col("p_partkey") % 3 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), "p_brand", F.lit(" ")))
    ordered = p.repartitionByRange(4, "p_partkey").sortWithinPartitions("p_partkey").select(slug.alias("slug"), F.lit("x").alias("note"))
    ordered.write.option("header", "true").options(ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv(path)
    return readers.batch_slugs(spark, path)


# -- text of scraped pages -----------------------------------------------------------------------------------------------------


@query("STR19_mojibake", "customer", sql="select c_custkey, 'अदालत ' || c_name || case when c_custkey % 3 = 2 then ' é' else '' end as name from customer")
def _(c):
    text = F.concat(F.lit("अदालत "), "c_name", F.when(F.col("c_custkey") % 3 == 2, " é").otherwise(""))
    garbled = F.when(F.col("c_custkey") % 3 == 0, text).otherwise(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"))
    return c.select("c_custkey", tx.repaired_mojibake(garbled).alias("name"))


@query(
    "STR29_cells",
    "supplier",
    sql="""
    select s_suppkey, case when s_suppkey % 5 > 0 then 'माननीय ' || s_name || ', माननीय श्याम' end judges, s_name || ' (' || s_nationkey || ')' note,
        case when s_suppkey % 4 > 0 then s_suppkey end::int as count from supplier""",
)
def _(s):
    judges = F.when(F.col("s_suppkey") % 5 == 0, " \n ").otherwise(F.concat(F.lit("  माननीय \t"), "s_name", F.lit("माननीय  श्याम ")))
    note = F.concat(F.lit("'"), "s_name", F.lit("(  "), "s_nationkey", F.lit(" )'"))
    count = F.when(F.col("s_suppkey") % 4 == 0, "none").otherwise(F.concat(tx.devanagari_digits(F.col("s_suppkey").cast("string")), F.lit(" पटक")))
    return s.select("s_suppkey", tx.split_judges(judges).alias("judges"), tx.spaced_parentheses(note).alias("note"), tx.counted(count).alias("count"))


# -- places ----------------------------------------------------------------------------------------------------------------------


@query(
    "ENT13_redirects",
    "customer",
    "supplier",
    "nation",
    "region",
    sql="""
    with t as (
        select case c_custkey % 3 when 0 then 'unit ' || c_nationkey when 1 then 'area ' || n_regionkey else 'mixed ' || c_custkey % 4 end k,
            'u' || c_nationkey iri, 'd' || n_regionkey d
        from customer join nation on c_nationkey = n_nationkey),
    g as (select k, count(distinct iri) i, count(distinct d) n, min(iri) iri, min(d) d from t group by 1),
    m as (
        select s_suppkey, case s_suppkey % 4 when 0 then 'unit ' || s_nationkey when 1 then 'area ' || n_regionkey when 2 then 'mixed 2' else 'elsewhere' end k
        from supplier join nation on s_nationkey = n_nationkey)
    select s_suppkey, case when n > 1 then null when i > 1 then d else iri end iri, case when n is null then 'no twin' when n > 1 then 'twins disagree' end reason
    from m left join g using (k)""",
)
def _(c, s, n_, r):
    """Entries without a code bear a local title and, in another script, that of a unit."""
    none = F.lit(None).cast("string")
    districts = r.select(F.concat(F.lit("d"), "r_regionkey").alias("iri"), F.lit("district").alias("kind"), none.alias("parent"), F.col("r_name").alias("name"))
    units = n_.select(F.concat(F.lit("u"), "n_nationkey").alias("iri"), F.lit("unit").alias("kind"), F.concat(F.lit("d"), "n_regionkey").alias("parent"), F.col("n_name").alias("name"))
    k = F.col("c_custkey") % 3
    local = F.when(k == 0, F.concat(F.lit("Unit "), "c_nationkey")).when(k == 1, F.concat(F.lit("Area, "), "n_regionkey")).otherwise(F.concat(F.lit("MIXED "), F.col("c_custkey") % 4))
    twins = c.join(n_, c.c_nationkey == n_.n_nationkey).select(F.concat(F.lit("c"), "c_custkey").alias("iri"), F.array(local, "n_name").alias("titles"))
    q = F.col("s_suppkey") % 4
    at = F.when(q == 0, F.concat(F.lit("unit-"), "s_nationkey")).when(q == 1, F.concat(F.lit("(area "), "n_regionkey", F.lit(")"))).when(q == 2, "Mixed 2").otherwise("elsewhere")
    mentions = s.join(n_, s.s_nationkey == n_.n_nationkey).select("s_suppkey", at.alias("place"))
    return places.redirected(mentions, "s_suppkey", "place", twins, districts.unionByName(units)).select("s_suppkey", "iri", "reason")


# -- windows and redaction ---------------------------------------------------------------------------------------------------------


def _ended(rows: str) -> str:
    """SQL for the end of a window (t, s, target): 300 characters, overlap 40, slack 100."""
    part = f"(select *, greatest(s, target - 100) low, instr(reverse(substr(t, greatest(s, target - 100) + 1, target - greatest(s, target - 100))), chr(10)) back from {rows})"
    return f"(select *, case when target >= length(t) then length(t) when back > 0 and target - back + 1 > s + 40 then target - back + 1 else target end e from {part})"


@query(
    "STR24_snapped_windows",
    "documents",
    sql=f"""
    with recursive d as (select doc_id, replace(coalesce(text, ''), '. ', '.' || chr(10)) t from documents),
    w as (
        select doc_id, t, 0 s, 300 + doc_id % 50 target from d
        union all select doc_id, t, e - 40, e - 40 + 300 from {_ended("w")} where e < length(t))
    select doc_id, s::int as start, e::int as "end", sha256(substr(t, s::bigint + 1, (e - s)::bigint)) body from {_ended("w")}""",
)
def _(d):
    text = F.replace(F.coalesce("text", F.lit("")), F.lit(". "), F.lit(".\n"))
    w = d.select("doc_id", F.inline(tx.snapped_windows(text, 300, 40, 100, F.col("doc_id") % 50)))
    return w.select("doc_id", "start", "end", F.sha2("body", 256).alias("body"))


@query(
    "STR27_published",
    "documents",
    sql="""
    with d as (select doc_id, coalesce(text, '') t from documents),
    e as (select doc_id, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+')) + (doc_id % 5 = 1)::int n from d)
    select doc_id, case when doc_id % 5 = 2 then 'withheld' else 'told' end as action, case when doc_id % 5 = 2 then 'citizenship' else '' end residual, n::int email from e""",
)
def _(d):
    """To some texts a mail address is added, to others a number in a shape that no rule takes out."""
    t = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 5 == 1, " a.b@example.org ").when(F.col("doc_id") % 5 == 2, "\ncitizenship no: 12/345/6789").otherwise(""))
    out = redaction.published(d.select("doc_id", t.alias("text")), "text", "contact")
    action = F.when(F.col("action") == "withheld", "withheld").otherwise("told")
    mails = F.coalesce(F.try_element_at("counts", F.lit("email")), F.lit(0))
    return out.select("doc_id", action.alias("action"), F.array_join(F.map_keys("residual"), ",").alias("residual"), mails.alias("email"))
