"""Queries over pages, envelopes and the checks of whole stores; they extend ``plans.catalog``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from civicframe.functions import calendar, web
from civicframe.functions import text as tx
from civicframe.operators import casework, review, search, upsert
from civicframe.sources import pages, sinks
from civicframe.streaming import events

from .catalog import query
from .catalog_dockets import _STARTS, _months

# -- sources ---------------------------------------------------------------------------------------------------------------


@query("SRC11_tender", "pages", sql="select page_id, 'T-' || page_id as number, case when page_id % 2 = 0 then 'Roads Office' end office, url from pages")
def _(p):
    even = F.col("page_id") % 2 == 0
    rows = F.concat(
        F.lit("<table><tr><td> Tender <b>No.</b>: </td><td></td><td>T-"), "page_id", F.lit("</td></tr><tr><td>Office</td><td>"), F.when(even, "Roads\n Office").otherwise(""), F.lit("</td><td>Source:<td>"),
        F.regexp_replace("url", "&", "&amp;"), F.lit("</tr></table>"),
    )
    made = p.select("page_id", pages.page(F.concat(rows, F.coalesce("html", F.lit("")))).alias("page"))
    found = pages.label_values(F.col("page"), {"Tender No.": "number", "Office": "office", "Source": "url"})
    return made.select("page_id", found.alias("f")).select("page_id", *(F.try_element_at("f", F.lit(k)).alias(k) for k in ("number", "office", "url")))


@query("SRC11_cause_list", "supplier", "nation", sql="select n_nationkey, s_suppkey::varchar number, s_name party from supplier join nation on s_nationkey = n_nationkey")
def _(s, n):
    row = F.concat(F.lit("<tr><td>"), "s_suppkey", F.lit("<td> "), "s_name", F.lit(" </td><td>x</td></tr>"))
    lists = s.groupBy("s_nationkey", F.floor(F.col("s_suppkey") / 50)).agg(F.array_join(F.array_sort(F.collect_list(row)), "").alias("rows"))  # lists of 50 rows at most
    html = F.concat(F.lit("<table><tr><th>No</th><th>Party</th><th>Note</th></tr><tr><td></td><td>blank</td><td></td></tr><tr><td>too short</td></tr>"), "rows", F.lit("</table>"))
    made = n.join(lists, n.n_nationkey == lists.s_nationkey).select("n_nationkey", pages.page(html).alias("page"))
    rows = made.select("n_nationkey", F.explode(pages.table_rows(F.col("page"), ["No", "Party", "Note"])).alias("r"))
    return rows.select("n_nationkey", F.col("r")["No"].alias("number"), F.col("r")["Party"].alias("party"))


_DAY = "date '2019-03-01' + (page_id % 700)::int"


@query(
    "SRC12_published",
    "pages",
    sql=f"""
    with p as (select page_id, page_id % 7 k, {_DAY} d, html from pages)
    select page_id, case when k = 6 then null when k = 5 then d + 1 else d end published, regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1) <> '' titled from p""",
)
def _(p):
    day = F.date_add(F.lit("2019-03-01").cast("date"), (F.col("page_id") % 700).cast("int"))
    iso, k = F.date_format(day, "yyyy-MM-dd"), F.col("page_id") % 7
    time = F.concat(F.lit("<time datetime='"), F.date_format(F.date_add(day, 1), "yyyy-MM-dd"), F.lit("'>x</time>"))
    carriers = [
        F.concat(F.lit("<meta property='article:published_time' content='"), iso, F.lit("T10:00:00Z'>"), time),
        F.concat(F.lit("<meta content='"), F.date_format(day, "MMMM d, yyyy"), F.lit("' name='DC.date.issued'>"), time),
        F.concat(F.lit("<meta itemprop=datePublished content="), iso, F.lit(">"), time),
        F.concat(F.lit('<script type="application/ld+json">{"@graph": [{"x": 1}, {"datePublished": "'), iso, F.lit('"}]}</script>'), time),
        F.concat(F.lit("<meta name=date content=2082-04-20><p>प्रकाशित: "), F.date_format(day, "yyyy/M/d"), F.lit("</p>")),  # a year of Bikram Sambat is passed over
        F.concat(time, F.lit("<script>{\"datePublished\": \"2001-01-01\"}</script>")),
        F.lit("<p>मिति २०८२-०४-२०</p><script type='application/ld+json'>{broken</script>"),
    ]
    head = F.lit("")
    for i, x in enumerate(carriers):
        head = F.when(k == i, x).otherwise(head)
    made = p.select("page_id", pages.page(F.concat(head, F.coalesce("html", F.lit("")))).alias("page"))
    return made.select("page_id", pages.published(F.col("page"), 2030).alias("published"), (F.col("page.title") != "").alias("titled"))


@query("SRC11_press_release", "pages", sql="""select page_id, 'Release ' || page_id title, '2081-0' || (1 + page_id % 9) || '-05' as "date", ['/f/' || page_id || '.PDF'] files from pages""")
def _(p):
    head = F.concat(F.lit("<style>1999-01-01</style><h1>Release\n<i>"), "page_id", F.lit("</i></h1><p>मिति २०८१।"), F.translate((1 + F.col("page_id") % 9).cast("string"), "123456789", "१२३४५६७८९"), F.lit("।५</p><a href='/f/"), "page_id", F.lit(".PDF'>x</a><a href='/y'>y</a>"))
    made = p.select("page_id", pages.press_release(F.concat(head, F.regexp_replace(F.coalesce("html", F.lit("")), r"(?i)\.(pdf|docx?)", ""))).alias("r"))
    return made.select("page_id", "r.title", "r.date", "r.files")


@query("SRC9_envelopes", "customer", sql="""select c_custkey, case when c_custkey % 4 in (0, 1) then 'person' end prefix, case when c_custkey % 4 < 3 then c_name end as name, case c_custkey % 4 when 0 then 'https://a.example' when 1 then 'https://b.example' end source,
    case when c_custkey % 4 = 3 then 'neither prefix nor id' end problem from customer where c_custkey % 5 > 0 union all select c_custkey, null, null, null, 'not an object' from customer where c_custkey % 5 = 0""")
def _(c):
    k = F.col("c_custkey")
    name = F.to_json(F.struct(F.col("c_name").alias("name"))).substr(F.lit(2), F.lit(999))
    line = (
        F.when(k % 5 == 0, F.when(k % 2 == 0, "[1]").otherwise("not json"))
        .when(k % 4 == 0, F.concat(F.lit('{"entity_prefix": "person", "sources": ["https://a.example"], "entity_data": {"n": 1, '), name, F.lit("}")))
        .when(k % 4 == 1, F.concat(F.lit('{"entity_prefix": "person", "sources": [{"url": "https://b.example", "authority": "B"}], '), name))
        .when(k % 4 == 2, F.concat(F.lit('{"@id": "https://r.example/entity/person/x", '), name)).otherwise(F.concat(F.lit("{"), name))
    )
    made = pages.entity_records(c.select("c_custkey", line.alias("value")), keep=["c_custkey"])
    return made.select("c_custkey", "prefix", F.get_json_object("data", "$.name").alias("name"), F.try_element_at("sources", F.lit(1))["url"].alias("source"), "problem")


# -- checks of whole stores --------------------------------------------------------------------------------------------------


@query("PIPE11_reconcile", "orders", "customer", sql="""with e as (select o_custkey as iri, count(distinct o_orderkey) expected from orders where o_orderstatus <> 'P' group by 1), i as (select c_custkey as iri, case when c_custkey % 3 = 0 then 1 else coalesce(expected, 0) end indexed from customer left join e on c_custkey = iri where c_custkey % 7 > 0)
    select coalesce(e.iri, i.iri) as iri, coalesce(expected, 0) expected, indexed from e full join i on e.iri = i.iri where coalesce(expected, 0) <> coalesce(indexed, -1)""")
def _(o, c):
    binds = o.select(F.col("o_custkey").alias("iri"), F.col("o_orderkey").alias("case_id"))
    cases = o.select(F.col("o_orderkey").alias("case_id"), (F.col("o_orderstatus") != "P").alias("published"))
    true = o.where("o_orderstatus <> 'P'").groupBy("o_custkey").agg(F.count("*").alias("n"))
    index = c.where("c_custkey % 7 > 0").join(true, F.col("c_custkey") == F.col("o_custkey"), "left")
    index = index.select(F.col("c_custkey").alias("iri"), F.when(F.col("c_custkey") % 3 == 0, 1).otherwise(F.coalesce("n", F.lit(0))).alias("case_count"))
    return review.reconciled(binds.unionByName(binds), cases, index)


@query("AGG28_truncation_ceiling", "lineitem", sql="select count(*) created, count(*) filter (where l_discount > 0.08) flagged, (count(*) filter (where l_discount > 0.08))::double / count(*) rate from lineitem")
def _(li):
    return review.under_ceiling(li, F.col("l_discount") > 0.08, 0.5, 20)


@query("SNK7_snapshot", "orders", "customer", sql="""select 'cases' as key, (select count(*) from orders) n, 'updated' as action union all select 'entities', (select count(*) from customer), 'created' union all select 'old', 7, 'kept'""")
def _(o, c):
    count = lambda df, key: df.agg(F.count("*").alias("n")).select(F.lit(key).alias("key"), "n")
    stored = o.sparkSession.createDataFrame([("cases", -1), ("old", 7)], "key string, n long")
    return upsert.upsert(stored, count(o, "cases").unionByName(count(c, "entities")), ["key"])


@query("ENT11_duplicates", "customer", sql="""with p as (select c_custkey, lower(c_mktsegment) as name, 'Q' || (1000 + c_nationkey) qid from customer), s as (select name, qid, min(lpad(c_custkey::varchar, 9, '0')) survivor from p group by 1, 2)
    select survivor, lpad(c_custkey::varchar, 9, '0') as iri, qid from p join s using (name, qid) where lpad(c_custkey::varchar, 9, '0') <> survivor""")
def _(c):
    name = F.concat(F.lit(" "), F.when(F.col("c_custkey") % 2 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")))
    ids = F.concat(F.lit("https://data.example/wiki/Q"), 1000 + F.col("c_nationkey"))
    return review.duplicate_persons(c.select(F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("iri"), name.alias("name_en"), F.concat_ws(" ", ids, ids).alias("ids")))


@query("ENT15_type_detection", "orders", sql="""select o_orderkey, case when o_orderkey % 10 = 9 then 'other' when o_orderkey % 5 in (0, 1) then case o_orderkey % 3 when 0 then 'verdict' when 1 then 'extended' else 'basic' end when o_orderkey % 5 in (2, 3) then 'other'
    else case o_orderkey % 3 when 1 then 'extended' when 2 then 'basic' else 'other' end end as type from orders""")
def _(o):
    k = F.col("o_orderkey")
    docket = F.expr("case o_orderkey % 5 when 0 then 'special/081-CR-0001' when 1 then 'supreme/081-CR-0001' when 2 then 'supreme/075-WO-0696' when 3 then 'patanhc/081-CR-0002' end")
    iris = F.array_compact(F.array(F.concat(F.lit("https://r.example/courtcase/"), docket), F.when(k % 5 == 0, "https://r.example/courtcase/patanhc/1")))
    kinds = F.array(F.when(k % 3 == 0, "VERDICT").when(k % 3 == 1, "CHARGE_SHEET").otherwise("PRESS_RELEASE"))
    return o.select("o_orderkey", review.detected(iris, kinds, F.when(k % 10 == 9, "money_laundering"), ["MONEY_LAUNDERING"])["type"].alias("type"))


_TRUTH = "select l_orderkey k, l_linestatus v from lineitem where l_linenumber % 3 > 0"


@query("PIPE17_evaluation", "lineitem", "orders", sql=f"""with t as (select k, min(v) want from ({_TRUTH}) group by 1 having min(v) = max(v)), p as (select o_orderkey k, case when o_orderpriority = '1-URGENT' then 'abstained' else o_orderstatus end as got from orders where o_orderpriority <> '5-LOW')
    select want, coalesce(got, 'missing') as got, count(*) n from t left join p using (k) group by 1, 2""")
def _(li, o):
    truth = li.select(F.col("l_orderkey").alias("case_number"), F.col("l_linestatus").alias("verdict"), (F.col("l_linenumber") % 3 == 0).alias("derived"))
    said = o.where("o_orderpriority <> '5-LOW'").select(F.col("o_orderkey").alias("case_number"), F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_orderstatus")).alias("verdict"))
    return review.evaluated(truth, said)


def _vocabulary(p):
    words = p.select(F.explode(F.split("p_name", " ")).alias("w")).distinct()
    aliases = words.where("w < 'm'").select(F.col("w").alias("key"), F.when(F.col("w") < "g", F.concat(F.lit("tag-"), F.substring("w", 1, 1))).alias("tag"), F.lit("").alias("reason"))
    return aliases, aliases.where("tag is not null").select(F.col("tag").alias("id"), F.lit(None).cast("string").alias("merged_into")).distinct()


@query("PIPE13_vocabulary_rebuild", "part", sql="""with t as (select unnest(string_split(p_name, ' ')) w from part) select case when w < 'g' then 'canonical' when w < 'm' then 'retired' else 'unknown' end as resolution, upper(w) as raw, case when w < 'g' then 'tag-' || w[1] end as tag, count(*) n from t group by 1, 2, 3""")
def _(p):
    aliases, tags = _vocabulary(p)
    return review.rebuilt(p.select(F.col("p_partkey").alias("case_id"), F.split(F.upper("p_name"), " ").alias("tags")), aliases, tags)[0]


@query("PIPE13_rewritten", "part", sql="""with t as (select p_partkey, unnest(string_split(p_name, ' ')) w, generate_subscripts(string_split(p_name, ' '), 1) i from part), k as (select p_partkey, case when w < 'g' then 'tag-' || w[1] else upper(w) end t, min(i) i from t where w < 'g' or w >= 'm' group by 1, 2)
    select p_partkey as case_id, coalesce(list(t order by i) filter (where t is not null), []) as tags from part left join k using (p_partkey) group by p_partkey, p_name having coalesce(list(t order by i) filter (where t is not null), []) <> string_split(upper(p_name), ' ')""")
def _(p):
    aliases, tags = _vocabulary(p)
    return review.rebuilt(p.select(F.col("p_partkey").alias("case_id"), F.split(F.upper("p_name"), " ").alias("tags")), aliases, tags)[1]


@query("SRCH12_document_hits", "lineitem", "part", sql="""with u as (select l_orderkey doc, l_linenumber p, 0 r, 'page' kind, null as key, p_name t from lineitem join part on l_partkey = p_partkey union all select l_orderkey, l_linenumber, 1, 'table', 't' || l_suppkey, p_type from lineitem join part on l_partkey = p_partkey)
    select doc as document, p as page_no, kind, key, row_number() over w as place, count(*) over (partition by doc) total from u where contains(lower(t), 'small') window w as (partition by doc order by p, r, key) qualify row_number() over w <= 5""")
def _(li, p):
    rows = li.join(p, li.l_partkey == p.p_partkey)
    pages_ = rows.select(F.col("l_orderkey").alias("document"), F.col("l_linenumber").alias("page_no"), F.col("p_name").alias("text"))
    tables = rows.select(F.col("l_orderkey").alias("document"), F.col("l_linenumber").alias("page_no"), F.concat(F.lit("t"), "l_suppkey").alias("key"), F.col("p_type").alias("text"))
    return review.document_hits(pages_, tables, tables.limit(0), "SMALL", 5).drop("by")


@query("STM12_catch_up", "orders", sql="select o_orderkey, o_orderstatus || case when o_orderdate >= timestamp '1996-01-01' then '' else ' old' end status from orders where o_orderdate < timestamp '1996-01-01' and o_orderkey % 2 = 0 or o_orderdate >= timestamp '1996-01-01' and o_orderstatus <> 'F'")
def _(o):
    index = o.where("o_orderkey % 2 = 0").select("o_orderkey", F.concat("o_orderstatus", F.lit(" old")).alias("status"))
    changes = review.changed_since(o, "1996-01-01", "o_orderdate", F.col("o_orderstatus") == "F").select("o_orderkey", F.col("o_orderstatus").alias("status"), "evicted")
    return sinks.catch_up(index, changes, "o_orderkey")


# -- writes, streams, order --------------------------------------------------------------------------------------------------


def _docket(p, brand, extra):
    return p.select("p_partkey", brand.alias("brand"), F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit(extra), F.lit("x")).alias("extra"))


@query("SNK3_cause_list", "part", sql="""select p_partkey, case when p_partkey % 5 in (0, 1) and p_partkey % 4 > 0 then p_brand when p_partkey % 5 = 0 then null else p_type end brand, case when p_partkey % 4 > 0 and p_partkey % 5 > 0 then 3 else 2 end keys,
    case when p_partkey % 4 = 0 then 'created' when p_partkey % 5 = 0 then 'kept' else 'updated' end as action from part where p_partkey % 4 > 0 or p_partkey % 5 > 0""")
def _(p):
    stored = _docket(p.where("p_partkey % 4 > 0"), F.col("p_brand"), "old")
    incoming = _docket(p.where("p_partkey % 5 > 0"), F.when((F.col("p_partkey") % 5 > 1) | (F.col("p_partkey") % 4 == 0), F.col("p_type")), "new")
    return upsert.listed(stored, incoming, ["p_partkey"], "extra").select("p_partkey", "brand", F.size("extra").alias("keys"), "action")


@query("SNK5_enriched", "part", sql="""select p_partkey, case when p_partkey % 3 = 1 then p_type else p_brand end judge, case when p_partkey % 3 = 1 then coalesce(case when p_partkey % 2 = 0 then 'OLD' end, 'CONVICTED') when p_partkey % 2 = 0 then 'OLD' end verdict_type,
    case p_partkey % 3 when 0 then 'kept' when 1 then 'updated' else 'rejected' end as action, case when p_partkey % 3 = 1 then 2 else 1 end keys from part""")
def _(p):
    k, none = F.col("p_partkey"), F.lit(None).cast("string")
    extra = lambda name: F.create_map(F.lit(name), F.lit("x"))
    stored = p.select("p_partkey", F.col("p_brand").alias("judge"), F.when(k % 2 == 0, "OLD").alias("verdict_type"), extra("a").alias("extra"))
    parsed = p.where("p_partkey % 3 > 0").select("p_partkey", F.when(k % 3 == 1, F.col("p_type")).alias("judge"), none.alias("verdict_type"), F.when(k % 3 == 1, extra("b")).alias("extra"))
    made = upsert.enriched(stored, parsed.unionByName(parsed.limit(0)), ["p_partkey"], "extra", F.lit("CONVICTED"))
    return made.select("p_partkey", "judge", "verdict_type", "action", F.size("extra").alias("keys"))


@query("ENT9_repointed", "orders", "customer", "lineitem", sql="""select 'cases' as store, count(*) filter (where o_custkey % 10 = 0) n from orders union all select 'entities', count(*) filter (where c_custkey % 10 = 0) from customer union all select 'materials', count(*) filter (where l_partkey % 10 = 0 and l_partkey in (select c_custkey from customer)) from lineitem""")
def _(o, c, li):
    mapping = c.where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("old"), (F.col("c_custkey") + 1).alias("new"))
    mapping = mapping.unionByName(o.where("o_custkey % 10 = 0").select(F.col("o_custkey").alias("old"), (F.col("o_custkey") + 1).alias("new"))).distinct()
    held = c.select("c_custkey")
    stores = {"cases": (o.select("o_orderkey", "o_custkey"), "o_custkey"), "entities": (held, "c_custkey"), "materials": (li.join(held, li.l_partkey == held.c_custkey, "left_semi").select("l_orderkey", "l_partkey"), "l_partkey")}
    return upsert.repointed(stores, mapping)[1]


@query(
    "ENT9_merge_commit",
    "orders",
    "lineitem",
    sql="""
    with m as (select distinct o_custkey old, o_custkey // 10 * 10 + 1 new from orders where o_custkey % 10 > 7),
    cases as (select coalesce(new, o_custkey) id from orders left join m on old = o_custkey),
    binds as (select coalesce(new, l_partkey) id from lineitem left join m on old = l_partkey),
    lineage as (select 'cases' store, old, new, count(*) n from orders join m on old = o_custkey group by all union all select 'binds', old, new, count(*) from lineitem join m on old = l_partkey group by all)
    select 'cases' store, id::varchar id, 'live' what, count(*) n from cases group by 2 union all select 'binds', id::varchar, 'live', count(*) from binds group by 2
    union all select store, old || ' > ' || new, 'lineage', n from lineage""",
)
def _(o, li):
    from civicframe.sources import generations
    from civicframe.storage import shared_path

    spark = o.sparkSession
    folder = shared_path(spark, "stores")
    generations.commit(spark, folder, {"cases": o.select("o_orderkey", F.col("o_custkey").alias("id")), "binds": li.select("l_orderkey", F.col("l_partkey").alias("id"))})
    mapping = o.where("o_custkey % 10 > 7").select(F.col("o_custkey").alias("old"), F.expr("o_custkey div 10 * 10 + 1").alias("new"))
    generations.merge(spark, folder, mapping, {"cases": "id", "binds": "id"})
    stores = generations.live(spark, folder)
    counted = [stores[s].groupBy(F.lit(s).alias("store"), F.col("id").cast("string").alias("id"), F.lit("live").alias("what")).agg(F.count("*").alias("n")) for s in ("cases", "binds")]
    lineage = stores["lineage"].select("store", F.concat_ws(" > ", "old", "new").alias("id"), F.lit("lineage").alias("what"), F.col("rows").alias("n"))
    return counted[0].unionByName(counted[1]).unionByName(lineage)


@query("STM1_lookback", "events", sql="""with m as (select max(ts) t from events), i as (select event_id, ts from events, m where ts >= t - interval 48 hour) select event_id, (select count(*) from i) > 50 saturated from (select * from i order by ts desc, lpad(event_id::varchar, 12, '0') limit 50)""")
def _(e):
    last = e.agg(F.max("ts").alias("now"))
    rows, report = events.lookback(e.select("event_id", F.lpad(F.col("event_id").cast("string"), 12, "0").alias("dedup_key"), F.col("ts").alias("occurred_at")).join(F.broadcast(last), F.lit(True)), F.col("now"), 48, 50)  # a row of one time
    return rows.select("event_id").join(F.broadcast(report.select("saturated")), F.lit(True))


@query("STM3_backfilled", "events", sql="select date_trunc('day', ts) as start, event_type as subject, count(*) filter (where event_id % 5 > 0) fresh, count(*) filter (where event_id % 5 = 0) backfilled from events group by 1, 2")
def _(e):
    written = F.col("ts") + F.when(F.col("event_id") % 5 == 0, F.expr("interval 49 hours")).otherwise(F.expr("interval 48 hours"))
    return events.backfill_totals(e.select(F.col("ts").alias("occurred_at"), F.col("event_type").alias("subject"), written.alias("written_at")), "1 day")


@query("STM8_byte_bound", "events", sql="""select event_type, event_id from (select event_type, event_id, sum(100 + event_id % 50) over (partition by event_type order by ts desc, lpad(event_id::varchar, 12, '0') desc rows unbounded preceding) s from events) where s <= 9999""")
def _(e):
    rows = e.select("event_id", "event_type", F.col("event_type").alias("subject"), F.col("ts").alias("occurred_at"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("dedup_key"))
    return events.within_bytes(rows, 100 + F.col("event_id") % 50, 9999, "day").select("event_type", "event_id")


@query("STM11_verdicts", "lineitem", sql="""with b as (select l_partkey, l_suppkey, max(l_discount) d from lineitem where l_discount >= 0.04 group by 1, 2), t as (select l_partkey, l_suppkey, min(l_shipdate) t from lineitem join b using (l_partkey, l_suppkey) where l_discount = d group by 1, 2)
    select l_orderkey, l_linenumber, case when l_discount < 0.04 then 'unsure' when l_partkey % 4 = 0 then 'staged before' when l_discount = d and l_shipdate = t then 'staged' else 'repeated' end verdict from lineitem left join b using (l_partkey, l_suppkey) left join t using (l_partkey, l_suppkey)""")
def _(li):
    rows = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_discount").alias("confidence"), F.col("l_shipdate").alias("proposed_at"))
    return casework.staged(rows, li.where("l_partkey % 4 = 0").select("l_partkey", "l_suppkey"), ["l_partkey", "l_suppkey"], 0.04).select("l_orderkey", "l_linenumber", "verdict")


@query("SRT1_all_modes", "orders", sql=" union all ".join(f"(select '{mode}' as mode, o_orderkey, row_number() over (order by {order}, o_orderkey) place from orders qualify place <= 20)" for mode, order in (
    ("relevance", "round(o_totalprice / 1000) desc nulls last, case when o_orderkey % 3 > 0 then o_orderdate end desc nulls last"), ("newest", "case when o_orderkey % 3 > 0 then o_orderdate end desc nulls last"),
    ("oldest", "case when o_orderkey % 3 > 0 then o_orderdate end asc nulls last"), ("title", "lower(o_orderpriority) asc nulls last"), ("featured", "(o_orderstatus = 'P') desc nulls last, case when o_orderkey % 3 > 0 then o_orderdate end desc nulls last"))))
def _(o):
    rows = o.select("o_orderkey", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderdate")).alias("date"), F.col("o_orderpriority").alias("title"), F.round(F.col("o_totalprice") / 1000).alias("score"), (F.col("o_orderstatus") == "P").alias("featured"))
    out = None
    for mode in ("relevance", "newest", "oldest", "title", "featured"):
        order = search.sort_order(mode, key="o_orderkey")
        top = rows.orderBy(*order).limit(20)
        one = top.select(F.lit(mode).alias("mode"), "o_orderkey", F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"))  # over the twenty
        out = one if out is None else out.unionByName(one)
    return out


@query("STR28_label", "part", sql="""select p_partkey, case when length(p_name) <= 12 then p_name else case when substr(p_name, 12, 1) not in ('', ' ') and length(regexp_replace(left(p_name, 11), '\\s+\\S*$', '')) * 2 >= 12 then regexp_replace(left(p_name, 11), '\\s+\\S*$', '') else rtrim(left(p_name, 11)) end || '…' end as label from part""")
def _(p):
    return p.select("p_partkey", tx.clipped("p_name", 12).alias("label"))


@query("STR22_four_types", "customer", sql="""select c_custkey, 'https://r.example/courtcase/special/081-cr-' || c_custkey docket, 'https://r.example/material/a/b/' || c_custkey material, case when c_custkey % 2 = 0 then 'https://r.example/case/c' || c_custkey end as case_iri from customer""")
def _(c):
    made = lambda *parts: F.concat(F.lit("http://old.example/"), *parts)
    k = F.col("c_custkey").cast("string")
    docket, material, case = made(F.lit("courtcase/Special/081-CR-"), k), made(F.lit("material/a/b/"), k, F.lit("/")), made(F.when(F.col("c_custkey") % 2 == 0, "case/c").otherwise("case/x/"), k)
    iri = lambda x, kind: web.canonical_iri("https://r.example", x, kind)
    return c.select("c_custkey", iri(docket, "courtcase").alias("docket"), iri(material, "material").alias("material"), iri(case, "case").alias("case_iri"))


@query("SRCH6_expansions", "part", sql="""with v as (select w as word, count(distinct p_partkey) freq from (select p_partkey, unnest(string_split(p_name, ' ')) w from part) group by 1), t as (select distinct left(word, 4) || 'x' || substr(word, 5) token from v where length(word) >= 5),
    m as (select token, word, levenshtein(token, word)::int distance, freq from t, v where token[1] = word[1] and levenshtein(token, word) between 1 and case when length(token) < 8 then 1 else 2 end) select token, word, distance, 0.3::double boost from m qualify row_number() over (partition by token order by distance, freq desc, word) <= 2""")
def _(p):
    words = p.select("p_partkey", F.explode(F.split("p_name", " ")).alias("word")).distinct()
    voc = words.groupBy("word").agg(F.count("*").alias("freq"))
    misspelt = voc.where("length(word) >= 5").select(F.concat(F.substring("word", 1, 4), F.lit("x"), F.expr("substr(word, 5)")).alias("token")).distinct()
    return search.expansions(search.fuzzy(voc.select("word"), misspelt), voc, 2)


@query("DT8_bs_lookback", "orders", sql=f"""{_STARTS} , l as (select unnest(generate_series(max(o_orderdate)::date - interval 29 day, max(o_orderdate)::date, interval 1 day))::date ad from orders)
    select ad, y || '-' || lpad(m::varchar, 2, '0') || '-' || lpad((ad - start::date + 1)::varchar, 2, '0') bs from l left join s on ad >= start and ad < start + days::int""")
def _(o):
    return calendar.lookback_days(o, F.to_date(F.max("o_orderdate")), 30, calendar.month_starts(_months(o.sparkSession), "1943-04-14"))
