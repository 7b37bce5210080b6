"""Queries over dockets, calendars, tags, search, writes and sweeps; they extend ``plans.catalog``.

The driver's tables hold no dockets, so the inputs are made from their columns: noise put around a known label, say, and the SQL names the label.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from civicframe.functions import calendar, dockets, web
from civicframe.functions import text as tx
from civicframe.operators import dockets as imports
from civicframe.operators import resolve, search, tags, upsert

from .catalog import n, query

# -- dockets ---------------------------------------------------------------------------------------------------------------

_LABEL = "case p_partkey % 3 when 0 then 'चोरी गरेको (दफा 241)' when 1 then 'लेनदेन' else 'घूस लिएको' end"
_NOISE = f"""case p_partkey % 6 when 0 then concat('080-C1-', lpad(cast(p_size as string), 4, '0'), ', ', {_LABEL}) when 1 then concat({_LABEL}, ' ०७९-CP-२३४२')
    when 2 then concat('भ्रष्टाचार ( ', {_LABEL}, ' )') when 3 then concat('080-CR-0199 ', 'भ्रष्टाचार (', {_LABEL}, ')') when 4 then concat('"', {_LABEL}, '"') else '080-C1-0199' end"""


@query("STR4_case_type", "part", sql=f"""select p_partkey, case p_partkey % 6 when 4 then '"' || {_LABEL} || '"' when 5 then '080-C1-0199' else {_LABEL} end case_type from part""")
def _(p):
    return p.select("p_partkey", dockets.case_type(F.expr(_NOISE)).alias("case_type"))


_STATUS = """case o_orderkey % 7 when 0 then 'आदेश /फैसलाको किसिम' when 1 then ' चली  रहेको ' when 2 then 'फैसला / अन्तिम आदेश >> आंशिक दावी पुग्ने' when 3 then 'फैसला >> नयाँ कुरा'
    when 4 then 'फैसला (मिती: २०८१/9/' || cast(1 + o_orderkey % 28 as varchar) || ')' when 5 then 'अन्तिम आदेश' else 'something' end"""


@query("STR7_case_status", "orders", sql="""select o_orderkey, case o_orderkey % 7 when 1 then 'PENDING' when 2 then 'DECIDED' when 3 then 'DECIDED' when 4 then 'DECIDED' when 5 then 'DECIDED' else 'UNKNOWN' end lifecycle,
    case o_orderkey % 7 when 2 then 'PARTIALLY_UPHELD' when 3 then 'OTHER' end verdict, case o_orderkey % 7 when 2 then 'आंशिक दावी पुग्ने' when 3 then 'नयाँ कुरा' end raw,
    case o_orderkey % 7 when 4 then '2081-09-' || lpad((1 + o_orderkey % 28)::varchar, 2, '0') end date_bs, o_orderkey % 7 = 3 unmapped from orders""")
def _(o):
    return o.select("o_orderkey", dockets.case_status(F.expr(_STATUS.replace("varchar", "string"))).alias("s")).select("o_orderkey", "s.*")


@query("STR8_order_type", "orders", sql="""select o_orderkey, case o_orderkey % 6 when 0 then 'compound' when 1 then 'terminal' when 2 then 'terminal' when 3 then 'interlocutory' when 4 then 'empty' else 'unmapped' end bucket,
    case o_orderkey % 6 when 0 then 'PARTIALLY_UPHELD' when 1 then 'DISMISSED' when 2 then 'CLAIM_UPHELD' end verdict from orders""")
def _(o):
    cell = F.expr("case o_orderkey % 6 when 0 then 'रिट खारेज, परमादेश जारी फाइल हेर्नुहोस्' when 1 then 'रिट  खारेज' when 2 then 'मागवमोजिम हुने' when 3 then 'थुनछेक' when 4 then '  ' else 'x' end")
    made = dockets.order_type(cell, {"रिट खारेज, परमादेश जारी": "PARTIALLY_UPHELD"}, {"रिट खारेज": "DISMISSED", "माग बमोजिम हुने": "CLAIM_UPHELD"}, ["थुनछेक"], ["पूर्ण इजलासमा पेश"])
    return o.select("o_orderkey", made.alias("s")).select("o_orderkey", "s.*")


@query(
    "STR10_sensitive",
    "part",
    sql="""select p_partkey, contains(replace(lower(p_name), ' ', ''), 'redpl') or contains(lower(p_type), 'promo') sensitive from part""",
)
def _(p):
    return p.select("p_partkey", dockets.names_any(F.concat_ws("|", "p_name", "p_type"), ["red pl", "PROMO"]).alias("sensitive"))


@query("STR5_stated_defendants", "part", sql="select p_partkey, case when p_partkey % 3 = 0 then p_size end total, p_partkey % 3 = 1 bare from part")
def _(p):
    cell = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("राम समेत "), tx.devanagari_digits(F.col("p_size").cast("string")))).when(F.col("p_partkey") % 3 == 1, F.lit("राम समेत ।")).otherwise("राम")
    return p.select("p_partkey", tx.stated_defendants(cell).alias("s")).select("p_partkey", "s.total", "s.bare")


_STAGE = "select o_orderkey, case when o_orderkey % 5 = 0 then 'stages[0]: stage' when o_orderkey % 5 = 1 then 'stages[1]: end before start' when o_orderkey % 5 = 2 then 'stages[0]: label required' when o_orderkey % 5 = 3 then 'stages[1]: end' end problem from orders"


@query("DT11_stage_problem", "orders", sql=_STAGE)
def _(o):
    k = F.col("o_orderkey") % 5
    none = F.lit(None).cast("string")

    def stage(name, start, end):
        return F.struct(name.alias("stage"), start.alias("start"), end.alias("end"), none.alias("label"), none.alias("notes"), none.alias("body"), none.alias("iri"))

    first = stage(F.when(k == 0, "first_instance").when(k == 2, "other").otherwise("initial"), F.lit("2020-01-01"), F.lit("2020-01-01"))
    second = stage(F.lit("appeal"), F.lit("2021-05-01"), F.when(k == 1, "2021-04-30").when(k == 3, "soon").otherwise(none))
    return o.select("o_orderkey", dockets.stage_problem(F.array(first, second)).alias("problem"))


@query("DT7_stale", "orders", sql="select o_orderkey, o_orderdate < timestamp '1996-01-01' or o_orderkey % 4 = 0 due from orders")
def _(o):
    at = F.when(F.col("o_orderkey") % 4 != 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    return o.select("o_orderkey", dockets.stale(at, "1996-01-01T00:00:00").alias("due"))


#: Month lengths by a rule of our own, as no table is at hand: 365 days a year.
_LENGTHS = (31, 31, 32, 31, 31, 31, 30, 29, 30, 29, 30, 30)


def _months(spark):
    lengths = F.array(*map(F.lit, _LENGTHS))
    return spark.range(120 * 12).select((F.lit(2000) + F.floor(F.col("id") / 12)).cast("int").alias("year"), (F.col("id") % 12 + 1).cast("int").alias("month"), F.element_at(lengths, (F.col("id") % 12 + 1).cast("int")).alias("days"))


_STARTS = f"""with m as (select 2000 + i // 12 y, i % 12 + 1 m, ({list(_LENGTHS)})[i % 12 + 1] as days, i from (select unnest(range(1440)) i)),
    s as (select y, m, days, date '1943-04-14' + (sum(days) over (order by i) - days)::int as start from m)"""


@query("DT1_bs_to_ad", "orders", sql=f"""{_STARTS}, o as (select o_orderkey, 2040 + o_orderkey % 20 y, 1 + o_orderkey % 13 m, 1 + o_orderkey % 33 d from orders)
    select o_orderkey, (case when d <= days then start + (d - 1)::int end)::date ad from o left join s using (y, m)""")
def _(o):
    k = F.col("o_orderkey")
    text = F.concat_ws("/", (2040 + k % 20).cast("string"), (1 + k % 13).cast("string"), (1 + k % 33).cast("string"))
    starts = calendar.month_starts(_months(o.sparkSession), "1943-04-14")
    return calendar.bs_to_ad(o.select("o_orderkey", tx.devanagari_digits(text).alias("bs")), "bs", starts, "ad").drop("bs")


@query("DT1_ad_to_bs", "orders", sql=f"""{_STARTS} select o_orderkey, y || '-' || lpad(m::varchar, 2, '0') || '-' || lpad((o_orderdate::date - start::date + 1)::varchar, 2, '0') bs from orders left join s on o_orderdate::date >= start and o_orderdate::date < start + days::int""")
def _(o):
    starts = calendar.month_starts(_months(o.sparkSession), "1943-04-14")
    return calendar.ad_to_bs(o.select("o_orderkey", "o_orderdate"), "o_orderdate", starts, "bs").select("o_orderkey", "bs")


_RAW = "select c_custkey k, case when c_custkey % 9 = 0 then '  ' else 'special' end court, case when c_custkey % 2 = 0 then '080-cr-' || c_custkey else '080-CR-' || lpad(c_custkey::varchar, 4, '0') end num from customer"


@query("PIPE1_import_counters", "customer", sql="""select 'read' stage, count(*) n from customer union all select 'rejected', count(*) from customer where c_custkey % 9 = 0 union all select 'retyped', count(*) from customer where c_custkey % 4 = 0
    union all select 'header_status', count(*) from customer where c_custkey % 5 = 0 union all select 'unmapped', count(*) from customer where c_custkey % 5 = 1 union all select 'truncated', count(*) from customer where c_custkey % 3 = 0 union all select 'renumbered', count(*) from customer where c_custkey % 2 = 0""")
def _(c):
    k = F.col("c_custkey")
    two = k % 2 == 0
    raw = c.select(
        F.when(k % 9 == 0, "  ").otherwise("special").alias("court"), F.concat(F.when(two, "080-cr-").otherwise("080-CR-"), F.lpad(k.cast("string"), 8, "0")).alias("case_number"),
        F.when(k % 4 == 0, "भ्रष्टाचार ( घूस )").otherwise("घूस").alias("case_type"), F.when(k % 5 == 0, "मुद्दाको  किसिम").when(k % 5 == 1, "फैसला >> नयाँ").otherwise("चालु").alias("case_status"),
        F.when(k % 3 == 0, "राम समेत ५").otherwise("राम").alias("defendant"), F.array(F.lit("राम")).alias("defendants"),
    )
    return imports.counters(imports.imported(raw))


@query("PIPE3_recompute_changes", "orders", sql="""select o_orderkey, concat_ws(',', case when o_orderkey % 7 = 0 then 'case_status' end, case when o_orderkey % 7 in (4, 6) and o_orderstatus <> 'P' then 'verdict_date_bs' end, case when o_orderkey % 7 in (2, 3) or o_orderkey % 7 = 6 then 'verdict_type' end) changed
    from orders where o_orderkey % 7 in (0, 2, 3, 6) or o_orderkey % 7 = 4 and o_orderstatus <> 'P'""")
def _(o):
    k = F.col("o_orderkey")
    cases = o.select(
        "o_orderkey", F.expr(_STATUS.replace("varchar", "string")).alias("case_status"), F.lit("DISMISSED").alias("verdict_type"), F.when(F.col("o_orderstatus") == "P", "2070-01-01").alias("verdict_date_bs"),
        F.when(k % 7 == 6, "CONVICTED").alias("outcome"), F.when(k % 7 == 6, "2080-02-02").alias("outcome_date"),
    )
    keep = ["o_orderkey", "case_status", "verdict_type", "verdict_date_bs"]
    return upsert.changed_columns(cases.select(*keep), imports.recomputed(cases).select(*keep), ["o_orderkey"])


@query("PIPE4_stored_hearings", "orders", sql="""select o_orderkey::varchar case_number, '2080-01-' || lpad((1 + o_orderkey % 28)::varchar, 2, '0') hearing_date_bs from orders where o_orderkey % 3 <> 0
    union all select o_orderkey::varchar, '2081-05-06' from orders where o_orderkey % 4 <> 0""")
def _(o):
    k = F.col("o_orderkey").cast("string")
    day = F.concat(F.lit("2080-01-"), F.lpad((1 + F.col("o_orderkey") % 28).cast("string"), 2, "0"))
    listed = F.array(F.create_map(F.lit("hearing_date_bs"), F.concat(F.lit("2080/1/"), (1 + F.col("o_orderkey") % 28).cast("string"))), F.create_map(F.lit("date_bs"), F.lit("2081.5.6")), F.create_map(F.lit("when"), F.lit("2081-07-08")))
    cases = o.select(F.lit("x").alias("court"), k.alias("case_number"), F.to_json(listed).alias("hearings"))
    held = o.select(F.lit("x").alias("court"), k.alias("case_number"), F.explode(F.array_compact(F.array(F.when(F.col("o_orderkey") % 3 == 0, day), F.when(F.col("o_orderkey") % 4 == 0, F.lit("2081-05-06"))))).alias("hearing_date_bs"))
    return imports.stored_hearings(cases, held).select("case_number", "hearing_date_bs")


_TODAY = "date '1998-01-01'"


@query("PIPE6_sweep_order", "orders", sql="""select o_orderkey, case when o_orderkey % 3 = 0 then 0 else o_orderkey % 5 end misses, o_orderkey % 3 = 0 fresh from orders where o_orderkey % 3 = 0 or (o_orderkey % 5 < 3 and o_orderdate <= timestamp '1997-12-02')""")
def _(o):
    probes = o.where("o_orderkey % 3 <> 0").select("o_orderkey", (F.col("o_orderkey") % 5).alias("misses"), F.to_date("o_orderdate").alias("last_probed"))
    return imports.sweep_order(o.select("o_orderkey"), probes, ["o_orderkey"], F.expr(_TODAY), 30, 3)


@query("PIPE6_probed", "orders", sql="""select o_orderkey, (o_orderkey % 5 + case when o_orderkey % 2 = 0 then 1 else 0 end)::int misses, case when o_orderkey % 2 = 0 then date '1998-01-01' else o_orderdate::date end last_probed from orders where o_orderkey % 3 <> 0 and not (o_orderkey % 2 = 0 and o_orderkey % 7 = 0)
    union all select o_orderkey, 1, date '1998-01-01' from orders where o_orderkey % 3 = 0 and o_orderkey % 2 = 0 and o_orderkey % 7 <> 0""")
def _(o):
    probes = o.where("o_orderkey % 3 <> 0").select("o_orderkey", (F.col("o_orderkey") % 5).cast("int").alias("misses"), F.to_date("o_orderdate").alias("last_probed"))
    found = o.where("o_orderkey % 2 = 0").select("o_orderkey", (F.col("o_orderkey") % 7 == 0).alias("present"))
    return imports.probed(probes, found, ["o_orderkey"], F.expr(_TODAY))


# -- tags ------------------------------------------------------------------------------------------------------------------


@query("STR12_tag_key", "part", sql="select p_partkey, lower(p_type) || ' ' || p_brand[1:5].lower() as key from part")
def _(p):
    raw = F.concat(F.lit(' ("'), F.replace("p_type", F.lit(" "), F.lit("_")), F.lit("--  "), F.substring("p_brand", 1, 5), F.lit('.") '))
    return p.select("p_partkey", tags.tag_key(raw).alias("key"))


def _vocabulary(p):
    one = p.select(F.col("p_type").alias("id")).distinct()
    merged = F.when(F.col("id").startswith("ECONOMY"), "STANDARD TIN").when(F.col("id") == "STANDARD TIN", "LARGE TIN")
    known = one.unionByName(p.sparkSession.createDataFrame([("STANDARD TIN",), ("LARGE TIN",)], "id string")).distinct().select("id", merged.alias("merged_into"))
    aliases = one.where(~F.col("id").startswith("PROMO")).select(tags.tag_key("id").alias("key"), F.when(~F.col("id").startswith("SMALL"), F.col("id")).alias("tag"), F.when(F.col("id").startswith("SMALL"), "too small").alias("reason"))
    return known, aliases


@query("STR13_resolve_tags", "part", sql="""select p_partkey, case when p_type like 'PROMO%' then 'unknown' when p_type like 'SMALL%' then 'retired' else 'canonical' end resolution, case when p_type like 'PROMO%' or p_type like 'SMALL%' then null when p_type like 'ECONOMY%' or p_type = 'STANDARD TIN' then 'LARGE TIN' else p_type end tag,
    case when p_type like 'SMALL%' then 'too small' end reason from part""")
def _(p):
    known, aliases = _vocabulary(p)
    raw = p.select("p_partkey", F.concat(F.lower("p_type"), F.lit(".")).alias("raw"))
    return tags.resolved(raw, "raw", aliases, known).select("p_partkey", "resolution", "tag", "reason")


@query("STR13_broader", "nation", sql="""with recursive t as (select n_nationkey id, n_nationkey ancestor, 0 d from nation union all select id, ancestor // 3, d + 1 from t where ancestor > 0 and d < 6) select distinct id, ancestor from t""")
def _(na):
    return tags.with_broader(na.select(F.col("n_nationkey").cast("long").alias("id"), F.when(F.col("n_nationkey") > 0, F.expr("cast(n_nationkey div 3 as bigint)")).alias("broader")))


@query(
    "STR25_keyword_tags",
    "part",
    sql="""
    select p_partkey, array_to_string(list_concat(
      list_filter([case when contains(p_name, 'blue') then 'blue' end, case when contains(p_name, 'bolt') then 'metal' end], lambda x: x is not null)[:1],
      list_filter([case when contains(p_type, 'PROMO') then 'offer' end], lambda x: x is not null)), ',') tags from part""",
)
def _(p):
    rules = [("blue", "name", ["BLUE"]), ("offer", "type", ["tin"]), ("metal", "name", ["bolt"])]
    name = F.concat_ws("|", "p_name", F.when(F.contains("p_type", F.lit("PROMO")), "tin"))
    return p.select("p_partkey", F.array_join(tags.keyword_tags(name, rules, 1), ",").alias("tags"))


# -- search ----------------------------------------------------------------------------------------------------------------

_KIND = "case p_partkey % 5 when 0 then 'case' when 1 then 'entity' when 2 then 'courtcase' when 3 then 'material' end"
_FACTOR = "case p_partkey % 5 when 0 then 2.0 when 1 then 1.2 when 2 then 1.0 when 3 then 0.9 else 1.0 end"


def _docs(p):
    return p.select("p_partkey", F.expr(_KIND).alias("type"), F.col("p_name").alias("title_en"), F.col("p_brand").alias("title_ne"), F.col("p_type").alias("keywords"), F.concat_ws(" ", "p_name", "p_type").alias("body"))


@query(
    "SRCH2_language",
    "part",
    sql=f"""select p_partkey, round(7.0 * {_FACTOR}, 6)::double score from part where list_contains(string_split(p_name, ' '), 'red')""",
)
def _(p):
    return search.search(_docs(p), "Red", "en").select("p_partkey", F.round("score", 6).alias("score"))


@query(
    "SRCH3_phrase",
    "part",
    sql=f"""
    with s as (select *, string_split(p_name, ' ') w, lower(p_type) k from part),
    t as (select *, list_contains(w, 'red')::int a, list_contains(w, 'plate')::int b, (k = 'red')::int u, (k = 'plate')::int v, contains(' ' || p_name || ' ', ' red plate ')::int ph from s)
    select p_partkey, round((3.0 * (a + b) + 2.0 * (u + v) + greatest(a, u) + greatest(b, v) + 5.0 * ph) * {_FACTOR}, 6)::double score from t where a + b + u + v > 0""",
)
def _(p):
    return search.search(_docs(p), "red plate").select("p_partkey", F.round("score", 6).alias("score"))


@query("SRCH4_type_boost", "part", sql=f"select type, round(max(score), 6) score from (select {_KIND} as type, {_FACTOR}::double score from part) group by 1")
def _(p):
    return search.search(_docs(p), " ").groupBy("type").agg(F.round(F.max("score"), 6).alias("score"))


@query("SRCH8_browse", "part", sql="select count(*) n from part")
def _(p):
    return search.search(_docs(p), "  ").agg(n())


@query("SRCH9_highlight", "part", sql="select p_partkey, regexp_replace(p_name, '(?i)(red|plate)', '<em>\\1</em>', 'g') snippet from part")
def _(p):
    return p.select("p_partkey", search.highlighted("p_name", ["red", "plate"]).alias("snippet"))


@query("SRCH10_envelope", "part", sql="select p_partkey iri, p_name title, 'title_en,body' matched from part where list_contains(string_split(p_name, ' '), 'red')")
def _(p):
    docs = _docs(p).withColumnRenamed("p_partkey", "iri")
    out = search.envelope(search.search(docs, "red", "en"), ["red"], "en")
    return out.select("iri", "hit.title", F.array_join("hit.matched", ",").alias("matched"))


@query(
    "SRCH13_fallback",
    "part",
    sql="""
    select p_partkey, (case when list_contains(string_split(p_name, ' '), 'old') then 10.0 when contains(p_name, 'old') then 3.0 else 0.0 end + case when p_type = 'OLD' then 5.0 when contains(lower(p_type), 'old') then 2.0 else 0.0 end
      + case when contains(p_name, 'old') then 1.0 else 0.0 end)::double score from part""",
)
def _(p):
    return p.select("p_partkey", search.fallback_relevance(F.array("p_name"), F.array("p_type"), F.array("p_name"), "Old").alias("score"))


@query("SRCH14_analyzed", "part", sql="select p_partkey, array_to_string(list_filter(string_split(p_name || ' 12 elan', ' '), lambda t: t <> 'red'), ',') tokens from part")
def _(p):
    text = F.concat("p_name", F.lit("‍, १2 Élan!"))
    return p.select("p_partkey", F.array_join(search.analyzed(text, ["red"]), ",").alias("tokens"))


# -- paging, writes, resolution ---------------------------------------------------------------------------------------------


@query("SRC4_keyset_scan", "lineitem", sql="select l_orderkey, l_linenumber from lineitem where (l_orderkey, l_linenumber) > (100, 2) order by l_orderkey, l_linenumber limit 500")
def _(li):
    return search.keyset(li.select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"], [100, 2], 500)


@query("SRT4_newest_first", "orders", sql="select o_orderkey from orders where o_totalprice < 150000 or (o_totalprice = 150000 and o_orderkey > 7) order by o_totalprice desc, o_orderkey limit 500")
def _(o):
    return search.newest_first(o, "o_totalprice", "o_orderkey", search.encode_cursor([150000, 7]), 9000).select("o_orderkey")


@query("SNK6_replace_children", "lineitem", "orders", sql="""select l_orderkey, count(*) n, sum(l_linenumber)::bigint total from (select l_orderkey, l_linenumber from lineitem where l_orderkey % 3 <> 0 union all select l_orderkey, 10 from lineitem where l_orderkey % 6 = 0 and l_linenumber = 1) group by 1""")
def _(li, o):
    stored = li.select("l_orderkey", "l_linenumber")
    new = li.where("l_orderkey % 6 = 0 and l_linenumber = 1 or l_orderkey % 5 = 7").select("l_orderkey", F.lit(10).cast(stored.schema["l_linenumber"].dataType).alias("l_linenumber"))
    documents = o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("l_orderkey"))
    return upsert.replace_children(stored, new, documents, "l_orderkey").groupBy("l_orderkey").agg(n(), F.sum("l_linenumber").alias("total"))


@query("SNK11_requests", "part", sql="select count(*) n, sum(length(p_name))::bigint bytes, true fits from part")
def _(p):
    numbered = upsert.request_numbers(p.select("p_partkey", "p_name"), F.octet_length("p_name"), 500, F.pmod("p_partkey", F.lit(4)), ["p_partkey"])
    sums = numbered.groupBy("shard", "request").agg(n(), F.sum(F.octet_length("p_name")).alias("bytes"))
    return sums.agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.bool_and(F.col("bytes") <= 500).alias("fits"))


@query("SNK14_attach", "part", sql="select p_partkey, case when p_partkey % 2 = 0 then 'RAW:' || p_brand || ':new' else 'RAW:' || p_brand || ':old,TEXT:' || p_brand || ':new' end media from part")
def _(p):
    held = F.array(F.struct(F.lit("RAW").alias("role"), F.col("p_brand").alias("sha256"), F.lit("old").alias("url")))
    role = F.when(F.col("p_partkey") % 2 == 0, "RAW").otherwise("TEXT")
    made = upsert.attached(held, role, F.col("p_brand"), F.lit("new"))
    return p.select("p_partkey", F.array_join(F.transform(made, lambda m: F.concat_ws(":", m["role"], m["sha256"], m["url"])), ",").alias("media"))


@query("ENT3_promote_held", "pages", sql="""with h as (select split_part(url, '/', 4) lang, array_to_string(string_split(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '.')[-2:], '.') host from pages)
    select lang, count(distinct host) publishers, count(distinct host) >= 3 promoted from h group by 1 union all select 'none', 0, false""")
def _(p):
    named = p.withColumn("lang", F.split("url", "/")[3])
    held = named.select("lang").distinct().unionByName(p.sparkSession.createDataFrame([("none",)], "lang string"))
    return upsert.promoted_held(held, named, "lang", web.registrable_domain(web.host("url")), 3)


@query("ENT5_last_word_score", "customer", "supplier", sql="select s_suppkey, c_custkey, round(1 - levenshtein(lower(c_name), lower(s_name))::double / greatest(length(c_name), length(s_name)), 6) score from supplier join customer on right(c_name, 9) = right(s_name, 9)")
def _(c, s):
    spaced = lambda x: F.regexp_replace(x, "#", " #")
    pairs = s.withColumn("s", spaced("s_name")).join(c.withColumn("c", spaced("c_name")), F.right("c_name", F.lit(9)) == F.right("s_name", F.lit(9)))
    longest = F.greatest(F.length("c"), F.length("s"))
    edits = (1 - resolve.name_score("c", "s")) * longest
    return pairs.select("s_suppkey", "c_custkey", F.round(1 - edits / F.greatest(F.length("c_name"), F.length("s_name")), 6).alias("score"))
