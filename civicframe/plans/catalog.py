"""Queries over the star schema: each applies an operator to whole tables, with the SQL that it has to equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civicframe.functions import domain as dom
from civicframe.functions import text as tx
from civicframe.functions import web
from civicframe.operators import graph, references, resolve, search, upsert
from civicframe.plans import gate
from civicframe.sources.readers import table
from civicframe.streaming import events as ev

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, *tables: str, sql: str | None = None) -> Callable:
    """Registers a function of frames, named by ``tables``."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[name] = lambda spark, sf: f(*(table(spark, sf, t) for t in tables))
        if sql:
            ORACLES[name] = sql
        return f

    return add


def n(name: str = "n") -> Column:
    return F.count("*").alias(name)


def money(x: str | Column, name: str) -> Column:
    return F.round(x, 2).alias(name)


# -- aggregation ---------------------------------------------------------------------------------------------------------


@query("AGG1_conditional_counts", "orders", sql="""select count(*) n, count(*) filter (where o_orderstatus = 'F') n_f, count(*) filter (where o_orderstatus = 'O') n_o,
    count(*) filter (where o_orderstatus = 'P') n_p, round(coalesce(sum(o_totalprice) filter (where o_orderstatus = 'F'), 0), 2) sum_f, round(coalesce(sum(o_totalprice) filter (where o_orderstatus = '?'), 0), 2) sum_none from orders""")
def _(o):
    s = F.col("o_orderstatus")
    return o.agg(n(), *(F.count_if(s == x).alias(f"n_{x.lower()}") for x in "FOP"), *(money(F.coalesce(F.sum(F.when(s == v, F.col("o_totalprice"))), F.lit(0.0)), k) for k, v in (("sum_f", "F"), ("sum_none", "?"))))


@query("AGG2_distinct_over_join", "orders", "customer", "nation", sql="select n_name, count(distinct o_custkey) customers from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1")
def _(o, c, na):
    return o.join(c, o.o_custkey == c.c_custkey).join(na, c.c_nationkey == na.n_nationkey).groupBy("n_name").agg(F.countDistinct("o_custkey").alias("customers"))


@query("AGG3_group_desc", "part", sql="select p_brand, count(*) n from part group by 1 order by n desc, p_brand")
def _(p):
    return p.groupBy("p_brand").agg(n()).orderBy(F.desc("n"), "p_brand")


@query("AGG4_two_keys", "part", sql="select p_brand, p_type, count(*) n from part group by 1, 2 order by n desc, p_brand, p_type")
def _(p):
    return p.groupBy("p_brand", "p_type").agg(n()).orderBy(F.desc("n"), "p_brand", "p_type")


@query("AGG5_json_key", "events", sql="select trim(json_extract_string(props, '$.k')) k, count(*) n from events where trim(json_extract_string(props, '$.k')) <> '' group by 1")
def _(e):
    return e.select(F.trim(F.get_json_object("props", "$.k")).alias("k")).where("k <> ''").groupBy("k").agg(n())


_YEARS = "select year from (select distinct substr(strftime(o_orderdate, '%Y-%m-%d'), 1, 4)::int as year from orders) order by year desc limit 25"


def _years(o):
    """Orders with a year, parsed as the text dates are; the last 25 years are kept, by an aggregate and a semi-join."""
    y = o.withColumn("year", tx.bs_year(tx.devanagari_digits(F.date_format("o_orderdate", "yyyy-MM-dd")))).where("year is not null")
    return y.join(F.broadcast(y.select("year").distinct().orderBy(F.desc("year")).limit(25)), "year", "left_semi")


@query("AGG6_year_histogram", "orders", sql=f"select year(o_orderdate)::int as year, count(*) n from orders where year(o_orderdate) in ({_YEARS}) group by 1")
def _(o):
    return _years(o).groupBy("year").agg(n())


@query("AGG7_matrix", "orders", sql=f"select year(o_orderdate)::int as year, o_orderpriority, count(*) n from orders where year(o_orderdate) in ({_YEARS}) group by 1, 2")
def _(o):
    return _years(o).groupBy("year", "o_orderpriority").agg(n())


@query("AGG8_percentages", "lineitem", sql="select l_returnflag, case when count(*) = 0 then 0.0 else round(100.0 * (count(*) filter (where l_linestatus = 'F'))::double / count(*), 1) end pct from lineitem group by 1")
def _(li):
    return li.groupBy("l_returnflag").agg(dom.percent(F.count_if(F.col("l_linestatus") == "F"), F.count("*")).alias("pct"))


@query("AGG9_json_presence", "events", sql="""with v as (select case json_extract_string(props, '$.k')::int % 3 when 0 then '{}' when 1 then '{"k":null}' else props end p from events)
    select case when json_type(p, '$.k') is null then 'absent' when json_type(p, '$.k') = 'NULL' then 'null' else 'present' end state, count(*) n from v group by 1""")
def _(e):
    k = F.get_json_object("props", "$.k").cast("int") % 3
    v = F.parse_json(F.when(k == 0, "{}").when(k == 1, '{"k":null}').otherwise(F.col("props")))
    field = F.variant_get(v, "$.k", "variant")
    return e.select(F.when(field.isNull(), "absent").when(F.is_variant_null(field), "null").otherwise("present").alias("state")).groupBy("state").agg(n())


@query("AGG10_first_resolvable", "part", sql="""select coalesce(list_filter(string_split(p_name, ' '), lambda w: w[1] in ('b', 'g'))[1], 'none') sector, count(*) n from part group by 1""")
def _(p):
    hit = F.filter(F.split("p_name", " "), lambda w: F.substring(w, 1, 1).isin("b", "g"))
    return p.groupBy(F.coalesce(F.try_element_at(hit, F.lit(1)), F.lit("none")).alias("sector")).agg(n())


@query("AGG11_distinct_per_entity", "lineitem", sql="select l_suppkey, count(distinct l_orderkey) cases from lineitem group by 1")
def _(li):
    return li.groupBy("l_suppkey").agg(F.countDistinct("l_orderkey").alias("cases"))


_LATEST = "select user_id, event_type, arg_max(event_id, row(ts, event_id)) event_id, round(arg_max(value, row(ts, event_id)), 2) as value from events"


@query("AGG12_latest_per_group", "events", sql=f"{_LATEST} group by 1, 2")
def _(e):
    return upsert.latest(e.select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", money("value", "value"))


@query("AGG13_ledger", "events", sql=f"{_LATEST} where event_type <> 'click' group by 1, 2")
def _(e):
    return upsert.latest(e.where("event_type <> 'click'").select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", money("value", "value"))


@query("AGG14_stage_summary", "events", sql="select event_type, dayofweek(ts)::int as stage, count(*) n from events group by 1, 2")
def _(e):
    return e.groupBy("event_type", (F.dayofweek("ts") - 1).alias("stage")).agg(n())


@query("AGG15_weighted_rollup", "lineitem", sql="""select coalesce(l_returnflag, 'all') category, round(least(greatest(100 * sum(l_discount * l_quantity) / sum(l_quantity), 0), 100), 4) score, count(*) n from lineitem group by rollup (l_returnflag)""")
def _(li):
    score = dom.clamp(100 * F.sum(F.col("l_discount") * F.col("l_quantity")) / F.sum("l_quantity"))
    return li.rollup("l_returnflag").agg(F.round(score, 4).alias("score"), n()).select(F.coalesce("l_returnflag", F.lit("all")).alias("category"), "score", "n")


@query("AGG16_disposition", "lineitem", sql="""select l_orderkey, case when not bool_and(l_discount <= 0.09) then 'REJECT' when avg(l_quantity) >= 30 then 'PASS' when avg(l_quantity) >= 20 then 'REVISE' else 'REJECT' end disposition from lineitem group by 1""")
def _(li):
    return li.groupBy("l_orderkey").agg(dom.review_disposition(F.bool_and(F.col("l_discount") <= 0.09), F.avg("l_quantity"), 30, 20).alias("disposition"))


@query("AGG17_usage_totals", "lineitem", sql="select l_returnflag, l_linestatus, count(*) calls, round(sum(l_quantity), 2) tokens from lineitem group by grouping sets ((l_returnflag, l_linestatus), ())")
def _(li):
    return li.groupingSets([[F.col("l_returnflag"), F.col("l_linestatus")], []], "l_returnflag", "l_linestatus").agg(n("calls"), money(F.sum("l_quantity"), "tokens"))


_ENVELOPE = """select 'customer' as type, c_custkey id, c_name title from customer union all select 'supplier', s_suppkey, s_name from supplier union all select 'part', p_partkey, p_name from part"""


def _envelope(c, s, p):
    parts = ((c, "customer", "c_custkey", "c_name"), (s, "supplier", "s_suppkey", "s_name"), (p, "part", "p_partkey", "p_name"))
    frames = [df.select(F.lit(kind).alias("type"), F.col(k).alias("id"), F.col(t).alias("title")) for df, kind, k, t in parts]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query("AGG18_type_counts", "customer", "supplier", "part", sql=f"select type, count(*) n from ({_ENVELOPE}) group by 1")
def _(c, s, p):
    return _envelope(c, s, p).groupBy("type").agg(n())


@query("AGG19_self_excluding_facets", "part", sql="""with f as (select * from part where p_size <= 10), b as (select * from part where p_brand = 'Brand#1'), fb as (select * from part where p_size <= 10 and p_brand = 'Brand#1')
    select 'p_brand' facet, p_brand as value, count(*) n from f group by 2 union all select 'p_size', p_size::varchar, count(*) from b group by 2 union all select 'p_type', p_type, count(*) from fb group by 2""")
def _(p):
    return search.facets(p, {"p_brand": F.col("p_brand") == "Brand#1", "p_size": F.col("p_size") <= 10}, ["p_brand", "p_size", "p_type"])


@query(
    "AGG20_pinned_facet",
    "part",
    sql="""with c as (select p_type as value, count(*) n from part group by 1), t as (select * from c order by n desc, value limit 3)
    select * from t union select * from c where value in ('SMALL', 'PROMO', 'ECONOMY', 'STANDARD', 'none')""",
)
def _(p):
    return search.pinned(p.groupBy(F.col("p_type").alias("value")).agg(n()), 3, ["SMALL", "PROMO", "ECONOMY", "STANDARD", "none"])


@query("AGG21_global_extent", "orders", sql="select round(min(o_totalprice), 2) low, round(max(o_totalprice), 2) high, count(*) n from orders")
def _(o):
    return o.agg(money(F.min("o_totalprice"), "low"), money(F.max("o_totalprice"), "high"), n())


@query("AGG22_corpus_lastmod", "orders", "events", sql="select 'orders' as type, count(*) n, max(o_orderdate) lastmod from orders union all select 'events', count(*), max(ts) from events")
def _(o, e):
    return o.agg(F.lit("orders").alias("type"), n(), F.max("o_orderdate").alias("lastmod")).unionByName(e.agg(F.lit("events").alias("type"), n(), F.max("ts").alias("lastmod")))


@query("AGG23_density", "lineitem", sql="select count(distinct l_orderkey) held, max(l_orderkey) high, round(100.0 * count(distinct l_orderkey)::double / max(l_orderkey), 1) density from lineitem")
def _(li):
    held = li.agg(F.countDistinct("l_orderkey").alias("held"), F.max("l_orderkey").alias("high"))
    return held.withColumn("density", dom.percent(F.col("held"), F.col("high")))


@query(
    "AGG23_register_report",
    "orders",
    sql="""
    with h as (select o_orderpriority r, o_orderkey s, o_orderdate d from orders where o_orderkey >= 1),
    n as (select *, lag(d) over (partition by r order by s, d) p from h),
    t as (select o_custkey % 5 k, o_orderkey s from orders where o_orderstatus = 'F'),
    b as (select substr(r, 1, 1)::int - 1 k, r from (select distinct r from h)),
    q as (select b.r, count(distinct t.s) probed, count(distinct h.s) hits from t join b using (k) left join h on h.r = b.r and h.s = t.s group by 1)
    select n.r, count(distinct s) held, max(s) high, round(100.0 * count(distinct s)::double / max(s), 1) density, any_value(probed) probed, any_value(hits) hits,
      round(100.0 * any_value(hits)::double / any_value(probed), 1) hit_rate, count(p) pairs, count(*) filter (where d >= p) ordered, round(100.0 * count(*) filter (where d >= p)::double / count(p), 1) confidence
    from n join q on q.r = n.r group by 1""",
)
def _(o):
    held = o.select(F.col("o_orderpriority").alias("r"), F.col("o_orderkey").alias("s"), F.col("o_orderdate").alias("d"))
    named = held.groupBy((F.substring("r", 1, 1).cast("int") - 1).alias("k"), "r").agg(n()).drop("n")
    probes = o.where("o_orderstatus = 'F'").select((F.col("o_custkey") % 5).cast("int").alias("k"), F.col("o_orderkey").alias("s")).join(F.broadcast(named), "k").select("r", "s")  # five registers
    return graph.register_report(held, probes, ["r"], "s", "d")


@query("AGG24_modal_pad", "part", sql="with c as (select p_brand, length(p_name) pad, count(*) n from part group by 1, 2) select p_brand, arg_max(pad, row(n, pad))::bigint pad from c group by 1")
def _(p):
    c = p.groupBy("p_brand", F.length("p_name").cast("long").alias("pad")).agg(n())
    return c.groupBy("p_brand").agg(F.max_by("pad", F.struct("n", "pad")).alias("pad"))


@query("AGG25_conflicts", "events", sql="select user_id, ts::date as day, count(distinct event_type) kinds from events where event_type in ('purchase', 'error') group by 1, 2 having count(distinct event_type) > 1")
def _(e):
    return e.where(F.col("event_type").isin("purchase", "error")).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.countDistinct("event_type").alias("kinds")).where("kinds > 1")


@query("AGG26_reference_counts", "lineitem", "orders", sql="select 'lineitem' store, count(*) n from lineitem where l_suppkey = 1 union all select 'orders', count(*) from orders where o_custkey = 1")
def _(li, o):
    return li.where("l_suppkey = 1").agg(F.lit("lineitem").alias("store"), n()).unionByName(o.where("o_custkey = 1").agg(F.lit("orders").alias("store"), n()))


@query("AGG27_gate_aggregates", "lineitem", sql="select l_linestatus, count(*) n, round(sum(l_quantity), 2) s, round(avg(l_quantity), 4) a, min(l_shipdate) lo, max(l_shipdate) hi, bool_and(l_quantity > 0) all_pos, bool_or(l_discount > 0.09) any_high from lineitem group by 1")
def _(li):
    return li.groupBy("l_linestatus").agg(n(), money(F.sum("l_quantity"), "s"), F.round(F.avg("l_quantity"), 4).alias("a"), F.min("l_shipdate").alias("lo"), F.max("l_shipdate").alias("hi"), F.bool_and(F.col("l_quantity") > 0).alias("all_pos"), F.bool_or(F.col("l_discount") > 0.09).alias("any_high"))


@query("AGG29_confidence", "lineitem", sql="select l_orderkey, case when count(*) < 2 then 'single' when round(stddev_pop(l_quantity), 6) <= 5 then 'high' when round(stddev_pop(l_quantity), 6) <= 12 then 'medium' else 'low' end label from lineitem group by 1")
def _(li):
    return li.groupBy("l_orderkey").agg(dom.confidence(F.round(F.stddev_pop("l_quantity"), 6), F.count("*")).alias("label"))


# -- joins ---------------------------------------------------------------------------------------------------------------


@query("J1_left_lookup", "customer", "nation", sql="select c_custkey, n_name from customer left join nation on c_nationkey = n_nationkey and n_nationkey < 20")
def _(c, na):
    small = na.where("n_nationkey < 20")
    return c.join(small, c.c_nationkey == small.n_nationkey, "left").select("c_custkey", "n_name")


@query("J2_semi_live", "lineitem", "orders", sql="select l_orderkey, l_linenumber, l_partkey from lineitem where exists (select 1 from orders where o_orderkey = l_orderkey and o_orderstatus = 'F')")
def _(li, o):
    live = o.where("o_orderstatus = 'F'")
    return li.join(live, li.l_orderkey == live.o_orderkey, "left_semi").select("l_orderkey", "l_linenumber", "l_partkey")


@query("J3_anti", "orders", "lineitem", sql="select o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)")
def _(o, li):
    return o.join(li, o.o_orderkey == li.l_orderkey, "left_anti").select("o_orderkey")


@query("J4_existence_first", "customer", "orders", sql="select c_custkey, exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P') flagged from customer order by flagged desc, c_custkey")
def _(c, o):
    keys = o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("hit")).distinct()
    return c.join(keys, "c_custkey", "left").select("c_custkey", F.col("hit").isNotNull().alias("flagged")).orderBy(F.desc("flagged"), "c_custkey")


@query("J5_many_to_many", "part", "lineitem", sql="select distinct p_partkey, p_name from part join lineitem on l_partkey = p_partkey where l_quantity > 49")
def _(p, li):
    return p.join(li.where("l_quantity > 49"), p.p_partkey == li.l_partkey, "left_semi").select("p_partkey", "p_name")


@query("J6_disjunctive_match", "events", "customer", sql="""with m as (select distinct event_id, c_custkey from (select event_id, c_custkey from events join customer on user_id = c_custkey
      union all select event_id, c_custkey from events join customer on c_nationkey = user_id % 25 and c_acctbal > 9900)), k as (select *, count(*) over (partition by event_id) n from m)
    select event_id, c_custkey, 1::double / n confidence from k where n <= 5""")
def _(e, c):
    rich = F.when(F.col("c_acctbal") > 9900, F.col("c_nationkey"))
    return graph.disjunctive_match(e, c, [("user", F.col("user_id")), ("nation", F.col("user_id") % 25)], [("user", F.col("c_custkey")), ("nation", rich)], "event_id", "c_custkey", 5)


@query("J7_stub_on_miss", "orders", "customer", sql="select o_orderkey, coalesce(c_name, 'unknown:' || o_custkey) name from orders left join customer on c_custkey = o_custkey and c_mktsegment <> 'BUILDING'")
def _(o, c):
    known = c.where("c_mktsegment <> 'BUILDING'")
    return o.join(known, o.o_custkey == known.c_custkey, "left").select("o_orderkey", F.coalesce("c_name", F.concat(F.lit("unknown:"), F.col("o_custkey"))).alias("name"))


@query("J8_derived_fallback", "lineitem", "part", sql="select l_orderkey, l_linenumber, coalesce(p_retailprice, l_extendedprice / l_quantity) price from lineitem left join part on p_partkey = l_partkey and p_size > 25")
def _(li, p):
    big = p.where("p_size > 25")
    return li.join(big, li.l_partkey == big.p_partkey, "left").select("l_orderkey", "l_linenumber", F.coalesce(F.col("p_retailprice"), F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))


@query("J9_catalogue_nest", "nation", "customer", "supplier", "region", sql="""select n_name, r_name, c.n customers, s.n suppliers, c.segments from nation join region on n_regionkey = r_regionkey
    left join (select c_nationkey, count(*) n, string_agg(distinct c_mktsegment, ',' order by c_mktsegment) segments from customer group by 1) c on c_nationkey = n_nationkey
    left join (select s_nationkey, count(*) n from supplier where s_acctbal > 5000 group by 1) s on s_nationkey = n_nationkey""")
def _(na, c, s, r):
    cs = c.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(n("customers"), F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ",").alias("segments"))
    ss = s.where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(n("suppliers"))
    return na.join(r, na.n_regionkey == r.r_regionkey).join(cs, "n_nationkey", "left").join(ss, "n_nationkey", "left").select("n_name", "r_name", "customers", "suppliers", "segments")


@query("J10_parsed_key", "customer", "orders", sql="select c_name, count(*) n from orders join customer on c_name = 'Customer#' || lpad(o_custkey::varchar, 9, '0') group by 1")
def _(c, o):
    key = F.concat(F.lit("Customer#"), tx.padded(F.col("o_custkey").cast("string"), 9)).alias("c_name")
    return o.select(key).join(c, "c_name").groupBy("c_name").agg(n())


@query(
    "J12_embedded_references",
    "orders",
    "customer",
    sql="""
    with poor as (select c_custkey from customer where c_acctbal < 0),
    refs as (select o_orderkey, 'customer/' || o_custkey iri from orders where o_custkey in (select * from poor)
      union select o_orderkey, 'priority/' || o_orderpriority from orders where o_orderpriority = '1-URGENT' and o_orderstatus = 'F')
    select iri, count(*) n from refs group by 1""",
)
def _(o, c):
    node = lambda kind, of: F.struct(F.concat(F.lit(f"{kind}/"), F.col(of).cast("string")).alias("@id"))
    steps = F.array(F.struct(F.lit("filed").alias("stage"), F.array(node("customer", "o_custkey")).alias("by")), F.struct(F.lit("heard").alias("stage"), F.array(node("priority", "o_orderpriority")).alias("by")))
    decided = F.when(F.col("o_orderstatus") == "F", F.slice(steps, 1, 2)).otherwise(F.slice(steps, 1, 1))
    own = F.concat(F.lit("order/"), F.col("o_orderkey").cast("string"))
    body = F.to_json(F.struct(own.alias("@id"), F.struct(decided.alias("steps")).alias("history")))
    poor = c.where("c_acctbal < 0").select(F.concat(F.lit("customer/"), F.col("c_custkey").cast("string")).alias("iri"))
    urgent = o.where("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("priority/"), F.col("o_orderpriority")).alias("iri")).distinct()
    return references.referring(o.select("o_orderkey", body.alias("body")), "o_orderkey", "body", poor.unionByName(urgent)).groupBy("iri").agg(n())


@query("J13_visibility_recompute", "customer", "orders", sql="select c_custkey, case max(case o_orderstatus when 'F' then 2 when 'P' then 1 else 0 end) when 2 then 'LISTED' when 1 then 'UNLISTED' else 'PRIVATE' end visibility from customer left join orders on o_custkey = c_custkey group by 1")
def _(c, o):
    rank = dom.visibility_rank("o_orderstatus", ("F",), ("P",))
    ranks = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(rank).alias("rank"))
    return c.join(ranks, "c_custkey", "left").select("c_custkey", dom.visibility(F.col("rank")).alias("visibility"))


@query("J14_click_through", "events", sql="""with s as (select user_id, ts::date d, count(*) shown from events where event_type = 'view' group by 1, 2), k as (select user_id, ts::date d, count(*) clicks from events where event_type = 'click' group by 1, 2)
    select d as day, sum(shown)::bigint shown, sum(coalesce(clicks, 0))::bigint clicks, round(sum(coalesce(clicks, 0))::double / sum(shown), 4) ctr from s left join k using (user_id, d) group by 1""")
def _(e):
    day = F.to_date("ts").alias("day")
    count = lambda kind, name: e.where(F.col("event_type") == kind).groupBy("user_id", day).agg(n(name))
    both = count("view", "shown").join(count("click", "clicks"), ["user_id", "day"], "left").na.fill(0, ["clicks"])
    return both.groupBy("day").agg(F.sum("shown").alias("shown"), F.sum("clicks").alias("clicks")).withColumn("ctr", F.round(F.col("clicks") / F.col("shown"), 4))


@query("J15_geography", "lineitem", "supplier", "orders", "customer", sql="""select r_key, count(distinct l_suppkey) suppliers from (select l_suppkey, c_nationkey r_key from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey
    union select s_suppkey, s_nationkey from supplier) group by 1""")
def _(li, s, o, c):
    via = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).select("l_suppkey", F.col("c_nationkey").alias("r_key"))
    own = s.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("r_key"))
    return via.unionByName(own).groupBy("r_key").agg(F.countDistinct("l_suppkey").alias("suppliers"))


_GATED = "select c_mktsegment, count(*) n from gated_orders left join gated_customers on gated_orders.o_custkey = gated_customers.c_custkey where o_orderpriority like '1%' group by c_mktsegment"


@query("J16_gated_join", "orders", "customer", sql="select c_mktsegment, count(*) n from orders left join customer on orders.o_custkey = customer.c_custkey where o_orderpriority like '1%' group by 1")
def _(o, c):
    return gate.run(o.sparkSession, _GATED, {"gated_orders": o, "gated_customers": c})


@query("J17_gaps", "lineitem", sql="select g.v missing from (select unnest(range(1, (select max(l_orderkey) from lineitem) + 1)) v) g where not exists (select 1 from lineitem where l_orderkey = v)")
def _(li):
    one = li.select(F.lit(1).alias("register"), "l_orderkey").groupBy("l_orderkey").agg(F.first("register").alias("register"))
    return graph.gaps(one.withColumn("register", F.expr("l_orderkey div 1000000000")), ["register"], "l_orderkey").select(F.col("l_orderkey").alias("missing"))


# -- windows, sorts, sets ------------------------------------------------------------------------------------------------


@query("WIN1_rank", "customer", sql="select c_custkey, row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) rn, rank() over (partition by c_nationkey order by c_mktsegment) rk, dense_rank() over (partition by c_nationkey order by c_mktsegment) dr from customer")
def _(c):
    w = Window.partitionBy("c_nationkey")
    by = w.orderBy("c_mktsegment")
    return c.select("c_custkey", F.row_number().over(w.orderBy(F.desc("c_acctbal"), "c_custkey")).cast("long").alias("rn"), F.rank().over(by).cast("long").alias("rk"), F.dense_rank().over(by).cast("long").alias("dr"))


@query("WIN2_topn_total", "customer", sql="select c_nationkey, c_custkey, place, total from (select *, row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) place, count(*) over (partition by c_nationkey) total from customer) where place <= 3")
def _(c):
    return upsert.top_n(c, ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")], 3).select("c_nationkey", "c_custkey", F.col("place").cast("long").alias("place"), "total")


@query("WIN3_first_occurrence", "events", sql="select user_id, event_type, arg_min(event_id, row(ts, event_id)) event_id from events group by 1, 2")
def _(e):
    return upsert.first_occurrence(e.select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("WIN4_monotone_pairs", "orders", sql="select o_custkey, count(p) pairs, count(*) filter (where o_orderdate >= p) ordered from (select *, lag(o_orderdate) over (partition by o_custkey order by o_orderkey) p from orders) group by 1")
def _(o):
    return graph.ordered_pairs(o, ["o_custkey"], "o_orderkey", "o_orderdate")


@query(
    "WIN5_rival_exclusion",
    "lineitem",
    sql="""
    with p as (select l_orderkey docket, l_partkey % 4 a, l_suppkey % 4 b, max(l_extendedprice) score from lineitem group by all)
    select docket, a, b, score from p where not exists (
      select 1 from p q where q.docket = p.docket and (q.a = p.a or q.b = p.b) and (q.a, q.b) <> (p.a, p.b) and q.score >= p.score - 5000)""",
)
def _(li):
    pairs = li.groupBy(F.col("l_orderkey").alias("docket"), (F.col("l_partkey") % 4).alias("a"), (F.col("l_suppkey") % 4).alias("b")).agg(F.max("l_extendedprice").alias("score"))
    return resolve.unrivalled(pairs, 5000)


@query("WIN6_latest_disposing", "events", sql="select user_id, arg_max(event_type, row(ts, event_id)) last_disposing from events where event_type in ('purchase', 'error') group by 1")
def _(e):
    return e.where(F.col("event_type").isin("purchase", "error")).groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_disposing"))


@query("WIN7_ordinals", "lineitem", sql="select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by l_shipdate, l_linenumber) ordinal from lineitem")
def _(li):
    from civicframe.sources.readers import ordinals

    return ordinals(li, "l_orderkey", ["l_shipdate", "l_linenumber"]).select("l_orderkey", "l_linenumber", F.col("ordinal").cast("long").alias("ordinal"))


@query("WIN8_role_union", "lineitem", sql="select l_suppkey, l_returnflag, min(l_orderkey) first_order from lineitem group by 1, 2")
def _(li):
    return upsert.first_occurrence(li.select("l_suppkey", "l_returnflag", "l_orderkey", "l_linenumber"), ["l_suppkey", "l_returnflag"], ["l_orderkey", "l_linenumber"]).select("l_suppkey", "l_returnflag", F.col("l_orderkey").alias("first_order"))


@query("SRT1_sort_modes", "orders", sql="select o_orderkey, row_number() over (order by nullif(o_orderpriority, '5-LOW') desc nulls last, o_orderkey) place from orders order by place limit 100")
def _(o):
    top = o.select("o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("p")).orderBy(F.desc_nulls_last("p"), "o_orderkey").limit(100)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last("p"), "o_orderkey")).cast("long")).drop("p")  # over the hundred


@query("SRT2_offset_page", "orders", sql="select o_orderkey from orders order by o_totalprice desc, o_orderkey limit 20 offset 40")
def _(o):
    return search.page(o, [F.desc("o_totalprice"), F.col("o_orderkey")], 40, 20).select("o_orderkey")


@query("SRT3_keyset_page", "orders", sql="with c as (select o_orderpriority p, o_orderkey k from orders where o_orderkey = 10) select o_orderkey, o_orderpriority from orders, c where (o_orderpriority < p) or (o_orderpriority = p and o_orderkey > k) order by o_orderpriority desc, o_orderkey limit 50")
def _(o):
    at = o.where("o_orderkey = 10").select(F.col("o_orderpriority").alias("p"), F.col("o_orderkey").alias("k")).first()
    cursor = search.decode_cursor(search.encode_cursor([at.p, at.k]), 2)
    return o.where(search.after([("o_orderpriority", True), ("o_orderkey", False)], cursor)).orderBy(F.desc("o_orderpriority"), "o_orderkey").limit(50).select("o_orderkey", "o_orderpriority")


@query("SRT5_row_cap", "part", sql="select p_partkey from part order by p_partkey limit 500")
def _(p):
    return p.orderBy("p_partkey").limit(500).select("p_partkey")


@query("SRT6_byte_cap", "part")
def _(p):
    from civicframe.plans.gate import byte_cap

    return byte_cap(p.select("p_partkey", "p_name").orderBy("p_partkey").limit(500), ["p_partkey"], 10_000)


@query("SRT7_work_queue", "orders", sql="select o_orderkey, case o_orderstatus when 'P' then 0 when 'O' then 1 else 2 end as rank from orders order by rank, o_orderdate desc nulls last, o_orderkey limit 200")
def _(o):
    rank = dom.ladder((F.col("o_orderstatus") == "P", 0), (F.col("o_orderstatus") == "O", 1), otherwise=2)
    return o.withColumn("rank", rank).orderBy("rank", F.desc_nulls_last("o_orderdate"), "o_orderkey").limit(200).select("o_orderkey", "rank")


@query("SRT8_next_job", "events", sql="select event_id from events order by event_type, ts, event_id limit 1")
def _(e):
    return e.orderBy("event_type", "ts", "event_id").limit(1).select("event_id")


@query("SRT9_count_before_cut", "part", sql="select p_partkey, (select count(*) from part where p_name like '%an%') total from part where p_name like '%an%' order by p_partkey limit 10")
def _(p):
    hits = p.where(F.col("p_name").contains("an"))
    return hits.select("p_partkey").orderBy("p_partkey").limit(10).join(F.broadcast(hits.agg(n("total"))))  # a row of one count


@query("SRT10_gap_priority", "lineitem", sql="""with b as (select distinct l_orderkey // 1000 r, l_orderkey % 1000 s from lineitem where l_orderkey % 1000 > 0), h as (select r, max(s) m from b group by 1),
    g as (select r, unnest(range(1, m)) s, 1 kind from h union all select r, unnest(range(m + 1, m + 4)), 0 from h)
    select r, s, kind from g where not exists (select 1 from b where b.r = g.r and b.s = g.s) order by r desc, kind, s limit 300""")
def _(li):
    held = li.select(F.expr("l_orderkey div 1000").alias("r"), (F.col("l_orderkey") % 1000).alias("s")).distinct()
    return graph.gaps(held, ["r"], "s", tail=3).select("r", "s", F.when(F.col("kind") == "tail", 0).otherwise(1).alias("kind")).orderBy(F.desc("r"), "kind", "s").limit(300)


@query("SRT11_amount_desc", "customer", sql="select c_custkey, round(coalesce(try_cast(case when c_acctbal < 0 then 'garbage' else c_acctbal::varchar end as double), 0), 2) amount from customer order by amount desc, c_custkey limit 100")
def _(c):
    raw = F.when(F.col("c_acctbal") < 0, "garbage").otherwise(F.col("c_acctbal").cast("string"))
    return c.select("c_custkey", money(F.coalesce(raw.try_cast("double"), F.lit(0.0)), "amount")).orderBy(F.desc("amount"), "c_custkey").limit(100)


@query("SET1_union_envelope", "customer", "supplier", "part", sql=_ENVELOPE)
def _(c, s, p):
    return _envelope(c, s, p)


@query(
    "SET2_missing_columns",
    "customer",
    "supplier",
    "part",
    "orders",
    sql="""select 'customer/' || c_custkey iri, c_name title, c_mktsegment segment, null::timestamp as "date" from customer union all select 'supplier/' || s_suppkey, s_name, null, null from supplier
    union all select 'part/' || p_partkey, p_name, p_type, null from part union all select 'order/' || o_orderkey, null, o_orderpriority, o_orderdate from orders""",
)
def _(c, s, p, o):
    iri = lambda kind, key: F.concat(F.lit(f"{kind}/"), F.col(key).cast("string")).alias("iri")
    four = [
        c.select(iri("customer", "c_custkey"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("segment")),
        s.select(iri("supplier", "s_suppkey"), F.col("s_name").alias("title")),
        p.select(iri("part", "p_partkey"), F.col("p_name").alias("title"), F.col("p_type").alias("segment")),
        o.select(iri("order", "o_orderkey"), F.col("o_orderpriority").alias("segment"), F.col("o_orderdate").alias("date")),
    ]
    out = four[0]
    for one in four[1:]:
        out = out.unionByName(one, allowMissingColumns=True)
    return out


@query("SET3_cited_unknown", "orders", "lineitem", sql="select o_orderkey from orders except select l_orderkey from lineitem")
def _(o, li):
    return o.select("o_orderkey").join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").distinct()


@query(
    "SET4_union_sorted",
    "orders",
    "lineitem",
    sql="""
    with l as (select l_orderkey, list(l_partkey) parts from lineitem group by 1)
    select o_orderkey, array_to_string(list_sort(list_distinct(list_concat([o_custkey], coalesce(parts, [])))), ',') ids from orders left join l on l_orderkey = o_orderkey""",
)
def _(o, li):
    linked = li.groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("parts"))  # the lines of an order
    both = F.array_union(F.array("o_custkey"), F.coalesce("parts", F.array().cast("array<bigint>")))
    return o.join(linked, o.o_orderkey == linked.l_orderkey, "left").select("o_orderkey", F.array_join(F.array_sort(both), ",").alias("ids"))


@query("SET5_holes_minus_absent", "lineitem", sql="select v missing from (select unnest(range(1, (select max(l_orderkey) from lineitem) + 1)) v) where v % 7 <> 0 and v not in (select l_orderkey from lineitem)")
def _(li):
    held = li.select(F.expr("l_orderkey div 1000000000").alias("r"), "l_orderkey").distinct()
    return graph.gaps(held, ["r"], "l_orderkey").where("l_orderkey % 7 <> 0").select(F.col("l_orderkey").alias("missing"))


@query("SET6_first_in_batch", "lineitem", sql="select l_partkey, min(l_orderkey) l_orderkey, count(*) - 1 dropped from lineitem group by 1")
def _(li):
    return li.groupBy("l_partkey").agg(F.min("l_orderkey").alias("l_orderkey"), (F.count("*") - 1).alias("dropped"))
