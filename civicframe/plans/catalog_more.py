"""Queries over projections, writes, scalars, search, resolution, events and pipelines; they extend ``plans.catalog``."""

from __future__ import annotations

from pyspark.sql import functions as F

from civicframe.functions import domain as dom
from civicframe.functions import text as tx
from civicframe.functions import web
from civicframe.operators import graph, postings, references, resolve, search, upsert
from civicframe.streaming import events as ev

from .catalog import money, n, query

# -- projections and predicates ------------------------------------------------------------------------------------------


@query("PRJ1_optional_filters", "orders", sql="select o_orderkey from orders where o_orderstatus = 'O' and o_orderpriority = '2-HIGH' and o_orderdate >= timestamp '1995-01-01' and o_orderdate < timestamp '1997-01-01'")
def _(o):
    wanted = {"o_orderstatus": "O", "o_orderpriority": "2-HIGH", "o_custkey": None}
    for k, v in wanted.items():
        o = o if v is None else o.where(F.col(k) == v)
    return o.where("o_orderdate >= timestamp_ntz'1995-01-01' and o_orderdate < timestamp_ntz'1997-01-01'").select("o_orderkey")


@query("PRJ2_substring_any_case", "customer", sql="select c_custkey from customer where contains(lower(c_mktsegment), lower('BuIlD'))")
def _(c):
    return c.where(F.contains(F.lower("c_mktsegment"), F.lower(F.lit("BuIlD")))).select("c_custkey")


@query("PRJ3_prefix", "part", sql="select p_partkey from part where concat_ws('/', p_type, p_brand) = 'STANDARD' or starts_with(concat_ws('/', p_type, p_brand), (select min(p_type) from part) || '/')")
def _(p):
    first = p.agg(F.min("p_type").alias("first"))
    path = F.concat_ws("/", "p_type", "p_brand")
    return p.join(F.broadcast(first), path.startswith(F.concat("first", F.lit("/"))) | (path == "STANDARD")).select("p_partkey")  # a row of one value


@query("PRJ4_joined_membership", "part", sql="select p_partkey from part where list_contains(string_split(replace(p_name, ' ', ','), ','), split_part((select min(p_name) from part), ' ', 1))")
def _(p):
    word = F.split(F.min("p_name"), " ")[0].alias("word")
    return p.withColumn("w", F.explode(F.array_distinct(F.split(F.replace("p_name", F.lit(" "), F.lit(",")), ",")))).join(F.broadcast(p.agg(word)), F.col("w") == F.col("word")).select("p_partkey")


@query("PRJ5_contains_all", "part", sql="select p_partkey from part where list_has_all(string_split(p_name, ' '), string_split((select min(p_name) from part), ' ')[1:1])")
def _(p):
    wanted = p.agg(F.slice(F.split(F.min("p_name"), " "), 1, 1).alias("wanted"))
    return p.join(F.broadcast(wanted), F.size(F.array_except("wanted", F.split("p_name", " "))) == 0).select("p_partkey")  # a row of one list


@query("PRJ6_public_projection", "customer", sql="select c_custkey, c_name, c_mktsegment from customer where c_acctbal >= 0")
def _(c):
    return c.where("c_acctbal >= 0").select("c_custkey", "c_name", "c_mktsegment")


@query("PRJ7_abridged", "documents", sql="select doc_id, lang, source, n_chars, true abridged from documents")
def _(d):
    return d.drop("text").withColumn("abridged", F.lit(True))


@query("PRJ8_key_shape", "part", sql="select p_partkey from part where regexp_matches(p_brand, '^Brand#[1-3]')")
def _(p):
    return p.where(F.col("p_brand").rlike("^Brand#[1-3]")).select("p_partkey")


@query("PRJ9_null_safe_not", "customer", sql="select c_custkey from customer where nullif(c_mktsegment, 'BUILDING') is distinct from 'MACHINERY'")
def _(c):
    return c.where(~F.nullif("c_mktsegment", F.lit("BUILDING")).eqNullSafe("MACHINERY")).select("c_custkey")


@query("PRJ10_exclude_keeps_null", "customer", sql="select c_custkey from customer where not coalesce(contains(nullif(c_mktsegment, 'BUILDING'), 'MACH'), false)")
def _(c):
    return c.where(~F.coalesce(F.contains(F.nullif("c_mktsegment", F.lit("BUILDING")), F.lit("MACH")), F.lit(False))).select("c_custkey")


@query("PRJ11_display_name", "customer", sql="select c_custkey, coalesce(nullif(trim(case when c_custkey % 3 = 0 then '  ' else c_name end), ''), c_mktsegment) display from customer")
def _(c):
    raw = F.when(F.col("c_custkey") % 3 == 0, "  ").otherwise(F.col("c_name"))
    return c.select("c_custkey", F.coalesce(F.nullif(F.trim(raw), F.lit("")), "c_mktsegment").alias("display"))


@query("PRJ12_ranges", "lineitem", sql="select l_orderkey, l_linenumber from lineitem where l_discount >= 0 and l_discount <= 0.05 and l_quantity >= 10")
def _(li):
    bounds = {"l_discount": (0, 0.05), "l_quantity": (10, None)}
    for k, (low, high) in bounds.items():
        li = li if low is None else li.where(F.col(k) >= low)
        li = li if high is None else li.where(F.col(k) <= high)
    return li.select("l_orderkey", "l_linenumber")


@query("PRJ13_scopes", "customer", sql="select c_custkey from customer where c_mktsegment in ('BUILDING', 'MACHINERY') and not coalesce(nullif(c_nationkey, 7) in (1, 2, 3), false)")
def _(c):
    return c.where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & ~F.coalesce(F.nullif("c_nationkey", F.lit(7)).isin(1, 2, 3), F.lit(False))).select("c_custkey")


@query("PRJ14_three_arm_gate", "customer", "orders", sql="select c_custkey from customer left join (select o_custkey, count(*) n from orders where o_orderstatus = 'P' group by 1) on o_custkey = c_custkey where c_mktsegment <> 'BUILDING' or n >= 1 or nullif(c_nationkey, 0) is null")
def _(c, o):
    counts = o.where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(n())
    return c.join(counts, "c_custkey", "left").where((F.col("c_mktsegment") != "BUILDING") | (F.coalesce("n", F.lit(0)) >= 1) | F.nullif("c_nationkey", F.lit(0)).isNull()).select("c_custkey")


@query("PRJ15_visibility_ladder", "orders", "customer", sql="""select o_orderkey, case when o_orderpriority like '5%' then 'hidden' when o_orderstatus = 'F' then 'shown' when c_mktsegment = 'BUILDING' then 'shown' when o_totalprice > 200000 then 'cited' else 'hidden' end as state
    from orders join customer on c_custkey = o_custkey""")
def _(o, c):
    state = dom.ladder((F.col("o_orderpriority").startswith("5"), "hidden"), (F.col("o_orderstatus") == "F", "shown"), (F.col("c_mktsegment") == "BUILDING", "shown"), (F.col("o_totalprice") > 200000, "cited"), otherwise="hidden")
    return o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", state.alias("state"))


@query("PRJ16_policy_rank", "customer", "orders", sql="""select c_custkey, case c_nationkey % 3 when 0 then 'LISTED' when 1 then 'PRIVATE' else case max(case o_orderstatus when 'F' then 2 when 'P' then 1 else 0 end) when 2 then 'LISTED' when 1 then 'UNLISTED' else 'PRIVATE' end end visibility
    from customer left join orders on o_custkey = c_custkey group by c_custkey, c_nationkey""")
def _(c, o):
    ranks = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(dom.visibility_rank("o_orderstatus", ("F",), ("P",))).alias("rank"))
    policy = F.element_at(F.array(F.lit("PUBLIC"), F.lit("PRIVATE"), F.lit("CASE_GATED")), F.col("c_nationkey") % 3 + 1)
    return c.join(ranks, "c_custkey", "left").withColumn("policy", policy).select("c_custkey", dom.policy_visibility("policy", F.col("rank")).alias("visibility"))


@query("PRJ17_facet_value_search", "part", sql="select distinct p_type from part where contains(lower(p_type), lower('aNd'))")
def _(p):
    return p.where(F.contains(F.lower("p_type"), F.lower(F.lit("aNd")))).select("p_type").distinct()


@query("PRJ18_selection_bypass", "orders", sql="select o_orderkey from orders where (year(o_orderdate) = 1996 and o_orderstatus = 'O' and o_orderpriority = '1-URGENT') or o_orderkey in (1, 2, 3)")
def _(o):
    return o.where(((F.year("o_orderdate") == 1996) & (F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") == "1-URGENT")) | F.col("o_orderkey").isin(1, 2, 3)).select("o_orderkey")


@query("PRJ19_patch_validation", "part")
def _(p):
    from civicframe.functions.arrow import patch_problems

    patch = F.to_json(F.array(F.struct(F.element_at(F.array(*map(F.lit, ("add", "remove", "move", "paint"))), (F.col("p_partkey") % 4 + 1).cast("int")).alias("op"), F.concat(F.lit("/"), F.split("p_name", " ")[0]).alias("path"), F.lit("/slug/x").alias("from"), F.col("p_size").alias("value"))))
    return p.select("p_partkey", patch_problems(patch, ("/slug",)).alias("problem"))


# -- writes --------------------------------------------------------------------------------------------------------------


def _stored(p):
    return p.where("p_partkey % 2 = 0").select("p_partkey", "p_brand", F.when(F.col("p_partkey") % 4 == 0, F.lit(None).cast("int")).otherwise(F.col("p_size")).alias("p_size"), (F.col("p_partkey") % 10 == 0).alias("is_deleted"))


def _incoming(p):
    return p.where("p_partkey % 3 = 0").select("p_partkey", F.concat("p_brand", F.lit("*")).alias("p_brand"), "p_size", F.lit(False).alias("is_deleted"))


_SI = """with s as (select p_partkey, p_brand, case when p_partkey % 4 = 0 then null else p_size end p_size, p_partkey % 10 = 0 is_deleted from part where p_partkey % 2 = 0),
    i as (select p_partkey, p_brand || '*' p_brand, p_size, false is_deleted from part where p_partkey % 3 = 0)"""


@query("SNK1_upsert", "part", sql=f"""{_SI} select p_partkey, coalesce(i.p_brand, s.p_brand) p_brand, coalesce(i.p_size, s.p_size) p_size, coalesce(i.is_deleted, s.is_deleted) is_deleted,
    case when i.p_brand is null then 'kept' when s.p_brand is null then 'created' when s.is_deleted then 'revived' else 'updated' end as action from s full join i using (p_partkey)""")
def _(p):
    return upsert.upsert(_stored(p), _incoming(p), ["p_partkey"], "is_deleted")


@query("SNK2_gap_fill", "part", sql=f"""{_SI} select p_partkey, coalesce(s.p_brand, i.p_brand) p_brand, coalesce(s.p_size, i.p_size) p_size, coalesce(s.is_deleted, i.is_deleted) is_deleted,
    case when i.p_brand is null then 'kept' when s.p_brand is null then 'created' when s.p_size is null then 'updated' else 'unchanged' end as action from s full join i using (p_partkey)""")
def _(p):
    return upsert.gap_fill(_stored(p), _incoming(p), ["p_partkey"])


@query("SNK3_map_union", "part", sql="""select p_partkey, p_brand || '+' || p_type brand, coalesce(case when p_size > 25 then p_name end, p_type) as type from part""")
def _(p):
    old, new = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("type"), F.col("p_type")), F.create_map(F.lit("brand"), F.concat_ws("+", "p_brand", "p_type"), F.lit("type"), F.when(F.col("p_size") > 25, F.col("p_name")))
    m = p.select("p_partkey", upsert.map_union(old, new).alias("m"))
    return m.select("p_partkey", F.col("m")["brand"].alias("brand"), F.col("m")["type"].alias("type"))


@query("SNK4_monotonic_promotion", "orders", "lineitem", sql="select l_orderkey, l_linenumber, case when l_shipdate >= o_orderdate + interval 30 day then l_returnflag else o_orderstatus end verdict from lineitem join orders on o_orderkey = l_orderkey")
def _(o, li):
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return j.select("l_orderkey", "l_linenumber", upsert.promoted(F.col("o_orderstatus"), F.expr("o_orderdate + interval 30 days"), F.col("l_returnflag"), F.col("l_shipdate")).alias("verdict"))


@query("SNK5_replace_children", "lineitem", sql="select l_orderkey, l_linenumber from lineitem where l_orderkey % 2 = 1 union all select l_orderkey, l_linenumber + 100 from lineitem where l_orderkey % 2 = 0")
def _(li):
    fresh = li.where("l_orderkey % 2 = 0").select("l_orderkey", (F.col("l_linenumber") + 100).alias("l_linenumber"))
    return li.select("l_orderkey", "l_linenumber").join(fresh.select("l_orderkey").distinct(), "l_orderkey", "left_anti").unionByName(fresh)


@query("SNK8_changed_columns", "part", sql="select changed, count(*) n from (select concat_ws(',', case when p_partkey % 5 = 0 then 'p_brand' end, case when p_partkey % 3 = 0 then 'p_size' end) changed from part) where changed <> '' group by 1")
def _(p):
    after = p.withColumn("p_size", F.when(F.col("p_partkey") % 3 == 0, F.col("p_size") + 1).otherwise(F.col("p_size"))).withColumn("p_brand", F.when(F.col("p_partkey") % 5 == 0, "new").otherwise(F.col("p_brand")))
    return upsert.changed_columns(p, after, ["p_partkey"]).groupBy("changed").agg(n())


@query("SNK10_rebuild_catch_up", "part", sql="select p_partkey, case when p_partkey % 3 = 1 then 'fresh' else p_name end p_name from part where p_partkey % 3 <> 0")
def _(p):
    from civicframe.sources.sinks import catch_up

    changes = p.where("p_partkey % 3 < 2").select("p_partkey", F.lit("fresh").alias("p_name"), (F.col("p_partkey") % 3 == 0).alias("evicted"))
    return catch_up(p.select("p_partkey", "p_name"), changes, "p_partkey")


@query("SNK12_index_tree", "part", sql="with recursive t as (select p_partkey id, 'index/' || p_partkey path from part where p_partkey = 1 union all select p.p_partkey, t.path || '/' || p.p_partkey from part p join t on p.p_partkey // 2 = t.id and p.p_partkey > 1) select path from t")
def _(p):
    from civicframe.sources.sinks import index_tree

    nodes = p.where("p_partkey >= 1").select(F.col("p_partkey").cast("string").alias("id"), F.when(F.col("p_partkey") > 1, F.expr("p_partkey div 2").cast("string")).alias("parent"), F.col("p_name").alias("label"))
    return index_tree(nodes, "index").select("path")


@query("SNK13_resource_list", "orders", sql="select count(*) n, count(distinct entry) entries from (select 'https://example.org/o/' || o_orderkey || o_orderdate entry from orders)")
def _(o):
    from civicframe.sources.sinks import resource_list

    docs = o.select(F.concat(F.lit("https://example.org/o/"), F.col("o_orderkey")).alias("iri"), F.col("o_orderdate").alias("lastmod"))
    return resource_list(docs, 1000).agg(n(), F.countDistinct("entry").alias("entries"))


# -- scalars -------------------------------------------------------------------------------------------------------------


@query("STR1_query_key", "part", sql="select p_partkey, lower(trim(regexp_replace('  ' || replace(p_name, ' ', '  ') || ' X', '\\s+', ' ', 'g'))) k from part")
def _(p):
    return p.select("p_partkey", tx.query_key(F.concat(F.lit("  "), F.replace("p_name", F.lit(" "), F.lit("  ")), F.lit(" X"))).alias("k"))


@query("STR2_digits", "customer", sql="select c_custkey, translate(c_name, '0123456789', '०१२३४५६७८९') deva, c_name ascii from customer")
def _(c):
    deva = tx.devanagari_digits("c_name")
    return c.select("c_custkey", deva.alias("deva"), tx.ascii_digits(deva).alias("ascii"))


@query("STR3_case_number", "orders", sql="select o_orderkey, case when o_orderkey % 5 = 0 then o_orderkey || '/x' else lpad((o_orderkey % 90)::varchar, 3, '0') || '-C' || (o_custkey % 9) || '-' || case when length(o_orderkey::varchar) < 4 then lpad(o_orderkey::varchar, 4, '0') else o_orderkey::varchar end end number from orders")
def _(o):
    raw = F.concat((F.col("o_orderkey") % 90).cast("string"), F.lit("-c"), (F.col("o_custkey") % 9).cast("string"), F.lit("-"), F.col("o_orderkey").cast("string"))
    return o.select("o_orderkey", tx.case_number(F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.col("o_orderkey"), F.lit("/x"))).otherwise(raw)).alias("number"))


@query("STR6_sentinel", "orders", sql="select o_orderstatus, regexp_replace(coalesce(case o_orderstatus when 'F' then '**** ** **' when 'O' then null else '2081-01-02' end, ''), '[* -]', '', 'g') = '' sentinel, count(*) n from orders group by 1, 2")
def _(o):
    v = F.when(F.col("o_orderstatus") == "F", "**** ** **").when(F.col("o_orderstatus") == "O", F.lit(None)).otherwise("2081-01-02")
    return o.groupBy("o_orderstatus", tx.no_verdict(v).alias("sentinel")).agg(n())


@query("STR15_sound_fold", "part", sql="""with f as (select p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(lower('Bhv ' || p_name || ' Weddings'), '[^a-z0-9]+', ' ', 'g'), '([bcdgjkpt])h', '\\1', 'g'), '[vw]', 'b', 'g')) s from part),
    ch as (select p_partkey, i, s[i] x, s[i - 1] y from (select p_partkey, s, unnest(range(1, length(s) + 1)) i from f))
    select p_partkey, string_agg(x, '' order by i) fold from ch where not (x = y and x between 'a' and 'z') or i = 1 group by 1""")
def _(p):
    return p.select("p_partkey", tx.sound_fold(F.concat(F.lit("Bhv "), "p_name", F.lit(" Weddings"))).alias("fold"))


@query("STR16_matches", "part", sql="select p_partkey from part where contains(lower(p_name), 'al') or contains(lower(p_type), 'tin')")
def _(p):
    return p.where(tx.matches("p_name", F.lit(" AL ")) | tx.matches("p_type", F.lit("TIN"))).select("p_partkey")


_URL = "regexp_replace(trim(url), '#.*$', '')"


@query("STR20_article_url", "pages", sql=f"""with u as (select page_id, {_URL} u from pages), p as (select page_id, lower(regexp_extract(u, '^([A-Za-z]+):', 1)) s, regexp_replace(lower(regexp_extract(u, '://([^/?#:]*)', 1)), '^www[0-9]*\\.', '') h,
      regexp_replace(regexp_extract(u, '^[^:]+://[^/?]*([^?]*)', 1), '/+$', '') pa, array_to_string(list_filter(string_split(regexp_extract(u, '\\?(.*)$', 1), '&'), lambda k: k <> '' and not regexp_matches(lower(k), '^(utm_|fbclid|gclid|ref)')), '&') q from u),
    r as (select page_id, s || '://' || h || case when pa = '' then '/' else pa end || case when q = '' then '' else '?' || q end url from p) select page_id, url, substr(sha256(url), 1, 8) ident from r""")
def _(p):
    u = web.article_url("url")
    return p.select("page_id", u.alias("url"), F.substring(F.sha2(u, 256), 1, 8).alias("ident"))


@query("STR21_registrable_domain", "pages", sql="select array_to_string(string_split(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '.')[-2:], '.') as domain, count(*) n from pages group by 1")
def _(p):
    return p.groupBy(web.registrable_domain(web.host("url")).alias("domain")).agg(n())


@query("STR22_iri", "nation", sql="select n_nationkey, 'https://example.org/place/' || n_nationkey iri, 'place' kind from nation")
def _(na):
    i = web.iri("https://example.org", "place", "n_nationkey")
    return na.select("n_nationkey", i.alias("iri"), web.iri_parts("https://example.org", i)["kind"].alias("kind"))


@query("STR24_windows", "documents", sql="""with d as (select doc_id, coalesce(text, '') t from documents), w as (select doc_id, t, unnest(range(0, case when length(t) = 0 then 0 else ceil(greatest(length(t) - 50, 1) / 350.0)::bigint end)) no from d)
    select doc_id, no::int no, sha256(substr(t, no * 350 + 1, 400)) body from w""")
def _(d):
    return d.select("doc_id", F.inline(tx.windows("text", 400, 50))).select("doc_id", "no", F.sha2("body", 256).alias("body"))


@query("STR26_amount_tier", "orders", sql="""with a as (select o_orderkey, floor(o_totalprice * 100)::bigint v from orders), p as (select o_orderkey, v // 1000000000 a, v % 1000000000 // 10000000 c, v % 10000000 // 100000 l, v % 100000 // 1000 h from a),
    t as (select o_orderkey, concat_ws(' ', case when a > 0 then a || ' Arab' end, case when c > 0 then c || ' Crore' end, case when l > 0 and a = 0 then l || ' Lakh' end, case when h > 0 and a = 0 and c = 0 then h || ' Hazar' end) t from p) select o_orderkey, case when t = '' then 'Under 1 Hazar' else '~' || t end tier from t""")
def _(o):
    return o.select("o_orderkey", tx.amount_tier(F.floor(F.col("o_totalprice") * 100)).alias("tier"))


@query("STR27_redact", "documents", sql="""select doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+'))::int email, len(regexp_extract_all(text, '\\+[0-9]{1,3} \\([0-9]{3}\\) [0-9]{3}-[0-9]{4}'))::int phone, 0 residue from documents""")
def _(d):
    counts, after = tx.redaction_counts("text"), tx.redaction_counts(tx.redacted("text"))
    return d.select("doc_id", counts["email"].alias("email"), counts["phone"].alias("phone"), (after["email"] + after["phone"] + after["card"]).alias("residue"))


@query("STR28_snippet", "documents", sql="select doc_id, instr(text, 'er')::int as at, substr(text, greatest(instr(text, 'er') - 30, 1), 90) snippet from documents where contains(text, 'er')")
def _(d):
    at = F.instr("text", "er")
    return d.where(at > 0).select("doc_id", at.alias("at"), tx.snippet("text", at).alias("snippet"))


@query("STR31_gate_scalars", "customer", sql="select c_custkey, upper(trim(c_mktsegment)) || '-' || length(c_name) a, concat_ws('/', lower(c_name), substring(c_mktsegment, 1, 3)) b, replace(ltrim(rtrim(c_name)), '#', ':') c from customer")
def _(c):
    return c.selectExpr("c_custkey", "upper(trim(c_mktsegment)) || '-' || length(c_name) a", "concat_ws('/', lower(c_name), substring(c_mktsegment, 1, 3)) b", "replace(ltrim(rtrim(c_name)), '#', ':') c")


@query("STR32_slug", "part", sql="select p_partkey, trim(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-') slug from part")
def _(p):
    return p.select("p_partkey", tx.slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"))


@query("DT2_any_separator", "orders", sql="select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day from orders")
def _(o):
    return o.select("o_orderkey", tx.bs_date(tx.devanagari_digits(F.concat_ws(".", F.year("o_orderdate").cast("string"), F.month("o_orderdate").cast("string"), F.day("o_orderdate").cast("string")))).alias("day"))


_STAGES = "select l_orderkey, min(l_shipdate)::date started, case when bool_or(l_linestatus = 'O') then null else max(l_shipdate)::date end decided from lineitem group by 1"


@query("DT4_proceeding_dates", "lineitem", sql=_STAGES)
def _(li):
    stage = F.struct(F.lit("initial").alias("stage"), F.to_date("l_shipdate").alias("start"), F.when(F.col("l_linestatus") != "O", F.to_date("l_shipdate")).alias("end"))
    s = li.groupBy("l_orderkey").agg(F.collect_list(stage).alias("stages"))  # the lines of an order
    d = dom.proceeding_dates("stages", ("initial",))
    return s.select("l_orderkey", d["started"].alias("started"), d["decided"].alias("decided"))


@query("DT5_single_stage", "lineitem", sql="select l_orderkey, case when count(*) filter (where l_returnflag = 'A') = 1 then min(l_shipdate) filter (where l_returnflag = 'A')::date end as start from lineitem group by 1")
def _(li):
    s = li.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_returnflag").alias("stage"), F.to_date("l_shipdate").alias("start"), F.to_date("l_shipdate").alias("end"))).alias("stages"))
    return s.select("l_orderkey", dom.single_stage_dates("stages", "A")["start"].alias("start"))


@query("DT6_lifecycle", "lineitem", sql="select l_orderkey, case when bool_and(l_linestatus = 'F') then 'decided' when bool_or(l_linestatus = 'F') then 'partly' else 'open' end as status from lineitem group by 1")
def _(li):
    f = F.col("l_linestatus") == "F"
    return li.groupBy("l_orderkey").agg(dom.ladder((F.bool_and(f), "decided"), (F.bool_or(f), "partly"), otherwise="open").alias("status"))


@query("DT8_lookback_series", "orders", sql="select d::date as day from (select unnest(generate_series(max(o_orderdate)::date - interval 30 day, max(o_orderdate)::date, interval 1 day)) d from orders)")
def _(o):
    last = F.to_date(F.max("o_orderdate"))
    return o.agg(F.sequence(F.date_sub(last, 30), last).alias("s")).select(F.explode("s").alias("day"))


@query("DT9_gate_dates", "orders", sql="select date_trunc('month', o_orderdate)::date as month, extract(quarter from o_orderdate)::int as quarter, count(*) n from orders group by 1, 2")
def _(o):
    return o.groupBy(F.to_date(F.date_trunc("month", "o_orderdate")).alias("month"), F.quarter("o_orderdate").alias("quarter")).agg(n())


@query("DT10_guarded_date", "orders", sql="select o_orderkey, case when o_orderkey % 4 = 0 then null else o_orderdate::date end as day from orders")
def _(o):
    raw = F.when(F.col("o_orderkey") % 4 == 0, "1998-13-40").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    day = F.to_date(F.try_to_timestamp(raw, F.lit("yyyy-MM-dd")))
    return o.select("o_orderkey", F.when(F.year(day).between(1900, 2200), day).alias("day"))


@query("MA1_gate_math", "lineitem", sql="select l_orderkey, l_linenumber, abs(ceil(-l_quantity / 7))::bigint a, floor(l_quantity / 7)::bigint f, greatest(l_quantity, 25) g, least(l_quantity, 25) l, coalesce(nullif(l_linenumber, 1), -1)::int c from lineitem")
def _(li):
    return li.selectExpr("l_orderkey", "l_linenumber", "cast(abs(ceil(-l_quantity / 7)) as bigint) a", "cast(floor(l_quantity / 7) as bigint) f", "greatest(l_quantity, 25d) g", "least(l_quantity, 25d) l", "coalesce(nullif(l_linenumber, 1), -1) c")


@query("MA3_backoff", "lineitem", sql="select l_linenumber, case when l_linenumber <= 1 then 60 when l_linenumber = 2 then 300 when l_linenumber = 3 then 900 else 1800 end as seconds, count(*) n from lineitem group by 1")
def _(li):
    return li.groupBy("l_linenumber").agg(n()).withColumn("seconds", dom.backoff(F.col("l_linenumber")))


@query("MA4_finite", "lineitem", sql="select l_orderkey, l_linenumber, case when l_linenumber = 1 then null else l_quantity end q from lineitem")
def _(li):
    return li.select("l_orderkey", "l_linenumber", dom.finite(F.when(F.col("l_linenumber") == 1, F.lit(float("nan"))).otherwise(F.col("l_quantity"))).alias("q"))


@query("AR2_distinct_words", "part", sql="select distinct unnest(string_split(p_name, ' ')) w from part where p_partkey % 3 = 0 order by 1")
def _(p):
    words = F.to_json(F.split("p_name", " "))
    body = F.when(F.col("p_partkey") % 3 == 0, words).when(F.col("p_partkey") % 3 == 1, F.to_json(F.struct(F.col("p_brand").alias("brand")))).otherwise(F.col("p_type"))  # arrays, objects, and what isn't JSON
    return references.distinct_elements(p.select(body.alias("body")), "body", "w").orderBy("w")


@query("AR4_pairs_of_small_frames", "region", "nation", sql="select r_name || '/' || n_nationkey iri from region cross join nation where n_nationkey < 5")
def _(r, na):
    numbers = F.array(*map(F.lit, range(5)))
    return r.select("r_name", F.explode(numbers).alias("k")).join(F.broadcast(na), F.col("k") == F.col("n_nationkey")).select(F.concat_ws("/", "r_name", "n_nationkey").alias("iri"))


@query("JSON1_extract", "events", sql="select event_id, json_extract_string(props, '$.k')::int k from events")
def _(e):
    return e.select("event_id", F.get_json_object("props", "$['k']").cast("int").alias("k"))


@query("JSON2_has_key", "events", sql="select event_type, count(*) filter (where json_exists(props, '$.k')) has_k, count(*) filter (where json_exists(props, '$.nope')) has_none from events group by 1")
def _(e):
    keys = F.json_object_keys("props")
    return e.groupBy("event_type").agg(F.count_if(F.array_contains(keys, "k")).alias("has_k"), F.count_if(F.array_contains(keys, "nope")).alias("has_none"))


@query("JSON4_repair", "events")
def _(e):
    from civicframe.functions.arrow import repaired_json

    return e.select("event_id", repaired_json(F.concat(F.lit("```json\n"), F.expr("substr(props, 1, length(props) - 1)"))).alias("props"))


@query("JSON5_rewrite_references", "part", sql="select p_partkey, case when p_brand = 'Brand#1' then 'Brand#merged' else p_brand end ref, p_brand id, case when p_brand = 'Brand#1' then 1 else 2 end entries from part")
def _(p):
    from civicframe.functions.arrow import rewritten_json

    ref = F.struct(F.col("p_brand").alias("@id"))
    doc = F.to_json(F.struct(F.col("p_brand").alias("@id"), F.array(ref, ref).alias("about")))
    made = rewritten_json(doc, {"Brand#1": "Brand#merged"})
    entries = F.size(F.from_json(F.get_json_object(made, "$.about"), "array<string>"))
    return p.select("p_partkey", F.get_json_object(made, "$.about[0]['@id']").alias("ref"), F.get_json_object(made, "$['@id']").alias("id"), entries.alias("entries"))


@query("JSON6_shape", "nation", sql="select n_nationkey, 'https://example.org/place/' || n_nationkey id, n_name from nation")
def _(na):
    doc = F.to_json(F.struct(web.iri("https://example.org", "place", "n_nationkey").alias("@id"), F.lit("Place").alias("@type"), F.struct(F.col("n_name").alias("en")).alias("name")))
    return na.withColumn("doc", doc).select("n_nationkey", F.get_json_object("doc", "$['@id']").alias("id"), F.get_json_object("doc", "$.name.en").alias("n_name"))


# -- search, resolution, events, pipelines ---------------------------------------------------------------------------------


@query("SRCH1_weighted", "part", sql="""with w as (select string_split(min(p_name), ' ')[1] t from part) select p_partkey, (case when list_contains(string_split(lower(p_name), ' '), t) then 3.0 else 0.0 end + case when list_contains(string_split(lower(p_type), ' '), 'tin') then 1.0 else 0.0 end)::double score from part, w
    where list_contains(string_split(lower(p_name), ' '), t) or list_contains(string_split(lower(p_type), ' '), 'tin') order by score desc, p_partkey""")
def _(p):
    token = p.agg(F.split(F.min("p_name"), " ")[0].alias("t")).first().t
    score = search.overlap_score({"p_name": 3.0}, [token]) + search.overlap_score({"p_type": 1.0}, ["tin"])
    return p.select("p_partkey", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "p_partkey")


#: BM25 over two fields, as the index and the scan have it.
_BM25 = r"""
    with f as (select doc_id, 'text' field, 1.0::double w, regexp_split_to_array(lower(coalesce(text, '')), '[ \t\n\x0B\f\r]+') words from documents
      union all select doc_id, 'source', 2.0, regexp_split_to_array(lower(coalesce(source, '')), '[ \t\n\x0B\f\r]+') from documents),
    s as (select field, count(*) n, avg(len(words)) mean from f group by 1),
    h as (select doc_id, field, w, len(words) len, t term, len(list_filter(words, lambda x: x = t)) tf from f, (select unnest({tokens}) t) where list_contains(words, t)),
    d as (select field, term, count(*) df from h group by 1, 2),
    r as (select doc_id, round(sum(w * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) score from h join d using (field, term) join s using (field) group by 1)"""


@query("SRCH1_bm25", "documents", sql=_BM25.format(tokens="['and', 'of', 'src1']") + " select doc_id, score from r")
def _(d):
    return search.bm25(d, "doc_id", {"text": 1.0, "source": 2.0}, ["and", "of", "src1"]).select("doc_id", F.round("score", 6).alias("score"))


@query("SRCH1_indexed", "documents", sql=_BM25.format(tokens="['and', 'src1', 'la']") + " select doc_id, score from r order by score desc, doc_id limit 50")
def _(d):
    from civicframe.storage import shared_path

    index = postings.build(d, "doc_id", ["text", "source"], shared_path(d.sparkSession, "index"))
    return postings.best(index, {"text": 1.0, "source": 2.0}, ["and", "src1", "la"], 50).select(F.col("key").alias("doc_id"), "score")


@query(
    "SRCH3_indexed_phrase",
    "part",
    sql="""
    with t as (select p_partkey, len(list_filter(range(1, len(w)), lambda i: w[i] = 'medium' and w[i + 1] = 'red')) n from (select p_partkey, string_split(lower(p_type || ' ' || p_name), ' ') w from part))
    select p_partkey, n::int n from t where n > 0""",
)
def _(p):
    from civicframe.storage import shared_path

    index = postings.build(p.select("p_partkey", F.concat_ws(" ", "p_type", "p_name").alias("body")), "p_partkey", ["body"], shared_path(p.sparkSession, "index"))
    return postings.phrases(index, "body", ["medium", "red"]).select(F.col("key").alias("p_partkey"), "n")


@query("SRCH5_eligible", "part", sql="select p_partkey, array_to_string(list_filter(string_split(p_name, ' '), lambda t: regexp_matches(t, '^[a-zA-Z]{4,}$') and lower(t) <> 'azure')[:12], ',') tokens from part")
def _(p):
    return p.select("p_partkey", F.array_join(search.eligible(F.split("p_name", " "), denied=["azure"]), ",").alias("tokens"))


_VOC = "select unnest(string_split(p_name, ' ')) word from part"
_MIS = "select distinct substr(word, 1, 2) || substr(word, 4) token from voc where length(word) >= 5"


@query("SRCH6_fuzzy", "part", sql=f"with voc as (select word, count(*) freq from ({_VOC}) group by 1), mis as ({_MIS}) select token, word, levenshtein(token, word)::int distance from mis, voc where substr(token, 1, 1) = substr(word, 1, 1) and levenshtein(token, word) between 1 and case when length(token) < 8 then 1 else 2 end")
def _(p):
    voc = p.select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    mis = voc.where("length(word) >= 5").select(F.concat(F.substring("word", 1, 2), F.expr("substr(word, 4)")).alias("token")).distinct()
    return search.fuzzy(voc, mis)


@query("SRCH7_suggest", "part", sql=f"with voc as (select word, count(*) freq from ({_VOC}) group by 1), mis as ({_MIS}) select token, arg_max(word, row(-levenshtein(token, word), freq, word)) word from mis, voc where substr(token, 1, 1) = substr(word, 1, 1) and levenshtein(token, word) between 1 and case when length(token) < 8 then 1 else 2 end group by 1")
def _(p):
    voc = p.select(F.explode(F.split("p_name", " ")).alias("word")).groupBy("word").agg(n("freq"))
    mis = voc.where("length(word) >= 5").select(F.concat(F.substring("word", 1, 2), F.expr("substr(word, 4)")).alias("token")).distinct()
    return search.suggestion(search.fuzzy(voc.select("word"), mis).join(voc, "word"))


@query(
    "SRCH7_did_you_mean",
    "part",
    sql=r"""
    with held as (select distinct p_partkey doc, unnest(string_split(p_name, ' ')) word from part),
    voc as (select word, count(*) freq, length(word) % 2 authority from held group by 1),
    names as (select distinct string_split(p_name, ' ') w from part),
    bad as (select w, [case when length(x) >= 5 then substr(x, 1, 2) || substr(x, 4) else x end for x in w] t from names),
    asked as (select array_to_string(w, ' ') query_id, t from bad union select array_to_string(w, ' ') || ' ' || array_to_string(w, ' '), list_concat(t, t) from bad where w[1] < w[2]),
    missed as (select * from asked where not exists (select 1 from part where list_has_all(string_split(p_name, ' '), t))),
    cand as (select token, word, levenshtein(token, word)::bigint d, freq, authority from (select distinct unnest(t) token from missed) k, voc
      where token = word or (length(token) >= 4 and substr(token, 1, 1) = substr(word, 1, 1) and levenshtein(token, word) between 1 and case when length(token) < 8 then 1 else 2 end)),
    lists as (select token, list({'a': -authority, 'd': d, 'f': -freq, 'w': word} order by authority desc, d, freq desc, word)[:5] items from cand group by 1),
    one as (select query_id, len(t) n, coalesce((select items from lists where token = t[1]), [{'a': 0, 'd': 0, 'f': 0, 'w': t[1]}]) a, coalesce((select items from lists where token = t[2]), [{'a': 0, 'd': 0, 'f': 0, 'w': t[2]}]) b,
      case when len(t) > 2 then 2 else 1 end times from missed),
    pairs as (select query_id, x, y, times from (select query_id, unnest(a) x, b, times from one), unnest(b) u(y)),
    two as (select query_id, [x, y] c from pairs where times = 1 union all
      select p.query_id, [p.x, p.y, q.x, q.y] from pairs p join pairs q on p.query_id = q.query_id where p.times = 2),
    ranked as (select query_id, [z.w for z in c] ws, row_number() over (partition by query_id order by list_sum([z.a for z in c]), list_sum([z.d for z in c]), list_sum([z.f for z in c]), array_to_string([z.w for z in c], ' ')) place from two),
    hit as (select * from ranked where place <= 25 and exists (select 1 from part where list_has_all(string_split(p_name, ' '), ws)))
    select query_id, array_to_string(arg_min(ws, place), ' ') suggestion from hit group by 1""",
)
def _(p):
    from civicframe.operators import suggest

    held = p.select(F.col("p_partkey").alias("doc"), F.explode(F.split("p_name", " ")).alias("word")).distinct()
    voc = held.groupBy("word").agg(n("freq")).withColumn("authority", F.length("word") % 2)
    names = p.select(F.split("p_name", " ").alias("w")).distinct()
    bad = names.withColumn("t", F.transform("w", lambda x: F.when(F.length(x) >= 5, F.concat(F.substring(x, 1, 2), F.substr(x, F.lit(4)))).otherwise(x)))
    once = bad.select(F.array_join("w", " ").alias("query_id"), F.col("t").alias("tokens"))
    twice = bad.where("w[0] < w[1]").select(F.array_join(F.concat("w", "w"), " ").alias("query_id"), F.concat("t", "t").alias("tokens"))
    return suggest.did_you_mean(once.unionByName(twice), voc, held)


@query("SRCH16_demand_report", "events", sql="select event_type, count(*) searches, count(distinct user_id) users, count(*) filter (where value < 10) zero from events group by 1")
def _(e):
    return e.groupBy("event_type").agg(n("searches"), F.countDistinct("user_id").alias("users"), F.count_if(F.col("value") < 10).alias("zero"))


@query("ENT1_versioned_upsert", "part", sql="select p_partkey id, p_name body, case when p_partkey % 2 = 0 then 4 else 1 end as version, case when p_partkey % 2 = 0 then 'old' else 'new' end created_at from part where p_partkey % 3 = 0")
def _(p):
    stored = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), F.lit(3).alias("version"), F.lit("old").alias("created_at"))
    new = p.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("body"), F.lit("new").alias("created_at"), F.explode(F.array(F.lit(1), F.lit(2))).alias("position"))
    return upsert.versioned(stored, new, "id")


@query("ENT2_publisher_gate", "pages", sql="select split_part(url, '/', 4) lang, count(distinct array_to_string(string_split(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '.')[-2:], '.')) publishers, count(distinct array_to_string(string_split(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '.')[-2:], '.')) < 2 held from pages group by 1")
def _(p):
    return resolve.publisher_gate(p.withColumn("lang", F.split("url", "/")[3]), "lang", web.registrable_domain(web.host("url")), 2)


@query("ENT6_verdicts", "part", sql="""with s as (select p_brand mention, p_type entity, max(p_size / 50.0)::double score, bool_or(p_partkey % 11 = 0) veto from part group by 1, 2), m as (select *, row_number() over (partition by mention order by score desc, entity) place, max(score) over (partition by mention) top from s),
    r as (select *, count(*) filter (where score >= top - 0.05) over (partition by mention) rivals from m) select mention, entity, round(score, 4) score, case when score < 0.85 then 'NO_MATCH' when veto or rivals > 1 then 'REVIEW' else 'BIND' end verdict from r where place = 1""")
def _(p):
    scored = p.select(F.col("p_brand").alias("mention"), F.col("p_type").alias("entity"), (F.col("p_size") / 50).alias("score"), (F.col("p_partkey") % 11 == 0).alias("veto"))
    return resolve.verdicts(scored).withColumn("score", F.round("score", 4))


@query("ENT8_exact_pairs", "customer", "supplier", sql="""with c as (select regexp_replace(c_name, '[^0-9]', '', 'g') k, min(c_custkey) c_custkey from customer group by 1 having count(*) = 1), s as (select regexp_replace(s_name, '[^0-9]', '', 'g') k, min(s_suppkey) s_suppkey from supplier group by 1 having count(*) = 1) select c_custkey, s_suppkey from c join s using (k)""")
def _(c, s):
    key = lambda x: F.regexp_replace(x, "[^0-9]", "").alias("k")
    return graph.unique_pairs(c.select("c_custkey", key("c_name")), s.select("s_suppkey", key("s_name")), "c_custkey", "s_suppkey", "k").select("c_custkey", "s_suppkey")


@query("ENT8_near_pairs", "lineitem")
def _(li):
    # as many candidates as lines, few a docket
    scored = li.select(F.col("l_orderkey").alias("docket"), F.concat(F.lit("a"), F.col("l_partkey") % 4).alias("a"), F.concat(F.lit("b"), F.col("l_suppkey") % 4).alias("b"), (0.8 + F.col("l_discount").cast("double")).alias("score"))
    return resolve.best_first_pairs(scored, 0.015)


@query("ENT9_merge_fold", "orders", sql="select case when o_custkey % 10 = 0 then o_custkey + 1 else o_custkey end c, o_orderstatus, string_agg(distinct o_orderpriority, '; ' order by o_orderpriority) note, max(o_orderdate) verdict, count(*) folded from orders group by 1, 2")
def _(o):
    mapping = o.where("o_custkey % 10 = 0").select(F.col("o_custkey").alias("old"), (F.col("o_custkey") + 1).alias("new")).distinct()
    binds = o.select(F.col("o_custkey").alias("c"), "o_orderstatus", F.col("o_orderpriority").alias("note"), F.col("o_orderdate").alias("verdict"))
    return upsert.fold_collisions(binds, mapping, "c", ["o_orderstatus"], "note", "verdict")


_CHAIN = "with recursive t(id, target, hops) as (select p_partkey, p_partkey, 0 from part union all select id, target // 2, hops + 1 from t where target > 1 and hops < 16)"


@query("ENT10_chain", "part", sql=f"{_CHAIN} select id, arg_max(target, hops) target, max(hops)::int hops from t group by 1")
def _(p):
    nodes = p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") > 1, F.expr("p_partkey div 2")).alias("next"))
    return graph.resolve_chain(nodes, 16)


@query("ENT12_nearest_ancestor", "part", sql=f"{_CHAIN} select id, arg_min(target, hops) ancestor from t where target % 3 = 0 or target = 1 group by 1")
def _(p):
    found = lambda x: (x % 3 == 0) | (x == 1)
    above = lambda x: F.when(x > 1, F.shiftright(x, 1))
    places = p.select(F.col("p_partkey").alias("id")).distinct()
    return places.select("id", graph.nearest(F.col("id"), above, found, 16).alias("ancestor")).where("ancestor is not null")


@query("ENT16_rule_battery", "orders", sql="""select o_orderkey, ((o_totalprice > 1000)::int * 3 + (o_orderstatus <> 'P')::int * 2 + (o_orderpriority <> '5-LOW')::int) * 100 / 6.0::double score, concat_ws(',', case when not o_totalprice > 1000 then 'small' end, case when not o_orderstatus <> 'P' then 'pending' end, case when not o_orderpriority <> '5-LOW' then 'low' end) issues from orders""")
def _(o):
    rules = {"small": (F.col("o_totalprice") > 1000, 3), "pending": (F.col("o_orderstatus") != "P", 2), "low": (F.col("o_orderpriority") != "5-LOW", 1)}
    points = F.lit(0)
    for fine, weight in rules.values():
        points = points + fine.cast("int") * weight
    return o.select("o_orderkey", (points * 100 / F.lit(6.0).cast("double")).alias("score"), F.concat_ws(",", *(F.when(~fine, k) for k, (fine, _) in rules.items())).alias("issues"))


@query("STM1_overlap_dedup", "events", sql="select event_type, count(*) n from events group by 1")
def _(e):
    twice = e.unionByName(e.where("event_id % 2 = 0"))
    env = ev.envelope(twice, F.concat(F.lit("court."), F.col("event_type")), F.concat_ws(":", "event_type", "event_id"), F.col("ts"), ["user_id"])
    return ev.deduplicated(env).groupBy(F.substring_index("subject", ".", -1).alias("event_type")).agg(n())


@query("STM3_window_totals", "events", sql="select date_trunc('hour', ts) as start, 'court.' || event_type subject, count(*) n from events group by 1, 2")
def _(e):
    env = e.select(F.col("ts").alias("occurred_at"), F.concat(F.lit("court."), F.col("event_type")).alias("subject"))
    return ev.window_totals(env, "1 hour")


@query("STM5_routing", "events", sql="select count(*) filter (where event_type = 'click') exact, count(*) one, 0::bigint none from events")
def _(e):
    s = F.concat(F.lit("court."), F.col("event_type"))
    return e.agg(F.count_if(ev.routed(s, "court.click")).alias("exact"), F.count_if(ev.routed(s, "court.*") & ev.routed(s, "court.>")).alias("one"), F.count_if(ev.routed(s, "court.*.x") | ev.routed(s, "court.click.>")).alias("none"))


@query("STM7_disposition", "events", sql="""select event_id, case when event_type <> 'error' then 'ack' when value > 90 then 'dead_letter' when user_id % 5 = 0 then 'dead_letter' when user_id % 5 >= 4 then 'dead_letter' else 'retry' end disposition from events""")
def _(e):
    rows = e.select("event_id", (F.col("event_type") == "error").alias("error"), (F.col("value") > 90).alias("poison"), F.nullif((F.col("user_id") % 5).cast("int"), F.lit(0)).alias("delivered"))
    return ev.split(rows, 4).select("event_id", "disposition")


@query("STM8_retention", "events", sql="select event_type, count(*) n from events where ts >= (select max(ts) from events) - case when event_type = 'click' then interval 7 day else interval 365 day end group by 1")
def _(e):
    now = e.agg(F.max("ts").alias("now"))
    env = e.withColumn("occurred_at", F.col("ts")).withColumn("subject", F.concat(F.col("event_type"), F.lit(".x"))).join(F.broadcast(now), F.lit(True))  # a row of one time
    return ev.retained(env, F.col("now"), {"click": 7}, 365).groupBy("event_type").agg(n())


#: What the event types stand for.
_JOB_EVENT = {"signup": "enqueue", "click": "claim", "view": "heartbeat", "purchase": "done", "error": "retry"}


@query(
    "STM10_job_fold",
    "events",
    sql=f"""
    with recursive e as (
      select user_id::varchar job, epoch_us(ts) t, event_type k, row_number() over (partition by user_id order by ts, event_id) i from events where user_id is not null and ts is not null),
    f as (
      select job, 0::bigint i, '' status, 0 attempts, 0::bigint due, 0::bigint lease, 0 jobs, 0 duplicates, 0 stale from (select distinct job from e)
      union all
      select job, i, case when act = 'new' then 'queued' when act = 'run' then 'running' when act = 'end' then 'done' when act = 'back' then 'queued' when act = 'die' then 'dead' else s end,
        case when act = 'new' then 0 when act = 'run' then a + 1 else a end,
        case when act = 'new' then t when act = 'back' then t + delay else d end,
        case when act in ('run', 'beat') then t + 3600000000 * 24 when act in ('end', 'back', 'die') then 0 else l end,
        jobs + (act = 'new')::int, duplicates + (act = 'dup')::int, stale + (act = 'stale')::int
      from (select *, case
          when k = 'signup' and s in ('queued', 'running') then 'dup' when k = 'signup' then 'new'
          when k = 'click' then case when s = 'queued' and d <= t then 'run' else '' end
          when k in ('view', 'purchase', 'error') and s <> 'running' then 'stale'
          when k = 'view' then 'beat' when k = 'purchase' then 'end'
          when k = 'error' then case when a < 3 then 'back' else 'die' end else '' end act
        from (select f.job, e.i, e.k, e.t, f.attempts a, jobs, duplicates, stale,
            case when f.attempts = 1 then 60 when f.attempts = 2 then 300 when f.attempts = 3 then 900 else 1800 end * 1000000::bigint delay,
            case when status = 'running' and lease < t then case when f.attempts < 3 then 'queued' else 'dead' end else status end s,
            case when status = 'running' and lease < t then lease + delay else due end d,
            case when status = 'running' and lease < t then 0 else lease end l
          from f join e on e.job = f.job and e.i = f.i + 1)))
    select job, arg_max(status, i) status, arg_max(attempts, i) attempts, arg_max(jobs, i) jobs, arg_max(duplicates, i) duplicates, arg_max(stale, i) stale from f group by 1""",
)
def _(e):
    from civicframe.streaming.jobs import job_states

    kind = F.element_at(F.create_map(*(F.lit(x) for p in _JOB_EVENT.items() for x in p)), F.col("event_type"))
    rows = e.select(F.col("user_id").cast("string").alias("job"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), F.coalesce(kind, F.lit("other")).alias("event"))
    return job_states(rows, lease=86_400).select("job", "status", "attempts", "jobs", "duplicates", "stale")


@query("STM11_staging", "lineitem", "orders", sql="select l_orderkey, l_linenumber from lineitem where l_discount >= 0.08 and l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'F')")
def _(li, o):
    done = o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return li.where("l_discount >= 0.08").join(done, "l_orderkey", "left_anti").select("l_orderkey", "l_linenumber")


@query("PIPE2_deciding_row", "lineitem", "orders", sql="select l_orderkey, arg_min(l_suppkey, row(case l_linestatus when 'F' then 0 else 1 end, l_linenumber, l_suppkey)) judge from lineitem join orders on o_orderkey = l_orderkey where l_shipdate >= o_orderdate group by 1")
def _(li, o):
    j = li.join(o, li.l_orderkey == o.o_orderkey).where("l_shipdate >= o_orderdate")
    return j.groupBy("l_orderkey").agg(F.min_by("l_suppkey", F.struct((F.col("l_linestatus") != "F").cast("int"), "l_linenumber", "l_suppkey")).alias("judge"))


@query("PIPE7_crawl_frontier", "orders", sql="select d::date as day from (select unnest(generate_series(max(o_orderdate)::date - interval 60 day, max(o_orderdate)::date, interval 1 day)) d from orders) where d::date not in (select o_orderdate::date from orders where o_orderpriority = '1-URGENT')")
def _(o):
    last = F.to_date(F.max("o_orderdate"))
    days = o.agg(F.sequence(F.date_sub(last, 60), last).alias("s")).select(F.explode("s").alias("day"))
    return days.join(o.where("o_orderpriority = '1-URGENT'").select(F.to_date("o_orderdate").alias("day")), "day", "left_anti")


@query("PIPE8_failure_states", "orders", sql="select o_orderstatus, case when o_orderstatus = 'F' then 'done' when o_orderpriority = '5-LOW' then 'deferred' when o_orderpriority = '1-URGENT' then 'failed' else 'retry' end as state, count(*) n from orders group by 1, 2")
def _(o):
    p = F.col("o_orderpriority")
    return o.groupBy("o_orderstatus", dom.ladder((F.col("o_orderstatus") == "F", "done"), (p == "5-LOW", "deferred"), (p == "1-URGENT", "failed"), otherwise="retry").alias("state")).agg(n())


@query("PIPE12_exact_copies", "documents", sql="select sha256(text) h, min(doc_id) survivor, count(*) copies from documents where text is not null group by 1 having count(*) > 1")
def _(d):
    return d.where("text is not null").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("survivor"), n("copies")).where("copies > 1")


@query(
    "PIPE12_copies_removed",
    "documents",
    sql="""
    with d as (select doc_id id, text, lang title, doc_id % 11 = 3 deleted from documents),
    g as (select text, min(id) survivor from d where text is not null group by 1),
    p as (select id, survivor from d join g using (text) where id <> survivor union all select id, id - id % 5 from d where id % 5 = 4),
    w as (select id, min(survivor) survivor from p group by 1)
    select w.id, w.survivor, case when a.deleted then 'gone' when b.id is null or b.deleted then 'no survivor' when w.survivor in (select id from w) then 'survivor goes too'
      when a.title is distinct from b.title then 'title' when coalesce(a.text, '') = '' or a.text is distinct from b.text then 'text' else 'deleted' end as action
    from w join d a on a.id = w.id left join d b on b.id = w.survivor""",
)
def _(d):
    from civicframe.operators.documents import copies_removed

    docs = d.select(F.col("doc_id").alias("id"), F.col("lang").alias("title"), "text", (F.col("doc_id") % 11 == 3).alias("deleted"))
    mark = F.sha2(F.col("text").cast("binary"), 256)
    first = docs.where("text is not null").groupBy(mark.alias("mark")).agg(F.min("id").alias("survivor"))
    copies = docs.where("text is not null").select("id", mark.alias("mark")).join(first, "mark").where("id <> survivor").select("id", "survivor")
    wrong = docs.where("id % 5 = 4").select("id", (F.col("id") - F.col("id") % 5).alias("survivor"))
    return copies_removed(docs, copies.unionByName(wrong))


@query(
    "SRC1_ordered_scan",
    "lineitem",
    sql="""select l_orderkey, l_linenumber, l_partkey, row_number() over (order by l_orderkey, l_linenumber, l_partkey) place,
    row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) ordinal from lineitem""",
)
def _(li):
    from civicframe.sources.readers import in_order

    return in_order(li.select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey", ["l_linenumber", "l_partkey"])


@query("SRC2_shards", "lineitem", sql="select l_returnflag, count(*) n, count(distinct l_orderkey) orders from lineitem group by 1")
def _(li):
    from civicframe.sources.readers import shards
    from civicframe.storage import shared_path

    folder = shared_path(li.sparkSession, "dataset")
    li.select("l_orderkey", "l_returnflag").repartition(4).write.parquet(f"{folder}/lines")
    return shards(li.sparkSession, folder, "lines").groupBy("l_returnflag").agg(n(), F.countDistinct("l_orderkey").alias("orders"))


@query("SRC7_json_lines", "events", sql="select event_id, event_type from events where event_id % 7 <> 0")
def _(e):
    from civicframe.sources.readers import json_lines
    from civicframe.storage import shared_path

    path, line = shared_path(e.sparkSession, "lines"), F.to_json(F.struct("event_id", "event_type"))
    e.select(F.when(F.col("event_id") % 7 == 0, F.substr(line, F.lit(1), F.length(line) - 3)).otherwise(line)).write.text(path)
    return json_lines(e.sparkSession, path, "event_id long, event_type string")


@query("SRC8_unseen", "orders", sql="select o_orderkey from orders where o_orderkey % 3 <> 0 or o_orderstatus <> 'F'")
def _(o):
    from civicframe.sources.readers import json_lines, unseen
    from civicframe.storage import shared_path

    cache = shared_path(o.sparkSession, "cache")
    o.where("o_orderkey % 3 = 0 and o_orderstatus = 'F'").select(F.to_json(F.struct("o_orderkey"))).write.text(cache)
    return unseen(json_lines(o.sparkSession, cache, "o_orderkey long"), o.select("o_orderkey"), "o_orderkey")


@query("SRC10_batch_slugs", "part", sql="with s as (select p_name slug, min(p_partkey) k from part group by 1) select slug, row_number() over (order by k) as position from s")
def _(p):
    from civicframe.sources.readers import batch_slugs
    from civicframe.storage import shared_path

    path = shared_path(p.sparkSession, "batch")
    p.orderBy("p_partkey").select(F.concat(F.lit("  "), "p_name", F.lit(" ")).alias("slug")).write.option("header", "true").csv(path)
    return batch_slugs(p.sparkSession, path)


@query("STR19_mojibake", "documents", sql="select doc_id, sha256(coalesce(text, '')) body from documents")
def _(d):
    garbled = F.decode(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), "ISO-8859-1")
    return d.select("doc_id", F.sha2(tx.repaired_mojibake(garbled), 256).alias("body"))


@query("STR29_cells", "part", sql="select p_partkey, p_name || ', मा.' || p_brand judges, p_name || ' (' || p_type || ')' label, p_size n from part")
def _(p):
    cells = p.select("p_partkey", F.concat("p_name", F.lit("मा."), "p_brand").alias("j"), F.concat("p_name", F.lit("( "), "p_type", F.lit(" )")).alias("l"), F.concat(F.translate(F.col("p_size").cast("string"), "0123456789", "०१२३४५६७८९"), F.lit(" जना")).alias("c"))
    return cells.select("p_partkey", tx.split_judges("j").alias("judges"), tx.spaced_parentheses("l").alias("label"), tx.counted("c").alias("n"))


@query("SRC5_children", "orders", "lineitem", sql="select o_orderkey, string_agg(l_partkey::varchar, ',' order by l_linenumber, l_partkey) parts from orders join lineitem on l_orderkey = o_orderkey group by 1")
def _(o, li):
    kids = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    return o.join(li, o.o_orderkey == li.l_orderkey).groupBy("o_orderkey").agg(F.array_join(F.transform(kids, lambda x: x["l_partkey"].cast("string")), ",").alias("parts"))


@query("SRC12_title", "pages", sql="select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) title, regexp_extract(html, 'lang=\"([a-z]+)\"', 1) lang from pages")
def _(p):
    return p.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("lang"))
