"""Queries over scripts, names, evidence, places, drafts and intents; they extend ``plans.catalog``.

The driver's tables hold no such records: the inputs are made from their columns, and the SQL states what has to come out.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from civicframe.functions import evidence, names, scripts, web
from civicframe.operators import casework, decisions, documents, places
from civicframe.operators.rules import Rules

from .catalog import query

# -- scripts and names -----------------------------------------------------------------------------------------------------


@query("STR14_round_trip", "part", sql="select p_partkey, lower(p_name) latin, true other_script from part")
def _(p):
    there = scripts.to_devanagari("p_name")
    return p.select("p_partkey", scripts.to_roman(there).alias("latin"), there.rlike("[ऀ-ॿ]").alias("other_script"))


@query("STR14_colloquial", "part", sql="""select p_partkey, case when kept = dropped then kept else kept || ' ' || dropped end spelt from (select p_partkey, lower(p_name) kept,
    array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: case when length(w) > 2 and w like '%a' then left(w, length(w) - 1) else w end), ' ') dropped from part)""")
def _(p):
    return p.select("p_partkey", scripts.to_roman_colloquial(scripts.to_devanagari("p_name")).alias("spelt"))


@query("STR30_title_translit", "nation", sql="""select n_nationkey, case n_nationkey % 3 when 0 then 'bharata bharata bharat' when 2 then 'bharata bharata bharat भरत Bharata' else case when n_nationkey % 2 = 0 then 'भरत Bharata' else null end end translit from nation""")
def _(n):
    k = F.col("n_nationkey")
    ne, en = F.when(k % 3 != 1, "भरत"), F.when((k % 3 == 2) | ((k % 3 == 1) & (k % 2 == 0)), "Bharata")
    return n.select("n_nationkey", scripts.title_translit(ne, en).alias("translit"))


@query("STR9_register_fold", "part", sql="select p_partkey, case p_partkey % 3 when 0 then 'बालबिबाह' when 1 then 'मानबबेचबिखन' else '' end folded from part")
def _(p):
    k = F.col("p_partkey")
    text = F.when(k % 3 == 0, F.concat(F.col("p_name"), F.lit(" वाल‍विवाह (1)"))).when(k % 3 == 1, F.concat(F.lit("मानव- बेच विखन "), "p_type")).otherwise(F.col("p_name"))
    return p.select("p_partkey", names.register_fold(text).alias("folded"))


@query("STR11_anonymised", "customer", sql="select c_custkey, c_custkey % 4 in (1, 3) hidden from customer")
def _(c):
    cell = F.expr("case c_custkey % 4 when 0 then 'एक्स को हाल परिवर्तित नाम वाई प्रा. लि.' when 1 then 'परिवर्तित नाम पोखरा 12' when 2 then c_name else 'हाल परिवर्तित नाम क कम्पनी, परिवर्तित  नाम काठमाडौं ५' end")
    return c.select("c_custkey", names.anonymised_party("c_name", cell).alias("hidden"))


@query("STR17_name_key", "customer", sql="select c_custkey, case c_custkey % 3 when 0 then 'गुरुङ' else 'बहादुर' end || regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g') as key from customer")
def _(c):
    made = F.expr("case c_custkey % 3 when 0 then concat('गुरुङ्ग ', c_name) when 1 then concat('डा. वहादूर', c_name, ' समेत ६४') else concat('बहादुर-', c_name) end")
    return c.select("c_custkey", names.name_key(made).alias("key"))


_SKELETON = "translate(regexp_replace(lower(p_name), '[^a-z]|[aeiou]', '', 'g'), 'w', 'v')"
for _letter in "bcdfghjklmnpqrstvxyz":
    _SKELETON = f"regexp_replace({_SKELETON}, '{_letter}+', '{_letter}', 'g')"


@query("STR17_skeleton", "part", sql=f"select p_partkey, {_SKELETON} skeleton from part")
def _(p):
    return p.select("p_partkey", names.name_skeleton("p_name", ("w", "v")).alias("skeleton"))


@query("ENT5_match_score", "customer", sql="""select c_custkey, case c_custkey % 6 when 0 then 1.0 when 1 then 0.96 when 2 then 0.95 when 3 then 0.0 when 4 then 0.0 else 0.8 end score from customer""")
def _(c):
    left = F.expr("case c_custkey % 6 when 0 then 'राम बहादुर थापा' when 1 then 'Bharat Thap' when 2 then 'राम थापा' when 3 then 'कमल थापा' when 4 then 'कृष्ण राम' else 'राम थापा' end")
    right = F.expr("case c_custkey % 6 when 0 then 'राम  बहादुर थापाः' when 1 then 'थप भरत' when 2 then 'राम बहादुर थापा' when 3 then 'कमला थापा' when 4 then 'राम कृष्ण' else 'राम बहादुर कुमार थापा' end")
    tokens = lambda x: names.name_tokens(x, variants=[("thap", "thapa")])
    return c.select("c_custkey", names.match_score(tokens(left), tokens(right), surnames=["थापा", "thapa"], particles=["बहादुर", "कुमार"]).alias("score"))


@query("ENT7_vetoes", "customer", sql="select c_custkey, case c_custkey % 4 when 0 then 'composite' when 1 then 'single token' when 2 then 'generic' end veto, case c_custkey % 3 when 0 then 'province not named' when 1 then 'unknown province' end province from customer")
def _(c):
    name = F.expr("case c_custkey % 4 when 0 then 'Road works - Bara' when 1 then 'Thapa.' when 2 then 'District Office' else c_name || ' of Bara' end")
    where = F.expr("case c_custkey % 3 when 0 then 'gandaki' when 1 then 'nowhere' end")
    return c.select("c_custkey", names.name_veto(name, ["district", "office"]).alias("veto"), names.province_veto(name, where, {"gandaki": ["गण्डकी", "gandaki"]}).alias("province"))


@query(
    "ENT6_ladder",
    "part",
    sql="""
    with d as (select p_name, string_split(p_name, ' ')[1] w1, min(p_partkey) k from part group by 1, 2),
    ents as (
        select 'e:' || p_name entity, p_name title, w1, k from d
        union all select 'o:' || p_name, p_name || ' office', w1, k from d
        union all select 'f:' || p_name, p_name || ' office parsa', w1, k from d where k % 2 = 0
        union all select 's:' || w1, w1, w1, min(k) from d group by w1),
    edges as (select w1, min(k % 3) low from ents group by 1),
    m as (
        select p_partkey, string_split(p_name, ' ')[1] w1,
            case p_partkey % 5 when 1 then string_split(p_name, ' ')[1] when 2 then p_name || ' office' when 3 then string_split(p_name, ' ')[1] || ' zzz' else p_name end title
        from part),
    r as (
        select p_partkey as mention, entity,
            case when entity is null then 'below the threshold' when p_partkey % 2 = 1 and low >= k % 3 then 'search cut' when p_partkey % 5 = 1 then 'single token'
                when p_partkey % 5 = 2 and k % 2 = 0 then 'unqualified organisation' when k % 4 = 0 then 'record not read' when k % 4 = 1 then 'election record' end reason
        from m left join ents using (title, w1) left join edges using (w1))
    select mention, case when reason is null then entity end entity, entity as best, case when entity is null then 'NO_MATCH' when reason is null then 'BIND' else 'REVIEW' end verdict, reason
    from r""",
)
def _(p):
    """Names of parts, some cut, qualified or with a particle, against what a search for their first word gives."""
    first = F.split("p_name", " ")[0]
    d = p.groupBy("p_name", first.alias("w1")).agg(F.min("p_partkey").alias("k"))
    of = lambda df, tag, name, title: df.select(F.concat(F.lit(tag), name).alias("entity"), title.alias("title"), "w1", "k")
    name = F.col("p_name")
    entities = of(d, "e:", name, name).unionByName(of(d, "o:", name, F.concat(name, F.lit(" office")))).unionByName(of(d.where("k % 2 = 0"), "f:", name, F.concat(name, F.lit(" office parsa"))))
    entities = entities.unionByName(of(d.groupBy("w1").agg(F.min("k").alias("k")), "s:", F.col("w1"), F.col("w1")))
    k = F.col("p_partkey") % 5
    said = F.when(k == 1, first).when(k == 2, F.concat(name, F.lit(" Office."))).when(k == 3, F.concat(first, F.lit(" zzz"))).when(k == 4, F.replace(name, F.lit(" "), F.lit(" old "))).otherwise(name)
    mentions = p.select(F.col("p_partkey").alias("mention"), said.alias("name"), (F.col("p_partkey") % 2 == 0).alias("complete"), first.alias("w1"))
    election = F.when(F.col("k") % 4 == 1, True).when(F.col("k") % 4 > 1, False)
    found = mentions.select("mention", "w1").join(entities, "w1").select(
        "mention", "entity", F.array("title").alias("titles"), (F.col("k") % 3).cast("double").alias("relevance"), F.lit(False).alias("coded"), F.lit(None).cast("string").alias("province"), election.alias("election")
    )
    return decisions.decided(mentions, found, decisions.Lexicon(particles=["old"], generic=["office"])).select("mention", "entity", "best", "verdict", "reason")


@query("STR21_publisher", "documents", sql="select doc_id, case when doc_id % 2 = 0 then lower(trim(source)) when doc_id % 3 = 0 then 'moha.gov.np' end publisher from documents")
def _(d):
    even = F.col("doc_id") % 2 == 0
    url = F.when(F.col("doc_id") % 3 == 0, "https://WWW.news.moha.gov.np/a?b")
    return d.select("doc_id", web.publisher_key(F.when(even, F.concat(F.lit(" "), "source")), url).alias("publisher"))


@query("ENT4_canonical_id", "customer", sql="select c_custkey, case when c_custkey % 5 > 0 then 'https://registry.example/entity/person/c-' || c_custkey end iri from customer")
def _(c):
    raw = F.expr("concat(case c_custkey % 2 when 0 then 'http://other.example' else 'https://registry.example' end, case c_custkey % 5 when 0 then '/entity/Person/' else '/entity/person/' end, 'c-', c_custkey)")
    return c.select("c_custkey", web.canonical_iri("https://registry.example/", raw).alias("iri"))


# -- evidence --------------------------------------------------------------------------------------------------------------

@query("STR23_verbatim", "documents", sql="select doc_id, 'as planted' as kind from documents")
def _(d):
    planted = "the registrar recorded on that day that the sum of nine lakh was paid in cash"
    body = F.concat_ws(" ", "text", F.lit(planted.replace(" ", "  ") + "."))
    tail = F.concat(F.lit(planted + " qzx"), F.col("doc_id").cast("string"), F.lit("qzx to the clerk"))
    whole, part, short = (evidence.verbatim_quote(x, body) for x in (F.lit(planted), tail, F.lit("the sum")))
    ok = (whole == planted) & (part == planted) & (short == "")
    return d.select("doc_id", F.when(ok, "as planted").otherwise("lost").alias("kind"))


@query("PIPE20_page_states", "documents", sql="""select doc_id, case doc_id % 4 when 0 then 'unread' when 1 then 'unread' when 2 then 'blank' else case when length(trim(coalesce(text, ''))) > 0 then 'anchored' else 'blank' end end state,
    case when doc_id % 4 in (1, 2) or length(trim(coalesce(text, ''))) = 0 then '' when doc_id % 3 = 0 then 'suspect' else 'tight' end fidelity from documents""")
def _(d):
    k = F.col("doc_id")
    text = F.when(~(k % 4).isin(1, 2), F.col("text"))
    return d.select("doc_id", evidence.coverage(text, k % 4 == 1, k % 4 == 0).alias("state"), evidence.fidelity(text, k % 3 == 0).alias("fidelity"))


@query("PIPE20_verdicts", "lineitem", sql="""select l_orderkey, case when not bool_or(l_quantity > 5) then 'unread' when bool_or(l_returnflag = 'R') then 'partial' else 'clean' end verdict from lineitem group by 1""")
def _(li):
    pages = li.select("l_orderkey", F.when(F.col("l_quantity") > 5, "x").otherwise(" ").alias("text"), F.when(F.col("l_returnflag") == "R", "unread").otherwise("anchored").alias("state"))
    return evidence.transcript_verdicts(pages, "l_orderkey")


@query("PIPE16_public_media", "orders", sql="""select o_orderkey, case when o_orderkey % 2 = 0 then 1 else 2 end public, case when o_orderkey % 2 = 0 then 1 else 0 end withheld from orders""")
def _(o):
    link = lambda role, url: F.struct(role.alias("role"), url.alias("url"))
    ours, theirs = F.lit("https://ours.example/a"), F.lit("https://ministry.example/a")
    k = F.col("o_orderkey")
    second = F.when(k % 4 == 1, "transcript").otherwise("redacted")
    media = F.array(link(F.lit("original"), F.when(k % 4 == 3, theirs).otherwise(ours)), link(second, ours))
    made = evidence.public_media(media, {"original": "redacted"}, "https://ours.example/")
    return o.select("o_orderkey", F.size(made["public"]).alias("public"), made["withheld"].alias("withheld"))


# -- places ----------------------------------------------------------------------------------------------------------------


@query("ENT13_places", "customer", "nation", "region", sql="""select c_custkey, 'u' || c_nationkey as unit, 'd' || n_regionkey as district, null::varchar reason from customer join nation on c_nationkey = n_nationkey where c_custkey % 3 = 0
    union all select c_custkey, null, null, 'claim not named' from customer join nation on c_nationkey = n_nationkey where c_custkey % 3 = 1 union all select c_custkey, null, 'd' || n_regionkey, null from customer join nation on c_nationkey = n_nationkey where c_custkey % 3 = 2""")
def _(c, n, r):
    districts = r.select(F.concat(F.lit("d"), "r_regionkey").alias("iri"), F.lit("district").alias("kind"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"))
    units = n.select(F.concat(F.lit("u"), "n_nationkey"), F.lit("unit"), F.concat(F.lit("d"), "n_regionkey"), F.col("n_name"))
    k = F.col("c_custkey")
    rows = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    mentions = rows.select(
        "c_custkey", F.when(k % 3 == 0, F.concat_ws(", ", F.lit("ward 4 of"), "n_name")).when(k % 3 == 2, F.concat(F.lit("in "), F.lower("r_name"))).otherwise("somewhere").alias("place"),
        F.when(k % 3 == 1, F.col("r_name")).alias("claim"), F.lit("no place here").alias("evidence"),
    )
    return places.resolved_places(mentions, "c_custkey", districts.unionByName(units.toDF(*districts.columns)))


@query("ENT14_court_places", "supplier", sql="select s_suppkey, case when s_suppkey % 4 = 0 then 'D1' end district, case s_suppkey % 4 when 0 then 'P1' when 1 then 'P2' when 2 then 'national' end province from supplier")
def _(s):
    spark = s.sparkSession
    courts = s.select("s_suppkey", F.expr("case s_suppkey % 4 when 0 then 'd1dc' when 1 then 'd2hc' when 2 then 'supreme' else 'moot' end").alias("court"))
    made = places.court_places(courts, "court", spark.createDataFrame([("d1dc", "D1")], "court string, district string"), spark.createDataFrame([("d2hc", "D2")], "court string, district string"), spark.createDataFrame([("D1", "P1"), ("D2", "P2")], "district string, province string"), ["supreme"])
    return made.drop("court")


# -- drafts, records, intents ----------------------------------------------------------------------------------------------


@query("PIPE5_created", "orders", sql="select o_orderkey, o_custkey from orders where o_orderkey % 3 <> 0 and o_orderpriority <> '5-LOW'")
def _(o):
    rows = o.select("o_orderkey", "o_custkey", "o_orderpriority")
    return casework.created_when_absent(o.where("o_orderkey % 3 = 0").select("o_orderkey"), rows.unionByName(rows), ["o_orderkey"], F.col("o_orderpriority") != "5-LOW").drop("o_orderpriority")


@query("PIPE9_draft_imports", "orders", sql="""with first as (select o_custkey, min(o_orderkey) f from orders where o_orderkey % 7 <> 0 group by 1) select o_orderkey, case when o_orderkey % 7 = 0 then 'failed' when o_custkey % 5 = 0 then 'skipped' when o_orderkey <> f then 'skipped' else 'created' end status,
    o_orderkey % 2 = 0 truncated from orders left join first using (o_custkey)""")
def _(o):
    number = F.lpad(F.col("o_orderkey").cast("string"), 12, "0")
    drafts = o.select(
        "o_orderkey", number.alias("case_no"), F.when(F.col("o_orderkey") % 7 != 0, "t").otherwise(" ").alias("case_title"), F.array(F.col("o_custkey").cast("string"), number).alias("dockets"),
        F.when(F.col("o_orderkey") % 4 == 0, "राम समेत ३").when(F.col("o_orderkey") % 2 == 0, "राम समेत").otherwise("राम").alias("defendant"), F.array(F.lit("राम")).alias("names"),
    )
    held = o.where("o_custkey % 5 = 0").select(F.col("o_custkey").cast("string").alias("docket"))
    return casework.draft_imports(drafts, held).select("o_orderkey", "status", "truncated")


@query("PIPE10_promotions", "orders", "customer", sql="""select o_orderkey, (1 + o_orderkey % 3)::bigint publishers, o_custkey % 2 = 0 contractor, o_custkey % 2 = 0 or o_orderkey % 3 > 0 promoted from orders where o_custkey in (select c_custkey from customer)""")
def _(o, c):
    source = lambda a, u: F.struct(a.alias("authority"), u.alias("url"))
    none = F.lit(None).cast("string")
    given = F.array(source(F.lit(" PPMO "), none), source(F.lit("ppmo"), none), F.when(F.col("o_orderkey") % 3 > 0, source(none, F.lit("https://A.example/x"))), F.when(F.col("o_orderkey") % 3 > 1, source(F.lit(""), F.lit("http://b.example"))))
    ids = F.array(F.struct(F.lit("PAN No").alias("kind"), F.concat(F.lit("no. "), F.col("o_custkey").cast("string")).alias("value")), F.struct(F.lit("phone").alias("kind"), F.lit("1").alias("value")))
    held = o.join(c.select(F.col("c_custkey").alias("o_custkey")), "o_custkey").select(F.col("o_orderkey").alias("id"), ids.alias("identifiers"), F.array_compact(given).alias("sources"))
    return casework.contractor_promotions(held, c.where("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("number")), 2).withColumnRenamed("id", "o_orderkey")


@query("PIPE14_seeded", "part", sql="select 'p' || p_partkey as id, 'p' || p_partkey * 3 as broader, case when p_partkey % 3 = 0 then 'kept' when p_partkey % 3 = 1 then 'created' else 'updated' end as action, p_partkey * 3 not in (select p_partkey from part) dangling from part")
def _(p):
    tag = lambda df, label: df.select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.concat(F.lit("p"), F.col("p_partkey") * 3).alias("broader"), F.lit(label).alias("label_en"))
    return casework.seeded(tag(p.where("p_partkey % 3 <> 1"), "old"), tag(p.where("p_partkey % 3 > 0"), "new")).select("id", "broader", "action", "dangling")


@query("PIPE14_alias_conflicts", "part", sql="select lower(p_type) as key, list_sort(list(distinct 'p' || p_partkey)) as tags from part group by 1 having count(distinct p_partkey) > 1")
def _(p):
    label = F.concat(F.lit("label "), "p_partkey")
    entries = p.select(F.concat(F.lit("p"), "p_partkey").alias("id"), label.alias("label_en"), label.alias("label_ne"), F.array("p_type", F.concat(F.lit("("), "p_type", F.lit(")"))).alias("aliases"))
    return casework.alias_conflicts(entries)


@query("PIPE15_stale", "documents", sql="""select 'm' || doc_id as iri, doc_id % 5 = 0 or doc_id % 5 = 1 and doc_id % 7 > 0 as stale, (doc_id % 5 = 0 or doc_id % 5 = 1 and doc_id % 7 > 0) and not (doc_id % 3 = 0) as queue from documents""")
def _(d):
    k = F.col("doc_id")
    iri, digest = F.concat(F.lit("m"), "doc_id"), F.when(k % 7 > 0, F.sha2(k.cast("string"), 256))
    held = d.where("doc_id % 5 > 0").select(iri.alias("iri"), F.when(k % 5 == 1, "sha256:0").otherwise(F.concat(F.lit("sha256:"), digest)).alias("revision"))
    return casework.stale_content(d.select(iri.alias("iri"), digest.alias("sha256")), held, d.where("doc_id % 3 = 0").select(iri.alias("iri"), digest.alias("sha256")))


@query("PIPE18_mapped_files", "pages", sql="""select page_id, case when page_id % 3 > 0 then page_id end id, case when page_id % 3 = 0 then 'no id' when page_id % 5 = 0 then 'unknown' else 'mapped' end verdict from pages""")
def _(p):
    k = F.col("page_id")
    files = p.select(F.concat(F.lit("/runs/press-9/"), F.when(k % 3 > 0, F.concat(F.lit("press-release-"), k.cast("string"))).otherwise(F.concat(F.lit("note-"), k.cast("string"))), F.lit(".md")).alias("path"))
    made = casework.mapped_files(files, p.where("page_id % 5 > 0").select(k.alias("id"), "url"), r"press-release-(\d+)")
    return made.select(F.regexp_extract("path", r"-(\d+)\.md$", 1).cast("long").alias("page_id"), "id", "verdict")


_BINDS = "select o_custkey case_id, o_orderkey iri, o_orderpriority <> '5-LOW' accused from orders"


@query("PIPE19_intents", "orders", sql=f"""with b as ({_BINDS}) select case_id as intent, case when case_id % 4 = 0 then 'outcome' when not bool_and(accused) then 'not accused' end problem from b group by 1""")
def _(o):
    binds = o.select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("iri"), F.when(F.col("o_orderpriority") != "5-LOW", "accused").otherwise("witness").alias("role"))
    wanted = F.struct("iri", F.when((F.col("case_id") % 4 == 0) & (F.col("iri") == F.col("least")), "charged").otherwise("convicted").alias("outcome"))
    least = binds.groupBy("case_id").agg(F.min("iri").alias("least"))
    intents = binds.join(least, "case_id").groupBy("case_id").agg(F.collect_list(wanted).alias("outcomes")).withColumn("intent", F.col("case_id"))
    return casework.outcome_intents(intents, binds)


@query("PIPE19_links", "lineitem", sql="""with f as (select l_orderkey case_id, l_partkey iri, min(l_linenumber) seq from lineitem where l_linenumber > 2 group by 1, 2), r as (select l_orderkey case_id, l_partkey iri, min(l_linenumber) ordinal from lineitem where l_linenumber <= 2 group by 1, 2)
    select case_id, iri, coalesce(m, 0) + row_number() over (partition by case_id order by seq, iri) as ordinal from f anti join r using (case_id, iri) left join (select case_id, max(ordinal) m from r group by 1) using (case_id)""")
def _(li):
    rows = li.select(F.col("l_orderkey").alias("case_id"), F.col("l_partkey").alias("iri"), F.col("l_linenumber").alias("seq"))
    held = rows.where("seq <= 2").groupBy("case_id", "iri").agg(F.min("seq").alias("ordinal"))
    return casework.material_links(rows.where("seq > 2"), held)


@query("SNK9_bulk_ingest", "customer", "orders", sql="""select c_custkey, case when c_custkey % 7 = 0 then 'malformed' when coalesce(n, 0) < 3 then 'held' else 'stored' end destination, case when c_custkey % 7 > 0 and coalesce(n, 0) >= 3 then case when c_custkey % 2 = 0 then 5 else 1 end end as version
    from customer left join (select o_custkey, count(distinct o_orderpriority) n from orders group by 1) on o_custkey = c_custkey""")
def _(c, o):
    base = "https://registry.example"
    raw = lambda k: F.when(k % 7 == 0, F.concat(F.lit("person "), k)).otherwise(F.concat(F.lit("http://x.example/entity/person/c"), k))
    k = F.col("c_custkey")
    at = F.lit("2024-01-01").cast("timestamp")
    stored = c.where("c_custkey % 2 = 0").select(F.concat(F.lit(f"{base}/entity/person/c"), k).alias("iri"), F.lit(4).alias("version"), at.alias("created_at"))
    incoming = c.select(raw(k).alias("raw_id"), F.lit(1).alias("position"), at.alias("created_at"))
    sources = o.select(raw(F.col("o_custkey")).alias("raw_id"), F.col("o_orderpriority").alias("publisher"))
    made = casework.ingested(stored, incoming, sources, base, 3)
    return made.select(F.regexp_extract("raw_id", r"(\d+)$", 1).cast("long").alias("c_custkey"), "destination", F.col("version").cast("int").alias("version"))


# -- search documents, telemetry, rules -------------------------------------------------------------------------------------


@query("SRCH11_corpus", "orders", "supplier", "documents", "customer", sql="""select 'case' as type, count(*) n, count(*) filter (where o_orderstatus = 'F') public, 0::bigint cited from orders union all select 'court', count(*), count(*), 0 from supplier
    union all select 'material', count(*), count(*) filter (where doc_id % 2 = 0), 0 from documents union all select 'entity', count(*), count(*) filter (where n > 0), sum(n)::bigint from (select c_custkey, count(o_orderkey) n from customer left join orders on o_custkey = c_custkey group by 1)""")
def _(o, s, d, c):
    none, now = F.lit(None).cast("string"), F.lit("2024-01-01").cast("timestamp")
    named = {"name_ne": none, "name_en": none, "updated_at": now}
    cases = documents.case_document(o.select(F.concat(F.lit("c"), "o_orderkey").alias("slug"), F.lit("भरत").alias("name"), F.lit("x").alias("description"), F.array("o_orderpriority").alias("tags"), F.array(none).alias("accused"), F.to_date("o_orderdate").alias("start"), F.when(F.col("o_orderstatus") == "F", "PUBLISHED").otherwise("DRAFT").alias("state"), F.col("o_totalprice").alias("amount")).withColumns(named))
    dockets = documents.docket_document(s.select(F.lit("special").alias("court"), F.concat(F.lit("080-CR-"), "s_suppkey").alias("case_number"), F.lit("घूस").alias("case_type"), F.col("s_name").alias("plaintiff"), none.alias("defendant"), F.lit("2024-01-01").cast("date").alias("registered"), F.lit("PENDING").alias("lifecycle"), F.lit(True).alias("public"), now.alias("updated_at")))
    materials = documents.material_document(d.select(F.concat(F.lit("m"), "doc_id").alias("iri"), F.col("source").alias("name"), "text", F.array("lang").alias("kinds"), F.lit(None).cast("date").alias("published"), (F.col("doc_id") % 2 == 0).alias("public")).withColumns(named))
    cited = o.select(F.concat(F.lit("e"), "o_custkey").alias("iri"), F.col("o_orderkey").alias("case_id"))
    entities = documents.entity_document(c.select(F.concat(F.lit("e"), "c_custkey").alias("iri"), F.col("c_name").alias("name"), F.array("c_mktsegment").alias("alternates")).withColumns(named), cited)
    all_of = documents.corpus(cases, dockets, materials, entities)
    return all_of.groupBy("type").agg(F.count("*").alias("n"), F.count_if("public").alias("public"), F.sum(F.coalesce("case_count", F.lit(0))).alias("cited"))


@query("SRCH15_telemetry", "events", sql="""select event_id, case when event_id % 5 = 0 then '' else event_type || ' x' end q_normalized, event_id % 5 <> 0 and event_id % 4 = 0 zero_result, case when event_id % 4 = 0 then 0 else 2 end returned, case when event_id % 4 > 0 and event_id % 3 = 0 and event_id % 2 = 0 then 'case' end top_type from events""")
def _(e):
    k = F.col("event_id")
    hit = lambda t: F.struct(F.lit(t).alias("type"), F.lit(1.0).alias("score"))
    rows = e.select(
        k.alias("search_id"), F.when(k % 5 == 0, "  ").otherwise(F.concat(F.lit(" "), F.upper("event_type"), F.lit("   x "))).alias("q"), F.lit("ne").alias("lang"), F.array(F.lit("b"), F.lit("a")).alias("types"), F.when(k % 3 == 0, 1).otherwise(2).alias("page"),
        F.when(k % 2 > 0, "c").alias("cursor"), F.create_map(F.lit("court"), F.array(F.lit("x"))).alias("filters"), F.when(k % 4 == 0, 0).otherwise(9).alias("count"), F.when(k % 4 > 0, F.array(hit("case"), hit("court"))).alias("results"), F.lit(1.234).alias("took_ms"),
    )
    return documents.search_events(rows).select(F.col("search_id").alias("event_id"), "q_normalized", "zero_result", "returned", "top_type")


@query("SRCH16_ctr", "events", sql="""with s as (select event_id, event_type q, 1 + event_id % 3 returned from events), shown as (select event_id, q, unnest(range(1, returned + 1)) as rank from s)
    select q as q_normalized, rank, count(*) shown, count(*) filter (where event_id % 2 = 0 and rank = 1 + event_id % 5) clicked, round(count(*) filter (where event_id % 2 = 0 and rank = 1 + event_id % 5) / count(*), 4) ctr from shown group by 1, 2""")
def _(e):
    k = F.col("event_id")
    searches = e.select(k.alias("search_id"), F.col("event_type").alias("q_normalized"), (1 + k % 3).alias("returned"))
    clicks = e.where("event_id % 2 = 0").select(k.alias("search_id"), (1 + k % 5).alias("rank"), F.lit("r").alias("result_id"))
    return documents.judgments(searches, clicks.unionByName(clicks))


_RULES = Rules()


@_RULES.rule("amount", weight=3)
def _():
    return F.col("o_totalprice") > 50_000


@_RULES.rule("settled", weight=1, kind="F", gate=True)
def _():
    return F.col("o_orderpriority") != "5-LOW"


@query("UDF1_rule_registry", "orders", sql="""select o_orderkey, round(100.0 * ((o_totalprice > 50000)::int * 3 + (o_orderstatus = 'F' and o_orderpriority <> '5-LOW')::int) / (3 + (o_orderstatus = 'F')::int), 1)::double score,
    concat_ws(',', case when not o_totalprice > 50000 then 'amount' end, case when o_orderstatus = 'F' and o_orderpriority = '5-LOW' then 'settled' end) issues, not (o_orderstatus = 'F' and o_orderpriority = '5-LOW') passed from orders""")
def _(o):
    return _RULES.report(o, "o_orderstatus").select("o_orderkey", "score", F.array_join("issues", ",").alias("issues"), "passed")
