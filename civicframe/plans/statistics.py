"""The statistics snapshot: the blocks of the catalogue as one frame of (block, metric, value), and the flagship."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicframe.sources.readers import table


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Orders by region: counts, conditional counts and null-safe sums, the largest first.

    One pass over orders; the dimensions are broadcast by the planner where they are small.
    """
    o, c, n, r = (table(spark, sf, t) for t in ("orders", "customer", "nation", "region"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    settled = F.col("o_orderstatus") == "F"
    out = j.groupBy("r_name").agg(
        F.count("*").alias("n"), F.count_if(settled).alias("settled"), F.round(F.coalesce(F.sum(F.when(settled, F.col("o_totalprice"))), F.lit(0.0)), 2).alias("settled_sum"), F.countDistinct("o_custkey").alias("customers")
    )
    return out.orderBy(F.desc("n"), "r_name")


FLAGSHIP_SQL = """select r_name, count(*) n, count(*) filter (where o_orderstatus = 'F') settled, round(coalesce(sum(o_totalprice) filter (where o_orderstatus = 'F'), 0), 2) settled_sum, count(distinct o_custkey) customers
    from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1"""


def snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """All blocks: two scans of orders' columns, one of the others. Written as a table, it serves what is too slow for a request."""
    o, c, p, s = (table(spark, sf, t) for t in ("orders", "customer", "part", "supplier"))

    def block(df: DataFrame, name: str, key: str) -> DataFrame:
        return df.groupBy(F.col(key).cast("string").alias("metric")).agg(F.count("*").alias("value")).select(F.lit(name).alias("block"), "metric", "value")

    years = o.select(F.date_format("o_orderdate", "yyyy").alias("year"))
    parts = [block(o, "status", "o_orderstatus"), block(years, "year", "year"), block(c, "segment", "c_mktsegment"), block(p, "brand", "p_brand"), block(s, "supplier_nation", "s_nationkey")]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


SNAPSHOT_SQL = """select 'status' block, o_orderstatus metric, count(*) as value from orders group by 2 union all select 'year', year(o_orderdate)::varchar, count(*) from orders group by 2
    union all select 'segment', c_mktsegment, count(*) from customer group by 2 union all select 'brand', p_brand, count(*) from part group by 2 union all select 'supplier_nation', s_nationkey::varchar, count(*) from supplier group by 2"""
QUERIES = {"flagship_by_region": flagship, "statistics_snapshot": snapshot}
ORACLES = {"flagship_by_region": FLAGSHIP_SQL, "statistics_snapshot": SNAPSHOT_SQL}
