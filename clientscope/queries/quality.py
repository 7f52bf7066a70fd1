"""Data-quality checks."""

from __future__ import annotations

from clientscope import quality as q
from clientscope.queries.registry import query
from clientscope.sources import fixtures as fx


@query(
    "qa_key_uniqueness",
    """select 'all' as grp, count(o_custkey) as n, count(distinct o_custkey) as n_distinct from orders
       union all select o_orderstatus, count(o_custkey), count(distinct o_custkey) from orders group by 1""",
)
def qa_key_uniqueness(spark, sf):
    o = fx.table(spark, sf, "orders")
    whole = q.key_uniqueness(o, "o_custkey").selectExpr("'all' as grp", "n", "n_distinct")
    return whole.unionByName(q.key_uniqueness(o, "o_custkey", ["o_orderstatus"]).withColumnRenamed("o_orderstatus", "grp"))


@query(
    "qa_duplicate_rows",
    """select (select count(*) from lineitem) as n,
              (select count(*) from (select distinct l_orderkey, l_linenumber from lineitem)) as n_distinct,
              (select count(*) from lineitem) - (select count(*) from (select distinct l_orderkey, l_linenumber from lineitem))
                as duplicates""",
)
def qa_duplicate_rows(spark, sf):
    return q.duplicate_rows(fx.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"))


@query(
    "qa_distinct_values",
    "select distinct last_day(cast(o_orderdate as date)) as report_dt from orders",
)
def qa_distinct_values(spark, sf):
    from pyspark.sql import functions as F

    return q.distinct_values(fx.table(spark, sf, "orders"), F.last_day(F.col("o_orderdate").cast("date")), "report_dt")
