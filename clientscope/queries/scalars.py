"""Scalar functions, one query per group."""

from __future__ import annotations

from pyspark.sql import functions as F

from clientscope.functions import dates as d
from clientscope.functions.predicates import like_any
from clientscope.queries.predicates import LEFT_SUMS_SQL, left_sums
from clientscope.queries.registry import query
from clientscope.sources import fixtures as fx


@query(
    "scalar_null",
    f"""select epk, coalesce(views, 0) as views0, nullif(coalesce(views, 0), 5) as not_five,
               case when acq is null then 1 else 0 end as acq_missing, case when views is not null then 1 else 0 end as seen
        from ({LEFT_SUMS_SQL})""",
)
def scalar_null(spark, sf):
    return left_sums(spark, sf).select(
        "epk",
        F.coalesce("views", F.lit(0)).alias("views0"),
        F.nullif(F.coalesce("views", F.lit(0)), F.lit(5)).alias("not_five"),
        F.when(F.col("acq").isNull(), 1).otherwise(0).alias("acq_missing"),
        F.when(F.col("views").isNotNull(), 1).otherwise(0).alias("seen"),
    )


@query(
    "scalar_conditional",
    f"""select epk, case when views > 20 then 'many' when views > 0 then 'some' else 'none' end as searched,
               case coalesce(views, 0) when 0 then 'zero' when 1 then 'one' else 'more' end as simple,
               least(views * 0.05::double, acq * 0.3::double, 2.0::double) as smallest from ({LEFT_SUMS_SQL})""",
)
def scalar_conditional(spark, sf):
    v = F.col("views")
    return left_sums(spark, sf).select(
        "epk",
        F.when(v > 20, "many").when(v > 0, "some").otherwise("none").alias("searched"),
        F.when(F.coalesce(v, F.lit(0)) == 0, "zero").when(v == 1, "one").otherwise("more").alias("simple"),
        F.least(v * F.lit(0.05), F.col("acq") * F.lit(0.3), F.lit(2.0)).alias("smallest"),
    )


@query(
    "scalar_math",
    """select o_orderkey as id, round(o_totalprice) as whole, round(o_totalprice / 7, 4) as seventh,
              abs(o_totalprice - 200000) as distance, round(o_totalprice * 0.4::double + 2 * 0.6::double, 4) as blend
       from orders""",
)
def scalar_math(spark, sf):
    p = F.col("o_totalprice")
    return fx.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.round(p).alias("whole"),
        F.round(p / 7, 4).alias("seventh"),
        F.abs(p - 200000).alias("distance"),
        F.round(p * 0.4 + 2 * F.lit(0.6), 4).alias("blend"),
    )


@query(
    "scalar_string",
    """select p_partkey as id, lower(p_brand) as brand, lower(p_name) like '%ring%' as ring,
              p_brand || '-' || p_type as code, p_brand between 'Brand#11' and 'Brand#19' as in_range,
              p_type < 'PROMO' as before_promo from part""",
)
def scalar_string(spark, sf):
    brand = F.col("p_brand")
    return fx.table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"),
        F.lower(brand).alias("brand"),
        like_any(F.col("p_name"), ["ring"]).alias("ring"),
        F.concat(brand, F.lit("-"), F.col("p_type")).alias("code"),
        brand.between("Brand#11", "Brand#19").alias("in_range"),
        (F.col("p_type") < "PROMO").alias("before_promo"),
    )


@query(
    "scalar_date",
    """select o_orderkey as id, d as day, date_trunc('month', d)::date as month_start,
              (d + interval (-2) month)::date as two_before, last_day(d) as month_end,
              last_day((d - interval 1 month)::date) as prev_end, strftime(d, '%Y-%m') as ym, year(d)::int as y,
              (d - interval 14 day)::date as two_weeks, date_diff('day', d, date '2002-01-01')::int as days,
              (epoch(o_orderdate + interval 90 second) - epoch(o_orderdate))::bigint as seconds
       from (select *, o_orderdate::date as d from orders)""",
)
def scalar_date(spark, sf):
    day = F.col("o_orderdate").cast("date")
    later = F.unix_seconds((F.col("o_orderdate") + F.expr("interval 90 seconds")).cast("timestamp"))
    return fx.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        day.alias("day"),
        d.month_start(day).alias("month_start"),
        F.add_months(day, -2).alias("two_before"),
        F.last_day(day).alias("month_end"),
        d.shift_month_end(day, -1).alias("prev_end"),
        F.date_format(day, "yyyy-MM").alias("ym"),
        F.year(day).alias("y"),
        (day - F.expr("interval 2 weeks")).cast("date").alias("two_weeks"),
        F.datediff(F.lit("2002-01-01").cast("date"), day).alias("days"),
        (later - F.unix_seconds(F.col("o_orderdate").cast("timestamp"))).alias("seconds"),
    )


@query(
    "scalar_cast",
    """select p_partkey as id, cast(split_part(p_brand, '#', 2) as int) as brand_no, cast(p_size as varchar) as size_text,
              try_cast(p_type as int) as type_no, cast(cast(p_retailprice as decimal(12,1)) as double) as price,
              cast('1998-12-31' as date) as day from part""",
)
def scalar_cast(spark, sf):
    return fx.table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"),
        F.split_part("p_brand", F.lit("#"), F.lit(2)).cast("int").alias("brand_no"),
        F.col("p_size").cast("string").alias("size_text"),
        F.col("p_type").try_cast("int").alias("type_no"),
        F.col("p_retailprice").cast("decimal(12,1)").cast("double").alias("price"),
        F.lit(fx.ANCHOR).cast("date").alias("day"),
    )


@query(
    "scalar_predicate",
    """select p_partkey as id, p_type in ('SMALL', 'LARGE') as in_list, p_type not in ('SMALL', 'LARGE') as not_in_list,
              p_size between 10 and 20 as mid, p_name like 'b%t' as pattern, p_type <> 'PROMO' as other
       from part where exists (select 1 from lineitem where l_partkey = p_partkey)""",
)
def scalar_predicate(spark, sf):
    t = F.col("p_type")
    used = fx.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"))
    return (
        fx.table(spark, sf, "part")
        .join(used, "p_partkey", "left_semi")
        .select(
            F.col("p_partkey").alias("id"),
            t.isin("SMALL", "LARGE").alias("in_list"),
            (~t.isin("SMALL", "LARGE")).alias("not_in_list"),
            F.col("p_size").between(10, 20).alias("mid"),
            F.col("p_name").like("b%t").alias("pattern"),
            (t != "PROMO").alias("other"),
        )
    )
