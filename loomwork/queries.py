"""Registered queries: each applies operators of the library to the given tables, beside the same result in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions import dates
from loomwork.operators import charts, cleaning, closure, compare, constraints, geo, graph, joins, privacy, quality, reports, resolve, selections, shape, stats, taxonomy, vectors
from loomwork.plans import builder, cells, macros
from loomwork.plans.notebook import Notebook
from loomwork.sources import sinks
from loomwork.streaming import events as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL if there is any."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- builder, macros, calculated fields ------------------------------------------------


@query("""select c_mktsegment, count(o_orderkey) as n_orders, sum(o_totalprice) as total, min(o_totalprice) as smallest, max(o_totalprice) as largest
from orders join customer on o_custkey = c_custkey where o_orderstatus = 'F' and o_totalprice >= 1000 group by 1 order by total desc nulls last limit 100""")
def builder_join_group_limit(spark, sf_dir):
    tables = {n: table(spark, sf_dir, n) for n in ("orders", "customer")}
    spec = builder.Spec(
        "orders", [("customer", "orders.o_custkey", "customer.c_custkey")], ["c_mktsegment"], [("o_orderstatus", "=", "F"), ("o_totalprice", ">=", 1000), ("o_totalprice", "<", "cheap")],
        ["c_mktsegment"], [("COUNT", "o_orderkey", "n_orders"), ("SUM", "o_totalprice", "total"), ("MIN", "o_totalprice", "smallest"), ("MAX", "o_totalprice", "largest")], ("total", "DESC"), 100,
    )
    return builder.build(spec, tables)


@query("""select o_orderstatus, count(*) as customers, max(n) as most from (select o_custkey, o_orderstatus, count(*) as n from orders group by 1, 2) where n >= 2 group by 1""")
def pipeline_two_step(spark, sf_dir):
    spec = builder.Spec("orders", columns=["o_custkey", "o_orderstatus"], group_by=["o_custkey", "o_orderstatus"], aggregates=[("COUNT", "o_orderkey", "n")])
    step = builder.Step([("n", ">=", 2)], ["o_orderstatus"], [("COUNT", "o_custkey", "customers"), ("MAX", "n", "most")])
    return builder.pipeline(spec, [step], {"orders": table(spark, sf_dir, "orders")})


_FRAGMENTS = {
    "measures": {"gross": "sum(l_extendedprice)", "revenue": "sum(l_extendedprice * (1 - l_discount))", "margin": "MEASURE(revenue) / MEASURE(gross)"},
    "dimensions": {"year": "year(l_shipdate)"},
    "segments": {"returned": "l_returnflag = 'R'"},
    "filters": {"ships": ""},
}


@query("""select year(l_shipdate)::int as y, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, round(sum(l_extendedprice * (1 - l_discount)) / sum(l_extendedprice), 6) as margin,
count(*) filter (where l_returnflag = 'R') as returned from lineitem group by 1""")
def macro_measure_dim_segment(spark, sf_dir):
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("macro_lineitem")
    sql = """select DIM(year) as y, round(MEASURE(revenue), 2) as revenue, round(MEASURE(margin), 6) as margin, count(*) filter (where SEGMENT(returned)) as returned
             from macro_lineitem where CROSSFILTER(ships) group by DIM(year)"""
    return spark.sql(macros.expanded(sql, **_FRAGMENTS))


@query("""with a as (select o_custkey, sum(o_totalprice) as total from orders group by 1) select c_mktsegment, count(*) as customers, round(sum(total), 2) as total
from a join customer on o_custkey = c_custkey where total > 100000 group by 1""")
def notebook_cells(spark, sf_dir):
    for n in ("orders", "customer"):
        table(spark, sf_dir, n).createOrReplaceTempView(f"nb_{n}")
    book = Notebook(spark, inputs={"floor": 100000.0})
    book.add("totals", "select o_custkey, sum(o_totalprice) as total from nb_orders group by 1")
    book.add("big", "select * from @totals where total > @floor")
    book.add("segments", "select c_mktsegment, count(*) as customers, round(sum(total), 2) as total from @big join nb_customer on o_custkey = c_custkey group by 1")
    return book.run("segments")


@query("""select l_orderkey, l_linenumber, l_quantity, sum(l_quantity) over (partition by l_orderkey) as order_quantity, count(*) over (partition by l_returnflag) as flag_rows,
l_quantity / nullif(sum(l_quantity) over (partition by l_orderkey), 0) as share from lineitem""")
def calc_field_lod_window(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    df = shape.lod(df, "flag_rows", "count", "l_orderkey", ["l_returnflag"])
    df = shape.lod(df, "order_quantity", "sum", "l_quantity", ["l_orderkey"])
    df = builder.calculated(df, "share", "try_divide(l_quantity, order_quantity)")
    return df.select("l_orderkey", "l_linenumber", "l_quantity", "order_quantity", "flag_rows", "share")


# --- statistics --------------------------------------------------------------------------

_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _union(parts: list[str]) -> str:
    return " union all ".join(parts)


@query(_union([f"""select '{c}' as column_name, count({c}) as n, count(*) - count({c}) as nulls, count(distinct {c}) as n_distinct, min({c})::double as min, max({c})::double as max,
round(avg({c}), 4) as mean, round(stddev({c}), 4) as stddev, round(quantile_cont({c}, 0.5)::double, 6) as median from lineitem""" for c in _NUMBERS] + ["""select 'l_returnflag', count(l_returnflag),
count(*) - count(l_returnflag), count(distinct l_returnflag), null, null, null, null, null from lineitem"""]))
def descriptives_lineitem(spark, sf_dir):
    return stats.descriptives(table(spark, sf_dir, "lineitem"), [*_NUMBERS, "l_returnflag"]).withColumns({"mean": F.round("mean", 4), "stddev": F.round("stddev", 4), "median": F.round("median", 6)})


@query(_union([f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 6) as corr from lineitem" for i, a in enumerate(_NUMBERS) for b in _NUMBERS[i:]]))
def correlation_matrix(spark, sf_dir):
    return stats.correlation_matrix(table(spark, sf_dir, "lineitem"), _NUMBERS).withColumn("corr", F.round("corr", 6))


@query("select * from (select 'l_quantity' as a, 'l_extendedprice' as b, round(corr(l_quantity, l_extendedprice), 6) as corr from lineitem union all select 'l_extendedprice', 'net', round(corr(l_extendedprice, l_extendedprice * (1 - l_discount)), 6) from lineitem union all select 'l_quantity', 'net', round(corr(l_quantity, l_extendedprice * (1 - l_discount)), 6) from lineitem union all select 'l_discount', 'net', round(corr(l_discount, l_extendedprice * (1 - l_discount)), 6) from lineitem) where abs(corr) >= 0.5")
def correlation_graph(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumn("net", F.expr("l_extendedprice * (1 - l_discount)"))
    return stats.correlation_graph(df, ["l_quantity", "l_extendedprice", "l_discount", "net"]).withColumn("corr", F.round("corr", 6))


def _profile_sql(t: str, c: str) -> str:
    return f"""select '{c}' as column_name, count(*) as total, count(*) - count({c}) as nulls, count(distinct {c}) as n_distinct, min(length({c}::varchar)) as min_length, max(length({c}::varchar)) as max_length,
    round(avg(length({c}::varchar)), 6) as avg_length, (select string_agg(v, ' | ' order by n desc, v) from (select {c}::varchar as v, count(*) as n from {t} where {c} is not null group by 1 order by n desc, v limit 5)) as top_values from {t}"""


@query(_union([_profile_sql("orders", c) for c in ("o_orderstatus", "o_orderpriority", "o_custkey")]))
def column_profile(spark, sf_dir):
    return stats.column_profile(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority", "o_custkey"]).withColumn("avg_length", F.round("avg_length", 6))


def _iqr_sql(t: str, c: str) -> str:
    q = f"(select quantile_cont({c}, 0.25) as a, quantile_cont({c}, 0.75) as b, quantile_cont({c}, 0.5) as m from {t})"
    return f"""select '{c}' as column_name, count({c}) as n, min({c})::double as min, round(any_value(a)::double, 6) as q1, round(any_value(m)::double, 6) as median, round(any_value(b)::double, 6) as q3, max({c})::double as max,
    count(*) filter (where {c} < a - 1.5 * (b - a) or {c} > b + 1.5 * (b - a)) as outliers from {t}, {q}"""


@query(_union([_iqr_sql("orders", "o_totalprice"), _iqr_sql("orders", "o_custkey")]))
def numeric_profile_iqr(spark, sf_dir):
    return stats.numeric_profile(table(spark, sf_dir, "orders"), ["o_totalprice", "o_custkey", "o_orderstatus"]).withColumns({c: F.round(c, 6) for c in ("q1", "median", "q3")})


@query("""select 'c_name' as column_name, 0.0::double as null_share, count(distinct c_name) as n_distinct, null::varchar as min, null::varchar as max from customer
union all select 'c_mktsegment', 0.0, count(distinct c_mktsegment), min(c_mktsegment), max(c_mktsegment) from customer""")
def agent_column_stats(spark, sf_dir):
    return stats.agent_stats(table(spark, sf_dir, "customer"), {"c_name": "pii", "c_mktsegment": "public"})


@query(_union([f"select '{c}' as column_name, avg((nullif({c}::varchar, '') is null)::int)::double as null_share from customer" for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")]))
def null_shares(spark, sf_dir):
    return taxonomy.wide_sample_nulls(table(spark, sf_dir, "customer"))


@query()
def classify_columns(spark, sf_dir):
    found = []
    for name in ("customer", "orders", "events", "pages"):
        found += [(name, r["column"], r["type"], r["status"], round(r["confidence"], 4), r["sensitivity"]) for r in taxonomy.classify(table(spark, sf_dir, name))]
    return spark.createDataFrame(found, "table_name string, column_name string, type string, status string, confidence double, sensitivity string")


# --- comparison, quality, cleaning -------------------------------------------------------


def _changed_orders(orders: DataFrame) -> DataFrame:
    kept = orders.filter("o_orderkey % 17 <> 0").withColumn("o_totalprice", F.expr("if(o_orderkey % 11 = 0, o_totalprice + 1, o_totalprice)"))
    more = orders.filter("o_orderkey % 23 = 0").withColumn("o_orderkey", F.expr("-o_orderkey - 1"))
    return kept.unionByName(more)


_CHANGED = """(select o_orderkey, o_custkey, o_orderstatus, case when o_orderkey % 11 = 0 then o_totalprice + 1 else o_totalprice end as o_totalprice, o_orderdate, o_orderpriority from orders where o_orderkey % 17 <> 0
union all select -o_orderkey - 1, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority from orders where o_orderkey % 23 = 0)"""


@query(f"""select count(*) filter (where b.o_orderkey is null) as only_a, count(*) filter (where a.o_orderkey is null) as only_b, count(*) filter (where a.o_orderkey is not null and b.o_orderkey is not null) as matched,
count(*) filter (where a.o_orderkey is not null and b.o_orderkey is not null and a.o_totalprice is distinct from b.o_totalprice) as differing from orders a full join {_CHANGED} b on a.o_orderkey = b.o_orderkey""")
def compare_orders_buckets(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return compare.buckets(orders, _changed_orders(orders), "o_orderkey")


@query(f"""select a.o_orderkey as key, 'o_totalprice' as column_name, round(a.o_totalprice, 2) as a_value, round(b.o_totalprice, 2) as b_value from orders a join {_CHANGED} b on a.o_orderkey = b.o_orderkey where a.o_totalprice is distinct from b.o_totalprice""")
def compare_orders_diff_rows(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    found = compare.differing_rows(orders, _changed_orders(orders), "o_orderkey", limit=None)
    return found.withColumns({c: F.round(F.col(c).cast("double"), 2) for c in ("a_value", "b_value")})


_CHECKS = [
    quality.Check("price_given", "completeness", "o_totalprice"),
    quality.Check("status_known", "accepted_values", "o_orderstatus", {"values": ["f", "o"]}),
    quality.Check("price_range", "valid_range", "o_totalprice", {"min": 1000, "max": 300000}),
    quality.Check("priority_format", "format", "o_orderpriority", {"pattern": "[0-9]-[A-Z ]+"}),
    quality.Check("customer_unique", "uniqueness", "o_custkey"),
    quality.Check("customer_exists", "referential_validity", "o_custkey", {"parent_table": "customer", "parent_column": "c_custkey"}),
]


@query("""select check_name, kind, violations, case when violations = 0 then 'PASS' else 'FAIL' end as status from (
select 'price_given' as check_name, 'completeness' as kind, count(*) filter (where o_totalprice is null) as violations from orders
union all select 'status_known', 'accepted_values', count(*) filter (where lower(o_orderstatus) not in ('f', 'o')) from orders
union all select 'price_range', 'valid_range', count(*) filter (where o_totalprice < 1000 or o_totalprice > 300000) from orders
union all select 'priority_format', 'format', count(*) filter (where not regexp_full_match(o_orderpriority, '[0-9]-[A-Z ]+')) from orders
union all select 'customer_unique', 'uniqueness', count(*) from (select o_custkey from orders group by 1 having count(*) > 1)
union all select 'customer_exists', 'referential_validity', count(*) from orders where o_custkey not in (select c_custkey from customer))""")
def quality_checks(spark, sf_dir):
    return quality.run_checks(table(spark, sf_dir, "orders"), _CHECKS, {"customer_exists": table(spark, sf_dir, "customer")})


@query("select l_suppkey, count(*) as n from lineitem where l_suppkey not in (select s_suppkey from supplier where s_acctbal > 0) group by 1")
def orphan_keys(spark, sf_dir):
    parent = table(spark, sf_dir, "supplier").filter("s_acctbal > 0")
    check = quality.Check("supplier", "referential_validity", "l_suppkey", {"parent_column": "s_suppkey"})
    return quality.violations(table(spark, sf_dir, "lineitem"), check, parent).groupBy("l_suppkey").agg(F.count("*").alias("n"))


@query("select o_custkey, count(*) as duplicate_count from orders where o_custkey is not null group by 1 having count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return quality.violations(table(spark, sf_dir, "orders"), quality.Check("unique", "uniqueness", "o_custkey"))


@query("select p_partkey, p_size, p_retailprice from part where p_size < 5 or p_size > 45")
def range_violations(spark, sf_dir):
    return quality.violations(table(spark, sf_dir, "part"), quality.Check("size", "valid_range", "p_size", {"min": 5, "max": 45})).select("p_partkey", "p_size", "p_retailprice")


def _dirty(customer: DataFrame) -> DataFrame:
    return customer.select("c_custkey", F.expr("case when c_custkey % 7 = 0 then concat('  ', c_name, ' ') when c_custkey % 11 = 0 then 'N/A' when c_custkey % 13 = 0 then null else c_name end").alias("name"),
                           F.expr("case when c_custkey % 3 = 0 then null else c_mktsegment end").alias("a"), F.expr("case when c_custkey % 5 = 0 then null else lower(c_mktsegment) end").alias("b"))


_DIRTY = """(select c_custkey, case when c_custkey % 7 = 0 then '  ' || c_name || ' ' when c_custkey % 11 = 0 then 'N/A' when c_custkey % 13 = 0 then null else c_name end as name,
case when c_custkey % 3 = 0 then null else c_mktsegment end as a, case when c_custkey % 5 = 0 then null else lower(c_mktsegment) end as b from customer)"""


@query(f"""select c_custkey, trim(name) as trimmed, case when upper(trim(name)) in ('N/A', 'NA', 'NULL', 'NONE', 'NIL', '-', '--', '?', '') then null else name end as present, lower(name) as folded,
coalesce(name, '') as filled, coalesce(a, b) as merged, coalesce(a <> b, false) as merged_collision, coalesce(try_cast(nullif(regexp_extract(name, '(-?[0-9]+(?:\\.[0-9]+)?)', 1), '') as double), null) as num from {_DIRTY}""")
def clean_columns(spark, sf_dir):
    df = cleaning.merge_columns(_dirty(table(spark, sf_dir, "customer")), "a", "b", "merged")
    name = F.col("name")
    return df.select("c_custkey", cleaning.trim(name).alias("trimmed"), cleaning.missing_to_null(name).alias("present"), cleaning.fold_case(name).alias("folded"), cleaning.fill_null(name, "").alias("filled"),
                     "merged", "merged_collision", cleaning.embedded_number(name).alias("num"))


@query(f"""select * from (select 'name' as column_name, 'trim' as fix, count(*) filter (where trim(name) <> name) as rows, count(*) filter (where trim(name) <> name) / count(*)::double as share from {_DIRTY}
union all select 'name', 'missing', count(*) filter (where upper(trim(name)) = 'N/A'), count(*) filter (where upper(trim(name)) = 'N/A') / count(*)::double from {_DIRTY}
union all select 'name', 'null', count(*) filter (where name is null), count(*) filter (where name is null) / count(*)::double from {_DIRTY}
union all select 'name', 'lower', count(*) filter (where lower(name) <> name), count(*) filter (where lower(name) <> name) / count(*)::double from {_DIRTY}
union all select 'a', 'null', count(*) filter (where a is null), count(*) filter (where a is null) / count(*)::double from {_DIRTY}
union all select 'a', 'lower', count(*) filter (where lower(a) <> a), count(*) filter (where lower(a) <> a) / count(*)::double from {_DIRTY}) where share >= 0.01""")
def clean_impact(spark, sf_dir):
    return cleaning.impact(_dirty(table(spark, sf_dir, "customer")), ["name", "a"])


@query("select o_orderkey, split_part(o_orderpriority, '-', 1) as o_orderpriority_1, split_part(o_orderpriority, '-', 2) as o_orderpriority_2 from orders")
def split_column(spark, sf_dir):
    return cleaning.split_column(table(spark, sf_dir, "orders"), "o_orderpriority", "-", 2).select("o_orderkey", "o_orderpriority_1", "o_orderpriority_2")


@query("select o_custkey, year(o_orderdate)::int as year, round(sum(o_totalprice), 2) as total from orders where o_orderdate is not null group by 1, 2")
def unpivot_years(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("y", F.year("o_orderdate"))
    years = [r.y for r in orders.filter("y is not null").select("y").distinct().orderBy("y").collect()]  # a column each
    wide = shape.pivot_wide(orders, "o_custkey", "y", "o_totalprice", "sum", years)
    named = wide.select("o_custkey", *[F.round(F.col(str(y)), 2).alias(f"total_{y}") for y in years])
    return cleaning.unpivot_years(named, "total", ["o_custkey"], "total")


@query("select distinct o_custkey, o_orderstatus from orders")
def dedupe_rows(spark, sf_dir):
    return cleaning.distinct_rows(table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus"))


@query("""select c_custkey, md5('pepper' || coalesce(c_name, '')) as c_name, floor(c_acctbal / 100)::double * 100 as c_acctbal, '[REDACTED]' as c_mktsegment from customer""")
def anonymize_projection(spark, sf_dir):
    return privacy.anonymize(table(spark, sf_dir, "customer"), {"c_custkey": "keep", "c_name": "hash", "c_acctbal": "bucket", "c_mktsegment": "redact", "c_nationkey": "drop"}, "pepper")


@query("select doc_id, case when left(text, 1) in ('=', '+', '-', '@', chr(9), chr(13)) then '''' || text else text end as text from documents")
def csv_neutralised(spark, sf_dir):
    return privacy.csv_safe(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("""select c_custkey, 'Dear ' || c_name || ', segment ' || c_mktsegment || ' ${unknown}' as message from customer""")
def request_template(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    return df.select("c_custkey", sinks.filled_template("Dear ${c_name}, segment ${c_mktsegment} ${unknown}", df.columns).alias("message"))


# --- resolution and selection ------------------------------------------------------------


def _variants(part: DataFrame) -> DataFrame:
    return part.select("p_partkey", F.expr("case p_partkey % 4 when 0 then upper(p_name) when 1 then concat(' ', p_name, '.') when 2 then concat_ws(' ', reverse(split(p_name, ' '))) else p_name end").alias("name"))


_VARIANTS = "(select p_partkey, case p_partkey % 4 when 0 then upper(p_name) when 1 then ' ' || p_name || '.' when 2 then array_to_string(list_reverse(string_split(p_name, ' ')), ' ') else p_name end as name from part)"
_FP = r"array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(trim(value)), '[^a-z0-9\s]', '', 'g'), '\s+'), lambda x: x <> ''))), ' ')"


@query(f"""with c as (select name as value, count(*) as n from {_VARIANTS} where name <> '' group by 1), k as (select *, {_FP} as fingerprint from c),
r as (select *, row_number() over (partition by fingerprint order by n desc, length(value) desc, value) as r from k)
select fingerprint, count(*) as members, sum(n)::bigint as total, max(value) filter (where r = 1) as canonical from r where fingerprint <> '' group by 1 having count(*) > 1""")
def fingerprint_clusters(spark, sf_dir):
    return resolve.key_clusters(resolve.value_counts(_variants(table(spark, sf_dir, "part")), "name"))


@query(f"""with c as (select name as value, count(*) as n from {_VARIANTS} where name <> '' group by 1), k as (select *, {_FP} as fingerprint from c),
r as (select *, row_number() over (partition by fingerprint order by n desc, length(value) desc, value) as r from k), m as (select a.value, b.value as canonical from r a join r b on a.fingerprint = b.fingerprint and b.r = 1)
select v.p_partkey, v.name, coalesce(m.canonical, v.name) as name__merged from {_VARIANTS} v left join m on v.name = m.value""")
def merge_map(spark, sf_dir):
    rows = _variants(table(spark, sf_dir, "part"))
    counts = resolve.value_counts(rows, "name").withColumn("fingerprint", resolve.fingerprint(F.col("value"), ascii_only=True)).filter("fingerprint <> ''")
    best = counts.groupBy("fingerprint").agg(resolve.canonical().alias("canonical"))
    return resolve.merge_values(rows, "name", counts.join(best, "fingerprint").select("value", "canonical"))


_NEAR = f"""with v as (select value, left({_FP}, 1) as block from (select distinct p_name as value from part)) select a.value as a, b.value as b, 1 - levenshtein(a.value, b.value) / length(b.value)::double as similarity from v a join v b
on a.block = b.block and (length(b.value) > length(a.value) or (length(b.value) = length(a.value) and b.value > a.value)) where 1 - levenshtein(a.value, b.value) / length(b.value)::double > 0.7 - 1e-9"""


@query(_NEAR)
def nearest_neighbour_pairs(spark, sf_dir):
    return resolve.near_pairs(resolve.value_counts(table(spark, sf_dir, "part"), "p_name"), 0.7, ascii_only=True)


@query(f"""with recursive p as ({_NEAR}), w as (select a, b from p union select b, a from p), r as (select a as value, a as reach from w union select r.value, w.b from r join w on r.reach = w.a),
k as (select value, min(reach) as cluster from r group by 1), c as (select p_name as value, count(*) as n from part where p_name <> '' group by 1)
select value, cluster, first_value(value) over (partition by cluster order by n desc, length(value) desc, value) as canonical from k join c using (value)""")
def nearest_neighbour_clusters(spark, sf_dir):
    return resolve.near_clusters(resolve.value_counts(table(spark, sf_dir, "part"), "p_name"), 0.7, ascii_only=True)


@query("""select o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) as o_orderstatus, max(o_totalprice) as o_totalprice, min(o_orderdate) as o_orderdate, arg_min(o_orderpriority, (o_orderdate, o_orderkey)) as o_orderpriority from orders group by 1""")
def golden_table(spark, sf_dir):
    rules = {"o_orderstatus": "latest", "o_totalprice": "max", "o_orderdate": "min", "o_orderpriority": "first"}
    return resolve.golden(table(spark, sf_dir, "orders").withColumn("at", F.col("o_orderdate")), "o_custkey", rules, "at", "o_orderkey")


@query("""with s as (select o_orderstatus, o_orderpriority, o_orderpriority = '1-URGENT' as p, o_orderstatus = 'F' as f from orders)
select 'o_orderstatus' as column_name, o_orderstatus as value, count(*) as n, case when o_orderstatus = 'F' then 'selected' when bool_or(p) then 'associated' else 'excluded' end as state from s group by 2
union all select 'o_orderpriority', o_orderpriority, count(*), case when o_orderpriority = '1-URGENT' then 'selected' when bool_or(f) then 'associated' else 'excluded' end from s group by 2""")
def value_states(spark, sf_dir):
    return selections.value_states(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"], {"o_orderstatus": ["F"], "o_orderpriority": ["1-URGENT"]})


@query("select event_type, count(*) as n from events where value between 10 and 50 and ts between timestamp '2024-01-05' and timestamp '2024-01-20' and event_type in ('click', 'view') group by 1")
def crossfilter_facets(spark, sf_dir):
    held = selections.range_predicate("value", 50, 10) & F.col("ts").between(F.expr("timestamp_ntz'2024-01-05'"), F.expr("timestamp_ntz'2024-01-20'"))
    return table(spark, sf_dir, "events").filter(held & selections.predicate({"event_type": ["click", "view"]})).groupBy("event_type").agg(F.count("*").alias("n"))


# --- shapes -------------------------------------------------------------------------------


@query("""select coalesce(o_orderstatus, '') as row_key, coalesce(o_orderpriority, '') as col_key, round(sum(o_totalprice), 2) as cell, grouping(coalesce(o_orderstatus, ''), coalesce(o_orderpriority, ''))::int as level
from orders group by cube (coalesce(o_orderstatus, ''), coalesce(o_orderpriority, ''))""".replace("coalesce(o_orderstatus, '')", "o_orderstatus").replace("coalesce(o_orderpriority, '')", "o_orderpriority"))
def pivot_sum(spark, sf_dir):
    return shape.pivot(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority", "o_totalprice", "sum").withColumn("cell", F.round("cell", 2))


@query("""select event_type as row_key, dayname(ts) as col_key, count(*)::double as cell, grouping(event_type, dayname(ts))::int as level from events group by cube (event_type, dayname(ts))""".replace("dayname(ts)", "strftime(ts, '%Y-%m-%d')"))
def pivot_count_totals(spark, sf_dir):
    return shape.pivot(table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd")), "event_type", "day", None, "count")


def _histogram_sql(t: str, v: str) -> str:
    return f"""with e as (select min({v})::double as lo, max({v})::double as hi from {t}), b as (select case when {v} >= hi then 29 else least(29, floor(({v} - lo) / ((hi - lo) / 30)))::int end as bin, count(*) as n from {t}, e group by 1)
    select r.bin::int as bin, round(lo + r.bin * ((hi - lo) / 30), 4) as low, round(lo + (r.bin + 1) * ((hi - lo) / 30), 4) as high, coalesce(n, 0) as n from (select unnest(range(30)) as bin) r cross join e left join b on r.bin = b.bin"""


@query(_histogram_sql("events", "value"))
def histogram_value(spark, sf_dir):
    return shape.histogram(table(spark, sf_dir, "events"), F.col("value")).withColumns({"low": F.round("low", 4), "high": F.round("high", 4)})


@query(_histogram_sql("(select epoch_us(ts)::double as value from events)", "value"))
def time_histogram(spark, sf_dir):
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return shape.histogram(table(spark, sf_dir, "events"), micros).withColumns({"low": F.round("low", 4), "high": F.round("high", 4)})


@query("""with c as (select p_brand as v, count(*) as n from part group by 1), r as (select *, row_number() over (order by n desc, v) as r from c) select case when r <= 20 then v else '(other)' end as category, sum(n)::bigint as n from r group by 1""")
def category_topn_other(spark, sf_dir):
    return shape.category_counts(table(spark, sf_dir, "part"), "p_brand", 20)


@query("""with c as (select p_type as v, sum(p_retailprice) as t from part where p_retailprice > 0 group by 1), r as (select *, row_number() over (order by t desc, v) as r, count(*) over () as k from c)
select case when k <= 12 or r <= 11 then v else 'Other' end as label, round(sum(t), 2) as total from r group by 1""")
def pie_slices(spark, sf_dir):
    return shape.pie_slices(table(spark, sf_dir, "part"), "p_type", "p_retailprice").withColumn("total", F.round("total", 2))


@query("select count(*) filter (where try_cast(o_orderpriority as double) is not null) / count(*)::double >= 0.8 as \"numeric\", count(*) filter (where try_cast(o_orderpriority as double) is not null) / count(*)::double as share from orders")
def numeric_text_test(spark, sf_dir):
    return shape.is_numeric_text(table(spark, sf_dir, "orders"), "o_orderpriority")


@query("select round(sum(o_totalprice), 2) as total, round(avg(o_totalprice), 4) as average, count(o_totalprice) as n from orders")
def stat_tile(spark, sf_dir):
    return shape.summarize(table(spark, sf_dir, "orders"), "o_totalprice").withColumns({"total": F.round("total", 2), "average": F.round("average", 4)})


@query("select p_size, p_brand, count(*) as n from part group by 1, 2")
def heatmap_counts(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_size", "p_brand").agg(F.count("*").alias("n"))


@query("""select c_nationkey, c_mktsegment, count(*) as n, grouping(c_nationkey, c_mktsegment)::int as level from customer group by cube (c_nationkey, c_mktsegment)""")
def cube_totals(spark, sf_dir):
    return table(spark, sf_dir, "customer").cube("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))


# --- reports ------------------------------------------------------------------------------


@query("""select case when d <= 0 then 'current' when d <= 30 then '1-30' when d <= 60 then '31-60' when d <= 90 then '61-90' else '90+' end as bucket, round(sum(o_totalprice), 2) as total, count(*) as n
from (select o_totalprice, datediff('day', o_orderdate::date, date '1998-08-01') as d from orders where o_orderstatus = 'O') group by 1""")
def ar_aging(spark, sf_dir):
    open_orders = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'")
    return reports.ageing(open_orders, "o_orderdate", "o_totalprice", "1998-08-01").withColumn("total", F.round("total", 2))


@query("""select s_name, round(total, 2) as total, round(total / sum(total) over (), 8) as share from (select s_name, sum(l_extendedprice * (1 - l_discount)) as total from supplier join lineitem on s_suppkey = l_suppkey group by 1) order by total desc, s_name limit 20""")
def vendor_concentration(spark, sf_dir):
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    out = reports.concentration(joined, "s_name", F.expr("l_extendedprice * (1 - l_discount)"))
    return out.withColumns({"total": F.round("total", 2), "share": F.round("share", 8)})


@query("select substr(c_mktsegment, 1, 2) as prefix, count(*) as n, round(sum(c_acctbal), 2) as total from customer group by 1")
def prefix_recon(spark, sf_dir):
    return reports.prefix_groups(table(spark, sf_dir, "customer"), "c_mktsegment", "c_acctbal").withColumn("total", F.round("total", 2))


@query("select date_trunc('hour', ts)::timestamp as period, count(*) as n from events where event_type = 'error' group by 1")
def error_by_hour(spark, sf_dir):
    return reports.counts_by_time(table(spark, sf_dir, "events").filter("event_type = 'error'"), "ts", "hour")


@query("select event_type, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, round(quantile_cont(value, 0.99), 6) as p99, count(*) as n from events group by 1")
def latency_percentiles(spark, sf_dir):
    out = reports.percentiles(table(spark, sf_dir, "events"), "event_type", "value")
    return out.withColumns({c: F.round(c, 6) for c in ("p50", "p95", "p99")})


@query("select date_trunc('day', ts)::timestamp as period, count(distinct user_id) as n from events group by 1")
def dau(spark, sf_dir):
    return reports.counts_by_time(table(spark, sf_dir, "events"), "ts", "day", distinct="user_id")


@query("select event_type, count(*) as n, count(distinct user_id) as users from events group by 1 order by n desc, event_type limit 20")
def top_events(spark, sf_dir):
    return reports.top_events(table(spark, sf_dir, "events"), "event_type", "user_id")


_RANKED = "(select event_type as e, row_number() over (order by count(*) desc, event_type) as r from events group by 1)"


@query(f"""with k as {_RANKED}, a as (select user_id, min(ts) as t from events join k on e = event_type and r = 1 group by 1),
b as (select x.user_id, min(x.ts) as t from events x join k on e = event_type and r = 2 join a on a.user_id = x.user_id and x.ts > a.t group by 1),
c as (select x.user_id, min(x.ts) as t from events x join k on e = event_type and r = 3 join b on b.user_id = x.user_id and x.ts > b.t group by 1),
s as (select 1 as step, (select e from k where r = 1) as event, (select count(*) from a) as users union all select 2, (select e from k where r = 2), (select count(*) from b) union all select 3, (select e from k where r = 3), (select count(*) from c))
select step, event, users, users * 100.0::double / nullif(first_value(users) over (order by step), 0) as share_of_first, (lag(users) over (order by step) - users) * 100.0::double / nullif(lag(users) over (order by step), 0) as drop_from_previous from s""")
def funnel(spark, sf_dir):
    steps = reports.funnel(table(spark, sf_dir, "events"), "user_id", "ts", "event_type")
    return shape.funnel_rates(steps, "step", "users")


@query("""with s as (select *, row_number() over (partition by user_id order by ts, event_id) as r from events) select e1 || ' > ' || e2 || ' > ' || e3 as path, count(*) as users from
(select user_id, max(event_type) filter (where r = 1) as e1, max(event_type) filter (where r = 2) as e2, max(event_type) filter (where r = 3) as e3 from s group by 1) where e3 is not null group by 1 order by users desc, path limit 25""")
def top_paths(spark, sf_dir):
    return reports.top_paths(table(spark, sf_dir, "events"), "user_id", "ts", "event_type", "event_id")


@query("""with w as (select distinct user_id, date_trunc('week', ts)::timestamp as w from events), f as (select user_id, min(w) as cohort from w group by 1)
select cohort, (datediff('day', cohort, w) / 7)::int as week_offset, count(distinct user_id) as users from w join f using (user_id) where datediff('day', cohort, w) / 7 between 0 and 4 group by 1, 2""")
def retention(spark, sf_dir):
    return reports.retention(table(spark, sf_dir, "events"), "user_id", "ts")


@query("""with s as (select distinct user_id, json_extract_string(props, '$.k')::int % 10 as source from events), p as (select distinct user_id as v from events where event_type = 'purchase' and value > 90)
select source::int as source, count(distinct user_id) as users, count(distinct v) as converted, count(distinct v) / count(distinct user_id)::double as rate from s left join p on user_id = v where source is not null group by 1 having count(distinct user_id) >= 5""")
def conversion_by_source(spark, sf_dir):
    source = F.get_json_object("props", "$.k").cast("int") % 10
    return reports.conversion(table(spark, sf_dir, "events"), "user_id", source, F.expr("event_type = 'purchase' and value > 90"))


@query("select date_trunc('month', o_orderdate)::timestamp as period, o_orderstatus, count(*) as n from orders group by 1, 2")
def monthly_trend(spark, sf_dir):
    return reports.counts_by_time(table(spark, sf_dir, "orders"), "o_orderdate", "month", ["o_orderstatus"])


def _brief_sql(t: str, d: str, m: str, how: str, extra: str = "") -> str:
    return f"select {d} as dimension, round({how}({m}), 4) as metric, count(*) as n{extra} from {t} group by 1 order by metric desc nulls last, dimension limit 30"


_BOUND: dict[str, tuple[str, str, str, str | None]] = {
    # brief: (table, dimension, metric, optional)
    "marketplace": ("part", "p_brand", "p_retailprice", "p_size"),
    "outcome": ("orders", "o_orderstatus", "o_totalprice", None),
    "geo": ("customer", "c_nationkey", "c_acctbal", None),
    "retail": ("lineitem", "l_partkey", "l_quantity * l_extendedprice", "l_quantity"),
    "content": ("documents", "source", "n_chars", None),
    "hr": ("supplier", "s_nationkey", "s_acctbal", None),
    "real_estate": ("part", "p_type", "p_retailprice", "p_size"),
    "education": ("documents", "lang", "n_chars", None),
    "clinical": ("events", "event_type", "value", None),
    "demographic": ("customer", "c_mktsegment", "c_acctbal", None),
    "sensor": ("events", "user_id", "value", None),
    "fraud": ("orders", "o_orderpriority", "o_totalprice", None),
    "banking": ("customer", "c_mktsegment", "c_acctbal", "c_nationkey"),
    "insurance": ("orders", "o_orderpriority", "o_totalprice", None),
    "support": ("events", "event_type", "value", "user_id"),
    "inventory": ("lineitem", "l_suppkey", "l_quantity", "l_discount"),
    "consumption": ("events", "user_id", "value", None),
    "production": ("lineitem", "l_linestatus", "l_quantity", "l_tax"),
    "contract": ("orders", "o_custkey", "o_totalprice", None),
    "nonprofit": ("orders", "o_orderstatus", "o_totalprice", None),
    "research": ("documents", "lang", "n_chars", None),
    "government": ("supplier", "s_nationkey", "s_acctbal", None),
    "agriculture": ("part", "p_brand", "p_size", "p_retailprice"),
    "sports": ("events", "event_type", "value", None),
}


def _register_briefs() -> None:
    for name, (source, dimension, metric, optional) in _BOUND.items():
        want_dimension, want_metric, how, want_optional = reports.BRIEFS[name]

        def run(spark, sf_dir, name=name, source=source, dimension=dimension, metric=metric, optional=optional, wd=want_dimension, wm=want_metric, wo=want_optional):
            bound = {wd: F.expr(dimension).cast("string"), wm: F.expr(f"cast({metric} as double)")}
            if optional and wo:
                bound[wo] = F.expr(f"cast({optional} as double)")
            out = reports.domain_brief(table(spark, sf_dir, source), name, bound)
            return out.withColumns({c: F.round(c, 4) for c in ("metric", wo) if c in out.columns})

        QUERIES[f"brief_{name}"] = run
        extra = f', round(avg({optional}), 4) as "{want_optional}"' if optional and want_optional else ""
        ORACLE_SQL[f"brief_{name}"] = f"select dimension, round(metric, 4) as metric, n{', ' + chr(34) + want_optional + chr(34) if extra else ''} from (select ({dimension})::varchar as dimension, {how}(({metric})::double) as metric, count(*) as n{extra} from {source} group by 1 order by metric desc nulls last, dimension limit 30)"


_register_briefs()


@query("select c_mktsegment as dimension, round(sum(try_cast(c_acctbal as double)), 2) as metric, count(*) as n from customer group by 1 order by metric desc nulls last, dimension limit 30")
def metric_by_dimension(spark, sf_dir):
    return reports.brief(table(spark, sf_dir, "customer"), F.col("c_mktsegment"), shape.number("c_acctbal")).withColumn("metric", F.round("metric", 2))


# --- joins and sets ------------------------------------------------------------------------


@query("""select o_custkey from orders where o_orderstatus = 'F' union select o_custkey from orders where o_totalprice > 200000 except select c_custkey from customer where c_acctbal < 0""")
def setops_union_except(spark, sf_dir):
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    both = orders.filter("o_orderstatus = 'F'").select("o_custkey").union(orders.filter("o_totalprice > 200000").select("o_custkey")).distinct()
    return both.subtract(customer.filter("c_acctbal < 0").select("c_custkey"))


@query("select o_custkey from orders where o_orderstatus = 'F' intersect select o_custkey from orders where o_orderstatus = 'O'")
def setops_intersect(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus")
    return orders.filter("o_orderstatus = 'F'").select("o_custkey").intersect(orders.filter("o_orderstatus = 'O'").select("o_custkey"))


@query("""select 'with' as kind, count(*) as n from customer where c_custkey in (select o_custkey from orders where o_totalprice > 150000) union all select 'without', count(*) from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 150000)""")
def semi_anti(spark, sf_dir):
    customer, big = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").filter("o_totalprice > 150000")
    on = F.col("c_custkey") == F.col("o_custkey")
    count = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count(joins.semi(customer, big, on), "with").unionByName(count(joins.anti(customer, big, on), "without"))


@query("""select e.event_id, e.user_id, e.ts, p.ts as last_signup, p.value as signup_value from (select * from events where event_type = 'purchase') e asof left join (select user_id, ts, value from events where event_type = 'signup') p on e.user_id = p.user_id and e.ts >= p.ts""")
def asof_join(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    left = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = events.filter("event_type = 'signup'").select("user_id", F.col("ts").alias("last_signup"), F.col("value").alias("signup_value"))
    return joins.asof(left, right, ["user_id"], "ts", "last_signup", ["last_signup", "signup_value"])


@query("select user_id, event_id, ts, r::int as rank from (select *, row_number() over (partition by user_id order by ts, event_id) as r from events) where r <= 3")
def first_events(spark, sf_dir):
    out = resolve.top_per_group(table(spark, sf_dir, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], 3)
    return out.select("user_id", "event_id", "ts", "rank")


@query("""select event_id, json_extract_string(props, '$.k')::int as k from events""")
def json_prop_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("""select event_type, count(*) filter (where (user_id % 200) between -90 and 90 and (event_id % 400 - 20) between -180 and 180) as points,
count(*) filter (where not ((user_id % 200) between -90 and 90 and (event_id % 400 - 20) between -180 and 180)) as invalid from events group by 1""")
def geo_point_validity(spark, sf_dir):
    df = table(spark, sf_dir, "events").withColumns({"lat": F.col("user_id") % 200, "lon": F.col("event_id") % 400 - 20})
    return geo.point_validity(df, "lat", "lon", "event_type")


# --- vectors and graphs ---------------------------------------------------------------------


@query("""with q as (select embedding::double[] as q from embeddings where vec_id = 0), s as (select vec_id, list_sum(list_transform(range(1, len(embedding) + 1), lambda i: embedding[i]::double * q[i])) / sqrt(list_sum(list_transform(embedding, lambda x: x::double * x)) * list_sum(list_transform(q, lambda x: x * x))) as similarity from embeddings, q)
select vec_id, round(similarity, 4) as similarity from s order by s.similarity desc, vec_id limit 10""")
def cosine_topk(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    found = df.filter("vec_id = 0").select("embedding").first()
    out = vectors.top_k(df, "embedding", list(found[0]) if found else [], 10, "vec_id")
    return out.select("vec_id", F.round("similarity", 4).alias("similarity"))


@query()
def pca_2d(spark, sf_dir):
    return vectors.pca_2d(table(spark, sf_dir, "embeddings"), "embedding", ["vec_id"])


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier and part of every line; suppliers are numbered below zero."""
    return table(spark, sf_dir, "lineitem").select((-1 - F.col("l_suppkey")).alias("src"), F.col("l_partkey").alias("dst"))


def _ordered_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part and part with lines in one order."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    lines = graph.dealt(lines, lines.count(), "l_orderkey").distinct()  # one dealing for this and both sides
    return lines.withColumnRenamed("l_partkey", "src").join(lines.withColumnRenamed("l_partkey", "dst"), "l_orderkey").filter("src < dst").select("src", "dst")


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer and nation, nation and region; nations are numbered below zero, regions below -1000."""
    nation = table(spark, sf_dir, "nation").select((-1 - F.col("n_nationkey")).cast("long").alias("src"), (-1001 - F.col("n_regionkey")).cast("long").alias("dst"))
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("src"), (-1 - F.col("c_nationkey")).cast("long").alias("dst"))
    return nation.unionByName(customer)


_EDGE_ROWS = "(select -1 - l_suppkey as src, l_partkey as dst from lineitem)"
_EDGES = "(select distinct -1 - l_suppkey as src, l_partkey as dst from lineitem)"
_TOGETHER = "(select distinct a.l_partkey as src, b.l_partkey as dst from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_partkey < b.l_partkey)"
_PLACES = "(select (-1 - n_nationkey)::bigint as src, (-1001 - n_regionkey)::bigint as dst from nation union select c_custkey, (-1 - c_nationkey)::bigint from customer)"


@query(f"""with recursive e as {_EDGES}, w as (select src, dst from e union select dst, src from e), r as (select 0 as i, src as node, src as least from w group by 2
union all select i + 1, node, min(least) from (select r.i, w.src as node, r.least from r join w on w.dst = r.node where r.i < 24 union all select i, node, least from r where i < 24) group by 1, 2)
select node, least as component from r where i = 24""")
def graph_components(spark, sf_dir):
    return graph.connected_components(_edges(spark, sf_dir))


@query(f"select node, count(*) as degree from (select src as node from {_EDGE_ROWS} union all select dst from {_EDGE_ROWS}) group by 1")
def graph_degree(spark, sf_dir):
    return graph.degree(_edges(spark, sf_dir))


@query(f"""with e as {_TOGETHER}, w as (select src, dst from e union select dst, src from e), k as (select src as node, count(*) as k from w group by 1),
t as (select a.src as node, count(*) as triangles from w a join w b on a.src = b.src and a.dst < b.dst join e on e.src = a.dst and e.dst = b.dst group by 1)
select k.node, coalesce(triangles, 0) as triangles, round(case when k < 2 then 0 else 2.0 * coalesce(triangles, 0) / (k * (k - 1)) end, 6)::double as coefficient from k left join t on k.node = t.node""")
def graph_clustering(spark, sf_dir):
    return graph.clustering(_ordered_together(spark, sf_dir)).withColumn("coefficient", F.round("coefficient", 6))


@query(f"""with recursive e as {_EDGES}, w as (select src, dst from e union select dst, src from e), r as (select 0 as i, src as node, count(*) as h from w group by 2
union all select i + 1, node, max(least(h, c)) from (select r.i, w.src as node, r.h, row_number() over (partition by w.src order by r.h desc) as c from r join w on w.dst = r.node where r.i < 60) group by 1, 2)
select node, h as core from r where i = 60""")
def graph_core_numbers(spark, sf_dir):
    return graph.core_numbers(_edges(spark, sf_dir))


@query(f"""with recursive e as {_EDGES}, w as (select src, dst from e union select dst, src from e), k as (select src, count(*) as k from w group by 1), n as (select count(*)::double as n from k),
p as (select 0 as i, src as node, 1.0::double / n as rank from k, n union all select p.i + 1, w.dst, (1 - 0.85::double) / n + 0.85::double * sum(rank / k) from p join k on k.src = p.node join w on w.src = p.node, n where p.i < 100 group by p.i, w.dst, n),
m as (select a.i, sum(abs(a.rank - b.rank)) as moved from p a join p b on a.i = b.i + 1 and a.node = b.node group by 1)
select node, round(rank, 8) as rank from p where i = (select coalesce(min(i), 100) from m, n where moved < n * 1e-6)""")
def graph_pagerank(spark, sf_dir):
    return graph.pagerank(_edges(spark, sf_dir)).withColumn("rank", F.round("rank", 8))


@query(f"""with recursive e as {_PLACES}, w as (select src, dst from e union select dst, src from e), r as (select src as s, src as t, 0 as d from w union select r.s, w.dst, r.d + 1 from r join w on w.src = r.t where r.d < 16),
l as (select s, t, min(d) as d from r group by 1, 2), p as (select s, t, d, 1.0::double as n from l where d = 0 union all select l.s, l.t, l.d, sum(p.n) from p join w on w.src = p.t join l on l.s = p.s and l.t = w.dst and l.d = p.d + 1 group by 1, 2, 3),
b as (select x.t as node, sum(x.n * y.n / z.n) as b from p x join p y on x.t = y.s and x.d > 0 and y.d > 0 join p z on z.s = x.s and z.t = y.t and z.d = x.d + y.d group by 1), k as (select distinct src as node from w), n as (select count(*) as n from k)
select k.node, round(case when n > 2 then coalesce(b, 0) / ((n - 1) * (n - 2)) else 0 end, 10)::double as betweenness from n, k left join b on b.node = k.node""")
def graph_betweenness(spark, sf_dir):
    """Of customers, nations and regions, from all of them: pairs of nodes of a region are the work."""
    return graph.betweenness(_places(spark, sf_dir)).withColumn("betweenness", F.round("betweenness", 10))


@query()
def graph_communities(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    labels = graph.communities(edges)
    return labels.crossJoin(F.broadcast(graph.label_modularity(edges, labels)))  # one row


@query("""with recursive e as (select distinct n_nationkey::bigint as src, (100 + n_regionkey)::bigint as dst from nation union select distinct (1000 + c_custkey)::bigint, c_nationkey::bigint from customer),
r as (select src, dst, 1 as depth from e where src <> dst union select r.src, e.dst, depth + 1 from r join e on r.dst = e.src where depth < 5) select src, dst, min(depth)::int as depth from r group by 1, 2""")
def transitive_closure(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("src"), (F.col("n_regionkey") + 100).cast("long").alias("dst"))
    customer = table(spark, sf_dir, "customer").select((F.col("c_custkey") + 1000).cast("long").alias("src"), F.col("c_nationkey").cast("long").alias("dst"))
    return closure.transitive_closure(nation.unionByName(customer))


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands under materials under part; brands are subclasses of size classes, which are disjoint; a material has another name."""
    part = table(spark, sf_dir, "part").select("p_brand", F.element_at(F.split("p_type", " "), -1).alias("metal"), F.concat(F.lit("size:"), (F.col("p_size") % 4).cast("string")).alias("size"))
    size = part.select("size").distinct()
    of = lambda df, relation, src, dst: df.select(F.lit(relation).alias("relation"), src.alias("src"), dst.alias("dst"))
    brand, metal = F.concat(F.lit("brand:"), "p_brand"), F.concat(F.lit("metal:"), "metal")
    facts = of(part, "broader", brand, metal).unionByName(of(part, "broader", metal, F.lit("root:part")))
    facts = facts.unionByName(of(part, "subClassOf", brand, F.col("size"))).unionByName(of(part, "exactMatch", metal, F.concat(F.lit("stuff:"), "metal")))
    return facts.unionByName(of(size.join(size.withColumnRenamed("size", "other"), F.col("size") < F.col("other")), "disjointWith", F.col("size"), F.col("other")))


# Between sizes a < b is asserted; what a brand is disjoint with follows from its sizes, what is disjoint with a brand by symmetry.
_REASONED = """with part_of as (select distinct 'brand:' || p_brand as brand, 'metal:' || split_part(p_type, ' ', -1) as metal, 'size:' || (p_size % 4) as size from part),
sub as (select distinct brand, size from part_of), sizes as (select distinct size from part_of), apart as (select a.size as a, b.size as b from sizes a join sizes b on a.size <> b.size),
far as (select distinct brand, b as size from sub join apart on a = size),
known as (select 'broader' as relation, brand as src, metal as dst, 'asserted' as rule from part_of union select 'broader', metal, 'root:part', 'asserted' from part_of union select 'broader', brand, 'root:part', 'broader-transitive' from part_of
union select 'subClassOf', brand, size, 'asserted' from sub union select 'exactMatch', metal, 'stuff:' || metal[7:], 'asserted' from part_of union select 'exactMatch', 'stuff:' || metal[7:], metal, 'symmetric' from part_of
union select 'disjointWith', a, b, case when a < b then 'asserted' else 'symmetric' end from apart union select 'disjointWith', brand, size, 'disjoint-down' from far union select 'disjointWith', size, brand, 'symmetric' from far
union select 'disjointWith', s.brand, f.brand, 'disjoint-down' from sub s join far f on s.size = f.size where s.brand <> f.brand)"""


@query(f"{_REASONED} select relation, src, dst, rule from known")
def rule_reasoning(spark, sf_dir):
    """All facts that follow from those of the parts, each with the rule that first gave it."""
    return closure.reason(_facts(spark, sf_dir))


@query(f"{_REASONED} select distinct s.src, s.dst from known s join known d on s.src = d.src and s.dst = d.dst where s.relation = 'subClassOf' and d.relation = 'disjointWith'")
def rule_conflicts(spark, sf_dir):
    """Brands that are a subclass of a size class and disjoint with it, as their parts have several sizes."""
    return closure.conflicts(closure.reason(_facts(spark, sf_dir)))


# --- dates, constraints, Python cells -----------------------------------------------------------


@query("""select o_orderkey, date_trunc('day', o_orderdate)::timestamp as parsed from orders where o_orderkey % 5 <> 4 union all select o_orderkey, null from orders where o_orderkey % 5 = 4""")
def parse_dates(spark, sf_dir):
    styled = F.expr("""case o_orderkey % 5 when 0 then date_format(o_orderdate, 'M/d/yyyy') when 1 then date_format(o_orderdate, 'MMMM d, yyyy') when 2 then date_format(o_orderdate, 'yyyy-MM-dd')
                       when 3 then date_format(o_orderdate, 'd MMM yyyy') else 'no date' end""")
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.parse_time(styled).alias("parsed"))


@query("""select 'o_totalprice' as field, 'min_inclusive' as constraint_name, count(*) filter (where o_totalprice < 1000) as violations from orders union all select 'o_totalprice', 'max_inclusive', count(*) filter (where o_totalprice > 400000) from orders
union all select 'o_orderstatus', 'min_count', count(*) filter (where o_orderstatus is null) from orders union all select 'o_orderstatus', 'enumeration', count(*) filter (where o_orderstatus not in ('F', 'O')) from orders
union all select 'o_orderpriority', 'pattern', count(*) filter (where not regexp_matches(o_orderpriority, '^[1-3]-')) from orders union all select 'o_orderpriority', 'datatype', count(*) filter (where try_cast(o_orderpriority as integer) is null) from orders""")
def shape_constraints(spark, sf_dir):
    shapes = [constraints.Shape("o_totalprice", minimum=1000, maximum=400000), constraints.Shape("o_orderstatus", min_count=1, values=("F", "O")), constraints.Shape("o_orderpriority", pattern="^[1-3]-", datatype="int")]
    return constraints.validate(table(spark, sf_dir, "orders"), shapes)


@query("""select l_orderkey, l_linenumber, rank() over (partition by l_orderkey order by l_extendedprice desc, l_linenumber)::int as price_rank from lineitem""")
def python_cell_rank(spark, sf_dir):
    """The rank of each line in its order, equal lines sharing one, by a pandas function on groups of orders."""

    def ranked(pdf):
        # In the order of SQL: no number before all numbers, nulls last; nulls come as flags, so that keys stay whole numbers.
        price = pdf["l_extendedprice"].to_numpy(dtype=float)
        kind = np.where(pdf["unpriced"], 2, np.where(np.isnan(price), 0, 1))
        price = np.where(kind == 1, -price, 0.0)
        keys = [pdf["keyless"], pdf["l_orderkey"], kind, price, pdf["lineless"], pdf["l_linenumber"]]
        keys = [np.asarray(k) for k in keys]
        order = np.lexsort(keys[::-1])
        keys = [k[order] for k in keys]
        places = np.arange(len(order))
        new = lambda some: np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in some])])
        first = lambda some: np.maximum.accumulate(np.where(new(some), places, 0))
        rank = (first(keys) - first(keys[:2]) + 1).astype("int32")
        column = lambda c, absent: pd.arrays.IntegerArray(c.copy(), absent.astype(bool))
        return pd.DataFrame({"l_orderkey": column(keys[1], keys[0]), "l_linenumber": column(keys[5], keys[4]), "price_rank": rank})

    lines = table(spark, sf_dir, "lineitem")
    groups = max(64, -(-lines.count() // 100_000))  # so many rows a group, whatever the table
    absent = lambda c, name: F.col(c).isNull().alias(name)
    filled = [F.coalesce(c, F.lit(0).cast(kind)).alias(c) for c, kind in (("l_orderkey", "long"), ("l_linenumber", "int"), ("l_extendedprice", "double"))]
    flags = [absent("l_orderkey", "keyless"), absent("l_linenumber", "lineless"), absent("l_extendedprice", "unpriced")]
    lines = lines.select(*filled, *flags, F.pmod(F.xxhash64("l_orderkey"), F.lit(groups)).alias("part"))
    return cells.python_cell(lines, ranked, "l_orderkey bigint, l_linenumber int, price_rank int", ["part"])


# --- streams ---------------------------------------------------------------------------------


@query("select date_trunc('day', ts)::timestamp as start, event_type, count(*) as n, round(sum(value), 2) as total from events group by 1, 2")
def streaming_daily(spark, sf_dir):
    batch = table(spark, sf_dir, "events")
    events = streams.read_events(spark, _folder(sf_dir, "events"), batch.schema)
    out = streams.drain(streams.tumbling(events, "ts", "1 day", "event_type", "value"), _memory("daily"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


@query("""with o as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) > interval 6 hour then 1 else 0 end as fresh from events where ts is not null),
s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from o) select user_id, min(ts)::timestamp as start, (max(ts) + interval 6 hour)::timestamp as "end", count(*) as n from s group by user_id, k""")
def streaming_sessions(spark, sf_dir):
    batch = table(spark, sf_dir, "events")
    events = streams.read_events(spark, _folder(sf_dir, "events"), batch.schema)
    out = streams.drain(streams.sessions(events, "ts", "6 hours", "user_id"), _memory("sessions"))
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


def _memory(name: str) -> str:
    import uuid

    return f"loomwork_{name}_{uuid.uuid4().hex[:8]}"


def _folder(sf_dir: str, name: str) -> str:
    """A glob that a file stream accepts for a table that is one file or a folder."""
    return f"{sf_dir}/{name}.parquet*"


# --- charts and tiles ----------------------------------------------------------------------------


@query("""select 'event_type' as category, 'value' as value, round(sum(value) filter (where value > 0), 2) as total from events""")
def chart_columns_pick(spark, sf_dir):
    """The columns a chart of the events takes, found from the values, and what it shows in all."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "value")
    category, value = charts.chart_columns(events) or ("event_type", "value")
    return events.agg(F.round(F.sum(F.when(F.col(value) > 0, F.col(value))), 2).alias("total")).select(F.lit(category).alias("category"), F.lit(value).alias("value"), "total")


@query("select l_returnflag as category, sum(l_quantity) as total, count(*) as rows from lineitem group by 1 order by total desc nulls last, 1 limit 20")
def quick_sum_by(spark, sf_dir):
    types = {"l_quantity": "quantity", "l_returnflag": "event_name"}
    return charts.quick_actions(types, "l_quantity")["sum_l_quantity_by_l_returnflag"](table(spark, sf_dir, "lineitem"))


@query("select p_brand as category, count(*) as n from part group by 1 order by n desc, 1 limit 20")
def quick_count_by(spark, sf_dir):
    return charts.quick_actions({"p_brand": "vendor_name"}, "p_brand")["count_by_p_brand"](table(spark, sf_dir, "part"))


@query("select quality as category, round(avg(toxic), 3) as rate, count(*) as n from labels group by 1")
def quick_rate_by(spark, sf_dir):
    return charts.quick_actions({"toxic": "outcome_flag", "quality": "http_status"}, "toxic")["rate_toxic_by_quality"](table(spark, sf_dir, "labels"))


@query("select date_trunc('day', o_orderdate)::timestamp as day, count(*) as n from orders where o_orderdate is not null group by 1")
def quick_per_day(spark, sf_dir):
    return charts.quick_actions({"o_orderdate": "iso_date"}, "o_orderdate")["per_day_o_orderdate"](table(spark, sf_dir, "orders"))


@query("select count(distinct user_id) as unique_user_id from events")
def quick_unique(spark, sf_dir):
    return charts.quick_actions({"user_id": "user_id"}, "user_id")["unique_user_id"](table(spark, sf_dir, "events"))


@query("select substr(p_brand, 1, 7) as prefix, round(sum(p_retailprice), 2) as total, count(*) as n from part group by 1")
def quick_prefix_totals(spark, sf_dir):
    return charts.prefix_totals(table(spark, sf_dir, "part"), "p_brand", "p_retailprice", 7).withColumn("total", F.round("total", 2))


@query("select coalesce(c_nationkey::varchar, '') as facet, round(sum(c_acctbal), 2) as total from customer where c_acctbal > 0 group by 1 order by sum(c_acctbal) desc, 1 limit 9")
def pie_facets(spark, sf_dir):
    return charts.facets(table(spark, sf_dir, "customer"), "c_nationkey", "c_acctbal").withColumn("total", F.round("total", 2))


@query("select distinct 'p_size' as field, coalesce(p_size::varchar, '') as key, p_size::double as number from part union all select distinct 'p_brand', p_brand, null::double from part")
def pivot_key_order(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    made = [charts.ordered_keys(part, c).select(F.lit(c).alias("field"), "key", "number") for c in ("p_size", "p_brand")]
    return made[0].unionByName(made[1])


@query("select round(sum(o_totalprice), 2) as total, round(avg(o_totalprice), 4) as average, count(*) as count from orders")
def kpi_values(spark, sf_dir):
    return charts.kpi(table(spark, sf_dir, "orders"), "o_totalprice").withColumns({"total": F.round("total", 2), "average": F.round("average", 4)})


@query("select round(sum(o_totalprice), 2) as total, round(avg(o_totalprice), 4) as average, count(*) as n, o_orderstatus from orders group by o_orderstatus")
def kpi_measures(spark, sf_dir):
    """The measures of a tile under their names, by status."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("tile_orders")
    sql = "select round(MEASURE(order_value_total), 2) as total, round(MEASURE(order_value_average), 4) as average, MEASURE(order_value_count) as n, o_orderstatus from tile_orders group by o_orderstatus"
    return spark.sql(macros.expanded(sql, measures=charts.kpi_measures("Order value", "o_totalprice"), dimensions={}))


@query("""select 'c_mktsegment' as column_name, case when d < 0.1 then 1.0 when d < 0.3 then 0.6 else 0.2 end::double * l as score from (select count(distinct c_mktsegment) / count(c_mktsegment) as d, avg((length(c_mktsegment) <= 9)::int) as l from customer)
union all select 'c_custkey', case when d > 0.8 then 1.0 when d > 0.5 then 0.6 else 0.2 end::double * l from (select count(distinct c_custkey) / count(c_custkey) as d, avg((try_cast(c_custkey as double) is not null)::int) as l from customer)""")
def column_distribution(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    few = taxonomy.distribution(customer, "c_mktsegment", low_cardinality=True, max_length=9)
    return few.unionByName(taxonomy.distribution(customer, "c_custkey", high_cardinality=True, numeric=True))


@query("""select 'status_drift' as check_name, 'semantic_drift' as kind, count(*) filter (where o_orderstatus not in ('F', 'O')) as violations, case when count(*) filter (where o_orderstatus not in ('F', 'O')) = 0 then 'PASS' else 'FAIL' end as status from orders
union all select 'price_drift', 'semantic_drift', count(*) filter (where o_totalprice < 0 or o_totalprice > 300000), case when count(*) filter (where o_totalprice < 0 or o_totalprice > 300000) = 0 then 'PASS' else 'FAIL' end from orders
union all select 'priority_drift', 'semantic_drift', count(*) filter (where not regexp_full_match(o_orderpriority, '[1-5]-[A-Z ]+')), case when count(*) filter (where not regexp_full_match(o_orderpriority, '[1-5]-[A-Z ]+')) = 0 then 'PASS' else 'FAIL' end from orders""")
def semantic_drift_checks(spark, sf_dir):
    """Checks of expected types, written as a contract and read again before they run."""
    made = [
        quality.Check("status_drift", "semantic_drift", "o_orderstatus", {"expected_type": "order_status", "constraint": {"kind": "accepted_values", "values": ["F", "O"]}}),
        quality.Check("price_drift", "semantic_drift", "o_totalprice", {"expected_type": "amount", "constraint": {"kind": "valid_range", "min": 0, "max": 300000}}),
        quality.Check("priority_drift", "semantic_drift", "o_orderpriority", {"expected_type": "priority", "constraint": {"kind": "format", "pattern": "[1-5]-[A-Z ]+"}}),
    ]
    return quality.run_checks(table(spark, sf_dir, "orders"), quality.parse_contract(quality.contract("orders", made)))


@query("select event_id, event_type, value from events where value is not null and event_type is not null")
def drop_null_rows(spark, sf_dir):
    return cleaning.drop_null_rows(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), ["value", "event_type"])


@query("""with r as (select min(o_totalprice) as lo, max(o_totalprice) as hi from orders), b as (select least(19, floor((o_totalprice - lo) / ((hi - lo) / 20)))::int as bin, count(*) as n from orders, r group by 1)
select i::int as bin, coalesce(n, 0) as n from range(20) t(i) left join b on b.bin = i""")
def chart_histogram(spark, sf_dir):
    return shape.histogram(table(spark, sf_dir, "orders"), F.col("o_totalprice"), 20).select("bin", "n")


@query("select 'c_acctbal' as column_name, avg((c_acctbal is null)::int)::double as null_share from customer union all select 'c_name', avg((nullif(c_name, '') is null)::int)::double from customer union all select 'c_mktsegment', avg((nullif(c_mktsegment, '') is null)::int)::double from customer")
def wide_null_shares(spark, sf_dir):
    return taxonomy.wide_sample_nulls(table(spark, sf_dir, "customer").select("c_acctbal", "c_name", "c_mktsegment"))


# --- flagship ----------------------------------------------------------------------------------


@query("""select s_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as lines from supplier join lineitem on s_suppkey = l_suppkey group by 1 order by sum(l_extendedprice * (1 - l_discount)) desc, s_name limit 20""")
def supplier_revenue_top(spark, sf_dir):
    """Revenue, a named measure, of each supplier: the largest twenty."""
    for n in ("supplier", "lineitem"):
        table(spark, sf_dir, n).createOrReplaceTempView(f"flag_{n}")
    sql = """select s_name, round(MEASURE(revenue), 2) as revenue, count(*) as lines from flag_supplier join flag_lineitem on s_suppkey = l_suppkey group by s_name order by MEASURE(revenue) desc, s_name limit 20"""
    return spark.sql(macros.expanded(sql, **_FRAGMENTS))
