"""Tabular checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.findings import together
from assay.functions.numbers import parse_number
from assay.functions.text import is_blank
from assay.operators import tabular
from assay.operators.tabular import RowBounds
from assay.plans import query, table

TABLES = {"region": RowBounds(exact=5), "nation": RowBounds(exact=25), "customer": RowBounds(least=1), "supplier": RowBounds(least=1), "part": RowBounds(least=1), "orders": RowBounds(least=1000), "lineitem": RowBounds(least=1000, most=10_000_000_000), "events": RowBounds(most=100)}


@query(
    "select 'region' target, count(*) n_rows, count(*) = 5 ok from region union all select 'nation', count(*), count(*) = 25 from nation "
    "union all select 'customer', count(*), count(*) >= 1 from customer union all select 'supplier', count(*), count(*) >= 1 from supplier union all select 'part', count(*), count(*) >= 1 from part "
    "union all select 'orders', count(*), count(*) >= 1000 from orders union all select 'lineitem', count(*), count(*) between 1000 and 10000000000 from lineitem union all select 'events', count(*), count(*) <= 100 from events"
)
def row_bounds(spark, sf_dir):
    """P3, A4."""
    return together(*(tabular.row_count(table(spark, sf_dir, t), t, b) for t, b in TABLES.items()))


@query("select unnest(['o_clerk', 'o_comment']) column_name")
def required_columns(spark, sf_dir):
    """Two of the five are not in the table."""
    return tabular.missing_columns(table(spark, sf_dir, "orders"), ["o_orderkey", "o_clerk", "o_custkey", "o_comment", "o_orderdate"])


BLANKED = "case when c_custkey % 7 = 0 then '' when c_custkey % 11 = 0 then '  \t' when c_custkey % 13 = 0 then null else c_name end"


@query(f"with t as (select {BLANKED} marked, c_mktsegment from customer) select 'marked' column_name, count(*) filter (where trim(coalesce(marked, ''), E' \\t') = '') n_blank, count(*) n_rows from t union all select 'c_mktsegment', count(*) filter (where trim(coalesce(c_mktsegment, '')) = ''), count(*) from t")
def blank_cells(spark, sf_dir):
    """Blanks are set by a rule so that the check has something to find."""
    marked = table(spark, sf_dir, "customer").select(F.expr(BLANKED).alias("marked"), "c_mktsegment")
    return tabular.blank_counts(marked, ["marked", "c_mktsegment"])


LINE_KEY = "concat(cast(l_orderkey as string), '-', cast(l_linenumber as string))"


@query("select l_orderkey::varchar || '-' || l_linenumber::varchar as value, count(*) n, min(l_partkey) first_row from lineitem group by 1 having count(*) > 1")
def duplicate_keys(spark, sf_dir):
    """A5, W5."""
    return tabular.duplicate_groups(table(spark, sf_dir, "lineitem"), F.expr(LINE_KEY), F.col("l_partkey"))


@query(
    "with t as (select md5(trim(text, E' \\t\\n\\r')) as value, doc_id, row_number() over (partition by md5(trim(text, E' \\t\\n\\r')) order by doc_id) place from documents) "
    "select value, count(*) n, string_agg(doc_id::varchar, ',' order by doc_id) filter (where place <= 20) as rows, greatest(0, count(*) - 20) more from t group by value having count(*) > 1"
)
def duplicate_rows_listed(spark, sf_dir):
    """A3, A5, W7."""
    docs = table(spark, sf_dir, "documents")
    return tabular.listed_rows(docs, F.md5(F.expr("trim(both ' \t\n\r' from text)")), F.col("doc_id"))


AMOUNT = """case o_orderkey % 6
 when 0 then '(' || cast(o_custkey as string) || ',000.50)' when 1 then '₩' || cast(o_custkey as string)
 when 2 then ' +' || cast(o_custkey as string) || '.25 ' when 3 then cast(o_custkey as string) || '%'
 when 4 then 'abc' else '-$' || cast(o_custkey as string) end"""
PARSED = """case o_orderkey % 6 when 0 then -(o_custkey * 1000 + 0.5) when 1 then o_custkey::double when 2 then o_custkey + 0.25
 when 3 then o_custkey::double when 4 then null else -o_custkey::double end"""


@query(f"select o_orderkey % 6 kind, count(*) n_rows, count({PARSED}) counted, round(sum(({PARSED})::decimal(20,2)), 2)::double total from orders group by 1")
def parse_number_roundtrip(spark, sf_dir):
    """N1, A2."""
    orders = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 6).alias("kind"), parse_number(F.expr(AMOUNT)).alias("number"))
    sums = tabular.exact_sums(orders, F.col("number"), ["kind"], {"n_rows": F.lit(True), "counted": F.col("number").isNotNull()})
    return sums.select("kind", "n_rows", "counted", F.when(F.col("counted") > 0, F.round("total", 2)).alias("total"))


@query("select l_returnflag, round(fsum(l_extendedprice), 2) total, count(*) n_rows, abs(fsum(l_extendedprice) - sum(l_extendedprice::decimal(20,2))::double) <= 0.001 holds from lineitem group by 1")
def sum_exact(spark, sf_dir):
    """A1, A6."""
    lines, price = table(spark, sf_dir, "lineitem"), F.col("l_extendedprice")
    sums = tabular.exact_sums(lines, price, ["l_returnflag"], {"n_rows": F.lit(True)})
    check = lines.groupBy("l_returnflag").agg(F.sum(price.cast("decimal(20,2)")).cast("double").alias("check"))
    return sums.join(check, "l_returnflag").select("l_returnflag", F.round("total", 2).alias("total"), "n_rows", tabular.within(F.col("total"), F.col("check")).alias("holds"))


@query("select l_returnflag, sum(l_partkey)::bigint as total, count(*) * 3 as n_rows from lineitem group by 1")
def sum_magnitudes(spark, sf_dir):
    """A1: numbers below a billionth of a billionth among numbers beyond a billion billions, which cancel; no digit is lost."""
    small, large = F.col("l_partkey") * F.pow(F.lit(2.0), F.lit(-70)), F.col("l_orderkey") * F.pow(F.lit(2.0), F.lit(70))
    cells = table(spark, sf_dir, "lineitem").select("l_returnflag", F.explode(F.array(small, large, -large)).alias("x"))
    sums = tabular.exact_sums(cells, F.col("x"), ["l_returnflag"], {"n_rows": F.lit(True)})
    return sums.select("l_returnflag", (F.col("total") * F.pow(F.lit(2.0), F.lit(70))).cast("long").alias("total"), "n_rows")


VALUE = "case when event_id % 5 = 0 then '' when event_id % 7 = 0 then 'n/a' else cast(cast(value as decimal(20,2)) as string) end"


@query(
    "select event_type, sum(case when event_id % 35 = 0 or event_id % 5 = 0 or event_id % 7 = 0 then 0 else value::decimal(20,2) end)::double total, count(*) filter (where event_id % 5 = 0 or event_id % 7 <> 0) counted, "
    "count(*) filter (where event_id % 5 = 0) blanks, count(*) filter (where event_id % 5 <> 0 and event_id % 7 = 0) not_numbers, count(*) n_rows from events group by 1"
)
def empty_as_zero(spark, sf_dir):
    """A1, A2: blank cells count as zero, unreadable ones are left out and listed."""
    events = table(spark, sf_dir, "events").withColumn("cell", F.expr(VALUE))
    return tabular.total(events, F.col("cell"), True, ["event_type"]).select("event_type", F.round("total", 2).alias("total"), "counted", "blanks", "not_numbers", "n_rows")


RECONCILE = """with a as (select fsum(l_extendedprice) t, count(*) n from lineitem), b as (select fsum(l_extendedprice) t, count(*) n from {right})
select round(a.t, 2) left_total, round(b.t, 2) right_total, a.n left_rows, b.n right_rows, abs(a.t - b.t) <= 0.001 sums_agree, a.n = b.n rows_agree,
case when abs(a.t - b.t) <= 0.001 and a.n = b.n then 'pass' else 'fail' end status from a, b"""


def cents(reconciled):
    return reconciled.withColumns({c: F.round(c, 2) for c in ("left_total", "right_total")})


@query(RECONCILE.format(right="lineitem join orders on l_orderkey = o_orderkey"))
def reconcile_sum(spark, sf_dir):
    """J1, balanced: line items measured directly and through their orders."""
    lines, orders = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice"), table(spark, sf_dir, "orders").select("o_orderkey")
    return cents(tabular.reconcile(lines, lines.join(orders, lines.l_orderkey == orders.o_orderkey), F.col("l_extendedprice"), F.col("l_extendedprice")))


@query(RECONCILE.format(right="lineitem join orders on l_orderkey = o_orderkey where o_orderstatus <> 'F'"))
def reconcile_sum_broken(spark, sf_dir):
    """J1, positive control: one status is left out, so it must fail."""
    lines, orders = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice"), table(spark, sf_dir, "orders").filter("o_orderstatus <> 'F'").select("o_orderkey")
    return cents(tabular.reconcile(lines, lines.join(orders, lines.l_orderkey == orders.o_orderkey), F.col("l_extendedprice"), F.col("l_extendedprice")))


@query("with a as (select count(*) n from orders), b as (select count(distinct l_orderkey) n from lineitem) select a.n left_rows, b.n right_rows, a.n = b.n rows_agree from a, b")
def reconcile_rows(spark, sf_dir):
    """Orders without lines make it fail."""
    one = F.lit(0)
    out = tabular.reconcile(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").select("l_orderkey").distinct(), one, one)
    return out.select("left_rows", "right_rows", "rows_agree")


@query(
    "with t as (select c_nationkey, sum(c_acctbal::decimal(20,6)) s from customer group by 1), e as (select unnest([0.0, 0.001, 0.0011, 0.5])::decimal(20,6) d) "
    "select c_nationkey, d::double delta, abs(s - (s + d)) <= 0.001 inside from t, e"
)
def tolerance_edges(spark, sf_dir):
    """The tolerance is inclusive."""
    sums = tabular.exact_sums(table(spark, sf_dir, "customer"), F.col("c_acctbal"), ["c_nationkey"]).select("c_nationkey", F.col("total").cast("decimal(38,6)").alias("s"))
    deltas = F.array(*(F.lit(d).cast("decimal(20,6)") for d in ("0", "0.001", "0.0011", "0.5")))
    rows = sums.select("c_nationkey", "s", F.explode(deltas).alias("d"))
    return rows.select("c_nationkey", F.col("d").cast("double").alias("delta"), tabular.within(F.col("s"), (F.col("s") + F.col("d")).cast("decimal(38,6)")).alias("inside"))


@query("select p_brand, count(*) n, count(*) filter (where trim(coalesce(case when p_partkey % 9 = 0 then ' ' else p_name end, '')) = '') blanks from part group by 1")
def blanks_by_group(spark, sf_dir):
    """P4, A2, per group."""
    part = table(spark, sf_dir, "part").withColumn("cell", F.expr("case when p_partkey % 9 = 0 then ' ' else p_name end"))
    return part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.count_if(is_blank(F.col("cell"))).alias("blanks"))
