"""Error injection and cell verification queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabaudit.catalog.base import LINE_ID, LINEITEM, ORDERS, PANEL, Catalog, lineitem, orders, panel, rounded, u
from tabaudit.operators import corrupt as X
from tabaudit.operators import verify as V

cat = Catalog()
OID = ["o_orderkey"]
OKEY = "cast(o_orderkey as varchar)"
PID = ["entity", "t"]
PKEY = "(entity || '-' || t)"


def _order_summary(df: DataFrame, truth: DataFrame, *aggs) -> DataFrame:
    """The dirty rows with a flag whether they are in the truth table."""
    t = truth.select(F.col("row_id"), F.lit(1).alias("hit"))
    key = F.col("o_orderkey").cast("string")
    return df.join(t, key == F.col("row_id"), "left").withColumn("hit", F.coalesce("hit", F.lit(0)))


def corrupt_overwrite(spark: SparkSession, d: str) -> DataFrame:
    o = orders(spark, d)
    rows = (F.col("o_orderpriority") == "2-HIGH") & (F.col("o_orderstatus") != "O")
    dirty, truth = X.corrupt_overwrite(o, "o_orderstatus", rows, "O", keys=OID, error="e", frac=0.5, salt="s1")
    return _order_summary(dirty, truth).select("o_orderkey", "o_orderstatus", "hit")


cat.add("q_corrupt_overwrite", corrupt_overwrite, f"""
with x as (select *, o_orderpriority = '2-HIGH' and o_orderstatus <> 'O' and {u(OKEY, 's1')} < 0.5 as h from {ORDERS})
select o_orderkey, case when h then 'O' else o_orderstatus end as o_orderstatus, cast(h as int) as hit from x""")


def corrupt_overwrite_cell(spark: SparkSession, d: str) -> DataFrame:
    o = orders(spark, d)
    rows = (F.col("o_orderpriority") == "3-MEDIUM") & (F.col("o_year") == 1997)
    dirty, truth = X.corrupt_overwrite(o, "o_orderstatus", rows, "P", keys=OID, error="e", truth_mode="changed")
    return _order_summary(dirty, truth).groupBy("o_year", "o_orderstatus", "hit").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


cat.add("q_corrupt_overwrite_cell", corrupt_overwrite_cell, f"""
with x as (select *, o_orderpriority = '3-MEDIUM' and o_year = 1997 as h from {ORDERS})
select o_year, case when h then 'P' else o_orderstatus end as o_orderstatus, cast(h and o_orderstatus <> 'P' as int) as hit,
       count(*) as n, cast(sum(o_orderkey) as bigint) as keys from x group by 1, 2, 3""")


def corrupt_overwrite_exact(spark: SparkSession, d: str) -> DataFrame:
    o = orders(spark, d)
    rows = F.col("o_orderpriority") == "1-URGENT"
    dirty, truth = X.corrupt_overwrite(o, "o_orderstatus", rows, "X", keys=OID, error="e", frac=0.3, salt="s2", exact=True)
    return _order_summary(dirty, truth).filter("hit = 1").select("o_orderkey", "o_orderstatus")


cat.add("q_corrupt_overwrite_exact", corrupt_overwrite_exact, f"""
with x as (select *, row_number() over (order by {u(OKEY, 's2')}) as k, count(*) over () as n from {ORDERS} where o_orderpriority = '1-URGENT')
select o_orderkey, 'X' as o_orderstatus from x where k <= floor(n * 0.3)""")


def corrupt_randint(spark: SparkSession, d: str) -> DataFrame:
    li = lineitem(spark, d)
    dirty, truth = X.corrupt_randint(li, "l_quantity", F.col("l_returnflag") == "R", 2, 8, keys=LINE_ID, error="e", frac=0.5, salt="s3")
    hits = truth.select(F.col("row_id").alias("rid"), F.lit(1).alias("hit"))
    j = dirty.join(hits, "rid", "left")
    return j.groupBy("l_returnflag", F.coalesce("hit", F.lit(0)).alias("hit"), "l_quantity").agg(F.count(F.lit(1)).alias("n"))


cat.add("q_corrupt_randint", corrupt_randint, f"""
with x as (select *, l_returnflag = 'R' and {u('rid', 's3')} < 0.5 as h from {LINEITEM})
select l_returnflag, cast(h as int) as hit, case when h then cast(2 + floor({u('rid', 's3-value')} * 7) as double) else l_quantity end as l_quantity,
       count(*) as n from x group by 1, 2, 3""")


def corrupt_scale(spark: SparkSession, d: str) -> DataFrame:
    dirty, truth = X.corrupt_scale(lineitem(spark, d), "l_extendedprice", F.col("l_linenumber") == 3, 0.10, keys=LINE_ID, error="e")
    out = dirty.groupBy("l_linenumber").agg(F.sum("l_extendedprice").alias("price"), F.count(F.lit(1)).alias("n"))
    counts = truth.groupBy("error").agg(F.count(F.lit(1)).alias("n_truth"))
    return rounded(out.join(counts.withColumn("l_linenumber", F.lit(3)), "l_linenumber", "left").select("l_linenumber", "price", "n", "n_truth"), price=1)


cat.add("q_corrupt_scale", corrupt_scale, f"""
select l_linenumber, round(sum(case when l_linenumber = 3 then l_extendedprice * 0.1::double else l_extendedprice end), 1) as price, count(*) as n,
       case when l_linenumber = 3 then count(*) end as n_truth from {LINEITEM} group by 1""")


def corrupt_shift(spark: SparkSession, d: str) -> DataFrame:
    dirty, truth = shifted_1997(spark, d)
    n = truth.groupBy("error").agg(F.count(F.lit(1)).alias("n_truth")).withColumn("ship_year", F.lit(1997))
    out = dirty.groupBy("ship_year").agg(F.sum("l_quantity").alias("quantity"), F.max("l_quantity").alias("top"))
    return out.join(n, "ship_year", "left").select("ship_year", "quantity", "top", "n_truth")


def shifted_1997(spark: SparkSession, d: str, amount: float = 10.0) -> tuple[DataFrame, DataFrame]:
    """lineitem with the quantity raised in ship year 1997, and the truth."""
    return X.corrupt_shift(lineitem(spark, d), "l_quantity", F.col("ship_year") == 1997, amount, keys=LINE_ID, error="quantity_1997")


SHIFTED = f"(select * replace (case when ship_year = 1997 then l_quantity + 10 else l_quantity end as l_quantity) from {LINEITEM})"

cat.add("q_corrupt_shift", corrupt_shift, f"""
select ship_year, sum(l_quantity) as quantity, max(l_quantity) as top, case when ship_year = 1997 then count(*) end as n_truth
from {SHIFTED} group by 1""")


def status_nulls(spark: SparkSession, d: str, frac: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """orders with 70% of the status F missing where the priority is 1-URGENT."""
    rows = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F")
    return X.corrupt_null(orders(spark, d), "o_orderstatus", rows, frac, keys=OID, error="status_urgent", salt="s4")


STATUS_NULLS = f"""(select * replace (case when o_orderpriority = '1-URGENT' and o_orderstatus = 'F' and {u(OKEY, 's4')} < 0.7 then null
  else o_orderstatus end as o_orderstatus) from {ORDERS})"""


def corrupt_null(spark: SparkSession, d: str) -> DataFrame:
    dirty, _ = status_nulls(spark, d)
    return dirty.groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


cat.add("q_corrupt_null", corrupt_null, f"""
select o_orderpriority, o_orderstatus, count(*) as n, cast(sum(o_orderkey) as bigint) as keys from {STATUS_NULLS} group by 1, 2""")


def corrupt_collapse(spark: SparkSession, d: str) -> DataFrame:
    dirty, _ = X.corrupt_collapse(panel(spark, d), "revenue", F.col("t").isin(5, 11, 17), keys=PID, error="e", salt="s5")
    return rounded(dirty.select("entity", "t", "revenue"), revenue=4)


cat.add("q_corrupt_collapse", corrupt_collapse, f"""
select entity, t, round(case when t in (5, 11, 17) then revenue * ({u(PKEY, 's5')} * 0.03::double) else revenue end, 4) as revenue from {PANEL}""")


def corrupt_quantile_band(spark: SparkSession, d: str) -> DataFrame:
    dirty, truth = X.corrupt_quantile_band(panel(spark, d), "quantity", F.col("entity").isin("NATION_2", "NATION_8"), keys=PID, error="e", salt="s6")
    return rounded(dirty.select("entity", "t", "quantity"), quantity=6)


cat.add("q_corrupt_quantile_band", corrupt_quantile_band, f"""
with p as (select * from {PANEL}), q as (select quantile_cont(quantity, 0.85) as lo, quantile_cont(quantity, 0.95) as hi from p)
select entity, t, round(case when entity in ('NATION_2', 'NATION_8') then lo + {u(PKEY, 's6')} * (hi - lo) else quantity end, 6) as quantity
from p, q""")


def corrupt_window(spark: SparkSession, d: str) -> DataFrame:
    dirty, truth = X.corrupt_window(panel(spark, d), ["revenue", "quantity", "n_lines"], "entity", ["NATION_3", "NATION_11"], "t", 10, 15, 1.30, keys=PID, error="e")
    hit = truth.select("row_id", F.lit(1).alias("hit"))
    out = dirty.join(hit, F.concat_ws("-", "entity", "t") == F.col("row_id"), "left").select("entity", "t", "revenue", "quantity", "n_lines", F.coalesce("hit", F.lit(0)).alias("hit"))
    return rounded(out, revenue=3, quantity=6, n_lines=6)


cat.add("q_corrupt_window", corrupt_window, f"""
with x as (select *, entity in ('NATION_3', 'NATION_11') and t between 10 and 15 as h from {PANEL}),
f as (select *, case when h then 1.3::double else 1.0::double end as f from x)
select entity, t, round(revenue * f, 3) as revenue, round(quantity * f, 6) as quantity, round(n_lines * f, 6) as n_lines, cast(h as int) as hit from f""")


def ground_truth_counts(spark: SparkSession, d: str) -> DataFrame:
    _, a = shifted_1997(spark, d)
    _, b = status_nulls(spark, d)
    return X.ground_truth_counts(X.ground_truth(a, b))


cat.add("q_ground_truth_counts", ground_truth_counts, f"""
select 'quantity_1997' as error, count(*) as n_rows from {LINEITEM} where ship_year = 1997
union all select 'status_urgent', count(*) from {ORDERS} where o_orderpriority = '1-URGENT' and o_orderstatus = 'F' and {u(OKEY, 's4')} < 0.7""")


# -- verification: three versions of one table ---------------------------------

def order_versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """clean, dirty (price +1000 on 2-HIGH, status nulled on urgent F) and a partly wrong cleaning."""
    clean = orders(spark, d).select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority", "o_year")
    dirty, _ = status_nulls(spark, d)
    dirty = dirty.withColumn("o_totalprice", F.when(F.col("o_orderpriority") == "2-HIGH", F.col("o_totalprice") + 1000).otherwise(F.col("o_totalprice")))
    dirty = dirty.filter(F.col("o_orderkey") % 97 != 5)
    price = (
        F.when((F.col("o_orderpriority") == "2-HIGH") & (F.col("o_orderkey") % 5 != 0), F.col("o_totalprice") - 1000)
        .when((F.col("o_orderpriority") == "2-HIGH") & (F.col("o_orderkey") % 10 == 0), F.col("o_totalprice") - 999)
        .when(F.col("o_orderkey") % 11 == 0, F.col("o_totalprice") + 0.001)
        .when(F.col("o_orderkey") % 13 == 0, F.col("o_totalprice") * 2)
        .otherwise(F.col("o_totalprice"))
    )
    status = F.coalesce("o_orderstatus", F.when(F.col("o_orderkey") % 3 == 0, "P").when(F.col("o_orderkey") % 3 == 1, "F"))
    cleaned = dirty.withColumn("o_totalprice", price).withColumn("o_orderstatus", status)
    return clean, dirty, cleaned.filter(F.col("o_orderkey") % 89 != 7)


O_CLEAN = f"(select o_orderkey, o_orderstatus, o_totalprice, o_orderpriority from {ORDERS})"
O_DIRTY = f"""(select o_orderkey, o_orderstatus, case when o_orderpriority = '2-HIGH' then o_totalprice + 1000 else o_totalprice end as o_totalprice
  from {STATUS_NULLS} where o_orderkey % 97 <> 5)"""
O_CLEANED = f"""(select d.o_orderkey, coalesce(d.o_orderstatus, case d.o_orderkey % 3 when 0 then 'P' when 1 then 'F' end) as o_orderstatus,
  case when o_orderpriority = '2-HIGH' and d.o_orderkey % 5 <> 0 then d.o_totalprice - 1000
       when o_orderpriority = '2-HIGH' and d.o_orderkey % 10 = 0 then d.o_totalprice - 999
       when d.o_orderkey % 11 = 0 then d.o_totalprice + 0.001 when d.o_orderkey % 13 = 0 then d.o_totalprice * 2
       else d.o_totalprice end as o_totalprice
  from {O_DIRTY} d join orders o on o.o_orderkey = d.o_orderkey where d.o_orderkey % 89 <> 7)"""
O_ALIGNED = f"""(select c.o_orderkey, c.o_orderstatus as cs, d.o_orderstatus as ds, r.o_orderstatus as rs,
  c.o_totalprice as cp, d.o_totalprice as dp, r.o_totalprice as rp
  from {O_CLEAN} c join {O_DIRTY} d using (o_orderkey) join {O_CLEANED} r using (o_orderkey))"""


def _num_diff(a: str, b: str) -> str:
    return f"(abs({a} - {b}) > 1e-6 * (1 + abs({a})))"


def _status(c: str, d: str, r: str, diff) -> str:
    return (f"case when {diff(c, d)} and not {diff(r, c)} then 'REPAIRED' when {diff(c, d)} and not {diff(r, d)} then 'MISSED' "
            f"when {diff(c, d)} then 'CHANGED' when {diff(r, c)} then 'COLLATERAL' end")


O_CELLS = f"""(select o_orderkey, 'o_totalprice' as col, {_status('cp', 'dp', 'rp', _num_diff)} as status,
    cp, dp, rp, null as cs, null as ds, null as rs from {O_ALIGNED}
  union all select o_orderkey, 'o_orderstatus', {_status('cs', 'ds', 'rs', lambda a, b: f'({a} is distinct from {b})')},
    null, null, null, cs, ds, rs from {O_ALIGNED})"""
_COUNTS = ", ".join(f"count(*) filter (status = '{s}') as {s.lower()}" for s in V.STATUSES)
REPORT_TAIL = f"""injected, repaired, changed, missed, collateral, collateral > 0 as warning"""


def align_id(spark: SparkSession, d: str) -> DataFrame:
    a = V.align_by_id(*order_versions(spark, d), OID)
    out = a.select("o_orderkey", F.col("clean.o_totalprice").alias("clean_price"), F.col("dirty.o_totalprice").alias("dirty_price"),
                   F.col("cleaned.o_orderstatus").alias("cleaned_status"))
    return rounded(out, dirty_price=4)


cat.add("q_align_id", align_id, f"""
select o_orderkey, cp as clean_price, round(dp, 4) as dirty_price, rs as cleaned_status from {O_ALIGNED}""")

cat.add("q_cell_report", lambda s, d: V.cell_report(V.align_by_id(*order_versions(s, d), OID)), f"""
with c as (select coalesce(col, 'TOTAL') as "column", {_COUNTS} from (
    select col, status from {O_CELLS} union all select c, null from (values ('o_orderdate'), ('o_orderpriority'), ('o_year')) v(c)) group by rollup (col))
select "column", repaired + changed + missed as injected, repaired, changed, missed, collateral, collateral > 0 as warning from c""")


def cell_diff(spark: SparkSession, d: str) -> DataFrame:
    out = V.cell_diff(V.align_by_id(*order_versions(spark, d), OID))
    number = F.col("column") == "o_totalprice"
    price = {f"{s}_price": F.round(F.when(number, F.col(s)).cast("double"), 3) for s in V.SIDES}
    text = {f"{s}_status": F.when(~number, F.col(s)) for s in V.SIDES}
    return out.withColumns({**price, **text}).drop(*V.SIDES)


cat.add("q_cell_diff", cell_diff, f"""
select o_orderkey, col as "column", status, round(cp, 3) as clean_price, round(dp, 3) as dirty_price, round(rp, 3) as cleaned_price,
       cs as clean_status, ds as dirty_status, rs as cleaned_status from {O_CELLS} where status is not null""")


L_ORDER = ["l_partkey", "l_suppkey", "l_shipdate"]
L_KEY = ["l_orderkey", "l_linenumber"]


def line_versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    cols = [*L_KEY, *L_ORDER, "l_quantity", "l_returnflag"]
    clean = lineitem(spark, d).select(*cols, "ship_year")
    dirty, _ = shifted_1997(spark, d)
    dirty = dirty.select(*clean.columns).filter(F.col("l_partkey") % 50 != 7)
    fixed = F.when((F.col("ship_year") == 1997) & (F.col("l_suppkey") % 2 == 0), F.col("l_quantity") - 10).otherwise(F.col("l_quantity"))
    return clean.drop("ship_year"), dirty.drop("ship_year"), dirty.withColumn("l_quantity", fixed).drop("ship_year")


def _line_aligned_sql() -> str:
    num = f"row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_shipdate) as pair_no"
    clean = f"(select *, {num} from {LINEITEM})"
    dirty = f"(select *, {num} from {SHIFTED} where l_partkey % 50 <> 7)"
    cleaned = f"""(select * replace (case when ship_year = 1997 and l_suppkey % 2 = 0 then l_quantity - 10 else l_quantity end as l_quantity) from {dirty})"""
    return f"""(select l_orderkey, l_linenumber, pair_no, c.l_quantity as cq, d.l_quantity as dq, r.l_quantity as rq,
      c.l_partkey as cpk, d.l_partkey as dpk, r.l_partkey as rpk, c.l_suppkey as csk, d.l_suppkey as dsk, r.l_suppkey as rsk,
      c.l_shipdate as csd, d.l_shipdate as dsd, r.l_shipdate as rsd, c.l_returnflag as crf, d.l_returnflag as drf, r.l_returnflag as rrf
      from {clean} c join {dirty} d using (l_orderkey, l_linenumber, pair_no) join {cleaned} r using (l_orderkey, l_linenumber, pair_no))"""


L_ALIGNED = _line_aligned_sql()


def align_key(spark: SparkSession, d: str) -> DataFrame:
    a = V.align_by_key(*line_versions(spark, d), L_KEY, L_ORDER)
    return a.select(*L_KEY, "pair_no", F.col("clean.l_quantity").alias("clean_q"), F.col("dirty.l_quantity").alias("dirty_q"),
                    F.col("cleaned.l_quantity").alias("cleaned_q"), F.col("dirty.l_partkey").alias("dirty_part"))


cat.add("q_align_key", align_key, f"""
select l_orderkey, l_linenumber, pair_no, cq as clean_q, dq as dirty_q, rq as cleaned_q, dpk as dirty_part from {L_ALIGNED}""")


def unmatched(spark: SparkSession, d: str) -> DataFrame:
    clean, dirty, cleaned = line_versions(spark, d)
    return V.unmatched_rows(dirty, V.align_by_key(clean, dirty, cleaned.filter(F.col("l_partkey") % 31 != 3), L_KEY, L_ORDER))


def _unmatched_sql() -> str:
    dirty = f"(select * from {SHIFTED} where l_partkey % 50 <> 7)"
    n = "select l_orderkey, l_linenumber, count(*) as n from"
    g = "group by 1, 2"
    return f"""with c as ({n} {LINEITEM} {g}), d as ({n} {dirty} {g}), r as ({n} {dirty} where l_partkey % 31 <> 3 {g}),
m as (select sum(least(c.n, d.n, r.n)) as m from c join d using (l_orderkey, l_linenumber) join r using (l_orderkey, l_linenumber))
select cast((select count(*) from {dirty}) - m as bigint) as lost, cast(m as bigint) as matched from m"""


cat.add("q_unmatched_rows", unmatched, _unmatched_sql())


def _line_report_sql() -> str:
    parts = []
    for col, k in (("l_quantity", "q"), ("l_partkey", "pk"), ("l_suppkey", "sk")):
        parts.append(f"select '{col}' as col, {_status('c' + k, 'd' + k, 'r' + k, _num_diff)} as status from {L_ALIGNED}")
    for col, k in (("l_shipdate", "sd"), ("l_returnflag", "rf")):
        parts.append(f"select '{col}' as col, {_status('c' + k, 'd' + k, 'r' + k, lambda a, b: f'({a} is distinct from {b})')} as status from {L_ALIGNED}")
    return f"""with c as (select coalesce(col, 'TOTAL') as "column", {_COUNTS} from ({' union all '.join(parts)}) group by rollup (col))
select "column", repaired + changed + missed as injected, repaired, changed, missed, collateral, collateral > 0 as warning from c"""


cat.add("q_cell_report_by_key", lambda s, d: V.cell_report(V.align_by_key(*line_versions(s, d), L_KEY, L_ORDER)), _line_report_sql())


def restoration(spark: SparkSession, d: str) -> DataFrame:
    clean, dirty, cleaned = order_versions(spark, d)
    _, nulls = status_nulls(spark, d)
    price = X.truth_of(clean, F.col("o_orderpriority") == "2-HIGH", "price_high", OID)
    rules = {
        "price_high": {"column": "o_totalprice", "within": V.within_abs(1.5)},
        "status_urgent": {"column": "o_orderstatus", "only": lambda a, dd: V.cells_differ(a, dd), "within": lambda r, a: r.isNotNull()},
    }
    return V.restoration_report(X.ground_truth(price, nulls), clean, dirty, cleaned, OID, rules)


cat.add("q_restoration", restoration, f"""
select 'price_high' as error, count(*) as n_rows, count(*) filter ({_num_diff('rp', 'dp')}) as n_changed,
       count(*) filter (not {_num_diff('rp', 'cp')}) as n_exact, count(*) filter (abs(rp - cp) <= 1.5) as n_within
from {O_ALIGNED} join orders using (o_orderkey) where o_orderpriority = '2-HIGH'
union all
select 'status_urgent', count(*), count(*) filter (rs is distinct from ds), count(*) filter (rs is not distinct from cs), count(*) filter (rs is not null)
from {O_ALIGNED} join orders o using (o_orderkey) where o_orderpriority = '1-URGENT' and o.o_orderstatus = 'F' and {u('cast(o_orderkey as varchar)', 's4')} < 0.7
  and cs is distinct from ds""")
