"""Repair, split, encoding and gate queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabaudit.catalog.auditing import INFLATED, MEASURES, OVERWRITTEN, inflated_panel, overwritten_lines
from tabaudit.catalog.base import LINE_ID, LINEITEM, ORDERS, PANEL, Catalog, lineitem, orders, panel, rounded, u
from tabaudit.catalog.corruption import OKEY, SHIFTED, STATUS_NULLS, shifted_1997, status_nulls
from tabaudit.catalog.slicing import FLAT, HALVED, flat_low, halved_line3
from tabaudit.config import AuditConfig
from tabaudit.functions.lineage import cut
from tabaudit.functions.predicates import slice_pred, window_pred
from tabaudit.operators import corrupt as X
from tabaudit.operators import evaluate as E
from tabaudit.operators import findings as FD
from tabaudit.operators import repair as R
from tabaudit.operators import verify as V
from tabaudit.operators.categorical import detect_missingness
from tabaudit.operators.slices import SliceOptions, numeric_audit
from tabaudit.plans import gate as G
from tabaudit.plans.audit import audit
from tabaudit.sources import io

cat = Catalog()
OID = ["o_orderkey"]


def repair_subtract(spark: SparkSession, d: str) -> DataFrame:
    clean, (dirty, _) = lineitem(spark, d), shifted_1997(spark, d)
    fixed = R.repair_subtract(dirty, "l_quantity", slice_pred("ship_year", "1997"), 10.0)
    cols = ["rid", "l_quantity", "l_returnflag"]
    return V.cell_report(V.align_by_id(clean.select(cols), dirty.select(cols), fixed.select(cols), LINE_ID, check=False))


cat.add("q_repair_subtract", repair_subtract, f"""
with n as (select count(*) filter (ship_year = 1997) as n from {LINEITEM})
select c as "column", case when c = 'l_returnflag' then 0 else n end as injected, case when c = 'l_returnflag' then 0 else n end as repaired,
       cast(0 as bigint) as changed, cast(0 as bigint) as missed, cast(0 as bigint) as collateral, false as warning
from n, (values ('l_quantity'), ('l_returnflag'), ('TOTAL')) v(c)""")


def repair_divide(spark: SparkSession, d: str) -> DataFrame:
    fixed = R.repair_divide(halved_line3(spark, d), "l_extendedprice", slice_pred("l_linenumber", 3), 0.5)
    return rounded(fixed.groupBy("l_linenumber", "ship_year").agg(F.sum("l_extendedprice").alias("price")), price=1)


cat.add("q_repair_divide", repair_divide, f"select l_linenumber, ship_year, round(sum(case when l_linenumber = 3 then l_extendedprice / 0.5::double else l_extendedprice end), 1) as price from {HALVED} group by 1, 2")


def repair_from_reference(spark: SparkSession, d: str) -> DataFrame:
    fixed = R.repair_from_reference(flat_low(spark, d), "o_totalprice", slice_pred("o_orderpriority", "5-LOW"), OID, "ref")
    return rounded(fixed.select("o_orderkey", "o_orderpriority", "o_totalprice"), o_totalprice=4)


cat.add("q_repair_from_reference", repair_from_reference, f"""
with r as (select o_totalprice as x, row_number() over (order by o_totalprice) as k, count(*) over () as n from {FLAT} where o_orderpriority <> '5-LOW'),
s as (select o_orderkey, o_orderpriority, floor({u(OKEY, 'ref')} * (select count(*) from r)) as k from {FLAT} where o_orderpriority = '5-LOW')
select o_orderkey, o_orderpriority, round(x, 4) as o_totalprice from s join r on r.k = s.k + 1
union all select o_orderkey, o_orderpriority, round(o_totalprice, 4) from {FLAT} where o_orderpriority <> '5-LOW'""")


def repair_recategorise(spark: SparkSession, d: str) -> DataFrame:
    fixed = R.repair_recategorise(overwritten_lines(spark, d), "l_returnflag", "ship_year", "1997", LINE_ID, "l_linestatus", "F", "cat")
    return fixed.groupBy("ship_year", "l_linestatus", "l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("keys"))


cat.add("q_repair_recategorise", repair_recategorise, f"""
with m as (select l_returnflag as v, count(*) as n from {OVERWRITTEN} where l_linestatus = 'F' and ship_year <> 1997 group by 1),
c as (select v, sum(n) over (order by n desc, v) as hi, sum(n) over (order by n desc, v) - n as lo, sum(n) over () as t from m),
f as (select ship_year, l_linestatus, l_orderkey, v as l_returnflag from {OVERWRITTEN} join c on floor({u('rid', 'cat')} * t) >= lo and floor({u('rid', 'cat')} * t) < hi
    where l_linestatus = 'F' and ship_year = 1997
  union all select ship_year, l_linestatus, l_orderkey, l_returnflag from {OVERWRITTEN} where not (l_linestatus = 'F' and ship_year = 1997))
select ship_year, l_linestatus, l_returnflag, count(*) as n, cast(sum(l_orderkey) as bigint) as keys from f group by 1, 2, 3""")


def repair_missing(spark: SparkSession, d: str) -> DataFrame:
    dirty, _ = status_nulls(spark, d)
    urgent, high = slice_pred("o_orderpriority", "1-URGENT"), slice_pred("o_orderpriority", "2-HIGH")
    fixed = R.repair_missing(dirty, "o_orderstatus", urgent, {"F": 0.93, "P": 0.07}, OID)
    holed = fixed.withColumn("o_orderstatus", F.when(~high, F.col("o_orderstatus")))
    fixed = R.repair_missing(holed, "o_orderstatus", high, {"O": 0.5, "F": 0.3, "P": 0.2}, OID, "draw")
    return fixed.groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


cat.add("q_repair_missing", repair_missing, f"""
with f as (select o_orderkey, o_orderpriority, case when o_orderpriority = '1-URGENT' then coalesce(o_orderstatus, 'F')
    when o_orderpriority = '2-HIGH' then case when {u(OKEY, 'draw')} < 0.5 then 'O' when {u(OKEY, 'draw')} < 0.8 then 'F' else 'P' end
    else o_orderstatus end as s from {STATUS_NULLS})
select o_orderpriority, s as o_orderstatus, count(*) as n, cast(sum(o_orderkey) as bigint) as keys from f group by 1, 2""")


def gap_panel(spark: SparkSession, d: str) -> DataFrame:
    """panel with collapsed quarters, a long gap for one nation and missing ends for two."""
    p = panel(spark, d).filter(~((F.col("entity") == "NATION_1") & F.col("t").between(9, 14)))
    p = p.filter(~((F.col("entity") == "NATION_2") & (F.col("t") < 5)) & ~((F.col("entity") == "NATION_3") & (F.col("t") > 11)))
    return p.withColumn("revenue", F.when(F.col("t").isin(*BAD), F.col("revenue") * 0.01).otherwise(F.col("revenue")))


BAD = [5, 6, 8, 11, 12, 25]
GAPS = f"""(select entity, t, case when t in ({', '.join(map(str, BAD))}) then revenue * 0.01::double else revenue end as revenue from {PANEL}
  where not (entity = 'NATION_1' and t between 9 and 14) and not (entity = 'NATION_2' and t < 5) and not (entity = 'NATION_3' and t > 11))"""


def repair_interpolate(spark: SparkSession, d: str) -> DataFrame:
    fixed = R.repair_interpolate(gap_panel(spark, d), "revenue", "entity", "t", BAD, BAD)
    return rounded(fixed.select("entity", "t", "revenue"), revenue=3)


cat.add("q_repair_interpolate", repair_interpolate, f"""
with g as (select *, t in ({', '.join(map(str, BAD))}) as bad from {GAPS}),
w as (select *, last_value(case when not bad then t end ignore nulls) over b as t0, last_value(case when not bad then revenue end ignore nulls) over b as x0,
    first_value(case when not bad then t end ignore nulls) over a as t1, first_value(case when not bad then revenue end ignore nulls) over a as x1 from g
  window b as (partition by entity order by t rows between unbounded preceding and 1 preceding), a as (partition by entity order by t rows between 1 following and unbounded following))
select entity, t, round(case when not bad then revenue when t0 is not null and t1 is not null then case when t1 - t0 <= 8 then x0 + (x1 - x0) * (t - t0) / (t1 - t0) else revenue end
    when t0 is not null and t - t0 <= 3 then x0 when t1 is not null and t1 - t <= 3 then x1 else revenue end, 3) as revenue from w""")


def repair_window(spark: SparkSession, d: str) -> DataFrame:
    p = inflated_panel(spark, d)
    fixed = R.repair_window(p, MEASURES, window_pred("entity", "NATION_6", "t", 10, 15), "t", 10, factor=3.0)
    fixed = R.repair_window(fixed, ["revenue"], window_pred("entity", "NATION_7", "t", 4, 9), "t", 4, per_year=1.1)
    return rounded(fixed, revenue=3, quantity=6, n_lines=6)


cat.add("q_repair_window", repair_window, f"""
select entity, t, round(case when entity = 'NATION_7' and t between 4 and 9 then revenue / f / pow(1.1::double, t - 4 + 1) else revenue / f end, 3) as revenue,
       round(quantity / f, 6) as quantity, round(n_lines / f, 6) as n_lines
from (select *, case when entity = 'NATION_6' and t between 10 and 15 then 3.0::double else 1.0::double end as f from {INFLATED})""")


def apply_found(spark: SparkSession, d: str) -> DataFrame:
    """Audit the shifted lineitem and apply what was found; every injected cell is restored."""
    clean, (dirty, _) = lineitem(spark, d), shifted_1997(spark, d)
    # a repair needs the very offset: without the whole ones beside it the folds settle on 11, and the shift of 10 passes for unexplained
    opt = SliceOptions(whole_steps=2)
    found = numeric_audit(dirty, ["ship_year"], ["l_quantity"], row_id=LINE_ID, strata={"ship_year": "l_linenumber"}, opt=opt).collect()
    fixed = R.apply_all(dirty, found, LINE_ID)
    cols = ["rid", "l_quantity"]
    return V.cell_report(V.align_by_id(clean.select(cols), dirty.select(cols), fixed.select(cols), LINE_ID, check=False))


cat.add("q_apply_all", apply_found, f"""
with n as (select count(*) filter (ship_year = 1997) as n from {LINEITEM})
select c as "column", n as injected, n as repaired, cast(0 as bigint) as changed, cast(0 as bigint) as missed, cast(0 as bigint) as collateral, false as warning
from n, (values ('l_quantity'), ('TOTAL')) v(c)""")


def repair_sql(spark: SparkSession, d: str) -> DataFrame:
    f = detect_missingness(status_nulls(spark, d)[0], ["o_orderpriority"], ["o_orderstatus"])
    return R.with_repair_sql(f).select("kind", "level", "target", "repair_sql")


cat.add("q_repair_sql", repair_sql, f"""
select 'mnar_missingness' as kind, '1-URGENT' as level, 'o_orderstatus' as target,
  'case when cast(`o_orderpriority` as string) = ''1-URGENT'' and `o_orderstatus` is null then ''F'' else `o_orderstatus` end' as repair_sql
from {STATUS_NULLS} where o_orderpriority = '1-URGENT' group by o_orderpriority having avg(cast(o_orderstatus is null as int)) > 0.15""")


# -- evaluation -------------------------------------------------------------------

ORDER_CFG = AuditConfig(name="orders", target="high", row_id=("o_orderkey",), numeric_features=("o_totalprice", "o_custkey", "absent"),
                        categorical_features=("o_orderpriority", "o_orderstatus"), id_cols=("o_orderkey",), top_k={"o_orderpriority": 3})


def labelled(df: DataFrame) -> DataFrame:
    return df.withColumn("high", (F.col("o_totalprice") > 250000).cast("int"))


def split_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("high", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


cat.add("q_split2", lambda s, d: split_counts(E.split2(labelled(orders(s, d)), ORDER_CFG, 42)), f"""
select cast(o_totalprice > 250000 as int) as high, case when {u(OKEY, 'split-42')} < 0.3 then 'test' else 'train' end as part, count(*) as n,
       cast(sum(o_orderkey) as bigint) as keys from orders group by 1, 2""")
cat.add("q_split3", lambda s, d: split_counts(E.split3(labelled(orders(s, d)), ORDER_CFG, 42)), f"""
select cast(o_totalprice > 250000 as int) as high, case when {u(OKEY, 'split-42')} < 0.2 then 'test' when {u(OKEY, 'split-42')} < 0.4 then 'validation' else 'train' end as part,
       count(*) as n, cast(sum(o_orderkey) as bigint) as keys from orders group by 1, 2""")
cat.add("q_split3_exact", lambda s, d: split_counts(E.split3(labelled(orders(s, d)), ORDER_CFG, 42, exact=True)), f"""
with r as (select o_orderkey, cast(o_totalprice > 250000 as int) as high, row_number() over (partition by o_totalprice > 250000 order by {u(OKEY, 'split-42')}) as k,
    count(*) over (partition by o_totalprice > 250000) as n from orders)
select high, case when k <= floor(n * 0.2) then 'test' when k <= floor(n * 0.4) then 'validation' else 'train' end as part, count(*) as n,
       cast(sum(o_orderkey) as bigint) as keys from r group by 1, 2""")


def encode(spark: SparkSession, d: str) -> DataFrame:
    dirty = labelled(status_nulls(spark, d)[0])
    dirty = dirty.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 10 != 3, F.col("o_totalprice")))
    enc = E.encode_features(dirty, ORDER_CFG, E.learn_levels(dirty, ORDER_CFG))
    names = [c for c in enc.columns if c != "label"]
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("x")) for c in names])
    long = enc.select("label", F.explode(cells).alias("e")).select("label", "e.*")
    return rounded(long.groupBy("label", "feature").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("total")), total=2)


cat.add("q_encode", encode, f"""
with o as (select *, cast(o_totalprice > 250000 as int) as high, case when o_orderkey % 10 <> 3 then o_totalprice end as p from {STATUS_NULLS}),
m as (select quantile_cont(p, 0.5) as m from o),
k as (select c, v from (select *, row_number() over (partition by c order by n desc, v) as k from (
    select 'o_orderpriority' as c, o_orderpriority as v, count(*) as n from o group by 2 union all
    select 'o_orderstatus', coalesce(o_orderstatus, 'OTHER'), count(*) from o group by 2)) where k <= case when c = 'o_orderpriority' then 3 else 10 end and v <> 'OTHER'),
l as (select c, v from k union all values ('o_orderpriority', 'OTHER'), ('o_orderstatus', 'OTHER')),
h as (select high, c, case when (c, coalesce(v, 'OTHER')) in (select (c, v) from k) then v else 'OTHER' end as v from (
    select high, 'o_orderpriority' as c, o_orderpriority as v from o union all select high, 'o_orderstatus', o_orderstatus from o))
select high as label, 'o_totalprice' as feature, count(*) as n, round(sum(coalesce(p, m)), 2) as total from o, m group by 1
union all select high, 'o_custkey', count(*), round(sum(o_custkey::double), 2) from o group by 1
union all select high, 'absent', count(*), 0.0 from o group by 1
union all select h.high, l.c || '=' || l.v, count(*), sum(cast(h.v = l.v as int))::double from h join l using (c) group by 1, 2""")


def f1(spark: SparkSession, d: str) -> DataFrame:
    o = labelled(orders(spark, d)).withColumn("prediction", (F.col("o_orderpriority") <= "3-MEDIUM").cast("int"))
    return rounded(E.f1_score(o, "high"), f1=10)


cat.add("q_f1", f1, """
with c as (select o_totalprice > 250000 as y, o_orderpriority <= '3-MEDIUM' as p from orders)
select round(2.0 * count(*) filter (y and p) / (2 * count(*) filter (y and p) + count(*) filter (p and not y) + count(*) filter (y and not p)), 10) as f1 from c""")


def best_version(spark: SparkSession, d: str) -> DataFrame:
    h = orders(spark, d).groupBy("o_year").agg(F.round(F.avg((F.col("o_orderstatus") == "F").cast("double")), 3).alias("score"))
    h = h.select(F.concat(F.lit("v"), F.col("o_year").cast("string")).alias("version"), "score", F.col("o_year").alias("step"))
    best = io.best_version(h, "v0")
    summary = G.recovery_summary(h, 0.25, 0.40)
    return rounded(best.join(summary, best.score == summary.best).select("version", "score", "goal", "recovery"), goal=6, recovery=6)


cat.add("q_best_version", best_version, f"""
with h as (select 'v' || o_year as version, round(avg(cast(o_orderstatus = 'F' as int)), 3) as score, o_year as step from {ORDERS} group by o_year)
select arg_max(version, (score, -step)) as version, max(score) as score, 0.28::double as goal, round((max(score) - 0.25) / 0.15, 6) as recovery from h""")


# -- whole plans (no SQL twin: they fit a model or run the whole audit) ---------------

LINE_CFG = AuditConfig(name="lineitem", target="big", row_id=("rid",), numeric_features=("l_quantity", "l_discount"),
                       categorical_features=("l_linestatus",), id_cols=("rid",))


def inject_lines(df: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    return X.corrupt_shift(df, "l_quantity", F.col("ship_year") == 1997, 10.0, keys=LINE_ID, error="quantity_1997")


def line_rows(spark: SparkSession, d: str) -> DataFrame:
    li = lineitem(spark, d).withColumn("big", (F.col("l_quantity") > 25).cast("int"))
    return li.select("rid", "ship_year", "l_linenumber", "l_linestatus", "l_quantity", "l_discount", "big")


def line_table(spark: SparkSession, d: str) -> DataFrame:
    return cut(line_rows(spark, d))


def audit_orders(spark: SparkSession, d: str) -> DataFrame:
    df = labelled(status_nulls(spark, d)[0])
    f = audit(df, ORDER_CFG).findings
    return R.with_repair_sql(f).select("rank", "kind", "slicer", "level", "ref", "target", "n", "confidence", "repair_sql")


cat.add("q_audit", audit_orders)


def gate_lines(spark: SparkSession, d: str) -> DataFrame:
    # the part of a row follows from its rid, which no injection changes: nothing is joined, and each row is hashed once
    clean = cut(E.split3(line_rows(spark, d), LINE_CFG, 42), by="part")
    dirty, _ = inject_lines(clean, 42)
    return G.gated_repair(dirty.filter("part = 'train'").drop("part"), clean.filter("part = 'validation'").drop("part"), LINE_CFG).history


cat.add("q_gate", gate_lines)


def final_test(spark: SparkSession, d: str) -> DataFrame:
    clean = cut(E.split3(line_rows(spark, d), LINE_CFG, 42))
    dirty, _ = inject_lines(clean, 42)
    fixed = R.repair_subtract(dirty, "l_quantity", slice_pred("ship_year", "1997"), 10.0)
    return G.final_test(*[df.filter("part = 'train'") for df in (clean, dirty, fixed)], clean.filter("part = 'test'"), LINE_CFG)


cat.add("q_final_test", final_test)
cat.add("q_seed_sweep", lambda s, d: G.seed_sweep(line_table(s, d), inject_lines, LINE_CFG))
