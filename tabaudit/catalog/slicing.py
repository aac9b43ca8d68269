"""Grouped statistics and numeric slice audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabaudit.catalog.base import LINE_ID, LINEITEM, ORDERS, PANEL, Catalog, lineitem, orders, panel, rounded, table, u
from tabaudit.catalog.corruption import SHIFTED, STATUS_NULLS, shifted_1997, status_nulls
from tabaudit.catalog.slice_sql import FOUND, audit_ctes, deduped
from tabaudit.functions.order_stats import fine_for
from tabaudit.functions.ks import ks_floor, ks_two_sample, ks_vs_rest
from tabaudit.operators import corrupt as X
from tabaudit.operators import slices as S
from tabaudit.operators import stats as A
from tabaudit.operators.panel import robust_z

cat = Catalog()

cat.add("q_null_rates", lambda s, d: rounded(A.null_rates(status_nulls(s, d)[0], "o_orderpriority", "o_orderstatus"), null_rate=8), f"""
select o_orderpriority as level, count(*) as n, round(avg(cast(o_orderstatus is null as int)), 8) as null_rate from {STATUS_NULLS} group by 1""")

cat.add("q_crosstab_shares", lambda s, d: rounded(A.crosstab_shares(status_nulls(s, d)[0], "o_orderpriority", "o_orderstatus"), share=8), f"""
with c as (select o_orderpriority as level, o_orderstatus as value, count(*) as n from {STATUS_NULLS} where o_orderstatus is not null group by 1, 2)
select level, value, n, cast(t as bigint) as n_level, round(n / t, 8) as share from (select *, sum(n) over (partition by level) as t from c) where t >= 20""")

cat.add("q_stratum_medians", lambda s, d: rounded(A.stratum_medians(shifted_1997(s, d)[0], "ship_year", "l_linenumber", "l_extendedprice"), median=4), f"""
select cast(ship_year as varchar) as level, cast(l_linenumber as varchar) as stratum, count(*) as n, round(quantile_cont(l_extendedprice, 0.5), 4) as median
from {SHIFTED} group by 1, 2""")

cat.add("q_complement", lambda s, d: rounded(A.complement_medians(orders(s, d), "o_orderpriority", "o_totalprice"), median=4), f"""
with l as (select distinct o_orderpriority as level from orders)
select level, 'own' as side, count(*) as n, round(quantile_cont(o_totalprice, 0.5), 4) as median from l join orders on o_orderpriority = level group by 1
union all
select level, 'rest', count(*), round(quantile_cont(o_totalprice, 0.5), 4) from l join orders on o_orderpriority <> level group by 1""")

cat.add("q_value_shares", lambda s, d: rounded(A.value_shares(status_nulls(s, d)[0], "o_orderstatus"), share=8), f"""
select o_orderstatus as value, count(*) as n, round(count(*) / sum(count(*)) over (), 8) as share from {STATUS_NULLS} where o_orderstatus is not null group by 1""")

cat.add("q_tv", lambda s, d: rounded(A.tv_vs_rest(status_nulls(s, d)[0], "o_orderpriority", "o_orderstatus"), tv=8), f"""
with b as (select o_orderpriority as p, o_orderstatus as v from {STATUS_NULLS} where o_orderstatus is not null),
l as (select distinct p as level from b), v as (select distinct v from b),
o as (select l.level, v.v, (select count(*) from b where b.p = l.level and b.v = v.v) as a, (select count(*) from b where b.p <> l.level and b.v = v.v) as r from l, v),
t as (select *, sum(a) over (partition by level) as ta, sum(r) over (partition by level) as tr from o)
select level, round(0.5 * sum(abs(a / ta - r / tr)), 8) as tv from t group by 1""")


def tv_two_tables(spark: SparkSession, d: str) -> DataFrame:
    a = A.crosstab_shares(orders(spark, d), "o_orderpriority", "o_orderstatus")
    b = A.crosstab_shares(status_nulls(spark, d)[0], "o_orderpriority", "o_orderstatus")
    return rounded(A.tv_distance(a, b, ["level"]), tv=8)


cat.add("q_tv_before_after", tv_two_tables, f"""
with a as (select o_orderpriority as level, o_orderstatus as v, count(*) / sum(count(*)) over (partition by o_orderpriority) as p from orders group by 1, 2),
b as (select o_orderpriority as level, o_orderstatus as v, count(*) / sum(count(*)) over (partition by o_orderpriority) as p
  from {STATUS_NULLS} where o_orderstatus is not null group by 1, 2)
select level, round(0.5 * sum(abs(coalesce(a.p, 0) - coalesce(b.p, 0))), 8) as tv from a full join b using (level, v) group by 1""")


def _ks_rest_sql(src: str, slicer: str, x: str) -> str:
    return f"""with b as (select cast({slicer} as varchar) as lv, {x} as x from {src}),
h as (select l.level, b.x, count(*) filter (b.lv = l.level) as a, count(*) filter (b.lv <> l.level) as r from (select distinct lv as level from b) l, b group by 1, 2),
c as (select level, sum(a) over w as ca, sum(r) over w as cr, sum(a) over (partition by level) as na, sum(r) over (partition by level) as nr
  from h window w as (partition by level order by x))
select level, cast(na as bigint) as n, round(max(abs(ca / na - cr / nr)), 10) as ks from c group by 1, 2"""


cat.add("q_ks_vs_rest", lambda s, d: rounded(ks_vs_rest(lineitem(s, d), "l_returnflag", "l_extendedprice"), ks=10), _ks_rest_sql("lineitem", "l_returnflag", "l_extendedprice"))
cat.add("q_ks_events", lambda s, d: rounded(ks_vs_rest(table(s, d, "events"), "event_type", "value"), ks=10), _ks_rest_sql("events", "event_type", "value"))


def ks_pair(spark: SparkSession, d: str) -> DataFrame:
    li = lineitem(spark, d)
    a = li.filter("l_returnflag = 'A'").select("l_linestatus", "l_extendedprice")
    b = li.filter("l_returnflag = 'R'").select("l_linestatus", "l_extendedprice")
    return rounded(ks_two_sample(a, b, ["l_linestatus"], "l_extendedprice"), ks=10)


cat.add("q_ks_pair", ks_pair, """
with h as (select l_linestatus, l_extendedprice as x, count(*) filter (l_returnflag = 'A') as a, count(*) filter (l_returnflag = 'R') as r
  from lineitem where l_returnflag in ('A', 'R') group by 1, 2),
c as (select l_linestatus, sum(a) over w as ca, sum(r) over w as cr, sum(a) over (partition by l_linestatus) as na, sum(r) over (partition by l_linestatus) as nr
  from h window w as (partition by l_linestatus order by x))
select l_linestatus, round(max(abs(ca / na - cr / nr)), 10) as ks from c group by 1""")


def ks_floors(spark: SparkSession, d: str) -> DataFrame:
    n = lineitem(spark, d).groupBy("ship_year").agg(F.count(F.lit(1)).alias("n_a"), F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("n_b"))
    return n.select("ship_year", F.round(ks_floor(F.col("n_a"), F.col("n_b")), 10).alias("floor"))


cat.add("q_ks_floor", ks_floors, f"""
select ship_year, round(1.36 * sqrt((a + b) / (a::double * b)), 10) as floor from (
  select ship_year, count(*) as a, count(*) filter (l_returnflag = 'R') as b from {LINEITEM} group by 1)""")


def robust_scores(spark: SparkSession, d: str) -> DataFrame:
    return rounded(robust_z(panel(spark, d).select("entity", "t", "quantity"), ["t"], "quantity").select("entity", "t", "z"), z=6)


cat.add("q_robust_z", robust_scores, f"""
with m as (select *, quantile_cont(quantity, 0.5) over (partition by t) as med from {PANEL}),
a as (select *, quantile_cont(abs(quantity - med), 0.5) over (partition by t) as mad from m)
select entity, t, round((quantity - med) / (1.4826 * (mad + 1e-9)), 6) as z from a""")


# -- numeric audit ---------------------------------------------------------------

YEAR = {"ship_year": "l_linenumber"}
LINE = {"l_linenumber": "ship_year"}


def halved_line3(spark: SparkSession, d: str) -> DataFrame:
    return X.corrupt_scale(lineitem(spark, d), "l_extendedprice", F.col("l_linenumber") == 3, 0.5, keys=LINE_ID, error="e")[0]


HALVED = f"(select * replace (case when l_linenumber = 3 then l_extendedprice * 0.5::double else l_extendedprice end as l_extendedprice) from {LINEITEM})"


def mixed_line3(spark: SparkSession, d: str) -> DataFrame:
    li = lineitem(spark, d)
    rows = X.sampled(li, F.col("l_linenumber") == 3, 0.5, LINE_ID, "mix")
    return X.corrupt_shift(li, "l_extendedprice", rows, 60000.0, keys=LINE_ID, error="e")[0]


MIXED = f"""(select * replace (case when l_linenumber = 3 and {u('rid', 'mix')} < 0.5 then l_extendedprice + 60000 else l_extendedprice end as l_extendedprice) from {LINEITEM})"""


def flat_low(spark: SparkSession, d: str) -> DataFrame:
    o = orders(spark, d)
    low = F.col("o_orderpriority") == "5-LOW"
    return o.withColumn("o_totalprice", F.when(low, 450000 + F.col("o_totalprice") / 1000).otherwise(F.col("o_totalprice")))


FLAT = "(select * replace (case when o_orderpriority = '5-LOW' then 450000 + o_totalprice / 1000 else o_totalprice end as o_totalprice) from orders)"


def raised_high(spark: SparkSession, d: str) -> DataFrame:
    rows = F.col("o_orderpriority") == "2-HIGH"
    return X.corrupt_shift(orders(spark, d), "o_totalprice", rows, 80000.0, keys=["o_orderkey"], error="e")[0]


RAISED = "(select * replace (case when o_orderpriority = '2-HIGH' then o_totalprice + 80000 else o_totalprice end as o_totalprice) from orders)"


def raised_status(spark: SparkSession, d: str) -> DataFrame:
    return X.corrupt_shift(lineitem(spark, d), "l_quantity", F.col("l_linestatus") == "F", 10.0, keys=LINE_ID, error="e")[0]


RAISED_STATUS = f"(select * replace (case when l_linestatus = 'F' then l_quantity + 10 else l_quantity end as l_quantity) from {LINEITEM})"
OKEY = "cast(o_orderkey as varchar)"


def offsets(spark: SparkSession, d: str) -> DataFrame:
    _, _, cells = S.prepare(shifted_1997(spark, d)[0], ["ship_year"], ["l_quantity"], YEAR)
    out = cells.select("level", "n_a", "n_b", "scale", "strata", F.col("delta0").alias("delta"), "iqr", "sign", "ratio", S.may_be_offset().alias("detected"))
    return rounded(out, scale=6, delta=6, iqr=6, sign=6, ratio=6)


YEAR_AUDIT = audit_ctes(SHIFTED, "ship_year", "l_quantity", "l_linenumber", pairwise=False, whole=True)
cat.add("q_offsets", offsets, f"""{YEAR_AUDIT}
select lv as level, n_a, n_b, round(scale, 6) as scale, strata, round(delta0, 6) as delta, round(iqr, 6) as iqr, round(sign, 6) as sign, round(ratio, 6) as ratio,
       cid in (select cid from cand) as detected from cells_t""")


def collapse(spark: SparkSession, d: str) -> DataFrame:
    _, _, cells = S.prepare(flat_low(spark, d), ["o_orderpriority"], ["o_totalprice"], {})
    f = S.collapse_findings(cells)
    return rounded(f.select("kind", "level", "ref", "n", "confidence", F.col("repair.type").alias("repair"), F.col("stats.delta").alias("delta")), delta=3)


cat.add("q_collapse", collapse, f"""{audit_ctes(FLAT, "o_orderpriority", "o_totalprice", None, pairwise=True, whole=False, key=OKEY)}
select 'collapse' as kind, lv as level, ref, n_a as n, 'REPAIR' as confidence, 'impute_from_reference' as repair, round(med_a - med_b, 3) as delta from flags where collapsed""")


def _evaluated(df: DataFrame, slicer: str, target: str, strata: dict, row_id: list[str], opt: S.SliceOptions) -> DataFrame:
    whole, edges, cells = S.prepare(df, [slicer], [target], strata)
    cand = S.candidates_of(cells)
    return S.evaluate_candidates(df, cand, S.members_of(df, cells, cand), edges, whole, row_id, opt)


def refine_shift(spark: SparkSession, d: str) -> DataFrame:
    t = _evaluated(shifted_1997(spark, d)[0], "ship_year", "l_quantity", YEAR, LINE_ID, S.SliceOptions(acceptance="asymptotic"))
    return rounded(t.select("level", "ks0", "delta", F.col("ks_add").alias("ks_fit")), ks0=8, delta=6, ks_fit=8)


cat.add("q_refine_shift", refine_shift, f"""{audit_ctes(SHIFTED, "ship_year", "l_quantity", "l_linenumber", pairwise=False, whole=True, acceptance="asymptotic")}
select lv as level, round(ks0, 8) as ks0, round(delta, 6) as delta, round(ks_fit, 8) as ks_fit from found""")


def crossfit(spark: SparkSession, d: str) -> DataFrame:
    t = _evaluated(shifted_1997(spark, d)[0], "ship_year", "l_quantity", YEAR, LINE_ID, S.SliceOptions())
    return rounded(t.select("level", "ks_add", "ks_mul"), ks_add=8, ks_mul=8)


cat.add("q_crossfit", crossfit, f"""{YEAR_AUDIT}
select lv as level, round(ks_add, 8) as ks_add, round(ks_mul, 8) as ks_mul from evald""")


def perm_floor(spark: SparkSession, d: str) -> DataFrame:
    """Noise floor of every year's reference, all other years, on counts."""
    df = shifted_1997(spark, d)[0]
    _, edges, cells = S.prepare(df, ["ship_year"], ["l_quantity"], YEAR)
    hist = S.value_counts(df, {"ship_year": ["l_quantity"]})
    tau = S.permutation_floor(hist, S.members_of(df, cells, cells), cells, edges, fine_for(hist.count()), S.SliceOptions())
    return rounded(tau.join(cells, "cid").select("level", "n_a", "n_b", "tau"), tau=8)


# the draws are hypergeometric numbers, which SQL does not have: tests/test_slices_whole.py compares them with row permutations
cat.add("q_perm_floor", perm_floor)


SHOWN = {"ks0": 6, "ks_add": 6, "ks_mul": 6, "delta": 4, "ratio": 6}


def shown(f: DataFrame, **more: int) -> DataFrame:
    digits = SHOWN | more
    return rounded(f.select("kind", "level", "ref", "n", "confidence", *[F.col(f"stats.{c}").alias(c) for c in digits]), **digits)


def audit_add(spark: SparkSession, d: str) -> DataFrame:
    return shown(S.numeric_audit(shifted_1997(spark, d)[0], ["ship_year"], ["l_quantity"], row_id=LINE_ID, strata=YEAR))


cat.add("q_numeric_audit_add", audit_add, f"""{audit_ctes(SHIFTED, "ship_year", "l_quantity", "l_linenumber", pairwise=False, whole=True)} {deduped(FOUND)}""")


def audit_mul(spark: SparkSession, d: str) -> DataFrame:
    return shown(S.numeric_audit(halved_line3(spark, d), ["l_linenumber"], ["l_extendedprice"], row_id=LINE_ID, strata=LINE))


cat.add("q_numeric_audit_mul", audit_mul, f"""{audit_ctes(HALVED, "l_linenumber", "l_extendedprice", "ship_year", pairwise=False, whole=False)} {deduped(FOUND)}""")


def audit_unexplained(spark: SparkSession, d: str) -> DataFrame:
    return shown(S.numeric_audit(mixed_line3(spark, d), ["l_linenumber"], ["l_extendedprice"], row_id=LINE_ID, strata=LINE))


cat.add("q_numeric_audit_unexplained", audit_unexplained, f"""{audit_ctes(MIXED, "l_linenumber", "l_extendedprice", "ship_year", pairwise=False, whole=False)} {deduped(FOUND)}""")


def audit_asymptotic(spark: SparkSession, d: str) -> DataFrame:
    opt = S.SliceOptions(acceptance="asymptotic")
    return shown(S.numeric_audit(shifted_1997(spark, d)[0], ["ship_year"], ["l_quantity"], row_id=LINE_ID, strata=YEAR, opt=opt), tau=6)


cat.add("q_numeric_audit_asymptotic", audit_asymptotic, f"""{audit_ctes(SHIFTED, "ship_year", "l_quantity", "l_linenumber", pairwise=False, whole=True, acceptance="asymptotic")} {deduped(FOUND.replace("round(delta, 4)", "round(tau, 6) as tau, round(delta, 4)"))}""")
