"""Categorical, missingness, panel and post-processing queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabaudit.catalog.base import LINEITEM, PANEL, Catalog, lineitem, panel, rounded, table
from tabaudit.catalog.corruption import STATUS_NULLS, status_nulls
from tabaudit.catalog.slice_sql import audit_ctes, deduped
from tabaudit.catalog.slicing import OKEY, RAISED, RAISED_STATUS, raised_high, raised_status
from tabaudit.functions.lineage import cut
from tabaudit.operators import categorical as K
from tabaudit.operators import findings as FD
from tabaudit.operators import panel as N
from tabaudit.operators import slices as S

cat = Catalog()


def part_groups(spark: SparkSession, d: str) -> DataFrame:
    """part with a category that its brand determines, but for Brand#9."""
    last = F.substring("p_brand", -1, 1).cast("int")
    group = F.when(F.col("p_brand") == "Brand#9", F.col("p_type")).when(last % 2 == 1, "ODD").otherwise("EVEN")
    return table(spark, d, "part").withColumn("category", group)


PART_GROUPS = """(select *, case when p_brand = 'Brand#9' then p_type when cast(substr(p_brand, -1, 1) as int) % 2 = 1 then 'ODD' else 'EVEN' end as category from part)"""


def fd_violation(spark: SparkSession, d: str) -> DataFrame:
    f = K.detect_fd_violation(part_groups(spark, d), ["p_brand", "p_size"], ["category"])
    return rounded(f.select("kind", "slicer", "level", "target", "n", "confidence", F.col("stats.share_in").alias("share")), share=8)


cat.add("q_fd_violation", fd_violation, f"""
with c as (select s, l, category as v, count(*) as n from (select 'p_brand' as s, p_brand as l, category from {PART_GROUPS}
    union all select 'p_size', cast(p_size as varchar), category from {PART_GROUPS}) group by 1, 2, 3),
p as (select s, l, cast(sum(n) as bigint) as n, max(n) / sum(n) as m from c group by 1, 2 having sum(n) >= 20),
f as (select s from p group by 1 having count(*) >= 2 and count(*) filter (m >= 0.97) >= 2)
select 'fd_violation' as kind, s as slicer, l as level, 'category' as target, n, 'REVIEW' as confidence, round(m, 8) as share
from p join f using (s) where m <= 0.9""")


def overwritten_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = (F.col("ship_year") == 1997) & (F.col("l_linestatus") == "F")
    return lineitem(spark, d).withColumn("l_returnflag", F.when(rows, F.lit("R")).otherwise(F.col("l_returnflag")))


OVERWRITTEN = f"(select * replace (case when ship_year = 1997 and l_linestatus = 'F' then 'R' else l_returnflag end as l_returnflag) from {LINEITEM})"
OW_SLICERS = ["ship_year", "l_linenumber", "l_linestatus"]


def overwrite(spark: SparkSession, d: str) -> DataFrame:
    f = K.detect_overwrite(overwritten_lines(spark, d), OW_SLICERS, ["l_returnflag"])
    out = f.select("kind", "slicer", "level", "context", "context_level", "target", "n", "confidence",
                   *[F.col(f"stats.{c}").alias(c) for c in ("share_in", "share_out", "tv")])
    return rounded(out, share_in=8, share_out=8, tv=8)


def _overwrite_sql(src: str, slicers: list[str], target: str) -> str:
    parts, sizes = [], ["select '' as ctx, '' as cl, 1000 as c"]
    for s in slicers:
        for c in [None, *slicers]:
            if c != s:
                lv = f"cast({c} as varchar)" if c else "''"
                parts.append(f"select '{c or ''}' as ctx, {lv} as cl, '{s}' as s, cast({s} as varchar) as l, {target} as v, count(*) as n from {src} group by 1, 2, 3, 4, 5")
        sizes.append(f"select '{s}', cast({s} as varchar), count(*) from {src} group by 2")
    return f"""with c as materialized ({' union all '.join(parts)}), z as ({' union all '.join(sizes)}),
p as materialized (select ctx, cl, s, l, sum(n) as n, max(n) / sum(n) as m, arg_min(v, (-n, v)) as top from c group by 1, 2, 3, 4 having sum(n) >= 20),
f as (select s from p where ctx = '' group by 1 having count(*) >= 2 and count(*) filter (m >= 0.97) >= 2),
g as (select ctx, cl, s, max(l) filter (m >= 0.97 and n >= 80) as lv, max(top) filter (m >= 0.97 and n >= 80) as top, cast(max(n) filter (m >= 0.97 and n >= 80) as bigint) as nl
  from p join z using (ctx, cl) where (ctx = '' or z.c >= 160) and s not in (select s from f) group by 1, 2, 3
  having count(*) >= 2 and count(*) filter (m >= 0.97 and n >= 80) = 1 and count(*) filter (m <= 0.9) >= 1),
x as (select ctx, cl, s, v, top, lv, nl, coalesce(sum(n) filter (l = lv), 0) as a, coalesce(sum(n) filter (l <> lv), 0) as b from c join g using (ctx, cl, s) group by 1, 2, 3, 4, 5, 6, 7),
y as (select *, a / sum(a) over (partition by ctx, cl, s) as pa, b / sum(b) over (partition by ctx, cl, s) as pb from x),
r as (select ctx, cl, s, lv, top, nl, max(pb) as mo, max(pb) filter (v = top) as so, max(pa) filter (v = top) as si, 0.5 * sum(abs(pa - pb)) as tv from y group by 1, 2, 3, 4, 5, 6),
o as (select ctx, cl, s, quantile_cont(k / t, 0.5) as os from (select g.ctx, g.cl, g.s, c.cl as c2, sum(n) as t, coalesce(sum(n) filter (v = top), 0) as k
    from c join g on c.ctx = g.ctx and c.s = g.s and c.l = g.lv and c.cl <> g.cl where g.ctx <> '' group by 1, 2, 3, 4) where t >= 30 group by 1, 2, 3)
select 'categorical_overwrite' as kind, s as slicer, lv as level, nullif(ctx, '') as context, case when ctx <> '' then cl end as context_level, '{target}' as target,
       nl as n, 'REPAIR' as confidence, round(si, 8) as share_in, round(so, 8) as share_out, round(tv, 8) as tv
from r left join o using (ctx, cl, s) where mo <= 0.9 and so <= 0.6 and coalesce(os, 0) <= 0.6"""


cat.add("q_overwrite", overwrite, _overwrite_sql(OVERWRITTEN, OW_SLICERS, "l_returnflag"))


def missingness(spark: SparkSession, d: str) -> DataFrame:
    f = K.detect_missingness(status_nulls(spark, d)[0], ["o_orderpriority"], ["o_orderstatus"])
    out = f.select("kind", "slicer", "level", "ref", "target", "n", F.col("stats.missing_rate").alias("rate"), F.explode("repair.dist").alias("value", "share"))
    return rounded(out, rate=8, share=8)


cat.add("q_missingness", missingness, f"""
with l as (select o_orderpriority as p, count(*) as n, avg(cast(o_orderstatus is null as int)) as r from {STATUS_NULLS} group by 1 having count(*) >= 80),
f as (select arg_min(p, (r, p)) as ref, min(r) as rr from l having count(*) >= 2 and min(r) <= 0.03),
m as (select o_orderpriority as p, o_orderstatus as v, count(*) / sum(count(*)) over (partition by o_orderpriority) as s from {STATUS_NULLS} where o_orderstatus is not null group by 1, 2),
b as (select l.*, ref from l, f where p <> ref and r >= rr + 0.15),
w as (select b.p, b.ref, b.n, b.r, v.v, greatest(0, (coalesce(a.s, 0) - (1 - b.r) * coalesce(o.s, 0)) / b.r) as w
  from b cross join (select distinct v from m) v left join m a on a.p = b.ref and a.v = v.v left join m o on o.p = b.p and o.v = v.v),
d as (select *, w / sum(w) over (partition by p) as s from w)
select 'mnar_missingness' as kind, 'o_orderpriority' as slicer, p as level, ref, 'o_orderstatus' as target, n, round(r, 8) as rate, v as value, round(s, 8) as share
from d where s > 0.02""")


# -- panel -------------------------------------------------------------------------

MEASURES = ["revenue", "quantity", "n_lines"]


def collapsed_panel(spark: SparkSession, d: str) -> DataFrame:
    p = panel(spark, d)
    return p.withColumn("revenue", F.when(F.col("t").isin(8, 17), F.col("revenue") * 0.02).otherwise(F.col("revenue")))


COLLAPSED = f"(select * replace (case when t in (8, 17) then revenue * 0.02::double else revenue end as revenue) from {PANEL})"


def inflated_panel(spark: SparkSession, d: str) -> DataFrame:
    hit = (F.col("entity") == "NATION_6") & F.col("t").between(10, 15)
    return panel(spark, d).withColumns({c: F.when(hit, F.col(c) * 3).otherwise(F.col(c)) for c in MEASURES})


INFLATED = f"(select entity, t, {', '.join(f'case when entity = {chr(39)}NATION_6{chr(39)} and t between 10 and 15 then {c} * 3 else {c} end as {c}' for c in MEASURES)} from {PANEL})"


def jumpy_panel(spark: SparkSession, d: str) -> DataFrame:
    k = F.when(F.col("t") % 2 == 0, 3.0).otherwise(20.0)
    return panel(spark, d).withColumn("revenue", F.when(F.col("entity") == "NATION_12", F.col("revenue") * k).otherwise(F.col("revenue")))


JUMPY = f"(select * replace (case when entity = 'NATION_12' then revenue * (case when t % 2 = 0 then 3.0::double else 20.0::double end) else revenue end as revenue) from {PANEL})"


def long_sql(src: str) -> str:
    return " union all ".join(f"select entity, t, '{c}' as target, {c} as y from {src}" for c in MEASURES)


def period_collapse(spark: SparkSession, d: str) -> DataFrame:
    f = N.detect_period_collapse(collapsed_panel(spark, d), "entity", "t", MEASURES)
    out = f.select("kind", "level", "target", "n", F.col("stats.frac").alias("frac"), F.concat_ws(",", F.col("repair.all_years").cast("array<string>")).alias("all_years"))
    return rounded(out, frac=8)


cat.add("q_period_collapse", period_collapse, f"""
with s as ({long_sql(COLLAPSED)}), e as (select entity, target from s group by 1, 2 having count(*) >= 5),
p as (select *, (lag(y) over w + lead(y) over w) / 2 as pred from s join e using (entity, target) window w as (partition by entity, target order by t)),
r as (select target, t, avg(cast(coalesce(y / pred < 0.2, false) as int)) as frac, count(*) as n from p where pred > 0 group by 1, 2),
b as (select * from r where n >= 20 and frac >= 0.6)
select 'year_collapse' as kind, cast(t as varchar) as level, target, n, round(frac, 8) as frac,
       (select string_agg(cast(t as varchar), ',' order by t) from b b2 where b2.target = b.target) as all_years from b""")

cat.add("q_neighbour_mean", lambda s, d: rounded(N.neighbour_mean(N.long_series(panel(s, d), "entity", "t", MEASURES)).select("entity", "time", "target", "pred"), pred=4), f"""
select entity, t as time, target, round((lag(y) over w + lead(y) over w) / 2, 4) as pred from ({long_sql(PANEL)}) window w as (partition by entity, target order by t)""")

cat.add("q_rolling_median", lambda s, d: rounded(N.rolling_median(N.long_series(panel(s, d), "entity", "t", MEASURES)).select("entity", "time", "target", "rm"), rm=4), f"""
select entity, t as time, target, round(case when count(y) over w >= 7 then quantile_cont(y, 0.5) over w end, 4) as rm
from ({long_sql(PANEL)}) window w as (partition by entity, target order by t rows between 10 preceding and 10 following)""")

cat.add("q_abs_dlog", lambda s, d: rounded(N.abs_dlog(N.long_series(panel(s, d), "entity", "t", MEASURES)).select("entity", "time", "target", "x"), x=8), f"""
select * from (select entity, t as time, target, round(abs(ln(y) - ln(lag(y) over (partition by entity, target order by t))), 8) as x from ({long_sql(PANEL)})) where x is not null""")

BEST_WINDOWS = f"""with s0 as (select entity, t, target, y, row_number() over (partition by entity, target order by t) - 1 as pos,
    count(*) over (partition by entity, target) as n, count(y) over (partition by entity, target) as v, min(y) over (partition by entity, target) as lo from ({long_sql(INFLATED)})),
s1 as (select entity, t, target, pos, n, ln(y) as y from s0 where n >= 12 and v = n and lo > 0),
rm as (select *, quantile_cont(y, 0.5) over (partition by entity, target order by t rows between 10 preceding and 10 following) as r from s1),
ok as (select entity, target from rm group by 1, 2 having max(abs(y - r)) >= 0.6 * ln(1.15)),
m as (select entity, target, avg(t) as mx, avg(y) as my from s1 join ok using (entity, target) group by 1, 2),
s as materialized (select s1.entity, s1.target, t, pos, n, t - mx as x, s1.y - my as y from s1 join m using (entity, target)),
tot as (select entity, target, sum(x) as tx, sum(y) as ty, sum(x * x) as txx, sum(x * y) as txy, sum(y * y) as tyy from s group by 1, 2),
c as (select entity, target, pos as i, l, n from s, range(3, 13) r(l) where l <= n - 6 and pos >= 3 and pos <= n - l - 3),
i as (select c.entity, c.target, c.i, c.l, c.n, sum(x) as ix, sum(y) as iy, sum(x * x) as ixx, sum(x * y) as ixy, sum(y * y) as iyy
  from c join s on s.entity = c.entity and s.target = c.target and s.pos between c.i and c.i + c.l - 1 group by all),
o as (select i.*, n - l as m, tx - ix as sx, ty - iy as sy, txx - ixx as sxx, txy - ixy as sxy, tyy - iyy as syy from i join tot using (entity, target)),
f as (select *, (sxy - sx * sy / m) / (sxx - sx * sx / m) as a from o),
g as (select *, (sy - a * sx) / m as b, sqrt(greatest((syy - sy * sy / m - a * (sxy - sx * sy / m)) / m, 0)) + 1e-6 as noise from f),
h as (select g.entity, g.target, g.i, g.l, min(s.t) as st, max(s.t) as en, any_value(noise) as noise, quantile_cont(s.y - (a * s.x + b), [0.25, 0.5]) as q,
    regr_slope(s.y - (a * s.x + b), s.pos) as trend from g join s on s.entity = g.entity and s.target = g.target and s.pos between g.i and g.i + g.l - 1 group by 1, 2, 3, 4),
w as materialized (select *, q[2] / noise as score, row_number() over (partition by entity, target order by q[2] / noise desc, l, i) as k from h where q[2] > ln(1.15) and q[1] > 3 * noise),
best as materialized (select entity, target, st, en, exp(q[2]) as factor, exp(trend) as per_year, score from w where k = 1)"""


def window_growth(spark: SparkSession, d: str) -> DataFrame:
    f = N.detect_window_growth(inflated_panel(spark, d), "entity", "t", MEASURES)
    out = f.select("kind", "level", "target", "n", "confidence", F.col("repair.start").alias("start_t"), F.col("repair.end").alias("end_t"),
                   F.col("repair.factor").alias("factor"), F.col("repair.per_year").alias("per_year"), F.col("stats.score").alias("score"))
    return rounded(out, factor=6, per_year=6, score=4)


cat.add("q_window_growth", window_growth, f"""{BEST_WINDOWS}
select 'window_growth' as kind, entity as level, target, cast(en - st + 1 as bigint) as n, case when score > 4 then 'REPAIR' else 'REVIEW' end as confidence,
       st as start_t, en as end_t, round(factor, 6) as factor, round(case when per_year > 1.08 then per_year end, 6) as per_year, round(score, 4) as score from best""")


def merge_windows(spark: SparkSession, d: str) -> DataFrame:
    f = N.merge_entity_windows(cut(N.detect_window_growth(inflated_panel(spark, d), "entity", "t", MEASURES)), "entity", "t")
    out = f.select("kind", "level", "target", "n", "confidence", F.col("repair.start").alias("start_t"), F.col("repair.end").alias("end_t"), F.col("repair.factor").alias("factor"))
    return rounded(out, factor=6)


cat.add("q_merge_windows", merge_windows, f"""{BEST_WINDOWS},
e as (select entity, quantile_cont(st, 0.5) as s, quantile_cont(en, 0.5) as e, quantile_cont(factor, 0.5) as f, string_agg(target, ',' order by target) as ts
  from best group by 1 having count(*) >= 3 and max(factor) / min(factor) <= 1.15)
select 'entity_window_growth' as kind, entity as level, ts as target, cast(floor(e) - floor(s) + 1 as bigint) as n, 'REPAIR' as confidence,
       cast(floor(s) as int) as start_t, cast(floor(e) as int) as end_t, round(f, 6) as factor from e
union all select 'window_growth', entity, target, cast(en - st + 1 as bigint), case when score > 4 then 'REPAIR' else 'REVIEW' end, st, en, round(factor, 6)
from best where entity not in (select entity from e)""")


def demote_windows(spark: SparkSession, d: str) -> DataFrame:
    f = N.demote_mass_windows(cut(N.detect_window_growth(inflated_panel(spark, d), "entity", "t", MEASURES)), per_col=1)
    return f.select("kind", "level", "target", "confidence", F.size("notes").alias("n_notes"))


cat.add("q_demote_windows", demote_windows, f"""{BEST_WINDOWS},
d as (select count(*) >= 12 or max(c) >= 1 as mass from (select count(*) over (partition by target) as c from best))
select 'window_growth' as kind, entity as level, target, case when score > 4 and not mass then 'REPAIR' else 'REVIEW' end as confidence,
       cast(score > 4 and mass as int) as n_notes from best, d""")


def rough(spark: SparkSession, d: str) -> DataFrame:
    out = N.roughness(jumpy_panel(spark, d), "entity", "t", MEASURES)
    flagged = (F.col("n_peers") >= N.MIN_PEERS) & (F.col("z") > 4) & (F.col("level") >= F.col("hi_level"))
    return rounded(out.select("entity", "target", "rough", "level", "z", flagged.alias("flagged")), rough=8, level=3, z=5)


ROUGHNESS = f"""with s as ({long_sql(JUMPY)}), l as (select *, abs(ln(y) - ln(lag(y) over (partition by entity, target order by t))) as d from s),
e as (select entity, target, quantile_cont(d, 0.5) as rough, quantile_cont(y, 0.5) as level from l group by 1, 2 having count(*) >= 8 and min(y) > 0),
m as (select *, quantile_cont(rough, 0.5) over (partition by target) as med, quantile_cont(level, 0.75) over (partition by target) as hi, count(*) over (partition by target) as n from e),
a as (select *, quantile_cont(abs(rough - med), 0.5) over (partition by target) as mad from m),
z as (select *, (rough - med) / (1.4826 * (mad + 1e-9)) as z from a)"""
cat.add("q_roughness", rough, f"""{ROUGHNESS}
select entity, target, round(rough, 8) as rough, round(level, 3) as level, round(z, 5) as z, n >= 20 and z > 4 and level >= hi as flagged from z""")


def rough_series(spark: SparkSession, d: str) -> DataFrame:
    f = N.detect_rough_series(jumpy_panel(spark, d), "entity", "t", MEASURES)
    return rounded(f.select("kind", "level", "target", "confidence", F.col("repair.type").alias("repair"), F.col("stats.z").alias("z")), z=5)


cat.add("q_rough_series", rough_series, f"""{ROUGHNESS}
select 'rough_series' as kind, entity as level, target, 'REVIEW' as confidence, 'flag_entity' as repair, round(z, 5) as z from z where n >= 20 and z > 4 and level >= hi""")


# -- post-processing of real findings -------------------------------------------------

# acceptance is a noisy test even for a true shift; with this salt both directions of the pair pass it
MIRROR_SALT = "m1"


def raw_pairwise(spark: SparkSession, d: str) -> DataFrame:
    """Raw findings of two pairwise audits."""
    a = S.numeric_raw(raised_high(spark, d), ["o_orderpriority"], ["o_totalprice"], row_id=["o_orderkey"], strata={})
    b = S.numeric_raw(raised_status(spark, d), ["l_linestatus"], ["l_quantity"], row_id=["rid"], strata={"l_linestatus": "ship_year"}, opt=S.SliceOptions(salt=MIRROR_SALT))
    return cut(a.unionByName(b))


def _raw_sql() -> str:
    cols = "kind, lv, ref, n_a, case when kind = 'unexplained_shift' then 'REVIEW' else 'REPAIR' end as confidence"
    a = audit_ctes(RAISED, "o_orderpriority", "o_totalprice", None, pairwise=True, whole=False, key=OKEY)
    b = audit_ctes(RAISED_STATUS, "l_linestatus", "l_quantity", "ship_year", pairwise=True, whole=True, salt=MIRROR_SALT)
    return f"""(select 'o_orderpriority' as slicer, 'o_totalprice' as target, * from ({a} select {cols} from decided where kind is not null)
      union all select 'l_linestatus', 'l_quantity', * from ({b} select {cols} from decided where kind is not null))"""


RAW = _raw_sql()
DEDUPED = f"(select * exclude (rk) from (select *, row_number() over (partition by kind, slicer, lv, target order by ref) as rk from {RAW}) where rk = 1)"
VIEW = ["kind", "slicer", "level", "ref", "target", "n", "confidence"]
SQL_VIEW = "kind, slicer, lv as level, ref, target, n_a as n, confidence"

cat.add("q_dedupe_findings", lambda s, d: FD.dedupe_findings(raw_pairwise(s, d)).select(*VIEW), f"select {SQL_VIEW} from {DEDUPED}")

FAMILY = f"""(select *, kind in ('additive_shift', 'multiplicative_shift') and count(*) over (partition by kind, slicer, target) >= 3 as nat from {DEDUPED})"""
DEMOTED = f"(select * replace (case when nat then 'REVIEW' else confidence end as confidence) from {FAMILY})"
cat.add("q_demote_natural", lambda s, d: FD.demote_natural(FD.dedupe_findings(raw_pairwise(s, d))).select(*VIEW, F.size("notes").alias("n_notes")),
        f"select {SQL_VIEW}, cast(nat as int) as n_notes from {DEMOTED}")

MIRRORS = f"""(select *, count(*) over (partition by kind, slicer, target, least(lv, ref), greatest(lv, ref)) >= 2
  and kind in ('additive_shift', 'multiplicative_shift') and ref is not null as mirrored from {DEMOTED})"""
cat.add("q_mirrors", lambda s, d: FD.annotate_mirrors(FD.dedupe_findings(raw_pairwise(s, d))).select(
    *VIEW, F.array_contains("notes", "direction ambiguous: mirror also listed").alias("mirrored")),
    f"select {SQL_VIEW}, mirrored from {MIRRORS.replace(DEMOTED, DEDUPED)}")

_KINDS = " ".join(f"when '{k}' then {v}" for k, v in FD.KIND_ORDER.items())
RANKED = f"""(select *, cast(row_number() over (order by case when confidence = 'REPAIR' then 0 else 1 end, case when target = 'l_quantity' then 0 else 1 end,
  case kind {_KINDS} else 9 end, n_a desc, kind, slicer, target, lv, ref) as int) as rank from {DEMOTED})"""
cat.add("q_rank_findings", lambda s, d: FD.rank_findings(FD.postprocess(FD.dedupe_findings(raw_pairwise(s, d))), ["l_quantity"]).select(*VIEW, "rank"),
        f"select {SQL_VIEW}, rank from {RANKED}")

cat.add("q_cap_reviews", lambda s, d: FD.cap_reviews(FD.rank_findings(FD.postprocess(FD.dedupe_findings(raw_pairwise(s, d))), ["l_quantity"]), 2).select(*VIEW, "rank"),
        f"select {SQL_VIEW}, rank from (select *, row_number() over (partition by confidence order by rank) as k from {RANKED}) where confidence = 'REPAIR' or k <= 2")
