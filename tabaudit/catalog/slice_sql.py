"""SQL twin of the numeric slice audit for one slicer and target, as a chain of CTEs.

The permutation floor is drawn by permuting rows here and on value counts by the
operator: the same distribution, other random numbers. So the floor itself is not
compared, only what it decides (``q_perm_floor`` has a plain numpy version).
"""

from __future__ import annotations

from tabaudit.functions.rng import HEX_DIGITS

SCALE = float(16**HEX_DIGITS)


def _u(key: str, salt: str) -> str:
    return f"(cast('0x' || substr(md5({key} || '-' || {salt}), 1, {HEX_DIGITS}) as bigint) / {SCALE})"


def _ks(aset: str, href: str, grid: str) -> str:
    """Distance of each grid point (cid, part, g, d, r)."""
    return f"""(select cid, part, g, any_value(d) as d, max(abs(ca / na - cb / nb)) as ks from (
      select cid, part, g, d, sum(a) over (partition by cid, part, g order by x) as ca, sum(b) over (partition by cid, part, g order by x) as cb,
             sum(a) over (partition by cid, part, g) as na, sum(b) over (partition by cid, part, g) as nb
      from (select cid, part, g, d, x, cast(sum(a) as double) as a, cast(sum(b) as double) as b from (
          select q.cid, q.part, q.g, q.d, (s.x - q.d) / q.r as x, s.n as a, 0 as b from {grid} q join {aset} s on s.cid = q.cid and s.part = q.part
          union all select q.cid, q.part, q.g, q.d, h.x, 0, h.n from {grid} q join {href} h on h.cid = q.cid) group by 1, 2, 3, 4, 5)
      ) group by 1, 2, 3)"""


def _points(source: str, center: str, step: str, first: list[str]) -> str:
    lo, hi = f"({center} - 10 * {step})", f"({center} + 10 * {step})"
    parts = [f"select cid, part, {i} as g, {d} as d, 1.0::double as r from {source}" for i, d in enumerate(first)]
    n = len(first)
    parts.append(f"select cid, part, {n} + j as g, case when j = 20 then {hi} else j::double * (({hi} - {lo}) / 20) + {lo} end as d, 1.0::double "
                 f"from {source}, range(0, 21) t(j)")
    return " union all ".join(parts)


def audit_ctes(src: str, slicer: str, target: str, stratum: str | None, *, pairwise: bool, whole: bool, key: str = "rid",
               acceptance: str = "crossfit", salt: str = "") -> str:
    """CTEs up to ``cells_t`` (all comparisons), ``cand``, ``fit`` and ``decided``."""
    if pairwise:
        cells = f"select '{slicer}|' || a.lv || '|{target}|' || b.lv as cid, a.lv, b.lv as ref from lvl a join lvl b on a.lv <> b.lv"
    else:
        cells = f"select '{slicer}|' || lv || '|{target}|None' as cid, lv, cast(null as varchar) as ref from lvl"
    k = f"cast({stratum} as varchar)" if stratum else "cast(null as varchar)"
    text = f"""with base as materialized (select cast({slicer} as varchar) as lv, {k} as k, cast({target} as double) as x, {key} as key from {src} where {slicer} is not null),
lvl as (select lv from base group by lv having count(*) >= 80),
cells as ({cells}),
mem as (select c.cid, b.lv as blv from cells c join (select distinct lv from base) b on c.ref = b.lv or (c.ref is null and b.lv <> c.lv)),
ra as materialized (select c.cid, b.k, b.x from cells c join base b on b.lv = c.lv where b.x is not null),
rb as materialized (select m.cid, b.k, b.x from mem m join base b on b.lv = m.blv where b.x is not null),
sa as (select cid, count(*) as n_a, stddev_samp(x) as std_a, quantile_cont(x, 0.5) as med_a from ra group by cid),
sb as (select cid, count(*) as n_b, stddev_samp(x) as std_b, quantile_cont(x, 0.5) as med_b from rb group by cid),
oa as (select cid, k, count(*) as n, quantile_cont(x, 0.5) as m from ra where k is not null group by 1, 2),
ob as (select cid, k, count(*) as n, quantile_cont(x, 0.5) as m from rb where k is not null group by 1, 2),
offs as (select cid, oa.m - ob.m as d, case when ob.m <> 0 then oa.m / ob.m end as r from oa join ob using (cid, k) where oa.n >= 20 and ob.n >= 20),
og as (select cid, count(*) as c, quantile_cont(d, [0.25, 0.5, 0.75]) as q, greatest(avg(cast(d > 0 as int)), avg(cast(d < 0 as int))) as s,
         quantile_cont(r, 0.5) as rr from offs group by cid),
cells_t as materialized (select cid, lv, ref, n_a, n_b, std_a, std_b, med_a, med_b, greatest(std_b, 1e-9) as scale, coalesce(c >= 4, false) as stratified,
    cast(coalesce(c, 0) as int) as strata, case when c >= 4 then q[2] else med_a - med_b end as delta0, case when c >= 4 then q[3] - q[1] end as iqr,
    case when c >= 4 then s else 1.0 end as sign, case when c >= 4 then rr when med_b <> 0 then med_a / med_b end as ratio,
    1.36 * sqrt((n_a + n_b) / (n_a::double * n_b)) as floor_
  from cells join sa using (cid) join sb using (cid) left join og using (cid) where n_a >= 80 and n_b >= 80),
flags as (select *, std_a < 0.05 * scale and abs(med_a - med_b) > 0.5 * scale as collapsed from cells_t),
cand as materialized (select * from flags where not collapsed and abs(delta0) > 0.10 * scale and (not stratified or sign >= 0.85)),
hb as materialized (select cid, x, count(*) as n from rb where cid in (select cid from cand) group by 1, 2),
fold as materialized (select c.cid, b.x, b.key, case when {_u('b.key', f"(c.cid || '{salt}')")} < 0.5 then 'A' else 'B' end as part
  from cand c join base b on b.lv = c.lv where b.x is not null),
med as materialized (select cid, part, quantile_cont(x, 0.5) as m from fold group by 1, 2),
probs as materialized (select cid, 'full' as part, delta0 as d0, scale, cast(null as double) as fr from cand
  union all select cid, part, m - med_b, scale, case when med_b <> 0 then m / med_b end from med join cand using (cid)),
aset as materialized (select cid, 'full' as part, x, count(*) as n from ra where cid in (select cid from cand) group by 1, 2, 3
  union all select cid, part, x, count(*) from fold group by 1, 2, 3),
p1 as (select *, greatest(0.15 * scale, abs(d0) * 0.5, 1e-9) / 10 as s1, greatest(0.15 * scale, abs(d0) * 0.5, 1e-9) / 100 as s2 from probs),
g1 as ({_points('p1', 'd0', 's1', ['d0', '0.0::double'])}),
k1 as materialized (select * from {_ks('aset', 'hb', 'g1')}),
b1 as (select cid, part, arg_min(d, (ks, g)) as d1 from k1 where g <> 1 group by 1, 2),
p2 as (select p1.*, b1.d1, k1.ks as ks0 from p1 join b1 using (cid, part) join k1 using (cid, part) where k1.g = 1),
g2 as ({_points('p2', 'd1', 's2', ['d1'])}),
k2 as materialized (select * from {_ks('aset', 'hb', 'g2')}),
b2 as (select cid, part, arg_min(d, (ks, g)) as d2, min(ks) as ks2 from k2 group by 1, 2),
p3 as (select * from p2 join b2 using (cid, part)),
g3 as (select cid, part, 0 as g, round_even(d2, 0) as d, 1.0::double as r from p3 where {str(whole).lower()}),
k3 as materialized (select * from {_ks('aset', 'hb', 'g3')}),
fit as materialized (select p3.cid, p3.part, p3.fr, p3.ks0, case when k3.ks <= ks2 + 0.005 then k3.d else d2 end as delta,
    case when k3.ks <= ks2 + 0.005 then k3.ks else ks2 end as ks_fit from p3 left join k3 on k3.cid = p3.cid and k3.part = p3.part),
found as materialized (select cand.*, f.ks0, f.delta, f.ks_fit from cand join fit f on f.cid = cand.cid and f.part = 'full' where stratified or f.ks0 >= 2 * floor_),"""
    if acceptance == "asymptotic":
        return text + f"""
g4 as (select cid, 'full' as part, 0 as g, 0.0::double as d, ratio as r from cand where ratio > 0),
k4 as (select * from {_ks('aset', 'hb', 'g4')}),
evald as materialized (select found.*, ks_fit as ks_add, coalesce(k4.ks, 1.0) as ks_mul, cast(null as double) as tau from found left join k4 using (cid)),
ok as (select *, ks_add <= greatest(0.25 * ks0, 1.5 * floor_) and ks_add < 0.05 and ks0 > 2 * floor_ and (iqr is null or iqr < 0.5 * abs(delta) + 0.05 * scale) as add_ok,
    ks_mul <= greatest(0.25 * ks0, 1.5 * floor_) and ks_mul < 0.05 and ks0 > 2 * floor_ and coalesce(abs(ratio - 1) > 0.05, false) as mul_ok from evald),
{_DECIDE}"""
    return text + f"""
fits as (select cid, part, delta, case when fr > 0 then fr end as r from fit where part <> 'full'),
ev as (select f.cid, t.part, f.x, t.delta, t.r from fold f join fits t on t.cid = f.cid and t.part <> f.part),
tests as (select cid, part || '+' as part, 0 as g, delta as d, 1.0::double as r from fits union all select cid, part || '*', 0, 0.0, r from fits where r is not null),
rset as (select cid, part || '+' as part, x, count(*) as n from ev group by 1, 2, 3 union all select cid, part || '*', x, count(*) from ev group by 1, 2, 3),
k5 as materialized (select * from {_ks('rset', 'hb', 'tests')}),
rs as (select cid, max(ks) filter (part like '%+') as ks_add,
    case when count(*) filter (part like '%*') < 2 then greatest(1.0, max(ks) filter (part like '%*')) else max(ks) filter (part like '%*') end as ks_mul from k5 group by 1),
res as materialized (select found.*, ks_add, ks_mul, ks_add <= 0.25 * ks0 and ks_add < 0.05 and ks0 > 2 * floor_ and (iqr is null or iqr < 0.5 * abs(delta) + 0.05 * scale) as may_add,
    ks_mul <= 0.25 * ks0 and ks_mul < 0.05 and ks0 > 2 * floor_ as may_mul from found join rs using (cid)),
open_ as (select cid, least(n_a // 2, n_b // 2) as m from res where may_add or may_mul),
dr as (select cid, m, j, x, row_number() over (partition by cid, j order by hash(key || '-' || cid || '{salt}|' || j)) as k
  from (select m.cid, b.x, b.key from mem m join base b on b.lv = m.blv where b.x is not null and m.cid in (select cid from open_)) join open_ using (cid), range(0, 200) t(j)),
dc as (select cid, j, x, cast(count(*) filter (k <= m) as double) as a, cast(count(*) filter (k > m) as double) as b from dr where k <= 2 * m group by 1, 2, 3),
dk as (select cid, j, max(abs(ca / na - cb / nb)) as ks from (select cid, j, sum(a) over w as ca, sum(b) over w as cb, sum(a) over (partition by cid, j) as na,
    sum(b) over (partition by cid, j) as nb from dc window w as (partition by cid, j order by x)) group by 1, 2),
tau as materialized (select cid, quantile_cont(ks, 0.95) as tau from dk group by 1),
evald as materialized (select res.*, tau from res left join tau using (cid)),
ok as (select *, may_add and coalesce(ks_add <= tau, false) as add_ok, may_mul and coalesce(ks_mul <= tau, false) and coalesce(abs(ratio - 1) > 0.05, false) as mul_ok from evald),
{_DECIDE}"""


_DECIDE = """decided as materialized (select *, case when add_ok then 'additive_shift' when mul_ok then 'multiplicative_shift'
    when ks0 >= 0.20 and sign >= 0.90 and abs(delta) > 0.25 * scale then 'unexplained_shift' end as kind from ok)"""

# the findings columns the registered queries show
FOUND = """select kind, lv as level, ref, n_a as n, case when kind = 'unexplained_shift' then 'REVIEW' else 'REPAIR' end as confidence,
  round(ks0, 6) as ks0, round(ks_add, 6) as ks_add, round(ks_mul, 6) as ks_mul, round(delta, 4) as delta, round(ratio, 6) as ratio
from decided where kind is not null"""


def deduped(text: str) -> str:
    """One finding per (kind, level): that of the first reference."""
    return f"select * exclude (rk) from (select *, row_number() over (partition by kind, level order by ref) as rk from ({text})) where rk = 1"
