"""DuckDB SQL of the later operators, written from the definitions and not from the operators."""

from __future__ import annotations

from tabaudit.llm.twins import WORD

#: Rows of each order fall to the first filter of the order that they fail.
INTERACTIONS = f"""
with lab as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels where doc_id is not null group by 1),
d as (select coalesce(lang, '') as part, doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), {WORD}) as w,
             coalesce(min(doc_id) over (partition by coalesce(text, '')) < doc_id, false) as e from documents),
f as (select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
        [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t),
         regexp_matches(t, '[#$%&*|]'), e] as fails from d left join lab using (doc_id)),
c as materialized (select part, fails, count(*) as n, sum(good) as good, sum(toxic) as toxic from f group by all),
l as (select * from (values (1, 'A'), (2, 'B'), (3, 'C'), (4, 'D'), (5, 'E')) t(i, x)),
o as (select [a.i, b.i, c1.i, d1.i, e1.i] as ord, a.x || b.x || c1.x || d1.x || e1.x as filter_order from l a, l b, l c1, l d1, l e1
      where len(list_distinct([a.i, b.i, c1.i, d1.i, e1.i])) = 5),
h as (select part, filter_order, ord, fails, n, good, toxic, list_position(list_transform(ord, lambda i: fails[i]), true) as hit from c, o),
s as (select part, filter_order, k as step, ord[k] as i, sum(n) filter (hit is null or hit > k) as kept, sum(n) filter (hit = k) as removed,
        sum(n) filter (fails[ord[k]] and hit < k) as redundant, sum(n) filter (fails[ord[k]] and len(list_filter(fails, lambda x: x)) = 1) as unique_fails,
        sum(good) filter (hit = k) as good_lost, sum(toxic) filter (hit = k) as toxic_lost from h, range(1, 6) r(k) group by all)
select part, filter_order, cast(step as integer) as step, {', '.join(f'cast(coalesce({c}, 0) as bigint) as {c}' for c in ('kept', 'removed', 'redundant', 'unique_fails', 'good_lost', 'toxic_lost'))},
  cast(coalesce(sum(removed) over (partition by part, i), 0) as bigint) as shapley from s"""


#: Two hexadecimal digits a byte; every window of 200 bytes is grouped by its digest.
SUFFIXES = """
with d as materialized (select doc_id, row_number() over () as k, hex(encode(coalesce(text, ''))) as h from documents),
win as (select k, i, md5(substr(h, 2 * i - 1, 400)) as w from (select k, h, unnest(range(1, length(h) // 2 - 198)) as i from d)),
rep as (select k, i from (select k, i, count(*) over (partition by w) as c from win) where c > 1),
run as (select k, i, sum(case when i > bef + 200 then 1 else 0 end) over (partition by k order by i) as g from (select k, i, lag(i) over (partition by k order by i) as bef from rep)),
sp as materialized (select k, g, min(i) as a, max(i) + 199 as z from run group by k, g),
pc as (select k, a as o, coalesce(lag(z) over (partition by k order by a), 0) + 1 as x, a - 1 as y from sp union all select k, max(z), max(z) + 1, null from sp group by k),
kp as (select k, string_agg(substr(h, 2 * x - 1, 2 * (coalesce(y, length(h) // 2) - x + 1)), '' order by o) as t from pc join d using (k) group by k),
st as (select k, sum(z - a + 1) as n, count(*) as c from sp group by k)
select doc_id, cast(length(h) // 2 as bigint) as n_bytes, cast(coalesce(st.n, 0) as bigint) as n_removed, cast(coalesce(c, 0) as bigint) as n_spans, sha256(unhex(coalesce(t, h))) as kept_sha256
from d left join st using (k) left join kp using (k)"""


def _repair() -> str:
    """The cheapest edits row by row, one value (cost in nine digits, then edits) a state; inserts go before rows and at the end."""
    def plus(v: str, cost: str, edit: str) -> str:
        return f"(lpad(cast(cast(substr({v}, 1, 9) as bigint) + {cost} as varchar), 9, '0') || substr({v}, 10) || '{edit}')"

    ins = lambda v, n=1: plus(v, str(2 * n), "I" * n)
    closed = f"p0 as q0, p1 as q1, least(p2, {ins('p0')}, {ins('p1')}, {ins('p3')}) as q2, least(p3, {ins('p2')}, {ins('p0', 2)}, {ins('p1', 2)}) as q3"
    to_u = "least(q0, q1, q3)"
    return f"""
with recursive raw as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    list_transform(string_split(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '), ''), lambda x: cast(ascii(x) as bigint)) as b from conversations),
crc as (select *, xor(list_reduce([4294967295::bigint] || b, lambda c, y: list_reduce([xor(c, y)] || range(8), lambda x, k: case when x % 2 = 1 then xor(x // 2, 3988292384::bigint) else x // 2 end)), 4294967295::bigint) % 20 as f from raw),
dam as (select conv_id, turn, case when f = 4 then 'user' else role end as role, case when f = 1 then '' when f = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(case when f = 3 then [1, 2] else [1] end) as copy from crc where f <> 0),
cv as materialized (select conv_id, row_number() over (order by conv_id nulls first) as ck from (select distinct conv_id from conversations)),
seq as (select ck, turn, role, text, row_number() over (partition by ck order by turn nulls first, role, sha256(text), copy) as pos,
    row_number() over (partition by ck, role, text order by turn nulls first, copy) as seen from dam join cv on dam.conv_id is not distinct from cv.conv_id),
r as materialized (select *, substr(role, 1, 1) as init, case when not regexp_matches(text, '[^\\x20\\x09-\\x0D]') then 1 when seen > 1 then 2 when not regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') then 3 else 0 end as fault from seq),
st as (select ck, max(turn) - min(turn) + 1 - count(distinct turn) as gaps, count(*) filter (fault = 1) as blank, count(*) filter (fault = 2) as duplicate, count(*) filter (fault = 3) as truncated,
    count(*) filter (bef is not null and bef || init not in ('su', 'ua', 'au')) as illegal from (select *, lag(init) over (partition by ck order by pos) as bef from r) group by ck),
dp as (select ck, 0::bigint as k, '000000000' as p0, null::varchar as p1, null::varchar as p2, null::varchar as p3 from cv
  union all
  select q.ck, k + 1, {plus('q0', '3', 'D')}, least({plus('q1', '3', 'D')}, case when ok and init = 's' then {plus('q0', 'tr', 'K')} end),
    least({plus('q2', '3', 'D')}, case when ok and init = 'u' then {plus(to_u, 'tr', 'K')} when ok then {plus(to_u, '(tr + 2)', 'R')} end),
    least({plus('q3', '3', 'D')}, case when ok and init = 'a' then {plus('q2', 'tr', 'K')} when ok then {plus('q2', '(tr + 2)', 'R')} end)
  from (select ck, k, {closed} from dp) q join (select ck, pos, init, fault in (0, 3) as ok, case when fault = 3 then 1 else 0 end as tr from r) r on r.ck = q.ck and r.pos = q.k + 1),
fin as (select ck, least(q0, q3) as v from (select ck, {closed} from (select * from dp qualify row_number() over (partition by ck order by k desc) = 1))),
ed as (select ck, cast(substr(v, 1, 9) as bigint) as cost, substr(v, 10) as audit from fin),
le as (select ck, j, substr(audit, j, 1) as e from (select ck, audit, unnest(range(1, length(audit) + 1)) as j from ed)),
ln as (select ck, j, e, sum(case when e <> 'I' then 1 else 0 end) over w as pos, sum(case when e <> 'D' then 1 else 0 end) over w as m from le window w as (partition by ck order by j)),
wi as (select ln.*, role, text, max(case when m = 1 and e = 'K' and init = 's' then 1 else 0 end) over (partition by ln.ck) as has_s from ln left join r on r.ck = ln.ck and r.pos = ln.pos and ln.e <> 'I'),
rp as (select ck, sha256(string_agg(case when e = 'K' then role else case when (m - has_s) % 2 = 1 then 'user' else 'assistant' end end || ':' || case when e = 'I' then '' else text end, chr(10) order by j)) as h from wi where e <> 'D' group by ck)
select conv_id, {', '.join(f'cast(coalesce({c}, 0) as bigint) as {c}' for c in ('gaps', 'blank', 'duplicate', 'truncated', 'illegal'))}, cost, audit, coalesce(h, sha256('')) as repaired_sha256
from cv join ed using (ck) left join st using (ck) left join rp using (ck)"""


MORE = {"op11_suffix_dedup": SUFFIXES, "op12_conversation_repair": _repair(), "op13_filter_audit": INTERACTIONS}
