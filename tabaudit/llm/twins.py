"""DuckDB SQL for the registered queries, written from the definitions and not from the operators."""

from __future__ import annotations

from tabaudit.llm import chat, lines, mixing, quality

WORD = "'[^\\x20\\x09-\\x0D]+'"
RUN = "'[\\x20\\x09-\\x0D]+'"


def _urls(rules: list[tuple[str, str, str]]) -> str:
    values = ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in rules)
    return f"""
with r as (select * from (values {values}) t(h, p, a)),
u as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
v as (select page_id, row_number() over () as k,
             translate(regexp_extract(rest, '^([^/?#]*)', 1), '{mixing_upper()}', '{mixing_upper().lower()}') as host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
m as (select k, max({{'n': length(h) + length(p), 'nh': length(h), 'b': a = 'block', 'rule': h || p, 'a': a}}) as best
      from v join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by k)
select page_id, host, path, best.rule as rule, coalesce(best.a, 'allow') as verdict from v left join m using (k)"""


def mixing_upper() -> str:
    return "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


EXACT = f"""
with t as (select doc_id, sha256(regexp_replace(coalesce(text, ''), {RUN}, ' ', 'g')) as text_sha256 from documents)
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = min(doc_id) over w as kept, text_sha256
from t window w as (partition by text_sha256)"""


SUBSTRING = f"""
with d as (select doc_id, row_number() over (order by doc_id nulls first) as k, regexp_extract_all(coalesce(text, ''), {WORD}) as w from documents),
win as (select k, i, md5(array_to_string(w[i:i + 19], ' ')) as h from (select k, w, unnest(range(1, len(w) - 18)) as i from d)),
rep as (select k, i from (select k, i, row_number() over (partition by h order by k, i) as r from win) where r > 1),
gone as (select distinct k, j from (select k, unnest(range(i, i + 20)) as j from rep)),
g as (select k, list(j) as js, count(*) as n from gone group by k),
kept as (select k, string_agg(x, ' ' order by j) as t from (select k, unnest(w) as x, generate_subscripts(w, 1) as j from d) left join gone using (k, j)
         where gone.k is null group by k)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(g.n, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join g using (k) left join kept using (k)"""


def _chat(tricky: str) -> str:
    esc = "|".join(["\\\\", *chat.CONTROLS])
    escaped = lambda c: f"length(regexp_replace({c}, '({esc})', '\\\\\\1', 'g'))"
    fixed = sum(map(len, chat.CONTROLS))
    return f"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all select -7, 0, 'user', '{tricky}' union all select -7, 1, 'assistant', '{tricky}')
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, sha256(text))) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, role, sha256(text)) filter (role = 'assistant'), '')) as loss_sha256,
       cast(sum({fixed} + {escaped('role')} + {escaped('text')}) as bigint) as formatted_chars
from c group by conv_id"""


def lines_sql(docs: str) -> str:
    """doc_id, n_lines, n_removed, removed_lines. Lines within one edit share their first or last words up to
    half of the shorter; such pairs are formed and compared by their common beginning and end."""
    return f"""
with ln as materialized (select doc_id, pos - 1 as pos, trim(regexp_replace(l, {RUN}, ' ', 'g')) as l
  from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as l, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from {docs})),
di as materialized (select l, min({{'d': doc_id, 'p': pos}}) as o, string_split(l, ' ') as w from ln where l <> '' group by l),
lg as (select *, len(w) as n from di where len(w) >= {lines.MIN_WORDS}),
hv as (select distinct o, w, n, m, side, case when side = 0 then w[1:m] else w[n - m + 1:n] end as h
       from (select *, unnest([n // 2, (n - 1) // 2]) as m from lg), (values (0), (1)) s(side)),
pr as (select distinct a.o as o, a.w as w, b.w as v from hv a join hv b on a.m = b.m and a.side = b.side and a.h = b.h and b.o < a.o and abs(a.n - b.n) <= 1),
pf as (select o, greatest(len(w), len(v)) as big,
        coalesce(list_position(list_transform(range(1, greatest(len(w), len(v)) + 1), lambda i: w[i] is distinct from v[i]), true), greatest(len(w), len(v)) + 1) - 1 as p,
        coalesce(list_position(list_transform(range(1, greatest(len(w), len(v)) + 1), lambda i: list_reverse(w)[i] is distinct from list_reverse(v)[i]), true), greatest(len(w), len(v)) + 1) - 1 as s from pr),
gone as (select distinct o from pf where p + s >= big - 1),
st as (select o from di where o not in (select o from gone)),
v as (select doc_id, pos, l = '' or {{'d': doc_id, 'p': pos}} in (select o from st) as stays from ln)
select doc_id, count(*) as n_lines, count(*) filter (not stays) as n_removed, coalesce(string_agg(pos, ',' order by pos) filter (not stays), '') as removed_lines from v group by doc_id"""


def _mixing() -> str:
    w = ", ".join(map(str, mixing.WEIGHTS))
    return f"""
with recursive d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), {WORD})) as size,
                  substr(md5(coalesce(cast(doc_id as varchar), '') || '-{mixing.SEED}'), 1, {mixing.DRAW_HEX}) as u from documents),
s as (select source, sum(size) as n, [{w}][1 + (row_number() over (order by source nulls last) - 1) % {len(mixing.WEIGHTS)}]::double as w from d group by 1),
-- clamp what is above its cap, share the rest anew, until nothing is
fill(step, rows) as (
  select 0, (select list({{'source': source, 'n': n, 'w': w, 'full': false, 't': 0.0::double}} order by source nulls last) from s)
  union all
  select step + 1, list_transform(rows, lambda x: {{'source': x.source, 'n': x.n, 'w': x.w, 'full': x.full or level * x.w > {mixing.EPOCHS} * x.n, 't': least(({mixing.EPOCHS} * x.n)::double, case when x.full then {mixing.EPOCHS} * x.n else level * x.w end)}})
  from (select step, rows, ({mixing.SHARE} * list_sum(list_transform(rows, lambda x: x.n))
        - list_sum(list_transform(rows, lambda x: case when x.full then {mixing.EPOCHS} * x.n else 0 end)))
        / nullif(list_sum(list_transform(rows, lambda x: case when x.full then 0.0 else x.w end)), 0) as level from fill) where step <= len(rows)),
t as (select r.source as source, cast(r.n as bigint) as source_size, round(r.t, 6) as target from (select unnest(rows) as r from fill where step = (select max(step) from fill))),
e as (select d.*, t.source_size, t.target, cast(floor(case when source_size > 0 then target / source_size else 0 end + 1e-12) as bigint) as whole
      from d join t on d.source is not distinct from t.source),
x as (select *, target - whole * source_size as extra,
             sum(size) over (partition by source order by u, doc_id nulls first) as upto,
             sum(size) over (partition by source, u, doc_id) as own from e)
select doc_id, cast(size as bigint) as size, source_size, target,
       cast(size * (whole + case when extra > 0 and upto - extra <= extra - (upto - own) then 1 else 0 end) as bigint) as taken from x"""


def _quality() -> str:
    """Signals by unnesting, then EM as one CTE per step."""
    rules = quality.RULES
    votes = ", ".join(f"case when {bad} then -1 when {good} then 1 else 0 end as v{j}" for j, (bad, good) in enumerate(quality.VOTES[r] for r in rules))
    vs = ", ".join(f"v{j}" for j in range(len(rules)))
    clamp = lambda x, b: f"least(greatest({x}, {b[0]}), {b[1]})"

    def z(m: str) -> str:
        return f"ln({m}.prior / (1 - {m}.prior)) + " + " + ".join(f"case when v{j} < 0 then ln({m}.f{j} / {m}.s{j}) when v{j} > 0 then ln((1 - {m}.f{j}) / (1 - {m}.s{j})) else 0 end" for j in range(len(rules)))

    st = quality.START
    first = ", ".join(f"{st['sensitivity']}::double as s{j}, {st['alarm']}::double as f{j}" for j in range(len(rules)))
    steps = [f"m0 as materialized (select {st['prior']}::double as prior, {first})"]
    for i in range(quality.STEPS):
        new = ", ".join(
            clamp(f"(sum(case when v{j} < 0 then n * (1 - q) else 0 end) + 6) / (sum(case when v{j} <> 0 then n * (1 - q) else 0 end) + 10)", quality.SENSITIVITY) + f" as s{j}, "
            + clamp(f"(sum(case when v{j} < 0 then n * q else 0 end) + 0.2) / (sum(case when v{j} <> 0 then n * q else 0 end) + 10)", quality.ALARM) + f" as f{j}" for j in range(len(rules)))
        steps.append(f"q{i} as materialized (select pat.*, 1 / (1 + exp(-({z(f'm{i}')}))) as q from pat, m{i})")
        steps.append(f"m{i + 1} as materialized (select {clamp('(sum(n * q) + 9) / (sum(n) + 10)', quality.PRIOR)} as prior, {new} from q{i})")
    last = f"m{quality.STEPS}"
    return f"""
with d as materialized (select row_number() over () as k, doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), {WORD}) as w from documents),
win as (select k, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select k, w, unnest(range(1, len(w) - 1)) as i from d)),
rep as (select k, count(distinct j) as n from (select k, unnest([i, i + 1, i + 2]) as j from (select k, i, count(*) over (partition by k, g) as c from win) where c > 1) group by k),
ln1 as (select k, unnest(string_split(text, chr(10))) as l from d),
dup as (select k, count(*) as lines, count(*) - count(distinct l) as n from ln1 where regexp_matches(l, {WORD}) group by k),
sig as materialized (select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars,
  cast(len(regexp_extract_all(text, '{quality.SYMBOLS}')) as bigint) as n_symbols, cast(coalesce(dup.n, 0) as bigint) as n_dup_lines,
  cast(coalesce(rep.n, 0) as bigint) as n_repeat_words, coalesce(dup.lines, 0) as n_lines from d left join rep using (k) left join dup using (k)),
vot as materialized (select *, {votes} from sig),
pat as materialized (select {vs}, count(*)::double as n from vot group by all),
{', '.join(steps)},
fin as (select vot.*, 1 / (1 + exp(-({z(last)}))) as p, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from vot, {last})
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and p >= 0.5 as kept from fin"""


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
TWINS = {
    "op1_url_filters": _urls(RULES),
    "op2_exact_dedup": EXACT,
    "op4_substring_dedup": SUBSTRING,
    "op5_chat_formatting": _chat("\\### Assistant: </turn> ok"),
    "op6_line_dedup": lines_sql("documents"),
    "op7_mixing": _mixing(),
    "op9_quality_rules": _quality(),
}
