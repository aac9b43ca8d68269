"""Cleaning, profiling and summary queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabaudit.catalog.base import LINEITEM, ORDERS, PANEL, Catalog, lineitem, orders, panel, rounded, table
from tabaudit.config import AuditConfig
from tabaudit.operators import profile as P
from tabaudit.operators.panel import entity_rankings
from tabaudit.sources import clean as C
from tabaudit.sources import io

cat = Catalog()


def names_sentinels_cast(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    raw = c.select(
        F.col("c_custkey").alias(" c-custkey"), F.col("c_name").alias("c.name"),
        F.when(F.col("c_nationkey") == 7, " ?").otherwise(F.col("c_nationkey").cast("string")).alias("c-nation"),
        F.when(F.col("c_nationkey") == 3, "n/a").otherwise(F.col("c_acctbal").cast("string")).alias("acct.bal "),
        F.when(F.col("c_nationkey") == 5, "NaN").otherwise(F.col("c_nationkey").cast("string")).alias("code"),
        F.col("c_mktsegment").alias("segment"),
    )
    out = C.null_sentinels(C.canonical_names(raw))
    out = C.to_number(out, ["acct_bal", "code"]).withColumn("label", C.label_contains("segment", "BUILD"))
    return C.feature_view(out, ["acct_bal", "code", "absent_number"], ["c_nation", "absent_category"], keep=["c_custkey", "label"])


cat.add("q_names_sentinels_cast", names_sentinels_cast, """
select c_custkey, cast(contains(c_mktsegment, 'BUILD') as int) as label,
       case when c_nationkey <> 3 then c_acctbal end as acct_bal,
       case when c_nationkey <> 5 then cast(c_nationkey as double) end as code,
       cast(null as double) as absent_number,
       case when c_nationkey = 7 then 'OTHER' else cast(c_nationkey as varchar) end as c_nation,
       'OTHER' as absent_category
from customer""")


def event_props(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("k", F.regexp_extract("props", r"(\d+)", 1))
    e = C.to_number(e, ["k"]).withColumn("is_click", C.label_contains("event_type", "click"))
    return e.groupBy("event_type", "is_click").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("sum_k"))


cat.add("q_event_props", event_props, r"""
select event_type, cast(contains(event_type, 'click') as int) as is_click, count(*) as n,
       sum(try_cast(nullif(regexp_extract(props, '(\d+)', 1), '') as double)) as sum_k
from events group by 1, 2""")


def panel_load(spark: SparkSession, d: str) -> DataFrame:
    p = panel(spark, d)
    hashed = F.conv(F.substring(F.md5(F.concat_ws("-", "entity", F.col("t").cast("string"))), 1, 1), 16, 10).cast("int")
    raw = p.select(
        F.col("entity").alias("Country Name"),
        F.when(F.col("entity") == "NATION_4", None).when(F.col("entity") == "NATION_9", "OWID_X").otherwise(F.col("entity")).alias("Code"),
        F.when(hashed == 15, "n/a").otherwise(F.col("t").cast("string")).alias("Time (quarter)"),
        F.when(hashed > 3, F.col("revenue")).alias("Total revenue, USD"),
        F.when(hashed > 2, F.col("quantity").cast("string")).alias("quantity sold"),
    )
    return io.load_panel(raw, {"Entity": ["entity", "country"], "Code": ["code"], "Time": ["year", "time"]},
                         {"Revenue": ["revenue"], "Quantity": ["missing", "quantity"], "Other": ["other"]},
                         entity="Entity", time="Time", code="Code", label="High")


cat.add("q_panel_load", panel_load, f"""
with h as (select *, cast('0x' || substr(md5(entity || '-' || t), 1, 1) as int) as hx from {PANEL}),
r as (select entity as "Entity", case when entity = 'NATION_9' then 'OWID_X' else entity end as "Code",
        cast(t as int) as "Time", case when hx > 3 then revenue end as "Revenue", case when hx > 2 then quantity end as "Quantity"
      from h where entity not in ('NATION_4', 'NATION_9') and hx <> 15 and hx > 2),
s as (select *, coalesce("Revenue", 0) + coalesce("Quantity", 0) as tot from r)
select "Entity", "Time", "Code", "Revenue", "Quantity",
       cast(tot > quantile_cont(tot, 0.5) over (partition by "Time") as int) as "High" from s""")


def above_group_median(spark: SparkSession, d: str) -> DataFrame:
    o = orders(spark, d).select("o_orderkey", "o_year", "o_totalprice")
    return C.above_group_median(o, "o_totalprice", "o_year", "high").select("o_orderkey", "o_year", "high")


cat.add("q_above_group_median", above_group_median, f"""
select o_orderkey, o_year, cast(o_totalprice > quantile_cont(o_totalprice, 0.5) over (partition by o_year) as int) as high
from {ORDERS}""")


def named_customers(spark: SparkSession, d: str) -> DataFrame:
    seg = F.concat(F.upper(F.substring("c_mktsegment", 1, 1)), F.lower(F.substring("c_mktsegment", 2, 20)))
    return table(spark, d, "customer").withColumn("full_name", F.concat_ws("", "c_name", F.lit(", "), seg, F.lit(". Buyer")))


def token_extract(spark: SparkSession, d: str) -> DataFrame:
    c, added = C.derive_tokens(named_customers(spark, d), ["full_name", "c_name", "c_mktsegment"])
    c = c.withColumn("n_derived", F.lit(len(added)))
    return c.groupBy(F.col("full_name__title").alias("title"), "n_derived").agg(
        F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("keys"))


cat.add("q_token_extract", token_extract, r"""
with c as (select c_custkey, c_name || ', ' || upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) || '. Buyer' as f from customer)
select nullif(trim(regexp_extract(f, ',\s*([A-Za-z ]+?)\.', 1)), '') as title, cast(1 as int) as n_derived,
       count(*) as n, cast(sum(c_custkey) as bigint) as keys from c group by 1, 2""")

ORDER_CFG = AuditConfig(name="orders", target="high", row_id=("o_orderkey",), id_cols=("o_orderkey",))


def role_input(spark: SparkSession, d: str) -> DataFrame:
    o = orders(spark, d).withColumn("o_open", (F.col("o_orderstatus") == "O").cast("int")).withColumn(
        "high", (F.col("o_totalprice") > 250000).cast("int"))
    return o.withColumn("o_clerk", F.concat(F.lit("clerk-"), (F.col("o_custkey") % 100).cast("string"))).withColumn(
        "o_note", F.when(F.col("o_year") == 1995, None).otherwise(F.col("o_orderpriority")))


ROLE_INPUT = f"""(select *, cast(o_orderstatus = 'O' as int) as o_open, cast(o_totalprice > 250000 as int) as high,
  'clerk-' || (o_custkey % 100) as o_clerk, case when o_year <> 1995 then o_orderpriority end as o_note from {ORDERS})"""
ROLE_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority", "o_year", "o_open", "high", "o_clerk", "o_note"]
ROLE_NUMERIC = ["o_orderkey", "o_custkey", "o_totalprice", "o_year", "o_open", "high"]


def _roles_sql() -> str:
    parts = []
    for i, c in enumerate(ROLE_COLS):
        num = c in ROLE_NUMERIC
        whole = f"bool_and(coalesce(cast({c} as double) % 1 = 0, true))" if num else "false"
        parts.append(f"select '{c}' as \"column\", {i} as pos, count(*) as n_rows, count(*) - count({c}) as n_null, "
                     f"count(distinct {c}) as d, {whole} as whole, {str(num).lower()} as num from {ROLE_INPUT}")
    return f"""(select "column", pos, n_rows, n_null, d as n_distinct, case when "column" = 'high' then 'target' when "column" = 'o_orderkey' then 'id'
      when num and d <= 2 then 'binary' when num and d <= 40 and whole then 'numeric_categorical' when num then 'numeric'
      when d = n_rows or d > 0.8 * n_rows then 'id' when d <= 40 then 'categorical' else 'text' end as role
    from ({' union all '.join(parts)}))"""


ROLES_SQL = _roles_sql()

cat.add("q_roles", lambda s, d: P.infer_roles(role_input(s, d), ORDER_CFG).select("column", "role", "n_distinct", "n_null"),
        f'select "column", role, n_distinct, n_null from {ROLES_SQL}')

cat.add("q_role_sets", lambda s, d: P.role_sets(P.infer_roles(role_input(s, d), ORDER_CFG)), f"""
select "column", 'slicer' as role_set from {ROLES_SQL} where role in ('categorical', 'numeric_categorical', 'binary')
union all select "column", 'numeric' from {ROLES_SQL} where role in ('numeric', 'numeric_categorical')
union all select "column", 'categorical' from {ROLES_SQL} where role in ('categorical', 'binary')""")


def profile(spark: SparkSession, d: str) -> DataFrame:
    df = role_input(spark, d)
    out = P.profile(df, P.infer_roles(df, ORDER_CFG), ["o_custkey", "o_totalprice", "o_year", "o_open"])
    return rounded(out, null_share=8, q25=4, med=4, q75=4)


cat.add("q_profile", profile, f"""
with q as ({' union all '.join(
    f"select '{c}' as c, cast(min({c}) as double) as mn, quantile_cont(cast({c} as double), [0.25, 0.5, 0.75]) as q, cast(max({c}) as double) as mx from {ROLE_INPUT}"
    for c in ("o_custkey", "o_totalprice", "o_year", "o_open"))})
select "column", role, round(n_null / n_rows, 8) as null_share, n_distinct, mn as "min", round(q[1], 4) as q25,
       round(q[2], 4) as med, round(q[3], 4) as q75, mx as "max"
from {ROLES_SQL} left join q on c = "column" """)

SHARE_COLS = ["o_orderstatus", "o_orderpriority", "o_clerk", "o_note"]
cat.add("q_top_shares", lambda s, d: rounded(P.top_shares(role_input(s, d), SHARE_COLS, 6), share=8), f"""
with v as ({' union all '.join(f"select '{c}' as c, {c} as v from {ROLE_INPUT}" for c in SHARE_COLS)}),
n as (select c, v, count(*) as n from v where v is not null group by 1, 2),
r as (select *, sum(n) over (partition by c) as t, row_number() over (partition by c order by n desc, v) as k from n)
select c as "column", cast(k as int) as rank, v as value, n, round(n / t, 8) as share from r where k <= 6""")


def line_slicers(spark: SparkSession, d: str) -> tuple[DataFrame, dict[str, int]]:
    li = lineitem(spark, d).select("ship_year", "l_linenumber", "l_returnflag", "l_linestatus", "l_discount", "l_quantity", "l_extendedprice")
    cols = ["ship_year", "l_linenumber", "l_returnflag", "l_linestatus"]
    row = li.agg(*[F.count_distinct(c).alias(c) for c in cols]).first()
    return li, row.asDict()


LINE_CFG = AuditConfig(name="lineitem", target="l_late", row_id=("rid",))


def rank_slicers(spark: SparkSession, d: str) -> DataFrame:
    li, _ = line_slicers(spark, d)
    li = li.withColumn("l_qty_group", (F.col("l_quantity") % 3).cast("int")).withColumn("is_big", (F.col("l_quantity") > 25).cast("int"))
    return P.ranked_slicers(P.infer_roles(li, LINE_CFG))


cat.add("q_rank_slicers", rank_slicers, f"""
with d as ({' union all '.join(f"select '{c}' as c, {i} as pos, count(distinct {e}) as d from {LINEITEM}" for i, (c, e) in enumerate([
    ('ship_year', 'ship_year'), ('l_linenumber', 'l_linenumber'), ('l_returnflag', 'l_returnflag'), ('l_linestatus', 'l_linestatus'),
    ('l_qty_group', 'cast(l_quantity as int) % 3'), ('is_big', 'l_quantity > 25')]))}),
s as (select *, case when c in ('ship_year', 'l_qty_group') then 3 else 0 end
        + case when d between 3 and 15 then 2 when d = 2 then 1 else 0 end as score from d),
r as (select *, row_number() over (order by score desc, d, pos) as rk from s)
select c as "column", cast(score as int) as score, d as n_distinct, cast(rk as int) as rank from r""")


def best_stratifier(spark: SparkSession, d: str) -> DataFrame:
    li, distinct = line_slicers(spark, d)
    return P.best_stratifiers(li, P.rank_slicers(spark, distinct, list(distinct)), distinct)


def _best_strat_sql() -> str:
    # ranked order: ship_year (3+2), then 3..15 levels by size, then the two-level flag
    order = {"ship_year": 0, "l_returnflag": 1, "l_linenumber": 2, "l_linestatus": 3}
    parts = []
    for s in order:
        for k in order:
            if s != k and k != "l_linestatus":
                parts.append(f"select '{s}' as slicer, '{k}' as stratifier, {order[k]} as pos, count(*) as n from {LINEITEM} group by {s}, {k}")
    return f"""with p as ({' union all '.join(parts)}),
c as (select slicer, stratifier, pos, count(*) filter (n >= 100) as n_cells from p group by 1, 2, 3),
r as (select *, row_number() over (partition by slicer order by n_cells desc, pos) as k from c)
select slicer, stratifier, n_cells from r where k = 1"""


cat.add("q_best_stratifier", best_stratifier, _best_strat_sql())


def cross_summaries(spark: SparkSession, d: str) -> DataFrame:
    o = orders(spark, d)
    out = P.cross_summaries(o, ["o_year", "o_orderpriority", "o_orderstatus"], ["o_totalprice", "o_custkey"], ["o_orderstatus", "o_orderpriority"])
    return rounded(out, value=6)


def _cross_sql() -> str:
    slicers, nums, cats = ["o_year", "o_orderpriority", "o_orderstatus"], ["o_totalprice", "o_custkey"], ["o_orderstatus", "o_orderpriority"]
    parts = []
    for s in slicers:
        for c in nums:
            for stat, e in (("med", f"quantile_cont(cast({c} as double), 0.5)"), ("min", f"min({c})"), ("max", f"max({c})")):
                parts.append(f"select '{s}' as slicer, cast({s} as varchar) as level, count(*) as n_level, '{c}' as \"column\", '{stat}' as stat, "
                             f"round(cast({e} as double), 6) as value from {ORDERS} group by {s} having count(*) >= 10")
        for c in cats:
            if c != s:
                parts.append(f"""select '{s}', level, cast(n_level as bigint), '{c}', 'share:' || v, round(n / n_level, 6) from (
                  select cast({s} as varchar) as level, {c} as v, count(*) as n, sum(count(*)) over (partition by {s}) as n_level,
                         row_number() over (partition by {s} order by count(*) desc, {c}) as k
                  from {ORDERS} group by {s}, {c}) where k <= 3 and n_level >= 10""")
    return " union all ".join(parts)


cat.add("q_cross_summaries", cross_summaries, _cross_sql())

cat.add("q_entity_rankings", lambda s, d: rounded(entity_rankings(panel(s, d), "entity", ["revenue", "quantity"]), median=4), f"""
with m as ({' union all '.join(f"select '{c}' as c, entity, quantile_cont({c}, 0.5) as m from {PANEL} group by entity" for c in ('revenue', 'quantity'))}),
r as (select *, row_number() over (partition by c order by m desc, entity) as k from m)
select c as "column", entity, round(m, 4) as median, cast(k as int) as rank from r where k <= 12""")
