"""Repairs: inverting the mechanism of a finding, without touching other rows.

Most repairs are one column expression. Draws (from a reference slice or a
category mix) use the hash of the row identity, so that a retried task draws the
same value.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabaudit.functions.lineage import cut
from tabaudit.functions.order_stats import bucket_of, cumulative, ordinal_in_group, value_edges
from tabaudit.functions.predicates import as_number, slice_pred, window_pred
from tabaudit.functions.rng import HEX_DIGITS, SCALE, key_sql, key_text, uniform
from tabaudit.operators.frozen import DOMINANT, apply_stage, ladder, salt_of, stages
from tabaudit.sources.clean import TOKEN_PATTERN, TOKEN_SUFFIX, token

REVIEW_ONLY = ("flag_entity", "flag_fd")
YEAR_REPAIR = "interpolate_year"
MAX_GAP, MAX_CARRY = 8, 3
BLOCK_ROWS = 200_000


def _number(target: str) -> Column:
    return as_number(F.col(f"`{target}`"))


def repair_subtract(df: DataFrame, target: str, rows: Column, value: float) -> DataFrame:
    """Subtract a constant in a slice."""
    x = _number(target)
    return df.withColumn(target, F.when(rows, x - F.lit(float(value))).otherwise(x))


def repair_divide(df: DataFrame, target: str, rows: Column, value: float) -> DataFrame:
    """Divide a slice by a constant."""
    x = _number(target)
    return df.withColumn(target, F.when(rows, x / F.lit(float(value))).otherwise(x))


def repair_window(df: DataFrame, targets: Sequence[str], rows: Column, time: str, start: int, factor: float | None = None,
                  per_year: float | None = None) -> DataFrame:
    """Divide a window by a factor, or by ``per_year ** k`` with k = 1 at the window start."""
    by = F.pow(F.lit(float(per_year)), F.col(time) - F.lit(start) + 1) if per_year else F.lit(float(factor))
    return df.withColumns({t: F.when(rows, _number(t) / by).otherwise(_number(t)) for t in targets})


def _with_draws(hit: DataFrame, spans: DataFrame, n: int, hits: int, u: Column) -> DataFrame:
    """``hit`` with ``_draw``: the value ``_v`` of the span ``lo`` <= rank < ``hi`` that holds the rank floor(u * n).

    Ranks are looked up by merging draws and spans inside blocks of equal rank range,
    about BLOCK_ROWS rows of both in each, so neither side is gathered or paired with
    the whole other side.
    """
    cols = hit.columns
    size = max(1, n // -(-(n + hits) // BLOCK_ROWS))
    blocks = spans.withColumn("_block", F.explode(F.sequence(F.floor(F.col("lo") / size), F.floor((F.col("hi") - 1) / size))))
    left = blocks.select(
        *[F.lit(None).cast(hit.schema[c].dataType).alias(c) for c in cols], "_block",
        F.greatest(F.col("lo"), F.col("_block") * size).alias("_r"), F.lit(0).alias("_kind"), "_v")
    r = F.least(F.floor(u * n), F.lit(n - 1))
    right = hit.withColumn("_r", r).select(
        *cols, F.floor(F.col("_r") / size).alias("_block"), "_r", F.lit(1).alias("_kind"), F.lit(None).cast(spans.schema["_v"].dataType).alias("_v"))
    w = Window.partitionBy("_block").orderBy("_r", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    drawn = left.unionByName(right).withColumn("_draw", F.last("_v", ignorenulls=True).over(w))
    return drawn.filter("_kind = 1").select(*cols, "_draw")


def repair_from_reference(df: DataFrame, target: str, rows: Column, keys: Sequence[str], salt: str = "reference") -> DataFrame:
    """Replace a slice by random draws from the values of all other rows (null if there are none).

    A draw is a rank in the sorted reference.
    """
    x = _number(target)
    df = df.withColumn(target, x)
    hit = df.filter(rows)
    rest = df.filter(~rows)
    ref = rest.filter(F.col(target).isNotNull()).select(F.col(target).alias("x"))
    sizes = df.agg(F.count_if(~rows & F.col(target).isNotNull()).alias("n"), F.count_if(rows).alias("hits")).first()
    n = sizes["n"]
    if n == 0:
        return df.withColumn(target, F.when(~rows, F.col(target)))
    edges = value_edges(ref, ["x"])["x"]
    hist = ref.groupBy("x").agg(F.count(F.lit(1)).alias("n")).withColumn("_g", F.lit(0))
    ranked = cumulative(hist, ["_g"], "x", {"n": "hi"}, bucket_of(F.col("x"), edges))
    spans = ranked.select((F.col("hi") - F.col("n")).alias("lo"), "hi", F.col("x").alias("_v"))
    drawn = _with_draws(hit, spans, n, sizes["hits"], uniform(key_text(keys), salt))
    return rest.unionByName(drawn.withColumn(target, F.col("_draw")).select(*df.columns))


def _ladder(u: Column, steps: Sequence[tuple[Any, Any]]) -> Column:
    """The first value whose cumulative bound exceeds ``u``."""
    out = None
    for value, bound in steps[:-1]:
        out = F.when(u < F.lit(bound), F.lit(value)) if out is None else out.when(u < F.lit(bound), F.lit(value))
    last = F.lit(steps[-1][0])
    return last if out is None else out.otherwise(last)


def _category_spans(values: DataFrame, target: str) -> DataFrame:
    """Ranks of each category, the frequent ones first, equally frequent ones by value: lo, hi, _v.

    Categories of one frequency have equal spans, so a category's place is the end of the
    more frequent ones plus its number among its equals. The window without a partition
    sees one row per distinct frequency, at most the square root of twice the rows.
    """
    mix = cut(values.groupBy(F.col(target).alias("_v")).agg(F.count(F.lit(1)).alias("n")))
    upto = F.sum("all").over(Window.orderBy(F.desc("n")))
    before = mix.groupBy("n").agg(F.sum("n").alias("all")).select("n", (upto - F.col("all")).alias("before"))
    placed = ordinal_in_group(mix, ["n"], ["_v"], "k").join(before, "n")
    lo = F.col("before") + (F.col("k") - 1) * F.col("n")
    return placed.select(lo.alias("lo"), (lo + F.col("n")).alias("hi"), "_v")


def repair_recategorise(df: DataFrame, target: str, slicer: str, level: Any, keys: Sequence[str], context: str | None = None,
                        context_level: Any = None, salt: str = "category") -> DataFrame:
    """Replace a slice by draws from the category mix of the other levels in the same context."""
    rows = slice_pred(slicer, level, context, context_level)
    inside = slice_pred(context, context_level) if context is not None else F.lit(True)
    is_ref = inside & ~slice_pred(slicer, level) & F.col(target).isNotNull()
    sizes = df.agg(F.count_if(is_ref).alias("n"), F.count_if(rows).alias("hits")).first()
    if not sizes["n"]:
        return df
    drawn = _with_draws(df.filter(rows), _category_spans(df.filter(is_ref), target), sizes["n"], sizes["hits"], uniform(key_text(keys), salt))
    return df.filter(~F.coalesce(rows, F.lit(False))).unionByName(drawn.withColumn(target, F.col("_draw")).select(*df.columns))


def repair_missing(df: DataFrame, target: str, rows: Column, dist: Mapping[str, float], keys: Sequence[str], salt: str = "missing") -> DataFrame:
    """Fill the nulls of a slice: the dominant category if there is one, else draws from ``dist``."""
    if not dist:
        return df
    steps = ladder(dist)
    value = F.lit(steps[0][0]) if len(steps) == 1 else _ladder(uniform(key_text(keys), salt), steps)
    hole = rows & F.col(target).isNull()
    return df.withColumn(target, F.when(hole, value.cast(df.schema[target].dataType)).otherwise(F.col(target)))


def repair_interpolate(df: DataFrame, target: str, entity: str, time: str, fix: Sequence[int], bad: Sequence[int]) -> DataFrame:
    """Replace bad periods by a line between the nearest intact points.

    With points on both sides the gap may be at most 8, else the cell is left
    alone; with one side only, that value is carried at most 3 periods. Anchors
    are found by an equi-join on (entity, time +- 1..8) for the bad rows only.
    """
    df = df.withColumn(target, _number(target))
    good = df.filter(F.col(target).isNotNull() & F.col(entity).isNotNull() & ~F.col(time).isin(list(bad))).select(
        F.col(entity).alias("_e"), F.col(time).cast("int").alias("_t"), F.col(target).alias("_x"))
    holes = df.filter(F.col(time).isin(list(fix)) & F.col(entity).isNotNull()).select(F.col(entity).alias("_e"), F.col(time).cast("int").alias("_y")).distinct()
    steps = F.explode(F.array(*[F.lit(k) for k in range(-MAX_GAP, MAX_GAP + 1) if k]))
    near = holes.withColumn("_k", steps).withColumn("_t", F.col("_y") + F.col("_k")).join(good, ["_e", "_t"])
    point = F.struct("_t", "_x")
    near = near.groupBy("_e", "_y").agg(F.max(F.when(F.col("_t") < F.col("_y"), point)).alias("_p"), F.min(F.when(F.col("_t") > F.col("_y"), point)).alias("_n"))
    ends = good.groupBy("_e").agg(F.min("_t").alias("_lo"), F.max("_t").alias("_hi"))
    h = holes.join(near, ["_e", "_y"], "left").join(ends, "_e", "left")
    before, after = F.coalesce(F.col("_lo") < F.col("_y"), F.lit(False)), F.coalesce(F.col("_hi") > F.col("_y"), F.lit(False))
    t0, x0, t1, x1 = F.col("_p._t"), F.col("_p._x"), F.col("_n._t"), F.col("_n._x")
    line = F.when(t1 - t0 <= MAX_GAP, x0 + (x1 - x0) * (F.col("_y") - t0) / (t1 - t0))
    value = F.when(before & after, line).when(before & (F.col("_y") - t0 <= MAX_CARRY), x0).when(after & (t1 - F.col("_y") <= MAX_CARRY), x1)
    h = h.select(F.col("_e"), F.col("_y"), value.alias("_new")).filter("_new is not null")
    j = df.join(h, (F.col(entity) == F.col("_e")) & (F.col(time) == F.col("_y")), "left")
    return j.withColumn(target, F.coalesce("_new", F.col(target))).select(*df.columns)


def apply_repair(df: DataFrame, f: Row, keys: Sequence[str], seed: int = 0) -> DataFrame:
    """Apply the repair of one finding."""
    r, t = f["repair"], f["target"]
    kind = r["type"]
    salt = salt_of(f, seed)
    if kind in REVIEW_ONLY:
        return df
    if kind == YEAR_REPAIR:
        return repair_interpolate(df, t, r["entity_col"], r["time_col"], [r["year"]], r["all_years"] or [r["year"]])
    if kind in ("divide_window", "divide_window_multi"):
        rows = window_pred(r["entity_col"], r["entity"], r["time_col"], r["start"], r["end"])
        return repair_window(df, r["targets"] or [t], rows, r["time_col"], r["start"], r["factor"], r["per_year"])
    if kind == "reimpute_categorical":
        return repair_recategorise(df, t, f["slicer"], f["level"], keys, f["context"], f["context_level"], salt)
    rows = slice_pred(f["slicer"], f["level"], f["context"], f["context_level"])
    if kind == "subtract":
        return repair_subtract(df, t, rows, r["value"])
    if kind == "divide":
        return repair_divide(df, t, rows, r["value"])
    if kind == "impute_from_reference":
        return repair_from_reference(df, t, rows, keys, salt)
    if kind == "impute_missing":
        return repair_missing(df, t, rows, r["dist"], keys, salt)
    raise ValueError(f"unknown repair {kind}")


def _series(f: Row) -> tuple:
    return f["target"], f["repair"]["entity_col"], f["repair"]["time_col"]


def apply_all(df: DataFrame, findings: Sequence[Row], keys: Sequence[str], confidences: Sequence[str] = ("REPAIR",), seed: int = 0) -> DataFrame:
    """Apply the repairs of the findings in order; helper columns are added and dropped again.

    Repairs that need no other rows are applied many at once (see ``frozen``).
    """
    chosen = [f for f in findings if f["repair"] is not None and f["confidence"] in confidences and f["repair"]["type"] not in REVIEW_ONLY]
    columns = df.columns
    helpers = {c[: -len(TOKEN_SUFFIX)] for f in chosen for c in (f["slicer"], f["context"]) if c and c.endswith(TOKEN_SUFFIX) and c not in columns}
    if helpers:
        # the findings name them: whether a column qualifies was asked by the audit
        df = df.withColumns({f"{c}{TOKEN_SUFFIX}": token(c) for c in sorted(helpers)})
    years: dict[tuple, list[Row]] = {}
    for f in chosen:
        if f["repair"]["type"] == YEAR_REPAIR:
            years.setdefault(_series(f), []).append(f)
    first = {id(same[0]) for same in years.values()}
    for stage in stages([f for f in chosen if f["repair"]["type"] != YEAR_REPAIR or id(f) in first], keys):
        f = stage.found[0][1]
        if f["repair"]["type"] == YEAR_REPAIR:  # all bad years of a column in one pass
            same = years[_series(f)]
            fix = sorted({x["repair"]["year"] for x in same})
            bad = sorted({y for x in same for y in x["repair"]["all_years"] or [x["repair"]["year"]]})
            df = repair_interpolate(df, f["target"], f["repair"]["entity_col"], f["repair"]["time_col"], fix, bad)
        elif len(stage.found) == 1:
            df = apply_repair(df, f, keys, seed)
        else:
            df = apply_stage(df, stage, keys, seed)
    return df.select(*columns)


def _quoted(c: Column) -> Column:
    plain = F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\"))
    return F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("\\'")), F.lit("'"))


def _name(c: Column) -> Column:
    return F.concat(F.lit("`"), c, F.lit("`"))


def _fill_text(r: Column, keys: Sequence[str], seed: int) -> Column:
    """SQL of the value that fills a hole: the dominant category, else a draw from ``dist`` by row identity."""
    shares = r["dist"]
    total = F.aggregate(F.map_values(shares), F.lit(0.0), lambda a, v: a + v)
    items = F.array_sort(F.map_entries(shares), lambda a, b: F.when(a["value"] > b["value"], -1).when(a["value"] < b["value"], 1).when(
        a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    top, last = F.get(items, F.lit(0)), F.get(items, F.size(items) - 1)
    if not keys:
        return F.when(top["value"] / total >= DOMINANT, _quoted(top["key"]))
    salt = F.concat(F.lit(f"{seed}|"), F.concat_ws("|", "kind", "slicer", "level", "target"))
    u = F.concat(F.lit(f"cast(conv(substring(md5(concat({key_sql(keys)}, '-', "), _quoted(salt), F.lit(f")), 1, {HEX_DIGITS}), 16, 10) as double) / {SCALE!r}D"))
    start = F.struct(F.lit(0.0).alias("run"), F.lit("case").alias("sql"))

    def step(a: Column, e: Column) -> Column:
        run = a["run"] + e["value"] / total
        return F.struct(run.alias("run"), F.concat(a["sql"], F.lit(" when "), u, F.lit(" < "), run.cast("string"), F.lit("D then "), _quoted(e["key"])).alias("sql"))

    drawn = F.aggregate(F.slice(items, F.lit(1), F.greatest(F.size(items) - 1, F.lit(0))), start, step, lambda a: F.concat(a["sql"], F.lit(" else "), _quoted(last["key"]), F.lit(" end")))
    return F.when(top["value"] / total >= DOMINANT, _quoted(top["key"])).otherwise(drawn)


def with_repair_sql(findings: DataFrame, keys: Sequence[str] = (), seed: int = 0) -> DataFrame:
    """Add ``repair_sql``: the repaired target as a Spark SQL expression.

    Fills that draw from a mix of categories need the row id ``keys`` (and the ``seed``
    given to the executor). Repairs that need other rows, and draws without keys, name
    the operator that does it. Helper token columns are written out as expressions.
    """
    r = F.col("repair")
    t = _name(F.col("target"))

    def side(c: str) -> Column:
        cut_ = F.expr(f"substring({c}, 1, length({c}) - {len(TOKEN_SUFFIX)})")
        token = F.concat(F.lit("trim(regexp_extract(`"), cut_, F.lit("`, '" + TOKEN_PATTERN.replace("\\", "\\\\") + "', 1))"))
        return F.when(F.col(c).endswith(TOKEN_SUFFIX), token).otherwise(F.concat(F.lit("cast("), _name(F.col(c)), F.lit(" as string)")))

    where = F.concat(side("slicer"), F.lit(" = "), _quoted(F.col("level")),
                     F.when(F.col("context").isNotNull(), F.concat(F.lit(" and "), side("context"), F.lit(" = "), _quoted(F.col("context_level")))).otherwise(""))
    num = F.concat(F.lit("try_cast("), t, F.lit(" as double)"))

    def case(cond: Column, value: Column, other: Column) -> Column:
        return F.concat(F.lit("case when "), cond, F.lit(" then "), value, F.lit(" else "), other, F.lit(" end"))

    text = lambda c: c.cast("string")
    window = F.concat(F.lit("cast("), _name(r["entity_col"]), F.lit(" as string) = "), _quoted(r["entity"]), F.lit(" and "), _name(r["time_col"]),
                      F.lit(" between "), text(r["start"]), F.lit(" and "), text(r["end"]))
    by = F.when(r["per_year"].isNotNull(), F.concat(F.lit("pow("), text(r["per_year"]), F.lit("D, "), _name(r["time_col"]), F.lit(" - "), text(r["start"]), F.lit(" + 1)"))
                ).otherwise(F.concat(text(r["factor"]), F.lit("D")))
    fill = _fill_text(r, keys, seed)
    multi = F.array_join(F.transform(r["targets"], lambda c: F.concat(
        F.lit("case when "), window, F.lit(" then `"), c, F.lit("` / "), by, F.lit(" else `"), c, F.lit("` end as `"), c, F.lit("`"))), ", ")
    sql = (
        F.when(r["type"] == "subtract", case(where, F.concat(num, F.lit(" - "), text(r["value"]), F.lit("D")), num))
        .when(r["type"] == "divide", case(where, F.concat(num, F.lit(" / "), text(r["value"]), F.lit("D")), num))
        .when(r["type"] == "impute_missing", F.coalesce(
            case(F.concat(where, F.lit(" and "), t, F.lit(" is null")), fill, t), F.concat(F.lit("-- draw from the mix for nulls where "), where)))
        .when(r["type"] == "divide_window", case(window, F.concat(num, F.lit(" / "), by), num))
        .when(r["type"] == "divide_window_multi", multi)
        .when(r["type"].isin("reimpute_categorical", "impute_from_reference"), F.concat(F.lit("-- draw from the other rows where not ("), where, F.lit(")")))
        .when(r["type"] == "interpolate_year", F.concat(F.lit("-- interpolate "), t, F.lit(" at "), text(r["year"]), F.lit(" between intact periods")))
        .when(r["type"].isin(*REVIEW_ONLY), F.concat(F.lit("-- review "), t, F.lit(" where "), where))
    )
    return findings.withColumn("repair_sql", sql)
