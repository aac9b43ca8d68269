"""Panel audits: every entity is judged by its own series and by its peers.

Series are cut in overlapping chunks (``chunked_series``), so that one very long
series is worked on by many tasks; all window frames here are a few rows wide.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabaudit.functions.lineage import cut
from tabaudit.functions.order_stats import chunked_series, group_quantiles, value_edges
from tabaudit.functions.predicates import as_number
from tabaudit.operators.findings import to_findings

MIN_SERIES = 5
MIN_GROWTH_SERIES = 12
MIN_PEERS = 20
GROWTH = 1.15
MIN_LEN, MAX_LEN = 3, 12


def long_series(df: DataFrame, entity: str, time: str, numerics: Sequence[str]) -> DataFrame:
    """(entity, time, target, y): one row per measure."""
    cells = F.array(*[F.struct(F.lit(c).alias("target"), as_number(F.col(c).cast("double")).alias("y")) for c in numerics if c != time])
    long = df.filter(F.col(entity).isNotNull()).select(F.col(entity).cast("string").alias("entity"), F.col(time).cast("int").alias("time"), F.explode(cells).alias("e"))
    return long.select("entity", "time", "e.target", "e.y")


def _chunk_window() -> Window:
    return Window.partitionBy("entity", "target", "chunk").orderBy("pos")


def neighbour_mean(series: DataFrame, **chunking: int) -> DataFrame:
    """Mean of the previous and the next row of each series (null at the ends): column ``pred``."""
    w = _chunk_window()
    s = chunked_series(series, ["entity", "target"], "time", halo=1, **chunking)
    pred = (F.lag("y").over(w) + F.lead("y").over(w)) / 2
    return s.withColumn("pred", pred).filter("own").select("entity", "time", "target", "y", "pred")


def period_ratios(series: DataFrame, **chunking: int) -> DataFrame:
    """Per (target, time): share of series far below their neighbours, and how many were compared."""
    sizes = series.groupBy("entity", "target").agg(F.count(F.lit(1)).alias("len")).filter(F.col("len") >= MIN_SERIES)
    near = neighbour_mean(series, **chunking).join(sizes.select("entity", "target"), ["entity", "target"])
    low = F.coalesce(F.col("y") / F.col("pred") < 0.2, F.lit(False))
    return near.filter("pred > 0").groupBy("target", "time").agg(F.avg(low.cast("double")).alias("frac"), F.count(F.lit(1)).alias("n"))


def detect_period_collapse(df: DataFrame, entity: str, time: str, numerics: Sequence[str], **chunking: int) -> DataFrame:
    """Time points at which most series drop to nearly nothing; the repair lists all bad times of the target."""
    bad = period_ratios(long_series(df, entity, time, numerics), **chunking).filter((F.col("n") >= MIN_PEERS) & (F.col("frac") >= 0.6))
    all_years = bad.groupBy("target").agg(F.sort_array(F.collect_set("time")).alias("all_years"))
    j = bad.join(all_years, "target")
    return to_findings(
        j, kind="year_collapse", slicer=time, level=F.col("time"), target=F.col("target"), n=F.col("n"), confidence="REPAIR",
        stats={"frac": F.col("frac")},
        repair={"type": "interpolate_year", "time_col": time, "entity_col": entity, "year": F.col("time"), "all_years": F.col("all_years")},
    )


def rolling_median(series: DataFrame, half: int = 10, min_rows: int = 7, **chunking: int) -> DataFrame:
    """Centred rolling median of ``y`` over 2*half+1 rows: column ``rm``."""
    w = _chunk_window().rowsBetween(-half, half)
    s = chunked_series(series, ["entity", "target"], "time", halo=half, **chunking)
    rm = F.when(F.count("y").over(w) >= min_rows, F.percentile("y", F.lit(0.5)).over(w))
    return s.withColumn("rm", rm).filter("own").drop("chunk", "own")


def growth_series(series: DataFrame, **chunking: int) -> DataFrame:
    """Log series worth searching: long enough, complete, positive and not smooth."""
    whole = series.groupBy("entity", "target").agg(F.count(F.lit(1)).alias("len"), F.count("y").alias("v"), F.min("y").alias("lo"))
    whole = whole.filter((F.col("len") >= MIN_GROWTH_SERIES) & (F.col("v") == F.col("len")) & (F.col("lo") > 0)).select("entity", "target", "len")
    logs = series.join(whole, ["entity", "target"]).withColumn("y", F.log("y"))
    rough = rolling_median(logs, **chunking).groupBy("entity", "target").agg(F.max(F.abs(F.col("y") - F.col("rm"))).alias("dev"))
    rough = rough.filter(F.col("dev") >= 0.6 * math.log(GROWTH)).select("entity", "target")
    return logs.join(rough, ["entity", "target"])


def candidate_windows(logs: DataFrame, min_len: int = MIN_LEN, max_len: int = MAX_LEN, **chunking: int) -> DataFrame:
    """Every window (start, length) with three rows left on both sides, and its points.

    At most ``max_len - min_len + 1`` windows per row, each with at most
    ``max_len`` points in an array.
    """
    w = _chunk_window().rowsBetween(0, max_len - 1)
    s = chunked_series(logs, ["entity", "target"], "time", halo=max_len, **chunking)
    s = s.withColumn("points", F.collect_list(F.struct("time", "y")).over(w)).filter("own")
    longest = F.least(F.lit(max_len), F.col("len") - 6, F.col("len") - 3 - F.col("pos")).cast("int")
    s = s.filter((F.col("pos") >= 3) & (longest >= min_len))
    s = s.withColumn("length", F.explode(F.sequence(F.lit(min_len), longest)))
    return s.select("entity", "target", "len", F.col("pos").alias("first"), "length", F.slice("points", 1, F.col("length")).alias("points"))


def _total(points: Column, f) -> Column:
    return F.aggregate(points, F.lit(0.0), lambda acc, p: acc + f(p))


def _at(sorted_values: Column, q: float, length: Column) -> Column:
    """Linear-interpolated quantile of a short sorted array."""
    pos = F.lit(q) * (length - 1)
    lo = F.element_at(sorted_values, (F.floor(pos) + 1).cast("int"))
    hi = F.element_at(sorted_values, (F.ceil(pos) + 1).cast("int"))
    return lo + (hi - lo) * (pos - F.floor(pos))


def fit_windows(logs: DataFrame, **chunking: int) -> DataFrame:
    """Line through the points outside every candidate window, and the residuals inside.

    The outside fit comes from the totals of the series minus the sums of the
    window, so no window re-reads its series. Times and values are centred first.
    """
    mean = logs.groupBy("entity", "target").agg(F.avg("time").alias("mx"), F.avg("y").alias("my"))
    x, y = F.col("time") - F.col("mx"), F.col("y") - F.col("my")
    tot = logs.join(mean, ["entity", "target"]).groupBy("entity", "target").agg(
        F.first("mx").alias("mx"), F.first("my").alias("my"),
        F.sum(x).alias("tx"), F.sum(y).alias("ty"), F.sum(x * x).alias("txx"), F.sum(x * y).alias("txy"), F.sum(y * y).alias("tyy"))
    c = candidate_windows(logs, **chunking).join(tot, ["entity", "target"])
    centred = F.transform("points", lambda p: F.struct((p["time"] - F.col("mx")).alias("x"), (p["y"] - F.col("my")).alias("y")))
    c = c.withColumn("c", centred)
    pts = F.col("c")
    c = c.select(
        "*", (F.col("len") - F.col("length")).alias("m"),
        (F.col("tx") - _total(pts, lambda p: p["x"])).alias("sx"),
        (F.col("ty") - _total(pts, lambda p: p["y"])).alias("sy"),
        (F.col("txx") - _total(pts, lambda p: p["x"] * p["x"])).alias("sxx"),
        (F.col("txy") - _total(pts, lambda p: p["x"] * p["y"])).alias("sxy"),
        (F.col("tyy") - _total(pts, lambda p: p["y"] * p["y"])).alias("syy"),
    )
    m = F.col("m")
    c = c.withColumn("vxx", F.col("sxx") - F.col("sx") * F.col("sx") / m).withColumn("vxy", F.col("sxy") - F.col("sx") * F.col("sy") / m).withColumn(
        "vyy", F.col("syy") - F.col("sy") * F.col("sy") / m)
    c = c.withColumn("slope", F.col("vxy") / F.col("vxx")).withColumn("icept", (F.col("sy") - F.col("slope") * F.col("sx")) / m)
    var = (F.col("vyy") - F.col("slope") * F.col("vxy")) / m
    c = c.withColumn("noise", F.sqrt(F.greatest(var, F.lit(0.0))) + 1e-6)
    c = c.withColumn("resid", F.transform("c", lambda p: p["y"] - (F.col("slope") * p["x"] + F.col("icept"))))
    sorted_ = F.array_sort("resid")
    mid = (F.col("length") - 1) / 2
    num = F.aggregate(F.transform("resid", lambda v, i: v * (i - mid)), F.lit(0.0), lambda a, v: a + v)
    den = F.col("length") * (F.col("length") * F.col("length") - 1) / 12
    return c.select(
        "entity", "target", "first", "length", "noise",
        F.element_at("points", 1)["time"].alias("start"), F.element_at("points", -1)["time"].alias("end"),
        _at(sorted_, 0.5, F.col("length")).alias("med"), _at(sorted_, 0.25, F.col("length")).alias("q25"), (num / den).alias("trend"),
    )


def best_windows(df: DataFrame, entity: str, time: str, numerics: Sequence[str], **chunking: int) -> DataFrame:
    """The best-scoring inflated window of every series that has one (first wins ties: length, then start)."""
    logs = cut(growth_series(long_series(df, entity, time, numerics), **chunking))
    fits = fit_windows(logs, **chunking).filter((F.col("med") > math.log(GROWTH)) & (F.col("q25") > 3 * F.col("noise")))
    fits = fits.withColumn("score", F.col("med") / F.col("noise"))
    best = F.max_by(F.struct("start", "end", "med", "trend", "score"), F.struct(F.col("score"), -F.col("length"), -F.col("first")))
    b = fits.groupBy("entity", "target").agg(best.alias("b")).select("entity", "target", "b.*")
    return b.select("entity", "target", "start", "end", F.exp("med").alias("factor"), F.exp("trend").alias("per_year"), "score")


def detect_window_growth(df: DataFrame, entity: str, time: str, numerics: Sequence[str], **chunking: int) -> DataFrame:
    """A contiguous window of one series above its own outside trend."""
    b = best_windows(df, entity, time, numerics, **chunking)
    return to_findings(
        b, kind="window_growth", slicer=entity, level=F.col("entity"), target=F.col("target"), n=F.col("end") - F.col("start") + 1,
        confidence=F.when(F.col("score") > 4, "REPAIR").otherwise("REVIEW"),
        stats={"score": F.col("score"), "ratio": F.col("factor")},
        repair={"type": "divide_window", "entity_col": entity, "entity": F.col("entity"), "time_col": time, "start": F.col("start"),
                "end": F.col("end"), "factor": F.col("factor"),
                "per_year": F.when(F.col("per_year") > 1.08, F.col("per_year"))},
    )


def merge_entity_windows(findings: DataFrame, entity: str, time: str, min_cols: int = 3) -> DataFrame:
    """Similar windows on several columns of one entity become one finding."""
    is_window = F.col("kind") == "window_growth"
    r = F.col("repair")
    g = findings.filter(is_window).groupBy("level").agg(
        F.count(F.lit(1)).alias("c"), F.max(r["factor"]).alias("hi"), F.min(r["factor"]).alias("lo"),
        F.percentile(r["start"], F.lit(0.5)).cast("int").alias("s"), F.percentile(r["end"], F.lit(0.5)).cast("int").alias("e"),
        F.percentile(r["factor"], F.lit(0.5)).alias("f"), F.sort_array(F.collect_list("target")).alias("ts"),
    ).filter((F.col("c") >= min_cols) & (F.col("hi") / F.col("lo") <= 1.15))
    merged = to_findings(
        g, kind="entity_window_growth", slicer=entity, level=F.col("level"), target=F.concat_ws(",", "ts"),
        n=F.col("e") - F.col("s") + 1, confidence="REPAIR", stats={"ratio": F.col("f")},
        repair={"type": "divide_window_multi", "entity_col": entity, "entity": F.col("level"), "time_col": time, "start": F.col("s"),
                "end": F.col("e"), "targets": F.col("ts"), "factor": F.col("f")},
    )
    taken = g.select(F.col("level").alias("_entity"))
    singles = findings.filter(is_window).join(taken, F.col("level") == F.col("_entity"), "left_anti")
    return findings.filter(~is_window).unionByName(singles).unionByName(merged)


def demote_mass_windows(findings: DataFrame, per_col: int = 5, total: int = 12) -> DataFrame:
    """A panel with many single-column windows has trend breaks of its own, so these go to REVIEW."""
    single = F.col("kind") == "window_growth"
    per = findings.filter(single).groupBy("target").count()
    flag = per.agg(F.sum("count").alias("_all"), F.max("count").alias("_most")).withColumn("_k", F.lit(1))
    j = findings.withColumn("_k", F.lit(1)).join(flag, "_k", "left")
    hit = single & (F.col("confidence") == "REPAIR") & ((F.col("_all") >= total) | (F.col("_most") >= per_col))
    note = F.concat(F.lit("mass windows: "), F.col("_all").cast("string"), F.lit(" single-column windows in the panel"))
    return (
        j.withColumn("notes", F.when(hit, F.concat("notes", F.array(note))).otherwise(F.col("notes")))
        .withColumn("confidence", F.when(hit, F.lit("REVIEW")).otherwise(F.col("confidence")))
        .select(*findings.columns)
    )


def abs_dlog(series: DataFrame, **chunking: int) -> DataFrame:
    """|ln x - ln previous x| between consecutive non-null values: column ``x``."""
    s = chunked_series(series.filter("y is not null"), ["entity", "target"], "time", halo=1, **chunking)
    step = F.abs(F.log("y") - F.log(F.lag("y").over(_chunk_window())))
    return s.withColumn("x", step).filter("own and x is not null").select("entity", "target", "time", "x")


def robust_z(df: DataFrame, group: Sequence[str], value: str, out: str = "z") -> DataFrame:
    """(value - median) / (1.4826 * (MAD + 1e-9)) within each group."""
    group = list(group)
    med = group_quantiles(df.select(*group, F.col(value).alias("x")), group, {"_med": 0.5}, count="_n")
    dev = df.join(med, group).withColumn("_dev", F.abs(F.col(value) - F.col("_med")))
    mad = group_quantiles(dev.select(*group, F.col("_dev").alias("x")), group, {"_mad": 0.5}, count="_m").drop("_m")
    return dev.join(mad, group).withColumn(out, (F.col(value) - F.col("_med")) / (1.4826 * (F.col("_mad") + 1e-9))).drop("_med", "_mad", "_dev", "_n")


def roughness(df: DataFrame, entity: str, time: str, numerics: Sequence[str], **chunking: int) -> DataFrame:
    """Per series: roughness, level, robust z among its peers, and the peers' upper quartile level."""
    series = long_series(df, entity, time, numerics).filter("y is not null")
    good = series.groupBy("entity", "target").agg(F.count(F.lit(1)).alias("len"), F.min("y").alias("lo")).filter("len >= 8 and lo > 0")
    series = cut(series.join(good.select("entity", "target"), ["entity", "target"]))
    names = [c for c in numerics if c != time]
    rough = group_quantiles(abs_dlog(series, **chunking), ["entity", "target"], {"rough": 0.5}, count="_n").drop("_n")
    edges = {c: value_edges(df.select(as_number(F.col(c).cast("double")).alias(c)), [c])[c] or [0.0] for c in names}
    level = group_quantiles(series, ["entity", "target"], {"level": 0.5}, x="y", edges=edges, edges_key="target", count="_m").drop("_m")
    peers = cut(rough.join(level, ["entity", "target"]))
    hi = group_quantiles(peers.select("target", F.col("level").alias("x")), ["target"], {"hi_level": 0.75}, count="n_peers")
    return robust_z(peers, ["target"], "rough").join(hi, "target")


def detect_rough_series(df: DataFrame, entity: str, time: str, numerics: Sequence[str], **chunking: int) -> DataFrame:
    """Series far rougher than their peers at a high level (REVIEW only)."""
    r = roughness(df, entity, time, numerics, **chunking)
    hit = r.filter((F.col("n_peers") >= MIN_PEERS) & (F.col("z") > 4) & (F.col("level") >= F.col("hi_level")))
    return to_findings(
        hit, kind="rough_series", slicer=entity, level=F.col("entity"), target=F.col("target"), n=0, confidence="REVIEW",
        stats={"z": F.col("z")}, repair={"type": "flag_entity", "entity_col": entity, "entity": F.col("entity")},
    )


def entity_rankings(df: DataFrame, entity: str, numerics: Sequence[str], k: int = 12) -> DataFrame:
    """The k entities with the largest median of each column."""
    names = list(numerics)
    wide = df.select(F.col(entity).cast("string").alias("entity"), *[as_number(F.col(c).cast("double")).alias(c) for c in names])
    edges = {c: (e or [0.0]) for c, e in value_edges(wide, names).items()}
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("x")) for c in names])
    long = wide.filter("entity is not null").select("entity", F.explode(cells).alias("e")).select("entity", "e.*")
    med = group_quantiles(long, ["entity", "column"], {"median": 0.5}, edges=edges, edges_key="column")
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("median"), "entity"))
    return med.withColumn("rank", rank).filter(F.col("rank") <= k).select("column", "entity", "median", "rank")
