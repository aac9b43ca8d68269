"""Numeric slice audit: does one simple mechanism explain why a slice differs?

Stages, each one pass over the table or less:

1. counts, moments and medians of every (slicer, level, stratum, target) cell,
   from which the complements ("all other levels") are put together;
2. cheap detection on those small tables; only the candidates go on;
3. value histograms of the candidates, on which the offset is refined by a
   two-step grid of exact Kolmogorov-Smirnov distances;
4. cross-fitted residuals over all rows, split by row hash, and a permutation noise
   floor drawn on the reference's value counts, that decide acceptance.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabaudit.functions.ks import grid_buckets, grid_cells, ks_counts, ks_floor, ks_grid
from tabaudit.functions.lineage import cut, few
from tabaudit.functions.order_stats import bucket_by, complement_quantiles, fine_for, group_quantiles, made_once, value_edges
from tabaudit.functions.permutation import permutation_distances
from tabaudit.functions.predicates import as_number, is_whole
from tabaudit.functions.rng import key_text, uniform
from tabaudit.operators import findings as FD
from tabaudit.operators.cube import ROWS

MIN_N = 80
MIN_STRATUM = 20
MIN_STRATA = 4
PAIRWISE_LEVELS = 6
REST = "*"  # the stratum that stands for all rows of a level
NO_STRATUM = "\u0000"
CELL = ["cid", "slicer", "level", "ref", "target"]
DIRECT_ROWS = 5_000
COUNTED_SHARE = 1 / 20  # distinct rows are counted where they are at most this share of all rows
FEW_LEVELS = 1_000


@dataclass(frozen=True)
class SliceOptions:
    """Options of the acceptance test, which is decided on all rows.

    ``fold_cap`` and ``ref_cap`` bound the rows of a fold and of the reference;
    with them the test is an approximation. ``whole_steps``: of a target of whole numbers,
    so many whole offsets on each side of the rounded one are tried too. The points of the
    grid rarely are whole, and next to the right offset all distances are alike.
    """

    acceptance: str = "crossfit"  # or "asymptotic", the earlier rule
    fold_cap: int | None = None
    ref_cap: int | None = None
    draws: int = 200
    direct_rows: int = DIRECT_ROWS  # histograms up to this size skip the bounding step
    salt: str = ""
    whole_steps: int = 0


def _weight(df: DataFrame) -> Column:
    return (F.col(ROWS) if ROWS in df.columns else F.lit(1)).cast("long")


def counted(df: DataFrame, slicers: Sequence[str], numerics: Sequence[str], strata: Mapping[str, str | None]) -> DataFrame:
    """The distinct rows of what the audit reads, with their number in ``ROWS``, written; the table itself where they are not far fewer."""
    names = list(dict.fromkeys(c for c in [*slicers, *numerics, *[strata.get(s) for s in slicers]] if c))
    if not slicers or not numerics or ROWS in df.columns:
        return df
    row = df.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.xxhash64(*[F.col(f"`{c}`") for c in names])).alias("d")).first()
    if row["d"] > row["n"] * COUNTED_SHARE:
        return df
    return cut(df.groupBy(*[F.col(f"`{c}`") for c in names]).agg(F.count(F.lit(1)).alias(ROWS)))


def _places_and_cells(slicers: Sequence[str], targets: Sequence[str], strata: Mapping[str, str | None]) -> tuple[Column, Column]:
    places = F.array(*[
        F.struct(F.lit(s).alias("slicer"), F.col(s).cast("string").alias("level"),
                 (F.coalesce(F.col(strata[s]).cast("string"), F.lit(NO_STRATUM)) if strata.get(s) else F.lit(NO_STRATUM)).alias("stratum"))
        for s in slicers
    ])
    cells = F.array(*[F.struct(F.lit(t).alias("target"), as_number(F.col(t).cast("double")).alias("x")) for t in targets])
    return places, cells


def folded_rows(df: DataFrame, slicers: Sequence[str], targets: Sequence[str], strata: Mapping[str, str | None], keep: Sequence[Column] = ()) -> DataFrame:
    """(p, target, x): one row per numeric target, with all its places."""
    places, cells = _places_and_cells(slicers, targets, strata)
    one = df.select(places.alias("p"), F.explode(cells).alias("c"), *keep)
    return one.select("p", "c.target", "c.x", *one.columns[2:])


def unfolded(rows: DataFrame) -> DataFrame:
    """Rows of ``folded_rows`` once for each of their levels, as a whole and within the stratum (``g_stratum``)."""
    names = [c for c in rows.columns if c != "p"]
    flat = rows.select(F.explode("p").alias("p"), *names).select("p.*", *names).filter("level is not null")
    return flat.withColumn("g_stratum", F.explode(F.array(F.lit(REST), F.col("stratum")))).filter(F.col("g_stratum") != NO_STRATUM)


def long_rows(df: DataFrame, slicers: Sequence[str], targets: Sequence[str], strata: Mapping[str, str | None], keep: Sequence[Column] = ()) -> DataFrame:
    """(slicer, level, stratum, target, x): one row per slicer and numeric target."""
    places, cells = _places_and_cells(slicers, targets, strata)
    one = df.select(places.alias("p"), cells.alias("c"), *keep)
    names = one.columns[2:]
    two = one.select(F.explode("p").alias("p"), "c", *names).filter("p.level is not null")
    return two.select("p.slicer", "p.level", "p.stratum", F.explode("c").alias("c"), *names).select("slicer", "level", "stratum", "c.target", "c.x", *names)


def audit_levels(df: DataFrame, slicers: Sequence[str]) -> DataFrame:
    """Levels with enough rows, for slicers that have at least two such levels."""
    places = F.array(*[F.struct(F.lit(s).alias("slicer"), F.col(s).cast("string").alias("level")) for s in slicers])
    n = df.select(F.explode(places).alias("p"), _weight(df).alias("w")).select("p.*", "w").filter("level is not null").groupBy("slicer", "level").agg(F.sum("w").alias("n_rows"))
    per = F.count(F.lit(1)).over(Window.partitionBy("slicer"))
    return n.filter(F.col("n_rows") >= MIN_N).withColumn("n_levels", per).filter(F.col("n_levels") >= 2)


def audit_cells(levels: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Every comparison: level against each other level (few levels) or against the rest."""
    few = F.col("n_levels") <= PAIRWISE_LEVELS
    other = levels.select("slicer", F.col("level").alias("ref"))
    pairs = levels.filter(few).join(other, "slicer").filter("level <> ref").select("slicer", "level", "ref")
    rest = levels.filter(~few).select("slicer", "level", F.lit(None).cast("string").alias("ref"))
    cells = pairs.unionByName(rest).withColumn("target", F.explode(F.array(*[F.lit(t) for t in targets])))
    cid = F.concat_ws("|", "slicer", "level", "target", F.coalesce("ref", F.lit("None")))
    return cells.select(cid.alias("cid"), "slicer", "level", "ref", "target")


def reference_members(cells: DataFrame, sizes: DataFrame) -> DataFrame:
    """(cid, slicer, level, target): the base groups that make up each reference."""
    base = sizes.select("slicer", "target", F.col("level").alias("b_level")).distinct()
    hit = (F.col("ref") == F.col("b_level")) | (F.col("ref").isNull() & (F.col("level") != F.col("b_level")))
    return cells.join(base, ["slicer", "target"]).filter(hit).select("cid", "slicer", F.col("b_level").alias("level"), "target")


def _moments(rows: DataFrame) -> DataFrame:
    """n, mean and centred sum of squares per (slicer, level, stratum, target)."""
    keys = ["slicer", "level", "stratum", "target"]
    if ROWS in rows.columns:
        have, w = rows.filter("x is not null"), F.col(ROWS)
        mean = cut(have.groupBy(*keys).agg(F.sum(w).alias("n"), (F.sum(w * F.col("x")) / F.sum(w)).alias("mean")))
        gap = F.col("x") - F.col("mean")
        return have.join(few(mean), keys).groupBy(*keys, "n", "mean").agg(F.sum(w * gap * gap).alias("m2"))
    return rows.filter("x is not null").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), (F.var_pop("x") * F.count(F.lit(1))).alias("m2"))


def _pool(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Moments of a union of groups, from the moments of its parts."""
    w = Window.partitionBy(*keys)
    mean = F.sum(F.col("n") * F.col("mean")).over(w) / F.sum("n").over(w)
    p = parts.withColumn("_mean", mean)
    return p.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.first("_mean").alias("mean"),
        F.sum(F.col("m2") + F.col("n") * (F.col("mean") - F.col("_mean")) * (F.col("mean") - F.col("_mean"))).alias("m2"))


def _reference_moments(cells: DataFrame, own: DataFrame) -> DataFrame:
    """Moments (cid, n, m2) of each comparison's reference, from those of the levels.

    All other levels are what comes before and what comes after a level, summed about a
    centre that a single level cannot move far, so nothing is subtracted but a mean.
    """
    named = cells.filter("ref is not null").join(own.withColumnRenamed("level", "ref"), ["slicer", "ref", "target"]).select("cid", "n", "m2")
    centre = own.groupBy("slicer", "target").agg(F.percentile("mean", F.lit(0.5)).alias("_c"))
    gap = F.col("mean") - F.col("_c")
    sums = own.join(centre, ["slicer", "target"]).select("slicer", "target", "level", "n", (F.col("n") * gap).alias("s1"), (F.col("m2") + F.col("n") * gap * gap).alias("s2"))
    w = Window.partitionBy("slicer", "target").rowsBetween(Window.unboundedPreceding, -1)

    def others(c: str) -> Column:
        return F.coalesce(F.sum(c).over(w.orderBy("level")), F.lit(0)) + F.coalesce(F.sum(c).over(w.orderBy(F.col("level").desc())), F.lit(0))

    rest = sums.select("slicer", "target", "level", others("n").alias("n"), others("s1").alias("s1"), others("s2").alias("s2")).filter("n > 0")
    rest = rest.select("slicer", "target", "level", "n", F.greatest(F.col("s2") - F.col("s1") * F.col("s1") / F.col("n"), F.lit(0.0)).alias("m2"))
    return named.unionByName(cells.filter("ref is null").join(rest, ["slicer", "target", "level"]).select("cid", "n", "m2"))


def cell_table(df: DataFrame, slicers: Sequence[str], targets: Sequence[str], strata: Mapping[str, str | None],
               edges: Mapping[str, Sequence[float]]) -> DataFrame:
    """Per comparison: sizes, spreads and medians of both sides, and the consistent offset across strata."""
    levels = cut(audit_levels(df, slicers))
    cells = audit_cells(levels, targets)
    weight = ROWS if ROWS in df.columns else None
    rows = long_rows(df, slicers, targets, strata, [F.col(ROWS)] if weight else [])
    mom = cut(_moments(rows))
    own = _pool(mom, ["slicer", "level", "target"])
    a = own.select("slicer", "level", "target", F.col("n").alias("n_a"), F.sqrt(F.col("m2") / (F.col("n") - 1)).alias("std_a"))
    b = _reference_moments(cells, own).select("cid", F.col("n").alias("n_b"), F.sqrt(F.col("m2") / (F.col("n") - 1)).alias("std_b"))

    # medians of each level, and for large slicers of all other levels; both overall and per stratum
    folded = folded_rows(df, slicers, targets, strata, [F.col(ROWS)] if weight else [])
    wanted = few(levels.select("slicer", "level"))
    med = group_quantiles(folded, ["slicer", "level", "g_stratum", "target"], {"median": 0.5}, weight=weight, edges=edges, edges_key="target", count="size",
                          unfold=lambda r: unfolded(r).join(wanted, ["slicer", "level"], "left_semi"))
    med = med.select(F.lit("own").alias("side"), "slicer", F.col("level").alias("g_level"), "g_stratum", "target", "median", "size")
    many = levels.filter(F.col("n_levels") > PAIRWISE_LEVELS).select("slicer", "level")
    if many.take(1):
        large = few(cut(many.select("slicer").distinct()))
        rest = complement_quantiles(folded, ["slicer", "g_stratum", "target"], ["level"], {"median": 0.5}, weight=weight, wanted=many.select("level").distinct(), edges=edges, edges_key="target", count="size",
                                    unfold=lambda r: unfolded(r).join(large, "slicer", "left_semi"))
        med = med.unionByName(rest.select(F.lit("rest").alias("side"), "slicer", F.col("level").alias("g_level"), "g_stratum", "target", "median", "size"))
    med = cut(med)

    place = ["slicer", "target"]
    left = med.filter("side = 'own'").select(*place, F.col("g_level").alias("level"), F.col("g_stratum").alias("k"),
                                              F.col("median").alias("med_a"), F.col("size").alias("size_a"))
    right = med.select(*place, F.when(F.col("side") == "own", F.concat(F.lit("="), "g_level")).otherwise(F.concat(F.lit("!"), "g_level")).alias("rk"),
                       F.col("g_stratum").alias("k"), F.col("median").alias("med_b"), F.col("size").alias("size_b"))
    rk = F.when(F.col("ref").isNull(), F.concat(F.lit("!"), "level")).otherwise(F.concat(F.lit("="), "ref"))
    pairs = cells.withColumn("rk", rk).join(left, [*place, "level"]).join(right, [*place, "rk", "k"])
    overall = pairs.filter(F.col("k") == REST).select("cid", "med_a", "med_b")
    offs = pairs.filter((F.col("k") != REST) & (F.col("size_a") >= MIN_STRATUM) & (F.col("size_b") >= MIN_STRATUM)).select(
        "cid", (F.col("med_a") - F.col("med_b")).alias("d"), F.when(F.col("med_b") != 0, F.col("med_a") / F.col("med_b")).alias("r"))
    # at most 15 strata per comparison
    offs = offs.groupBy("cid").agg(
        F.count(F.lit(1)).alias("strata"), F.percentile("d", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"),
        F.greatest(F.avg((F.col("d") > 0).cast("double")), F.avg((F.col("d") < 0).cast("double"))).alias("s_sign"), F.percentile("r", F.lit(0.5)).alias("s_ratio"))
    t = cells.join(a, ["slicer", "level", "target"]).join(b, "cid").join(overall, "cid").join(offs, "cid", "left")
    t = t.filter((F.col("n_a") >= MIN_N) & (F.col("n_b") >= MIN_N))
    scale = F.greatest(F.col("std_b"), F.lit(1e-9))
    strat = F.coalesce(F.col("strata") >= MIN_STRATA, F.lit(False))
    diff = F.col("med_a") - F.col("med_b")
    t = t.withColumn("scale", scale).withColumn("stratified", strat).withColumn("strata", F.coalesce("strata", F.lit(0)).cast("int"))
    return t.select(
        *CELL, "n_a", "n_b", "std_a", "std_b", "med_a", "med_b", "scale", "stratified", "strata",
        F.when(strat, F.col("q")[1]).otherwise(diff).alias("delta0"),
        F.when(strat, F.col("q")[2] - F.col("q")[0]).alias("iqr"),
        F.when(strat, F.col("s_sign")).otherwise(F.lit(1.0)).alias("sign"),
        F.when(strat, F.col("s_ratio")).otherwise(F.when(F.col("med_b") != 0, F.col("med_a") / F.col("med_b"))).alias("ratio"),
        ks_floor(F.col("n_a"), F.col("n_b")).alias("floor"),
    )


def is_collapse() -> Column:
    """The slice is nearly constant and far from the reference median."""
    return (F.col("std_a") < 0.05 * F.col("scale")) & (F.abs(F.col("med_a") - F.col("med_b")) > 0.5 * F.col("scale"))


def may_be_offset() -> Column:
    """Large enough offset; the unstratified cells still need the distance test."""
    far = F.abs("delta0") > 0.10 * F.col("scale")
    return ~is_collapse() & far & (~F.col("stratified") | (F.col("sign") >= 0.85))


def collapse_findings(cells: DataFrame) -> DataFrame:
    return FD.to_findings(
        cells.filter(is_collapse()), kind="collapse", slicer=F.col("slicer"), level=F.col("level"), ref=F.col("ref"), target=F.col("target"),
        n=F.col("n_a"), confidence="REPAIR", stats={"delta": F.col("med_a") - F.col("med_b")}, repair={"type": "impute_from_reference"},
    )


def _grid(problems: DataFrame, center: str, step: str, first: Sequence[Column]) -> DataFrame:
    """Evaluation points of one refinement pass: the given points, then 21 around the centre, ascending."""
    lo, hi = F.col(center) - 10 * F.col(step), F.col(center) + 10 * F.col(step)
    width = (hi - lo) / 20
    n = len(first)
    points = [F.struct(F.lit(i).alias("g"), d.alias("d")) for i, d in enumerate(first)]
    points += [F.struct(F.lit(n + j).alias("g"), (hi if j == 20 else F.lit(float(j)) * width + lo).alias("d")) for j in range(21)]
    return problems.withColumn("p", F.explode(F.array(*points))).select(
        "cid", "part", F.col("p.g").alias("g"), F.col("p.d").alias("d"), F.lit(1.0).alias("r"), (F.col("p.d") == 0).alias("exact"))


class Refiner:
    """Distances of the candidates' samples (whole slice, or a fold) against their full references."""

    def __init__(self, hist: DataFrame, members: DataFrame, samples: DataFrame, edges: Mapping[str, Sequence[float]], n_values: int, opt: SliceOptions) -> None:
        self.hist, self.members, self.samples, self.edges = hist, members, samples, edges
        self.direct, self.fine, self.steps = n_values <= opt.direct_rows, fine_for(n_values), opt.whole_steps
        self.counts: dict[str, DataFrame] = {}

    def distances(self, grid: DataFrame, prune: bool = False) -> DataFrame:
        if not self.direct and not self.counts:  # all grids are bounded by the same cells
            self.counts = {"cells": cut(grid_cells(self.samples, ["cid", "part"], "target", self.edges, self.fine)),
                           "buckets": cut(grid_buckets(self.hist, ["slicer", "level", "target"], "target", self.edges, self.fine))}
        members = grid.select("cid", "part").distinct().join(self.members, "cid")
        return ks_grid(self.samples, self.hist, members, grid, problem=["cid", "part"], base=["slicer", "level", "target"],
                       edges=self.edges, edges_key="target", direct=self.direct, fine=self.fine, prune=prune, **self.counts)

    def refine(self, problems: DataFrame, any_whole: bool = True) -> DataFrame:
        """argmin over d of the distance, coarse then fine; problems: cid, part, d0, scale, whole.

        Returns the problems with ``ks0`` (no move), ``delta`` (snapped to whole
        numbers where that costs at most 0.005) and ``ks_fit``.
        """
        span = F.greatest(0.15 * F.col("scale"), F.abs("d0") * 0.5, F.lit(1e-9))
        p = problems.withColumn("s1", span / 10).withColumn("s2", span / 100)
        first = cut(self.distances(_grid(p, "d0", "s1", [F.col("d0"), F.lit(0.0)]), prune=True))
        zero = first.filter("g = 1").select("cid", "part", F.col("ks").alias("ks0"))
        best = first.filter("g <> 1").groupBy("cid", "part").agg(F.min_by("d", F.struct("ks", "g")).alias("d1"))
        p = p.join(best, ["cid", "part"]).join(zero, ["cid", "part"])
        second = self.distances(_grid(p, "d1", "s2", [F.col("d1")]), prune=True)
        best = second.groupBy("cid", "part").agg(F.min_by(F.struct("d", "ks"), F.struct("ks", "g")).alias("b"))
        p = cut(p.join(best, ["cid", "part"]).withColumn("d2", F.col("b.d")).withColumn("ks2", F.col("b.ks")).drop("b"))
        if not any_whole:
            return p.select(*problems.columns, "ks0", F.col("d2").alias("delta"), F.col("ks2").alias("ks_fit"))
        near = sorted(range(-self.steps, self.steps + 1), key=abs)  # of equal distances, the offset next to the refined one
        points = F.explode(F.array(*[F.struct(F.lit(g).alias("g"), (F.rint("d2") + F.lit(float(j))).alias("d")) for g, j in enumerate(near)]))
        snap = p.filter("whole").select("cid", "part", points.alias("p")).select("cid", "part", "p.g", "p.d", F.lit(1.0).alias("r"), F.lit(True).alias("exact"))
        snapped = self.distances(snap).groupBy("cid", "part").agg(F.min_by(F.struct("d", "ks"), F.struct("ks", "g")).alias("b")).select(
            "cid", "part", F.col("b.d").alias("di"), F.col("b.ks").alias("ks_i"))
        p = p.join(snapped, ["cid", "part"], "left")
        use = F.coalesce(F.col("ks_i") <= F.col("ks2") + 0.005, F.lit(False))
        return p.withColumn("delta", F.when(use, F.col("di")).otherwise(F.col("d2"))).withColumn(
            "ks_fit", F.when(use, F.col("ks_i")).otherwise(F.col("ks2"))).drop("s1", "s2", "d1", "d2", "ks2", "di", "ks_i")


def _value_rows(df: DataFrame, pairs: Mapping[str, Sequence[str]], row_id: Sequence[str], levels: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Rows of the pairs, with their key; those of other than the given ``levels`` may be left out before it is made."""
    rows = None
    for s, targets in pairs.items():
        those = df if levels is None else df.filter(F.col(s).cast("string").isin(list(levels[s])))
        part = long_rows(those, [s], targets, {}, [key_text(row_id).alias("key")]).filter("x is not null").drop("stratum")
        rows = part if rows is None else rows.unionByName(part)
    return rows


def _smallest(rows: DataFrame) -> DataFrame:
    """The ``cap`` rows with the smallest ``v`` of each (cid, part); only the buckets of v up to that rank are shuffled."""
    rows = rows.withColumn("_b", F.floor(F.col("v") * 4096))
    counts = rows.groupBy("cid", "part", "cap", "_b").agg(F.count(F.lit(1)).alias("_c"))
    before = F.sum("_c").over(Window.partitionBy("cid", "part").orderBy("_b")) - F.col("_c")
    edge = cut(counts.withColumn("_lo", before).filter(F.col("_lo") < F.col("cap")).groupBy("cid", "part").agg(F.max("_b").alias("_edge")))
    near = rows.join(edge, ["cid", "part"]).filter(F.col("_b") <= F.col("_edge"))
    rank = F.row_number().over(Window.partitionBy("cid", "part").orderBy("v", "key"))
    return near.withColumn("_rank", rank).filter(F.col("_rank") <= F.col("cap"))


def fold_rows(df: DataFrame, cand: DataFrame, pairs: Mapping[str, Sequence[str]], row_id: Sequence[str], opt: SliceOptions) -> DataFrame:
    """Two folds (A, B) of each candidate slice: (cid, part, target, key, x). All its rows, unless ``fold_cap`` is given."""
    c = few(cand.select("cid", "slicer", "level", "target", "n_a"))
    places = cand.select("slicer", "level").distinct().limit(FEW_LEVELS + 1).collect()
    levels = {s: [r["level"] for r in places if r["slicer"] == s] for s in pairs} if len(places) <= FEW_LEVELS else None
    own = made_once(_value_rows(df, pairs, row_id, levels).join(c, ["slicer", "level", "target"]), "u", uniform(F.col("key"), F.concat(F.col("cid"), F.lit(opt.salt))))
    own = own.withColumn("part", F.when(F.col("u") < 0.5, "A").otherwise("B"))
    if opt.fold_cap is not None:
        own = own.withColumn("v", F.when(F.col("u") < 0.5, F.col("u")).otherwise(F.col("u") - 0.5))
        own = _smallest(own.withColumn("cap", F.least(F.floor(F.col("n_a") / 2), F.lit(opt.fold_cap))))
    return own.select("cid", "part", "target", "key", "x")


def reference_rows(df: DataFrame, cand: DataFrame, pairs: Mapping[str, Sequence[str]], members: DataFrame, row_id: Sequence[str], opt: SliceOptions) -> DataFrame:
    """Reference of each candidate: (cid, target, key, x). All its rows, unless ``ref_cap`` is given."""
    ref = _value_rows(df, pairs, row_id).join(members, ["slicer", "level", "target"]).join(cand.select("cid", "n_b"), "cid")
    if opt.ref_cap is not None:
        ref = ref.withColumn("v", uniform(F.col("key"), F.concat("cid", F.lit(opt.salt), F.lit("|ref")))).withColumn("part", F.lit("R"))
        ref = _smallest(ref.withColumn("cap", F.least(F.col("n_b"), F.lit(opt.ref_cap))))
    return ref.select("cid", "target", "key", "x")


def _split_size(opt: SliceOptions) -> Column:
    """Rows in each of the two parts of a permutation draw: those of a fold, at most half the reference."""
    fold, ref = F.floor(F.col("n_a") / 2), F.col("n_b")
    fold = fold if opt.fold_cap is None else F.least(fold, F.lit(opt.fold_cap))
    ref = ref if opt.ref_cap is None else F.least(ref, F.lit(opt.ref_cap))
    return F.least(fold, F.floor(ref / 2))


def _tau(c: DataFrame, d: DataFrame) -> DataFrame:
    tau = d.groupBy("cid").agg(F.percentile("ks", F.lit(0.95)).alias("tau"))
    return c.join(tau, "cid", "left").select("cid", F.coalesce("tau", F.lit(0.05)).alias("tau"))


def sampled_permutation_floor(reference: DataFrame, cand: DataFrame, opt: SliceOptions) -> DataFrame:
    """95th percentile of the distance between two random disjoint parts of a bounded reference: (cid, tau).

    At most ``draws`` x ``ref_cap`` rows per candidate, in parallel by (cid, draw).
    """
    c = cand.select("cid", _split_size(opt).alias("m"))
    drawn = reference.join(c.filter("m >= 10"), "cid").select("cid", "m", "x", "key", F.explode(F.sequence(F.lit(0), F.lit(opt.draws - 1))).alias("draw"))
    # one explicit exchange: hashing, ranking and counting all run on the (cid, draw) partitions
    tasks = int(reference.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    drawn = drawn.repartition(tasks, "cid", "draw")
    h = uniform(F.col("key"), F.concat("cid", F.lit(opt.salt), F.lit("|"), F.col("draw").cast("string")))
    ranked = drawn.select("cid", "draw", "m", "x", h.alias("h"), "key").withColumn(
        "_rank", F.row_number().over(Window.partitionBy("cid", "draw").orderBy("h", "key")))
    in_a = (F.col("_rank") <= F.col("m")).cast("long")
    in_b = ((F.col("_rank") > F.col("m")) & (F.col("_rank") <= 2 * F.col("m"))).cast("long")
    return _tau(c, ks_counts(ranked.filter(F.col("_rank") <= 2 * F.col("m")), ["cid", "draw"], "x", in_a, in_b))


def permutation_floor(hist: DataFrame, members: DataFrame, cand: DataFrame, edges: Mapping[str, Sequence[float]], fine: int, opt: SliceOptions) -> DataFrame:
    """95th percentile of the distance between two random disjoint parts of the whole reference: (cid, tau).

    The parts are drawn on the counts of the reference's values (see ``functions.permutation``), no row is copied.
    """
    c = cut(cand.select("cid", _split_size(opt).alias("m")))
    reference = hist.join(few(cut(members.join(c.select("cid"), "cid", "left_semi"))), ["slicer", "level", "target"])
    d = permutation_distances(reference, c.filter("m >= 10"), bucket_by(F.col("x"), F.col("target"), edges, fine), opt.draws, opt.salt)
    return _tau(c, d)


def crossfit_residual(folds: DataFrame, fits: DataFrame, reference: DataFrame, members: DataFrame, base: Sequence[str],
                      edges: Mapping[str, Sequence[float]], direct: bool, fine: int) -> DataFrame:
    """Worst residual distance over both directions: (cid, ks_add, ks_mul).

    ``fits`` (cid, part, delta, r) holds the moves fitted on each fold; they are
    applied to the other fold (cid, part, target, x, n) and compared with the
    reference, the histogram (base.., target, x, n) of ``members`` (cid, base..).
    """
    fits = fits.select("cid", "part", "delta", F.when(F.col("r") > 0, F.col("r")).alias("r"))
    other = folds.withColumn("part", F.when(F.col("part") == "A", "B").otherwise("A"))
    one, yes = F.lit(1.0), F.lit(True).alias("exact")
    grid = fits.select("cid", "part", F.lit(0).alias("g"), F.col("delta").alias("d"), one.alias("r"), yes).unionByName(
        fits.filter("r is not null").select("cid", "part", F.lit(1).alias("g"), F.lit(0.0).alias("d"), "r", yes))
    grid = cut(grid)
    d = ks_grid(other, reference, grid.select("cid", "part").distinct().join(members, "cid"), grid, problem=["cid", "part"], base=base,
                edges=edges, edges_key="target", direct=direct, fine=fine).select("cid", "part", "g", "ks")
    d = fits.withColumn("g", F.explode(F.array(F.lit(0), F.lit(1)))).join(d, ["cid", "part", "g"], "left")
    value = F.when((F.col("g") == 1) & F.col("r").isNull(), one).otherwise(F.coalesce("ks", F.lit(0.0)))
    return d.groupBy("cid").agg(F.max(F.when(F.col("g") == 0, value)).alias("ks_add"), F.max(F.when(F.col("g") == 1, value)).alias("ks_mul"))


def value_counts(df: DataFrame, pairs: Mapping[str, Sequence[str]]) -> DataFrame:
    """Histogram (slicer, level, target, x, n) of the targets of each slicer, written."""
    base = None
    for s, targets in pairs.items():
        part = long_rows(df, [s], targets, {}, [_weight(df).alias("w")]).filter("x is not null").groupBy("slicer", "level", "target", "x").agg(F.sum("w").alias("n"))
        base = part if base is None else base.unionByName(part)
    return cut(base, spread="x")


def evaluate_candidates(df: DataFrame, cand: DataFrame, sizes_members: DataFrame, edges: Mapping[str, Sequence[float]], whole: Mapping[str, bool],
                        row_id: Sequence[str], opt: SliceOptions, counts: DataFrame | None = None) -> DataFrame:
    """Candidates with ks0, delta, ks_add, ks_mul and tau; undetected ones removed.

    ``counts``: the table as ``counted`` gives it; only the folds read the table itself.
    """
    pairs: dict[str, list[str]] = {}
    for r in sorted(cand.select("slicer", "target").distinct().collect()):  # at most slicers x targets
        pairs.setdefault(r["slicer"], []).append(r["target"])
    hist = value_counts(df if counts is None else counts, pairs)
    n_values = hist.count()
    members = cut(sizes_members)
    full = hist.join(few(cut(cand.select("cid", "slicer", "level", "target"))), ["slicer", "level", "target"]).select(
        "cid", F.lit("full").alias("part"), "target", "x", "n")
    is_int = F.col("target").isin([t for t, w in whole.items() if w])
    problems = cand.select("cid", F.lit("full").alias("part"), F.col("delta0").alias("d0"), "scale", is_int.alias("whole"))
    aset = full
    crossfit = opt.acceptance == "crossfit"
    if crossfit:
        folds = cut(fold_rows(df, cand, pairs, row_id, opt).groupBy("cid", "part", "target", "x").agg(F.count(F.lit(1)).alias("n")), spread="x")
        aset = full.unionByName(folds)
        med = group_quantiles(folds, ["cid", "part", "target"], {"med_f": 0.5}, weight="n", edges=edges, edges_key="target").drop("n", "target")
        med = med.join(cand.select("cid", "med_b", "scale", "target"), "cid")
        med = cut(med.select("cid", "part", (F.col("med_f") - F.col("med_b")).alias("d0"), "scale", is_int.alias("whole"),
                             F.when(F.col("med_b") != 0, F.col("med_f") / F.col("med_b")).alias("r")))
        problems = problems.unionByName(med.drop("r"))
    aset = cut(aset, spread="x")
    fit = cut(Refiner(hist, members, aset, edges, n_values, opt).refine(problems, any(whole[t] for ts in pairs.values() for t in ts)))
    main = fit.filter("part = 'full'").select("cid", "ks0", "delta", "ks_fit")
    t = cand.join(main, "cid").filter(F.col("stratified") | (F.col("ks0") >= 2 * F.col("floor")))
    if crossfit:
        moves = fit.filter("part <> 'full'").select("cid", "part", "delta").join(med.select("cid", "part", "r"), ["cid", "part"])
        refs, base_keys, ref_members = hist, ["slicer", "level", "target"], members
        if opt.ref_cap is not None:
            sampled = cut(reference_rows(df, cand, pairs, members, row_id, opt), spread="key")
            refs, base_keys = sampled.groupBy(F.col("cid").alias("of"), "target", "x").agg(F.count(F.lit(1)).alias("n")), ["of"]
            ref_members = cand.select("cid", F.col("cid").alias("of"))
        t = cut(t.join(crossfit_residual(folds, moves, refs, ref_members, base_keys, edges, n_values <= opt.direct_rows, fine_for(n_values)), "cid"))
        # the noise floor is only drawn for the candidates it decides about
        open_ = t.filter(would_accept("ks_add") & is_steady() | would_accept("ks_mul"))
        if opt.ref_cap is not None:
            return t.join(sampled_permutation_floor(sampled, open_, opt), "cid", "left")
        floor = permutation_floor(hist, members, open_, edges, fine_for(n_values), opt)
        return t.join(floor, "cid", "left")
    grid = cand.filter(F.col("ratio") > 0).select("cid", F.lit("full").alias("part"), F.lit(0).alias("g"), F.lit(0.0).alias("d"), F.col("ratio").alias("r"), F.lit(True).alias("exact"))
    mul = Refiner(hist, members, full, edges, n_values, opt).distances(grid).select("cid", F.col("ks").alias("ks_m"))
    return t.join(mul, "cid", "left").select(
        "*", F.col("ks_fit").alias("ks_add"), F.coalesce("ks_m", F.lit(1.0)).alias("ks_mul"), F.lit(None).cast("double").alias("tau")).drop("ks_m")


def would_accept(ks: str) -> Column:
    """Every condition on a residual distance except the permutation floor."""
    k, ks0 = F.col(ks), F.col("ks0")
    return (k <= 0.25 * ks0) & (k < 0.05) & (ks0 > 2 * F.col("floor"))


def is_steady() -> Column:
    """The offset varies little across strata (or there are no strata to compare)."""
    return F.col("iqr").isNull() | (F.col("iqr") < 0.5 * F.abs("delta") + 0.05 * F.col("scale"))


def decide(t: DataFrame, acceptance: str) -> DataFrame:
    """Findings of the evaluated candidates: additive, multiplicative or unexplained."""
    def aligned(ks: str) -> Column:
        k = F.col(ks)
        if acceptance == "asymptotic":
            return (k <= F.greatest(0.25 * F.col("ks0"), 1.5 * F.col("floor"))) & (k < 0.05) & (F.col("ks0") > 2 * F.col("floor"))
        return would_accept(ks) & F.coalesce(k <= F.col("tau"), F.lit(False))

    add = aligned("ks_add") & is_steady()
    mul = ~add & aligned("ks_mul") & F.coalesce(F.abs(F.col("ratio") - 1) > 0.05, F.lit(False))
    other = ~add & ~mul & (F.col("ks0") >= 0.20) & (F.col("sign") >= 0.90) & (F.abs("delta") > 0.25 * F.col("scale"))
    kind = F.when(add, "additive_shift").when(mul, "multiplicative_shift").when(other, "unexplained_shift")
    t = t.withColumn("kind", kind).filter("kind is not null")
    repair = F.when(F.col("kind") == "additive_shift", F.lit("subtract")).otherwise(F.lit("divide"))
    value = F.when(F.col("kind") == "additive_shift", F.col("delta")).otherwise(F.col("ratio"))
    return FD.to_findings(
        t, kind=F.col("kind"), slicer=F.col("slicer"), level=F.col("level"), ref=F.col("ref"), target=F.col("target"), n=F.col("n_a"),
        confidence=F.when(F.col("kind") == "unexplained_shift", "REVIEW").otherwise("REPAIR"),
        stats={c: F.col(c) for c in ("ks0", "ks_add", "ks_mul", "tau", "delta", "ratio", "iqr", "sign", "strata")},
        repair={"type": repair, "value": value}, repair_if=F.col("kind") != "unexplained_shift",
    )


def usable_targets(df: DataFrame, numerics: Sequence[str]) -> dict[str, bool]:
    """Targets with enough values, and whether all their values are whole numbers."""
    if not numerics:
        return {}
    aggs = []
    for i, t in enumerate(numerics):
        x = as_number(F.col(t).cast("double"))
        aggs += [F.sum(F.when(x.isNotNull(), _weight(df))).alias(f"c{i}"), is_whole(x).alias(f"w{i}")]
    row = df.agg(*aggs).first()
    return {t: row[f"w{i}"] for i, t in enumerate(numerics) if (row[f"c{i}"] or 0) >= 2 * MIN_N}


def prepare(df: DataFrame, slicers: Sequence[str], numerics: Sequence[str], strata: Mapping[str, str | None], label: str | None = None):
    """Usable targets, bucket edges and the table of comparisons."""
    targets = usable_targets(df, [t for t in numerics if t not in slicers and t != label])
    if not targets or not slicers:
        return {}, {}, None
    names = list(targets)
    nums = df.select(*[as_number(F.col(t).cast("double")).alias(t) for t in names])
    edges = value_edges(nums, names)
    return targets, edges, cut(cell_table(df, slicers, names, strata, edges))


def candidates_of(cells: DataFrame) -> DataFrame:
    return cells.filter(may_be_offset())


def members_of(df: DataFrame, cells: DataFrame, cand: DataFrame) -> DataFrame:
    """Reference members of the candidates; small levels of the slicer belong to a complement too."""
    slicers = [r["slicer"] for r in cand.select("slicer").distinct().collect()]
    places = F.array(*[F.struct(F.lit(s).alias("slicer"), F.col(s).cast("string").alias("level")) for s in slicers])
    levels = df.select(F.explode(places).alias("p")).select("p.*").filter("level is not null").distinct()
    sizes = levels.join(cand.select("slicer", "target").distinct(), "slicer")
    return reference_members(cand, sizes)


def numeric_raw(df: DataFrame, slicers: Sequence[str], numerics: Sequence[str], *, row_id: Sequence[str], strata: Mapping[str, str | None],
                label: str | None = None, opt: SliceOptions = SliceOptions()) -> DataFrame:
    """All findings before the per-slice dedupe."""
    seen = counted(df, slicers, [t for t in numerics if t not in slicers and t != label], strata)
    whole, edges, cells = prepare(seen, slicers, numerics, strata, label)
    if cells is None:
        return FD.empty(df.sparkSession)
    collapsed = collapse_findings(cells)
    cand = cut(candidates_of(cells))
    if not cand.take(1):
        return cut(collapsed)
    t = evaluate_candidates(df, cand, members_of(seen, cells, cand), edges, whole, row_id, opt, seen)
    return cut(collapsed.unionByName(decide(t, opt.acceptance)))


def numeric_audit(df: DataFrame, slicers: Sequence[str], numerics: Sequence[str], *, row_id: Sequence[str], strata: Mapping[str, str | None],
                  label: str | None = None, opt: SliceOptions = SliceOptions()) -> DataFrame:
    """Collapse, additive, multiplicative and unexplained shifts of numeric columns."""
    return FD.dedupe_findings(numeric_raw(df, slicers, numerics, row_id=row_id, strata=strata, label=label, opt=opt))
