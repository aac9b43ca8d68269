"""Two-sample Kolmogorov-Smirnov distances over value histograms.

A *problem* compares sample A with sample B; a *grid* asks for the distance after
A was moved by ``(x - d) / r`` for several (d, r). Distances are exact. Large
problems are first bounded per value bucket: inside a bucket both distribution
functions only rise, so the distance there cannot exceed what the bucket's ends
allow. For the bounds cells of values are moved, not values. Only the buckets that
could still hold the maximum are looked at value by value, which is a small part of the rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabaudit.functions.lineage import cut, few
from tabaudit.functions.order_stats import FINE, bucket_by, bucket_of, cumulative, value_edges, made_once, with_total

MIN_SIDE = 6  # a side with fewer values gives distance 0
BOUND_TOL = 1e-9  # bounds are compared with room for rounding
CELLS_FINE = 256  # cuts per coarse bucket for the first bounds of a grid: a fixed number of cells, whatever the rows


def ks_floor(na: Column, nb: Column) -> Column:
    """The 5% critical distance of two samples of these sizes."""
    return F.lit(1.36) * F.sqrt((na + nb) / (na.cast("double") * nb))


def ks_counts(rows: DataFrame, keys: Sequence[str], x: str, a: Column, z: Column) -> DataFrame:
    """Distance per key where ``a`` and ``z`` count a row into the two samples; for bounded groups."""
    keys = list(keys)
    steps = rows.groupBy(*keys, F.col(x).alias("_x")).agg(F.sum(a).alias("_a"), F.sum(z).alias("_z"))
    run = Window.partitionBy(*keys).orderBy("_x")
    steps = steps.select(*keys, F.sum("_a").over(run).alias("_ca"), F.sum("_z").over(run).alias("_cz"),
                         F.sum("_a").over(Window.partitionBy(*keys)).alias("_na"),
                         F.sum("_z").over(Window.partitionBy(*keys)).alias("_nz"))
    gap = F.abs(F.col("_ca") / F.col("_na") - F.col("_cz") / F.col("_nz"))
    small = (F.col("_na") < MIN_SIDE) | (F.col("_nz") < MIN_SIDE)
    return steps.groupBy(*keys).agg(F.max(F.when(small, F.lit(0.0)).otherwise(gap)).alias("ks"))


def ks_direct(a: DataFrame, b: DataFrame, keys: Sequence[str], x: str = "x", n: str = "n") -> DataFrame:
    """Distance per key from two histograms (keys, x, n); for bounded groups."""
    keys = list(keys)
    zero = F.lit(0).cast("long")
    both = a.select(*keys, F.col(x).alias("_v"), F.col(n).alias("_wa"), zero.alias("_wz")).unionByName(
        b.select(*keys, F.col(x).alias("_v"), zero.alias("_wa"), F.col(n).alias("_wz"))
    )
    return ks_counts(both, keys, "_v", F.col("_wa"), F.col("_wz"))


def ks_split(rows: DataFrame, keys: Sequence[str], x: str, bucket: Column, a: Column, z: Column) -> DataFrame:
    """``ks_counts`` for groups of any size: distances are bounded per value bucket, and only buckets that can hold the maximum are read by value."""
    keys = list(keys)
    rows = rows.select(*keys, bucket.alias("_b"), F.col(x).alias("_x"), a.alias("_a"), z.alias("_z"))
    w = Window.partitionBy(*keys)
    run = w.orderBy("_b")
    counts = rows.groupBy(*keys, "_b").agg(F.sum("_a").alias("_a"), F.sum("_z").alias("_z")).select(
        *keys, "_b", "_a", "_z", F.sum("_a").over(run).alias("_ca"), F.sum("_z").over(run).alias("_cz"), F.sum("_a").over(w).alias("_na"), F.sum("_z").over(w).alias("_nz"))
    fa, fz = F.col("_ca") / F.col("_na"), F.col("_cz") / F.col("_nz")
    fa0, fz0 = (F.col("_ca") - F.col("_a")) / F.col("_na"), (F.col("_cz") - F.col("_z")) / F.col("_nz")
    small = (F.col("_na") < MIN_SIDE) | (F.col("_nz") < MIN_SIDE)
    counts = counts.withColumn("_at", F.when(small, F.lit(0.0)).otherwise(F.abs(fa - fz))).withColumn("_cap", F.when(small, F.lit(0.0)).otherwise(F.greatest(fa - fz0, fz - fa0)))
    counts = cut(counts.withColumn("_known", F.max("_at").over(w)))
    open_ = cut(counts.filter(F.col("_cap") > F.col("_known")).select(
        *keys, "_b", (F.col("_ca") - F.col("_a")).alias("_ca0"), (F.col("_cz") - F.col("_z")).alias("_cz0"), "_na", "_nz"))
    fixed = [*keys, "_b", "_ca0", "_cz0", "_na", "_nz"]
    steps = rows.join(open_, [*keys, "_b"]).groupBy(*fixed, "_x").agg(F.sum("_a").alias("_a"), F.sum("_z").alias("_z"))
    inner = Window.partitionBy(*keys, "_b").orderBy("_x")
    gap = F.abs((F.col("_ca0") + F.sum("_a").over(inner)) / F.col("_na") - (F.col("_cz0") + F.sum("_z").over(inner)) / F.col("_nz"))
    return steps.select(*keys, gap.alias("_at")).unionByName(counts.select(*keys, "_at")).groupBy(*keys).agg(F.max("_at").alias("ks"))


def grid_cells(a: DataFrame, problem: Sequence[str], edges_key: str, edges: Mapping[str, Sequence[float]], fine: int) -> DataFrame:
    """Sample A by value buckets: (problem.., edges_key, _cell, _lo, _hi, _n)."""
    return a.groupBy(*problem, edges_key, bucket_by(F.col("x"), F.col(edges_key), edges, fine).alias("_cell")).agg(
        F.min("x").alias("_lo"), F.max("x").alias("_hi"), F.sum("n").alias("_n"))


def grid_buckets(b: DataFrame, base: Sequence[str], edges_key: str, edges: Mapping[str, Sequence[float]], fine: int) -> DataFrame:
    """The histogram of sample B by value buckets: (_k, _b, _z)."""
    return b.groupBy(F.xxhash64(*base).alias("_k"), bucket_by(F.col("x"), F.col(edges_key), edges, fine).alias("_b")).agg(F.sum("n").alias("_z"))


def _moved_cells(cells: DataFrame, grid: DataFrame, problem: Sequence[str], edges_key: str, edges: Mapping[str, Sequence[float]], fine: int, merge: int = 1) -> DataFrame:
    """Cells at each grid point: the buckets ``_from`` to ``_to`` that their values are moved to; ``merge`` neighbours are one."""
    one, two = (F.col("_lo") - F.col("d")) / F.col("r"), (F.col("_hi") - F.col("d")) / F.col("r")
    ends = cells.join(grid, list(problem)).withColumns({"_p": F.xxhash64(*problem), "_low": F.least(one, two), "_high": F.greatest(one, two)})
    for name, x in (("_from", "_low"), ("_to", "_high")):
        ends = made_once(ends, name, bucket_by(F.col(x), F.col(edges_key), edges, fine))
    return ends.withColumns({c: F.floor(F.col(c) / merge).cast("int") for c in ("_from", "_to")}) if merge > 1 else ends


def _sides(moved: DataFrame, buckets: DataFrame, mem: DataFrame, points: DataFrame) -> DataFrame:
    """Both samples at the buckets of each point: bounds of what A has up to a bucket's end, and what B has there.

    A cell of A stays an interval when it is moved: it is surely below a bucket's end if its
    upper end is (``_cl``), and may be if its lower end is (``_ch``). ``_known`` is a distance
    that is reached for sure at the bucket's end, ``_cap`` one that is not exceeded in it.
    """
    point = ["_p", "g"]
    zero = F.lit(0).cast("long")
    ends = F.array(F.struct(F.col("_from").alias("_b"), F.col("_n").alias("_may"), zero.alias("_sure")), F.struct(F.col("_to").alias("_b"), zero.alias("_may"), F.col("_n").alias("_sure")))
    sides = moved.select(*point, F.inline(ends)).groupBy(*point, "_b").agg(F.sum("_may").alias("_may"), F.sum("_sure").alias("_sure")).withColumn("_z", zero)
    b = buckets.join(mem, "_k").groupBy("_p", "_b").agg(F.sum("_z").alias("_z"))
    sides = sides.unionByName(b.join(points.select(*point), "_p").select(*point, "_b", zero.alias("_may"), zero.alias("_sure"), "_z"))
    sides = sides.groupBy(*point, "_b").agg(*[F.sum(c).alias(c) for c in ("_may", "_sure", "_z")])
    w = Window.partitionBy(*point)
    run = w.orderBy("_b")
    sides = sides.select(
        *point, "_b", "_sure", "_z", F.sum("_may").over(run).alias("_ch"), F.sum("_sure").over(run).alias("_cl"), F.sum("_z").over(run).alias("_cz"),
        F.sum("_sure").over(w).alias("_na"), F.sum("_z").over(w).alias("_nz")).filter((F.col("_na") >= MIN_SIDE) & (F.col("_nz") >= MIN_SIDE))
    high, low, fz = F.col("_ch") / F.col("_na"), F.col("_cl") / F.col("_na"), F.col("_cz") / F.col("_nz")
    low0, fz0 = (F.col("_cl") - F.col("_sure")) / F.col("_na"), (F.col("_cz") - F.col("_z")) / F.col("_nz")
    return sides.withColumn("_known", F.greatest(low - fz, fz - high, F.lit(0.0))).withColumn("_cap", F.greatest(high - fz0, fz - low0))


def _grid_bounds(cells: DataFrame, fixed: DataFrame, mem: DataFrame, grid: DataFrame, problem: Sequence[str], edges_key: str,
                 edges: Mapping[str, Sequence[float]], fine: int = CELLS_FINE) -> DataFrame:
    """Bounds (_p, g, _known, _most) of the distance at each grid point, from cells (problem.., edges_key, _lo, _hi, _n) instead of values."""
    buckets = fixed.groupBy("_k", bucket_by(F.col("x"), F.col("_e"), edges, fine).alias("_b")).agg(F.sum("n").alias("_z"))
    sides = _sides(_moved_cells(cells, grid, problem, edges_key, edges, fine), buckets, mem, grid.select(F.xxhash64(*problem).alias("_p"), "g"))
    return sides.groupBy("_p", "g").agg(F.max("_known").alias("_known"), F.max("_cap").alias("_most"))


def ks_grid(
    a: DataFrame,
    b: DataFrame,
    members: DataFrame,
    grid: DataFrame,
    *,
    problem: Sequence[str],
    base: Sequence[str],
    edges: Mapping[str, Sequence[float]],
    edges_key: str,
    direct: bool = False,
    fine: int = FINE,
    prune: bool = False,
    cells: DataFrame | None = None,
    buckets: DataFrame | None = None,
) -> DataFrame:
    """Distance of every (problem, grid point): columns problem.., g, d, r, ks.

    a        problem.., edges_key, x, n   sample A of each problem
    b        base.., edges_key, x, n      histogram sample B is made of
    members  problem.., base..            the base groups that make up B
    grid     problem.., g, d, r, exact    the moves to try on A
    direct   skip the bounding step (small histograms)
    prune    bound the points by wide cells first; for grids of many points that are not ``exact``
    cells, buckets    ``grid_cells`` of a and ``grid_buckets`` of b, where they are at hand

    Where ``exact`` is false only the smallest distance of the problem is asked
    for: points that cannot be it keep a lower bound, which is larger. Cells of A are moved
    instead of its values; only values of cells that reach an open bucket are.
    """
    problem, base = list(problem), list(base)
    # long keys: problems and groups are joined and sorted as one number each
    pid, gid = F.xxhash64(*problem).alias("_p"), F.xxhash64(*base).alias("_k")
    point = ["_p", "g"]
    grid = few(cut(grid))
    points = grid.select("*", pid)
    mem = cut(members.select(pid, gid))
    fixed = b.select(gid, F.col(edges_key).alias("_e"), "x", "n")
    if direct:
        moved = a.join(grid, problem).select(pid, "g", edges_key, ((F.col("x") - F.col("d")) / F.col("r")).alias("x"), "n")
        both = fixed.join(few(mem), "_k").join(points.select(*point), "_p").select(*point, "x", "n")
        return points.join(ks_direct(moved, both, point), point).drop("_p")
    cells = cut(grid_cells(a, problem, edges_key, edges, fine)) if cells is None else cells
    buckets = cut(grid_buckets(b, base, edges_key, edges, fine)) if buckets is None else buckets

    # most points of a grid are told from the best one by a few wide cells
    settled = None
    merge = max(1, fine // CELLS_FINE)
    if prune and merge > 1:
        wide = cells.groupBy(*problem, edges_key, F.floor(F.col("_cell") / merge).alias("_cell")).agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.sum("_n").alias("_n"))
        wide_b = buckets.groupBy("_k", F.floor(F.col("_b") / merge).cast("int").alias("_b")).agg(F.sum("_z").alias("_z"))
        rough = _sides(_moved_cells(wide, grid, problem, edges_key, edges, fine, merge), wide_b, mem, points)
        rough = rough.groupBy(*point).agg(F.max("_known").alias("_known"), F.max("_cap").alias("_most"))
        rough = points.join(rough, point, "left").withColumn("_limit", F.min("_most").over(Window.partitionBy("_p")))
        lost = ~F.col("exact") & F.coalesce(F.col("_known") > F.col("_limit") + BOUND_TOL, F.lit(False))
        rough = cut(rough.withColumn("_lost", lost))
        settled = rough.filter("_lost").select(*points.columns, F.col("_known").alias("ks"))
        grid = few(cut(rough.filter("not _lost").select(*grid.columns)))
        points = grid.select("*", pid)

    zero = F.lit(0).cast("long")
    moved = _moved_cells(cells, grid, problem, edges_key, edges, fine)
    sides = cut(_sides(moved, buckets, mem, points))
    bounds = sides.groupBy(*point).agg(F.max("_known").alias("_known"), F.max("_cap").alias("_most"))
    bounds = cut(points.join(bounds, point).withColumn("_limit", F.min("_most").over(Window.partitionBy("_p"))))
    live = bounds.filter(F.col("exact") | (F.col("_known") <= F.col("_limit") + BOUND_TOL)).select(*point, F.col("_known").alias("_least"))
    # written out, so that its size is known: the rows of A and B meet it in a broadcast join when it is
    # small and only those in open buckets are shuffled
    open_ = cut(sides.join(live, point).filter(F.col("_cap") > F.col("_least")).select(
        *point, "_b", (F.col("_cl") - F.col("_sure")).alias("_ca0"), (F.col("_cz") - F.col("_z")).alias("_cz0"), "_na", "_nz"))
    open_b = few(cut(open_.join(mem, "_p")))
    # cells that reach an open bucket; what they have below it counts as before it
    reach = moved.select(*point, *problem, edges_key, "_cell", F.explode(F.sequence("_from", "_to")).alias("_b")).join(few(open_), [*point, "_b"])
    reach = few(cut(reach))
    fixed_cols = [*point, "_b", "_ca0", "_cz0", "_na", "_nz"]
    in_cells = made_once(a, "_cell", bucket_by(F.col("x"), F.col(edges_key), edges, fine)).join(reach, [*problem, edges_key, "_cell"]).join(points.select(*point, "d", "r"), point)
    in_cells = made_once(in_cells.withColumn("_x", (F.col("x") - F.col("d")) / F.col("r")), "_at", bucket_by(F.col("_x"), F.col(edges_key), edges, fine))
    in_a = in_cells.filter(F.col("_at") <= F.col("_b")).select(
        *fixed_cols, F.when(F.col("_at") == F.col("_b"), F.col("_x")).alias("_x"), F.col("n").alias("_a"), zero.alias("_z"))
    fixed = made_once(fixed, "_b", bucket_by(F.col("x"), F.col("_e"), edges, fine))
    in_b = fixed.join(open_b, ["_k", "_b"]).select(*fixed_cols, F.col("x").alias("_x"), zero.alias("_a"), F.col("n").alias("_z"))
    steps = in_a.unionByName(in_b).groupBy(*fixed_cols, "_x").agg(F.sum("_a").alias("_a"), F.sum("_z").alias("_z"))
    inner = Window.partitionBy(*point, "_b").orderBy(F.col("_x").asc_nulls_first())
    gap = F.abs((F.col("_ca0") + F.sum("_a").over(inner)) / F.col("_na") - (F.col("_cz0") + F.sum("_z").over(inner)) / F.col("_nz"))
    seen = steps.select(*point, gap.alias("_at")).unionByName(bounds.select(*point, F.col("_known").alias("_at")))
    best = seen.groupBy(*point).agg(F.max("_at").alias("ks"))
    out = points.join(best, point, "left").withColumn("ks", F.coalesce("ks", F.lit(0.0)))
    if settled is not None:
        out = out.unionByName(settled.select(*out.columns))
    return out.drop("_p")


def ks_two_sample(a: DataFrame, b: DataFrame, keys: Sequence[str], x: str = "x") -> DataFrame:
    """Distance per key between the values of two tables (keys.., x)."""
    keys = list(keys)
    ha = a.filter(F.col(x).isNotNull()).groupBy(*keys, F.col(x).alias("x")).agg(F.count(F.lit(1)).alias("n"))
    hb = b.filter(F.col(x).isNotNull()).groupBy(*keys, F.col(x).alias("x")).agg(F.count(F.lit(1)).alias("n"))
    edges = {"": value_edges(a.select(F.col(x).alias("x")).unionByName(b.select(F.col(x).alias("x"))), ["x"])["x"]}
    side = F.lit("").alias("_side")
    cells = ha.select(*keys).distinct()
    grid = cells.select(*keys, F.lit(0).alias("g"), F.lit(0.0).alias("d"), F.lit(1.0).alias("r"), F.lit(True).alias("exact"))
    members = cells.select(*[F.col(k) for k in keys], *[F.col(k).alias(f"_k_{k}") for k in keys])
    hb = hb.select(*[F.col(k).alias(f"_k_{k}") for k in keys], side, "x", "n")
    out = ks_grid(ha.withColumn("_side", F.lit("")), hb, members, grid, problem=keys,
                  base=[f"_k_{k}" for k in keys], edges=edges, edges_key="_side")
    return out.select(*keys, "ks")


def ks_vs_rest(df: DataFrame, slicer: str, target: str) -> DataFrame:
    """Distance of every level of ``slicer`` against all other levels, in one pass.

    Between two values of a level its own distribution function is flat and the
    complement's only rises, so the maximum is found at (or just before) the
    level's own values; the complement's function there is total minus own.
    """
    x = F.col(target).cast("double")
    rows = df.select(F.col(slicer).cast("string").alias("level"), x.alias("x")).filter("level is not null and x is not null")
    edges = value_edges(rows, ["x"])["x"]
    hist = rows.groupBy("level", "x").agg(F.count(F.lit(1)).alias("n"))
    own = cumulative(hist, ["level"], "x", {"n": "c_own"}, bucket_of(F.col("x"), edges))
    all_ = hist.groupBy("x").agg(F.sum("n").alias("m")).withColumn("_one", F.lit(1))
    total = cumulative(all_, ["_one"], "x", {"m": "c_all"}, bucket_of(F.col("x"), edges)).drop("_one")
    sizes = hist.groupBy("level").agg(F.sum("n").alias("n_own"))
    sizes = with_total(sizes, "n_own", "n_all")
    at = own.join(total, "x").join(sizes, "level")
    n_rest = F.col("n_all") - F.col("n_own")
    now = F.abs(F.col("c_own") / F.col("n_own") - (F.col("c_all") - F.col("c_own")) / n_rest)
    own0, all0 = F.col("c_own") - F.col("n"), F.col("c_all") - F.col("m")
    before = F.abs(own0 / F.col("n_own") - (all0 - own0) / n_rest)
    gap = F.when((F.col("n_own") < MIN_SIDE) | (n_rest < MIN_SIDE), F.lit(0.0)).otherwise(F.greatest(now, before))
    return at.groupBy("level", "n_own").agg(F.max(gap).alias("ks")).select(
        "level", F.col("n_own").alias("n"), "ks")
