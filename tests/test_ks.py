import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabaudit.functions import ks as K
from tabaudit.functions.order_stats import value_edges


def ks_numpy(a, b):
    if len(a) < 6 or len(b) < 6:
        return 0.0
    v = np.concatenate([a, b])
    fa = np.searchsorted(np.sort(a), v, side="right") / len(a)
    fb = np.searchsorted(np.sort(b), v, side="right") / len(b)
    return float(np.abs(fa - fb).max())


@pytest.mark.parametrize("digits", [0, 3])
@pytest.mark.parametrize("direct", [True, False])
def test_grid_is_exact(spark, digits, direct):
    rng = np.random.default_rng(11)
    a = {"p": np.round(rng.normal(3, 2, 800), digits), "q": np.round(rng.exponential(2, 300), digits)}
    b = {"u": np.round(rng.normal(0, 2, 900), digits), "v": np.round(rng.normal(1, 1, 700), digits)}
    hist = lambda d, k: spark.createDataFrame(pd.concat([pd.DataFrame({k: g, "e": "e", "x": x}) for g, x in d.items()])).groupBy(k, "e", "x").agg(F.count(F.lit(1)).alias("n"))
    ha, hb = hist(a, "pid"), hist(b, "k")
    members = spark.createDataFrame([("p", "u"), ("q", "u"), ("q", "v")], "pid string, k string")
    pts = [(0, 0.0, 1.0), (1, 2.5, 1.0), (2, 3.0, 1.0), (3, 0.0, 1.7)]
    grid = spark.createDataFrame([(p, g, d, r, True) for p in a for g, d, r in pts], "pid string, g int, d double, r double, exact boolean")
    edges = {"e": value_edges(hb, ["x"])["x"]}
    got = K.ks_grid(ha, hb, members, grid, problem=["pid"], base=["k"], edges=edges, edges_key="e", direct=direct).collect()
    assert len(got) == 8
    sets = {"p": b["u"], "q": np.concatenate([b["u"], b["v"]])}
    for r in got:
        assert r["ks"] == pytest.approx(ks_numpy((a[r["pid"]] - r["d"]) / r["r"], sets[r["pid"]]), abs=1e-12)


def test_inexact_points_never_win(spark):
    rng = np.random.default_rng(5)
    a, b = np.round(rng.normal(2, 1, 2000), 3), np.round(rng.normal(0, 1, 2500), 3)
    one = lambda x, **k: spark.createDataFrame(pd.DataFrame({**k, "e": "e", "x": x})).groupBy(*k, "e", "x").agg(F.count(F.lit(1)).alias("n"))
    ds = [float(d) for d in np.linspace(1, 3, 21)]
    grid = spark.createDataFrame([("p", i, d, 1.0, False) for i, d in enumerate(ds)], "pid string, g int, d double, r double, exact boolean")
    members = spark.createDataFrame([("p", "u")], "pid string, k string")
    hb = one(b, k="u")
    got = K.ks_grid(one(a, pid="p"), hb, members, grid, problem=["pid"], base=["k"], edges={"e": value_edges(hb, ["x"])["x"]}, edges_key="e").collect()
    want = [ks_numpy(a - d, b) for d in ds]
    best = min(got, key=lambda r: (r["ks"], r["g"]))
    assert best["g"] == int(np.argmin(want)) and best["ks"] == pytest.approx(min(want), abs=1e-12)
    assert all(r["ks"] <= want[r["g"]] + 1e-12 for r in got)


def test_vs_rest_and_small_sides(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"s": rng.choice(["a", "b", "c"], 900), "x": np.round(rng.normal(0, 1, 900), 1)})
    pdf = pd.concat([pdf, pd.DataFrame({"s": ["tiny"] * 5, "x": [9.0] * 5})])
    got = {r["level"]: r["ks"] for r in K.ks_vs_rest(spark.createDataFrame(pdf).repartition(5), "s", "x").collect()}
    for s in "abc":
        assert got[s] == pytest.approx(ks_numpy(pdf[pdf.s == s].x.values, pdf[pdf.s != s].x.values), abs=1e-12)
    assert got["tiny"] == 0.0


def test_equal_multisets_have_distance_zero(spark):
    df = spark.range(0, 400).select((F.col("id") % 7).cast("double").alias("x"), F.lit(1).alias("k"))
    assert K.ks_two_sample(df, df.repartition(3), ["k"]).first()["ks"] == 0.0


def test_cells_settle_most_points_of_a_grid(spark):
    """With ``prune`` the least distance stays exact, points asked for exactly too, and few points move every value."""
    rng = np.random.default_rng(7)
    a, b = np.round(rng.normal(2, 1, 6000), 4), np.round(np.concatenate([rng.normal(0, 1, 6000), np.full(900, 0.25)]), 4)
    one = lambda x, **k: spark.createDataFrame(pd.DataFrame({**k, "e": "e", "x": x})).groupBy(*k, "e", "x").agg(F.count(F.lit(1)).alias("n"))
    ds = [0.0, *[float(d) for d in np.linspace(1, 3, 21)]]
    grid = spark.createDataFrame([("p", i, d, 1.0, d == 0) for i, d in enumerate(ds)], "pid string, g int, d double, r double, exact boolean")
    members = spark.createDataFrame([("p", "u")], "pid string, k string")
    ha, hb = one(a, pid="p"), one(b, k="u")
    edges = {"e": value_edges(hb, ["x"])["x"]}
    got = K.ks_grid(ha, hb, members, grid, problem=["pid"], base=["k"], edges=edges, edges_key="e", prune=True).collect()
    want = [ks_numpy(a - d, b) for d in ds]
    assert sorted(r["g"] for r in got) == list(range(22))
    best = min(got, key=lambda r: (r["ks"], r["g"]))
    assert best["g"] == int(np.argmin(want)) and best["ks"] == pytest.approx(min(want), abs=1e-12)
    assert got[[r["g"] for r in got].index(0)]["ks"] == pytest.approx(want[0], abs=1e-12)
    cells = ha.groupBy("pid", "e", K.bucket_by(F.col("x"), F.col("e"), edges, K.CELLS_FINE).alias("c")).agg(F.min("x").alias("_lo"), F.max("x").alias("_hi"), F.sum("n").alias("_n"))
    mem = members.select(F.xxhash64("pid").alias("_p"), F.xxhash64("k").alias("_k"))
    bounds = {r["g"]: r for r in K._grid_bounds(cells, hb.select(F.xxhash64("k").alias("_k"), F.col("e").alias("_e"), "x", "n"), mem, grid, ["pid"], "e", edges).collect()}
    assert all(bounds[g]["_known"] - 1e-12 <= want[g] <= bounds[g]["_most"] + 1e-12 for g in range(22))
    limit = min(r["_most"] for r in bounds.values())
    assert sum(r["_known"] <= limit for r in bounds.values()) <= 4
