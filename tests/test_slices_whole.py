"""The acceptance test of a slice is decided on all rows."""
import numpy as np
from pyspark.sql import functions as F

from tabaudit.functions.order_stats import bucket_of
from tabaudit.functions.permutation import draw_counts, permutation_distances
from tabaudit.operators import slices as S


def _table(spark):
    """Level a is b moved by 50; 12,000 rows each."""
    x = F.pmod(F.xxhash64("id"), F.lit(10_007)).cast("double") / 100
    return spark.range(24_000).select("id", F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("s"), (x + F.when(F.col("id") % 2 == 0, 50.0).otherwise(0.0)).alias("x"))


def _ks(a, b):
    at = np.union1d(a, b)
    return np.abs(np.searchsorted(np.sort(a), at, "right") / len(a) - np.searchsorted(np.sort(b), at, "right") / len(b)).max()


def test_no_caps_by_default():
    assert (S.SliceOptions().fold_cap, S.SliceOptions().ref_cap) == (None, None)


def test_residual_and_floor_over_all_rows(spark):
    df, opt = _table(spark), S.SliceOptions(draws=9)
    whole, edges, cells = S.prepare(df, ["s"], ["x"], {})
    cand = S.candidates_of(cells).filter("level = 'a'")
    members = S.members_of(df, cells, cand)
    folds = S.fold_rows(df, cand, {"s": ["x"]}, ["id"], opt).collect()
    assert len(folds) == 12_000
    row = S.evaluate_candidates(df, cand, members, edges, whole, ["id"], opt).first()
    ref = np.array([r.x for r in df.filter("s = 'b'").collect()])
    a, b = (np.array([r.x for r in folds if r.part == p]) for p in "AB")
    want = max(_ks(a / np.median(b) * np.median(ref), ref), _ks(b / np.median(a) * np.median(ref), ref))
    assert abs(row.ks_mul - want) < 1e-3 and 0 < row.ks_add < 0.05 and 0 < row.tau < 0.05


def _row_permutations(x, m, draws, rng):
    out = []
    for _ in range(draws):
        p = rng.permutation(x)
        out.append(_ks(p[:m], p[m : 2 * m]))
    return np.array(out)


def test_draws_on_counts_are_row_permutations(spark):
    """Mean and 95th percentile of the distances, for continuous, tied and mixed values, within sampling error."""
    rng = np.random.default_rng(3)
    data = {"even": (rng.normal(size=9000), 3000), "tied": (rng.integers(0, 5, 4000).astype(float), 1500), "mixed": (np.where(rng.random(6000) < 0.5, 0.0, rng.lognormal(size=6000)), 3000), "small": (np.arange(40.0), 10)}
    rows = [(c, "x", float(v), 1) for c, (x, _) in data.items() for v in x]
    hist = spark.createDataFrame(rows, "cid string, target string, x double, n int")
    sizes = spark.createDataFrame([(c, m) for c, (_, m) in data.items()], "cid string, m long")
    for edges in ([-3.0, -0.5, 0.0, 0.5, 4.0, 40.0], [0.0]):
        got = permutation_distances(hist, sizes, bucket_of(F.col("x"), edges, 8), 1000).collect()
        assert len(got) == 4000
        for c, (x, m) in data.items():
            ours, rows_ = np.array([r.ks for r in got if r.cid == c]), _row_permutations(x, m, 1000, rng)
            assert abs(ours.mean() - rows_.mean()) < 4 * rows_.std() * np.sqrt(2 / 1000)
            # distances are multiples of 1 / m, so the percentile may fall on the next one
            assert abs(np.percentile(ours, 95) - np.percentile(rows_, 95)) < 0.08 * np.percentile(rows_, 95) + 1.01 / m


def test_a_draw_costs_nodes_and_not_rows():
    """A thousand times the rows on the same values: the same work; and the distances shrink as they have to."""
    rng = np.random.default_rng(1)
    counts = rng.integers(1, 5, 4096)
    for k in (1, 1000, 10**7):
        n = counts * k
        m = int(n.sum() // 2)
        a, z = draw_counts(rng, n, m)
        assert a.sum() == z.sum() == m and (a + z <= n).all() and (a >= 0).all() and (z >= 0).all()
        d = np.abs(np.cumsum(a) - np.cumsum(z)).max() / m
        assert 0.2 < d * np.sqrt(m / 2) < 2.5


def test_draws_do_not_depend_on_the_partitioning(spark):
    hist = spark.range(3000).select(F.lit("c").alias("cid"), (F.pmod(F.xxhash64("id"), F.lit(701)) / 3).alias("x"), F.lit(1).alias("n"))
    sizes = spark.createDataFrame([("c", 900)], "cid string, m long")
    one, two = ({(r.draw, r.ks) for r in permutation_distances(h, sizes, bucket_of(F.col("x"), [0.0, 100.0, 240.0], 16), 30).collect()} for h in (hist, hist.repartition(7, "x")))
    assert one == two


def test_caps_still_bound_what_is_drawn(spark):
    df, opt = _table(spark), S.SliceOptions(fold_cap=500, ref_cap=700)
    _, _, cells = S.prepare(df, ["s"], ["x"], {})
    cand = S.candidates_of(cells).filter("level = 'a'")
    n = {r.part: r["count"] for r in S.fold_rows(df, cand, {"s": ["x"]}, ["id"], opt).groupBy("part").count().collect()}
    assert n == {"A": 500, "B": 500}
    assert S.reference_rows(df, cand, {"s": ["x"]}, S.members_of(df, cells, cand), ["id"], opt).count() == 700
