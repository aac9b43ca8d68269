"""Distances between random disjoint parts of a table, drawn on counts instead of rows.

Two parts of ``m`` rows each, drawn without replacement, put hypergeometric numbers of
rows into the halves of any tree over the ordered values. So a draw goes down the tree: the
numbers of a node are split between its children, and the distance of the two parts'
distribution functions is known at every border. Inside a node both functions only rise,
which bounds the distance there; nodes that cannot hold the largest one are not opened. A
draw costs the buckets of the first level and then, for each part of size m, in the order
of the square root of m nodes, whatever the number of rows.

The upper levels are the value buckets of a histogram, drawn in blocks of draws; the lower
levels are the values within a bucket, one task per (problem, bucket), which reads them
once for all draws that have it open. Random numbers depend on the problem, the salt, the
draw and the bucket only, so a lost task gives the same numbers again.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabaudit.functions.lineage import cut, few
from tabaudit.functions.order_stats import made_once

#: Draws of a problem that one task makes at the bucket level.
DRAWS_A_TASK = 20
#: Above this many rows a split is drawn from the normal distribution of the same mean and variance (relative error below 1e-4).
EXACT_ROWS = 500_000_000


def hypergeometric(rng: np.random.Generator, good: np.ndarray, bad: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Of k rows drawn from good + bad, how many are good."""
    out = np.zeros(len(good), np.int64)
    n = good + bad
    small = n < EXACT_ROWS
    out[small] = rng.hypergeometric(good[small], bad[small], k[small])
    if not small.all():
        g, b, d, t = (x[~small].astype(float) for x in (good, bad, k, n))
        spread = np.sqrt(np.maximum(d * (g / t) * (b / t) * (t - d) / np.maximum(t - 1, 1), 0))
        x = np.rint(d * g / t + spread * rng.standard_normal(len(g)))
        out[~small] = np.clip(x, np.maximum(0, d - b), np.minimum(g, d)).astype(np.int64)
    return out


def _split(rng: np.random.Generator, left: np.ndarray, right: np.ndarray, a: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the first and of the second part that fall into the left child."""
    la = hypergeometric(rng, left, right, a)
    return la, hypergeometric(rng, left - la, right - (a - la), z)


def draw_counts(rng: np.random.Generator, counts: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of two disjoint parts of m rows in each bucket, top-down."""
    size = 1 << max(0, int(len(counts) - 1).bit_length())
    levels = [np.concatenate([counts, np.zeros(size - len(counts), np.int64)])]
    while len(levels[-1]) > 1:
        levels.append(levels[-1][0::2] + levels[-1][1::2])
    a, z = np.array([m], np.int64), np.array([m], np.int64)
    for children in levels[-2::-1]:
        la, lz = _split(rng, children[0::2], children[1::2], a, z)
        a, z = np.stack([la, a - la], axis=1).ravel(), np.stack([lz, z - lz], axis=1).ravel()
    return a[: len(counts)], z[: len(counts)]


def largest_inside(rng: np.random.Generator, counts: np.ndarray, m: int, a: np.ndarray, z: np.ndarray, a0: np.ndarray, z0: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Per draw the largest distance at the values of a bucket, or what was ``known`` if that is not less.

    ``counts``: rows of the bucket's values; a, z: what the parts have in it; a0, z0: before it.
    """
    upto = np.concatenate([[0], np.cumsum(counts)])
    best = known.copy()
    draw, low, high = np.arange(len(a)), np.zeros(len(a), np.int64), np.full(len(a), len(counts))
    while len(draw):
        middle = (low + high) // 2
        la, lz = _split(rng, upto[middle] - upto[low], upto[high] - upto[middle], a, z)
        np.maximum.at(best, draw, np.abs((a0 + la) - (z0 + lz)) / m)
        draw, low, high = np.tile(draw, 2), np.concatenate([low, middle]), np.concatenate([middle, high])
        a0, z0 = np.concatenate([a0, a0 + la]), np.concatenate([z0, z0 + lz])
        a, z = np.concatenate([la, a - la]), np.concatenate([lz, z - lz])
        most = np.maximum(a0 + a - z0, z0 + z - a0) / m
        live = (high - low > 1) & (most > best[draw])
        draw, low, high, a, z, a0, z0 = (v[live] for v in (draw, low, high, a, z, a0, z0))
    return best


def _rng(*words) -> np.random.Generator:
    return np.random.default_rng([zlib.crc32(str(w).encode()) for w in words])


def permutation_distances(hist: DataFrame, sizes: DataFrame, bucket: Column, draws: int, salt: str = "") -> DataFrame:
    """Distance of every draw: (cid, draw, ks).

    hist   cid, x, n, and what ``bucket`` needs: counts of values; a value may have several rows
    sizes  cid, m: rows of each part; at most half the problem's rows
    """
    rows = made_once(hist.join(few(cut(sizes)), "cid"), "b", bucket).select("cid", "m", "b", "x", F.col("n").cast("long").alias("n"))
    counts = rows.groupBy("cid", "m", "b").agg(F.sum("n").alias("n"))
    blocks = F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // DRAWS_A_TASK))).alias("block")

    def upper(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("b")
        cid, m, block, n, b = p["cid"].iloc[0], int(p["m"].iloc[0]), int(p["block"].iloc[0]), p["n"].to_numpy(), p["b"].to_numpy()
        out = []
        for d in range(block * DRAWS_A_TASK, min(draws, (block + 1) * DRAWS_A_TASK)):
            a, z = draw_counts(_rng(cid, salt, d), n, m)
            ca, cz = np.cumsum(a), np.cumsum(z)
            known = np.abs(ca - cz).max() / m
            open_ = (np.maximum(ca - (cz - z), cz - (ca - a)) / m > known) & (a + z > 1)
            out.append(pd.DataFrame({"b": np.append(-1, b[open_]), "a": np.append(0, a[open_]), "z": np.append(0, z[open_]), "a0": np.append(0, (ca - a)[open_]), "z0": np.append(0, (cz - z)[open_]), "draw": d, "known": known}))
        return pd.concat(out).assign(cid=cid, m=m)[["cid", "m", "draw", "b", "a", "z", "a0", "z0", "known"]]

    first = cut(counts.select("*", blocks).groupBy("cid", "block").applyInPandas(upper, "cid string, m long, draw int, b int, a long, z long, a0 long, z0 long, known double"))
    whole = first.filter("b < 0").select("cid", "draw", F.col("known").alias("ks"))
    open_ = first.filter("b >= 0")

    def lower(key: tuple, tries: pd.DataFrame, values: pd.DataFrame) -> pd.DataFrame:
        if not len(tries) or not len(values):
            return pd.DataFrame({"cid": [], "draw": [], "ks": []}).astype({"cid": "object", "draw": "int32", "ks": "float64"})
        tries = tries.sort_values("draw")
        _, which = np.unique(values["x"].to_numpy(), return_inverse=True)
        n = np.bincount(which, weights=values["n"].to_numpy()).astype(np.int64)
        got = largest_inside(_rng(key[0], salt, "in", key[1]), n, int(tries["m"].iloc[0]), *[tries[c].to_numpy() for c in ("a", "z", "a0", "z0", "known")])
        return pd.DataFrame({"cid": key[0], "draw": tries["draw"].to_numpy(), "ks": got})

    wanted = few(cut(open_.select("cid", "b").distinct()))
    inside = rows.select("cid", "b", "x", "n").join(wanted, ["cid", "b"], "left_semi")
    fine = open_.groupBy("cid", "b").cogroup(inside.groupBy("cid", "b")).applyInPandas(lower, "cid string, draw int, ks double")
    return whole.unionByName(fine).groupBy("cid", "draw").agg(F.max("ks").alias("ks"))
