"""Filter interaction audit: the exact solve, and edge rows against a plain version."""
from fractions import Fraction
from itertools import permutations

import brute
import numpy as np
from pyspark.sql import functions as F

from tabaudit.llm import interactions


def test_operator_is_the_mean_over_orders():
    rng = np.random.default_rng(2)
    v = [0, *map(int, rng.integers(0, 1000, 31))]
    v[0] = 17  # an offset is nobody's
    got = [sum(c * x for c, x in zip(row, v)) for row in interactions.shapley_operator()]
    want = [Fraction(0)] * 5
    for order in permutations(range(5)):
        s = 0
        for i in order:
            want[i] += Fraction(v[s | 1 << i] - v[s], 120)
            s |= 1 << i
    assert got == want


def plain(rows, labels):
    """rows: (id, text, part). As audit() defines it, one filter and order after the other."""
    fails = []
    for i, t, _ in rows:
        t = t or ""
        w = brute.words(t)
        copy = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)
        fails.append((len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), any(c in "#$%&*|" for c in t), copy))
    good, toxic = ({d for d, *x in labels if d is not None and x[k] == 1} for k in (0, 1))
    out = {}
    for part in {p or "" for _, _, p in rows}:
        mine = [k for k, r in enumerate(rows) if (r[2] or "") == part]
        shapley = [0] * 5
        for order in permutations(range(5)):
            left = set(mine)
            for step, f in enumerate(order, 1):
                gone = {k for k in left if fails[k][f]}
                redundant = sum(fails[k][f] for k in mine) - len(gone)
                left -= gone
                shapley[f] += len(gone)
                out[part, "".join("ABCDE"[x] for x in order), step] = [len(left), len(gone), redundant, sum(fails[k][f] and sum(fails[k]) == 1 for k in mine), sum(rows[k][0] in good for k in gone), sum(rows[k][0] in toxic for k in gone), f]
        for key in out:
            if key[0] == part:
                out[key][6] = shapley[out[key][6]]
    return out


LONG = " ".join(f"w{i}" for i in range(30_000))
OK = " ".join(f"a{i}" for i in range(120))
ROWS = [
    (3, OK, "en"), (1, OK, "en"), (1, OK, "en"), (2, OK, None), (None, OK, "en"), (None, OK, "en"), (4, None, "en"), (5, "", "de"), (6, " \t\n", ""), (7, LONG, "de"), (8, LONG + " #", "de"),
    (9, "ABC " * 150, "en"), (10, OK.upper(), "de"), (11, "x " * 99, "de"), (12, "É|" + OK, "de"), (13, "É|" + OK, "en"), (13, OK + " x", "en"),
]
LABELS = [(1, 1, 0), (3, 1, 1), (3, 0, 1), (3, 1, None), (None, 1, 1), (13, None, 1), (99, 1, 1), (10, 1, 0)]


def frames(spark, rows, labels):
    clash = ["id", "part", "digest", "own", "n", "good", "toxic", "mask", "docs", "values", "walk", "l_id"]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").select("*", *[F.lit("clash").alias(c) for c in clash])
    return d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("good", F.lit("x"))


def test_against_the_plain_version(spark):
    out = interactions.audit(*frames(spark, ROWS, LABELS))
    got = {(r["part"], r["filter_order"], r["step"]): list(r[3:]) for r in out.collect()}
    assert out.count() == len(got) == 600 * 3 and got == plain(ROWS, LABELS)


def test_empty(spark):
    assert interactions.audit(*frames(spark, [], LABELS)).count() == 0
    out = interactions.audit(*frames(spark, ROWS[:1], []))
    assert {tuple(r[3:]) for r in out.collect()} == {(1, 0, 0, 0, 0, 0, 0)}
