"""A row of several groups is given its bucket once, and only rows of needed buckets are unfolded to look for values."""
import pytest
from pyspark.sql import functions as F

from tabaudit.functions.order_stats import complement_quantiles, group_quantiles


def test_unfolded_groups(spark):
    h = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    rows = spark.range(20_000).select(F.array((h % 3).cast("string"), F.when(h % 7 > 0, (h % 5).cast("string"))).alias("p"), F.when(F.shiftright(h, 9) % 50 > 0, F.shiftright(h, 9) % 4001 / 7).alias("x"), F.lit("c").alias("of"))
    read = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def seen(_):
        read.add(1)
        return True

    def unfold(r):
        return r.filter(seen.asNondeterministic()("x")).select("*", F.posexplode("p").alias("k", "level")).filter("level is not null")

    edges = {"c": [float(e) for e in range(0, 573, 40)]}
    out = group_quantiles(rows, ["k", "level", "of"], {"lo": 0.0, "med": 0.5, "hi": 0.9}, edges=edges, edges_key="of", unfold=unfold)
    got = {(r.k, r.level): (r.n, r.lo, r.med, r.hi) for r in out.collect()}
    flat = rows.filter("x is not null").select("x", F.posexplode("p").alias("k", "level")).filter("level is not null")
    want = flat.groupBy("k", "level").agg(F.count("x").alias("n"), F.percentile("x", F.array(F.lit(0.0), F.lit(0.5), F.lit(0.9))).alias("q")).collect()
    assert {(r.k, r.level): (r.n, *[pytest.approx(v) for v in r.q]) for r in want} == got and len(got) == 8
    assert read.value < 22_000  # once for the counts, then the few rows near the quantiles; not all of them twice


def test_unfolded_complements(spark):
    h = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    rows = spark.range(6_000).select(F.array((h % 3).cast("string"), (h % 5).cast("string")).alias("p"), (F.shiftright(h, 9) % 401 / 7).alias("x"), F.lit("c").alias("of"), (1 + h % 2).alias("w"))

    def unfold(r):
        return r.select("*", F.posexplode("p").alias("k", "level"))

    how = {"whole": ["k", "of"], "part": ["level"], "probs": {"med": 0.5}, "weight": "w", "edges": {"c": [float(e) for e in range(0, 61, 4)]}, "edges_key": "of"}
    got = {(r.k, r.level): (r.n, r.med) for r in complement_quantiles(rows, **how, unfold=unfold).collect()}
    flat = unfold(rows).select("k", "level", "x", F.explode(F.sequence(F.lit(1), "w"))).toPandas()
    assert len(got) == 8
    for (k, level), (n, med) in got.items():
        rest = flat[(flat.k == k) & (flat.level != level)].x
        assert (n, med) == (len(rest), pytest.approx(rest.median()))
