"""Repairs as lookup tables against the same repairs one by one."""
import random
import time

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tabaudit.operators import frozen
from tabaudit.operators import repair as R

FIELDS = ("value", "dist", "entity_col", "entity", "time_col", "start", "end", "factor", "per_year", "year", "all_years", "targets")


def finding(type_, target, slicer=None, level=None, context=None, context_level=None, confidence="REPAIR", **repair):
    r = Row(**{"type": type_, **{f: repair.get(f) for f in FIELDS}})
    return Row(kind=type_, slicer=slicer, level=level, context=context, context_level=context_level, target=target, confidence=confidence, repair=r)


@pytest.fixture(scope="module")
def df(spark):
    return spark.range(600).select(
        "id", (F.col("id") % 7).cast("int").alias("s"), F.when(F.col("id") % 11 > 0, F.concat(F.lit("g"), F.col("id") % 5)).alias("c d"),
        (F.col("id") % 10 + 2000).cast("int").alias("year"), (F.col("id") * 1.7 + 3).alias("x"), (F.col("id") * 3).cast("int").alias("y"),
        F.when(F.col("id") % 4 == 0, "n/a").otherwise((F.col("id") / 8).cast("string")).alias("t"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("k"), F.col("id") % 2)).alias("cat"))


def mixed(seed, n):
    """Findings of every kind that needs only its row, and some that read what others write."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        at = rng.choice([dict(slicer="s", level=str(rng.randrange(8))), dict(slicer="c d", level=f"g{rng.randrange(6)}"),
                         dict(slicer="s", level=str(rng.randrange(7)), context="c d", context_level=f"g{rng.randrange(5)}"), dict(slicer="cat", level="k1")])
        window = dict(entity_col=rng.choice(["c d", "cat"]), entity=rng.choice(["g1", "g2", "k0"]), time_col="year", start=2000 + rng.randrange(6), end=2004 + rng.randrange(6))
        mix = rng.choice([{"k0": 0.9, "q": 0.1}, {"k0": 0.4, "it's": 0.35, "z": 0.25}, {}])
        out.append(rng.choice([
            finding("subtract", rng.choice("xyt"), value=rng.choice([0.5, 3.25]), **at), finding("divide", rng.choice("xyt"), value=rng.choice([1.5, 3.0]), **at),
            finding("divide_window", "x", factor=1.25, **window), finding("divide_window_multi", "y", targets=["x", "y"], per_year=1.1, **window),
            finding("impute_missing", "cat", dist=mix, **at), finding("flag_fd", "cat", **at), finding("subtract", "x", confidence="REVIEW", value=9.0, **at),
            finding("divide_window", "s", factor=2.0, **window),
        ]))
    return out


@pytest.mark.parametrize("seed,n", [(1, 6), (2, 14), (3, 14)])
def test_equal_to_one_by_one(df, seed, n):
    found, want = mixed(seed, n), df
    for f in found:
        if f["confidence"] == "REPAIR":
            want = R.apply_repair(want, f, ["id"], seed=3)
    got = R.apply_all(df, found, ["id"], seed=3)
    assert got.columns == want.columns and [f.dataType for f in got.schema] == [f.dataType for f in want.schema]
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_a_repair_waits_for_what_it_reads_and_passes_what_it_does_not_touch():
    a = finding("subtract", "x", "s", "1", value=1.0)
    fill = finding("impute_missing", "cat", "s", "1", dist={"k0": 1.0})
    b = finding("divide", "y", "s", "2", value=2.0)
    reads = finding("divide", "y", "cat", "k0", value=2.0)
    writes = finding("subtract", "s", "c d", "g1", value=1.0)
    kinds = lambda found: [[p for p, _ in s.found] for s in frozen.stages(found, ["id"])]
    assert kinds([a, fill, b]) == [[0, 2], [1]]
    assert kinds([a, fill, reads, b]) == [[0], [1], [2, 3]]
    assert kinds([a, writes, b]) == [[0, 1], [2]]
    assert kinds([a, finding("impute_from_reference", "x", "s", "3"), a]) == [[0], [1], [2]]
    assert kinds([a, finding("subtract", "x", "s", None, value=1.0), a]) == [[0], [1], [2]]


def test_only_reviews_and_empty_mixes_change_nothing(df):
    found = [finding("flag_fd", "cat", "s", "1"), finding("impute_missing", "cat", "s", "1", dist={}), finding("impute_missing", "cat", "s", "2", dist={})]
    assert sorted(map(str, R.apply_all(df, found, ["id"]).collect())) == sorted(map(str, df.collect()))
    assert R.apply_all(df.limit(0), mixed(2, 14), ["id"]).count() == 0


def test_a_thousand_findings_are_one_join(spark):
    df = spark.range(50_000).select("id", (F.col("id") % 1000).cast("string").alias("s"), F.lit(100.0).alias("x"), F.lit(8.0).alias("y"))
    found = [finding("subtract" if k % 2 else "divide", "xy"[k % 2], "s", str(k), value=float(k % 7 + 1)) for k in range(1000)]
    start = time.monotonic()
    out = R.apply_all(df, found, ["id"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert time.monotonic() - start < 20
    assert plan.count("BroadcastHashJoin") == 1 and "Exchange hash" not in plan
    k = F.col("id") % 1000
    x, y = F.when(k % 2 == 0, F.lit(100.0) / (k % 7 + 1)).otherwise(100.0), F.when(k % 2 == 1, F.lit(8.0) - (k % 7 + 1)).otherwise(8.0)
    assert out.filter((F.col("x") != x) | (F.col("y") != y)).count() == 0


def test_many_repairs_on_a_stream(spark, df, tmp_path):
    from tabaudit.streaming import repair_stream

    found = [f for f in mixed(4, 12) if f["confidence"] == "REPAIR"]
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = repair_stream(stream, found, ["id"]).writeStream.format("memory").queryName("many").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(str, spark.table("many").collect())) == sorted(map(str, R.apply_all(df, found, ["id"]).collect()))
