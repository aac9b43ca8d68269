"""Distances of a grid: cells are moved in place of values, and bucket numbers stay out of join keys."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabaudit.functions import ks as K
from tabaudit.functions.lineage import cut
from tabaudit.functions.order_stats import bucket_of, value_edges, made_once


def plan(df):
    return df._jdf.queryExecution().toString()


def test_bucket_is_written_out_once(spark):
    df = spark.range(100).select((F.col("id") * 1.0).alias("x"))
    bucket = bucket_of(F.col("x"), [0.0, 10.0, 50.0, 99.0])
    need = F.broadcast(spark.range(5).select(F.col("id").cast("int").alias("_b")))
    out = made_once(df, "_b", bucket).join(need, "_b")
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("WHEN (x") + text.count("WHEN (cast") <= str(bucket).count("WHEN (x") + 2
    assert "Generate explode(array(" in text
    want = df.withColumn("_b", bucket).join(need, "_b")
    assert sorted(out.select("x", "_b").collect()) == sorted(want.select("x", "_b").collect())


@pytest.mark.parametrize("scale", [1.0, 40.0])
def test_cells_that_span_many_buckets(spark, scale):
    """A is wide where B is dense, and moved beyond all edges too."""
    rng = np.random.default_rng(3)
    a = np.round(np.concatenate([rng.normal(0, scale, 1500), np.full(200, 1.25)]), 2)
    b = np.round(np.concatenate([rng.normal(0, 1, 3000), np.full(100, 0.5)]), 3)
    one = lambda x, **k: cut(spark.createDataFrame(pd.DataFrame({**k, "e": "e", "x": x})).groupBy(*k, "e", "x").agg(F.count(F.lit(1)).alias("n")))
    ds = [0.0, 0.3, -2.0, 500.0]
    grid = spark.createDataFrame([("p", i, d, r, True) for i, (d, r) in enumerate([(d, 1.0) for d in ds] + [(0.0, 0.5)])], "pid string, g int, d double, r double, exact boolean")
    members = spark.createDataFrame([("p", "u")], "pid string, k string")
    ha, hb = one(a, pid="p"), one(b, k="u")
    out = K.ks_grid(ha, hb, members, grid, problem=["pid"], base=["k"], edges={"e": value_edges(hb, ["x"])["x"]}, edges_key="e", fine=512, prune=True)
    assert "_cell" in plan(out)
    for r in out.collect():
        m, v = (a - r["d"]) / r["r"], None
        v = np.concatenate([m, b])
        want = np.abs(np.searchsorted(np.sort(m), v, side="right") / len(m) - np.searchsorted(np.sort(b), v, side="right") / len(b)).max()
        assert r["ks"] == pytest.approx(want, abs=1e-12)
