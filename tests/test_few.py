"""Stage results that are joined with large rows."""

from pyspark.sql import functions as F

from tabaudit.functions.ks import ks_grid
from tabaudit.functions.lineage import cut, few


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_few_rows_filter_in_the_scan_without_threshold(spark):
    small = cut(spark.range(10).withColumn("k", F.col("id") % 3))
    large = spark.range(1000).select("id")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" in plan(large.join(few(small), "id"))
        assert "BroadcastHashJoin" not in plan(large.join(few(small, 9), "id"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_grid_does_not_shuffle_moved_values(spark, monkeypatch):
    """The last joins of a grid meet every moved value of sample A; no plan may exchange those."""
    n = 20_000
    a = cut(spark.range(n).select(F.lit("p").alias("cid"), F.lit("t").alias("target"), (F.col("id") * 1.0).alias("x"), F.lit(1).cast("long").alias("n")))
    b = cut(spark.range(n).select(F.lit("r").alias("lv"), F.lit("t").alias("target"), (F.col("id") * 1.01).alias("x"), F.lit(1).cast("long").alias("n")))
    grid = spark.createDataFrame([("p", g, float(g), 1.0, True) for g in range(3)], "cid string, g int, d double, r double, exact boolean")
    members = spark.createDataFrame([("p", "r", "t")], "cid string, lv string, target string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = ks_grid(a, b, members.drop("target").withColumn("target", F.lit("t")), grid, problem=["cid"], base=["lv", "target"],
                      edges={"t": [0.0, n / 2, float(n) * 1.01]}, edges_key="target", fine=64)
        text = plan(out)
        assert text.count("BroadcastHashJoin") >= 3
        got = {r["g"]: r["ks"] for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    direct = ks_grid(a, b, members, grid, problem=["cid"], base=["lv", "target"], edges={"t": [0.0, 1.0]}, edges_key="target", direct=True)
    assert got == {r["g"]: r["ks"] for r in direct.collect()}
