import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabaudit.functions import order_stats as O
from tabaudit.functions.rng import key_text, uniform


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": rng.choice(["hot", "b", "c"], 6000, p=[0.8, 0.15, 0.05]), "x": np.round(rng.lognormal(2, 2, 6000), 2)})
    pdf.loc[pdf.index % 50 == 0, "x"] = None
    return pdf, spark.createDataFrame(pdf.replace({np.nan: None})).repartition(7).cache()


@pytest.mark.parametrize("edges", [None, [0.0], [1.0, 2.0, 50.0]])
def test_quantiles_are_exact_whatever_the_edges(rows, edges):
    pdf, df = rows
    df = df.withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    got = {r["k"]: r for r in O.group_quantiles(df, ["k"], {"lo": 0.0, "q": 0.25, "m": 0.5, "hi": 0.9}, edges=edges).collect()}
    for k, x in pdf.dropna().groupby("k")["x"]:
        assert got[k]["n"] == len(x)
        np.testing.assert_allclose([got[k][c] for c in ("lo", "q", "m", "hi")], x.quantile([0, 0.25, 0.5, 0.9]), rtol=1e-12)


def test_quantiles_of_member_unions(spark, rows):
    pdf, df = rows
    df = df.withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    members = spark.createDataFrame([("not hot", "b"), ("not hot", "c"), ("all", "hot"), ("all", "b"), ("all", "c")], "g string, k string")
    got = {r["g"]: r["m"] for r in O.group_quantiles(df, ["k"], {"m": 0.5}, members=members, group=["g"]).collect()}
    x = pdf.dropna()
    assert got["all"] == pytest.approx(x.x.median())
    assert got["not hot"] == pytest.approx(x[x.k != "hot"].x.median())


def test_bucket_never_decreases(spark):
    edges = [0.0, 1.0, 1.5, 10.0]
    df = spark.range(0, 2000).select(((F.col("id") - 300) / 100).alias("x"))
    b = [r["b"] for r in df.select("x", O.bucket_of(F.col("x"), edges).alias("b")).orderBy("x").collect()]
    assert b == sorted(b) and b[0] == 0


def test_cumulative_matches_a_window(spark, rows):
    _, df = rows
    hist = df.filter("not isnan(x) and x is not null").groupBy("k", "x").agg(F.count(F.lit(1)).alias("n"))
    got = O.cumulative(hist, ["k"], "x", {"n": "c"}, O.bucket_of(F.col("x"), [0.0, 5.0, 20.0]))
    want = hist.withColumn("c", F.sum("n").over(Window.partitionBy("k").orderBy("x")))
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_ordinal_of_hot_groups_matches_row_number(rows):
    _, df = rows
    df = df.filter("not isnan(x) and x is not null").withColumn("id", F.monotonically_increasing_id()).cache()
    plain = O.ordinal_in_group(df, ["k"], ["x", "id"], "rn")
    split = O.ordinal_in_group(df, ["k"], ["x", "id"], "rn", hot_rows=200)
    assert split.exceptAll(plain).count() == 0


def test_chunks_keep_the_neighbours(spark):
    df = spark.range(0, 500).select(F.lit("a").alias("e"), F.col("id").alias("t"), (F.col("id") * F.col("id")).alias("y"))
    w = Window.partitionBy("e", "chunk").orderBy("pos").rowsBetween(-3, 3)
    got = O.chunked_series(df, ["e"], "t", halo=3, chunk=20, hot_rows=100).withColumn("s", F.sum("y").over(w)).filter("own").select("t", "s")
    want = df.select("t", F.sum("y").over(Window.partitionBy("e").orderBy("t").rowsBetween(-3, 3)).alias("s"))
    assert got.count() == 500 and got.exceptAll(want).count() == 0


def test_uniform_depends_on_key_and_salt_only(spark):
    df = spark.range(0, 5000).select("id", uniform(key_text("id"), "s").alias("u"), uniform(key_text("id"), "z").alias("v"))
    again = df.repartition(11)
    assert again.exceptAll(df).count() == 0
    m = df.agg(F.avg("u").alias("m"), F.min("u").alias("lo"), F.max("u").alias("hi"), F.corr("u", "v").alias("c")).first()
    assert abs(m["m"] - 0.5) < 0.02 and m["lo"] >= 0 and m["hi"] < 1 and abs(m["c"]) < 0.05


def test_hot_group_in_text_order(spark):
    df = spark.range(2000).select(F.lit("k").alias("k"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("x"))
    split = O.ordinal_in_group(df, ["k"], ["x"], "rn", hot_rows=100).orderBy("rn").collect()
    assert [r["rn"] for r in split] == list(range(1, 2001))
    assert [r["x"] for r in split] == sorted(f"n{i}" for i in range(2000))


def test_buckets_of_a_skewed_column_are_bounded(spark):
    rng = np.random.default_rng(8)
    x = np.append(rng.lognormal(0, 3, 40_000), [1e12, -1e15])
    df = spark.createDataFrame(pd.DataFrame({"x": x, "z": np.where(rng.random(len(x)) < 0.4, 0.0, x)}))
    edges = O.value_edges(df, ["x", "z"])
    n = df.groupBy(O.bucket_of(F.col("x"), edges["x"]).alias("b")).count().agg(F.max("count")).first()[0]
    assert n <= O.LARGEST * len(x)
    # a value that most rows have keeps its bucket, alone
    z = df.groupBy(O.bucket_of(F.col("z"), edges["z"]).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("z").alias("d")).filter(F.col("n") > O.LARGEST * len(x)).collect()
    assert [r["d"] for r in z] == [1]
    q = {"a": 0.01, "m": 0.5, "b": 0.999, "top": 1.0}
    got = O.group_quantiles(df.withColumn("k", F.lit(1)), ["k"], q, edges=edges["x"]).first()
    np.testing.assert_allclose([got[c] for c in q], np.quantile(x, list(q.values())), rtol=1e-12)


@pytest.mark.parametrize("edges", [None, [0.0], [-1.0, 0.0, 2.0]])
def test_quantiles_of_complements(spark, edges):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"w": rng.integers(0, 3, 3000), "p": rng.choice(list("abcdefgh"), 3000, p=[0.5, 0.2, 0.1, 0.1, 0.04, 0.03, 0.02, 0.01]), "x": np.round(rng.normal(0, 2, 3000), 1)})
    pdf.loc[pdf.p == "b", "x"] += 4.0
    pdf = pd.concat([pdf, pd.DataFrame({"w": [9] * 3, "p": ["a", "b", "b"], "x": [1.0, 2.0, 5.0]}), pd.DataFrame({"w": [10] * 2, "p": ["a", "a"], "x": [1.0, 2.0]})])
    q = {"lo": 0.0, "q": 0.25, "m": 0.5, "hi": 1.0}
    got = {(r["w"], r["p"]): r for r in O.complement_quantiles(spark.createDataFrame(pdf), ["w"], ["p"], q, edges=edges).collect()}
    want = {(w, p): g[g.p != p].x for w, g in pdf.groupby("w") for p in g.p.unique() if (g.p != p).any()}
    assert set(got) == set(want)
    for k, x in want.items():
        assert got[k]["n"] == len(x)
        np.testing.assert_allclose([got[k][c] for c in q], x.quantile(list(q.values())), rtol=1e-12, atol=1e-12)


def test_complements_of_many_parts_are_linear(spark):
    """2,000 parts: what is shuffled is a few rows a part, not a row a pair of parts."""
    df = spark.range(40_000).select((F.col("id") % 2000).alias("p"), F.lit(1).alias("w"), (F.pmod(F.xxhash64("id"), F.lit(9973)) / 7.0).alias("x"))
    out = O.complement_quantiles(df, ["w"], ["p"], {"m": 0.5})
    pdf = df.toPandas()
    got = {r["p"]: r["m"] for r in out.collect()}
    assert len(got) == 2000
    for p in (0, 7, 1999):
        assert got[p] == pytest.approx(pdf[pdf.p != p].x.median(), rel=1e-12)


def test_hot_groups_with_a_constant_first_column_and_a_null_key(spark):
    n = 4000
    df = spark.range(n).select(F.when(F.col("id") % 2 == 0, "k").alias("k"), F.lit("same").alias("a"), F.when(F.col("id") % 7 > 0, F.concat(F.lit("a long text, equal to the last "), F.col("id").cast("string"))).alias("b"), "id")
    plain = O.ordinal_in_group(df, ["k"], ["a", "b", "id"], "rn")
    split = O.ordinal_in_group(df, ["k"], ["a", "b", "id"], "rn", hot_rows=100)
    assert split.count() == n and split.exceptAll(plain).count() == 0
    ranges = O._ordinal_by_ranges(df, ["k"], ["a", "b", "id"], "rn")
    assert ranges.exceptAll(plain).count() == 0
    tasks = df.repartitionByRange(8, "k", "a", "b", "id").select("k", F.spark_partition_id().alias("p")).groupBy("k").agg(F.countDistinct("p").alias("n")).collect()
    assert all(r["n"] > 2 for r in tasks)
