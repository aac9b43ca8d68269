"""Rows the driver tables do not hold: NaN cells, null ids, boolean targets, clashing keys, equal rows."""
import pytest
from pyspark.sql import functions as F

from tabaudit.config import AuditConfig
from tabaudit.operators.evaluate import encode_features
from tabaudit.functions.rng import key_sql, key_text
from tabaudit.operators.verify import align_by_id, align_by_key, cells_differ
from tabaudit.sources.datasets import with_row_id


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(5.0, float("nan")), (float("nan"), None), (5.0, 5.0)], "a double, b double")
    assert [r[0] for r in df.select(cells_differ(F.col("a"), F.col("b"), kind="number")).collect()] == [True, False, False]
    assert [r[0] for r in df.select(cells_differ(F.col("a"), F.col("b"), kind="text")).collect()] == [True, False, False]


def test_null_ids_pair_up(spark):
    df = spark.createDataFrame([(None, "x"), (1, "y")], "id long, v string")
    assert align_by_id(df, df, df, ["id"]).count() == 2


def test_boolean_target(spark):
    df = spark.createDataFrame([(True, 1.0), (False, 2.0)], "t boolean, n double")
    out = encode_features(df, AuditConfig(name="b", target="t", row_id=("n",), numeric_features=("n",)), {})
    assert {(r["label"], r["n"]) for r in out.collect()} == {(1, 1.0), (0, 2.0)}


def test_different_keys_have_different_texts(spark):
    rows = [("1", None), (None, "1"), ("a-b", "c"), ("a", "b-c"), ("a\\", "-c"), ("a\\-", "c"), ("\\", "x"), (None, "x"), ("", "x"), ("1", ""), (None, None)]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select(key_text(["a", "b"]).alias("k"), F.expr(key_sql(["a", "b"])).alias("s")).collect()
    assert len({r["k"] for r in got}) == len(rows) and all(r["k"] == r["s"] for r in got)
    plain = spark.createDataFrame([("x", 3)], "a string, b int").select(key_text(["a", "b"]).alias("k"), key_text("b").alias("one")).first()
    assert tuple(plain) == ("x-3", "3")


def test_row_ids_do_not_depend_on_the_splits(spark):
    df = spark.range(300).select((F.col("id") % 70).alias("a"), F.when(F.col("id") % 3 > 0, "x").alias("b"), (F.col("id") % 5 / 2).alias("c"))
    one, two = (sorted(map(tuple, with_row_id(d).collect()), key=str) for d in (df.repartition(1), df.repartition(7, "b")))
    assert one == two and len({r[-1] for r in one}) == 300


def test_no_shared_key_is_an_error(spark):
    a, b = (spark.createDataFrame([(k, 1)], "k string, v int") for k in "ab")
    with pytest.raises(ValueError, match="no key"):
        align_by_key(a, b, b, ["k"], ["v"], check=True)


def test_distinct_counts_of_few_and_many_values(spark, monkeypatch):
    from tabaudit.operators import profile as P

    df = spark.range(3000).select((F.col("id") % 7).alias("few"), F.col("id").alias("many"), F.when(F.col("id") % 2 == 0, -0.0).otherwise(0.0).alias("zero"),
                                  F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("text"), F.lit(None).cast("string").alias("none"))
    for limit in (5_000, 100, 0):
        monkeypatch.setattr(P, "FEW_VALUES", limit)
        got = {r["column"]: (r["n_distinct"], r["n_null"]) for r in P.column_counts(df).collect()}
        assert got == {"few": (7, 0), "many": (3000, 0), "zero": (1, 0), "text": (2000, 1000), "none": (0, 3000)}
    assert P.column_counts(df.limit(0)).collect()[0]["n_rows"] == 0
