"""The downstream model on counted feature rows."""

from pyspark.sql import functions as F

from tabaudit.config import AuditConfig
from tabaudit.operators import evaluate as E

CFG = AuditConfig(name="t", target="y", row_id=("id",), numeric_features=("a", "absent"), categorical_features=("c",), top_k={"c": 2})


def rows(spark, n=3000):
    df = spark.range(n).select(
        "id", F.when(F.col("id") % 11 != 0, (F.col("id") * 7 % 40).cast("double")).alias("a"),
        F.when(F.col("id") % 13 != 0, F.concat(F.lit("v"), F.col("id") % 5)).alias("c"))
    return df.withColumn("y", ((F.coalesce("a", F.lit(0.0)) > 18) != (F.col("id") % 17 == 0)).cast("int"))


def counts(spark):
    return rows(spark).groupBy("y", "a", "c").agg(F.count(F.lit(1)).alias(E.ROWS))


def test_model_reads_counts_not_rows(spark, monkeypatch):
    fitted = []
    plain = E._vectors
    monkeypatch.setattr(E, "_vectors", lambda df, stats: fitted.append(plain(df, stats)) or fitted[-1])
    E.evaluate(rows(spark), rows(spark), CFG)
    distinct = counts(spark).count()
    assert [v.count() for v in fitted] == [distinct, distinct] and distinct < 3000
    assert fitted[0].agg(F.sum(E.ROWS)).first()[0] == 3000


def test_counts_give_the_fit_of_rows(spark):
    one = rows(spark).withColumn(E.ROWS, F.lit(1).cast("long"))  # each row stands for itself
    a, levels_a, stats_a = E.fit_model(one, CFG)
    b, levels_b, stats_b = E.fit_model(rows(spark), CFG)
    assert levels_a == levels_b
    for c in stats_a:
        assert abs(stats_a[c][0] - stats_b[c][0]) < 1e-9 and abs(stats_a[c][1] - stats_b[c][1]) < 1e-9
    assert max(abs(a.coefficients.toArray() - b.coefficients.toArray())) < 1e-5 and abs(a.intercept - b.intercept) < 1e-5
    assert E.evaluate(one, one, CFG) == E.evaluate(rows(spark), rows(spark), CFG)
