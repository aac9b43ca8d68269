"""Draws from a category mix of any size, in blocks."""

from collections import Counter

from pyspark.sql import functions as F

from tabaudit.functions.rng import key_text, uniform
from tabaudit.operators import findings as FD
from tabaudit.operators import repair as R


def test_recategorise_draws_from_any_number_of_categories(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK_ROWS", 1000)
    n = 12_001
    ref = spark.range(n).select("id", F.lit("other").alias("s"), F.concat(F.lit("c"), (F.col("id") % 11_000).cast("string")).alias("cat"))
    hit = spark.range(n, n + 500).select("id", F.lit("bad").alias("s"), F.lit("x").alias("cat"))
    df = ref.unionByName(hit)
    out = {r["id"]: r["cat"] for r in R.repair_recategorise(df, "cat", "s", "bad", ["id"], salt="t").collect()}
    mix = Counter(f"c{i % 11_000}" for i in range(n))
    slots = [c for c, k in sorted(mix.items(), key=lambda kv: (-kv[1], kv[0])) for _ in range(k)]
    u = {r["id"]: r["u"] for r in hit.select("id", uniform(key_text(["id"]), "t").alias("u")).collect()}
    assert len(out) == n + 500
    assert {i: out[i] for i in u} == {i: slots[int(x * n)] for i, x in u.items()}
    assert all(out[i] == f"c{i % 11_000}" for i in range(n))


def test_recategorise_without_reference_changes_nothing(spark):
    df = spark.createDataFrame([(1, "bad", "x"), (2, "other", None)], "id long, s string, cat string")
    assert sorted(R.repair_recategorise(df, "cat", "s", "bad", ["id"]).collect()) == sorted(df.collect())


def test_reference_draws_do_not_depend_on_the_blocks(spark, monkeypatch):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "bad").otherwise("ok").alias("s"), (F.col("id") % 97).cast("double").alias("x"))
    draw = lambda: sorted(map(tuple, R.repair_from_reference(df, "x", F.col("s") == "bad", ["id"]).collect()))
    whole = draw()
    monkeypatch.setattr(R, "BLOCK_ROWS", 100)
    assert draw() == whole


def test_fill_text_draws_what_the_executor_draws(spark):
    mix = {"it's": 0.4, "b\\c": 0.35, "d": 0.25}
    dist = F.create_map(*[F.lit(x) for kv in mix.items() for x in kv])
    found = FD.to_findings(spark.range(1), kind="mnar_missingness", slicer="s", level="bad", target="cat", n=1, confidence="REPAIR",
                           repair={"type": "impute_missing", "dist": dist})
    f = found.withColumn("rank", F.lit(1))
    df = spark.range(400).select("id", (F.col("id") % 7).alias("k2"), F.when(F.col("id") % 2 == 0, "bad").otherwise("ok").alias("s"),
                                 F.when(F.col("id") % 3 == 0, "kept").alias("cat"))
    keys = ["id", "k2"]
    done = R.apply_all(df, f.collect(), keys, seed=5)
    text = R.with_repair_sql(f, keys, seed=5).first()["repair_sql"]
    assert sorted(map(str, done.collect())) == sorted(map(str, df.withColumn("cat", F.expr(text)).collect()))
    assert {r["cat"] for r in done.filter("s = 'bad'").collect()} == {*mix, "kept"}
    assert R.with_repair_sql(f).first()["repair_sql"].startswith("-- draw")
