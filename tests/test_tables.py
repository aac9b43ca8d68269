"""Injection, repair, verification, profiling and io on small tables."""
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from tabaudit.config import AuditConfig
from tabaudit.functions.predicates import as_number, slice_complement, slice_pred
from tabaudit.operators import corrupt as X
from tabaudit.operators import profile as P
from tabaudit.operators import repair as R
from tabaudit.operators import stats as A
from tabaudit.operators import verify as V
from tabaudit.sources import clean as C
from tabaudit.sources import io


@pytest.fixture(scope="module")
def base(spark):
    return spark.range(0, 400).select(
        F.col("id"), F.when(F.col("id") % 10 != 9, F.concat(F.lit("s"), (F.col("id") % 4).cast("string"))).alias("s"),
        (F.col("id") % 17).cast("double").alias("x"), F.when(F.col("id") % 3 == 0, "A").otherwise("B").alias("c")).cache()


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(amount=st.integers(-50, 50).filter(bool), factor=st.sampled_from([0.5, 2.0, 10.0]), level=st.sampled_from(["s0", "s1", "s2"]))
def test_inverse_repair_restores_every_cell(base, amount, factor, level):
    rows = slice_pred("s", level)
    dirty, t1 = X.corrupt_shift(base, "x", rows, float(amount), keys=["id"], error="a")
    dirty, t2 = X.corrupt_scale(dirty, "x", rows, factor, keys=["id"], error="b")
    fixed = R.repair_subtract(R.repair_divide(dirty, "x", rows, factor), "x", rows, float(amount))
    rep = {r["column"]: r for r in V.cell_report(V.align_by_id(base, dirty, fixed, ["id"], check=False)).collect()}
    tot = rep["TOTAL"]
    assert tot["injected"] == tot["repaired"] + tot["changed"] + tot["missed"]
    assert tot["missed"] == tot["changed"] == tot["collateral"] == 0
    assert t1.count() == base.filter(rows).count()


def test_null_level_is_in_no_slice(base):
    assert base.filter(slice_pred("s", "s1")).filter("s is null").count() == 0
    assert base.filter(slice_complement("s", "s1")).filter("s is null").count() == 0
    assert base.filter(slice_complement("s", "s1", with_nulls=True)).filter("s is null").count() == base.filter("s is null").count()


def test_exact_fraction(base):
    rows = slice_pred("s", "s2")
    n = base.filter(rows).count()
    _, truth = X.corrupt_null(base, "x", rows, 0.33, keys=["id"], error="e", exact=True)
    assert truth.count() == int(n * 0.33)
    _, none = X.corrupt_null(base, "x", F.lit(False), 0.5, keys=["id"], error="e", exact=True)
    assert none.count() == 0


def test_statuses_and_tolerance(spark):
    rows = [("rep", 1.0, 2.0, 1.0000001), ("miss", 1.0, 2.0, 2.0), ("chg", 1.0, 2.0, 3.0), ("col", 1.0, 1.0, 5.0), ("same", 1.0, 1.0, 1.0), ("nul", None, None, None), ("fill", None, None, 1.0)]
    side = lambda i: spark.createDataFrame([(r[0], r[i]) for r in rows], "k string, x double")
    a = V.align_by_id(side(1), side(2), side(3), ["k"])
    got = {r["k"]: r["status"] for r in V.cell_diff(a).collect()}
    assert got == {"rep": "REPAIRED", "miss": "MISSED", "chg": "CHANGED", "col": "COLLATERAL", "fill": "COLLATERAL"}
    assert {r["k"]: r["status"] for r in V.cell_diff(a, V.STRICT_TOL).collect()}["rep"] == "CHANGED"


def test_alignment_errors(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "x")], "k int, v string")
    with pytest.raises(ValueError, match="several rows"):
        V.align_by_id(b, a, b, ["k"])
    with pytest.raises(ValueError, match="no id column"):
        V.align_by_id(b, b, b, ["nope"])
    with pytest.raises(ValueError, match="share no id"):
        V.align_by_id(b, b.withColumn("k", F.lit(2)), b, ["k"])
    with pytest.raises(ValueError, match="row id"):
        V.align_by_key(b, b, b, [], ["v"])


def test_align_by_key_pairs_duplicates_in_order(spark):
    d = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), ("z", 1, "c")], "k string, o int, v string")
    a = V.align_by_key(d, d, d.filter("v <> 'b'"), ["k"], ["o"]).orderBy("k").collect()
    assert [(r["k"], r["pair_no"], r["dirty"]["v"]) for r in a] == [("k", 1, "a"), ("z", 1, "c")]
    lost = V.unmatched_rows(d, V.align_by_key(d, d, d.filter("v <> 'b'"), ["k"], ["o"])).first()
    assert (lost["lost"], lost["matched"]) == (1, 2)


def test_draws_stay_in_the_slice_and_follow_the_reference(base):
    rows = slice_pred("s", "s1")
    out = R.repair_from_reference(base.withColumn("x", F.when(rows, 999.0).otherwise(F.col("x"))), "x", rows, ["id"])
    assert out.count() == 400 and out.filter(rows & (F.col("x") > 16)).count() == 0
    assert out.filter(~rows).exceptAll(base.filter(~rows)).count() == 0
    alone = R.repair_from_reference(base.filter(rows), "x", rows, ["id"])
    assert alone.filter("x is not null").count() == 0


def test_missing_fill_dominant_and_drawn(base):
    rows = slice_pred("s", "s0")
    holes = base.withColumn("c", F.when(~(rows & (F.col("id") % 8 == 0)), F.col("c")))
    assert R.repair_missing(holes, "c", rows, {"A": 0.8, "B": 0.2}, ["id"]).filter("c is null").count() == 0
    drawn = R.repair_missing(holes, "c", rows, {"A": 0.5, "B": 0.5}, ["id"])
    filled = drawn.filter(rows & (F.col("id") % 8 == 0)).groupBy("c").count().collect()
    assert {r["c"] for r in filled} == {"A", "B"}
    assert R.repair_missing(holes, "c", rows, {}, ["id"]).filter("c is null").count() > 0


@pytest.mark.parametrize("gap, repaired", [(8, True), (9, False)])
def test_interpolation_gap(spark, gap, repaired):
    bad = list(range(1, gap))
    df = spark.createDataFrame([("e", t, 100.0 * t if t in (0, gap) else -1.0) for t in range(gap + 1)], "e string, t int, x double")
    out = {r["t"]: r["x"] for r in R.repair_interpolate(df, "x", "e", "t", bad, bad).collect()}
    assert all(out[t] == (pytest.approx(100.0 * t) if repaired else -1.0) for t in bad)


def test_interpolation_carries_at_most_three(spark):
    df = spark.createDataFrame([("e", t, 5.0 if t == 0 else -1.0) for t in range(6)], "e string, t int, x double")
    bad = [1, 2, 3, 4, 5]
    out = {r["t"]: r["x"] for r in R.repair_interpolate(df, "x", "e", "t", bad, bad).collect()}
    assert [out[t] for t in range(6)] == [5.0, 5.0, 5.0, 5.0, -1.0, -1.0]


def test_roles(spark):
    df = spark.range(0, 100).select(
        "id", (F.col("id") % 2).cast("int").alias("flag"), (F.col("id") % 40).cast("double").alias("forty"), (F.col("id") % 41).alias("many"),
        F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"), F.concat(F.lit("c"), (F.col("id") % 40).cast("string")).alias("cat"),
        F.concat(F.lit("t"), (F.col("id") % 41).cast("string")).alias("txt"), (F.col("id") / 7).alias("y"), F.array("id").alias("arr"))
    cfg = AuditConfig(name="t", target="y", row_id=("id",), id_cols=("id",))
    got = {r["column"]: r["role"] for r in P.infer_roles(df, cfg).collect()}
    assert got == {"id": "id", "flag": "binary", "forty": "numeric_categorical", "many": "numeric", "name": "id", "cat": "categorical", "txt": "text",
                   "y": "target", "arr": "unsupported"}
    assert P.rank_slicers(spark, {"a": 2, "year": 7, "b": 4, "c": 30}, ["a", "year", "b", "c"]) == ["year", "b", "a", "c"]


def test_numbers_and_sentinels(spark):
    df = spark.createDataFrame([("1.5",), ("NaN",), ("x",), ("",), (None,)], "v string")
    assert [r[0] for r in df.select(as_number(F.col("v"))).collect()] == [1.5, None, None, None, None]
    assert C.null_sentinels(spark.createDataFrame([(" ?",), ("a",)], "v string")).filter("v is null").count() == 1
    assert C.canonical_names(spark.createDataFrame([(1,)], "` a-b.c ` int")).columns == ["a_b_c"]


def test_csv_without_header(spark, tmp_path):
    (tmp_path / "n.csv").write_text("1, x, <=50K\n2, ?, >50K\n")
    (tmp_path / "h.csv").write_text("a,b,label\n1, x, <=50K\n")
    names = ["a", "b", "label"]
    assert io.read_table(spark, str(tmp_path / "n.csv"), names=names, label="label").count() == 2
    assert [tuple(r) for r in io.read_table(spark, str(tmp_path / "h.csv"), names=names, label="label").collect()] == [(1, "x", "<=50K")]


def test_versions_and_json(spark, base, tmp_path):
    path = io.write_version(base, str(tmp_path), 3, order=["id"])
    assert path.endswith("/v3") and io.read_table(spark, path).count() == 400
    io.write_findings(base.limit(2), str(tmp_path / "f"))
    assert spark.read.json(str(tmp_path / "f")).count() == 2
    h = spark.createDataFrame([("v0", 0.5, 0), ("v1", 0.7, 1), ("v2", 0.7, 2)], "version string, score double, step int")
    assert io.best_version(h).first()["version"] == "v1"
    assert io.best_version(h.filter("false"), "v9").first()["version"] == "v9"


def test_null_rates_skip_null_levels(base):
    assert A.null_rates(base, "s", "x").count() == 4


def test_frozen_repairs_on_a_stream(spark, base, tmp_path):
    from tabaudit.operators import findings as FD
    from tabaudit.streaming import repair_stream

    f = FD.to_findings(spark.range(1), kind="additive_shift", slicer="s", level="s1", target="x", n=1, confidence="REPAIR", repair={"type": "subtract", "value": 2.0}).collect()
    base.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(base.schema).parquet(str(tmp_path / "in"))
    q = repair_stream(stream, f, ["id"]).writeStream.format("memory").queryName("fixed").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    want = R.repair_subtract(base, "x", slice_pred("s", "s1"), 2.0)
    assert spark.table("fixed").exceptAll(want).count() == 0 and spark.table("fixed").count() == 400
    bad = [Row(**{**f[0].asDict(), "repair": Row(type="impute_from_reference")})]
    with pytest.raises(ValueError, match="need other rows"):
        repair_stream(stream, bad, ["id"])
