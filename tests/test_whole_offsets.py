"""Offsets of whole numbers: the grid misses the right one, the whole numbers beside the rounded one do not."""
import pytest

from tabaudit.operators import slices as S


@pytest.mark.parametrize("steps, delta, ks", [(0, 11.0, 0.02), (1, 10.0, 0.0), (2, 10.0, 0.0)])
def test_refined_offset(spark, steps, delta, ks):
    base = spark.createDataFrame([("s", "0", "x", float(x), 20) for x in range(1, 51)], "slicer string, level string, target string, x double, n long")
    moved = spark.createDataFrame([("c", "A", "x", float(x + 10), 4) for x in range(1, 51)], "cid string, part string, target string, x double, n long")
    members = spark.createDataFrame([("c", "s", "0", "x")], "cid string, slicer string, level string, target string")
    problems = spark.createDataFrame([("c", "A", 11.0, 14.4, True)], "cid string, part string, d0 double, scale double, whole boolean")
    fit = S.Refiner(base, members, moved, {"x": [10.0, 20.0, 30.0, 40.0]}, 50, S.SliceOptions(whole_steps=steps)).refine(problems).first()
    assert (fit["delta"], fit["ks_fit"]) == (delta, pytest.approx(ks, abs=1e-12))
