"""What the seed sweep leaves on disk, and how the protocol deals rows out without joins."""
import os

from pyspark.sql import functions as F

from tabaudit.config import AuditConfig
from tabaudit.functions.lineage import cut, stage_dir
from tabaudit.operators.evaluate import split3
from tabaudit.plans import gate as G

CFG = AuditConfig(name="t", target="y", row_id=("k", "j"), numeric_features=("x",), categorical_features=(), id_cols=("k",))


def test_sweep_removes_what_a_seed_wrote(spark, monkeypatch):
    def one(clean, inject, cfg, seed, **kw):
        return cut(clean.select(F.lit(seed).alias("seed"), "x").limit(1))

    monkeypatch.setattr(G, "run_seed", one)
    clean = cut(spark.range(9).select(F.col("id").alias("x")))
    folder = stage_dir(spark).removeprefix("file:").replace("///", "/")
    before = set(os.listdir(folder))
    out = G.seed_sweep(clean, None, CFG, (1, 2))
    assert sorted(r["seed"] for r in out.collect()) == [1, 2]
    assert set(os.listdir(folder)) == before
    assert clean.count() == 9


def test_parts_are_those_of_the_join(spark):
    """Repeated identities count as often as a join with all identities has them, null ones drop out."""
    rows = [(k, j, float(k or 0), k == 3) for k in [*range(40), 3, 3, 7, None] for j in ("a", "b")] + [(5, None, 1.0, True)]
    df = spark.createDataFrame(rows, "k long, j string, x double, part boolean")
    ids = split3(df.select("k", "j"), CFG, 42)
    got = G.with_repeats(G.with_part(df, CFG, 42), ["k", "j"])
    for part in ("train", "validation", "test"):
        want = df.join(ids.filter(F.col("part") == part).select("k", "j"), ["k", "j"])
        mine = got.filter(F.col(G.PART) == part).drop(G.PART)
        assert mine.columns == want.columns
        assert sorted(mine.collect()) == sorted(want.collect())
