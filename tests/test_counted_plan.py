"""The audit plan counts slicers and categories once; q_gate hashes each row once."""
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tabaudit.functions.lineage import cut
from tabaudit.operators.cube import ROWS, combination_counts, distinct_rows
from tabaudit.plans import audit as A
from tabaudit.sources.clean import column_medians


@pytest.fixture(scope="module")
def df(spark):
    h = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    z = F.when(h % 5 == 0, F.lit(-0.0)).when(h % 5 == 1, F.lit(0.0)).otherwise((h % 3).cast("double"))
    return cut(spark.range(20_000).select("id", F.when(h % 7 > 0, (h % 7).cast("string")).alias("a"), (h % 4).alias("b"), z.alias("z"), (h % 2).cast("int").alias("y")))


def test_counts_of_distinct_rows(df):
    places = [("s", "l", ["a", "b", "z"]), ("t", "v", ["a", "z"])]
    few = distinct_rows(df, ["a", "b", "z"])
    assert few.count() < 500 and few.agg(F.sum(ROWS)).first()[0] == 20_000
    rows, counts = (Counter(map(tuple, combination_counts(t, places).collect())) for t in (df, few))
    assert rows == counts and any(r[1] == "-0.0" for r in rows) and any(r[1] is None for r in rows)


def test_plan_reads_counts(df, monkeypatch):
    seen = []
    for module, name in ((A.P, "best_stratifiers"), (A.categorical, "categorical_audit")):
        plain = getattr(module, name)
        monkeypatch.setattr(module, name, lambda t, *a, plain=plain: seen.append(t.columns) or plain(t, *a))
    A.audit(df.drop("z"), A.AuditConfig(name="t", target="y", row_id=("id",), id_cols=("id",), numeric_features=(), categorical_features=("a",)))
    assert len(seen) == 2 and all(sorted(c) == [ROWS, "a", "b"] for c in seen)


def test_medians_of_counts(df):
    counts = distinct_rows(df.withColumn("x", (F.col("id") % 10).cast("int")), ["x"])
    assert column_medians(counts, ["x"], ROWS) == {"x": 4.5}


def test_written_by_part(df):
    parts = cut(df.withColumn("part", F.when(df.y == 1, "one").otherwise("other")), by="part")
    one = parts.filter("part = 'one'")
    assert parts.columns[-1] == "part" and one.count() == df.filter("y = 1").count()
    assert all("part=one" in r[0] for r in one.select(F.input_file_name()).distinct().collect())
