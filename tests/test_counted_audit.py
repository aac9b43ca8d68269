"""The numeric audit reads counts of distinct rows where these are few; the result is that over the rows."""
import pytest
from pyspark.sql import functions as F

from tabaudit.operators import slices as S

STRATA = {"s": "k", "k": None}


@pytest.fixture(scope="module")
def df(spark):
    """Nine levels, the third moved by 20; nulls in every column."""
    h = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    s = F.when(h % 101 > 0, (h % 9).cast("string"))
    k = F.when(F.shiftright(h, 7) % 53 > 0, F.shiftright(h, 7) % 5)
    x = F.when(F.shiftright(h, 12) % 47 > 0, (F.shiftright(h, 12) % 30).cast("double") + F.when(s == "3", 20.0).otherwise(0.0))
    return spark.range(60_000).select("id", s.alias("s"), k.alias("k"), x.alias("x"))


def test_counts(df):
    few = S.counted(df, ["s", "k"], ["x"], STRATA)
    assert S.ROWS in few.columns and "id" not in few.columns
    assert few.agg(F.sum(S.ROWS)).first()[0] == 60_000
    assert few.count() == df.select("s", "k", "x").distinct().count() < 3_000
    assert S.ROWS not in S.counted(df, ["s"], ["id"], {}).columns


def test_cells_are_those_of_the_rows(df):
    def cells(t):
        whole, _, c = S.prepare(t, ["s", "k"], ["x"], STRATA)
        members = {tuple(r) for r in S.members_of(t, c, c).collect()}
        return whole, members, {r["cid"]: r.asDict() for r in c.collect()}

    (w0, m0, rows), (w1, m1, counts) = cells(df), cells(S.counted(df, ["s", "k"], ["x"], STRATA))
    assert w0 == w1 == {"x": True} and m0 == m1 and rows.keys() == counts.keys() and len(rows) == 9 + 20
    for cid, r in rows.items():
        for c, v in r.items():
            assert counts[cid][c] == (pytest.approx(v, rel=1e-9) if isinstance(v, float) else v), (cid, c)


def test_audit_reads_counts(df, monkeypatch):
    def found():
        out = S.numeric_audit(df, ["s"], ["x"], row_id=["id"], strata=STRATA, opt=S.SliceOptions(draws=20)).collect()
        return [(r.kind, r.level, r.n, r.stats.delta, r.stats.ks0, r.stats.ks_add, r.stats.tau) for r in out]

    seen, plain = [], S.prepare
    monkeypatch.setattr(S, "prepare", lambda t, *a, **k: seen.append(S.ROWS in t.columns) or plain(t, *a, **k))
    with_counts = found()
    assert seen == [True]
    monkeypatch.setattr(S, "COUNTED_SHARE", 0.0)
    assert with_counts == found() and [r[:2] for r in with_counts] == [("additive_shift", "3")]
