"""Counts by marginalisation against plain counting, with one block and with many."""
from collections import Counter
from itertools import product

import pytest

from tabaudit.operators.cube import _groups, blocks_of, combination_counts

COLUMNS = ["a", "b", "c d", "many", "hole"]
PLACES = [("context", "context_level", [None, "a", "b", "c d"]), ("slicer", "level", ["a", "b", "c d"]), ("target", "value", ["c d", "many", "hole", "a"])]


@pytest.fixture(scope="module")
def rows():
    # one value of "a" holds most rows; "hole" is mostly null, and some rows repeat
    out = [("hot" if i % 3 else f"a{i % 4}", i % 5, f"{i % 2}", f"id{i // 2}", None if i % 6 else "x") for i in range(400)]
    return [*out, *out[:50], (None, None, None, None, None)]


def plain(rows, places):
    at, text = {c: i for i, c in enumerate(COLUMNS)}, lambda v: None if v is None else str(v)
    value = lambda r, c: "" if c is None else text(r[at[c]])
    combos = [cs for cs in product(*[cols for _, _, cols in places]) if len(set(cs)) == len(cs)]
    return Counter(tuple(x for c in cs for x in (c or "", value(r, c))) for r in rows for cs in combos)


@pytest.mark.parametrize("spare", [1e-9, 8, 1e9])
@pytest.mark.parametrize("places", [PLACES, PLACES[1:], PLACES[:1], [("context", "context_level", [None]), *PLACES[1:]]])
def test_counts_are_those_of_the_rows(spark, rows, places, spare):
    df = spark.createDataFrame(rows, "a string, b int, `c d` string, many string, hole string").repartition(3)
    got = {tuple(r)[:-1]: r["n"] for r in combination_counts(df, places, spare).collect()}
    assert got == dict(plain(rows, places))


def test_an_empty_table_and_no_columns(spark):
    none = spark.createDataFrame([], "a string, b int, `c d` string, many string, hole string")
    assert combination_counts(none, PLACES).count() == 0
    out = combination_counts(none, [("slicer", "level", []), ("target", "value", ["a"])])
    assert out.columns == ["slicer", "level", "target", "value", "n"] and out.count() == 0


def test_columns_of_few_values_share_a_block():
    assert blocks_of({"a": 3, "b": 4, "id": 1000, "c": 2}, 24) == [["c", "a", "b"], ["id"]]
    assert blocks_of({"a": 30, "b": 40}, 24) == [["a"], ["b"]]


def test_groups_are_never_more_than_the_unordered_triples():
    home = {c: i for i, c in enumerate("abcdef")}  # each column a block of its own
    groups = _groups([list("abcdef")] * 3, home)
    assert len(groups) == 20 and sum(map(len, groups.values())) == 6**3  # 6 choose 3, and every ordered triple answered once


def test_few_groups_for_many_columns_of_few_values(spark):
    """Twelve columns, 132 ordered pairs: six joint counts answer for all of them."""
    df = spark.range(20_000).selectExpr(*[f"id % {2 + k % 2} as s{k}" for k in range(12)])
    out = combination_counts(df, [("slicer", "a", df.columns), ("stratifier", "b", df.columns)])
    assert out.agg({"n": "sum"}).first()[0] == 20_000 * 12 * 11
    blocks = blocks_of({c: 2 + k % 2 for k, c in enumerate(df.columns)}, (20_000 / 8) ** 0.5)
    assert len(_groups([df.columns] * 2, {c: i for i, b in enumerate(blocks) for c in b})) <= 6
