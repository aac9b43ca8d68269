"""Counts of the value combinations of many pairs or triples of columns, by marginalisation.

Columns are dealt into blocks. Rows are counted once for each group of blocks (as many
blocks as there are places), and the counts of single pairs or triples are sums over these
joint counts. Blocks are filled so that a group has at most a ``SPARE``-th as many possible
combinations as there are rows: few rows of joint counts are multiplied by the pairs, not the
table's rows. Columns of few values share one block and one joint count; a column of many
values is a block of its own, and then a group is a single pair or triple, counted once
whichever of its columns takes which place.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabaudit.functions.lineage import cut

SPARE = 8
ROWS = "__rows__"  # rows of the table that a row of counts stands for


def _text(c: str | None) -> Column:
    return F.lit("") if c is None else F.col(f"`{c}`").cast("string")


def _sizes(df: DataFrame, columns: Sequence[str | None]) -> tuple[int, dict[str | None, int]]:
    """Rows, and about how many values each column has, null included."""
    aggs = [F.approx_count_distinct(F.coalesce(_text(c), F.lit("\u0000"))).alias(f"d{i}") for i, c in enumerate(columns)]
    row = df.agg(F.count(F.lit(1)).alias("n"), *aggs).first()
    return row["n"], {c: row[f"d{i}"] for i, c in enumerate(columns)}


def blocks_of(distinct: Mapping[str | None, int], cells: float) -> list[list[str | None]]:
    """Columns in blocks of at most ``cells`` possible combinations, columns of few values first; a column beyond it stands alone."""
    blocks: list[list[str | None]] = []
    size = 1
    for c in sorted(distinct, key=lambda c: (distinct[c], c or "")):
        d = max(1, distinct[c])
        if blocks and size * d <= cells:
            blocks[-1].append(c)
            size *= d
        else:
            blocks.append([c])
            size = d
    return blocks


def _groups(places: Sequence[Sequence[str | None]], home: Mapping[str | None, int]) -> dict[tuple[int, ...], list[tuple[int, ...]]]:
    """Groups of blocks to count, each with the block of every place that it answers for; a group inside another one is left to that one."""
    duties: dict[tuple[int, ...], list[tuple[int, ...]]] = {}
    for duty in product(*[sorted({home[c] for c in cols}) for cols in places]):
        duties.setdefault(tuple(sorted(set(duty))), []).append(duty)
    for small in sorted(duties, key=len):
        wide = next((g for g in duties if len(g) > len(small) and set(small) < set(g)), None)
        if wide:
            duties[wide] += duties.pop(small)
    return duties


def distinct_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The distinct rows of some columns, with their number in ``ROWS``; written."""
    # a group holds 0.0 and -0.0, which are two texts
    kinds = dict(df.dtypes)
    keys = [_text(c).alias(c) if kinds[c] in ("float", "double") else F.col(f"`{c}`") for c in columns]
    return cut(df.groupBy(*keys).agg(F.count(F.lit(1)).alias(ROWS)))


def combination_counts(df: DataFrame, places: Sequence[tuple[str, str, Sequence[str | None]]], spare: float = SPARE) -> DataFrame:
    """Rows per combination of one column a place and their values.

    A place is (output for the column's name, output for its value, columns); None stands for
    the whole table, with '' as name and value. A column is never combined with itself. Values
    are text, nulls are values. Columns: the outputs of the places, and ``n``. A row with
    ``ROWS`` counts so many times.
    """
    columns = list(dict.fromkeys(c for _, _, cols in places for c in cols))
    outputs = [o for name, level, _ in places for o in (name, level)]
    if not all(cols for _, _, cols in places):
        return df.sparkSession.createDataFrame([], ", ".join(f"`{o}` string" for o in outputs) + ", n long")
    rows, distinct = _sizes(df, columns)
    free = max(1, sum(len(cols) > 1 for _, _, cols in places))
    blocks = blocks_of(distinct, max(1.0, rows / spare) ** (1 / free))
    home = {c: i for i, b in enumerate(blocks) for c in b}
    at = {c: i for i, c in enumerate(columns)}
    sums = []
    for members, duties in _groups([cols for _, _, cols in places], home).items():
        of = [c for b in members for c in blocks[b]]
        place = {c: i for i, c in enumerate(of)}
        answers = [{f"p{k}": [{"c": c or "", "i": place[c]} for c in cols if home[c] == b] for k, ((_, _, cols), b) in enumerate(zip(places, duty))} for duty in duties]
        sums.append({"g": len(sums), "take": [at[c] for c in of], "duties": answers})
    # the plan stays of one size whatever the number of columns: what to count is one literal
    sides = ",".join(f"p{k}:array<struct<c:string,i:int>>" for k in range(len(places)))
    what = F.from_json(F.lit(json.dumps(sums)), f"array<struct<g:int,take:array<int>,duties:array<struct<{sides}>>>>")
    weight = F.col(ROWS) if ROWS in df.columns else F.lit(1).cast("long")
    one = df.select(F.array(*map(_text, columns)).alias("row"), weight.alias("w")).select("row", "w", F.explode(F.transform(what, lambda s: F.struct(s["g"], s["take"]))).alias("s"))
    counts = one.groupBy(F.col("s.g").alias("g"), F.transform("s.take", lambda i: F.get("row", i)).alias("v")).agg(F.sum("w").alias("n"))
    long = counts.select("v", "n", F.explode(F.get(what, F.col("g"))["duties"]).alias("d"))
    for k in range(len(places)):
        long = long.select("*", F.explode(f"d.p{k}").alias(f"q{k}"))
        for j in range(k):
            long = long.filter(F.col(f"q{k}.c") != F.col(f"q{j}.c"))
    flat = [c for k, (name, level, _) in enumerate(places) for c in (F.col(f"q{k}.c").alias(name), F.get("v", F.col(f"q{k}.i")).alias(level))]
    return long.select(*flat, "n").groupBy(*outputs).agg(F.sum("n").alias("n"))
