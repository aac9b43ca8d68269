"""Many repairs at once: repairs as rows of lookup tables, folded per column.

Findings whose repair needs nothing but the row itself become rows (level, steps) of one
small table a slicer. A stage joins these tables to the data and applies the steps of
each column in one expression, in the order of the findings, so the plan grows with the
slicers and columns, not with the findings. The tables hold the findings that the caller
passed in; they are joined without a hint, so Spark copies them to the executors only
below its size limit.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import add

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from tabaudit.functions.predicates import as_number
from tabaudit.functions.rng import key_text, uniform

NUMBERS, FILLS = "numbers", "fills"
STAGE_OF = {"subtract": NUMBERS, "divide": NUMBERS, "divide_window": NUMBERS, "divide_window_multi": NUMBERS, "impute_missing": FILLS}
WINDOWS = ("divide_window", "divide_window_multi")
#: The share from which a category fills every hole.
DOMINANT = 0.75
_STEP = {
    NUMBERS: pa.struct([("pos", pa.int32()), ("minus", pa.float64()), ("by", pa.float64()), ("per", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]),
    FILLS: pa.struct([("pos", pa.int32()), ("salt", pa.string()), ("ladder", pa.list_(pa.struct([("value", pa.string()), ("below", pa.float64())])))]),
}
_DDL = {NUMBERS: "array<struct<pos:int,minus:double,by:double>>", FILLS: "array<struct<pos:int,salt:string,ladder:array<struct<value:string,below:double>>>>"}


def targets_of(f: Row) -> list[str]:
    return list(f["repair"]["targets"] or [f["target"]]) if f["repair"]["type"] in WINDOWS else [f["target"]]


def reads_of(f: Row, keys: Sequence[str]) -> set[str]:
    """Columns other than its targets that a repair looks at."""
    r, draws = f["repair"], f["repair"]["type"] in ("impute_missing", "reimpute_categorical", "impute_from_reference")
    return {c for c in (f["slicer"], f["context"], r["entity_col"], r["time_col"], *(keys if draws else ())) if c is not None}


def salt_of(f: Row, seed: int) -> str:
    return f"{seed}|{f['kind']}|{f['slicer']}|{f['level']}|{f['target']}"


def ladder(dist: Mapping[str, float]) -> list[tuple[str, float]]:
    """Categories with the bound below which a uniform number means them; the dominant one alone if there is one."""
    items = sorted(dist.items(), key=lambda kv: (-kv[1], kv[0]))
    total = reduce(add, dist.values(), 0.0)  # added up in map order, as the SQL text does
    if items[0][1] / total >= DOMINANT:
        return [(items[0][0], 2.0)]
    steps, run = [], 0.0
    for k, v in items:
        run += v / total
        steps.append((k, run))
    return [*steps[:-1], (steps[-1][0], 2.0)]


@dataclass
class Stage:
    """Repairs that see the same state of the columns they look at: one alone (``kind`` None), or any number of one kind."""

    kind: str | None
    found: list[tuple[int, Row]] = field(default_factory=list)
    writes: set[str] = field(default_factory=set)
    reads: set[str] = field(default_factory=set)


def _kind(f: Row) -> str | None:
    """The kind of stage a repair can share; None for those that need other rows or have no level to look up."""
    kind = STAGE_OF.get(f["repair"]["type"])
    level = f["repair"]["entity"] if f["repair"]["type"] in WINDOWS else f["level"]
    known = isinstance(level, str) and (f["context"] is None or isinstance(f["context_level"], str))
    return kind if known else None


def stages(findings: Sequence[Row], keys: Sequence[str]) -> list[Stage]:
    """The findings in stages whose result is that of applying them one by one.

    A repair goes to the earliest stage of its kind that it can reach: it may pass a stage if
    neither writes what the other reads or writes, and join one that does not write what it reads.
    """
    out: list[Stage] = []
    for pos, f in enumerate(findings):
        kind, writes, reads = _kind(f), set(targets_of(f)), reads_of(f, keys)
        home = None
        for s in reversed(out):
            if kind and s.kind == kind and not reads & s.writes:
                home = s
            if writes & (s.writes | s.reads) or reads & s.writes:
                break
        if home is None:
            home = Stage(kind)
            out.append(home)
        home.found.append((pos, f))
        home.writes |= writes
        home.reads |= reads
    return out


def _step(f: Row, pos: int, kind: str, seed: int) -> dict:
    r = f["repair"]
    if kind == FILLS:
        return {"pos": pos, "salt": salt_of(f, seed), "ladder": [{"value": v, "below": b} for v, b in ladder(r["dist"])]}
    if r["type"] == "subtract":
        return {"pos": pos, "minus": float(r["value"])}
    if r["type"] == "divide":
        return {"pos": pos, "by": float(r["value"])}
    return {"pos": pos, "start": r["start"], "end": r["end"], **({"per": float(r["per_year"])} if r["per_year"] else {"by": float(r["factor"])})}


def _lookups(stage: Stage, seed: int) -> dict[tuple, dict[tuple, dict[str, list[dict]]]]:
    """Per side (column, context, time): per level and context level: per target the steps in order."""
    out: dict[tuple, dict[tuple, dict[str, list[dict]]]] = {}
    for pos, f in stage.found:
        r = f["repair"]
        if stage.kind == FILLS and not r["dist"]:
            continue
        if r["type"] in WINDOWS:
            side, at = (r["entity_col"], None, r["time_col"]), (r["entity"], None)
        else:
            side, at = (f["slicer"], f["context"], None), (f["level"], f["context_level"])
        for t in targets_of(f):
            out.setdefault(side, {}).setdefault(at, {}).setdefault(t, []).append(_step(f, pos, stage.kind, seed))
    return out


def _text(c: str) -> Column:
    return F.col(f"`{c}`").cast("string")


def _numbers(steps: Column, time: Column | None) -> Column:
    """Steps as what to subtract or to divide by; of windows, those that hold the row's time."""
    if time is not None:
        steps = F.filter(steps, lambda s: time.between(s["start"], s["end"]))
    by = (lambda s: s["by"]) if time is None else (lambda s: F.coalesce(F.pow(s["per"], time - s["start"] + 1), s["by"]))
    return F.transform(steps, lambda s: F.struct(s["pos"].alias("pos"), s["minus"].alias("minus"), by(s).alias("by")))


def _calculated(x: Column, steps: Column) -> Column:
    return F.aggregate(steps, as_number(x), lambda a, s: F.coalesce(a - s["minus"], a / s["by"]))


def _filled(x: Column, steps: Column, kind: DataType, keys: Sequence[str]) -> Column:
    def draw(s: Column) -> Column:
        return F.get(F.filter(s["ladder"], lambda e: uniform(key_text(keys), s["salt"]) < e["below"]), F.lit(0))["value"].cast(kind)

    return F.aggregate(steps, x, lambda a, s: F.coalesce(a, draw(s)))


def apply_stage(df: DataFrame, stage: Stage, keys: Sequence[str], seed: int) -> DataFrame:
    """All repairs of a stage in one join a slicer and one expression a column."""
    columns, here, steps_of = df.columns, df, {}
    for k, ((column, context, time), levels) in enumerate(_lookups(stage, seed).items()):
        names = sorted({t for steps in levels.values() for t in steps})
        level, other = f"__repair{k}_level", f"__repair{k}_context"
        data = {level: pa.array([a for a, _ in levels], pa.string())}
        if context is not None:
            data[other] = pa.array([c for _, c in levels], pa.string())
        for j, t in enumerate(names):
            data[f"__repair{k}_{j}"] = pa.array([steps.get(t, []) for steps in levels.values()], pa.list_(_STEP[stage.kind]))
        on = _text(column) == F.col(level)
        if context is not None:
            on = on & (_text(context) == F.col(other))
        here = here.join(df.sparkSession.createDataFrame(pa.table(data)), on, "left")
        for j, t in enumerate(names):
            steps = F.col(f"__repair{k}_{j}")
            if stage.kind == NUMBERS:
                steps = _numbers(steps, None if time is None else F.col(f"`{time}`"))
            steps_of.setdefault(t, []).append(F.coalesce(steps, F.array().cast(_DDL[stage.kind])))
    done = {}
    for t, parts in steps_of.items():
        steps = parts[0] if len(parts) == 1 else F.array_sort(F.concat(*parts), lambda a, b: a["pos"] - b["pos"])
        done[t] = _calculated(F.col(f"`{t}`"), steps) if stage.kind == NUMBERS else _filled(F.col(f"`{t}`"), steps, df.schema[t].dataType, keys)
    if not done:
        return df
    return here.withColumns(done).select(*[F.col(f"`{c}`") for c in columns])
