"""The findings table and its post-processing.

One row per anomaly. ``stats`` holds the numbers that support it, ``repair`` the
mechanism that inverts it (null when there is none).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

STATS = ("ks0", "ks_add", "ks_mul", "tau", "delta", "ratio", "iqr", "sign", "tv", "share_in", "share_out",
         "missing_rate", "frac", "z", "score")
REPAIR_TYPE = ("struct<type:string,value:double,dist:map<string,double>,entity_col:string,entity:string,time_col:string,"
               "start:int,end:int,factor:double,per_year:double,year:int,all_years:array<int>,targets:array<string>>")
REPAIR_FIELDS = ("type", "value", "dist", "entity_col", "entity", "time_col", "start", "end", "factor", "per_year", "year", "all_years", "targets")
TEXT_FIELDS = ("kind", "slicer", "level", "ref", "context", "context_level", "target", "confidence")
SCHEMA_DDL = (
    "kind string, slicer string, level string, ref string, context string, context_level string, target string, "
    "targets array<string>, n bigint, confidence string, notes array<string>, "
    "stats struct<" + ",".join(f"{s}:double" for s in STATS) + ",strata:int>, "
    f"repair {REPAIR_TYPE}, ref_pos int"
)
COLUMNS = ("kind", "slicer", "level", "ref", "context", "context_level", "target", "targets", "n", "confidence", "notes", "stats", "repair", "ref_pos")

# fixed values: order of the kinds in a report
KIND_ORDER = {"categorical_overwrite": 0, "entity_window_growth": 0, "fd_violation": 1, "mnar_missingness": 1, "additive_shift": 2,
              "multiplicative_shift": 3, "collapse": 4, "year_collapse": 5, "window_growth": 6, "rough_series": 7, "unexplained_shift": 8}
NATURAL_KINDS = ("additive_shift", "multiplicative_shift", "collapse", "categorical_overwrite")
MIRROR_KINDS = ("additive_shift", "multiplicative_shift")
DEDUPE_KEY = ("kind", "slicer", "level", "target", "context", "context_level")
MAX_REVIEWS = 8


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], StructType.fromDDL(SCHEMA_DDL))


def _lit(v: Any) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def to_findings(df: DataFrame, *, kind: Any, slicer: Any, level: Any, target: Any, n: Any, confidence: Any,
                stats: Mapping[str, Any] | None = None, repair: Mapping[str, Any] | None = None, repair_if: Column | None = None,
                ref: Any = None, context: Any = None, context_level: Any = None, ref_pos: Any = 0) -> DataFrame:
    """Rows of ``df`` as findings; fields not given are null."""
    given = {"kind": kind, "slicer": slicer, "level": level, "ref": ref, "context": context, "context_level": context_level,
             "target": target, "confidence": confidence}
    cols = [_lit(given[f]).cast("string").alias(f) for f in TEXT_FIELDS[:7]]
    repair, stats = dict(repair or {}), dict(stats or {})
    cols.append(_lit(repair.get("targets")).cast("array<string>").alias("targets"))
    cols.append(_lit(n).cast("bigint").alias("n"))
    cols.append(_lit(confidence).cast("string").alias("confidence"))
    cols.append(F.array().cast("array<string>").alias("notes"))
    values = [_lit(stats.get(s)).cast("double").alias(s) for s in STATS] + [_lit(stats.get("strata")).cast("int").alias("strata")]
    cols.append(F.struct(*values).alias("stats"))
    if repair:
        r = F.struct(*[_lit(repair.get(f)).alias(f) for f in REPAIR_FIELDS]).cast(REPAIR_TYPE)
        cols.append((F.when(repair_if, r) if repair_if is not None else r).alias("repair"))
    else:
        cols.append(F.lit(None).cast(REPAIR_TYPE).alias("repair"))
    cols.append(_lit(ref_pos).cast("int").alias("ref_pos"))
    return df.select(*cols)


def union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def dedupe_findings(findings: DataFrame) -> DataFrame:
    """One finding per (kind, slice, target): that of the first reference."""
    key = [F.coalesce(F.col(c), F.lit("\u0000")) for c in DEDUPE_KEY]
    first = F.row_number().over(Window.partitionBy(*key).orderBy("ref_pos", "ref"))
    return findings.withColumn("_first", first).filter("_first = 1").drop("_first")


def demote_natural(findings: DataFrame, levels: int = 3) -> DataFrame:
    """A mechanism on many levels of one slicer and target is natural structure, not one corrupted slice."""
    family = F.col("kind").isin(list(NATURAL_KINDS))
    n = F.count(F.lit(1)).over(Window.partitionBy("kind", "slicer", "target"))
    hit = family & (F.col("_family") >= levels) & (F.col("confidence") == "REPAIR")
    note = F.concat(F.lit("natural structure: "), F.col("_family").cast("string"), F.lit(" levels"))
    return (
        findings.withColumn("_family", n)
        .withColumn("notes", F.when(hit, F.concat("notes", F.array(note))).otherwise(F.col("notes")))
        .withColumn("confidence", F.when(hit, F.lit("REVIEW")).otherwise(F.col("confidence")))
        .drop("_family")
    )


def mirror_key() -> Column:
    """Identity of a pair of opposite hypotheses (level against ref, ref against level); null if none."""
    pair = F.array_sort(F.array("level", "ref"))
    return F.when(F.col("kind").isin(list(MIRROR_KINDS)) & F.col("ref").isNotNull(),
                  F.concat_ws("\u0001", "kind", "slicer", "target", pair))


def annotate_mirrors(findings: DataFrame) -> DataFrame:
    """Note the findings whose mirror hypothesis is listed too."""
    keyed = findings.withColumn("_mirror", mirror_key())
    n = F.count("_mirror").over(Window.partitionBy("_mirror"))
    hit = F.col("_mirror").isNotNull() & (F.col("_pair") >= 2)
    return (
        keyed.withColumn("_pair", n)
        .withColumn("notes", F.when(hit, F.concat("notes", F.array(F.lit("direction ambiguous: mirror also listed")))).otherwise(F.col("notes")))
        .drop("_pair", "_mirror")
    )


def postprocess(findings: DataFrame) -> DataFrame:
    return annotate_mirrors(demote_natural(findings))


def rank_findings(findings: DataFrame, features: Sequence[str] = ()) -> DataFrame:
    """Add ``rank``: REPAIR first, model features, kind order, larger slices (findings tables are small)."""
    kinds = F.create_map(*[F.lit(x) for kv in KIND_ORDER.items() for x in kv])
    feats = F.array(*[F.lit(f) for f in features]).cast("array<string>")
    on_feature = F.arrays_overlap(F.coalesce(F.col("targets"), F.array("target")), feats)
    order = [
        F.when(F.col("confidence") == "REPAIR", 0).otherwise(1),
        F.when(on_feature, 0).otherwise(1),
        F.coalesce(F.try_element_at(kinds, F.col("kind")), F.lit(9)),
        F.desc("n"),
        F.col("kind"), F.col("slicer"), F.col("target"), F.col("level"), F.col("ref"), F.col("context"), F.col("context_level"),
    ]
    return findings.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)))


def cap_reviews(ranked: DataFrame, reviews: int = MAX_REVIEWS) -> DataFrame:
    """Report: every REPAIR and the best ``reviews`` REVIEW findings."""
    n = F.row_number().over(Window.partitionBy("confidence").orderBy("rank"))
    return ranked.withColumn("_n", n).filter((F.col("confidence") == "REPAIR") | (F.col("_n") <= reviews)).drop("_n")
