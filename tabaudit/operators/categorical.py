"""Categorical audits: broken dependencies, overwritten cells, conditional missingness.

Each audit works on one count table over (context, slicer, target) values, which is
summed up from joint counts of blocks of columns (see ``cube``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabaudit.functions.lineage import cut
from tabaudit.operators.cube import combination_counts
from tabaudit.operators.findings import to_findings
from tabaudit.operators.slices import MIN_N

MIN_ROW = 20
PURE, MIXED = 0.97, 0.90
MINORITY = 0.60
MIN_CONTEXT_ROWS = 30
NULL_LEVEL = "\u0000"
PLACE = ["context", "context_level", "slicer", "target"]


def _cells(df: DataFrame, contexts: Sequence[str | None], slicers: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """Counts per (context, context_level, slicer, level, target, value); null slicers and values are kept as null."""
    counts = combination_counts(df, [("context", "context_level", contexts), ("slicer", "level", slicers), ("target", "value", targets)])
    return counts.filter("context_level is not null")


def _purity(counts: DataFrame) -> DataFrame:
    """Per level: rows, most frequent value and its share; levels with too few rows are dropped."""
    known = counts.filter("level is not null and value is not null")
    g = known.groupBy(*PLACE, "level").agg(
        F.sum("n").alias("n_level"), F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("top"), F.max("n").alias("n_top"))
    return g.filter(F.col("n_level") >= MIN_ROW).withColumn("share", F.col("n_top") / F.col("n_level"))


def _dependencies(purity: DataFrame) -> DataFrame:
    """(slicer, target) pairs where at least two levels are pure: near-functional dependencies."""
    top = purity.filter("context = ''").groupBy("slicer", "target").agg(
        F.count(F.lit(1)).alias("levels"), F.count(F.when(F.col("share") >= PURE, 1)).alias("pure"))
    return top.filter("levels >= 2 and pure >= 2").select("slicer", "target", "pure")


def detect_fd_violation(df: DataFrame, slicers: Sequence[str], targets: Sequence[str], counts: DataFrame | None = None) -> DataFrame:
    """Mixed levels of a near-functional dependency (REVIEW: which value is right needs judgement)."""
    counts = counts if counts is not None else _cells(df, [None], slicers, targets)
    purity = _purity(counts.filter("context = ''"))
    bad = purity.join(_dependencies(purity), ["slicer", "target"]).filter(F.col("share") <= MIXED)
    return to_findings(
        bad, kind="fd_violation", slicer=F.col("slicer"), level=F.col("level"), target=F.col("target"), n=F.col("n_level"), confidence="REVIEW",
        stats={"share_in": F.col("share")}, repair={"type": "flag_fd"},
    )


def overwritten_cells(df: DataFrame, slicers: Sequence[str], targets: Sequence[str], counts: DataFrame | None = None) -> DataFrame:
    """Cells where exactly one level holds one value while its siblings are mixed."""
    if counts is None:
        counts = cut(_cells(df, [None, *slicers], slicers, targets))
    # every row of a context is in each of its (slicer, target) tables
    sizes = counts.groupBy(*PLACE).agg(F.sum("n").alias("rows")).filter((F.col("context") == "") | (F.col("rows") >= 2 * MIN_N)).drop("rows")
    purity = cut(_purity(counts))
    fd = _dependencies(purity).select("slicer", "target")
    pure = (F.col("share") >= PURE) & (F.col("n_level") >= MIN_N)
    cell = purity.join(sizes, PLACE).join(fd, ["slicer", "target"], "left_anti").groupBy(*PLACE).agg(
        F.count(F.lit(1)).alias("levels"), F.count(F.when(pure, 1)).alias("pure"), F.count(F.when(F.col("share") <= MIXED, 1)).alias("mixed"),
        F.max(F.when(pure, F.struct("level", "top", "n_level"))).alias("p"),
    ).filter("levels >= 2 and pure = 1 and mixed >= 1").select(*PLACE, F.col("p.level").alias("lv"), F.col("p.top").alias("top"), F.col("p.n_level").alias("n"))
    cell = cut(cell)
    inside = F.coalesce(F.col("level") == F.col("lv"), F.lit(False))
    mix = counts.withColumnRenamed("n", "m").filter("value is not null").join(cell, PLACE).groupBy(*PLACE, "value").agg(
        F.first("top").alias("top"), F.sum(F.when(inside, F.col("m")).otherwise(0)).alias("a"), F.sum(F.when(~inside, F.col("m")).otherwise(0)).alias("b"))
    tot = mix.groupBy(*PLACE).agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    j = mix.join(tot, PLACE)
    pa, pb = F.col("a") / F.col("ta"), F.col("b") / F.col("tb")
    is_top = F.col("value") == F.col("top")
    rest = j.groupBy(*PLACE).agg(
        F.max(pb).alias("max_out"), F.max(F.when(is_top, pb)).alias("share_out"), F.max(F.when(is_top, pa)).alias("share_in"),
        (F.sum(F.abs(pa - pb)) * 0.5).alias("tv"))
    others = counts.filter("value is not null and context <> ''").withColumnRenamed("context_level", "other_level").withColumnRenamed("n", "m").join(
        cell.drop("n"), ["context", "slicer", "target"]).filter((F.col("level") == F.col("lv")) & (F.col("other_level") != F.col("context_level")))
    others = others.groupBy(*PLACE, "other_level").agg(F.sum("m").alias("t"), F.sum(F.when(F.col("value") == F.col("top"), F.col("m")).otherwise(0)).alias("k"))
    others = others.filter(F.col("t") >= MIN_CONTEXT_ROWS).groupBy(*PLACE).agg(F.percentile(F.col("k") / F.col("t"), F.lit(0.5)).alias("other_share"))
    out = cell.join(rest, PLACE).join(others, PLACE, "left").withColumn("other_share", F.coalesce("other_share", F.lit(0.0)))
    return out.filter((F.col("max_out") <= MIXED) & (F.col("share_out") <= MINORITY) & (F.col("other_share") <= MINORITY))


def detect_overwrite(df: DataFrame, slicers: Sequence[str], targets: Sequence[str], counts: DataFrame | None = None) -> DataFrame:
    """One value written over a (context, slice) cell."""
    c = overwritten_cells(df, slicers, targets, counts)
    has = F.col("context") != ""
    return to_findings(
        c, kind="categorical_overwrite", slicer=F.col("slicer"), level=F.col("lv"), context=F.when(has, F.col("context")),
        context_level=F.when(has, F.col("context_level")), target=F.col("target"), n=F.col("n"), confidence="REPAIR",
        stats={"share_in": F.col("share_in"), "share_out": F.col("share_out"), "tv": F.col("tv")}, repair={"type": "reimpute_categorical"},
    )


def categorical_audit(df: DataFrame, slicers: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """Dependencies and overwrites from one count table."""
    counts = cut(_cells(df, [None, *slicers], slicers, targets))
    return detect_fd_violation(df, slicers, targets, counts).unionByName(detect_overwrite(df, slicers, targets, counts))


def detect_missingness(df: DataFrame, slicers: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """Levels whose values are missing far more often than in a complete reference level.

    ``dist`` is the mix of the missing values that would bring the level back to
    the reference mix; entries of at most 2% are dropped, so it stays short.
    """
    counts = cut(_cells(df, [None], slicers, targets).select("slicer", "level", "target", "value", "n"))
    key = ["slicer", "target"]
    null = F.when(F.col("value").isNull(), F.col("n")).otherwise(0)
    share = counts.groupBy(*key).agg((F.sum(null) / F.sum("n")).alias("all_rate")).filter("all_rate >= 0.02").select(*key)
    level = counts.filter("level is not null").groupBy(*key, "level").agg(F.sum("n").alias("n_level"), (F.sum(null) / F.sum("n")).alias("r"))
    level = level.filter(F.col("n_level") >= MIN_N).join(share, key)
    first = F.min_by(F.struct("level", "r"), F.struct(F.col("r"), F.expr("try_cast(level as double)"), F.col("level")))
    ref = level.groupBy(*key).agg(F.count(F.lit(1)).alias("levels"), first.alias("f")).filter("levels >= 2 and f.r <= 0.03").select(
        *key, F.col("f.level").alias("ref"), F.col("f.r").alias("r_ref"))
    bad = level.join(ref, key).filter((F.col("level") != F.col("ref")) & (F.col("r") >= F.col("r_ref") + 0.15))
    known = counts.filter("level is not null and value is not null")
    mix = known.join(known.groupBy(*key, "level").agg(F.sum("n").alias("t")), [*key, "level"]).select(*key, "level", "value", (F.col("n") / F.col("t")).alias("p"))
    cell = [*key, "level", "ref", "n_level", "r"]
    in_ref = bad.select(*cell).join(mix.withColumnRenamed("level", "ref"), [*key, "ref"]).select(*cell, "value", F.col("p").alias("p_ref"), F.lit(0.0).alias("p_obs"))
    in_obs = bad.select(*cell).join(mix, [*key, "level"]).select(*cell, "value", F.lit(0.0).alias("p_ref"), F.col("p").alias("p_obs"))
    v = in_ref.unionByName(in_obs).groupBy(*cell, "value").agg(F.sum("p_ref").alias("p_ref"), F.sum("p_obs").alias("p_obs"))
    v = v.withColumn("w", F.greatest(F.lit(0.0), (F.col("p_ref") - (1 - F.col("r")) * F.col("p_obs")) / F.col("r")))
    z = v.groupBy(*cell).agg(F.sum("w").alias("z"))
    v = v.join(z, cell).withColumn("p", F.col("w") / F.when(F.col("z") > 0, F.col("z")).otherwise(1.0))
    kept = F.sort_array(F.collect_list(F.when(F.col("p") > 0.02, F.struct("value", "p"))))
    out = v.groupBy(*cell).agg(F.map_from_entries(kept).alias("dist"))
    return to_findings(
        out, kind="mnar_missingness", slicer=F.col("slicer"), level=F.col("level"), ref=F.col("ref"), target=F.col("target"), n=F.col("n_level"),
        confidence="REPAIR", stats={"missing_rate": F.col("r")}, repair={"type": "impute_missing", "dist": F.col("dist")},
    )
