"""The full audit: profile, all detectors, post-processing, report."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tabaudit.config import AuditConfig
from tabaudit.functions.lineage import cut
from tabaudit.operators import categorical, panel
from tabaudit.operators import findings as FD
from tabaudit.operators import profile as P
from tabaudit.operators.cube import distinct_rows
from tabaudit.operators.slices import COUNTED_SHARE, SliceOptions, numeric_audit


@dataclass
class AuditResult:
    findings: DataFrame
    roles: P.Roles
    slicers: list[str]

    @property
    def report(self) -> DataFrame:
        """The short view: every REPAIR and the best REVIEW findings."""
        return FD.cap_reviews(self.findings)


def panel_findings(df: DataFrame, cfg: AuditConfig, numerics: list[str]) -> DataFrame:
    ent, t = cfg.entity_col, cfg.time_col
    nums = [c for c in numerics if c != t]
    windows = cut(panel.detect_window_growth(df, ent, t, nums))
    windows = panel.demote_mass_windows(cut(panel.merge_entity_windows(windows, ent, t)))
    return FD.union([panel.detect_period_collapse(df, ent, t, nums), windows, panel.detect_rough_series(df, ent, t, nums)])


def audit(df: DataFrame, cfg: AuditConfig, *, opt: SliceOptions = SliceOptions(), approx: bool = False) -> AuditResult:
    """All findings of one table, ranked; ``report`` of the result is the short view."""
    work, roles = P.roles_of(df, cfg, approx)
    slicers = P.rank_slicers(df.sparkSession, roles.distinct, roles.slicers)
    cats = [c for c in roles.categoricals if c != cfg.target]
    few = [c for c in cats if 2 <= roles.distinct[c] <= 12]
    # slicers and categories have few combinations: they are counted once
    levels = list(dict.fromkeys([*slicers, *few]))
    combinations = math.prod(roles.distinct[c] + 1 for c in levels)
    seen = distinct_rows(work, levels) if levels and combinations <= roles.n_rows * COUNTED_SHARE else work
    strata = {r["slicer"]: r["stratifier"] for r in P.best_stratifiers(seen, slicers, roles.distinct).collect()}  # one row a slicer
    parts = []
    numerics = [c for c in roles.numerics if c not in slicers]
    if slicers and numerics:
        parts.append(numeric_audit(work, slicers, numerics, row_id=cfg.row_id, strata=strata, label=cfg.target, opt=opt))
    if slicers and few:
        parts.append(categorical.categorical_audit(seen, slicers, few))
    texts = [c for c, r in roles.role.items() if r == "text"]
    holes = [c for c in cats + texts if roles.nulls[c] >= 0.02 * roles.n_rows and isinstance(work.schema[c].dataType, StringType)]
    if slicers and holes:
        parts.append(categorical.detect_missingness(seen if set(holes) <= set(levels) else work, slicers, holes))
    if cfg.entity_col and cfg.time_col and cfg.entity_col in df.columns:
        parts.append(panel_findings(work, cfg, roles.numerics))
    if not parts:
        return AuditResult(FD.empty(df.sparkSession).withColumn("rank", F.lit(0)), roles, slicers)
    raw = cut(FD.union(parts))
    ranked = FD.rank_findings(FD.postprocess(raw), cfg.features)
    return AuditResult(cut(ranked), roles, slicers)
