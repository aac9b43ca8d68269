"""The fixed downstream model: split, encode, fit, score.

A model sees only the features and the label, so a table is first counted by them: its
distinct feature rows, each with its number of rows. Encoder, fit and score read these
counts, however often they iterate, and the table itself is read once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType
from pyspark.sql.window import Window

from tabaudit.config import AuditConfig
from tabaudit.functions.lineage import cut
from tabaudit.functions.predicates import as_number
from tabaudit.functions.rng import key_text, uniform
from tabaudit.operators.corrupt import smallest
from tabaudit.sources.clean import column_medians, feature_view

DEFAULT_TOP_K = 10
OTHER = "OTHER"
ROWS = "__rows__"  # rows of the table that a distinct feature row stands for


def _parts(df: DataFrame, u: Column, bounds: Sequence[tuple[str, float]]) -> DataFrame:
    out = None
    for name, hi in bounds[:-1]:
        out = F.when(u < F.lit(hi), name) if out is None else out.when(u < F.lit(hi), name)
    return df.withColumn("part", out.otherwise(bounds[-1][0]))


def _exact_parts(df: DataFrame, cfg: AuditConfig, seed: int, bounds: Sequence[tuple[str, float]]) -> DataFrame:
    """Exact shares within each label: cuts are exact order statistics of the hash."""
    u = uniform(key_text(cfg.row_id), f"split-{seed}")
    part = F.lit(bounds[-1][0])
    for row in df.groupBy(cfg.target).count().collect():  # one row per class label
        label = F.col(cfg.target).eqNullSafe(F.lit(row[0]))
        for name, hi in reversed(bounds[:-1]):
            part = F.when(smallest(df, u, label, int(row["count"] * hi), row["count"]), name).otherwise(part)
    return df.withColumn("part", part)


def split2(df: DataFrame, cfg: AuditConfig, seed: int = 42, test: float = 0.3, exact: bool = False) -> DataFrame:
    """Column ``part``: test (a share of ``test`` of every label) or train."""
    bounds = [("test", test), ("train", 1.0)]
    return _exact_parts(df, cfg, seed, bounds) if exact else _parts(df, uniform(key_text(cfg.row_id), f"split-{seed}"), bounds)


def split3(df: DataFrame, cfg: AuditConfig, seed: int = 42, exact: bool = False) -> DataFrame:
    """Column ``part``: 20% test, 20% validation, 60% train."""
    bounds = [("test", 0.2), ("validation", 0.4), ("train", 1.0)]
    return _exact_parts(df, cfg, seed, bounds) if exact else _parts(df, uniform(key_text(cfg.row_id), f"split-{seed}"), bounds)


def feature_counts(df: DataFrame, cfg: AuditConfig) -> DataFrame:
    """The distinct rows of the label and the features, with their number in ``ROWS``; written."""
    if ROWS in df.columns:
        return df
    names = dict.fromkeys(c for c in (cfg.target, *cfg.numeric_features, *cfg.categorical_features) if c in df.columns)
    return cut(df.groupBy(*names).agg(F.count(F.lit(1)).alias(ROWS)))


def _weight(df: DataFrame) -> Column:
    return F.col(ROWS) if ROWS in df.columns else F.lit(1)


def top_k_levels(df: DataFrame, k: Mapping[str, int]) -> DataFrame:
    """The k most frequent values of each column (null counts as OTHER, which is dropped after the cut)."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit(OTHER)).alias("value")) for c in k])
    counts = df.select(F.explode(cells).alias("e"), _weight(df).alias("w")).groupBy("e.column", "e.value").agg(F.sum("w").alias("n"))
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))
    most = counts.withColumn("rank", rank).filter(F.col("rank") <= max(k.values()))
    limit = F.create_map(*[F.lit(x) for kv in k.items() for x in kv])
    return most.filter((F.col("rank") <= limit[F.col("column")]) & (F.col("value") != OTHER))


def learn_levels(train: DataFrame, cfg: AuditConfig) -> dict[str, list[str]]:
    """One-hot levels per categorical feature (a handful per column)."""
    have = [c for c in cfg.categorical_features if c in train.columns]
    levels: dict[str, list[str]] = {c: [] for c in cfg.categorical_features}
    if have:
        top = top_k_levels(train, {c: cfg.top_k.get(c, DEFAULT_TOP_K) for c in have}).collect()
        for r in sorted(top, key=lambda r: (r["column"], r["rank"])):
            levels[r["column"]].append(r["value"])
    return levels


def encode_features(df: DataFrame, cfg: AuditConfig, levels: Mapping[str, Sequence[str]]) -> DataFrame:
    """``label`` and one number per feature, in name order.

    Numbers are filled with this frame's own medians, then 0; categories become
    0/1 columns for the given levels and OTHER. ``ROWS`` is kept, if the frame has it.
    """
    target = F.col(cfg.target)
    if isinstance(df.schema[cfg.target].dataType, BooleanType):
        target = target.cast("int")
    label = F.coalesce(as_number(target.cast("string")), F.lit(0.0)).cast("int").alias("label")
    numbers = [c for c in cfg.numeric_features if c in df.columns]
    kept = [c for c in (ROWS,) if c in df.columns]
    medians = column_medians(df, numbers, *kept)
    view = feature_view(df.withColumn("label", label), cfg.numeric_features, cfg.categorical_features, keep=["label", *kept])
    cols: dict[str, Column] = {}
    for c in cfg.numeric_features:
        cols[c] = F.coalesce(F.col(c), F.lit(medians.get(c)).cast("double"), F.lit(0.0))
    for c, known in levels.items():
        value = F.when(F.col(c).isin(list(known)), F.col(c)).otherwise(OTHER)
        for lv in [*known, OTHER]:
            cols[f"{c}={lv}"] = (value == lv).cast("double")
    return view.select("label", *[cols[n].alias(n) for n in sorted(cols)], *kept)


def f1_score(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """F1 of class 1 (0 when undefined), one aggregate."""
    y, p = F.col(label) == 1, F.col(prediction) == 1
    tp, fp, fn = (F.coalesce(F.sum(F.when(c, _weight(df))), F.lit(0)) for c in (y & p, ~y & p, y & ~p))
    return df.agg(F.coalesce(F.try_divide(2.0 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1"))


def _standardiser(train: DataFrame) -> dict[str, tuple[float, float]]:
    names = [c for c in train.columns if c not in ("label", ROWS)]
    x, w = [F.col(f"`{c}`") for c in names], F.col(ROWS)
    mean = train.agg(*[F.sum(w * v) / F.sum(w) for v in x]).first() or ()
    means = [m or 0.0 for m in mean]
    spread = train.agg(*[F.sqrt(F.sum(w * (v - m) * (v - m)) / F.sum(w)) for v, m in zip(x, means)]).first() or ()
    return {c: (m, s or 1.0) for c, m, s in zip(names, means, spread)}


def _vectors(df: DataFrame, stats: Mapping[str, tuple[float, float]]) -> DataFrame:
    z = [((F.col(f"`{c}`") - F.lit(m)) / F.lit(s)).alias(f"z{i}") for i, (c, (m, s)) in enumerate(stats.items())]
    flat = df.select("label", F.col(ROWS).cast("double").alias(ROWS), *z)
    return VectorAssembler(inputCols=flat.columns[2:], outputCol="features").transform(flat).select("label", ROWS, "features")


def fit_model(train: DataFrame, cfg: AuditConfig):
    """Standardised, L2-penalised logistic regression (C = 1): the model and its encoder state."""
    train = feature_counts(train, cfg)
    levels = learn_levels(train, cfg)
    enc = encode_features(train, cfg, levels)
    stats = _standardiser(enc)
    data = _vectors(enc, stats).persist()
    try:
        n = data.agg(F.sum(ROWS)).first()[0] or 0.0
        lr = LogisticRegression(weightCol=ROWS, regParam=1.0 / max(n, 1.0), elasticNetParam=0.0, standardization=False, maxIter=2000, tol=1e-9)
        model = lr.fit(data)
    finally:
        data.unpersist()
    return model, levels, stats


def evaluate(train: DataFrame, test: DataFrame, cfg: AuditConfig) -> float:
    """F1 on ``test`` of the fixed model trained on ``train``; both as rows or as ``feature_counts``."""
    model, levels, stats = fit_model(train, cfg)
    scored = model.transform(_vectors(encode_features(feature_counts(test, cfg), cfg, levels), stats))
    return float(f1_score(scored).first()["f1"])
