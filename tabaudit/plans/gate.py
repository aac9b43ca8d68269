"""Keeping only the repairs that do not hurt a fixed downstream model.

The loop over findings runs on the driver because every decision depends on the
one before; each trial is a Spark job over the whole table, and only scores come
back. An accepted table is written once, so lineage does not grow.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tabaudit.config import AuditConfig
from tabaudit.functions.lineage import cut, few, scratch
from tabaudit.operators import findings as FD
from tabaudit.operators.evaluate import evaluate, feature_counts, split3
from tabaudit.operators.repair import REVIEW_ONLY, apply_all
from tabaudit.operators.slices import SliceOptions
from tabaudit.operators.verify import STRICT_TOL, align_by_id, cell_report, restoration_report
from tabaudit.plans.audit import audit

GOAL_MARGIN = 0.03
HISTORY = "step int, version string, score double, accepted boolean, kind string, slicer string, level string, target string"


@dataclass
class Evaluator:
    """Scores submitted tables on a held-out set and remembers them."""

    test: DataFrame
    cfg: AuditConfig
    history: list[tuple] = field(default_factory=list)
    best_score: float | None = None
    best_version: str | None = None

    def __post_init__(self) -> None:
        self.test = feature_counts(self.test, self.cfg)

    def submit(self, df: DataFrame, version: str, finding: Row | None = None) -> float:
        """Score a table; a table without the target column is rejected."""
        if self.cfg.target not in df.columns:
            raise ValueError(f"the submitted table lacks the target column {self.cfg.target!r}")
        score = evaluate(df, self.test, self.cfg)
        what = [finding[c] if finding else None for c in ("kind", "slicer", "level", "target")]
        self.history.append([len(self.history), version, score, False, *what])
        if self.best_score is None or score > self.best_score:
            self.best_score, self.best_version = score, version
        return score

    def accept(self) -> None:
        self.history[-1][3] = True

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(h) for h in self.history], HISTORY)


@dataclass
class GateResult:
    cleaned: DataFrame
    kept: list[Row]
    score: float
    history: DataFrame


@dataclass(frozen=True)
class Rule:
    """Which findings are tried, in which order, and what score lets a repair stay.

    A repair stays when its score reaches the bar plus ``margin`` (``above``: exceeds it). The
    bar is the best score so far, or with ``follow`` that of the last accepted table.
    """

    margin: float
    above: bool
    follow: bool
    audits: int
    confidences: tuple[str, ...]
    features_first: bool
    one_direction: bool  # a pair of levels is moved in one direction only
    pass_failing: bool  # a repair that fails is passed over

    def stays(self, score: float, bar: float) -> bool:
        wanted = bar + self.margin
        return score > wanted if self.above else score >= wanted


def strict_rule(tol: float = 0.0, rounds: int = 2, reviews: bool = False) -> Rule:
    """Only improvements stay (with ``tol``: losses up to it do too); audits again after each round that kept something."""
    return Rule(1e-6 if tol <= 0 else -tol, tol <= 0, False, rounds, ("REPAIR", "REVIEW") if reviews else ("REPAIR",), True, True, False)


NO_WORSE = Rule(0.0, False, True, 1, ("REPAIR",), False, False, True)


def candidates(found: DataFrame, cfg: AuditConfig, rule: Rule) -> DataFrame:
    """The findings a rule tries, in order, with ``pair``: what a finding shares with its mirror."""
    wanted = F.col("repair").isNotNull() & F.col("confidence").isin(*rule.confidences) & ~F.col("repair.type").isin(*REVIEW_ONLY)
    elsewhere = ~F.substring_index("target", ",", 1).isin(*cfg.features) if rule.features_first else F.lit(False)
    two_sided = F.col("kind").isin(*FD.MIRROR_KINDS) & F.col("ref").isNotNull()
    pair = F.when(two_sided, F.to_json(F.array("kind", "slicer", "target", F.least("level", "ref"), F.greatest("level", "ref"))))
    return found.filter(wanted).withColumn("pair", pair).orderBy(elsewhere, "rank")


class _Gate:
    """The table as repaired so far, and the scores that led to it."""

    def __init__(self, dirty: DataFrame, held_out: DataFrame, cfg: AuditConfig, rule: Rule, seed: int) -> None:
        self.now, self.cfg, self.rule, self.seed = dirty, cfg, rule, seed
        self.scores = Evaluator(held_out, cfg)
        self.bar = self.scores.submit(dirty, "v0")
        self.kept: list[Row] = []

    def _trial(self, f: Row) -> DataFrame | None:
        """The table with one more repair, written, as scoring reads it several times."""
        try:
            return cut(apply_all(self.now, [f], self.cfg.row_id, self.rule.confidences, self.seed))
        except (PySparkException, Py4JJavaError, ValueError):
            if self.rule.pass_failing:
                return None
            raise

    def attempt(self, f: Row) -> bool:
        trial = self._trial(f)
        if trial is None:
            return False
        score = self.scores.submit(trial, f"v{len(self.scores.history)}", f)
        if not self.rule.stays(score, self.bar):
            return False
        self.scores.accept()
        self.now, self.bar = trial, score if self.rule.follow else max(self.bar, score)
        self.kept.append(f)
        return True

    def walk(self, tries: DataFrame) -> int:
        """Tries findings as they come in; how many were kept."""
        settled: set[str] = set()
        before = len(self.kept)
        for f in tries.toLocalIterator():  # one partition of findings at a time, in order
            if self.rule.one_direction and f["pair"] in settled:
                continue
            if self.attempt(f) and f["pair"] is not None:
                settled.add(f["pair"])
        return len(self.kept) - before


def gated_repair(dirty: DataFrame, held_out: DataFrame, cfg: AuditConfig, *, rule: Rule | None = None, seed: int = 42, opt: SliceOptions = SliceOptions()) -> GateResult:
    """Greedy repair: each finding's repair is tried on what stands so far and stays if ``rule`` says so."""
    rule = rule or strict_rule()
    gate = _Gate(dirty, held_out, cfg, rule, seed)
    for _ in range(rule.audits):
        if not gate.walk(candidates(audit(gate.now, cfg, opt=opt).report, cfg, rule)):
            break
    return GateResult(gate.now, gate.kept, gate.bar, gate.scores.table(dirty.sparkSession))


def recovery_summary(history: DataFrame, p_dirty: float, p_clean: float, margin: float = GOAL_MARGIN) -> DataFrame:
    """Anchors, goal and the share of the available improvement that was recovered."""
    best = history.agg(F.max("score").alias("best"))
    gain, room = F.col("best") - F.lit(p_dirty), F.lit(p_clean - p_dirty)
    return best.select(F.lit(p_dirty).alias("p_dirty"), F.lit(p_clean).alias("p_clean"), F.lit(p_dirty + margin).alias("goal"), "best",
                       F.when(room > 0, gain / room).alias("recovery"))


def final_test(clean: DataFrame, dirty: DataFrame, cleaned: DataFrame, test: DataFrame, cfg: AuditConfig) -> DataFrame:
    """Scores on the held-out test split, read once after the repairs are frozen."""
    test = feature_counts(test, cfg)
    rows = [(n, evaluate(df, test, cfg)) for n, df in (("p_dirty", dirty), ("p_clean", clean), ("final", cleaned))]
    return clean.sparkSession.createDataFrame(rows, "name string, f1 double")


Inject = Callable[[DataFrame, int], tuple[DataFrame, DataFrame]]


@dataclass
class Protocol:
    """Everything one run of the whole protocol yields."""

    gate: GateResult
    scores: DataFrame  # name, f1: dirty, clean and repaired training data on the test split
    cells: DataFrame  # cell report of the training rows
    recovery: DataFrame  # anchors, goal and share of the improvement that was recovered
    restoration: DataFrame | None  # per injected error, where rules are given


PART, OWN_PART = "__part__", "__own_part__"


def with_part(df: DataFrame, cfg: AuditConfig, seed: int) -> DataFrame:
    """The part of each row that has an identity, which it follows from: no join deals it out."""
    df = df.select(*cfg.row_id, *[c for c in df.columns if c not in cfg.row_id]).dropna(subset=list(cfg.row_id))
    return split3(df.withColumnRenamed("part", OWN_PART), cfg, seed).withColumnRenamed("part", PART).withColumnRenamed(OWN_PART, "part")


def with_repeats(df: DataFrame, row_id: Sequence[str]) -> DataFrame:
    """Each row as often as its identity is there, as a join with the identities has it; only hashes of identities are shuffled."""
    at = F.xxhash64(*row_id)
    twice = cut(df.groupBy(at.alias("_h")).count().filter("count > 1").select("_h"))
    if not twice.take(1):
        return df
    again = df.select(*row_id, at.alias("_h")).join(few(twice), "_h", "left_semi").groupBy(*row_id).agg(F.count(F.lit(1)).alias("_times")).filter("_times > 1")
    times = df.join(few(cut(again)), list(row_id), "left").withColumn("_time", F.explode(F.sequence(F.lit(1), F.coalesce("_times", F.lit(1)).cast("int"))))
    return times.select(*df.columns)


def run_protocol(clean: DataFrame, inject: Inject, cfg: AuditConfig, seed: int = 42, *, rule: Rule = NO_WORSE, rules: Mapping[str, Mapping] | None = None,
                 opt: SliceOptions = SliceOptions()) -> Protocol:
    """Inject, split 60/20/20, gate on the validation rows, score once on the test rows, compare with the truth."""
    dirty, truth = inject(clean, seed)
    row_id = list(cfg.row_id)
    dealt = cut(with_repeats(with_part(clean, cfg, seed), row_id), by=PART)

    def rows(part: str) -> DataFrame:
        return dealt.filter(F.col(PART) == part).drop(PART)

    train = rows("train")
    ids = with_part(clean.select(*row_id), cfg, seed).filter(F.col(PART) == "train").drop(PART)
    damaged = cut(with_part(dirty, cfg, seed).filter(F.col(PART) == "train").drop(PART).join(ids, row_id))
    g = gated_repair(damaged, rows("validation"), cfg, rule=rule, seed=seed, opt=opt)
    scores = cut(final_test(train, damaged, g.cleaned, rows("test"), cfg))
    f1 = {r["name"]: r["f1"] for r in scores.collect()}  # three rows
    cells = cell_report(align_by_id(train, damaged, g.cleaned, row_id, check=False), STRICT_TOL)
    restored = restoration_report(truth, train, damaged, g.cleaned, row_id, rules) if rules else None
    return Protocol(g, scores, cells, recovery_summary(g.history, f1["p_dirty"], f1["p_clean"]), restored)


def run_seed(clean: DataFrame, inject: Inject, cfg: AuditConfig, seed: int, **kw) -> DataFrame:
    """One seed of the protocol as one row."""
    p = run_protocol(clean, inject, cfg, seed, **kw)
    f1 = {r["name"]: r["f1"] for r in p.scores.collect()}
    return p.cells.filter(F.col("column") == "TOTAL").select(
        F.lit(seed).alias("seed"), F.lit(f1["p_dirty"]).alias("p_dirty"), F.lit(f1["p_clean"]).alias("p_clean"), F.lit(len(p.gate.kept)).alias("kept"),
        F.lit(p.gate.score).alias("f1_validation"), F.lit(f1["final"]).alias("f1_test"), "injected", "repaired", "changed", "missed", "collateral")


def seed_sweep(clean: DataFrame, inject: Inject, cfg: AuditConfig, seeds: Sequence[int] = (42, 43, 44), **kw) -> DataFrame:
    """One row per seed. What a seed writes on its way is removed before the next one."""
    rows, schema = [], None
    for s in seeds:
        with scratch(clean.sparkSession):
            one = run_seed(clean, inject, cfg, s, **kw)
            rows, schema = rows + one.collect(), one.schema
    return clean.sparkSession.createDataFrame(rows, schema)
