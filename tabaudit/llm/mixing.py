"""Mixing sources to target weights by capped water-filling (DataFrame functions only).

Sources share a budget in proportion to their weights; a source stops at ``epochs``
times its size and its excess goes to the others by weight until none is above. The
level is found in closed form from one row per source. A source's target is then
taken as whole repetitions of every document plus one more of those with the
smallest seeded draws, cut where the taken words come nearest to the target. The
cut is found in counts per draw bucket first, then inside one bucket, so no source
is gathered in one task.

Edge cases: a null text has size 0 and is taken as often as its source's epochs say;
the null source is a source of its own, the last; equal rows get the same draw and
the same number of repetitions; an empty table gives an empty result; other input
columns are carried, those named like an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabaudit.functions.lineage import cut
from tabaudit.llm.native import aside, restored, words_of

WEIGHTS = (5, 2, 1)
SHARE, EPOCHS, SEED = 1.5, 2, "mix-1"
#: Draws are 40 bits; their first 12 name one of 4,096 buckets.
DRAW_HEX, BUCKET_HEX = 10, 3
OUT = ("size", "source_size", "target", "repetitions", "taken")


def draw(doc_id: str, seed: str = SEED) -> Column:
    """Seeded draw of a document, as hex digits of one length (so text order is number order)."""
    return F.substring(F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(f"-{seed}"))), 1, DRAW_HEX)


def with_size(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("size", F.size(words_of(text)).cast("long"))


def targets(sized: DataFrame, source: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """One row per source: source_size, target. Sources are ordered by code point, null last."""
    by = sized.groupBy(F.col(source).alias("source")).agg(F.sum("size").alias("source_size"))
    # one row per source from here on: the windows see sources, not documents
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("double")
    cap = (epochs * F.col("source_size")).cast("double")
    w = by.withColumn("weight", weight).withColumn("cap", cap).withColumn("fill", F.col("cap") / F.col("weight"))
    order = Window.orderBy("fill", F.col("source").asc_nulls_last())
    before, after, whole = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.lit(share) * F.sum("source_size").over(whole)
    level = (budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    # the first source, in filling order, that its level does not fill up sets the level of all after it
    w = w.withColumn("_level", level).withColumn("_open", F.when(F.col("_level") <= F.col("fill"), F.col("_level")))
    w = w.withColumn("_at", F.first("_open", ignorenulls=True).over(whole))
    target = F.when(F.col("_at").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("_at") * F.col("weight")))
    return w.select("source", "source_size", F.round(target, 6).alias("target"))


def plan(sized: DataFrame, doc_id: str = "doc_id", source: str = "source", seed: str = SEED, **options) -> DataFrame:
    """One row per source: source_size, target, whole repetitions, and the last (draw, id) that gets one more."""
    rows = sized.select(F.col(source).alias("source"), F.col(doc_id).alias("id"), "size", draw(doc_id, seed).alias("u"))
    t = targets(sized, source, **options)
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    t = cut(t.withColumn("whole", F.floor(epochs + F.lit(1e-12)).cast("int")).withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size")))
    bucket = F.substring("u", 1, BUCKET_HEX)
    per = rows.groupBy("source", bucket.alias("b")).agg(F.sum("size").alias("in_bucket"))
    run = Window.partitionBy("source").orderBy("b")  # at most 4,096 rows a source
    per = per.withColumn("below", F.sum("in_bucket").over(run) - F.col("in_bucket")).withColumnRenamed("source", "s1")
    at = per.join(t.withColumnRenamed("source", "s2"), F.col("s1").eqNullSafe(F.col("s2")))
    at = at.filter((F.col("below") < F.col("extra")) & (F.col("extra") <= F.col("below") + F.col("in_bucket"))).select("s1", "b", "below", "extra")
    inside = rows.withColumn("b2", bucket).join(at, F.col("source").eqNullSafe(F.col("s1")) & (F.col("b2") == F.col("b")))
    # equal (draw, id) go together, so that equal rows share their fate
    inside = inside.groupBy("source", "b", "u", "id", "below", "extra").agg(F.sum("size").alias("size"))
    order = Window.partitionBy("source", "b").orderBy("u", F.col("id").asc_nulls_first())
    upto = F.col("below") + F.sum("size").over(order)
    # the row that passes the target is taken when that brings the sum nearer than leaving it
    taken = upto - F.col("extra") <= F.col("extra") - (upto - F.col("size"))
    last = inside.withColumn("_take", taken).filter("_take").groupBy("source").agg(F.max(F.struct("u", F.col("id"))).alias("cut"))
    # documents in the buckets below the cut bucket are taken in any case
    floor = at.select(F.col("s1").alias("fs"), F.col("b").alias("floor"))
    out = t.join(last.withColumnRenamed("source", "ls"), F.col("source").eqNullSafe(F.col("ls")), "left").join(floor, F.col("source").eqNullSafe(F.col("fs")), "left")
    return cut(out.select("source", "source_size", "target", "whole", "floor", "cut"))


def apply_plan(sized: DataFrame, of: DataFrame, doc_id: str = "doc_id", source: str = "source", seed: str = SEED) -> DataFrame:
    """Rows with source_size, target, repetitions (whole and seeded extra) and taken words."""
    p = of.select(F.col("source").alias("__s"), F.col("source_size").alias("__size"), F.col("target").alias("__target"), F.col("whole").alias("__whole"), F.col("floor").alias("__floor"), F.col("cut").alias("__cut"))
    base = sized.drop(*[c for c in OUT if c != "size"])
    u, i = draw(doc_id, seed), F.col(doc_id)
    cut_id = F.col("__cut.id")
    upto = (u < F.col("__cut.u")) | ((u == F.col("__cut.u")) & (i.isNull() | (cut_id.isNotNull() & (i <= cut_id))))
    extra = F.coalesce(F.substring(u, 1, BUCKET_HEX) < F.col("__floor"), F.lit(False)) | F.coalesce(upto, F.lit(False))
    both = base.join(p, F.col(source).eqNullSafe(F.col("__s")), "left")
    reps = F.col("__whole") + extra.cast("int")
    return both.select(*base.columns, F.col("__size").alias("source_size"), F.col("__target").alias("target"), reps.alias("repetitions"), (F.col("size") * reps).alias("taken"))


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """``docs`` with size, source_size, target, repetitions, taken."""
    sized = with_size(docs, text)
    return apply_plan(sized, plan(cut(sized.select(doc_id, source, "size")), doc_id, source, **options), doc_id, source)


def repeated(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """The mixed corpus itself: each document as many times as the mix takes it, in the input's columns, unchanged."""
    used = (doc_id, source, text)
    out = mix(aside(docs, *used), doc_id, source, text, **options).filter("repetitions > 0")
    return restored(out.withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("repetitions")))), docs.columns, *used)
