"""How filters interact: steps of every order of filters, and their Shapley values.

A document is its set of failed filters (a mask of ``len(LETTERS)`` bits), so a table of
counts by mask says all there is to say. From it every coalition of filters is tabulated:
what it removes when it is applied, 32 numbers a part for five filters. A step of an
order is the difference of two coalitions, and the Shapley values are the solution of
least squares over all coalitions under the Shapley kernel, with the whole removal given
out exactly (efficiency). The normal equations are solved once, in rationals, for a
general game: the solution is linear in the 32 numbers, and all orders taken together it
has whole coefficients, so no rounding occurs anywhere.

Only one row a document (digest of the text, part, mask) is shuffled, aggregated before.
Copies are found by the digest of the whole text: of the rows of one text all but those
with the smallest id fail E. Equal (text, part, id) rows are one row with a count, and
texts meet by two aggregations, so neither a text with a third of all rows nor an id of
many rows lies in one task.

Edge cases: a null text is empty; a null part counts as ''; a null id is neither smaller
than others nor does it have smaller ones, and no labels; rows that repeat an id count
each; a document is good (toxic) when any of its labels says 1; a part in which nothing is
removed has its rows, with zeros; an empty table gives an empty result; other input columns
are not read.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabaudit.llm.native import let, text_of, words_of

LETTERS = "ABCDE"
N = len(LETTERS)
ALL = (1 << N) - 1
#: Failure conditions of the filters that see one text: fewer words, a lower share (in per cent) of distinct words, more capitals (in per cent), a symbol.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 100, 80, 10, "[#$%&*|]"


def shapley_operator(n: int = N) -> list[list[Fraction]]:
    """Row i: coefficients of v(coalition), by the coalition's bits, in the value of player i.

    Minimises the sum over coalitions S (but none and all) of k(S) (v(S) - v(0) - sum of x_i
    in S)^2, k(S) = (n - 1) / (C(n, s) s (n - s)), under sum of all x_i = v(all) - v(0).
    Lagrange: [A 1; 1' 0] [x; m] = [b; v(all) - v(0)], where A = sum k z z', b = sum k z (v - v(0)).
    The right-hand sides are those of all unit games at once.
    """
    full = (1 << n) - 1
    bits = [[Fraction(s >> i & 1) for i in range(n)] for s in range(full + 1)]
    kernel = [Fraction(n - 1, comb(n, sum(map(int, z))) * int(sum(z)) * (n - int(sum(z)))) if 0 < s < full else Fraction(0) for s, z in enumerate(bits)]
    rows = []
    for i in range(n):
        left = [sum(k * z[i] * z[j] for k, z in zip(kernel, bits)) for j in range(n)] + [Fraction(1)]
        right = [k * z[i] for k, z in zip(kernel, bits)]
        right[0] -= sum(right)  # v(0) is taken off each v(S)
        rows.append(left + right)
    rows.append([Fraction(1)] * n + [Fraction(0)] + [Fraction((s == full) - (s == 0)) for s in range(full + 1)])
    for c in range(n + 1):  # Gauss and Jordan
        p = next(r for r in range(c, n + 1) if rows[r][c])
        rows[c], rows[p] = rows[p], rows[c]
        rows[c] = [x / rows[c][c] for x in rows[c]]
        for r in range(n + 1):
            if r != c and rows[r][c]:
                rows[r] = [x - rows[r][c] * y for x, y in zip(rows[r], rows[c])]
    return [row[n + 1 :] for row in rows[:n]]


def own_mask(text: str = "text") -> Column:
    """Bits of the filters that see one text alone (all but the last)."""
    t = text_of(text)
    capitals = F.length(t) - F.length(F.regexp_replace(t, "[A-Z]+", ""))

    def of(w: Column) -> Column:
        n = F.size(w)
        return F.when(n < LEAST_WORDS, 1).otherwise(0) + F.when(100 * F.size(F.array_distinct(w)) < LEAST_DISTINCT * n, 2).otherwise(0)

    return let(words_of(text), of) + F.when(100 * capitals > MOST_CAPITALS * F.length(t), 4).otherwise(0) + F.when(t.rlike(SYMBOLS), 8).otherwise(0)


def masks(docs: DataFrame, labels: DataFrame, part: str, doc_id: str, text: str) -> DataFrame:
    """part, mask, n, good, toxic: documents by the filters that they fail."""
    marks = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("l_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text_of(text), 256)).alias("digest"), own_mask(text).alias("own"))
    rows = rows.groupBy("digest", "part", "id").agg(F.count(F.lit(1)).alias("n"), F.first("own").alias("own"))
    named = rows.filter("id is not null").join(marks, F.col("id") == F.col("l_id"), "left").drop("l_id")
    both = named.unionByName(rows.filter("id is null").withColumns({"good": F.lit(None).cast("int"), "toxic": F.lit(None).cast("int")}))
    counts = both.withColumns({"good": F.coalesce("good", F.lit(0)) * F.col("n"), "toxic": F.coalesce("toxic", F.lit(0)) * F.col("n")})
    # by text and part: all rows that have an id, those with the smallest one, those without
    known, sums = F.col("id").isNotNull(), ("n", "good", "toxic")
    texts = counts.groupBy("digest", "part").agg(
        F.first("own").alias("own"), F.min(F.when(known, F.struct("id", *sums))).alias("low"),
        F.struct(*[F.coalesce(F.sum(F.when(known, F.col(c))), F.lit(0)).alias(c) for c in sums]).alias("ided"), F.struct(*[F.coalesce(F.sum(F.when(~known, F.col(c))), F.lit(0)).alias(c) for c in sums]).alias("free"))
    least = texts.groupBy(F.col("digest").alias("m_digest")).agg(F.min("low.id").alias("least"))
    seen = texts.join(least, F.col("digest") == F.col("m_digest"))
    first = F.coalesce(F.col("low.id") == F.col("least"), F.lit(False))

    def counted(mask: Column, count) -> Column:
        return F.struct(mask.cast("int").alias("mask"), *[count(c).alias(c) for c in sums])

    stays = lambda c: F.col(f"free.{c}") + F.when(first, F.col(f"low.{c}")).otherwise(0)
    split = F.array(counted(F.col("own"), stays), counted(F.col("own") + (1 << N - 1), lambda c: F.col(f"ided.{c}") + F.col(f"free.{c}") - stays(c)))
    return seen.select("part", F.inline(split)).groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in sums]).filter("n > 0")


def coalitions(by_mask: DataFrame) -> DataFrame:
    """One row a part: documents, and by coalition (an array over its bits) what it removes of all, good and toxic ones."""
    each = by_mask.groupBy("part").agg(F.sum("n").alias("docs"), F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("each"))  # 32 masks at most

    def total(where, c: str) -> Column:
        return F.aggregate("each", F.lit(0).cast("long"), lambda a, x: a + F.when(where(x["mask"]), x[c]).otherwise(F.lit(0)))

    def removed(c: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(ALL)), lambda s: total(lambda m: m.bitwiseAND(s) != 0, c))

    def only(i: int) -> Column:
        return total(lambda m: m == 1 << i, "n")

    return each.select("part", "docs", *[removed(c).alias(c) for c in ("n", "good", "toxic")], F.array(*map(only, range(N))).alias("alone"))


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley (times all orders).

    ``labels``: doc_id, quality, toxic.
    """
    table = coalitions(masks(docs, labels, part, doc_id, text))
    orders = factorial(N)
    weights = [[orders * x for x in row] for row in shapley_operator()]
    assert all(x.denominator == 1 for row in weights for x in row)
    v = lambda c, s: F.get(F.col(c), s)
    values = F.array(*[sum((F.lit(int(w)).cast("long") * v("n", F.lit(s)) for s, w in enumerate(row) if w), F.lit(0).cast("long")) for row in weights])
    steps = []
    for order in permutations(range(N)):
        before = 0
        for k, f in enumerate(order):
            steps.append(f"('{''.join(LETTERS[i] for i in order)}',{k + 1},{f},{before},{before | 1 << f})")
            before |= 1 << f
    spark = docs.sparkSession
    walk = spark.sql(f"select * from values {','.join(steps)} as t(filter_order, step, f, before, after)")
    walk = walk.agg(F.collect_list(F.struct("filter_order", "step", "f", "before", "after")).alias("walk"))  # 600 rows, whatever the input
    rows = table.withColumn("values", values).join(F.broadcast(walk)).select("*", F.inline("walk"))
    alone = F.array(*[F.lit(1 << i) for i in range(N)])
    gone = lambda c: v(c, F.col("after")) - v(c, F.col("before"))
    return rows.select(
        "part", "filter_order", "step", (F.col("docs") - v("n", F.col("after"))).alias("kept"), gone("n").alias("removed"),
        (v("n", F.get(alone, F.col("f"))) - gone("n")).alias("redundant"),
        v("alone", F.col("f")).alias("unique_fails"), gone("good").alias("good_lost"), gone("toxic").alias("toxic_lost"), v("values", F.col("f")).alias("shapley"))
