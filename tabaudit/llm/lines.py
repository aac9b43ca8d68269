"""Line deduplication over the whole corpus by a deletion-neighbourhood join (DataFrame functions only).

A line is its words joined by one space. Lines that are equal, or of ``MIN_WORDS`` words
or more and within one word of edit distance (one word added, dropped or changed), are
near; a line stays if no earlier line is near to it, where earlier means a smaller
document id, then the position in the document. Lines without a word always stay.

Equal lines are settled first, by their hashes. For the rest, each line's deletion
neighbourhood (the line without its i-th word, for every i) is emitted as hashed keys.
Two lines that share a variant made at the same i differ in that word only; a line that
equals another's variant is one word shorter. So each key's earliest members settle the
key, and no pairs are formed inside a group, however large. What a key settles is
verified by words before a line is dropped.

Two lines within one edit share their first or their last half. Lines that share no half
with another are left out of the neighbourhood step, and beside a shared half only the
words of the other half are deleted; that loses nothing and spares most of the variants.

Edge cases: a null text is one empty line; rows equal in id and text count as one row and
get the same verdict; null ids come first; a very long line has a variant per word like
any other; an empty table gives an empty result; other input columns are carried by
``dedup_lines``, and not read by ``judge_lines``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabaudit.functions.lineage import cut
from tabaudit.llm.native import let, text_of

#: Lines under this many words are only dropped if an earlier line is equal: one word of five is a fifth.
MIN_WORDS = 5


def _lines(text: Column) -> Column:
    """Array of the lines, with single spaces; one may stand at either end. Most texts have no other white space, which plain searches tell."""
    odd = F.lit(False)
    for space in ("  ", "\t", "\x0b", "\f", "\r"):
        odd = odd | F.contains(text, F.lit(space))
    return F.split(F.when(odd, F.regexp_replace(text, "[ \\t\\x0B\\f\\r]+", " ")).otherwise(text), "\n", -1)


def _n_words(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def _first(line: Column, m: Column) -> Column:
    return F.call_function("substring_index", line, F.lit(" "), m.cast("int"))


def _last(line: Column, m: Column) -> Column:
    return F.call_function("substring_index", line, F.lit(" "), (-m).cast("int"))


def _identity(line: Column) -> tuple[Column, Column]:
    """Two hashes of a line: 128 bits."""
    return F.xxhash64(line), F.xxhash64(F.lit(7), line)


def _halves(line: str, n: str, m: tuple[str, str]) -> Column:
    """(key, m, side), one of which any line within one edit shares: the first (side 0) or last (1) m words, m half of the shorter line's.

    Column names: the line, its number of words, and the halves for a line of as many words and of one more.
    """
    def keys(c: str) -> list[Column]:
        x = F.col(c)
        return [F.struct(F.xxhash64(F.lit(s), x, f(F.col(line), x)).alias("k"), x.alias("m"), F.lit(s).alias("side")) for s, f in ((0, _first), (1, _last))]

    both = F.when(F.col(m[0]) == F.col(m[1]), F.array(*keys(m[0]))).otherwise(F.array(*keys(m[0]), *keys(m[1])))
    return F.when(F.col(n) < MIN_WORDS, F.array().cast("array<struct<k:bigint,m:int,side:int>>")).otherwise(both)


def line_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per line: id, th (hash of the text), pos, l1 and l2 (null without words), halves."""
    t = text_of(text)
    rows = docs.select(F.col(doc_id).alias("id"), F.xxhash64(t).alias("th"), F.posexplode(_lines(t)).alias("pos", "raw"))
    # each step a projection of its own, so that what is used several times is computed once
    rows = rows.withColumn("line", F.trim(F.col("raw"))).withColumn("n", _n_words(F.col("line")))
    rows = rows.withColumn("m0", F.shiftright("n", 1)).withColumn("m1", F.shiftright(F.col("n") - 1, 1))
    line, full = F.col("line"), F.col("line") != ""
    l1, l2 = _identity(line)
    return rows.select("id", "th", "pos", F.when(full, l1).alias("l1"), F.when(full, l2).alias("l2"), F.when(full, _halves("line", "n", ("m0", "m1"))).alias("halves"))


def _order(*cols: str) -> Column:
    return F.struct(*[F.col(c) for c in cols])


def _variants(line: Column, half: Column) -> Column:
    """(i, key) of the words beside a shared half, whole (i = 0) and without their i-th; the key holds the half too."""
    rest = F.when(half["side"] == 0, _last(line, _n_words(line) - half["m"])).otherwise(_first(line, _n_words(line) - half["m"]))

    def of(r: Column) -> Column:
        n = _n_words(r)

        def without(i: Column) -> Column:
            head, tail = _first(r, i - 1), _last(r, n - i)
            left = F.when(i == 0, r).when(i == 1, tail).when(i == n, head).otherwise(F.concat(head, F.lit(" "), tail))
            return F.struct(i.alias("i"), F.xxhash64(half["k"], left).alias("key"))

        return F.transform(F.sequence(F.lit(0), n), without)

    return let(rest, of)


def one_edit(a: Column, b: Column) -> Column:
    """Whether two arrays of words are within one word of edit distance."""
    na, nb = F.size(a), F.size(b)

    def shared(x: Column, y: Column) -> Column:
        differs = F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), F.lit(False))
        return F.when(differs == 0, F.greatest(na, nb)).otherwise(differs.cast("int") - 1)

    return shared(a, b) + shared(F.reverse(a), F.reverse(b)) >= F.greatest(na, nb) - 1


def near_dropped(docs: DataFrame, first: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, th, pos) of distinct lines with an earlier line within one edit.

    ``first``: distinct lines as id, th, pos of their first occurrence, and halves.
    """
    half = first.select("id", "th", "pos", F.explode("halves").alias("h"))
    shared = half.groupBy(F.col("h.k").alias("k")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("k")
    wanted = half.join(shared, F.col("h.k") == F.col("k"), "left_semi").groupBy(F.col("id").alias("w_id"), F.col("th").alias("w_th")).agg(F.collect_list(F.struct("pos", "h")).alias("at"))
    t = text_of(text)
    texts = docs.select(F.col(doc_id).alias("id"), F.xxhash64(t).alias("th"), t.alias("text")).join(wanted, F.col("id").eqNullSafe(F.col("w_id")) & (F.col("th") == F.col("w_th")))
    lines = let(_lines(F.col("text")), lambda a: F.transform(F.col("at"), lambda p: F.struct(p["pos"].alias("pos"), p["h"].alias("h"), F.trim(F.get(a, p["pos"])).alias("line"))))
    # rows equal in id and text are one row here
    met = cut(texts.select("id", "th", F.explode(lines).alias("x")).select("id", "th", "x.*").dropDuplicates(["id", "th", "pos", "h"]))
    near = met.select("id", "th", "pos", "line").dropDuplicates(["id", "th", "pos"])
    rows = cut(met.select(_order("id", "th", "pos").alias("o"), F.explode(_variants(F.col("line"), F.col("h"))).alias("v")).select("o", F.col("v.i").alias("i"), F.col("v.key").alias("key")))
    # a key's line itself, and the earliest line that it is a variant of
    keys = rows.groupBy("key").agg(F.min(F.when(F.col("i") == 0, F.col("o"))).alias("itself"), F.min(F.when(F.col("i") > 0, F.col("o"))).alias("longer"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = cut(rows.join(keys.drop("n"), "key"))
    same = met.filter("i > 0").groupBy(F.col("key").alias("k2"), F.col("i").alias("i2")).agg(F.min("o").alias("changed"))
    met = met.join(same, (F.col("key") == F.col("k2")) & (F.col("i") == F.col("i2")), "left")
    rival = F.when(F.col("i") == 0, F.col("longer")).otherwise(F.least(F.col("itself"), F.col("changed")))
    pairs = met.withColumn("by", rival).filter(F.col("by") < F.col("o")).select("o", "by").distinct()
    word = lambda c: F.split(F.col(c), " ", -1)
    left, right = (near.select(_order("id", "th", "pos").alias(k), F.col("line").alias(f"line_{k}")) for k in ("o", "by"))
    checked = pairs.join(left, "o").join(right, "by").filter(one_edit(word("line_o"), word("line_by")))
    return checked.select("o").distinct().select("o.*")


def judge_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: id, th (hash of its text), n_lines, and the positions of the lines that stay (from 0)."""
    rows = cut(line_table(docs, doc_id, text))
    first = rows.filter("l1 is not null").groupBy("l1", "l2").agg(F.min(F.struct("id", "th", "pos", "halves")).alias("f")).select("f.*")
    first = cut(first)
    gone = near_dropped(docs, first.filter(F.size("halves") > 0), doc_id, text)
    same = lambda c: F.col(c).eqNullSafe(F.col(f"g_{c}"))
    stays = first.drop("halves").join(gone.select(*[F.col(c).alias(f"g_{c}") for c in ("id", "th", "pos")]), same("id") & same("th") & same("pos"), "left_anti")
    blank = rows.filter("l1 is null").select("id", "th", "pos").distinct()
    kept = stays.unionByName(blank).groupBy(F.col("id").alias("k_id"), F.col("th").alias("k_th")).agg(F.sort_array(F.collect_list("pos")).alias("kept"))
    every = rows.groupBy("id", "th").agg((F.max("pos") + 1).cast("long").alias("n_lines"), F.count(F.lit(1)).alias("n"))
    out = every.join(kept, F.col("id").eqNullSafe(F.col("k_id")) & (F.col("th") == F.col("k_th")), "left")
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.floor(F.col("n") / F.col("n_lines"))))
    return out.withColumn("_copy", copies).select("id", "th", "n_lines", F.coalesce("kept", F.array().cast("array<int>")).alias("kept"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the lines that stay, and with n_lines and n_removed."""
    verdict = judge_lines(docs, doc_id, text).dropDuplicates(["id", "th"]).select(F.col("id").alias("__id"), F.col("th").alias("__th"), F.col("n_lines").alias("__n"), F.col("kept").alias("__kept"))
    base = docs.drop("n_lines", "n_removed")
    t = text_of(text)
    both = base.withColumn("__h", F.xxhash64(t)).join(verdict, F.col(doc_id).eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__th")))
    raw = let(F.split(t, "\n", -1), lambda a: F.array_join(F.transform(F.col("__kept"), lambda p: F.get(a, p)), "\n"))
    carried = [raw.alias(text) if c == text else F.col(c) for c in base.columns]
    return both.select(*carried, F.col("__n").alias("n_lines"), (F.col("__n") - F.size("__kept")).alias("n_removed"))
