"""Exact order statistics that never gather a group in one task.

Values are placed in ordered buckets by fixed edges. Counts per (group, bucket)
locate the bucket that holds the wanted rank; only the rows of that bucket are
shuffled and sorted. A group that holds a third of the table is therefore spread
over thousands of buckets. The edges only steer the work: any edges give the
same, exact result.

A *member table* says which base groups make up a wanted group, so "every other
level" or "all levels but this one" costs a join of two small count tables
instead of another pass over the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabaudit.functions.lineage import cut, few

COARSE = 16
FINE = 256
#: Share of the rows that a bucket may hold; rounds of splitting (each narrows 256 times, so these do for any doubles).
LARGEST = 1 / 128
ROUNDS = 12


def value_edges(df: DataFrame, columns: Sequence[str], coarse: int = COARSE, fine: int = FINE, largest: float = LARGEST) -> dict[str, list[float]]:
    """Ordered bucket edges per column, such that no bucket holds more than the share ``largest`` of the rows.

    One approximate-quantile pass gives the first edges. A bucket that is counted above
    the bound is split again: its smallest and largest value become edges, between which
    it is cut anew. Each round narrows a bucket ``fine`` times or more, so a few rounds do
    for any skew; a bucket of one value cannot be split and is left.
    """
    columns = list(columns)
    probs = [i / coarse for i in range(coarse + 1)]
    found = df.approxQuantile(columns, probs, 1.0 / (4 * coarse))
    edges = {c: sorted(set(e)) for c, e in zip(columns, found)}
    split = [c for c in columns if len(edges[c]) > 1]
    for _ in range(ROUNDS):
        if not split:
            break
        cells = F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("x"), bucket_of(F.col(c), edges[c], fine).alias("b")) for i, c in enumerate(split)])
        counts = df.select(F.explode(cells).alias("v")).select("v.*").filter("b is not null and not isnan(x)").groupBy("c", "b").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        large = counts.withColumn("all", F.sum("n").over(Window.partitionBy("c"))).filter((F.col("n") > largest * F.col("all")) & (F.col("lo") < F.col("hi")))
        full = large.select("c", "lo", "hi").collect()  # 1 / largest buckets a column at most
        for r in full:
            edges[split[r["c"]]] = sorted({*edges[split[r["c"]]], r["lo"], r["hi"]})
        split = [split[i] for i in sorted({r["c"] for r in full})]
    return edges


def bucket_of(x: Column, edges: Sequence[float], fine: int = FINE) -> Column:
    """Bucket number of ``x``: never decreasing in x, null for null.

    Quantile edges give the coarse bucket (a balanced CASE tree, compiled with
    the rest of the stage); each coarse bucket is cut in ``fine`` equal widths.
    """
    if len(edges) < 2:
        return F.when(x.isNotNull(), F.lit(0)).cast("int")
    top = (fine - 1) / fine

    def leaf(i: int) -> Column:
        lo, hi = float(edges[i]), float(edges[i + 1])
        part = F.greatest(F.lit(0.0), F.least(F.lit(top), (x - F.lit(lo)) / F.lit(hi - lo)))
        return F.lit(i * fine) + F.floor(part * F.lit(float(fine)))

    def tree(lo: int, hi: int) -> Column:
        if hi - lo == 1:
            return leaf(lo)
        mid = (lo + hi) // 2
        return F.when(x < F.lit(float(edges[mid])), tree(lo, mid)).otherwise(tree(mid, hi))

    return F.when(x.isNotNull(), tree(0, len(edges) - 1)).cast("int")


def made_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is made once, before anything that reads it; for bucket numbers and hashes.

    A plain expression of that length is written out again in the filters and keys of a join, and
    the method that is generated for them gets too long for the JVM to compile: each row then
    takes about twenty times as long. A generator of one element is not merged with what follows.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def fine_for(n_rows: int, per_bucket: int = 200) -> int:
    """Cuts per coarse bucket, so that a bucket holds a few hundred rows up to 10^7 of them, then grows slowly."""
    return int(min(4096, max(8, n_rows // (COARSE * per_bucket))))


def bucket_by(x: Column, name: Column, edges: Mapping[str, Sequence[float]], fine: int = FINE) -> Column:
    """Bucket number where the edges depend on the column ``name`` (long form)."""
    items = list(edges.items())
    if len(items) == 1:
        return bucket_of(x, items[0][1], fine)
    out = F.when(name == F.lit(items[0][0]), bucket_of(x, items[0][1], fine))
    for key, e in items[1:]:
        out = out.when(name == F.lit(key), bucket_of(x, e, fine))
    return out


def group_quantiles(
    rows: DataFrame,
    keys: Sequence[str],
    probs: Mapping[str, float],
    *,
    x: str = "x",
    weight: str | None = None,
    members: DataFrame | None = None,
    group: Sequence[str] | None = None,
    edges: Sequence[float] | Mapping[str, Sequence[float]] | None = None,
    edges_key: str | None = None,
    count: str = "n",
    fine: int = FINE,
    unfold: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Exact linear-interpolated quantiles of ``x`` per group.

    ``probs`` maps output names to probabilities. Without ``members`` the groups
    are the ``keys``; with it, a group is the union of the listed key groups.
    Null values are left out; ``count`` names the column with the group size.

    ``unfold`` makes the rows of the groups from ``rows``, where one belongs to several groups,
    and keeps the other columns. Buckets are numbered before it, and values are looked for only
    in the rows of buckets that some group needs, so few rows are unfolded a second time.
    """
    keys, group = list(keys), list(group or keys)
    if edges is None:
        edges = value_edges(rows, [x])[x]
    bucket = bucket_by(F.col(x), F.col(edges_key), edges, fine) if edges_key else bucket_of(F.col(x), edges, fine)
    wt = F.col(weight) if weight else F.lit(1)
    numbered = made_once(rows.filter(F.col(x).isNotNull()), "_b", bucket)

    def in_groups(r: DataFrame) -> DataFrame:
        return (unfold(r) if unfold else r).select(*keys, F.col(x).alias("_x"), wt.cast("long").alias("_n"), "_b")

    base = in_groups(numbered)
    counts = base.groupBy(*keys, "_b").agg(F.sum("_n").alias("_c"))
    if members is not None:
        counts = counts.join(members, keys).groupBy(*group, "_b").agg(F.sum("_c").alias("_c"))
    in_group = Window.partitionBy(*group)
    counts = counts.withColumn("_hi", F.sum("_c").over(in_group.orderBy("_b"))).withColumn(
        "_tot", F.sum("_c").over(in_group)
    )

    def ranks(q: float) -> tuple[Column, Column, Column]:
        pos = F.lit(float(q)) * (F.col("_tot") - 1)
        return pos, F.floor(pos), F.ceil(pos)

    def holds(rank: Column, lo: Column, hi: Column) -> Column:
        return (lo <= rank) & (rank < hi)

    wanted = F.lit(False)
    for q in probs.values():
        _, r0, r1 = ranks(q)
        lo, hi = F.col("_hi") - F.col("_c"), F.col("_hi")
        wanted = wanted | holds(r0, lo, hi) | holds(r1, lo, hi)
    # written, so that its size is known and it filters the rows in the scan instead of shuffling them
    need = cut(counts.filter(wanted).select(*group, "_b", (F.col("_hi") - F.col("_c")).alias("_lo"), "_tot"))

    if unfold and members is None:
        place = [c for c in (edges_key, "_b") if c]
        base = in_groups(numbered.join(few(cut(need.select(*place).distinct())), place, "left_semi"))
    if members is not None:
        inside = base.join(few(cut(need.join(members, group))), [*keys, "_b"])
    else:
        inside = base.join(few(need), [*keys, "_b"])
    hist = inside.groupBy(*group, "_b", "_lo", "_tot", "_x").agg(F.sum("_n").alias("_c"))
    run = F.sum("_c").over(Window.partitionBy(*group, "_b").orderBy("_x"))
    hist = hist.withColumn("_hi", F.col("_lo") + run)
    aggs = [F.max("_tot").alias("_tot")]
    for name, q in probs.items():
        _, r0, r1 = ranks(q)
        lo, hi = F.col("_hi") - F.col("_c"), F.col("_hi")
        aggs.append(F.max(F.when(holds(r0, lo, hi), F.col("_x"))).alias(f"_{name}_0"))
        aggs.append(F.max(F.when(holds(r1, lo, hi), F.col("_x"))).alias(f"_{name}_1"))
    out = hist.groupBy(*group).agg(*aggs)
    cols = []
    for name, q in probs.items():
        pos, r0, _ = ranks(q)
        a, b = F.col(f"_{name}_0"), F.col(f"_{name}_1")
        cols.append((a + (b - a) * (pos - r0)).alias(name))
    return out.select(*group, F.col("_tot").alias(count), *cols)


def with_total(table: DataFrame, column: str, out: str) -> DataFrame:
    """``table`` with the sum of a column beside each row; the sum is one row, so no task gets the table."""
    one = F.lit(1).alias("_one")
    return table.select("*", one).join(F.broadcast(table.agg(F.sum(column).alias(out)).select(one, out)), "_one").drop("_one")


def _locate(own: DataFrame, total: DataFrame, queries: DataFrame, whole: Sequence[str], part: Sequence[str], pos: str) -> DataFrame:
    """Where the complement of a part holds a rank: ``queries`` (whole.., part.., q, r) with pos and ``left``, the rank within pos.

    ``own`` (whole.., part.., pos, c) and ``total`` (whole.., pos, c) are counts. The
    complement's running count is total minus own. At a position of the part it is known;
    between two of them own stands still, so there the rank in the complement is a rank in
    the total, moved by own's count so far. No other part is looked at.
    """
    whole, part = list(whole), list(part)
    t = total.withColumn("_hiT", F.sum("_c").over(Window.partitionBy(*whole).orderBy(pos))).select(*whole, pos, "_hiT", (F.col("_hiT") - F.col("_c")).alias("_loT"))
    o = own.withColumn("_hiO", F.sum("_c").over(Window.partitionBy(*whole, *part).orderBy(pos))).withColumn("_loO", F.col("_hiO") - F.col("_c")).join(t, [*whole, pos])
    o = o.select(*whole, *part, pos, "_hiO", (F.col("_loT") - F.col("_loO")).alias("_before"), (F.col("_hiT") - F.col("_hiO")).alias("_after"))
    r = F.col("r")
    at = queries.join(o, [*whole, *part], "left").groupBy(*whole, *part, "q", "r").agg(
        F.coalesce(F.max(F.when(F.col("_after") <= r, F.col("_hiO"))), F.lit(0)).alias("_k"),
        F.max(F.when((F.col("_before") <= r) & (r < F.col("_after")), F.struct(pos, "_before"))).alias("_hit"))
    # between two positions: the last one of the total that begins at or before the rank
    asked = at.select(*whole, (r + F.col("_k")).alias("_at"), F.lit(1).alias("_ask"), *part, "q", "r", "_hit")
    given = t.select(*whole, F.col("_loT").alias("_at"), F.lit(0).alias("_ask"), pos)
    run = Window.partitionBy(*whole).orderBy("_at", "_ask").rowsBetween(Window.unboundedPreceding, 0)
    both = given.unionByName(asked, allowMissingColumns=True)
    both = both.withColumn("_p", F.last(F.when(F.col("_ask") == 0, F.struct(pos, "_at")), ignorenulls=True).over(run))
    left = F.when(F.col("_hit").isNotNull(), r - F.col("_hit._before")).otherwise(F.col("_at") - F.col("_p._at"))
    return both.filter("_ask = 1").select(*whole, *part, "q", F.coalesce(f"_hit.{pos}", f"_p.{pos}").alias(pos), left.alias("left"))


def complement_quantiles(rows: DataFrame, whole: Sequence[str], part: Sequence[str], probs: Mapping[str, float], *, x: str = "x", weight: str | None = None, wanted: DataFrame | None = None,
                         edges: Sequence[float] | Mapping[str, Sequence[float]] | None = None, edges_key: str | None = None, count: str = "n", fine: int = FINE,
                         unfold: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Exact quantiles of what remains of each ``whole`` group without one of its parts, for every part (or the ``wanted`` ones).

    Ranks are searched in total counts minus own counts, by bucket and then by value in the
    buckets that hold a rank, so the cost is that of one quantile per whole group plus a few
    rows a part: linear in the number of parts. Parts that leave nothing are left out.
    ``unfold``: as in ``group_quantiles``.
    """
    whole, part = list(whole), list(part)
    if edges is None:
        edges = value_edges(rows, [x])[x]
    bucket = bucket_by(F.col(x), F.col(edges_key), edges, fine) if edges_key else bucket_of(F.col(x), edges, fine)
    wt = F.col(weight) if weight else F.lit(1)
    numbered = made_once(rows.filter(F.col(x).isNotNull()), "_b", bucket)

    def in_groups(r: DataFrame) -> DataFrame:
        return (unfold(r) if unfold else r).select(*whole, *part, F.col(x).alias("_x"), wt.cast("long").alias("_w"), "_b")

    base = in_groups(numbered)
    own = cut(base.groupBy(*whole, *part, "_b").agg(F.sum("_w").alias("_c")))
    total = own.groupBy(*whole, "_b").agg(F.sum("_c").alias("_c"))
    mine = own if wanted is None else own.join(wanted, part, "left_semi")
    sizes = mine.groupBy(*whole, *part).agg(F.sum("_c").alias("_n")).join(own.groupBy(*whole).agg(F.sum("_c").alias("_of")), whole)
    sizes = sizes.select(*whole, *part, (F.col("_of") - F.col("_n")).alias("_tot")).filter("_tot > 0")
    ranks, names = [], list(probs)
    for i, q in enumerate(probs.values()):
        place = F.lit(float(q)) * (F.col("_tot") - 1)
        ranks += [F.struct(F.lit(2 * i).alias("q"), F.floor(place).alias("r")), F.struct(F.lit(2 * i + 1).alias("q"), F.ceil(place).alias("r"))]
    queries = sizes.select(*whole, *part, F.inline(F.array(*ranks)))
    in_bucket = cut(_locate(mine, total, queries, whole, part, "_b"))
    if unfold:
        place = [c for c in (edges_key, "_b") if c]
        base = in_groups(numbered.join(few(cut(in_bucket.select(*place).distinct())), place, "left_semi"))
    near = cut(base.join(few(cut(in_bucket.select(*whole, "_b").distinct())), [*whole, "_b"]).groupBy(*whole, "_b", *part, "_x").agg(F.sum("_w").alias("_c")))
    own_near = near.join(in_bucket.select(*whole, "_b", *part).distinct(), [*whole, "_b", *part], "left_semi")
    total_near = near.groupBy(*whole, "_b", "_x").agg(F.sum("_c").alias("_c"))
    found = _locate(own_near, total_near, in_bucket.withColumnRenamed("left", "r"), [*whole, "_b"], part, "_x")
    wide = found.groupBy(*whole, *part).agg(*[F.max(F.when(F.col("q") == k, F.col("_x"))).alias(f"_x{k}") for k in range(2 * len(names))]).join(sizes, [*whole, *part])
    out = []
    for i, (name, q) in enumerate(probs.items()):
        place = F.lit(float(q)) * (F.col("_tot") - 1)
        out.append((F.col(f"_x{2 * i}") + (F.col(f"_x{2 * i + 1}") - F.col(f"_x{2 * i}")) * (place - F.floor(place))).alias(name))
    return wide.select(*whole, *part, F.col("_tot").alias(count), *out)


def cumulative(hist: DataFrame, keys: Sequence[str], x: str, sums: Mapping[str, str], bucket: Column) -> DataFrame:
    """Running totals of ``sums`` (column -> output) over ordered ``x`` per group.

    Totals per bucket are cumulated first (a short list per group), then each
    (group, bucket) is cumulated on its own. Rows with a null ``x`` are left out.
    """
    keys = list(keys)
    base = hist.withColumn("_b", bucket)
    order = Window.partitionBy(*keys).orderBy("_b")
    totals = base.groupBy(*keys, "_b").agg(*[F.sum(c).alias(f"_t_{o}") for c, o in sums.items()])
    before = totals.select(
        *keys, "_b", *[(F.sum(f"_t_{o}").over(order) - F.col(f"_t_{o}")).alias(f"_p_{o}") for o in sums.values()]
    )
    inner = Window.partitionBy(*keys, "_b").orderBy(x)
    joined = base.join(before, [*keys, "_b"])
    return joined.select(
        *hist.columns, *[(F.col(f"_p_{o}") + F.sum(c).over(inner)).alias(o) for c, o in sums.items()]
    )


def _same_keys(keys: Sequence[str], other: str) -> Column:
    """Null-safe equality of ``keys`` with columns named ``other`` + key."""
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"{other}{k}"))
    return on


def _ordinal_by_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """Numbers within groups of any size: rows are dealt by ranges of the keys and the whole order, sorted there and
    numbered, and each range of a group is moved by the group's rows in the ranges before it."""
    place = [F.col(c).asc_nulls_first() for c in [*keys, *order]]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # what all of these leave equal is told apart by the other columns, so that only equal rows stay together
    rest = [c for c in df.columns if c not in keys and c not in order]
    dealt = df.withColumn("_tie", F.xxhash64(*rest) if rest else F.lit(0))
    numbered = cut(dealt.repartitionByRange(parts, *place, "_tie").sortWithinPartitions(*place, "_tie").drop("_tie").withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)  # the task is in the upper bits
    pieces = numbered.groupBy(*[F.col(k).alias(f"_of_{k}") for k in keys], part.alias("_part")).agg(F.min("_m").alias("_lo"), F.count(F.lit(1)).alias("_c"))
    before = F.sum("_c").over(Window.partitionBy(*[f"_of_{k}" for k in keys]).orderBy("_part")) - F.col("_c")
    pieces = pieces.select(*[f"_of_{k}" for k in keys], "_part", (before - F.col("_lo") + 1).alias("_move"))
    joined = numbered.join(pieces, (part == F.col("_part")) & _same_keys(keys, "_of_"))
    return joined.select(*df.columns, (F.col("_m") + F.col("_move")).cast("long").alias(out))


def ordinal_in_group(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, hot_rows: int = 1_000_000) -> DataFrame:
    """``row_number`` per group (from 1; null is a key like others) in the order of all ``order`` columns, nulls first.

    The groups of up to ``hot_rows`` rows are numbered by a window, which is one exchange;
    larger ones, by which a task would be filled, in ranges. Both give the same numbers.
    """
    keys, order = list(keys), list(order)
    if not keys:
        raise ValueError("a global order needs a row id column; align on it instead")
    plain = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")
    hot = df.groupBy(*[F.col(k).alias(f"_hot_{k}") for k in keys]).count().filter(F.col("count") > hot_rows).drop("count")
    hot = cut(hot)
    if not hot.take(1):
        return df.withColumn(out, plain)
    large = df.join(hot, _same_keys(keys, "_hot_"), "left_semi")
    small = df.join(hot, _same_keys(keys, "_hot_"), "left_anti")
    return small.withColumn(out, plain).unionByName(_ordinal_by_ranges(large, keys, order, out))


def chunked_series(df: DataFrame, entity: Sequence[str], time: str, *, halo: int, chunk: int = 100_000, hot_rows: int = 1_000_000) -> DataFrame:
    """Cut long series in chunks that overlap by ``halo`` rows.

    Adds ``pos`` (row number in the series, from 0), ``chunk`` and ``own`` (false
    for a row that is only there as neighbour). Any window frame of at most
    ``halo`` rows on either side is exact on ``partitionBy(entity, chunk)`` for
    the rows with ``own``.
    """
    entity = list(entity)
    numbered = ordinal_in_group(df, entity, [time], "_rn", hot_rows).withColumn("pos", F.col("_rn") - 1).drop("_rn")
    home = F.floor(F.col("pos") / chunk)
    first = F.floor(F.greatest(F.col("pos") - halo, F.lit(0)) / chunk)
    last = F.floor((F.col("pos") + halo) / chunk)
    return numbered.withColumn("_home", home).withColumn("chunk", F.explode(F.sequence(first, last))).withColumn(
        "own", F.col("chunk") == F.col("_home")
    ).drop("_home")
