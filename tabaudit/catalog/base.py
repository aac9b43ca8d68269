"""Input tables of the registered queries, and the SQL fragments that mirror them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabaudit.functions.lineage import cut
from tabaudit.functions.rng import HEX_DIGITS

Query = Callable[[SparkSession, str], DataFrame]

LINE_ID = ["rid"]


class Catalog:
    """Named queries with their SQL twin (none where SQL cannot express them)."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, fn: Query, sql: str | None = None) -> None:
        self.queries[name] = fn
        if sql is not None:
            self.sql[name] = sql


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lineitem(spark: SparkSession, folder: str) -> DataFrame:
    li = table(spark, folder, "lineitem")
    day = F.col("l_shipdate").cast("date").cast("string")
    rid = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")], day)
    return li.withColumn("ship_year", F.year("l_shipdate")).withColumn("rid", rid)


def orders(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").withColumn("o_year", F.year("o_orderdate"))


def panel(spark: SparkSession, folder: str) -> DataFrame:
    """Nation of the customer x quarter of shipment; one row per (entity, t).

    The few cells are written, as the audits read them many times; so lineitem is shuffled
    once, by order, and as four columns.
    """
    li = table(spark, folder, "lineitem")
    t = (F.year("l_shipdate") - 1995) * 4 + F.quarter("l_shipdate") - 1
    # whole numbers: the sum does not depend on the order of the rows
    ten_thousandths = (F.round(F.col("l_extendedprice") * 100) * F.round(100 - F.col("l_discount") * 100)).cast("long")
    lines = li.select("l_orderkey", t.alias("t"), ten_thousandths.alias("s"), "l_quantity")
    o = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, folder, "nation").select("n_nationkey", "n_name")
    home = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    joined = lines.join(home, F.col("l_orderkey") == F.col("o_orderkey"))
    # few (nation, quarter) cells: aggregate before the name is joined
    cells = joined.groupBy("c_nationkey", "t").agg(
        F.sum("s").alias("s"),
        F.sum("l_quantity").alias("quantity"),
        F.count(F.lit(1)).cast("double").alias("n_lines"),
    )
    out = cells.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    revenue = F.expr("(s + 50) div 100") / F.lit(100.0)
    return cut(out.select(F.col("n_name").alias("entity"), F.col("t").cast("int").alias("t"), revenue.alias("revenue"), "quantity", "n_lines"))


def u(key: str, salt: str) -> str:
    """SQL of the hash uniform over the text expression ``key``."""
    return f"(cast('0x' || substr(md5({key} || '-{salt}'), 1, {HEX_DIGITS}) as bigint) / {float(16 ** HEX_DIGITS)})"


RID = "(l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || cast(l_shipdate as date))"
LINEITEM = f"(select *, cast(year(l_shipdate) as int) as ship_year, {RID} as rid from lineitem)"
ORDERS = "(select *, cast(year(o_orderdate) as int) as o_year from orders)"
PANEL = """(select n_name as entity, t, revenue, quantity, n_lines from (
  select c_nationkey, cast((year(l_shipdate) - 1995) * 4 + quarter(l_shipdate) - 1 as int) as t,
         cast((sum(cast(round(l_extendedprice * 100) * round(100 - l_discount * 100) as bigint)) + 50) // 100 as double) / 100.0 as revenue, sum(l_quantity) as quantity,
         cast(count(*) as double) as n_lines
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
  group by 1, 2) join nation on c_nationkey = n_nationkey)"""


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Round the named double columns, so that summation order does not show."""
    return df.withColumns({c: F.round(F.col(c), n) for c, n in digits.items()})
