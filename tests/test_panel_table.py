"""The panel is put together from the large tables once, however often an audit reads it."""
from tabaudit.catalog.base import panel

FOLDER = "/root/testdata/sf0.001"


def test_panel_does_not_read_the_large_tables_again(spark):
    files = panel(spark, FOLDER).inputFiles()
    assert files and not [f for f in files if FOLDER in f]


def test_panel_holds_every_line_once(spark):
    lines = spark.read.parquet(f"{FOLDER}/lineitem.parquet")
    orders, customer = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("orders", "customer"))
    n = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(customer, orders.o_custkey == customer.c_custkey).count()
    assert sum(r["n_lines"] for r in panel(spark, FOLDER).collect()) == n
