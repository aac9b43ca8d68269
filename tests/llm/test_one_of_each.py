"""one_of_each keeps one row a class where ids are null or repeated."""
from tabaudit.llm import jaccard

BASE = [f"w{i}" for i in range(60)]
NEAR = " ".join([*BASE, "more"])
BASE = " ".join(BASE)
ALONE, OTHER, FAR = (" ".join(f"{k}{i}" for i in range(40)) for k in "xyz")


def kept(spark, rows):
    df = spark.createDataFrame([(*r, "other column") for r in rows], "doc_id long, text string, more string")
    return sorted(((r.doc_id is None, r.doc_id or 0, r.text or "") for r in jaccard.one_of_each(df).collect()))


def test_null_ids(spark):
    assert len(kept(spark, [(None, BASE), (None, NEAR), (None, BASE)])) == 1
    assert kept(spark, [(None, BASE), (5, NEAR), (None, NEAR), (7, BASE)]) == [(False, 5, NEAR)]


def test_repeated_ids(spark):
    # id 2 names a copy of document 1 and a document of its own
    rows = [(1, BASE), (2, NEAR), (2, ALONE), (3, OTHER), (3, FAR), (4, None), (4, None)]
    assert kept(spark, rows) == sorted([(False, 1, BASE), (False, 2, ALONE), (False, 3, OTHER), (False, 3, FAR), (False, 4, "")])
