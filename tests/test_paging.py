"""Pages found by the last row of the page before."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from holdfast.operators.keys import page_after
from holdfast.plans import institutions
from holdfast.plans.institutions import RankFilter

ROWS = [(a, b, i) for i, (a, b) in enumerate([(1, "x"), (None, "y"), (2, None), (2, "z"), (1, None), (None, None), (2, "a"), (1, "x"), (3, "q")])]


@pytest.mark.parametrize("order", [
    [("a", True), ("b", False), ("i", False)], [("a", False), ("b", True), ("i", True)], [("b", True), ("a", True), ("i", False)], [("b", False), ("i", True)],
])
def test_pages_follow_each_other_over_nulls_and_ties(spark, order):
    df = spark.createDataFrame(ROWS, "a int, b string, i int")
    whole = [tuple(r) for r in df.orderBy(*(F.col(n).desc() if d else F.col(n).asc() for n, d in order)).collect()]
    last, seen = None, []
    while rows := page_after(df, order, last, 2).collect():
        seen += [tuple(r) for r in rows]
        last = rows[-1].asDict()
    assert seen == whole


def test_page_after_keeps_its_size_only_and_reaches_the_scan(spark, folder):
    spark.range(10_000).withColumn("v", F.col("id") % 97).write.parquet(folder)
    rows = page_after(spark.read.parquet(folder), [("v", True), ("id", False)], {"v": 40, "id": 5000}, 7)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=7" in plan and "LessThanOrEqual(v,40)" in plan
    assert page_after(spark.read.parquet(folder), [("id", False)], {"id": 9999}, 7).count() == 0
    with pytest.raises(ValueError):
        page_after(rows, [("id", False)], None, 0)


@pytest.mark.parametrize("f", [RankFilter(sort_by="concentrated", descending=False), RankFilter(sort_by="new_exited"), RankFilter(sort_by="institution")])
def test_walking_the_ranking_equals_the_pages(warehouse, f):
    quarter = warehouse.latest_quarter()
    first = institutions.institutions_after(warehouse, None, quarter, f, 15).collect()
    second = institutions.institutions_after(warehouse, first[-1].asDict(), quarter, f, 15).collect()
    assert first == institutions.rank_institutions(warehouse, quarter, f, 1, 15).collect()
    assert second == institutions.rank_institutions(warehouse, quarter, f, 2, 15).collect()


def test_unknown_sort_key(warehouse):
    with pytest.raises(ValueError):
        institutions.institutions_after(warehouse, None, None, replace(RankFilter(), sort_by="nonsense"))
