"""Hot keys, rare keys, unmatched keys and nulls."""

import pytest

from sparkloom.operators.joins import hot_join, hot_keys, salted_join


@pytest.mark.parametrize("how", ["left", "inner"])
def test_equals_plain_join(spark, how):
    rows = [(i, "hot" if i % 3 == 0 else f"k{i % 700}") for i in range(6000)] + [(9000, "nobody"), (9001, None)]
    left = spark.createDataFrame(rows, "id long, value string")
    counts = left.filter("value is not null and value <> 'nobody'").groupBy("value").count().selectExpr("value", "count as n", "upper(value) as big")
    got = hot_join(left, counts, "value", "id", "n", len(rows), how)
    want = left.join(counts, "value", how).select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_empty_sides(spark):
    left = spark.createDataFrame([(1, "a")], "id long, value string")
    classes = spark.createDataFrame([("a", 1, "x")], "value string, n long, big string")
    assert hot_join(left.limit(0), classes, "value", "id", "n", 0).count() == 0
    assert hot_join(left, classes.limit(0), "value", "id", "n", 1).head().big is None


def test_salted_join_equals_plain_join(spark):
    many = spark.createDataFrame([("hub" if i % 4 else f"k{i % 90}", i) for i in range(8000)], "a string, b long")
    few = spark.createDataFrame([(q, a) for q in range(5) for a in ("hub", "k1", "k8", "none", None)], "q long, a string")
    hot = hot_keys(many, "a")
    assert [r.a for r in hot.collect()] == ["hub"]
    got = salted_join(few, many, "a", "b", hot)
    want = few.join(many, "a").select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
